"""From files to files."""

import json

import pytest

from winnow.params import PRESETS, generate_config
from winnow.plans import run as RUN


@pytest.fixture
def files(tmp_path):
    cfg = generate_config(PRESETS["standard"], ["CTX", "TECH"])
    cfg["output"]["csv"] = True
    cfg["TECH"] = {"positives": [{"term": "robot*", "level": 1}]}
    (tmp_path / "config.json").write_text(json.dumps(cfg))
    (tmp_path / "terms.csv").write_text(
        "block;kind;term;level;section_scope;is_regex\nctx;pos;oil and gas;1;any;0\nctx;pos;rig;3;any;0\n"
        "GLOBAL;anti;retracted;;title;0\nctx;oops;x;;any;0\n",
        encoding="utf-8-sig",
    )
    (tmp_path / "in.csv").write_text(
        "Key,Article Title,Abstract Note,Manual Tags\n"
        '1,Oil and gas robots,"a rig; with, commas",\n2,Retracted: oil and gas,,x\n3,Robots,rig,x\n'
    )
    return tmp_path


def test_run(spark, files):
    paths = [str(files / n) for n in ("in.csv", "config.json", "terms.csv")]
    written = RUN.run_triage(spark, *paths, str(files / "out"))
    rows = {r["ID"]: r for r in spark.read.parquet(written["parquet"]).collect()}
    assert rows["1"]["Final_Decision"] == "APPROVED_FINAL"
    assert rows["1"]["Title_Highlighted"] == "***OIL AND GAS*** ***ROBOTS***"
    assert rows["2"]["Decision_Reason"] == "T0: Global exclusion: retracted"
    assert rows["3"]["Decision_Reason"] == "Flagged blocks: CTX"
    report = {(r["part"], r["name"]): r["value"] for r in spark.read.parquet(written["report"]).collect()}
    assert report["decision", "REJECTED_FINAL"] >= 1
    manifest = spark.read.json(written["manifest"]).first()
    assert manifest["processing"]["total_articles"] == 3 and manifest["inputs"]["input_hash"]


def test_inspect(spark, files):
    setup = RUN.set_up(spark, *(str(files / n) for n in ("in.csv", "config.json", "terms.csv")))
    issues, findings, profile = RUN.inspect(setup)
    assert issues == []
    assert [(r["source_row"], r["code"]) for r in findings.collect()] == [(3, "kind")]
    assert {r["field"]: r["column"] for r in profile.collect()}["abstract"] == "Abstract Note"


def test_without_term_table(spark, files):
    paths = [str(files / n) for n in ("in.csv", "config.json")]
    written = RUN.run_triage(spark, *paths, None, str(files / "out2"))
    assert {r["ID"] for r in spark.read.parquet(written["parquet"]).filter("Final_Decision = 'APPROVED_FINAL'").collect()} == {"1", "3"}


def test_empty_input(spark, files):
    (files / "in.csv").write_text("Key,Title,Abstract\n")
    with pytest.raises(ValueError, match="no articles"):
        RUN.run_triage(spark, str(files / "in.csv"), str(files / "config.json"), None, str(files / "out3"))


def run(spark, files, cfg=None, terms=None, name="in.csv"):
    if cfg is not None:
        (files / "c.json").write_text(json.dumps(cfg))
    out = str(files / f"out-{len(list(files.iterdir()))}")
    config = str(files / ("c.json" if cfg is not None else "config.json"))
    return RUN.run_triage(spark, str(files / name), config, terms and str(files / terms), out)


def decisions(spark, written):
    return {r["ID"]: (r["Final_Decision"], r["Decision_Reason"]) for r in spark.read.parquet(written["parquet"]).collect()}


def test_pre_screen_in_the_configuration(spark, files):
    cfg = generate_config(PRESETS["standard"], ["TECH"])
    cfg["TECH"] = {"positives": [{"term": "oil", "level": 1}]}
    cfg["T0"] = {"anti": {"exclude": [{"term": "retracted"}]}}
    found = decisions(spark, run(spark, files, cfg))
    assert found["2"] == ("REJECTED_FINAL", "T0: Global exclusion: retracted")
    # A term table's global block takes its place.
    cfg["T0"] = {"anti": {"exclude": [{"term": "robots"}]}}
    found = decisions(spark, run(spark, files, cfg, "terms.csv"))
    assert found["2"][0] == "REJECTED_FINAL" and found["1"][0] == "APPROVED_FINAL"


def test_blocks_that_the_configuration_names(spark, files):
    cfg = generate_config(PRESETS["standard"], [])
    cfg |= {b: {"positives": [{"term": "oil", "level": 1}]} for b in ("A", "B")}
    columns = spark.read.parquet(run(spark, files, cfg | {"_domain_blocks": ["A"]})["parquet"]).columns
    assert "Status_A" in columns and "Status_B" not in columns


def test_rules_of_the_configuration(spark, files):
    cfg = generate_config(PRESETS["standard"], ["A"])
    cfg["A"] = {"positives": [{"term": "petroleum", "level": 1}]}
    cfg["normalization_rules"] = {"enabled": True, "abbreviations": {"Oil": "Petroleum"}}
    assert decisions(spark, run(spark, files, cfg))["1"][0] == "APPROVED_FINAL"
    cfg["normalization_rules"]["enabled"] = False
    assert decisions(spark, run(spark, files, cfg))["1"][0] == "REJECTED_FINAL"


def test_failed_rows_and_their_limit(spark, files):
    (files / "bad.csv").write_text("Key,Title,Abstract\n1,Oil robots,x\n2,a,b,c\n3,Robots,y\n")
    cfg = generate_config(PRESETS["standard"], ["TECH"])
    cfg["TECH"] = {"positives": [{"term": "robot*", "level": 1}]}
    cfg["global"]["MAX_ERROR_RATE"] = 0.5
    found = decisions(spark, run(spark, files, cfg, name="bad.csv"))
    assert found["ERR_2"][0] == "FLAGGED_FINAL" and found["ERR_2"][1].startswith("Processing error: ")
    assert set(found) == {"1", "ERR_2", "3"}
    cfg["global"]["MAX_ERROR_RATE"] = 0.1
    with pytest.raises(RuntimeError, match="exceeds the limit"):
        run(spark, files, cfg, name="bad.csv")
    assert not [p for p in files.iterdir() if p.name.startswith("out-") and not (p / "parquet").exists()]
    cfg["global"] |= {"ERROR_POLICY": "fail", "MAX_ERROR_RATE": 1.0}
    with pytest.raises(Exception, match="Processing error"):
        run(spark, files, cfg, name="bad.csv")


def test_findings_settings_and_odd_block_names(spark, files):
    (files / "t.csv").write_text("block;kind;term;level;section_scope;is_regex\nA.1;pos;oil;1;any;0\nA.1;pos;(;1;any;1\n")
    cfg = generate_config(PRESETS["standard"], [])
    written = run(spark, files, cfg, "t.csv")
    codes = {r["code"] for r in spark.read.parquet(written["findings"]).collect()}
    assert "regex" in codes
    settings = json.loads(spark.read.text(written["settings"]).first()["value"])
    assert settings["_metadata"]["config_hash"] and settings["policy"] == "special"
    blocks = {r["block"] for r in spark.read.parquet(written["report"]).collect()}
    assert "A.1" in blocks


def test_blocks_asked_for_but_not_there(spark, files):
    cfg = generate_config(PRESETS["standard"], ["CTX", "GONE"])
    (files / "c.json").write_text(json.dumps(cfg))
    setup = RUN.set_up(spark, *(str(files / n) for n in ("in.csv", "c.json", "terms.csv")))
    assert ("error", "Block 'GONE' is asked for, but has no terms") in RUN.inspect(setup)[0]
