"""Terms, scoring, decisions, parameters, statistics and manifests on small examples."""

import json

import pytest
from pyspark.sql import functions as F

from winnow import fixture as X
from winnow.functions.text import NormRules, label_key, normalize, rules_from_table
from winnow.operators import analytics as A
from winnow.operators import results as R
from winnow.operators import terms as T
from winnow.params import Params, check_config, generate_config, load_config
from winnow.plans import manifest as MF
from winnow.plans.engine import TriageEngine, require_articles

ARTICLE = "id string, title string, abstract string, manual_tags string"


def articles(spark, *rows):
    return spark.createDataFrame(list(rows), ARTICLE)


def decide(spark, terms, rows, **params):
    e = TriageEngine.build(X.raw_terms(spark, terms), Params(**params))
    return {r["id"]: r for r in e.decide(articles(spark, *rows)).collect()}


# -- parameters ---------------------------------------------------------------------------


def test_defaults():
    p = Params.from_dict({})
    assert (p.max_gap, p.no_tags_uplift, p.max_section_score, p.policy) == (2, 1.17, 30.0, "special")
    assert p.approval[5] is None and p.weak_levels == (5,) and p.configured_levels == ()


def test_legacy_names_and_text_keys():
    p = Params.from_dict(
        {
            "UPLIFT_NO_MANUAL_TAGS": 1.5, "MAX_SCORE_POR_SECAO": 12, "THRESHOLD_APROVACAO_ESPECIAL": 9,
            "PONTUACAO_NIVEIS": {"1": 5, "2": 3}, "LIMITES_APROVADO": {"1": 4, "2": None},
            "MAX_GAP_BETWEEN_TERMS": -4,
        }
    )
    assert (p.no_tags_uplift, p.max_section_score, p.special_threshold, p.max_gap) == (1.5, 12.0, 9.0, 0)
    assert p.level_scores == {1: 5, 2: 3} and p.approval == {1: 4.0, 2: None}
    assert p.weak_levels == (2,) and p.level_order == (1, 2) and p.configured_levels == (1, 2)


def test_presets():
    assert Params.preset("binary").level_scores == {1: 10}
    assert Params.preset("simple", ["A"]).block_order == ("A",)
    assert Params.preset("standard").approval == {1: 10.0, 2: 12.0, 3: 18.0, 4: 22.0, 5: None}
    assert Params.custom({1: 3}, {1: 2}, {1: 1}).flagging == {1: 1.0}
    with pytest.raises(ValueError, match="no preset"):
        Params.preset("none")
    with pytest.raises(ValueError):
        Params.custom({}, {}, {})


def test_load_and_check_config(spark, tmp_path):
    cfg = generate_config({"level_scores": {1: 10}, "approval": {1: 5}, "flagging": {1: -3}}, ["A", "B"])
    cfg["global"]["DECISION_POLICY"] = "vote"
    path = tmp_path / "config.json"
    path.write_text(json.dumps(cfg))
    loaded = load_config(spark, str(path))
    issues = check_config(loaded, {"A": 0, "B": None})
    assert [s for s, _ in issues] == ["warning", "error", "error", "warning"]
    assert check_config({}, {})[0] == ("error", "The configuration has no 'global' settings")


# -- text ---------------------------------------------------------------------------------


def test_normalize(spark):
    rules = NormRules(
        abbreviations={"ai": "artificial intelligence", "a": "one"},
        compound_variants={"supply-chain": "supply chain"},
        symbol_replacements={"&": " and ", "c#": "csharp", "$": r"\dollar$1"},
    )
    cases = {
        "AI  &\tAI": "artificial intelligence and artificial intelligence",
        " Supply-Chain x": "supply chain x",
        "C# xc# c#y": "csharp xc# csharpy",
        "AIM a$": r"aim one\dollar$1",
        "É É": "é é",
        " \n ": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.n for r in df.select("t", normalize(F.col("t"), rules).alias("n")).collect()}
    assert got == cases


def test_rules_from_table(spark):
    raw = X.raw_terms(
        spark,
        [
            ("", "", "AI", "", "any", "0", "abbreviation", "Artificial Intelligence"),
            ("", "", "ai", "", "any", "0", "Abbreviation ", "augmented"),
            ("", "", "&", "", "any", "0", "symbol_replacement", " and"),
            ("", "", "x", "", "any", "0", "unknown", "y"),
            ("", "", "z", "", "any", "0", "", "y"),
            ("A", "pos", "artificial", "1", "any", "0", "", ""),
        ],
    )
    rules = rules_from_table(T.norm_rules(raw))
    assert rules.abbreviations == {"ai": "augmented"} and rules.symbol_replacements == {"&": "and"}
    codes = sorted(r["code"] for r in T.lint(raw).collect())
    assert codes == ["empty_field", "rule_overwritten", "rule_type", "rule_without_type"]


def test_terms_are_normalised_like_texts(spark):
    e = TriageEngine.build(
        X.raw_terms(
            spark,
            [
                ("A", "pos", "AI tools", "1", "any", "0"),
                ("", "", "AI", "", "any", "0", "abbreviation", "artificial intelligence"),
            ],
        )
    )
    df = articles(spark, ("1", "Artificial Intelligence Tools", "", ""), ("2", "our AI tools", "", ""))
    assert e.hits(df, "id").count() == 2
    marked = [r["Title_Highlighted"] for r in e.highlight(df).collect()]
    assert marked == ["***ARTIFICIAL INTELLIGENCE TOOLS***", "our ***AI TOOLS***"]


def test_label_key():
    assert label_key("Título ") == "titulo" and label_key("Manual_Tags") == "manualtags"


# -- term tables --------------------------------------------------------------------------


def test_lint(spark):
    raw = X.raw_terms(
        spark,
        [
            ("A", "pos", "oil", "1", "any", "0"),  # 0
            ("A", "POS", "OIL", "1.0", "any", "0"),  # 1 duplicate of 0
            ("A", "anti", "oil", "", "any", "0"),  # 2 contradicts 0
            ("A", "pos", "x", "2.5", "body", "maybe"),  # 3 broad, level, scope, is_regex
            ("A", "bad", "y", "1", "any", "0"),  # 4
            ("", "pos", "", "1", "any", "0"),  # 5
            ("A", "flag", "gas", "3", "any", "0"),  # 6 level ignored
            ("A", "pos", "nine", "9", "any", "0"),  # 7 level not configured
            ("A", "pos", "(", "1", "any", "1"),  # 8 bad regex
            ("B", "flag", "gas", "", "any", "0"),  # 9 B has no positives
            ("Z", "pos", "gas", "", "any", "0"),  # 10 not in order, no level
        ],
    )
    params = Params(configured_levels=(1, 2), block_order=("a", "B "))
    found = {(r["source_row"], r["severity"], r["code"]) for r in T.lint(raw, params).collect()}
    assert found == {
        (1, "warning", "duplicate"), (0, "error", "pos_and_anti"), (3, "warning", "too_broad"),
        (3, "warning", "level_invalid"), (3, "warning", "scope"), (3, "warning", "is_regex"),
        (4, "warning", "kind"), (5, "warning", "empty_field"), (6, "warning", "level_ignored"),
        (7, "warning", "level_unknown"), (8, "warning", "regex"), (None, "warning", "no_positives"),
        (None, "warning", "block_ignored"), (10, "warning", "level_missing"),
    }


def test_clean_keeps_rules_that_differ(spark):
    rows = [
        ("A", "pos", "oil", "1", "any", "0"),
        ("A", "pos", "oil", "2", "any", "0"),
        ("A", "pos", "oil", "1", "title", "0"),
        ("A", "pos", "oil", "1", "any", "yes"),
        ("A", "flag", "gas", "1", "any", "0"),
        ("A", "flag", "gas", "", "any", "0"),
        ("A", "flag", "GAS", "", "any", "0"),
    ]
    terms = T.clean(X.raw_terms(spark, rows)).orderBy("source_row").collect()
    assert [t["source_row"] for t in terms] == [0, 1, 2, 3, 4, 5]
    assert [t["level"] for t in terms] == [1, 2, 1, 1, None, None]


def test_headers(spark):
    raw = spark.createDataFrame([("A", "pos", "oil", 0)], "` BLOCK` string, Kind string, term string, source_row int")
    term = T.clean(raw).first()
    assert (term["block"], term["scope"], term["level"]) == ("A", "any", None)
    with pytest.raises(ValueError, match="lacks columns"):
        T.clean(spark.createDataFrame([("A",)], "block string"))


def test_routing(spark):
    rows = [
        ("ctx ", "pos", "a1", "1", "any", "0"), ("TECH", "pos", "b1", "1", "any", "0"),
        ("GLOBAL", "flag", "c1", "", "any", "0"), ("OTHER", "pos", "d1", "1", "any", "0"),
    ]
    terms = T.clean(X.raw_terms(spark, rows))
    routed = T.route(terms, ("TECH", "MISSING", "CTX"))
    assert routed.blocks == ("TECH", "CTX") and routed.has_t0
    assert [r["block"] for r in T.browse(routed).collect()] == ["TECH", "CTX", "T0"]
    assert T.browse(routed, kind="flag").count() == 1 and T.browse(routed, block="CTX").count() == 1
    assert T.route(terms).blocks == ("OTHER", "TECH", "ctx")


def test_inline_terms_come_first(spark):
    cfg = {
        "A": {"positives": [{"term": "oil", "level": "2"}], "anti": {"flag": [{"term": "gas"}]}},
        "C": {"positives": [{"term": "c[a-z]", "level": 1, "regex": True}]},
        "global": {"BLOCK_ORDER": ["A"]},
    }
    raw = X.raw_terms(spark, [("a", "pos", "tar", "1", "any", "0")])
    e = TriageEngine.build(raw, Params(block_order=("A", "C")), inline=T.inline_terms(spark, cfg))
    listed = [(r["block"], r["kind"], r["term"], r["level"]) for r in T.browse(e.term_set).collect()]
    assert listed == [
        ("A", "pos", "oil", 2), ("A", "pos", "tar", 1), ("A", "flag", "gas", None), ("C", "pos", "c[a-z]", 1),
    ]


def test_contradictions_stop_the_run(spark):
    rows = [("A", "pos", "oil", "1", "any", "0"), ("A", "flag", "Oil", "", "any", "0")]
    with pytest.raises(ValueError, match="Contradicting"):
        TriageEngine.build(X.raw_terms(spark, rows))
    ok = [("GLOBAL", *r[1:]) for r in rows] + [("A", "pos", "x1", "1", "any", "0")]
    assert TriageEngine.build(X.raw_terms(spark, ok)).has_t0


def test_bad_regex_is_left_out(spark):
    rows = [("A", "pos", "(", "1", "any", "1"), ("A", "pos", "oil", "1", "any", "0")]
    e = TriageEngine.build(X.raw_terms(spark, rows))
    assert e.hits(articles(spark, ("1", "( oil", "", "")), "id").count() == 1


# -- scores and decisions -----------------------------------------------------------------

TWO = [
    ("A", "pos", "oil", "1", "any", "0"), ("A", "pos", "gas", "1", "any", "0"),
    ("A", "pos", "tar", "5", "any", "0"), ("A", "flag", "coal", "", "any", "0"),
    ("A", "anti", "peat", "", "any", "0"), ("B", "pos", "wind", "1", "any", "0"),
    ("B", "pos", "sun", "3", "any", "0"), ("B", "pos", "nolevel", "", "any", "0"),
]


def evals(row):
    return {e["block"]: e for e in row["evals"]}


def test_levels_count_once_per_section(spark):
    row = decide(spark, TWO, [("1", "oil gas tar", "oil", "x")])["1"]
    a = evals(row)["A"]
    assert (a["raw_score"], a["best_level"], a["uplift"]) == (2 * 12.0 + 10.0, 1, False)
    assert a["reason"] == "Score 34.00 >= threshold 10 (L1)"


def test_uplift_and_tag_texts(spark):
    rows = [("1", "sun", "", " NaN "), ("2", "sun", "", "t"), ("3", "sun", "", "")]
    got = decide(spark, TWO, rows, fail_fast=False)
    scores = [round(evals(got[i])["B"]["final_score"], 4) for i in ("1", "2", "3")]
    assert scores == [14.04, 12.0, 14.04]
    assert evals(got["2"])["B"]["reason"] == "Score 12.00 >= flag threshold 6 (L3)"


def test_configured_thresholds_print_as_floats(spark):
    p = Params.from_dict({"LIMITES_APROVADO": {"1": 10}, "LIMITES_SINALIZADO": {"1": 2}})
    e = TriageEngine.build(X.raw_terms(spark, TWO), p)
    row = e.decide(articles(spark, ("1", "oil", "", "x"))).first()
    assert evals(row)["A"]["reason"] == "Score 20.00 >= threshold 10.0 (L1)"


def test_section_cap(spark):
    rows = [("A", "pos", f"w{i}", str(i), "any", "0") for i in range(1, 6)]
    row = decide(spark, rows, [("1", "w1 w2 w3 w4 w5", "w1 w2 w3 w4 w5", "x")], max_section_score=20.0)["1"]
    assert evals(row)["A"]["raw_score"] == 60.0


def test_exclusion_keeps_the_score(spark):
    a = evals(decide(spark, TWO, [("1", "oil peat coal", "", "x")])["1"])["A"]
    assert (a["status"], a["reason"], a["raw_score"]) == ("REJECTED", "Anti-exclusion: peat", 20.0)


def test_warning_only_lowers_approved(spark):
    got = decide(spark, TWO, [("1", "oil coal", "", "x"), ("2", "coal", "", "x")])
    assert evals(got["1"])["A"]["reason"] == "Downgraded to flagged: anti-flag term 'coal'"
    assert evals(got["2"])["A"]["reason"] == "No positive terms found"


def test_hit_without_level(spark):
    b = evals(decide(spark, TWO, [("1", "nolevel", "", "x")], fail_fast=False)["1"])["B"]
    assert (b["status"], b["reason"], len(b["pos"])) == ("REJECTED", "No positive terms found", 1)


def test_fail_fast_clears_later_blocks(spark):
    row = decide(spark, TWO, [("1", "wind", "", "x")])["1"]
    b = evals(row)["B"]
    assert (b["status"], b["reason"], b["final_score"], len(b["pos"])) == (
        "NOT_EVALUATED", "Previous block rejected", 0.0, 0,
    )
    assert row["Decision_Reason"] == "Rejected blocks: A"


def test_strict_flags_before_it_rejects(spark):
    # B is flagged by score, A rejected: fail-fast decides the outcome.
    rows = [("1", "sun", "", "x")]
    assert decide(spark, TWO, rows, policy="strict")["1"]["Final_Decision"] == "REJECTED_FINAL"
    assert decide(spark, TWO, rows, policy="strict", fail_fast=False)["1"]["Final_Decision"] == "FLAGGED_FINAL"


def test_special_rule(spark):
    strong = ("1", "oil gas", "oil tar", "oil tar")  # A: 20 + 12 + 18 = 50
    weak = ("2", "oil", "", "x")
    rows = [(i, t + " sun", a, g) for i, t, a, g in (strong, weak)]
    got = decide(spark, TWO, rows)
    assert got["1"]["Decision_Reason"] == "Special rule: 1 approved (scores >= 40.0)"
    assert got["2"]["Decision_Reason"] == "Flagged blocks: B"
    off = decide(spark, TWO, rows, special_rule=False)
    assert off["1"]["Final_Decision"] == "FLAGGED_FINAL"


def test_k_of_n(spark):
    rows = [("1", "oil sun", "", "x"), ("2", "oil wind", "", "x")]
    one = decide(spark, TWO, rows, policy="k_of_n")
    assert one["1"]["Decision_Reason"] == "1 approved, 1 flagged"
    assert one["2"]["Decision_Reason"] == "2/2 approved (k_of_n)"
    assert decide(spark, TWO, rows, policy="k_of_n", max_flagged_blocks=1)["1"]["Final_Decision"] == "APPROVED_FINAL"


def test_unknown_policy_is_special(spark):
    assert decide(spark, TWO, [("1", "oil wind", "", "x")], policy="vote")["1"]["Decision_Reason"] == "All blocks approved"


def test_no_blocks(spark):
    e = TriageEngine.build(X.raw_terms(spark, [("GLOBAL", "flag", "oil", "", "any", "0")]))
    rows = e.run(articles(spark, ("1", "oil", "", ""))).collect()
    assert (rows[0]["Final_Decision"], rows[0]["Decision_Reason"]) == ("REJECTED_FINAL", "No domain blocks configured")
    assert rows[0]["Status_T0"] == "FLAGGED"


def test_t0_rejects_before_blocks(spark):
    rows = [*TWO, ("GLOBAL", "anti", "retracted", "", "title", "0"), ("GLOBAL", "pos", "hello", "1", "any", "0")]
    e = TriageEngine.build(X.raw_terms(spark, rows))
    df = articles(spark, ("1", "retracted hello oil wind", "", "x"), ("2", "oil wind", "retracted", "x"))
    first, second = e.run(df).collect()
    assert first["Decision_Reason"] == "T0: Global exclusion: retracted"
    assert (first["Status_A"], first["FinalScore_A"], first["Highlights_A"]) == ("NOT_EVALUATED", 0.0, "")
    assert first["AntiHighlights_T0"] == "retracted:title:8"
    # Marked whether or not the blocks were evaluated; pre-screen positives too.
    assert first["Title_Highlighted"] == "***RETRACTED*** ***HELLO*** ***OIL*** ***WIND***"
    assert second["Final_Decision"] == "APPROVED_FINAL"


def test_packing(spark):
    rows = [('A', "pos", 'say "hi" and go', "1", "any", "0"), ("A", "pos", "back\\slash", "", "any", "0")]
    e = TriageEngine.build(X.raw_terms(spark, rows))
    row = e.run(articles(spark, ("1", 'say "hi" and go', "back\\slash", "x"))).first()
    assert row["Highlights_A"].split(" | ") == [
        r'term="say \"hi\" and go" sec=title L=1 row=0 type=exact',
        r'term="say \"hi\" and go" sec=title L=1 row=0 type=proximity comps=say "hi"+go',
        r'term="back\\slash" sec=abstract L=None row=1 type=exact',
    ]


def test_coverage_reads_packed_terms(spark):
    rows = [("A", "pos", 'pipe 5" | x', "1", "any", "0"), ("A", "pos", "a\\\\b", "2", "any", "0")]
    e = TriageEngine.build(X.raw_terms(spark, rows))
    df = articles(spark, ("1", 'a pipe 5" | x', "a\\\\b", "x"), ("2", "a\\\\b", "", "x"))
    stored = A.coverage_of_results(e.run(df)).orderBy("term").collect()
    assert stored == A.term_coverage(e.decide(df)).orderBy("term").collect()
    assert {r["term"]: (r["hits"], r["articles"]) for r in stored} == {'pipe 5" | x': (1, 1), "a\\\\b": (2, 2)}


def test_result_columns(spark):
    e = TriageEngine.build(X.raw_terms(spark, TWO))
    df = e.run(articles(spark, (None, "oil", None, None)), id_output="Ref")
    assert df.columns[:4] == ["Ref", "Title_Highlighted", "Abstract_Highlighted", "Tags_Highlighted"]
    assert df.columns[-4:] == ["Final_Decision", "Decision_Reason", "triage_version", "run_timestamp"]
    assert df.first()["Ref"] == "NO_ID"
    with pytest.raises(ValueError, match="generated"):
        e.run(articles(spark), id_output="Status_A")
    with pytest.raises(ValueError, match="no articles"):
        require_articles(articles(spark))


def test_duplicate_ids_stay_separate(spark):
    e = TriageEngine.build(X.raw_terms(spark, TWO))
    rows = e.run(articles(spark, ("1", "oil", "", ""), ("1", "wind", "", ""), ("1", "oil", "", ""))).collect()
    assert len(rows) == 3


def test_sample(spark):
    df = articles(spark, *[("same", f"t{i}", "", "") for i in range(30)])
    one, two = (sorted(r["title"] for r in R.sample_articles(df, 10, 7).collect()) for _ in range(2))
    assert one == two and len(set(one)) == 10
    assert one != sorted(r["title"] for r in R.sample_articles(df, 10, 8).collect())
    assert R.sample_articles(df, 99).count() == 30
    with pytest.raises(ValueError):
        R.sample_articles(df, 0)


def test_page_and_detail(spark):
    rows = [(str(i), "FLAGGED_FINAL" if i % 2 else "REJECTED_FINAL", "x" * 600, 1.0) for i in range(120)]
    df = spark.createDataFrame(rows, "ID string, Final_Decision string, Decision_Reason string, FinalScore_A double")
    key = F.col("ID").cast("int")
    first = R.page(df, key, None, "FLAGGED_FINAL").collect()
    assert len(first) == 50 and first[-1]["ID"] == "99" and len(R.page(df, key, size=7).collect()) == 7
    page = R.page(df, key, 99, "FLAGGED_FINAL").collect()
    assert len(page) == 10 and page[0]["ID"] == "101" and list(page[0].asDict()) == ["ID", "Final_Decision", "FinalScore_A"]
    detail = {r["name"]: r["value"] for r in R.detail(df, "ID", "3").collect()}
    assert detail["ID"] == "3" and len(detail["Decision_Reason"]) == 500 and detail["Decision_Reason"].endswith("...")


def test_error_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "bad record")], "n int, error string")
    good, failed = R.split_errors(df)
    assert good.columns == ["n"] and good.count() == 1
    errors = R.error_results(failed, "n", Params())
    e = TriageEngine.build(X.raw_terms(spark, TWO))
    whole = R.with_errors(e.run(articles(spark, ("1", "oil wind", "", "x"))), errors)
    stats = A.totals(whole).first()
    assert (stats["n_total"], stats["n_valid"], stats["n_error"], stats["error_rate"]) == (2, 1, 1, 0.5)
    row = whole.filter("ID = 'ERR_2'").first()
    assert (row["Final_Decision"], row["Decision_Reason"], row["Status_A"]) == (
        "FLAGGED_FINAL", "Processing error: bad record", None,
    )
    performance = {r["block"]: r["n_valid"] for r in A.block_performance(whole).collect()}
    assert performance == {"A": 1, "B": 1}
    with pytest.raises(Exception, match="bad record"):
        R.error_results(failed, "n", Params(error_policy="fail")).collect()
    with pytest.raises(RuntimeError, match="50.0%"):
        R.check_error_rate(2, 1, Params())
    R.check_error_rate(2, 1, Params(max_error_rate=-1))


def test_diff(spark):
    a = spark.createDataFrame([("1", "X"), ("1", "X"), ("2", "Y"), (None, "Z")], "ID string, Final_Decision string")
    b = spark.createDataFrame([("1", "Y"), ("1", "X"), ("3", "Y")], "ID string, Final_Decision string")
    got = {(r["article_id"], r["old"], r["new"]): r["n"] for r in A.run_diff(a, b).collect()}
    assert got == {
        ("1", "X", "Y"): 2, ("2", "Y", "MISSING"): 1, ("3", "MISSING", "Y"): 1, ("MISSING", "Z", "MISSING"): 1,
    }
    with pytest.raises(ValueError, match="first"):
        A.run_diff(a.drop("Final_Decision"), b)
    with pytest.raises(ValueError, match="No common id"):
        A.run_diff(a, b.withColumnRenamed("ID", "other"))


def test_broad_terms_need_a_corpus(spark):
    e = TriageEngine.build(X.raw_terms(spark, TWO))
    few = articles(spark, *[(str(i), "oil wind", "", "") for i in range(9)])
    many = articles(spark, *[(str(i), "oil wind", "oil", "") for i in range(10)])
    report = lambda df: A.coverage_report(e.decide(df), e.term_set, df)
    assert A.broad_terms(report(few)).isEmpty()
    assert {r["term"] for r in A.dead_terms(report(few)).collect()} == {"gas", "tar", "sun", "nolevel"}
    found = A.broad_terms(report(many)).orderBy("term").collect()
    assert [(r["term"], r["articles"], r["hits"], r["pct"]) for r in found] == [
        ("oil", 10, 20, 100.0), ("wind", 10, 10, 100.0),
    ]
    assert A.block_discrimination(report(many)).count() == 2


# -- manifests ----------------------------------------------------------------------------


def test_manifest_round_trip(spark):
    row = MF.manifest(spark, Params(), ("A",), 10, 2.0, {"input_file": "x"}, "out", {"sample_size": 5}).toDF(
        *MF.manifest(spark, Params(), ("A",), 10, 2.0, {}).columns
    )
    assert row.first()["processing"]["articles_per_second"] == 5.0
    docs = row.select(F.to_json(F.struct("*")).alias("document"))
    assert MF.validate_manifests(docs).first()["errors"] == []


def test_migration_keeps_what_is_there(spark):
    doc = json.dumps({"protocol_version": "1.0", "inputs": {"a": [1, "x"]}, "note": 'q"', "triage_version": "2"})
    future = json.dumps({"protocol_version": "9"})
    df = spark.createDataFrame([(doc,), (future,), ("{}",)], "document string")
    first, second, third = MF.migrate_manifests(df).collect()
    got = json.loads(first["migrated"])
    assert got["inputs"] == {"a": [1, "x"]} and got["note"] == 'q"' and got["protocol_version"] == "2.1"
    assert got["configuration"] == {} and got["triage_version"] == "2" and "methodology" in got
    assert second["migrated"] is None and "9" in second["error"] and "None" in third["error"]


def test_hashes(spark):
    assert MF.config_hash(Params()) == MF.config_hash(Params()) != MF.config_hash(Params(max_gap=1))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "i int, t string")
    one = MF.table_fingerprint(df).first()
    two = MF.table_fingerprint(df.orderBy(F.desc("i")).repartition(3)).first()
    assert one == two and one["n_rows"] == 3
    assert one["hash"] != MF.table_fingerprint(df.distinct()).first()["hash"]
    assert MF.config_audit(Params())["_metadata"]["config_hash"] == MF.config_hash(Params())


def test_row_numbers_beyond_32_bits(spark):
    rows = [(3_000_000_000 + i, "A", "pos", t, "1") for i, t in enumerate(["oil and gas or coal", "oil", "OIL", ""])]
    raw = spark.createDataFrame(rows, "source_row long, block string, kind string, term string, level string")
    assert [r.source_row for r in T.clean(raw).orderBy("source_row").collect()] == [3_000_000_000, 3_000_000_001]
    assert [(r.source_row, r.first_row) for r in T.duplicates(raw).collect()] == [(3_000_000_002, 3_000_000_001)]
    assert 3_000_000_003 in [r.source_row for r in T.lint(raw).collect()]
    docs = spark.createDataFrame([("1", "oil and gas or coal", "", "")], "id string, title string, abstract string, manual_tags string")
    hits = TriageEngine.build(raw, Params(block_order=("A",))).hits(docs, "id").collect()
    assert [(r.source_row, r.match_type) for r in hits] == [
        (3_000_000_000, "exact"), (3_000_000_001, "exact"), (3_000_000_000, "proximity"), (3_000_000_000, "proximity"),
    ]


def test_duplicates_of_a_rule_that_fills_the_table(spark):
    rows = [(i, "A", "pos", "oil" if i % 3 else f"t{i}", "1") for i in range(3000)] + [(9000, "A", "pos", "t0", "1")]
    raw = spark.createDataFrame(rows, "source_row long, block string, kind string, term string, level string")
    found = sorted((r.source_row, r.first_row) for r in T.duplicates(raw).collect())
    assert found == [*((i, 1) for i in range(2, 3000) if i % 3), (9000, 0)]
