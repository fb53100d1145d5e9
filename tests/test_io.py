"""Sources, sinks and streams."""

import pytest
from pyspark.sql import functions as F

from winnow import fixture as X
from winnow.operators import analytics as A
from winnow.operators import results
from winnow.operators.results import split_errors
from winnow.sources import sinks, tables
from winnow.streaming.stream import triage_stream, write_stream


def test_separators(spark, tmp_path):
    cases = {
        "a.csv": "Key;Title;Abstract Note\n1;t;x, y, z\n",
        "b.csv": 'Key,Title,Abstract Note\n1,t,"x; y; z; w"\n',
        "c.tsv": "Key\tTitle\tAbstract Note\n1\tt\tx; y\n",
        "d.txt": "Key\tTitle\tAbstract Note\n1\tt\t\n",
    }
    for name, text in cases.items():
        (tmp_path / name).write_text(text)
        df = tables.read_table(spark, str(tmp_path / name))
        assert df.columns == ["Key", "Title", "Abstract Note"], name
        assert df.first()["Key"] == "1"
    assert tables.read_table(spark, str(tmp_path / "d.txt")).first()["Abstract Note"] == ""


def test_quoted_line_breaks_and_rows(spark, tmp_path):
    path = tmp_path / "terms.csv"
    path.write_text('block;kind;term\nA;pos;"two\nlines"\nA;pos;"say ""hi"""\nB;;x\n')
    rows = sorted(tables.read_terms(spark, str(path)).collect(), key=lambda r: r["source_row"])
    assert [(r["source_row"], r["term"]) for r in rows] == [(0, "two\nlines"), (1, 'say "hi"'), (2, "x")]
    assert rows[2]["kind"] == ""


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1252", "latin-1"])
def test_encodings(spark, tmp_path, encoding):
    path = tmp_path / "in.csv"
    word = "élan \x81" if encoding == "latin-1" else "élan vital"
    path.write_bytes(f"key;title;abstract\n1;{word};naïve\n".encode(encoding))
    df = tables.read_table(spark, str(path))
    assert df.columns[0] == "key"
    assert (df.first()["title"], df.first()["abstract"]) == (word, "naïve")


def test_errors(spark, tmp_path):
    one = tmp_path / "one.csv"
    one.write_text("only\n1\n")
    with pytest.raises(ValueError, match="separator"):
        tables.read_table(spark, str(one))
    assert tables.read_results(spark, str(one)).columns == ["only"]
    with pytest.raises(ValueError, match="Unsupported"):
        tables.read_table(spark, str(tmp_path / "x.docx"))
    with pytest.raises(Exception):
        tables.read_table(spark, str(tmp_path / "absent.csv"))


def test_header_only(spark, tmp_path):
    path = tmp_path / "empty.csv"
    path.write_text("key;title;abstract\n")
    assert tables.read_table(spark, str(path)).isEmpty()


def test_find_input(spark, tmp_path):
    assert tables.find_input(spark, str(tmp_path / "absent")) is None
    assert tables.find_input(spark, str(tmp_path)) is None
    for name in ("b.csv", "a.csv"):
        (tmp_path / name).write_text("x\n")
    assert tables.find_input(spark, str(tmp_path)).endswith("/a.csv")
    (tmp_path / "my_corpus.csv").write_text("x\n")
    assert tables.find_input(spark, str(tmp_path)).endswith("my_corpus.csv")


def test_columns():
    columns = ["Record ID", "Título", "Resumen", "Palavras-chave"]
    assert tables.resolve_fields(columns, {"manual_tags": "manual_tags"}) == {
        "id": "Record ID", "title": "Título", "abstract": "Resumen", "manual_tags": "Palavras-chave",
    }
    assert tables.resolve_fields(["KEY", "x"])["id"] == "KEY"
    assert tables.resolve_fields(["x"]) == {"id": None, "title": None, "abstract": None, "manual_tags": None}
    assert tables.find_column(["Manual-Tags"], "manual_tags") == "Manual-Tags"


def test_profile(spark):
    df = spark.createDataFrame([("1", "t", ""), ("2", " ", "")], "Key string, Title string, x string")
    rows = {r["field"]: r for r in tables.input_profile(df).collect()}
    assert (rows["title"]["n_rows"], rows["title"]["n_blank"], rows["abstract"]["missing"]) == (2, 1, True)


def test_row_key_is_stable(spark, sf_dir):
    first, second = (tables.with_row_key(spark, f"{sf_dir}/documents.parquet").select("doc_id", "row_key") for _ in "ab")
    assert first.exceptAll(second).isEmpty() and first.select("row_key").distinct().count() == first.count()


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([("1", 1.5, None, 'a;"b"')], "ID string, s double, n double, t string")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "out"), {})
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == '\ufeffID;s;n;t\n1;1,50;;"a;""b"""\n'


def test_results_round_trip(spark, tmp_path, sf_dir):
    e = X.engine(spark)
    results = e.run(X.articles(spark, sf_dir))
    paths = sinks.write_results(results, str(tmp_path / "run"), {"output": {"csv": True}})
    stored = tables.read_results(spark, paths["csv"])
    assert stored.count() == 200
    back = spark.read.parquet(paths["parquet"])
    assert back.filter("Final_Decision = 'APPROVED_FINAL'").count() == 13
    assert A.run_diff(back.select("ID", "Final_Decision"), results.select("ID", "Final_Decision")).isEmpty()


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    e = X.engine(spark)
    docs = X.articles(spark, sf_dir)
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = write_stream(triage_stream(e, source), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("run_timestamp")
    batch = e.run(docs).drop("run_timestamp")
    assert got.count() == 200 and got.select(batch.columns).exceptAll(batch).isEmpty()


def test_term_files_of_a_folder_are_numbered_in_order(spark, tmp_path):
    head = "block;kind;term;level\n"
    (tmp_path / "b.csv").write_text(head + "A;pos;y0;1\nA;pos;y1;1\n")
    (tmp_path / "a.csv").write_text(head + "".join(f"A;pos;x{i};1\n" for i in range(3000)))
    rows = {r["term"]: r["source_row"] for r in tables.read_terms(spark, str(tmp_path)).collect()}
    assert rows == {f"x{i}": i for i in range(3000)} | {"y0": 3000, "y1": 3001}
    plain = spark.createDataFrame([("A", "pos", f"t{i}") for i in range(50)], "block string, kind string, term string")
    plain.repartition(4).write.parquet(str(tmp_path / "p.parquet"))
    numbered = tables.read_terms(spark, str(tmp_path / "p.parquet")).collect()
    assert sorted(r["source_row"] for r in numbered) == list(range(50))


def test_csv_begins_with_the_configured_mark(spark, tmp_path):
    df = spark.createDataFrame([("1", "é")], "ID string, t string").coalesce(1)
    for encoding, mark in (("utf-8-sig", b"\xef\xbb\xbf"), ("utf-8", b"")):
        sinks.write_csv(df, str(tmp_path / encoding), {"encoding": encoding})
        written = next((tmp_path / encoding).glob("part-*")).read_bytes()
        assert written == mark + "ID;t\n1;é\n".encode()
        assert tables.read_results(spark, str(tmp_path / encoding)).columns == ["ID", "t"]


def places(df):
    return tables.numbered(df, df, tables.PLACES[0], "number").collect()


def test_malformed_records_have_a_place(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,title,abstract\n1,a,b\n2,c\n3,d,e,f\n4,"g\nh",i\n')
    rows = places(tables.read_table(spark, str(tmp_path / "x.csv"), places=True))
    assert [(r.id, r.title, r.number, r.input_error is None) for r in sorted(rows, key=lambda r: r.number)] == [
        ("1", "a", 0, True), ("2", "c", 1, True), ("3", "d", 2, False), ("4", "g\nh", 3, True),
    ]
    (tmp_path / "x.json").write_text('{"id": 1, "title": "a"}\n{bad\n{"id": 2, "title": "b"}\n')
    rows = places(tables.read_table(spark, str(tmp_path / "x.json"), places=True))
    assert sorted((r.number, r.title, r.input_error is None) for r in rows if r.title) == [(0, "a", True), (2, "b", True)]
    assert [r.number for r in rows if r.input_error] == [1]


def test_numbers_of_some_rows_over_many_splits(spark, tmp_path):
    for name in ("b", "a"):
        lines = "".join(f"{name}{i},t{i},x\n" for i in range(4000))
        (tmp_path / f"{name}.csv").write_text("id,title,abstract\n" + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8000)
    try:
        df = tables.read_table(spark, str(tmp_path), places=True, multi_line=False)
        some = tables.numbered(df.filter("id IN ('a7', 'a3999', 'b0', 'b3000')"), df, tables.PLACES[0], "n")
        assert sorted((r.id, r.n) for r in some.collect()) == [("a3999", 3999), ("a7", 7), ("b0", 4000), ("b3000", 7000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_good_rows_are_decided_without_a_join(spark, tmp_path):
    (tmp_path / "x.csv").write_text("key,title,abstract\n1,oil,b\n2,c,d,e\n")
    table = tables.read_table(spark, str(tmp_path / "x.csv"), places=True)
    engine = X.engine(spark, X.TERMS)
    good, _ = split_errors(tables.as_articles(table, None, *tables.PLACES), tables.PLACES[1], tables.PLACES[0])
    plan = engine.run(good)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_blanks_around_cells_stay(spark, tmp_path):
    df = spark.createDataFrame([("1", "  a b "), ("2", "")], "ID string, t string")
    sinks.write_csv(df, str(tmp_path / "x"))
    assert sorted((r.ID, r.t) for r in tables.read_results(spark, str(tmp_path / "x")).collect()) == [("1", "  a b "), ("2", "")]


def test_encodings_of_a_folder(spark, tmp_path):
    (tmp_path / "a b.csv").write_bytes("id,title,abstract\n1,café,x\n".encode())
    (tmp_path / "c.csv").write_bytes("id,title,abstract,more\n2,ação,y,z\n".encode("cp1252"))
    (tmp_path / "d.csv").write_bytes("id,title,abstract\n3,élan \x81,\n".encode("latin-1"))
    assert sorted(tables.file_encodings(spark, str(tmp_path)).values()) == ["ISO-8859-1", "UTF-8", "windows-1252"]
    df = tables.read_table(spark, str(tmp_path))
    assert {(r.id, r.title, r.abstract, r.more) for r in df.collect()} == {
        ("1", "café", "x", ""), ("2", "ação", "y", "z"), ("3", "élan \x81", "", ""),
    }
    rows = places(tables.read_table(spark, str(tmp_path), places=True))
    assert sorted((r.number, r.id) for r in rows) == [(0, "1"), (1, "2"), (2, "3")]


def test_given_encoding_is_taken(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("id,title,abstract\n1,ação,x\n".encode("cp1252"))
    assert tables.read_table(spark, str(tmp_path / "x.csv")).first()["title"] == "ação"
    assert tables.read_table(spark, str(tmp_path / "x.csv"), encoding="utf-8").first()["title"] != "ação"
    split = tables.read_table(spark, str(tmp_path / "x.csv"), encoding="cp1252", multi_line=False)
    assert split.first()["title"] == "ação"


def test_sample_is_exact_and_sorts_nothing(spark, sf_dir, monkeypatch):
    docs = X.articles(spark, sf_dir)
    plan = results.sample_articles(docs, 50)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan
    assert results.sample_articles(docs, 100, partitions=5).rdd.getNumPartitions() == 5
    by_hash = docs.orderBy(F.xxhash64(F.lit(42), *docs.columns)).collect()
    for near in (100_000, 1):
        monkeypatch.setattr(results, "NEAR_LIMIT", near)
        for n in (1, 7, 50, len(by_hash), len(by_hash) + 1):
            drawn = results.sample_articles(docs, n).collect()
            assert sorted(r.id for r in drawn) == sorted(r.id for r in by_hash[:n])


def test_sample_of_a_table_of_copies(spark):
    columns = "id string, title string, abstract string, manual_tags string"
    docs = spark.createDataFrame([("1", "a", "b", "")] * 700 + [(str(i), "c", "", "") for i in range(300)], columns)
    for n in (1, 300, 650, 1000):
        assert results.sample_articles(docs, n).count() == n
    assert results.sample_articles(docs.limit(0), 3).count() == 0


def test_decided_partitions(spark, sf_dir):
    from winnow.operators.results import decided_as

    df = spark.createDataFrame([("1", "A")], "ID string, Final_Decision string")
    assert decided_as(df, "B").isEmpty() and decided_as(df.drop("Final_Decision"), "B").count() == 1
