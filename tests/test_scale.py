"""Steps that have to keep up with tables of any size."""

import re
import time

import pytest
from pyspark.sql import functions as F

from winnow import queries
from winnow.functions import patterns as P
from winnow.operators import terms as T
from winnow.params import Params
from winnow.sources.staging import stored

JIT_LIMIT = 8_000  # bytes of a method; the JVM interprets longer ones


def generated(df):
    """Bytes of the longest generated method of a plan's final form, and the plan."""
    execution = df._jdf.queryExecution()
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", execution.explainString(mode))
    return max(map(int, sizes)), execution.executedPlan().toString()


@pytest.fixture
def plain_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize(
    "name",
    "duplicates conflicts broad no_positives dedup block_lint lint blocks".split(),
)
def test_term_queries_are_compiled(spark, sf_dir, plain_plans, name):
    size, plan = generated(getattr(queries, f"terms_{name}")(spark, sf_dir))
    assert size < JIT_LIMIT
    # A step that is not generated evaluates its expressions row by row.
    steps = [line.lstrip(" :+-") for line in plan.splitlines()]
    if name == "lint":
        assert not [s for s in steps if s.startswith("Generate")]
    if name in ("duplicates", "dedup"):
        assert all(s.split("[")[1].startswith("rule") for s in steps if "SortAggregate(key" in s)
    assert sum(s.count("regexp_replace(") for s in steps) <= 2 * 8


def test_strip_takes_all_white_space(spark):
    spaces = ["", " ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　"]
    texts = [a + body + b for a in spaces for b in spaces for body in ("", "x", "a b", "a\nb", "é", "~!", "​")]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = {r["t"]: r["s"] for r in df.select("t", T.strip(F.col("t")).alias("s")).collect()}
    assert got.pop(None) == ""
    assert got == {t: t.strip("".join(spaces)) for t in texts}


def test_pairs_of_a_term_with_very_many_parts(spark):
    n = 20_000
    df = spark.createDataFrame([(" or ".join(f"w{i}" for i in range(n)),)], "t string")
    begin = time.monotonic()
    pairs = df.select(F.posexplode(P.compound_pairs(F.col("t"))).alias("i", "p"))
    row = pairs.agg(F.count("*").alias("n"), F.max_by("p", "i").alias("last")).first()
    assert (row["n"], row["last"]) == (n - 1, [f"w{n - 2}", f"w{n - 1}"])
    assert time.monotonic() - begin < 20


@pytest.mark.parametrize(("name", "key"), [("sample_preview", "id"), ("input_fingerprint", "doc_id")])
def test_rows_in_another_order_are_dealt_over_all_tasks(spark, sf_dir, plain_plans, name, key):
    """As many tasks as the session has for a shuffle, by a key that tells rows apart."""
    plan = getattr(queries, name)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    dealt = set(re.findall(r"(?:hashpartitioning|RoundRobinPartitioning)\((.*?)\), REPARTITION", plan))
    n = spark.conf.get("spark.sql.shuffle.partitions")
    assert any(re.fullmatch(rf"{key}#\d+L?, {n}", d) for d in dealt)
    assert not {d for d in dealt if d == "3" or d.startswith("source")}


def test_browse_cleans_the_terms_once(spark, sf_dir):
    """Their blocks and the listing are read from the cleaned table, not from all words again."""
    files = queries.terms_browse(spark, sf_dir).inputFiles()
    assert files and not [f for f in files if "documents" in f]


def test_terms_are_reduced_where_they_are_read(spark, sf_dir, plain_plans):
    """Rows are hashed before anything is moved; an aggregate that sorts them would write them to disk first."""
    plan = queries.terms_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    first = plan[plan.rindex("Exchange hashpartitioning") :]
    assert " HashAggregate(" in first and "SortAggregate(" not in first and " Sort [" not in first


def test_a_stored_table_leaves_no_shuffle_files(spark, sf_dir):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    queries.terms_browse(spark, sf_dir)
    assert spark.conf.get(name) == before
    rows = stored(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), shuffles_go=True)
    assert rows.count() == 7 and spark.conf.get(name) == before


# What a rule is made of, with texts that look like the lengths and marks between its parts.
ODD_RULES = [
    (i, block, kind, term, level, scope, regex)
    for i, (block, kind, term, level, scope, regex) in enumerate(
        (block, kind, term, level, scope, regex)
        for block in ("A", "1", "1 1", "é 2", "A1")
        for kind in ("pos", " ANTI ", "flag", "other")
        for term in ("1", "1 1", "Oil", "OIL", "oil", "İ", "ÉTÉ", "été", "🛢 Oil", "a\x00b", "")
        for level, scope, regex in (("1", "any", "0"), ("1.0", "Title", "yes"), ("1 1", "body", "0"), ("", "abstract", "1"))
    )
]


def test_rules_of_any_text(spark):
    names = ("source_row", "block", "kind", "term", "level", "section_scope", "is_regex")
    raw = spark.createDataFrame(ODD_RULES[::-1], "source_row long, " + ", ".join(f"{n} string" for n in names[1:]))
    first, again = {}, []
    for row, block, kind, term, level, scope, regex in ODD_RULES:
        kind, scope = kind.strip().lower(), scope.lower() if scope.lower() != "body" else "any"
        if kind == "other" or not term:
            continue
        number = {"1": 1, "1.0": 1}.get(level) if kind == "pos" else None
        rule = (block, kind, term.lower(), scope, number if kind == "pos" else level, regex != "0")
        kept = first.setdefault(rule, (row, block, kind, term, number, scope, regex != "0"))
        if kept[0] != row:
            again.append((row, kept[0], block, kind, term))
    columns = ("source_row", "block", "kind", "term", "level", "scope", "is_regex")
    cleaned = T.clean(raw, Params(configured_levels=(1, 2)))
    assert sorted(map(tuple, cleaned.select(*columns).collect()), key=lambda r: r[0]) == sorted(first.values())
    found = T.duplicates(raw, Params(configured_levels=(1, 2))).collect()
    assert sorted((r.source_row, r.first_row, r.block, r.kind, r.term) for r in found) == sorted(again) and again


def test_rows_of_duplicates_are_moved_once(spark, sf_dir, plain_plans):
    """All words are read and moved once, equal rules beside each other; nothing is sorted where they arrive."""
    plan = queries.terms_duplicates(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 1
    arrived, left = plan.split("Exchange hashpartitioning", 1)
    assert "ShuffledHashJoin" in arrived and " Sort [" not in arrived + left.split("ReusedExchange")[-1]
    assert left.count(" Sort [") == 1


def test_duplicates_without_row_numbers(spark):
    rows = [(None, "A", "pos", "oil"), (4, "A", "pos", "OIL"), (2, "A", "pos", "Oil"), (None, "B", "pos", "gas")]
    raw = spark.createDataFrame(rows, "source_row long, block string, kind string, term string")
    assert [tuple(r) for r in T.duplicates(raw).collect()] == [(4, 2, "A", "pos", "OIL")]
