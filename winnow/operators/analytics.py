"""Statistics over results, term coverage, and comparison of two runs.

Everything here is a map-side aggregate over rows that are already complete, so only
group totals are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions.once import built_once
from winnow.functions.text import named
from winnow.operators.terms import TermSet
from winnow.params import SECTIONS, T0

# A term is broad above this share, in corpora of at least this many articles.
BROAD_SHARE = 0.8
BROAD_MIN_ARTICLES = 10
ID_COLUMNS = ("ID", "id", "Key", "key")
MISSING = "MISSING"


# -- statistics of a result table ---------------------------------------------------------


def status_blocks(results: DataFrame) -> list[str]:
    return [c.removeprefix("Status_") for c in results.columns if c.startswith("Status_")]


def _long(results: DataFrame) -> DataFrame:
    """(block, status, score) per article and block; score is null for the pre-screen."""
    none = F.lit(None).cast("double")

    def cell(block: str) -> Column:
        score = f"FinalScore_{block}"
        has_score = block != T0 and score in results.columns
        return F.struct(
            F.lit(block).alias("block"),
            named(f"Status_{block}").alias("status"),
            (named(score).cast("double") if has_score else none).alias("score"),
        )

    return results.select(F.inline(F.array(*map(cell, status_blocks(results)))))


def totals(results: DataFrame) -> DataFrame:
    """n_total, n_valid (some block has a status), n_error, error_rate."""
    blocks = status_blocks(results)
    valid = F.coalesce(*(named(f"Status_{b}") for b in blocks)).isNotNull() if blocks else F.lit(False)
    counted = results.agg(F.count("*").alias("n_total"), F.count_if(valid).alias("n_valid"))
    n_error = F.col("n_total") - F.col("n_valid")
    rate = F.when(F.col("n_total") > 0, n_error / F.col("n_total")).otherwise(F.lit(0.0))
    return counted.select("n_total", "n_valid", n_error.alias("n_error"), rate.alias("error_rate"))


def with_share(counts: DataFrame, *group: str) -> DataFrame:
    """Adds `pct`, the share of the total; `counts` has one row per category."""
    total = F.sum("n").over(Window.partitionBy(*(group or (F.lit(0),))))
    return counts.withColumn("pct", F.col("n") / total * 100)


def decision_distribution(results: DataFrame) -> DataFrame:
    return with_share(results.groupBy("Final_Decision").agg(F.count("*").alias("n")))


def status_distribution(results: DataFrame) -> DataFrame:
    """Articles per block and status, without rows that have no status."""
    rows = _long(results).filter("status is not null")
    return with_share(rows.groupBy("block", "status").agg(F.count("*").alias("n")), "block")


def block_performance(results: DataFrame) -> DataFrame:
    """n_valid, average and highest score per block; no scores for the pre-screen."""
    return (
        _long(results)
        .groupBy("block")
        .agg(
            F.count("status").alias("n_valid"),
            F.avg("score").alias("avg_score"),
            F.max("score").alias("max_score"),
        )
    )


def score_distribution(results: DataFrame) -> DataFrame:
    """Mean, sample deviation, range and count of the final scores per block."""
    return (
        _long(results)
        .filter(F.col("score").isNotNull())
        .groupBy("block")
        .agg(
            F.avg("score").alias("mean"),
            F.stddev_samp("score").alias("std"),
            F.min("score").alias("min"),
            F.max("score").alias("max"),
            F.count("score").alias("n_valid"),
        )
    )


def level_distribution(results: DataFrame) -> DataFrame:
    """Articles per block and best level."""
    blocks = [b for b in status_blocks(results) if f"BestLevel_{b}" in results.columns]
    cells = [
        F.struct(F.lit(b).alias("block"), named(f"BestLevel_{b}").cast("int").alias("best_level"))
        for b in blocks
    ]
    rows = results.select(F.inline(F.array(*cells)))
    return rows.groupBy("block", "best_level").agg(F.count("*").alias("n"))


def report(results: DataFrame) -> DataFrame:
    """Decisions, block statuses and scores as one (part, block, name, value, pct) table.

    All parts come from one aggregate over one pass of the results.
    """
    none = F.lit(None).cast("double")

    def cell(part: str, block: str, name: Column, score: Column) -> Column:
        return F.struct(
            F.lit(part).alias("part"), F.lit(block).alias("block"), name.alias("name"), score.alias("score")
        )

    cells = [cell("decision", "", F.col("Final_Decision"), none)]
    for b in status_blocks(results):
        has_score = b != T0 and f"FinalScore_{b}" in results.columns
        score = named(f"FinalScore_{b}").cast("double") if has_score else none
        cells.append(cell("status", b, named(f"Status_{b}"), score))
    groups = (
        results.select(F.inline(F.array(*cells)))
        .filter("name is not null")
        .groupBy("part", "block", "name")
        .agg(
            F.count("*").alias("n"),
            F.sum("score").alias("total"),
            F.count("score").alias("n_scores"),
            F.max("score").alias("highest"),
        )
    )
    whole = Window.partitionBy("part", "block")
    summed = groups.select(
        "part",
        "block",
        "name",
        F.col("n").cast("double").alias("value"),
        (F.col("n") / F.sum("n").over(whole) * 100).alias("pct"),
        (F.sum("total").over(whole) / F.sum("n_scores").over(whole)).alias("avg_score"),
        F.max("highest").over(whole).alias("max_score"),
        F.row_number().over(whole.orderBy("name")).alias("position"),
    )

    def row(part: Column, name: Column, value: Column, pct: Column) -> Column:
        return F.struct(
            part.alias("part"), name.alias("name"), value.alias("value"), pct.alias("pct")
        )

    def score_row(column: str) -> Column:
        first = (F.col("position") == 1) & F.col(column).isNotNull()
        return F.when(first, row(F.lit("score"), F.lit(column), F.col(column), none))

    own = row(F.col("part"), F.col("name"), F.col("value"), F.col("pct"))
    rows = F.array_compact(F.array(own, score_row("avg_score"), score_row("max_score")))
    return summed.select("block", F.inline(rows)).select("part", "block", "name", "value", "pct")


# -- term coverage ------------------------------------------------------------------------


def term_coverage(decided: DataFrame, ignore_fail_fast: bool = False) -> DataFrame:
    """Hits per positive term: by section, in total, and articles with at least one.

    Blocks that were not evaluated count no hits, unless `ignore_fail_fast`. One hit per
    article and term stands for the article, so articles are counted without a distinct.
    """
    per_article = decided.select(F.inline(_article_terms(ignore_fail_fast)))
    return per_article.groupBy(F.col("name").alias("term")).agg(*_sums())


def _sums() -> list[Column]:
    columns = [f"{s}_hits" for s in SECTIONS] + ["hits", "articles"]
    return [F.sum(c).alias(c) for c in columns]


def _row(
    about: str, name: Column, status: Column, counts: list[Column], articles: int | Column = 1
) -> Column:
    *by_section, total = counts
    return F.struct(
        F.lit(about).alias("about"),
        name.alias("name"),
        status.cast("string").alias("status"),
        *(n.alias(f"{s}_hits") for n, s in zip(by_section, SECTIONS)),
        total.alias("hits"),
        (articles if isinstance(articles, Column) else F.lit(articles)).alias("articles"),
    )


@built_once
def _article_terms(ignore_fail_fast: bool) -> Column:
    """One row per hit of a positive term in the article."""
    if ignore_fail_fast:
        hits = F.filter("hits", lambda h: (h["block_ord"] >= 0) & (h["kind_ord"] == 0))
    else:
        hits = F.flatten(F.transform("evals", lambda e: e["pos"]))
    return _counted_hits(hits)


def _counted_hits(hits: Column) -> Column:
    """A row per hit, from hits with a `term` and a `sec`; the first one of a term counts the article.

    Hits of a term are neighbours once they are sorted, so one look back tells the first.
    """

    def rows(sorted_: Column) -> Column:
        def row(h: Column, i: Column) -> Column:
            by_section = [(h["sec"] == k).cast("int") for k in range(len(SECTIONS))]
            first = ~F.get(sorted_, i - 1)["term"].eqNullSafe(h["term"])
            return _row("term", h["term"], F.lit(None), [*by_section, F.lit(1)], first.cast("int"))

        return F.transform(sorted_, row)

    pairs = F.transform(hits, lambda h: F.struct(h["term"].alias("term"), h["sec"].alias("sec")))
    # Through a one-element array, so that the sorting is written and done once.
    return F.flatten(F.transform(F.array(F.array_sort(pairs)), rows))


def coverage_of_results(results: DataFrame) -> DataFrame:
    """As `term_coverage`, from the packed hits of a result table, stored or fresh."""
    literal = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    item = rf"term=({literal})\s+sec=(\w+)"

    def unpacked(packed: Column) -> Column:
        found = F.regexp_extract_all(F.coalesce(packed, F.lit("")), F.lit(item), F.lit(0))

        def hit(text: Column) -> Column:
            quoted = F.concat(F.lit('{"t":'), F.regexp_extract(text, item, 1), F.lit("}"))
            names = F.array(*map(F.lit, SECTIONS))
            return F.struct(
                F.get_json_object(quoted, "$.t").alias("term"),
                (F.array_position(names, F.regexp_extract(text, item, 2)) - 1).alias("sec"),
            )

        return F.transform(found, hit)

    columns = [named(f"Highlights_{b}") for b in status_blocks(results) if f"Highlights_{b}" in results.columns]
    rows = results.select(F.inline(_counted_hits(F.concat(*map(unpacked, columns)))))
    return rows.groupBy(F.col("name").alias("term")).agg(*_sums())


def coverage_report(
    decided: DataFrame, term_set: TermSet, articles: DataFrame, ignore_fail_fast: bool = False
) -> DataFrame:
    """Configured terms with their hits, and blocks with their statuses, from one pass.

    Columns: about ('term' or 'block'), name, hits by section, hits, articles, n_statuses,
    status, n_articles. Terms without hits come in as rows of zeros, and statuses are
    counted per block, so that a single aggregate over the articles serves everything
    below. The number of articles is read off the input, whose columns are not needed.
    """
    none = [F.lit(0)] * 4
    statuses = F.transform("evals", lambda e: _row("block", e["block"], e["status"], none))
    found = decided.select(F.inline(F.concat(_article_terms(ignore_fail_fast), statuses)))
    configured = term_set.terms.filter((F.col("block") != T0) & (F.col("kind") == "pos")).select(
        F.inline(F.array(_row("term", F.col("term"), F.lit(None), none, 0)))
    )
    counted = found.unionByName(configured).groupBy("about", "name", "status").agg(*_sums())
    return (
        counted.groupBy("about", "name")
        .agg(*_sums(), F.count("*").alias("n_statuses"), F.min("status").alias("status"))
        .withColumn("n_articles", articles.agg(F.count("*")).scalar())
    )


def _is_dead() -> Column:
    return (F.col("about") == "term") & (F.col("articles") == 0)


def _is_broad() -> Column:
    return (
        (F.col("about") == "term")
        & (F.col("n_articles") >= BROAD_MIN_ARTICLES)
        & (F.col("articles") > F.col("n_articles") * BROAD_SHARE)
    )


def _is_uniform() -> Column:
    return (F.col("about") == "block") & (F.col("n_statuses") == 1)


def _pct() -> Column:
    return F.col("articles") / F.col("n_articles") * 100


def dead_terms(report: DataFrame) -> DataFrame:
    """Positive terms without any hit."""
    return report.filter(_is_dead()).select(F.col("name").alias("term"))


def broad_terms(report: DataFrame) -> DataFrame:
    """Terms found in more than 80 % of the articles; none in a very small corpus."""
    return report.filter(_is_broad()).select(
        F.col("name").alias("term"), "articles", "hits", _pct().alias("pct")
    )


def block_discrimination(report: DataFrame) -> DataFrame:
    """Blocks that give every article the same status."""
    return report.filter(_is_uniform()).select(F.col("name").alias("block"), "status")


def section_distribution(coverage: DataFrame) -> DataFrame:
    sums = coverage.agg(
        *(F.coalesce(F.sum(f"{s}_hits"), F.lit(0)).alias(s) for s in SECTIONS)
    )
    return sums.select(
        F.inline(
            F.array(*(F.struct(F.lit(s).alias("section"), F.col(s).alias("hits")) for s in SECTIONS))
        )
    )


def suggestions(report: DataFrame) -> DataFrame:
    """Advice in words."""

    def advice(condition: Column, about: str, text: str, *values: str | Column) -> Column:
        return F.when(
            condition,
            F.struct(F.lit(about).alias("about"), F.format_string(text, *values).alias("suggestion")),
        )

    texts = [
        advice(_is_dead(), "dead", "Term '%s' had 0 matches - check spelling or remove", "name"),
        advice(
            _is_broad(), "broad", "Term '%s' matched %d/%d articles (%.0f%%) - may add noise",
            "name", "articles", "n_articles", F.bround(_pct(), 0),
        ),
        advice(
            _is_uniform(), "block", "Block '%s' has no discrimination - all articles are %s", "name", "status"
        ),
    ]
    return report.select(F.inline(F.array_compact(F.array(*texts))))


def coverage_export(report: DataFrame) -> DataFrame:
    """Dead and broad terms in one table."""
    dead = _is_dead()
    return report.filter(dead | _is_broad()).select(
        F.col("name").alias("term"),
        F.when(dead, "dead").otherwise("broad").alias("status"),
        F.when(dead, F.lit(0).cast("bigint")).alias("hits"),
        F.when(dead, F.lit(0.0)).otherwise(_pct()).alias("pct"),
        F.when(~dead, F.col("articles")).alias("articles"),
        F.when(~dead, F.col("hits")).alias("section_hits"),
    )


# -- comparison of two runs ---------------------------------------------------------------


def shared_id(a: DataFrame, b: DataFrame) -> str:
    for name, df in (("first", a), ("second", b)):
        if "Final_Decision" not in df.columns:
            raise ValueError(f"The {name} table has no 'Final_Decision' column")
    for name in ID_COLUMNS:
        if name in a.columns and name in b.columns:
            return name
    if a.columns[0] in b.columns:
        return a.columns[0]
    raise ValueError(f"No common id column (one of {', '.join(ID_COLUMNS)})")


def run_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Articles whose decision differs, as (article_id, old, new, n)."""
    key = shared_id(a, b)
    sides = [
        df.select(F.lit(side).alias("side"), named(key).cast("string").alias("article_id"), "Final_Decision")
        for side, df in (("a", a), ("b", b))
    ]
    return diff_of_sides(sides[0].unionByName(sides[1]))


def diff_of_sides(rows: DataFrame) -> DataFrame:
    """As `run_diff`, from (side, article_id, Final_Decision) with the sides 'a' and 'b' in one table.

    An id may occur many times on both sides, and every occurrence counts with every
    other. Rows are counted per id and decision before they are shuffled, and an id has
    only a few decisions; `n` is the number of pairs, which are never built.
    """
    counts = rows.groupBy(
        F.coalesce("article_id", F.lit(MISSING)).alias("article_id"),
        F.coalesce("Final_Decision", F.lit(MISSING)).alias("decision"),
    ).agg(F.count_if(F.col("side") == "a").alias("n_old"), F.count_if(F.col("side") == "b").alias("n_new"))
    kept = counts.groupBy("article_id").agg(F.collect_list(F.struct("decision", "n_old", "n_new")).alias("all"))
    none = F.array(F.struct(F.lit(MISSING).alias("decision"), F.lit(1).cast("bigint").alias("n")))

    def side(n: str) -> Column:
        own = F.transform(
            F.filter("all", lambda x: x[n] > 0), lambda x: F.struct(x["decision"].alias("decision"), x[n].alias("n"))
        )
        return F.when(F.size(own) > 0, own).otherwise(none)

    old = kept.select("article_id", side("n_new").alias("new_side"), F.inline(side("n_old")).alias("old", "n_old"))
    pairs = old.select("article_id", "old", "n_old", F.inline("new_side").alias("new", "n_new"))
    return pairs.filter("old <> new").select("article_id", "old", "new", (F.col("n_old") * F.col("n_new")).alias("n"))


def diff_transitions(diff: DataFrame) -> DataFrame:
    return diff.groupBy("old", "new").agg(F.sum("n").alias("n"))


def diff_totals(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both tables."""
    sides = a.select(F.lit("a").alias("side")).unionByName(b.select(F.lit("b").alias("side")))
    return sides.agg(
        F.count_if(F.col("side") == "a").alias("total_a"),
        F.count_if(F.col("side") == "b").alias("total_b"),
    )
