"""Result tables: wide rows, pages, details, samples, and rows that failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.once import built_once
from winnow.functions.text import named
from winnow.operators.highlight import pack_exclusions, pack_hits
from winnow.params import T0, VERSION, Params

# Generated result columns.
HIGHLIGHTED = ("Title_Highlighted", "Abstract_Highlighted", "Tags_Highlighted")
BLOCK_PREFIXES = ("RawScore_", "FinalScore_", "BestLevel_", "Status_", "Highlights_", "AntiHighlights_", "Flags_")
DECISION_COLUMNS = ("Final_Decision", "Decision_Reason", "triage_version", "run_timestamp")
T0_COLUMNS = ("Status_T0", "Reason_T0", "Scope_T0", "AntiHighlights_T0", "Flags_T0")
DETAIL_FIRST = (
    "ID", "key", "Key", "Final_Decision", "Decision_Reason", "Title_Highlighted", "Abstract_Highlighted",
)
NO_ID = "NO_ID"


def check_id_output(id_output: str, blocks: tuple[str, ...]) -> None:
    taken = {*HIGHLIGHTED, *DECISION_COLUMNS, *T0_COLUMNS}
    taken |= {p + b for p in BLOCK_PREFIXES for b in blocks}
    if id_output in taken:
        raise ValueError(f"id_output={id_output!r} is the name of a generated result column")


def wide(
    decided: DataFrame,
    blocks: tuple[str, ...],
    has_t0: bool,
    id_output: str = "ID",
    timestamp: bool = True,
) -> DataFrame:
    """One row per article with seven columns per block, in the published column order."""
    check_id_output(id_output, blocks)
    marked = [c for c in HIGHLIGHTED if c in decided.columns]
    columns = [F.coalesce(F.col("id").cast("string"), F.lit(NO_ID)).alias(id_output), *marked]
    columns += _wide_columns(blocks)
    columns += ["Final_Decision", "Decision_Reason", F.lit(VERSION).alias("triage_version")]
    if timestamp:
        columns.append(
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("run_timestamp")
        )
    if has_t0:
        columns += _t0_columns()
    return decided.select(*columns)


@built_once
def _wide_columns(blocks: tuple[str, ...]) -> list[Column]:
    columns = []
    for i, b in enumerate(blocks):
        e = F.get("evals", F.lit(i))
        columns += [
            F.bround(e["raw_score"], 2).alias(f"RawScore_{b}"),
            F.bround(e["final_score"], 2).alias(f"FinalScore_{b}"),
            e["best_level"].alias(f"BestLevel_{b}"),
            e["status"].alias(f"Status_{b}"),
            pack_hits(e["pos"]).alias(f"Highlights_{b}"),
            pack_exclusions(e["anti"]).alias(f"AntiHighlights_{b}"),
            pack_exclusions(e["flag"]).alias(f"Flags_{b}"),
        ]
    return columns


@built_once
def _t0_columns() -> list[Column]:
    t0 = F.col("t0")
    return [
        t0["status"].alias("Status_T0"),
        t0["reason"].alias("Reason_T0"),
        t0["scope"].alias("Scope_T0"),
        pack_exclusions(t0["anti"]).alias("AntiHighlights_T0"),
        pack_exclusions(t0["flag"]).alias("Flags_T0"),
    ]


def block_rows(decided: DataFrame, *keep: str, t0: bool = False) -> DataFrame:
    """One row per article and block."""
    fields = (
        "block", "block_ord", "status", "reason", "raw_score", "final_score", "best_level", "uplift",
        "section_scores",
    )
    rows = decided.select(*keep, F.inline("evals")).select(*keep, *fields)
    if not t0:
        return rows
    pre = decided.select(
        *keep,
        F.lit(T0).alias("block"),
        F.lit(-1).alias("block_ord"),
        F.col("t0.status").alias("status"),
        F.col("t0.reason").alias("reason"),
    )
    return rows.unionByName(pre, allowMissingColumns=True)


#: The driver sorts no more than this many hashes of the articles around the limit of a sample.
NEAR_LIMIT = 100_000


def _nth_hash(hashes: DataFrame, n: int) -> tuple[int, int] | None:
    """The n-th smallest value of a column `hash` (64 bits) and how many are smaller; None if
    there are fewer values. Counts per range of values narrow it down, 16 bits at a time."""
    below, low, high = 0, -(1 << 63), (1 << 63) - 1
    while True:
        rows = hashes.filter(F.col("hash").between(low, high))
        shift = max((high - low).bit_length() - 16, 0)
        ranges = rows.groupBy(F.shiftright("hash", shift).alias("range")).count().orderBy("range").collect()
        here = None
        for r in ranges:  # 65,537 at most
            if below + r["count"] >= n:
                here = r
                break
            below += r["count"]
        if here is None:
            return None
        low, high = max(low, here["range"] << shift), min(high, (here["range"] + 1 << shift) - 1)
        if low == high:
            return low, below
        if here["count"] <= NEAR_LIMIT:
            near = hashes.filter(F.col("hash").between(low, high)).collect()
            values = sorted(r["hash"] for r in near)
            value = values[n - below - 1]
            return value, below + values.index(value)


def sample_articles(articles: DataFrame, n: int, seed: int = 42, partitions: int = 0) -> DataFrame:
    """Exactly `n` articles, the same ones for the same seed; all of them if there are fewer.

    These are the articles with the smallest hashes. The hash covers the whole row: articles
    with the same id are ranked on their own. The n-th smallest hash is found first, by counts;
    then every task keeps its articles below it, however many these are. Of equal articles at
    the limit, any as many as are missing do. The sample is spread over `partitions` (as many
    as there are cores, if 0) for what comes after.
    """
    if n < 1:
        raise ValueError("The sample size must be at least 1")
    value = F.xxhash64(F.lit(seed), *(named(c) for c in articles.columns))
    limit = _nth_hash(articles.select(value.alias("hash")), n)
    if limit is None:
        drawn = articles
    else:
        drawn = articles.filter(value < limit[0]).union(articles.filter(value == limit[0]).limit(n - limit[1]))
    return drawn.repartition(partitions or articles.sparkSession.sparkContext.defaultParallelism)


def decided_as(results: DataFrame, decision: str | None) -> DataFrame:
    """Results with one final decision, or all of them."""
    if decision is None or "Final_Decision" not in results.columns:
        return results
    return results.filter(F.col("Final_Decision") == decision)


def overview_columns(columns: list[str]) -> list[str]:
    shown = [
        c for c in columns if c in ("ID", "key", "Key") or c.startswith(("Final_", "Status_", "FinalScore_"))
    ]
    return shown or columns[:6]


def page(
    results: DataFrame,
    order_by: Column,
    after: object = None,
    decision: str | None = None,
    size: int = 50,
) -> DataFrame:
    """The first `size` rows of the overview whose order key lies behind `after`.

    `after` is the last key of the page before (None for the first page), so any page costs
    the same. Rows with equal keys may be parted by a page's end: order by a key that is
    unique, such as a struct of several columns.
    """
    rows = decided_as(results, decision)
    if after is not None:
        rows = rows.filter(order_by > (after if isinstance(after, Column) else F.lit(after)))
    return rows.select(*map(named, overview_columns(results.columns))).orderBy(order_by).limit(size)


def detail(
    results: DataFrame, id_column: str, article_id: str, columns: int = 20, length: int = 500
) -> DataFrame:
    """An article's most telling columns as (position, name, value).

    At most `columns` of them, and values of more than `length` characters are cut.
    """
    names = [c for c in DETAIL_FIRST if c in results.columns]
    names += [c for c in results.columns if c.startswith(("Status_", "FinalScore_")) and c not in names]

    def shown(name: str) -> Column:
        text = F.coalesce(named(name).cast("string"), F.lit(""))
        cut = F.concat(F.left(text, F.lit(length - 3)), F.lit("..."))
        return F.when(F.length(text) > length, cut).otherwise(text)

    items = [
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), shown(n).alias("value"))
        for i, n in enumerate(names[:columns])
    ]
    return results.filter(named(id_column) == article_id).select(F.inline(F.array(*items)))


# -- rows that could not be processed -----------------------------------------------------


def split_errors(rows: DataFrame, error: str = "error", *only_failed: str) -> tuple[DataFrame, DataFrame]:
    """Rows to process and rows whose `error` column names a problem (a malformed record).

    Columns `only_failed` stay with the failed rows alone.
    """
    good = rows.filter(F.col(error).isNull()).drop(error, *only_failed)
    return good, rows.filter(F.col(error).isNotNull())


def error_results(
    failed: DataFrame,
    position: str,
    params: Params,
    id_output: str = "ID",
    error: str = "error",
    timestamp: bool = True,
) -> DataFrame:
    """Result rows for failed input: flagged for a person to look at, or the run fails.

    `position` is the row's place in the input, counted from 1.
    """
    reason = F.concat(F.lit("Processing error: "), F.col(error))
    if params.error_policy == "fail":
        reason = F.raise_error(reason).cast("string")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("run_timestamp")
    return failed.select(
        F.concat(F.lit("ERR_"), F.col(position).cast("string")).alias(id_output),
        F.lit("FLAGGED_FINAL").alias("Final_Decision"),
        reason.alias("Decision_Reason"),
        F.lit(VERSION).alias("triage_version"),
        *([now] if timestamp else []),
    )


def with_errors(results: DataFrame, errors: DataFrame) -> DataFrame:
    return results.unionByName(errors, allowMissingColumns=True)


def check_error_rate(n_total: int, n_error: int, params: Params) -> None:
    """Stop when too many rows failed."""
    rate = n_error / n_total if n_total else 0.0
    if params.error_policy == "flag" and params.max_error_rate >= 0 and rate > params.max_error_rate:
        raise RuntimeError(
            f"Error rate {rate:.1%} exceeds the limit of {params.max_error_rate:.1%} "
            f"({n_error} of {n_total} articles)"
        )
