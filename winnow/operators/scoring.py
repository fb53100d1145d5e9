"""Block scores and statuses, the global pre-screen and fail-fast, within each row.

Blocks are an array in block order. Every step below is a `transform` over that array, so
that each intermediate value is computed once and the expression does not grow with the
number of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.once import built_once, with_once
from winnow.operators.matching import HIT
from winnow.params import SECTIONS, Params

POS, ANTI, FLAG = 0, 1, 2
NO_TERMS = "No positive terms found"

EVAL = (
    f"struct<block:string,block_ord:int,pos:array<{HIT}>,anti:array<{HIT}>,flag:array<{HIT}>,"
    "levels:array<int>,section_scores:struct<title:double,abstract:double,manual_tags:double>,"
    "raw_score:double,best_level:int,final_score:double,uplift:boolean,status:string,reason:string>"
)


def _level_map(values: dict, spark_type: str) -> Column:
    """Map literal from levels; a None value means the level has no entry."""
    pairs = [F.lit(x) for k, v in values.items() if v is not None for x in (k, v)]
    return F.create_map(*pairs).cast(f"map<int,{spark_type}>")


def _by_level(values: dict, level: Column, spark_type: str) -> Column:
    return F.try_element_at(_level_map(values, spark_type), level)


def two_decimals(score: Column) -> Column:
    return F.format_string("%.2f", F.bround(score, 2))


def _section_score(pos: Column, sec: int, params: Params) -> Column:
    """Scores of the distinct levels found in a section, capped, times the section weight."""
    levels = F.array_distinct(
        F.transform(
            F.filter(pos, lambda h: (h["sec"] == sec) & h["level"].isNotNull()), lambda h: h["level"]
        )
    )
    total = F.aggregate(
        levels,
        F.lit(0).cast("long"),
        lambda acc, lvl: acc
        + F.coalesce(_by_level(params.level_scores, lvl, "long"), F.lit(0).cast("long")),
    )
    capped = F.least(total.cast("double"), F.lit(params.max_section_score))
    return capped * F.lit(params.section_weights.get(SECTIONS[sec], 1.0))


def _status(e: Column, params: Params) -> Column:
    """Status and reason of one block from its score, levels and exclusion hits."""
    level, final = e["best_level"], e["final_score"]
    # Thresholds print the way they were configured (10 or 10.0).
    texts = lambda values: {k: str(v) for k, v in values.items() if v is not None}
    approval = _by_level(params.approval, level, "double")
    flagging = F.coalesce(_by_level(params.flagging, level, "double"), F.lit(0.0))
    flag_text = F.coalesce(_by_level(texts(params.flagging), level, "string"), F.lit("0"))
    score = two_decimals(final)
    tag = F.concat(F.lit(" (L"), level.cast("string"), F.lit(")"))

    def outcome(status: str, *reason: Column | str) -> Column:
        text = F.concat(*(F.lit(r) if isinstance(r, str) else r for r in reason))
        return F.struct(F.lit(status).alias("status"), text.alias("reason"))

    rules: list[tuple[Column, Column]] = [
        (F.size(e["anti"]) > 0, outcome("REJECTED", "Anti-exclusion: ", F.get(e["anti"], F.lit(0))["term"]))
    ]
    if params.noise_profile != "relaxed":
        found = level.isNotNull()
        n_terms = F.size(F.array_distinct(e["pos"]["term"]))
        n_secs = F.size(F.array_distinct(e["pos"]["sec"]))
        rules += [
            (
                found & (n_terms < params.min_unique_terms),
                outcome("REJECTED", "Noise filter: only ", n_terms.cast("string"), " unique term(s)"),
            ),
            (
                found & (n_secs < params.min_sections_with_hits),
                outcome("REJECTED", "Noise filter: hits in only ", n_secs.cast("string"), " section(s)"),
            ),
        ]
        if params.require_non_weak:
            weak = F.array(*map(F.lit, params.weak_levels)).cast("array<int>")
            rules.append(
                (
                    found & (F.size(F.array_except(e["levels"], weak)) == 0),
                    outcome("REJECTED", "Noise filter: only weak-level terms found"),
                )
            )
    approved = level.isNotNull() & approval.isNotNull() & (final >= approval)
    rules += [
        (level.isNull(), outcome("REJECTED", NO_TERMS)),
        (
            approved & (F.size(e["flag"]) > 0),
            outcome(
                "FLAGGED", "Downgraded to flagged: anti-flag term '",
                F.get(e["flag"], F.lit(0))["term"], "'",
            ),
        ),
        (
            approved,
            outcome(
                "APPROVED", "Score ", score, " >= threshold ",
                _by_level(texts(params.approval), level, "string"), tag,
            ),
        ),
        (
            (final > 0) & (final >= flagging),
            outcome("FLAGGED", "Score ", score, " >= flag threshold ", flag_text, tag),
        ),
    ]
    result = F.when(*rules[0])
    for condition, value in rules[1:]:
        result = result.when(condition, value)
    return result.otherwise(outcome("REJECTED", "Score ", score, " below thresholds", tag))


@built_once
def block_evals(blocks: tuple[str, ...], params: Params) -> Column:
    """Array with the evaluation of every block, each one by itself."""
    if not blocks:
        return F.array().cast(f"array<{EVAL}>")
    hits = F.col("hits")

    def of_kind(mine: Column, kind: int) -> Column:
        return F.filter(mine, lambda h: h["kind_ord"] == kind)

    start = F.array(
        *(F.struct(F.lit(b).alias("block"), F.lit(i).alias("block_ord")) for i, b in enumerate(blocks))
    )
    mine = F.transform(
        start,
        lambda b: F.struct(
            b["block"].alias("block"),
            b["block_ord"].alias("block_ord"),
            F.filter(hits, lambda h: h["block_ord"] == b["block_ord"]).alias("mine"),
        ),
    )
    split = F.transform(
        mine,
        lambda b: F.struct(
            b["block"].alias("block"),
            b["block_ord"].alias("block_ord"),
            of_kind(b["mine"], POS).alias("pos"),
            of_kind(b["mine"], ANTI).alias("anti"),
            of_kind(b["mine"], FLAG).alias("flag"),
        ),
    )

    def scored(b: Column) -> Column:
        return F.struct(
            b["block"].alias("block"),
            b["block_ord"].alias("block_ord"),
            b["pos"].alias("pos"),
            b["anti"].alias("anti"),
            b["flag"].alias("flag"),
            F.array_distinct(F.filter(b["pos"]["level"], lambda x: x.isNotNull())).alias("levels"),
            F.struct(
                *(_section_score(b["pos"], i, params).alias(s) for i, s in enumerate(SECTIONS))
            ).alias("section_scores"),
        )

    def totalled(b: Column) -> Column:
        s = b["section_scores"]
        return F.struct(
            *(b[f].alias(f) for f in ("block", "block_ord", "pos", "anti", "flag", "levels", "section_scores")),
            (s["title"] + s["abstract"] + s["manual_tags"]).alias("raw_score"),
            F.array_min(b["levels"]).alias("best_level"),
        )

    carried = ("block", "block_ord", "pos", "anti", "flag", "levels", "section_scores", "raw_score", "best_level")

    def uplifted(b: Column) -> Column:
        raw = b["raw_score"]
        lift = (
            ~F.col("has_tags") & (raw > 0) if params.no_tags_uplift > 1.0 else F.lit(False)
        )
        return F.struct(
            *(b[f].alias(f) for f in carried),
            F.when(lift, raw * F.lit(params.no_tags_uplift)).otherwise(raw).alias("final_score"),
            lift.alias("uplift"),
        )

    def judged(b: Column) -> Column:
        return F.struct(
            *(b[f].alias(f) for f in (*carried, "final_score", "uplift")),
            _status(b, params).alias("outcome"),
        )

    result = split
    for step in (scored, totalled, uplifted, judged):
        result = F.transform(result, step)
    return F.transform(
        result,
        lambda b: F.struct(
            *(b[f].alias(f) for f in (*carried, "final_score", "uplift")),
            b["outcome"]["status"].alias("status"),
            b["outcome"]["reason"].alias("reason"),
        ),
    )


@built_once
def t0_eval() -> Column:
    """Outcome of the global pre-screen."""
    def hits_of(kind: int) -> Column:
        return F.filter("hits", lambda h: (h["block_ord"] == -1) & (h["kind_ord"] == kind))

    found = F.array(F.struct(hits_of(ANTI).alias("anti"), hits_of(FLAG).alias("flag")))

    def judged(t: Column) -> Column:
        first = lambda f: F.get(t[f], F.lit(0))["term"]
        rejected, flagged = F.size(t["anti"]) > 0, F.size(t["flag"]) > 0
        return F.struct(
            F.when(rejected, "REJECTED").when(flagged, "FLAGGED").otherwise("PASSED").alias("status"),
            F.when(rejected, F.concat(F.lit("Global exclusion: "), first("anti")))
            .when(flagged, F.concat(F.lit("Global flag: "), first("flag")))
            .otherwise("No global anti-terms triggered")
            .alias("reason"),
            F.lit("global").alias("scope"),
            t["anti"].alias("anti"),
            t["flag"].alias("flag"),
        )

    return F.get(F.transform(found, judged), F.lit(0))


def _skipped(e: Column, reason: str) -> Column:
    no_hits = F.filter(e["pos"], lambda h: F.lit(False))
    zero = F.lit(0.0)
    return F.struct(
        e["block"].alias("block"),
        e["block_ord"].alias("block_ord"),
        no_hits.alias("pos"),
        no_hits.alias("anti"),
        no_hits.alias("flag"),
        F.array().cast("array<int>").alias("levels"),
        F.struct(*(zero.alias(s) for s in SECTIONS)).alias("section_scores"),
        zero.alias("raw_score"),
        F.lit(None).cast("int").alias("best_level"),
        zero.alias("final_score"),
        F.lit(False).alias("uplift"),
        F.lit("NOT_EVALUATED").alias("status"),
        F.lit(reason).alias("reason"),
    )


@built_once
def fail_fast(has_t0: bool, params: Params) -> Column:
    """`evals` without blocks that are not reached: after a rejected block, or after T0 rejects."""
    evals = result = F.col("evals")
    if params.fail_fast:
        first = F.array_position(evals["status"], "REJECTED")  # from 1; 0 if there is none
        result = F.transform(
            evals,
            lambda e, i: F.when(
                (first > 0) & (i >= first), _skipped(e, "Previous block rejected")
            ).otherwise(e),
        )
    if not has_t0:
        return result
    return F.when(
        F.col("t0.status") == "REJECTED", F.transform(evals, lambda e: _skipped(e, "Global T0 exclusion"))
    ).otherwise(result)


def evaluate(matched: DataFrame, blocks: tuple[str, ...], has_t0: bool, params: Params) -> DataFrame:
    """Adds `t0` (null without a pre-screen) and `evals`, one struct per block in order."""
    values = {"evals": block_evals(blocks, params)}
    if has_t0:
        values["t0"] = t0_eval()
    df = with_once(matched, values)
    return with_once(df, {"evals": fail_fast(has_t0, params)})
