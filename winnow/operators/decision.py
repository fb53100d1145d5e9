"""Final decision from block evaluations and the pre-screen, by policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.once import built_once, with_once
from winnow.params import Params

APPROVED, FLAGGED, REJECTED = "APPROVED_FINAL", "FLAGGED_FINAL", "REJECTED_FINAL"


def _named(evals: Column, condition) -> Column:
    return F.transform(F.filter(evals, condition), lambda e: e["block"])


def _outcome(decision: str, *reason: Column | str) -> Column:
    text = F.concat(*(F.lit(r) if isinstance(r, str) else r for r in reason))
    return F.struct(F.lit(decision).alias("decision"), text.alias("reason"))


def _count(names: Column) -> Column:
    return F.size(names).cast("string")


def _names(names: Column) -> Column:
    return F.array_join(names, ", ")


def _strict(s: Column, n: int, params: Params) -> list[tuple[Column, Column]]:
    return [
        (F.size(s["approved"]) == n, _outcome(APPROVED, "All blocks approved (strict policy)")),
        (F.size(s["flagged"]) > 0, _outcome(FLAGGED, "Flagged blocks: ", _names(s["flagged"]))),
        (F.lit(True), _outcome(REJECTED, "Rejected blocks: ", _names(s["rejected"]))),
    ]


def _k_of_n(s: Column, n: int, params: Params) -> list[tuple[Column, Column]]:
    n_ok, n_flag = F.size(s["approved"]), F.size(s["flagged"])
    enough = (n_ok >= (params.min_approved_blocks or 1)) & (n_flag <= params.max_flagged_blocks)
    return [
        (F.size(s["rejected"]) > 0, _outcome(REJECTED, "Rejected blocks: ", _names(s["rejected"]))),
        (enough, _outcome(APPROVED, _count(s["approved"]), f"/{n} approved (k_of_n)")),
        (
            (n_ok + n_flag) > 0,
            _outcome(FLAGGED, _count(s["approved"]), " approved, ", _count(s["flagged"]), " flagged"),
        ),
        (F.lit(True), _outcome(REJECTED, "No blocks approved or flagged")),
    ]


def _special(
    s: Column, n: int, params: Params, t0: Column | None
) -> list[tuple[Column, Column]]:
    n_ok = F.size(s["approved"])
    rules = [
        (F.size(s["rejected"]) > 0, _outcome(REJECTED, "Rejected blocks: ", _names(s["rejected"])))
    ]
    if t0 is not None:
        rules.append((t0["status"] == "FLAGGED", _outcome(FLAGGED, "T0: ", t0["reason"])))
    rules.append(
        (
            F.size(s["anti_flagged"]) > 0,
            _outcome(FLAGGED, "Anti-flag in blocks: ", _names(s["anti_flagged"])),
        )
    )
    if params.special_rule:
        rules.append(
            (
                (F.size(s["score_flagged"]) == 1)
                & (n_ok >= 1)
                & (n_ok == n - 1)
                & F.forall(s["approved_scores"], lambda x: x >= params.special_threshold),
                _outcome(
                    APPROVED, "Special rule: ", _count(s["approved"]),
                    f" approved (scores >= {params.special_threshold})",
                ),
            )
        )
    return rules + [
        (
            F.size(s["score_flagged"]) > 0,
            _outcome(FLAGGED, "Flagged blocks: ", _names(s["score_flagged"])),
        ),
        (n_ok == n, _outcome(APPROVED, "All blocks approved")),
        (F.lit(True), _outcome(FLAGGED, "Inconclusive evaluation")),
    ]


@built_once
def final_outcome(blocks: tuple[str, ...], has_t0: bool, params: Params) -> Column:
    """Struct (decision, reason)."""
    evals = F.col("evals")
    t0 = F.col("t0") if has_t0 else None
    n = len(blocks)
    if n == 0:
        result = _outcome(REJECTED, "No domain blocks configured")
    else:
        flagged_by_score = lambda e: (e["status"] == "FLAGGED") & (F.size(e["flag"]) == 0)
        summary = F.array(
            F.struct(
                _named(evals, lambda e: e["status"] == "APPROVED").alias("approved"),
                _named(evals, lambda e: e["status"] == "FLAGGED").alias("flagged"),
                _named(evals, lambda e: e["status"] == "REJECTED").alias("rejected"),
                _named(evals, lambda e: F.size(e["flag"]) > 0).alias("anti_flagged"),
                _named(evals, flagged_by_score).alias("score_flagged"),
                F.transform(
                    F.filter(evals, lambda e: e["status"] == "APPROVED"), lambda e: e["final_score"]
                ).alias("approved_scores"),
            )
        )

        def decide(s: Column) -> Column:
            if params.policy == "strict":
                rules = _strict(s, n, params)
            elif params.policy == "k_of_n":
                rules = _k_of_n(s, n, params)
            else:  # "special", and any name that is not known
                rules = _special(s, n, params, t0)
            outcome = F.when(*rules[0])
            for rule in rules[1:]:
                outcome = outcome.when(*rule)
            return outcome

        result = F.get(F.transform(summary, decide), F.lit(0))
    if t0 is None:
        return result
    return F.when(t0["status"] == "REJECTED", _outcome(REJECTED, "T0: ", t0["reason"])).otherwise(result)


def decide(evaluated: DataFrame, blocks: tuple[str, ...], has_t0: bool, params: Params) -> DataFrame:
    """Adds `Final_Decision` and `Decision_Reason`."""
    df = with_once(evaluated, {"outcome": final_outcome(blocks, has_t0, params)})
    return df.select(
        *evaluated.columns,
        F.col("outcome.decision").alias("Final_Decision"),
        F.col("outcome.reason").alias("Decision_Reason"),
    )
