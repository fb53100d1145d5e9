"""Triage of articles as they arrive.

An article is decided from its own row, so the batch plan runs on a stream unchanged:
no state, no watermark, and any output mode that appends. Counts of decisions are state: one
number per decision, kept as long as the stream's checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from winnow.plans.engine import TriageEngine


def triage_stream(engine: TriageEngine, articles: DataFrame, id_output: str = "ID") -> DataFrame:
    if engine.matching != "row":
        raise ValueError("A stream is matched by row: build the engine with matching='row'")
    return engine.run(articles, id_output)


def write_stream(results: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append to Parquet. `checkpoint` must be a folder that all machines share."""
    return (
        results.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .partitionBy("Final_Decision")
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )


def count_decisions(results: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep `path` (Parquet) at the number of results per final decision so far."""

    def replace(counts: DataFrame, _: int) -> None:
        counts.coalesce(1).write.mode("overwrite").parquet(path)  # a row per decision

    counts = results.groupBy("Final_Decision").count().withColumnRenamed("count", "n")
    return (
        counts.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(replace)
        .start()
    )
