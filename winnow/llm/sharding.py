"""Global shuffle into shards in two passes.

Pass one scatters the rows over buckets by a seeded hash of id, text and place in the table, so
buckets have about `bucket_bytes` of text however often an id or a text comes. Pass two holds one
bucket at a time, brings its rows into a fixed order, applies a seeded Fisher-Yates shuffle and
writes it. The buckets behind one another are a random order of all rows, which is cut into
shards of equal row counts (at most one apart).

The same table, seed and bucket size give the same shards. Defined results: nulls are values like
others (a null text has no bytes); repeated rows are shuffled each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm.common import col_name, fresh, settle

BUCKET_BYTES = 16_000_000
SEED = 7


def fisher_yates(n: int, seed: list[int]) -> list[int]:
    """A random order of 0 .. n - 1."""
    draws = np.random.default_rng(seed).random(n).tolist()
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def _shuffled(bucket: str, by: str, place: str, seed: int, schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        own = rows.column(bucket)[0].as_py()
        order = rows.column(by).to_numpy().argsort(kind="stable")
        order = order[fisher_yates(len(order), [seed, own])]
        rows = rows.drop_columns([by]).take(pa.array(order))
        rows = rows.append_column(place, pa.array(np.arange(len(order), dtype=np.int64)))
        return rows.select(schema.names).cast(schema)

    return run


def _rows_before(counts: DataFrame, bucket: str) -> DataFrame:
    """bucket and the number of rows in the buckets before it, in two levels."""
    thousand = counts.withColumn("high_", F.expr(f"{col_name(bucket)} div 1000"))
    before = lambda w: F.coalesce(F.sum("n_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    low = thousand.withColumn("low_", before(Window.partitionBy("high_").orderBy(bucket)))
    sums = thousand.groupBy("high_").agg(F.sum("n_").alias("n_"))
    sums = sums.select("high_", before(Window.orderBy("high_")).alias("sum_"))
    return low.join(sums, "high_").select(bucket, F.expr("sum_ + low_").alias("before_"))


def shards(
    docs: DataFrame,
    n_shards: int,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
    doc_id: str = "doc_id",
    text: str = "text",
    names: tuple[str, str] = ("shard", "slot"),
) -> DataFrame:
    """All rows in random order, with two columns more: shard and place there."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bucket, by, place = fresh(docs, "bucket_"), fresh(docs, "by_"), fresh(docs, "place_")
    body = F.col(col_name(text))
    size = docs.agg(F.sum(F.coalesce(F.octet_length(body), F.lit(0)) + 1)).first()[0] or 0
    buckets = -(-int(size) // bucket_bytes) or 1
    key = F.xxhash64(F.lit(seed), F.col(col_name(doc_id)), body, F.monotonically_increasing_id())
    scattered = docs.withColumn(by, key).withColumn(bucket, F.pmod(F.col(by), F.lit(buckets)).cast("int"))
    schema = T.StructType(
        [*docs.schema.fields, T.StructField(bucket, T.IntegerType()), T.StructField(place, T.LongType())]
    )
    run = _shuffled(bucket, by, place, seed, to_arrow_schema(schema))
    written = settle(scattered.groupBy(bucket).applyInArrow(run, schema))
    counts = settle(written.groupBy(bucket).agg(F.count("*").alias("n_")))
    total = counts.agg(F.sum("n_")).first()[0] or 0
    before = _rows_before(counts, bucket).toDF(bucket, fresh(written, "before_"))
    position = f"({col_name(before.columns[1])} + {col_name(place)})"
    # Shard s begins at row ceil(s * total / n_shards).
    shard = f"({position} * {n_shards}L div {max(total, 1)}L)"
    slot = f"{position} - ({shard} * {total}L + {n_shards - 1}L) div {n_shards}L"
    return written.join(before, bucket).select(
        *map(col_name, docs.columns), F.expr(shard).cast("int").alias(names[0]), F.expr(slot).alias(names[1])
    )


def write(placed: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder per shard."""
    placed.write.partitionBy(shard).parquet(path)


def report(docs: DataFrame, n_shards: int = 8, **options) -> DataFrame:
    """One row per document: size, checksum, law and place."""
    own = docs.select("doc_id", "text")
    body = F.coalesce(F.col("text"), F.lit(""))
    return shards(own, n_shards, **options).select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
