"""Exact deduplication as a stateful stream; DataFrame operations only.

Documents arrive as files. A streaming aggregate keyed by the digest of the text keeps, for each
digest ever seen, how many rows had it, the largest document id among them and where this row is
(file and row number). The state is in RocksDB on the executors' disks, saved to the checkpoint
folder, and never expires; running again with the same folder takes in new files only.

Equal digests are hits. For hits, whole texts are compared with the text at the kept row's place.
Rows whose text differs are grouped by the text itself, so the result is right for any digest.

Rows with the same text are one group, of whatever size: the stream aggregates before it shuffles,
and the joins on the digest have one row per digest on one side, so a large group can be split.

Defined results: a null text is an empty text; null ids count as smallest, and a group of null
ids only has a null keep_id; of repeated rows with the same id and text one stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm.common import col_name, scratch, settle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bytes of files in one micro-batch.
BATCH_BYTES = 64 << 30


def sha256(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def _as_pattern(path: str) -> str:
    """The path as a pattern that only it matches: streams refuse the plain path of a single file."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def _rows(table: DataFrame, doc_id: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    place = table.metadataColumn("_metadata")
    rows = table.select(
        F.col(col_name(doc_id)).alias("doc_id"),
        place["file_path"].alias("file"),
        place["row_index"].alias("row"),
        F.coalesce(F.col(col_name(text)), F.lit("")).alias("body"),
    )
    return rows.withColumn("digest", digest(F.col("body")))


def absorb(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    state: str,
    doc_id: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """Take the Parquet files under `path` that `state` has not seen; all that the state keeps:
    digest, keep (doc_id, file, row) and n."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    arriving = session.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(_as_pattern(path))
    kept = _rows(arriving, doc_id, text, digest).groupBy("digest").agg(
        F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("n")
    )
    stream = kept.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
    stream.option("checkpointLocation", state).start().awaitTermination()
    stored = spark.read.format("statestore").load(state)
    value = stored.schema["value"].dataType.names
    return stored.select(
        F.col("key.digest").alias("digest"),
        F.col("value")[value[0]].alias("keep"),
        F.col("value")[value[1]].alias("n"),
    )


def _differing(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows that share the digest of the kept row but not its bytes."""
    repeated = state.filter("n > 1").select("digest", "keep")
    is_kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    hits = settle(rows.join(repeated, "digest").withColumn("is_kept", is_kept).drop("keep"))
    kept = hits.filter("is_kept").select("digest", F.col("body").alias("kept_body"))
    return hits.join(kept, "digest").filter("body <> kept_body").drop("is_kept", "kept_body")


def groups(
    spark: SparkSession,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = sha256,
    state: str | None = None,
) -> DataFrame:
    """One row per row of the Parquet files under `path`: doc_id, its place (file, row), digest,
    keep (doc_id and place of the row that stays) and n, the size of its group."""
    schema = spark.read.parquet(path).schema
    found = settle(absorb(spark, path, schema, state or scratch(spark), doc_id, text, digest))
    rows = _rows(spark.read.schema(schema).parquet(path), doc_id, text, digest)
    differing = settle(_differing(rows, found))
    if not differing.isEmpty():
        return _regrouped(rows, found, differing)
    return rows.drop("body").join(found, "digest")


def _regrouped(rows: DataFrame, state: DataFrame, differing: DataFrame) -> DataFrame:
    """The same with groups by text for rows that a clash of digests put together."""
    own = differing.groupBy("digest", "body").agg(
        F.max(F.struct("doc_id", "file", "row")).alias("own_keep"), F.count("*").alias("own_n")
    )
    moved = differing.join(own, ["digest", "body"]).select("file", "row", "own_keep", "own_n")
    fewer = own.groupBy("digest").agg(F.sum("own_n").alias("gone"))
    rest = state.join(fewer, "digest", "left").withColumn("n", F.expr("n - coalesce(gone, 0)")).drop("gone")
    found = rows.drop("body").join(rest, "digest").join(moved, ["file", "row"], "left")
    return found.withColumns(
        {"keep": F.coalesce("own_keep", "keep"), "n": F.coalesce("own_n", "n")}
    ).drop("own_keep", "own_n")


def report(spark: SparkSession, path: str, **options) -> DataFrame:
    """One row per document, those that go included. The group's digest must be SHA-256."""
    is_kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    return groups(spark, path, **options).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        is_kept.alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def unique(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of a table that stay, with all their columns."""
    spark = docs.sparkSession
    path = scratch(spark)
    # Columns under neutral names, so that none hides the files' metadata.
    names = [f"c{i}" for i in range(len(docs.columns))]
    docs.toDF(*names).write.parquet(path)
    lowered = [c.lower() for c in docs.columns]
    at = [names[lowered.index(c.lower())] for c in (doc_id, text)]
    kept = groups(spark, path, *at, **options).select("keep.file", "keep.row").distinct()
    stored = spark.read.parquet(path)
    place = stored.metadataColumn("_metadata")
    rows = stored.withColumns({"file": place["file_path"], "row": place["row_index"]})
    return rows.join(kept, ["file", "row"], "left_semi").select(*names).toDF(*docs.columns)
