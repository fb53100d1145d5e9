"""Tables that a plan leaves in the folder which driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir; in local mode, where it may be unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/winnow-{uuid.uuid4().hex}"


#: Shuffle files go when the command that made them ends, not when the driver happens to collect its garbage.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, shuffles_go: bool = False) -> DataFrame:
    """The same rows from a written table: computed once, with no lineage to recompute.

    With `shuffles_go`, what was shuffled for them is removed as soon as they are written.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(_SHUFFLES_GO, None)
    try:
        if shuffles_go:
            spark.conf.set(_SHUFFLES_GO, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_SHUFFLES_GO, before)
        elif shuffles_go:
            spark.conf.unset(_SHUFFLES_GO)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """As `stored`, from a table in `buckets` buckets of a key: joins on the key move the other
    side only. The files stay under `path`; no table name is left behind."""
    spark = df.sparkSession
    name = f"winnow_{uuid.uuid4().hex}"
    spread = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    spread.option("path", path or scratch(spark)).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    _ = table.schema  # resolved while the name is there
    spark.sql(f"DROP TABLE {name}")
    return table
