"""From raw documents to packed training sequences: five stages, each on what the one before kept.

Every stage is called with a table of documents and returns one; between stages the rows are
written as Parquet and read again, so a stage starts from files, not from the plan of all others.
All stages but the last return documents with the columns they came with.

A stage's scratch tables are needed until its result is written. The next stage, which starts from
that result, removes them first, unless the documents it is given still read them.

Nulls, empty and very long texts, repeated rows, ties, empty tables and extra columns, whatever
their names, are handled as the operators' modules say: a document without words is no one's near
copy, stays if it is the one of its group, and is packed as its end token alone.

| stage | operator | what goes |
|---|---|---|
| quality | winnow.llm.kneser_ney | documents with a perplexity beyond their language's threshold |
| exact | winnow.llm.exact | all but the largest doc_id of equal texts |
| near | winnow.llm.near | all but the smallest doc_id of near-duplicates |
| decontaminate | winnow.llm.decontaminate | documents of which benchmark items cover a twentieth or more |
| pack | winnow.llm.packing | nothing: pieces with their place in sequences of 4,096 tokens |
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from winnow.llm import decontaminate, exact, kneser_ney, near, packing  # noqa: E402
from winnow.llm.common import noting, remove, settle  # noqa: E402

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch folders by application and stage.
_made: dict[tuple[str, str], list[str]] = {}


def _stage(work: Stage) -> Stage:
    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        read = docs.inputFiles()
        for _, before in STAGES[: [f for _, f in STAGES].index(run)]:
            left = _made.pop((app, before.__name__), [])
            needed = [x for x in left if any(x in file for file in read)]
            remove(spark, [x for x in left if x not in needed])
            _made[app, before.__name__] = needed
        with noting() as made:
            result = work(spark, docs, sf_dir)
        _made.setdefault((app, work.__name__), []).extend(made)
        return result

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kneser_ney.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.unique(docs)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.distinct_texts(docs)


@_stage
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, ids=False)


STAGES = [
    ("quality", quality),
    ("exact", exact_copies),
    ("near", near_copies),
    ("decontaminate", benchmark_passages),
    ("pack", pack),
]

#: Perplexity, near-duplicates and tokens are beyond SQL; tests/llm/test_pipeline.py checks the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for _, stage in STAGES[:-1]:
        with noting() as stored:
            docs = settle(stage(spark, docs, sf_dir))
        remove(spark, before)
        before = stored
    return STAGES[-1][1](spark, docs, sf_dir)
