"""Demonstration terms for the test documents, and the documents seen as articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.params import Params
from winnow.plans.engine import TriageEngine

BLOCKS = ("FUNC", "FORM")

# block, kind, term, level, section_scope, is_regex
TERMS = [
    ("FUNC", "pos", "that", "2", "any", "0"),
    ("FUNC", "pos", "with", "3", "any", "0"),
    ("FUNC", "pos", "from", "4", "any", "0"),
    ("FUNC", "pos", "th*", "5", "any", "0"),
    ("FUNC", "pos", "pour", "2", "any", "0"),
    ("FUNC", "pos", "dans", "3", "any", "0"),
    ("FUNC", "pos", "sich", "2", "any", "0"),
    ("FUNC", "pos", "para", "2", "any", "0"),
    ("FUNC", "pos", "ción*", "4", "any", "0"),
    ("FUNC", "flag", "than", "", "any", "0"),
    ("FUNC", "anti", "thth", "", "any", "0"),
    ("FORM", "pos", "this and that", "1", "any", "0"),
    ("FORM", "pos", "this", "3", "any", "0"),
    ("FORM", "pos", "ther", "4", "any", "0"),
    ("FORM", "pos", "tion", "5", "any", "0"),
    ("FORM", "pos", "avec", "3", "any", "0"),
    ("FORM", "pos", "elle", "4", "any", "0"),
    ("FORM", "pos", "eine", "3", "any", "0"),
    ("FORM", "pos", "mente", "4", "any", "0"),
    ("FORM", "pos", "étion", "2", "any", "0"),
    ("FORM", "pos", "en", "5", "any", "0"),
    ("FORM", "flag", "ándo", "", "any", "0"),
    ("FORM", "flag", "heit", "", "any", "0"),
    ("FORM", "anti", "keit", "", "any", "0"),
    ("GLOBAL", "anti", "mit license", "", "any", "0"),
    ("GLOBAL", "flag", "avec", "", "any", "0"),
]

RAW_SCHEMA = (
    "block string, kind string, term string, level string, section_scope string, "
    "is_regex string, normalization_type string, normalization_target string, source_row int"
)


def raw_terms(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Term rows of six columns, or eight with a normalisation rule, as a raw table."""
    full = [(*r, *("" for _ in range(8 - len(r))), i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, RAW_SCHEMA)


def engine(spark: SparkSession, rows: list[tuple] | None = None, **params) -> TriageEngine:
    settings = Params(block_order=BLOCKS).with_(**params)
    return TriageEngine.build(raw_terms(spark, rows or TERMS), settings)


def articles(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Documents as articles: first line is the title, the rest the abstract."""
    return as_articles(spark.read.parquet(f"{sf_dir}/documents.parquet"), *keep)


def as_articles(docs: DataFrame, *keep: str) -> DataFrame:
    text = F.col("text")
    cut = F.instr(text, "\n")
    return docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(cut > 0, F.left(text, cut - 1)).otherwise(text).alias("title"),
        F.when(cut > 0, F.substring(text, cut + 1, F.length(text))).otherwise("").alias("abstract"),
        F.when(F.col("doc_id") % 3 == 0, "")
        .otherwise(F.concat_ws(", ", "lang", "source"))
        .alias("manual_tags"),
        *keep,
    )
