"""Stages of the pipeline against plain evaluations of what each must keep, on its own input."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as C
from tests.llm.test_decontaminate import plain_report
from tests.llm.test_near import plain_classes
from winnow.llm import kneser_ney
from winnow.llm.common import settle


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    docs = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for _, stage in C.STAGES:
        docs.append(settle(stage(spark, docs[-1], sf_dir)))
    return docs


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_rows_stay_as_they_are(tables):
    for df in tables[1:-1]:
        assert df.schema.names == tables[0].columns
        assert df.join(tables[0], tables[0].columns, "left_anti").count() == 0


def test_quality(spark, sf_dir, tables):
    judged = kneser_ney.report(tables[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(tables[1]) == ids(judged.filter("kept"))
    assert 0 < tables[1].count() < tables[0].count()


def test_exact(tables):
    best = tables[1].groupBy(F.coalesce("text", F.lit(""))).agg(F.max("doc_id").alias("doc_id"))
    assert ids(tables[2]) == ids(best)


def test_near(tables):
    docs = [(r.doc_id, r.text) for r in tables[2].collect()]
    assert ids(tables[3]) == sorted(min(docs[i][0] for i in c) for c in plain_classes(docs).values())


def test_decontaminate(spark, sf_dir, tables):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    judged = plain_report([(r.doc_id, r.text) for r in tables[3].collect()], items)
    assert ids(tables[4]) == sorted(r[0] for r in judged if not r[-1])


def test_pack(spark, sf_dir, tables):
    assert sorted(set(ids(tables[5]))) == ids(tables[4])
    ends = tables[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.expr("offset + length")).alias("m"))
    assert ends.filter("n <> m OR n > 4096").count() == 0
    whole = entry.queries()["pipeline"](spark, sf_dir)
    assert whole.groupBy("doc_id", "piece", "length").count().join(tables[5], ["doc_id", "piece", "length"]).count() == tables[5].count()


def test_scratch_goes_when_the_next_stage_begins(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    first = C.exact_copies(spark, docs, sf_dir)
    made = C._made[spark.sparkContext.applicationId, "exact_copies"]
    assert made
    C.near_copies(spark, first, sf_dir).count()  # not stored: what it reads stays
    assert first.count() > 0
    first.write.parquet(f"{tmp_path}/first")
    kept = C.near_copies(spark, spark.read.parquet(f"{tmp_path}/first"), sf_dir)
    assert not any(os.path.exists(x) for x in made) and kept.count() > 0


def test_nulls_empty_tables_and_clashing_columns(spark, sf_dir, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, rid long, band string, file string"
    words = " ".join(f"word{i}" for i in range(300))
    rows = [(1, None, None, None, None, None, None, None), (2, "", "en", "s", 0, 1, "b", "f"), (3, words, "en", "s", 9, 1, "b", "f")]
    rows += [(4, words, "en", None, 9, 2, None, "f"), (None, words + " more", "en", "s", 9, 1, "b", "f")]
    for n, own in (("some", rows), ("none", [])):
        docs = spark.createDataFrame(own, schema)
        for name, stage in C.STAGES:
            docs.write.parquet(f"{tmp_path}/{n}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{n}-{name}")
            names = docs.columns
            docs = stage(spark, docs, sf_dir)
            assert name == "pack" or docs.columns == names
        assert (docs.count() > 0) == bool(own)
