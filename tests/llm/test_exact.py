"""Groups of equal texts against a plain evaluation, with weak digests and in several arrivals."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from winnow.llm import exact as X
from winnow.llm.common import scratch

SCHEMA = "doc_id long, text string"


def plain(docs):
    sizes, best = defaultdict(int), {}
    for doc_id, text in docs:
        sizes[text or ""] += 1
        known = best.get(text or "")
        best[text or ""] = doc_id if known is None else max(known, doc_id if doc_id is not None else known)
    return sorted(
        ((i, best[t or ""], sizes[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs),
        key=repr,
    )


def stored(spark, docs, parts=3):
    path = scratch(spark)
    spark.createDataFrame(docs, SCHEMA).repartition(parts).write.parquet(path)
    return path


def sample(seed, n=120):
    rng = random.Random(seed)
    texts = ["", "a", "A", "a ", "é", "é", "long " * 9000, None, *(f"t{i}" for i in range(30))]
    docs = [(i, rng.choice(texts)) for i in range(n)] + [(1000 + i, "hot") for i in range(60)]
    return docs + [(3, docs[3][1]), (3, docs[3][1]), (None, "hot"), (None, "only null"), (None, "only null")]


def test_groups(spark):
    docs = sample(1)
    rows = X.report(spark, stored(spark, docs)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=repr) == plain(docs)
    texts = {hashlib.sha256((t or "").encode()).hexdigest() for _, t in docs}
    kept = [r for r in rows if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted(texts)
    assert all(r.doc_id == r.keep_id for r in kept)


def test_clashing_digests(spark):
    docs = sample(2)
    weak = lambda body: F.substring(F.sha2(body.cast("binary"), 256), 1, 1)
    rows = X.groups(spark, stored(spark, docs), digest=weak).collect()
    found = sorted(((r.doc_id, r.keep.doc_id, r.n) for r in rows), key=repr)
    assert found == sorted(((i, k, n) for i, k, n, _ in plain(docs)), key=repr)


def test_state_goes_on_with_new_files(spark):
    docs, more = sample(3), [(5000, "hot"), (5001, "new")]
    path, state = stored(spark, docs), scratch(spark)
    schema = spark.read.parquet(path).schema
    X.absorb(spark, path, schema, state)
    spark.createDataFrame(more, SCHEMA).write.mode("append").parquet(path)
    found = {r.digest: (r.keep.doc_id, r.n) for r in X.absorb(spark, path, schema, state).collect()}
    assert found == {d: (k, n) for _, k, n, d in plain(docs + more)}


def test_unique_keeps_all_columns(spark):
    rows = [(1, "x", "f1", None), (2, "x", "f2", 1), (3, None, "f3", 2), (4, "", "f4", None), (2, "x", "f2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string, _metadata int")
    kept = X.unique(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [(2, "x", "f2", 1), (4, "", "f4", None)]


@pytest.mark.parametrize("operation", ["report", "unique"])
def test_empty(spark, operation):
    docs = spark.createDataFrame([], SCHEMA)
    if operation == "unique":
        assert X.unique(docs).collect() == []
    else:
        path = scratch(spark)
        docs.write.parquet(path)
        assert X.report(spark, path).collect() == []
