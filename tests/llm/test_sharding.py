"""Round trips through the shards: all rows once, equal shares, a repeatable random order."""

import zlib
from collections import Counter

import pytest

from winnow.llm import sharding as S
from winnow.llm.common import scratch

SCHEMA = "doc_id long, text string"


def docs_of(spark, n=500):
    rows = [(i, f"text {i} " * (i % 40)) for i in range(n)]
    rows += [(None, None)] * 40 + [(7, "same")] * 60 + [(8, ""), (9, "x" * 200_000)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def check(rows, docs, n_shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs
    )
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(n_shards)]
    assert set(slots) <= set(range(n_shards)) and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize(("n_shards", "bucket_bytes"), [(8, 20_000), (7, 300), (1, 10**9), (1000, 5000)])
def test_shards(spark, n_shards, bucket_bytes):
    docs, df = docs_of(spark)
    check(S.report(df, n_shards, bucket_bytes=bucket_bytes).collect(), docs, n_shards)


def test_order_follows_the_seed(spark):
    _, df = docs_of(spark)
    order = lambda seed: [(r.doc_id, r.shard, r.slot) for r in S.shards(df, 8, seed, 20_000).orderBy("shard", "slot").collect()]
    assert order(1) == order(1)
    assert order(1) != order(2)


def test_buckets_stay_small(spark):
    rows = [(1, "same text of a hot row")] * 4000
    out = S.shards(spark.createDataFrame(rows, SCHEMA), 4, bucket_bytes=10_000)
    assert out.count() == 4000


def test_order_is_even():
    places = Counter()
    for seed in range(6000):
        places[tuple(S.fisher_yates(3, [seed, 1]))] += 1
    assert len(places) == 6 and min(places.values()) > 850


def test_columns_of_the_same_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5, None), (2, "b", 6, "k")], "doc_id long, text string, bucket_ int, before_ string")
    out = S.shards(df, 2)
    assert out.columns == [*df.columns, "shard", "slot"]
    assert sorted(map(tuple, out.select(df.columns).collect())) == [(1, "a", 5, None), (2, "b", 6, "k")]
    path = scratch(spark)
    S.write(out, path)
    assert spark.read.parquet(path).count() == 2


def test_empty(spark):
    assert S.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_documents_of_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(S.report(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], 8)
