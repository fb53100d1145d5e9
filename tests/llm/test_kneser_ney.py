"""The model against a plain evaluation of its formulas, decisions on labelled documents."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.llm import kneser_ney as K

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def plain_model(texts, seen, order):
    """logp of every n-gram in `seen` by recursion over the textbook formulas."""
    tables = [Counter()]
    for t in texts:
        padded = K.BEGIN * (order - 1) + t + K.END
        for i in range(len(t) + 1):
            tables[0][padded[i : i + order]] += 1
    for _ in range(order - 1):
        tables.insert(0, Counter(g[1:] for g in tables[0]))
    letters = {g[-1] for g in seen}
    discounts, contexts = [], []
    for table in tables:
        t = [0, *(sum(c == k for c in table.values()) for k in (1, 2, 3, 4))]
        own = []
        for k in (1, 2, 3):
            y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else None
            d = k - (k + 1) * y * t[k + 1] / t[k] if t[k] and y is not None else k * 0.5
            own.append(min(max(d, 0.1), k))
        discounts.append([0, *own])
        by = defaultdict(list)
        for g, c in table.items():
            by[g[:-1]].append(c)
        contexts.append(by)

    def p(g):
        less = p(g[1:]) if len(g) > 1 else 1 / (len(letters) + 1)
        table, d, by = tables[len(g) - 1], discounts[len(g) - 1], contexts[len(g) - 1]
        if g[:-1] not in by:
            return less
        counts, c = by[g[:-1]], table.get(g, 0)
        return (c - d[min(c, 3)] + sum(d[min(x, 3)] for x in counts) * less) / sum(counts)

    return {g: math.log(p(g)) for g in seen}


def grams(text, order):
    padded = K.BEGIN * (order - 1) + text + K.END
    return [padded[i : i + order] for i in range(len(text) + 1)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    parts = ["the ", "and ", "ing ", "é", "on", "er", "th", "日", "😀", "\n"]
    text = lambda n: "".join(rng.choice(parts) for _ in range(n))
    docs = [(i, text(rng.choice([1, 5, 40])), rng.choice(["en", "fr", None])) for i in range(60)]
    docs += [(60, None, "en"), (61, "", "fr"), (62, "x" * 5000, "en"), (63, "other", "zz"), (None, "the", "en"),
             (3, docs[3][1], "en"), (64, "a\x02b\x03c", "en")]
    labels = [(i, int(i % 3 > 0), int(i % 10 == 0)) for i in range(40)] + [(1, 1, 0), (60, 1, 0), (None, 1, 0), (2, None, None)]
    return docs, labels


@pytest.mark.parametrize(("order", "shard_rows"), [(1, 10**6), (3, 10**6), (5, 60)])
def test_scores(spark, corpus, order, shard_rows):
    docs, labels = corpus
    by = defaultdict(list)
    for i, q, t in labels:
        by[i].append(None if q is None else q == 1 and t != 1)
    good = {i for i, flags in by.items() if i is not None and False not in flags and True in flags}
    bare = lambda t: (t or "").replace(K.BEGIN, " ").replace(K.END, " ")
    models = {(d[2] or ""): None for d in docs}
    df = spark.createDataFrame(docs, DOCS)
    folds = {r.doc_id: r.fold for r in K.with_folds(df, spark.createDataFrame(labels, LABELS), "doc_id", "fold").collect()}
    assert {i for i, f in folds.items() if f} == good & {d[0] for d in docs}
    assert {0, 1, 2} == set(folds.values())
    for lang in models:
        own = [(i, bare(t)) for i, t, x in docs if (x or "") == lang and t]
        seen = {g for _, t in own for g in grams(t, order)}
        models[lang] = plain_model([t for i, t in own if folds[i] == K.COUNTED], seen, order)
    rows = K.scored(df, spark.createDataFrame(labels, LABELS), order=order, shard_rows=shard_rows).collect()
    found = sorted((repr((r.doc_id, r.text, r.lang)), r.n_tokens, r.sum_logp, r.fold) for r in rows)
    assert len(rows) == len(docs)
    for (i, t, lang), (key, n, logp, fold) in zip(sorted(docs, key=repr), found, strict=True):
        assert key == repr((i, t, lang)) and fold == folds[i]
        own = [models[lang or ""][g] for g in grams(bare(t), order)] if t else []
        assert n == len(own)
        assert logp == pytest.approx(sum(own), rel=1e-4, abs=1e-6)


def test_probabilities_of_a_context_sum_to_one(spark):
    texts = ["abracadabra", "banana", "cab", "bad dad"]
    letters = sorted({c for t in texts for c in t} | {K.END})
    docs = [(t, "en", 1) for t in texts] + [("".join(letters[1:]) + a + b, "en", 0) for a in "abcd" for b in letters[1:]]
    table = K.log_probabilities(K.gram_counts(spark.createDataFrame(docs, "text string, lang string, fold int"), 2), 2)
    p = {r.gram: math.exp(r.logp) for r in table.collect()}
    for c in "abcd":
        assert sum(v for g, v in p.items() if g[0] == c) <= 1 + 1e-9


def test_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64 - 1, 5000, dtype=np.uint64))
    table = K.Lookup(keys, np.arange(len(keys)) + 1.0)
    assert table.get(keys[::-1]).tolist() == list(range(len(keys), 0, -1))
    assert not table.get(keys + np.uint64(1)).any()
    assert K.Lookup(keys[:0], np.zeros(0)).get(keys[:3]).tolist() == [0, 0, 0]


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    train, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    rows = K.report(docs, train).join(held, "doc_id").select("kept", "quality", "toxic").collect()
    clean = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) >= 0.985 * len(clean)
    assert sum(bad) <= 0.25 * len(bad)


@pytest.mark.parametrize("half", [0, 1])
def test_bad_documents_held_out(spark, half):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    train, held = labels.filter(f"doc_id % 2 = {half}"), labels.filter(f"doc_id % 2 <> {half}")
    rows = K.report(spark.read.parquet(f"{sf}/documents.parquet"), train).join(held, "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) >= 0.98 * len(clean)
    assert sum(bad) <= 0.1 * len(bad)


def test_outliers_do_not_set_the_limit(spark):
    rows = [(i, "en", K.THRESHOLD, -100.0 - i % 7, 100) for i in range(40)]
    rows += [(i, "en", K.THRESHOLD, -500.0, 100) for i in (50, 51)] + [(60, "en", 0, -250.0, 100)]
    rows += [(i, "fr", K.THRESHOLD, -100.0, 100) for i in range(70, 80)] + [(80, "fr", 0, -102.0, 100)]
    names = ("fold", "sum_logp", "n_tokens")
    found = spark.createDataFrame(rows, "doc_id long, lang string, fold int, sum_logp double, n_tokens long")
    judged, out = K._judged(found, "lang", names)
    kept = judged.filter(K._stays(out, "n_tokens"))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(40), *range(70, 81)]


def test_rows_that_stay(spark):
    docs = [(i, "good text here " * 20, "en") for i in range(30)] + [(90, "%$#@" * 40, "en"), (91, None, "en"), (92, "", "en"),
            (93, "good text here " * 20, "xx")]
    df = spark.createDataFrame(docs, DOCS).withColumns({"fold_": F.lit(1), "range_": F.lit("r")})
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(90, 0, 0)], LABELS)
    kept = K.good_documents(df, labels)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(30), 93]
    none = K.good_documents(df, labels.limit(0))
    assert none.count() == 32


def test_empty(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert K.report(docs, labels).collect() == []
