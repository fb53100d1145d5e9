"""Removed bytes against a plain search for every string of the width."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from winnow.llm import repeats as R

SCHEMA = "doc_id long, text string"


def plain(docs, width):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for (doc_id, _), t in zip(docs, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not before for g, before in zip(gone, b"\0" + gone, strict=False))
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, docs, **options):
    rows = R.report(spark.createDataFrame(docs, SCHEMA), **options).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=repr)


def corpus(seed, alphabet="abcdefgé ", n=60):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [word(rng.choice([30, 39, 40, 41, 50, 80, 200])) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p))
            parts += [word(rng.randint(0, 60)), rng.choice([p, p, p[cut:], p[:cut], p[:cut] + "X" + p[cut:]])]
        docs.append((i, "".join(parts)))
    # Copies, copies with edits, null, empty, periodic texts, one long text.
    docs += [(n + 1, docs[3][1]), (3, docs[3][1]), (n + 2, docs[5][1] + "!"), (None, None), (n + 3, ""), (None, docs[5][1])]
    docs += [(n + 4, "a" * 300), (n + 5, "ab" * 100), (n + 6, "A, " * 90), (n + 7, word(20_000) + passages[0])]
    return docs


@pytest.mark.parametrize(("seed", "alphabet"), [(1, "abcdefgé "), (2, "ab"), (3, "abcdefghijklmnopqrstuvwxyz ")])
def test_small_width(spark, seed, alphabet):
    docs = corpus(seed, alphabet)
    assert run(spark, docs, width=40, gram=8) == plain(docs, 40)


def test_full_width(spark):
    rng = random.Random(9)
    word = lambda k: "".join(rng.choice("abcdefgh \n") for _ in range(k))
    passages = [word(k) for k in (399, 400, 401, 463, 464, 800, 3000)]
    docs = [(i, word(rng.randint(0, 900)) + rng.choice(passages) + word(rng.randint(0, 900))) for i in range(30)]
    near = docs[4][1]
    docs += [(100 + k, near[: 97 * k] + "#" + near[97 * k + 1 :]) for k in range(1, 6)]
    assert run(spark, docs) == plain(docs, 400)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == plain([(1, None)], 400)


def test_representatives_depend_on_the_string_only():
    rng = np.random.default_rng(1)
    buffer = rng.integers(97, 100, 2000).astype(np.uint8)
    grams = R.gram_ids(buffer, 4)
    chosen = R.representatives(grams, 30, 4)
    for p in range(0, len(buffer) - 30 + 1):
        own = grams[p : p + 27] >> np.uint64(32)
        assert chosen[p] - p == int(own.argmin())


def test_documents_of_the_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = R.report(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    found = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=repr)
    assert found == plain(docs, 400)


def test_long_text_full_of_repeats_and_clashing_columns(spark):
    rng = random.Random(4)
    unit = "".join(rng.choice("abcdefgh ") for _ in range(500))
    docs = [(1, unit * 400 + "end"), (2, "x" * 100_000), (3, unit[:399])]
    df = spark.createDataFrame([(*d, 1, "s", 2) for d in docs], "doc_id long, text string, rid int, spans string, bucket long")
    rows = sorted((r.doc_id, r.n_removed, r.n_kept, r.n_spans) for r in R.report(df).collect())
    assert rows == [(1, 200_000, 3, 1), (2, 100_000, 0, 1), (3, 0, 399, 0)]


def test_second_hash_tells_stretches_apart_on_its_own():
    buffer = np.frombuffer(b"abcdefgh" * 10, np.uint8)
    start, end = np.array([0, 8, 1]), np.array([40, 48, 41])
    one, two = (R.stretch_hash(R.running(buffer, *v), start, end) for v in ((), (R._OTHER_VALUE,)))
    assert one[0] == one[1] != one[2] and two[0] == two[1] != two[2] and not set(one) & set(two)
