"""Periodic runs and the grammar's queries against plain searches."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from winnow.llm import periodic as P
from winnow.llm.grammar import Grammar

SCHEMA = "doc_id long, text string"


def plain_runs(words):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        start = None
        for i in range(len(words) - p + 1):
            equal = i + p < len(words) and words[i] == words[i + p]
            if equal and start is None:
                start = i
            if not equal and start is not None:
                length = i + p - start
                if length >= max(12, 2 * p):
                    found.setdefault((start, length), p)
                start = None
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for s, k, q in runs for i in range(s + q, s + k)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    first = (None,) * 4 if not best else (*best, 1000 * best[1] // best[2])
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *first, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(kept))


def order(rows):
    return sorted(rows, key=repr)


def texts(n, seed):
    rnd = random.Random(seed)
    for _ in range(n):
        words = []
        for _ in range(rnd.randrange(6)):
            unit = rnd.choices("abcd", k=rnd.randrange(1, 9))
            words += (unit * rnd.randrange(1, 9))[: rnd.randrange(1, 40)]
        yield rnd.choice([" ", "\n", " \t "]).join(words)


@pytest.mark.parametrize("seed", range(4))
def test_queries_of_the_grammar(seed):
    rnd = random.Random(seed)
    body = [int(w) for t in texts(40, seed) for w in map(ord, t.replace("\n", " ").split())] + [1] * 50 + [1, 2] * 40
    rnd.shuffle(body[:20])
    sequence = np.array([1000, *body, 1001])
    grammar = Grammar(sequence, enough=2)
    x = np.array([rnd.randrange(1, len(body)) for _ in range(3000)])
    y = np.array([rnd.randrange(1, len(body)) for _ in range(3000)])
    x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
    for a, b, ahead, behind in zip(x, y, grammar.common(x, y, True), grammar.common(x, y, False), strict=True):
        k = 0
        while sequence[a + k] == sequence[b + k]:
            k += 1
        assert ahead == k
        k = 0
        while sequence[a - k] == sequence[b - k]:
            k += 1
        assert behind == k


@pytest.mark.parametrize("seed", range(5))
def test_runs_of_many_texts(monkeypatch, seed):
    monkeypatch.setattr(P, "PAIRS", [1 << 18, 7, 100][seed % 3])
    many = [t.encode().split() for t in texts(120, seed)]
    found = P.runs_of(many)
    for i, words in enumerate(many):
        assert [tuple(r[1:]) for r in found.tolist() if r[0] == i] == plain_runs(words)


def test_report(spark):
    docs = list(enumerate(texts(300, 8)))
    docs += [(None, None), (None, "x " * 30), (5, ""), (5, " \x0b\n "), (6, "é日   " * 9), (7, "a a " * 15)]
    docs += [(9, "b a " * 7)] * 3
    df = spark.createDataFrame(docs, SCHEMA)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and t for i, t in docs)
    assert order(map(tuple, P.report(df).collect())) == order(plain_row(*d) for d in docs)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    short = docs.filter("length(text) < 6000")
    expected = [plain_row(*r) for r in short.collect()]
    found = P.report(docs).join(short.select("doc_id").distinct(), "doc_id", "left_semi")
    assert order(map(tuple, found.collect())) == order(expected)


def test_real_outputs(spark):
    df = spark.createDataFrame([("k", "so it goes on " * 4 + "end", 1)], "name string, body string, runs int")
    row = P.periodic_runs(df, "name", "body").first()
    assert row.name == "k" and [tuple(r) for r in row.runs] == [(0, 16, 4)] and row.collapsed == "so it goes on end"


def test_long_texts_full_of_repeats():
    begin = time.time()
    fib = [b"a", b"ab"]
    while len(fib[-1]) < 100_000:
        fib.append(fib[-1] + fib[-2])
    for words, n in (([b"a"] * 200_000, 1), ([b"a", b"b", b"a"] * 60_000, 1), ([bytes([c]) for c in fib[-1]], None)):
        found = P.runs_of([words])
        assert n is None or len(found) == n
    assert time.time() - begin < 60


def test_empty_table_and_clashing_columns(spark):
    empty = P.report(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns[:3] == ["doc_id", "n_runs", "start"]
    df = spark.createDataFrame([(1, "a " * 20, 0, 0, "z", 1)], SCHEMA + ", h long, a int, words string, id int")
    assert tuple(P.report(df).first()) == plain_row(1, "a " * 20)
