"""Folding, matching and exceptions on small cases; the score on held-out labels."""

import os
import random
import zlib

import numpy as np
import pytest

from winnow.llm import toxicity as T

SCHEMA = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize(
    ("text", "folded"),
    [
        ("An 1D10T, l0$er!! $cum", " an idiot loser scum "),
        ("ѕtupіd сlоwn", " stupid clown "),
        ("ｍｏｒｏｎ", " moron "),
        ("tra​sh tr­ash", " trash trash "),
        ("in 1999, 42 %", " in 1999 42 "),
        ("wh$$$ the!!", " wh the "),
        ("réêou_É", " réêou é "),
        ("", " "),
        ("--", " "),
    ],
)
def test_fold(text, folded):
    assert T.fold(text.encode()) == folded
    assert T.fold(b"a\xffb") == " a b "


def plain_hits(folded, entries, phrases):
    words = folded.split()
    free = set()
    for p in phrases:
        p = p.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                free |= set(range(i, i + len(p)))
    return sorted(
        e for i, w in enumerate(words) if i not in free for e in entries if (w == e.strip() if e.endswith(" ") else w.startswith(e.strip()))
    )


def test_hits_against_a_plain_search():
    rnd = random.Random(3)
    entries = {" ab": 1.0, " abc ": 2.0, " c ": 3.0, " cab": 1.0, " a ": 1.0}
    phrases = ["c a", "abc", "b abc b", "a a"]
    phrases = [p for p in phrases if f" {p} " not in entries]
    matcher = T.Matcher(entries, phrases)
    for _ in range(400):
        folded = T.fold(" ".join("".join(rnd.choices("abc", k=rnd.randrange(1, 5))) for _ in range(rnd.randrange(12))).encode())
        assert sorted(e for _, e in matcher.hits(folded)) == plain_hits(folded, entries, phrases)


def test_stems_words_and_exceptions_are_learned(spark):
    rnd = random.Random(5)
    filler = lambda n: [rnd.choice("lorem ipsum dolor sit amet eius modi quia".split()) + rnd.choice("aeiou") for _ in range(n)]
    docs, labels = [], []
    for i in range(1200):
        words = filler(40)
        toxic = i % 4 == 0
        if toxic:
            words[rnd.randrange(5, 30)] = rnd.choice(["nitwit", "gruzz" + rnd.choice("abcdefgh"), "n1tw1t"])
        elif i % 40 == 1:
            k = rnd.randrange(5, 30)
            words[k : k + 2] = ["gentle", "nitwit"]
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    model = T.train(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS))
    assert {" gruzz"} <= set(model.weights) and "gentle nitwit" in model.exceptions
    rows = T.report(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    right = [r.predicted == int(r.doc_id % 4 == 0) for r in held]
    assert np.mean(right) > 0.9


def test_held_out_labels(spark, sf_dir):
    """Figures for the README; 4 % of the toxic labels are on texts without any such word."""
    sf = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = T.report(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    caught = found[found.toxic == 1].predicted.mean()
    right = found[found.predicted == 1].toxic.mean()
    both = found.score.rank()
    n = (found.toxic == 1).sum()
    area = (both[found.toxic == 1].sum() - n * (n + 1) / 2) / n / (len(found) - n)
    print(f"caught {caught:.3f}, right {right:.3f}, area {area:.4f}")
    assert caught > 0.9 and right > 0.95 and area > 0.96


def test_held_out_rows_are_not_learned_from(spark):
    docs = [(i, f"word{i % 7} plain text number {i} " + ("awful" if i % 2 else "")) for i in range(400)]
    labels = [(i, 1, i % 2) for i in range(400)]
    turned = [(i, q, t if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - t) for i, q, t in labels]
    df = spark.createDataFrame(docs, SCHEMA)
    one, two = (T.train(df, spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert one == two and one.weights


def test_nulls_copies_long_texts_and_clashing_columns(spark):
    docs = [(i, "calm words here " * 3 + f"{i} " + ("vile" if i % 3 == 0 else "")) for i in range(300)]
    docs += [(None, None), (None, "vile " * 50), (1000, ""), (1001, None), (1002, "vile " * 200_000)]
    docs += [(3, "vile again")] * 3
    labels = [(i, 1, int(i % 3 == 0)) for i in range(300)] + [(None, 1, 1), (5, 1, None), (4, 0, 0), (4, 0, 0)]
    df = spark.createDataFrame([(*d, 0.5, "x", 1) for d in docs], SCHEMA + ", score double, value string, toxic int")
    rows = T.report(df, spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert {r.n_terms > 0 for r in rows if r.doc_id == 3} == {True}


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([(1, "a b")], SCHEMA), spark.createDataFrame([], LABELS)
    assert [(r.score, r.predicted) for r in T.report(docs, labels).collect()] == [(0.0, 0)]
    assert T.report(spark.createDataFrame([], SCHEMA), labels).collect() == []
