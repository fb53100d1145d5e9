"""The FM-index against plain search, the report against a plain evaluation of its rule."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Row

from winnow.llm import decontaminate as D
from winnow.llm.fm_index import FMIndex, suffix_order
from winnow.llm.words import plain_words, words

SCHEMA = "doc_id long, text string"


def plain_report(docs, items, width=13):
    windows = {}
    for name, text in items:
        own = plain_words(text)
        for i in range(max(1, len(own) - width + 1) if own else 0):
            windows.setdefault(tuple(own[i : i + width]), set()).add("" if name is None else str(name))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        own, hit, found = plain_words(text), set(), set()
        for n in sizes:
            for i in range(len(own) - n + 1):
                if names := windows.get(tuple(own[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(own)))
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, SCHEMA)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = D.report(d, b, **options).collect()
    return sorted(
        ((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows), key=repr
    )


@pytest.mark.parametrize("seed", range(6))
def test_index_counts_and_locates(seed):
    rng = random.Random(seed)
    body = [rng.choice([0, 1, 1, 2, 3, 4]) for _ in range(rng.choice([3, 40, 400]))]
    tokens = np.array([0, *body, 0])
    index = FMIndex(tokens)
    phrases = [[rng.randint(1, 5) for _ in range(rng.randint(1, 4))] for _ in range(60)]
    matrix = np.zeros((60, 4), dtype=np.int64)
    for i, p in enumerate(phrases):
        matrix[i, : len(p)] = p
    low, high = index.search(matrix, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high, strict=True):
        expected = [i for i in range(len(tokens)) if tokens[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


def test_suffix_order_of_a_long_repeat():
    tokens = np.array([0, *[1] * 300, 0, *[1] * 300, 0])
    order = suffix_order(tokens)
    zeros = {p: i for i, p in enumerate(np.flatnonzero(tokens == 0))}

    def key(p):
        suffix = []
        while tokens[p]:
            suffix.append(10 + int(tokens[p]))
            p += 1
        return [*suffix, zeros[p]]

    assert order.tolist() == sorted(range(len(tokens)), key=key)


def test_words_are_those_of_the_rule():
    texts = ["It's A1-b2 été ÉTÉ x", "", "  ", "日本 語_x~y", "end"]
    found = words([t.encode() for t in texts])
    raw = [found.buffer[a:b].tobytes().decode() for a, b in zip(found.start, found.end, strict=True)]
    expected = [plain_words(t) for t in texts]
    assert [w.translate({c: c + 32 for c in range(65, 91)}) for w in raw] == sum(expected, [])
    assert np.diff(found.first).tolist() == [len(x) for x in expected]
    assert len(set(found.hash.tolist())) == len({w for x in expected for w in x})


def test_report_matches_the_rule(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, item(rng.choice([3, 13, 14, 30]))) for i in range(20)]
    items += [(3, items[3][1]), (90, items[4][1]), (91, None), (92, ""), (93, "!!"), (None, item(14))]
    docs = [(i, item(rng.choice([0, 1, 12, 40, 300]))) for i in range(40)]
    for i in range(40, 70):
        inside = (items[i % 20][1] or "").upper().replace(" ", ", ")
        docs.append((i, f"{item(5)} {inside} {item(rng.choice([0, 30, 900]))}"))
    docs += [(70, None), (71, ""), (None, items[0][1]), (41, docs[41][1]), (72, item(30_000) + " " + items[1][1])]
    expected = plain_report(docs, items)
    assert run(spark, docs, items) == expected
    assert run(spark, docs, items, phrase_bytes=300) == expected


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == plain_report([(1, "a b")], [])


def test_filter_keeps_columns_and_clean_rows(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame(
        [
            Row(doc_id=1, text=passage, spans="x", N_Words=5, items=None),
            Row(doc_id=2, text="clean", spans="y", N_Words=6, items=None),
            Row(doc_id=3, text=None, spans=None, N_Words=None, items=None),
            Row(doc_id=4, text=passage + " z" * 2000, spans="z", N_Words=6, items=None),
        ],
        "doc_id long, text string, spans string, N_Words int, items int",
    )
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
