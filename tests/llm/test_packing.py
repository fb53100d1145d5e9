"""Tokens against the tokenizer itself, bins against exhaustive search, places against the rules."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from winnow.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(str(PATH))


PARTS = ["the", " ", "  ", "\n", "Été", "é", "İ", "ß", "'s", "don't", "x1y", "١٢", "\x1c", "\x85", "　", "日本",
         "<|endoftext|>", "a<|startoftext|>b", ",", "...", "́", "Σς", "😀", "‍", "ﬁ", "A" * 40]


@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=5))))
@settings(max_examples=400, deadline=None)
def test_ids_are_those_of_the_tokenizer(parts):
    plain = Tokenizer.from_file(str(PATH)) if not hasattr(test_ids_are_those_of_the_tokenizer, "t") else None
    if plain:
        test_ids_are_those_of_the_tokenizer.t = plain, P.WordTokenizer(str(PATH))
    plain, own = test_ids_are_those_of_the_tokenizer.t
    text = "".join(parts).encode(errors="ignore").decode()
    expected = plain.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == expected


@pytest.mark.parametrize(
    "word", ["Straẞe", "\u212a\u212a", "\u212bngstrom,", "Ⱥx", "İx", "x÷y", "foo.,!", "a\u0301", "é&&&", "Ǆ", "don't'", "x'S"]
)
def test_odd_words_one_by_one(word):
    expected = Tokenizer.from_file(str(PATH)).encode(word, add_special_tokens=False).ids
    assert np.frombuffer(P.WordTokenizer(str(PATH)).encode([word])[0], "<u4").tolist() == expected


def test_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF62') AS string) AS text")
    row = P.tokenized(df).first()
    assert list(row.ids) == [*Tokenizer.from_file(str(PATH)).encode("a\ufffdb", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("seed", range(20))
def test_fullest_combination(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(4)}
    room = rng.randint(0, 60)
    best = max(
        s
        for use in itertools.product(*(range(c + 1) for c in counts.values()))
        if (s := sum(n * u for n, u in zip(counts, use, strict=True))) <= room
    )
    used = P.fullest(counts, room)
    assert all(u <= counts[n] for n, u in used.items())
    assert sum(n * u for n, u in used.items()) == best


@pytest.mark.parametrize("seed", range(10))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 50): rng.randint(1, 400) for _ in range(rng.randint(1, 30))}
    places = {}
    ends = {(s.length, s.rank) for s in P.plan(counts, 50)}
    by = {n: sorted([s for s in P.plan(counts, 50) if s.length == n], key=lambda s: s.rank) for n in counts}
    assert len(ends) == sum(map(len, by.values()))
    for n, slots in by.items():
        for rank in range(counts[n]):
            s = [x for x in slots if x.rank <= rank][-1]
            nth = rank - s.rank
            places.setdefault(s.sequence + nth // s.use, []).append((s.offset + nth % s.use * n, n))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 50
    assert sum(map(len, places.values())) == sum(counts.values())


def check(rows, docs, plain, capacity):
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    expected = []
    for doc_id, text in docs:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            expected.append((doc_id, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(expected, key=repr)
    placed = {}
    for r in rows:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in placed.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    return placed


def test_documents_are_packed_whole(spark, plain):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["one", "Two,", "three's", "été"]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 7, 30, 90, 400]))) for i in range(150)]
    docs += [(3, docs[3][1]), (None, "x"), (None, "x"), (900, None), (901, ""), (902, "\x1c a")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    placed = P.packed(df, capacity=64)
    used = check(placed.collect(), docs, plain, 64)
    total = sum(n for own in used.values() for _, n in own)
    assert len(used) <= -(-total // 64) + 2
    made = {r.sequence_id: r.ids for r in P.sequences(placed).collect()}
    assert sum(map(len, made.values())) == total


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.packed(empty, ids=False).collect() == []


def test_documents_of_the_tables(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = P.packed(docs, ids=False).collect()
    used = check(rows, [(r.doc_id, r.text) for r in docs.collect()], plain, 4096)
    total = sum(r.length for r in rows)
    assert len(used) <= -(-total // 4096) + 1
