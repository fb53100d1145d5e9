"""The audit of sources against a plain count in Python, with exact fractions."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations
from types import SimpleNamespace

import pyarrow as pa
import pytest

from winnow.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, least, top):
    lower = {c: c + 32 for c in range(65, 91)}
    terms = [(lang or "", source or "", TERM.findall((text or "").translate(lower))) for text, lang, source in docs]
    in_docs = defaultdict(Counter)
    for lang, _, words in terms:
        in_docs[lang].update(set(words))
    rows = []
    for lang in {t[0] for t in terms}:
        kept = {w for w, k in in_docs[lang].items() if k >= least}
        counts = defaultdict(Counter)
        for other, source, words in terms:
            if other == lang:
                counts[source].update(w for w in words if w in kept)
        whole = sum(counts.values(), Counter())
        v = len(kept)
        p = {
            s: {w: 1 + (1_000_000_000 * (c[w] + 5)) // (sum(c.values()) + 5 * v) for w in kept}
            for s, c in [*counts.items(), (None, whole)]
        }
        found = defaultdict(list)
        for a, b in permutations(counts, 2):
            found[a, "pair"].append((-sum(abs(p[a][w] - p[b][w]) for w in kept), b.encode()))
        for s in counts:
            more = [(p[None][w] - p[s][w], w.encode()) for w in kept if counts[s][w] and p[s][w] > p[None][w]]
            found[s, "term"] = sorted(more)[:top]
        for (s, part), items in found.items():
            rows += [(lang, s, part, b.decode(), -f, r) for r, (f, b) in enumerate(sorted(items), 1)]
    return sorted(rows)


def result(spark, docs, least=3, top=4, schema=SCHEMA):
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], schema)
    return sorted(tuple(r) for r in D.audit(df, least, top).collect())


def made(n, seed):
    rnd = random.Random(seed)
    words = ["The", "the,", "über", "Über!", "a1b", "x-y", "x", " z", "ÀB", "don't", "\t", "q\x0bq", "Ω", "日本 語"]
    rare = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    for _ in range(n):
        pick = rnd.choices(words, k=rnd.randrange(12)) + rnd.choices(rare, k=rnd.randrange(5))
        yield " ".join(pick), rnd.choice(["en", "de", "", None]), rnd.choice(["a", "b", "b", "é", None, ""])


@pytest.mark.parametrize(("least", "top", "seed"), [(3, 4, 1), (12, 50, 2), (1, 2, 3), (10**6, 5, 4)])
def test_same_as_plain(spark, least, top, seed):
    docs = list(made(300, seed))
    assert result(spark, docs, least, top) == plain(docs, least, top)


def test_small_matrices_flushes_and_documents_looked_at_again(spark, monkeypatch):
    """Terms whose documents lie between the bounds: variants of one word, overlapping or not."""
    docs = [("Ab ab, ab. AB", "en", "s")] * 2 + [("ab, cd", "en", "t"), ("Cd", "en", "t"), ("(cd) Cd", "en", "u")]
    docs += [("x-x X x;x", "en", "u")] * 2
    monkeypatch.setattr(D, "CELLS", 2)
    monkeypatch.setattr(D, "MOST_CELLS", 3)
    assert result(spark, docs, 3, 9) == plain(docs, 3, 9)
    many = list(made(200, 9))
    assert result(spark, many, 5, 9) == plain(many, 5, 9)


def test_nulls_ties_copies_and_texts_without_terms(spark):
    docs = [(None, None, None), ("", "en", "a"), ("123 !!", "en", "b"), ("same same", "en", "c")] * 3
    found = result(spark, docs, 3, 9)
    assert found == plain(docs, 3, 9)
    assert [r[3] for r in found if r[:3] == ("en", "c", "pair")] == ["a", "b"]  # a tie, in order of the items


def test_long_text_and_clashing_columns(spark):
    docs = [("word " * 200_000 + "z" * 100_000, "en", "a"), ("word other", "en", "b")] * 3
    df = spark.createDataFrame(
        [(i, *d, "x", 1, 2, "y") for i, d in enumerate(docs)],
        SCHEMA + ", chunk string, row long, count long, term string",
    )
    assert sorted(tuple(r) for r in D.audit(df, 3, 9).collect()) == plain(docs, 3, 9)


def test_empty_table(spark):
    found = D.audit(spark.createDataFrame([], SCHEMA))
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"] and not found.collect()


def test_counts_beyond_64_bits_when_scaled(spark):
    p = spark.range(1).select(D._p("30000000000000", "90000000000001", "7").alias("p")).first().p
    assert p == 1 + (10**9 * (3 * 10**13 + 5)) // (9 * 10**13 + 1 + 35)


def test_variants_of_a_word_are_one_chunk_and_need_no_second_look(spark):
    docs = [("Ab ab, (AB) 12 x-Y: --", "en", "s"), ('"ab" X-y Été. 3.14', "en", "s")] * 2
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], SCHEMA)
    sums, buckets = D.chunk_sums(df)
    found = sorted(tuple(r) for r in sums.select("chunk", "occurrences", "documents").collect())
    assert found == [("ab", 8, 4), ("x-y", 4, 4), ("Été", 2, 2)]
    assert sorted(tuple(r) for r in D.chunk_terms(sums, buckets).collect()) == [
        ("ab", "ab", 1), ("x-y", "x", 1), ("x-y", "y", 1), ("Été", "Été", 1)
    ]
    assert result(spark, docs, 2, 9) == plain(docs, 2, 9)


def test_signs_between_and_around_letters(spark):
    rng = random.Random(6)
    ends = [chr(b) for b in range(1, 128)] + ["é", "ß", "日", "\u00a0", "\u2028"]
    docs = [("".join(rng.choices(ends, k=80)), "en", rng.choice("ab")) for _ in range(150)]
    assert result(spark, docs, 3, 50) == plain(docs, 3, 50)


def batches(docs, rows):
    for i in range(0, len(docs), rows):
        columns = list(zip(*docs[i : i + rows], strict=True))
        yield pa.record_batch([pa.array(c) for c in columns], names=["lang", "source", "text", "row"][: len(columns)])


@pytest.mark.parametrize("portion", [1, 700, 10**6])
def test_sums_of_portions(monkeypatch, portion):
    monkeypatch.setattr(D, "PORTION_BYTES", portion)
    docs = [(lang or "", source or "", text) for text, lang, source in made(300, 5)] + [("en", "a", "Ab " * 500), ("en", "a", "")]
    wanted, found = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        chunks = Counter(c for c in (x.lower().strip(D.SIGNS) for x in text.encode().split()) if c)
        wanted[lang, source].update({(c.decode(), i): k for c, n in chunks.items() for i, k in enumerate((n, 1))})
    sent = list(D._sums(batches(docs, 7)))
    for row in pa.Table.from_batches(sent).to_pylist():
        own = row["occurrences"], row["documents"]
        found[row["lang"], row["source"]].update({(row["chunk"], i): k for i, k in enumerate(own)})
    assert found == wanted
    if portion == 10**6:  # small batches are summed together
        assert sum(b.num_rows for b in sent) == sum(map(len, wanted.values())) // 2


def test_second_look_takes_the_checksum_of_a_chunk_once(monkeypatch):
    sums = []
    monkeypatch.setattr(D, "zlib", SimpleNamespace(crc32=lambda c: sums.append(c) or zlib.crc32(c)))
    whole = bytearray(D.BITS // 8)
    at = zlib.crc32(b"ab") % D.BITS
    whole[at // 8] |= 1 << at % 8
    docs = [("en", "s", f"Ab, cd 1 (ab) e{'xy'[i % 2]}", i) for i in range(50)]
    seen = [r for b in D._having(SimpleNamespace(value=bytes(whole)))(batches(docs, 7)) for r in b.to_pylist()]
    assert sorted(r["row"] for r in seen) == list(range(50)) and {r["chunk"] for r in seen} == {"ab"}
    assert sorted(sums) == [b"ab", b"cd", b"ex", b"ey"]
