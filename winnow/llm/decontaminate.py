"""Benchmark decontamination: an FM-index per training shard, searched for all test phrases.

A phrase is a window of 13 consecutive words of a benchmark item; a shorter item is one phrase.
Documents stay where they are: a task takes its documents in shards of some megabytes, numbers
their words by the benchmark's vocabulary, builds the index, searches every phrase backwards,
locates the occurrences and merges them to spans. Nothing is shuffled, so no key can be hot.

Words that no phrase holds cannot be in an occurrence. They become separators, and stretches
between separators that are shorter than the shortest phrase are left out of the index. Both
change no result and keep the index small.

The phrases go to all tasks. A block of them has at most `phrase_bytes` of item text (one larger
item is a block of its own); larger benchmarks are searched block by block, the spans carried
along in the documents' rows.

Defined results: null or wordless documents have no words and are clean; null or wordless items
have no phrase; repeated items with one id count once; a null id is an item with an empty name.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm.common import chunks, col_name, fresh, giving_back
from winnow.llm.fm_index import FMIndex
from winnow.llm.words import words

WIDTH = 13
PHRASE_BYTES = 16_000_000
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class Phrases:
    """Distinct windows of some items, as numbers of their words."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = WIDTH):
        found = words([(t or "").encode() for _, t in items])
        self.vocabulary, numbers = np.unique(found.hash, return_inverse=True)
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for (name, _), a, b in zip(items, found.first[:-1], found.first[1:], strict=True):
            own = (numbers[a:b] + 1).tolist()
            for i in range(max(1, len(own) - width + 1) if own else 0):
                owners[tuple(own[i : i + width])].add(name)
        self.owners = [sorted(x) for x in owners.values()]
        self.lengths = np.array([len(x) for x in owners], dtype=np.int64)
        self.shortest = int(self.lengths.min(initial=width))
        self.matrix = np.zeros((len(owners), width), dtype=np.int64)
        for row, x in enumerate(owners):
            self.matrix[row, : len(x)] = x
        # Most words of a text are in no phrase: a small table of hash ends rules them out.
        self.filter = np.zeros(1 << 18, dtype=bool)
        self.filter[self.vocabulary & np.uint64((1 << 18) - 1)] = True

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word in the vocabulary, from 1; 0 if it is not there."""
        out = np.zeros(len(hashes), dtype=np.int64)
        maybe = np.flatnonzero(self.filter[hashes & np.uint64((1 << 18) - 1)])
        at = np.searchsorted(self.vocabulary, hashes[maybe])
        at[at == len(self.vocabulary)] = 0
        hit = self.vocabulary[at] == hashes[maybe]
        out[maybe[hit]] = at[hit] + 1
        return out


def occurrences(phrases: Phrases, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, phrase) of every occurrence in a shard of texts; `first` as in Words."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.lengths) or not len(hashes):
        return none
    numbers = phrases.numbered(hashes)
    starts = np.zeros(len(hashes) + 1, dtype=bool)
    starts[first] = True
    known = numbers > 0
    begins = np.flatnonzero(known & (starts[:-1] | ~np.r_[False, known[:-1]]))
    ends = np.flatnonzero(known & (starts[1:] | ~np.r_[known[1:], False])) + 1
    long = ends - begins >= phrases.shortest
    begins, sizes = begins[long], (ends - begins)[long]
    if not len(begins):
        return none
    # 0, stretch, 0, stretch, ... 0; `word_of` leads back to the words.
    offsets = np.cumsum(np.r_[1, sizes + 1])
    tokens = np.zeros(int(offsets[-1]), dtype=np.int64)
    word_of = np.full(int(offsets[-1]), -1, dtype=np.int64)
    place = np.repeat(offsets[:-1] - np.cumsum(np.r_[0, sizes[:-1]]), sizes) + np.arange(int(sizes.sum()))
    word_of[place] = np.repeat(begins - np.cumsum(np.r_[0, sizes[:-1]]), sizes) + np.arange(int(sizes.sum()))
    tokens[place] = numbers[word_of[place]]
    index = FMIndex(tokens)
    low, high = index.search(phrases.matrix, phrases.lengths)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(low - np.cumsum(np.r_[0, count[:-1]]), count) + np.arange(int(count.sum()))
    return word_of[index.locate(rows)], which


def _marked(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True for the places that some [start, end) covers."""
    depth = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(depth[:n]) > 0


def _scan(phrases, text: str, spans: str, items: str, n_words: str, drop_text: bool, schema: pa.Schema):
    @giving_back
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = phrases.value
        for batch, texts in chunks(batches, text):
            w = words(texts)
            at, which = occurrences(p, w.hash, w.first)
            hit = _marked(len(w.hash), at, at + p.lengths[which])
            names: dict[int, set[str]] = defaultdict(set)
            text_of = np.searchsorted(w.first, at, side="right") - 1
            for d, k in set(zip(text_of.tolist(), which.tolist(), strict=True)):
                names[d].update(p.owners[k])
            before_spans = batch.column(batch.schema.get_field_index(spans)).to_pylist()
            before_items = batch.column(batch.schema.get_field_index(items)).to_pylist()
            all_spans, all_items = [], []
            for d in range(len(texts)):
                a, b = int(w.first[d]), int(w.first[d + 1])
                own = hit[a:b].copy()
                for s in before_spans[d] or ():
                    own[s["start"] : s["end"]] = True
                edge = np.flatnonzero(np.diff(np.r_[0, own.view(np.int8), 0])).tolist()
                all_spans.append([{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                all_items.append(sorted(names.get(d, set()).union(before_items[d] or ())))
            made = {spans: all_spans, items: all_items, n_words: np.diff(w.first)}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(made[f.name], type=f.type)
                    if f.name in made
                    else batch.column(batch.schema.get_field_index(f.name)).cast(f.type)
                    for f in schema
                ],
                schema=schema,
            )

    return run


def hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    phrase_bytes: int = PHRASE_BYTES,
    names: tuple[str, str, str] = ("spans", "items", "n_words"),
) -> DataFrame:
    """The documents with three more columns: hit spans (word numbers from 0, merged), the names
    of items with an occurrence, and the number of words. `names` must be new to the table."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spans, items, n_words = names
    spark = docs.sparkSession
    test = benchmark.select(
        F.coalesce(F.col(col_name(item_id)).cast("string"), F.lit("")).alias("name"),
        F.col(col_name(item_text)).alias("phrase"),
    ).filter("length(phrase) > 0")
    size = test.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    blocks = -(-int(size) // phrase_bytes) or 1
    out = docs.withColumns(
        {spans: F.lit(None).cast(SPANS), items: F.lit(None).cast("array<string>"), n_words: F.lit(0).cast("long")}
    )
    for k in range(blocks):
        own = test.filter(F.pmod(F.xxhash64("name", "phrase"), F.lit(blocks)) == k) if blocks > 1 else test
        # Bounded: a block holds about phrase_bytes of text.
        phrases = spark.sparkContext.broadcast(Phrases([(r[0], r[1]) for r in own.collect()], width))
        schema = T.StructType([*out.schema.fields])
        scan = _scan(phrases, text, spans, items, n_words, False, to_arrow_schema(schema))
        out = out.mapInArrow(scan, schema)
    return out


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: how much of it the benchmark's items cover, and which items."""
    own = docs.select(F.col(col_name(doc_id)).alias("doc_id"), F.col(col_name(text)).alias("text"))
    found = hits(own, benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "spans",
        "items",
    ).withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    names = tuple(fresh(docs, n) for n in ("spans", "items", "n_words"))
    found = hits(docs, benchmark, text=text, names=names, **options)
    spans, _, n_words = (F.col(n) for n in names)
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.filter(~((n_hit > 0) & (20 * n_hit >= n_words))).drop(*names)


def item_digest(names: Iterable[str]) -> str:
    """The digest of a document's items, for comparison."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
