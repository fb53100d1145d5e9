"""Periodic runs of words: where a text says the same thing again and again.

A run is a stretch of consecutive words with smallest period q and at least max(12, 2 q) words that
no neighbouring word extends. For each period p, every such stretch holds two places x and x + p
with x on the grid of multiples of max(p, 12 - p); summed over all p these are n log n pairs. Each
pair whose words or whose words before agree is extended both ways by queries on the text's
run-length grammar (`grammar`: recompression), which gives the exact ends. A stretch found under
several periods is kept under the smallest, which divides the others.

A task holds the texts of about CHUNK bytes, or one longer text, and its grammar, a few dozen bytes
a word; grid pairs are made in blocks of PAIRS. No text is split over tasks and nothing is shuffled,
so hot keys and copies do no harm.

Words are runs of `[^\\x20\\x09-\\x0D]`. Defined results: a null, empty or blank text has no words,
no runs and an empty collapsed text; rows are judged each on its own, so repeated rows give the
same result each; runs are listed by start, then period (no two share both); texts of any length
are searched whole; bytes that are no UTF-8 stay as they are; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import chunks, col_name
from winnow.llm.grammar import Grammar

#: Fewest words of a run.
LEAST = 12
CHUNK = 1_000_000
PAIRS = 1 << 18
WORD_GAP = "[ \\t\\n\\x0B\\f\\r]+"


def _grid(sizes: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places a period apart, in blocks: x and the period."""
    most = np.where(sizes >= LEAST, sizes // 2, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    gap = np.maximum(period, LEAST - period)
    count = (sizes[text] - 1 - period) // gap + 1
    end = np.cumsum(count)
    first = 0
    while first < len(end):
        before = int(end[first - 1]) if first else 0
        last = max(int(np.searchsorted(end, before + PAIRS, "right")), first + 1)
        for a in range(0, int(end[last - 1]) - before, PAIRS):  # one period's pairs may be many
            part = np.arange(before + a, min(before + a + PAIRS, int(end[last - 1])))
            row = first + np.searchsorted(end[first:last], part, "right")
            yield begin[text[row]] + (part - (end[row] - count[row])) * gap[row], period[row]
        first = last


def runs_of(texts: list[list[bytes]]) -> np.ndarray:
    """Text number, start, length and period of every run, in this order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    names: dict[bytes, int] = {}
    sequence = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64)
    begin = np.cumsum(sizes + 1) - sizes
    for words, at in zip(texts, begin.tolist(), strict=True):
        sequence[at : at + len(words)] = [names.setdefault(w, len(names)) for w in words]
    sequence[np.append(0, begin + sizes)] = len(names) + np.arange(len(texts) + 1)  # between texts
    grammar = Grammar(sequence, enough=16 + 4 * len(texts))
    word = sequence.astype(grammar.symbol.dtype)
    found = []
    for x, period in _grid(sizes, begin):
        y = x + period
        some = np.flatnonzero((word[x] == word[y]) | (word[x - 1] == word[y - 1]))
        x, y, period = x[some], y[some], period[some]
        ahead, behind = grammar.common(x, y, True), grammar.common(x - 1, y - 1, False)
        some = ahead + behind >= np.maximum(period, LEAST - period)
        rows = np.stack([x - behind, period + ahead + behind, period])[:, some]
        found.append(np.unique(rows, axis=1) if rows.size else rows)
    rows = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
    if rows.shape[1]:
        same = (rows[0, 1:] == rows[0, :-1]) & (rows[1, 1:] == rows[1, :-1])
        rows = rows[:, np.append(True, ~same)]
    text = np.searchsorted(begin, rows[0], "right") - 1
    rows = np.stack([text, rows[0] - begin[text], rows[1], rows[2]], axis=1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds beyond its first period."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


def _searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch, texts in chunks(batches, "text", CHUNK):
        words = [t.split() for t in texts]
        runs = runs_of(words)
        ends = np.searchsorted(runs[:, 0], np.arange(len(words) + 1))
        rest = [collapsed(w, runs[a:b, 1:]) for w, a, b in zip(words, ends[:-1], ends[1:], strict=True)]
        spans = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in (1, 2, 3)], fields=list(kind))
        yield pa.record_batch(
            [batch.column(0), pa.ListArray.from_arrays(ends.astype(np.int32), spans), pa.array(rest, pa.binary())],
            names=["id", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, `runs` as (start, length, period) in words, and `collapsed`: the text with one period
    of every run, its words joined by one space."""
    named = docs.select(F.col(col_name(key)).alias("id"), F.col(col_name(text)).cast("string").alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    span = "array<struct<start: long, length: long, period: long>>"
    found = named.mapInArrow(_searched, f"id {kind}, runs {span}, collapsed binary")
    return found.select(F.col("id").alias(key), "runs", F.col("collapsed").cast("string").alias("collapsed"))


def repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; one document in ten, chosen by its id's checksum, repeats from some word on."""
    words = F.expr(f"filter(split(coalesce(text, ''), r'{WORD_GAP}'), w -> w <> '')")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    chosen = F.expr("h % 10 = 0")
    rows = rows.withColumn("words", F.when(chosen, words))
    rows = rows.withColumn("a", F.expr("(h div 10) % nullif(size(words), 0)"))
    rows = rows.withColumn("p", F.expr("1 + (size(words) - a) div (3 + (h div 10) % 8)"))
    tail = F.expr(
        "array_join(transform(sequence(0, size(words) - 1),"
        " i -> words[int(if(i < a, i, a + (i - a) % p))]), ' ')"
    )
    return rows.select("doc_id", F.when(chosen & (F.size("words") > 0), tail).otherwise(F.col("text")).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: the number of runs, the longest one, and digests of all runs and of the rest."""
    found = periodic_runs(repeated_tails(docs))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start as start, -r.period as period)))")
    found = found.withColumn("longest", longest)
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("(1000 * longest.length) div -longest.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
