"""Removal of repeated byte strings: bucket-pointer refinement over sampled suffixes.

A byte goes if a string of `width` bytes covers it that also starts anywhere else in the corpus.

Suffixes. Every string of `width` bytes is represented by one suffix that starts in it: the one
whose first `gram` bytes have the smallest hash (the first of equals). Equal strings choose alike,
so only these suffixes, about one in 170 bytes, need to be compared. A suffix stands for the
strings that start `low` to `high` bytes before it.

Buckets. Suffixes are first put in buckets by their q-gram. Then buckets are refined: a member's
new bucket is made of the bucket identifiers of the q-grams at offset after offset of the
stretch that is compared. Members that are alone in their bucket are done: nothing equals them.
Members that share their bucket over the stretch that all their strings cover together are done
too: all of these strings repeat, and one such member goes on in place of all. The rest is split by
the strings' offsets and refined again, until one string is left per row. Only passages' edges go
that far.

Spark counts the members of a bucket before it shuffles, so a passage that a third of all documents
share costs one row per task. The table of texts is stored in buckets of its row number; each
round joins a few numbers per document to it, and texts are not shuffled again.

Bucket identifiers are 64-bit hashes of content. What is taken for equal must agree in a second
64-bit hash over the whole stretch, made with other numbers for the bytes: two of 10^12 stretches
differ and agree in both with a probability under 10^-14.

Defined results: null and empty texts have no bytes; repeated rows repeat each other; texts shorter
than `width` keep all bytes; a string that repeats in its own text goes at all its places, so there
are no ties to break; texts of any length are searched whole (one is held by one task); an empty
table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm.common import chunks, col_name, settle, settle_by, text_bytes
from winnow.llm.words import U64, mix, running, stretch_hash

WIDTH = 400
GRAM = 64
#: How many neighbouring strings are compared together, round by round.
STEPS = (64, 8, 1)
#: Bytes of text in a bucket of the table of texts, when the session's partitions are too few.
BUCKET_BYTES = 64_000_000

# bucket: that of the stretch that all strings of the row have in common; whole: that of the stretch
# that they cover together; proof: another hash of the latter; rid, at, low, high: row number of the text, suffix, strings.
MEMBERS = "bucket long, whole long, proof long, rid long, at long, low long, high long"
_STEP = U64(0xD6E8FEB86659FD93)
_OTHER_VALUE = mix(np.arange(1000, 1256, dtype=U64) * U64(0xA0761D6478BD642F))


def _batch(schema: pa.Schema, columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    parts = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
    return pa.RecordBatch.from_arrays(
        [pa.array(p.view(np.int64) if p.dtype == U64 else p).cast(f.type) for p, f in zip(parts, schema, strict=True)],
        schema=schema,
    )


def gram_ids(buffer: np.ndarray, gram: int) -> np.ndarray:
    """Bucket identifiers of all q-grams."""
    n = len(buffer) - gram + 1
    if n <= 0:
        return np.zeros(0, U64)
    places = np.arange(n)
    return stretch_hash(running(buffer), places, places + gram)


def stretch_ids(grams: np.ndarray, starts: np.ndarray, ends: np.ndarray, gram: int) -> np.ndarray:
    """Bucket identifiers of stretches: those of their q-grams at offset after offset, combined."""
    out = np.zeros(len(starts), dtype=U64)
    last = ends - gram
    for offset in range(0, int((ends - starts).max(initial=0)), gram):
        live = starts + offset < last
        out[live] = mix(out[live] * _STEP + grams[starts[live] + offset])
    return mix(out * _STEP + grams[last])


def representatives(grams: np.ndarray, width: int, gram: int) -> np.ndarray:
    """For each string start, the suffix that represents it."""
    span = width - gram + 1
    best = (grams & ~U64(0xFFFFFFFF)) | np.arange(len(grams), dtype=U64)
    reach = 1
    while 2 * reach <= span:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if reach < span:
        best = np.minimum(best[: len(best) - (span - reach)], best[span - reach :])
    return (best & U64(0xFFFFFFFF)).astype(np.int64)


def _suffixes(width: int, gram: int, schema: pa.Schema) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            rids = batch.column(batch.schema.get_field_index("rid")).to_numpy()
            kept = [i for i, t in enumerate(texts) if len(t) >= width]
            if not kept:
                continue
            sizes = np.array([len(texts[i]) for i in kept])
            begin = np.cumsum(np.r_[0, sizes + 1])[:-1]
            buffer = np.frombuffer(b"\0".join([texts[i] for i in kept]), dtype=np.uint8)
            grams = gram_ids(buffer, gram)
            chosen = representatives(grams, width, gram)
            n_starts = sizes - width + 1
            first = np.cumsum(np.r_[0, n_starts[:-1]])
            text = np.repeat(np.arange(len(kept)), n_starts)
            start = np.arange(int(n_starts.sum())) + (begin - first)[text]
            at = chosen[start]
            # Runs of starts with the same suffix.
            edge = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
            ends = np.r_[edge[1:], len(at)] - 1
            at, text, low_start, high_start = at[edge], text[edge], start[edge], start[ends]
            low, high = at - high_start, at - low_start
            salt = mix((low * 4096 + high).astype(U64))
            whole = mix(stretch_ids(grams, low_start, high_start + width, gram) ^ salt)
            proof = mix(stretch_hash(running(buffer, _OTHER_VALUE), low_start, high_start + width) ^ salt)
            yield _batch(
                schema, [[grams[at]], [whole], [proof], [rids[np.array(kept)[text]]], [at - begin[text]], [low], [high]]
            )

    return run


def _refined(step: int, width: int, gram: int, schema: pa.Schema) -> Callable:
    """The next buckets of members, split by `step` neighbouring strings."""

    def of(text: bytes, rows: list[dict]) -> list[np.ndarray]:
        at, low, high = np.array([(x["at"], x["low"], x["high"]) for x in rows], dtype=np.int64).T
        n = high // step - low // step + 1
        which = np.repeat(np.arange(len(at)), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + (low // step)[which]
        at, low, high = at[which], np.maximum(low[which], k * step), np.minimum(high[which], k * step + step - 1)
        buffer = np.frombuffer(text, dtype=np.uint8)
        grams = gram_ids(buffer, gram)
        # A split piece may lack strings at its ends; pieces with the same strings compare.
        salt = mix((low * 4096 + high).astype(U64))
        whole = mix(stretch_ids(grams, at - high, at - low + width, gram) ^ salt)
        proof = mix(stretch_hash(running(buffer, _OTHER_VALUE), at - high, at - low + width) ^ salt)
        last = np.minimum(k * step + step - 1, width - gram)
        common = stretch_ids(grams, at - k * step, at - last + width, gram)
        return [mix(common ^ mix((k + 1).astype(U64) * _STEP)), whole, proof, at, low, high]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(batch.schema.get_field_index("text")))
            rids = batch.column(batch.schema.get_field_index("rid")).to_pylist()
            members = batch.column(batch.schema.get_field_index("members"))
            columns: list[list[np.ndarray]] = [[] for _ in schema]
            size = 0
            for i, text in enumerate(texts):
                made = of(text, members[i].as_py())
                made.insert(3, np.full(len(made[0]), rids[i], dtype=np.int64))
                for c, values in zip(columns, made, strict=True):
                    c.append(values)
                size += len(made[0])
                if size > 200_000:
                    yield _batch(schema, columns)
                    columns, size = [[] for _ in schema], 0
            if size:
                yield _batch(schema, columns)

    return run


def _shared(members: DataFrame, *by: str) -> DataFrame:
    """Members that are not alone in their bucket. The buckets are a stored table, so that the join
    can split those with many members."""
    buckets = members.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").select(*by)
    return settle(members.join(settle(buckets), list(by), "left_semi"))


def repeated_starts(texts: DataFrame, width: int, gram: int, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """rid, first, last: runs of places in a text where strings start that start elsewhere too.
    `texts`: rid and text, stored in buckets of rid."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(MEMBERS)
    arrow = to_arrow_schema(schema)
    members = settle(texts.mapInArrow(_suffixes(width, gram, arrow), schema))
    rounds = []
    for step in steps:
        shared = _shared(members, "bucket")
        alike = shared.groupBy("whole", "proof").agg(F.count("*").alias("n"), F.min(F.struct("rid", "at", "low")).alias("one"))
        alike = settle(alike.filter("n > 1").select("whole", "proof", "one"))
        marked = settle(shared.join(alike, ["whole", "proof"], "left"))
        rounds.append(marked.filter("one IS NOT NULL"))
        # Of members alike one goes on, as those that are left may share some of its strings.
        open_ = marked.filter("one IS NULL OR (rid = one.rid AND at = one.at AND low = one.low)")
        listed = open_.groupBy("rid").agg(F.collect_list(F.struct("at", "low", "high")).alias("members"))
        refine = _refined(step, width, gram, arrow)
        joined = texts.join(listed.hint("shuffle_hash"), "rid")
        members = settle(joined.mapInArrow(refine, schema))
    rounds.append(_shared(members, "bucket", "proof"))  # single strings: alike if they share both
    columns = [F.col("rid"), F.expr("at - high").alias("first"), F.expr("at - low").alias("last")]
    found = rounds[0].select(columns)
    for r in rounds[1:]:
        found = found.union(r.select(columns))
    return found


def _cut(width: int, schema: pa.Schema) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            runs = batch.column(batch.schema.get_field_index("runs"))
            spans, kept = [], []
            for text, own in zip(texts, runs, strict=True):
                merged: list[list[int]] = []
                for a, b in sorted((x["first"], x["last"] + width) for x in own.as_py() or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                spans.append([{"start": a, "end": b} for a, b in merged])
                ends = [0, *(b for _, b in merged)]
                kept.append(b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in merged), len(text)], strict=True)))
            made = {"n_bytes": [len(t) for t in texts], "spans": spans, "kept": kept}
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


def without_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM
) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (removed bytes, merged) and kept (the others,
    joined; bytes, as a cut may fall into a character)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    own = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(col_name(doc_id)).alias("doc_id"),
        F.col(col_name(text)).alias("text"),
    )
    size = docs.agg(F.sum(F.octet_length(col_name(text)))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // BUCKET_BYTES))
    texts = settle_by(own, "rid", parts)
    found = repeated_starts(texts.select("rid", "text"), width, gram)
    runs = found.groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("runs")).hint("shuffle_hash")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(
        [
            T.StructField("doc_id", own.schema["doc_id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("spans", T.ArrayType(span)),
            T.StructField("kept", T.BinaryType()),
        ]
    )
    return texts.join(runs, "rid", "left").mapInArrow(_cut(width, to_arrow_schema(schema)), schema)


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: bytes, removed bytes, bytes left, runs of removed bytes, digest of the rest."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return without_repeats(docs, **options).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        (F.col("n_bytes") - removed).alias("n_kept"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
