"""How far the sources of a language differ in their words, from factorised chunk counts.

A chunk is a stretch between ASCII white space, with a-z for A-Z and without the signs and digits at
its ends; a term is a run of `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]` after A-Z became a-z, so terms never
cross chunks and no term is lost. Chunks without any term are dropped at once.

1. Tasks cut and number the chunks of some MB of text at a time, as Arrow columns, and add up, per
   (lang, source, chunk), occurrences and documents. Spark adds these sums; a frequent chunk or a hot source is a few rows by then. They
   are stored in buckets of the chunk.
2. Every globally distinct chunk is cut into terms once; the terms are joined back to the sums, all
   within the buckets.
3. A term's documents are at least those of its most frequent chunk and at most the sum over its
   chunks. Only where the minimum lies between the two are documents looked at again: a fixed
   bitmap of chunk checksums (4 MB, no false negatives) picks out the chunks concerned, which are
   joined exactly and counted by distinct rows.
4. p = 1 + floor(10^9 (count + 5) / (N + 5 V)) in 38-digit decimals. Pairs of sources are compared
   per bucket of terms, as a dense matrix of terms by sources of some CELLS values; the sums of
   the buckets are added by Spark. Every pair of sources is a row of the result, so a bucket holds
   the more terms the more sources there are, up to MOST_CELLS values.

Defined results: null text, lang and source are ''; repeated rows are documents each, whatever
their ids; a text of any length is one document and counts all its chunks; bytes that are no UTF-8
are what Spark's decoder makes of them (U+FFFD); ties in value are ranked by item in UTF-8 order;
a language without kept terms has pairs of value 0 and no terms; a group without terms has its
pairs as well; an empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import settle, settle_by, text_bytes

MIN_DOCUMENTS = 30
TOP_TERMS = 50
PRIOR = 5
SCALE = 1_000_000_000
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Values of one matrix of terms by sources in a task: few, and many where there are many pairs.
CELLS, MOST_CELLS = 1 << 16, 1 << 22
#: Bytes of text that a task cuts at a time, what a row counts besides its text, and rows sent on at once.
PORTION_BYTES, ROW_BYTES, SENT_ROWS = 16_000_000, 64, 100_000
#: Bytes of text for each bucket of chunks, when the session's partitions are too few.
BUCKET_BYTES = 64_000_000
#: Bits of the bitmap, and of one piece of it.
BITS, PIECE = 1 << 25, 1 << 15

#: ASCII that no term holds, taken off the ends of chunks.
SIGNS = bytes(b for b in range(128) if not chr(b).isalpha())


def _texts(docs: DataFrame) -> DataFrame:
    """lang, source, text, nulls as ''."""
    as_text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    return docs.select(as_text("lang"), as_text("source"), as_text("text"))


def _portions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with about PORTION_BYTES of text in a batch; a longer text is held whole."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
        upto = np.cumsum(lengths.astype(np.int64) + ROW_BYTES)
        first = before = 0
        while first < batch.num_rows:
            last = min(int(np.searchsorted(upto, before + PORTION_BYTES - size)) + 1, batch.num_rows)
            held.append(batch.slice(first, last - first))
            size += int(upto[last - 1]) - before
            first, before = last, int(upto[last - 1])
            if size >= PORTION_BYTES:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Place of the text and number of the chunk for every chunk of some texts; the chunks by number."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    place = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    found = pc.ascii_trim(parts.flatten(), SIGNS.decode())
    bare = pc.not_equal(found, "")
    found = found.filter(bare).dictionary_encode()
    return place[bare.to_numpy(zero_copy_only=False)], found.indices.to_numpy().astype(np.int64), found.dictionary


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per (lang, source, chunk) of some text at a time."""
    for batch in _portions(batches):
        place, number, chunks = _cut(batch.column(2))
        n = max(len(chunks), 1)
        in_text, times = np.unique(place * n + number, return_counts=True)
        lang, source = (batch.column(i).dictionary_encode() for i in range(2))
        n_sources = len(source.dictionary)
        group = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
        groups, group = np.unique(group, return_inverse=True)
        key = group[in_text // n] * n + in_text % n
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        own = groups[key[first] // n]
        sums = {
            "lang": lang.dictionary.take(pa.array(own // n_sources)),
            "source": source.dictionary.take(pa.array(own % n_sources)),
            "chunk": chunks.take(pa.array(key[first] % n)),
            "occurrences": pa.array(np.add.reduceat(times[order], first) if len(first) else first),
            "documents": pa.array(np.diff(np.r_[first, len(key)])),
        }
        yield from pa.table(sums).to_batches(max_chunksize=SENT_ROWS)


def chunk_sums(docs: DataFrame) -> tuple[DataFrame, int]:
    """lang, source, chunk, its occurrences and the documents it is in; and the buckets it is in."""
    texts = _texts(docs)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // BUCKET_BYTES))
    parts = texts.mapInArrow(
        _sums, "lang string, source string, chunk string, occurrences long, documents long"
    )
    # The tasks have summed up already: by chunk at once, so that nothing moves again.
    sums = parts.repartition(buckets, "chunk").groupBy("lang", "source", "chunk")
    sums = sums.agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))
    return settle_by(sums, "chunk", buckets, spread=False), buckets


def chunk_terms(sums: DataFrame, buckets: int) -> DataFrame:
    """chunk, term and how often it is in the chunk; every distinct chunk is cut once."""
    terms = F.regexp_extract_all("chunk", F.lit(TERM), F.lit(0))
    cut = sums.select("chunk").distinct().select("chunk", F.explode(terms).alias("term"))
    cut = cut.groupBy("chunk", "term").agg(F.count("*").alias("times"))
    return settle_by(cut, "chunk", buckets, spread=False)


def _having(bits: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The distinct chunks of each row whose checksum's bit is set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_set = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").astype(bool)
        for batch in _portions(batches):
            place, number, chunks = _cut(batch.column(2))
            n = max(len(chunks), 1)
            some = is_set[np.fromiter(map(zlib.crc32, text_bytes(chunks)), np.int64, len(chunks)) % BITS]
            live = np.flatnonzero(some[number])
            in_text = np.unique(place[live] * n + number[live])
            text = pa.array(in_text // n)
            seen = {
                "lang": batch.column(0).take(text),
                "row": batch.column(3).take(text),
                "chunk": chunks.take(pa.array(in_text % n)),
            }
            yield from pa.table(seen).to_batches(max_chunksize=SENT_ROWS)

    return run


def _bitmap(chunks: DataFrame) -> bytes:
    """One bit per checksum of a chunk: BITS bits, however many chunks there are."""
    bit = F.crc32("chunk") % BITS
    pieces = chunks.select((bit / PIECE).cast("int").alias("piece"), (bit % PIECE).alias("bit")).groupBy("piece")
    whole = bytearray(BITS // 8)
    for row in pieces.agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        whole[row.piece * PIECE // 8 : (row.piece + 1) * PIECE // 8] = row.bits
    return bytes(whole)


def kept_terms(docs: DataFrame, sums: DataFrame, terms: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """lang and term, for terms in at least `least` documents of the language."""
    per_lang = sums.groupBy("lang", "chunk").agg(F.sum("documents").alias("documents"))
    cut = per_lang.join(terms.hint("shuffle_hash"), "chunk")
    bounds = cut.groupBy("lang", "term").agg(F.max("documents").alias("low"), F.sum("documents").alias("high"))
    bounds = settle(bounds.filter(F.col("high") >= least))
    unsure = settle(bounds.filter(F.col("low") < least).select("lang", "term"))
    unsure = settle(cut.select("lang", "chunk", "term").join(unsure, ["lang", "term"]))
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(unsure))
    rows = _texts(docs).withColumn("row", F.monotonically_increasing_id())
    seen = rows.mapInArrow(_having(bits), "lang string, row long, chunk string").join(unsure, ["lang", "chunk"])
    seen = seen.groupBy("lang", "term").agg(F.count_distinct("row").alias("n")).filter(F.col("n") >= least)
    sure = bounds.filter(F.col("low") >= least)
    return settle(sure.select("lang", "term").unionByName(seen.select("lang", "term")))


def _p(count: Column | str, n: Column | str, v: Column | str) -> Column:
    """1 + floor(SCALE (count + PRIOR) / (n + PRIOR v)), without rounding and without overflow."""
    return F.expr(
        f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + {PRIOR} as decimal(20,0)))"
        f" div cast({n} + {PRIOR} * {v} as decimal(20,0))"
    )


def _distances(rows: pa.Table) -> pa.Table:
    """Summed differences of all pairs of sources over one bucket of terms."""
    source, item, p = rows.column("source").to_pylist(), rows.column("term").to_pylist(), rows.column("p").to_numpy()
    base = [i for i, t in enumerate(item) if t is None]
    names = [source[i] for i in base]
    place = {s: i for i, s in enumerate(names)}
    term = {t: i for i, t in enumerate({t for t in item if t is not None})}
    cells = np.tile(p[base], (len(term), 1)) if term else np.zeros((0, len(names)), np.int64)
    for s, t, value in zip(source, item, p, strict=True):
        if t is not None:
            cells[term[t], place[s]] = value
    lefts, rights, values = [], [], []
    for a in range(len(names) - 1):
        lefts += [names[a]] * (len(names) - 1 - a)
        rights += names[a + 1 :]
        values.append(np.abs(cells[:, a + 1 :] - cells[:, a : a + 1]).sum(axis=0, dtype=np.int64))
    value = np.concatenate(values) if values else np.zeros(0, np.int64)
    lang = pa.array(rows.column("lang").to_pylist()[:1] * len(lefts), pa.string())
    return pa.table(
        [lang, pa.array(lefts, pa.string()), pa.array(rights, pa.string()), pa.array(value)],
        names=["lang", "source", "item", "value"],
    )


def audit(docs: DataFrame, least: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the language's other sources (`pair`)
    and the terms that a source has more often than its language (`term`)."""
    sums, buckets = chunk_sums(docs)
    terms = chunk_terms(sums, buckets)
    kept = kept_terms(docs, sums, terms, least)
    cells = sums.join(terms.hint("shuffle_hash"), "chunk").join(kept, ["lang", "term"])
    cells = cells.groupBy("lang", "source", "term").agg(F.sum(F.col("occurrences") * F.col("times")).alias("count"))
    cells = settle(cells)

    per_source = cells.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    per_lang = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = _texts(docs).select("lang", "source").distinct().join(per_source, ["lang", "source"], "left")
    groups = settle(groups.join(per_lang, "lang", "left").fillna(0, ["n", "v"]))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("n"), F.max("v").alias("v"), F.count("*").alias("sources"))

    own = cells.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", _p("count", "n", "v").alias("p")
    )
    whole = cells.groupBy("lang", "term").agg(F.sum("count").alias("count")).join(langs, "lang")
    whole = whole.select("lang", "term", _p("count", "n", "v").alias("q"))
    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = own.join(whole, ["lang", "term"]).filter("p > q")
    more = more.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    more = more.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= top)

    cells_each = f"least({MOST_CELLS}, greatest({CELLS}, 8 * sources * sources))"
    sizes = langs.select("lang", F.expr(f"int(1 + (v * sources) div {cells_each})").alias("buckets"))
    bucket = F.expr("int(pmod(xxhash64(term), buckets))").alias("bucket")
    sparse = own.join(sizes, "lang").select("lang", bucket, "source", "term", "p")
    unseen = F.when(F.col("v") > 0, _p("0", "n", "greatest(v, 1)")).otherwise(F.lit(0)).alias("p")
    base = groups.join(sizes, "lang").select(
        "lang", F.explode(F.expr("sequence(0, buckets - 1)")).alias("bucket"), "source",
        F.lit(None).cast("string").alias("term"), unseen,
    )
    pairs = sparse.unionByName(base).groupBy("lang", "bucket")
    pairs = pairs.applyInArrow(_distances, "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = pairs.select("lang", F.explode(turned).alias("way"), "value").select("lang", "way.*", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(by_rank))
    order = ["lang", "source", "part", "item", "value", "rank"]
    both = [x.withColumn("part", F.lit(part)).select(order) for x, part in ((pairs, "pair"), (more, "term"))]
    return both[0].unionByName(both[1])
