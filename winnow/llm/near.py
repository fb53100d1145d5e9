"""Near-duplicates: ProbMinHash signatures, banding, verification, classes.

A document's elements are its five-word shingles (all its words, if it has fewer), each with weight
1 however often it comes, as links are decided by sets. In ProbMinHash every element is a Poisson process with its weight as rate; each
arrival falls on a random register, and a register keeps the element that came first. An element
whose next arrival is later than all registers' first ones is done. Two documents agree in a
register with their probability Jaccard similarity as probability: for equal weights, the shared
shingles' share of the larger set, which is no less than the Jaccard similarity.

Documents with the same words are one text (`copies`); signatures of distinct texts are cut into
20 bands of 4 registers. Texts that share a band are candidates. A pair becomes a link when the
Jaccard similarity of the shingle sets is 0.8 or more; classes are what links connect.

No bucket is ever paired out when it is large. Its most popular text, the one with the most
bucket mates over all its bands, is compared with all others; near copies of one source meet that
source. In buckets whose texts are not all in one class then, those of different classes that share
one of their rarest shingles are compared with each other. This prune is exact, so no candidate link
between classes is lost, and large classes cost one comparison per text and outsider.

Defined results: texts without words (null, empty, signs only) are a class each; repeated rows are
copies; a class is named by its smallest doc_id, nulls last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm.common import chunks, col_name, fresh, giving_back, settle, settle_by
from winnow.llm.graph import components
from winnow.llm.words import U64, mix, words

SHINGLE = 5
BANDS, ROWS = 20, 4
#: Links: 10 * shared shingles >= 8 * shingles of either.
SIMILARITY = (8, 10)
BUCKET_BYTES = 64_000_000
#: Shingles of a text by which a pair's first common one is known.
FIRST = 8
#: Text bytes that a task signs at a time: a dozen arrays hold eight bytes for each shingle.
CHUNK_BYTES = 1_000_000
_STEP = U64(0x9E3779B97F4A7C15)

SIGNED = T.StructType(
    [
        T.StructField("rid", T.LongType()),
        T.StructField("words_a", T.LongType()),
        T.StructField("words_b", T.LongType()),
        T.StructField("signature", T.ArrayType(T.IntegerType())),
        T.StructField("shingles", T.ArrayType(T.IntegerType())),
    ]
)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of every shingle of some texts; `first` as in Words."""
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(n_words - size + 1, 1), 0)
    text = np.repeat(np.arange(len(n)), n)
    start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[:-1][text]
    out = np.zeros(len(start), dtype=U64)
    for k in range(size):
        live = start + k < first[1:][text]
        out[live] = mix(out[live] * _STEP + hashes[start[live] + k])
    return text, out


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """ProbMinHash of n weighted sets, given as parallel arrays with distinct elements per text."""
    time = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, dtype=np.uint32)
    at = np.zeros(len(element))
    live = np.arange(len(element))
    arrival = 0
    while len(live):
        draw = mix(element[live] + U64(arrival * int(_STEP) % (1 << 64)))
        at[live] += -np.log(((draw >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live]
        slot = text[live] * registers + (mix(draw ^ _STEP) % U64(registers)).astype(np.int64)
        now = at[live]
        ahead = np.flatnonzero(now < time[slot])
        np.minimum.at(time, slot[ahead], now[ahead])
        won = ahead[now[ahead] == time[slot[ahead]]]
        winner[slot[won]] = element[live[won]].astype(np.uint32)
        # Later arrivals of an element only come later: it is done when all registers are ahead.
        own = np.unique(text[live])
        latest = np.zeros(n)
        latest[own] = time.reshape(n, registers)[own].max(axis=1)
        live = live[now < latest[text[live]]]
        arrival += 1
    return winner.reshape(n, registers)


def _signed(registers: int, schema: pa.Schema) -> Callable:
    @giving_back
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text", CHUNK_BYTES):
            w = words(texts)
            n = len(texts)
            text, shingle = shingles(w.hash, w.first)
            order = np.lexsort((shingle, text))
            text, shingle = text[order], shingle[order]
            new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])][: len(text)])
            text, shingle = text[new], shingle[new]
            del order, new
            found = signatures(text, shingle, np.ones(len(text)), n, registers).view(np.int32)
            # Two hashes of all words in order name the text.
            place = np.arange(len(w.hash)) - w.first[:-1][w.text_of()]
            names = []
            for salt in (1, 2):
                spread = mix(w.hash ^ mix((place * 2 + salt).astype(U64) * _STEP))
                sums = np.r_[U64(0), np.cumsum(spread, dtype=U64)]
                names.append(mix(sums[w.first[1:]] - sums[w.first[:-1]]).view(np.int64))
            low = np.unique(text.astype(U64) << U64(32) | shingle & U64(0xFFFFFFFF))
            ends = np.searchsorted(low >> U64(32), np.arange(n + 1, dtype=U64)).astype(np.int32)
            low = low.astype(np.uint32).view(np.int32)
            empty = w.first[1:] == w.first[:-1]
            made = {
                "words_a": pa.array(names[0], mask=empty),
                "words_b": pa.array(names[1], mask=empty),
                "signature": pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1) * registers, type=pa.int32()), pa.array(found.reshape(-1))
                ),
                "shingles": pa.ListArray.from_arrays(pa.array(ends), pa.array(low)),
            }
            yield pa.RecordBatch.from_arrays(
                [
                    (made[f.name] if f.name in made else batch.column(batch.schema.get_field_index(f.name))).cast(f.type)
                    for f in schema
                ],
                schema=schema,
            )

    return run


def _similar(x: str, y: str) -> Column:
    """Whether two sets of shingles, given by their columns, are similar."""
    least, of = SIMILARITY
    small, large = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    both = F.size(F.array_intersect(x, y))
    # Sizes alone rule many pairs out before shingles are compared.
    return (of * small >= least * large) & (of * both >= least * (F.size(x) + F.size(y) - both))


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar. Many pairs may have the same a; b differs more.

    `texts` is stored in buckets of rid. Texts that are an `a` are stored apart: the join with them
    has an exchange on both sides, which lets Spark split an `a` with many pairs.
    """
    firsts = texts.join(pairs.select(F.col("a").alias("rid")).distinct(), "rid", "left_semi")
    firsts = settle(firsts.select(F.col("rid").alias("a"), F.col("shingles").alias("shingles_a")))
    seconds = texts.select(F.col("rid").alias("b"), F.col("shingles").alias("shingles_b"))
    met = pairs.join(seconds, "b").join(firsts, "a")
    return settle(met.filter(_similar("shingles_a", "shingles_b")).select("a", "b"))


def _across(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of different classes in a band that may be similar. rest: band, rid, class.

    Similar sets share one of their rarest shingles: of n shingles, in one order for all texts, the
    first n - ceil(0.8 n) + 1 (the prefix). Texts meet by band and such a shingle, and only where it
    is in several classes; there, those outside of the class with the most texts meet all. So the
    texts of one class never meet through each other, and at most twice the pairs of different
    classes that share a key are looked at. Similar texts share many keys: a pair comes out of the
    join at the first one.
    """
    least, of = SIMILARITY
    own = settle(rest.select("rid", "class").distinct())
    sets = own.join(texts.select("rid", "shingles"), "rid")
    rows = settle(sets.select("rid", "class", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle")))
    often = settle(rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("class").alias("x"), F.max("class").alias("y")))
    often = often.selectExpr("shingle", "n", "x <> y AS several")
    order = Window.partitionBy("rid").orderBy("n", "shingle")
    # A text's class would only be moved along with each of its shingles: it comes back after the ranks.
    placed = rows.drop("class").join(often, "shingle").withColumn("place", F.row_number().over(order) - 1)
    prefix = placed.filter(f"several AND place < size - ({least} * size + {of - 1}) div {of} + 1")
    prefix = settle(prefix.join(own, "rid").select("rid", "class", "size", "shingle", "place"))
    # What tells a pair's first key from its others: some first shingles, and all bands of a text.
    rank = F.row_number().over(Window.partitionBy("rid").orderBy("place"))
    firsts = prefix.select("rid", "place", "shingle", rank.alias("k")).filter(F.col("k") <= FIRST)
    firsts = firsts.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("place", "shingle")))["shingle"].alias("firsts"))
    own = settle(firsts.join(rest.groupBy("rid").agg(F.collect_list("band").alias("bands")), "rid"))
    met = settle(prefix.join(rest.select("band", "rid"), "rid").join(own, "rid"))
    key = ["band", "shingle"]
    held = met.groupBy(*key, "class").agg(F.count("*").alias("n"))
    held = held.groupBy(key).agg(F.max(F.struct("n", "class")).alias("top"), F.count("*").alias("classes"))
    held = settle(held.filter("classes > 1").select(*key, F.col("top.class").alias("most")))
    # Hashed, not sorted: rows of a text stay together, so that their equal lists shrink in shuffles.
    met = settle(met.join(held.hint("shuffle_hash"), key))
    few = met.filter("class <> most")
    other = met.select(*key, *(F.col(c).alias(f"{c}_b") for c in ("rid", "class", "size", "place", "firsts", "bands")))
    # What both have from their first shared shingle on must do.
    both = "least(size - place, size_b - place_b)"
    enough = F.expr(
        "class <> class_b AND (class_b = most OR rid < rid_b)"
        f" AND {of} * least(size, size_b) >= {least} * greatest(size, size_b)"
        f" AND {of} * ({both}) >= {least} * (size + size_b - ({both}))"
        # Once for all bands that both are in; and if they share a first shingle, once for all shingles.
        " AND band = array_min(array_intersect(bands, bands_b))"
        " AND shingle = coalesce(get(array_intersect(firsts, firsts_b), 0), shingle)"
    )
    pairs = few.join(other, key).filter(enough)
    return settle(pairs.select(F.least("rid", "rid_b").alias("a"), F.greatest("rid", "rid_b").alias("b")).distinct())


def _classes(texts: DataFrame, bands: int, rows: int) -> DataFrame:
    """node and component of all texts that have links."""
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * rows + 1, rows))
    )
    banded = texts.select("rid", F.explode(keys).alias("band"))
    buckets = settle(banded.groupBy("band").agg(F.count("*").alias("mates")).filter("mates > 1"))
    members = settle(banded.join(buckets, "band"))
    popular = settle(members.groupBy("rid").agg(F.sum("mates").alias("popularity")))
    first = members.join(popular, "rid").groupBy("band").agg(F.max(F.struct("popularity", "rid")).alias("first"))
    first = settle(first.select("band", F.col("first.rid").alias("a")))
    pairs = members.join(first, "band").filter("a <> rid").select("a", F.col("rid").alias("b")).distinct()
    links = _links(settle(pairs), texts)
    found = settle(components(links))
    # Buckets that hold texts of several classes: these have met the first text, but not each other.
    named = members.filter("mates > 2").join(found, members["rid"] == found["node"], "left")
    named = settle(named.select("band", "rid", F.coalesce("component", "rid").alias("class")))
    mixed = named.groupBy("band").agg(F.min("class").alias("x"), F.max("class").alias("y"))
    rest = settle(named.join(settle(mixed.filter("x <> y").select("band")), "band", "left_semi"))
    if rest.isEmpty():
        return found
    more = _links(_across(rest, texts), texts)
    return found if more.isEmpty() else settle(components(links.union(more)))


def _stored(own: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """Names, signature and shingles of all documents, stored in buckets of rid."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = own.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // BUCKET_BYTES))
    schema = T.StructType([*SIGNED.fields, own.schema["doc_id"]])
    signed = own.select("rid", "doc_id", "text").mapInArrow(_signed(bands * rows, to_arrow_schema(schema)), schema)
    return settle_by(signed, "rid", parts)


def classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """rid, doc_id and class (a number) of every row of a table."""
    own = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(col_name(doc_id)).alias("doc_id"),
        F.col(col_name(text)).alias("text"),
    )
    return classes_of(own, bands, rows)


def classes_of(own: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The same for a table of rid (unique numbers), doc_id and text."""
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    signed = _stored(own, size, bands, rows)
    name = ["words_a", "words_b"]
    copies = settle(signed.filter("words_a IS NOT NULL").groupBy(name).agg(F.min("rid").alias("one")))
    texts = signed.join(copies.select(F.col("one").alias("rid")).hint("shuffle_hash"), "rid", "left_semi")
    found = _classes(texts, bands, rows)
    named = copies.join(found, copies["one"] == found["node"], "left")
    named = settle(named.select(*name, F.coalesce("component", "one").alias("class")))
    of_rows = signed.select("rid", "doc_id", *name).join(named, name, "left")
    return of_rows.select("rid", "doc_id", F.coalesce("class", "rid").alias("class"))


def _first_of_class(found: DataFrame) -> DataFrame:
    """class, size of the class and its first document."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    return settle(found.groupBy("class").agg(F.count("*").alias("size"), F.min(order).alias("first")))


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: the smallest doc_id of its class, the size of the class, and whether
    the document is the one that stays."""
    found = settle(classes(docs, **options))
    first = _first_of_class(found)
    return found.join(first, "class").select(
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        F.col("size").alias("class_size"),
        (F.col("rid") == F.col("first.rid")).alias("kept"),
    )


def distinct_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of a table without those that are near-duplicates of another one that stays."""
    rid = fresh(docs, "rid_")
    stored = settle(docs.withColumn(rid, F.monotonically_increasing_id()))
    own = stored.select(
        F.col(rid).alias("rid"), F.col(col_name(doc_id)).alias("doc_id"), F.col(col_name(text)).alias("text")
    )
    first = _first_of_class(settle(classes_of(own, **options)))
    return stored.join(first.select(F.col("first.rid").alias(rid)), rid, "left_semi").select(
        *map(col_name, docs.columns)
    )
