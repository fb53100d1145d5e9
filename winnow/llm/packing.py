"""Packing of tokenised documents into sequences by minimum bin slack.

Documents become pieces of at most `capacity` tokens; only longer documents are cut. Every bin
takes the largest piece that is left and fills up with the combination of the other lengths that
comes closest to the capacity: a subset-sum dynamic programme over bits, one bit per fill level.

Pieces of one length are alike, so the search runs on the counts per length, at most `capacity`
numbers however many pieces there are. A combination is used as often as the counts allow before
the next is sought. The plan says which ranks among the pieces of a length go where; the pieces
get their ranks on the cluster and look their place up.

Defined results: null and empty texts have only the end token; bytes that are no UTF-8 are read as
U+FFFD; repeated rows are packed each; ties between combinations go to the longer lengths; texts of
any length are cut, none is left out; a table without rows gives no pieces. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm.common import chunks, col_name, giving_back, settle

CAPACITY = 4096
END_TOKEN = 1
#: Words that a worker remembers with their ids.
CACHE_WORDS = 600_000
# White space for str.split but not for the tokenizer.
_SEPARATORS = re.compile("[\x1c-\x1f]")
# Small letters that keep to themselves in composition; and signs that become one of them in lower case.
_SMALL = "".join(c for c in map(chr, range(0x61, 0x250)) if c.isalpha() and c.lower() == c)
_ODD = re.compile("[" + "".join(c for c in map(chr, range(0x250, 0x10000)) if c.lower() in set(_SMALL)) + "]")
# A line of such letters and of ASCII signs behind them, in two groups; of any other line, nothing.
_PLAIN_LINE = re.compile(rf"^(?:([{_SMALL}]+)([!-/:-@\[-`{{-~]*)|.*)$", re.MULTILINE)


class WordTokenizer:
    """Ids of texts by a tokenizer that never joins text across white space.

    The words of a text repeat, so each is encoded once and remembered. A word of Latin letters is
    one token group and the signs behind it another, so these are put together from the ids of the
    lower-case word, got from the tokenizer's model many at a time, and of the signs. All other
    words go through the whole tokenizer one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # The model's letters for bytes beyond ASCII: C3 and C4 to C9 lead, 80 to BF follow.
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = np.arange(256, dtype="<u4")
        for lead in range(0xC3, 0xCA):
            for follow in range(0x80, 0xC0):
                letters = "".join(x for x, _ in shown.pre_tokenize_str(bytes([lead, follow]).decode()))
                self.letters[[lead, follow]] = [ord(x) for x in letters]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {"": b""}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4") for x in found]

    def _learn(self, new: list[str]) -> None:
        rest = [w for w in new if _ODD.search(w)] if _ODD.search("".join(new)) else []
        if rest:
            new = list(set(new).difference(rest))
        found = _PLAIN_LINE.findall("\n".join(new).lower()) if new else []
        cores = dict.fromkeys([c for c, _ in found])
        cores.pop("", None)
        if cores:
            joined = " ".join(cores)
            if not joined.isascii():
                joined = self.letters[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(stops) != len(cores):
                found = [("", "")] * len(new)  # words that the model does not end as expected
            else:
                raw = ids.tobytes()
                cores = {c: raw[a:b] for c, a, b in zip(cores, [0, *stops], stops)}
        other = list({signs for _, signs in found} - self.signs.keys())
        self.signs.update(zip(other, (x.tobytes() for x in self._encode(other)), strict=True))
        known, signs_of = self.known, self.signs
        for word, (core, signs) in zip(new, found, strict=True):
            if core:
                known[word] = cores[core] + signs_of[signs]
            else:
                rest.append(word)
        known.update(zip(rest, (x.tobytes() for x in self._encode(rest)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [t.split() if not _SEPARATORS.search(t) else None for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        new = set().union(*(x for x in split if x)) - self.known.keys()
        if new:
            self._learn(list(new))
        known = self.known
        return [
            b"".join([known[w] for w in x]) if x is not None else self._encode([t])[0].tobytes()
            for x, t in zip(split, texts, strict=True)
        ]


_tokenizers: dict[str, WordTokenizer] = {}


def _pieces(path: str, capacity: int, schema: pa.Schema) -> Callable:
    @giving_back
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = _tokenizers.setdefault(path, None) or WordTokenizer(path)
        _tokenizers[path] = tokenizer
        end = np.array([END_TOKEN], dtype="<u4").tobytes()
        step = 4 * capacity
        for batch, texts in chunks(batches, "text"):
            rows: list[int] = []
            made: dict[str, list] = {"piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
            for row, ids in enumerate(tokenizer.encode([t.decode("utf-8", "replace") for t in texts])):
                ids += end
                for k in range(0, len(ids), step):
                    part = ids[k : k + step]
                    rows.append(row)
                    made["piece"].append(k // step)
                    made["start"].append(k // 4)
                    made["length"].append(len(part) // 4)
                    made["ids_crc32"].append(zlib.crc32(part))
                    made["ids"].append(np.frombuffer(part, dtype="<u4") if "ids" in schema.names else None)
            own = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(rows, type=pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [own.cast(f.type) if f.name == "doc_id" else pa.array(made[f.name], type=f.type) for f in schema],
                schema=schema,
            )

    return run


def tokenized(
    docs: DataFrame,
    path: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    ids: bool = True,
) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, and the ids if wanted."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    own = docs.select(F.col(col_name(doc_id)).alias("doc_id"), F.col(col_name(text)).alias("text"))
    fields = [
        T.StructField("doc_id", own.schema["doc_id"].dataType),
        T.StructField("piece", T.IntegerType()),
        *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")),
    ]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    schema = T.StructType(fields)
    return own.mapInArrow(_pieces(str(path), capacity, to_arrow_schema(schema)), schema)


class Slot(NamedTuple):
    """Pieces of one length with ranks from `rank` on: `use` of them in each sequence from `sequence` on."""

    length: int
    rank: int
    sequence: int
    use: int
    offset: int


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to `room`.

    Bit s of `reached` says that a sum of s is feasible. A length's copies are added in powers of
    two, so each length takes a few shifts. The states in between lead back to the lengths.
    """
    mask = (1 << (room + 1)) - 1
    reached = 1
    trail: list[tuple[int, int, int]] = []
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left > 0:
            take = min(step, left)
            trail.append((reached, length, take))
            reached |= (reached << (length * take)) & mask
            left -= take
            step *= 2
        if reached >> room & 1:
            break
    total = reached.bit_length() - 1
    used: dict[int, int] = {}
    for before, length, take in reversed(trail):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Slot]:
    """Where the pieces of every length go. `counts`: pieces by length."""
    left = {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    slots: list[Slot] = []
    sequence = 0
    while left:
        largest = max(left)
        left[largest] -= 1
        used = fullest(left, capacity - largest)
        left[largest] += 1
        used[largest] = used.get(largest, 0) + 1
        times = min(left[n] // u for n, u in used.items())
        offset = 0
        for n in sorted(used, reverse=True):
            slots.append(Slot(n, rank[n], sequence, used[n], offset))
            offset += n * used[n]
            rank[n] += used[n] * times
            left[n] -= used[n] * times
            if not left[n]:
                del left[n]
        sequence += times
    return slots


def _placed(slots: list[Slot], schema: pa.Schema) -> Callable:
    table = np.array(sorted(slots), dtype=np.int64).reshape(-1, len(Slot._fields))

    @giving_back
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            length, rank = (get(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "rank_"))
            # Slots are in order of length and rank: the last one at or before the piece is its own.
            wide = np.int64(1) << 44
            at = np.searchsorted(table[:, 0] * wide + table[:, 1], length * wide + rank, side="right") - 1
            own = table[at]
            nth = rank - own[:, 1]
            made = {"sequence_id": own[:, 2] + nth // own[:, 3], "offset": own[:, 4] + nth % own[:, 3] * length}
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[f.name]) if f.name in made else get(f.name).cast(f.type) for f in schema],
                schema=schema,
            )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = 64) -> DataFrame:
    """Pieces (a stored table) with the sequence and the place there of each.

    A length that many pieces share is ranked in buckets; `salts` buckets at least, one more for
    every million pieces.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    slots = plan(counts, capacity)
    buckets = salts + sum(counts.values()) // 1_000_000
    scattered = pieces.withColumn(
        "bucket_", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
    )
    scattered = settle(scattered)
    # Pieces of the buckets before.
    own = scattered.groupBy("length", "bucket_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy("length").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = own.select("length", "bucket_", before.alias("before_"))
    within = F.row_number().over(Window.partitionBy("length", "bucket_").orderBy("doc_id", "piece"))
    ranked = (
        scattered.withColumn("in_", within.cast("long"))
        .join(offsets, ["length", "bucket_"])
        .withColumn("rank_", F.expr("before_ + in_ - 1"))
        .select(*pieces.columns, "rank_")
    )
    schema = T.StructType(
        [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    return ranked.mapInArrow(_placed(slots, to_arrow_schema(schema)), schema)


def packed(docs: DataFrame, ids: bool = True, capacity: int = CAPACITY, **options) -> DataFrame:
    """Documents to placed pieces."""
    return pack(settle(tokenized(docs, capacity=capacity, ids=ids, **options)), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The token ids of every sequence, put together from its pieces (`ids` must be there)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", F.flatten("parts.ids").alias("ids"))
