"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded texts.

Folding: lower case, letters that look like Latin ones become these (Cyrillic, Greek, full width),
invisible characters go, digits and signs that stand for letters inside a word become these
(`1d10t`, `l0$er`); all else that is no letter or digit is a word gap.

The lexicon is learned: whole words and beginnings of words (stems, 3 to 12 characters) that are
at least e^2.5 times as frequent among toxic as among other training texts. A stem that one
longer entry explains goes, as does an entry below a kept stem. Phrases of a hit and a neighbouring
word that clean texts hold as often are exceptions, as are those given; a hit inside one does not
count. A text's hits (up to three of an entry) are summed by weight and normalised by its length;
a logistic curve over five such numbers, fitted to the training texts, is the score.

The fit sees at most TRAIN_ROWS labelled ids of each class, by hash of the id, and of texts that
share their least hash of five words (near copies) one. All else covers every row: scoring is one
pass with the automaton in each task, without a shuffle. The driver holds the lexicon (LEXICON
entries at most) and the training texts' five numbers.

Defined results: null and empty texts are scored as texts without words; several labels of one id
are toxic if one is; labels without an id or a value are not used; a null id is never held out and
never learned from; repeated rows get the same score each; ties among training ids go by id; texts
of any length are matched whole, and bytes that are no UTF-8 are word gaps; without toxic training
texts (or with empty tables) every score is 0. Other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import chunks, settle

#: Labelled ids of each class that the fit sees.
TRAIN_ROWS = 20_000
#: Candidate entries looked at, and learned exceptions: the most frequent ones.
LEXICON = 20_000
#: Training texts of a class that must hold an entry or an exception.
SUPPORT, SHARE = 4, 0.004
LEAST_WEIGHT = 2.5
STEM = (3, 12)
THRESHOLD = 0.3

# Letters that look like Latin ones, in Cyrillic and Greek.
_ALIKE = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "α": "a", "β": "b",
    "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ı": "i",
}
# Digits and signs that stand for letters.
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
# Usual phrases in which a lexicon word is harmless.
EXCEPTIONS = (
    "class clown", "clown fish", "dumb luck", "idiot proof", "kill switch", "pond scum", "stupid question",
    "trash bin", "trash can", "trash collection", "white trash bag",
)

_WIDE = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
_FOLD = {ord(k): v.lower() for k, v in {**_WIDE, **_ALIKE}.items()}
_INVISIBLE = "­​‌‍⁠﻿"
_FOLD |= dict.fromkeys(map(ord, _INVISIBLE))
_NEEDS_FOLD = re.compile("[" + "".join(map(chr, _FOLD)) + "]")
_SIGNS = re.compile(r"(?<![\W_])[013457@$!]+(?=[^\W\d_])|(?<!\w)[013457@$]+(?=[^\W\d_])")
_GAP = re.compile(r"[\W_]+")
_AS_LETTERS = {ord(k): v for k, v in _STANDS_FOR.items()}


def fold(text: bytes) -> str:
    """The folded words, one space before, between and after them."""
    plain = text.decode("utf-8", "replace").lower()
    if not plain.isascii() and _NEEDS_FOLD.search(plain):
        plain = plain.translate(_FOLD)
    plain = _SIGNS.sub(lambda m: m[0].translate(_AS_LETTERS), plain)
    words = _GAP.sub(" ", plain).strip(" ")
    return f" {words} " if words else " "


@dataclass(frozen=True)
class Model:
    """Entries are ` stem` or ` word `; `scale` and `shift` bring the numbers to one size."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    shift: tuple[float, ...] = (0.0,) * 5
    scale: tuple[float, ...] = (1.0,) * 5
    slopes: tuple[float, ...] = (0.0,) * 6
    fitted: bool = False

    def curve(self, numbers: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(numbers))
        steep = (numbers - np.array(self.shift)) / np.array(self.scale) @ np.array(self.slopes[1:]) + self.slopes[0]
        return 1 / (1 + np.exp(-np.clip(steep, -500, 500)))


class Matcher:
    """The automaton of a model's entries and exceptions."""

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = ()):
        self.automaton = ahocorasick.Automaton()
        for entry in weights:
            self.automaton.add_word(entry, (entry, False))
        for phrase in exceptions:
            folded = fold(phrase.encode())
            if len(folded) > 1 and folded not in weights:
                self.automaton.add_word(folded, (folded, True))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()
        self.weights = weights

    def hits(self, folded: str) -> list[tuple[int, str]]:
        """End and entry of every hit outside exceptions."""
        if self.empty:
            return []
        found = list(self.automaton.iter(folded))
        free = [(end, end - len(e) + 2, e) for end, (e, harmless) in found if harmless]
        if not free:
            return [(end, e) for end, (e, _) in found]
        inside = np.zeros(len(folded) + 2, np.int64)
        for end, start, _ in free:
            inside[start] += 1
            inside[end] -= 1
        inside = np.cumsum(inside) > 0
        return [(end, e) for end, (e, harmless) in found if not harmless and not inside[end - len(e) + 2]]

    def numbers(self, folded: str) -> tuple[list[float], Counter]:
        counts = Counter(e for _, e in self.hits(folded))
        total = sum(self.weights[e] * min(n, 3) for e, n in counts.items())
        n = folded.count(" ")
        most = max((self.weights[e] for e in counts), default=0.0)
        return [math.log1p(total), total / math.sqrt(n), most, float(len(counts)), math.log(n)], counts


def _sketch(folded: str) -> int:
    words = folded.split()
    some = (" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))
    return min(zlib.crc32(s.encode()) for s in some)


def _entries(folded: str) -> set[str]:
    found = set()
    for word in set(folded.split()):
        found.add(f" {word} ")
        found.update(" " + word[:k] for k in range(STEM[0], min(len(word), STEM[1]) + 1))
    return found


def _per_text(of: Callable[[str], object], kind: pa.DataType) -> Callable:
    """A column `value` made of each folded text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            made = pa.array([of(fold(t)) for t in texts], kind)
            yield batch.append_column("value", made)

    return run


def _tallies(of: Callable[[str], Iterable[str]]) -> Callable:
    """key, toxic, n: how many texts have each key, summed up for some texts at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            counts = {0: Counter(), 1: Counter()}
            for toxic, text in zip(batch.column("toxic").to_pylist(), texts, strict=True):
                counts[toxic].update(of(fold(text)))
            for toxic, some in counts.items():
                n = len(some)
                columns = [list(some), [toxic] * n, list(some.values())]
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64()), strict=True)],
                    names=["key", "toxic", "n"],
                )

    return run


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text and toxic (0, 1) of sampled labelled documents, of near copies one."""
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    marked = marked.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    marked = marked.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [marked.filter(F.col("toxic") == c).orderBy(*by_hash).limit(rows) for c in (0, 1)]
    some = settle(some[0].unionByName(some[1]))  # at most 2 * rows ids: small enough to broadcast
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")
    found = found.filter(F.col("text") != "")
    found = found.mapInArrow(_per_text(_sketch, pa.int64()), _schema(found, "value long"))
    first = Window.partitionBy("value", "toxic").orderBy("doc_id", "text")
    return settle(found.withColumn("n", F.row_number().over(first)).filter("n = 1").select("text", "toxic"))


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *more])


def _lexicon(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Entries by weight: log of how much more frequent they are in toxic texts."""
    weight = {
        e: math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)) for e, (t, c) in counts.items()
    }
    longer = Counter()
    for entry, (t, _) in counts.items():
        longer[entry[:-1]] = max(longer[entry[:-1]], t)
    good = {
        e for e in counts
        if weight[e] >= LEAST_WEIGHT and (e.endswith(" ") or longer[e] < 0.95 * counts[e][0])
    }
    below = lambda e: any(e[:k] in good for k in range(STEM[0] + 1, len(e)))
    return {e: weight[e] for e in sorted(good) if not below(e)}


def _around(matcher: Matcher) -> Callable[[str], set[str]]:
    """Phrases of a hit's word and the word before or after it."""

    def of(folded: str) -> set[str]:
        found = set()
        for end, entry in matcher.hits(folded):
            start = end - len(entry) + 1
            stop = folded.index(" ", start + 1)
            before, after = folded.rfind(" ", 0, start), folded.find(" ", stop + 1)
            if before >= 0:
                found.add(folded[before : stop + 1].strip())
            if after > 0:
                found.add(folded[start : after + 1].strip())
        return found

    return of


def _logistic(numbers: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shift, scale and slopes by Newton's method, a small ridge keeps them finite."""
    shift, scale = numbers.mean(axis=0), numbers.std(axis=0)
    scale[scale == 0] = 1.0
    x = np.column_stack([np.ones(len(numbers)), (numbers - shift) / scale])
    slopes = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ slopes, -500, 500)))
        pull = x.T @ (toxic - p) - 0.01 * slopes
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(x.shape[1])
        slopes = slopes + np.linalg.solve(bend, pull)
    return shift, scale, slopes


def train(
    docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, exceptions: Iterable[str] = EXCEPTIONS
) -> Model:
    """A model of labelled documents whose id's checksum is not held out."""
    train_on = training_rows(docs, labels, rows)
    sizes = {r.toxic: r.n for r in train_on.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return Model()
    tallied = "key string, toxic int, n long"
    most = train_on.filter("toxic = 1").mapInArrow(_tallies(_entries), tallied).groupBy("key")
    most = most.agg(F.sum("n").alias("n")).filter(F.col("n") >= max(SUPPORT, SHARE * toxic))
    in_toxic = {r.key: r.n for r in most.orderBy(F.desc("n"), "key").limit(LEXICON).collect()}
    every = Matcher(dict.fromkeys(in_toxic, 0.0))
    seen = train_on.filter("toxic = 0").mapInArrow(_tallies(lambda t: {e for _, e in every.hits(t)}), tallied)
    in_clean = {r.key: r.n for r in seen.groupBy("key").agg(F.sum("n").alias("n")).collect()}
    weights = _lexicon({e: (n, in_clean.get(e, 0)) for e, n in in_toxic.items()}, toxic, clean)

    around = train_on.mapInArrow(_tallies(_around(Matcher(weights))), tallied).groupBy("key")
    of = lambda c: F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0))
    harmless = (F.col("c") >= SUPPORT) & (F.col("c") * toxic >= F.col("t") * clean)
    around = around.agg(of(0).alias("c"), of(1).alias("t")).filter(harmless)
    learned = [r.key for r in around.orderBy(F.desc("c"), "key").limit(LEXICON).collect()]
    phrases = tuple(sorted({*exceptions, *learned}))

    matcher = Matcher(weights, phrases)
    kind = pa.list_(pa.float64())
    fit = train_on.mapInArrow(
        _per_text(lambda t: matcher.numbers(t)[0], kind), "text string, toxic int, value array<double>"
    )
    fit = fit.select("toxic", "value").toPandas()  # TRAIN_ROWS of each class at most
    shift, scale, slopes = _logistic(np.array(fit["value"].tolist()), fit["toxic"].to_numpy())
    return Model(weights, phrases, tuple(shift), tuple(scale), tuple(slopes), True)


def _scored(model: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Model = model.value
        matcher = Matcher(known.weights, known.exceptions)
        for batch, texts in chunks(batches, "text"):
            found = [matcher.numbers(fold(t)) for t in texts]
            scores = known.curve(np.array([numbers for numbers, _ in found]))
            terms = pa.array([sorted(e.strip() for e in counts) for _, counts in found], pa.list_(pa.string()))
            yield pa.record_batch([batch.column(0), pa.array(scores), terms], names=["doc_id", "score", "terms"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and the lexicon entries found, for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scored(sent), f"doc_id {dict(rows.dtypes)['doc_id']}, score double, terms array<string>")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; and the number of lexicon entries found."""
    found = score(docs, train(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return found.select(
        "doc_id",
        held.alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("terms").cast("long").alias("n_terms"),
    )
