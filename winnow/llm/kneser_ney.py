"""Quality by perplexity: an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, five at a time, one model per language. Trusted are the documents
that `labels` calls good and not toxic. Three quarters of them (by a hash of the id) are counted;
the last quarter, which the model has not seen, sets the thresholds.

Counting. Each task counts the n-grams of its share of all documents, and how many are in trusted
ones; Spark adds the counts up. So there is one row per n-gram of the corpus, with its count in
trusted text (perhaps 0).

Probabilities. Order by order, shorter n-grams first, joins of the count tables give the discounted
count, the mass that a context leaves, and the probability of the next shorter n-gram. Lower orders
count in how many different n-grams a suffix ends, as Kneser and Ney do; the three discounts of an
order come from its counts of counts.

Scoring. The finished table, n-gram to log probability, is cut into shards of a bounded number of
rows. The documents are read shard after shard and add up what they find; the sum after the last
shard is whole, and texts are never shuffled. A document's perplexity is that of its characters
and its end.

Decision. The deviation of a document is how far its log perplexity lies above the median of its
language's threshold documents, times sqrt(n / (n + 100)) for n characters, as the mean of a short
text varies more. It stays if that is no more than ten times the median absolute deviation of the
threshold documents of its language, and in any case if it is no more than 0.05: a few documents
with wrong labels do not move a median, at any number of documents, and a language whose trusted
documents are mostly copies has no limit of zero.

Defined results: null and empty texts have no perplexity and go; a null language is a language
without a name; a language without such documents has no threshold, and its documents stay.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm.common import chunks, col_name, fresh, giving_back, settle
from winnow.llm.words import U64, mix

ORDER = 5
#: Labelled ids up to this number are sent to all tasks; more are joined by a shuffle.
SENT_IDS = 1_000_000
#: Rows of the table of n-grams that the driver and a task hold at a time: some 60 MB.
SHARD_ROWS = 4_000_000
BEGIN, END = "\x02", "\x03"
#: Of so many trusted documents one sets thresholds.
FOLDS = 4
COUNTED, THRESHOLD = 1, 2
#: The deviation that is allowed, in median absolute deviations of the threshold documents, and the
#: deviation that always is.
SPREADS, ALLOWED = 10, 0.05
#: A text of this many characters has its deviation counted at 1 / sqrt(2).
STEADY = 100
_STEP = U64(0x9E3779B97F4A7C15)
_BARE = str.maketrans({BEGIN: " ", END: " "})


def _salt(lang: str) -> np.ndarray:
    return mix(np.array([zlib.crc32(lang.encode()) + 1], dtype=U64))


def gram_hashes(codes: np.ndarray, lang: str, order: int) -> np.ndarray:
    """Hashes of all windows of `order` characters."""
    n = max(0, len(codes) - order + 1)
    out = np.repeat(_salt(lang), n)
    for k in range(order):
        out = mix(out * _STEP + codes[k : k + n])
    return out


def coded(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of some texts, each with begin marks before and an end mark behind; the windows
    that end in a character or an end mark; for each text where its windows begin."""
    joined = "".join((BEGIN * (order - 1)) + (t.translate(_BARE) if BEGIN in t or END in t else t) + END for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    windows = np.flatnonzero(codes[order - 1 :] != ord(BEGIN))
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    return codes, windows, np.cumsum(sizes) - sizes


def _by_language(batch: pa.RecordBatch, lang: str) -> dict[str, list[int]]:
    found: dict[str, list[int]] = defaultdict(list)
    for i, x in enumerate(batch.column(batch.schema.get_field_index(lang)).to_pylist()):
        found[x or ""].append(i)
    return found


def _counted(order: int, schema: pa.Schema) -> Callable:
    def merged(parts: list[tuple]) -> tuple:
        hashes, grams, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        kept, first, group = np.unique(hashes, return_index=True, return_inverse=True)
        return kept, grams[first], np.bincount(group, weights=counts, minlength=len(kept)).astype(np.int64)

    def rows(found: dict[str, list[tuple]]) -> pa.RecordBatch:
        langs, grams, counts = [], [], []
        for lang, parts in found.items():
            _, own, n = merged(parts)
            text = own.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            grams += [text[i : i + order] for i in range(0, len(text), order)]
            langs += [lang] * len(n)
            counts.append(n)
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(counts)], schema=schema)

    @giving_back
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[tuple]] = defaultdict(list)
        held = 0
        for batch, texts in chunks(batches, "text", 2_000_000):
            fold = batch.column(batch.schema.get_field_index("fold")).to_pylist()
            for lang, members in _by_language(batch, "lang").items():
                own = [texts[i].decode("utf-8", "replace") for i in members if texts[i]]
                if not own:
                    continue
                codes, windows, first = coded(own, order)
                weight = np.repeat([int(fold[i] == COUNTED) for i in members if texts[i]], np.diff(np.r_[first, len(windows)]))
                hashes = gram_hashes(codes, lang, order)[windows]
                kept, at, group = np.unique(hashes, return_index=True, return_inverse=True)
                counts = np.bincount(group, weights=weight, minlength=len(kept))
                grams = codes[windows[at][:, None] + np.arange(order)]
                found[lang].append((kept, grams, counts))
                held += len(kept)
            if held > 1_500_000:
                found = defaultdict(list, {k: [merged(v)] for k, v in found.items()})
                held = sum(len(v[0][0]) for v in found.values())
                if held > 750_000:
                    yield rows(found)
                    found, held = defaultdict(list), 0
        if found:
            yield rows(found)

    return run


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram and n (its count in trusted text) of all n-grams. docs: text, lang, fold."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string("lang string, gram string, n long")
    parts = docs.mapInArrow(_counted(order, to_arrow_schema(schema)), schema)
    return settle(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def _discounts(counts: DataFrame) -> DataFrame:
    """The three discounts of an order, per language."""
    of = [F.count(F.when(F.col("n") == k, 1)).cast("double").alias(f"t{k}") for k in (1, 2, 3, 4)]
    types = counts.filter("n > 0").groupBy("lang").agg(*of)
    y = "(t1 / nullif(t1 + 2 * t2, 0))"
    # Counts of counts may be missing in small corpora. A discount is no more than its count, and
    # leaves some mass for what was not seen.
    bounded = [
        f"least(greatest(coalesce({k} - {k + 1} * {y} * t{k + 1} / nullif(t{k}, 0), {k} * 0.5D), 0.1D), {k}D) AS d{k}"
        for k in (1, 2, 3)
    ]
    return types.selectExpr("lang", *bounded)


def log_probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram and log probability of the last character after the others."""
    tables = [counts]
    for _ in range(order - 1):  # lower orders: in how many trusted n-grams a suffix ends
        longer = tables[0]
        ends = longer.groupBy("lang", F.expr("substring(gram, 2)").alias("gram"))
        tables.insert(0, settle(ends.agg(F.sum((F.col("n") > 0).cast("long")).alias("n"))))
    sizes = settle(tables[0].groupBy("lang").agg((F.count("*") + 1).alias("letters")))
    few = sizes.count() <= 10_000
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    lower = None
    for table in tables:
        split = table.withColumn("context", F.expr("substring(gram, 1, length(gram) - 1)"))
        n = F.col("n")
        known = split.filter("n > 0").groupBy("lang", "context").agg(
            F.sum("n").alias("total"),
            *(F.count(F.when(c, 1)).alias(f"m{k}") for k, c in ((1, n == 1), (2, n == 2), (3, n > 2))),
        )
        known = settle(known)
        rows = split.join(known, ["lang", "context"], "left")
        rows = rows.join(small(settle(_discounts(table))), "lang", "left")
        if lower is None:
            rows = rows.join(small(sizes), "lang").withColumn("less", F.expr("1D / letters"))
        else:
            shorter = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("less"))
            rows = rows.withColumn("suffix", F.expr("substring(gram, 2)")).join(shorter, ["lang", "suffix"])
        own = "CASE WHEN n = 0 THEN 0D WHEN n = 1 THEN n - d1 WHEN n = 2 THEN n - d2 ELSE n - d3 END"
        p = f"CASE WHEN total IS NULL THEN less ELSE ({own} + (d1 * m1 + d2 * m2 + d3 * m3) * less) / total END"
        lower = settle(rows.select("lang", "gram", F.expr(p).alias("p")))
    return lower.select("lang", "gram", F.log("p").alias("logp"))


class Lookup:
    """Values by hash, found by the hash's first bits."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.keys, self.values = hashes[order], values[order].astype(np.float32)
        self.bits = max(1, int(len(hashes)).bit_length())
        heads = np.arange((1 << self.bits) + 1, dtype=np.float64) * 2.0 ** (64 - self.bits)
        self.first = np.searchsorted(self.keys, heads[:-1].astype(U64)).astype(np.int32)
        self.first = np.r_[self.first, np.int32(len(self.keys))]

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """The values; 0 for hashes that are not there."""
        out = np.zeros(len(hashes))
        head = (hashes >> U64(64 - self.bits)).astype(np.int64)
        at, end = self.first[head], self.first[head + 1]
        live = np.flatnonzero(at < end)
        at = at[live]
        while len(live):
            hit = self.keys[at] == hashes[live]
            out[live[hit]] = self.values[at[hit]]
            more = ~hit
            live, at = live[more], at[more] + 1
            more = at < end[live]
            live, at = live[more], at[more]
        return out


def _scored(lookup, text: str, lang: str, sums: str, size: str, order: int, schema: pa.Schema) -> Callable:
    @giving_back
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lookup.value
        for batch, texts in chunks(batches, text, 2_000_000):
            total = batch.column(batch.schema.get_field_index(sums)).to_numpy().copy()
            n = np.zeros(len(texts), dtype=np.int64)
            for name, members in _by_language(batch, lang).items():
                members = [i for i in members if texts[i]]
                if not members:
                    continue
                codes, windows, first = coded([texts[i].decode("utf-8", "replace") for i in members], order)
                logp = table.get(gram_hashes(codes, name, order)[windows])
                total[members] += np.add.reduceat(logp, first)
                n[members] = np.diff(np.r_[first, len(windows)])
            made = {sums: pa.array(total), size: pa.array(n)}
            yield pa.RecordBatch.from_arrays(
                [
                    (made[f.name] if f.name in made else batch.column(batch.schema.get_field_index(f.name))).cast(f.type)
                    for f in schema
                ],
                schema=schema,
            )

    return run


def _hashed(order: int, schema: pa.Schema) -> Callable:
    @giving_back
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(batch.schema.get_field_index("gram")).to_pylist()
            hashes = np.zeros(len(grams), dtype=U64)
            for lang, members in _by_language(batch, "lang").items():
                text = "".join([grams[i] for i in members])
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
                hashes[members] = gram_hashes(codes, lang, order)[::order]
            logp = batch.column(batch.schema.get_field_index("logp"))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), logp.cast(pa.float32())], schema=schema)

    return run


def _shard(table: DataFrame, order: int) -> Lookup:
    """A part of the table, hashed by the tasks: twelve bytes a row come to the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string("hash long, logp float")
    rows = table.mapInArrow(_hashed(order, to_arrow_schema(schema)), schema).toArrow()
    hashes, values = (rows.column(n).to_numpy() for n in ("hash", "logp"))
    return Lookup(hashes.view(U64), values)


def with_folds(docs: DataFrame, labels: DataFrame, doc_id: str, name: str) -> DataFrame:
    """The documents with their fold: COUNTED or THRESHOLD if a label calls them good and none bad
    or toxic, else 0."""
    good = labels.groupBy("doc_id").agg(F.min(F.expr("quality = 1 AND NOT coalesce(toxic = 1, false)")).alias("good"))
    good = settle(good.filter("good").select("doc_id"))
    few = good.count() <= SENT_IDS
    key = fresh(docs, "labelled_")
    ids = good.select(F.col("doc_id").alias(key))
    joined = docs.join(F.broadcast(ids) if few else ids, F.col(col_name(doc_id)) == F.col(key), "left")
    fold = F.when(F.pmod(F.xxhash64(key), F.lit(FOLDS)) == 0, THRESHOLD).otherwise(COUNTED)
    return joined.withColumn(name, F.when(F.col(key).isNotNull(), fold).otherwise(0)).drop(key)


def scored(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    order: int = ORDER,
    shard_rows: int = SHARD_ROWS,
    names: tuple[str, str, str] = ("fold", "sum_logp", "n_tokens"),
) -> DataFrame:
    """The documents with three columns more: fold, summed log probability, scored characters."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    fold, sums, size = names
    marked = with_folds(docs, labels, doc_id, fold)
    plain = marked.select(
        F.col(col_name(text)).alias("text"), F.col(col_name(lang)).cast("string").alias("lang"), F.col(fold).alias("fold")
    )
    table = settle(log_probabilities(gram_counts(plain, order), order))
    shards = -(-table.count() // shard_rows) or 1
    out = marked.withColumns({sums: F.lit(0.0), size: F.lit(0).cast("long")})
    for k in range(shards):
        own = table.filter(F.pmod(F.xxhash64("lang", "gram"), F.lit(shards)) == k) if shards > 1 else table
        lookup = spark.sparkContext.broadcast(_shard(own, order))  # shard_rows rows, about
        run = _scored(lookup, text, lang, sums, size, order, to_arrow_schema(out.schema))
        out = out.mapInArrow(run, out.schema)
    return out


def _judged(
    found: DataFrame, lang: str, names: tuple[str, str, str], spreads: float = SPREADS, steady: int = STEADY
) -> tuple[DataFrame, str]:
    """The scored documents with a column `range_` or the like: deviation, and limit of the language."""
    fold, sums, size = (col_name(n) for n in names)
    out = fresh(found, "range_")
    key = F.coalesce(F.col(col_name(lang)).cast("string"), F.lit(""))
    score = F.when(F.expr(f"{size} > 0"), F.expr(f"-{sums} / {size}"))

    def medians(value) -> DataFrame:
        own = found_so_far.filter(f"{fold} = {THRESHOLD}").groupBy(key.alias("lang_"))
        own = settle(own.agg(F.percentile_approx(value, 0.5, 100_000).alias("value_")))
        return F.broadcast(own) if own.count() <= 10_000 else own

    found_so_far = found
    middle = medians(score).select(F.col("lang_"), F.col("value_").alias("middle_"))
    away = (score - F.col("middle_")) * F.sqrt(F.expr(f"{size} / ({size} + {steady})"))
    found_so_far = found.join(middle, key == F.col("lang_"), "left").withColumn(out, away)
    found_so_far = found_so_far.select(*map(col_name, found.columns), out)
    judged = found_so_far.join(medians(F.abs(F.col(out))), key == F.col("lang_"), "left")
    limit = F.when(F.col("value_").isNotNull(), F.greatest(F.lit(ALLOWED), F.lit(spreads) * F.col("value_")))
    return judged.withColumn(out, F.struct(F.col(out).alias("deviation"), limit.alias("limit"))), out


def _stays(out: str, size: str) -> str:
    return f"{col_name(size)} > 0 AND coalesce({col_name(out)}.deviation <= {col_name(out)}.limit, true)"


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: perplexity, the bounds of its language, and whether it stays."""
    names = ("fold", "sum_logp", "n_tokens")
    own = docs.select("doc_id", "text", "lang")
    found = settle(scored(own, labels, names=names, **options).drop("text"))
    judged, out = _judged(found, "lang", names)
    return judged.select(
        "doc_id",
        "lang",
        "n_tokens",
        F.expr("CASE WHEN n_tokens > 0 THEN exp(-sum_logp / n_tokens) END").alias("perplexity"),
        f"{out}.deviation",
        f"{out}.limit",
        F.expr(_stays(out, "n_tokens")).alias("kept"),
    )


def good_documents(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options
) -> DataFrame:
    """The rows that stay, with their own columns."""
    names = tuple(fresh(docs, n) for n in ("fold_", "sum_logp_", "n_tokens_"))
    found = settle(scored(docs, labels, doc_id, text, lang, names=names, **options))
    judged, out = _judged(found, lang, names)
    return judged.filter(_stays(out, names[2])).select(*map(col_name, docs.columns))
