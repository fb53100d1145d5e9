"""Which terms occur in which section of which article.

The join between texts and terms is turned into key lookups: a text's words (and word
beginnings and endings, of the lengths the dictionary asks for) are its keys, and a term
has one key that any matching text must hold. What the key alone does not prove is
checked with the term's pattern, on the few candidates only.

There are two ways, and the caller chooses. By row, the dictionary travels inside the
plan as a literal and every article is matched within its own row: no shuffle, no row
identity, nothing to skew, and it works on streams; the driver holds the dictionary. By
join, the dictionary stays a table and meets the texts' words by key. Both ways yield the
same candidate columns; everything after that is shared.

Of a term's words, the one that the fewest terms share is its key, so that a word in very
many phrases is asked for by few of them. Terms without a key (regexes, `*il*`) are tried
on every text, each as a constant of the plan behind a test for a text it requires.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from winnow.functions.once import built_once, with_once
from winnow.functions.text import NormRules, has_tags, normalize, tokens
from winnow.params import KINDS, SECTIONS, T0
from winnow.sources.staging import stored

# Field order is sort order: sorting hits puts them in block, kind, term, section order.
HIT = (
    "struct<block_ord:int,kind_ord:int,near:int,ord:bigint,pair_pos:int,sec:int,level:int,term:string,"
    "source_row:bigint,match_type:string,components:array<string>>"
)
MATCH_ENTRY = f"struct<scope:string,guards:array<string>,pattern:string,hit:{HIT}>"

_KEYS_PER_BUCKET = 4
NORM_COLUMNS = tuple(f"norm_{s}" for s in SECTIONS)


def match_entries(compiled: DataFrame) -> DataFrame:
    """(keys, entry) of every term that takes part in matching.

    Positives of the pre-screen only matter for highlighting.
    """
    kind_ord = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    hit = F.struct(
        "block_ord",
        kind_ord.alias("kind_ord"),
        (F.col("match_type") == "proximity").cast("int").alias("near"),
        "ord",
        "pair_pos",
        F.lit(None).cast("int").alias("sec"),
        "level",
        "term",
        "source_row",
        "match_type",
        "components",
    )
    return compiled.filter(~((F.col("block") == T0) & (F.col("kind") == "pos"))).select(
        "keys", F.struct("scope", "guards", "pattern", hit.alias("hit")).alias("entry")
    )


def _key_rank(key: str, shared: int) -> tuple:
    return shared, -len(key), key


def with_rarest_key(entries: DataFrame) -> DataFrame:
    """(lookup_key, entry): the key that the fewest entries share, then the longest."""
    shared = entries.select(F.explode("keys").alias("lookup_key")).groupBy("lookup_key").agg(F.count("*").alias("n"))
    rank = F.struct("n", -F.length("lookup_key"), "lookup_key")
    return (
        entries.select("entry", F.explode("keys").alias("lookup_key"))
        .join(shared, "lookup_key")
        .groupBy("entry")
        .agg(F.min_by("lookup_key", rank).alias("lookup_key"))
    )


@dataclass(frozen=True)
class Scan:
    """Entries without key, each a constant test of a text."""

    entries_json: str
    tests: tuple[tuple[tuple[str, ...], str | None], ...]
    entry_type: str

    @classmethod
    def of(cls, entries: list[dict], entry_type: str) -> Scan:
        """What a test proves need not be verified again; marking needs the pattern."""
        tests = tuple((tuple(e.get("guards") or ()), e.get("pattern")) for e in entries)
        if "hit" in entry_type:
            entries = [e | {"guards": [], "pattern": None} for e in entries]
        return cls(json.dumps(entries), tests, entry_type)

    def lookup(self, text: Column) -> Column:
        """Entries that the text passes the test of."""

        def holds(guards: tuple[str, ...], pattern: str | None) -> Column:
            parts = [F.contains(text, F.lit(g)) for g in guards]
            parts += [F.rlike(text, F.lit(pattern))] if pattern is not None else []
            return reduce(Column.__and__, parts, F.lit(True))

        known = F.from_json(F.lit(self.entries_json), f"array<{self.entry_type}>")
        passed = [F.when(holds(*t), F.lit(i)) for i, t in enumerate(self.tests)]
        if not passed:
            return F.array().cast(f"array<{self.entry_type}>")
        return F.transform(F.array_compact(F.array(*passed)), lambda i: F.get(known, i))


def text_keys(words: Column, begin_lengths: tuple[int, ...], end_lengths: tuple[int, ...]) -> Column:
    """The words plus their beginnings and endings of the given lengths."""

    def begins(n: int) -> Column:
        return F.transform(words, lambda w: F.concat(F.lit(f"{n}<"), F.left(w, F.lit(n))))

    def ends(n: int) -> Column:
        return F.transform(words, lambda w: F.concat(F.lit(f"{n}>"), F.right(w, F.lit(n))))

    parts = [words, *map(begins, begin_lengths), *map(ends, end_lengths)]
    return F.concat(*parts) if len(parts) > 1 else words


@dataclass(frozen=True)
class KeyIndex:
    """A bounded table of (lookup_key, entry) as literals."""

    keys: tuple[str, ...]
    begin_lengths: tuple[int, ...]
    end_lengths: tuple[int, ...]
    buckets_json: str
    scan: Scan
    n_buckets: int
    entry_type: str

    @classmethod
    def build(cls, entries: DataFrame, entry_type: str) -> KeyIndex:
        rows: list[Row] = entries.select("keys", F.to_json("entry").alias("entry")).collect()
        shared = Counter(k for row in rows for k in row["keys"])
        by_key: dict[str, list] = {}
        unkeyed = []
        for row in rows:
            entry = json.loads(row["entry"])
            if not row["keys"]:
                unkeyed.append(entry)
            else:
                key = min(row["keys"], key=lambda k: _key_rank(k, shared[k]))
                by_key.setdefault(key, []).append(entry)
        # Reading a map is a scan over its keys, so keys are spread over many small maps.
        n_buckets = max(1, len(by_key) // _KEYS_PER_BUCKET)
        buckets: list[dict] = [{} for _ in range(n_buckets)]
        for key, found in sorted(by_key.items()):
            buckets[zlib.crc32(key.encode()) % n_buckets][key] = found
        return cls(
            keys=tuple(sorted(by_key)),
            begin_lengths=tuple(sorted({int(k.split("<")[0]) for k in by_key if "<" in k})),
            end_lengths=tuple(sorted({int(k.split(">")[0]) for k in by_key if ">" in k})),
            buckets_json=json.dumps(buckets),
            scan=Scan.of(unkeyed, entry_type),
            n_buckets=n_buckets,
            entry_type=entry_type,
        )

    def _known_keys(self, words: str) -> Column:
        """The dictionary's keys among those of a column of words.

        The tests are written as SQL: one text for a list of thousands of keys, which Spark
        turns into a hash set.
        """

        def listed(keys: list[str]) -> str:
            return ",".join(f"'{k}'" for k in keys)  # keys are made of word characters only

        def known(length: int, mark: str, function: str) -> Column:
            head = f"{length}{mark}"
            wanted = [k.removeprefix(head) for k in self.keys if k.startswith(head)]
            return F.expr(
                f"array_distinct(transform("
                f"filter({words}, w -> {function}(w, {length}) IN ({listed(wanted)})), "
                f"w -> concat('{head}', {function}(w, {length}))))"
            )

        plain = [k for k in self.keys if "<" not in k and ">" not in k]
        parts = [F.expr(f"filter({words}, w -> w IN ({listed(plain)}))")] if plain else []
        parts += [known(n, "<", "left") for n in self.begin_lengths]
        parts += [known(n, ">", "right") for n in self.end_lengths]
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    def lookup(self, words: str, text: Column) -> Column:
        """Entries whose key occurs in a column of words, or whose test the text passes."""
        scanned = self.scan.lookup(text)
        if not self.keys:
            return scanned
        found = self._known_keys(words)
        buckets = F.from_json(
            F.lit(self.buckets_json), f"array<map<string,array<{self.entry_type}>>>"
        )
        entries = F.flatten(
            F.transform(
                found,
                lambda k: F.try_element_at(
                    F.get(buckets, (F.crc32(k.cast("binary")) % self.n_buckets).cast("int")), k
                ),
            )
        )
        return F.concat(entries, scanned) if self.scan.tests else entries


def _text(prefix: str, section: str) -> Column:
    return F.coalesce(F.col(f"{prefix}{section}"), F.lit(""))


def with_candidates(df: DataFrame, index: KeyIndex, prefix: str = "norm_") -> DataFrame:
    """Adds candidate entries per section, from the row's own words and texts."""
    return df.withColumns(_lookups(index, prefix))


@built_once
def _lookups(index: KeyIndex, prefix: str) -> dict[str, Column]:
    return {f"cand_{s}": index.lookup(f"words_{s}", _text(prefix, s)) for s in SECTIONS}


#: Bits of the filter for dictionary keys, and of one piece of it.
KEY_BITS, _PIECE = 1 << 21, 1 << 15


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BITS))


def key_filter(keyed: DataFrame) -> str:
    """One bit per hash of a lookup key, as JSON text of 64-bit numbers.

    KEY_BITS bits whatever the dictionary: from some hundred thousand keys on, more words pass
    that no term asks for, and meet no key in the join.
    """
    bit = _bit(F.col("lookup_key"))
    pieces = keyed.select((bit / _PIECE).cast("int").alias("piece"), (bit % _PIECE).alias("bit"))
    words = [0] * (KEY_BITS // 64)
    for row in pieces.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        first = row["piece"] * _PIECE // 64
        for i in range(_PIECE // 64):
            words[first + i] = int.from_bytes(row["bits"][8 * i : 8 * i + 8], "little", signed=True)
    return json.dumps(words)


def _may_be_key(bits_json: str) -> Callable[[Column], Column]:
    bits = F.from_json(F.lit(bits_json), "array<bigint>")

    def test(key: Column) -> Column:
        bit = _bit(key)
        return F.getbit(F.get(bits, F.shiftright(bit, 6).cast("int")), (bit % 64).cast("int")) == 1

    return test


@dataclass(frozen=True)
class KeyTable:
    """A dictionary of any size: a stored table of (lookup_key, entry), and what the plan knows of it."""

    keyed: DataFrame
    begin_lengths: tuple[int, ...]
    end_lengths: tuple[int, ...]
    bits_json: str
    scan: Scan
    entry_type: str

    @classmethod
    def build(cls, entries: DataFrame, entry_type: str) -> KeyTable:
        """Cleaned and compiled once: the table is written to the folder for scratch tables."""
        whole = stored(entries)
        keyed = stored(with_rarest_key(whole.filter(F.size("keys") > 0)))

        def lengths(mark: str) -> tuple[int, ...]:
            part = F.split_part("lookup_key", F.lit(mark), F.lit(1)).cast("int")
            rows = keyed.filter(F.col("lookup_key").contains(mark)).select(part).distinct().collect()
            return tuple(sorted(r[0] for r in rows))

        unkeyed = whole.filter(F.size("keys") == 0).select(F.to_json("entry").alias("entry")).collect()
        scan = Scan.of([json.loads(r["entry"]) for r in unkeyed], entry_type)
        return cls(keyed, lengths("<"), lengths(">"), key_filter(keyed), scan, entry_type)


def with_joined_candidates(
    df: DataFrame,
    table: KeyTable,
    row_key: str,
    rebuild: Callable[[DataFrame], DataFrame],
    prefix: str = "norm_",
) -> DataFrame:
    """Adds candidate entries per section by joining text keys with the entries' keys.

    `rebuild` adds the texts under `prefix` and their words to the articles `df`. `row_key`
    must identify a row, also after a recomputation (a stored key, or the file and row
    position that `sources.with_row_key` gives). Words that no entry asks for are dropped
    within their article, by a filter of fixed size, before anything is exploded. What is
    shuffled is row key, section and word, once by word if the dictionary is too large to be
    broadcast and once by row. Articles stored in buckets of their row key (`TriageEngine.store`)
    stay where they are; others move once, as they came. A word in very many articles is a
    skewed join key, which Spark splits at run time.
    """
    keyed = table.keyed
    wanted = _may_be_key(table.bits_json)

    def section_keys(section: str) -> Column:
        keys = text_keys(F.col(f"words_{section}"), table.begin_lengths, table.end_lengths)
        return F.transform(
            F.array_distinct(F.filter(keys, wanted)),
            lambda k: F.struct(F.lit(section).alias("section"), k.alias("lookup_key")),
        )

    asked = rebuild(df).select(row_key, F.inline(F.concat(*map(section_keys, SECTIONS))))
    asked = asked.join(keyed.select("lookup_key").distinct(), "lookup_key", "left_semi")
    # Grouped as words, so that entries need not move with them, and met with entries after that.
    by_row = asked.groupBy(row_key).agg(F.collect_list(F.struct("section", "lookup_key")).alias("asked"))
    found = (
        by_row.select(row_key, F.inline("asked"))
        .join(keyed, "lookup_key")
        .groupBy(row_key)
        .agg(F.collect_list(F.struct("section", "entry")).alias("found"))
    )

    def of_section(section: str) -> Column:
        mine = F.filter("found", lambda c: c["section"] == section)
        none = F.array().cast(f"array<{table.entry_type}>")
        scanned = table.scan.lookup(_text(prefix, section))
        return F.concat(F.coalesce(F.transform(mine, lambda c: c["entry"]), none), scanned)

    joined = rebuild(df.join(found, row_key, "left"))
    return joined.withColumns({f"cand_{s}": of_section(s) for s in SECTIONS}).drop("found")


def with_norm(articles: DataFrame, rules: NormRules | None) -> DataFrame:
    """Normalised text per section as `norm_<section>`; stored articles have it already."""
    if set(NORM_COLUMNS) <= set(articles.columns):
        return articles
    return articles.withColumns(_norms(rules))


@built_once
def _norms(rules: NormRules | None) -> dict[str, Column]:
    return {f"norm_{s}": normalize(F.col(s), rules) for s in SECTIONS}


def with_words(df: DataFrame, prefix: str = "norm_") -> DataFrame:
    """Distinct words per section as `words_<section>`, from the columns with the prefix."""
    return df.withColumns(_words(prefix))


@built_once
def _words(prefix: str) -> dict[str, Column]:
    return {f"words_{s}": tokens(F.col(f"{prefix}{s}")) for s in SECTIONS}


def _verified(candidates: Column, norm: Column, section: str) -> Column:
    """Candidates in scope whose guards and pattern hold for the section's text."""

    def holds(e: Column) -> Column:
        in_scope = e["scope"].isin("any", section)
        guarded = F.forall(e["guards"], lambda g: F.contains(norm, g))
        proven = F.when(e["pattern"].isNull(), F.lit(True)).otherwise(F.rlike(norm, e["pattern"]))
        return in_scope & guarded & proven

    return F.filter(candidates, holds)


@built_once
def sorted_hits() -> Column:
    """Hits of all sections from `norm_*` and `cand_*`; blank sections have none."""
    none = F.array().cast(f"array<{HIT}>")

    def of_section(sec: int, section: str) -> Column:
        norm = F.col(f"norm_{section}")
        found = _verified(F.col(f"cand_{section}"), norm, section)
        hits = F.transform(found, lambda e: e["hit"].withField("sec", F.lit(sec)))
        return F.when(norm == "", none).otherwise(hits)

    return F.array_sort(F.concat(*(of_section(i, s) for i, s in enumerate(SECTIONS))))


def _matched(candidates: DataFrame, columns: list[str]) -> DataFrame:
    found = with_once(
        candidates, {"has_tags": has_tags(F.col("manual_tags")), "hits": sorted_hits()}
    )
    return found.select(*columns, "has_tags", "hits")


def match_narrow(articles: DataFrame, index: KeyIndex, rules: NormRules | None) -> DataFrame:
    """Adds `hits` and `has_tags`, each row by itself."""
    words = with_words(with_norm(articles, rules))
    return _matched(with_candidates(words, index), articles.columns)


def match_join(
    articles: DataFrame, table: KeyTable, rules: NormRules | None, row_key: str
) -> DataFrame:
    """As `match_narrow`, for a dictionary that stays a table."""
    found = with_joined_candidates(articles, table, row_key, lambda df: with_words(with_norm(df, rules)))
    return _matched(found, [c for c in articles.columns if c not in NORM_COLUMNS])


def hit_rows(matched: DataFrame, blocks: tuple[str, ...], *keep: str) -> DataFrame:
    """One row per article, term and section."""
    names = F.array(*map(F.lit, (T0, *blocks)))
    return matched.select(*keep, F.inline("hits")).select(
        *keep,
        F.get(names, F.col("block_ord") + 1).alias("block"),
        F.get(F.array(*map(F.lit, KINDS)), F.col("kind_ord")).alias("kind"),
        "term",
        "level",
        F.get(F.array(*map(F.lit, SECTIONS)), F.col("sec")).alias("section"),
        "match_type",
        "components",
        "source_row",
        "ord",
    )
