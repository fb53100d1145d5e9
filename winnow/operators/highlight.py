"""Matched text marked in the original sections, and hits packed into text.

Every block's terms are marked, whether or not the block was evaluated. Spans of all
patterns are merged where they overlap or touch. Matches of length zero are not marked.

Terms that a lookup key proves mark whole words, so one pass over a text's words serves
all of them. Only texts that several patterns match need spans: one alone is marked in place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.once import built_once, with_once
from winnow.functions.text import WORD, tokens
from winnow.params import SECTIONS

MARK = "***"
HIGHLIGHT_ENTRY = "struct<scope:string,pattern:string,how:string,text:string>"


def highlight_entries(compiled: DataFrame) -> DataFrame:
    """(keys, entry) of everything to mark.

    An entry without pattern marks the words equal to, beginning or ending with `text`.
    """
    key = F.when(F.col("pattern").isNull(), F.get("keys", F.lit(0))).otherwise("")
    how = F.regexp_extract(key, r"^\d+([<>])", 1)
    text = F.regexp_replace(key, r"^\d+[<>]", "")
    return (
        compiled.select("scope", F.inline("highlight"))
        .select("keys", F.struct("scope", "pattern", how.alias("how"), text.alias("text")).alias("entry"))
        .distinct()
    )


def with_original_words(articles: DataFrame) -> DataFrame:
    """Distinct words of the sections as written, lower-cased, as `words_<section>`."""
    return articles.withColumns(
        {f"words_{s}": tokens(F.lower(F.coalesce(F.col(s), F.lit("")))) for s in SECTIONS}
    )


def _word_pattern(entries: Column) -> Column:
    """One pattern for all entries that mark whole words; null if there are none."""

    def word(e: Column) -> Column:
        more = F.lit(f"{WORD}*")
        return F.when(e["how"] == "<", F.concat(e["text"], more)).when(
            e["how"] == ">", F.concat(more, e["text"])
        ).otherwise(e["text"])

    proven = F.filter(entries, lambda e: e["pattern"].isNull())
    any_of = F.array_join(F.array_distinct(F.transform(proven, word)), "|")
    whole = F.concat(F.lit(f"(?iu)(?<!{WORD})(?:"), any_of, F.lit(f")(?!{WORD})"))
    return F.when(any_of != "", whole)


# Two code points that are never characters stand around a match while a text is cut up.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"
_BLOCK = 128


def _before(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each value, what `combine` makes of 0 and all values before it; one more at the end.

    An array that grows value by value is copied each time, so values are taken in blocks:
    only arrays of a block's length grow.
    """

    def spread(b: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1)), F.lit(_BLOCK))
        blocks = F.transform(starts, lambda k: F.slice(b, k, _BLOCK))
        totals = F.transform(blocks, lambda v: F.aggregate(v, F.lit(0), combine))

        def prefixes(v: Column, first: Column) -> Column:
            start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("all"))
            return F.aggregate(
                v,
                start,
                lambda acc, x: F.struct(
                    combine(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")
                ),
                lambda acc: acc["all"],
            )

        firsts = F.array(F.struct(prefixes(totals, F.lit(0)).alias("firsts"), totals.alias("totals")))
        whole = F.aggregate(totals, F.lit(0), combine)
        inner = F.flatten(
            F.transform(
                firsts, lambda f: F.flatten(F.transform(blocks, lambda v, i: prefixes(v, F.get(f["firsts"], i))))
            )
        )
        return F.concat(inner, F.array(whole))

    return F.flatten(F.transform(F.array(values), spread))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _spans(pieces: Column) -> Column:
    """Begin and end of the pieces, from (gap before, piece)."""

    def placed(p: Column) -> Column:
        lengths = F.transform(p, lambda x: F.length(x["gap"]) + F.length(x["piece"]))
        both = F.array(F.struct(p.alias("pieces"), _before(lengths, _add).alias("at")))

        def span(b: Column) -> Column:
            return F.transform(
                b["pieces"],
                lambda x, i: F.struct(
                    (F.get(b["at"], i) + F.length(x["gap"])).alias("begin"),
                    F.get(b["at"], i + 1).alias("stop"),
                ),
            )

        return F.flatten(F.transform(both, span))

    return F.flatten(F.transform(F.array(pieces), placed))


def _pieces(text: Column, pattern: Column) -> Column:
    """Matches of some length, those that touch as one, each with the text before it, and a last gap
    with no piece."""
    marked = F.regexp_replace(text, pattern, F.lit(f"{_OPEN}$0{_CLOSE}"))
    for none in (_OPEN + _CLOSE, _CLOSE + _OPEN):
        marked = F.replace(marked, F.lit(none), F.lit(""))
    parts = F.split(marked, f"[{_OPEN}{_CLOSE}]", -1)

    def pairs(p: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(p) - 1, F.lit(2)),
            lambda i: F.struct(F.get(p, i).alias("gap"), F.get(p, i + 1).alias("piece")),
        )

    return F.flatten(F.transform(F.array(parts), pairs))


def _found(pieces: Column) -> Column:
    return F.filter(pieces, lambda p: p["piece"].isNotNull())


def _merged(spans: Column) -> Column:
    """Sorted spans, joined where one begins before or where an earlier one ends."""

    def joined(sorted_: Column) -> Column:
        ends = _before(F.transform(sorted_, lambda x: x["stop"]), _larger)
        both = F.array(F.struct(sorted_.alias("spans"), ends.alias("ends")))

        def firsts(b: Column) -> Column:
            """Spans that begin behind all before them, each with the furthest end so far."""
            reached = F.transform(
                b["spans"], lambda x, i: F.struct(x["begin"].alias("begin"), F.get(b["ends"], i).alias("end"), i.alias("i"))
            )
            kept = F.filter(reached, lambda x: (x["i"] == 0) | (x["begin"] > x["end"]))
            return F.transform(
                F.array(F.struct(kept.alias("kept"), F.element_at(b["ends"], -1).alias("last"))),
                lambda k: F.transform(
                    k["kept"],
                    lambda x, i: F.struct(
                        x["begin"].alias("begin"), F.coalesce(F.get(k["kept"], i + 1)["end"], k["last"]).alias("stop")
                    ),
                ),
            )

        return F.flatten(F.flatten(F.transform(both, firsts)))

    return F.flatten(F.transform(F.array(F.array_sort(spans)), joined))


def _mark(piece: Column) -> Column:
    return F.concat(F.lit(MARK), F.upper(piece), F.lit(MARK))


_CHUNK = 512


def _rebuilt_from_spans(text: Column, merged: Column) -> Column:
    """The text with its spans marked.

    Finding a position in a string means counting characters from its start, so a long
    text is first cut into chunks of equal length, and every slice comes from the chunks
    it touches.
    """
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    both = F.array(F.struct(chunks.alias("chunks"), merged.alias("spans")))

    def chunk_of(at: Column) -> Column:
        return (at / _CHUNK).cast("int")

    def build(b: Column) -> Column:
        def cut(begin: Column, stop: Column) -> Column:
            n = chunk_of(stop - 1) - chunk_of(begin) + 1
            touched = F.array_join(F.slice(b["chunks"], chunk_of(begin) + 1, n), "")
            return F.substring(touched, begin % _CHUNK + 1, stop - begin)

        def piece(m: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(b["spans"], i - 1)["stop"])
            return F.concat(cut(before, m["begin"]), _mark(cut(m["begin"], m["stop"])))

        last = F.element_at(b["spans"], -1)["stop"]
        return F.concat(
            F.array_join(F.transform(b["spans"], piece), ""), cut(last, F.length(text))
        )

    return F.get(F.transform(both, build), F.lit(0))


def _text_of(section: str) -> Column:
    return F.coalesce(F.col(section), F.lit(""))


def _in_scope(section: str) -> Column:
    return F.filter(F.col(f"cand_{section}"), lambda e: e["scope"].isin("any", section))


def _other_patterns(section: str) -> Column:
    """The patterns that do more than mark whole words."""
    found = F.col(f"cand_{section}")
    return F.array_distinct(F.filter(found, lambda e: e["pattern"].isNotNull())["pattern"])


def _only_pattern(section: str) -> Column:
    """The pattern that is the only one of its text: its matches are marked in place."""
    word, others = F.col(f"pattern_{section}"), F.col(f"patterns_{section}")
    return F.coalesce(F.when(F.size(others) == 0, word), F.when(word.isNull() & (F.size(others) == 1), F.get(others, F.lit(0))))


def _pattern_spans(section: str) -> Column:
    """Spans of all patterns, where there are several."""
    text, word = _text_of(section), F.col(f"pattern_{section}")
    patterns = F.concat(F.col(f"patterns_{section}"), F.filter(F.array(word), lambda p: p.isNotNull()))
    several = F.when(F.size(patterns) > 1, patterns).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(several, lambda p: _spans(_found(_pieces(text, p)))))


def _only_pieces(section: str) -> Column:
    pattern = _only_pattern(section)
    return F.when(pattern.isNotNull(), _pieces(_text_of(section), pattern))


def _marked(section: str) -> Column:
    text, pieces, spans = _text_of(section), F.col(f"pieces_{section}"), F.col(f"spans_{section}")
    in_place = F.array_join(
        F.transform(pieces, lambda p: F.concat(p["gap"], F.coalesce(_mark(p["piece"]), F.lit("")))), ""
    )
    return (
        F.when(F.size(spans) > 0, _rebuilt_from_spans(text, _merged(spans)))
        .when(pieces.isNull(), text)
        .otherwise(in_place)
    )


@built_once
def _marking_steps() -> list[dict[str, Column]]:
    """Candidates in scope, one pattern for whole words, where things match, marked text."""
    names = ("Title_Highlighted", "Abstract_Highlighted", "Tags_Highlighted")
    return [
        {f"cand_{s}": _in_scope(s) for s in SECTIONS},
        {f"pattern_{s}": _word_pattern(F.col(f"cand_{s}")) for s in SECTIONS}
        | {f"patterns_{s}": _other_patterns(s) for s in SECTIONS},
        {f"spans_{s}": _pattern_spans(s) for s in SECTIONS}
        | {f"pieces_{s}": _only_pieces(s) for s in SECTIONS},
        {name: _marked(s) for name, s in zip(names, SECTIONS)},
    ]


def marked_sections(candidates: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` plus `Title_Highlighted`, `Abstract_Highlighted` and `Tags_Highlighted`."""
    scoped, patterns, places, marked = _marking_steps()
    step = with_once(candidates, scoped).withColumns(patterns)
    return with_once(with_once(step, places), marked).select(*columns, *marked)


# -- packing ------------------------------------------------------------------------------


def _or_none(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def json_text(text: Column) -> Column:
    """The text as a JSON string literal."""
    quoted = F.to_json(F.struct(text.alias("t")))
    return F.substring(quoted, 6, F.length(quoted) - 6)


def pack_hits(pos: Column) -> Column:
    """Positive hits by section, then term: `term="x" sec=title L=1 row=0 type=exact | ...`."""

    def item(h: Column, section: str) -> Column:
        parts = F.when(
            F.size(h["components"]) > 0,
            F.concat(F.lit(" comps="), F.array_join(h["components"], "+")),
        ).otherwise("")
        return F.concat(
            F.lit("term="), json_text(h["term"]), F.lit(f" sec={section} L="), _or_none(h["level"]),
            F.lit(" row="), _or_none(h["source_row"]), F.lit(" type="), h["match_type"], parts,
        )

    def items(sec: int) -> Column:
        mine = F.filter(pos, lambda h: h["sec"] == sec)
        return F.transform(mine, lambda h: item(h, SECTIONS[sec]))

    return F.array_join(F.concat(*map(items, range(len(SECTIONS)))), " | ")


def pack_exclusions(hits: Column) -> Column:
    """Exclusion or warning hits as `term:section:row|...`."""
    names = F.array(*map(F.lit, SECTIONS))
    return F.array_join(
        F.transform(
            hits,
            lambda h: F.concat(
                h["term"], F.lit(":"), F.get(names, h["sec"]), F.lit(":"), _or_none(h["source_row"])
            ),
        ),
        "|",
    )
