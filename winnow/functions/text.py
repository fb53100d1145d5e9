"""Text normalisation as Column expressions.

Word characters and whitespace are spelled out as explicit classes, so that the
JVM regex engine agrees with the rules on accents, NBSP and the like.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
WORD_RUN = r"[\p{L}\p{N}_]+"

# Unicode whitespace: separators and the control characters that count as space.
_WS_CHARS = r"\p{Z}\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85"
WS = f"[{_WS_CHARS}]"
# The same characters, one by one.
WS_EACH = "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c)[0] == "Z" or c in "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85")

# Texts that mean "no tags given".
NO_TAG_TEXTS = ("", "nan", "none", "null")


@dataclass(frozen=True)
class NormRules:
    """Normalisation rules: lower-cased key -> lower-cased target, per rule type."""

    abbreviations: dict[str, str] = field(default_factory=dict)
    compound_variants: dict[str, str] = field(default_factory=dict)
    symbol_replacements: dict[str, str] = field(default_factory=dict)

    def __hash__(self) -> int:
        return hash(repr(self))

    @classmethod
    def from_dict(cls, rules: dict) -> NormRules | None:
        """Rules written in a configuration, if they are switched on there."""
        if not rules.get("enabled", False):
            return None
        kinds = ("abbreviations", "compound_variants", "symbol_replacements")
        return cls(**{k: {a.lower(): b.lower() for a, b in rules.get(k, {}).items()} for k in kinds})

    @property
    def enabled(self) -> bool:
        return bool(self.abbreviations or self.compound_variants or self.symbol_replacements)

    @staticmethod
    def ordered(rules: dict[str, str]) -> list[tuple[str, str]]:
        """Longest key first, ties by key, so the table's row order has no effect."""
        return sorted(rules.items(), key=lambda kv: (-len(kv[0]), kv[0]))


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def collapse_ws(col: Column) -> Column:
    """One space for every whitespace run, none at the ends.

    The pattern passes over a space before a word, which is nearly all of the whitespace
    in prose, so that the replacement only does work where the text changes.
    """
    return F.trim(F.regexp_replace(col, f"(?! [^{_WS_CHARS}]){WS}+", " "))


def is_word_char(char: str) -> bool:
    return char == "_" or unicodedata.category(char)[0] in "LN"


def quote(text: str) -> str:
    """Regex text matching `text` itself."""
    return "".join("\\" + c if c.isascii() and not c.isalnum() and c not in "_ " else c for c in text)


def _replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def _boundary(key: str) -> str:
    """`key` between word boundaries: an edge that is no word character needs one next to it."""
    head = f"(?<!{WORD})" if is_word_char(key[0]) else f"(?<={WORD})"
    tail = f"(?!{WORD})" if is_word_char(key[-1]) else f"(?={WORD})"
    return head + quote(key) + tail


def _loose_boundary(key: str) -> str:
    """`key`, anchored only at the edges that are word characters."""
    head = f"(?<!{WORD})" if is_word_char(key[0]) else ""
    tail = f"(?!{WORD})" if is_word_char(key[-1]) else ""
    return head + quote(key) + tail


def normalize(col: Column, rules: NormRules | None = None) -> Column:
    """Lower-cased text with collapsed whitespace, after the rules, if there are any.

    Order: abbreviations on the text as written, lower-casing, symbols, compound variants.
    Every rule sees the output of the rule before it.
    """
    text = F.coalesce(col, F.lit(""))
    if rules is None or not rules.enabled:
        return collapse_ws(F.lower(text))
    for key, target in NormRules.ordered(rules.abbreviations):
        text = F.regexp_replace(text, "(?iu)" + _boundary(key), _replacement(target))
    text = F.lower(text)
    for key, target in NormRules.ordered(rules.symbol_replacements):
        if re.search("[a-z]", key, re.IGNORECASE):
            text = F.regexp_replace(text, "(?iu)" + _loose_boundary(key), _replacement(target))
        else:
            text = F.replace(text, F.lit(key), F.lit(target))
    for key, target in NormRules.ordered(rules.compound_variants):
        text = F.regexp_replace(text, _boundary(key), _replacement(target))
    return collapse_ws(text)


def tokens(norm: Column) -> Column:
    """Distinct words of a normalised text."""
    return F.array_distinct(F.split(norm, f"{NON_WORD}+"))


def has_tags(tags: Column) -> Column:
    return ~collapse_ws(F.lower(F.coalesce(tags, F.lit("")))).isin(*NO_TAG_TEXTS)


def label_key(label: str) -> str:
    """Column label without case, accents and punctuation."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", label) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", "", plain.lower())


def rules_from_table(rules: DataFrame) -> NormRules:
    """Rule columns `type, key, target` (see `operators.terms.norm_rules`) as `NormRules`.

    Each rule becomes a step of the plan, so all of them are read by the driver.
    """
    by_type: dict[str, dict[str, str]] = {}
    for row in rules.collect():
        by_type.setdefault(row["type"], {})[row["key"]] = row["target"]
    return NormRules(
        abbreviations=by_type.get("abbreviation", {}),
        compound_variants=by_type.get("compound_variant", {}),
        symbol_replacements=by_type.get("symbol_replacement", {}),
    )
