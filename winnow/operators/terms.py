"""The term dictionary as a relation: cleaning, linting, routing to blocks, compiling.

A raw term table has text columns `block, kind, term` and optionally `level,
section_scope, is_regex, normalization_type, normalization_target`, plus an integer
`source_row` counting from 0 in file order.

Groups are reduced with map-side aggregates, never gathered: one duplicated term may make
up a third of a machine-made table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions import patterns as P
from winnow.functions.once import built_once, with_once
from winnow.functions.text import WS_EACH, NormRules, normalize
from winnow.params import GLOBAL_BLOCK, KINDS, SCOPES, T0, Params

# Fixed values.
NORM_TYPES = ("abbreviation", "compound_variant", "symbol_replacement")
REGEX_TRUE = ("1", "true", "yes")
REGEX_FALSE = ("0", "false", "no", "")
OPTIONAL_COLUMNS = {
    "level": "",
    "section_scope": "any",
    "is_regex": "0",
    "normalization_type": "",
    "normalization_target": "",
}

CLEAN_SCHEMA = (
    "source_row bigint, term_ord bigint, block string, kind string, term string, "
    "level int, scope string, is_regex boolean"
)
LINT_SCHEMA = "source_row bigint, severity string, code string, message string"

_DIGITS = tuple("0123456789")

# Table terms come after the terms written inline in a configuration.
_TABLE_ORD = 1 << 31


def strip(col: Column) -> Column:
    """Text without white space at its ends, none of which a usual text has: a cheaper look says so."""
    stripped = F.btrim(F.coalesce(col, F.lit("")), F.lit(WS_EACH))
    last = F.substring(col, -1, 1)
    usual = (col >= "!") & (col < "\x7f") & (last >= "!") & (last < "\x7f")
    return F.when(usual, col).otherwise(stripped)


def _worded(name: str, *words: str) -> Column:
    """A stripped, lower-cased field that nearly always holds one of a few words."""
    return F.when(F.col(name).isin(*words), F.col(name)).otherwise(F.lower(strip(F.col(name))))


def with_standard_headers(raw: DataFrame) -> DataFrame:
    """Lower-cased, stripped headers; missing optional columns get their default."""
    df = raw.toDF(*(c.strip().lower() for c in raw.columns))
    missing = {"block", "kind", "term"} - set(df.columns)
    if missing:
        raise ValueError(f"Terms table lacks columns: {sorted(missing)}; found: {sorted(df.columns)}")
    absent = {c: F.lit(v) for c, v in OPTIONAL_COLUMNS.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def _fields(raw: DataFrame, *names: str) -> DataFrame:
    """Stripped fields of raw rows, each computed once however often later steps refer to it."""
    c = F.col
    fields = {
        "block": lambda: strip(c("block")),
        "kind": lambda: _worded("kind", *KINDS),
        "term": lambda: strip(c("term")),
        "level_text": lambda: F.when(c("level").isin(*_DIGITS, ""), c("level")).otherwise(strip(c("level"))),
        "scope_text": lambda: _worded("section_scope", *SCOPES),
        "regex_text": lambda: _worded("is_regex", *REGEX_TRUE, *REGEX_FALSE),
        "norm_type": lambda: _worded("normalization_type", *NORM_TYPES, ""),
        "norm_target": lambda: strip(c("normalization_target")),
    }
    df = with_standard_headers(raw)
    for some in (names[:6], names[6:]):  # all in one would be more than the JVM compiles
        df = with_once(df, {name: fields[name]() for name in some}) if some else df
    return df


def _checked(raw: DataFrame, levels: tuple[int, ...], *more: str) -> DataFrame:
    """Raw rows with parsed fields and one flag per row-level check."""
    c = F.col
    df = _fields(raw, "block", "kind", "term", "level_text", "scope_text", "regex_text", *more)
    digit = c("level_text").isin(*_DIGITS)
    is_number = c("level_text").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    number = F.when(~digit & (c("level_text") != "") & is_number, c("level_text").try_cast("double"))
    df = df.withColumn("number", number).withColumns(
        {
            "level_number": F.when(digit, c("level_text").try_cast("int")).when(
                c("number") == F.floor("number"), c("number").try_cast("int")
            ),
            "is_pos": c("kind") == "pos",
            "empty": (c("block") == "") | (c("kind") == "") | (c("term") == ""),
            "scope": F.when(c("scope_text").isin(*SCOPES), c("scope_text")).otherwise("any"),
            "is_regex": c("regex_text").isin(*REGEX_TRUE),
        }
    ).withColumn("level_known", c("level_number").isin(*levels) if levels else F.lit(True))
    good_level = c("is_pos") & c("level_known") & c("level_number").isNotNull()
    return df.withColumns(
        {
            "level": F.when(good_level, c("level_number")),
            # An exclusion term's level has no effect, but its text still tells rows apart.
            "level_key": F.when(~c("is_pos"), c("level_text")).otherwise(
                F.coalesce(F.when(good_level, c("level_number").cast("string")), F.lit(""))
            ),
            "usable": ~c("empty") & c("kind").isin(*KINDS),
        }
    )


def _rules(checked: DataFrame) -> DataFrame:
    """Usable rows: what makes them the same rule as one text, `spelled` where a term is not in lower case.

    One column is sorted, hashed and moved for less than six. The text begins with a character for
    kind, scope and regex and with the bytes of block and level, so that no two rules share one.
    """
    c = F.col
    at = lambda name, words: reduce(lambda e, i: e.when(c(name) == words[i], i), range(len(words) - 1), F).otherwise(
        len(words) - 1
    )
    code = (at("kind", KINDS) * len(SCOPES) + at("scope", SCOPES)) * 2 + c("is_regex").cast("int")
    rows = with_once(
        checked.filter("usable"), {"code": F.char(code + ord("0")), "level_key": c("level_key"), "term_key": F.lower("term")}
    )
    head = F.concat("code", F.octet_length("block").cast("string"), F.lit(" "), F.octet_length("level_key").cast("string"))
    return rows.select(
        F.concat(head, F.lit(" "), "block", "level_key", "term_key").alias("rule"),
        F.when(c("term") != c("term_key"), c("term")).alias("spelled"),
        "source_row",
    )


def _of_rule(df: DataFrame) -> DataFrame:
    """Rows with the fields that their column `rule` is made of."""
    c = F.col
    df = with_once(df, {"head": F.substring_index("rule", " ", 2)})
    df = with_once(
        df,
        {
            "code": F.ascii("head") - ord("0"),
            "body": F.substring(c("rule").cast("binary"), F.octet_length("head") + 2, F.octet_length("rule")),
            "n_block": F.expr("substring(substring_index(head, ' ', 1), 2)").cast("int"),
            "n_level": F.substring_index("head", " ", -1).cast("int"),
        },
    )
    word = lambda words, i: F.get(F.array(*map(F.lit, words)), i.cast("int"))
    part = lambda start, n: F.substring(c("body"), start, n).cast("string")
    return df.select(
        *(name for name in df.columns if name not in ("head", "code", "body", "n_block", "n_level")),
        part(F.lit(1), c("n_block")).alias("block"),
        word(KINDS, F.floor(c("code") / (2 * len(SCOPES)))).alias("kind"),
        part(c("n_block") + c("n_level") + 1, F.octet_length("body")).alias("term_key"),
        word(SCOPES, F.floor(c("code") / 2) % len(SCOPES)).alias("scope"),
        part(c("n_block") + 1, c("n_level")).alias("level_key"),
        (c("code") % 2 == 1).alias("is_regex"),
    )


def _side_by_side(rows: DataFrame) -> DataFrame:
    """A task's rows with equal rules and equal beginnings of rules one after another.

    What neighbours share is compressed when they are moved, which takes the rows of a rule that
    stands often to a few bytes each. They are sorted by one number, its upper 16 bits from the
    first bytes of the text. A generator keeps the sort from being optimized away.
    """
    whole, start = F.xxhash64("rule"), F.xxhash64(F.substring("rule", 1, 8))
    near = F.shiftleft(start, 48).bitwiseOR(whole.bitwiseAND(F.lit((1 << 48) - 1)))
    return with_once(rows.sortWithinPartitions(near), {name: F.col(name) for name in rows.columns})


def _first_rows(checked: DataFrame) -> DataFrame:
    """First row of every distinct rule.

    Rows of the same spelling are reduced first, to a number: that is hashed where the rows are read,
    while a text among the results of an aggregate has all its input sorted.
    """
    spelled = _rules(checked).groupBy("rule", "spelled").agg(F.min("source_row").alias("source_row"))
    return (
        spelled.repartition("rule")
        .groupBy("rule")
        .agg(F.min_by("spelled", "source_row").alias("spelled"), F.min("source_row").alias("source_row"))
    )


def clean(raw: DataFrame, params: Params | None = None) -> DataFrame:
    """Usable, distinct terms of a raw table."""
    levels = params.configured_levels if params else ()
    return _of_rule(_first_rows(_checked(raw, levels))).select(
        F.col("source_row").cast("bigint").alias("source_row"),
        (F.col("source_row").cast("bigint") + F.lit(_TABLE_ORD)).alias("term_ord"),
        "block",
        "kind",
        F.coalesce("spelled", "term_key").alias("term"),
        F.when(F.col("kind") == "pos", F.col("level_key").try_cast("int")).alias("level"),
        "scope",
        "is_regex",
    )


def inline_terms(spark: SparkSession, cfg: dict) -> DataFrame:
    """Terms written inside a configuration document, in the same form as `clean`.

    Blocks are the entries with positives; the entry `T0` is the pre-screen.
    """
    rows = []
    for block, body in cfg.items():
        is_block = isinstance(body, dict) and (block == T0 or "positives" in body)
        if not is_block or block == GLOBAL_BLOCK:
            continue
        anti = body.get("anti") or {}
        groups = (
            ("pos", body.get("positives") or []),
            ("anti", anti.get("exclude", [])),
            ("flag", anti.get("flag", [])),
        )
        for kind, entries in groups:
            for e in entries:
                level, regex = str(e.get("level") or "").strip(), e.get("regex", e.get("is_regex", False))
                rows.append(
                    (
                        e.get("source_row"),
                        len(rows),
                        block,
                        kind,
                        str(e.get("term", "")).strip(),
                        int(level) if kind == "pos" and level.lstrip("+-").isdigit() else None,
                        e.get("scope", "any"),
                        str(regex).lower() in REGEX_TRUE,
                    )
                )
    return spark.createDataFrame(rows, CLEAN_SCHEMA).filter("term <> ''")


# -- lint ---------------------------------------------------------------------------------


def _label() -> Column:
    return F.concat(F.lit("block '"), F.col("block"), F.lit("', term '"), F.col("term"), F.lit("'"))


def _finding(condition: Column, severity: str, code: str, message: Column) -> Column:
    return F.when(
        F.coalesce(condition, F.lit(False)),
        F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message")),
    )


def row_findings(raw: DataFrame, params: Params | None = None) -> DataFrame:
    """Findings that one row shows by itself."""
    c = F.col
    levels = params.configured_levels if params else ()
    df = _checked(raw, levels, "norm_type", "norm_target").withColumns(
        {
            "usable_pos": c("usable") & c("is_pos"),
            "rule_row": (c("norm_type") != "") & (c("norm_type") != "nan"),
            "known_rule": c("norm_type").isin(*NORM_TYPES),
        }
    )
    label, pos, rule_row = _label(), c("usable_pos"), c("rule_row")
    missing = F.concat_ws(
        ", ", *(F.when(c(name) == "", F.lit(name)) for name in ("block", "kind", "term"))
    )
    checks = {
        "empty_field": (c("empty") & ~rule_row, F.concat(F.lit("empty "), missing)),
        "kind": (~c("empty") & ~c("kind").isin(*KINDS), F.concat(label, F.lit(": unknown kind "), c("kind"))),
        "level_missing": (pos & (c("level_text") == ""), label),
        "level_invalid": (
            pos & (c("level_text") != "") & c("level_number").isNull(),
            F.concat(label, F.lit(": level "), c("level_text")),
        ),
        "level_unknown": (
            pos & c("level_number").isNotNull() & ~c("level_known"),
            F.concat(label, F.lit(": level "), c("level_number").cast("string")),
        ),
        "level_ignored": (c("usable") & ~c("is_pos") & (c("level_text") != ""), label),
        "scope": (
            c("usable") & ~c("scope_text").isin(*SCOPES), F.concat(label, F.lit(": scope "), c("scope_text"))
        ),
        "is_regex": (
            c("usable") & ~c("regex_text").isin(*REGEX_TRUE, *REGEX_FALSE),
            F.concat(label, F.lit(": is_regex "), c("regex_text")),
        ),
        "rule_without_type": (~rule_row & (c("norm_target") != ""), c("norm_target")),
        "rule_type": (rule_row & ~c("known_rule"), c("norm_type")),
        "rule_without_target": (c("known_rule") & (c("norm_target") == ""), c("term")),
    }
    # Messages are made of what is found, and only where they are asked for.
    codes = F.array(*(F.when(condition, F.lit(code)) for code, (condition, _) in checks.items()))
    message = reduce(lambda e, code: e.when(c("code") == code, checks[code][1]), checks, F)
    return df.select("*", F.explode(codes).alias("code")).filter("code IS NOT NULL").select(
        c("source_row").cast("bigint").alias("source_row"), F.lit("warning").alias("severity"), "code",
        message.alias("message"),
    )


def duplicates(raw: DataFrame, params: Params | None = None) -> DataFrame:
    """Rows dropped because an earlier row states the same rule.

    Rows are moved once, to the task of their rule, and read there twice: for the first row of the
    rules that stand more than once, which are held hashed, and to be compared with it, one after
    another. So rows of a rule that fills much of the table cost its task time, not memory.
    """
    c = F.col
    rows = _rules(_checked(raw, params.configured_levels if params else ())).filter("source_row IS NOT NULL")
    moved = _side_by_side(rows).repartition("rule")
    # Both spellings are counted, as only readers of the same columns share what is moved.
    n = F.count("spelled") + F.count_if(c("spelled").isNull())
    stated = moved.groupBy("rule").agg(F.min("source_row").alias("first_row"), n.alias("n"))
    again = _of_rule(stated.filter("n > 1")).select("rule", "first_row", "block", "kind", "term_key")
    return moved.join(again.hint("shuffle_hash"), "rule").filter(~c("source_row").eqNullSafe(c("first_row"))).select(
        c("source_row").cast("bigint").alias("source_row"), "first_row", "block", "kind",
        F.coalesce("spelled", "term_key").alias("term"),
    )


def conflicts(terms: DataFrame) -> DataFrame:
    """Texts that a block uses both as a positive and as an exclusion or warning term."""
    has = lambda kind: F.bool_or(F.col("kind") == kind)
    return (
        terms.filter(F.col("block") != GLOBAL_BLOCK)
        .groupBy("block", F.lower("term").alias("term"))
        .agg(
            has("pos").alias("is_pos"),
            has("anti").alias("is_anti"),
            has("flag").alias("is_flag"),
            F.min("source_row").alias("source_row"),
        )
        .filter("is_pos")
        .select(
            "block",
            "term",
            "source_row",
            F.explode(
                F.array_compact(
                    F.array(
                        F.when(F.col("is_anti"), F.lit("anti")), F.when(F.col("is_flag"), F.lit("flag"))
                    )
                )
            ).alias("other_kind"),
        )
    )


def broad_literals(terms: DataFrame) -> DataFrame:
    """Positive terms that match nearly every text."""
    return terms.filter(
        (F.col("kind") == "pos")
        & (F.col("block") != GLOBAL_BLOCK)
        & F.col("term").rlike(r"^(?:[*?]|\p{L})$")
    )


def block_counts(terms: DataFrame) -> DataFrame:
    """Terms per block and kind."""
    return terms.groupBy("block").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS)
    )


def block_findings(terms: DataFrame, params: Params | None = None) -> DataFrame:
    """Findings about whole blocks: no positives, or not part of the block order."""
    c = F.col
    n_all = c("n_pos") + c("n_anti") + c("n_flag")
    checks = [_finding((c("n_pos") == 0) & (n_all > 0), "warning", "no_positives", c("block"))]
    if params and params.block_order:
        order = [b.strip().upper() for b in params.block_order]
        checks.append(
            _finding(
                ~F.upper(F.trim("block")).isin(*order), "warning", "block_ignored",
                F.format_string("%s: %d term(s)", "block", n_all),
            )
        )
    return (
        block_counts(terms.filter(c("block") != GLOBAL_BLOCK))
        .select(
            F.lit(None).cast("bigint").alias("source_row"),
            F.inline(F.array_compact(F.array(*checks))),
        )
    )


def lint(raw: DataFrame, params: Params | None = None) -> DataFrame:
    """All findings about a raw term table as (source_row, severity, code, message)."""
    terms = clean(raw, params)
    text = F.format_string("block '%s', term '%s'", "block", "term")
    columns = ("source_row", "severity", "code", "message")
    parts = [
        row_findings(raw, params),
        duplicates(raw, params).select(
            "source_row", F.lit("warning").alias("severity"), F.lit("duplicate").alias("code"),
            text.alias("message"),
        ),
        conflicts(terms).select(
            "source_row", F.lit("error").alias("severity"),
            F.concat(F.lit("pos_and_"), "other_kind").alias("code"), text.alias("message"),
        ),
        broad_literals(terms).select(
            "source_row", F.lit("warning").alias("severity"), F.lit("too_broad").alias("code"),
            text.alias("message"),
        ),
        block_findings(terms, params),
        rule_conflicts(raw).select(
            "source_row", F.lit("warning").alias("severity"), F.lit("rule_overwritten").alias("code"),
            F.col("key").alias("message"),
        ),
        regex_findings(terms),
    ]
    if params:
        parts.append(unit_findings(raw.sparkSession, params))
    return reduce(DataFrame.unionByName, (p.select(*columns) for p in parts))


# -- normalisation rules ------------------------------------------------------------------


def _rule_rows(raw: DataFrame) -> DataFrame:
    return (
        _fields(raw, "term", "norm_type", "norm_target")
        .filter(
            F.col("norm_type").isin(*NORM_TYPES)
            & (F.col("norm_target") != "")
            & (F.col("term") != "")
        )
        .select(
            F.col("norm_type").alias("type"),
            F.lower("term").alias("key"),
            F.lower("norm_target").alias("target"),
            "source_row",
        )
    )


def norm_rules(raw: DataFrame) -> DataFrame:
    """Normalisation rules (type, key, target); the last row of a key wins."""
    return _rule_rows(raw).groupBy("type", "key").agg(F.max_by("target", "source_row").alias("target"))


def rule_conflicts(raw: DataFrame) -> DataFrame:
    """Rule keys that occur with different targets."""
    return (
        _rule_rows(raw)
        .groupBy("type", "key")
        .agg(
            F.max("source_row").cast("bigint").alias("source_row"),
            F.max_by("target", "source_row").alias("target"),
            F.min("target").alias("low"),
            F.max("target").alias("high"),
        )
        .filter("low <> high")
        .select("type", "key", "target", "source_row")
    )


# -- routing and compiling ----------------------------------------------------------------


@dataclass(frozen=True)
class TermSet:
    """Terms routed to blocks. `terms` has `block_ord`: position of the block, -1 for T0."""

    terms: DataFrame
    blocks: tuple[str, ...]
    has_t0: bool


def route(terms: DataFrame, block_order: tuple[str, ...] | None = None) -> TermSet:
    """Give every term its canonical block; drop terms of blocks outside the order.

    Block names are matched without regard to case and outer whitespace. Blocks become
    output columns, so the driver knows all of them. The pre-screen's terms are those of
    the table's global block, or else those written inline.
    """
    inline = F.col("term_ord") < _TABLE_ORD
    rows = (
        terms.groupBy("block", inline.alias("inline"))
        .agg(F.min("term_ord").alias("first_ord"))
        .collect()
    )
    domain = [r for r in rows if r["block"] not in (GLOBAL_BLOCK, T0)]
    written = {r["block"] for r in domain if r["inline"]}
    by_name: dict[str, str] = {}
    for row in sorted(domain, key=lambda r: r["first_ord"]):
        if not row["inline"]:
            by_name[row["block"].strip().upper()] = row["block"]
    wanted = block_order or tuple(sorted(written | set(by_name.values())))
    found = [b for b in wanted if b != GLOBAL_BLOCK and (b in written or b.strip().upper() in by_name)]
    # Inline blocks go by their exact name, those of a table by any spelling of it.
    target = {f"true {b}": (b, i) for i, b in enumerate(found) if b in written}
    target |= {
        f"false {by_name[b.strip().upper()]}": (b, i)
        for i, b in enumerate(found)
        if b.strip().upper() in by_name
    }
    in_table = any(r["block"] == GLOBAL_BLOCK for r in rows)
    written_inline = any(r["block"] == T0 and r["inline"] for r in rows)
    target |= {f"false {GLOBAL_BLOCK}" if in_table else f"true {T0}": (T0, -1)}
    lookup = F.from_json(
        F.lit(json.dumps({k: {"name": n, "ord": i} for k, (n, i) in target.items()})),
        "map<string,struct<name:string,ord:int>>",
    )
    key = F.concat(inline.cast("string"), F.lit(" "), F.col("block"))
    routed = (
        terms.withColumn("target", F.try_element_at(lookup, key))
        .filter(F.col("target").isNotNull())
        .withColumns({"block": F.col("target.name"), "block_ord": F.col("target.ord")})
        .drop("target")
    )
    return TermSet(routed, tuple(found), in_table or written_inline)


def regex_terms(terms: DataFrame) -> list[str]:
    """Distinct regexes, on the driver: each of them becomes a test in the plan."""
    return [r["term"] for r in terms.filter("is_regex").select("term").distinct().collect()]


def _usable(spark: SparkSession, patterns: list[str]) -> set[str]:
    """Those of some JVM patterns that compile.

    A bad pattern would end the whole job, so all of them are tried on a constant first;
    if that fails, by halves, until the bad ones are found.
    """
    if not patterns:
        return set()
    try:
        tests = [F.rlike(F.lit("x"), F.lit(p)).alias(f"t{i}") for i, p in enumerate(patterns)]
        spark.sql("SELECT 1").select(F.array(*tests)).collect()
        return set(patterns)
    except Exception:  # noqa: BLE001 - the JVM reports a bad pattern in several ways
        half = len(patterns) // 2
        return _usable(spark, patterns[:half]) | _usable(spark, patterns[half:]) if half else set()


def vet_regexes(spark: SparkSession, regexes: list[str]) -> dict[str, str | None]:
    """JVM form of every usable regex, None for the others."""
    java = {r: P.java_regex(r) for r in regexes if P.python_regex_ok(r)}
    good = _usable(spark, list(java.values()))
    return {r: java[r] if java.get(r) in good else None for r in regexes}


def vet_token_unit(spark: SparkSession, unit: str) -> tuple[str | None, bool]:
    """JVM form of a token unit (None: the default one), and whether it is usable at all."""
    if unit == P.DEFAULT_TOKEN_UNIT:
        return None, True
    java = P.jvm_unit(unit)
    good = java is not None and bool(_usable(spark, [P.unit_gap(java)]))
    return (java if good else None), good


def unit_findings(spark: SparkSession, params: Params) -> DataFrame:
    """A token unit that cannot run; proximity takes the default one in its place."""
    good = vet_token_unit(spark, params.token_unit)[1]
    message = f"token unit {params.token_unit!r} is no usable regex: {P.DEFAULT_TOKEN_UNIT!r} is used"
    return spark.createDataFrame([] if good else [(None, "warning", "token_unit", message)], LINT_SCHEMA)


def regex_findings(terms: DataFrame) -> DataFrame:
    """Regex terms that cannot run; they take no part in matching."""
    vetted = vet_regexes(terms.sparkSession, regex_terms(terms))
    bad = [r for r, pattern in vetted.items() if pattern is None]
    return terms.filter(F.col("is_regex") & F.col("term").isin(*bad) if bad else F.lit(False)).select(
        "source_row",
        F.lit("warning").alias("severity"),
        F.lit("regex").alias("code"),
        F.format_string("block '%s', term '%s'", "block", "term").alias("message"),
    )


def compile_terms(term_set: TermSet, rules: NormRules | None, params: Params) -> DataFrame:
    """Terms with regex text, lookup key and guards; compound positives add proximity rows.

    `near`, `ord` and `pair_pos` sort a block's terms: exact ones in table order, then the
    proximity ones in table order, each term's pairs as they stand in it.
    """
    terms = term_set.terms
    vetted = vet_regexes(terms.sparkSession, regex_terms(terms))
    regex_map = F.from_json(F.lit(json.dumps(vetted)), "map<string,string>")
    regex = F.when(F.col("is_regex"), F.try_element_at(regex_map, F.col("term")))
    required = {r: [t] if (t := P.required_text(r)) else [] for r, java in vetted.items() if java}
    required_map = F.from_json(F.lit(json.dumps(required)), "map<string,array<string>>")
    normal = F.when(~F.col("is_regex"), normalize(F.col("term"), rules))
    unchanged = F.col("is_regex") | (F.col("normal") == "")
    base = (
        terms.withColumn("java_regex", regex)
        .filter(~F.col("is_regex") | F.col("java_regex").isNotNull())
        .withColumn("regex_guards", F.try_element_at(required_map, F.col("term")))
        .withColumn("normal", normal)
        .withColumn("match_term", F.when(unchanged, F.col("term")).otherwise(F.col("normal")))
        .withColumn("probe", F.lower("match_term"))
    )
    exact = base.select(*_COMMON, *_exact_columns())
    if not params.proximity:
        return exact
    pairs = F.posexplode(P.compound_pairs(F.col("match_term"))).alias("pair_pos", "pair")
    near = (
        base.filter(F.col("kind") == "pos")
        .select("*", pairs)
        .select(*_COMMON, *_near_columns(params.max_gap, vet_token_unit(terms.sparkSession, params.token_unit)[0]))
    )
    return exact.unionByName(near)


_COMMON = (
    "block_ord", "block", "kind", "level", "term", "match_term", "scope", "is_regex", "source_row",
)


def _mark(keys: Column, pattern: Column) -> Column:
    return F.struct(keys.alias("keys"), pattern.alias("pattern"))


def _literal_mark(text: Column) -> Column:
    """What to mark for a literal term; without pattern, the words its key stands for."""
    low = F.lower(text)
    # A lone `*` also matches between words, where there is nothing to mark.
    written = F.when(low.rlike(r"^\*+$"), F.lit(P.WORD_RUN)).otherwise(P.literal_pattern(text))
    return _mark(
        P.lookup_keys(low), F.when(~P.key_is_proof(low), F.concat(F.lit("(?iu)"), written))
    )


@built_once
def _exact_columns() -> list[Column]:
    c = F.col
    no_parts = F.array().cast("array<string>")
    literal = _literal_mark(c("term"))
    return [
        c("term_ord").alias("ord"),
        F.lit(-1).alias("pair_pos"),
        F.lit("exact").alias("match_type"),
        no_parts.alias("components"),
        F.when(c("is_regex"), no_parts).otherwise(P.lookup_keys(c("probe"))).alias("keys"),
        F.when(c("is_regex"), c("regex_guards")).otherwise(P.guards(c("probe"))).alias("guards"),
        F.when(c("is_regex"), c("java_regex"))
        .when(~P.key_is_proof(c("probe")), P.literal_pattern(c("probe")))
        .alias("pattern"),
        F.when(c("is_regex"), F.array(_mark(no_parts, c("java_regex"))))
        .when(c("match_term") == c("term"), F.array(literal))
        .otherwise(F.array(literal, _literal_mark(c("match_term"))))
        .alias("highlight"),
    ]


@built_once
def _near_columns(max_gap: int, token_unit: str | None) -> list[Column]:
    pair = F.col("pair")
    a, b = F.lower(F.get(pair, F.lit(0))), F.lower(F.get(pair, F.lit(1)))
    return [
        F.col("term_ord").alias("ord"),
        F.col("pair_pos"),
        F.lit("proximity").alias("match_type"),
        pair.alias("components"),
        P.proximity_keys(a, b).alias("keys"),
        F.array(a, b).alias("guards"),
        P.proximity_pattern(a, b, max_gap, token_unit).alias("pattern"),
        F.array(_literal_mark(F.col("term"))).alias("highlight"),
    ]


def browse(term_set: TermSet, block: str | None = None, kind: str | None = None) -> DataFrame:
    """Term listing: blocks in order with T0 last; positives, exclusions, warnings.

    Blocks and kinds are sorted and moved as numbers, and named afterwards.
    """
    terms = term_set.terms
    if block:
        terms = terms.filter(F.col("block") == block)
    if kind:
        terms = terms.filter(F.col("kind") == kind)
    kind_ord = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    block_ord = F.when(F.col("block_ord") < 0, len(term_set.blocks)).otherwise(F.col("block_ord"))
    level = F.when(F.col("kind") == "pos", F.col("level"))
    listed = terms.select(
        block_ord.alias("block_ord"), kind_ord.alias("kind_ord"), "term_ord", "term", level.alias("level"), "scope"
    ).orderBy("block_ord", "kind_ord", "term_ord")
    name = lambda names, at: F.get(F.array(*map(F.lit, names)), at.cast("int"))
    return listed.select(
        name((*term_set.blocks, T0), F.col("block_ord")).alias("block"),
        name(KINDS, F.col("kind_ord") - 1).alias("kind"),
        "term", "level", "scope",
    )


__all__ = [
    "TermSet", "block_counts", "block_findings", "broad_literals", "browse", "clean",
    "compile_terms", "conflicts", "duplicates", "inline_terms", "lint",
    "norm_rules", "regex_findings", "route", "row_findings", "rule_conflicts", "unit_findings", "vet_regexes",
    "vet_token_unit",
]
