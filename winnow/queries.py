"""Registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow import fixture as X
from winnow.functions import patterns as P
from winnow.functions.once import with_once
from winnow.functions.text import NormRules, named, normalize
from winnow.operators import analytics as A
from winnow.operators import results as R
from winnow.operators import terms as T
from winnow.operators.decision import decide
from winnow.params import SECTIONS, Params, check_config, wanted_blocks
from winnow.plans import manifest as MF
from winnow.plans.engine import TriageEngine
from winnow.plans.run import results_with_errors
from winnow.sources import sinks
from winnow.sources import tables as S
from winnow.sources.staging import scratch, stored
from winnow.streaming.stream import count_decisions, triage_stream

Query = Callable[[SparkSession, str], DataFrame]

# Dictionaries beyond the fixture: block, kind, term, level, section_scope, is_regex.
WILDCARDS = [
    ("FUNC", "pos", "th*", "5", "any", "0"),
    ("FUNC", "pos", "ción*", "4", "any", "0"),
    ("FUNC", "pos", "*tion", "3", "any", "0"),
    ("FUNC", "pos", "*igh*", "3", "any", "0"),
    ("FUNC", "pos", "e*en", "2", "any", "0"),
    ("FORM", "pos", "the th*", "1", "any", "0"),
    ("FORM", "pos", "*ing, the", "1", "any", "0"),
]
PROXIMITY = [
    ("FUNC", "pos", "this and that", "1", "any", "0"),
    ("FUNC", "pos", "pour / dans", "2", "any", "0"),
    ("FORM", "pos", "sich & eine or auf", "1", "any", "0"),
    ("FORM", "pos", "para or una", "2", "abstract", "0"),
]
UNITS = (r"(?P<w>\S+)", r"\w{,4}", "\\")
REGEXES = [
    ("FUNC", "pos", "th(is|at)", "3", "any", "1"),
    ("FUNC", "pos", r"^(the|la|der)\s", "2", "any", "1"),
    ("FORM", "pos", r"qu[aeiou]+\s+(?P<w>en|de)", "4", "any", "1"),
    ("FORM", "anti", "[0-9]{4}-[0-9]{2}", "", "abstract", "1"),
]
SCOPED = [
    ("FUNC", "pos", "en", "1", "manual_tags", "0"),
    ("FUNC", "pos", "that", "2", "title", "0"),
    ("FORM", "pos", "that", "2", "abstract", "0"),
    ("FORM", "flag", "src1*", "", "manual_tags", "0"),
    ("GLOBAL", "anti", "src7", "", "manual_tags", "0"),
]
BROAD = [*X.TERMS, ("FUNC", "pos", "*e*", "5", "any", "0"), ("FORM", "pos", "qzqzqz", "5", "any", "0")]
ANY_LENGTH = [("FUNC", "pos", "th(e*)|z*", "1", "any", "1")]
NORMALIZED = [
    ("FUNC", "pos", "through", "1", "any", "0"),
    ("FUNC", "pos", "it", "2", "any", "0"),
    ("FORM", "pos", "thorough", "3", "any", "0"),
    ("FORM", "flag", "informatics", "", "any", "0"),
]
# A whole configuration without a term table, its pre-screen included.
INLINE = {
    "FUNC": {
        "positives": [{"term": "that", "level": 2}, {"term": "th*", "level": "5"}, {"term": "pour", "level": 2}],
        "anti": {"flag": [{"term": "than"}]},
    },
    "FORM": {"positives": [{"term": "this", "level": 3}, {"term": "en", "level": 5, "scope": "abstract"}]},
    "T0": {"anti": {"exclude": [{"term": "thth"}], "flag": [{"term": "avec"}]}},
    "IDLE": {"positives": [{"term": "not asked for", "level": 1}]},
}
UNIFORM = [t for t in X.TERMS if t[0] != "GLOBAL"] + [("VOID", "pos", "qzqzqz", "1", "any", "0")]

RULES = NormRules(
    abbreviations={"th": "through", "it": "information tech"},
    compound_variants={"information tech": "informatics"},
    symbol_replacements={",": " ;", "th.": "thorough"},
)

_engines: dict[tuple, TriageEngine] = {}


def engine(spark: SparkSession, name: str = "fixture", **params) -> TriageEngine:
    """Engines are built once per session and dictionary."""
    rows, blocks = {
        "fixture": (X.TERMS, X.BLOCKS),
        "wildcards": (WILDCARDS, X.BLOCKS),
        "proximity": (PROXIMITY, X.BLOCKS),
        "regexes": (REGEXES, X.BLOCKS),
        "scoped": (SCOPED, X.BLOCKS),
        "broad": (BROAD, X.BLOCKS),
        "uniform": (UNIFORM, (*X.BLOCKS, "VOID")),
        "any_length": (ANY_LENGTH, X.BLOCKS),
        "normalized": (NORMALIZED, X.BLOCKS),
        "dotted": ([(t[0].replace("FUNC", "A.1"), *t[1:]) for t in X.TERMS], ("A.1", "FORM")),
    }[name]
    key = (spark.sparkContext.applicationId, name)
    if key not in _engines:
        built = TriageEngine.build(X.raw_terms(spark, rows), Params(block_order=blocks))
        _ = built.match_index
        _engines[key] = built
    return _engines[key].with_params(**params) if params else _engines[key]


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.articles(spark, sf_dir)


def _decided(name: str = "fixture", **params) -> Query:
    return lambda spark, sf: engine(spark, name, **params).decide(articles(spark, sf))


def _hits(name: str, *columns: str, where: str = "true") -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return engine(spark, name).hits(articles(spark, sf), "id").filter(where).select("id", *columns)

    return query


def _results(name: str = "fixture", **params) -> Query:
    """Result rows without text, the input of the statistics."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        e = engine(spark, name, **params)
        return R.wide(e.decide(articles(spark, sf)), e.blocks, e.has_t0, timestamp=False)

    return query


def _evaluated_twice(spark: SparkSession, sf: str, id_a: Column, id_b: Column) -> DataFrame:
    """Every article with its decision under two policies, from one evaluation, as two rows."""
    e = engine(spark)
    evaluated = e.evaluate(X.articles(spark, sf, "doc_id", "lang", "source"))

    def under(df: DataFrame, policy: str) -> DataFrame:
        found = decide(df, e.blocks, e.has_t0, e.params.with_(policy=policy))
        return found.withColumnRenamed("Final_Decision", policy).drop("Decision_Reason")

    sides = [
        F.struct(F.lit(side).alias("side"), key.alias("article_id"), F.col(policy).alias("Final_Decision"))
        for side, key, policy in (("a", id_a, "special"), ("b", id_b, "strict"))
    ]
    return under(under(evaluated, "special"), "strict").select(F.inline(F.array(*sides)))


def _round(col: str, digits: int = 2) -> Column:
    return F.round(F.col(col), digits).alias(col)


def triage(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: decisions over all documents."""
    return A.decision_distribution(_decided()(spark, sf)).select("Final_Decision", "n", _round("pct"))


# -- sources ------------------------------------------------------------------------------


def _exported(spark: SparkSession, sf: str) -> DataFrame:
    """The articles under the headers of a reference manager."""
    return articles(spark, sf).toDF("Article ID", "Document Title", "Abstract Note", "Manual Tags")


def articles_view(spark: SparkSession, sf: str) -> DataFrame:
    return S.as_articles(_exported(spark, sf), {"manual_tags": "manual_tags"})


def tag_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Tags given as a list, with missing elements."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    listed = docs.select(
        F.col("doc_id").alias("key"),
        F.lit("").alias("title"),
        F.lit("").alias("abstract"),
        F.array("lang", F.when(F.col("doc_id") % 2 == 0, F.col("source"))).alias("Keywords"),
    )
    return S.as_articles(listed, {"manual_tags": "manual_tags"}).select("id", "manual_tags")


def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return S.input_profile(_exported(spark, sf), {"manual_tags": "manual_tags"})


def csv_exchange(spark: SparkSession, sf: str) -> DataFrame:
    """Results written as CSV with decimal commas and a byte order mark, and read again as text."""
    rows = _results()(spark, sf).select("ID", "FinalScore_FUNC", "BestLevel_FORM", "Final_Decision", "Decision_Reason")
    at = scratch(spark)
    sinks.write_csv(rows, at)
    return S.read_results(spark, at)


def csv_encodings(spark: SparkSession, sf: str) -> DataFrame:
    """Articles from one folder of files in several encodings, with quoted line breaks."""
    at, docs = scratch(spark), _exported(spark, sf)
    cells = F.array(*map(named, docs.columns))
    one_byte = F.forall(cells, lambda c: c.rlike(r"^[\x00-\x7F\xA0-\xFF]*$"))
    latin = one_byte & (named("Article ID").cast("int") % 2 == 0)
    sinks.write_csv(docs.filter(latin), at, {"encoding": "ISO-8859-1"}, "append")
    sinks.write_csv(docs.filter(~latin), at, {"encoding": "utf-8"}, "append")
    return S.as_articles(S.read_table(spark, at), {"manual_tags": "manual_tags"})


# -- text and patterns --------------------------------------------------------------------


def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    cells = [
        F.struct(F.lit(s).alias("section"), normalize(F.col(s), RULES).alias("norm")) for s in SECTIONS
    ]
    return articles(spark, sf).select("id", F.inline(F.array(*cells)))


def compound_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every section as if it were a term: its neighbouring parts."""
    pair = F.col("pair")
    cells = [F.struct(F.lit(s).alias("section"), normalize(F.col(s)).alias("norm")) for s in SECTIONS]
    rows = articles(spark, sf).select("id", F.inline(F.array(*cells)))
    rows = with_once(rows, {"pairs": P.compound_pairs(F.col("norm"))})
    rows = rows.select("id", "section", F.posexplode("pairs").alias("pos", "pair"))
    return rows.select(
        "id", "section", "pos", F.get(pair, F.lit(0)).alias("a"), F.get(pair, F.lit(1)).alias("b")
    )


# -- term tables made from the documents --------------------------------------------------


def document_terms(spark: SparkSession, sf: str) -> DataFrame:
    """A raw term table: one row per word of the documents, with all the faults a table can have."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = docs.select(
        "doc_id", "lang", "source",
        F.posexplode(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))).alias("pos", "word"),
    )
    i = F.col("doc_id") + F.col("pos")

    def pick(n: int, *values: str) -> Column:
        return F.get(F.array(*map(F.lit, values)), (i % n).cast("int"))

    return words.select(
        (F.col("doc_id") * 100_000 + F.col("pos")).alias("source_row"),
        F.when(i % 41 == 0, "").when(i % 11 == 0, "GLOBAL").otherwise(F.upper("lang")).alias(" Block"),
        F.when(i % 43 == 0, "bogus")
        .otherwise(pick(6, "pos", "POS ", "pos", "anti", "flag", "pos"))
        .alias("Kind"),
        F.when(i % 37 == 0, "").when(i % 29 == 0, "e").otherwise(F.col("word")).alias("TERM"),
        pick(9, "1", "2.0", "", "1.5", "x", "3", "9", "4", " 5 ").alias("level"),
        pick(5, "any", "title", "Abstract", "body", "any").alias("section_scope"),
        pick(7, "0", "no", "", "0", "maybe", "0", "0").alias("is_regex"),
        F.when(i % 13 == 0, "abbreviation")
        .when(i % 17 == 0, "compound_variant")
        .when(i % 19 == 0, "other")
        .otherwise("")
        .alias("normalization_type"),
        F.when(i % 13 == 0, F.col("source")).when(i % 17 == 0, F.col("lang")).otherwise("").alias(
            "normalization_target"
        ),
    )


TERM_PARAMS = Params(configured_levels=(1, 2, 3, 4, 5), block_order=("EN", "FR", "de"))


def terms_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return T.clean(document_terms(spark, sf), TERM_PARAMS).drop("term_ord")


def terms_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return T.duplicates(document_terms(spark, sf), TERM_PARAMS)


def terms_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return T.conflicts(T.clean(document_terms(spark, sf), TERM_PARAMS))


def terms_lint(spark: SparkSession, sf: str) -> DataFrame:
    return T.row_findings(document_terms(spark, sf), TERM_PARAMS).select("source_row", "severity", "code")


def terms_broad(spark: SparkSession, sf: str) -> DataFrame:
    found = T.broad_literals(T.clean(document_terms(spark, sf), TERM_PARAMS))
    return found.select("source_row", "block", "term")


def terms_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return T.block_counts(T.clean(document_terms(spark, sf), TERM_PARAMS))


def terms_block_lint(spark: SparkSession, sf: str) -> DataFrame:
    found = T.block_findings(T.clean(document_terms(spark, sf), TERM_PARAMS), TERM_PARAMS)
    return found.select("severity", "code", "message")


def terms_no_positives(spark: SparkSession, sf: str) -> DataFrame:
    """A block that has exclusions and warnings only can never approve."""
    found = T.block_findings(T.clean(_flags_only(spark, sf), TERM_PARAMS))
    return found.select("severity", "code", "message")


def _flags_only(spark: SparkSession, sf: str) -> DataFrame:
    raw = document_terms(spark, sf)
    return raw.withColumn("Kind", F.when(F.col(" Block") == "FR", "flag").otherwise(F.col("Kind")))


def terms_bad_regexes(spark: SparkSession, sf: str) -> DataFrame:
    """Regexes made of the documents' sources, some of which no dialect takes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tail = F.get(F.array(*map(F.lit, ("[0-9]", "(", "(?P<n>x)?", "[b-a]"))), (F.col("doc_id") % 4).cast("int"))
    raw = docs.select(
        F.col("doc_id").alias("source_row"), F.lit("A").alias("block"), F.lit("pos").alias("kind"),
        F.concat("source", tail).alias("term"), F.lit("1").alias("level"), F.lit("yes").alias("is_regex"),
    )
    return T.regex_findings(T.clean(raw))


def config_checks(spark: SparkSession, sf: str) -> DataFrame:
    """A planned run over the documents' terms: blocks without terms or positives, policy, thresholds."""
    terms = T.clean(_flags_only(spark, sf), TERM_PARAMS)
    counts = {r["block"]: r["n_pos"] for r in T.block_counts(terms).collect()}
    cfg = {
        "global": {"DECISION_POLICY": "any", "LIMITES_APROVADO": {"1": -1, "2": 12}, "LIMITES_SINALIZADO": {"3": -2}},
        "_domain_blocks": ["EN", "FR", "XX", "GLOBAL"],
    }
    found = check_config(cfg, {b: counts.get(b) for b in wanted_blocks(cfg)})
    return spark.createDataFrame(found, "severity string, message string")


def terms_browse(spark: SparkSession, sf: str) -> DataFrame:
    """The terms are read three times: for their blocks, for the bounds of the sorted parts, and sorted."""
    terms = stored(T.clean(document_terms(spark, sf), TERM_PARAMS), shuffles_go=True)
    return T.browse(T.route(terms, TERM_PARAMS.block_order))


def norm_rules(spark: SparkSession, sf: str) -> DataFrame:
    return T.norm_rules(document_terms(spark, sf))


def norm_rule_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return T.rule_conflicts(document_terms(spark, sf))


# -- scores and decisions -----------------------------------------------------------------


def section_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.block_rows(_decided(fail_fast=False)(spark, sf), "id")
    return rows.filter("status <> 'NOT_EVALUATED'").select("id", "block", "section_scores.*")


def block_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.block_rows(_decided(fail_fast=False)(spark, sf), "id")
    return rows.filter("status <> 'NOT_EVALUATED'").select(
        "id", "block", _round("raw_score"), _round("final_score"), "best_level", "uplift"
    )


def _block_status(**params) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return R.block_rows(_decided(**params)(spark, sf), "id").select("id", "block", "status", "reason")

    return query


def t0_prescreen(spark: SparkSession, sf: str) -> DataFrame:
    return _decided()(spark, sf).select("id", "t0.status", "t0.reason", "t0.scope")


def _decision(**params) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _decided(**params)(spark, sf).select("id", "Final_Decision", "Decision_Reason")

    return query


# -- statistics, coverage, diff -----------------------------------------------------------


def status_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return A.status_distribution(_results()(spark, sf)).select("block", "status", "n", _round("pct"))


def block_performance(spark: SparkSession, sf: str) -> DataFrame:
    return A.block_performance(_results()(spark, sf)).select(
        "block", "n_valid", _round("avg_score"), _round("max_score")
    )


def score_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return A.score_distribution(_results()(spark, sf)).select(
        "block", _round("mean"), _round("std"), _round("min"), _round("max"), "n_valid"
    )


def level_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return A.level_distribution(_results()(spark, sf))


def report(spark: SparkSession, sf: str) -> DataFrame:
    return A.report(_results()(spark, sf)).select("part", "block", "name", _round("value"), _round("pct"))


def _coverage(spark: SparkSession, sf: str, name: str = "broad", **options) -> DataFrame:
    return A.term_coverage(_decided(name)(spark, sf), **options)


def _report(spark: SparkSession, sf: str, name: str = "broad", **params) -> DataFrame:
    docs, e = articles(spark, sf), engine(spark, name, **params)
    return A.coverage_report(e.decide(docs), e.term_set, docs)


def dead_terms(spark: SparkSession, sf: str) -> DataFrame:
    return A.dead_terms(_report(spark, sf))


def broad_terms(spark: SparkSession, sf: str) -> DataFrame:
    return A.broad_terms(_report(spark, sf)).select("term", "articles", "hits", _round("pct"))


def section_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return A.section_distribution(_coverage(spark, sf))


def block_discrimination(spark: SparkSession, sf: str) -> DataFrame:
    return A.block_discrimination(_report(spark, sf, "uniform", fail_fast=False))


def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return A.suggestions(_report(spark, sf))


def coverage_export(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.coverage_export(_report(spark, sf))
    return rows.select("term", "status", "hits", _round("pct"), "articles", "section_hits")


def _group_ids() -> tuple[Column, Column]:
    """Ids that repeat, and some that are in one run only, while every row stays."""
    group = F.concat_ws("-", "lang", "source")
    return group, F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("other-"), "source")).otherwise(group)


def run_diff(spark: SparkSession, sf: str) -> DataFrame:
    return A.diff_of_sides(_evaluated_twice(spark, sf, *_group_ids()))


def diff_transitions(spark: SparkSession, sf: str) -> DataFrame:
    both = _evaluated_twice(spark, sf, F.col("id"), F.col("id"))
    return A.diff_transitions(A.diff_of_sides(both))


def run_diff_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Two result tables, as from two runs."""
    other = dict(policy="k_of_n", min_approved_blocks=1, max_flagged_blocks=1)
    a, b = (_decided(**params)(spark, sf).select("id", "Final_Decision") for params in ({}, other))
    return A.run_diff(a, b)


def diff_totals(spark: SparkSession, sf: str) -> DataFrame:
    both = _evaluated_twice(spark, sf, *_group_ids())
    return A.diff_totals(*(both.filter(F.col("side") == side) for side in ("a", "b")))


# -- result tables ------------------------------------------------------------------------


def results_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page: it begins behind the last key of the first one."""
    rows, key = _results()(spark, sf), F.col("ID").cast("int")
    first = R.page(rows, key, None, "REJECTED_FINAL")
    return R.page(rows, key, first.agg(F.max(key)).scalar(), "REJECTED_FINAL")


def highlight(spark: SparkSession, sf: str) -> DataFrame:
    return engine(spark).highlight(articles(spark, sf)).select("id", *R.HIGHLIGHTED)


def highlight_regex(spark: SparkSession, sf: str) -> DataFrame:
    """A regex that also matches nothing: what it does match is marked."""
    return engine(spark, "any_length").highlight(articles(spark, sf)).select("id", *R.HIGHLIGHTED)


def term_hits_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The dictionary as a table, joined with the texts' words."""
    key = (spark.sparkContext.applicationId, "joined")
    if key not in _engines:
        params = Params(block_order=X.BLOCKS)
        _engines[key] = TriageEngine.build(X.raw_terms(spark, X.TERMS), params, matching="join", row_key="id")
    e = _engines[key]
    return e.hits(e.store(articles(spark, sf)), "id").select(
        "id", "block", "kind", "term", "level", "section", "match_type", "source_row"
    )


def normalized_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Terms and texts under the same normalisation rules."""
    e = engine(spark, "normalized")
    ruled = TriageEngine(e.params, e.term_set, RULES)
    return ruled.hits(articles(spark, sf), "id").select("id", "block", "kind", "term", "section")


def proximity_units(spark: SparkSession, sf: str) -> DataFrame:
    """Units of a user: with a named group, with an open bound, and one that is no regex."""

    def under(unit: str) -> DataFrame:
        found = engine(spark, "proximity", token_unit=unit).hits(articles(spark, sf), "id")
        found = found.filter("match_type = 'proximity'").withColumn("components", F.array_join("components", "+"))
        return found.select("id", "term", "section", "components", F.lit(unit).alias("unit"))

    return reduce(DataFrame.unionByName, map(under, UNITS))


def inline_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions of a configuration that brings its own blocks and pre-screen."""
    none = spark.createDataFrame([], X.RAW_SCHEMA)
    e = TriageEngine.build(none, Params(block_order=X.BLOCKS), T.inline_terms(spark, INLINE))
    return e.decide(articles(spark, sf)).select("id", "Final_Decision", "Decision_Reason")


def _with_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of one file: a place is a document's number there."""
    place, error = S.PLACES
    where = F.struct(F.lit("documents").alias("file"), F.lit(0).alias("split"), F.col("doc_id").alias("read"))
    docs = X.articles(spark, sf, "doc_id").withColumns(
        {place: where, error: F.when(F.col("doc_id") % 50 == 7, F.lit("bad record"))}
    )
    return results_with_errors(engine(spark), docs.drop("doc_id"), timestamp=False)


def error_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Which limits on the share of failed records stop a run."""
    n = A.totals(_with_errors(spark, sf)).first()

    def stops(limit: float, policy: str) -> bool:
        try:
            R.check_error_rate(n["n_total"], n["n_error"], Params(max_error_rate=limit, error_policy=policy))
        except RuntimeError:
            return True
        return False

    cases = [(limit, policy) for limit in (-1.0, 0.0, 0.01, 0.05) for policy in ("flag", "fail")]
    return spark.createDataFrame([(*c, stops(*c)) for c in cases], "max_rate double, policy string, stops boolean")


def merged_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of a configuration before those of a table: one block has both, the table's pre-screen counts."""
    table = X.raw_terms(spark, [t for t in X.TERMS if t[0] != "FUNC"])
    e = TriageEngine.build(table, Params(block_order=X.BLOCKS), T.inline_terms(spark, INLINE))
    return e.decide(articles(spark, sf)).select("id", "Final_Decision", "Decision_Reason")


def no_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary that is a pre-screen only."""
    e = TriageEngine.build(X.raw_terms(spark, [t for t in X.TERMS if t[0] == "GLOBAL"]), Params())
    return e.decide(articles(spark, sf)).select("id", "Final_Decision", "Decision_Reason")


def article_detail(spark: SparkSession, sf: str) -> DataFrame:
    """What there is to say of one article, long values cut."""
    return R.detail(_results(fail_fast=False)(spark, sf), "ID", "7", columns=7, length=30)


def stream_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as a stream of files: decisions counted in state until all files are read."""
    docs = S.stream_parquet(spark, f"{sf}/documents.parquet")
    results = triage_stream(engine(spark), X.as_articles(docs))
    at = scratch(spark)
    count_decisions(results, f"{at}/counts", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/counts")


def error_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every fiftieth record cannot be read; it is in the results all the same."""
    return _with_errors(spark, sf).select("ID", "Final_Decision", "Decision_Reason")


def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    counted = A.totals(_with_errors(spark, sf))
    return counted.select("n_total", "n_valid", "n_error", _round("error_rate", 6))


def sample_preview(spark: SparkSession, sf: str) -> DataFrame:
    """What can be said of a sample: its size, that its rows are articles, that it can be drawn again."""
    docs, e = articles(spark, sf), engine(spark)
    drawn = e.preview(docs, 50, 42).select("ID", "Final_Decision")
    again = R.sample_articles(docs.repartition("id"), 50, 42).select(F.col("id").alias("again"))
    decided = e.decide(docs).select(F.col("id").alias("known"), F.col("Final_Decision").alias("d"))
    same = (F.col("ID") == F.col("known")) & (F.col("Final_Decision") == F.col("d"))
    joined = drawn.join(decided, same, "left").join(again, F.col("ID") == F.col("again"), "left")
    return joined.agg(
        F.count("*").alias("n_rows"), F.count("known").alias("n_as_in_run"), F.count("again").alias("n_again")
    )


def input_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, and whether the fingerprint stays the same in another order and differs for other rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = MF.table_fingerprint(docs)
    other = MF.table_fingerprint(docs.repartition("doc_id")).select(F.col("hash").alias("moved"))
    less = docs.withColumn("lang", F.when(F.col("doc_id") > 0, F.col("lang")))
    less = MF.table_fingerprint(less).select(F.col("hash").alias("changed"))
    one = lambda df: df.withColumn("k", F.lit(1))
    joined = one(found).join(one(other), "k").join(one(less), "k")
    return joined.select(
        "n_rows", (F.col("hash") == F.col("moved")).alias("order_free"), (F.col("hash") != F.col("changed")).alias("tells_nulls")
    )


def run_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest of a run over the documents, without what depends on time and place."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = MF.table_fingerprint(docs).first()
    inputs = {"input_file": "documents", "input_hash": found["hash"]}
    m = MF.manifest(spark, Params(), X.BLOCKS, found["n_rows"], 2.0, inputs)
    return m.select(
        "protocol_version",
        "triage_version",
        "inputs.input_file",
        F.length("inputs.input_hash").alias("hash_length"),
        "configuration.decision_policy",
        F.array_join("configuration.domain_blocks.id", ",").alias("blocks"),
        "processing.total_articles",
        "processing.articles_per_second",
    )


def manifest_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest per document, of several versions and degrees of completeness."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    i = F.col("doc_id")
    version = F.get(F.array(*map(F.lit, ("2.1", "2.0", "1.0", "3.0"))), (i % 4).cast("int"))
    body = F.struct(
        version.alias("protocol_version"),
        F.when(i % 3 > 0, F.lit("s")).alias("schema_id"),
        F.concat(F.lit("run_"), i.cast("string")).alias("execution_id"),
        F.when(i % 5 > 0, F.lit("2020-01-01")).alias("generated_at"),
        F.lit("3").alias("triage_version"),
        F.struct(F.col("source").alias("input_file")).alias("inputs"),
        F.when(i % 7 > 0, F.struct(F.lit("strict").alias("decision_policy"))).alias("configuration"),
        F.struct(F.col("n_chars").alias("total_articles")).alias("processing"),
        F.concat(F.lit("[draft] {"), "source").alias("note"),
        F.col("n_chars").alias("size"),
        (i % 2 == 0).alias("final"),
    )
    return docs.select(i.alias("doc_id"), F.to_json(body).alias("document"))


def manifest_check(spark: SparkSession, sf: str) -> DataFrame:
    checked = MF.validate_manifests(manifest_documents(spark, sf))
    return checked.select("doc_id", F.array_join("errors", "; ").alias("errors"))


def manifest_migration(spark: SparkSession, sf: str) -> DataFrame:
    migrated = MF.migrate_manifests(manifest_documents(spark, sf))
    checked = MF.validate_manifests(migrated, "migrated")
    # Read with their types: a number that became a text would be null here.
    kept = F.from_json("migrated", "note string, size bigint, final boolean", {"mode": "FAILFAST"})
    return checked.withColumn("kept", kept).select(
        "doc_id",
        "error",
        F.when(F.col("migrated").isNotNull(), F.size("errors")).alias("n_errors"),
        F.get_json_object("migrated", "$.inputs.input_file").alias("input_file"),
        F.get_json_object("migrated", "$.execution_id").alias("execution_id"),
        F.get_json_object("migrated", "$.schema_id").alias("schema_id"),
        F.col("kept.note").alias("note"),
        F.col("kept.size").alias("size"),
        F.col("kept.final").alias("final"),
    )


def queries() -> dict[str, Query]:
    noise = dict(
        noise_profile="strict", min_unique_terms=2, min_sections_with_hits=2, require_non_weak=True,
        fail_fast=False,
    )
    return {
        "triage": triage,
        "articles_view": articles_view,
        "tag_lists": tag_lists,
        "column_profile": column_profile,
        "normalize_text": normalize_text,
        "compound_pairs": compound_pairs,
        "terms_dedup": terms_dedup,
        "terms_duplicates": terms_duplicates,
        "terms_conflicts": terms_conflicts,
        "terms_lint": terms_lint,
        "terms_broad": terms_broad,
        "terms_blocks": terms_blocks,
        "terms_block_lint": terms_block_lint,
        "terms_browse": terms_browse,
        "terms_no_positives": terms_no_positives,
        "terms_bad_regexes": terms_bad_regexes,
        "config_checks": config_checks,
        "csv_exchange": csv_exchange,
        "csv_encodings": csv_encodings,
        "error_gate": error_gate,
        "merged_terms": merged_terms,
        "no_blocks": no_blocks,
        "article_detail": article_detail,
        "norm_rules": norm_rules,
        "norm_rule_conflicts": norm_rule_conflicts,
        "term_hits": _hits(
            "fixture", "block", "kind", "term", "level", "section", "match_type", "source_row"
        ),
        "wildcard_hits": _hits("wildcards", "block", "term", "section"),
        "proximity_hits": lambda spark, sf: _hits("proximity", "term", "section", "match_type", "components")(
            spark, sf
        ).withColumn("components", F.array_join("components", "+")),
        "proximity_units": proximity_units,
        "regex_hits": _hits("regexes", "block", "kind", "term", "section"),
        "scoped_hits": _hits("scoped", "block", "kind", "term", "section"),
        "anti_hits": lambda spark, sf: engine(spark)
        .of_kinds("anti", "flag")
        .hits(articles(spark, sf), "id")
        .select("id", "block", "kind", "term", "section"),
        "term_hits_joined": term_hits_joined,
        "stream_decisions": stream_decisions,
        "normalized_hits": normalized_hits,
        "inline_terms": inline_terms,
        "error_rows": error_rows,
        "section_scores": section_scores,
        "block_scores": block_scores,
        "noise_filter": _block_status(**noise),
        "block_status": _block_status(fail_fast=False),
        "t0_prescreen": t0_prescreen,
        "fail_fast": _block_status(),
        "decision_special": _decision(),
        "decision_special_all_blocks": _decision(fail_fast=False),
        "decision_strict": _decision(policy="strict"),
        "decision_strict_all_blocks": _decision(policy="strict", fail_fast=False),
        "decision_k_of_n": _decision(policy="k_of_n", min_approved_blocks=1, max_flagged_blocks=1),
        "decision_distribution": lambda spark, sf: A.decision_distribution(
            _decided(policy="k_of_n", min_approved_blocks=1, max_flagged_blocks=1)(spark, sf)
        ).select("Final_Decision", "n", _round("pct")),
        "status_distribution": status_distribution,
        "block_performance": block_performance,
        "score_distribution": score_distribution,
        "level_distribution": level_distribution,
        "run_totals": run_totals,
        "report": report,
        "report_dotted_block": lambda spark, sf: A.report(_results("dotted")(spark, sf)).select(
            "part", "block", "name", _round("value"), _round("pct")
        ),
        "term_coverage": _coverage,
        "term_coverage_all_blocks": lambda spark, sf: _coverage(spark, sf, ignore_fail_fast=True),
        "coverage_of_results": lambda spark, sf: A.coverage_of_results(_results("broad")(spark, sf)),
        "dead_terms": dead_terms,
        "broad_terms": broad_terms,
        "section_distribution": section_distribution,
        "block_discrimination": block_discrimination,
        "suggestions": suggestions,
        "coverage_export": coverage_export,
        "run_diff": run_diff,
        "run_diff_stored": run_diff_stored,
        "diff_transitions": diff_transitions,
        "diff_totals": diff_totals,
        "results": _results(),
        "results_page": results_page,
        "highlight": highlight,
        "highlight_regex": highlight_regex,
        "sample_preview": sample_preview,
        "input_fingerprint": input_fingerprint,
        "run_manifest": run_manifest,
        "manifest_check": manifest_check,
        "manifest_migration": manifest_migration,
    }
