"""A whole run from files to files, and a look at the set-up before it."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions.text import NormRules
from winnow.operators import analytics as A
from winnow.operators import results as R
from winnow.operators import terms as T
from winnow.params import Params, check_config, load_config, wanted_blocks
from winnow.plans import manifest as MF
from winnow.plans.engine import TriageEngine, require_articles
from winnow.sources import sinks, tables

NO_TERMS = (
    "block string, kind string, term string, level string, section_scope string, is_regex string, "
    "normalization_type string, normalization_target string, source_row bigint"
)


@dataclass(frozen=True)
class Setup:
    """What a configuration, a term table and an input make together."""

    cfg: dict
    params: Params
    raw_terms: DataFrame
    inline: DataFrame
    table: DataFrame

    @property
    def articles(self) -> DataFrame:
        """Articles with their place in the input and what is wrong with them (`tables.PLACES`)."""
        return tables.as_articles(self.table, self.cfg.get("fields"), *tables.PLACES)

    def engine(self) -> TriageEngine:
        rules = NormRules.from_dict(self.cfg.get("normalization_rules") or {})
        return TriageEngine.build(self.raw_terms, self.params, self.inline, rules=rules)

    def routed(self) -> T.TermSet:
        terms = self.inline.unionByName(T.clean(self.raw_terms, self.params))
        return T.route(terms, self.params.block_order)


def set_up(
    spark: SparkSession,
    input_path: str,
    config_path: str,
    terms_path: str | None = None,
    encoding: str | None = None,
    multi_line: bool = True,
) -> Setup:
    """`encoding` and `multi_line` are those of `tables.read_delimited`, for the input."""
    cfg = load_config(spark, config_path)
    params = Params.from_dict(cfg.get("global", {}))
    if terms_path:
        raw = tables.read_terms(spark, terms_path)
    else:
        raw = spark.createDataFrame([], NO_TERMS)
        params = params.with_(block_order=wanted_blocks(cfg) or None)
    table = tables.read_table(spark, input_path, encoding=encoding, multi_line=multi_line, places=True)
    return Setup(cfg, params, raw, T.inline_terms(spark, cfg), table)


def inspect(setup: Setup) -> tuple[list[tuple[str, str]], DataFrame, DataFrame]:
    """Problems of the configuration, findings about the terms, and the input's profile."""
    routed = setup.routed()
    counts = {r["block"]: r["n_pos"] for r in T.block_counts(routed.terms).collect()}
    wanted = setup.params.block_order or routed.blocks
    issues = check_config(setup.cfg, {b: counts.get(b, 0) if b in routed.blocks else None for b in wanted})
    return issues, T.lint(setup.raw_terms, setup.params), tables.input_profile(setup.table, setup.cfg.get("fields"))


def results_with_errors(
    engine: TriageEngine, articles: DataFrame, id_output: str = "ID", timestamp: bool = True
) -> DataFrame:
    """The result table of articles with their places (`tables.PLACES`): failed rows are flagged.

    A failed row is named by its number in the input. Only failed rows are joined with what their
    number follows from; articles are decided without a join.
    """
    place, error = tables.PLACES
    good, failed = R.split_errors(articles, error, place)
    failed = tables.numbered(failed, articles, place, "number_").withColumn("number_", F.col("number_") + 1)
    errors = R.error_results(failed, "number_", engine.params, id_output, error, timestamp)
    return R.with_errors(engine.run(good, id_output, timestamp), errors)


def run_triage(
    spark: SparkSession,
    input_path: str,
    config_path: str,
    terms_path: str | None,
    output_dir: str,
    encoding: str | None = None,
    multi_line: bool = True,
) -> dict[str, str]:
    """Decide all articles and write results, findings, settings, report and manifest.

    Rows that cannot be read become flagged results; too many of them stop the run before
    anything is written. The report is made from the written results, so that articles are
    evaluated once. Returns where everything is.
    """
    begin = time.time()
    setup = set_up(spark, input_path, config_path, terms_path, encoding, multi_line)
    articles = setup.articles
    require_articles(articles)
    engine = setup.engine()
    counted = articles.agg(
        F.count("*").alias("n_total"), F.count(tables.PLACES[1]).alias("n_error")
    ).first()
    R.check_error_rate(counted["n_total"], counted["n_error"], setup.params)
    id_output = (setup.cfg.get("fields") or {}).get("id_output", "ID")
    written = sinks.write_results(results_with_errors(engine, articles, id_output), output_dir, setup.cfg)
    stored = spark.read.parquet(written["parquet"])
    written |= {n: f"{output_dir}/{n}" for n in ("report", "manifest", "findings", "settings")}
    T.lint(setup.raw_terms, setup.params).write.parquet(written["findings"])
    audit = json.dumps(MF.config_audit(setup.params), default=str)
    spark.range(1).select(F.lit(audit).alias("value")).write.text(written["settings"])
    A.report(stored).write.parquet(written["report"])
    source = MF.table_fingerprint(setup.table).first()["hash"]
    inputs = {"input_file": input_path, "input_hash": source, "terms_file": terms_path or "n/a"}
    if terms_path:
        inputs["terms_hash"] = MF.table_fingerprint(setup.raw_terms).first()["hash"]
    MF.manifest(
        spark, setup.params, engine.blocks, counted["n_total"], time.time() - begin, inputs, written["parquet"]
    ).write.json(written["manifest"])
    return written
