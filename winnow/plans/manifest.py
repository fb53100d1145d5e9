"""Run manifests: what went in, what came out, and how to read older ones."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions.text import named
from winnow.params import VERSION, Params

# Manifest format.
CURRENT = "2.1"
SCHEMA_ID = "rsl-triage-protocol-v2.1"
MIGRATABLE = ("1.0", "2.0", CURRENT)
ROOT_KEYS = (
    "protocol_version", "schema_id", "execution_id", "generated_at", "triage_version", "inputs",
    "configuration", "processing", "artifacts", "reproducibility",
)
METHODOLOGY = {"scoring": "levels and section weights, thresholds by level", "normalization": "rules"}

MANIFEST = """
    protocol_version string, schema_id string, execution_id string, generated_at string,
    triage_version string,
    inputs struct<input_file:string,input_hash:string,terms_file:string,terms_hash:string,config_hash:string>,
    configuration struct<decision_policy:string,domain_blocks:array<struct<id:string,label:string>>,
        fail_fast:boolean,enable_special_approval:boolean,level_scores:map<string,int>,
        section_weights:map<string,double>,approval_thresholds:map<string,double>,
        flagging_thresholds:map<string,double>>,
    processing struct<total_articles:bigint,processing_time_seconds:double,articles_per_second:double,
        sample_mode:boolean,sample_size:bigint,population_size:bigint,sample_seed:bigint>,
    artifacts struct<results_path:string>,
    reproducibility struct<deterministic_engine:boolean>,
    methodology struct<scoring:string,normalization:string>
"""


def config_hash(params: Params) -> str:
    """First 16 hex digits of the SHA-256 of the parameters in canonical form."""
    text = json.dumps(dataclasses.asdict(params), sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and content hash, whatever the order of the rows.

    A sum over row hashes keeps what an exclusive-or would lose: equal rows in pairs.
    """
    # As JSON with its nulls: a hash of columns passes over nulls, wherever they stand.
    row = F.xxhash64(F.to_json(F.struct(*map(named, df.columns)), {"ignoreNullFields": "false"}))
    summed = F.sum(row.cast("decimal(38,0)")).cast("string")
    return df.agg(
        F.count("*").alias("n_rows"),
        F.substring(F.sha2(F.concat_ws(":", F.count("*").cast("string"), summed), 256), 1, 16).alias("hash"),
    )


def manifest(
    spark: SparkSession,
    params: Params,
    blocks: tuple[str, ...],
    total_articles: int,
    seconds: float,
    inputs: dict[str, str],
    results_path: str = "",
    sample: dict[str, int] | None = None,
) -> DataFrame:
    """One row that describes a run, to append to a manifest table or write as JSON."""
    processing = {
        "total_articles": total_articles,
        "processing_time_seconds": float(seconds),
        "articles_per_second": total_articles / seconds if seconds else 0.0,
        "sample_mode": bool(sample),
        **(sample or {}),
    }
    body = {
        "protocol_version": CURRENT,
        "schema_id": SCHEMA_ID,
        "execution_id": f"run_{uuid.uuid4().hex[:12]}",
        "generated_at": datetime.now(timezone.utc).isoformat(),
        "triage_version": VERSION,
        "inputs": {**inputs, "config_hash": config_hash(params)},
        "configuration": {
            "decision_policy": params.policy,
            "domain_blocks": [{"id": b, "label": b} for b in blocks],
            "fail_fast": params.fail_fast,
            "enable_special_approval": params.special_rule,
            "level_scores": {str(k): v for k, v in params.level_scores.items()},
            "section_weights": params.section_weights,
            "approval_thresholds": {str(k): v for k, v in params.approval.items()},
            "flagging_thresholds": {str(k): v for k, v in params.flagging.items()},
        },
        "processing": processing,
        "artifacts": {"results_path": results_path},
        "reproducibility": {"deterministic_engine": True},
        "methodology": METHODOLOGY,
    }
    parsed = F.from_json(F.lit(json.dumps(body)), MANIFEST)
    return spark.range(1).select(parsed.alias("m")).select("m.*")


def config_audit(params: Params) -> dict:
    """The parameters with a record of when and by what they were written."""
    return {
        **dataclasses.asdict(params),
        "_metadata": {
            "export_timestamp": datetime.now(timezone.utc).isoformat(),
            "version": VERSION,
            "config_hash": config_hash(params),
        },
    }


def _root(document: Column, key: str) -> Column:
    return F.get_json_object(document, f"$.{key}")


def validate_manifests(documents: DataFrame, column: str = "document") -> DataFrame:
    """Adds `errors`: missing root keys and a version other than the current one."""
    doc = F.col(column)
    keys = F.json_object_keys(doc)
    missing = [
        F.when(~F.coalesce(F.array_contains(keys, k), F.lit(False)), F.lit(f"Missing root key: '{k}'"))
        for k in ROOT_KEYS
    ]
    version = _root(doc, "protocol_version")
    wrong = F.when(
        ~version.eqNullSafe(F.lit(CURRENT)),
        F.concat(F.lit(f"Version mismatch: expected {CURRENT}, got "), F.coalesce(version, F.lit("None"))),
    )
    return documents.withColumn("errors", F.array_compact(F.array(*missing, wrong)))


def migrate_manifests(documents: DataFrame, column: str = "document") -> DataFrame:
    """Documents of known versions in the current form; others get an `error` and no form.

    Keys that are already there are kept as they are, known or not.
    """
    doc = F.col(column)
    parsed = F.from_json(doc, "map<string,variant>")
    known = _root(doc, "protocol_version").isin(*MIGRATABLE)
    objects = {k: "{}" for k in ("inputs", "configuration", "processing", "artifacts", "reproducibility")}
    scalars = {
        "execution_id": F.concat(F.lit("run_migrated_"), F.substring(F.sha2(doc, 256), 1, 12)),
        "generated_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        "triage_version": F.lit(VERSION),
    }

    def quoted(text: Column) -> Column:
        json_struct = F.to_json(F.struct(text.alias("t")))
        return F.substring(json_struct, 6, F.length(json_struct) - 6)

    def member(key: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{key}":'), value)

    def absent(key: str) -> Column:
        return ~F.map_contains_key(parsed, key)

    added = [
        member("protocol_version", F.lit(f'"{CURRENT}"')),
        member("schema_id", F.lit(f'"{SCHEMA_ID}"')),
        *(F.when(absent(k), member(k, F.lit(v))) for k, v in objects.items()),
        *(F.when(absent(k), member(k, quoted(v))) for k, v in scalars.items()),
        F.when(absent("methodology"), member("methodology", F.lit(json.dumps(METHODOLOGY)))),
    ]
    # What is there already keeps its value and type.
    kept = F.transform(
        F.filter(
            F.map_entries(parsed), lambda e: ~e["key"].isin("protocol_version", "schema_id")
        ),
        lambda e: F.concat(
            quoted(e["key"]),
            F.lit(":"),
            F.coalesce(F.to_json(e["value"]), F.lit("null")),
        ),
    )
    body = F.concat(
        F.lit("{"), F.array_join(F.concat(F.array_compact(F.array(*added)), kept), ","), F.lit("}")
    )
    return documents.select(
        "*",
        F.when(known, body).alias("migrated"),
        F.when(
            ~F.coalesce(known, F.lit(False)),
            F.concat(F.lit("Unknown source version: "), F.coalesce(_root(doc, "protocol_version"), F.lit("None"))),
        ).alias("error"),
    )
