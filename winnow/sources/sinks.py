"""Writing results."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.text import named

_BOM = "\ufeff"


def export_options(cfg: dict[str, Any] | None = None) -> dict[str, Any]:
    """Output settings of a configuration, with defaults."""
    cfg = cfg or {}
    out = cfg.get("output") or {}
    return {
        "csv": bool(out.get("csv", False)),
        "csv_sep": out.get("csv_sep", cfg.get("sep", ";")),
        "csv_decimal": out.get("csv_decimal", cfg.get("decimal", ",")),
        "csv_float_format": out.get("csv_float_format", "%.2f"),
        "encoding": cfg.get("encoding", "utf-8-sig"),
    }


def _as_text(df: DataFrame, options: dict[str, Any]) -> DataFrame:
    """Numbers with decimals as text in the configured form."""

    def cell(name: str, kind: str) -> Column:
        col = named(name)
        if kind not in ("double", "float"):
            return col
        text = F.format_string(options["csv_float_format"], col)
        return F.when(col.isNotNull(), F.replace(text, F.lit("."), F.lit(options["csv_decimal"]))).alias(name)

    return df.select(*(cell(f.name, f.dataType.typeName()) for f in df.schema))


def write_csv(df: DataFrame, path: str, cfg: dict[str, Any] | None = None, mode: str = "error") -> None:
    """A folder of CSV files, as the tasks wrote them."""
    options = export_options(cfg)
    encoding, rows = options["encoding"], _as_text(df, options)
    if encoding.lower() == "utf-8-sig":
        # Each file begins with its header, so the mark goes before the first name.
        encoding, rows = "UTF-8", rows.toDF(_BOM + df.columns[0], *df.columns[1:])
    rows.write.mode(mode).csv(
        path, sep=options["csv_sep"], header=True, quote='"', escape='"', encoding=encoding,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def write_results(
    df: DataFrame, path: str, cfg: dict[str, Any] | None = None, mode: str = "error"
) -> dict[str, str]:
    """Parquet in one folder per decision, and CSV if the configuration asks for it."""
    written = {"parquet": f"{path}/parquet"}
    df.write.mode(mode).partitionBy("Final_Decision").parquet(written["parquet"])
    if export_options(cfg)["csv"]:
        written["csv"] = f"{path}/csv"
        stored = df.sparkSession.read.parquet(written["parquet"]).select(*df.columns)
        write_csv(stored, written["csv"], cfg, mode)
    return written
