"""Writing the results of a run."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from relinker.functions import urls
from relinker.operators.consensus import by_score, redirects
from relinker.sources.tables import VERSION, current_version


def run_name(mapping_df: DataFrame, at: datetime) -> str:
    """``<yyyymmdd_HHMM>_<domain>_redirect_map``; the domain is that of the first row by score."""
    stamp = at.strftime("%Y%m%d_%H%M")
    first = by_score(mapping_df).select(urls.domain_key("url_404").alias("domain")).first()
    return f"{stamp}_{first['domain']}_redirect_map" if first and first["domain"] else f"{stamp}_redirect_map"


def write_outputs(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> str:
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(f"{folder}/{name}")
    return folder


def write_mapping(mapping_df: DataFrame, stats: DataFrame, base: str, at: datetime, fmt: str = "parquet",
                  metrics: DataFrame | None = None) -> str:
    """Mapping, redirects and algorithm statistics, the first two by descending score.

    With ``metrics`` the quality numbers are written in place of the algorithm statistics.
    """
    tables = {
        "mapping": by_score(mapping_df), "redirects": by_score(redirects(mapping_df)),
        **({"algorithm_stats": stats} if metrics is None else {"metrics": metrics}),
    }
    return write_outputs(tables, f"{base}/{run_name(mapping_df, at)}", fmt)


def append_history(rows: DataFrame, path: str) -> None:
    """Adds rows to the current version of a history."""
    _write_version(rows, path, current_version(rows.sparkSession, path) or 0)


def write_history(rows: DataFrame, path: str) -> None:
    """Writes a whole history, such as one that ``retain`` has cut, as a new version; readers then see only that one.

    The old version stays until its folder is removed, so the new rows may well be read from it.
    """
    version = current_version(rows.sparkSession, path)
    _write_version(rows, path, 0 if version is None else version + 1)


def _write_version(rows: DataFrame, path: str, version: int) -> None:
    rows.drop(VERSION).withColumn(VERSION, F.lit(version)).write.mode("append").partitionBy(VERSION).parquet(path)
