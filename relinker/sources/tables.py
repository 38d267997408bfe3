"""Reading URL tables, check logs and match history."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from relinker import schemas
from relinker.functions import urls


VERSION = "history_version"


def load_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Reads a parquet, CSV or JSON table and refuses an empty one (one row is looked at)."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.load(path)
    if df.isEmpty():
        raise ValueError(f"table {path} has no rows")
    return df


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Checks column names without regard to case; runs no job."""
    present = {c.strip().lower() for c in df.columns}
    missing = [c for c in required if c.lower() not in present]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def prepare_urls(df: DataFrame, url_column: str, order: Column, clean: bool = False) -> DataFrame:
    """One row per distinct non-null URL: ``(url, idx)`` with idx = smallest position of the URL.

    ``order`` gives the input position; it is carried explicitly because rows of a DataFrame have
    no order, and later ties go to the smallest position.
    """
    names = {c.strip(): c for c in df.columns}
    if url_column not in names:
        raise ValueError(f"missing columns: {url_column}")
    url = F.col(f"`{names[url_column]}`").cast("string")
    rows = df.select(url.alias("url"), order.cast("bigint").alias("idx")).where(F.col("url").isNotNull())
    if clean:
        rows = rows.withColumn("url", urls.clean_url("url"))
    return rows.groupBy("url").agg(F.min("idx").alias("idx"))


def empty_history(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.HISTORY)


def normalise_source(history: DataFrame) -> DataFrame:
    """A history without a source column, or with nulls in it, counts as written by the system."""
    if "source" not in history.columns:
        history = history.withColumn("source", F.lit("auto"))
    return history.withColumn("source", F.coalesce("source", F.lit("auto")))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def current_version(spark: SparkSession, path: str) -> int | None:
    """The newest version of a stored history; versions are folders, so no rows are read."""
    stored = _stored(spark, path)
    if stored is None:
        return None
    return stored.select(F.max(VERSION)).first()[0] if VERSION in stored.columns else 0


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a history; an absent one is empty, and one written without versions is read as it is."""
    stored = _stored(spark, path)
    if stored is None:
        return empty_history(spark)
    if VERSION in stored.columns:
        stored = stored.where(F.col(VERSION) == current_version(spark, path)).drop(VERSION)
    return normalise_source(stored)
