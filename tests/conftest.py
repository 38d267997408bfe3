import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample(spark):
    """Three broken and five live URLs with known votes."""
    base = "https://www.example.com"
    broken = spark.createDataFrame([
        (f"{base}/products/old-widget", 0), (f"{base}/about/team/john-doe", 1), (f"{base}/promo/expired", 2),
    ], "url string, idx bigint")
    live = spark.createDataFrame([
        (f"{base}/products/new-widget", 0), (f"{base}/products", 1), (f"{base}/about/team", 2),
        (f"{base}/about-us/staff", 3), (f"{base}/", 4),
    ], "url string, live_idx bigint")
    return broken, live
