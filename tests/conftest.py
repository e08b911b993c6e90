import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Collect a DataFrame as a sorted list of tuples, NULLs first."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()),
                      key=lambda r: [(v is not None, v) for v in r])

    return collect


FACT = ("entity_key string, entity_name string, fy string, quarter int, measure_group string, "
        "measure string, bucket string, value double, derived boolean, window_mode string, "
        "portfolio string")


@pytest.fixture(scope="session")
def fact_table(spark):
    """Facts from (name, fy, quarter, measure, bucket, value) tuples."""

    def make(*entries, portfolio=None):
        out = []
        for name, fy, quarter, measure, bucket, value in entries:
            total = name == "Total"
            out.append((
                "_all" if total else name, name, fy, quarter, "requests", measure, bucket,
                float(value), total, "fy" if quarter is None else "single_quarter",
                (portfolio or {}).get(name)))
        return spark.createDataFrame(out, FACT)

    return make
