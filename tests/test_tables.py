import pytest

from factloom.sources.tables import NAMES, Tables

PATH = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", NAMES)
def test_declared_schema_is_the_stored_one(spark, name):
    stored = spark.read.parquet(f"{PATH}/{name}.parquet")
    assert getattr(Tables(spark, PATH), name).dtypes == stored.dtypes


def test_unknown_table(spark):
    with pytest.raises(AttributeError):
        Tables(spark, PATH).sales
