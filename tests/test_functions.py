import datetime as dt

import pytest
from pyspark.sql import functions as F

from factloom.functions.checked import computed_column
from factloom.functions.hashing import content_digest, row_hash
from factloom.functions.numbers import half_even, number_label, parse_number, percent
from factloom.functions.periods import (
    epoch_micros, fiscal_label, fiscal_quarter, fiscal_range, fiscal_year)


def one(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_parse_number(spark):
    cells = ["1,234", " 5 ", "No data", "", None, "-2.5", "1e3", "3d", "\t7\n", "1.", ".5"]
    assert one(spark, cells, "string", parse_number) == [
        1234.0, 5.0, None, None, None, -2.5, 1000.0, None, 7.0, 1.0, 0.5]
    assert one(spark, ["x", None, "4"], "string", lambda c: parse_number(c, "zero")) == [0, 0, 4]
    with pytest.raises(ValueError):
        parse_number(F.lit("1"), "guess")


def test_fiscal_calendar(spark):
    days = [dt.datetime(1999, 6, 30), dt.datetime(1999, 7, 1), dt.datetime(2000, 1, 1),
            dt.datetime(2000, 9, 30), dt.datetime(2009, 12, 31)]
    assert one(spark, days, "timestamp_ntz", fiscal_year) == [
        "1998-99", "1999-00", "1999-00", "2000-01", "2009-10"]
    assert one(spark, days, "timestamp_ntz", fiscal_quarter) == [4, 1, 3, 1, 2]
    assert fiscal_range("1999-00") == (dt.datetime(1999, 7, 1), dt.datetime(2000, 7, 1))
    assert one(spark, ["1982-1983", "2023-24", " 1999-2000 "], "string", fiscal_label) == [
        "1982-83", "2023-24", "1999-00"]


def test_epoch_micros_ignores_the_session_zone(spark):
    stamp = dt.datetime(2024, 3, 31, 2, 30, 0, 123456)
    expected = (stamp - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert one(spark, [stamp], "timestamp_ntz", epoch_micros) == [expected]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_rounding_ties_go_to_even(spark):
    assert one(spark, [0.5, 1.5, 2.5, -0.5], "double", half_even) == [0, 2, 2, 0]


def test_percent_has_no_value_without_a_base(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (1.0, 8.0)], "a double, b double")
    assert [r[0] for r in df.select(percent(F.col("a"), F.col("b"), 1)).collect()] == [
        None, None, 12.5]


def test_number_label(spark):
    assert one(spark, [1235.0, 0.0, 1234.5, 100.25, None, 1000000.0, -12.3], "double",
               number_label) == ["1,235", "0", "1,234.5", "100.25", "no data", "1,000,000",
                                 "-12.3"]


def checked(spark, formula, **env):
    names = list(env)
    df = spark.createDataFrame([tuple(env[n] for n in names)],
                               ", ".join(f"{n} double" for n in names))
    row = computed_column(df, formula).first()
    return row["value"], row["error"]


def test_computed_column_values(spark):
    assert checked(spark, lambda x: x["a"] / x["b"] * 100, a=1.0, b=3.0) == (33.33, None)
    assert checked(spark, lambda x: -x["a"] + 2 ** x["b"], a=1.0, b=3.0) == (7.0, None)
    assert checked(spark, lambda x: 10 - x["a"] - x["b"], a=1.0, b=3.0) == (6.0, None)


def test_computed_column_errors(spark):
    assert checked(spark, lambda x: x["a"] / x["b"], a=1.0, b=0.0) == (None, "division by zero")
    assert checked(spark, lambda x: 1 + x["a"] / (x["b"] - 1), a=1.0, b=1.0) == (
        None, "division by zero")
    assert checked(spark, lambda x: x["b"] ** -1, b=0.0) == (None, "division by zero")
    assert checked(spark, lambda x: x["a"] ** 999, a=1e9) == (None, "result out of range")
    assert checked(spark, lambda x: 1 / x["a"] ** 999, a=1e9) == (None, "result out of range")
    assert checked(spark, lambda x: (-x["a"]) ** 0.5, a=2.0) == (None, "result out of range")
    assert checked(spark, lambda x: x["nope"] + 1, a=1.0) == (None, "unknown column nope")
    assert checked(spark, lambda x: x["a"] + 1, a=None) == (None, "no value in a")
    with pytest.raises(TypeError):
        checked(spark, lambda x: x["a"] + "1", a=1.0)


def test_digest_ignores_order_and_partitions_but_not_copies(spark):
    a = spark.createDataFrame([(i % 7, f"n{i % 5}") for i in range(100)], "x int, y string")
    digest = content_digest(a, ["x", "y"]).first()
    for other in (a.repartition(7, "x"), a.orderBy(F.desc("y")), a.coalesce(1)):
        assert content_digest(other, ["x", "y"]).first() == digest
    assert content_digest(a.union(a.limit(1)), ["x", "y"]).first() != digest
    doubled = a.union(a)
    assert content_digest(doubled, ["x", "y"]).first()["content_digest"] != digest["content_digest"]
    empty = content_digest(a.limit(0), ["x", "y"]).first()
    assert empty["row_count"] == 0 and len(empty["content_digest"]) == 64


def test_row_hash_fields_cannot_run_together(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "-"), ("-", None)],
                               "x string, y string")
    hashes = [r[0] for r in df.select(row_hash(df, ["x", "y"])).collect()]
    assert len(set(hashes)) == 4
