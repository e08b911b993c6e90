"""One key with a third or more of all rows: same answers, and the large side of a
join is split instead of landing in one task."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import quality as Q
from factloom.operators.citations import resolve_pointers
from factloom.operators.sequence import latest_by_key, numbered
from factloom.plans import lineage as L

N = 120_000


@pytest.fixture
def small_partitions(spark):
    """Shuffle joins only, and a skew threshold these tables exceed."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(spark):
    """Ids 0..N-1; key 0 holds every second row, the rest spread over 1..999."""
    i = F.col("id")
    key = F.when(i % 2 == 0, 0).otherwise(i % 999 + 1).cast("bigint")
    return spark.range(0, N, 1, 8).select(key.alias("artifact_id"), "id")


def executed(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_a_call_cited_by_half_of_all_pointers(spark, small_partitions):
    pointers = hot(spark).select("artifact_id", "id", F.lit("0.1.0.total").alias("pointer"))
    calls = spark.range(0, 500).select(
        F.col("id").alias("artifact_id"), F.lit(1).alias("seq"), F.lit("query_dataset").alias("tool"),
        F.format_string('{"total":%d}', F.col("id")).alias("result"))
    rows, plan = executed(resolve_pointers(pointers, calls))
    assert "skew=true" in plan
    assert len(rows) == N
    for r in rows:
        assert r["value"] == (str(r["artifact_id"]) if r["artifact_id"] < 500 else None)


def test_an_artifact_with_half_of_all_calls(spark, small_partitions):
    artifacts = spark.range(0, 2000).select(
        F.col("id").alias("artifact_id"), F.lit(1).alias("version"), F.lit("{}").alias("spec_json"),
        F.lit(1).alias("dataset_id"))
    calls = hot(spark).select("artifact_id", F.col("id").cast("int").alias("seq"),
                              F.lit("compute").alias("tool"), F.lit("{}").alias("output_json"))
    rows, plan = executed(L.load_dashboard(artifacts, calls))
    assert "skew=true" in plan
    assert len(rows) == N + 1000  # artifacts 1000..1999 have no calls
    assert sum(r["seq"] is None for r in rows) == 1000


def test_numbering_a_hot_key(spark, small_partitions):
    out = numbered(hot(spark), ["artifact_id"], ["id"], F.floor(F.col("id") / 1000))
    checks = out.groupBy("artifact_id").agg(
        F.min("seq").alias("low"), F.max("seq").alias("high"), F.count_distinct("seq").alias("n"),
        F.corr(F.col("id").cast("double"), F.col("seq").cast("double")).alias("r")).collect()
    assert all(c["low"] == 1 and c["high"] == c["n"] and c["r"] > 0.999 for c in checks)
    sizes = out.withColumn("task", F.spark_partition_id()).filter("artifact_id = 0").groupBy(
        "task").count().agg(F.max("count")).first()[0]
    assert sizes < N / 4  # the hot key's N / 2 rows are spread over tasks


def test_checks_reduce_before_they_join(spark, small_partitions):
    rows = hot(spark)
    parents = spark.range(1, 500)
    orphans = {r["key"]: r["orphan_rows"] for r in Q.fk_check(
        rows, "artifact_id", parents, "id").collect()}
    assert orphans[0] == N // 2 and 499 not in orphans and 500 in orphans
    latest = {r["artifact_id"]: r["id"] for r in latest_by_key(rows, ["artifact_id"], ["id"]).collect()}
    assert latest[0] == N - 2
    copies = {r["artifact_id"]: r["copies"] for r in Q.duplicate_check(rows, ["artifact_id"]).collect()}
    assert copies[0] == N // 2
