"""What grows with the input: tasks, files, shuffles and samples, counted on small tables."""

import re

import pytest
from pyspark.sql import functions as F

from factloom.operators.sequence import placed
from factloom.plans import facts as facts_plan
from factloom.plans.facts import build_facts
from factloom.schema import FACT_COLUMNS, NATURAL_KEY
from factloom.sources import pages, snapshots
from factloom.sources.pages import PageIndex
from factloom.sources.snapshots import SnapshotStore
from factloom.sources.tables import Tables
from factloom.suite import load

@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders of 40 customers over four years, one line item each."""
    at = str(tmp_path_factory.mktemp("tables"))

    def put(name, schema, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")

    put("region", "r_regionkey int, r_name string", [(0, "ASIA")])
    put("nation", "n_nationkey int, n_name string, n_regionkey int", [(0, "JAPAN", 0)])
    put("customer", "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        [(i, f"Customer#{i}", 0, 0.0, "x") for i in range(40)])
    spark.range(800).selectExpr(
        "id AS o_orderkey", "id % 40 AS o_custkey", "element_at(array('F', 'P', 'O'), cast(id % 3 + 1 AS int)) AS o_orderstatus", "1.0D AS o_totalprice",
        "timestamp_ntz '1995-01-01 00:00:00' + make_dt_interval(cast(id % 1400 AS int)) AS o_orderdate", "'1-URGENT' AS o_orderpriority").write.parquet(f"{at}/orders.parquet")
    spark.range(800).selectExpr(
        "id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "1 AS l_linenumber", "1.0D AS l_quantity", "1.0D AS l_extendedprice", "0.0D AS l_discount", "0.0D AS l_tax",
        "'N' AS l_returnflag", "'O' AS l_linestatus", "timestamp_ntz '1996-01-01 00:00:00' AS l_shipdate").write.parquet(f"{at}/lineitem.parquet")
    return at


def test_tasks_of_the_facts_grow_with_them(spark, folder, rows, monkeypatch):
    want = rows(build_facts(Tables(spark, folder)))
    monkeypatch.setattr(facts_plan, "TASK_ROWS", 100)
    for levels in (("fy",), ("fy", "single_quarter", "cumulative")):
        made = build_facts(Tables(spark, folder), levels=levels, folded=True)
        assert made.rdd.getNumPartitions() >= made.count() // 200
    assert rows(build_facts(Tables(spark, folder), folded=True)) == want


def test_a_snapshot_is_written_by_the_tasks_that_make_it(spark, folder, tmp_path):
    facts = build_facts(Tables(spark, folder), folded=True).repartition(3).cache()
    store = SnapshotStore(spark, str(tmp_path / "s"))
    asked = []
    store.find = lambda d, real=store.find: asked.append(d) or real(d)
    first = store.write(facts, "all", "fy", ["x"], "1")
    # nothing is stored: no digest needs to be known beforehand
    assert asked == [] and first.inserted == facts.count()
    files = store.load(first.dataset_id).inputFiles()
    assert {re.search(r"part-(\d+)", f).group(1) for f in files} == {"00000", "00001", "00002"}
    again = store.write(facts, "all", "fy", ["x"], "1")
    assert asked == [first.content_digest] and again.inserted == 0 and again.content_digest == first.content_digest
    # as many facts, another of them: hashed beforehand, and stored
    other = facts.selectExpr(*[f"{c} + 1 AS {c}" if c == "value" else c for c in FACT_COLUMNS])
    assert store.write(other, "all", "fy", ["x"], "1").dataset_id == 2 and len(asked) == 2
    facts.unpersist()


def test_a_task_writes_many_files_of_a_page_index(spark, folder, tmp_path, monkeypatch):
    facts = build_facts(Tables(spark, folder), folded=True)
    index = PageIndex.build(facts, str(tmp_path / "p"), NATURAL_KEY, 50)
    files = index._stored().inputFiles()
    assert len(files) == -(-facts.count() // 50) and {re.search(r"part-(\d+)", f).group(1) for f in files} == {"00000"}
    monkeypatch.setattr(pages, "TASK_ROWS", 400)
    several = PageIndex.build(facts, str(tmp_path / "q"), NATURAL_KEY, 50)
    assert several.page(10_000).collect() == index.page(10_000).collect()
    for offset in (0, 390, 801):
        assert several.page(70, offset).collect() == index.page(70, offset).collect()
    monkeypatch.setattr(pages, "FILES", 7)
    few = PageIndex.build(facts, str(tmp_path / "r"), NATURAL_KEY, 1)
    assert few.index().count() <= 7 + facts.count() // 400 + 1 and few.page(33, 500).collect() == index.page(33, 500).collect()


def test_doubled_facts_are_made_once(spark, folder):
    found = load()[0]["fact_duplicates"](spark, folder)
    # a stack of the facts, one of their latest year and a headline each
    assert found._jdf.queryExecution().executedPlan().toString().count("Generate stack") <= 4
    got = {tuple(r) for r in found.collect()}
    annual = build_facts(Tables(spark, folder)).collect()
    last = max(r["fy"] for r in annual)
    assert got == {(r["entity_key"], r["fy"], None, r["measure"], r["bucket"], 2) for r in annual if r["fy"] != last} and got


# -- reload --------------------------------------------------------------------


def in_order(facts):
    """Rows by the reference's six columns, then by the others; NULL first."""
    key = ("entity_key", "fy", "quarter", "measure_group", "measure", "bucket", "window_mode", "entity_name", "value", "derived", "portfolio")
    got = [tuple(r[c] for c in FACT_COLUMNS) for r in facts.collect()]
    places = [FACT_COLUMNS.index(c) for c in key]
    return sorted(got, key=lambda r: [(r[i] is not None, r[i]) for i in places])


def test_a_snapshot_is_loaded_whole_and_in_order(spark, folder, monkeypatch):
    """The query gives every fact with its place; nothing is summed up."""
    monkeypatch.setattr(snapshots, "TASK_ROWS", 200)
    want = in_order(build_facts(Tables(spark, folder)))
    got = sorted(load()[0]["load_snapshot"](spark, folder).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(1, len(want) + 1)) and {r["dataset_id"] for r in got} == {1}
    assert [tuple(r[c] for c in FACT_COLUMNS) for r in got] == want


def test_loaded_facts_come_in_order(spark, folder, tmp_path, monkeypatch):
    """Of several levels, with keys that repeat; by many tasks, by one, and of a year alone."""
    facts = build_facts(Tables(spark, folder), levels=("fy", "single_quarter", "cumulative"), folded=True)
    twice = facts.filter("entity_key = '7'")
    facts = facts.unionByName(twice).unionByName(twice.withColumns({"entity_name": F.lit("A"), "portfolio": F.lit(None).cast("string")}))
    store, want = SnapshotStore(spark, str(tmp_path / "s")), in_order(facts)
    done = store.write(facts.repartition(5), "all", "fy", ["x"], "1")
    for size in (100, 1 << 19):
        monkeypatch.setattr(snapshots, "TASK_ROWS", size)
        loaded = store.load(done.dataset_id)
        assert loaded.rdd.getNumPartitions() == len(want) // size + 1
        assert [tuple(r) for r in loaded.select(*FACT_COLUMNS).collect()] == want
        year = [r for r in want if r[2] == "1996-97"]
        assert year and [tuple(r) for r in loaded.filter("fy = '1996-97'").select(*FACT_COLUMNS).collect()] == year
        got = placed(loaded.select(*FACT_COLUMNS)).collect()
        assert [tuple(r)[:-1] for r in sorted(got, key=lambda r: r["place"])] == want
        assert sorted(r["place"] for r in got) == list(range(1, len(want) + 1))
    # as stored, for readers that sum or sort: no shuffle
    assert "Exchange" not in store.load(done.dataset_id, ordered=False)._jdf.queryExecution().executedPlan().toString()
    empty = store.write(facts.limit(0), "none", "fy", ["x"], "1")
    assert placed(store.load(empty.dataset_id)).collect() == []
