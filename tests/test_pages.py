import random

import pytest

from factloom.operators import ranking as R
from factloom.plans import stats as S
from factloom.schema import FACT_COLUMNS, NATURAL_KEY
from factloom.sources.pages import PageIndex
from factloom.sources.snapshots import SnapshotStore

YEARS = ("2021-22", "2022-23", "2023-24")


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """1,500 facts, a third of one entity, some equal in their key."""
    rnd = random.Random(2)
    rows = []
    for i in range(1500):
        name = "A" if i % 3 == 0 else f"E{rnd.randrange(200):03d}"
        rows.append((name, name, rnd.choice(YEARS), rnd.choice([None, 1, 2]), "requests", rnd.choice(["received", "refused"]), rnd.choice(["total", "personal"]),
                     float(i), False, "fy", None))
    schema = ("entity_key string, entity_name string, fy string, quarter int, measure_group string, measure string, bucket string, value double, "
              "derived boolean, window_mode string, portfolio string")
    return spark.createDataFrame(rows, schema).select(*FACT_COLUMNS).repartition(4)


def key(r):
    return tuple(r[k] for k in NATURAL_KEY)


def test_pages_of_a_stored_table(many, tmp_path):
    index = PageIndex.build(many, str(tmp_path / "p"), NATURAL_KEY, 200)
    assert index.total() == 1500 and index.index().count() > 5
    whole = index.page(5000).collect()
    assert len(whole) == 1500 and {r["total"] for r in whole} == {1500}
    assert [key(r) for r in whole] == [key(r) for r in R.page_facts(many, 5000).collect()]
    for offset, limit in ((0, 40), (333, 100), (1450, 100), (1500, 10), (9999, 5), (7, 0)):
        page = index.page(limit, offset)
        assert len(page.inputFiles()) <= 2
        assert page.collect() == whole[offset: offset + limit]
    for at in (0, 1, 250, 777, 1498, 1499):
        # rows with the same key count as seen, as in ``page_facts``
        rest = [r for r in whole if R_key_after(r, whole[at])]
        page = index.page(60, after=whole[at].asDict())
        assert len(page.inputFiles()) <= 2 and page.collect() == rest[:60]
        assert index.page(10, 25, after=whole[at].asDict()).collect() == rest[25:35]
    nothing = dict.fromkeys(NATURAL_KEY) | {"entity_key": ""}
    assert index.page(5, after=nothing).collect() == whole[:5]
    with pytest.raises(ValueError):
        index.page(-1)
    with pytest.raises(ValueError, match="missing"):
        index.page(5, after={"fy": YEARS[0]})


def R_key_after(r, seen):
    order = lambda x: [(v is not None, v) for v in key(x)]
    return order(r) > order(seen)


def test_pages_of_a_snapshot(spark, many, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    distinct = many.dropDuplicates(list(NATURAL_KEY))
    written = store.write(distinct, "all", "fy", ["x"], "1")
    first = store.pages(written.dataset_id, 100).page(30).collect()
    assert first == R.page_facts(distinct, 30).collect()
    assert store.page(written.dataset_id, 30).collect() == first  # the index that is there
    assert spark.read.parquet(str(tmp_path / "s" / "paged")).count() == 1
    after = store.page(written.dataset_id, 30, after=first[9].asDict()).collect()
    assert after == R.page_facts(distinct, 30, 10).collect()


def test_an_empty_table(many, tmp_path):
    index = PageIndex.build(many.limit(0), str(tmp_path / "p"), NATURAL_KEY)
    assert index.total() == 0 and index.page(5).collect() == [] and index.page(5, after=dict.fromkeys(NATURAL_KEY)).collect() == []


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_one_scan_for_all_filters(spark, many, tmp_path, monkeypatch):
    path = str(tmp_path / "facts")
    many.write.parquet(path)
    facts = spark.read.schema(many.schema).parquet(path)
    asked = [S.Asked(f"e{i}", "requests_received_trend", entity=f"E{i:03d}") for i in range(30)] + [
        S.Asked("none", "requests_received_trend", entity="nobody"), S.Asked("top", "received_top20", fy=YEARS[1]), S.Asked("all", "received_top20")]
    pins = S.Pins(**{**S.PUBLISHED_PINS.__dict__, "top_fy": YEARS[1]})
    plans = []
    monkeypatch.setattr(S, "settled", lambda df, name, real=S.settled: plans.append(df) or real(df, name))
    got = S.rederive_all(facts, asked, pins)
    assert len(plans) == 1 and scans(plans[0]) == 1
    rows = {}
    for r in got.collect():
        rows.setdefault(r["filter"], []).append((r["status"], r["category"], r["value"], r["fact_rows"]))
    held = many.collect()
    assert rows["none"] == [("not_published", None, None, 0)]
    sums = {}
    for r in held:
        if r["fy"] == YEARS[1] and r["measure"] == "received" and r["bucket"] == "total" and r["quarter"] is None:
            sums[r["entity_name"]] = sums.get(r["entity_name"], 0) + r["value"]
    top = sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:20]
    assert sorted(x[1:3] for x in rows["top"]) == sorted(top) == sorted(x[1:3] for x in rows["all"])
    assert {x[3] for x in rows["top"]} == {sum(r["fy"] == YEARS[1] for r in held)} and {x[3] for x in rows["all"]} == {1500}
    for i in range(30):
        mine = [r for r in held if r["entity_name"] == f"E{i:03d}"]
        shown = {}
        for r in mine:
            if r["quarter"] is None:
                shown.setdefault(r["fy"], []).append(r["value"] if r["measure"] == "received" and r["bucket"] == "total" else None)
        want = [("published", fy, sum(v for v in vs if v is not None) if any(v is not None for v in vs) else None, len(mine)) for fy, vs in shown.items()]
        if not any(x[2] is not None for x in want):
            want = [("not_published", None, None, len(mine))]
        assert sorted(rows[f"e{i}"], key=str) == sorted(want, key=str)
