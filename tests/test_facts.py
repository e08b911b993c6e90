import pytest
from pyspark.sql import functions as F

from factloom.operators import aggregates as A
from factloom.operators import filters as P
from factloom.operators import melt as M
from factloom.operators import quality as Q
from factloom.operators import ranking as R
from factloom.plans import dataset as D
from factloom.plans import stats as S
from factloom.schema import (
    ACTION_PREFIXES, FACTS, PUBLISHED_HEADLINE, PUBLISHED_HEADLINE_PERIOD, UNMAPPED)

Y1, Y2, Y3 = "2022-23", "2023-24", "2024-25"


@pytest.fixture(scope="module")
def facts(fact_table):
    return fact_table(
        ("A", Y1, None, "received", "total", 10), ("A", Y1, None, "received", "personal", 10),
        ("A", Y2, None, "received", "total", 0), ("B", Y1, None, "received", "total", 5),
        ("B", Y3, None, "decided", "total", 4), ("B", Y3, None, "refused", "total", 1),
        ("A", Y3, None, "refused", "total", 3), ("A", Y1, 1, "received", "total", 2),
        ("Total", "2025-26", 1, "received", "total", 99),
        ("x note", Y1, None, "received", "other", 1),
        portfolio={"A": "Home"})


def test_trend_keeps_missing_years_null_and_true_zeros(facts, rows):
    assert rows(A.trend(facts, "received")) == [(Y1, 15.0, "fy"), (Y2, 0.0, "fy"), (Y3, None, "fy")]
    assert rows(A.trend(facts, "withdrawn")) == []


def test_ratio_trend_is_null_without_a_denominator(facts, rows):
    assert rows(A.ratio_trend(facts, ["refused"])) == [(Y1, None, "fy"), (Y2, None, "fy"), (Y3, 100.0, "fy")]


def test_empty_selection_sums_to_zero(facts):
    assert A.sum_measure(facts.filter("fy = 'none'")).first()[0] == 0.0


def test_compare_periods(facts):
    up = A.compare_periods(facts, Y1, Y2).first()
    assert (up["value_a"], up["value_b"], up["change"], up["change_pct"]) == (15, 0, -15, -100)
    assert A.compare_periods(facts, Y2, Y1).first()["change_pct"] is None
    assert A.compare_periods(facts, "1900-01", Y1).first()["value_a"] == 0


def test_per_entity_ops_never_hold_totals_and_name_their_level(facts, rows):
    assert rows(P.list_entities(facts)) == [("A",), ("B",)]
    assert rows(A.entity_totals(facts, Y1, "received"), "entity_name", "value") == [
        ("A", 10.0), ("B", 5.0)]
    both = A.summarize_entities(facts, "received", bucket=None).first()
    assert (both["row_count"], both["total"], both["basis"]) == (5, 26.0, "fy")
    mixed = A.summarize_entities(facts, "received", level=None).first()
    assert (mixed["total"], mixed["basis"]) == (17.0, "mixed")
    with pytest.raises(ValueError):
        P.at_level(facts, "weekly")


def test_quarter_none_is_no_constraint(facts):
    assert P.filter_facts(facts, measure="received", bucket="total").count() == 5
    assert P.annual_rows(facts).filter("measure = 'received' and bucket = 'total'").count() == 3


def test_search_is_literal_and_case_blind(facts):
    assert P.search_facts(facts, entity="X NO").count() == 1
    assert P.search_facts(facts, entity="%").count() == 0
    assert P.search_facts(facts, entity="", fy="").count() == facts.count()


def test_portfolio_blank_is_unmapped(facts, rows):
    assert rows(A.by_portfolio(facts, Y1, "received"), "portfolio", "value") == [
        ("Home", 10.0), (UNMAPPED, 5.0)]


def test_movers_need_both_denominators(fact_table, rows):
    facts = fact_table(
        ("A", Y1, None, "decided", "total", 8), ("A", Y1, None, "refused", "total", 2),
        ("A", Y2, None, "decided", "total", 4), ("A", Y2, None, "refused", "total", 4),
        ("B", Y1, None, "decided", "total", 5), ("B", Y2, None, "refused", "total", 5),
        ("C", Y1, None, "decided", "total", 5), ("C", Y2, None, "decided", "total", 5))
    assert rows(A.period_movers(facts, Y1, Y2)) == [("A", 25.0, 100.0, 75.0, "fy"), ("C", 0.0, 0.0, 0.0, "fy")]
    assert [r[0] for r in R.top_movers(facts, Y1, Y2).collect()] == ["A", "C"]


def test_top_ties_break_on_name_and_count_is_before_the_cut(fact_table):
    facts = fact_table(*[(n, Y1, None, "received", "total", 5) for n in "DCBA"])
    top = R.top_contributors(facts, Y1, "received", n=2).orderBy("entity_name").collect()
    assert [(r["entity_name"], r["value"], r["entities"]) for r in top] == [
        ("A", 5.0, 4), ("B", 5.0, 4)]


def test_pages_by_offset_and_by_key_agree(facts, rows):
    everything = R.page_facts(facts, limit=100).collect()
    assert {r["total"] for r in everything} == {10}
    first = R.page_facts(facts, limit=4).collect()
    by_key = R.page_facts(facts, limit=100, after=first[-1].asDict()).collect()
    assert first + by_key == everything
    assert R.page_facts(facts, limit=100, offset=4).collect() == by_key
    with pytest.raises(ValueError):
        R.page_facts(facts, offset=-1)
    with pytest.raises(ValueError):
        R.page_facts(facts, after={"fy": Y1})


def test_pearson_needs_two_points_and_variance(fact_table):
    def r(pairs):
        entries = []
        for i, (x, y) in enumerate(pairs):
            fy = f"20{10 + i}-{11 + i}"
            entries += [("A", fy, None, "within_statutory", "total", x),
                        ("A", fy, None, "received", "total", y)]
        return A.pearson_trend(fact_table(*entries)).first()[0]

    assert r([(1, 2), (2, 4), (3, 6)]) == 1.0
    assert r([(1, 6), (2, 4), (3, 2)]) == -1.0
    assert r([(5, 1), (5, 2), (5, 3)]) is None
    assert r([(5, 1)]) is None


def test_bar_scale_keeps_null_and_zero(spark, rows):
    figures = spark.createDataFrame(
        [("f", "a", 4.0), ("f", "b", None), ("f", "c", 0.0), ("g", "a", 0.0), ("g", "b", None)],
        "figure_key string, category string, value double")
    assert rows(R.bar_scale(figures), "figure_key", "category", "height") == [
        ("f", "a", 100.0), ("f", "b", None), ("f", "c", 0.0), ("g", "a", 0.0), ("g", "b", None)]


# -- sheets ------------------------------------------------------------------


def test_headers_first_match_wins():
    headers = ["Agency", "Granted in full (n)", "", "", "GRANTED IN FULL %", "Access refused", "", ""]
    assert M.header_triples(headers, ACTION_PREFIXES) == {
        "granted_full": (1, 2, 3), "refused": (5, 6, 7)}


def test_sheet_to_facts_drops_notes_and_totals(spark, rows):
    sheet = spark.createDataFrame(
        [("Old name", "1,200", "3", "1,203"), (" B ", "No data", "", "7"), ("", "9", "9", "9"),
         ("x excludes", "9", "9", "9"), ("TOTAL", "9", "9", "9"), (None, "9", "9", "9")],
        "Agency string, `Withdrawn a` string, b string, c string")
    renames = spark.createDataFrame([("Old name", "New name")], "old_name string, new_name string")
    out = M.sheet_facts(sheet, F.lit(Y1), "Agency", renames, prefixes=ACTION_PREFIXES)
    assert out.columns == FACTS.fieldNames()
    assert rows(out, "entity_key", "entity_name", "measure", "bucket", "value") == [
        ("B", "B", "withdrawn", "total", 7.0),
        ("New name", "Old name", "withdrawn", "other", 3.0),
        ("New name", "Old name", "withdrawn", "personal", 1200.0),
        ("New name", "Old name", "withdrawn", "total", 1203.0)]
    with pytest.raises(ValueError):
        M.melt_by_header(sheet, ["Agency"], {"nothing": "x"})
    with pytest.raises(ValueError):
        M.melt_positional(sheet, ["Agency"])


def test_published_headline_passes_its_gate_and_a_corrupt_one_does_not(spark, fact_table):
    table = S.headline_table(spark, PUBLISHED_HEADLINE, *PUBLISHED_HEADLINE_PERIOD)
    facts = M.inject_headline(fact_table(("A", Y1, None, "received", "total", 1)), table)
    expected = table.withColumnRenamed("value", "expected")
    Q.require(Q.golden_gate(facts, expected), F.col("passed"), "headline")
    corrupt = facts.withColumn("value", F.when(F.col("measure") == "decided", 1.0).otherwise(
        F.col("value")))
    with pytest.raises(Q.GateError, match="decided"):
        Q.require(Q.golden_gate(corrupt, expected), F.col("passed"), "headline")
    with pytest.raises(Q.GateError):
        Q.require(Q.golden_gate(facts.filter("not derived"), expected), F.col("passed"), "headline")


# -- catalogue ---------------------------------------------------------------


def test_published_shares(spark, fact_table):
    table = S.headline_table(spark, PUBLISHED_HEADLINE, *PUBLISHED_HEADLINE_PERIOD)
    facts = M.inject_headline(fact_table(("A", Y1, None, "received", "total", 1)), table)
    board = {r["stat_key"]: r for r in D.run_op(facts, "kpis").collect()}
    assert tuple(sorted(board)) == tuple(sorted(S.STAT_KEYS))
    assert board["within_statutory_pct_q1"]["value"] == 70
    assert board["granted_full_share_q1"]["value"] == 19
    assert board["requests_received_q1"]["value"] == 12359
    assert board["requests_received_q1"]["basis"] == "single_quarter"
    assert board["timeliness_slippage_corr"]["value"] is None


@pytest.mark.parametrize("key", [*S.STAT_KEYS, *S.FIGURE_KEYS])
def test_every_key_computes(facts, key):
    S.stat(facts, key).collect()


def test_unknown_keys_and_ops_fail(facts):
    with pytest.raises(KeyError):
        S.stat(facts, "made_up")
    with pytest.raises(ValueError, match="allowed"):
        D.run_op(facts, "drop_table")
    with pytest.raises(ValueError, match="trend"):
        D.run_op(facts, "gaps")


@pytest.mark.parametrize("op", D.OPS)
def test_every_op_answers(facts, op):
    D.run_op(facts, op, {"fy_a": Y1, "fy_b": Y2}).collect()


def test_read_api(facts, rows):
    info = dict_of(D.dataset_info(facts))
    assert info["fy"] == {Y1, Y2, Y3, "2025-26"} and info["fact_count"] == {"10"}
    assert info["stat_key"] == set(S.STAT_KEYS)
    assert rows(D.measure_groups(facts)) == [("requests", ["decided", "received", "refused"])]
    page = D.facts_page(facts, limit=2, entity="a", measure="received").collect()
    assert len(page) == 2 and page[0]["total"] == 5


def dict_of(profile):
    out = {}
    for r in profile.collect():
        out.setdefault(r["attribute"], set()).add(r["value"])
    return out


def test_a_series_without_values_has_no_rows(facts, rows):
    table = S.trend_figures(S.cell_summary(facts, digest=False))
    keys = {r["figure_key"] for r in table.collect()}
    assert "timeliness_trend" not in keys and "requests_received_trend" in keys


def test_rederive_only_when_its_rows_survive(facts):
    pins = S.PUBLISHED_PINS
    kept = S.rederive(facts, "requests_received_trend", pins, entity="A").collect()
    assert {(r["status"], r["category"], r["value"]) for r in kept} == {
        ("published", Y1, 10.0), ("published", Y2, 0.0), ("published", Y3, None)}
    lost = S.rederive(facts, "requests_received_trend", pins, bucket="personal").collect()
    assert [tuple(r) for r in lost] == [("not_published", None, None, 1)]
    assert S.rederive(facts, "decided_top20", pins, fy=Y1).first()["status"] == "not_published"
    with pytest.raises(KeyError):
        S.rederive(facts, "timeliness_change", pins)


# -- quality -----------------------------------------------------------------


def test_duplicate_check_counts_null_quarters_as_equal(fact_table):
    facts = fact_table(("A", Y1, None, "received", "total", 1), ("A", Y1, None, "received", "total", 2),
                       ("A", Y1, 1, "received", "total", 1))
    assert [r["copies"] for r in Q.duplicate_check(facts).collect()] == [2]


def test_fact_rules_find_violations(spark, facts):
    bad = facts.limit(1).withColumns({
        "bucket": F.lit("all"), "quarter": F.lit(5), "value": F.lit(None).cast("double")})
    found = {r["rule"]: r["violations"] for r in Q.domain_check(facts.unionByName(bad)).collect()}
    assert found.pop("bucket_domain") == found.pop("quarter_domain") == 1
    assert found.pop("value_not_null") == 1
    assert set(found.values()) == {0}


def test_reconcile_reports_both_sides(facts, spark):
    controls = spark.createDataFrame(
        [(Y1, "received", 15.0), (Y3, "decided", 5.0), (Y3, "withdrawn", 1.0)],
        "fy string, measure string, expected double")
    annual = P.annual_rows(facts).filter("bucket = 'total'")
    status = {(r["fy"], r["measure"]): r["status"]
              for r in Q.reconcile_totals(annual, controls, ["fy", "measure"]).collect()}
    assert status == {
        (Y1, "received"): "match", (Y3, "decided"): "mismatch", (Y3, "withdrawn"): "no_rows",
        (Y2, "received"): "no_control", (Y3, "refused"): "no_control"}


def test_schema_diff():
    assert Q.schema_diff(["fy", "colour"], FACTS)["undeclared"] == ["colour"]
