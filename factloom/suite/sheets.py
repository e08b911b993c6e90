"""Wide sheets, number cells, names and period files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from factloom.functions.numbers import number_label, parse_number
from factloom.functions.periods import (
    fiscal_label, fiscal_quarter, start_label, with_fiscal_period)
from factloom.operators import melt as M
from factloom.plans.facts import (
    build_facts, entity_dimension, headline_facts, request_rows)
from factloom.schema import ACTION_PREFIXES, FACT_COLUMNS, POSITIONAL_WIDTH, RESPONSE_PREFIXES
from factloom.sources.shared import fresh_path
from factloom.sources.wide import (
    LONG_RUN_COLUMNS, read_long_run, read_sheet, read_wide, union_periods)
from factloom.suite.registry import query
from factloom.suite.sql import fy, over_facts, over_requests

_COLUMNS = ", ".join(FACT_COLUMNS)

_RAW_PRICE = """CASE o_orderpriority
  WHEN '1-URGENT' THEN '  ' || format('{:,.2f}', o_totalprice) || ' '
  WHEN '2-HIGH' THEN 'No data' WHEN '3-MEDIUM' THEN ''
  WHEN '4-NOT SPECIFIED' THEN NULL ELSE format('{:,.2f}', o_totalprice) END"""


@query("parse_number", f"""
SELECT o_orderkey, n AS value, coalesce(n, 0) AS value_or_zero
FROM (SELECT o_orderkey, try_cast(replace(trim({_RAW_PRICE}), ',', '') AS DOUBLE) AS n FROM orders)""")
def _(t):
    text, kind = F.format_number("o_totalprice", 2), F.col("o_orderpriority")
    raw = (F.when(kind == "1-URGENT", F.concat(F.lit("  "), text, F.lit(" ")))
           .when(kind == "2-HIGH", "No data").when(kind == "3-MEDIUM", "")
           .when(kind == "4-NOT SPECIFIED", F.lit(None)).otherwise(text))
    return t.orders.select("o_orderkey", parse_number(raw).alias("value"),
                           parse_number(raw, "zero").alias("value_or_zero"))


@query("number_label", """
SELECT l_orderkey, l_linenumber, l_partkey,
       coalesce(regexp_replace(format('{:,.2f}', CASE WHEN l_returnflag <> 'R'
                                      THEN l_extendedprice END), '\\.?0+$', ''), 'no data') AS label
FROM lineitem""")
def _(t):
    shown = F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             number_label(shown).alias("label"))


# -- sheets ------------------------------------------------------------------


def _sheet_counts(t, measures):
    """Counters per entity and year, as the cells of a published sheet."""
    rows = request_rows(t.orders, t.lineitem, measures)
    entity = entity_dimension(t.customer, t.nation, t.region)
    cells = []
    for m in measures:
        cells += [F.count_if(F.col(m) & F.col("personal")).alias(f"{m}_p"),
                  F.count_if(F.col(m) & ~F.col("personal")).alias(f"{m}_o"),
                  F.count_if(F.col(m)).alias(f"{m}_t")]
    counts = rows.groupBy("o_custkey", "start_year").agg(*cells)
    return counts.join(entity, "o_custkey").withColumn("fy", start_label(F.col("start_year")))


def positional_sheet(t):
    """Request sheet: the entity first, triples at fixed positions, filler elsewhere."""
    counts = _sheet_counts(t, ["received", "finalised"])
    at = {4: "received_p", 5: "received_o", 6: "received_t",
          16: "finalised_p", 17: "finalised_o", 18: "finalised_t"}
    cells = [F.col("entity_name").alias("c0")]
    for i in range(1, POSITIONAL_WIDTH):
        text = F.format_number(F.col(at[i]), 0) if i in at else F.lit("n/a")
        cells.append(text.alias(f"c{i}"))
    return counts.select(*cells, "fy")


_MELT = over_requests("""
SELECT entity_name, fy, measure, bucket, value FROM (
  SELECT entity_name, fy, unnest({m}) AS measure, unnest({b}) AS bucket, unnest({v}) AS value
  FROM requests GROUP BY entity_name, fy)""")


def _melt_sql(measures):
    from factloom.suite.sql import FLAG

    names, buckets, values = [], [], []
    for m in measures:
        for b, extra in (("personal", " AND kind = 'personal'"), ("other", " AND kind = 'other'"),
                         ("total", "")):
            names.append(f"'{m}'")
            buckets.append(f"'{b}'")
            values.append(f"CAST(count(*) FILTER ({FLAG[m]}{extra}) AS DOUBLE)")
    return _MELT.format(m="[" + ", ".join(names) + "]", b="[" + ", ".join(buckets) + "]",
                        v="[" + ", ".join(values) + "]")


@query("melt_positional", _melt_sql(["received", "finalised"]))
def _(t):
    return M.melt_positional(positional_sheet(t), ["c0", "fy"]).withColumnRenamed(
        "c0", "entity_name")


_BY_HEADER = {
    "withdrawn": "Withdrawn", "granted_part": "Granted in part", "decided": "Total determined",
    "granted_full": "Granted in full", "refused": "Access refused"}


@query("melt_by_header", _melt_sql(list(_BY_HEADER)))
def _(t):
    counts = _sheet_counts(t, list(ACTION_PREFIXES.values()))
    cells = [F.col("entity_name"), F.col("fy")]
    for m, header in _BY_HEADER.items():
        cells += [F.col(f"{m}_p").cast("string").alias(f"{header} (number)"),
                  F.col(f"{m}_o").cast("string").alias(f"{m} b"),
                  F.col(f"{m}_t").cast("string").alias(f"{m} c")]
    # a later header with a known prefix must not win over the first
    cells.append(F.lit("999").alias("Withdrawn (percent)"))
    return M.melt_by_header(counts.select(*cells), ["entity_name", "fy"], ACTION_PREFIXES)


_NOTED = """CASE c_mktsegment WHEN 'MACHINERY' THEN 'x ' || c_name WHEN 'FURNITURE' THEN ' '
  WHEN 'HOUSEHOLD' THEN ' ' || c_name || ' ' WHEN 'BUILDING' THEN NULL ELSE 'X ' || c_name END"""


def _noted(t):
    kind, name = F.col("c_mktsegment"), F.col("c_name")
    return t.customer.select("c_custkey", (
        F.when(kind == "MACHINERY", F.concat(F.lit("x "), name)).when(kind == "FURNITURE", " ")
        .when(kind == "HOUSEHOLD", F.concat(F.lit(" "), name, F.lit(" ")))
        .when(kind == "BUILDING", F.lit(None)).otherwise(F.concat(F.lit("X "), name))
    ).alias("entity_name"))


@query("drop_note_rows", f"""
SELECT c_custkey, trim(n) AS entity_name FROM (SELECT c_custkey, {_NOTED} AS n FROM customer)
WHERE n IS NOT NULL AND trim(n) <> '' AND NOT starts_with(trim(n), 'x')""")
def _(t):
    return M.drop_note_rows(_noted(t))


@query("drop_total_rows", over_facts("""
SELECT 'fact' AS kind, fy, measure, bucket, sum(value) AS value FROM facts
WHERE window_mode = 'single_quarter' AND lower(entity_name) <> 'total' GROUP BY ALL
UNION ALL SELECT 'control', fy, measure, bucket, sum(value) FROM facts
WHERE derived GROUP BY ALL"""))
def _(t):
    facts = build_facts(t, levels=("single_quarter",), headline=True)

    def per_year(kind, rows):
        return rows.groupBy("fy", "measure", "bucket").agg(F.sum("value").alias("value")).select(
            F.lit(kind).alias("kind"), "*")

    return per_year("fact", M.drop_total_rows(facts)).unionByName(
        per_year("control", M.control_rows(facts)))


_RENAMES = {"NATION_0": "NATION_24", "NATION_7": "NATION_9", "NATION_13": "NATION_9"}


def _rename_map(t):
    pairs = F.array(*[F.struct(F.lit(a).alias("old_name"), F.lit(b).alias("new_name"))
                      for a, b in _RENAMES.items()])
    return t.spark.range(1).select(F.inline(pairs))


@query("apply_renames", f"""
SELECT c_custkey, CASE n_name {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _RENAMES.items())}
       ELSE n_name END AS entity_key
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def _(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("n_name").alias("entity_key"))
    return M.apply_renames(rows, _rename_map(t))


@query("assign_portfolio", """
SELECT o_orderkey, entity_key,
       coalesce(CASE WHEN r_name <> 'MIDDLE EAST' THEN r_name END, 'Unmapped') AS portfolio
FROM (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS entity_key, o_custkey FROM orders)
LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN region ON r_regionkey = n_regionkey""")
def _(t):
    entity = entity_dimension(t.customer, t.nation, t.region)
    portfolios = entity.filter(F.col("portfolio").isNotNull()).select(
        F.col("o_custkey").cast("string").alias("entity_key"), "portfolio")
    rows = t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("entity_key"))
    return M.assign_portfolio(rows, portfolios)


@query("inject_headline", over_facts(f"""
SELECT {_COLUMNS} FROM facts WHERE window_mode = 'single_quarter'"""))
def _(t):
    facts = build_facts(t, levels=("single_quarter",))
    published = headline_facts(t).select("fy", "quarter", "measure", "value")
    return M.inject_headline(facts, published)


@query("sheet_facts", _melt_sql(["within_statutory"]))
def _(t):
    counts = _sheet_counts(t, ["within_statutory"])
    sheet = counts.select(
        "entity_name", "fy",
        F.col("within_statutory_p").cast("string").alias("Response time within period"),
        F.col("within_statutory_o").cast("string").alias("other"),
        F.col("within_statutory_t").cast("string").alias("all"))
    return M.sheet_facts(sheet, F.col("fy"), "entity_name", prefixes=RESPONSE_PREFIXES).select(
        "entity_name", "fy", "measure", "bucket", "value")


# -- files -------------------------------------------------------------------


@query("read_wide", _melt_sql(["received", "finalised"]))
def _(t):
    path = fresh_path(t.spark, "sheet")
    sheet = positional_sheet(t)
    sheet.write.csv(path)
    names = sheet.columns
    return M.melt_positional(read_wide(t.spark, path, headers=names), ["c0", "fy"]).withColumnRenamed(
        "c0", "entity_name")


_SHEET_ROWS = 500


def _write_sheets(t, sheet, path, head):
    """Sheets as they are published: header rows, entity rows, a note, a total row; a file
    has ``_SHEET_ROWS`` entities or so."""
    cells = sheet.drop("fy")
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in cells.columns]))
    part = F.pmod(F.xxhash64(sheet.columns[0]), F.lit(1 + t.customer.count() // _SHEET_ROWS))
    files = sheet.select(line.alias("line"), "fy", part.alias("part")).groupBy("fy", "part").agg(
        F.array_join(F.collect_list("line"), "\n").alias("lines"))
    tail = ["", "x a note" + ",7" * 30, "Total" + ",12114" * 30]
    text = F.concat_ws("\n", *[F.lit(h) for h in head], "lines", *[F.lit(x) for x in tail])
    files.select(text.alias("value"), "fy", "part").write.partitionBy("fy", "part").text(path)


def _read_sheets(t, path, years, **how):
    return reduce(lambda a, b: a.unionByName(b), [
        read_sheet(t.spark, f"{path}/fy={fy}/*", **how).withColumn("fy", F.lit(fy)) for fy in years])


def _no_extras(rows, name):
    return M.drop_total_rows(M.drop_note_rows(rows, name), name)


@query("read_sheet", _melt_sql(["received", "finalised"]))
def _(t):
    """Positional sheets whose three header rows hold numbers too, as a melt must not see."""
    path = fresh_path(t.spark, "sheets")
    sheet = positional_sheet(t)
    _write_sheets(t, sheet, path, ["Agency" + ",received" * 21, "Agency name" + ",12114" * 21, "" + ",1" * 21])
    years = [r[0] for r in sheet.select("fy").distinct().collect()]  # one row per calendar year
    rows = _no_extras(_read_sheets(t, path, years), "c0")
    return M.melt_positional(rows, ["c0", "fy"], on_bad="zero").withColumnRenamed("c0", "entity_name")


@query("read_sheet_by_header", _melt_sql(["withdrawn", "granted_part", "refused"]))
def _(t):
    """Sheets whose columns are found by the header texts in the file."""
    named = {"withdrawn": "Withdrawn", "granted_part": "GRANTED IN PART (no.)", "refused": "Access refused"}
    path, head = fresh_path(t.spark, "sheets"), ["Agency"]
    counts = _sheet_counts(t, list(named))
    cells = [F.col("entity_name")]
    for m, text in named.items():
        cells += [F.col(f"{m}_{b}").cast("string").alias(f"{m}_{b}") for b in "pot"]
        head += [f'"{text}, all"', "", ""]
    sheet = counts.select(*cells, "fy")
    _write_sheets(t, sheet, path, [",".join([*head, "Withdrawn %"]), "Agency name" + ",99" * 10, "" + ",2" * 10])
    years = [r[0] for r in sheet.select("fy").distinct().collect()]
    rows = _no_extras(_read_sheets(t, path, years, by_header=True), "Agency")
    return M.melt_by_header(rows, ["Agency", "fy"], ACTION_PREFIXES).withColumnRenamed("Agency", "entity_name")


@query("union_periods", _melt_sql(["received", "finalised"]))
def _(t):
    root = fresh_path(t.spark, "periods")
    sheet = positional_sheet(t)
    sheet.withColumn("period", F.col("fy")).drop("fy").write.partitionBy("period").csv(root)
    years = [r[0] for r in sheet.select("fy").distinct().collect()]  # one row per calendar year
    paths = {fy: f"{root}/period={fy}" for fy in years}
    return M.melt_positional(union_periods(t.spark, paths), ["c0", "fy"]).withColumnRenamed(
        "c0", "entity_name")


# money columns of the long-run file: sums of the orders' and line items' own amounts
_MONEY = {"application_fees": ("Application fees AUD", "1-URGENT"), "review_fees": ("Internal review fees AUD", "2-HIGH"),
          "charges_notified": ("Charges notified AUD", "3-MEDIUM"), "charges_collected": ("Charges collected AUD", "5-LOW")}


@query("long_run_trend", f"""
SELECT {fy('o_orderdate')} AS fy,
       CASE WHEN fy >= '1997-98' THEN CAST(count(*) FILTER (kind) AS DOUBLE) END AS personal,
       CASE WHEN fy >= '1997-98' THEN CAST(count(*) FILTER (NOT kind) AS DOUBLE) END AS other,
       CAST(count(*) AS DOUBLE) AS total,
       {', '.join(f"CAST(floor(sum(price) FILTER (o_orderpriority = '{p}')) AS DOUBLE) AS {c}" for c, (_, p) in _MONEY.items())},
       CASE WHEN fy >= '1993-94' THEN CAST(floor(sum(price) FILTER (o_orderstatus = 'F')) AS DOUBLE) END AS total_collected,
       CAST(floor(sum(price)) AS DOUBLE) AS estimated_costs
FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderpriority IN ('1-URGENT', '2-HIGH') AS kind FROM orders) GROUP BY 1""")
def _(t):
    """Yearly totals written in the shape of the long-run file, every column of it, and read back."""
    kind, price = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_totalprice").cast("decimal(18,2)")

    def money(where):
        return F.floor(F.sum(F.when(where, price)))

    yearly = with_fiscal_period(t.orders, "o_orderdate").groupBy("fy").agg(
        F.count_if(kind).alias("p"), F.count_if(~kind).alias("o"), F.count(F.lit(1)).alias("n"),
        *[money(F.col("o_orderpriority") == p).alias(c) for c, (_, p) in _MONEY.items()],
        money(F.col("o_orderstatus") == "F").alias("collected"), money(F.lit(True)).alias("cost"))
    early = F.col("fy") < "1997-98"
    start = F.substring("fy", 1, 4)
    label = F.when(early, F.concat(start, F.lit("-"), (start.cast("int") + 1).cast("string")))
    cells = {
        "Year": F.coalesce(label, F.col("fy")),
        "Requests for personal information": F.when(early, "No data").otherwise(
            F.col("p").cast("string")),
        "Requests for other information": F.when(early, "No data").otherwise(
            F.col("o").cast("string")),
        "Total requests": F.format_number("n", 0),
        **{header: F.concat(F.lit(" "), F.format_number(c, 0)) for c, (header, _) in _MONEY.items()},
        "Total fees and charges collected AUD": F.when(F.col("fy") < "1993-94", "").otherwise(F.col("collected").cast("string")),
        "Estimated costs AUD": F.col("cost").cast("string"),
    }
    path = fresh_path(t.spark, "long-run")
    yearly.select(*[cells[h].alias(h) for h in LONG_RUN_COLUMNS]).write.option("header", True).csv(path)
    return read_long_run(t.spark, path)


@query("fiscal_label", f"""
SELECT o_orderkey, {fy('o_orderdate')} AS fy FROM orders""")
def _(t):
    rows = with_fiscal_period(t.orders, "o_orderdate")
    start = F.substring("fy", 1, 4)
    long_form = F.concat(start, F.lit("-"), (start.cast("int") + 1).cast("string"))
    raw = F.when(fiscal_quarter(F.col("o_orderdate")) > 2, long_form).otherwise(F.col("fy"))
    return rows.select("o_orderkey", fiscal_label(raw).alias("fy"))
