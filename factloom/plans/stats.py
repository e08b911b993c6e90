"""The closed catalogue of stats and figures.

All keys but the entity rankings are answered from one summary of the facts: a
cell per (window, year, quarter, measure, bucket) with its sum, row count and
digest slices.  That summary is a single map-side-combined aggregate whose size
depends on the calendar and the closed domains, not on the data; digests of
cells add up, so every stat's source rows are hashed without reading them again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.hashing import SLICES, digest_text, with_slices
from factloom.functions.numbers import half_even, percent
from factloom.operators.aggregates import pearson, period_movers, ratio
from factloom.operators.filters import ANNUAL, filter_facts, not_pseudo
from factloom.schema import DEFAULT_TOP_N, HASH_COLUMNS, MEASURES
from factloom.sources.shared import settled

# --------------------------------------------------------------------------
# The published keys, captions, and the page each figure is on.
# --------------------------------------------------------------------------

FIGURE_KEYS = (
    "requests_received_trend", "requests_finalised_trend", "requests_decided_trend",
    "decided_top20", "received_top20", "decision_outcomes_trend",
    "timeliness_trend", "refused_pct_trend", "granted_full_part_change",
    "timeliness_change", "agency_contributions_received", "agency_contributions_decided",
)
STAT_KEYS = (
    "requests_received_q1", "requests_finalised_q1", "decided_q1",
    "within_statutory_pct_q1", "granted_full_share_q1", "granted_part_share_q1",
    "refused_share_q1", "withdrawn_q1", "refusal_rate_change_fy23_fy24",
    "timeliness_slippage_corr",
)
CAPTIONS = {
    "requests_received_trend": "Requests received, FY trend",
    "requests_finalised_trend": "Requests finalised, FY trend",
    "requests_decided_trend": "Requests decided, FY trend",
    "received_top20": "Top 20 agencies by requests received",
    "decided_top20": "Top 20 agencies by requests decided",
    "decision_outcomes_trend": "Decision outcomes by FY",
    "timeliness_trend": "Timeliness of decision-making (within/after)",
    "refused_pct_trend": "Percentage of decisions refused",
    "granted_full_part_change": "Change in % granted in full or part",
    "timeliness_change": "Change in % within statutory time period",
}
PAGE_FIGURES = {
    "at-a-glance": ("requests_received_trend",),
    "requests-received": ("requests_received_trend",),
    "key-agency-contributions-received": ("received_top20",),
    "requests-finalised": ("requests_finalised_trend",),
    "requests-decided": ("requests_decided_trend",),
    "key-agency-contributions-decided": ("decided_top20",),
    "decision-outcomes": ("decision_outcomes_trend",),
    "change-decision-outcomes": ("granted_full_part_change",),
    "timeliness": ("timeliness_trend",),
    "change-timeliness": ("timeliness_change",),
}

# stat key -> (measure,) for a headline, (measure, whole) for a share
HEADLINE_STATS = {
    "requests_received_q1": ("received",),
    "requests_finalised_q1": ("finalised",),
    "decided_q1": ("decided",),
    "within_statutory_pct_q1": ("within_statutory", "decided"),
    "granted_full_share_q1": ("granted_full", "decided"),
    "granted_part_share_q1": ("granted_part", "decided"),
    "refused_share_q1": ("refused", "decided"),
    "withdrawn_q1": ("withdrawn",),
}
MOVERS_STAT = "refusal_rate_change_fy23_fy24"
CORRELATION_STAT = "timeliness_slippage_corr"
CORRELATED = ("within_statutory", "received")

# figure key -> {series: measure}, yearly totals
TREND_FIGURES = {
    "requests_received_trend": {"received": "received"},
    "requests_finalised_trend": {"finalised": "finalised"},
    "requests_decided_trend": {"decided": "decided"},
    "decision_outcomes_trend": {m: m for m in (
        "granted_full", "granted_part", "refused", "withdrawn")},
    "timeliness_trend": {"within_statutory": "within_statutory"},
}
# figure key -> (series, parts, whole), yearly percentages
RATIO_FIGURES = {
    "refused_pct_trend": ("refused_pct", ("refused",), "decided"),
    "granted_full_part_change": (
        "granted_full_or_part_pct", ("granted_full", "granted_part"), "decided"),
    "timeliness_change": ("within_statutory_pct", ("within_statutory",), "decided"),
}
# figure key -> measure, largest entities of the pinned year
TOP_FIGURES = {
    "decided_top20": "decided",
    "received_top20": "received",
    "agency_contributions_received": "received",
    "agency_contributions_decided": "decided",
}


@dataclass(frozen=True)
class Pins:
    """The periods the catalogue is pinned to."""

    headline_fy: str
    headline_quarter: int
    top_fy: str
    mover_fys: tuple[str, str]


PUBLISHED_PINS = Pins("2025-26", 1, "2024-25", ("2022-23", "2023-24"))


def check_keys(keys) -> tuple[str, ...]:
    keys = tuple(keys)
    unknown = [k for k in keys if k not in STAT_KEYS and k not in FIGURE_KEYS]
    if unknown:
        raise KeyError(f"unknown stat key {unknown[0]!r}")
    return keys


_CELL = ("window_mode", "derived", "fy", "quarter", "measure", "bucket")
_SLICE_NAMES = tuple(f"h{i}" for i in range(SLICES))


#: Binary logarithm of a sketch's registers; its relative standard error is 1.04 / 2 ** (half of it).
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def cell_summary(facts: DataFrame, by: tuple[str, ...] = (),
                 digest: bool | Column = True, sketch: bool = False) -> DataFrame:
    """Sum, row count and digest slices per cell (and per ``by``, e.g. dataset_id).

    Hashing rows is the costly part: a condition on cell columns as ``digest``
    hashes only the rows of the cells it selects.  With ``sketch`` a cell also
    has a sketch of its entities, which merge as the sums add up.
    """
    sums = [F.sum("value").alias("value"), F.count(F.lit(1)).alias("n")]
    if digest is not False:
        facts = with_slices(facts, HASH_COLUMNS, None if digest is True else digest)
        sums += [F.sum(h).alias(h) for h in _SLICE_NAMES]
    if sketch:  # a NULL is left out
        sums.append(F.hll_sketch_agg(F.when(not_pseudo(), F.col("entity_name")), SKETCH_BITS).alias("entities"))
    return facts.groupBy(*by, *_CELL).agg(*sums)


def summarised(facts: DataFrame, digest: bool | Column = True, sketch: bool = False) -> DataFrame:
    """The cell summary, computed once and kept in the shared folder: it is small,
    and everything built on it would otherwise read the facts again."""
    return settled(cell_summary(facts, digest=digest, sketch=sketch), "cells")


def entities_in(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """How many entities the cells hold, from their sketches alone: one row, or one for each value of ``by``.

    Filter the cells first, by whatever a cell is of.  Without cells there is no row per value, and 0 in all.
    """
    merged = cells.groupBy(*by).agg(F.hll_union_agg("entities", False).alias("_all"))
    return merged.select(*by, F.coalesce(F.hll_sketch_estimate("_all"), F.lit(0)).cast("bigint").alias("entities"))


def _pinned(pins: Pins) -> Column:
    return ((F.col("bucket") == "total") & F.col("derived")
            & (F.col("window_mode") == "single_quarter") & (F.col("fy") == pins.headline_fy)
            & (F.col("quarter") == pins.headline_quarter))


def _moving(pins: Pins) -> Column:
    return ((F.col("window_mode") == ANNUAL) & (F.col("bucket") == "total")
            & F.col("fy").isin(*pins.mover_fys))


def _correlated() -> Column:
    return ((F.col("window_mode") == ANNUAL) & (F.col("bucket") == "total")
            & F.col("measure").isin(*CORRELATED))


def stat_sources(pins: Pins) -> Column:
    """The rows any stat key is made of (figures are made of all of them)."""
    return _pinned(pins) | _moving(pins) | _correlated()


def _source(where: Column) -> list[Column]:
    """Row count and digest of the cells that meet a condition."""
    def over(name):
        return F.sum(F.when(where, F.col(name)))

    count = F.coalesce(over("n"), F.lit(0)).cast("bigint")
    return [count, digest_text(count, [over(h) for h in _SLICE_NAMES])]


def headline_stats(cells: DataFrame, pins: Pins, by: tuple[str, ...] = (),
                   keys: tuple[str, ...] = STAT_KEYS + FIGURE_KEYS) -> DataFrame:
    """The quarter stats, the mover and correlation stats and every figure key:
    value (NULL for list-valued keys), basis, source_rows and rows_hash."""
    pinned = _pinned(pins)

    def pinned_sum(m):
        return half_even(F.coalesce(
            F.sum(F.when(pinned & (F.col("measure") == m), F.col("value"))), F.lit(0.0)))

    entries = []
    for key, measures in HEADLINE_STATS.items():
        value = pinned_sum(measures[0])
        if len(measures) == 2:
            value = percent(value, pinned_sum(measures[1]))
        entries.append((key, value, "single_quarter",
                        _source(pinned & F.col("measure").isin(*measures))))
    nothing = F.lit(None).cast("double")
    entries.append((MOVERS_STAT, nothing, ANNUAL,
                    _source(_moving(pins))))
    entries.append((CORRELATION_STAT, nothing, ANNUAL,
                    _source(_correlated())))
    everything = _source(F.lit(True))
    entries += [(key, nothing, ANNUAL, everything) for key in FIGURE_KEYS]
    entries = [e for e in entries if e[0] in keys]
    rows = [
        F.struct(F.lit(key).alias("stat_key"), value.alias("value"), F.lit(base).alias("basis"),
                 count.alias("source_rows"), digest.alias("rows_hash"))
        for key, value, base, (count, digest) in entries]
    return cells.groupBy(*by).agg(F.array(*rows).alias("_rows")).select(*by, F.inline("_rows"))


def series_of(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Yearly totals per measure from the summary (axis: every annual year)."""
    annual = cells.filter(F.col("window_mode") == ANNUAL)
    return annual.groupBy(*by, "fy").agg(*[
        half_even(F.sum(F.when((F.col("bucket") == "total") & (F.col("measure") == m),
                               F.col("value")))).alias(m)
        for m in MEASURES])


def stat_board(cells: DataFrame, pins: Pins, by: tuple[str, ...] = ()) -> DataFrame:
    """Every stat key with value, basis, source_rows and rows_hash.

    The list-valued mover stat has a NULL value here; its rows are
    :func:`~factloom.operators.aggregates.period_movers`.
    """
    stats = headline_stats(cells, pins, by, STAT_KEYS)
    x, y = CORRELATED
    coefficient = series_of(cells, by).groupBy(*by).agg(pearson(F.col(x), F.col(y)).alias("_r"))
    if by:
        joined = stats.join(coefficient, list(by), "left")
        r = F.col("_r")
    else:
        joined, r = stats, coefficient.scalar()
    return joined.select(
        *by, "stat_key",
        F.when(F.col("stat_key") == CORRELATION_STAT, r).otherwise(F.col("value")).alias("value"),
        "basis", "source_rows", "rows_hash")


def board_of(facts: DataFrame, pins: Pins) -> DataFrame:
    """:func:`stat_board` straight from facts, reading only the rows it needs."""
    return stat_board(summarised(facts.filter(stat_sources(pins))), pins)


def catalogue_series() -> list[tuple[str, str]]:
    """Every (figure key, series) of the catalogue."""
    out = [(key, name) for key, series in TREND_FIGURES.items() for name in series]
    out += [(key, name) for key, (name, *_) in RATIO_FIGURES.items()]
    return out + list(TOP_FIGURES.items())


def trend_figures(cells: DataFrame, published: bool = True) -> DataFrame:
    """Rows (figure_key, series, category, value) of the yearly figures; of the published
    ones, a series without any value has no rows."""
    entries = []
    for key, series in TREND_FIGURES.items():
        entries += [(key, name, F.col(m)) for name, m in series.items()]
    for key, (name, parts, whole) in RATIO_FIGURES.items():
        entries.append((key, name, ratio(parts, whole, 1)))
    flat = []
    for key, name, value in entries:
        flat += [F.lit(key), F.lit(name), value]
    long = series_of(cells).select(
        F.col("fy").alias("category"),
        F.stack(F.lit(len(entries)), *flat).alias("figure_key", "series", "value"))
    if not published:
        return long.select("figure_key", "series", "category", "value")
    whole_series = Window.partitionBy("figure_key", "series")
    return long.withColumn("_any", F.count("value").over(whole_series)).filter(
        F.col("_any") > 0).select("figure_key", "series", "category", "value")


def top_figures(facts: DataFrame, pins: Pins, n: int = DEFAULT_TOP_N) -> DataFrame:
    """The entity rankings; both measures are summed in one pass over the year."""
    measures = sorted(set(TOP_FIGURES.values()))
    rows = filter_facts(facts, level=ANNUAL, fy=pins.top_fy, bucket="total").filter(
        F.col("measure").isin(*measures))
    sums = rows.groupBy("measure", "entity_name").agg(F.sum("value").alias("_sum"))
    # every task keeps its own first n per measure before anything is shuffled
    ranked = Window.partitionBy("measure").orderBy(F.desc("_sum"), "entity_name")
    top = sums.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= n)
    keys = F.lit(None).cast("array<string>")
    for m in measures:
        named = F.array(*[F.lit(k) for k, measure in TOP_FIGURES.items() if measure == m])
        keys = F.when(F.col("measure") == m, named).otherwise(keys)
    return top.select(
        F.explode(keys).alias("figure_key"), F.col("measure").alias("series"),
        F.col("entity_name").alias("category"), half_even(F.col("_sum")).alias("value"))


def figures(facts: DataFrame, cells: DataFrame, pins: Pins) -> DataFrame:
    return trend_figures(cells).unionByName(top_figures(facts, pins))


def export_all(facts: DataFrame, pins: Pins) -> DataFrame:
    """Every stat and figure of the catalogue as one table.

    Three passes over the facts: the cell summary, the rankings, the movers.
    """
    cells = summarised(facts, digest=stat_sources(pins))
    board = stat_board(cells, pins).select(
        F.lit("stat").alias("kind"), F.col("stat_key").alias("key"),
        F.lit(None).cast("string").alias("series"), F.lit(None).cast("string").alias("category"),
        "value", "basis")
    fig = figures(facts, cells, pins).select(
        F.lit("figure").alias("kind"), F.col("figure_key").alias("key"), "series", "category",
        "value", F.lit(ANNUAL).alias("basis"))
    movers = period_movers(facts, *pins.mover_fys)
    listed = movers.select(
        F.lit("list").alias("kind"), F.lit(MOVERS_STAT).alias("key"),
        F.stack(F.lit(3), F.lit("fy_a_rate"), F.col("fy_a_rate"), F.lit("fy_b_rate"),
                F.col("fy_b_rate"), F.lit("change"), F.col("change")).alias("series", "value"),
        F.col("entity_name").alias("category"), F.lit(ANNUAL).alias("basis"))
    return board.unionByName(fig).unionByName(listed)


def _json(rows: Column) -> Column:
    return F.to_json(rows, {"ignoreNullFields": "false"})


def listed_values(facts: DataFrame, cells: DataFrame, pins: Pins) -> DataFrame:
    """(stat_key, listed): the value of each key that is a list, as JSON: a figure's rows by category and
    series, and the ``DEFAULT_TOP_N`` largest movers (:func:`period_movers` has them all).  A figure without
    rows has none here."""
    rows = F.array_sort(F.collect_list(F.struct("category", "series", "value")))
    listed = figures(facts, cells, pins).groupBy(F.col("figure_key").alias("stat_key")).agg(_json(rows).alias("listed"))
    movers = period_movers(facts, *pins.mover_fys).orderBy(F.desc(F.abs("change")), "entity_name").limit(DEFAULT_TOP_N)
    ranked = F.array_sort(F.collect_list(F.struct((-F.abs("change")).alias("by"), "entity_name", "fy_a_rate", "fy_b_rate", "change")))
    named = F.transform(ranked, lambda r: F.struct(*[r[c].alias(c) for c in ("entity_name", "fy_a_rate", "fy_b_rate", "change")]))
    return listed.unionByName(movers.agg(F.lit(MOVERS_STAT).alias("stat_key"), _json(named).alias("listed")).select("stat_key", "listed"))


def kpi_values(facts: DataFrame, pins: Pins) -> DataFrame:
    """The stat board with the value of each key: a number, or the JSON text of a list."""
    cells = summarised(facts, digest=stat_sources(pins))
    board = stat_board(cells, pins)
    listed = listed_values(facts, cells, pins)
    return board.join(listed, "stat_key", "left").select(
        "stat_key", "value", "listed", "basis", "source_rows")


def stat(facts: DataFrame, key: str, pins: Pins = PUBLISHED_PINS) -> DataFrame:
    """One key of the catalogue; unknown keys raise ``KeyError``."""
    check_keys([key])
    if key == MOVERS_STAT:
        return period_movers(facts, *pins.mover_fys).orderBy(
            F.desc(F.abs("change")), "entity_name")
    if key in STAT_KEYS:
        return board_of(facts, pins).filter(F.col("stat_key") == key)
    table = top_figures(facts, pins) if key in TOP_FIGURES else trend_figures(
        summarised(facts, digest=False))
    return table.filter(F.col("figure_key") == key)


def headline_table(spark: SparkSession, values: dict[str, float], fy: str,
                   quarter: int) -> DataFrame:
    """Headline constants as rows (fy, quarter, measure, value)."""
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(float(v)).alias("value"))
                     for m, v in values.items()])
    return spark.range(1).select(F.lit(fy).alias("fy"), F.lit(quarter).alias("quarter"),
                                 F.inline(rows))


# -- re-deriving a figure under a filter ----------------------------------------

PUBLISHED, NOT_PUBLISHED = "published", "not_published"
_FILTERABLE = {"requests_received_trend": "received", "requests_finalised_trend": "finalised"}


@dataclass(frozen=True)
class Asked:
    """One figure under one filter; None is no constraint."""

    name: str
    key: str
    entity: str | None = None
    bucket: str | None = None
    fy: str | None = None

    def meets(self) -> Column:
        out = F.lit(True)
        for column, value in (("entity_name", self.entity), ("bucket", self.bucket), ("fy", self.fy)):
            if value is not None:
                out = out & (F.col(column) == value)
        return out

    def entry(self, number: int, pins: Pins) -> Column:
        """What a fact row is to the figure: its category and its value, both null where it has none."""
        total = F.col("bucket") == "total"
        if self.key in _FILTERABLE:
            row = F.col("quarter").isNull()
            used, category = row & total & (F.col("measure") == _FILTERABLE[self.key]), F.col("fy")
        elif self.key in TOP_FIGURES:
            # annual and quarterly rows coexist here; the figure reads the annual ones
            row = used = total & F.col("quarter").isNull() & (F.col("measure") == TOP_FIGURES[self.key]) & (F.col("fy") == pins.top_fy)
            category = F.col("entity_name")
        else:
            raise KeyError(f"{self.key!r} cannot be recomputed under a filter")
        row = F.coalesce(row, F.lit(False))
        return F.when(self.meets(), F.struct(
            F.lit(number).alias("number"), row.alias("shown"), F.when(row, category).alias("category"), F.when(used, F.col("value")).alias("value")))


def rederive_all(facts: DataFrame, asked: Sequence[Asked], pins: Pins) -> DataFrame:
    """Recompute figures from the rows their filters leave, those that still have rows.

    Rows (filter, status, category, value, fact_rows); where nothing that a figure is made of
    survives there is one ``not_published`` row with the number of facts left.  The facts are
    read once: each row is tagged with the filters it meets, and one aggregate sums up every
    filter's categories, map-side.
    """
    check_keys([a.key for a in asked])
    if not asked:
        raise ValueError("nothing is asked")
    met = F.filter(F.array(*[a.entry(i, pins) for i, a in enumerate(asked)]), lambda e: e.isNotNull())
    sums = settled(facts.select(F.inline(met)).groupBy("number", "shown", "category").agg(
        F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"), F.count("value").alias("used")), "rederived")
    left = sums.groupBy("number").agg(F.sum("n").alias("fact_rows"), F.sum("used").alias("used"))
    spark = facts.sparkSession
    names = spark.range(1).select(F.inline(F.array(*[F.struct(
        F.lit(i).alias("number"), F.lit(a.name).alias("filter"), F.lit(a.key in TOP_FIGURES).alias("top")) for i, a in enumerate(asked)])))
    names = names.join(left, "number", "left").fillna(0, ["fact_rows", "used"])
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("value"), "category"))
    rows = sums.filter("shown").select("number", "category", "value")
    tops = [i for i, a in enumerate(asked) if a.key in TOP_FIGURES]
    best = rows.filter(F.col("number").isin(tops)).withColumn("_rank", rank).filter(F.col("_rank") <= DEFAULT_TOP_N).drop("_rank")
    rows = rows.filter(~F.col("number").isin(tops)).unionByName(best)
    rounded = F.floor(F.col("value") + 0.5).cast("double")  # half up, as the page rounds
    published = names.filter("used > 0").join(rows, "number").select(
        "filter", F.lit(PUBLISHED).alias("status"), "category", rounded.alias("value"), "fact_rows")
    return published.unionByName(names.filter("used = 0").select(
        "filter", F.lit(NOT_PUBLISHED).alias("status"), F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("double").alias("value"), "fact_rows"))


def rederive(facts: DataFrame, key: str, pins: Pins, *, entity=None, bucket=None,
             fy=None) -> DataFrame:
    """``rederive_all`` of one filter, without its name."""
    return rederive_all(facts, [Asked("", key, entity, bucket, fy)], pins).drop("filter")
