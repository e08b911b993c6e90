"""Lineage tables: transcripts, recorded stats, replay and reports.

Reports are long tables, one row per child, so an artifact with a third of all
calls is many rows in many tasks, never one nested value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.periods import epoch_micros
from factloom.operators.sequence import latest_by_key, numbered
from factloom.operators.specs import panel_key
from factloom.plans.stats import FIGURE_KEYS, STAT_KEYS
from factloom.sources.shared import settled


def assign_seq(events: DataFrame, key: str, order: list[str], slice_by: Column) -> DataFrame:
    """Running call number per build, never restarting within one."""
    return numbered(events, [key], order, slice_by, "seq")


def transcript_table(events: DataFrame) -> DataFrame:
    """Tool-call events as rows with their call number."""
    calls = events.filter(F.col("event") == "tool_call")
    hour = F.floor(epoch_micros(F.col("ts")) / 3_600_000_000)
    ordered = assign_seq(calls, "artifact_id", ["ts", "event_id"], hour)
    return ordered.select(
        "artifact_id", F.col("seq").cast("int").alias("seq"), "tool", "op",
        F.col("args").alias("input_json"), F.col("result").alias("output_json"))


def update_artifact(artifacts: DataFrame, changes: DataFrame) -> DataFrame:
    """New version rows for ``changes`` (artifact_id, spec_json, status).

    NULL leaves a field as it was; a change of nothing gives no row.
    """
    latest = latest_by_key(artifacts, ["artifact_id"], ["version"])
    wanted = changes.filter(F.col("spec_json").isNotNull() | F.col("status").isNotNull()).select(
        "artifact_id", F.col("spec_json").alias("_spec"), F.col("status").alias("_status"))
    return latest.join(wanted, "artifact_id").withColumns({
        "version": F.col("version") + 1,
        "spec_json": F.coalesce("_spec", "spec_json"),
        "status": F.coalesce("_status", "status"),
    }).select(*artifacts.columns)


def record_stat_ops(panel_rows: DataFrame, board: DataFrame, dataset_id: int = 1,
                    listed: DataFrame | None = None) -> DataFrame:
    """One op row per panel that cites a catalogue key, with that key's hash and value: a number,
    the JSON text that ``listed`` (stat_key, listed) has for it, or ``null``."""
    if listed is not None:
        board = board.join(listed, "stat_key", "left")
    else:
        board = board.withColumn("listed", F.lit(None).cast("string"))
    cited = panel_rows.withColumn("op", panel_key(STAT_KEYS, FIGURE_KEYS)).filter(
        F.col("op").isNotNull())
    return cited.join(board, cited["op"] == board["stat_key"]).select(
        "artifact_id", F.lit(dataset_id).cast("bigint").alias("dataset_id"), "pos",
        F.lit("figure").alias("kind"), "op", F.lit("{}").alias("params"),
        F.col("source_rows").alias("row_count"), "rows_hash",
        F.coalesce(F.col("value").cast("string"), "listed", F.lit("null")).alias("result_value"))


def replay_verify(ops: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Compare stored hashes with recomputed ones; stored values are never trusted.

    ``recomputed`` has (dataset_id, stat_key, rows_hash).  An op without a stored
    hash, or whose snapshot or key cannot be recomputed, is not verified.
    """
    fresh = recomputed.select(
        F.col("dataset_id").alias("_dataset"), F.col("stat_key").alias("_key"),
        F.col("rows_hash").alias("_hash"))
    joined = ops.join(
        fresh, (F.col("dataset_id") == F.col("_dataset")) & (F.col("op") == F.col("_key")), "left")
    stored = F.nullif(F.col("rows_hash"), F.lit(""))
    status = (
        F.when(stored.isNull() | F.col("_hash").isNull(), "unverifiable")
        .when(stored == F.col("_hash"), "verified").otherwise("mismatch"))
    return joined.select(*ops.columns, status.alias("status"),
                         (status == "verified").alias("verified"))


def lineage_report(artifacts: DataFrame, snapshots: DataFrame, ops: DataFrame,
                   tool_calls: DataFrame) -> DataFrame:
    """The whole record of an artifact: itself, its snapshot, and its ops (by id) and tool
    calls (by seq).

    One row per child with ``ord`` inside its kind; ``input`` is an op's params or a call's
    input.  Artifacts without children have one row without a kind.  The children are
    written once: they are joined, and tell who has any.
    """
    children = settled(ops.select(
        F.col("artifact_id").alias("_artifact"), F.lit("op").alias("child"),
        F.col("op_id").cast("bigint").alias("ord"), F.col("kind").alias("name"), "op",
        F.col("params").alias("input"), F.col("result_value").alias("payload"),
        F.col("row_count").cast("bigint").alias("row_count"), "rows_hash").unionByName(
        tool_calls.select(
            F.col("artifact_id").alias("_artifact"), F.lit("tool_call").alias("child"),
            F.col("seq").cast("bigint").alias("ord"), F.col("tool").alias("name"), "op",
            F.col("input_json").alias("input"), F.col("output_json").alias("payload")),
        allowMissingColumns=True), "children")
    header = snapshots.select(
        F.col("dataset_id").alias("_dataset"), "period_label", "window_mode", "source_files",
        "normaliser_ver", "content_digest", "fact_count")
    head = artifacts.select(
        "artifact_id", "artifact_type", "artifact_key", "user_id", "dataset_id", "request_text",
        "spec_json", "model", "status").join(
        header, F.col("dataset_id") == F.col("_dataset"), "left").drop("_dataset")
    return _with_children(head, children)


def _with_children(head: DataFrame, children: DataFrame) -> DataFrame:
    """``head`` left-joined to ``children`` on the artifact.

    Written as an inner join plus the childless rows: an inner join may be split
    on its large (child) side when one artifact holds most children, a left join
    may not.
    """
    inner = head.join(children, F.col("artifact_id") == F.col("_artifact")).drop("_artifact")
    parents = children.select("_artifact").distinct()
    alone = head.join(parents, F.col("artifact_id") == F.col("_artifact"), "left_anti")
    return inner.unionByName(alone, allowMissingColumns=True)


def load_dashboard(artifacts: DataFrame, tool_calls: DataFrame,
                   artifact_id: int | None = None) -> DataFrame:
    """Latest spec of an artifact (or of all) beside its transcript rows in order."""
    latest = latest_by_key(artifacts, ["artifact_id"], ["version"])
    if artifact_id is not None:
        latest = latest.filter(F.col("artifact_id") == artifact_id)
        tool_calls = tool_calls.filter(F.col("artifact_id") == artifact_id)
    calls = tool_calls.select(F.col("artifact_id").alias("_artifact"), "seq", "tool",
                              F.col("output_json").alias("result"))
    joined = _with_children(latest.select("artifact_id", "spec_json", "dataset_id"), calls)
    return joined.orderBy("seq") if artifact_id is not None else joined
