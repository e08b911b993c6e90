"""Citation pointers ``{c:job.turn.call.path}`` resolved against recorded results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.schema import POINTER_PATTERN, POINTER_STEP

CITED_TOOL = "query_dataset"


def find_pointers(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per pointer in a text, with its position (0-based)."""
    found = F.regexp_extract_all(F.col(text), F.lit(POINTER_PATTERN), F.lit(1))
    return texts.select(*[c for c in texts.columns if c != text],
                        F.posexplode(found).alias("pos", "pointer"))


def json_path(dotted: Column) -> Column:
    """``top[0].agency`` or ``top.0.agency`` as a JSON path."""
    tokens = F.regexp_extract_all(dotted, F.lit(POINTER_STEP), F.lit(0))
    steps = F.transform(
        tokens,
        lambda t: F.when(t.startswith("["), t).when(t.rlike(r"^\d+$"), F.concat(
            F.lit("["), t, F.lit("]"))).otherwise(F.concat(F.lit("."), t)))
    return F.concat(F.lit("$"), F.array_join(steps, ""))


def resolve_pointers(pointers: DataFrame, transcript: DataFrame, key: str = "artifact_id",
                     tool: str = CITED_TOOL, recorded: str | None = None) -> DataFrame:
    """Add ``value`` and ``status`` to pointer rows.

    ``transcript`` has ``key``, seq, tool and result (JSON text).  Only the turn
    part selects the call, and only calls of ``tool`` count; of several with one
    seq the first recorded is kept, by the column ``recorded`` (by result text
    where none is named), so the lookup side is unique and each
    pointer stays one row.  A call cited by a third of all pointers is a skewed
    left join, which adaptive execution splits on the pointer side.
    """
    parts = F.split(F.col("pointer"), r"\.")
    turn = F.element_at(parts, 2)
    path = F.array_join(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), ".")
    parsed = pointers.withColumns({
        "_parts": F.size(parts),
        "_turn": F.when((F.size(parts) >= 4) & turn.rlike(r"^\d+$"), turn.try_cast("bigint")),
        "_path": F.when(F.size(parts) >= 4, json_path(path)),
    })
    calls = transcript.filter(F.col("tool") == tool).groupBy(
        F.col(key).alias("_key"), F.col("seq").cast("bigint").alias("_seq")).agg(
        (F.min("result") if recorded is None else F.min_by("result", F.struct(recorded, "result"))).alias("_result"))
    joined = parsed.join(
        calls, (F.col(key) == F.col("_key")) & (F.col("_turn") == F.col("_seq")), "left")
    found = F.try_variant_get(F.try_parse_json("_result"), F.col("_path"), "variant")
    kind = F.schema_of_variant(found)
    # numbers stay as they are recorded, a float with its fraction; 1e16 and more in E notation
    value = (
        F.when(kind == "VOID", "None")
        .when(kind == "BOOLEAN", F.initcap(found.cast("string")))
        .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.expr("get_json_object(_result, _path)"))
        .otherwise(found.cast("string")))
    status = (
        F.when(F.col("_parts") < 4, "too_short")
        .when(F.col("_turn").isNull(), "bad_turn")
        .when(F.col("_seq").isNull(), "no_call")
        .when(found.isNull(), "no_field")
        .otherwise("resolved"))
    return joined.select(*pointers.columns, value.alias("value"), status.alias("status"))


def resolve_citations(texts: DataFrame, transcript: DataFrame, ids: Iterable[str],
                      text: str = "text", key: str = "artifact_id",
                      strict: bool = False) -> DataFrame:
    """Texts with each pointer replaced by its recorded value.

    Adds ``resolved_text`` and ``unresolved`` (how many pointers stayed as they
    were).  ``strict`` fails the job at the first unresolved pointer instead.
    Replacement is positional, so a value that looks like a pointer is kept.
    """
    ids = list(ids)
    resolved = resolve_pointers(find_pointers(texts.select(*dict.fromkeys([*ids, key]), text),
                                              text), transcript, key)
    kept = F.concat(F.lit("{c:"), F.col("pointer"), F.lit("}"))
    if strict:
        kept = F.raise_error(F.concat(F.lit("citation "), F.col("pointer"), F.lit(": "),
                                      F.col("status")))
    piece = F.when(F.col("status") == "resolved", F.col("value")).otherwise(kept)
    per_text = resolved.groupBy(*[F.col(c).alias(f"_{c}") for c in ids]).agg(
        F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))).alias("_pieces"),
        F.count_if(F.col("status") != "resolved").alias("_unresolved"))
    on = None
    for c in ids:
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        on = same if on is None else on & same
    literals = F.split(F.col(text), POINTER_PATTERN.replace("(", "(?:", 1), -1)
    pieces = F.concat(F.transform("_pieces", lambda p: p["piece"]), F.array(F.lit("")))
    rebuilt = F.array_join(F.zip_with(literals, pieces, lambda a, b: F.concat(a, b)), "")
    return texts.join(per_text, on, "left").select(
        *texts.columns,
        F.when(F.col("_pieces").isNull(), F.col(text)).otherwise(rebuilt).alias("resolved_text"),
        F.coalesce("_unresolved", F.lit(0)).alias("unresolved"))
