"""Ordered rule screening of text rows."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# The published rule texts.
# --------------------------------------------------------------------------

INJECTION = (
    r"ignore (all |any |your )?(previous|prior|above)|you are now|"
    r"act as (if )?(an? )?(unrestricted|dan|jailbreak)|disregard (your )?(rules|instructions)|"
    r"reveal (your |the )?(system |model |prompt|instructions|key)|"
    r"what('s| is) your (system prompt|instructions|model)|"
    r"execute (arbitrary )?(shell|code|command)|run (any )?code|"
    r"export (your |the )?(api|key|secret)|access (the )?(file system|database|server)|"
    r"show (me )?(your )?(internal|hidden|raw) (prompt|output|instructions)"
)
OUT_OF_SCOPE = (
    r"immigration|visa|citizenship|tax (advice|return)|"
    r"welfare|centrelink|benefit (payments?|recipients?|claims?|advice)|pension|medicare|"
    r"health (advice|treatment)|defence (ops|operations|planning)|military (ops|strategy)|"
    r"united states|\busa\b|\buk\b|united kingdom|france|germany|china|russia|"
    r"canada|canadian|new zealand|mexico|mexican|japan|japanese|india|indian|"
    r"italy|italian|spain|spanish|europe|european|dutch|"
    r"crypto|bitcoin|stock (market|tip)|trading strategy|foreign (foi|freedom)|"
    r"personal (medical|financial) (info|record)|named individual|(?:a|an) (?:specific )?(?:person|individual)\b"
)
COUNTRY_CODE = (
    r"\b(?:US|U\.S\.|u\.s\.)\s+(?i:government|federal|state|health|healthcare|defen|"
    r"military|agenc|congress|president|citizenship|visa|state department|foi|freedom)"
)
FOREIGN_ADJECTIVE = (
    r"\b(?:german|french|british|american|canadian|chinese|russian|japanese|"
    r"european|italian|spanish|mexican|indian|dutch|new zealand)"
    r"\s+(?:foi|freedom(?: of information)?)\b"
)
FOREIGN_CODE = r"\b(?:US|UK|USA|NZ)\s+(?:FOI|freedom(?: of information)?)\b"
SCOPE_TERMS = (
    "foi", "freedom of information", "request", "requests", "received", "finalis",
    "decided", "decision", "outcome", "granted", "refused", "withdrawn", "timeliness",
    "statutory", "agency", "agencies", "portfolio", "quarter", "year", "trend",
    "compare", "top", "contributor", "home affairs", "services australia",
)


@dataclass(frozen=True)
class Rule:
    """A pattern that refuses a text; ``verdict`` names the refusal."""

    rule_id: str
    verdict: str
    pattern: str
    ignore_case: bool = True

    def hits(self, text: Column) -> Column:
        # U: word boundaries and classes are Unicode on every Java version
        return text.rlike(("(?Uiu)" if self.ignore_case else "(?U)") + self.pattern)


SCOPE_RULES = (
    Rule("injection", "injection", INJECTION),
    Rule("out_of_scope", "out_of_scope", OUT_OF_SCOPE),
    Rule("country_code", "out_of_scope", COUNTRY_CODE, ignore_case=False),
    Rule("foreign_adjective", "out_of_scope", FOREIGN_ADJECTIVE),
    Rule("foreign_code", "out_of_scope", FOREIGN_CODE, ignore_case=False),
)


def scope_screen(rows: DataFrame, text: str = "text", rules: Iterable[Rule] = SCOPE_RULES,
                 terms: Iterable[str] = SCOPE_TERMS) -> DataFrame:
    """Add ``verdict`` and ``rule_id``; the first rule that hits decides.

    Order: empty text, the rules as given, then (when ``terms`` are given) texts
    without any of the terms; everything else is allowed.  A narrow projection:
    no shuffle, whole texts, no Python.
    """
    body = F.col(text)
    hit = F.when(body.isNull() | ~body.rlike(r"(?U)\S"), F.struct(
        F.lit("empty").alias("verdict"), F.lit("empty").alias("rule_id")))
    for rule in rules:
        hit = hit.when(rule.hits(body), F.struct(
            F.lit(rule.verdict).alias("verdict"), F.lit(rule.rule_id).alias("rule_id")))
    terms = list(terms)
    if terms:
        lowered, found = F.lower(body), None
        for term in terms:
            has = F.contains(lowered, F.lit(term))
            found = has if found is None else found | has
        hit = hit.when(~found, F.struct(
            F.lit("off_topic").alias("verdict"), F.lit("no_scope_term").alias("rule_id")))
    hit = hit.otherwise(F.struct(
        F.lit("allowed").alias("verdict"), F.lit(None).cast("string").alias("rule_id")))
    return rows.withColumn("_hit", hit).select(
        *rows.columns, F.col("_hit.verdict").alias("verdict"),
        F.col("_hit.rule_id").alias("rule_id"))
