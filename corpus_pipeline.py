"""From raw documents to token ids: the stages of a training corpus, in order.

A stage reads what the one before it has kept and leaves out or changes what it decides on; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, decontaminate, near_dup, quality, substrings
from factloom.llm.queries import GOOD, quality_model, tokenizer
from factloom.llm.tables import kept, table


def _measured(docs: DataFrame) -> DataFrame:
    """With ``n_chars`` as the text now is."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as good; texts stay as they are."""
    model = quality_model(spark, docs, sf_dir)
    return quality.scored(docs, "text", model, "_quality", keep_text=True).filter(F.col("_quality") >= GOOD).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id."""
    return near_dup.deduplicated(docs, "doc_id", "text")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that an earlier place has; every document stays."""
    return _measured(substrings.cleaned(substrings.repeats(docs, "doc_id", "text"), docs.columns, "text"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of benchmark items; every document stays."""
    return _measured(decontaminate.decontaminated(docs, "text", table(spark, sf_dir, "benchmark")))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, exact): token ids, and whether they decode to the text."""
    made = bpe.encoded(docs.select("doc_id", "lang", "source", "text"), "text", tokenizer("byte_bpe_50k.json"), "ids", verify="exact")
    return made.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")


#: (name, function of (spark, docs, folder)).
STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: The first stage is a trained classifier and others walk byte strings: SQL can't express run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = kept(docs, f"pipeline-{name}")
    return docs
