"""Token counts through a cache of digests.

The cache is a Parquet table (content digest, tokenizer digest, count) that only grows. A run
digests every text, looks the distinct digests up, encodes one text of each digest that is
missing, appends those counts, and joins all rows to the cache. Counts are bound to the
tokenizer file by its own digest, so a changed file never meets old counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import bpe
from factloom.llm.tables import kept

CACHE = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("tokenizer", T.StringType()),
                      T.StructField("n_tokens", T.LongType())])


def tokenizer_digest(path: str) -> str:
    """SHA-256 of a tokenizer file, with the library that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return f"{library}:{hashlib.sha256(f.read()).hexdigest()}"


def counted(df: DataFrame, text: str, path: str) -> DataFrame:
    """``df`` with ``n_tokens`` in place of ``text``: as the file's library counts, without
    begin, end or other added tokens. Plain byte-level BPE files use this package's encoder,
    others their library (``tokenizers`` for .json, ``sentencepiece`` for .model)."""
    if path.endswith(".json"):
        try:
            bpe.loaded(path)
            return bpe.counted(df, text, path)
        except ValueError:
            pass  # another kind of file
    fields = [f for f in df.schema.fields if f.name not in (text, "n_tokens")]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            count = lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(text).to_pylist()]
            made = pa.array(np.array(count(texts) if texts else [], np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), made], names=[*names, "n_tokens"])

    return df.mapInArrow(run, T.StructType([*fields, T.StructField("n_tokens", T.LongType())]))


def token_counts(df: DataFrame, key: str, text: str, path: str, cache: str) -> DataFrame:
    """(key, n_bytes, n_tokens) of every row of ``df``.

    ``cache``: folder of the count table, made where it is missing. It must be one that all
    executors share, and has one writer at a time. Null texts count as empty: 0 bytes, 0 tokens.
    Null and repeated keys stay, a row each; other columns, whatever their names, aren't read.
    """
    spark, tokenizer = df.sparkSession, tokenizer_digest(path)
    rows = df.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("content", F.unhex(F.sha2("text", 256)))
    light = kept(rows.select("key", "content", F.octet_length("text").cast("long").alias("n_bytes")), "token-digests")

    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    # without broadcasts: what is known grows with the corpus
    known = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == tokenizer).select("content")
    missing = light.groupBy("content").agg(F.min("key").alias("first")).join(known, "content", "left_anti")
    missing = missing.select(F.col("content").alias("content_"), "first")
    texts = rows.join(missing, (F.col("content") == F.col("content_")) & F.col("key").eqNullSafe(F.col("first")), "left_semi")
    counts = counted(texts.select("content", "text"), "text", path).dropDuplicates(["content"])
    counts.select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)

    held = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == tokenizer).select("content", "n_tokens")
    return light.join(held, "content").select(F.col("key").alias(key), "n_bytes", "n_tokens")
