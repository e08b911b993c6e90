"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.tables import crc32_mod, kept, shared_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Least score of a document that counts as good.
GOOD = 0.3


def quality_model(spark: SparkSession, docs: DataFrame, folder: str):
    """Fitted on rows whose crc32(doc_id) mod 5 isn't 0."""
    from factloom.llm.quality import train

    labels = table(spark, folder, "labels").filter(crc32_mod("doc_id", 5) != 0)
    return train(docs, "doc_id", "text", labels, "quality")


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op1_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
m AS (SELECT x, max(page_id) AS top FROM p GROUP BY x)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(x, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN m USING (x)"""


@query
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    from factloom.llm import warc

    archive = shared_path(spark, "warc")
    warc.write(table(spark, folder, "pages"), archive, "page_id", "url", "html")
    records = kept(warc.read(spark, archive), "warc-records")
    return warc.lookup(records).select(F.col("key").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                                       "record_type", F.col("refers_to_key").alias("refers_to"))


@query
def op2_quality_crf(spark: SparkSession, folder: str) -> DataFrame:
    from factloom.llm.quality import scored

    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc32_mod("doc_id", 5) == 0, F.lit(False))
    made = scored(docs, "text", quality_model(spark, docs, folder))
    return made.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


ORACLES["op3_decontaminate"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS g
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(i) WHERE len(w) >= n),
found AS (SELECT doc_id, i, n, item FROM places JOIN windows USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM found, unnest(range(i, i + n)) t(j) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from factloom.llm.decontaminate import hits

    return hits(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "benchmark"))


@query
def op4_forest(spark: SparkSession, folder: str) -> DataFrame:
    from factloom.llm.forest import nearest

    rows = table(spark, folder, "embeddings")
    return nearest(rows, "vec_id", "embedding", rows.filter(F.col("vec_id") % 20 == 0), 20)


@query
def op5_substrings(spark: SparkSession, folder: str) -> DataFrame:
    from factloom.llm.substrings import removed, repeats

    return removed(repeats(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text"), "doc_id")


@query
def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    from factloom.llm.bpe import round_trip

    return round_trip(table(spark, folder, "documents"), "doc_id", "text", tokenizer("byte_bpe_50k.json"))


@query
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from factloom.llm.token_counts import token_counts

    docs, path, cache = table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), shared_path(spark, "token-cache")
    # an earlier run over some documents: what it stored is found again, and all documents are counted below
    token_counts(docs.filter(crc32_mod("doc_id", 4) == 0), "doc_id", "text", path, cache)
    made = token_counts(docs, "doc_id", "text", path, cache)
    return made.withColumn("over_limit", F.col("n_tokens") > 1024)


@query
def op8_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    from factloom.llm.class_lm import scored

    made = scored(table(spark, folder, "documents"), "doc_id", "text", crc32_mod("doc_id", 10) != 0)
    return made.withColumn("held_out", F.coalesce(crc32_mod("doc_id", 10) == 0, F.lit(False)))


@query
def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from factloom.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), "doc_id", "text")


def _license_sql() -> str:
    from factloom.llm.licenses import TEMPLATES

    rows = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
    words = "regexp_extract_all(" + _LOWER.format("text") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH templates(tid, name, text) AS (VALUES {rows}),
d AS (SELECT doc_id, {words} AS w FROM documents),
t AS (SELECT tid, name, {words} AS w FROM templates),
sets AS (SELECT DISTINCT tid, name, list_slice(w, i, i + 4) AS g FROM t, unnest(range(1, len(w) - 3)) r(i)),
sized AS (SELECT *, count(*) OVER (PARTITION BY tid) AS n FROM sets),
rival AS (SELECT t.tid, u.tid AS rid FROM sized t JOIN sets u ON t.g = u.g AND t.name <> u.name GROUP BY t.tid, u.tid, t.n HAVING 2 * count(*) >= t.n),
lacks AS (SELECT r.tid, r.rid, s.g FROM rival r JOIN sets s ON s.tid = r.tid
  WHERE NOT EXISTS (SELECT 1 FROM sets u WHERE u.tid = r.rid AND u.g = s.g)),
least AS (SELECT tid, rid, count(*) AS m FROM lacks GROUP BY ALL),
places AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM d, unnest(range(1, len(w) - 3)) r(i) WHERE len(w) >= 5),
found AS (SELECT doc_id, tid, name, n, i, g FROM places JOIN sized USING (g)),
hit AS (SELECT DISTINCT a.doc_id, a.tid, a.name, a.n, a.i, b.g FROM found a JOIN found b
  ON a.doc_id = b.doc_id AND a.tid = b.tid AND b.i BETWEEN a.i AND a.i + a.n + a.n // 2 - 1),
runs AS (SELECT doc_id, tid, name, n, i, count(*) AS k FROM hit GROUP BY ALL HAVING 100 * count(*) >= 75 * n),
weak AS (SELECT DISTINCT r.doc_id, r.tid, r.i FROM runs r JOIN least l USING (tid) LEFT JOIN (
    SELECT doc_id, tid, i, rid, count(*) AS c FROM hit JOIN lacks USING (tid, g) GROUP BY ALL) o
  ON o.doc_id = r.doc_id AND o.tid = r.tid AND o.i = r.i AND o.rid = l.rid WHERE 100 * coalesce(c, 0) < 75 * m),
held AS (SELECT doc_id, tid, name, max(k)::DOUBLE / n AS share FROM runs r
  WHERE NOT EXISTS (SELECT 1 FROM weak w WHERE w.doc_id = r.doc_id AND w.tid = r.tid AND w.i = r.i) GROUP BY doc_id, tid, name, n),
listed AS (SELECT doc_id, count(*) AS n, max(share) AS share, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM held GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::INT AS n_templates, coalesce(names, '') AS licenses, share AS containment
FROM d LEFT JOIN listed USING (doc_id)"""


ORACLES["op10_license_scan"] = _license_sql()


@query
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    from factloom.llm.licenses import scanned

    made = scanned(table(spark, folder, "documents").select("doc_id", "text"), "text")
    names = F.array_join(F.array_sort(F.array_distinct(F.col("matches.license"))), ",")
    return made.select("doc_id", "n_words", F.size("matches").alias("n_templates"), names.alias("licenses"),
                       F.array_max(F.col("matches.containment")).alias("containment"))


@query
def op11_id_store(spark: SparkSession, folder: str) -> DataFrame:
    """Every document is found again by its key, through the index."""
    from factloom.llm import id_store

    docs, store = table(spark, folder, "documents"), shared_path(spark, "ids")
    id_store.write(docs, "doc_id", "text", tokenizer("word_bpe_49k.json"), 2, store)
    keys = docs.groupBy("doc_id").agg(F.count("*").alias("n")).select(F.col("doc_id").cast("string").alias("key"),
                                                                      F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    found = id_store.fetch(id_store.lookup(keys, store), store, payload=False).join(id_store.shards(spark, store), "shard")
    return found.select(F.col("key").cast("long").alias("doc_id"), (F.col("first_id") + F.col("offset")).alias("start"), F.col("n").alias("n_tokens"),
                        F.col("crc32").alias("ids_crc32"))


ORACLES["op12_turn_trie"] = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({'r': r, 'x': x} ORDER BY p) AS q, c::VARCHAR AS s FROM t GROUP BY c),
hashed AS (SELECT c, c - c % 5 AS base, q, xor(list_reduce(list_concat([4294967295::BIGINT],
    flatten(list_transform(range(1, length(s) + 1), lambda i: [ascii(substr(s, i::INT, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, v: xor(xor(a, v) >> 1, 3988292384 * (xor(a, v) & 1))), 4294967295) % 9 AS h FROM own),
rebuilt AS (SELECT a.c, list_concat(coalesce(list_slice(b.q, 1, a.h), []), list_slice(a.q, a.h + 1, len(a.q))) AS q
  FROM hashed a LEFT JOIN own b ON a.base = b.c),
path AS (SELECT c, len(q) AS n, d, list_slice(q, 1, d) AS k FROM rebuilt, unnest(range(0, len(q) + 1)) u(d)),
node AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends
  FROM path GROUP BY d, k),
kids AS (SELECT d - 1 AS d, list_slice(k, 1, d - 1) AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(n, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(k[d].x) END AS saved
  FROM node LEFT JOIN kids USING (d, k)),
sums AS (SELECT e AS d, list_slice(k, 1, e) AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved
  FROM full_node, unnest(range(0, d + 1)) u(e) GROUP BY ALL)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM full_node f JOIN sums s ON f.d = s.d AND f.k = s.k LEFT JOIN node p ON p.d = f.d - 1 AND p.k = list_slice(f.k, 1, f.d - 1)"""


@query
def op12_turn_trie(spark: SparkSession, folder: str) -> DataFrame:
    from factloom.llm import turn_trie

    said = turn_trie.turns(table(spark, folder, "conversations"), "conv_id", "turn", "role", "text")
    return turn_trie.trie(*turn_trie.spliced(said)).drop("a", "b")


@query
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    from factloom.llm.whitening import fitted, whitened

    rows = table(spark, folder, "embeddings")
    return whitened(rows, "vec_id", "embedding", fitted(rows, "embedding", 4))


def load() -> tuple[dict, dict]:
    return dict(QUERIES), dict(ORACLES)
