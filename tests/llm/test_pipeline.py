import importlib
import os

import pytest

import corpus_pipeline
from factloom.llm import decontaminate, near_dup, substrings
from factloom.llm.queries import load, quality_model
from factloom.llm.quality import scored
from factloom.llm.tables import table

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage does what its operator says, on what the stage before it has kept."""
    docs = table(spark, FOLDER, "documents")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs)
    keys = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    model = quality_model(spark, seen[0], FOLDER)
    assert keys[1] == {r.doc_id for r in scored(seen[0].select("doc_id", "text"), "text", model).filter("score >= 0.3").collect()} and len(keys[1]) < len(keys[0])
    assert keys[2] == {r.doc_id for r in near_dup.near_duplicates(seen[1], "doc_id", "text").filter("kept").collect()} and len(keys[2]) < len(keys[1])
    assert keys[3] == keys[2] == keys[4]
    assert substrings.removed(substrings.repeats(seen[2], "doc_id", "text"), "doc_id").agg({"n_removed": "sum"}).first()[0] > 0
    items = table(spark, FOLDER, "benchmark")
    assert decontaminate.hits(seen[3], "doc_id", "text", items).filter("contaminated").count() > 0
    assert decontaminate.hits(seen[4], "doc_id", "text", items).filter("contaminated").count() == 0
    for d in seen:
        assert d.filter("n_chars != char_length(text)").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.filter("NOT exact").count() == 0 and last.count() == len(keys[4])


def test_stages_against_brute_force(spark):
    """Each stage's rows from those of the stage before, also with null, empty and repeated ones."""
    from test_documents import brute_groups, brute_removed
    from test_text_scans import brute_hits, words
    from tokenizers import Tokenizer

    from factloom.llm.queries import tokenizer

    docs = table(spark, FOLDER, "documents")
    text = docs.orderBy("doc_id").first().text
    odd = [(10 ** 6, None, None, None, None), (10 ** 6 + 1, "", "en", "s", 0), (10 ** 6 + 2, text, "en", "s", len(text)), (10 ** 6 + 2, text, "en", "s", len(text)),
           (10 ** 6 + 3, "ünï\n\n" * 300, "de", None, 2100)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    model, seen = quality_model(spark, table(spark, FOLDER, "documents"), FOLDER), []
    for name, stage in [(None, lambda s, d, f: d), *corpus_pipeline.STAGES]:
        docs = stage(spark, docs, FOLDER)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/brute-{name}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs)
    rows = [[(r.doc_id, r.text) for r in d.orderBy("doc_id", "text").collect()] for d in seen[:-1]]
    good = {r.doc_id for r in scored(seen[0].select("doc_id", "text"), "text", model).filter("score >= 0.3").collect()}
    assert rows[1] == [r for r in rows[0] if r[0] in good] and good < {k for k, _ in rows[0]}
    stays = [g[0] for g in brute_groups(rows[1]) if g[-1]]
    assert [k for k, _ in rows[2]] == sorted(set(stays)) and {*rows[2]} <= {*rows[1]}
    for (key, after), (_, before), (_, size, gone, spans, _) in zip(rows[3], rows[2], brute_removed(rows[2], 100), strict=True):
        left = len((after or "").encode())
        assert size - gone <= left <= size - gone + 4 * spans and (gone or after == before), key
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    hits = {k: n for k, _, n, *_ in brute_hits(rows[3], items)}
    assert any(hits.values())
    for (key, after), (_, before) in zip(rows[4], rows[3], strict=True):
        assert after == before if not hits[key] else len(words(after)) == len(words(before)) - hits[key], key
    encode = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    made = {r.doc_id: r for r in seen[5].collect()}
    assert len(made) == len(rows[4])
    for key, text in rows[4]:
        assert list(made[key].ids) == encode.encode(text or "", add_special_tokens=False).ids and made[key].exact


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 100


def test_every_operator_has_a_query(spark):
    queries, oracles = load()
    assert sorted(int(n[2:].split("_")[0]) for n in queries) == [*range(1, 14)]
    assert {*oracles} <= {*queries}


@pytest.mark.parametrize("name", sorted(load()[1]))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    queries, oracles = load()
    made = queries[name](spark, FOLDER)
    got = sorted(map(repr, made.select(sorted(made.columns)).collect()))
    listed = ", ".join(sorted(made.columns))
    row = type(made.first())
    want = con.execute(f"SELECT {listed} FROM ({oracles[name]})").fetchall()
    names = sorted(made.columns)
    assert got == sorted(repr(row(**dict(zip(names, r)))) for r in want)


def test_the_rest_does_without():
    root = os.path.dirname(importlib.import_module("factloom").__file__)
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as text:
                        assert "factloom.llm" not in text.read()
