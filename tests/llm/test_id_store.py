import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from factloom.llm import id_store

WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def encoded(path, texts):
    model = Tokenizer.from_file(path)
    return [x.ids for x in model.encode_batch(texts, add_special_tokens=False)]


ODD = ["Hello World's x́ don't", "é ́a b\x85c", "<|endoftext|> a<|startoftext|>b .<|endoftext|>.", "\x1c\x1d a\tb\nc\rd\x0be\x0cf",
       "Å각 ﬁ İI", "x" * 5000, "12 345,6!!.. ('s", "中文 \U0001f600\U0001f600 กำ", " ̈", "# # #", "H̱ẖ İ. Ab,Ab, AB.,! ab). <|ENDOFTEXT|>. <|endoftext|>, x's. X'S! 1.5. é. É!, k;̈ a.̈ . ., ..a"]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_words_encode_as_texts(path, corpus):
    import pyarrow as pa

    texts = [t or "" for _, t in corpus] + ODD
    encode = id_store.Encoder(path)
    assert encode.words == (path == WORDS)
    for some in (texts, texts[::3]):  # the second time from memory
        counts, ids = encode(pa.array(some, pa.string()))
        want = encoded(path, some)
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_perfect_hashes_are_minimal():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 1000, 40_000):
        h = rnd.integers(0, 1 << 63, n).astype(np.uint64)
        sizes, words = id_store.perfect(h)
        assert sorted(id_store.slots(h, sizes, words).tolist()) == list(range(n))
        other = id_store.slots(rnd.integers(0, 1 << 63, 50).astype(np.uint64), sizes, words)
        assert ((other >= -1) & (other < max(n, 1))).all()
    with pytest.raises(ValueError, match="same hash"):
        id_store.perfect(np.array([5, 5], np.uint64))


def test_damage_is_noticed():
    whole = id_store.packed([np.array([1, 2, 70_000])], [3], ["é"], 4) + b"\n"
    ids, sizes, keys = id_store.opened(whole)
    assert (ids.tolist(), sizes.tolist(), keys) == ([1, 2, 70_000], [3], ["é"])
    assert id_store.opened(id_store.packed([], [], [None, ""][:0], 2) + b"\n")[2] == []
    for bad in (whole[:-1], whole[1:], whole[:3] + whole[7:], b""):
        with pytest.raises(ValueError):
            id_store.opened(bad)


def found(spark, folder, keys):
    asked = spark.createDataFrame(keys, "key string, copy long")
    places = id_store.lookup(asked, folder)
    return {(r.key, r.copy): r for r in id_store.fetch(places, folder).join(id_store.shards(spark, folder), "shard").collect()}


@pytest.mark.parametrize("shard_ids, task_bytes, bucket", [(1 << 22, 16 << 20, 1 << 15), (500, 4000, 16)])
def test_every_document_is_found(spark, table, corpus, tmp_path, shard_ids, task_bytes, bucket):
    rows = corpus + [(400 + i, t) for i, t in enumerate(ODD)] + [(-7, "below zero")]
    folder = str(tmp_path / "store")
    id_store.write(table(rows, files=3), "doc_id", "text", WORDS, 2, folder, shard_ids, task_bytes, bucket)
    entries = id_store.directory(spark, folder).collect()
    assert len(entries) == len(rows)
    want = {}
    for (k, _), ids in zip(rows, encoded(WORDS, [t or "" for _, t in rows])):
        want.setdefault(k, []).append(tuple([*ids, 2]))
    got = found(spark, folder, [(None if k is None else str(k), c) for k, v in want.items() for c in range(len(v))])
    assert len(got) == len(rows)
    start = 0
    for k in sorted(want, key=lambda k: (k is not None, k or 0)):
        mine = [got[None if k is None else str(k), c] for c in range(len(want[k]))]
        for r in mine:
            data = bytes(r.ids)
            assert r.first_id + r.offset == start and r.n * 4 == len(data) and r.crc32 == zlib.crc32(data)
            start += r.n
        assert sorted(tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in mine) == sorted(want[k])
    # what isn't there isn't found
    none = id_store.lookup(spark.createDataFrame([("999999", 0), ("7", 99), ("", 0), ("100", -1)], "key string, copy long"), folder).collect()
    assert len(none) == 4 and all(r.shard is None and r.offset is None and r.n is None for r in none)
    if shard_ids == 500:
        held = id_store.shards(spark, folder).collect()
        assert len(held) > 20 and max(r.n_ids for r in held if r.n_docs > 1) < 500 + max(map(len, want[109]))


def test_a_few_keys_open_a_few_files(spark, table, corpus, tmp_path, monkeypatch):
    folder = str(tmp_path / "store")
    id_store.write(table(corpus), "doc_id", "text", WORDS, 2, folder, 300, 3000, 8)
    asked = []
    monkeypatch.setattr(id_store, "_files", lambda s, f, names=None, real=id_store._files: asked.append(names) or real(s, f, names))
    assert len(found(spark, folder, [("3", 0), ("3", 0), ("nobody", 0)])) == 1
    assert len(asked) == 1 and len(asked[0]) == 1
    assert found(spark, folder, [("nobody", 0)]) == {} and asked[1] == []


def test_a_key_with_a_third_of_all_rows(spark, table, tmp_path):
    rows = [(5, f"text {i} " * 20) for i in range(400)] + [(i + 10, "other") for i in range(800)]
    folder = str(tmp_path / "store")
    id_store.write(table(rows, files=4), "doc_id", "text", WORDS, 2, folder, 1000, 4000, 64)
    held = [r.shard for r in id_store.directory(spark, folder).filter("key = '5'").select("shard").distinct().collect()]
    assert len({h[:7] for h in held}) > 3  # written by several tasks
    buckets = spark.read.parquet(f"{folder}/index").collect()
    assert sum(r.n for r in buckets) == 1200 and max(r.n for r in buckets) < 3 * 64
    assert len(found(spark, folder, [("5", c) for c in range(400)])) == 400


def test_an_empty_store(spark, table, tmp_path):
    folder = str(tmp_path / "store")
    id_store.write(table([], files=1), "doc_id", "text", WORDS, 2, folder)
    assert id_store.shards(spark, folder).count() == 0
    assert found(spark, folder, [("1", 0), (None, 0)]) == {}


def test_the_query(spark):
    from factloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    want, start = [], 0
    for (k, _), ids in zip(docs, encoded(WORDS, [t for _, t in docs])):
        want.append((k, start, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())))
        start += len(ids) + 1
    assert sorted(map(tuple, QUERIES["op11_id_store"](spark, folder).collect())) == want


def test_texts_are_encoded_a_few_megabytes_at_a_time():
    texts = ["word " * 2000] * 900
    batch = pa.RecordBatch.from_pydict({"key": [str(i) for i in range(900)], "text": texts})
    seen = []

    def encode(column):
        seen.append(sum(map(len, column.to_pylist())))
        return np.ones(len(column), np.int64), np.arange(len(column))

    made = list(id_store.encoded(encode, batch))
    assert [k for keys, _, _ in made for k in keys] == batch.column("key").to_pylist()
    assert sum(seen) == 900 * 10_000 and max(seen) <= id_store.STEP < id_store.TASK_BYTES
