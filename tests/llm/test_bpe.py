import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import bpe, token_counts
from factloom.llm.arrow import flat

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def packed(texts):
    return flat(pa.array(texts, pa.string()))[::-1]


def test_like_the_library_on_odd_texts(library):
    rnd = random.Random(1)
    bits = ["a", "'", "s", "t", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "​", "é", "中", "😀", "1", "²", "the", "<|endoftext|>", "<|endof",
            "!", "...", "́", "\x00", "'ll", "'re", "'v", "'d", "\r\n", "ab" * 20, "x" * 90]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rnd.choice("'stmdrevl ax") for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    texts += ["a" * 3000, "ab" * 2000, " " * 3000, "", "x" * 300 + "\n" * 300]
    coder, made = bpe.ByteBPE(PATH), library.encode_batch(texts, add_special_tokens=False)
    ids, ends = coder.encode(*packed(texts))
    assert [list(ids[a:b]) for a, b in zip(ends, ends[1:])] == [m.ids for m in made]
    assert list(coder.count(*packed(texts))) == [len(m.ids) for m in made]
    assert coder.decode(ids, ends) == texts


def test_pairs_are_judged_as_merging_would(library):
    """A pair is compatible exactly when merging its joined bytes gives the pair back."""
    coder = bpe.ByteBPE(PATH)
    rnd = np.random.default_rng(2)
    a, b = rnd.integers(0, 5000, 3000), rnd.integers(0, 5000, 3000)
    data = {i: bytes(coder.bytes.gather(coder.outer[[i]])[0]) for i in {*a.tolist(), *b.tolist()}}
    merged = coder.merged([data[x] + data[y] for x, y in zip(a.tolist(), b.tolist())])
    assert coder.compatible(a, b).tolist() == [m == [x, y] for m, x, y in zip(merged, a.tolist(), b.tolist())]


def test_a_full_word_table_starts_afresh(monkeypatch, library):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    coder, rnd = bpe.ByteBPE(PATH), random.Random(3)
    for _ in range(20):
        texts = [" ".join("".join(rnd.choice("abcdef") for _ in range(6)) for _ in range(40))]
        assert list(coder.encode(*packed(texts))[0]) == library.encode(texts[0], add_special_tokens=False).ids


def test_bytes_that_are_no_text():
    coder = bpe.ByteBPE(PATH)
    ids = np.array([coder.outer[0xC3], coder.outer[0x41]])
    assert coder.decode(ids, np.array([0, 2])) == ["�A"]


def test_round_trip(table, corpus, rows, library):
    found = bpe.round_trip(table(corpus), "doc_id", "text", PATH)

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = []
    for key, text in corpus:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((key, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert rows(found) == sorted(want, key=lambda r: [(v is not None, v) for v in r])


def test_encoded_keeps_columns(table, corpus, spark):
    df = table(corpus)
    made = bpe.decoded(bpe.encoded(df, "text", PATH, "n", verify="exact"), "n", PATH, "word")
    assert set(made.columns) == {*df.columns, "exact"}
    assert made.filter("NOT word <=> coalesce(text, '')").count() == 0 and made.filter("NOT exact").count() == 0
    assert made.count() == len(corpus)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encoded(empty, "text", PATH).count() == 0
    assert bpe.decoded(spark.createDataFrame([(1, None)], "k int, ids array<int>"), "ids", PATH).first().decoded == ""


def test_counts_through_the_cache(table, corpus, rows, library, spark, tmp_path, monkeypatch):
    cache, df = str(tmp_path / "cache"), table(corpus)
    want = sorted(((k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in corpus),
                  key=lambda r: [(v is not None, v) for v in r])
    assert rows(token_counts.token_counts(df, "doc_id", "text", PATH, cache)) == want
    held = spark.read.schema(token_counts.CACHE).parquet(cache)
    assert held.count() == len({t or "" for _, t in corpus})
    # a second run with one new text encodes that alone
    seen = []
    plain = token_counts.counted
    monkeypatch.setattr(token_counts, "counted", lambda d, *a: seen.append(d.count()) or plain(d, *a))
    more = table([*corpus, (900, "something new"), (901, "something new")])
    assert token_counts.token_counts(more, "doc_id", "text", PATH, cache).count() == len(corpus) + 2
    assert seen == [1]
    grown = spark.read.schema(token_counts.CACHE).parquet(cache)
    assert grown.count() == grown.select("content").distinct().count() == held.count() + 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(empty, "doc_id", "text", PATH, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(name, table, spark, tmp_path):
    path = public_tokenizers.path(name)
    texts = [(1, "The river  and the stone."), (2, None), (3, "")]
    if name.endswith(".model"):
        import sentencepiece

        count = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))
    else:
        count = lambda t: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids)
    got = token_counts.token_counts(table(texts), "doc_id", "text", path, str(tmp_path / "c"))
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {k: count(t or "") for k, t in texts}


def test_a_changed_tokenizer_is_another_one():
    assert token_counts.tokenizer_digest(PATH) != token_counts.tokenizer_digest(public_tokenizers.path("word_bpe_49k.json"))


def test_over_limit(spark, tmp_path):
    from factloom.llm.queries import op7_token_counts

    spark.createDataFrame([(1, "word " * 1025), (2, "word " * 1000), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.over_limit for r in op7_token_counts(spark, str(tmp_path)).select(F.col("doc_id"), "over_limit").collect()}
    assert got == {1: True, 2: False, 3: False}
