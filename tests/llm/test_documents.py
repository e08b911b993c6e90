import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import bwt, class_lm, near_dup, quality, substrings
from factloom.llm.components import components
from factloom.llm.tables import crc32_mod

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
order = lambda r: [(v is not None, v) for v in r]


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))


# components ----------------------------------------------------------------


def test_components(spark):
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(50)]
    links += [(7, 7), (None, 3), (3, None), (40, 39)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# near duplicates -----------------------------------------------------------


def shingles(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i: i + 5]) for i in range(len(w) - 4)}


def brute_groups(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    groups = {}
    for i, (key, _) in enumerate(docs):
        groups.setdefault(top(i), []).append(key)
    out = []
    for i, (key, _) in enumerate(docs):
        keys = [k for k in groups[top(i)] if k is not None]
        first = min(keys) if keys else None
        out.append((key, len(sets[i]), first, key == first))
    return sorted(out, key=order)


def chained(rnd):
    """A chain whose neighbours are linked and whose ends aren't, and pairs about the threshold."""
    base = [f"c{i}" for i in range(100)]
    docs = [(500 + i, " ".join(base[4 * i: 4 * i + 60])) for i in range(10)]
    for i in range(30):
        a = [f"p{i}x{j}" for j in range(70)]
        b = list(a)
        for j in range(rnd.randint(1, 4)):
            b[rnd.randrange(70)] = "other"
        docs += [(600 + 2 * i, " ".join(a)), (601 + 2 * i, " ".join(b))]
    return docs


@pytest.mark.parametrize("block", [512, 2])
def test_near_duplicates(table, corpus, rows, monkeypatch, block):
    """Also where a bucket takes many blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    docs = [*corpus, *chained(random.Random(6))]
    got = near_dup.near_duplicates(table(docs), "doc_id", "text")
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert rows(got) == brute_groups(docs)


def test_one_of_each_group_stays(table, corpus):
    docs = [*corpus, *chained(random.Random(7))]
    df = table(docs)
    got = near_dup.deduplicated(df, "doc_id", "text")
    assert got.columns == df.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    assert len(brute_groups(left)) == len(left) and sum(len(shingles(t)) > 0 for _, t in left) == sum(r[3] for r in brute_groups(left) if r[1])
    # as many as there are groups: rows without words are a group each
    groups = {(r[2] if r[1] else object()) for r in brute_groups([d for d in docs if d[0] is not None and d[0] != 7])}
    assert len([x for x in left if x[0] is not None and x[0] != 7]) == len(groups)


def test_near_duplicates_of_nothing(table, spark, stored):
    assert near_dup.near_duplicates(table([]), "doc_id", "text").count() == 0
    assert [tuple(r) for r in near_dup.near_duplicates(table([(None, None)]), "doc_id", "text").collect()] == [(None, 0, None, True)]


def test_estimate_follows_similarity(spark):
    from factloom.llm.arrow import flat
    import pyarrow as pa

    rnd = random.Random(9)
    a = [f"w{i}" for i in range(400)]
    b = list(a)
    for i in rnd.sample(range(400), 12):
        b[i] = "x"
    true = len(shingles(" ".join(a)) & shingles(" ".join(b))) / len(shingles(" ".join(a)) | shingles(" ".join(b)))
    sets = near_dup.shingle_sets(*flat(pa.array([" ".join(a), " ".join(b), "unlike anything else there is here " * 3]))[::-1])
    bits = near_dup._packed(near_dup._signatures(*sets)).view(np.int64).tolist()
    df = spark.createDataFrame([(bits[0], bits[1], bits[2])], "a array<long>, b array<long>, c array<long>")
    one, other, same = df.select(near_dup.estimate(F.col("a"), F.col("b")), near_dup.estimate(F.col("a"), F.col("c")), near_dup.estimate(F.col("a"), F.col("a"))).first()
    assert abs(one - true) < 0.12 and abs(other) < 0.12 and same == 1


# repeated substrings -------------------------------------------------------


def brute_removed(docs, length):
    seen, out = set(), []
    for key, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            part = data[i: i + length]
            if part in seen:
                gone[i: i + length] = True
            seen.add(part)
        edges = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        left = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((key, len(data), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=order)


def unique_keys(corpus):
    """Keys all differ, in order, one is null: what is first is then certain."""
    seen, out = set(), []
    for key, text in sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        if key not in seen:
            seen.add(key)
            out.append((key, text))
    return out


@pytest.mark.parametrize("group", [4096, 3])
@pytest.mark.parametrize("length", [100, 30])
def test_removed(table, corpus, rows, monkeypatch, group, length):
    """Also where anchors are split into parts, and blocks are small."""
    monkeypatch.setattr(substrings, "GROUP", group)
    monkeypatch.setattr(substrings, "BLOCK", 1 << 12 if group == 3 else 1 << 20)
    docs = unique_keys(corpus) + [(1000 + i, f"{i} " + dict(corpus)[20][:90] + f"{i}") for i in range(40)]
    found = substrings.repeats(table(docs, files=4), "doc_id", "text", length)
    assert rows(substrings.removed(found, "doc_id", length)) == brute_removed(docs, length)


def test_repeated_rows_and_nothing(table, rows):
    text = "The river and the stone, " * 2 + "abcdefghij" * 12
    found = substrings.repeats(table([(1, text), (1, text), (2, text)], files=1), "doc_id", "text")
    got = [r[2] for r in rows(substrings.removed(found, "doc_id"))]
    assert sorted(got)[1:] == [len(text)] * 2 and sorted(got)[0] < len(text)
    assert substrings.removed(substrings.repeats(table([]), "doc_id", "text"), "doc_id").count() == 0


def test_cleaned(table, corpus):
    docs = unique_keys(corpus)
    df = table(docs)
    got = substrings.cleaned(substrings.repeats(df, "doc_id", "text"), df.columns, "text")
    assert got.columns == df.columns
    left = {r.doc_id: r.text for r in got.collect()}
    want = {r[0]: r for r in brute_removed(docs, 100)}
    for key, text in docs:
        if text is None:
            assert left[key] is None
        else:  # some bytes more where a character would be split
            kept = want[key][1] - want[key][2]
            assert kept <= len(left[key].encode()) <= kept + 4 * want[key][3]
            assert want[key][2] or left[key] == text


def test_groups_by_backward_extension():
    rnd = random.Random(3)
    for _ in range(120):
        length, letters = rnd.choice([1, 2, 5, 10, 20]), rnd.choice([b"a", b"ab", b"abcd", bytes(range(256))])
        base = bytes(rnd.choice(letters) for _ in range(60))
        pieces = [base[rnd.randint(0, 20): rnd.randint(30, 60)] if rnd.random() < 0.5 else bytes(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))
                  for _ in range(rnd.randint(1, 12))]
        want = {}
        for i, p in enumerate(pieces):
            for j in range(len(p) - length + 1):
                want.setdefault(p[j: j + length], set()).add((i, j))
        got = {}
        for i, j, g in zip(*(x.tolist() for x in bwt.repeated(pieces, length))):
            got.setdefault(g, set()).add((i, j))
        assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values() if len(v) > 1}


# quality -------------------------------------------------------------------


def lines_text(rnd, good):
    def line():
        n = rnd.randint(4, 15)
        if good:
            return " ".join(rnd.choice("river stone cloud value index with that from".split()) + rnd.choice(["", "s", "ed"]) for _ in range(n)) + "."
        kind = rnd.randrange(3)
        if kind == 0:
            return "Buy " * n
        return " ".join(f"{w}{'$$$' if kind == 1 else ' |'}" for w in ["x", "yy", "zzz"] * (n // 3 + 1))
    return "\n".join(line() for _ in range(rnd.randint(1, 8)))


def test_quality(table, spark):
    rnd = random.Random(10)
    docs = [(i, lines_text(rnd, i % 3 > 0)) for i in range(400)] + [(500, None), (501, ""), (502, "\n\n \n"), (None, lines_text(rnd, True)), (503, "word " * 60_000)]
    labels = [(i, int(i % 3 > 0)) for i in range(300)] + [(5, None), (None, 1), (500, 1), (0, 0), (0, 0), (0, 1)]
    df = table(docs)
    model = quality.train(df, "doc_id", "text", spark.createDataFrame(labels, "doc_id long, quality int"), "quality")
    got = quality.scored(df, "text", model)
    assert set(got.columns) == {*df.columns} - {"text"}
    rows = [(r.doc_id, r.score) for r in got.select("doc_id", "score").collect()]
    assert len(rows) == len(docs) and all(0 <= s <= 1 for _, s in rows)
    score = dict(rows)
    assert all((score[i] >= 0.3) == (i % 3 > 0) for i in range(300, 400))
    assert score[500] == score[501] == score[502] == model.prior
    again = quality.train(df, "doc_id", "text", spark.createDataFrame(labels, "doc_id long, quality int"), "quality")
    assert np.array_equal(again.weights, model.weights)


def test_quality_without_labels(table, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(table([(1, "a b")]), "doc_id", "text", none, "quality")
    assert [r.score for r in quality.scored(table([(1, "a b"), (2, None)]), "text", model).select("score").collect()] == [0.5, 0.5]


def test_marginals_against_all_paths():
    rnd = np.random.default_rng(1)
    score, moves, ends = rnd.normal(size=9), rnd.normal(size=(2, 2)), np.array([0, 4, 4, 9])
    got, expected = quality.marginals(score, ends, moves)
    total = np.zeros((2, 2))
    for a, b in zip(ends, ends[1:]):
        n, weight, good, pairs = b - a, 0.0, np.zeros(b - a), np.zeros((2, 2))
        for path in range(2**n if n else 0):
            s = [(path >> i) & 1 for i in range(n)]
            w = math.exp(sum(score[a + i] for i in range(n) if s[i]) + sum(moves[x, y] for x, y in zip(s, s[1:])))
            weight += w
            good += w * np.array(s)
            for x, y in zip(s, s[1:]):
                pairs[x, y] += w
        if n:
            assert np.allclose(got[a:b], good / weight)
            total += pairs / weight
    assert np.allclose(expected, total)


# class model ---------------------------------------------------------------


SMALL = class_lm.Shape(vocabulary=24, classes=6, endings=8, head=40)  # so that words have to be joined


def test_class_model(table, corpus):
    """Counts and base against brute force."""
    rows = class_lm.scored(table(corpus), "doc_id", "text", crc32_mod("doc_id", 10) != 0, SMALL).collect()
    train = [t for k, t in corpus if k is not None and zlib.crc32(str(k).encode()) % 10]
    count = Counter(w for t in train for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    want = []
    for key, text in corpus:
        w = [*words(text), None]
        want.append((key, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=order)
    for a, b in zip(got, sorted(want, key=order), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])
    assert all(r.score < 0 for r in rows)


def test_the_commonest_words(spark):
    rows = [(i, i % 3, n) for i, n in enumerate([5000, 4000, 4000, 900, 7, 7, 7, 1, 1, 1, 1])]
    counts = spark.createDataFrame(rows, "word long, ending int, n long")
    for most, got in ((3, 3), (4, 4), (6, 4), (7, 7), (10, 7), (11, 11), (100, 11), (0, 0)):
        (words_, n), ending = class_lm.commonest(counts, most)
        assert words_.tolist() == list(range(got)) and n.tolist() == [r[2] for r in rows[:got]] and ending.tolist() == [r[1] for r in rows[:got]]


def test_classes_help(table):
    """Texts in one of two languages are likelier under the model than word by word."""
    rnd = random.Random(12)
    tongues = [[f"{a}{b}" for b in "abcdefghij"] for a in ("x", "y")]
    docs = [(i, " ".join(rnd.choice(tongues[i % 2]) for _ in range(60))) for i in range(80)]
    rows = class_lm.scored(table(docs), "doc_id", "text", crc32_mod("doc_id", 10) != 0, SMALL).collect()
    assert all(r.score > r.base_score for r in rows)


def test_probabilities_sum_to_one(table, corpus):
    model, counts = class_lm.fit(table(corpus).select("text"), "text", SMALL)
    assert np.allclose((10.0 ** model.moves).sum(1), 1)
    size = len(model.members)
    members, known = 10.0 ** model.members, np.zeros(size)
    by_word = {r.word: r["n"] for r in counts.collect()}
    kinds = dict(zip(model.head.words.view(np.int64).tolist(), model.place[:24].tolist()))
    assert len(kinds) == 24 and len(by_word) + 1 == model.distinct
    for word, kind in kinds.items():
        known[kind] += by_word[word] + 0.1
    for c in range(6):  # what is left of each class is an unknown word's share
        assert members[c] - known[c] == pytest.approx(0.1)


def test_exchange_raises_the_likelihood():
    rnd = np.random.default_rng(5)
    shape = class_lm.Shape(vocabulary=40, classes=4, endings=2)
    pairs = np.zeros((shape.ids, shape.ids))
    for _ in range(4000):  # two kinds of words that follow their own kind
        k = rnd.integers(0, 2)
        a, b = rnd.integers(0, 20, 2) * 2 + k
        pairs[a, b] += 1
    place = class_lm.exchange(pairs, shape)

    def likelihood(place):
        grid = np.zeros((place.max() + 1,) * 2)
        for a, b in zip(*np.nonzero(pairs)):
            grid[place[a], place[b]] += pairs[a, b]
        return class_lm._h(grid).sum() - class_lm._h(grid.sum(0)).sum() - class_lm._h(grid.sum(1)).sum()

    start = np.concatenate([np.arange(40) % 4, 4 + np.arange(3)])
    assert likelihood(place) > likelihood(start)
    assert not {*place[0:40:2].tolist()} & {*place[1:40:2].tolist()}


def test_a_move_is_the_best_one():
    rnd = np.random.default_rng(6)
    pairs = rnd.poisson(0.4, (9, 9)).astype(float)
    place, classes = np.array([0, 1, 2, 0, 1, 2, 3, 4, 5]), 3

    def grid(place):
        out = np.zeros((6, 6))
        np.add.at(out, (place[:, None], place[None]), pairs)
        return out

    def moved(w, k):
        out = place.copy()
        out[w] = k
        return class_lm.likelihood(grid(out))

    for w in range(8):  # from a class, or from an ending
        cells = [(0, place[v], pairs[w, v]) for v in range(9) if v != w] + [(1, place[v], pairs[v, w]) for v in range(9) if v != w] + [(2, place[w], pairs[w, w])]
        summed = Counter()
        for s, k, n in cells:
            summed[s, k] += n
        side, kind, n = (np.array(z) for z in zip(*((s, k, n) for (s, k), n in sorted(summed.items()) if n)))
        got = class_lm.best(grid(place), place[[w]], np.array([0, len(n)]), side, kind, n, classes)[0]
        assert moved(w, got) == pytest.approx(max(moved(w, k) for k in range(classes)))


def test_every_repeated_word_is_clustered(table):
    """All words, not only the ones that the driver starts with, and counts of classes of every bigram."""
    rnd = random.Random(14)
    tongues = [[f"{rnd.randrange(10**6)}{i}" for i in range(60)] for _ in range(2)]
    docs = [(i, " ".join([*(rnd.choice(tongues[i % 2]) for _ in range(60)), f"once{i}"])) for i in range(120)]
    shape = class_lm.Shape(classes=4, endings=8, head=20, start=10)
    model, kinds = class_lm.fit(table(docs).select("text"), "text", shape)
    hashed = lambda w: int(class_lm.Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), class_lm.SOLID).hashes.view(np.int64)[0])
    by_word = {r.word: r.kind for r in kinds.collect()}
    of = [{by_word[hashed(w)] for w in t} for t in tongues]
    assert not of[0] & of[1] and max(of[0] | of[1]) < 4
    assert all(by_word[hashed(f"once{i}")] >= 4 for i in range(120))
    grid = np.zeros((shape.kinds, shape.kinds))
    for _, text in docs:
        k = [shape.kinds - 1, *(by_word[hashed(w)] for w in text.split()), shape.kinds - 1]
        np.add.at(grid, (k[:-1], k[1:]), 1)
    share = (grid.sum(0) + 0.1) / (grid.sum() + 0.1 * shape.kinds)
    assert np.allclose(10 ** model.moves, (grid + shape.kinds * share) / (grid.sum(1, keepdims=True) + shape.kinds))
    sizes = np.bincount(list(by_word.values()), minlength=shape.kinds)
    sizes[-1] = 1
    count = Counter(w for _, t in docs for w in t.split())
    want = {}
    for key, text in docs:
        k = [shape.kinds - 1, *(by_word[hashed(w)] for w in text.split()), shape.kinds - 1]
        logs = sum(math.log10(count[w] + 0.1) for w in text.split()) + math.log10(120.1)
        want[key] = logs + model.moves[k[:-1], k[1:]].sum() - np.log10(grid.sum(0) + 0.1 * (sizes + 1))[k[1:]].sum()
    got = {r.doc_id: r.score for r in class_lm.scored(table(docs), "doc_id", "text", F.lit(True), shape).collect()}
    assert got == pytest.approx(want)


def test_class_model_of_nothing(table):
    assert class_lm.scored(table([]), "doc_id", "text", F.lit(True)).count() == 0
    row = class_lm.scored(table([(1, "a b"), (2, None)]), "doc_id", "text", F.lit(False)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in row] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
