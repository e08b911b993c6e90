import base64
import hashlib

import numpy as np
import pytest

from factloom.llm import forest, warc

order = lambda r: [(v is not None, v) for v in r]


@pytest.fixture(scope="module")
def pages(corpus):
    out = [(i, f"http://x.test/{i}", t) for i, t in corpus]
    return out + [(900, None, "WARC/1.1\r\n\r\nx\r\n\r\nWARC/1.1\r\n"), (901, "http://y.test/a\r\nb é", "WARC/1.1\r\n\r\nx\r\n\r\nWARC/1.1\r\n"), (902, "u", "\r\n\r\n")]


def captured(table_of, spark, folder, min_bytes=0):
    warc.write(table_of, folder, "page_id", "url", "html", min_bytes)
    return warc.read(spark, folder, payloads=True)


@pytest.mark.parametrize("min_bytes", [0, 30])
def test_archives(spark, stored, pages, tmp_path, min_bytes):
    df = stored(spark.createDataFrame([(*p, "x", "x") for p in pages], "page_id long, url string, html string, payload string, key string"), 3)
    records = captured(df, spark, str(tmp_path / "w"), min_bytes).cache()
    groups = {}
    for i, _, html in pages:
        groups.setdefault(html or "", []).append(i)
    want = []
    for text, ids in groups.items():
        data = text.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        ids = sorted(ids, key=lambda i: (i is not None, i or 0))
        for n, i in enumerate(reversed(ids)):
            revisit = n > 0 and len(data) >= min_bytes
            want.append((i, len(data), digest, "revisit" if revisit else "response", ids[-1] if revisit else None))
    got = [(r.key, r.bytes, r.digest, r.record_type, r.refers_to_key) for r in warc.lookup(records).collect()]
    assert sorted(got, key=order) == sorted(want, key=order)
    # payloads are stored once, and as they were
    stored_payloads = [r.payload.decode() for r in records.filter("record_type = 'response'").collect()]
    assert {*stored_payloads} == {*groups}
    assert len(stored_payloads) == len({*stored_payloads}) or min_bytes
    assert records.filter("record_type = 'revisit' AND payload IS NOT NULL").count() == 0
    assert records.select("record_id").distinct().count() == len(pages)


def test_an_empty_archive(spark, stored, tmp_path):
    df = stored(spark.createDataFrame([], "page_id long, url string, html string"), 1)
    assert warc.lookup(captured(df, spark, str(tmp_path / "w"))).count() == 0


def test_damage_is_noticed():
    record = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [(h["content-length"], b) for h, b in warc.parse(record * 2)] == [("5", b"hello")] * 2
    for bad in (record[:-1], record.replace(b"5", b"4"), b"x" + record):
        with pytest.raises(ValueError):
            list(warc.parse(bad))


# vectors -------------------------------------------------------------------


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        near = {(i, tuple(w)) for i, w in rows if i != q and len(w) == len(v)}
        scored = sorted(((-float((np.array(v) * np.array(w)).sum()), i) for i, w in near))
        out.setdefault(q, [(n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])])
    return out


def run(spark, stored, rows, k=20, every=20):
    df = stored(spark.createDataFrame([(*r, "x", "x") for r in rows], "vec_id long, embedding array<float>, v string, id string"), 4)
    found = {}
    for r in forest.nearest(df, "vec_id", "embedding", df.filter(f"vec_id % {every} = 0"), k).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in found.items()}


def valid(rows):
    return [(i, v) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]


def test_small_tables_are_searched_whole(spark, stored):
    rng = np.random.default_rng(3)
    rows = [(i, np.round(rng.normal(size=8), 2).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(60)]  # one vector again and again
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] + [1.0] * 7), (304, [float("inf")] * 8), (305, [None] + [1.0] * 7), (None, rows[1][1]),
             rows[4], rows[4], (320, [1.0, 2.0, 3.0]), (321, [2.0, 1.0, 3.0]), (340, [1.0] * 5), (306, (np.array(rows[2][1], np.float32) * 50).tolist())]
    good = valid(rows)
    want = brute(good, [r for r in good if r[0] % 20 == 0], 20)
    got = run(spark, stored, rows)
    assert got.keys() == {q for q, v in want.items() if v}
    for q, near in got.items():
        assert [(n, i) for n, i, _ in near] == [(n, i) for n, i, _ in want[q]]
        assert np.allclose([s for *_, s in near], [s for *_, s in want[q]], rtol=1e-12)


def test_recall(spark, stored):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(6000, 32)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = run(spark, stored, rows, every=100)
    exact = vectors.astype(float) @ vectors.astype(float).T
    hits = 0
    for q, near in got.items():
        exact[q, q] = -9
        hits += len({i for _, i, _ in near} & {*np.argsort(-exact[q])[:20].tolist()})
        assert len(near) == 20 and np.allclose([s for *_, s in near], [exact[q, i] for _, i, _ in near])
    assert hits / (20 * len(got)) >= 0.9


def test_no_vectors(spark, stored):
    assert run(spark, stored, []) == {}
    assert run(spark, stored, [(0, [1.0]), (1, None)]) == {}
