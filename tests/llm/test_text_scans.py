import hashlib
import re

import pytest

from factloom.llm import decontaminate, licenses

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))


def brute_hits(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(len(w), decontaminate.WINDOW)
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i: i + size]), set()).add("" if item is None else str(item))
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for window, names in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i: i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= names
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=lambda r: [(v is not None, v) for v in r])


def items_of(corpus):
    texts = dict(corpus)
    return [(1, texts[20]), (10, texts[30]), (2, "One two"), (3, None), (4, ""), (5, "!!"), (None, texts[40]), (1, texts[41]), (6, "the of"), (6, "the of"),
            (7, texts[110])]


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_hits(table, corpus, rows, spark, monkeypatch, block):
    """Also where the items take several blocks."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = items_of(corpus)
    docs = [*corpus, (400, (dict(corpus)[20].upper() + " tail") * 3)]
    got = decontaminate.hits(table(docs), "doc_id", "text", table(items, "item_id"))
    assert rows(got) == brute_hits(docs, items)


def test_one_broadcast_at_a_time(table, corpus, rows, monkeypatch):
    """Five blocks and more, each destroyed before the next is made; spans of several blocks meet in one text."""
    from pyspark import Broadcast

    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 150)
    alive, most = [], []
    real_needles, real_destroy = decontaminate._needles, Broadcast.destroy

    def made(part):
        alive.append(real_needles(part))
        most.append(len(alive))
        return alive[-1]

    def destroyed(self, *args, **kw):
        if self in alive:
            alive.remove(self)
        return real_destroy(self, *args, **kw)

    monkeypatch.setattr(decontaminate, "_needles", made)
    monkeypatch.setattr(Broadcast, "destroy", destroyed)
    items = items_of(corpus)
    texts = dict(corpus)
    docs = [*corpus, (500, f"{texts[20]} {texts[30]} {texts[41]} one two {texts[20]}"), (None, texts[30])]
    df = table(docs)
    assert rows(decontaminate.hits(df, "doc_id", "text", table(items, "item_id"))) == brute_hits(docs, items)
    assert len(most) >= 5 and max(most) == 1 and not alive
    clean = decontaminate.decontaminated(df, "text", table(items, "item_id"))
    hit = {r.doc_id for r in decontaminate.hits(df, "doc_id", "text", table(items, "item_id")).filter("contaminated").collect()}
    before, after = ({(r.doc_id, r.text) for r in d.collect()} for d in (df, clean))
    assert clean.count() == len(docs) and {x for x in before if x[0] not in hit} <= after


def test_no_items_and_no_documents(table, corpus, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.hits(table(corpus), "doc_id", "text", none).filter("contaminated").count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.hits(empty, "doc_id", "text", table([(1, "a b")], "item_id")).count() == 0


def test_removal(table, corpus, spark):
    items = table([(7, dict(corpus)[110])], "item_id")
    df = table(corpus)
    clean = decontaminate.decontaminated(df, "text", items)
    assert clean.columns == df.columns and clean.count() == len(corpus)
    assert decontaminate.hits(clean, "doc_id", "text", items).filter("contaminated").count() == 0
    hit = {r.doc_id for r in decontaminate.hits(df, "doc_id", "text", items).filter("contaminated").collect()}
    assert {109, 110, 111} <= hit
    before, after = ({(r.doc_id, r.text) for r in d.collect()} for d in (df, clean))
    assert {x for x in before if x[0] not in hit} <= after
    whole = decontaminate.decontaminated(df, "text", items, remove="documents")
    assert {(r.doc_id, r.text) for r in whole.collect()} == {x for x in before if x[0] not in hit}
    with pytest.raises(ValueError):
        decontaminate.decontaminated(df, "text", items, remove="words")


def test_cuts_leave_the_rest(spark, table):
    items = table([(1, "alpha beta gamma delta")], "item_id")
    df = spark.createDataFrame([(1, "é x, Alpha beta\nGAMMA delta! ñ y alpha beta gamma delta")], "doc_id long, text string")
    assert decontaminate.decontaminated(df, "text", items).first().text == "é x, ! ñ y "


# licenses ------------------------------------------------------------------


def brute_licenses(text, templates):
    w = words(text)
    shingles = [tuple(w[i: i + 5]) for i in range(len(w) - 4)]
    sets, found = [], []
    for name, template in templates:
        t = words(template)
        sets.append((name, {tuple(t[i: i + 5]) for i in range(len(t) - 4)}))
    for name, held in sets:
        beyond = [held - s for n, s in sets if n != name and 2 * len(held & s) >= len(held)]
        span = licenses.span(len(held))
        runs = [set(shingles[i: i + span]) for i in range(len(shingles))]
        best = max((len(held & r) for r in runs if 100 * len(held & r) >= 75 * len(held)
                    and all(100 * len(d & r) >= 75 * len(d) for d in beyond)), default=0)
        if best:
            found.append((name, best / len(held)))
    return found


def test_licenses(table, corpus):
    import random

    rnd = random.Random(8)
    docs = list(corpus)
    for i, (_, text) in enumerate(licenses.TEMPLATES):
        t = text.split()
        for j in range(4):  # whole, changed in a few places, spread out, cut short
            u = list(t)
            if j == 1:
                u[rnd.randrange(len(u))] = "zzz"
            if j == 2:
                u.insert(rnd.randrange(len(u)), "zzz")
            if j == 3:
                u = u[: len(u) * 4 // 5]
            docs.append((1000 + 10 * i + j, dict(corpus)[20] + " " + " ".join(u).upper() + " " + dict(corpus)[21]))
    docs.append((2000, "Licensed under the Apache License, Version 2.0. " * 500))
    got = {}
    for r in licenses.scanned(table(docs), "text").select("doc_id", "n_words", "matches").collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [(m.license, m.containment) for m in r.matches]))
    want = {}
    for key, text in docs:
        want.setdefault(key, []).append((len(words(text)), brute_licenses(text, licenses.TEMPLATES)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(len(m) for v in got.values() for _, m in v) > 40


def test_notices_are_told_apart(spark):
    """Each notice is found under its own name alone, but for the 3-clause license, which holds the 2-clause one's text."""
    bsd = " ".join(text for name, text in licenses.TEMPLATES if name.startswith("BSD"))
    texts = [(i, f"Copyright someone. {text} More.") for i, (_, text) in enumerate(licenses.TEMPLATES)] + [(1000, bsd)]
    got = {r.doc_id: sorted({m.license for m in r.matches}) for r in licenses.scanned(spark.createDataFrame(texts, "doc_id long, text string"), "text").collect()}
    assert got.pop(1000) == ["BSD-2-Clause", "BSD-3-Clause"]
    assert got == {i: [name] for i, (name, _) in enumerate(licenses.TEMPLATES)}


def test_license_places(spark):
    df = spark.createDataFrame([(1, "x y z Released under the MIT License. x"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.matches for r in licenses.scanned(df, "text", [("MIT", "Released under the MIT License")]).collect()}
    assert [(m.license, m.start, m.end, m.containment) for m in got[1]] == [("MIT", 3, 8, 1.0)] and got[2] == []
    assert licenses.scanned(df.limit(0), "text").count() == 0


def test_short_templates_are_refused():
    with pytest.raises(ValueError):
        licenses.Templates([("X", "too short")])
