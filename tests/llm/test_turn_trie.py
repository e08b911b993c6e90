import hashlib
import random
import zlib

import pytest

from factloom.llm import turn_trie

SCHEMA = "conv_id long, turn long, role string, text string, conv string, ord string, pos string, a string, shard string, size string"


def ordered(rows):
    """{conversation: turns} in the order of the operator."""
    out = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None),
                                      key=lambda r: (r[0], r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 * (1 if c >= 0 else -1))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for k in members:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    for k, m in members.items():
        w = (len(m) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] = saved.get(k[:d], 0) + w
            leaves[k[:d]] = leaves.get(k[:d], 0) + (k not in kids)
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), kids.get(k, 0), leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k)).encode()).hexdigest()) for k, m in members.items())


def nodes(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def frame(spark, stored, rows, files=3):
    return stored(spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA), files)


@pytest.fixture(scope="module")
def talk():
    rnd = random.Random(8)
    starts = [("system", "be kind"), ("system", "be kind, ñ"), ("user", "hello"), (None, None), ("user", "")]
    rows = []
    for c in [*range(0, 120), -3, -5, 10 ** 15, 10 ** 15 + 1]:
        if c in (20, 35):
            continue  # others miss their base
        for t in range(rnd.choice([1, 1, 2, 3, 8, 12])):
            role, text = rnd.choice(starts) if t < 3 else (rnd.choice(["user", "model"]), rnd.choice("abc") * rnd.randint(0, 2))
            rows.append((c, rnd.choice([t, t, t, 3, None]), role, text))  # ties and nulls
    rows += [(200 + i, t, "user", f"copy {t}") for i in range(60) for t in range(4)]  # a third begin alike
    rows += [(77, t, "user", "again") for t in range(300)]  # long
    rows += [(78, t, "user", "again" if t < 250 else "other") for t in range(260)]
    rows += [rows[3], rows[3], (None, 1, "user", "nobody"), (None, None, None, None), (50, 1, "user", "x" * 200_000), (51, 1, "user", "x" * 200_000)]
    return rows


@pytest.mark.parametrize("shard, width, task_bytes", [(4096, 64, 16 << 20), (7, 3, 3000), (1, 1, 30_000), (64, 100, 800)])
def test_rebuilt_conversations(spark, stored, talk, shard, width, task_bytes):
    said = turn_trie.turns(frame(spark, stored, talk), "conv_id", "turn", "role", "text", task_bytes)
    assert nodes(turn_trie.trie(*turn_trie.spliced(said), shard, width)) == brute(rebuilt(ordered(talk)))


def test_as_they_are(spark, stored, talk):
    said = turn_trie.turns(frame(spark, stored, talk), "conv_id", "turn", "role", "text", 5000)
    assert nodes(turn_trie.trie(*turn_trie.paths(said), 50, 8)) == brute(ordered(talk))


def test_places_across_tasks(spark, stored):
    """One conversation over many tasks, between others."""
    rows = [(5, i, "user", f"t{i % 7}") for i in range(500)] + [(c, t, "user", "x") for c in (1, 2, 9, 12) for t in range(3)]
    said = turn_trie.turns(frame(spark, stored, rows), "conv_id", "turn", "role", "text", 1000)
    got = sorted((r.conv, r.ord, r.pos) for r in said.collect())
    assert got == sorted([(5, 2, i) for i in range(500)] + [(c, o, t) for o, c in ((0, 1), (1, 2), (3, 9), (4, 12)) for t in range(3)])


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")]])
def test_no_conversation(spark, stored, rows):
    said = turn_trie.turns(frame(spark, stored, rows, 1), "conv_id", "turn", "role", "text")
    assert turn_trie.trie(*turn_trie.spliced(said)).collect() == []


def test_only_the_root(spark, stored):
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(c, 1, "user", "gone")]  # no base, and fewer turns than come from it
    said = turn_trie.turns(frame(spark, stored, rows, 1), "conv_id", "turn", "role", "text")
    assert nodes(turn_trie.trie(*turn_trie.spliced(said))) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
