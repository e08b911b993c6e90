import random

import pytest

#: Names that operators use inside, as extra columns of their inputs.
CLASHING = ("no", "key", "text_a", "n", "row", "spans", "items", "score", "hits", "alive", "ids", "content", "word", "rest", "doc",
            "good", "digest", "class", "root", "v", "id", "dim", "shard", "payload", "original")


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """Write a DataFrame as Parquet and read it, as operators that read twice ask for."""

    def make(df, files=2):
        path = str(tmp_path_factory.mktemp("stored") / "t")
        df.repartition(files).write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return make


@pytest.fixture(scope="session")
def table(spark, stored):
    """(doc_id, text) rows with further columns whose names clash."""

    def make(rows, key="doc_id", text="text", kind="string", files=2):
        extra = ", ".join(f"`{c}` string" for c in CLASHING)
        return stored(spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], f"{key} long, {text} {kind}, {extra}"), files)

    return make


WORDS = ("the of and to in is was for that with erand thntble onhea ereath éaux ßung ción ñar niño 中文 data model token "
         "graph value index river stone cloud seven").split()


def prose(rnd, words):
    out = []
    while len(out) < words:
        out += [rnd.choice(WORDS) for _ in range(rnd.randint(3, 12))]
        out[-1] += rnd.choice([".", ".\n", ",", "!"])
    return " ".join(out[:words])


@pytest.fixture(scope="session")
def corpus():
    """Texts with nulls, empty and blank ones, a very long one, repeated keys and rows, copies and
    near copies, shared passages, odd bytes."""
    rnd = random.Random(5)
    passage = prose(rnd, 60)
    rows = [(i, prose(rnd, rnd.randint(1, 150))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (None, prose(rnd, 40)), (None, None), (103, "one two"), (104, "One TWO"),
             (105, "a" * 700), (106, "ab " * 300), (107, "<|endoftext|> a <|endoftext|>"), (108, "x'll y'RE  z 's\r\n\x1c é")]
    rows += [(109, prose(rnd, 4000) + passage), (110, passage + prose(rnd, 30)), (111, prose(rnd, 30) + passage)]
    base = prose(rnd, 120).split(" ")
    for i in range(25):  # near copies
        words = list(base)
        words[rnd.randrange(len(words))] = f"w{i}"
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, rows[3][1]) for i in range(20)]  # copies
    rows += [rows[7], rows[7], (7, "another text under the same key")]
    return rows
