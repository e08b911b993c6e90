from collections import Counter

import pytest

from factloom.llm import near_dup, warc
from factloom.llm.tables import kept


@pytest.fixture
def splitting(spark, monkeypatch):
    """What an operator keeps first is read in other splits than all that follows."""
    def kept_anew(df, name):
        out = kept(df, name)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
        return out

    def set_for(module):
        monkeypatch.setattr(module, "kept", kept_anew)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield set_for
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_near_duplicates_in_other_splits(table, corpus, splitting):
    df = table(corpus, files=4)
    want = Counter((r.doc_id, r.text) for r in near_dup.deduplicated(df, "doc_id", "text").collect())
    splitting(near_dup)
    assert Counter((r.doc_id, r.text) for r in near_dup.deduplicated(df, "doc_id", "text").collect()) == want


def test_archives_in_other_splits(spark, stored, tmp_path, splitting):
    pages = [(i, f"http://a/{i}", f"page {i % 7} " * 5) for i in range(60)]
    df = stored(spark.createDataFrame(pages, "page_id long, url string, html string"), files=4)
    splitting(warc)
    warc.write(df, str(tmp_path / "w"), "page_id", "url", "html")
    rows = warc.read(spark, str(tmp_path / "w"), payloads=True).collect()
    by_id = {r.record_id: r for r in rows}
    got = sorted((r.key, r.url, bytes((by_id[r.refers_to] if r.refers_to else r).payload or b"").decode()) for r in rows)
    assert got == sorted(pages) and sum(r.record_type == "response" for r in rows) == 7


@pytest.mark.parametrize("refers_to, digest", [("a", "Y"), ("c", "X")])
def test_a_revisit_without_its_original(spark, refers_to, digest):
    schema = "record_id string, record_type string, key long, url string, digest string, bytes long, refers_to string"
    records = [("a", "response", 1, "u", "X", 3, None), ("b", "revisit", 2, "u", "X", None, "a")]
    assert warc.lookup(spark.createDataFrame(records, schema)).count() == 2
    with pytest.raises(Exception, match="no original of the same digest for d"):
        warc.lookup(spark.createDataFrame([*records, ("d", "revisit", 3, "u", digest, None, refers_to)], schema)).collect()
