import pytest

from tellmark.llm import warc
from test_warc import plain


def test_key_over_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 64)
    monkeypatch.setattr(warc, "BATCH_ROWS", 100, raising=False)
    data = [(None, None, f"own {i}") for i in range(3000)] + [(i, f"http://a.b/{i % 50}", f"page {i % 300}") for i in range(1000)]
    data += [(5, "http://a.b/5", "page 5")] * 1500
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(6)
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=str) == plain_nulls(data)


@pytest.mark.parametrize("partitions", [4, 16])
def test_third_of_the_rows_on_one_key(spark, partitions):
    data = [(None, None, f"own {i}") for i in range(10_000)] + [(i, f"http://h{i % 700}.org/{i}", f"page {i % 9000}") for i in range(20_000)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted(map(tuple, warc.round_trip(df).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain_nulls(data)


def plain_nulls(data):
    return sorted(((None if i == -1 else i, *more) for i, *more in plain([(i, u, h) for i, u, h in data])), key=str)


def test_places_around_a_key():
    firsts = [("a", 1), ("b", 1), ("b", 1), ("b", 1), ("c", 1)]
    assert warc._around(firsts, ("b", 1)) == [0, 1, 2, 3]
    assert warc._around(firsts, ("b", 2)) == [3] and warc._around(firsts, ("0", 0)) == [0] and warc._around(firsts, ("d", 0)) == [4]
