import random

import corpus_pipeline as pipeline
from tellmark.llm import jaccard

SCHEMA = "doc_id long, text string"


def texts(n, seed=3):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(10_000)}" for _ in range(40)) for _ in range(n)]


def test_null_and_shared_ids_keep_different_texts(spark):
    t = texts(8)
    data = [(None, t[0]), (None, t[1]), (None, t[1] + " more"), (1, t[2]), (1, t[3]), (2, t[3]), (3, t[4]), (3, t[5] + " end"), (4, t[5]), (5, None)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in pipeline.near_dedup(spark, df, "").collect()]
    assert len(kept) == 7
    assert {x for x in kept if x[1] not in (t[1], t[1] + " more")} == {
        (None, t[0]), (1, t[2]), (1, t[3]), (3, t[4]), (3, t[5] + " end"), (5, None)
    }
    found = sorted(map(tuple, jaccard.near_duplicates(df).collect()), key=str)
    assert found == sorted(
        [(None, None, 0, True), (None, None, 1, True), (None, None, 1, False), (1, 1, 0, True), (1, 1, 1, True), (2, 1, 1, False),
         (3, 3, 0, True), (3, 3, 1, True), (4, 3, 1, False), (5, 5, 0, True)], key=str
    )


def test_equal_rows_of_an_id_leave_one_beside_shared_ids(spark):
    t = texts(3)
    df = spark.createDataFrame([(1, t[0]), (1, t[0]), (1, t[1]), (None, t[2]), (None, t[2])], SCHEMA)
    got = sorted(((r["doc_id"], r["text"]) for r in pipeline.near_dedup(spark, df, "").collect()), key=str)
    assert got == sorted([(1, t[0]), (1, t[1]), (None, t[2])], key=str)
