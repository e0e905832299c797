import random
import zlib

import numpy as np
import pytest

from tellmark.llm import langid

DATA = "/root/testdata/sf0.01/documents.parquet"


def plain_bits(counts, word, depth):
    """Code length of one word, byte by byte, from counts of (context, byte)."""
    raw = f" {word} ".encode()
    total = 0.0
    for i in range(1, len(raw)):
        for k in range(min(i, depth), -1, -1):
            seen = counts.get(raw[i - k : i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if raw[i] in seen:
                total -= np.log2(seen[raw[i]] / (n + d))
                break
            total -= np.log2(d / (n + d))
        else:
            total += 8
    return total


def test_code_lengths_equal_plain_context_trees():
    rng = random.Random(0)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    label = np.array([rng.randrange(3) for _ in words])
    n = np.array([rng.randrange(1, 5) for _ in words])
    trees = langid.Trees(["a", "b", "c"], label, words, n)
    tables = [{} for _ in range(3)]
    for w, lab, times in zip(words, label, n):
        raw = f" {w} ".encode()
        for i in range(1, len(raw)):
            for k in range(0, min(i, trees.depth) + 1):
                seen = tables[lab].setdefault(raw[i - k : i], {})
                seen[raw[i]] = seen.get(raw[i], 0) + int(times)
    tests = words[:20] + ["zzz", "日本", "a", "abcabcabc", "é" * 30]
    bits, lens = trees.costs(tests)
    want = [[plain_bits(t, w, trees.depth) for t in tables] for w in tests]
    assert (lens == 3).all() and np.allclose(bits.reshape(-1, 3), want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    from tellmark.llm.queries import QUERIES

    rows = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.98


@pytest.mark.parametrize("learned", [True, False])
def test_odd_texts(spark, learned):
    texts = [None, "", "  \n", "123 !!", "the", "é", "\x00", "the house " * 20000, "the house", "the house", "½ 12", "² ①"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string")
    seen = [("the house is big", "en"), ("la maison est là", "fr"), (None, "fr"), ("nothing", None)]
    known = spark.createDataFrame([(i, *r) for i, r in enumerate(seen if learned else [])], "doc_id long, text string, lang string")
    trees = langid.train(known)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, trees).collect()}
    assert len(got) == len(texts)
    assert all(got[i] == ("und", 0.0) for i in (0, 1, 2, 3, 6, 10, 11))
    if learned:
        assert got[4][0] == got[7][0] == "en" and got[8] == got[9]
        more = langid.attach(df, trees)
        assert more.columns == [*df.columns, "_lang", "_score"]
        assert {r["doc_id"]: (r["_lang"], r["_score"]) for r in more.collect()} == got
    else:
        assert all(v == ("und", 0.0) for v in got.values())


def test_sample_is_bounded_and_empty_tables_work(spark):
    many = spark.range(3000).selectExpr("id as doc_id", "'same text' as text", "if(id % 10 = 0, 'a', 'b') as lang")
    got = langid.sample_per_class(many, "lang", ["doc_id", "text"], 100).groupBy("lang").count().collect()
    assert all(60 < r["count"] < 140 for r in got) and len(got) == 2
    empty = many.limit(0)
    assert langid.train(empty) is None and langid.predict(empty, None).collect() == []
