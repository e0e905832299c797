import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tellmark.llm import langid, queries, substrings
from test_jaccard import plain as plain_jaccard
from test_lines import plain as plain_lines
from test_substrings import plain as plain_windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _left int, rank string"


def rows():
    rng = random.Random(77)
    word = lambda: rng.choice(["the", "la", "der", "house", "maison", "x1", "big", "klein"]) + rng.choice(["", "s", "en", "é"])
    line = lambda: " ".join(word() for _ in range(rng.randrange(3, 18)))
    passages = [" ".join(word() + str(rng.randrange(9)) for _ in range(45)) for _ in range(5)]
    texts = []
    for _ in range(120):
        texts.append("\n".join(line() for _ in range(rng.randrange(1, 9))))
        if rng.random() < 0.3:
            texts[-1] += " " + rng.choice(passages) + " " + word()
        if rng.random() < 0.2:
            texts.append(texts[rng.randrange(len(texts))])
        if rng.random() < 0.3:
            own = texts[-1].split(" ")
            own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    texts += [None, "", "12 34 !!", " \n", "é", "word " * 6000]
    rng.shuffle(texts)
    return [(i * 2, t, rng.choice(["en", "fr", None]), "s", None, 1, "r") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(4)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_columns_and_equal_plain_versions(spark, docs, tmp_path):
    trees = langid.train(docs)
    before = docs
    for name, stage in pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, before, "").write.parquet(path)
        after = spark.read.parquet(path)
        if name != "packing":
            assert after.columns == docs.columns
            kept = before.join(after.select("doc_id").distinct(), "doc_id", "left_semi")
        was, now = pairs(before), dict(pairs(after)) if name != "packing" else {}
        if name == "language":
            assert trees is not None
            assert now == {d: t for d, t in was if t and re.search(r"[^\W\d_]", t)}
        elif name == "lines":
            want = {d: h for d, n, gone, h in plain_lines(was)}
            assert set(now) <= set(want) and len(now) > 50
            assert all(hashlib.sha256(t.encode()).hexdigest() == want[d] for d, t in now.items())
            removed = {d: (n, gone) for d, n, gone, _ in plain_lines(was)}
            assert all(removed[d][0] == removed[d][1] or removed[d][1] > 0 for d in set(want) - set(now))
        elif name == "near_duplicates":
            assert now == {d: t for d, t in was if {x[0]: x[3] for x in plain_jaccard(was)}[d]}
        elif name == "substrings":
            want = {d: kept for d, *_, kept in plain_windows(was, substrings.WINDOW)}
            assert {d: substrings.WORD.findall(t.encode()) for d, t in now.items()} == {
                d: [w.encode() for w in k] for d, k in want.items() if k
            }
        else:
            lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            sizes = Counter()
            for r in after.collect():
                sizes[r["doc_id"]] += r["length"]
            assert sizes == Counter({d: len(lib.encode(t, add_special_tokens=False).ids) + 1 for d, t in was})
            filled = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e"))
            assert filled.where("n <> e or n > 2048").count() == 0
        assert name == "packing" or kept.count() == after.count()
        before = after


def test_run_and_empty_documents(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path / "a")).count() > 50
    docs.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_rows_that_share_an_id_leave_one(spark):
    df = spark.createDataFrame([(1, "same text of one id here"), (1, "same text of one id here"), (2, "other")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in pipeline.near_dedup(spark, df, "").collect()) == [1, 2]


def test_queries_are_registered():
    assert sorted(queries.QUERIES) == sorted(
        f"op{n}_{name}" for n, name in enumerate(
            ["language_id", "substrings", "warc", "neighbours", "jaccard", "toxicity", "pieces", "near_duplicates", "lines", "packing", "prefixes", "language_model", "ranked"], 1
        )
    )
    assert np.all([callable(q) for q in queries.QUERIES.values()])
