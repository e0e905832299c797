import random

import numpy as np

from tellmark.llm import toxicity as tx
from tellmark.llm.common import WordTable


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    part = lambda: "".join(rng.choice(["ba", "ko", "ri", "tu", "ne", "so", "la"]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        toxic = i % 9 == 0
        words = [part() for _ in range(rng.randrange(5, 80))]
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                bad = rng.choice(["moron", "grobiax" + part(), "IDIOT", "zzurk"])
                words.insert(rng.randrange(len(words)), bad + rng.choice(["", ",", "!!", "."]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_quality(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, toxic int").withColumn("score", tx.F.lit("clash"))
    grammar = tx.learn(df.where("doc_id < 600"))
    rows = tx.score(df, grammar).join(df.select("doc_id", "toxic"), "doc_id").where("doc_id >= 600").collect()
    hit = [(r["score"] >= 0.3) == bool(r["toxic"]) for r in rows]
    assert np.mean(hit) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_kinds_of_clauses():
    grammar = tx.Grammar({"moron$": 3.0})
    table = WordTable(grammar.read)
    texts = [
        "a moron walks", "you moron", "not a moron", "he said you moron", "not here. A moron", "kill time", "kill you",
        "nothing", "", None, "moron, moron", "moron moron", "moronic",
    ]
    x = grammar.features(texts, table)
    total, count = np.expm1(x[:, :4]).round(6), np.expm1(x[:, 4:]).round(6)
    kinds = [np.flatnonzero(t).tolist() for t in total]
    assert kinds == [[0], [1], [2], [3], [0], [], [0], [], [], [], [0], [0], []]
    assert count[10, 0] == 2 and count[11, 0] == 1 and total[11, 0] == 6


def test_composition_walks_like_its_parts():
    rng = random.Random(4)
    parts = (tx.INSULTING, tx.THREATENING, tx.TARGETING, tx.NEGATING, tx.REPORTING)
    start, table = tx.compose(*parts)
    for _ in range(200):
        state, own = start, [p.start for p in parts]
        for _ in range(8):
            symbol = rng.randrange(1, 6)
            steps = [p.step(s, symbol) for p, s in zip(parts, own)]
            state, emitted, _ = table[state, symbol]
            own = [n for n, _ in steps]
            assert state == tuple(own) and emitted == sum(e for _, e in steps if e is not None)


def test_odd_tables(spark):
    one_label = spark.createDataFrame([(1, "a", 1), (2, None, 0), (3, "b", None), (4, "c", 7)], "doc_id long, text string, toxic int")
    assert tx.learn(one_label) is None and tx.learn(one_label.limit(0)) is None
    assert {r["score"] for r in tx.score(one_label, None).collect()} == {0.0}
    df = spark.createDataFrame(corpus(300), "doc_id long, text string, toxic int")
    grammar = tx.learn(df)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "moron " * 50000), (4, "x"), (4, "x")], "doc_id long, text string")
    got = tx.score(odd, grammar).collect()
    by = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 5 and by[1] == by[2] == by[4] < 0.3 < by[3]
    assert tx.score(odd.limit(0), grammar).collect() == []
