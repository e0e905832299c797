"""Ranked search against a plain scorer over all documents."""

import math
import random
import re
from collections import Counter

import pytest

from tellmark.llm import ranked

TERM = re.compile(ranked.TERM)
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    rows = []
    for item, text in items:
        scored = []
        for doc, bag in bags:
            m = 100 - 25 + (25 * sum(bag.values()) * n_docs) // n_terms
            score = 0
            for t in TERM.findall((text or "").translate(LOWER)):
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * m))
            if score > 0:
                scored.append((-score, -(1 << 63) if doc is None else doc, doc))
        scored.sort(key=lambda x: x[:2])
        rows += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(scored[:k])]
    return sorted(rows, key=str)


def frame(spark, docs, items):
    rows = [(i, t, "x", 1) for i, t in docs]
    # names of the result and of the index stand in the input too
    d = spark.createDataFrame(rows, "doc_id long, text string, score string, rank int").repartition(3)
    return d, spark.createDataFrame(items, "item_id long, text string")


def random_texts(seed, n, longest):
    rng = random.Random(seed)
    words = ["the", "The", "été", "x1", "naïve"] + [f"w{i}" for i in range(60)]
    pick = lambda: words[min(int(rng.expovariate(0.08)), len(words) - 1)]
    return [(i, rng.choice([" ", "-", "\n", "_"]).join(pick() for _ in range(rng.randint(1, longest)))) for i in range(n)]


@pytest.mark.parametrize("unit_bytes", [300, 1 << 20])
@pytest.mark.parametrize("block_bytes", [100, 1 << 20])
def test_equals_plain_scorer(spark, unit_bytes, block_bytes):
    docs = random_texts(1, 300, 40) + [(None, "w3 w4"), (None, None), (400, ""), (401, " - "), (7, "w5 the"), (7, "w5 the"), (402, "w9 " * 5000)]
    items = random_texts(2, 12, 15) + [(50, None), (51, ""), (52, "nowhere at all"), (53, "w5 w5 w5")]
    d, i = frame(spark, docs, items)
    got = ranked.search(ranked.build(d, unit_bytes=unit_bytes), i, 7, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, 7)


def test_ties_go_by_id_over_units_and_tasks(spark):
    docs = [(i, "same words here") for i in range(500, 0, -1)] + [(1000 + i, f"other {i}") for i in range(300)]
    d, i = frame(spark, docs, [(1, "words"), (1, "other here")])
    got = ranked.search(ranked.build(d, unit_bytes=200), i, 20).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, [(1, "words"), (1, "other here")], 20)


def test_empty_tables(spark):
    d, i = frame(spark, [], [(1, "a")])
    assert ranked.search(ranked.build(d), i).collect() == []
    d, i = frame(spark, [(1, "a")], [])
    assert ranked.search(ranked.build(d), i).collect() == []


def test_counting_terms_leaves_the_text_to_bytes(spark):
    texts = [t for _, t in random_texts(3, 200, 30)] + ["", " - ", "a", "Zß9", "\u00a0", "x\u2028y", "a\x7fb", "\U0001f600 é", "-é", "end-"]
    assert [ranked.n_terms(t) for t in texts] == [len(TERM.findall(t)) for t in texts]
    d, _ = frame(spark, [*enumerate(texts), (None, None)], [(1, "a")])
    plans = []
    explained = type(d).agg
    try:
        type(d).agg = lambda self, *c: plans.append(self._jdf.queryExecution().toString()) or explained(self, *c)
        got = ranked.totals(d, unit_bytes=100)
    finally:
        type(d).agg = explained
    n = [len(TERM.findall(t)) for t in texts]
    assert got == (sum(k > 0 for k in n), sum(n))
    assert plans and not any("regexp" in p for p in plans)  # a regex over every text cost ten times the index
