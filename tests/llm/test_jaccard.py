import random

import numpy as np

from tellmark.llm import jaccard


def shingles(text, words=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def plain(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i].append(j)
    root = [d for d, _ in rows]
    for _ in range(60):
        for i in range(n):
            root[i] = min([root[i], *[root[j] for j in links[i]]])
    return sorted((d, root[i], len(links[i]), root[i] == d) for i, (d, _) in enumerate(rows))


def rows():
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefgh") + rng.choice(["é", "x", "Y", "日"]) + str(rng.randrange(60))
    out = []
    for base in range(25):
        words = [word() for _ in range(rng.randrange(3, 150))]
        for _ in range(rng.randrange(1, 14)):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                own[rng.randrange(len(own))] = word()
            out.append(rng.choice([" ", "\n"]).join(own))
    hot = [word() for _ in range(120)]
    for _ in range(90):
        own = list(hot)
        own[rng.randrange(120)] = word()
        out.append(" ".join(own))
    out += [hot and " ".join(hot)] * 20 + [None, "", " \n　\x1c", "one", "One", "one two", "x " * 4000, "x " * 30]
    rng.shuffle(out)
    return [(i * 7 - 100, t) for i, t in enumerate(out)] + [(5000, "one two three four five six")] * 3


def test_equals_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(d, t, 1, "h") for d, t in data], "doc_id long, text string, rep int, blk string").repartition(5)
    got = jaccard.near_duplicates(df, block_rows=16)
    assert got.columns == ["doc_id", "class_id", "n_links", "kept"]
    assert sorted(map(tuple, got.collect())) == plain(data)


def test_banding_reaches_recall():
    bands, rows = jaccard.banding(0.8, 0.99999, 256)
    assert bands * rows <= 256 and 1 - (1 - 0.8**rows) ** bands >= 0.99999
    more = rows + 1
    assert more * np.log(1e-5) / np.log(1 - 0.8**more) > 256


def test_overlaps_in_parts(monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 7)
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 25).astype(np.uint64)) for _ in range(9)]
    assert (jaccard.overlaps(sets) - np.diag(np.diag(jaccard.overlaps(sets))) == [
        [len(np.intersect1d(a, b)) if i != j else 0 for j, b in enumerate(sets)] for i, a in enumerate(sets)
    ]).all()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(empty).collect() == []
