"""N-gram scores against a plain model with the same discounts; sequences and levels against plain lists."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from tellmark.llm import ngrams

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return (text or "").encode().translate(bytes(range(256)).lower()).split() + ["end"]


def quantised(p, nothing=0.0):
    return nothing if not p else 10 ** (-min(round(-math.log10(p) * ngrams.SCALE), ngrams.NOTHING - 1) / ngrams.SCALE)


def plain(rows, d=ngrams.DISCOUNT, exact=False):
    """(id, tokens, known, N, base, score) of every text; weights of split words are not quantised, hence a tolerance."""
    q = (lambda p, nothing=0.0: p or nothing) if exact else quantised
    train = [words(t) for _, t, learns in rows if learns]
    one = Counter(w for t in train for w in t)
    two, three, after1, after2 = Counter(), Counter(), defaultdict(set), defaultdict(set)
    for t in train:
        s = ["<s>", "<t>", *t, "</s>"]
        for a, b, c in zip(s, s[1:], s[2:]):
            three[a, b, c] += 1
            after2[a, b].add(c)
            two[a, b] += 1
        for a, b in zip(s, s[1:]):
            if b != "</s>":
                after1[a].add(b)
    heads = Counter(one)
    heads["<t>"] = heads["<s>"] = len(train)
    n, v = sum(one.values()), len(one)
    out = []
    for i, text, _ in rows:
        t = words(text)
        s = ["<s>", "<t>", *t]
        base = score = 0.0
        for a, b, c in zip(s, s[1:], s[2:]):
            p = (one[c] + 1) / (n + v + 1)
            base += math.log10(p)
            if heads[b]:
                p *= q(d * len(after1[b]) / heads[b], 1.0) if after1[b] else 1.0
                p += q((two[b, c] - d) / heads[b]) if two[b, c] else 0.0
            if two[a, b]:
                p = q(d * len(after2[a, b]) / two[a, b]) * p + (q((three[a, b, c] - d) / two[a, b]) if three[a, b, c] else 0.0)
            score += math.log10(min(p, 1.0))
        out.append((i, len(t), sum(one[w] > 0 for w in t), n, base, score))
    return out


def made(seed, n=160):
    rng = random.Random(seed)
    pick = lambda: rng.choice(["The", "the", "été", "a b", "x"] + [f"w{int(rng.expovariate(0.1))}" for _ in range(6)])
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(pick() for _ in range(rng.choice([1, 2, 5, 40]))), rng.random() < 0.7) for i in range(n)]
    return rows + [(None, "w1 w2", True), (None, None, False), (900, "", True), (901, " \n", False), (5, "the w1", True), (5, "the w1", True), (902, "w1 w2 w3 " * 900, True)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, learns boolean, unit string, score int").repartition(3)


@pytest.mark.parametrize("sizes", [(200, 10, 100), (3000, 50, 700), (1 << 20, 1 << 20, 1 << 20)])
def test_equals_plain_model(spark, sizes):
    rows = made(sizes[0])
    got = ngrams.score(frame(spark, rows), F.col("learns"), unit_bytes=sizes[0], shard_words=sizes[1], shard_triples=sizes[2])
    assert got.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (str(r[0]), *r[1:3], round(r[4], 6), round(r[5], 6))
    got, want = sorted(map(tuple, got.collect()), key=key), sorted(plain(rows), key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for a, b in zip(got, want):
        assert a[4] == pytest.approx(b[4], abs=1e-6)
        # one shard splits no word, so all weights are codes
        assert a[5] == pytest.approx(b[5], abs=1e-6 if sizes[2] == 1 << 20 else 0.02 * a[1] + 1e-6)


def test_codes_are_close_to_the_model_without_them(spark):
    rows = made(7)[:160]
    got = {r[0]: r for r in map(tuple, ngrams.score(frame(spark, rows), F.col("learns")).collect()) if r[0] is not None}
    for i, n, _, _, base, score in plain(rows, exact=True):
        if i is not None:
            assert abs(got[i][5] - score) < n / 32
    assert sum(r[5] for r in got.values()) > sum(r[4] for r in got.values())


def test_nothing_learned_and_empty(spark):
    rows = [(1, "a b", False), (2, None, False)]
    assert sorted(map(tuple, ngrams.score(frame(spark, rows), F.col("learns")).collect())) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert ngrams.score(frame(spark, []), F.col("learns")).collect() == []


def test_sequences_find_successors():
    rng = np.random.default_rng(5)
    for n, top in ((0, 1), (1, 0), (1, 9), (500, 20), (3000, 10**12), (400_000, 10**9)):
        values = np.sort(rng.integers(0, top + 1, n))
        one = ngrams.EliasFano(n, *ngrams.EliasFano.arrays(values))
        assert (one[np.arange(n)] == values).all()
        low = rng.integers(0, n + 1, 200)
        high = np.minimum(n, low + rng.integers(0, 50, 200))
        wanted = rng.integers(0, top + 2, 200)
        assert (one.successor(low, high, wanted) == [a + np.searchsorted(values[a:b], x) for a, b, x in zip(low, high, wanted)]).all()
        assert (ngrams.unpack(ngrams.pack(values)) == values).all()


def test_levels_tell_what_was_written(tmp_path):
    rng = random.Random(9)
    triples = Counter((rng.randint(4, 9), rng.randint(4, 30), rng.randint(4, 60)) for _ in range(900))
    rows = np.array([(*t, c) for t, c in sorted(triples.items())])
    heads = Counter()
    for (a, _, _), c in triples.items():
        heads[a] += c
    fs, path = pyarrow.fs.LocalFileSystem(), str(tmp_path / "levels")
    ngrams.Levels.write(fs, path, *rows.T[:3], rows[:, 3], np.array([heads[a] for a in rows[:, 0]]), 0.75)
    levels = ngrams.Levels.open(fs, path)
    pairs = Counter()
    for (a, b, _), c in triples.items():
        pairs[a, b] += c
    for a, b, c in [*triples, (4, 4, 99), (99, 4, 4), (5, 31, 4), (0, 0, 0)]:
        zero = np.zeros(1, np.int64)
        g1, f2, g2, f3 = levels.look_up(np.array([a]), zero, np.array([b]), zero, np.array([c]))
        n = triples.get((a, b, c), 0)
        assert ngrams._FREQUENCY[f3[0]] == pytest.approx(quantised((n - 0.75) / pairs[a, b]) if n else 0.0)
        assert ngrams._FREQUENCY[f2[0]] == pytest.approx(quantised((pairs[a, b] - 0.75) / heads[a]) if pairs.get((a, b)) else 0.0)
        assert ngrams._WEIGHT[g1[0]] == pytest.approx(quantised(0.75 * len({y for x, y in pairs if x == a}) / heads[a]) if a in heads else 1.0)
