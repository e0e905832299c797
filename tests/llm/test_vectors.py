import math
import random

import numpy as np

from tellmark.llm import neardup, neighbours, tiles
from tellmark.llm.components import components
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, _v int, rank int, ids int"


def data(n=260, dim=12):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, dim))
    rows = []
    for i in range(n):
        v = centres[i % 9] * rng.choice([1, 3]) + rng.normal(size=dim) * rng.choice([0.02, 0.25, 1.0])
        rows.append((int(i * 3 - 60), [float(x) for x in v.astype(np.float32)], int(i % 4) if i % 11 else None))
    for k in range(40):  # copies
        rows.append((2000 + 20 * k, rows[5][1], rows[5][2]))
    rows += [
        (5000, None, 1), (5020, [0.0] * dim, 1), (5040, [1.0] * (dim - 1) + [None], 1), (5060, [math.nan] * dim, 1),
        (5080, [math.inf] + [1.0] * (dim - 1), 1), (5100, [], 1), (5120, [1.0, 2.0], 1), (5140, [1.0, 2.0], 1),
        (None, rows[5][1], 1), rows[7], rows[7], (5160, [1e-30] * dim, 2), (5180, [1e18] * dim, 2),
    ]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(6)


def good(v):
    return v and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_search_equals_brute_force(spark):
    rows = data()
    got = [tuple(r) for r in neighbours.search(frame(spark, rows), F.col("vec_id") % 20 == 0, 7, block_rows=64).collect()]
    use = {}
    for i, v, _ in rows:
        if i is not None and good(v):
            use[i] = min(use.get(i, v), v)
    want = []
    for q, v in use.items():
        if q % 20 == 0:
            scored = []
            for i, w in use.items():
                if i != q and len(w) == len(v):
                    s = 0.0
                    for x, y in zip(v, w):
                        s += float(np.float32(x)) * float(np.float32(y))
                    scored.append((-s, i))
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:7])]
    assert sorted(got) == sorted(want)


def test_near_duplicates_equal_brute_force(spark):
    rows = data()
    got = {r["vec_id"]: tuple(r)[1:] for r in neardup.near_duplicates(frame(spark, rows), block_rows=32).collect()}
    one = {}
    for i, v, lab in rows:
        if i is not None:
            one[i] = (lab, v)
    ids = sorted(one)
    unit = {i: np.array(one[i][1], float) / max(abs(np.array(one[i][1], float))) for i in ids if good(one[i][1])}
    links = {i: [] for i in ids}
    for i in ids:
        for j in ids:
            if i < j and i in unit and j in unit and one[i][0] is not None and one[i][0] == one[j][0] and len(unit[i]) == len(unit[j]):
                if unit[i] @ unit[j] / np.sqrt(unit[i] @ unit[i]) / np.sqrt(unit[j] @ unit[j]) >= 0.93:
                    links[i].append(j)
                    links[j].append(i)
    root = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            root[i] = min([root[i], *[root[j] for j in links[i]]])
    assert got == {i: (len(links[i]), root[i], root[i] == i) for i in ids}


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for unit in (False, True):
        x, y = rng.normal(size=(50, 1500)), rng.normal(size=(70, 1500)) * 1e5
        a, b = (tiles.Block(len(m), 1500, np.arange(len(m)).tobytes(), np.ones(len(m), int).tobytes(), m.tobytes(), unit) for m in (x, y))
        if unit:
            x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
        product, near = tiles.bounds(a, b, slice(0, 50))
        off = np.abs(product - x @ y.T)
        assert (off <= near).all() and near.max() < 0.05 * np.abs(a.norm).max() * np.abs(b.norm).max()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(5, 5), (None, 3)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(3000, 3001 + i) for i in range(50)]
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            if a is not None and a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted(root.items())


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert neighbours.search(empty, F.col("vec_id") % 20 == 0, 5).collect() == []
    assert neardup.near_duplicates(empty).collect() == []
