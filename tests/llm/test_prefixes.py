"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tellmark.llm import prefixes


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    found = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        found[c] = own.get(base, [])[:h] + ts[h:]
    at = defaultdict(set)
    for c, ts in found.items():
        for d in range(len(ts) + 1):
            at[tuple(ts[:d])].add(c)
    kids = defaultdict(list)
    for p in at:
        if p:
            kids[p[:-1]].append(p)
    out, below = [], {}
    for p in sorted(at, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves = sum(below[k][0] for k in kids[p]) or 1
        saved = (len(at[p]) - 1) * words + sum(below[k][1] for k in kids[p])
        below[p] = leaves, saved
        ends = ",".join(map(str, sorted(c for c in at[p] if len(found[c]) == len(p))))
        out.append((min(at[p]), len(p), min(at[p[:-1]]) if p else None, len(at[p]), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for c in range(-30, n):
        if rng.random() < 0.1:
            continue
        for turn in range(rng.choice([1, 2, 3, 5, 9, 30])):
            text = rng.choice(["a b c", "", "hot  turn here", None, f"own {c} {turn}", f"some {rng.randint(0, 3)}"])
            rows.append((c, rng.choice([turn, turn, turn, None, 0]), rng.choice(["user", None, "bot"]), "first" if turn == 0 and rng.random() < 0.8 else text))
    rows += rows[:20] + [(None, 1, "user", "lost")] + [(500 + 20 * i, t, "user", f"copy {t}") for i in range(40) for t in range(4)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("range_bytes, block", [(300, 2), (2000, 5), (1 << 22, 16)])
def test_equals_plain_trie(spark, range_bytes, block):
    rows = made(range_bytes)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, prefix string, depth int")
    got = prefixes.trie(df.repartition(5), range_bytes=range_bytes, block=block)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixes.trie(df).collect() == []


def test_long_and_turnless(spark):
    rows = [(0, t, "u", f"t {t}") for t in range(3000)] + [(20, 0, None, None), (4, 0, "a", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, prefixes.trie(df, range_bytes=100).collect()), key=str) == plain(rows)


def test_tree_layouts_grow_and_keys_may_be_prefixes():
    rng = random.Random(3)
    for width in (1, 3, 40):
        keys = {bytes(rng.randrange(256) if i % 3 == 0 else 7 for i in range(rng.randrange(width + 2))) for _ in range(3000)}
        tree = prefixes.Tree()
        for i, key in enumerate(sorted(keys)):
            tree.insert(key, i)
        assert all(tree.get(key) == i for i, key in enumerate(sorted(keys)))
        assert tree.get(b"\x01" * 99) == -1
        layouts = {node.layout for node, _, _ in tree.walk()}
        assert width < 40 or layouts == {4, 16, 48, 256} or 256 in layouts
