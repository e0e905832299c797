import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tellmark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(items, capacity):
    """By trying everything."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[k] += items[i]
            place(i + 1, bins)
            bins[k] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def test_dominance_is_never_wrong():
    rng = random.Random(0)
    for _ in range(300):
        capacity = rng.choice([10, 20, 50])
        items = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 11))]
        counts = np.bincount(items, minlength=capacity + 1)
        fixed, rest = packing.reduce_instance(counts, capacity)
        assert all(sum(s) <= capacity for s, _ in fixed)
        left = np.repeat(np.arange(capacity + 1), rest).tolist()
        assert sum(t for _, t in fixed) + (fewest(left, capacity) if left else 0) == fewest(items, capacity)


@pytest.mark.parametrize("capacity,n", [(30, 500), (2048, 3000), (100, 100_000)])
def test_rules_place_every_item_once(capacity, n):
    rng = random.Random(n)
    sizes = Counter(min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(n))
    rules = defaultdict(list)
    for size, *rule in packing.plan(sizes, capacity).tolist():
        rules[size].append(rule)
    filled = defaultdict(list)
    for size, n_items in sizes.items():
        ends = [r[0] for r in rules[size][1:]] + [n_items]
        for (first, sequence, each, offset), end in zip(rules[size], ends):
            for k in range(end - first):
                filled[sequence + k // each].append((offset + k % each * size, size))
    for parts in filled.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    bound = -(-sum(s * c for s, c in sizes.items()) // capacity)
    assert len(filled) <= bound * 1.02 + 1


def texts():
    rng = random.Random(2)
    letters = "abcdefgh      \n\té日😀ßñ\x1c\x85\xa0.,'s12"
    fixed = ["", None, " ", "a <|endoftext|> b", "<|endoftext|>", "a\nb\n\nc \n d", "x" * 9000, "word " * 5000, "\n", "a\n"]
    return fixed + ["".join(rng.choice(letters) for _ in range(rng.randrange(600))) for _ in range(400)] + ["same text"] * 300


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pieces_equal_the_tokenizer_and_sequences_are_gapless(spark, capacity):
    lib = Tokenizer.from_file(PATH)
    data = [(i, t, "c") for i, t in enumerate(texts())] + [(1000, "row twice", "c")] * 2
    df = spark.createDataFrame(data, "doc_id long, text string, rank string").repartition(5)
    rows = packing.pack(df, PATH, capacity).collect()
    want = Counter()
    for i, t, _ in data:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(filled) <= -(-sum(r["length"] for r in rows) // capacity) + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
