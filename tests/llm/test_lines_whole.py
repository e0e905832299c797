import random

import numpy as np

from tellmark.llm import lines
from test_lines import plain, rows, runs


def test_common_line_leaves_all_but_its_first_holder(spark):
    line = "one line of nine words that all texts hold"
    data = [(i, f"own text {i} a\n{line}\nown end {i} b") for i in range(40)]
    got = lines.digests(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(i, int(i > 0)) for i in range(40)]


def test_equals_plain_version_with_first_holders_of_lines_and_runs(spark):
    data = list(dict(rows()).items())
    data = [(d, t) for d, t in data if t and t.strip()]
    split = {d: ([lines.line_hash(x) for x in t.split("\n")], [len(x.split()) for x in t.split("\n")]) for d, t in data}
    same, first, want = {}, {}, []
    for d in sorted(split):
        rep = same.setdefault(tuple(split[d][0]), d)
        keys = runs(*split[d])
        gone = set(range(len(split[d][0]))) if rep != d else set()
        for e in {first.setdefault(x, d) for x in keys} - {d} if rep == d else ():
            gone.update(lines.common_lines(split[d][0], split[e][0], split[d][1]))
        want.append((d, len(gone)))
    got = lines.digests(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == want
    assert want == sorted((d, n) for d, _, n, _ in plain(data))


def every_earlier(data, least=5):
    """Number of lines that go when a text is aligned with all texts of smaller ids."""
    seq = {d: [lines.line_hash(x) for x in t.split("\n")] for d, t in data}
    out = []
    for d, t in data:
        gone, words = set(), [len(x.split()) for x in t.split("\n")]
        for e in seq:
            if e < d:
                gone.update(lines.common_lines(seq[d], seq[e], words, least))
        out.append((d, len(gone)))
    return sorted(out)


def test_block_whose_lines_have_other_first_holders(spark):
    block = ["two words", "", "three more words", "one", "last pair"]
    data = [(i, f"start {i}\n{x}\nstop {i}") for i, x in enumerate(block)]
    data += [(i, f"begin {i}\n" + "\n".join(block) + f"\nend {i}") for i in range(10, 13)]
    got = lines.digests(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == every_earlier(data)
    assert every_earlier(data)[-2:] == [(11, 5), (12, 5)]


def test_every_line_of_a_block_is_in_a_run_of_it():
    rng = random.Random(5)
    for _ in range(300):
        words = np.array([rng.randrange(5) for _ in range(rng.randrange(2, 12))])
        hashes = np.array([rng.randrange(1, 1 << 60) if w else 0 for w in words])
        inside = set(lines.run_hashes(hashes, words).tolist())
        around = np.r_[np.array([7, 8]), hashes, np.array([9])], np.r_[np.array([3, 1]), words, np.array([4])]
        assert inside <= set(lines.run_hashes(*around).tolist())
        assert bool(inside) == (words.sum() >= 5)
