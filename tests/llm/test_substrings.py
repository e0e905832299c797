import hashlib
import random
import re

from tellmark.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window):
    """Every window by its words."""
    first = {}
    for doc, text in rows:
        words = WORD.findall(text or "")
        for i in range(len(words) - window + 1):
            k = tuple(words[i : i + window])
            first[k] = min(first.get(k, (doc, i)), (doc, i))
    out = []
    for doc, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (doc, i):
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept))
    return out


def rows():
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "bé", "c\x1cd", "ee", "f g", "日本"])
    passages = [[word() + str(rng.randrange(40)) for _ in range(rng.randrange(4, 60))] for _ in range(12)]
    out = []
    for doc in range(300):
        words = []
        for _ in range(rng.randrange(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(30))]
        gap = lambda: rng.choice([" ", "\n", " \t", "\r\n"])
        out.append((rng.randrange(10**12) * 300 + doc, "".join(w + gap() for w in words)))
    out += [(1, None), (2, ""), (3, "  \n"), (-5, "x " * 5000), (7, "x " * 30), (8, "short text")]
    out += [(out[3][0] + 1, out[3][1]), out[4], out[4], (-(2**62), out[5][1])]
    return out


def test_digests_equal_plain_windows(spark):
    data = rows()
    df = spark.createDataFrame([(d, t, "z", 1) for d, t in data], "doc_id long, text string, begins string, _n int").repartition(7)
    for window in (20, 6):
        got = sorted(map(tuple, substrings.digests(df, window).collect()))
        assert got == sorted(x[:4] for x in plain(data, window))


def test_clean_keeps_words_and_columns(spark):
    data = rows()
    df = spark.createDataFrame([(d, t, "z") for d, t in data], "doc_id long, text string, part string")
    got = substrings.clean(df, 6)
    assert got.columns == ["doc_id", "text", "part", "words_left"]
    want = {d: kept for d, *_, kept in plain(data, 6)}
    for r in got.collect():
        assert WORD.findall(r["text"] or "") == want[r["doc_id"]]
        assert r["words_left"] == len(want[r["doc_id"]])


def test_empty_table_and_null_id(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.digests(empty).collect() == []
    text = " ".join(map(str, range(25)))
    df = spark.createDataFrame([(None, text), (4, text)], "doc_id long, text string")
    assert [(r["doc_id"], r["n_removed"]) for r in substrings.digests(df).orderBy("doc_id").collect()] == [(None, 0), (4, 25)]
