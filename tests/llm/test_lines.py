import hashlib
import random
from collections import Counter, defaultdict

from tellmark.llm import lines


def runs(seq, words, least=5):
    """Single lines, and shortest runs of lines with so many words, as tuples."""
    out = {(h,) for h in seq if h}
    for i in range(len(seq)):
        for ends in (range(i + 1, len(seq) + 1), range(i, -1, -1)):
            spans = [(min(i, e), max(i + 1, e)) for e in ends]
            span = next((x for x in spans if sum(words[x[0] : x[1]]) >= least), None)
            if span:
                out.add(tuple(seq[span[0] : span[1]]))
    return out


def plain(data, least=5):
    """Each text beside the texts of the first holders of its lines and of its shortest runs of lines."""
    seq = {}
    for d, t in data:
        if t and t.strip():
            seq[d, t] = tuple(lines.line_hash(x) for x in t.split("\n")), [len(x.split()) for x in t.split("\n")]
    rep, keys, first = {}, {}, {}
    for (d, _), (s, words) in seq.items():
        rep[s] = min(rep.get(s, d), d)
        keys[s] = runs(s, words, least)
    for s, d in rep.items():
        for x in keys[s]:
            first[x] = min(first.get(x, d), d)
    out = []
    for d, t in data:
        if (d, t) not in seq:
            out.append((d, 0, 0, hashlib.sha256((t or "").encode()).hexdigest()))
            continue
        (s, words), own, gone = seq[d, t], t.split("\n"), set()
        if rep[s] != d:
            gone = set(range(len(own)))
        else:
            partners = {first[x] for x in keys[s]} - {d}
            for other, e in rep.items():
                if e in partners:
                    gone.update(lines.common_lines(list(s), list(other), words, least))
        kept = "\n".join(x for i, x in enumerate(own) if i not in gone)
        out.append((d, len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(21)
    line = lambda: " ".join(rng.choice("abcdefg") + str(rng.randrange(99)) for _ in range(rng.randrange(1, 9)))
    common = [line() + " common line of many documents" for _ in range(3)]
    bases = [[line() for _ in range(rng.randrange(1, 25))] for _ in range(30)]
    out = []
    for _ in range(260):
        own = list(rng.choice(bases)) if rng.random() < 0.6 else [line() for _ in range(rng.randrange(1, 10))]
        for _ in range(rng.choice([0, 0, 1, 3])):
            own[rng.randrange(len(own))] = rng.choice([line(), "", " ", rng.choice(common)])
        if rng.random() < 0.5:
            own.insert(0, rng.choice(common))
        if rng.random() < 0.2:
            own += rng.choice(bases)[:4]
        out.append("\n".join(x + rng.choice(["", "", "\r", "  "]) for x in own))
    group = [line() + " x y z w" for _ in range(6)]
    for i in range(60):
        own = list(group)
        own[i % 6] = line() + f" changed {i}"
        out.append("\n".join(own))
    out += [None, "", "\n \n", "one", "one", "\n".join(["again and again and again"] * 500), "\n".join(["again and again and again"] * 400)]
    rng.shuffle(out)
    data = [(i * 3 - 50, t) for i, t in enumerate(out)]
    return data + [data[4], data[4], (data[9][0], "another text\nof the same id")]


def test_equals_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(d, t, "p", 1) for d, t in data], "doc_id long, text string, places string, t int").repartition(5)
    got = lines.digests(df)
    assert got.columns == ["doc_id", "n_lines", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(data)
    kept = lines.clean(df)
    assert kept.columns == ["doc_id", "text", "places", "t", "lines_left"]
    sha = Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in kept.collect())
    assert sha == Counter((d, h) for d, _, _, h in plain(data))


def test_alignment():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randrange(30))]
        b = [x for x in a if rng.random() < 0.8] + [rng.randrange(12) for _ in range(rng.randrange(4))]
        pairs = lines.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    distinct = rng.sample(range(1, 1000), 200)
    fewer = [x for x in distinct if x % 3]
    assert [a for a, _ in lines.align(distinct, fewer)] == [i for i, x in enumerate(distinct) if x % 3]
    assert lines.align(distinct, distinct) == [(i, i) for i in range(200)]


def test_first_holder_keeps_its_lines(spark):
    data = rows()
    texts, kept, seen = defaultdict(list), defaultdict(list), set()
    for d, t in data:
        texts[d] += (t or "").split("\n")
    for r in lines.clean(spark.createDataFrame(data, "doc_id long, text string")).collect():
        kept[r["doc_id"]] += (r["text"] or "").split("\n")
    for d in sorted(texts):
        for x in texts[d]:
            if x.strip() and x.strip() not in seen:
                seen.add(x.strip())
                assert x in kept[d]


def test_empty_table_and_null_id(spark):
    assert lines.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert [r["n_removed"] for r in lines.digests(df).collect()] == [0, 0]
