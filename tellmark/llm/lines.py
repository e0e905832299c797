"""Line de-duplication by pairwise alignment.

A document is its sequence of line hashes (lines without the white space around them). Documents of
one sequence are a class; later copies of its smallest document lose all their lines. Every line
leads the classes that hold it to the smallest of them, so a line that a third of all documents hold
gives as many links as holders, not pairs. So does every shortest run of neighbouring lines with
``BLOCK_WORDS`` words: each line of a common block lies in such a run inside the block, so the
smallest class that holds the run is met, also where each line alone has another first holder. Two
classes overlap when such a link joins them, however common the line or run is.

Overlapping documents are aligned by patience diff: equal lines at both ends, then the lines that
occur once on either side, in their longest common order, and the same again between them. Runs of
aligned lines, with at least ``BLOCK_WORDS`` words together, are common blocks and are deleted from
the later document. The first holder of a line always keeps it.

Null and blank texts have no lines to delete. Lines end at ``\\n``; blank lines align with blank
lines but lead nowhere. Rows that repeat an id are the same document and not later than themselves.
Ids must not be null to be compared (rows without one stay as they are). An empty table gives an
empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tellmark.llm.common import BROADCAST_BYTES, arrow, boxed, rewritten, slices, stored

BLOCK_WORDS = 5
BLANK = 0
#: Odd multiplier of run hashes, its inverse, the value of a blank line and of the final mixing.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BLANK_VALUE = np.uint64(0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xFF51AFD7ED558CCD)


def line_hash(line: str) -> int:
    """Signed 64-bit hash of a line without white space around it; 0 for a blank one."""
    line = line.strip()
    return (xxhash.xxh3_64_intdigest(line) or 1) - (1 << 63) if line else BLANK


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two sequences by patience diff, in order."""
    found, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {h: j for j, h in enumerate(b[b0:b1], b0) if in_b[h] == 1 and h != BLANK}
        once = [(i, at[h]) for i, h in enumerate(a[a0:a1], a0) if h in at and in_a[h] == 1]
        anchors = _rising(once)
        for (i0, j0), (i1, j1) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            if anchors and i0 + 1 < i1 and j0 + 1 < j1:
                open_.append((i0 + 1, i1, j0 + 1, j1))
        found += anchors
    return sorted(found)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence with rising second places (patience sorting)."""
    tops, last, before = [], [], []
    for n, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        before.append(last[pile - 1] if pile else None)
        if pile == len(tops):
            tops.append(j)
            last.append(n)
        else:
            tops[pile], last[pile] = j, n
    out, n = [], last[-1] if last else None
    while n is not None:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def common_lines(later: list[int], earlier: list[int], words: list[int], least: int = BLOCK_WORDS) -> list[int]:
    """Places in ``later`` that belong to aligned blocks of at least ``least`` words."""
    out, block = [], []
    for i, j in [*align(later, earlier), (-1, -1)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(words[x] for x, _ in block) >= least:
                out += [x for x, _ in block]
            block = []
        block.append((i, j))
    return out


def sequences(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``t`` (hash of the text), fingerprint ``k1``, ``k2``, ``lines`` and ``words`` of every text
    that has a line."""
    schema = "doc_id long, t long, k1 long, k2 long, lines array<long>, words array<int>"
    out = arrow(schema)
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(key).cast("long"), F.xxhash64(text), text)

    def run(batches):
        for batch in batches:
            for a, b, texts in slices(batch.column(2)):
                found = []
                for doc, t, content in zip(*[batch.column(i).slice(a, b - a).to_pylist() for i in (0, 1)], texts):
                    own = content.split("\n")
                    hashes = [line_hash(line) for line in own]
                    if any(hashes):
                        whole = xxhash.xxh3_128_intdigest(np.array(hashes, np.int64).tobytes())
                        k1, k2 = (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63)
                        found.append((doc, t, k1, k2, hashes, [len(line.split()) for line in own]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), out)], schema=out)

    return rows.mapInArrow(run, schema)


def run_hashes(hashes: np.ndarray, words: np.ndarray, least: int = BLOCK_WORDS) -> np.ndarray:
    """Distinct hashes of the shortest runs of two or more lines with at least ``least`` words that
    begin or that end at each line (runs of one line are the line)."""
    total = np.r_[0, np.cumsum(words, dtype=np.int64)]
    n = len(hashes)
    ends = np.searchsorted(total, total[:-1] + least)
    begins = np.searchsorted(total, total[1:] - least, side="right") - 1
    begin, end = np.r_[np.arange(n), begins], np.r_[ends, np.arange(1, n + 1)]
    use = (begin >= 0) & (end <= n) & (end - begin > 1)
    begin, end = begin[use], end[use]
    if not len(begin):
        return np.zeros(0, np.int64)
    values = np.where(hashes == BLANK, BLANK_VALUE, hashes.view(np.uint64))
    up, down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (BASE, INVERSE))
    sums = np.r_[np.uint64(0), np.cumsum(values * up[:n], dtype=np.uint64)]
    h = (sums[end] - sums[begin]) * down[begin]
    h ^= h >> np.uint64(32)
    h *= MIX
    h ^= h >> np.uint64(29)
    return np.unique(h).view(np.int64)


def _held(classes: DataFrame, block_words: int) -> DataFrame:
    """``rep``, ``k1`` and ``h``: the lines and shortest runs of lines of every class, once each."""
    schema = "rep long, k1 long, h long"
    out = arrow(schema)

    def run(batches):
        for batch in batches:
            at, found = [], []
            for k in range(batch.num_rows):
                own, words = (np.asarray(batch.column(i)[k].values) for i in (2, 3))
                single = np.unique(own)
                found += [single[single != BLANK], run_hashes(own, words, block_words)]
                at.append(len(found[-2]) + len(found[-1]))
            if found:
                at = np.repeat(np.arange(batch.num_rows), at)
                keys = [pa.array(batch.column(i).to_numpy()[at]) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.concatenate(found))], schema=out)

    return classes.select("rep", "k1", "lines", "words").mapInArrow(run, schema)


def overlapping(classes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``rep``, ``k1`` and ``first``: classes joined with the first holder of lines, and of runs of
    lines, that they share."""
    held = _held(classes, block_words)
    holders = held.groupBy("h").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return held.join(holders, "h").where("rep <> first").select("rep", "k1", "first").distinct()


def _deleted(pairs: DataFrame, classes: DataFrame, block_words: int) -> DataFrame:
    """``rep``, ``k1`` and the places of its lines to delete."""
    schema = "rep long, k1 long, places array<int>"
    out = arrow(schema)
    later = classes.select("rep", "k1", "lines", "words")
    earlier = classes.select(F.col("rep").alias("first"), F.col("lines").alias("others"))
    both = pairs.join(earlier, "first").join(later, ["rep", "k1"]).select("rep", "k1", "lines", "words", "others")

    def run(batches):
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                rep, k1, own, words, others = (c[k].as_py() for c in batch.columns)
                places = common_lines(own, others, words, block_words)
                if places:
                    found.append((rep, k1, places))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), out)], schema=out)

    places = both.mapInArrow(run, schema)
    return places.groupBy("rep", "k1").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))


def deletions(docs: DataFrame, text: str = "text", key: str = "doc_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id``, ``t``, ``places`` of lines to delete (null: all), for documents that lose any (stored)."""
    seqs = stored(sequences(docs, text, key), "line-sequences")
    classes = seqs.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("rep"), F.any_value("lines").alias("lines"), F.any_value("words").alias("words")
    )
    classes = stored(classes, "line-classes")
    pairs = stored(overlapping(classes, block_words), "line-pairs")
    places = _deleted(pairs, classes, block_words)
    named = seqs.select("doc_id", "t", "k1", "k2").join(classes.select("k1", "k2", "rep"), ["k1", "k2"])
    copies = named.where("doc_id <> rep").select("doc_id", "t", F.lit(None).cast("array<int>").alias("places"))
    firsts = named.where("doc_id = rep").select("doc_id", "t", "rep", "k1").join(places, ["rep", "k1"]).select("doc_id", "t", "places")
    return stored(copies.unionByName(firsts).distinct(), "line-deletions")


def _with_deletions(docs: DataFrame, found: DataFrame, text: str, key: str) -> DataFrame:
    """All rows with ``_loses`` and ``_places``; the deletions are broadcast where they are few."""
    size = found.agg(F.coalesce(F.sum(F.coalesce(F.size("places"), F.lit(0)) * 4 + 72), F.lit(0)).alias("n")).first()["n"]
    found = found.select(
        F.col("doc_id").alias("_doc"), F.col("t").alias("_t"), F.col("places").alias("_places"), F.lit(True).alias("_loses")
    )
    rows = boxed(docs, text)
    rows = rows.withColumn("_doc", F.col("_row").getField(key).cast("long")).withColumn("_t", F.xxhash64("_text"))
    return rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, ["_doc", "_t"], "left")


def _kept(text: str | None, loses, places) -> tuple[str | None, int, int]:
    """What stays of a text, its number of lines, and how many of them go."""
    if not text or not text.strip():
        return text, 0, 0
    own = text.split("\n")
    if not loses:
        return text, len(own), 0
    gone = set(range(len(own))) if places is None else set(places)
    return "\n".join([x for i, x in enumerate(own) if i not in gone]), len(own), len(gone)


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_lines``, ``n_removed`` and ``kept_sha256`` (of what is left of the text)."""
    rows = _with_deletions(docs.select(key, text), deletions(docs, text, key), text, key)
    rows = rows.select(F.col("_row").getField(key).alias(key), "_text", "_loses", "_places")
    schema = f"{key} {dict(docs.dtypes)[key]}, n_lines long, n_removed long, kept_sha256 string"
    out = arrow(schema)

    def run(batches):
        for batch in batches:
            cells = [[], [], []]
            for a, b, texts in slices(batch.column(1)):
                for x in zip(texts, *[batch.column(i).slice(a, b - a).to_pylist() for i in (2, 3)]):
                    kept, n, gone = _kept(*x)
                    for cell, value in zip(cells, (n, gone, sha256((kept or "").encode()).hexdigest())):
                        cell.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t.type) for c, t in zip(cells, list(out)[1:])]], schema=out)

    return rows.mapInArrow(run, schema)


def clean(docs: DataFrame, text: str = "text", key: str = "doc_id", left: str = "lines_left") -> DataFrame:
    """``docs`` without the deleted lines; ``left`` counts the lines with content that stay."""
    rows = _with_deletions(docs, deletions(docs, text, key), text, key)

    def cut(texts, loses, places):
        kept = [_kept(*x)[0] for x in zip(texts, loses, places)]
        return kept, [sum(1 for x in (t or "").split("\n") if x.strip()) for t in kept]

    return rewritten(rows, docs.schema, text, ["_loses", "_places"], [T.StructField(left, T.LongType())], cut)
