"""Ranked lexical search over a length-stratified index.

A term is a maximal run of ASCII letters and digits and of characters beyond ASCII; only A to Z are
lowered. A document of n terms has the normaliser m = 75 + (25 n N) div L, where N documents hold
at least one term and L terms in all. A term that df documents hold weighs floor(1000 ln((2N+2)/(2df+1)));
the score of a document is the sum of weight * ((10^9 tf) div (1000 tf + 12 m)) over the terms of
the query, repeats included.

* `build` cuts the documents into index units of about ``UNIT_BYTES`` of text. In a unit, documents
  of equal m are a stratum; the postings of a term are ordered by stratum, then by tf, largest
  first. So the first posting of a stratum bounds what the term can give there, and one impact serves all
  postings of a tf.
* `search` takes the queries in blocks, sums the df of their terms over the units, and goes over the
  units once a block. A task keeps the best k of each query as it goes from unit to unit: it visits strata by
  falling bound, and leaves those whose bound is below the k-th score found so far. A stratum
  whose bound equals it is visited, since equal scores go by id. The best k of all tasks are ranked at the end, so
  a task returns k rows a query at most.

Texts without a term and null texts are in no unit and count in neither N nor L. Rows that repeat an
id are documents each and rank one after another; a null id ranks before all others of its score. Rows that repeat
a query id are queries each and return their own ranks. Queries without a term, and an empty table on either side,
give no rows. Terms are known by 64 bits of hash. Whole texts are read; a text beyond the
unit size is a unit of its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tellmark.llm.common import arrow, slices, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text of an index unit, and of the terms of a block of queries.
UNIT_BYTES = 4_000_000
BLOCK_BYTES = 4_000_000
NO_ID = -(1 << 63)

#: Bytes to their place in a term: A to Z lowered, all that is no part of a term a space.
_PLAIN = bytes(b if re.match(TERM, chr(b)) else 32 for b in range(128)).lower() + bytes(range(128, 256))
#: Bytes to 120 where they are part of a term, others a space.
_MARKED = bytes(32 if b == 32 else 120 for b in _PLAIN)


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PLAIN).split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def n_terms(text: str) -> int:
    """How many terms a text has: each begins after a byte that is part of none."""
    return (b" " + text.encode().translate(_MARKED)).count(b" x")


def totals(docs: DataFrame, text: str = "text", unit_bytes: int = UNIT_BYTES) -> tuple[int, int]:
    """N and L."""
    schema = "docs long, terms long"
    out = arrow(schema)

    def run(batches):
        for batch in batches:
            for _, _, texts in slices(batch.column(0), unit_bytes):
                n = [k for k in map(n_terms, texts) if k]
                yield pa.RecordBatch.from_pydict({"docs": [len(n)], "terms": [sum(n)]}, schema=out)

    rows = docs.select(text).where(F.col(text).isNotNull()).mapInArrow(run, schema)
    row = rows.agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def build(docs: DataFrame, text: str = "text", key: str = "doc_id", unit_bytes: int = UNIT_BYTES) -> tuple[DataFrame, int, int]:
    """The index (stored, a row per unit), N and L. Arrays are little-endian binary columns."""
    total_docs, total_terms = totals(docs, text, unit_bytes)
    schema = "ids binary, m binary, stratum binary, terms binary, bounds binary, tf binary, doc binary"
    out = arrow(schema)

    def run(batches):
        for batch in batches:
            keys = batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for a, b, texts in slices(batch.column(1), unit_bytes):
                unit = _unit(keys[a:b], texts, total_docs, total_terms)
                if unit is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in unit], schema=out)

    rows = docs.select(F.col(key).cast("long"), F.col(text)).where(F.col(text).isNotNull())
    return stored(rows.mapInArrow(run, schema), "ranked-index"), total_docs, total_terms


def _unit(keys: np.ndarray, texts: list[str], total_docs: int, total_terms: int) -> tuple | None:
    """Ids and strata of the documents, the terms, and their postings by stratum and falling tf."""
    n, words = np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        own = terms(text)
        n[i] = len(own)
        words += own
    if not words:
        return None
    coded = pa.array(words, pa.binary()).dictionary_encode()
    del words
    known = hashes(coded.dictionary.to_pylist())
    vocabulary, place = np.unique(known, return_inverse=True)
    term = place[coded.indices.to_numpy(zero_copy_only=False)]
    m = 75 + (25 * n * total_docs) // max(total_terms, 1)
    order = np.lexsort((keys, m))
    order = order[n[order] > 0]
    rank = np.zeros(len(texts), np.int64)
    rank[order] = np.arange(len(order))
    levels, stratum = np.unique(m[order], return_inverse=True)
    # (term, document) with its tf, then by term, stratum, falling tf
    pairs, tf = np.unique(term * len(order) + rank[np.repeat(np.arange(len(texts)), n)], return_counts=True)
    term, doc = pairs // len(order), pairs % len(order)
    by = np.lexsort((doc, -tf, stratum[doc], term))
    bounds = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    return (
        keys[order], levels.astype(np.int64), stratum.astype(np.int32), vocabulary, bounds.astype(np.int64),
        tf[by].astype(np.int32), doc[by].astype(np.int32),
    )


_KINDS = [np.int64, np.int64, np.int32, np.uint64, np.int64, np.int32, np.int32]


def _units(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            yield [np.frombuffer(batch.column(i)[row].as_buffer(), kind) for i, kind in enumerate(_KINDS)]


def _places(vocabulary: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted hashes stand, and which of them stand there at all."""
    at = np.minimum(np.searchsorted(vocabulary, wanted), len(vocabulary) - 1)
    return at, vocabulary[at] == wanted


def document_frequencies(index: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """The documents that hold each of the wanted terms (hashes); terms of none are missing."""
    schema = "term long, df long"
    out = arrow(schema)

    def run(batches):
        total = np.zeros(len(wanted), np.int64)
        for _, _, _, vocabulary, bounds, _, _ in _units(batches):
            at, known = _places(vocabulary, wanted)
            total += np.where(known, bounds[at + 1] - bounds[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], schema=out)

    rows = index.select("ids", "m", "stratum", "terms", "bounds", "tf", "doc").mapInArrow(run, schema)
    return {int(wanted[r["term"]]): r["df"] for r in rows.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best: highest scores, smaller ids first."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        use = scores >= least
        ids, scores = ids[use], scores[use]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def visit(unit: list[np.ndarray], wanted: np.ndarray, weights: np.ndarray, best: tuple, k: int) -> tuple:
    """The best k documents of those found so far and of a unit, by id and score."""
    ids, levels, stratum, vocabulary, bounds, tfs, docs = unit
    at, known = _places(vocabulary, wanted)
    at, weights = at[known], weights[known]
    if not len(at):
        return best
    lens = bounds[at + 1] - bounds[at]
    posting = np.arange(int(lens.sum())) + np.repeat(bounds[at] - (np.cumsum(lens) - lens), lens)
    term = np.repeat(np.arange(len(at)), lens)
    tf, doc = tfs[posting].astype(np.int64), docs[posting]
    level = stratum[doc]
    new_level = np.r_[True, (term[1:] != term[:-1]) | (level[1:] != level[:-1])]
    runs = np.flatnonzero(new_level | np.r_[True, tf[1:] != tf[:-1]])
    # one impact per term, stratum and tf
    impact = weights[term[runs]] * ((1_000_000_000 * tf[runs]) // (1000 * tf[runs] + 12 * levels[level[runs]]))
    bound = np.zeros(len(levels), np.int64)
    first = new_level[runs]
    np.add.at(bound, level[runs[first]], impact[first])
    order = np.argsort(-bound, kind="stable")
    impact = np.repeat(impact, np.diff(np.r_[runs, len(tf)]))
    sizes = np.cumsum(np.bincount(stratum, minlength=len(levels))[order])
    begin, seen, want = 0, 0, 4 * k
    while begin < len(order):
        floor = best[1][-1] if len(best[1]) == k else 1
        # strata that may reach the k-th score, twice as many documents at each step
        reach = int(np.searchsorted(-bound[order], -floor, side="right"))
        end = min(int(np.searchsorted(sizes, seen + want)) + 1, reach)
        if end <= begin:
            break
        now = np.zeros(len(levels), bool)
        now[order[begin:end]] = True
        use = now[level]
        scores = np.zeros(len(ids), np.int64)
        np.add.at(scores, doc[use], impact[use])
        found = np.flatnonzero(scores >= floor)
        best = _best(np.r_[best[0], ids[found]], np.r_[best[1], scores[found]], k)
        begin, seen, want = end, int(sizes[end - 1]), 2 * want
    return best


def _blocks(items: DataFrame, limit: int):
    """The queries in blocks: (number, id, counts of term hashes)."""
    held, size = [], 0
    for number, row in enumerate(items.toLocalIterator()):
        counts = Counter(terms(row["text"]))
        if not counts:
            continue
        words = list(counts)
        held.append((number, row["item_id"], hashes(words), np.fromiter(counts.values(), np.int64, len(words))))
        size += 16 * len(words)
        if size > limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(
    index: tuple[DataFrame, int, int], items: DataFrame, k: int = 20, item_text: str = "text", item_key: str = "item_id",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` best documents of every query: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    units, total_docs, _ = index
    units = units.select("ids", "m", "stratum", "terms", "bounds", "tf", "doc")
    schema = "number long, item_id long, doc_id long, score long"
    out = arrow(schema)
    queries = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    found = None
    for block in _blocks(queries, block_bytes):
        wanted = np.unique(np.concatenate([h for _, _, h, _ in block]))
        df = document_frequencies(units, wanted)
        weight = {h: math.floor(1000 * math.log((2 * total_docs + 2) / (2 * n + 1))) for h, n in df.items()}
        asked = []
        for number, item, own, repeats in block:
            weights = np.array([weight.get(int(h), 0) for h in own], np.int64) * repeats
            asked.append((number, item, own[weights > 0], weights[weights > 0]))
        shared = items.sparkSession.sparkContext.broadcast(asked)

        def run(batches, shared=shared):
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(shared.value)
            for unit in _units(batches):
                best = [visit(unit, own, weights, b, k) for (_, _, own, weights), b in zip(shared.value, best)]
            for (number, item, _, _), (ids, scores) in zip(shared.value, best):
                n = len(ids)
                cells = [pa.array([number] * n, pa.int64()), pa.array([item] * n, pa.int64()), pa.array(ids, mask=ids == NO_ID), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(cells, schema=out)

        rows = units.mapInArrow(run, schema)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
