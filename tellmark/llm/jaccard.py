"""N-gram Jaccard join by MinHash banding, with exact verification.

A text is the set of its runs of ``WORDS`` consecutive words (lower case, split at white space;
a shorter text is one run). Texts of one set are a class, so copies never meet each other. Each
class gets ``bands`` hashes of ``rows`` minima each; `banding` picks the two numbers so that a pair
at the threshold agrees in some band with the wanted probability. Classes that agree in a band
are candidates:

* they are put into blocks: every class goes to the smallest class that it shares a band with, and
  large groups are cut by a hash, at ``BLOCK_ROWS`` classes or ``BLOCK_GRAMS`` runs;
* a pair of blocks that meets in any band is a tile, once, however many bands agree;
* a block travels as one row, so a tile is two rows; it compares full sets of all its pairs by one product
  of 0/1 matrices (runs that only one class has are left out, columns go in parts), and returns the
  number of links of each class and a spanning forest of the links.

So nothing grows with the pairs of a group but the products inside tiles, one for 262,144 pairs. Components of the forests
are the classes of near duplicates.

Null, empty and blank texts have no runs and link with nothing. Rows that repeat an id count as
documents each. Where an id is null or has several texts, rows are known by a number of their id and
text (`named`), in the order of id and fingerprint of the text; null ids order before all others. An
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tellmark.llm.common import arrow, drop_state, free_name, join_checked, release, slices, stored, worker_state
from tellmark.llm.components import components, merge_labels
from tellmark.llm.substrings import Rolling

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.99999
#: Minima that a class may have.
MOST_HASHES = 256
BLOCK_ROWS = 512
BLOCK_GRAMS = 500_000
#: Columns of a 0/1 matrix held at once.
PART = 8192
SEED = 7


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: as many rows as possible (fewer false candidates) such that
    1 - (1 - threshold ** rows) ** bands reaches ``recall`` within ``most`` minima."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("no banding within the allowed number of minima reaches the recall")
    return best


class Shingler:
    """Sets of word runs as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.words, self.rolling = words, Rolling(words)

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Flat distinct hashes, sorted inside each text, and the bounds of the texts."""
        own = [t.lower().split() if t else [] for t in texts]
        n = np.fromiter(map(len, own), np.int64, len(own))
        windows = np.maximum(n - self.words + 1, 0)
        start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        hashes = self.rolling([w for x in own for w in x], start + np.repeat(np.cumsum(n) - n, windows))[0]
        doc = np.repeat(np.arange(len(own)), windows)
        short = np.flatnonzero((n > 0) & (windows == 0))
        if len(short):
            whole = [xxhash.xxh3_64_intdigest(" ".join(own[i])) for i in short.tolist()]
            hashes, doc = np.r_[hashes, np.array(whole, np.uint64)], np.r_[doc, short]
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
        hashes, doc = hashes[new], doc[new]
        return hashes, np.searchsorted(doc, np.arange(len(own) + 1))


def _fingerprint(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    other = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    other ^= other >> np.uint64(29)
    return np.add.reduceat(hashes, first).view(np.int64), np.add.reduceat(other * other, first).view(np.int64)


def signatures(docs: DataFrame, words: int = WORDS, bands: int = 1, rows: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, fingerprint ``k1``, ``k2``, number of runs ``n`` and band hashes (none without
    runs) of every text."""
    schema = "doc_id long, k1 long, k2 long, n int, bands array<long>"
    out = arrow(schema)
    source = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), text)
    multipliers = np.random.default_rng(SEED).integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    mixers = np.random.default_rng(SEED + 1).integers(0, 2**63, bands, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        shingler = worker_state(("runs", words), lambda: Shingler(words))
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, texts in slices(batch.column(1)):
                hashes, bounds = shingler(texts)
                size = np.diff(bounds)
                some = np.flatnonzero(size)
                first = bounds[some]
                signs = np.empty((len(some), bands), np.uint64)
                for band in range(bands):
                    value = np.full(len(some), band + 1, np.uint64)
                    for m in multipliers[band * rows : (band + 1) * rows] if len(some) else ():
                        value = (value ^ np.minimum.reduceat(hashes * m, first)) * mixers[band]
                        value ^= value >> np.uint64(32)
                    signs[:, band] = value
                keys = np.zeros((2, b - a), np.int64)
                keys[:, some] = _fingerprint(hashes, first)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.r_[0, np.cumsum(bands * (size > 0))].astype(np.int32)), pa.array(signs.ravel().view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b]), *map(pa.array, keys), pa.array(size.astype(np.int32)), lists.cast(out.field(4).type)],
                    schema=out,
                )
        drop_state()

    return source.mapInArrow(run, schema)


def _sets(docs: DataFrame, chosen: DataFrame, words: int, text: str, key: str) -> DataFrame:
    """``blk``, ``rep``, ``m`` and the full set of every chosen class, computed again from the
    text of its smallest document."""
    schema = "blk long, rep long, m long, grams binary"
    out = arrow(schema)
    source = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("_text"))
    source = join_checked(source, chosen, "rep", "inner", 64).select("_text", "blk", "rep", "m", "k1", "k2")

    def run(batches):
        shingler = worker_state(("runs", words), lambda: Shingler(words))
        for batch in batches:
            for a, b, texts in slices(batch.column(0)):
                hashes, bounds = shingler(texts)
                some = np.flatnonzero(np.diff(bounds))
                part = batch.slice(a, b - a).take(pa.array(some))
                k1, k2 = _fingerprint(hashes, bounds[some])
                right = (k1 == part.column("k1").to_numpy()) & (k2 == part.column("k2").to_numpy())
                grams = [hashes[bounds[i] : bounds[i + 1]].tobytes() for i in some[right].tolist()]
                part = part.filter(pa.array(right))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("blk", "rep", "m")], pa.array(grams, pa.binary())], schema=out)
        drop_state()

    return source.mapInArrow(run, schema)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of distinct hashes."""
    size = np.array([len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = count > 1
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for begin in range(0, int(shared.sum()), PART):
        a, b = np.searchsorted(column, (begin, begin + PART))
        matrix = np.zeros((len(sets), min(PART, int(shared.sum()) - begin)), np.float32)
        matrix[row[a:b], column[a:b] - begin] = 1
        total += matrix @ matrix.T
    return total


def _packed(sets: DataFrame) -> DataFrame:
    """One row per block: classes, members and set sizes of each, and all sets one after another."""
    schema = "blk long, reps binary, members binary, sizes binary, grams binary"
    out = arrow(schema)

    def run(table: pa.Table) -> pa.Table:
        reps, place = np.unique(table.column("rep").to_numpy(), return_index=True)
        table = table.take(pa.array(place))
        grams = table.column("grams").to_pylist()
        sizes = np.array([len(g) // 8 for g in grams], np.int64)
        cells = [table.column("blk")[0].as_py(), reps.tobytes(), table.column("m").to_numpy().tobytes(), sizes.tobytes(), b"".join(grams)]
        return pa.Table.from_arrays([pa.array([c], t.type) for c, t in zip(cells, out)], schema=out)

    return sets.groupBy("blk").applyInArrow(run, schema)


def _verified(tile_blocks: DataFrame, threshold: float) -> DataFrame:
    """``rep`` with ``links`` (members of linked classes), and with ``other``, a link to follow."""
    schema = "rep long, links long, other long"
    out = arrow(schema)

    def run(table: pa.Table) -> pa.Table:
        same = table.column("a")[0] == table.column("b")[0]
        numbers = lambda name: [np.frombuffer(x.as_buffer(), np.int64) for x in table.column(name)]
        ids, m, sizes = numbers("reps"), numbers("members"), numbers("sizes")
        side = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        sets = [s for g, n in zip(numbers("grams"), sizes) for s in np.split(g, np.cumsum(n)[:-1])]
        ids, m, size = np.concatenate(ids), np.concatenate(m), np.concatenate(sizes)
        both = overlaps(sets)
        i, j = np.nonzero(both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6)
        use = (i < j) & (same or (side[i] != side[j]))
        i, j = i[use], j[use]
        n = len(ids)
        both = sets = None
        release()
        counts = np.bincount(i, m[j], n).astype(np.int64) + np.bincount(j, m[i], n).astype(np.int64)
        label = merge_labels(np.arange(n), i, j)
        some, joined = np.flatnonzero(counts), np.flatnonzero(label != np.arange(n))
        other = pa.array(np.r_[np.zeros(len(some), np.int64), ids[label[joined]]], mask=np.arange(len(some) + len(joined)) < len(some))
        return pa.Table.from_arrays(
            [pa.array(np.r_[ids[some], ids[joined]]), pa.array(np.r_[counts[some], np.zeros(len(joined), np.int64)]), other], schema=out
        )

    return tile_blocks.groupBy("a", "b").applyInArrow(run, schema)


def named(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, str, DataFrame | None]:
    """``docs`` with a key that no two texts share and that is never null, its name, and ``n``,
    ``doc_id`` of every key (stored; nothing, and the id itself as the key, where ids are such keys)."""
    several = docs.groupBy(F.col(key).alias("doc_id")).agg(F.min(F.xxhash64(text)).alias("a"), F.max(F.xxhash64(text)).alias("b"))
    if several.where("doc_id is null or a <> b").isEmpty():
        return docs, key, None
    names = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("t")).distinct().orderBy("doc_id", "t")
    names = stored(names.withColumn("n", F.monotonically_increasing_id()), "text-names")
    name, t, doc = (free_name(docs, x) for x in ("_name", "_t", "_doc"))
    found = names.select(F.col("doc_id").alias(doc), F.col("t").alias(t), F.col("n").alias(name))
    rows = docs.withColumn(t, F.xxhash64(text))
    # the fingerprint spreads the rows of a frequent id; ids are compared null for null
    rows = rows.join(found, (rows[t] == found[t]) & rows[key].eqNullSafe(found[doc])).select(*[rows[f"`{c}`"] for c in docs.columns], found[name])
    return rows, name, names.select("n", "doc_id")


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, text: str = "text",
    key: str = "doc_id", block_rows: int = BLOCK_ROWS, block_grams: int = BLOCK_GRAMS,
) -> DataFrame:
    """One row per document: ``class_id`` (its smallest document), ``n_links`` (documents at or
    above the threshold) and ``kept`` (the document names its class)."""
    rows, name, names = named(docs, text, key)
    found = judged(rows, threshold, words, recall, text, name, block_rows, block_grams)
    if names is None:
        return found
    of = names.select(F.col("n").alias("class_id"), F.col("doc_id").cast("long").alias("_class"))
    found = found.join(names, F.col(name) == F.col("n")).drop("n").join(of, "class_id")
    return found.select(F.col("doc_id").alias(key), F.col("_class").alias("class_id"), "n_links", "kept")


def judged(
    docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, text: str = "text",
    key: str = "doc_id", block_rows: int = BLOCK_ROWS, block_grams: int = BLOCK_GRAMS,
) -> DataFrame:
    """`near_duplicates` of rows whose key is never null and has one text."""
    bands, rows = banding(threshold, recall)
    signed = stored(signatures(docs, words, bands, rows, text, key), "signatures")
    classes = signed.where("n > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")
    )
    classes = stored(classes, "classes")
    banded = classes.select("rep", "n", F.posexplode("bands").alias("band", "h"))
    groups = banded.groupBy("band", "h").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    candidates = stored(banded.join(groups.drop("_n"), ["band", "h"]).select("band", "h", "hub", "rep", "n"), "candidates")

    placed = candidates.groupBy("rep").agg(F.min("hub").alias("hub"), F.any_value("n").alias("n"))
    parts = placed.groupBy("hub").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / block_rows), F.ceil(F.sum("n") / block_grams)).cast("long").alias("_parts")
    )
    placed = placed.join(parts, "hub").select("rep", F.xxhash64("hub", F.pmod(F.xxhash64("rep"), "_parts")).alias("blk"))
    placed = stored(placed, "blocks")
    touched = candidates.select("band", "h", "rep").join(placed, "rep").groupBy("band", "h", "blk").agg(F.count(F.lit(1)).alias("_n"))
    left = touched.select("band", "h", F.col("blk").alias("a"), F.col("_n").alias("_na"))
    met = left.join(touched.withColumnRenamed("blk", "b"), ["band", "h"]).where("a < b or (a = b and _na > 1)")
    tiles = stored(met.select("a", "b").distinct(), "tiles")

    chosen = placed.join(classes.select("rep", "m", "k1", "k2"), "rep")
    blocks = stored(_packed(_sets(docs, chosen, words, text, key)), "block-sets")
    sides = tiles.select("a", "b", F.col("a").alias("blk")).unionByName(tiles.where("a <> b").select("a", "b", F.col("b").alias("blk")))
    found = stored(_verified(sides.join(blocks, "blk"), threshold), "tile-links")

    links = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("_links"))
    reached = components(found.where("other is not null"), "rep", "other").withColumnRenamed("node", "rep")
    named = classes.select("k1", "k2", "rep", "m").join(links, "rep", "left").join(reached, "rep", "left").select(
        "k1", "k2", (F.coalesce("_links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("class_id")
    )
    linked = signed.where("n > 0").select("doc_id", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "class_id", "n_links")
    blank = signed.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(blank).select(
        F.col("doc_id").alias(key), "class_id", "n_links", (F.col("doc_id") == F.col("class_id")).alias("kept")
    )
