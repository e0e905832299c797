"""Near duplicates among vectors of one label, by cosine.

Equal vectors of a label are one class, so copies never meet each other. The classes of a label
are cut into blocks by a hash; every pair of blocks is one tile with a key of its own. A tile takes
int8 products of unit vectors with error bounds (`tiles`): pairs surely below the threshold are
dropped, pairs surely above it count, and only the pairs in between are computed in double
precision. A tile returns the number of links of each of its classes, and of the links themselves
a spanning forest, so what leaves it is linear in its rows however many pairs link. Components
come from the forests.

Rows without an id are left out; rows that repeat an id count once, with the smallest label and
vector. Rows without a label, and vectors that are null, zero or hold null or non-finite
components, link with nothing but are returned. Vectors of different dimension do not link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tellmark.llm import tiles
from tellmark.llm.common import arrow, stored
from tellmark.llm.components import components, merge_labels

THRESHOLD = 0.93
BLOCK_ROWS = 2048
STRIP = 512

PARTS = ("n", "dim", "ids", "weights", "vectors")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, vector: str = "embedding", label: str = "label", key: str = "vec_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per id: ``n_links``, ``component_id`` and ``kept``."""
    one = rows.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("_id"), F.struct(F.col(label).alias("_label"), F.col(vector).alias("_v")).alias("_s")
    ).groupBy("_id").agg(F.min("_s").alias("_s")).select("_id", "_s._label", "_s._v")
    one = stored(one.withColumn("_use", tiles.usable("_v") & F.col("_label").isNotNull()), "vectors")
    used = one.where("_use")
    classes = stored(used.groupBy("_label", "_v").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_m")), "classes")
    found = stored(_tiles(classes, threshold, block_rows), "tile-links")
    links = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("_links"))
    reached = components(found.where("other is not null"), "rep", "other")
    own = classes.join(links, classes["_rep"] == links["rep"], "left").drop("rep")
    own = own.join(reached, own["_rep"] == reached["node"], "left").select(
        "_label", "_v",
        (F.coalesce("_links", F.lit(0)) + F.col("_m") - 1).alias("_n"),
        F.coalesce("component", "_rep").alias("_component"),
    )
    linked = used.join(own, ["_label", "_v"]).select("_id", "_n", "_component")
    alone = one.where("not _use").select("_id", F.lit(0).cast("long").alias("_n"), F.col("_id").alias("_component"))
    return linked.unionByName(alone).select(
        F.col("_id").alias(key), F.col("_n").alias("n_links"), F.col("_component").alias("component_id"),
        (F.col("_id") == F.col("_component")).alias("kept"),
    )


def _tiles(classes: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """``rep`` with ``links`` (members of linked classes), and with ``other``, a link to follow."""
    classes = classes.withColumn("_dim", F.size("_v"))
    blocks = classes.groupBy("_label", "_dim").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks"))
    keyed = classes.join(blocks, ["_label", "_dim"]).withColumn("_b", F.pmod(F.xxhash64("_rep"), F.col("_blocks")).cast("int"))
    keyed = tiles.packed(keyed, ["_label", "_dim", "_blocks", "_b"], "_rep", "_v", "_m")
    first = keyed.withColumn("_a", F.col("_b")).withColumn("_z", F.explode(F.sequence("_a", F.col("_blocks") - 1)))
    second = keyed.withColumn("_z", F.col("_b")).withColumn("_a", F.explode(F.sequence(F.lit(0), F.col("_z"))))
    place = ["_label", "_dim", "_a", "_z"]
    pairs = first.select(*place, *[F.col(c).alias(f"a_{c}") for c in PARTS]).join(second.select(*place, *PARTS), place)
    pairs = pairs.select(F.col("_a") == F.col("_z"), *[f"a_{c}" for c in PARTS], *PARTS)
    schema = "rep long, links long, other long"
    out = arrow(schema)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                same, *row = (c[k].as_py() for c in batch.columns)
                a = tiles.Block(*row[:5], unit=True)
                yield _linked(a, a if same else tiles.Block(*row[5:], unit=True), threshold, out)

    return pairs.mapInArrow(run, schema)


def _linked(a: tiles.Block, b: tiles.Block, threshold: float, out: pa.Schema) -> pa.RecordBatch:
    same = a is b
    n = len(a.ids) + (0 if same else len(b.ids))
    shift = 0 if same else len(a.ids)
    weights = a.weights if same else np.r_[a.weights, b.weights]
    ids = a.ids if same else np.r_[a.ids, b.ids]
    counts, label = np.zeros(n, np.int64), np.arange(n)
    unit = [x.exact / np.abs(x.exact).max(axis=1, keepdims=True) / x.size[:, None] for x in (a, b)]
    for begin in range(0, len(a.ids), STRIP):
        rows = slice(begin, min(begin + STRIP, len(a.ids)))
        product, near = tiles.bounds(a, b, rows)
        i, j = np.nonzero(product + near >= threshold)
        i_all = i + begin
        if same:
            later = i_all < j
            i, j, i_all = i[later], j[later], i_all[later]
        sure = product[i, j] - near[i, j] >= threshold
        ask = np.flatnonzero(~sure)
        sure[ask] = tiles.products(unit[0], unit[1], i_all[ask], j[ask]) >= threshold
        i, j = i_all[sure], j[sure] + shift
        counts += np.bincount(i, weights[j], n).astype(np.int64) + np.bincount(j, weights[i], n).astype(np.int64)
        label = merge_labels(label, i, j)
    some, joined = np.flatnonzero(counts), np.flatnonzero(label != np.arange(n))
    rep = np.r_[ids[some], ids[joined]]
    blank = np.zeros(len(joined), np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(rep),
            pa.array(np.r_[counts[some], blank]),
            pa.array(np.r_[np.zeros(len(some), np.int64), ids[label[joined]]], mask=np.r_[np.ones(len(some), bool), blank > 0]),
        ],
        schema=out,
    )
