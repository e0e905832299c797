"""Nearest neighbours of a stated query set by inner product, in a block matrix join.

Queries and candidates are cut into blocks by a hash of the id; every pair of a query block and a
candidate block is one tile with a key of its own, so tiles spread over all tasks. A tile takes
int8 products with error bounds (`tiles`). The k-th best lower bound of a query excludes all
candidates whose upper bound is below it; what survives is computed again in double precision, and
the best k stay in a heap per query while a task goes through its tiles. The heaps of the tasks
meet in one ranking per query of at most k rows from each tile. The search is exact.

Rows without an id, and vectors that are null, zero or hold null or non-finite components, take no
part. Vectors meet only those of their own dimension. Rows that repeat an id count once, with the
smallest vector. Ties go to the smaller id. Without candidates a query has no rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tellmark.llm import tiles
from tellmark.llm.common import arrow, stored

BLOCK_ROWS = 4096
#: Rows of a query block whose products are held at once.
STRIP = 256


def _blocks(rows: DataFrame, name: str, total: int, block_rows: int) -> tuple[DataFrame, int]:
    many = max(1, -(-total // block_rows))
    keyed = rows.withColumn(name, F.pmod(F.xxhash64("_id"), F.lit(many)).cast("int"))
    return tiles.packed(keyed, ["_dim", name], "_id", "_v"), many


def search(rows: DataFrame, queries: Column, k: int, vector: str = "embedding", key: str = "vec_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k nearest of every row where
    ``queries`` holds, among all other rows."""
    used = rows.where(tiles.usable(vector) & F.col(key).isNotNull())
    used = used.select(F.col(key).cast("long").alias("_id"), F.col(vector).alias("_v"), queries.alias("_asks"))
    used = used.groupBy("_id").agg(F.min("_v").alias("_v"), F.max("_asks").alias("_asks"))
    used = stored(used.withColumn("_dim", F.size("_v")), "vectors")
    total, asked = used.agg(F.count(F.lit(1)), F.count(F.when(F.col("_asks"), 1))).first()
    candidates, n_c = _blocks(used, "_cb", total, block_rows)
    asking, n_q = _blocks(used.where("_asks"), "_qb", asked, block_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asking.select("_dim", "_qb", *[F.col(c).alias(f"q_{c}") for c in ("n", "dim", "ids", "weights", "vectors")])
    pairs = left.withColumn("_cb", every(n_c)).join(candidates.withColumn("_qb", every(n_q)), ["_dim", "_qb", "_cb"])
    pairs = pairs.select(*[f"q_{c}" for c in ("n", "dim", "ids", "weights", "vectors")], "n", "dim", "ids", "weights", "vectors")
    schema = "query_id long, vec_id long, score double"
    out = arrow(schema)

    def run(batches):
        best: dict[int, list] = defaultdict(list)
        for batch in batches:
            for k_row in range(batch.num_rows):
                row = [c[k_row].as_py() for c in batch.columns]
                _tile(tiles.Block(*row[:5]), tiles.Block(*row[5:]), k, best)
        found = [(q, -v, s) for q, heap in best.items() for s, v in heap]
        columns = zip(*found) if found else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, out)], schema=out)

    found = pairs.mapInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(key), "score"
    )


def _tile(asking: tiles.Block, others: tiles.Block, k: int, best: dict[int, list]) -> None:
    """Push what a tile finds into the heaps of its queries: (score, -id), worst first."""
    for begin in range(0, len(asking.ids), STRIP):
        rows = slice(begin, min(begin + STRIP, len(asking.ids)))
        ids = asking.ids[rows]
        product, near = tiles.bounds(asking, others, rows)
        own = others.ids[None, :] == ids[:, None]
        low = np.where(own, -np.inf, product - near)
        least = np.full(len(ids), -np.inf)
        if len(others.ids) > k:
            least = np.partition(low, -k, axis=1)[:, -k]
        held = [best[q][0][0] if len(best[q]) == k else -np.inf for q in ids.tolist()]
        least = np.maximum(least, held)
        i, j = np.nonzero((product + near >= least[:, None]) & ~own)
        score = tiles.products(asking.exact, others.exact, i + begin, j)
        vec = others.ids[j]
        order = np.lexsort((vec, -score, i))
        i, score, vec = i[order], score[order], vec[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        few = nth < k
        for q, s, v in zip(ids[i[few]].tolist(), score[few].tolist(), vec[few].tolist()):
            heap = best[q]
            if len(heap) < k:
                heapq.heappush(heap, (s, -v))
            elif (s, -v) > heap[0]:
                heapq.heapreplace(heap, (s, -v))
