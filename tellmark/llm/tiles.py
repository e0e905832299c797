"""Blocks of vectors and their int8 products with error bounds.

A vector v is quantised to integers q of at most 127 times a scale s; e = v - s q is known, so

    |a.b - s_a s_b (q_a . q_b)|  <=  |s_a q_a| |e_b| + |e_a| |b|

The integer products of a tile are one matrix product: sums of up to 1040 products of two int8
numbers stay below 2^24, so single precision holds them exactly; longer vectors go in parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tellmark.llm.common import arrow

#: Components whose int8 products can be summed exactly in single precision.
EXACT = 1040
#: Covers rounding of the bounds themselves.
SLACK = 1e-9


def usable(vector: str) -> Column:
    """True for vectors that are not null, not zero, and of finite components."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def packed(rows: DataFrame, keys: list[str], ids: str, vector: str, weight: str | None = None) -> DataFrame:
    """One row per block (``keys``) with ``n``, ``dim``, ``ids``, ``weights`` and ``vectors`` in
    binary, ordered by id."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n int, dim int, ids binary, weights binary, vectors binary"
    out = arrow(schema)
    columns = [*keys, F.col(ids).alias("_id"), F.col(vector).alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w")]

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("_id").to_numpy(), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        lists = table.column("_v").combine_chunks()
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        n = table.num_rows
        blobs = [x.tobytes() for x in (table.column("_id").to_numpy(), table.column("_w").to_numpy(), values)]
        cells = [table.column(k)[0].as_py() for k in keys] + [n, len(values) // n, *blobs]
        return pa.Table.from_arrays([pa.array([c], t.type) for c, t in zip(cells, out)], schema=out)

    return rows.select(*columns).groupBy(*keys).applyInArrow(run, schema)


class Block:
    """A block of vectors with their quantised form."""

    def __init__(self, n: int, dim: int, ids: bytes, weights: bytes, vectors: bytes, unit: bool = False):
        self.ids, self.weights = np.frombuffer(ids, np.int64), np.frombuffer(weights, np.int64)
        self.exact = np.frombuffer(vectors, np.float64).reshape(n, dim)
        peak = np.abs(self.exact).max(axis=1, keepdims=True)
        scaled = self.exact / peak  # keeps squares of huge and tiny components in range
        self.size = np.sqrt((scaled * scaled).sum(axis=1))
        if unit:
            scaled = scaled / self.size[:, None]
            peak = np.ones_like(peak)
        step = np.abs(scaled).max(axis=1, keepdims=True) / 127
        whole = np.rint(scaled / step)
        rest = scaled - whole * step
        self.whole, self.step = whole.astype(np.float32), (step * peak).ravel()
        self.norm = np.sqrt((scaled * scaled).sum(axis=1)) * peak.ravel() * (1 + SLACK)
        self.rest = np.sqrt((rest * rest).sum(axis=1)) * peak.ravel() * (1 + SLACK) + SLACK * self.norm


def bounds(a: Block, b: Block, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """Quantised products of some rows of ``a`` with all of ``b``, and how far they may be off."""
    product = np.zeros((len(range(*rows.indices(len(a.ids)))), len(b.ids)))
    for k in range(0, a.whole.shape[1], EXACT):
        product += a.whole[rows, k : k + EXACT] @ b.whole[:, k : k + EXACT].T
    product *= a.step[rows, None]
    product *= b.step[None, :]
    near = (a.norm + a.rest)[rows, None] * b.rest[None, :]
    near += a.rest[rows, None] * b.norm[None, :]
    return product, near


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, part: int = 65536) -> np.ndarray:
    """Inner products of pairs of rows in double precision, summed from the first component on."""
    out = np.zeros(len(i))
    for x in range(0, len(i), part):
        left, right = a[i[x : x + part]], b[j[x : x + part]]
        for k in range(a.shape[1]):
            out[x : x + part] += left[:, k] * right[:, k]
    return out
