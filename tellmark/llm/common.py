"""Helpers shared by the operators of this package. ``stored`` writes a result that several jobs read
to the shared folder; ``scratch_path`` names a folder there."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tellmark.session import scratch_path, settle as stored  # noqa: F401

#: A side is broadcast only when its measured rows need at most this many bytes.
BROADCAST_BYTES = 16 * 1024 * 1024
#: Bytes of text that one round of work inside a task takes at most (whole texts; a longer one is a
#: round of its own).
SLICE_BYTES = 2_000_000

def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """True for the rows kept away from learning: crc32 of the id as text, modulo ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def file_store(path: str):
    """File system and path of a folder of the cluster, for tasks."""
    if "://" not in path:
        path = re.sub("^file:", "", path)
    return pyarrow.fs.FileSystem.from_uri(path)


def join_checked(left: DataFrame, right: DataFrame, on: str | list[str], how: str, row_bytes: int) -> DataFrame:
    """Join on a unique key of ``right``. Its rows are counted: within ``BROADCAST_BYTES`` they
    are broadcast and ``left`` does not move, beyond it both sides shuffle."""
    if right.count() * row_bytes <= BROADCAST_BYTES:
        right = F.broadcast(right)
    return left.join(right, on, how)


def boxed(df: DataFrame, text: str) -> DataFrame:
    """``df`` as two columns, ``_text`` and ``_row`` with all others, so that columns which an
    operator adds clash with none."""
    return df.select(F.col(text).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text]).alias("_row"))


def unboxed(df: DataFrame, columns: list[str], text: str, new_text: Column) -> DataFrame:
    """The columns of before, in their order, with a text."""
    return df.select(*[new_text.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in columns])


def rewritten(rows: DataFrame, before: T.StructType, text: str, inputs: list[str], more: list[T.StructField], rewrite: Callable) -> DataFrame:
    """The columns of ``before`` from boxed ``rows``, with texts and further columns that ``rewrite``
    makes. It gets a round of texts and of each input, and returns the texts and a list for each
    further column; all other columns pass through as Arrow data."""
    names = [f.name for f in before.fields if f.name != text]
    source = rows.select(*[F.col("_row").getField(n).alias(f"_{i}") for i, n in enumerate(names)], "_text", *inputs)
    schema = T.StructType([*before.fields, *more])
    out = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            made: list[list[pa.Array]] = [[] for _ in range(1 + len(more))]
            kinds = [pa.string(), *[out.field(len(before.fields) + i).type for i in range(len(more))]]
            for a, b, texts in slices(batch.column("_text")):
                found = rewrite(texts, *[batch.column(c).slice(a, b - a).to_pylist() for c in inputs])
                for parts, values, kind in zip(made, found, kinds):
                    parts.append(pa.array(values, kind))
            if batch.num_rows:
                new, *further = [pa.concat_arrays(parts) for parts in made]
                old = iter(range(len(names)))
                kept = [new if f.name == text else batch.column(next(old)) for f in before.fields]
                made = parts = None
                yield pa.RecordBatch.from_arrays([*kept, *further], schema=out)
        drop_state()

    return source.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Give memory that is free but still held by a worker back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # C libraries other than GNU's have none
    if trim:
        trim(0)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list]]:
    """A column of texts in consecutive runs of about ``limit`` bytes: bounds and values. Only one
    run at a time exists as Python objects."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(column):
        done = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield begin, end, column.slice(begin, end - begin).to_pylist()
        begin = end
    release()


def take_ragged(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs ``flat[s:s+n]``, one after another."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lens), lens)]


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds (first axis); 0 where a part is empty."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), values.dtype)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class WordTable:
    """What ``encode`` makes of a word, kept for the words met so far.

    ``encode`` takes a list of distinct words and returns a flat array with the length of each
    word's part. At ``limit`` words the table starts anew, so its memory is bounded.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int = 250_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.index: dict = {}
        self.starts = self.lens = np.zeros(0, np.int64)
        self.flat: np.ndarray | None = None
        self.used = 0

    def __call__(self, words: list) -> np.ndarray:
        """The place of each word in ``starts`` and ``lens``."""
        new = list(set(words).difference(self.index))
        if self.index and len(self.index) + len(new) > self.limit:
            self._clear()
            new = list(set(words))
        if new or self.flat is None:
            flat, lens = self.encode(new)
            lens = np.asarray(lens, np.int64)
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(lens) - lens])
            self.lens = np.concatenate([self.lens, lens])
            if self.flat is None:
                self.flat = flat[:0].copy()
            if self.used + len(flat) > len(self.flat):
                grown = np.empty(2 * (self.used + len(flat)), flat.dtype)
                grown[: self.used] = self.flat[: self.used]
                self.flat = grown
            self.flat[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


_state: dict = {}


def worker_state(key, make: Callable):
    """What tasks of one kind keep in a worker, such as the words met so far. Only the kind used last
    is kept, so the operators of several stages do not add up in a worker that Spark reuses."""
    if key not in _state:
        _state.clear()
        release()
        _state[key] = make()
    return _state[key]


def drop_state() -> None:
    """Forget it at the end of a task, so that an idle worker holds none of it."""
    _state.clear()
    release()


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The groups of a partition sorted by ``key``, each as one table, across batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        begin = 0
        for end in [*cuts.tolist(), batch.num_rows]:
            if held and keys[begin] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last, begin = keys[begin], end
    if held:
        yield pa.Table.from_batches(held)


def arrow(schema: str) -> pa.Schema:
    """The Arrow schema of a Spark schema string, for the batches a task returns."""
    return to_arrow_schema(T.StructType.fromDDL(schema))
