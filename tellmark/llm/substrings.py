"""Removal of repeated word windows.

Every window of ``WINDOW`` consecutive words of a document gets two rolling (Rabin-Karp) hashes: a
polynomial over word hashes, read off prefix sums. Equal windows of a round of texts are counted
there; the earliest of each kind goes on. Its second hash picks a bucket, the first travels there
with document and start, packed. Windows of a bucket that
agree in the first hash are the same words (64 bits inside one of as many buckets as a million
windows each make: more data, more buckets, and no more chance of a false match per window). All
but the earliest by (document, start) are repeats. They return to their documents, where
overlapping ones merge into maximal removal intervals.

Words are runs of bytes other than blanks (0x20, 0x09-0x0D), unchanged. Null text has none. Texts
shorter than a window lose nothing. Windows of one document repeat each other too. Rows that
repeat a ``doc_id`` and its text count as the same document: a window does not repeat itself, so
equal rows are treated alike. Different texts of one id, or without an id, are documents each, in the
order of a hash of the text. A null id orders before all others. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tellmark.llm.common import BROADCAST_BYTES, WordTable, arrow, boxed, drop_state, join_checked, rewritten, slices, stored, worker_state

WINDOW = 20
#: Windows that one bucket holds on average.
BUCKET_WINDOWS = 1 << 19
#: Bytes of text that are hashed and packed together.
ROUND_BYTES = 2_000_000
#: Odd multipliers of the two polynomials and of the final mixing (fixed values).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xFF51AFD7ED558CCD)

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Rolling:
    """Hashes of all windows of a run of words."""

    def __init__(self, window: int):
        self.window = window
        self.words = WordTable(self._hash)
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def _hash(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        values = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        return values, np.ones(len(words), np.int64)

    def _grow(self, size: int) -> None:
        if self.powers and len(self.powers[0][0]) >= size:
            return
        self.powers = []
        for base in BASES:
            inverse = pow(base, -1, 1 << 64)
            both = []
            for b in (base, inverse):
                steps = np.full(size, b, np.uint64)
                steps[:1] = 1
                both.append(np.multiply.accumulate(steps))
            self.powers.append((both[0], both[1]))

    def __call__(self, words: list[bytes], starts: np.ndarray) -> list[np.ndarray]:
        """Both hashes of the windows that start at ``starts``."""
        at = self.words(words)
        values = self.words.flat[at]
        self._grow(len(values) + 1)
        out = []
        for up, down in self.powers:
            sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values * up[: len(values)], out=sums[1:])
            h = (sums[starts + self.window] - sums[starts]) * down[starts]
            h ^= h >> np.uint64(32)
            h *= MIX
            h ^= h >> np.uint64(29)
            out.append(h)
        return out


def _planes(values: np.ndarray) -> bytes:
    """Bytes of integers by significance, so that the empty high ones vanish when compressed."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def _pack(keys: np.ndarray, subs: np.ndarray, starts: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Documents (id, and hash of the text or 0), windows of each, and starts, of windows that lie
    together by document."""
    new = (keys[1:] != keys[:-1]) | (subs[1:] != subs[:-1])
    first = np.flatnonzero(np.r_[True, new]) if len(keys) else np.zeros(0, np.int64)
    steps = np.diff(starts.astype(np.int64), prepend=0)
    steps[first] = starts[first]
    return (
        _planes(np.diff(keys[first], prepend=np.int64(0))),
        _planes(subs[first]),
        _planes(np.diff(np.r_[first, len(keys)]).astype(np.uint32)),
        _planes(steps.astype(np.int32)),
    )


def _unpack(docs: bytes, subs: bytes, counts: bytes, starts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, n = np.cumsum(_unplanes(docs, np.int64)), _unplanes(counts, np.uint32).astype(np.int64)
    run = np.cumsum(_unplanes(starts, np.int32).astype(np.int64))
    first = np.cumsum(n) - n
    before = run[first] - _unplanes(starts, np.int32)[first]
    return np.repeat(keys, n), np.repeat(_unplanes(subs, np.int64), n), run - np.repeat(before, n)


_PACKED = "docs binary, subs binary, counts binary, starts binary"


def _shared(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Ids that have several texts, as ``_shared`` (stored)."""
    texts = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_shared"))
    texts = texts.agg(F.min(F.xxhash64(F.col(text).cast("binary"))).alias("a"), F.max(F.xxhash64(F.col(text).cast("binary"))).alias("b"))
    return stored(texts.where("a <> b").select("_shared"), "shared-ids")


def _keyed(rows: DataFrame, shared: DataFrame, doc: Column, text: str) -> DataFrame:
    """``rows`` with ``_key``, the id, and ``_sub``, the hash of the text where the id alone does not
    name it, else 0."""
    named = join_checked(rows.withColumn("_shared", doc.cast("long")), shared.withColumn("_several", F.lit(True)), "_shared", "left", 16)
    sub = F.when(F.col("_shared").isNull() | F.col("_several"), F.xxhash64(F.col(text).cast("binary"))).otherwise(F.lit(0).cast("long"))
    lowest = F.lit(-(1 << 63)).cast("long")
    return named.withColumn("_key", F.coalesce("_shared", lowest)).withColumn("_sub", sub).drop("_shared", "_several")


def _repeated(keys: np.ndarray, subs: np.ndarray, starts: np.ndarray, *hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows with these hashes: places of the earliest of each kind, and of all that start
    later than it. A second row of the same document and start is neither."""
    order = np.argsort(hashes[0])
    same = np.logical_and.reduce([h[order[1:]] == h[order[:-1]] for h in hashes])
    group = np.cumsum(np.r_[True, ~same])
    several = np.r_[same, False] | np.r_[False, same] if len(order) else np.zeros(0, bool)
    at, alone, group = order[several], order[~several], group[: len(order)][several]
    at = at[np.lexsort((starts[at], subs[at], keys[at], group))]
    first = np.flatnonzero(np.r_[True, np.diff(group) != 0])[: len(group)]
    least = np.repeat(at[first], np.diff(np.r_[first, len(at)]))
    later = at[(keys[at] != keys[least]) | (subs[at] != subs[least]) | (starts[at] != starts[least])]
    return np.r_[alone, at[first]], later


def _replies(keys: np.ndarray, subs: np.ndarray, starts: np.ndarray, groups: int) -> list[tuple]:
    """Packed windows by the group of their document."""
    part = ((keys ^ subs).astype(np.uint64) * MIX >> np.uint64(33)).astype(np.int64) % groups
    order = np.lexsort((starts, subs, keys, part))
    keys, subs, starts, part = keys[order], subs[order], starts[order], part[order]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
    return [(int(part[x]), *_pack(keys[x:y], subs[x:y], starts[x:y])) for x, y in zip(cuts.tolist(), cuts[1:].tolist())]


def _columns(rows: list[tuple], out: pa.Schema) -> list[pa.Array]:
    return [pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * len(out), out)]


def _requests(rows: DataFrame, window: int, buckets: int, groups: int) -> DataFrame:
    """Packed windows by bucket. Of equal windows of a round only the earliest goes to its bucket, so
    a window that a third of all documents hold is there once a round; the others are known to be
    repeats and are packed by document group, as buckets below 0."""
    schema = f"bucket int, hashes binary, {_PACKED}"
    out = arrow(schema)

    def run(batches):
        rolling = worker_state(("windows", window), lambda: Rolling(window))
        for batch in batches:
            keys, subs = (batch.column(i).to_numpy() for i in (0, 1))
            for a, b, texts in slices(batch.column(2), ROUND_BYTES):
                own = [t.split() if t else [] for t in texts]
                n = np.fromiter(map(len, own), np.int64, b - a)
                windows = np.maximum(n - window + 1, 0)
                doc = np.repeat(np.arange(a, b), windows)
                start = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
                place = start + np.repeat(np.cumsum(n) - n, windows)
                h, spread = rolling([w for words in own for w in words], place)
                key, part_of = keys[doc], subs[doc]
                kept, later = _repeated(key, part_of, start, h, spread)
                found = [(-1 - part, None, *packed) for part, *packed in _replies(key[later], part_of[later], start[later], groups)]
                kept = np.sort(kept)
                bucket = ((spread[kept] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
                for x, y in zip(cuts.tolist(), cuts[1:].tolist()):
                    at = kept[order[x:y]]
                    found.append((int(bucket[order[x]]), h[at].tobytes(), *_pack(key[at], part_of[at], start[at])))
                own = doc = start = place = h = spread = key = part_of = kept = later = bucket = order = None
                yield pa.RecordBatch.from_arrays(_columns(found, out), schema=out)
                found = None
        drop_state()

    return rows.mapInArrow(run, schema)


def _repeats(requests: DataFrame, groups: int) -> DataFrame:
    """Packed windows that also start earlier, by document group."""
    schema = f"part int, {_PACKED}"
    out = arrow(schema)

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            part = pa.array(np.full(table.num_rows, -1 - bucket, np.int32))
            return pa.Table.from_arrays([part, *[table.column(c) for c in ("docs", "subs", "counts", "starts")]], schema=out)
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()])
        packed = [table.column(c).to_pylist() for c in ("docs", "subs", "counts", "starts")]
        keys, subs, starts = map(np.concatenate, zip(*[_unpack(*x) for x in zip(*packed)]))
        _, later = _repeated(keys, subs, starts, h)
        return pa.Table.from_arrays(_columns(_replies(keys[later], subs[later], starts[later], groups), out), schema=out)

    return requests.groupBy("bucket").applyInArrow(run, schema)


def _intervals(repeats: DataFrame, window: int) -> DataFrame:
    """``_key`` and ``_sub`` with ``begins`` and ``ends`` of its maximal intervals of removed words."""
    schema = "_key long, _sub long, begins array<int>, ends array<int>"
    out = arrow(schema)

    def run(table: pa.Table) -> pa.Table:
        packed = [table.column(c).to_pylist() for c in ("docs", "subs", "counts", "starts")]
        keys, subs, starts = map(np.concatenate, zip(*[_unpack(*x) for x in zip(*packed)]))
        order = np.lexsort((starts, subs, keys))
        keys, subs, starts = keys[order], subs[order], starts[order]
        new_doc = np.r_[True, (keys[1:] != keys[:-1]) | (subs[1:] != subs[:-1])]
        first = np.flatnonzero(new_doc | np.r_[True, starts[1:] > starts[:-1] + window])
        last = np.r_[first[1:] - 1, len(keys) - 1]
        docs = np.flatnonzero(new_doc[first])
        bounds = pa.array(np.r_[docs, len(first)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(v.astype(np.int32))) for v in (starts[first], starts[last] + window)]
        return pa.Table.from_arrays([pa.array(keys[first[docs]]), pa.array(subs[first[docs]]), *[x.cast(out.field(2).type) for x in lists]], schema=out)

    return repeats.groupBy("part").applyInArrow(run, schema)


def removal_intervals(docs: DataFrame, shared: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Maximal intervals of words to remove, one row per document that has any (stored)."""
    rows = docs.select(F.col(key).alias("_id"), F.col(text).cast("binary").alias("_text"))
    rows = _keyed(rows, shared, F.col("_id"), "_text").select("_key", "_sub", "_text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(16, size // 6 // BUCKET_WINDOWS)
    groups = max(16, buckets // 4)
    return stored(_intervals(_repeats(_requests(rows, window, buckets, groups), groups), window), "intervals")


def _with_intervals(docs: DataFrame, found: DataFrame, shared: DataFrame, text: str, key: str) -> DataFrame:
    """All rows of ``docs`` with their intervals, which are broadcast where they are few."""
    size = found.agg(F.coalesce(F.sum(F.size("begins") * 8 + 56), F.lit(0)).alias("n")).first()["n"]
    rows = _keyed(boxed(docs, text), shared, F.col("_row").getField(key), "_text")
    return rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, ["_key", "_sub"], "left")


def digests(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_words``, ``n_removed`` and ``kept_sha256`` (of kept words joined by a space)."""
    shared = _shared(docs, text, key)
    found = removal_intervals(docs, shared, window, text, key)
    rows = _with_intervals(docs.select(key, F.col(text).cast("binary").alias(text)), found, shared, text, key)
    rows = rows.select(F.col("_row").getField(key).alias(key), "_text", "begins", "ends")
    schema = f"{key} {dict(docs.dtypes)[key]}, n_words long, n_removed long, kept_sha256 string"
    out = arrow(schema)

    def run(batches):
        for batch in batches:
            n_words, n_removed, digest = [], [], []
            for a, b, texts in slices(batch.column(1)):
                own = [batch.column(i).slice(a, b - a).to_pylist() for i in (2, 3)]
                for t, begins, ends in zip(texts, *own):
                    words = t.split() if t else []
                    n_words.append(len(words))
                    for x, y in zip(reversed(begins or ()), reversed(ends or ())):
                        del words[x:y]
                    n_removed.append(n_words[-1] - len(words))
                    digest.append(sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())],
                schema=out,
            )

    return rows.mapInArrow(run, schema)


def clean(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id", left: str = "words_left") -> DataFrame:
    """``docs`` with repeated words, and the blanks behind them, cut out of ``text``; ``left``
    counts the words that stay. Texts that lose nothing are unchanged."""
    shared = _shared(docs, text, key)
    rows = _with_intervals(docs, removal_intervals(docs, shared, window, text, key), shared, text, key)

    def cut(texts, begins, ends):
        kept, n = [], []
        for t, a, b in zip(texts, begins, ends):
            raw = (t or "").encode()
            if a is None:
                kept.append(t)
                n.append(len(raw.split()))
                continue
            at = [m.start() for m in WORD.finditer(raw)] + [len(raw)]
            edges = [0, *[at[x] for pair in zip(a, b) for x in pair], len(raw)]
            kept.append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2])).decode())
            n.append(len(at) - 1 - sum(b) + sum(a))
        return kept, n

    return rewritten(rows, docs.schema, text, ["begins", "ends"], [T.StructField(left, T.LongType())], cut)
