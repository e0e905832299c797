"""Packing token sequences by dominance reduction and best fit.

A document is its ids followed by the end id. One that is longer than a sequence is cut into full
sequences, with the remainder in front. All other pieces are items of a bin packing problem whose
sizes are 1 to ``capacity``, so the whole instance is a histogram of at most ``capacity`` rows,
whatever the number of documents. On it

* **dominance** fixes sets for good: the item of a size alone, with one partner, or with two, where
  every other feasible set around that item could be exchanged against the chosen one without
  needing more sequences (`reduce_instance`);
* **best fit**, largest first, packs what is left, many equal items and many equal sequences at a
  time (`best_fit`).

The result is a list of rules "items number a to b of this size go to the sequences from s on, q in
each, at offset o", and Spark numbers the pieces of each size (in hash buckets, so a size that
holds a third of all rows is no single task) and applies the rules. Rules depend on the sizes
that occur, not on the number of documents.

Null text counts as empty: one piece holding the end id. Equal rows get a place each. Ties are
broken by document, piece and content. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tellmark.llm.common import WordTable, arrow, slices, stored, take_ragged, worker_state

CAPACITY = 2048
END_ID = 0
#: Pieces that one rank bucket holds on average.
BUCKET_ROWS = 4096

PIECE_SCHEMA = "{key} {kind}, piece int, start long, length long, ids_crc32 long"


class KeptWords(WordTable):
    """A word table that keeps, when it is full, the words that several rounds met."""

    hits = np.zeros(0, np.int64)

    def distinct(self, words: list) -> np.ndarray:
        """The places of distinct words."""
        if self.index and len(self.index) + len(set(words).difference(self.index)) > self.limit:
            self._shrink()
        at = self(words)
        self.hits = np.r_[self.hits, np.zeros(len(self.lens) - len(self.hits), np.int64)]
        self.hits[at] += 1
        return at

    def _clear(self) -> None:
        super()._clear()
        self.hits = np.zeros(0, np.int64)

    def _shrink(self) -> None:
        keep = np.flatnonzero(self.hits > 1)
        if len(keep) > self.limit // 2:
            keep = np.sort(np.argsort(-self.hits, kind="stable")[: self.limit // 2])
        words = np.array(list(self.index), object)[keep].tolist()
        flat, lens, hits = take_ragged(self.flat, self.starts[keep], self.lens[keep]), self.lens[keep], self.hits[keep] // 2
        self._clear()
        self.index = dict(zip(words, range(len(words))))
        self.flat, self.used, self.lens, self.starts, self.hits = flat, len(flat), lens, np.cumsum(lens) - lens, hits


class Tokens:
    """Ids of texts; each word of a worker's texts is tokenised once.

    A text is cut at single spaces, and lines at line ends, between two visible characters. The
    split pattern of the vocabulary always cuts there, and no added token holds white space, so
    the ids of the parts joined are the ids of the text.

    Words of Latin letters and signs go in long rows through the byte-pair merges of the same
    file, where the order of merges is the order of ids (checked); all others go through the
    tokenizer itself.
    """

    #: A word that both ways split alike, with the space in front of it or without.
    PLAIN = r"[!-~\x{a1}-\x{24f}]+"
    #: Texts whose white space is more than single spaces and line ends between visible characters.
    UNEVEN = r"[\x00\x09\x0B-\x0D\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    ROW = 2048

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(content.decode())
        added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        plain = type(self.lib.pre_tokenizer).__name__ == "ByteLevel" and self.lib.normalizer is None
        self.whole = not plain or any(re.search(r"\s", t) for t in added)
        self.cut = re.compile(r" (?<=\S )(?=\S)")
        self.added = [t for t in added]
        self.rows = None if self.whole else self._ranks(json.loads(content), added)
        self.words = KeptWords(self._encode)

    def _ranks(self, spec: dict, added: list[str]):
        """The merges as an encoder of long rows, or None where ids do not follow the merges."""
        import tiktoken

        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(c): c for c in letters}  # bytes as the vocabulary spells them
        shown |= {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in letters)}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in added}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        if sorted(vocab.values()) != list(range(len(vocab))) or [vocab.get(a + b) for a, b in merges] != list(range(256, len(vocab))):
            return None
        ranks = {bytes(shown[c] for c in t): i for t, i in vocab.items()}
        self.opens = np.zeros(len(vocab), bool)
        self.opens[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.line = ranks[b"\n"]
        return tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        column = pa.array(words, pa.string())
        like = lambda pattern: pc.match_substring_regex(column, pattern).to_numpy(zero_copy_only=False).astype(bool)
        own = np.full(len(words), self.rows is None)
        for token in self.added:
            own |= pc.match_substring(column, token).to_numpy(zero_copy_only=False).astype(bool)
        with_space, without = like(rf"\A {self.PLAIN}\z") & ~own, like(rf"\A{self.PLAIN}\z") & ~own
        spaced, bare, rest = (np.flatnonzero(x).tolist() for x in (with_space, without, ~(with_space | without)))
        flat, lens = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]

        def add(ids: np.ndarray, firsts: np.ndarray, skip: int, many: int) -> None:
            if len(firsts) != many:
                raise ValueError("the tokens of a row of words do not show where words begin")
            lens.append(np.diff(np.r_[firsts, len(ids)]) - skip)
            flat.append(np.delete(ids, firsts) if skip else ids)

        for begin in range(0, len(spaced), self.ROW):
            row = [words[i] for i in spaced[begin : begin + self.ROW]]
            ids = np.array(self.rows.encode_ordinary("".join(row)), np.uint32)
            add(ids, np.flatnonzero(self.opens[ids]), 0, len(row))
        for begin in range(0, len(bare), self.ROW):
            row = [words[i] for i in bare[begin : begin + self.ROW]]
            ids = np.array(self.rows.encode_ordinary("\n" + "\n".join(row)), np.uint32)
            add(ids, np.flatnonzero(ids == self.line), 1, len(row))
        run = getattr(self.lib, "encode_batch_fast", self.lib.encode_batch)
        for e in run([words[i] for i in rest], add_special_tokens=False) if rest else []:
            flat.append(np.array(e.ids, np.uint32))
            lens.append(np.array([len(e.ids)], np.int64))
        place = np.argsort(np.array(spaced + bare + rest, np.int64))
        sizes = np.concatenate(lens)
        starts = np.cumsum(sizes) - sizes
        return take_ragged(np.concatenate(flat), starts[place], sizes[place]), sizes[place]

    def _split(self, text: str) -> list[str]:
        if self.whole:
            return [text]
        lines = text.split("\n")
        if len(lines) > 1 and any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
            lines = [text]
        words: list[str] = []
        for line in lines:
            if words:
                words.append("\n")
            first, *others = self.cut.split(line)
            words.append(first)
            words += [" " + w for w in others]
        return words

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and the bounds of each text in them."""
        column = pa.array(texts, pa.large_string()).fill_null("")
        uneven = pc.match_substring_regex(column, self.UNEVEN).to_numpy(zero_copy_only=False).astype(bool)
        uneven |= self.whole
        # the words of even texts are cut outside Python
        even = column.filter(pa.array(~uneven))
        for old, new in ((" ", "\0 "), ("\n", "\0\n\0")):
            even = pc.replace_substring(even, old, new)
        lists = pc.split_pattern(even, "\0")
        # an empty text is one empty word, which has no ids
        split = [self._split(texts[i]) for i in np.flatnonzero(uneven).tolist()]
        counts = np.zeros(len(texts), np.int64)
        counts[~uneven] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        counts[uneven] = [len(x) for x in split]
        words = pa.concat_arrays([lists.flatten(), pa.array([w for x in split for w in x], pa.large_string())])
        coded = words.dictionary_encode()
        at = self.words.distinct(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        # back from even and uneven texts to the order of the texts
        order = np.r_[np.flatnonzero(~uneven), np.flatnonzero(uneven)]
        first = np.empty(len(texts), np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        at = take_ragged(at, first, counts)
        lens = self.words.lens[at]
        ids = take_ragged(self.words.flat, self.words.starts[at], lens)
        ends = np.r_[0, np.cumsum(lens)]
        return ids, ends[np.r_[0, np.cumsum(counts)]]


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``."""
    with open(tokenizer, "rb") as f:
        content = f.read()
    digest, content = sha256(content).hexdigest(), docs.sparkSession.sparkContext.broadcast(content)
    source = docs.select(key, text)
    schema = PIECE_SCHEMA.format(key=key, kind=dict(source.dtypes)[key])
    out = arrow(schema)

    def run(batches):
        tokens = worker_state(("tokens", digest), lambda: Tokens(content.value))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                ids, bounds = tokens.encode(texts)
                raw, bounds = memoryview(ids.astype("<u4").tobytes()), bounds.tolist()
                row, piece, start, length, crc = [], [], [], [], []
                for i in range(b - a):
                    n = bounds[i + 1] - bounds[i] + 1
                    first = n % capacity or capacity
                    own = bytes(raw[4 * bounds[i] : 4 * bounds[i + 1]]) + end
                    cuts = [0, *range(first, n + 1, capacity)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        row.append(a + i)
                        piece.append(k)
                        start.append(x)
                        length.append(y - x)
                        crc.append(zlib.crc32(own[4 * x : 4 * y]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())),
                        pa.array(piece, pa.int32()),
                        *[pa.array(x, pa.int64()) for x in (start, length, crc)],
                    ],
                    schema=out,
                )

    return source.mapInArrow(run, schema)


def reduce_instance(counts: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Sets that dominate all alternatives, as ``(sizes, times)``, and the counts left over.

    For the item j of the largest size not yet looked at, with room r beside it:

    * no item fits: j alone;
    * the largest k that fits fills r, or no two items fit together, or at most two fit and
      their best sum is no larger than k: {j, k}, since all that could stand beside j fits
      into the place of k;
    * at most two fit, k with the largest m beside it leaves every other pair (a >= b) with
      a <= k and b <= m: {j, k, m}.

    Where none of them holds, j waits for the best fit.
    """
    counts, fixed = counts.copy(), []

    def largest(upto: int, taken: tuple[int, ...]) -> int:
        for size in np.flatnonzero(counts[: max(0, upto) + 1])[::-1].tolist():
            if counts[size] > taken.count(size):
                return size
        return 0

    def smallest(taken: tuple[int, ...], how_many: int) -> list[int]:
        found = []
        for size in np.flatnonzero(counts[: capacity + 1]).tolist():
            found += [size] * min(how_many - len(found), int(counts[size]) - taken.count(size))
            if len(found) >= how_many:
                break
        return found

    def best_pair(room: int, taken: tuple[int, ...]) -> tuple[int, int]:
        """The largest sum of two items within ``room``, and the largest smaller item of a pair."""
        sizes = np.flatnonzero(counts[: room + 1])
        free = counts[sizes] - np.array([taken.count(s) for s in sizes.tolist()])
        sizes, free = sizes[free > 0], free[free > 0]
        best = second = 0
        for i, a in enumerate(sizes.tolist()):
            j = int(np.searchsorted(sizes, min(room - a, a), side="right")) - 1
            if j >= 0 and sizes[j] == a and free[i] < 2:
                j -= 1
            if j >= 0:
                best, second = max(best, a + int(sizes[j])), max(second, int(sizes[j]))
        return best, second

    def fix(*sizes: int) -> None:
        need = {s: sizes.count(s) for s in sizes}
        times = min(int(counts[s]) // n for s, n in need.items())
        for s, n in need.items():
            counts[s] -= n * times
        fixed.append((sizes, times))

    for j in range(capacity, 0, -1):
        while counts[j]:
            room = capacity - j
            k = largest(room, (j,))
            if not k:
                # items of size j that stand alone: all, or the last one of its kind
                fix(j)
                continue
            low = smallest((j,), 3)
            two, three = len(low) > 1 and sum(low[:2]) <= room, len(low) > 2 and sum(low) <= room
            if k == room or not two:
                fix(j, k)
                continue
            if three:
                break
            best, second = best_pair(room, (j,))
            m = largest(room - k, (j, k))
            if best <= k:
                fix(j, k)
            elif m and second <= m:
                fix(j, k, m)
            else:
                break
    return fixed, counts


def best_fit(counts: np.ndarray, capacity: int, first: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rules ``(size, items, sequence, in each, offset)`` of best fit, largest first, in the order
    of use, and the next free sequence number. Sequences alike are handled as one range."""
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges of sequences
    rules, free = [], first
    open_rooms = np.zeros(capacity + 1, bool)

    def put(left: int, sequence: int, n: int) -> None:
        if left and n:
            room.setdefault(left, []).append((sequence, n))
            open_rooms[left] = True

    for size in range(capacity, 0, -1):
        n = int(counts[size])
        while n:
            fits = np.flatnonzero(open_rooms[size:])
            if len(fits):
                left = size + int(fits[0])
                sequence, many = room[left].pop()
                open_rooms[left] = bool(room[left])
            else:
                left, sequence, many = capacity, free, -(-n // (capacity // size))
                free += many
            each = left // size
            full = min(many, n // each)
            if full:
                rules.append((size, full * each, sequence, each, capacity - left))
                put(left - each * size, sequence, full)
                n -= full * each
            if n and full < many:
                rules.append((size, n, sequence + full, n, capacity - left))
                put(left - n * size, sequence + full, 1)
                n, full = 0, full + 1
            put(left, sequence + full, many - full)
    return rules, free


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rules ``size, first rank, sequence, in each, offset``, sorted by size and first rank."""
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    fixed, rest = reduce_instance(counts, capacity)
    rules, free = [], 0
    for sizes, times in fixed:
        offset = 0
        for size in sizes:
            rules.append((size, times, free, 1, offset))
            offset += size
        free += times
    more, free = best_fit(rest, capacity, free)
    rules += more
    used: dict[int, int] = {}
    rows = []
    for size, items, sequence, each, offset in rules:
        rows.append((size, used.get(size, 0), sequence, each, offset))
        used[size] = used.get(size, 0) + items
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5)


def _ranked(pieces: DataFrame, total: int, key: str) -> DataFrame:
    """Add ``rank``, the number of a piece among those of its length, from 0."""
    buckets = max(1, -(-total // BUCKET_ROWS))
    order = ["piece", key, "start", "ids_crc32"]
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        "length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order))
    return (
        rows.withColumn("_inside", inside).join(offsets, ["length", "_bucket"])
        .withColumn("rank", F.col("_inside") - 1 + F.col("_offset")).drop("_bucket", "_inside", "_offset")
    )


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces of lengths up to ``capacity``."""
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rules = plan(sizes, capacity)
    ranked = _ranked(pieces, sum(sizes.values()), key)
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    names = pieces.columns
    shared = pieces.sparkSession.sparkContext.broadcast(rules)
    out = arrow(schema)

    def run(batches):
        rules = shared.value
        starts = rules[:, 0] * 2**48 + rules[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(starts, length * 2**48 + rank, side="right") - 1
            size, begin, sequence, each, offset = rules[at].T
            nth = rank - begin
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(sequence + nth // each), pa.array(offset + nth % each * size)],
                schema=out,
            )

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of all documents with their sequence and place. The pieces (some 40 bytes for each
    document) are stored first, so texts are tokenised once."""
    return pack_pieces(stored(tokenize(docs, tokenizer, capacity, end_id, text, key), "pieces"), capacity, key)
