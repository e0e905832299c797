"""Language-model scores from an n-gram trie in Elias-Fano levels.

Tokens are the words of a text with A to Z lowered, and one end. The model learns from the texts
that ``learns`` names and knows every word, word pair and triple of them; nothing is cut off. The
probability of a token after two others is interpolated with absolute discounts:
max(c(abw) - D, 0) / c(ab) + D T(ab) / c(ab) * p(w | b), the same for p(w | b), and (c(w) + 1) / (N + V + 1) below, with
c the counts, T the number of different followers.

* `units` cuts the texts into units of about ``UNIT_BYTES``, written once as files of small arrays in the shared folder
  (`file_store`); afterwards only words and n-grams move, each once a unit with its count, so that a
  frequent one is a row per unit and not per occurrence.
* `vocabulary` counts words by hash in shards and gives each a number, small for frequent words.
* `exchange` sends every unit's distinct triples to the shards of their first two words (a word with
  more than a shard's share of the tokens is split by the second word). A shard adds the counts up,
  writes its levels (`Levels`), maps them into memory and looks all triples up: first word, then the second among
  the followers of the first, then the third among the followers of both. Word numbers of a level rise within a
  context; each context's are shifted by the last value of the one before, so a level is one
  monotone sequence, as are the pointers to the next level. Discounted frequencies and the weights of the lower order are codes of 8 bits on
  a logarithmic scale of 1/32 decade.
* `scores` puts the answers together in each unit.

The levels of the model stay in the shared folder while the driver lives, as the files of `model` name them.
Null and empty texts have one token, the end. Rows that repeat are texts each; null ids stay null. A
text larger than a unit is a unit of its own. An empty table gives an empty result. Words are told apart
by 64 bits of hash.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tellmark.llm.common import arrow, file_store, scratch_path, slices, stored, whole_groups

UNIT_BYTES = 4_000_000
#: Words, and triples, that a shard takes about.
SHARD_WORDS = 1_000_000
SHARD_TRIPLES = 1_000_000
DISCOUNT = 0.75
#: Codes per decade; NOTHING stands for a frequency of 0, and for a weight of 1.
SCALE, NOTHING = 32, 255
#: Word numbers before and behind a text; 0 is a word that was not learned, words begin at FIRST.
UNKNOWN, START, BEFORE, BEHIND, FIRST = 0, 1, 2, 3, 4
NO_ID = -(1 << 63)
END = b"\n"

_LOWER = bytes(range(256)).lower()


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def pack(values: np.ndarray) -> bytes:
    """Non-negative numbers, their bytes apart by weight, compressed."""
    values = np.ascontiguousarray(values, np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    values = np.zeros((planes.shape[1], 8), np.uint8)
    values[:, :width] = planes.T
    return values.reshape(-1).view(np.int64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data).view(np.uint64), dtype=np.uint64)


def code(values: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.clip(np.rint(-np.log10(values) * SCALE), 0, NOTHING - 1).astype(np.uint8)


_FREQUENCY = np.r_[10.0 ** (-np.arange(NOTHING) / SCALE), 0.0]
_WEIGHT = np.r_[10.0 ** (-np.arange(NOTHING) / SCALE), 1.0]


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, low_bits, low, high
        self.select = np.flatnonzero(np.unpackbits(high, bitorder="little")[: 8 * len(high)]).astype(np.int64)
        # every byte of the low part as the start of a 64-bit word
        self.words = np.ndarray((max(len(low) - 7, 0),), "<u8", low, strides=(1,)) if len(low) else low

    @staticmethod
    def arrays(values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of low bits, low part and high part of the values."""
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(8, np.uint8)
        if bits and n:
            parts = []
            for begin in range(0, n, 1 << 18):  # eight times any number of values fill whole bytes
                own = np.ascontiguousarray(values[begin : begin + (1 << 18)], np.uint64).view(np.uint8).reshape(-1, 8)
                parts.append(np.packbits(np.unpackbits(own, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little"))
            low = np.concatenate([*parts, low])
        places = (values.astype(np.int64) >> bits) + np.arange(n)
        flags = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        flags[places] = 1
        return bits, low, np.packbits(flags, bitorder="little")

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        high = (self.select[at] - at) << self.bits
        if not self.bits:
            return high
        bit = at * self.bits
        low = (self.words[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)
        return high | low.astype(np.int64)

    def successor(self, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """In each range, the first place whose value is not below the wanted one (its end, if all are)."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = self[middle] < wanted[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        return low


class Levels:
    """The trie of a shard as flat arrays, in a file that is mapped into memory where the folder is a local one."""

    def __init__(self, data: np.ndarray):
        head = int(data[:8].view("<u8")[0])
        self.about = json.loads(data[8 : 8 + head].tobytes())
        part = lambda name: data[8 + head + self.about[name][0] :][: self.about[name][1]]
        self.size = self.about["size"]
        self.ids = [EliasFano(self.size[k], self.about["bits"][k], part(f"low{k}"), part(f"high{k}")) for k in range(3)]
        self.pointers = [EliasFano(self.size[k] + 1, self.about["pointer_bits"][k], part(f"pointer_low{k}"), part(f"pointer_high{k}")) for k in range(2)]
        self.weights = [part("weight0"), part("weight1")]
        self.frequencies = [None, part("frequency1"), part("frequency2")]

    @staticmethod
    def write(fs, path: str, first: np.ndarray, second: np.ndarray, third: np.ndarray, count: np.ndarray, context: np.ndarray, discount: float) -> tuple:
        """Write sorted distinct triples with their counts; ``context`` is the count of each first
        word. Returns the first words and how many followers each has here."""
        ids1, at1 = np.unique(first, return_index=True)
        cut2 = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]) if len(first) else np.zeros(0, np.int64)
        pointer2 = np.r_[cut2, len(first)]
        pointer1 = np.searchsorted(cut2, np.r_[at1, len(first)])
        total2 = np.add.reduceat(count, cut2) if len(cut2) else count[:0]
        followers1, followers2 = np.diff(pointer1), np.diff(pointer2)
        context1 = context[at1]
        arrays = {
            "weight0": code(discount * followers1 / context1), "weight1": code(discount * followers2 / total2),
            "frequency1": code((total2 - discount) / np.repeat(context1, followers1)), "frequency2": code((count - discount) / np.repeat(total2, followers2)),
        }
        about = {"size": [len(ids1), len(cut2), len(first)], "bits": [], "pointer_bits": []}
        for k, (own, pointer) in enumerate([(ids1, np.array([0, len(ids1)])), (second[cut2], pointer1), (third, pointer2)]):
            last = own[pointer[1:] - 1] if len(own) else own
            values = own + np.repeat(np.cumsum(last) - last, np.diff(pointer)) if len(own) else own
            bits, arrays[f"low{k}"], arrays[f"high{k}"] = EliasFano.arrays(values)
            about["bits"].append(bits)
        for k, pointer in enumerate((pointer1, pointer2)):
            bits, arrays[f"pointer_low{k}"], arrays[f"pointer_high{k}"] = EliasFano.arrays(pointer)
            about["pointer_bits"].append(bits)
        place = 0
        for name, own in arrays.items():
            about[name] = [place, len(own)]
            place += len(own)
        head = json.dumps(about).encode()
        head += b" " * (-len(head) % 8)
        with fs.open_output_stream(path, compression=None) as f:
            f.write(np.array([len(head)], "<u8").tobytes() + head)
            for own in arrays.values():
                f.write(own.tobytes())
        return ids1, followers1

    @classmethod
    def open(cls, fs, path: str) -> Levels:
        if fs.type_name == "local":
            return cls(np.memmap(path, np.uint8, "r"))
        with fs.open_input_file(path) as f:
            return cls(np.frombuffer(f.read(), np.uint8))

    def _child(self, level: int, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Place of the wanted word among the followers of a context; -1 without."""
        ids = self.ids[level]
        some = np.flatnonzero((low < high) & (wanted > 0))
        found = np.full(len(wanted), -1, np.int64)
        if len(some):
            low, high = low[some], high[some]
            target = wanted[some] + np.where(low > 0, ids[np.maximum(low - 1, 0)], 0)
            at = ids.successor(low, high, target)
            there = at < high
            there[there] = ids[at[there]] == target[there]
            found[some[there]] = at[there]
        return found

    def _followers(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = at >= 0
        low, high = np.zeros((2, len(at)), np.int64)
        low[known], high[known] = self.pointers[level][at[known]], self.pointers[level][at[known] + 1]
        return low, high

    def look_up(self, first: np.ndarray, pair_of: np.ndarray, second: np.ndarray, triple_of: np.ndarray, third: np.ndarray) -> tuple:
        """Codes of words (weight), of pairs whose first word is at ``pair_of`` (frequency, weight), and
        of triples whose pair is at ``triple_of`` (frequency)."""
        coded = lambda codes, at: np.where(at >= 0, codes[np.maximum(at, 0)] if len(codes) else NOTHING, NOTHING).astype(np.uint8)
        one = self._child(0, np.zeros(len(first), np.int64), np.full(len(first), self.size[0]), first)
        low, high = self._followers(0, one)
        two = self._child(1, low[pair_of], high[pair_of], second)
        low, high = self._followers(1, two)
        three = self._child(2, low[triple_of], high[triple_of], third)
        return coded(self.weights[0], one), coded(self.frequencies[1], two), coded(self.weights[1], two), coded(self.frequencies[2], three)


def units(docs: DataFrame, learns: Column, folder: str, text: str, key: str, unit_bytes: int) -> DataFrame:
    """Units as files under ``folder``; returns (stored) ``unit`` (file, place and length), ``tokens``, ``learned`` ones of them, and
    distinct ``words``."""
    schema = "unit string, tokens long, learned long, words long"
    out = arrow(schema)

    def run(batches):
        fs, path = file_store(folder)
        sink, name, place = None, f"units-{uuid.uuid4().hex}", 0
        for batch in batches:
            keys = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, texts in slices(batch.column(1), unit_bytes):
                words, n = [], np.zeros(b - a, np.int64)
                for i, own in enumerate(texts):
                    own = tokens(own)
                    own.append(END)
                    n[i] = len(own)
                    words += own
                coded = pa.array(words, pa.binary()).dictionary_encode()
                del words
                known = coded.dictionary.to_pylist()
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
                order = np.argsort(hashes)
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                word = rank[coded.indices.to_numpy(zero_copy_only=False)]
                counts = np.bincount(word[np.repeat(train[a:b], n)], minlength=len(order))
                data = [pack_sorted(hashes[order]), pack(counts), keys[a:b].tobytes(), train[a:b].tobytes(), pack(n), pack(word)]
                data = np.array([len(x) for x in data], "<u8").tobytes() + b"".join(data)
                if sink is None:
                    fs.create_dir(path, recursive=True)
                    sink = fs.open_output_stream(f"{path}/{name}", compression=None)
                sink.write(data)
                cells = [f"{name}:{place}:{len(data)}", len(word), int(counts.sum()), len(order)]
                place += len(data)
                yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(cells, out)], schema=out)
        if sink is not None:
            sink.close()

    rows = docs.select(F.col(key).cast("long"), F.col(text), F.coalesce(learns, F.lit(False)).alias("learns"))
    return stored(rows.mapInArrow(run, schema), "units")


def _read_unit(fs, path: str, unit: str, words_only: bool = False) -> list[np.ndarray]:
    """Sorted hashes of the words of a unit and their counts; unless only these are wanted, also ids, whether
    learned and tokens of each text, and the tokens as places among the hashes."""
    name, offset, length = unit.split(":")
    with fs.open_input_file(f"{path}/{name}") as f:
        lens = np.frombuffer(f.read_at(48, int(offset)), "<u8").astype(np.int64)
        parts = [pa.py_buffer(f.read_at(int(n), int(offset) + 48 + int(at))) for at, n in zip(np.cumsum(lens) - lens, lens[: 2 if words_only else 6])]
    found = [unpack_sorted(parts[0].to_pybytes()), unpack(parts[1].to_pybytes())]
    if words_only:
        return found
    return [*found, np.frombuffer(parts[2], np.int64), np.frombuffer(parts[3], bool), unpack(parts[4].to_pybytes()), unpack(parts[5].to_pybytes())]


def _word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of hashes."""
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def vocabulary(found: DataFrame, folder: str, shards: int) -> DataFrame:
    """Per unit and word shard (stored): ``ids`` and ``counts`` of its words in the order of their hashes; rows without
    a unit tell the ``learned`` words of a shard."""
    asked = "shard int, unit string, hashes binary, counts binary"
    told = "unit string, shard int, a binary, b binary, c binary, d binary, learned long"
    ask, tell = arrow(asked), arrow(told)

    def split(batches):
        fs, path = file_store(folder)
        for batch in batches:
            for unit in batch.column(0).to_pylist():
                hashes, counts = _read_unit(fs, path, unit, words_only=True)
                some, own = zip(*_grouped(_word_shard(hashes, shards)))
                cells = [some, [unit] * len(own), [pack_sorted(hashes[x]) for x in own], [pack(counts[x]) for x in own]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cells, ask)], schema=ask)

    def number(batches):
        for group in whole_groups(batches, "shard"):
            shard = group.column("shard")[0].as_py()
            own = [unpack_sorted(x) for x in group.column("hashes").to_pylist()]
            hashes, at = np.unique(np.concatenate(own), return_inverse=True)
            total = np.bincount(at, np.concatenate([unpack(x) for x in group.column("counts").to_pylist()]), len(hashes)).astype(np.int64)
            rank = np.empty(len(hashes), np.int64)
            rank[np.lexsort((hashes, -total))] = np.arange(len(hashes))
            ids = np.where(total > 0, FIRST + rank * shards + shard, UNKNOWN)
            begin = 0
            for unit, mine in zip(group.column("unit").to_pylist(), own):
                use = at[begin : begin + len(mine)]
                begin += len(mine)
                cells = [unit, shard, pack(ids[use]), pack(total[use]), None, None, 0]
                yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(cells, tell)], schema=tell)
            cells = [None, shard, None, None, None, None, int((total > 0).sum())]
            yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(cells, tell)], schema=tell)

    rows = found.select("unit").mapInArrow(split, asked).repartition(shards, "shard").sortWithinPartitions("shard")
    return stored(rows.mapInArrow(number, told), "vocabulary")


class Windows(NamedTuple):
    """The triples of a unit: distinct words, pairs and triples, in the order of word numbers."""

    n: np.ndarray  # tokens per text
    ids: np.ndarray  # distinct words
    counts: np.ndarray  # their counts as contexts
    first: np.ndarray  # of each distinct pair, places among the words
    second: np.ndarray
    pair: np.ndarray  # of each distinct triple, its pair
    third: np.ndarray
    pair_at: np.ndarray  # of each window, its pair
    triple_at: np.ndarray  # of each window, its triple
    window: np.ndarray  # of each token, the window that it ends
    learned: np.ndarray  # of each window


def _windows(n: np.ndarray, train: np.ndarray, word: np.ndarray, ids: np.ndarray, counts: np.ndarray, texts: int) -> Windows:
    known, place = np.unique(np.r_[ids, UNKNOWN, START, BEFORE, BEHIND], return_inverse=True)
    total = np.zeros(len(known), np.int64)
    total[place[: len(ids)]] = counts
    total[place[-4:]] = 0, texts, texts, texts
    start, before, behind = place[-3:]
    # START BEFORE words END BEHIND of every text
    begin = np.cumsum(n + 3) - (n + 3)
    row = np.empty(int((n + 3).sum()), np.int64)
    row[begin], row[begin + 1], row[begin + n + 2] = start, before, behind
    token = np.arange(len(word)) + np.repeat(begin + 2 - (np.cumsum(n) - n), n)
    row[token] = place[word]
    window = np.arange(len(row))
    keep = np.ones(len(row), bool)
    keep[begin + n + 1] = keep[begin + n + 2] = False
    at = window[keep]
    size = len(known)
    pairs, pair_at = np.unique(row[at] * size + row[at + 1], return_inverse=True)
    triples, triple_at = np.unique(pair_at * size + row[at + 2], return_inverse=True)
    behind_at = np.cumsum(keep) - 1
    return Windows(
        n, known, total, pairs // size, pairs % size, triples // size, triples % size, pair_at, triple_at,
        behind_at[token - 2], np.repeat(train, n + 1),
    )


def _mixed(values: np.ndarray) -> np.ndarray:
    return ((values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def _pair_shards(w: Windows, shards: int, learned: int) -> np.ndarray:
    """The shard of each distinct pair; -1 where a word of it was not learned."""
    first, second = w.ids[w.first], w.ids[w.second]
    parts = _parts(w.counts, shards, learned)[w.first]
    shard = (_mixed(first) + np.where(parts > 1, _mixed(second) % parts, 0)) % shards
    return np.where((first > 0) & (second > 0), shard, -1)


def _parts(counts: np.ndarray, shards: int, learned: int) -> np.ndarray:
    return np.maximum(1, -(-counts * shards // max(learned, 1)))


def exchange(words: DataFrame, folder: str, word_shards: int, shards: int, learned: int, texts: int, discount: float) -> DataFrame:
    """Per unit and shard (stored): the codes of its triples, pairs and first words; rows without a unit name
    the file of a shard's levels, or tell the followers of words that are split over shards."""
    asked = "shard int, unit string, first binary, second binary, third binary, n binary, count binary"
    told = "unit string, shard int, a binary, b binary, c binary, d binary, learned long"
    ask, tell = arrow(asked), arrow(told)
    rows = words.where("unit is not null").select("unit", "shard", "a", "b").repartition("unit").sortWithinPartitions("unit", "shard")

    def request(batches):
        fs, path = file_store(folder)
        for group in whole_groups(batches, "unit"):
            unit = group.column("unit")[0].as_py()
            hashes, _, _, train, n, word = _read_unit(fs, path, unit)
            w = _windows(n, train, word, *_words_of(hashes, group, word_shards), texts)
            where = _pair_shards(w, shards, learned)
            count = np.bincount(w.triple_at[w.learned], minlength=len(w.third))
            for s, triples in _grouped(where[w.pair]):
                pair = w.pair[triples]
                first = w.first[pair]
                cells = [s, unit, pack(w.ids[first]), pack(w.ids[w.second[pair]]), pack(w.ids[w.third[triples]]), pack(count[triples]), pack(w.counts[np.unique(first)])]
                yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(cells, ask)], schema=ask)

    def answer(batches):
        fs, path = file_store(folder)
        for group in whole_groups(batches, "shard"):
            yield from _answer(group, fs, path, shards, learned, discount, tell)

    rows = rows.mapInArrow(request, asked).repartition(shards, "shard").sortWithinPartitions("shard")
    return stored(rows.mapInArrow(answer, told), "answers")


def _grouped(shard: np.ndarray):
    """Each shard that occurs with the places it has, in order; places of -1 are left out."""
    order = np.argsort(shard, kind="stable")
    order = order[int(np.searchsorted(shard[order], 0)) :]
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for places in np.split(order, cuts) if len(order) else ():
        yield int(shard[places[0]]), places


def _words_of(hashes: np.ndarray, group: pa.Table, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of the words of a unit, from the answers of the word shards."""
    ids, counts = np.zeros((2, len(hashes)), np.int64)
    places = dict(_grouped(_word_shard(hashes, shards)))
    for s, a, b in zip(*[group.column(c).to_pylist() for c in ("shard", "a", "b")]):
        ids[places[s]], counts[places[s]] = unpack(a), unpack(b)
    return ids, counts


def _answer(group: pa.Table, fs, path: str, shards: int, learned: int, discount: float, tell: pa.Schema):
    shard = group.column("shard")[0].as_py()
    column = lambda name: [unpack(x) for x in group.column(name).to_pylist()]
    firsts = column("first")
    contexts = [np.repeat(c, np.diff(np.r_[np.flatnonzero(np.diff(f, prepend=-1)), len(f)])) for f, c in zip(firsts, column("count"))]
    first, second, third = (np.concatenate(x) for x in (firsts, column("second"), column("third")))
    n, context = np.concatenate(column("n")), np.concatenate(contexts)
    size = int(max(second.max(), third.max())) + 1
    ones, one_at, one_of = np.unique(first, return_index=True, return_inverse=True)
    pairs, pair_of = np.unique(one_of * size + second, return_inverse=True)
    triples, triple_of = np.unique(pair_of * size + third, return_inverse=True)
    total = np.bincount(triple_of, n, len(triples)).astype(np.int64)
    pair, third = triples // size, triples % size
    word, second = pairs // size, pairs % size
    use = total > 0
    file = f"levels-{shard}-{uuid.uuid4().hex}"
    known, followers = Levels.write(
        fs, f"{path}/{file}", ones[word[pair[use]]], second[pair[use]], third[use], total[use], context[one_at][word[pair[use]]], discount
    )
    levels = Levels.open(fs, f"{path}/{file}")
    g1, f2, g2, f3 = levels.look_up(ones, word, second, pair, third)

    def row(*cells):
        return pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(cells, tell)], schema=tell)

    begin = 0
    for unit, own in zip(group.column("unit").to_pylist(), firsts):
        mine = triple_of[begin : begin + len(own)]
        begin += len(own)
        # the unit's triples come in order, so its pairs and first words do too
        own_pairs = pair[mine]
        own_pairs = own_pairs[np.r_[True, own_pairs[1:] != own_pairs[:-1]]]
        own_words = word[own_pairs]
        own_words = own_words[np.r_[True, own_words[1:] != own_words[:-1]]]
        yield row(unit, shard, pack(f3[mine]), pack(f2[own_pairs]), pack(g2[own_pairs]), pack(g1[own_words]), 0)
    split = _parts(context[one_at], shards, learned)[np.searchsorted(ones, known)] > 1
    yield row(None, shard, file.encode(), pack(known[split]), pack(followers[split]), None, len(triples))


def scores(words: DataFrame, answers: DataFrame, folder: str, word_shards: int, shards: int, learned: int, distinct: int, texts: int, discount: float, key: str) -> DataFrame:
    schema = f"`{key}` long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = arrow(schema)
    # at most one word per shard is split
    split: dict[int, int] = {}
    for r in answers.where("unit is null").select("b", "c").toLocalIterator():
        for i, t in zip(unpack(bytes(r["b"])).tolist(), unpack(bytes(r["c"])).tolist()):
            split[i] = split.get(i, 0) + t
    told = [x.where("unit is not null").select("unit", "shard", "a", "b", "c", "d", F.lit(kind).alias("kind")) for kind, x in enumerate((words, answers))]
    rows = told[0].unionByName(told[1]).repartition("unit").sortWithinPartitions("unit", "kind", "shard")

    def run(batches):
        fs, path = file_store(folder)
        for group in whole_groups(batches, "unit"):
            kind = group.column("kind").to_numpy()
            half = int(np.searchsorted(kind, 1))
            hashes, _, keys, train, n, word = _read_unit(fs, path, group.column("unit")[0].as_py())
            ids, counts = _words_of(hashes, group.slice(0, half), word_shards)
            w = _windows(n, train, word, ids, counts, texts)
            weight1, frequency2 = np.ones(len(w.ids)), np.zeros(len(w.first))
            weight2, frequency3 = np.ones(len(w.first)), np.zeros(len(w.third))
            where = _pair_shards(w, shards, learned)
            pairs, triples = dict(_grouped(where)), dict(_grouped(where[w.pair]))
            for s, *codes in zip(*[group.column(c).slice(half).to_pylist() for c in ("shard", "a", "b", "c", "d")]):
                f3, f2, g2, g1 = map(unpack, codes)
                frequency3[triples[s]], frequency2[pairs[s]], weight2[pairs[s]] = _FREQUENCY[f3], _FREQUENCY[f2], _WEIGHT[g2]
                weight1[np.unique(w.first[pairs[s]])] = _WEIGHT[g1]
            for i, t in split.items():
                at = int(np.searchsorted(w.ids, i))
                if at < len(w.ids) and w.ids[at] == i:
                    weight1[at] = discount * t / w.counts[at]
            base = (counts + 1) / (learned + distinct + 1)
            pair = w.pair_at[w.window]
            chance = frequency2[w.pair_at[w.window + 1]] + weight1[w.second[pair]] * base[word]
            chance = frequency3[w.triple_at[w.window]] + weight2[pair] * chance
            starts = np.cumsum(n) - n
            cells = [
                pa.array(keys, mask=keys == NO_ID), pa.array(n), pa.array(np.add.reduceat((counts[word] > 0).astype(np.int64), starts)), pa.array(np.full(len(n), learned)),
                pa.array(np.add.reduceat(np.log10(base[word]), starts)), pa.array(np.add.reduceat(np.log10(np.minimum(chance, 1.0)), starts)),
            ]
            yield pa.RecordBatch.from_arrays(cells, schema=out)

    return rows.mapInArrow(run, schema)


def score(
    docs: DataFrame, learns: Column, text: str = "text", key: str = "doc_id", discount: float = DISCOUNT, unit_bytes: int = UNIT_BYTES,
    shard_words: int = SHARD_WORDS, shard_triples: int = SHARD_TRIPLES,
) -> DataFrame:
    """Learn from the rows where ``learns`` holds and score all: ``key``, ``n_tokens``, ``n_known`` (learned ones),
    ``train_tokens``, ``base_score`` (single words) and ``score`` (the model), in log10."""
    folder = scratch_path(docs.sparkSession, "ngrams")
    found = units(docs, learns, folder, text, key, unit_bytes)
    sums = found.agg(F.sum("tokens"), F.sum("learned"), F.sum("words")).first()
    total, learned, distinct = (int(x or 0) for x in sums)
    texts = docs.where(learns).count()
    word_shards, shards = max(1, -(-distinct // shard_words)), max(1, -(-total // shard_triples))
    words = vocabulary(found, folder, word_shards)
    kinds = int(words.agg(F.sum("learned")).first()[0] or 0)
    answers = exchange(words, folder, word_shards, shards, learned, texts, discount)
    return scores(words, answers, folder, word_shards, shards, learned, kinds, texts, discount, key)
