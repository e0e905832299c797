"""Encoding and decoding with a byte-fallback piece model by vectorised merge rounds.

All new words of a round of texts lie as symbols in flat arrays. In each round, every word finds
its best-ranked adjacent pair (a segmented minimum), merges it, and the arrays are compacted;
words without a pair left leave. A pair is merged at all its places in the word at once, from the
left and without overlap, when no piece that begins or ends with the merged one ranks before it;
otherwise only its leftmost place is merged. That is the order of a queue by (score, place), so
ids equal those of the public library on every text.

Null text counts as empty. An empty text has no ids and decodes to itself. Texts of any length
work: long words take more symbols, not more rounds per symbol. Ties between pieces of one score
go to the leftmost. Rows that repeat are encoded each.
"""

from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tellmark.llm.common import WordTable, arrow, slices, sums_between, take_ragged, worker_state

SPACE = "▁"
NONE = np.int32(2**31 - 1)


class PieceModel:
    """Tables of one model file, and the merges over them."""

    def __init__(self, serialized: bytes):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=serialized)
        if lib.normalize("  a\tﬁ ") != f"{SPACE * 3}a\tﬁ{SPACE}":
            raise ValueError("only models without text normalisation are supported")
        size = lib.get_piece_size()
        special = [lib.is_control(i) or lib.is_unknown(i) for i in range(size)]
        byte = [lib.is_byte(i) for i in range(size)]
        pieces = [lib.id_to_piece(i) for i in range(size)]
        ordinary = {p: i for i, p in enumerate(pieces) if not special[i] and not byte[i]}
        if any(lib.is_unused(i) for i in ordinary.values()) or sum(byte) != 256:
            raise ValueError("only models with byte fallback and without unused pieces are supported")
        if any(SPACE in p.lstrip(SPACE) for p in ordinary):
            raise ValueError("a piece spans several words")
        self.byte_ids = np.array([i for i in range(size) if byte[i]], np.int32)
        self._symbols(ordinary, size)
        self._pairs(ordinary, {i: lib.get_score(i) for i in ordinary.values()})
        text = [
            b" \xe2\x81\x87 " if lib.is_unknown(i) else b"" if special[i]
            else bytes([int(p[3:5], 16)]) if byte[i] else p.replace(SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.marked = np.array([not special[i] and p.startswith(SPACE) for i, p in enumerate(pieces)])
        self.surface, self.surface_at, self.surface_len = self._table(text)
        self.digits, self.digits_at, self.digits_len = self._table([b"%d," % i for i in range(size)])
        self.words = WordTable(self.merge)

    @staticmethod
    def _table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lens = np.array([len(s) for s in strings], np.int64)
        return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lens) - lens, lens

    def _symbols(self, ordinary: dict[str, int], size: int) -> None:
        """Characters get their piece's id, or a number above all ids where they are none."""
        chars = sorted(set("".join(ordinary)))
        ids = dict(ordinary)
        for c in chars:
            if c not in ids:
                ids[c] = size + len(ids) - len(ordinary)
        self.known, self.size = ids, size
        self.width = size + len(ids) - len(ordinary) + 1
        self.stranger = self.width - 1  # a character that is in no piece
        self.char_codes = np.array([ord(c) for c in chars], np.uint32)
        self.char_ids = np.array([ids[c] for c in chars], np.int32)

    def _pairs(self, ordinary: dict[str, int], scores: dict[int, float]) -> None:
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rank = {i: order[s] for i, s in scores.items()}
        count = np.bincount(list(rank.values()))
        alone = {i: bool(count[r] == 1) for i, r in rank.items()}
        rows = []
        for piece, i in ordinary.items():
            for cut in range(1, len(piece)):
                left, right = self.known.get(piece[:cut]), self.known.get(piece[cut:])
                if left is not None and right is not None:
                    rows.append((left * self.width + right, rank[i], i))
                    for part in (left, right):
                        if part in rank and rank[i] <= rank[part]:
                            alone[part] = False
        rows.sort()
        keys, ranks, merged = np.array(rows or [(-1, 0, 0)], np.int64).T
        self.pair_keys = keys
        self.pair_rank = np.append(ranks.astype(np.int32), NONE)
        self.pair_piece = np.append(merged.astype(np.int32), 0)
        self.pair_all = np.append(np.array([alone.get(int(i), False) for i in merged]), False)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places in the pair tables; the last one stands for no pair."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, at, len(self.pair_keys)).astype(np.int32)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each without the space mark in front that all words have."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        marked = SPACE + SPACE.join(words)
        code = np.frombuffer(marked.encode("utf-32-le"), np.uint32)
        lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
        at = np.searchsorted(self.char_codes, code)
        at[at == len(self.char_codes)] = 0
        sym = np.where(self.char_codes[at] == code, self.char_ids[at], np.int32(self.stranger))
        word = np.repeat(np.arange(len(words)), lens)
        place = np.arange(len(code))  # the first character of each symbol
        pair = np.full(len(sym), len(self.pair_keys), np.int32)
        inside = np.flatnonzero(word[1:] == word[:-1])
        pair[inside] = self._pair(sym[inside], sym[inside + 1])
        done = []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = self.pair_rank[pair]
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(sym)])
            open_ = np.repeat(best != NONE, size)
            if not open_.all():
                done.append((place[~open_], sym[~open_]))
                sym, word, place, pair = sym[open_], word[open_], place[open_], pair[open_]
                continue
            hit = rank == np.repeat(best, size)
            at = np.flatnonzero(hit)
            # of overlapping places every second one counts, from the left
            run = np.cumsum(np.r_[True, np.diff(at) != 1])
            nth = np.arange(len(at)) - np.flatnonzero(np.r_[True, np.diff(run) != 0])[run - 1]
            leftmost = np.r_[True, word[at[1:]] != word[at[:-1]]]
            at = at[leftmost | (self.pair_all[pair[at]] & (nth % 2 == 0))]
            sym[at] = self.pair_piece[pair[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word, place, pair = sym[keep], word[keep], place[keep], pair[keep]
            at = at - np.arange(len(at))
            near = np.zeros(len(sym), bool)
            near[at] = near[at[at > 0] - 1] = True
            near = np.flatnonzero(near)
            pair[near] = len(self.pair_keys)
            near = near[near + 1 < len(sym)]
            near = near[word[near] == word[near + 1]]
            pair[near] = self._pair(sym[near], sym[near + 1])
        place = np.concatenate([p for p, _ in done])
        sym = np.concatenate([s for _, s in done])
        order = np.argsort(place, kind="stable")
        return self._fallback(code, place[order], sym[order], lens)

    def _fallback(self, code, place, sym, lens) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no piece become the ids of their UTF-8 bytes."""
        ends = np.cumsum(lens)
        owner = np.searchsorted(ends, place, side="right")
        odd = np.flatnonzero(sym >= self.size)
        if len(odd):
            raw = [chr(c).encode() for c in code[place[odd]].tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(r) for r in raw]
            owner, spread_sym = np.repeat(owner, times), np.repeat(sym, times)
            spread_sym[spread_sym >= self.size] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            sym = spread_sym
        return sym.astype(np.int32), np.bincount(owner, minlength=len(lens))

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and the bounds of each text in them."""
        words, counts = [], []
        for text in texts:
            if not text:
                counts.append(0)
                continue
            if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
                own = [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
            else:
                own = text.split(" ")
            words += own
            counts.append(len(own))
        at = self.words(words)
        lens = self.words.lens[at]
        ids = take_ragged(self.words.flat, self.words.starts[at], lens)
        sizes = sums_between(lens, np.r_[0, np.cumsum(counts)].astype(np.int64))
        return ids, np.r_[0, np.cumsum(sizes)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """UTF-8 texts of flat ids, without the space that stands for the mark in front.
        Bytes that form no character become U+FFFD each."""
        out = take_ragged(self.surface, self.surface_at[ids], self.surface_len[ids]).tobytes()
        cuts = np.r_[0, np.cumsum(self.surface_len[ids])][bounds].tolist()
        shown = np.flatnonzero(self.surface_len[ids])
        first = np.r_[shown, len(ids)][np.searchsorted(shown, bounds[:-1])]
        marked = np.r_[self.marked[ids], False][first].tolist()
        texts = [out[a + m : max(a + m, b)] if a < b else b"" for a, b, m in zip(cuts, cuts[1:], marked)]
        try:
            out.decode()
        except UnicodeDecodeError:
            texts = [
                re.sub("[\udc80-\udcff]", "�", t.decode(errors="surrogateescape")).encode()
                for t in texts
            ]
        return texts

    def written(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Decimal ids of each text, joined by commas."""
        out = take_ragged(self.digits, self.digits_at[ids], self.digits_len[ids]).tobytes()
        cuts = np.r_[0, np.cumsum(self.digits_len[ids])][bounds].tolist()
        return [out[a : max(a, b - 1)] for a, b in zip(cuts, cuts[1:])]


def _model(key: str, serialized) -> PieceModel:
    return worker_state(("pieces", key), lambda: PieceModel(serialized.value))


def _shared(df: DataFrame, model_path: str):
    with open(model_path, "rb") as f:
        content = f.read()
    return sha256(content).hexdigest(), df.sparkSession.sparkContext.broadcast(content)


def encode(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``ids`` (array of int) of every text."""
    digest, content = _shared(docs, model_path)
    source = docs.select(key, text)
    schema = f"{key} {dict(source.dtypes)[key]}, ids array<int>"
    out = arrow(schema)

    def run(batches):
        model = _model(digest, content)
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                ids, bounds = model.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists.cast(out.field(1).type)], schema=out)

    return source.mapInArrow(run, schema)


def digests(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every text: encoding and
    decoding in one pass, without moving the ids."""
    digest, content = _shared(docs, model_path)
    source = docs.select(key, text)
    schema = f"{key} {dict(source.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = arrow(schema)

    def run(batches):
        model = _model(digest, content)
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                ids, bounds = model.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([sha256(x).hexdigest() for x in model.written(ids, bounds)], pa.string()),
                        pa.array([sha256(x).hexdigest() for x in model.decode(ids, bounds)], pa.string()),
                    ],
                    schema=out,
                )

    return source.mapInArrow(run, schema)


def decode(tokens: DataFrame, model_path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``key`` and ``text`` of every list of ids; null counts as an empty list."""
    digest, content = _shared(tokens, model_path)
    source = tokens.select(key, ids)
    schema = f"{key} {dict(source.dtypes)[key]}, text string"
    out = arrow(schema)

    def run(batches):
        model = _model(digest, content)
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            bounds = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
            flat = np.array([i for x in lists for i in x], np.int64)
            texts = [t.decode() for t in model.decode(flat, bounds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=out)

    return source.mapInArrow(run, schema)
