"""Language identification by prediction by partial matching.

Every language has a context tree over bytes: for each context of up to ``DEPTH`` bytes inside a
word, the bytes that followed it and how often. A byte costs minus the logarithm of its share
under the longest known context; where it never followed there, the escape of that context
(d / (n + d) for n bytes of d kinds, method C) is paid and the next shorter context asked, down to
eight bits for any byte. Statistics stay frozen while scoring, so a code length is a sum over
bytes, and a word, which begins behind a space and ends with one, costs the same wherever it
stands. The language with the shortest code wins; ``score`` is its posterior under equal priors.

The trees are learned from whole texts of about ``SAMPLE_DOCS`` documents of each language,
those with the smallest hashes: a bound on the model, not on what is scored. Texts are lower-cased.
A null text, or one without a letter, is ``und`` with score 0. Ties go to the language that sorts
first. Without anything to learn from, every text is ``und``. Rows that repeat are scored each.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tellmark.llm.common import WordTable, arrow, boxed, drop_state, rewritten, slices, sums_between, worker_state

DEPTH = 4
SAMPLE_DOCS = 400
UNKNOWN = "und"


def sample_per_class(rows: DataFrame, label: str, order: list[str], most: int) -> DataFrame:
    """Rows of about ``most`` smallest hashes of each class. One count per class sets its hash
    threshold, a literal, so rows stop at the scan and no class is ranked, moved or gathered."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per class
    if not counts:
        return rows.limit(0)
    size = F.create_map(*[F.lit(x) for r in counts for x in (r[label], r["n"])])[F.col(label)]
    share = F.pmod(F.xxhash64(*order), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(share * size < float(most))


def _words(text: str) -> list[str]:
    return text.lower().split()


def word_counts(rows: DataFrame, label: str, text: str) -> DataFrame:
    """``label``, ``word`` and its count over whole texts, combined inside each task first."""
    schema = "label string, word string, n long"
    out = arrow(schema)

    def run(batches):
        from collections import Counter

        counts = Counter()
        for batch in batches:
            labels = batch.column(0).to_pylist()
            for a, b, texts in slices(batch.column(1)):
                for name, own in zip(labels[a:b], texts):
                    counts.update((name, w) for w in _words(own or ""))
        names, words = zip(*counts) if counts else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())],
            schema=out,
        )

    partial = rows.select(label, text).mapInArrow(run, schema)
    return partial.groupBy("label", "word").agg(F.sum("n").alias("n"))


def _grams(words: list[str], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the bytes of `` word `` behind the first space: the last eight bytes up to each as a
    number, how many bytes of context stand before it, and the word it belongs to."""
    raw = [f" {w} ".encode() for w in words]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(np.cumsum(lens) - lens, lens)
    code = np.zeros(len(data), np.uint64)
    for back in range(depth, -1, -1):
        code <<= np.uint64(8)
        code[back:] |= data[: len(data) - back] if back else data
    keep = place > 0
    return code[keep], np.minimum(place[keep], depth), np.repeat(np.arange(len(raw)), lens)[keep]


class Trees:
    """Costs in bits of every byte under every language, by the grams (context and byte) that
    any language knows."""

    def __init__(self, names: list[str], label: np.ndarray, words: list[str], n: np.ndarray, depth: int = DEPTH):
        self.names, self.depth, self.token = names, depth, uuid.uuid4().hex
        code, context, word = _grams(words, depth)
        lang, weight = label[word], n[word].astype(np.float64)
        self.grams, self.bits, self.contexts, self.escapes = [], [], [], []
        below = np.full((1, len(names)), 8.0)
        for k in range(depth + 1):
            use = context >= k
            gram = code[use] & np.uint64((1 << 8 * (k + 1)) - 1)
            grams, at = np.unique(gram, return_inverse=True)
            count = np.zeros((len(grams), len(names)))
            np.add.at(count, (at, lang[use]), weight[use])
            contexts, parent = np.unique(grams >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((2, len(contexts), len(names)))
            np.add.at(total, parent, count)
            np.add.at(kinds, parent, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(count / (total + kinds)[parent])
            if k:
                shorter = np.searchsorted(self.grams[-1], grams & np.uint64((1 << 8 * k) - 1))
                below = self.bits[-1][shorter]
            self.grams.append(grams)
            self.bits.append(np.where(count > 0, seen, escape[parent] + below))
            self.contexts.append(contexts)
            self.escapes.append(escape)

    def costs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each word under each language, flat, and the number of languages per word."""
        width = len(self.names)
        if not words:
            return np.zeros(0), np.zeros(0, np.int64)
        code, context, word = _grams(words, self.depth)
        bits = np.zeros((len(code), width))
        open_ = np.arange(len(code))
        for k in range(self.depth, -1, -1):
            now = context[open_] >= k
            at, later = open_[now], open_[~now]
            gram = code[at] & np.uint64((1 << 8 * (k + 1)) - 1)
            place = np.searchsorted(self.grams[k], gram)
            place[place == len(self.grams[k])] = 0
            found = self.grams[k][place] == gram
            bits[at[found]] += self.bits[k][place[found]]
            at, gram = at[~found], gram[~found] >> np.uint64(8)
            place = np.searchsorted(self.contexts[k], gram)
            place[place == len(self.contexts[k])] = 0
            known = self.contexts[k][place] == gram
            bits[at[known]] += self.escapes[k][place[known]]
            open_ = np.r_[later, at]
        bits[open_] += 8.0
        ends = np.r_[np.flatnonzero(np.diff(word)) + 1, len(word)]
        return sums_between(bits, np.r_[0, ends]).ravel(), np.full(len(words), width, np.int64)


def train(rows: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS, depth: int = DEPTH) -> Trees | None:
    """Context trees from rows whose language is known; None without any."""
    known = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text, key)
    sample = sample_per_class(known, lang, [key, text], sample_docs)
    counts = word_counts(sample, lang, text).toPandas().sort_values(["label", "word"])
    if counts.empty:
        return None
    names = sorted(set(counts["label"]))
    place = {name: i for i, name in enumerate(names)}
    return Trees(names, counts["label"].map(place).to_numpy(), counts["word"].tolist(), counts["n"].to_numpy(), depth)


def predict(docs: DataFrame, trees: Trees | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``lang_pred``, ``score`` and ``bits_per_byte`` (of the best language) of every text."""
    source = docs.select(key, text)
    schema = f"{key} {dict(source.dtypes)[key]}, lang_pred string, score double, bits_per_byte double"
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    out = arrow(schema)

    def run(batches):
        trees = shared.value
        table = _word_costs(trees) if trees else None
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *_classify(trees, table, texts)], schema=out
                )
        drop_state()

    return source.mapInArrow(run, schema)


def attach(docs: DataFrame, trees: Trees, text: str = "text", lang: str = "_lang", score: str = "_score") -> DataFrame:
    """All columns of ``docs`` with the predicted language and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def classify(texts):
        names, scores, _ = _classify(shared.value, _word_costs(shared.value), texts)
        return texts, names, scores

    more = [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]
    return rewritten(boxed(docs, text), docs.schema, text, [], more, classify)


def _word_costs(trees: Trees) -> WordTable:
    return worker_state(("trees", trees.token), lambda: WordTable(trees.costs))


def _classify(trees: Trees | None, table: WordTable | None, texts: list) -> list[pa.Array]:
    some = np.array([trees is not None and t is not None and any(map(str.isalpha, t)) for t in texts], bool)
    names, scores, rates = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    if some.any():
        own = [_words(texts[i]) for i in np.flatnonzero(some)]
        at = table([w for words in own for w in words])
        width = len(trees.names)
        bounds = np.r_[0, np.cumsum([len(words) for words in own])]
        total = sums_between(table.flat[: table.used].reshape(-1, width)[at], bounds)
        best = total.argmin(axis=1)
        least = total[np.arange(len(best)), best]
        with np.errstate(under="ignore"):
            scores[some] = 1 / np.exp2(np.maximum(least[:, None] - total, -1000)).sum(axis=1)
        size = [sum(len(w) + 1 for w in words) for words in own]
        rates[some] = least / size
        for i, j in zip(np.flatnonzero(some).tolist(), best.tolist()):
            names[i] = trees.names[j]
    return [pa.array(names, pa.string()), pa.array(scores), pa.array(rates)]
