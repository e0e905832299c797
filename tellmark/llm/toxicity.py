"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, report, or other. Five small transducers
read the symbols of a clause (up to punctuation or a line end): the insult and threat transducers
emit weights, the target, negation and reported-speech transducers remember what came before and
so decide of which kind an emission is. `compose` builds their product, one table of states; a
matched clause yields its weight under the kinds plain, targeted, negated and reported. A document
is scored by a logistic model over what its matched clauses yield, so an isolated word counts by
the clause that it stands in.

Learned from labelled rows, about ``SAMPLE_DOCS`` whole texts of each label (those with the
smallest hashes): the insult lexicon, whole words and word beginnings with the logarithm of how
much likelier toxic texts hold them, and the weights of the kinds. The short word lists below are
the start of the lexicon and the other symbols.

Null and empty texts match nothing and get the base score. Without labels of both kinds every
score is 0. Texts are lower-cased and read whole; rows that repeat are scored each.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tellmark.llm.common import WordTable, arrow, slices, stored, worker_state
from tellmark.llm.langid import sample_per_class

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

# Fixed word lists (English, German, French, Spanish).
INSULTS = "idiot moron stupid dumb scum loser trash pathetic worthless disgusting clown fool trottel dummkopf abschaum crétin ordure débile imbécil basura estúpido".split()
THREATS = "kill hurt destroy beat crush burn töten umbringen vernichten tuer détruire frapper matar destruir golpear".split()
TARGETS = "you your yours yourself they them dich euch deine ihr toi vous vos tu ti ustedes vosotros".split()
NEGATIONS = "not never isn't aren't wasn't don't nicht kein keine niemals pas jamais aucun nunca jamás tampoco".split()
REPORTS = "said says wrote claimed quoted called reported sagte schrieb behauptete disait écrivit affirma dijo escribió afirmó".split()

SYMBOLS = {
    **dict.fromkeys(THREATS, THREAT), **dict.fromkeys(TARGETS, TARGET),
    **dict.fromkeys(NEGATIONS, NEGATION), **dict.fromkeys(REPORTS, REPORT),
}
#: Kinds of what a clause emits, in the order of the features.
KINDS = ("plain", "targeted", "negated", "reported")

SAMPLE_DOCS = 6000
#: Lengths of word beginnings that can enter the lexicon.
STEMS = range(3, 9)
#: Least weight of an entry. A strong entry has it even that many standard errors below its estimate; a
#: weak one at fewer of them, and must explain texts that hold no strong entry: ``LEAST_TEXTS`` or
#: more, and at least 30 % of the toxic texts that hold it.
LEAST_WEIGHT = 2.0
STRONG, WEAK = 2.5, 1.6
LEAST_TEXTS = 3
MOST_ENTRIES = 20_000
START_WEIGHT = 2.5
LINE = " "
RUN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
END = re.compile(r"[.!?;:,)\]|][^\w]*$")


class Transducer:
    """States by name; ``arcs[state][symbol] = (next state, emission)``. Symbols without an arc leave
    the state as it is and emit nothing."""

    def __init__(self, start: str, arcs: dict[str, dict[int, tuple[str, float | None]]]):
        self.start, self.arcs = start, arcs

    def step(self, state: str, symbol: int) -> tuple[str, float | None]:
        return self.arcs.get(state, {}).get(symbol, (state, None))

    @property
    def states(self) -> list[str]:
        found = {self.start} | set(self.arcs)
        return sorted(found | {n for a in self.arcs.values() for n, _ in a.values()})


#: Emissions of insult and threat are factors of the word's weight.
INSULTING = Transducer("idle", {"idle": {INSULT: ("idle", 1.0)}})
THREATENING = Transducer("idle", {"idle": {THREAT: ("raised", None)}, "raised": {TARGET: ("idle", 1.0)}})
#: The others emit nothing; being in their second state names the kind.
TARGETING = Transducer("nobody", {"nobody": {TARGET: ("somebody", None)}})
NEGATING = Transducer("plain", {"plain": {NEGATION: ("negated", None)}, "negated": {INSULT: ("plain", None)}})
REPORTING = Transducer("own", {"own": {REPORT: ("quoted", None)}})


def compose(*parts: Transducer) -> tuple[tuple, dict]:
    """The product: its start state and ``table[state, symbol] = (next state, emission, kind)``. The
    kind is read off the states before the symbol."""
    table = {}
    for state in itertools.product(*[p.states for p in parts]):
        kind = 3 if "quoted" in state else 2 if "negated" in state else 1 if "somebody" in state else 0
        for symbol in range(1, 6):
            steps = [p.step(s, symbol) for p, s in zip(parts, state)]
            emitted = [e for _, e in steps if e is not None]
            table[state, symbol] = (tuple(n for n, _ in steps), sum(emitted), kind)
    return tuple(p.start for p in parts), table


START, TABLE = compose(INSULTING, THREATENING, TARGETING, NEGATING, REPORTING)


def _terms(text: str) -> set[str]:
    """Words (marked by $) and word beginnings of a text."""
    words = set(RUN.findall(text.lower()))
    return {w + "$" for w in words} | {w[:k] for w in words for k in STEMS if k < len(w)}


def _term_counts(rows: DataFrame, text: str, wanted: frozenset | None = None, without: frozenset = frozenset()) -> DataFrame:
    """How many texts hold each (wanted) term, of texts that hold none of ``without``. Counts are
    combined inside tasks first."""
    schema = "term string, n long"
    out = arrow(schema)

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for t in itertools.chain.from_iterable(texts for _, _, texts in slices(batch.column(0))):
                terms = _terms(t)
                if without.isdisjoint(terms):
                    counts.update(terms if wanted is None else wanted.intersection(terms))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=out
        )

    return rows.select(text).mapInArrow(run, schema).groupBy("term").agg(F.sum("n").alias("n"))


class Grammar:
    """Lexicon, and the weights of what clauses emit."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.token = lexicon, uuid.uuid4().hex
        self.weights = np.zeros(2 * len(KINDS) + 2)

    def symbol(self, word: str) -> tuple[int, float]:
        if word in SYMBOLS:
            return SYMBOLS[word], START_WEIGHT
        for term in (word + "$", *[word[:k] for k in reversed(STEMS) if k < len(word)]):
            if term in self.lexicon:
                weight = self.lexicon[term]
                return (INSULT, weight) if weight > 0 else (OTHER, 0.0)
        return OTHER, 0.0

    def read(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbol, weight and whether a clause ends, for each token (of which one symbol counts)."""
        rows = np.zeros((len(tokens), 3))
        for i, token in enumerate(tokens):
            if token == LINE:
                rows[i, 2] = 1
                continue
            found = max((self.symbol(w) for w in RUN.findall(token)), key=lambda s: (s[1], s[0]), default=(OTHER, 0.0))
            rows[i] = (*found, END.search(token) is not None)
        return rows.ravel(), np.full(len(tokens), 3, np.int64)

    def features(self, texts: list, table: WordTable) -> np.ndarray:
        """Per text and kind: logarithm of the summed weights and of the number of matched clauses."""
        own = [t.lower().replace("\n", f" {LINE} ").split() if t else [] for t in texts]
        at = table([w for words in own for w in words])
        codes = table.flat[: table.used].reshape(-1, 3)[at]
        ends = np.cumsum([len(w) for w in own])
        first = np.zeros(len(codes), bool)
        first[(ends - [len(w) for w in own])[ends > (ends - [len(w) for w in own])]] = True
        clause = np.cumsum(first | np.r_[True, codes[:-1, 2] > 0][: len(codes)])
        speaks = np.isin(codes[:, 0], (INSULT, THREAT))
        places = np.flatnonzero((codes[:, 0] > 0) & np.isin(clause, clause[speaks]))
        doc = np.searchsorted(ends, places, side="right").tolist()
        total, count = np.zeros((2, len(texts), len(KINDS)))
        last, state, seen = None, START, set()
        for d, c, symbol, weight in zip(doc, clause[places].tolist(), codes[places, 0].astype(int).tolist(), codes[places, 1].tolist()):
            if c != last:
                last, state, seen = c, START, set()
            state, emitted, kind = TABLE[state, symbol]
            if emitted:
                total[d, kind] += emitted * weight
                count[d, kind] += kind not in seen
                seen.add(kind)
        return np.c_[np.log1p(total), np.log1p(count)]

    def score(self, features: np.ndarray) -> np.ndarray:
        x = np.c_[features, features[:, : len(KINDS)].sum(axis=1), np.ones(len(features))] @ self.weights
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))

    def fit(self, features: np.ndarray, toxic: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> None:
        """Logistic weights by Newton steps; ``weight`` undoes unequal sampling of the labels."""
        x = np.c_[features, features[:, : len(KINDS)].sum(axis=1), np.ones(len(features))]
        penalty = ridge * np.eye(x.shape[1])
        penalty[-1, -1] = 1e-3
        for _ in range(30):
            p = self.score(features)
            slope = x.T @ (weight * (toxic - p)) - penalty @ self.weights
            bend = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty
            step = np.linalg.solve(bend, slope)
            self.weights = self.weights + np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break


def _symbols(grammar: Grammar) -> WordTable:
    return worker_state(("grammar", grammar.token), lambda: WordTable(grammar.read))


def learn(rows: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Grammar | None:
    """A grammar from labelled rows (labels 0 and 1; others and null texts are left out); None unless
    both labels occur."""
    known = rows.where(F.col(label).isin(0, 1) & F.col(text).isNotNull())
    known = known.select(F.col(label).cast("int").alias("_y"), F.col(text).alias("_t"), F.col(key).alias("_k"))
    known = stored(known, "labelled")
    totals = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return None
    sample = stored(sample_per_class(known, "_y", ["_k", "_t"], sample_docs), "labelled-sample")
    sizes = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    bad, good = sample.where("_y = 1"), sample.where("_y = 0")
    counts = lambda df: {r["term"]: r["n"] for r in df.toLocalIterator()}
    toxic = counts(_term_counts(bad, "_t").where(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "term").limit(50 * MOST_ENTRIES))
    clean = counts(_term_counts(good, "_t", frozenset(toxic) | {w + "$" for w in INSULTS}))
    weight, strong, weak = {}, [], []
    for term, n in toxic.items():
        m = clean.get(term, 0)
        weight[term] = float(np.log((n + 0.5) / (sizes[1] + 1)) - np.log((m + 0.5) / (sizes[0] + 1)))
        error = np.sqrt(1 / (n + 0.5) + 1 / (m + 0.5))
        if weight[term] - STRONG * error >= LEAST_WEIGHT:
            strong.append(term)
        elif weight[term] - WEAK * error >= LEAST_WEIGHT:
            weak.append(term)
    alone = counts(_term_counts(bad, "_t", frozenset(weak), frozenset(strong)))
    strong += [t for t in weak if alone.get(t, 0) >= max(LEAST_TEXTS, 0.3 * toxic[t])]
    best = sorted(strong, key=lambda t: (-weight[t] * toxic[t], t))[:MOST_ENTRIES]
    start = {w + "$": START_WEIGHT for w in INSULTS if w + "$" not in clean}  # of the word list, what nothing speaks against
    start |= {t: w for t, w in weight.items() if t in start and w > 0}
    grammar = Grammar({**start, **{t: weight[t] for t in best}})
    found = features(sample.select("_y", "_t"), grammar, "_t", "_y").toPandas()
    y = found["_y"].to_numpy()
    x = np.stack(found["features"].to_numpy())
    grammar.fit(x, y, np.where(y == 1, totals[1] / sizes[1], totals[0] / sizes[0]))
    return grammar


def features(docs: DataFrame, grammar: Grammar, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and what the matched clauses of each text yield."""
    source = docs.select(key, text)
    schema = f"{key} {dict(source.dtypes)[key]}, features array<double>"
    out = arrow(schema)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches):
        grammar = shared.value
        table = _symbols(grammar)
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                x = grammar.features(texts, table)
                lists = pa.array(list(x), out.field(1).type)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], schema=out)

    return source.mapInArrow(run, schema)


def score(docs: DataFrame, grammar: Grammar | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``score`` of every text."""
    if grammar is None:
        return docs.select(key, F.lit(0.0).alias("score"))
    source = docs.select(key, text)
    schema = f"{key} {dict(source.dtypes)[key]}, score double"
    out = arrow(schema)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches):
        grammar = shared.value
        table = _symbols(grammar)
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                found = grammar.score(grammar.features(texts, table))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found)], schema=out)

    return source.mapInArrow(run, schema)
