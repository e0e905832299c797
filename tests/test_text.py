"""Text functions against plain Python on edge cases."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tellmark import config as cfg
from tellmark.functions import text as tx

TEXTS = [
    "", " ", " 　", "a", "One two  three.", "We’ve been — twice… “yes”",
    "Étage élevé. 1st floor! Ok? no", "ﬁne ½ ﬀ café Zürich", "emoji 😀 here. And 𝒜 too",
    "especially前台的简，非常", "кириллица and latin", "no boundary at all " * 5, "A. B. C. D. E. F.",
    "'34", "''", "123", " line\u0085sep\x1cend ", "x" * 50 + ". " + "y" * 50, ". starts with a dot",
]


def run(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = rows.select("i", column(F.col("t")).alias("r")).collect()
    return [r["r"] for r in sorted(found, key=lambda r: r["i"])]


def test_counts_follow_unicode_whitespace(spark):
    assert run(spark, TEXTS, tx.n_words) == [len(t.split()) for t in TEXTS]
    assert run(spark, TEXTS, tx.n_chars) == [len(t) for t in TEXTS]
    assert run(spark, TEXTS, tx.strip) == [t.strip() for t in TEXTS]


def test_opener_word(spark):
    def plain(t):
        m = re.match(r"[^A-Za-z]*([A-Za-z']+)", t)
        return m.group(1).lower() if m else ""

    assert run(spark, TEXTS, tx.opener_word) == [plain(t) for t in TEXTS]
    assert run(spark, [None], tx.opener_word) == [None]


def test_fold_is_ascii_for_latin_and_idempotent(spark):
    once = run(spark, TEXTS, tx.normalize_ascii)
    assert run(spark, once, tx.normalize_ascii) == once
    assert once[5] == "We've been -- twice... 'yes'"
    assert once[7] == "fine 1⁄2 ff cafe Zurich"
    plain = ["".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in TEXTS]
    assert run(spark, TEXTS, tx.fold_accents) == plain
    assert run(spark, [None], tx.fold_accents) == [None]


def test_typography_map_is_complete(spark):
    assert len(cfg.TYPOGRAPHY) == 19
    assert run(spark, list(cfg.TYPOGRAPHY), tx.fold_typography) == list(cfg.TYPOGRAPHY.values())


def test_stray_characters(spark):
    def plain(t):
        return "".join(sorted({c for c in t if (c.isalpha() and ord(c) > 0x24F) or c in cfg.CJK_PUNCTUATION}))

    assert run(spark, TEXTS, tx.stray_characters) == [plain(t) for t in TEXTS]


@pytest.mark.parametrize("limit", [1, 5, 20, 52])
def test_trim_to_sentence(spark, limit):
    def plain(t):
        if len(t) <= limit:
            return t
        w = t[: limit + 1]
        at = max(w.rfind(e + " ") for e in ".!?")
        if at < 0:
            at = max(w.rfind(e) for e in ".!?")
        return t if at <= 0 else t[: at + 1].strip()

    assert run(spark, TEXTS, lambda c: tx.trim_to_sentence(c, limit)) == [plain(t) for t in TEXTS]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("<think>a\nb</think>\n\nGood stay.", "Good stay."),
        ("<THOUGHT>x</THOUGHT> Here's a review: Nice.", "Nice."),
        # Only a word directly before the mark is a preamble.
        ("Sure, here's a review: Nice.", "Sure, here's a review: Nice."),
        ("Sure: Certainly - Of course! : Review: Fine place", "Fine place"),
        ("Here is\nthe text: x", "Here is\nthe text: x"),
        ("review — all good", "- all good"),
        ('"Quoted text."', "Quoted text."),
        ("'''Nested'''", "''Nested''"),
        ("a\n\n\n\n\nb", "a\n\nb"),
        ("'", "'"),
        (None, ""),
        ("Surely not a preamble: kept", "Surely not a preamble: kept"),
    ],
)
def test_clean_response(spark, raw, want):
    assert run(spark, [raw], tx.clean_response) == [want]


def test_clean_response_without_folding_unwraps_each_quote_kind_once(spark):
    clean = lambda c: tx.clean_response(c, normalize=False)
    assert run(spark, ["\"'“ inner ”'\"", "“x”", '"a" and "b"'], clean) == ["inner", "x", 'a" and "b']


def test_length_band():
    assert tx.length_band(200, 0.35) == (130, 270)
    assert tx.length_band(700, 0.35) == (455, 945)


def test_band_distance(spark):
    rows = spark.createDataFrame([(n,) for n in (100, 130, 200, 270, 275)], "n int")
    got = rows.select(tx.band_distance(F.col("n"), F.lit(130), F.lit(270)).alias("d")).collect()
    assert [r["d"] for r in got] == [30, 0, 0, 0, 5]


def test_opener_ok(spark):
    moves = [m for m, _ in cfg.OPENER_MOVES]
    rows = [("I've been", moves[0]), ("We went", moves[0]), ("Us two", moves[1]), ("Us two", moves[2]), ("Our room", moves[3])]
    got = spark.createDataFrame(rows, "t string, m string").select(tx.opener_ok(F.col("t"), F.col("m")).alias("ok"))
    assert [r["ok"] for r in got.collect()] == [1, 0, 1, 1, 0]


ASPECT_TEXTS = [
    "Staff were rude and the ROOM was noisy.", "3 nights, buffet breakfast", "unclean? Clean.", "éclean",
    "a stroll; walking  distance", "value for what we paid", "heard it all", "hear", "check in", "nothing",
]


def test_aspects_match_python_regexes(spark):
    plain = [[a for a, p in cfg.ASPECT_PATTERNS.items() if re.search(p, t, re.I)] for t in ASPECT_TEXTS]
    assert run(spark, ASPECT_TEXTS, tx.aspect_hits) == plain


def test_hygiene_flags(spark):
    texts = ["Sure, ok", "review : x", "Reviewing it", "As an AI model", "class an ai", " here's it"]
    assert run(spark, texts, tx.preamble_leak) == [bool(re.search(cfg.PREAMBLE_LEAK_PATTERN, t, re.I)) for t in texts]
    assert run(spark, texts, tx.self_disclosure) == [bool(re.search(cfg.DISCLOSURE_PATTERN, t, re.I)) for t in texts]


@pytest.mark.parametrize("n", [1, 2, 6])
def test_word_ngrams(spark, n):
    def plain(t):
        w = t.lower().split()
        return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]

    assert run(spark, TEXTS, lambda c: tx.word_ngrams(c, n)) == [plain(t) for t in TEXTS]


def test_tokens(spark):
    assert run(spark, TEXTS, tx.tokens)[6] == ["etage", "eleve", "1st", "floor", "ok", "no"]
    kept = run(spark, TEXTS, lambda c: tx.tokens(c, strip_accents=False))[6]
    assert kept == ["étage", "élevé", "1st", "floor", "ok", "no"]


def test_cell_matches(spark):
    import fnmatch

    cells = ["long_positive_a", "short_negative_b", "x[1]", "a.b"]
    for pattern in ["long_*", "negative", "?hort*", "x[1]", "[!l]*", "a.b", "*[ab]", "zzz", ""]:
        want = [not pattern or fnmatch.fnmatchcase(c, pattern) or pattern in c for c in cells]
        assert run(spark, cells, lambda c: tx.cell_matches(c, pattern)) == want, pattern


def test_parse_verdict(spark):
    raw = ["Positive", " negative. ", "both positive and negative", "hm", "error:Timeout"]
    assert run(spark, raw, tx.parse_verdict) == ["positive", "negative", "positive", "unknown", "error:Timeout"]


def test_code_point_and_output_tag(spark):
    assert run(spark, ["中", "A"], tx.code_point) == ["4E2D", "41"]
    assert run(spark, ["a:b/c"], tx.output_tag) == ["a_b_c"]


def test_fold_takes_a_batch_in_slices(monkeypatch):
    """A whole Arrow batch as Python strings, twice, was most of a worker's memory."""
    import unicodedata

    import pyarrow as pa
    from pyspark.util import PythonEvalType

    from tellmark.functions import udfs

    texts = ["é", None, "", "ﬁn…½", "a\u0301b", "한국어", "plain", None, "ß“”", "\U0001d400"] * 3
    want = [None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts]
    for rows in (1, 4, 30, 1000):
        monkeypatch.setattr(udfs, "FOLD_ROWS", rows)
        assert udfs.folded(pa.array(texts, pa.string())).to_pylist() == want
        assert udfs.folded(pa.array(texts, pa.string()).slice(3, 9)).to_pylist() == want[3:12]
    assert udfs.folded(pa.array([], pa.string())).to_pylist() == [] and udfs.folded(pa.array([None], pa.string())).to_pylist() == [None]
    assert udfs._fold.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
