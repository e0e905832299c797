"""Scalar text functions, ``Column -> Column``. All are built-in expressions except
``fold_accents``, which lives in ``functions.udfs``.

Regular expressions use explicit character classes rather than ``\\s``, ``\\d`` and ``\\b``,
whose reach differs between engines: whitespace is everything Unicode counts as space, and a
word character is a letter, number or underscore.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from tellmark import config as cfg
from tellmark.functions.udfs import fold_accents

SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]"
WORD_START = r"(?:^|[^\p{L}\p{N}_])"
TOKEN = r"[\p{L}\p{N}_]{2,}"
NON_ASCII = r"[^\x00-\x7F]"


def portable(pattern: str) -> str:
    """Rewrite ``\\s``, ``\\d`` and a leading ``\\b`` as explicit Unicode classes."""
    head = WORD_START if pattern.startswith(r"\b") else ""
    body = pattern[2:] if head else pattern
    return head + body.replace(r"\s", WS).replace(r"\d", r"\p{Nd}")


def matches(c: Column, pattern: str) -> Column:
    """Case-insensitive search for a pattern of ``config``."""
    return c.rlike("(?iu)" + portable(pattern))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def words(c: Column) -> Column:
    """Whitespace-separated words; an all-space text has none."""
    s = strip(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, WS + "+"))


def n_chars(c: Column) -> Column:
    return F.length(c)


def n_words(c: Column) -> Column:
    return F.size(words(c))


# ---- cleaning -------------------------------------------------------------


def strip_reasoning(c: Column) -> Column:
    return F.regexp_replace(c, "(?isu)" + portable(cfg.REASONING_PATTERN), "")


def strip_preamble(c: Column) -> Column:
    """Drop every leading preamble; the repeated group does in one pass what repeating a
    single removal until nothing changes would do."""
    return strip(F.regexp_replace(c, f"(?iu)^(?:{portable(cfg.PREAMBLE_PATTERN)})+", ""))


def unwrap_quotes(c: Column) -> Column:
    def once(text: Column, pair: tuple[str, str]) -> Column:
        left, right = pair
        wrapped = (F.length(text) > 1) & text.startswith(left) & text.endswith(right)
        inner = F.substring(text, F.lit(2), F.length(text) - 2)
        return F.when(wrapped, strip(inner)).otherwise(text)

    pairs = (('"', '"'), ("'", "'"), ("“", "”"))
    return reduce(lambda text, pair: let(text, lambda t: once(t, pair)), pairs, c)


def collapse_blank_lines(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def fold_typography(c: Column) -> Column:
    single = {s: d for s, d in cfg.TYPOGRAPHY.items() if len(d) == 1}
    longer = {s: d for s, d in cfg.TYPOGRAPHY.items() if len(d) > 1}
    folded = F.translate(c, "".join(single), "".join(single.values()))
    return reduce(lambda t, sd: F.replace(t, F.lit(sd[0]), F.lit(sd[1])), longer.items(), folded)


def normalize_ascii(c: Column) -> Column:
    return fold_accents(fold_typography(c))


def clean_response(c: Column, normalize: bool = True) -> Column:
    """Reasoning blocks, fold, strip, preamble, wrapping quotes, blank lines, in that order."""
    text = strip_reasoning(F.coalesce(c, F.lit("")))
    if normalize:
        text = normalize_ascii(text)
    return collapse_blank_lines(unwrap_quotes(strip_preamble(strip(text))))


def stray_characters(c: Column) -> Column:
    """Letters beyond extended Latin plus CJK punctuation: distinct, sorted, joined."""
    last = f"\\x{{{cfg.LAST_LATIN_CODE_POINT:X}}}"
    found = F.regexp_extract_all(
        c, F.lit(rf"[\p{{L}}&&[^\x{{0}}-{last}]]|[{cfg.CJK_PUNCTUATION}]"), F.lit(0)
    )
    return F.array_join(F.sort_array(F.array_distinct(found)), "")


def trim_to_sentence(c: Column, max_chars) -> Column:
    """Cut an over-long text after its last sentence end within ``max_chars`` + 1."""
    limit = max_chars if isinstance(max_chars, Column) else F.lit(max_chars)
    window = F.substring(c, F.lit(1), limit + 1)
    spaced = F.regexp_extract(window, r"(?s)^(.*[.!?]) ", 1)
    ended = F.regexp_extract(window, r"(?s)^(.*[.!?])", 1)
    cut = F.when(spaced != "", spaced).otherwise(ended)
    return F.when((F.length(c) > limit) & (F.length(cut) > 1), strip(cut)).otherwise(c)


# ---- length band ----------------------------------------------------------


def length_band(target: int, tolerance: float) -> tuple[int, int]:
    return int(target * (1 - tolerance)), int(target * (1 + tolerance))


def band_distance(n: Column, lo, hi) -> Column:
    """0 inside the inclusive band, else characters to the nearest edge."""
    return F.when(n.between(lo, hi), F.lit(0)).otherwise(F.least(F.abs(n - lo), F.abs(n - hi)))


def by_length(length: Column, values: dict[str, int]) -> Column:
    """A per-condition constant chosen by the length factor."""
    return reduce(
        lambda acc, kv: acc.when(length == kv[0], F.lit(kv[1])), values.items(), F
    )


# ---- openers, aspects, flags ----------------------------------------------


def opener_word(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[^A-Za-z]*([A-Za-z']+)", 1))


def opener_ok(c: Column, move: Column) -> Column:
    word = opener_word(c)
    return (
        F.when(move.startswith("first person singular"), word.isin(*cfg.SINGULAR_OPENERS))
        .when(move.startswith("first person plural"), word.isin(*cfg.PLURAL_OPENERS))
        .otherwise(~word.isin(*cfg.DEFAULT_OPENERS))
        .cast("int")
    )


def aspect_hits(c: Column, patterns: dict[str, str] | None = None) -> Column:
    """Names of the aspects a text mentions, in pattern order."""
    patterns = patterns or cfg.ASPECT_PATTERNS
    named = [F.when(matches(c, p), F.lit(name)) for name, p in patterns.items()]
    return F.array_compact(F.array(*named))


def preamble_leak(c: Column) -> Column:
    return matches(c, cfg.PREAMBLE_LEAK_PATTERN)


def self_disclosure(c: Column) -> Column:
    return matches(c, cfg.DISCLOSURE_PATTERN)


def distinct_characters(c: Column) -> Column:
    """Distinct characters of a text that are not whitespace."""
    return F.array_distinct(F.split(F.translate(c, SPACES, ""), ""))


def code_point(ch: Column) -> Column:
    return F.hex(F.ascii(ch))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``.

    An expression repeated inside a lambda is evaluated for every element; a bound lambda
    variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grams(ws: Column, n: int) -> Column:
    """Runs of ``n`` neighbours joined by a space; none when there are fewer than ``n``.

    ``ws`` must be a stored column or a bound variable. Elements are fetched by position
    because slicing copies the whole array.
    """
    joined = F.transform(
        F.sequence(F.lit(0), F.size(ws) - n),
        lambda i: F.concat_ws(" ", *[F.get(ws, i + k) for k in range(n)]),
    )
    return F.when(F.size(ws) >= n, joined).otherwise(F.array().cast("array<string>"))


def word_ngrams(c: Column, n: int = 6) -> Column:
    """Lower-cased word n-grams."""
    return let(words(F.lower(c)), lambda ws: grams(ws, n))


def tokens(c: Column, strip_accents: bool = True) -> Column:
    """Lower-cased word tokens of two or more characters."""
    text = F.lower(c)
    if strip_accents:
        text = fold_accents(text)
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


# ---- cells, verdicts, scores ----------------------------------------------


def cell_id(*factors: Column) -> Column:
    return F.concat_ws("_", *factors)


def output_tag(c: Column) -> Column:
    return F.translate(c, ":/", "__")


def glob_regex(pattern: str) -> str:
    """Shell wildcards as an anchored regular expression."""
    out, rest = [], pattern
    while rest:
        bracket = re.match(r"\[(!?)(\]?[^\]]*)\]", rest)
        if rest[0] == "*":
            out.append(".*")
        elif rest[0] == "?":
            out.append(".")
        elif bracket:
            inner = re.sub(r"([\\\[\]^&])", r"\\\1", bracket[2])
            out.append(f"[{'^' if bracket[1] else ''}{inner}]")
            rest = rest[bracket.end():]
            continue
        else:
            out.append(re.escape(rest[0]))
        rest = rest[1:]
    return r"(?s)\A" + "".join(out) + r"\z"


def cell_matches(c: Column, pattern: str | None) -> Column:
    """Wildcard match or substring; an empty pattern takes every cell."""
    if not pattern:
        return F.lit(True)
    return c.rlike(glob_regex(pattern)) | c.contains(pattern)


def parse_verdict(c: Column) -> Column:
    v = F.lower(strip(c))
    return (
        F.when(c.startswith("error:"), c)
        .when(v.contains("positive"), "positive")
        .when(v.contains("negative"), "negative")
        .otherwise("unknown")
    )


def softmax_positive(l0: Column, l1: Column) -> Column:
    """Probability of class 1 from two logits."""
    return 1 / (1 + F.exp(l0.cast("double") - l1.cast("double")))
