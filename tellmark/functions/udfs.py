"""The places Python runs per row: Unicode folding and caller-supplied scorers."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

_NON_ASCII = r"[^\x00-\x7F]"
FOLD_ROWS = 256


@cache
def _marks() -> dict[int, None]:
    """A translation table that deletes combining marks."""
    return {c: None for c in range(0x300, sys.maxunicode + 1) if unicodedata.combining(chr(c))}


def folded(texts: pa.Array) -> pa.Array:
    """Texts decomposed and without marks; at most ``FOLD_ROWS`` of them exist as Python objects at a time."""
    marks, parts = _marks(), [pa.array([], pa.string())]
    for k in range(0, len(texts), FOLD_ROWS):
        part = texts.slice(k, FOLD_ROWS).to_pylist()
        parts.append(pa.array([None if t is None else unicodedata.normalize("NFKD", t).translate(marks) for t in part], pa.string()))
    out = pa.concat_arrays(parts)
    del parts
    pa.default_memory_pool().release_unused()
    return out


@F.arrow_udf(T.StringType())
def _fold(texts: pa.Array) -> pa.Array:
    return folded(texts)


def fold_accents(c: Column) -> Column:
    """Compatibility-decompose and drop combining marks.

    ASCII texts stay in the JVM: they reach the Arrow batch as nulls.
    """
    return F.coalesce(_fold(F.when(c.rlike(_NON_ASCII), c)), c)


def apply_scorer(
    df: DataFrame, scorer: Callable[[str], str], text: str = "text", out: str = "verdict"
) -> DataFrame:
    """Apply any per-text judge. A row whose call raises becomes ``error:<Type>``; the job
    goes on."""
    def guarded(value):
        try:
            return scorer(value)
        except Exception as exc:  # noqa: BLE001 - any failure of the judge is a row result
            return f"error:{type(exc).__name__}"

    @F.pandas_udf(T.StringType())
    def score(texts: pd.Series) -> pd.Series:
        return texts.astype(object).where(texts.notna(), None).map(guarded)

    return df.withColumn(out, score(F.col(text)))
