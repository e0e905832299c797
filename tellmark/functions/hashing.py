"""Seeded draws. One md5 per purpose makes each draw a function of the row alone, so any
row's draw can be repeated later without replaying the rows before it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def key_hash(*parts) -> Column:
    """md5 over the parts joined by ':'; plain values become literals."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def hash_number(h: Column, digits: int = 8) -> Column:
    """The first ``digits`` hex digits (at most 15) as a non-negative long."""
    if not 1 <= digits <= 15:
        raise ValueError("digits must be between 1 and 15")
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("long")
