"""Verbatim copying of word n-grams."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tellmark.functions.text import word_ngrams
from tellmark.plans.scaling import BROADCAST_BYTES, frame_bytes, guarded_join
from tellmark.session import settle

#: Size that a filter of gram hashes has at most, bits it has for each, and bits that a hash sets.
FILTER_BYTES = 16 * 1024 * 1024
FILTER_BITS = 12
FILTER_HASHES = 4


def ngram_copy(df: DataFrame, a: str, b: str, n: int = 6, out: str = "n_copied") -> DataFrame:
    """Aligned pairs: positions of ``b`` whose n-gram occurs anywhere in ``a``.

    Stays inside the row: the distinct grams of ``a`` and all grams of ``b`` are sorted
    together, so each run starts with the ``a`` entry if there is one, and one fold counts
    the ``b`` entries of such runs. Sorting keeps long copied texts out of quadratic time.
    """
    own = F.transform(
        F.array_distinct(word_ngrams(F.col(a), n)), lambda g: F.struct(g.alias("g"), F.lit(0).alias("s"))
    )
    other = F.transform(word_ngrams(F.col(b), n), lambda g: F.struct(g.alias("g"), F.lit(1).alias("s")))
    start = F.struct(F.lit(None).cast("string").alias("g"), F.lit(0).cast("long").alias("n"))
    counted = F.aggregate(
        F.sort_array(F.concat(own, other)),
        start,
        lambda acc, x: F.struct(
            F.when(x["s"] == 0, x["g"]).otherwise(acc["g"]).alias("g"),
            (acc["n"] + F.when((x["s"] == 1) & x["g"].eqNullSafe(acc["g"]), 1).otherwise(0))
            .cast("long").alias("n"),
        ),
        lambda acc: acc["n"],
    )
    return df.withColumn(out, F.coalesce(counted, F.lit(0).cast("long")))


def _place(h: Column, i: int, bits: int) -> Column:
    return (F.xxhash64(h, F.lit(i)) if i else h).bitwiseAND(F.lit(bits - 1))


def hash_filter(hashes: DataFrame, column: str, most_bytes: int = FILTER_BYTES) -> tuple[DataFrame, int]:
    """A Bloom filter of distinct 64-bit hashes: one row with an array of 64-bit ``words``, and its number
    of bits. Tasks set bits in words, which are joined by OR before and after they travel. Beyond
    ``most_bytes`` more other hashes pass it, never fewer of its own."""
    bits = 1 << max(6, (FILTER_BITS * hashes.count() - 1).bit_length())
    bits = min(bits, 1 << (8 * most_bytes).bit_length() - 1)
    places = hashes.select(F.explode(F.array(*[_place(F.col(column), i, bits) for i in range(FILTER_HASHES)])).alias("b"))
    words = places.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(b & 63))")).alias("v")).toPandas()
    dense = np.zeros(bits // 64, np.int64)
    dense[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    return settle(hashes.sparkSession.createDataFrame([(dense.tolist(),)], "words array<bigint>"), "filter"), bits


def may_hold(words: Column, bits: int, h: Column) -> Column:
    """True for all hashes of the filter, and for about one in two hundred others."""
    places = [_place(h, i, bits) for i in range(FILTER_HASHES)]
    tests = [F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1 for at in places]
    return reduce(and_, tests)


def ngram_contamination(
    corpus: DataFrame, probe: DataFrame, key: str, n: int = 6, text: str = "text", **join_options
) -> DataFrame:
    """Per corpus text that shares any n-gram with the probe set: matching positions, distinct
    matching grams, and all positions.

    The probe's distinct grams are the measured side of a semi join, so neither pairs of
    texts nor pairs of equal grams are ever formed. Grams travel as 64-bit hashes, eight bytes
    whatever their length; for a probe of a million grams a corpus gram is taken for one of them
    by chance once in 10^13. Within the broadcast limit the corpus does not shuffle before its
    per-text sums. Beyond it, a `hash_filter` of the probe drops grams inside the row, so of those that the
    probe has not, about one in two hundred moves; the join then decides exactly, and hot grams are salted.
    """
    wanted = settle(
        probe.select(F.explode(word_ngrams(F.col(text), n)).alias("gram")).select(F.xxhash64("gram").alias("gram")).distinct()
    )
    grams = corpus.select(key, F.transform(word_ngrams(F.col(text), n), lambda g: F.xxhash64(g)).alias("_g"))
    if frame_bytes(wanted) > join_options.get("max_bytes", BROADCAST_BYTES):
        filter_row, bits = hash_filter(wanted, "gram")
        grams = grams.crossJoin(F.broadcast(filter_row))  # one row of FILTER_BYTES at most
        passed = F.filter("_g", lambda g: may_hold(F.col("words"), bits, g))
        grams = grams.select(key, F.size("_g").cast("long").alias("n_grams"), passed.alias("_g"))
    else:
        grams = grams.select(key, F.size("_g").cast("long").alias("n_grams"), "_g")
    # The outer form keeps the optimizer from testing the array for emptiness below, which
    # would build every gram a second time; the semi join drops its nulls.
    positions = grams.select(key, "n_grams", F.explode_outer("_g").alias("gram"))
    found = guarded_join(positions, wanted, ["gram"], "left_semi", **join_options)
    return (
        found.groupBy(key, "n_grams", "gram").agg(F.count(F.lit(1)).alias("_c"))
        .groupBy(key, "n_grams")
        .agg(F.sum("_c").alias("n_matched"), F.count(F.lit(1)).alias("n_distinct_matched"))
    )
