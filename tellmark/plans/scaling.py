"""Plan shapes that keep single groups and single tasks bounded.

* ``guarded_join``   broadcast behind a size check, salted shuffle join beyond it
* ``exact_rank``     row numbers inside large groups, spread over hash buckets
* ``rank_cuts``      the exact k-th smallest key per group without ranking the group
* ``running_totals`` ordered cumulative sums without a one-partition window
* ``spread``, ``fan_out``  work for every core when the input is one file or few partitions
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tellmark.session import settle

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32
#: A key with more rows than this is hot; at most so many of them are salted, AQE splits the others.
HOT_ROWS = 1_000_000
HOT_KEYS = 10_000


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value: lengths of strings and binaries, sums over the parts of nested values,
    eight for anything else."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
    if isinstance(kind, T.StructType):
        parts = [value_bytes(value.getField(f.name), f.dataType) for f in kind.fields]
        return reduce(lambda a, b: a + b, parts, F.lit(8).cast("long"))
    if isinstance(kind, T.ArrayType):
        total = F.aggregate(value, F.lit(16).cast("long"), lambda acc, x: acc + value_bytes(x, kind.elementType))
        return F.coalesce(total, F.lit(8).cast("long"))
    if isinstance(kind, T.MapType):
        halves = (F.map_keys(value), kind.keyType), (F.map_values(value), kind.valueType)
        return reduce(lambda a, b: a + b, [value_bytes(v, T.ArrayType(k)) for v, k in halves])
    return F.lit(8).cast("long")


def frame_bytes(df: DataFrame) -> int:
    """Bytes of a frame's values."""
    sizes = [value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    total = sizes[0]
    for size in sizes[1:]:
        total = total + size
    return df.agg(F.coalesce(F.sum(total.cast("long")), F.lit(0)).alias("b")).first()["b"]


def guarded_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join a large ``left`` whose keys may be skewed with a smaller ``right``.

    ``right`` is measured; within ``max_bytes`` it is broadcast and ``left`` does not move.
    Beyond that, keys with more than ``hot_rows`` rows on the left are salted: their ``left`` rows
    take the salt of their own content and only their ``right`` rows are repeated once per salt,
    so a hot key spreads over ``salts`` tasks and the rest shuffles once. All ways give the same
    rows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    if frame_bytes(right) <= max_bytes:
        return left.join(F.broadcast(right), on, how)
    own = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int")
    hot = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows)
    hot = hot.select(*on, F.lit(True).alias("_hot")).limit(HOT_KEYS)
    if hot.isEmpty():
        return left.join(right, on, how)
    hot = F.broadcast(hot)  # at most HOT_KEYS rows
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = right.join(hot, on, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    salted = left.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), own).otherwise(0)).drop("_hot")
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


def exact_rank(
    df: DataFrame, groups: list[str], order: str, tie: str, out: str = "rank", digits: int = 3
) -> DataFrame:
    """1-based row number by (``order``, ``tie``) inside each group.

    ``order`` is a hex hash, so its first digits cut every group, however large, into equal
    buckets. Rows are ranked inside (group, bucket) and shifted by the bucket's offset; the
    rows shuffle once, by (group, bucket).
    """
    bucketed = df.withColumn("_bucket", F.substring(F.col(order), 1, digits))
    keys = [*groups, "_bucket"]
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        bucketed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(order, tie))
    return (
        bucketed.withColumn("_inside", inside)
        .join(offsets, keys)
        .withColumn(out, (F.col("_inside") + F.col("_offset")).cast("long"))
        .drop("_bucket", "_inside", "_offset")
    )


def rank_cuts(
    df: DataFrame,
    group: str,
    order: str,
    cuts: dict[str, Column],
    bucket: Column | None = None,
) -> list[dict]:
    """Per group, the ``order`` value at each wanted rank: ``{group: .., cut: value, ..}``.

    ``cuts`` maps a name to an expression of ``n`` (rows in the group) giving the 1-based rank;
    rank 0 gives None. ``bucket`` must rise with ``order``; the default is the first four digits
    of a hex hash. The first job counts buckets and finds the ones that hold a wanted rank;
    the second ranks only the rows of those. What reaches the driver is one row per group and
    cut, so the caller bounds the number of groups.
    """
    bucket = F.substring(F.col(order), 1, 4) if bucket is None else bucket
    keyed = df.where(F.col(group).isNotNull()).select(group, order).withColumn("_bucket", bucket)
    whole = Window.partitionBy(group)
    upto = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.array(*[F.struct(F.lit(c).alias("cut"), e.cast("long").alias("k")) for c, e in cuts.items()])
    hits = (
        keyed.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_hi", F.sum("_n").over(upto))
        .withColumn("n", F.sum("_n").over(whole))
        .withColumn("_w", F.explode(wanted))
        .select(group, "_bucket", "_w.cut", (F.col("_w.k") - F.col("_hi") + F.col("_n")).alias("_r"), "_n")
        .where((F.col("_r") > 0) & (F.col("_r") <= F.col("_n")))
        .drop("_n")
    )
    found = hits.collect()
    # The wanted places are literals of the second job: rows outside them stop at the scan.
    place = F.concat_ws(":", F.col(group).cast("string"), F.col("_bucket").cast("string"))
    inside = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(order))
    rows = (
        keyed.where(place.isin({f"{h[group]}:{h['_bucket']}" for h in found}))
        .withColumn("_r", inside)
        .where(F.concat_ws(":", place, "_r").isin({f"{h[group]}:{h['_bucket']}:{h['_r']}" for h in found}))
        .collect()
    )
    at = {(r[group], r["_bucket"], r["_r"]): r[order] for r in rows}
    out = {h[group]: {group: h[group], **dict.fromkeys(cuts)} for h in found}
    for h in found:
        out[h[group]][h["cut"]] = at[h[group], h["_bucket"], h["_r"]]
    return list(out.values())


#: Rows that one range of a running sum takes about, and ranges that one step of the offsets takes.
RANGE_ROWS = 1_000_000
RANGES = 1024


def running_totals(
    df: DataFrame, score: str, values: list[str], descending: bool = True, by: tuple[str, ...] = (), range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Add ``cum_<v>`` for each value column, in the order of a column of distinct values (within ``by``).

    Rows are stored in ranges of about ``range_rows`` rows, so there are as many ranges as the rows
    need. Sums run inside a range and start from the total of the ranges before it, which is
    summed in two steps: over groups of ``RANGES`` ranges, and inside a group.
    """
    direction = F.desc if descending else F.asc
    stored = settle(df, "points")
    parts = -(-stored.count() // range_rows)
    if parts > 1:
        ranged = stored.repartitionByRange(parts, *by, direction(score)).withColumn("_range", F.spark_partition_id())
        stored = settle(ranged, "ranges")
    else:
        stored = stored.withColumn("_range", F.lit(0))
    keys = [*by, "_range"]
    inside = Window.partitionBy(*keys).orderBy(direction(score)).rowsBetween(Window.unboundedPreceding, 0)
    out = stored.select("*", *[F.sum(v).over(inside).alias(f"cum_{v}") for v in values])
    if parts <= 1:
        return out.drop("_range")
    starts = stored.groupBy(*keys).agg(*[F.sum(v).alias(f"_t_{v}") for v in values]).withColumn("_group", F.floor(F.col("_range") / RANGES))
    groups = starts.groupBy(*by, "_group").agg(*[F.sum(f"_t_{v}").alias(f"_t_{v}") for v in values])

    def before(frame: DataFrame, within: list[str], order: str, prefix: str) -> DataFrame:
        w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return frame.select("*", *[F.coalesce(F.sum(f"_t_{v}").over(w), F.lit(0)).alias(f"{prefix}{v}") for v in values])

    far, near = before(groups, [*by], "_group", "_f_"), before(starts, [*by, "_group"], "_range", "_n_")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_group")]
    offsets = near.alias("a").join(far.alias("b"), reduce(and_, same)).select(
        *[f"a.{c}" for c in keys], *[(F.col(f"_f_{v}") + F.col(f"_n_{v}")).alias(f"_s_{v}") for v in values]
    )
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    joined = out.alias("a").join(offsets.alias("b"), reduce(and_, same))
    return joined.select(
        *[f"a.{c}" for c in df.columns], *[(F.col(f"cum_{v}") + F.col(f"_s_{v}")).alias(f"cum_{v}") for v in values]
    )


def spread(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Hash-partition by ``key`` into ``partitions``, for a small table that is one file and so
    one task however heavy the text work on it. Without a number the table stays as it is."""
    return df.repartition(partitions, key) if partitions else df


def fan_out(stored: DataFrame, key: str) -> DataFrame:
    """Give every core a part of a stored frame that came out in fewer partitions, for work
    that multiplies its rows."""
    cores = stored.sparkSession.sparkContext.defaultParallelism
    return stored.repartition(cores, key) if stored.rdd.getNumPartitions() < cores else stored
