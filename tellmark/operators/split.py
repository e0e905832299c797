"""Exact stratified splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tellmark.config import SplitSpec
from tellmark.functions.hashing import key_hash
from tellmark.plans.scaling import rank_cuts


def stratified_split(
    df: DataFrame,
    key: str = "id",
    label: str = "y",
    spec: SplitSpec = SplitSpec(),
    classes: tuple = (0, 1),
) -> DataFrame:
    """Add ``split``. Each class is ordered by a seeded hash of the key (unique per row);
    the first floor(n * train) rows train, the next floor(rest * val / (1 - train)) validate.

    Only the hash values at the two cuts of each listed class are looked up first; they enter
    the plan as literals, so assigning rows is a comparison inside the scan: no join, no
    shuffle, and any later use of the frame costs no second lookup.
    """
    return _assigned(df.withColumn("_h", key_hash(spec.seed, F.col(key))), label, spec, classes)


def stratified_splits(
    df: DataFrame,
    seeds: tuple[int, ...],
    key: str = "id",
    label: str = "y",
    spec: SplitSpec = SplitSpec(),
    classes: tuple = (0, 1),
) -> DataFrame:
    """The rows once per seed, with ``seed`` and the ``split`` they have under it. The cuts of all
    seeds are looked up together, so rows should be narrow."""
    many = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    hashed = many.withColumn("_h", key_hash(F.col("seed"), F.col(key))).withColumn(
        "_group", F.concat_ws(":", F.col("seed").cast("string"), F.col(label).cast("string"))
    )
    groups = tuple(f"{s}:{c}" for s in seeds for c in classes)
    return _assigned(hashed, "_group", spec, groups).drop("_group")


def _assigned(hashed: DataFrame, group: str, spec: SplitSpec, groups: tuple) -> DataFrame:
    n_train = F.floor(F.col("n") * F.lit(spec.train))
    rest = F.col("n") - n_train
    n_val = F.floor(rest * F.lit(spec.validation / (1.0 - spec.train)))
    cuts = rank_cuts(
        hashed.where(F.col(group).isin(*groups)),
        group, "_h", {"train": n_train, "val": n_train + n_val},
    )
    name = F
    for cut in cuts:  # one row per listed group
        own = F.col(group) == cut[group]
        for part, last in (("train", cut["train"]), ("validation", cut["val"])):
            if last is not None:
                name = name.when(own & (F.col("_h") <= last), F.lit(part))
    return hashed.withColumn("split", name.when(F.col(group).isin(*groups), F.lit("test"))).drop("_h")


def split_assignment(df: DataFrame, key: str = "id") -> DataFrame:
    return df.select(key, "split")


def split_counts(df: DataFrame, label: str = "y") -> DataFrame:
    return df.groupBy(label, "split").agg(F.count(F.lit(1)).alias("n_rows"))
