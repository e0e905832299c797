"""Both ways of every guarded shape give the same rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tellmark import session
from tellmark.plans import scaling
from tellmark.plans.scaling import exact_rank, frame_bytes, guarded_join, rank_cuts, running_totals


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key."""
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(40)}") for i in range(900)]
    return spark.createDataFrame(rows, "id long, key string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_guarded_join_salted_equals_broadcast(spark, skewed, how):
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("k3", 3), ("none", 4)], "key string, v int")
    small = guarded_join(skewed, right, ["key"], how)
    large = guarded_join(skewed, right, ["key"], how, max_bytes=0, salts=7, hot_rows=100)
    plain = guarded_join(skewed, right, ["key"], how, max_bytes=0)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect())) == sorted(map(str, plain.collect()))


def test_frame_bytes(spark):
    assert frame_bytes(spark.createDataFrame([("ab", 1), (None, 2)], "s string, n long")) == 18
    nested = spark.createDataFrame([(["ab", None], {"k": "vvv"}, (b"1234", 2))], "a array<string>, m map<string,string>, s struct<b:binary,i:int>")
    assert frame_bytes(nested) == (16 + 2) + (16 + 1 + 16 + 3) + (8 + 4 + 8)


def test_exact_rank(spark, skewed):
    ranked = exact_rank(skewed.withColumn("h", F.md5(F.col("id").cast("string"))), ["key"], "h", "id")
    groups = {}
    for r in ranked.collect():
        groups.setdefault(r["key"], []).append((r["h"], r["rank"]))
    for rows in groups.values():
        assert [rank for _, rank in sorted(rows)] == list(range(1, len(rows) + 1))


def test_rank_cuts(spark, skewed):
    hashed = skewed.withColumn("h", F.md5(F.col("id").cast("string")))
    cuts = rank_cuts(hashed, "key", "h", {"first": F.lit(1), "half": F.floor(F.col("n") / 2), "none": F.lit(0)})
    want = {}
    for r in hashed.collect():
        want.setdefault(r["key"], []).append(r["h"])
    assert len(cuts) == len(want)
    for c in cuts:
        hs = sorted(want[c["key"]])
        assert c["first"] == hs[0] and c["none"] is None
        assert c["half"] == (hs[len(hs) // 2 - 1] if len(hs) > 1 else None)


@pytest.mark.parametrize("range_rows", [7, 40, 10**6])
@pytest.mark.parametrize("ranges", [2, 1024])
@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(spark, monkeypatch, range_rows, ranges, descending):
    monkeypatch.setattr(scaling, "RANGES", ranges)
    rng = random.Random(2)
    rows = [(g, float(s), rng.randrange(5)) for g in ("a", "b", None) for s in rng.sample(range(1000), 120)]
    got = running_totals(spark.createDataFrame(rows, "g string, s double, v long"), "s", ["v"], descending, ("g",), range_rows)
    total, want = {}, {}
    for g, s, v in sorted(rows, key=lambda r: r[1], reverse=descending):
        total[g] = total.get(g, 0) + v
        want[g, s] = total[g]
    assert {(r["g"], r["s"]): r["cum_v"] for r in got.collect()} == want
    assert got.columns == ["g", "s", "v", "cum_v"]


def test_ranges_follow_the_rows(spark):
    """Ten times the rows are ten times the ranges, not larger ones."""
    sizes = []
    for n in (2000, 20_000):
        df = spark.range(n).select(F.rand(3).alias("s"), F.lit(1).alias("v"))
        plan = running_totals(df, "s", ["v"], range_rows=500)._jdf.queryExecution().executedPlan().toString()
        path = re.search(r"(file:[^\]]*ranges-[0-9a-f]+)", plan)[1]
        rows = spark.read.parquet(path).groupBy("_range").count().collect()
        sizes.append((len(rows), max(r["count"] for r in rows)))
    assert sizes[1][0] > 5 * sizes[0][0] and sizes[1][1] < 3 * 500


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return default if key == "spark.checkpoint.dir" else "/w"

    class Session:
        def __init__(self, master):
            self.conf, self.sparkContext = Conf(), type("C", (), {"master": master})

    assert session.shared_dir(Session("local[4]")) == session.shared_dir(Session("local")) == "/w/tellmark-shared"
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://h:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(Session(master))
