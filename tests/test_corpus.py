"""Sources, sinks, audit, split, features."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tellmark import config as cfg
from tellmark.config import SplitSpec, VectorSpec
from tellmark.operators import audit, reports, split as sp, tfidf as tv
from tellmark.sources import corpus as src, sinks


@pytest.fixture(scope="module")
def balanced(spark):
    return spark.range(1592).select("id", (F.col("id") % 2).cast("int").alias("y"))


def test_split_sizes_are_exact_disjoint_and_complete(balanced):
    rows = sp.stratified_split(balanced)
    counts = {(r["y"], r["split"]): r["n_rows"] for r in sp.split_counts(rows).collect()}
    for y in (0, 1):
        assert [counts[y, s] for s in ("train", "validation", "test")] == [557, 119, 120]
    assert rows.select("id").distinct().count() == 1592


def test_split_does_not_depend_on_partitions_but_on_seed(balanced):
    key = lambda df: sorted((r["id"], r["split"]) for r in df.collect())
    first = key(sp.stratified_split(balanced))
    assert key(sp.stratified_split(balanced.repartition(7))) == first
    assert key(sp.stratified_split(balanced, spec=SplitSpec(seed=43))) != first


def test_split_of_a_tiny_class(spark):
    rows = spark.createDataFrame([(i, int(i == 0)) for i in range(10)], "id long, y int")
    got = {(r["y"], r["split"]): r["n_rows"] for r in sp.split_counts(sp.stratified_split(rows)).collect()}
    assert got == {(0, "train"): 6, (0, "validation"): 1, (0, "test"): 2, (1, "test"): 1}


def test_csv_round_trip_with_quotes_newlines_and_column_order(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        'source,text,Binary_label,Category,is_synthetic\nWeb,"two\nlines, ""quoted""",real,h1,0\n', encoding="utf-8"
    )
    row = src.read_corpus(spark, str(tmp_path / "c.csv"), multi_line=True).first()
    assert row["text"] == 'two\nlines, "quoted"' and row["is_synthetic"] == 0 and row["Binary_label"] == "real"


def test_files_with_another_header_are_an_error(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1.csv").write_text("Binary_label,text,Category,source\nreal,T1,h,Web\n")
    (tmp_path / "c" / "2.csv").write_text("text,Binary_label,Category,source\nT2,fake,h,Web\n")
    with pytest.raises(Exception, match="header"):
        src.read_corpus(spark, str(tmp_path / "c")).collect()


def test_missing_column_is_an_error(spark, tmp_path):
    (tmp_path / "c.csv").write_text("text,source\na,b\n")
    with pytest.raises(ValueError, match="Binary_label"):
        src.read_corpus(spark, str(tmp_path / "c.csv"))


def test_require_clean(spark):
    frame = lambda rows: spark.createDataFrame(rows, "text string, label string")
    audit.require_clean(frame([("a", "x"), ("b", "y")]))
    with pytest.raises(ValueError, match="no text or no label"):
        audit.require_clean(frame([(None, "x"), ("b", "y")]))
    with pytest.raises(ValueError, match="1 values, not 2"):
        audit.require_clean(frame([("a", "x"), ("b", "x")]))
    assert audit.drop_null_text(frame([(None, "x"), ("b", "y")])).count() == 1


def test_normalize_labels(spark):
    rows = spark.createDataFrame([("  x\n", "FAKE"), ("y", "other"), ("z", "fake")], "text string, label string")
    got = audit.normalize_labels(rows).collect()
    assert [(r["text"], r["y"]) for r in got] == [("x", 1), ("y", 0), ("z", 1)]


def test_leakage_scan_findings(spark):
    rows = [(i, "fake" if i % 2 else "real", "m" if i % 2 else None, "c", "ab"[i % 2], "pq"[i // 10]) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, label string, model string, domain string, source string, free string")
    got = {r["column"]: r for r in audit.leakage_scan(df, ["id", "model", "domain", "source", "free"]).collect()}
    flags = lambda c: tuple(got[c][f] for f in ("is_constant", "near_unique", "perfect_predictor", "null_predictor"))
    assert flags("id") == (0, 1, 1, 0)  # the raw flag beside near_unique
    assert flags("model") == (0, 0, 1, 1)
    assert flags("domain") == (1, 0, 0, 0)
    assert flags("source") == (0, 0, 1, 0)
    assert flags("free") == (0, 0, 0, 0)
    assert audit.drop_leaky(df, cfg.LEAKY_COLUMNS).columns == ["id", "label", "domain", "source", "free"]


def test_sinks(spark, tmp_path):
    assert len(cfg.GENERATED_COLUMNS) == 21
    rows = spark.range(4).select(
        *[
            (F.lit("a:b/c") if f.name == "model" else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in src.GENERATED_SCHEMA.fields
        ]
    )
    out = str(tmp_path / "gen")
    sinks.write_generated(rows, out)
    sinks.write_generated(rows, out)
    back = src.read_generated(spark, out)
    assert back.count() == 8 and tuple(back.columns) == cfg.GENERATED_COLUMNS
    assert back.first()["model"] == "a:b/c"
    failures = spark.createDataFrame(
        [("c", 1, "h", "m", "output too short (0 words)", None)], src.FAILURE_SCHEMA
    )
    sinks.write_failures(failures, str(tmp_path / "f"))
    assert src.read_failures(spark, str(tmp_path / "f")).first()["error"] == "output too short (0 words)"
    sinks.write_metrics(spark.createDataFrame([(0.5,)], "f1 double"), str(tmp_path / "m"))
    assert spark.read.schema("f1 double").json(str(tmp_path / "m")).first()["f1"] == 0.5
    sinks.write_split(spark.createDataFrame([(7, "train")], "id long, split string"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).first()["id"] == 7


DOCS = ["the cat sat on the mat the cat", "the dog sat", "a cat, a dog; the END", "", "unseen words only here", "the the the"]


def test_tfidf_against_brute_force(spark):
    df = spark.createDataFrame(
        [(i, t, "test" if i == 4 else "train") for i, t in enumerate(DOCS)], "id long, text string, split string"
    )
    spec = VectorSpec(min_df=2, max_df=0.75, cap=4)
    tf = tv.term_frequency(df, spec=spec, keep=("split",))
    grams = {}
    for i, t in enumerate(DOCS):
        ts = re.findall(r"\w\w+", t.lower())
        grams[i] = Counter(ts + [f"{a} {b}" for a, b in zip(ts, ts[1:])])
    assert {(r["id"], r["term"]): r["tf"] for r in tf.collect()} == {
        (i, g): n for i, c in grams.items() for g, n in c.items()
    }
    train = [0, 1, 2, 3, 5]
    df_of = Counter(g for i in train for g in grams[i])
    cf_of = sum((grams[i] for i in train), Counter())
    kept = [g for g in df_of if 2 <= df_of[g] <= 0.75 * len(train)]
    kept = sorted(sorted(kept, key=lambda g: (-cf_of[g], g))[:4])
    vocab = tv.vocabulary(tf.where("split = 'train'"), len(train), spec)
    assert {r["term"]: r["term_id"] for r in vocab.collect()} == {g: k for k, g in enumerate(kept)}
    idf = {g: math.log((1 + len(train)) / (1 + df_of[g])) + 1 for g in kept}
    got = {(r["id"], r["term"]): r["weight"] for r in tv.tfidf(tf, vocab).collect()}
    want = {}
    for i in grams:
        w = {g: (1 + math.log(grams[i][g])) * idf[g] for g in kept if g in grams[i]}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want.update({(i, g): x / norm for g, x in w.items()})
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_vocabulary_sees_train_rows_only(spark):
    base = [(0, "aa bb", "train"), (1, "aa bb", "train")]
    more = base + [(2, "zz zz zz aa", "test"), (3, "zz aa", "validation")]
    spec = VectorSpec(max_df=1.0)

    def fit(rows):
        tf = tv.term_frequency(spark.createDataFrame(rows, "id long, text string, split string"), keep=("split",))
        return sorted(map(str, tv.vocabulary(tf.where("split = 'train'"), 2, spec).collect()))

    assert fit(base) == fit(more)


def test_bootstrap_refuses_a_larger_sample(spark):
    df = spark.createDataFrame([(i, "I went") for i in range(3)], "id long, text string")
    with pytest.raises(ValueError, match="reference of at least as many"):
        reports.opener_bootstrap(df, df.where("id < 2"), "id")


def test_bootstrap_of_the_whole_population_sees_every_opener(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(["I a", "We b", "The c", "I d"])], "id long, text string")
    row = reports.opener_bootstrap(df, df, "id", draws=5).first()
    assert (row["lo"], row["hi"], row["observed"], row["inside"]) == (3.0, 3.0, 3, 1)


def test_gate_raises(spark):
    df = spark.createDataFrame([("generated", "odd ~"), ("real", "odd"), ("fake", "odd")], "class string, text string")
    gate = reports.dataset_gate(df, "generated")
    assert gate.first().asDict() == {"n_separators": 1, "n_impure": 0, "passed": 0}
    with pytest.raises(ValueError, match="1 separators"):
        reports.require_gate(gate)


def test_splits_of_several_seeds_equal_single_ones(balanced):
    many = sp.stratified_splits(balanced.select("id", "y"), (42, 7))
    for seed in (42, 7):
        one = sp.stratified_split(balanced, spec=SplitSpec(seed=seed)).select("id", "split")
        assert sorted(map(tuple, many.where(F.col("seed") == seed).select("id", "split").collect())) == sorted(map(tuple, one.collect()))
