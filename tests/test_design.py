"""Manifest, draws, examples, prompts, grading, resume, copying, streaming."""

from collections import Counter

import pytest
from pyspark.sql import functions as F, types as T

from tellmark import config as cfg
from tellmark.config import AttemptSpec, Design, ExampleSpec
from tellmark.functions.text import word_ngrams
from tellmark.operators import copying, design as ds, grading
from tellmark.plans.views import TEMPLATES
from tellmark.streaming import ingest

DESIGN = Design()


@pytest.fixture(scope="module")
def items(spark):
    return ds.item_index(spark.createDataFrame([(f"h{i:02d}",) for i in range(20)] * 2, "c string"), "c")


@pytest.fixture(scope="module")
def manifest(spark, items):
    return ds.factorial_manifest(spark, cfg.AXES, items, total=200)


def test_even_split_and_rotation(manifest):
    rows = sorted(manifest.collect(), key=lambda r: r["ordinal"])
    sizes = Counter(r["cell_ord"] for r in rows)
    assert [sizes[i] for i in range(16)] == [13] * 8 + [12] * 8
    assert all(r["item"] == f"h{r['ordinal'] % 20:02d}" for r in rows)
    assert rows[13]["cell_ord"] == 1 and rows[13]["rep_index"] == 0
    assert rows[0]["cell_id"] == "short_positive_structured_few_shot"
    assert rows[-1]["cell_id"] == "long_negative_unstructured_zero_shot"


def test_fewer_rows_than_cells_and_per_cell(spark, items):
    few = ds.factorial_manifest(spark, cfg.AXES, items, total=5).collect()
    assert sorted(r["cell_ord"] for r in few) == [0, 1, 2, 3, 4]
    each = ds.factorial_manifest(spark, cfg.AXES, items, per_cell=2)
    assert each.count() == 32 and each.select("cell_id").distinct().count() == 16


def test_cell_filter_keeps_the_same_rows(spark, items, manifest):
    part = ds.factorial_manifest(spark, cfg.AXES, items, total=200, cells="long_positive*").collect()
    whole = {r["ordinal"]: r for r in manifest.collect()}
    assert len(part) == 48 and all(whole[r["ordinal"]] == r for r in part)


def test_draws(manifest):
    rows = ds.instructions(manifest, DESIGN).collect()
    for r in rows:
        if r["structure"] == "structured":
            assert len(set(r["aspects"])) == 4 and r["aspects"] == sorted(r["aspects"])
        else:
            assert r["aspects"] == []
    assert {r["opener_move"] for r in rows} == {m for m, _ in cfg.OPENER_MOVES}


def test_opener_weights(spark):
    rows = spark.range(13000).select(ds.draw_opener(DESIGN, F.lit("c"), F.col("id")).alias("m"))
    seen = Counter(r["m"] for r in rows.collect())
    for move, weight in cfg.OPENER_MOVES:
        assert abs(seen[move] - 1000 * weight) < 200


def test_examples_follow_the_fallbacks(spark, manifest):
    spec = ExampleSpec()
    rows = [(i, "real", "TripAdvisor", "h01", "x" * (10 + i)) for i in range(8)]
    rows += [(20, "real", "TripAdvisor", "h02", "y" * 5), (21, "real", "TripAdvisor", "h02", "y" * 50)]
    rows += [(30, "fake", "MTurk", "h09", " only fake "), (31, "fake", "MTurk", "h09", None)]
    corpus = spark.createDataFrame(rows, "id long, Binary_label string, source string, Category string, text string")
    pool = ds.example_pool(corpus, spec).collect()
    ids = lambda scope, length: {r["id"] for r in pool if (r["pool"], r["scope"], r["length"]) == ("real_positive", scope, length)}
    assert ids("h01", "short") == {0, 1} and ids("h01", "long") == {2, 3, 4, 5}
    # Two texts: neither lies inside the middle band, so the band is dropped.
    assert ids("h02", "short") == {20} and ids("h02", "long") == {20, 21}
    picks = ds.pick_examples(manifest, ds.example_pool(corpus, spec), corpus).collect()
    assert len(picks) == 200
    for r in picks:
        if r["example_mode"] == "zero_shot":
            assert (r["real_example"], r["fake_example"]) == ("", "")
        else:
            assert r["fake_example"] == "only fake" and r["fake_id"] == 30
            if r["sentiment"] == "negative":
                assert r["real_example"] == ""
            elif r["item"] == "h01":
                assert r["real_id"] in ids("h01", r["length"])
            elif r["item"] == "h02":
                assert r["real_id"] in ids("h02", r["length"])
            else:
                assert r["real_id"] in ids("", r["length"])
    prompts = ds.prompt_table(
        ds.instructions(ds.pick_examples(manifest, ds.example_pool(corpus, spec), corpus), DESIGN), TEMPLATES, DESIGN
    ).collect()
    for r in prompts:
        whole = r["example_mode"] == "few_shot" and r["sentiment"] == "positive"
        assert r["user"].startswith("First:") == whole and (whole or r["user"] == "Begin.")
        assert ("within 130 and 270" in r["system"]) == (r["length"] == "short")


def replay_rows(manifest):
    return ds.instructions(manifest, DESIGN).select(
        "cell_id", "rep_index", F.col("item").alias("Category"), "opener_move", F.lit(12).alias("gen_seed")
    )


def test_replay_equals_manifest(spark, items, manifest):
    for r in ds.replay_check(replay_rows(manifest), items, DESIGN, spark).collect():
        assert r["n_rows"] == r["n_category_ok"] == r["n_opener_ok"] and r["n_seeds"] == 1


def test_replay_of_two_seeds_is_skipped(spark, items, manifest):
    mixed = replay_rows(manifest).withColumn("gen_seed", F.when(F.col("rep_index") == 0, 12).otherwise(13))
    rows = ds.replay_check(mixed, items, DESIGN, spark).collect()
    assert all(r["n_category_ok"] is None and r["n_seeds"] == 2 for r in rows)


def test_resume(manifest):
    assert grading.remaining_work(manifest, manifest).count() == 0
    assert grading.remaining_work(manifest, manifest, by="count").count() == 0
    cell = "short_positive_structured_few_shot"
    done = manifest.where((F.col("cell_id") == cell) & (F.col("rep_index") != 3))
    left = lambda by: [r["rep_index"] for r in grading.remaining_work(manifest, done, by).where(F.col("cell_id") == cell).collect()]
    assert left("id") == [3] and left("count") == [12]


def test_best_attempt(spark):
    w = lambda n, tail=".": " ".join(["word"] * n) + tail
    rows = [
        ("in_band", 1, w(60)), ("in_band", 2, w(40)), ("in_band", 3, w(41)),
        ("nearest", 1, w(10)), ("nearest", 2, w(20)), ("nearest", 3, w(20, "!")),
        ("failed", 1, w(3)), ("failed", 2, w(12) + " 前台"), ("failed", 3, ""),
        ("long", 1, w(20) + " " + w(200)),
    ]
    df = spark.createDataFrame(rows, "sample string, attempt_no int, text string")
    got = {r["sample"]: r for r in grading.best_attempt(df, ["sample"], F.lit(130), F.lit(270)).collect()}
    assert got["in_band"]["text"] == w(40) and got["in_band"]["n_attempts"] == 2
    assert got["nearest"]["text"] == w(20) and got["nearest"]["n_attempts"] == 3
    assert got["failed"]["text"] is None and got["failed"]["error"] == "output too short (0 words)"
    assert got["long"]["text"] == w(20)
    kept = grading.best_attempt(df, ["sample"], F.lit(130), F.lit(270), AttemptSpec(trim_overlong=False))
    assert kept.where("sample = 'long'").first()["text"] == rows[-1][2]


def test_ngram_copy(spark):
    def plain(a, b, n):
        a, b = a.lower().split(), b.lower().split()
        seen = {tuple(a[i : i + n]) for i in range(len(a) - n + 1)}
        return sum(tuple(b[i : i + n]) in seen for i in range(len(b) - n + 1))

    pairs = [("a b c d e f g", "x a b c d e f g"), ("a a a a a a a", "a a a a a a a a a"), ("a b", "a b c d e f"), ("", ""), ("A B C D E F", "a b c d e f")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for n in (1, 2, 6):
        got = copying.ngram_copy(df, "a", "b", n).orderBy("i").collect()
        assert [r["n_copied"] for r in got] == [plain(a, b, n) for a, b in pairs]


def test_filter_drops_grams_before_they_move(spark):
    """Beyond the broadcast limit only grams of the probe, and few others, leave the rows."""
    corpus = spark.range(400).select("id", F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id").cast("string")) for k in range(60)]).alias("text"))
    probe = corpus.where("id % 100 = 0")
    rows = copying.ngram_contamination(corpus, probe, "id", 3, max_bytes=0)
    assert sorted((r["id"], r["n_matched"], r["n_grams"]) for r in rows.collect()) == [(i, 58, 58) for i in range(0, 400, 100)]
    wanted = probe.select(F.explode(word_ngrams(F.col("text"), 3)).alias("g")).select(F.xxhash64("g").alias("gram")).distinct()
    words, bits = copying.hash_filter(wanted, "gram")
    grams = corpus.select(F.explode(word_ngrams(F.col("text"), 3)).alias("g")).select(F.xxhash64("g").alias("gram")).crossJoin(F.broadcast(words))
    passed = grams.where(copying.may_hold(F.col("words"), bits, F.col("gram"))).count()
    assert 4 * 58 <= passed <= 4 * 58 + 400 * 58 * 0.02
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("filter(") and "getbit" in plan.lower()
    small, few = copying.hash_filter(wanted, "gram", most_bytes=8)
    assert few == 64 and grams.drop("words").join(wanted, "gram").crossJoin(F.broadcast(small)).where(~copying.may_hold(F.col("words"), few, F.col("gram"))).isEmpty()


def test_contamination_with_a_hot_gram_is_the_same_salted(spark):
    corpus = spark.createDataFrame([(i, "one two three " + str(i % 5)) for i in range(60)], "id long, text string")
    probe = spark.createDataFrame([("zero one two three",), ("two three 4",)], "text string")
    small = copying.ngram_contamination(corpus, probe, "id", 3)
    large = copying.ngram_contamination(corpus, probe, "id", 3, max_bytes=0)
    rows = sorted(map(tuple, small.collect()))
    assert rows == sorted(map(tuple, large.collect()))
    assert len(rows) == 60 and sum(r[2] for r in rows) == 60 + 12


def test_output_rows_have_the_stored_schema(manifest):
    collected = ds.instructions(manifest, DESIGN).select(
        "*", F.lit("word " * 40).alias("text"), F.lit(2).alias("n_attempts"), F.lit(130).alias("lo"),
        F.lit(270).alias("hi"), F.lit(200).alias("target_chars"), F.lit(12).alias("gen_seed"),
    )
    out = grading.output_rows(collected, "m:1", 1.0, "Hotel")
    assert tuple(out.columns) == cfg.GENERATED_COLUMNS
    assert out.first()["in_length_band"] == 1


STREAM = T.StructType(
    [T.StructField(c, t) for c, t in (
        ("cell_id", T.StringType()), ("rep_index", T.IntegerType()), ("model", T.StringType()),
        ("text", T.StringType()), ("timestamp", T.TimestampType()),
    )]
)


@pytest.mark.parametrize("files", [1, 3])
def test_stream_gives_the_same_sink_in_one_batch_or_several(spark, tmp_path, files):
    rows = spark.range(30).select(
        F.concat(F.lit("c"), F.col("id") % 3).alias("cell_id"), (F.col("id") % 12).cast("int").alias("rep_index"),
        F.lit("m").alias("model"),
        F.when(F.col("id") % 12 == 5, "short").otherwise(F.repeat(F.lit("word "), 30)).alias("text"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("id") % 12).alias("timestamp"),
    )
    source = str(tmp_path / "in")
    rows.repartition(files, "cell_id").write.parquet(source)

    def run():
        texts = ingest.read_stream(spark, source, STREAM, files_per_batch=1)
        ingest.stream_ingest(texts, str(tmp_path / "out"), 130, 270).awaitTermination()
        keys = lambda kind: sorted((r["cell_id"], r["rep_index"]) for r in ingest.read_sink(spark, str(tmp_path / "out"), kind).collect())
        return keys("accepted"), keys("failed")

    first = run()
    assert first[0] == sorted({(f"c{i % 3}", i % 12) for i in range(30) if i % 12 != 5})
    assert first[1] == [("c2", 5)]
    assert run() == first


@pytest.mark.parametrize("order", [(10, 11, 1, 2), (1, 2, 10, 11)])
def test_stream_loses_no_text_out_of_time_order(spark, tmp_path, order):
    """Files whose times go back by more than any delay, one file a batch."""
    source = str(tmp_path / "in")
    for n, day in enumerate(order):
        spark.range(5).coalesce(1).select(
            F.lit(f"day{day}").alias("cell_id"), F.col("id").cast("int").alias("rep_index"), F.lit("m").alias("model"),
            F.when(F.col("id") == 0, "short").otherwise(F.repeat(F.lit("word "), 30)).alias("text"),
            F.timestamp_seconds(F.lit(1700000000 + day * 86400) + F.col("id")).alias("timestamp"),
        ).write.mode("append").parquet(source)
    texts = ingest.read_stream(spark, source, STREAM, files_per_batch=1)
    ingest.stream_ingest(texts, str(tmp_path / "out"), 130, 270).awaitTermination()
    assert ingest.read_sink(spark, str(tmp_path / "out"), "accepted").count() == 16
    assert ingest.read_sink(spark, str(tmp_path / "out"), "failed").count() == 4


def test_replay_keeps_rows_of_unknown_cells_and_compares_aspects(spark):
    design = cfg.Design()
    items = ds.item_index(spark.createDataFrame([(f"h{i}",) for i in range(7)], "item string"), "item")
    planned = ds.instructions(ds.factorial_manifest(spark, design.axes, items, total=200), design)
    rows = planned.withColumn("Category", F.col("item")).withColumn("gen_seed", F.lit(design.seed))
    stray = F.col("ordinal") % 10 == 0
    rows = rows.withColumn("cell_id", F.when(stray, "elsewhere").otherwise(F.col("cell_id")))
    got = ds.replay_check(rows.drop("item"), items, design, spark).collect()
    assert sum(r["n_rows"] for r in got) == 200
    other = next(r for r in got if r["cell_id"] == "elsewhere")
    assert (other["n_category_ok"], other["n_opener_ok"], other["n_aspects_ok"]) == (0, 0, 0)
    assert all(r["n_aspects_ok"] == r["n_rows"] for r in got if r["cell_id"] != "elsewhere")


def test_blank_category_counts_once_in_the_whole_pool(spark):
    rows = [(1, "a text", "", "real", "en"), (2, "b text", "", "real", "en")]
    corpus = spark.createDataFrame(rows, "id long, text string, Category string, Binary_label string, source string")
    spec = cfg.ExampleSpec(real_source_by_sentiment={"positive": "en"}, fake_source="en")
    pool = ds.example_pool(corpus, spec).where("length = 'short'").collect()
    assert sorted(r["id"] for r in pool) in ([1], [2], [1, 2]) and {r["size"] for r in pool} == {len(pool)}


def test_chain_names_the_first_step_that_differs(spark):
    schema = "cell_id string, rep_index int, item string, opener_move string, aspects array<string>, real_id long, fake_id long, system string, user string"
    row = ("c", 0, "a", "o", ["x", "y"], 1, None, "s", "u")
    plan = spark.createDataFrame([row, (*row[:1], 1, *row[2:])], schema)
    other = [
        ("item", (*row[:2], "b", *row[3:])), ("item", (*row[:2], None, "p", *row[4:])), ("opener", (*row[:3], "p", *row[4:])),
        ("aspects", (*row[:4], ["x"], 2, *row[6:])), ("aspects", (*row[:4], None, *row[5:])), ("examples", (*row[:6], 5, "t", "u")),
        ("prompt", (*row[:7], None, "u")), ("prompt", (*row[:8], "")), ("", row), ("missing", ("d", *row[1:])),
    ]
    for want, recorded in other:
        got = ds.replay_prompts(ds.step_chain(spark.createDataFrame([recorded], schema)), ds.step_chain(plan)).collect()
        assert [r["first_difference"] for r in got] == [want]
