"""Every operator as a query over the given tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from tellmark import config as cfg
from tellmark.config import AttemptSpec, VectorSpec
from tellmark.functions import text as tx
from tellmark.functions.udfs import apply_scorer
from tellmark.operators import (
    audit, copying, design as ds, grading, learn, metrics as mx, reports, split as sp, tfidf as tv,
)
from tellmark.plans import views as v
from tellmark.session import settle, shared_dir
from tellmark.sources.corpus import require_columns
from tellmark.streaming import ingest

RAW = AttemptSpec(normalize=False)
QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


documents = v.documents


def raw_documents(spark, d):
    return documents(spark, d).select("doc_id", v.decorated(F.col("text"), F.col("doc_id")).alias("text"))


# ---- sources, audit, leakage ----------------------------------------------


@query
def read_corpus(spark, d):
    return require_columns(v.corpus(spark, d)).select("id", "Binary_label", "Category", "source", "text")


@query
def route_failures(spark, d):
    graded = grading.best_attempt(v.turns(spark, d), ["conv_id", "cell_id"], F.col("lo"), F.col("hi"), RAW)
    sink = F.when(F.col("error").isNull(), "accepted").otherwise("failed")
    return graded.select("conv_id", sink.alias("sink"), "n_attempts", "error")


@query
def null_audit(spark, d):
    wide = documents(spark, d).join(v.table(spark, d, "labels"), "doc_id", "left")
    return audit.null_audit(wide, ("text", "quality"))


@query
def normalize_labels(spark, d):
    padded = v.corpus(spark, d).select(
        "id",
        F.concat(F.lit("\u00a0 \n"), "text", F.lit("\t\u3000")).alias("text"),
        F.when(F.col("id") % 2 == 0, F.upper("Binary_label")).otherwise(F.col("Binary_label")).alias("label"),
    )
    return audit.normalize_labels(padded).select("id", "text", "label", "y")


@query
def corpus_audit(spark, d):
    return audit.corpus_audit(v.corpus(spark, d).withColumnRenamed("Binary_label", "label"))


@query
def source_label_crosstab(spark, d):
    return audit.source_label_crosstab(v.corpus(spark, d), label="Binary_label")


def merged(spark, d):
    human = v.corpus(spark, d).select(
        F.col("id"), "Binary_label", "Category", "domain", "text", "is_synthetic", "source"
    )
    generated = v.generated_rows(spark, d).select(
        "id", F.lit("generated").alias("Binary_label"), "Category", F.lit("text").alias("domain"),
        "text", F.lit(1).alias("is_synthetic"), "model", "cell_id", "rep_index",
    )
    return audit.merge_corpora(human, generated)


@query
def merge_corpora(spark, d):
    return merged(spark, d).withColumn("rep_index", F.col("rep_index").cast("string"))


@query
def leakage_scan(spark, d):
    two = merged(spark, d).withColumn(
        "label", F.when(F.col("Binary_label") == "generated", "generated").otherwise("human")
    )
    return audit.leakage_scan(
        two, ["Category", "domain", "is_synthetic", "source", "model", "cell_id", "id"]
    )


@query
def split_overlap(spark, d):
    return audit.split_overlap(sp.stratified_split(v.corpus(spark, d)))


# ---- text functions --------------------------------------------------------


@query
def text_counts(spark, d):
    text = F.col("text")
    return documents(spark, d).select("doc_id", tx.n_chars(text).alias("n_chars"), tx.n_words(text).alias("n_words"))


@query
def clean_response(spark, d):
    return raw_documents(spark, d).select("doc_id", tx.clean_response(F.col("text"), normalize=False).alias("text"))


@query
def fold_typography(spark, d):
    return raw_documents(spark, d).select("doc_id", tx.fold_typography(F.col("text")).alias("text"))


@query
def fold_accents(spark, d):
    return documents(spark, d).select("doc_id", tx.fold_accents(F.col("text")).alias("text"))


@query
def stray_characters(spark, d):
    return raw_documents(spark, d).select("doc_id", tx.stray_characters(F.col("text")).alias("stray"))


@query
def trim_to_sentence(spark, d):
    return documents(spark, d).select("doc_id", tx.trim_to_sentence(F.col("text"), 945).alias("text"))


@query
def length_band(spark, d):
    lo, hi = tx.length_band(700, 0.35)
    n = F.length("text")
    return documents(spark, d).select(
        "doc_id",
        F.lit(lo).alias("lo"), F.lit(hi).alias("hi"),
        n.between(lo, hi).cast("int").alias("in_band"),
        tx.band_distance(n, F.lit(lo), F.lit(hi)).alias("distance"),
    )


@query
def opener_words(spark, d):
    return raw_documents(spark, d).select("doc_id", tx.opener_word(F.col("text")).alias("opener"))


@query
def aspect_tags(spark, d):
    hits = tx.aspect_hits(F.col("text"))
    return documents(spark, d).select(
        "doc_id", F.array_join(hits, "|").alias("aspects"), F.size(hits).alias("n_aspects")
    )


@query
def word_ngrams(spark, d):
    return documents(spark, d).select("doc_id", tx.word_ngrams(F.col("text"), 6).alias("g")).select(
        "doc_id", F.size("g").alias("n_grams"), F.md5(F.array_join("g", "|")).alias("grams_md5")
    )


@query
def filter_cells(spark, d):
    return ds.factorial_manifest(
        spark, v.DESIGN.axes, ds.item_index(v.table(spark, d, "documents"), "source"),
        total=v.table(spark, d, "documents").count(), cells="long_*_few_shot",
    ).select("cell_id", "rep_index", "item")


@query
def parse_verdict(spark, d):
    return judged(spark, d).select("id", "raw", "verdict")


def judged(spark, d):
    """A judge's raw answers, from the labels: agreement, disagreement and failed calls."""
    raw = (
        F.when((F.col("y") == 1) & (F.col("toxic") == 1), "error:Timeout")
        .when(F.col("toxic") == 1, "No idea")
        .when(F.col("y") == 0, " Positive.\n")
        .otherwise("It is NEGATIVE")
    )
    asked = F.when(F.col("id") % 3 == 0, "negative").otherwise("positive")
    return v.corpus(spark, d).select("id", asked.alias("sentiment"), raw.alias("raw")).withColumn(
        "verdict", tx.parse_verdict(F.col("raw"))
    )


@query
def logit_scores(spark, d):
    scored = mx.logit_scores(v.logits(spark, d), F.col("a0"), F.col("a1"))
    return rounded(scored.select("vec_id", "y", "score", "pred"))


# ---- joins and copying ----------------------------------------------------


def instructed(spark, d):
    plan = ds.instructions(v.manifest(spark, d), v.DESIGN).select(
        "cell_id", "rep_index", "item", "aspects", F.col("opener_move").alias("asked_opener")
    )
    return ds.instruction_join(v.generated_rows(spark, d), plan)


@query
def instruction_join(spark, d):
    return instructed(spark, d).select(
        "id", "cell_id", "rep_index", "item", "asked_opener", F.array_join("aspects", "|").alias("aspects")
    )


@query
def remaining_work(spark, d):
    return grading.remaining_work(v.manifest(spark, d), done_rows(spark, d)).select("cell_id", "rep_index", "item")


@query
def remaining_work_by_count(spark, d):
    return grading.remaining_work(v.manifest(spark, d), done_rows(spark, d), by="count").select(
        "cell_id", "rep_index", "item"
    )


def done_rows(spark, d):
    """Rows counted as collected: documents that have a label."""
    labels = v.table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return v.generated_rows(spark, d).join(labels, "id", "left_semi")


def turn_pairs(spark, d):
    turns = v.table(spark, d, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("previous"))
    return turns.join(before, ["conv_id", "turn"])


@query
def ngram_copy(spark, d):
    return copying.ngram_copy(turn_pairs(spark, d), "previous", "text", n=2).select("conv_id", "turn", "n_copied")


@query
def ngram_contamination(spark, d):
    return copying.ngram_contamination(documents(spark, d), v.table(spark, d, "benchmark"), "doc_id", 6)


# ---- reports --------------------------------------------------------------


@query
def length_report(spark, d):
    return rounded(reports.length_report(v.generated_rows(spark, d)))


@query
def length_adherence(spark, d):
    return rounded(reports.length_adherence(v.generated_rows(spark, d)))


@query
def sentiment_agreement(spark, d):
    return rounded(reports.sentiment_agreement(judged(spark, d)))


@query
def aspect_coverage(spark, d):
    return rounded(reports.aspect_coverage(instructed(spark, d)))


@query
def aspect_mentions(spark, d):
    return rounded(reports.aspect_mentions(v.generated_rows(spark, d)))


@query
def opener_compliance(spark, d):
    return rounded(reports.opener_compliance(v.generated_rows(spark, d)))


@query
def stylometry(spark, d):
    return rounded(reports.stylometry(v.classes(spark, d), ("generated", "real", "fake")))


@query
def top_openers(spark, d):
    return reports.top_openers(v.classes(spark, d).where(F.col("class") == "generated"))


@query
def opener_bootstrap(spark, d):
    texts = v.classes(spark, d)
    return rounded(
        reports.opener_bootstrap(
            texts.where(F.col("class") == "generated"), texts.where(F.col("class") == "real"), "id"
        )
    )


@query
def char_document_frequency(spark, d):
    return reports.char_document_frequency(v.classes(spark, d)).withColumn(
        "code_point", tx.code_point(F.col("ch"))
    ).select("class", "code_point", "n_texts")


@query
def perfect_separators(spark, d):
    return rounded(reports.perfect_separators(v.classes(spark, d), "generated"))


@query
def language_purity(spark, d):
    return reports.language_purity(v.generated_rows(spark, d))


@query
def hygiene_report(spark, d):
    return reports.hygiene_report(v.generated_rows(spark, d), v.corpus(spark, d))


@query
def copy_report(spark, d):
    asked = v.prompts(spark, d).where(F.col("example_mode") == "few_shot").select("cell_id", "rep_index", "user")
    pairs = v.generated_rows(spark, d).select("cell_id", "rep_index", "text").join(asked, ["cell_id", "rep_index"])
    return reports.copy_report(copying.ngram_copy(pairs, "user", "text", n=6))


@query
def dataset_gate(spark, d):
    return reports.dataset_gate(v.classes(spark, d), "generated")


@query
def cell_counts(spark, d):
    return reports.cell_counts(v.generated_rows(spark, d))


@query
def failure_breakdown(spark, d):
    graded = grading.best_attempt(v.turns(spark, d), ["conv_id", "cell_id"], F.col("lo"), F.col("hi"), RAW)
    return reports.failure_breakdown(grading.failed(graded))


@query
def seed_summary(spark, d):
    texts = sp.stratified_splits(v.corpus(spark, d).select("id", "y", "toxic"), (42, 43, 44, 45, 46))
    runs = mx.binary_metrics(texts.where(F.col("split") == "test"), pred="toxic", by=("seed",))
    return rounded(mx.seed_summary(runs.withColumn("model", F.lit("toxic_flag"))))


# ---- design ---------------------------------------------------------------


@query
def factorial_manifest(spark, d):
    return v.manifest(spark, d).select("ordinal", "cell_ord", "cell_id", "rep_index", "item")


@query
def assign_aspects(spark, d):
    return ds.assign_aspects(v.manifest(spark, d), v.DESIGN).select(
        "cell_id", "rep_index", F.array_join("aspects", "|").alias("aspects")
    )


@query
def assign_openers(spark, d):
    return ds.assign_openers(v.manifest(spark, d), v.DESIGN).select("cell_id", "rep_index", "opener_move")


@query
def example_pool(spark, d):
    return ds.example_pool(v.corpus(spark, d), v.EXAMPLES, v.DESIGN.seed)


@query
def pick_examples(spark, d):
    texts = v.corpus(spark, d)
    pool = ds.example_pool(texts, v.EXAMPLES, v.DESIGN.seed)
    return ds.pick_examples(v.manifest(spark, d), pool, texts, v.DESIGN.seed).select(
        "cell_id", "rep_index", F.col("real_id").cast("string"), F.col("fake_id").cast("string")
    )


@query
def best_attempt(spark, d):
    return grading.best_attempt(
        v.attempts(spark, d), ["conv_id"], F.col("lo"), F.col("hi"), RAW
    ).select("conv_id", "text", "n_attempts", "error")


@query
def replay_check(spark, d):
    items = ds.item_index(v.table(spark, d, "documents"), "source")
    return ds.replay_check(v.generated_rows(spark, d), items, v.DESIGN, spark)


@query
def replay_prompts(spark, d):
    """Recorded prompts, some of which differ in one step, against the plan."""
    recorded = ds.step_chain(v.recorded_prompts(spark, d))
    return ds.replay_prompts(recorded, ds.step_chain(v.prompts(spark, d)))


@query
def prompt_table(spark, d):
    return v.prompts(spark, d).select("cell_id", "rep_index", "system", "user")


# ---- split and features ---------------------------------------------------


@query
def split_assignment(spark, d):
    return sp.split_assignment(sp.stratified_split(v.corpus(spark, d)))


@query
def split_counts(spark, d):
    return sp.split_counts(sp.stratified_split(v.corpus(spark, d)))


@query
def tokens(spark, d):
    return tv.tokens(documents(spark, d)).select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens")
    )


@query
def term_frequency(spark, d):
    return tv.term_frequency(v.corpus(spark, d))


def fitted_terms(spark, d):
    rows = sp.stratified_split(v.corpus(spark, d))
    tf = tv.term_frequency(rows, keep=("split",))
    n_train = rows.where(F.col("split") == "train").count()
    return tf, tv.vocabulary(tf.where(F.col("split") == "train"), n_train, VectorSpec())


@query
def vocabulary(spark, d):
    return rounded(fitted_terms(spark, d)[1])


@query
def tfidf(spark, d):
    tf, vocab = fitted_terms(spark, d)
    return rounded(tv.tfidf(tf, settle(vocab)).select("id", "split", "term", "tf", "weight"))


# ---- scoring --------------------------------------------------------------


def scored(spark, d):
    return mx.logit_scores(v.logits(spark, d), F.col("a0"), F.col("a1"))


@query
def param_grid(spark, d):
    """Every declared point of the three grids beside the rows that a fit of it learns from."""
    learned = sp.stratified_split(v.corpus(spark, d)).where(F.col("split") == "train").agg(*totals())
    named = F.transform(
        F.array_sort(F.map_entries("params")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))
    )
    points = [
        mx.param_grid(spark, grid).select(F.lit(family).alias("family"), "run", F.array_join(named, ";").alias("params"))
        for family, grid in (("svm", cfg.SVM_GRID), ("boosted_trees", cfg.TREES_GRID), ("transformer", cfg.TRANSFORMER_GRID))
    ]
    return reduce(DataFrame.unionByName, points).crossJoin(learned)  # one row of totals


@query
def threshold_grid(spark, d):
    return rounded(graded_thresholds(spark, d))


def graded_thresholds(spark, d):
    both = v.logits(spark, d).select(
        "y",
        tx.softmax_positive(F.col("a0"), F.col("a1")).alias("model_a"),
        tx.softmax_positive(F.col("b0"), F.col("b1")).alias("model_b"),
    )
    return mx.threshold_grid(both, [0.3, 0.4, 0.5, 0.6, 0.7], ["model_a", "model_b"])


@query
def leaderboard(spark, d):
    return rounded(mx.leaderboard(graded_thresholds(spark, d).withColumn("f1", F.round("f1", 9)))).select(
        "model", "run", "threshold", "f1", "place"
    )


@query
def binary_metrics(spark, d):
    return rounded(mx.binary_metrics(scored(spark, d)))


@query
def roc_auc(spark, d):
    return rounded(mx.roc_auc(scored(spark, d)))


@query
def average_precision(spark, d):
    return rounded(mx.average_precision(scored(spark, d)))


@query
def external_model_eval(spark, d):
    return rounded(mx.evaluate_scores(scored(spark, d)))


# ---- learners -------------------------------------------------------------

#: One point of either family. Margin classifiers are also searched over all 36 declared points.
LINEAR = {"C": 1.0, "kernel": "linear", "gamma": "scale", "class_weight": "balanced"}
RBF = {"C": 10.0, "kernel": "rbf", "gamma": "scale", "class_weight": None}
TREES = {
    "n_estimators": 200, "max_depth": 3, "learning_rate": 0.1, "subsample": 0.8, "colsample_bytree": 0.8, "min_child_weight": 1, "reg_lambda": 1,
}
SEEDS = (42, 43, 44, 45, 46)


def features(spark, d):
    return learn.build_features(sp.stratified_split(v.corpus(spark, d)))


def totals(prefix=""):
    return [F.count(F.lit(1)).alias(f"{prefix}n_rows"), F.sum(F.col("y").cast("long")).alias(f"{prefix}n_positive")]


def held_out_scores(spark, d, family, point):
    """Scores of a model on the validation split."""
    feats = features(spark, d)
    fitted = learn.TRAINERS[family](feats, feats.of("train"), point)
    return fitted.score(feats.of("validation")).select("id", "y", F.round("score", 6).alias("score"))


@query
def tfidf_vectors(spark, d):
    return features(spark, d).vectors.select(
        "id", "split", F.size("term_ids").alias("n_terms"),
        F.round(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared_norm"),
    )


@query
def train_linear_svm(spark, d):
    return held_out_scores(spark, d, "svm", LINEAR)


@query
def train_rbf_svm(spark, d):
    return held_out_scores(spark, d, "svm", RBF)


@query
def train_boosted_trees(spark, d):
    """All features, 200 trees."""
    return held_out_scores(spark, d, "boosted_trees", TREES)


@query
def calibrate_scores(spark, d):
    """Margins of the validation split, the fitted sigmoid and the probability that it gives."""
    feats = features(spark, d)
    fitted = learn.train_svm(feats, feats.of("train"), LINEAR)
    a, b = (F.lit(float(x)) for x in fitted.ab[:, 0])
    scored = fitted.score_all(fitted.score(feats.of("validation")), margin=True)
    return scored.select("id", "y", F.round(F.element_at("scores", 1), 6).alias("margin"), F.round("score", 6).alias("score"), F.round(a, 6).alias("a"), F.round(b, 6).alias("b"))


@query
def grid_search(spark, d):
    """All 36 declared points."""
    return rounded(learn.grid_search(features(spark, d), "svm"))


@query
def final_report(spark, d):
    """The winner of all 36 declared points, refitted and scored once."""
    feats = features(spark, d)
    return rounded(learn.final_report(feats, learn.grid_search(feats, "svm")))


@query
def model_comparison(spark, d):
    """All 36 declared margin classifiers beside all 288 declared points of the trees."""
    feats = features(spark, d)
    svm = learn.grid_search(feats, "svm")
    trees = learn.grid_search(feats, "boosted_trees")
    finals = learn.final_report(feats, svm).unionByName(learn.final_report(feats, trees))
    return rounded(mx.model_comparison(svm.unionByName(trees), finals.drop("run", "params")))


@query
def seed_models(spark, d):
    """Mean and deviation of a linear margin classifier's test metrics over five splits."""
    texts = v.corpus(spark, d).select("id", "y", "text")
    runs = learn.seed_runs(texts, sp.stratified_splits(texts.select("id", "y"), SEEDS), LINEAR, SEEDS)
    return rounded(mx.seed_summary(runs.withColumn("model", F.lit("linear_svm")), (*mx.METRICS, "roc_auc", "pr_auc")))


# ---- scorer and stream ----------------------------------------------------


def polarity(text):
    """A stand-in judge: it fails on an empty text and looks for two words."""
    if not text.strip():
        raise ValueError("empty")
    lowered = text.lower()
    return "positive" if "worthless" not in lowered and "pathetic" not in lowered else "negative"


@query
def apply_scorer_query(spark, d):
    return apply_scorer(documents(spark, d).select("doc_id", "text"), polarity).select("doc_id", "verdict")


QUERIES["apply_scorer"] = QUERIES.pop("apply_scorer_query")

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
    ]
)


@query
def stream_ingest(spark, d):
    out = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    texts = ingest.read_stream(spark, f"{d}/documents.parquet", DOCUMENT_SCHEMA).select(
        F.col("lang").alias("cell_id"), F.col("doc_id").alias("rep_index"),
        F.lit("collector").alias("model"),
        v.decorated(F.col("text"), F.col("doc_id")).alias("text"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("timestamp"),
    )
    ingest.stream_ingest(texts, out, 455, 945, RAW).awaitTermination()
    keep = ["cell_id", "rep_index", "n_words", "n_chars", "distance"]
    ok = ingest.read_sink(spark, out, "accepted").select("*", F.lit("").alias("error"))
    bad = ingest.read_sink(spark, out, "failed")
    return ok.select(*keep, "error").unionByName(bad.select(*keep, "error"))
