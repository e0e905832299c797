"""The shapes the operators work on, derived from the given tables.

Collected texts in practice carry preambles, wrapping quotes, typographic marks and stray
script; the given texts carry none, so ``decorated`` adds one kind per row by its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tellmark.config import Design, ExampleSpec, PromptTemplates
from tellmark.functions import text as tx
from tellmark.operators import design as ds
from tellmark.plans.scaling import spread
from tellmark.session import FIXTURE_PARTITIONS

DESIGN = Design()
EXAMPLES = ExampleSpec(
    real_source_by_sentiment={"positive": "en", "negative": "fr"}, fake_source="en"
)
TEMPLATES = PromptTemplates(
    opening="Describe {item}.",
    sentiment="Tone: {sentiment}.",
    length={
        "short": "Short, about {chars} characters ({w_min}-{w_max} words), within {lo} and {hi}.",
        "long": "Long, about {chars} characters ({w_min}-{w_max} words), within {lo} and {hi}.",
    },
    structured="Cover: {aspects}.",
    unstructured="Free form.",
    opener="Open with {move}.",
    closing="Text only.",
    few_shot="First:\n{real_example}\n\nSecond:\n{fake_example}",
    zero_shot="Begin.",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = spark.conf.get(FIXTURE_PARTITIONS, None)  # only local sessions set it
    return spread(table(spark, sf_dir, "documents"), "doc_id", int(dealt) if dealt else None)


def decorated(text: Column, number: Column) -> Column:
    kind = F.pmod(number, F.lit(8))
    return (
        F.when(kind == 1, F.concat(F.lit("<think>plan\nnotes</think>\n"), text))
        .when(kind == 2, F.concat(F.lit("Sure, here are my words: "), text))
        .when(kind == 3, F.concat(F.lit('Review:\n\n\n\n"'), text, F.lit('"')))
        .when(kind == 4, F.concat(F.lit("Certainly! - here is the text:\n '"), text, F.lit("'  ")))
        .when(kind == 5, F.concat(F.lit("“"), text, F.lit(";\n\n\n\n–”")))
        .when(kind == 6, F.concat(text, F.lit(" 前台的简，非常乐")))
        .when(kind == 7, F.concat(F.lit("Review — "), text, F.lit(" - we’ll see…")))
        .otherwise(text)
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts: documents with a quality label. Language plays the origin."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return documents(spark, sf_dir).join(labels, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("quality") == 1, "real").otherwise("fake").alias("Binary_label"),
        F.col("source").alias("Category"),
        F.lit("text").alias("domain"),
        "text",
        F.lit(0).alias("is_synthetic"),
        F.col("lang").alias("source"),
        (F.col("quality") == 0).cast("int").alias("y"),
        "toxic",
    )


def generated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a collected row: four bits of its id are the factors, the rest the
    repetition; its source is the category and its language the model."""
    bit = lambda i, axis: F.element_at(
        F.array(*[F.lit(v) for v in DESIGN.axes[axis]]),
        (F.shiftright(F.col("doc_id"), i).bitwiseAND(F.lit(1)) + 1).cast("int"),
    ).alias(axis)
    rows = documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("Category"),
        F.col("lang").alias("model"),
        decorated(F.col("text"), F.col("doc_id")).alias("text"),
        *[bit(i, axis) for i, axis in enumerate(DESIGN.axes)],
        F.shiftright(F.col("doc_id"), 4).cast("int").alias("rep_index"),
        F.lit(DESIGN.seed).alias("gen_seed"),
    )
    bands = {k: tx.length_band(t.chars, DESIGN.tolerance) for k, t in DESIGN.targets.items()}
    rows = rows.withColumn("cell_id", tx.cell_id(*[F.col(a) for a in DESIGN.axes]))
    n = F.length("text")
    length = F.col("length")
    return ds.assign_openers(rows, DESIGN).select(
        "*",
        n.alias("n_chars"),
        tx.n_words(F.col("text")).alias("n_words"),
        tx.by_length(length, {k: t.chars for k, t in DESIGN.targets.items()}).alias("target_chars"),
        n.between(
            tx.by_length(length, {k: b[0] for k, b in bands.items()}),
            tx.by_length(length, {k: b[1] for k, b in bands.items()}),
        ).cast("int").alias("in_length_band"),
        (1 + F.col("rep_index") % 2).cast("int").alias("n_attempts"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One planned row per document, rotating over the document sources."""
    texts = table(spark, sf_dir, "documents")
    items = ds.item_index(texts, "source")
    return ds.factorial_manifest(spark, DESIGN.axes, items, total=texts.count())


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = corpus(spark, sf_dir)
    pool = ds.example_pool(texts, EXAMPLES, DESIGN.seed)
    rows = ds.instructions(manifest(spark, sf_dir), DESIGN)
    return ds.prompt_table(ds.pick_examples(rows, pool, texts, DESIGN.seed), TEMPLATES, DESIGN)


def recorded_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planned prompts as a collection may have recorded them: by the number of a repetition one step differs."""
    kind = F.col("rep_index") % 8
    return (
        prompts(spark, sf_dir)
        .withColumn("item", F.when(kind == 1, F.concat("item", F.lit(" II"))).otherwise(F.col("item")))
        .withColumn("opener_move", F.when(kind == 2, F.lit("none of them")).otherwise(F.col("opener_move")))
        .withColumn("aspects", F.when(kind == 3, F.array(F.lit("none"))).otherwise(F.col("aspects")))
        .withColumn("real_id", F.when(kind == 4, F.lit(-1)).otherwise(F.col("real_id")))
        .withColumn("user", F.when(kind == 5, F.concat("user", F.lit(" "))).otherwise(F.col("user")))
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as successive attempts at one sample."""
    conv = F.col("conv_id")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        F.when(conv % 2 == 0, "short").otherwise("long").alias("cell_id"),
        (F.col("turn") + 1).alias("attempt_no"),
        decorated(F.col("text"), conv + F.col("turn")).alias("text"),
        F.when(conv % 2 == 0, 130).otherwise(455).alias("lo"),
        F.when(conv % 2 == 0, 270).otherwise(945).alias("hi"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a sample of its own, so that some samples fail."""
    by_turn = F.col("conv_id") * 100 + F.col("attempt_no") - 1
    return attempts(spark, sf_dir).withColumn("conv_id", by_turn)


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two human classes (labelled documents) and assistant turns as the generated class."""
    human = corpus(spark, sf_dir).select(F.col("Binary_label").alias("class"), "id", "text")
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    generated = turns.select(
        F.lit("generated").alias("class"),
        F.col("conv_id").alias("id"),
        decorated(F.col("text"), F.col("conv_id") + F.col("turn")).alias("text"),
    )
    return human.unionByName(generated)


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scoring models from the first four embedding values; the label's parity is truth."""
    e = lambda i: F.get("embedding", F.lit(i))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("label") % 2).alias("y"),
        e(0).alias("a0"), e(1).alias("a1"), e(2).alias("b0"), e(3).alias("b1"),
    )
