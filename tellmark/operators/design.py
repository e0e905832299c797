"""Factorial collection design: manifest, seeded draws, example choice, prompts, replay."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tellmark.config import Design, ExampleSpec, PromptTemplates
from tellmark.functions import text as tx
from tellmark.functions.hashing import hash_number, key_hash
from tellmark.plans.scaling import exact_rank, guarded_join
from tellmark.session import settle


def design_cells(spark: SparkSession, axes: dict[str, tuple[str, ...]]) -> DataFrame:
    """Every combination of the axes in axis order, with its ordinal. Its size is the product
    of the axis lengths."""
    n = 1
    for values in axes.values():
        n *= len(values)
    cells = spark.range(1)
    position = F.lit(0)
    for axis, values in axes.items():
        cells = cells.select(
            *[c for c in cells.columns], F.posexplode(F.array(*[F.lit(v) for v in values])).alias(f"_p_{axis}", axis)
        )
        position = position * len(values) + F.col(f"_p_{axis}")
    return cells.select(
        position.cast("int").alias("cell_ord"),
        tx.cell_id(*[F.col(a) for a in axes]).alias("cell_id"),
        *axes,
    )


def item_index(items: DataFrame, column: str) -> DataFrame:
    """Distinct items in sorted order with a 0-based index, stored because the rotation counts,
    measures and joins it. Items are numbered inside sorted ranges, which then shift by the sizes
    of the ranges before them."""
    distinct = items.select(F.col(column).alias("item")).where(F.col(column).isNotNull()).distinct()
    ranged = settle(distinct.repartitionByRange("item").withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("item"))
    return settle(
        ranged.withColumn("_inside", inside).join(F.broadcast(starts), "_range")  # one row per range
        .select("item", (F.col("_inside") - 1 + F.col("_start")).cast("int").alias("item_ix"))
    )


def rotate_items(df: DataFrame, items: DataFrame, ordinal: str = "ordinal", how: str = "inner") -> DataFrame:
    """Round-robin: row ``ordinal`` takes item ``ordinal mod n``."""
    n_items = items.agg(F.count(F.lit(1))).scalar()
    keyed = df.withColumn("item_ix", F.pmod(F.col(ordinal), n_items).cast("int"))
    return guarded_join(keyed, items, ["item_ix"], how).drop("item_ix")


def factorial_manifest(
    spark: SparkSession,
    axes: dict[str, tuple[str, ...]],
    items: DataFrame,
    total: int | None = None,
    per_cell: int | None = None,
    cells: str | None = None,
) -> DataFrame:
    """One row per (cell, repetition) with its item.

    ``total`` rows are split evenly (the first ``total mod n`` cells get one more) or each cell
    gets ``per_cell``. Cell and repetition follow from the row's ordinal by arithmetic, so
    the rows are made in parallel whatever the total. ``items`` comes from ``item_index``;
    rotation goes on across cells, and a ``cells`` filter never changes the rows it keeps.
    """
    grid = design_cells(spark, axes)
    n_cells = reduce(lambda a, b: a * len(b), axes.values(), 1)
    if total is None:
        if per_cell is None:
            raise ValueError("give total or per_cell")
        total = per_cell * n_cells
    base, extra = divmod(total, n_cells)
    head = extra * (base + 1)
    ordinal = F.col("ordinal")
    # ``base`` is 0 only when every row lies in the head.
    cell = F.when(ordinal < head, F.floor(ordinal / (base + 1))).otherwise(
        extra + F.floor((ordinal - head) / max(base, 1))
    )
    start = F.col("cell_ord") * base + F.least(F.col("cell_ord"), F.lit(extra))
    rows = (
        spark.range(total).withColumnRenamed("id", "ordinal")
        .withColumn("cell_ord", cell.cast("int"))
        .withColumn("rep_index", (ordinal - start).cast("int"))
        .join(F.broadcast(grid), "cell_ord")  # at most the product of the axis lengths
        .where(tx.cell_matches(F.col("cell_id"), cells))
    )
    return rotate_items(rows, items)


def offsets_from_counts(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """Running start of each cell when counts come from data; ``counts`` is per cell."""
    before = Window.orderBy("cell_ord").rowsBetween(Window.unboundedPreceding, -1)
    return (
        cells.join(counts, "cell_id", "left")
        .withColumn("target", F.coalesce("target", F.lit(0).cast("long")))
        .withColumn("start", F.coalesce(F.sum("target").over(before), F.lit(0)))
    )


# ---- seeded draws ---------------------------------------------------------


def draw_aspects(design: Design, cell: Column, rep: Column, seed: Column | None = None) -> Column:
    """``aspects_per_text`` aspects without replacement, sorted by name."""
    seed = F.lit(design.seed) if seed is None else seed
    ranked = F.sort_array(
        F.transform(
            F.array(*[F.lit(a) for a in design.aspects]),
            lambda a: F.struct(key_hash(seed, cell, rep, "aspect", a).alias("h"), a.alias("a")),
        )
    )
    chosen = F.slice(ranked, 1, min(design.aspects_per_text, len(design.aspects)))
    return F.sort_array(F.transform(chosen, lambda s: s["a"]))


def draw_opener(design: Design, cell: Column, rep: Column, seed: Column | None = None) -> Column:
    """A weighted opening move. The draw is compared with the cumulative weights as integers;
    seven literal bounds need no join."""
    seed = F.lit(design.seed) if seed is None else seed
    total = sum(w for _, w in design.moves)
    draw = hash_number(key_hash(seed, cell, rep, "opener"), 8) * total
    choice, upto = F, 0
    for move, weight in design.moves:
        upto += weight
        choice = choice.when(draw < F.lit(upto * 2**32), F.lit(move))
    return choice


def assign_aspects(manifest: DataFrame, design: Design, seed: Column | None = None) -> DataFrame:
    """``aspects`` for structured rows, an empty list elsewhere."""
    drawn = draw_aspects(design, F.col("cell_id"), F.col("rep_index"), seed)
    empty = F.array().cast("array<string>")
    return manifest.withColumn("aspects", F.when(F.col("structure") == "structured", drawn).otherwise(empty))


def assign_openers(manifest: DataFrame, design: Design, seed: Column | None = None) -> DataFrame:
    return manifest.withColumn(
        "opener_move", draw_opener(design, F.col("cell_id"), F.col("rep_index"), seed)
    )


def instructions(manifest: DataFrame, design: Design) -> DataFrame:
    return assign_openers(assign_aspects(manifest, design), design)


def instruction_join(texts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Texts with the instruction they were given; texts without one are skipped. Both sides
    grow with the collection, so no side is hinted."""
    return texts.join(manifest, ["cell_id", "rep_index"])


# ---- few-shot examples ----------------------------------------------------


def example_pool(corpus: DataFrame, spec: ExampleSpec, seed: int = 0, key: str = "id") -> DataFrame:
    """Candidate examples ranked for picking: ``pool, scope, length, id, rank, size``.

    A pool is a label and source; a scope is one category, or '' for the whole pool, the
    fallback where a category has no candidate. A text whose category is null or '' has none
    and is a candidate of the whole pool alone, once. Candidates lie inside the scope's length
    quantiles, or are the whole scope when none does. Quantiles and band sizes come from a
    histogram of lengths per scope, and ranks are spread over hash buckets, so a scope that
    holds most of the corpus is never in one task.
    """
    label, source = F.col("Binary_label"), F.col("source")
    pools = [
        F.when((label == spec.real_label) & (source == s), F.lit(f"real_{sentiment}"))
        for sentiment, s in spec.real_source_by_sentiment.items()
    ] + [F.when((label == spec.fake_label) & (source == spec.fake_source), F.lit("fake"))]
    scoped = (
        corpus.where(F.col("text").isNotNull())
        .select(
            F.col(key).alias("id"), F.length("text").alias("n_chars"), "Category",
            F.explode(F.array_compact(F.array(*pools))).alias("pool"),
        )
        .withColumn("scope", F.explode(F.array_compact(F.array(F.nullif(F.col("Category"), F.lit("")), F.lit("")))))
        .drop("Category")
    )
    histogram = scoped.groupBy("pool", "scope", "n_chars").agg(F.count(F.lit(1)).alias("f"))
    marks = sorted({q for band in spec.quantiles.values() for q in band})
    quantiles = histogram.groupBy("pool", "scope").agg(
        F.percentile("n_chars", [float(q) for q in marks], F.col("f")).alias("q")
    )
    bands = quantiles.select(
        "pool", "scope",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("length"),
                        F.get("q", marks.index(lo)).alias("lo"),
                        F.get("q", marks.index(hi)).alias("hi"),
                    )
                    for name, (lo, hi) in spec.quantiles.items()
                ]
            )
        ).alias("b"),
    ).select("pool", "scope", "b.*")
    inside = F.col("n_chars").between(F.col("lo"), F.col("hi"))
    sized = (
        histogram.join(bands, ["pool", "scope"])
        .groupBy("pool", "scope", "length", "lo", "hi")
        .agg(F.sum(F.when(inside, F.col("f")).otherwise(0)).alias("in_band"), F.sum("f").alias("whole"))
        .select(
            "pool", "scope", "length", "lo", "hi", "in_band",
            F.when(F.col("in_band") > 0, F.col("in_band")).otherwise(F.col("whole")).alias("size"),
        )
    )
    candidates = guarded_join(scoped, settle(sized), ["pool", "scope"]).where(
        inside | (F.col("in_band") == 0)
    )
    hashed = candidates.select(
        "pool", "scope", "length", "id", "n_chars", "size",
        key_hash(seed, F.col("id"), "example").alias("_h"),
    )
    return exact_rank(hashed, ["pool", "scope", "length"], "_h", "id").drop("_h")


def pick_examples(
    manifest: DataFrame, pool: DataFrame, corpus: DataFrame, seed: int = 0, key: str = "id"
) -> DataFrame:
    """One real and one fake example per few-shot row: ids and stripped texts, '' where the
    pool is empty. Zero-shot rows get neither and take part in no join.

    A row's pick is a rank computed from its own hash. The distinct picks fetch their texts
    first, by unique keys; the rows then take them through the guarded join, so a tiny pool
    that a large part of the rows draws from makes no hot task. The ranked pool (ids, not
    texts) is stored once; both kinds and the group sizes read it.
    """
    pool = settle(pool)
    sizes = settle(pool.select("pool", "scope", "length", "size").distinct())
    own = sizes.withColumnsRenamed({"scope": "item", "size": "_own"})
    whole = sizes.where(F.col("scope") == "").select("pool", "length", F.col("size").alias("_all"))
    place = ["pool", "scope", "length", "rank"]
    few_shot = F.col("example_mode") == "few_shot"
    out = manifest.where(few_shot)
    for kind in ("real", "fake"):
        name = F.concat(F.lit("real_"), F.col("sentiment")) if kind == "real" else F.lit("fake")
        wants = guarded_join(out.withColumn("pool", name), own, ["pool", "item", "length"], "left")
        wants = guarded_join(wants, whole, ["pool", "length"], "left")
        draw = hash_number(key_hash(seed, F.col("cell_id"), F.col("rep_index"), kind), 15)
        wants = wants.withColumn(
            "scope", F.when(F.col("_own").isNotNull(), F.col("item")).otherwise(F.lit(""))
        ).withColumn("rank", F.pmod(draw, F.coalesce("_own", "_all")) + 1)
        texts = corpus.select(
            F.col(key).alias(f"{kind}_id"), tx.strip(F.col("text")).alias(f"{kind}_example")
        )
        picked = (
            wants.select(*place).distinct()
            .join(pool.select(*place, F.col("id").alias(f"{kind}_id")), place)
            .join(texts, f"{kind}_id")
        )
        out = (
            guarded_join(wants, settle(picked), place, "left")
            .withColumn(f"{kind}_example", F.coalesce(f"{kind}_example", F.lit("")))
            .drop("pool", "scope", "rank", "_own", "_all")
        )
    no_text = {f"{kind}_example": F.lit("") for kind in ("real", "fake")}
    rest = manifest.where(~few_shot).withColumns(no_text)
    return out.unionByName(rest, allowMissingColumns=True)


# ---- prompts --------------------------------------------------------------


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template with {placeholders} as one concatenation."""
    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(values[name].cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def prompt_table(manifest: DataFrame, templates: PromptTemplates, design: Design) -> DataFrame:
    """``system`` and ``user`` text per row. Without a complete example pair a few-shot row
    falls back to the zero-shot text."""
    targets, length = design.targets, F.col("length")
    bands = {k: tx.length_band(t.chars, design.tolerance) for k, t in targets.items()}
    values = {
        "item": F.col("item"),
        "sentiment": F.col("sentiment"),
        "chars": tx.by_length(length, {k: t.chars for k, t in targets.items()}),
        "w_min": tx.by_length(length, {k: t.words[0] for k, t in targets.items()}),
        "w_max": tx.by_length(length, {k: t.words[1] for k, t in targets.items()}),
        "lo": tx.by_length(length, {k: b[0] for k, b in bands.items()}),
        "hi": tx.by_length(length, {k: b[1] for k, b in bands.items()}),
        "aspects": F.array_join("aspects", ", "),
        "move": F.col("opener_move"),
        "real_example": F.col("real_example"),
        "fake_example": F.col("fake_example"),
    }
    by_length = reduce(
        lambda acc, kv: acc.when(length == kv[0], fill(kv[1], values)), templates.length.items(), F
    )
    system = F.concat_ws(
        "\n",
        fill(templates.opening, values),
        fill(templates.sentiment, values),
        by_length,
        F.when(F.col("structure") == "structured", fill(templates.structured, values)).otherwise(
            fill(templates.unstructured, values)
        ),
        fill(templates.opener, values),
        fill(templates.closing, values),
    )
    pair = (
        (F.col("example_mode") == "few_shot")
        & (F.col("real_example") != "") & (F.col("fake_example") != "")
    )
    user = F.when(pair, fill(templates.few_shot, values)).otherwise(fill(templates.zero_shot, values))
    return manifest.withColumn("system", system).withColumn("user", user)


# ---- replay ---------------------------------------------------------------


def replay_check(
    generated: DataFrame, items: DataFrame, design: Design, spark: SparkSession
) -> DataFrame:
    """Per cell: rows whose stored item, opener and (where ``generated`` has a column
    ``aspects``) aspects equal the ones recomputed from (seed, cell, repetition).

    Every row is counted: a cell outside the design has no start, so its items match nothing.
    Cell sizes are read from the data. A collection with more than one seed cannot be replayed
    as one run: its counts are null and ``n_seeds`` says why.
    """
    from tellmark.operators.reports import cell_counts

    cells = design_cells(spark, design.axes).select("cell_ord", "cell_id")
    starts = offsets_from_counts(cells, cell_counts(generated).select("cell_id", "target"))
    placed = generated.join(F.broadcast(starts.select("cell_id", "start")), "cell_id", "left")  # one row per cell
    again = rotate_items(
        placed.withColumn("ordinal", F.col("start") + F.col("rep_index")), items, how="left"
    )
    known = F.col("start").isNotNull()
    with_aspects = "aspects" in generated.columns
    drawn = F.when(F.col("structure") == "structured", draw_aspects(design, F.col("cell_id"), F.col("rep_index"), F.col("gen_seed")))
    drawn = F.coalesce(drawn, F.array().cast("array<string>")) if with_aspects else None
    same = lambda c: F.sum((known & F.coalesce(c, F.lit(False))).cast("long"))
    opener = draw_opener(design, F.col("cell_id"), F.col("rep_index"), F.col("gen_seed"))
    n_seeds = generated.agg(F.countDistinct("gen_seed")).scalar()
    single = F.col("n_seeds") == 1
    return (
        again.groupBy("cell_id").agg(
            F.count(F.lit(1)).alias("n_rows"),
            same(F.col("item") == F.col("Category")).alias("_items"),
            same(opener == F.col("opener_move")).alias("_openers"),
            *([same(drawn == F.sort_array("aspects")).alias("_aspects")] if with_aspects else []),
        )
        .withColumn("n_seeds", n_seeds)
        .select(
            "cell_id", "n_rows", "n_seeds",
            F.when(single, F.col("_items")).alias("n_category_ok"),
            F.when(single, F.col("_openers")).alias("n_opener_ok"),
            *([F.when(single, F.col("_aspects")).alias("n_aspects_ok")] if with_aspects else []),
        )
    )


#: What a prompt is made of, in the order of its making.
STEPS = ("item", "opener", "aspects", "examples", "prompt")


def step_chain(rows: DataFrame, out: str = "chain") -> DataFrame:
    """Add the hashes of the steps of a row of `prompt_table`, each over the step and the hash before it: a row
    recorded with its chain tells later which step first came out otherwise. Absent values differ from empty ones."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    aspects = F.coalesce(F.concat(F.lit("="), F.array_join("aspects", "\n")), F.lit("-"))
    parts = [text("item"), text("opener_move"), aspects, F.concat_ws("\n", text("real_id"), text("fake_id")), F.concat_ws("\n", text("system"), text("user"))]
    steps = F.array(*parts)
    start = F.array().cast("array<string>")
    chained = F.aggregate(
        steps, start, lambda done, step: F.concat(done, F.array(F.md5(F.concat_ws("\n", F.coalesce(F.get(done, F.size(done) - 1), F.lit("")), step))))
    )
    return rows.withColumn(out, chained)


def replay_prompts(recorded: DataFrame, again: DataFrame, keys: tuple[str, ...] = ("cell_id", "rep_index")) -> DataFrame:
    """Rows of ``recorded`` (``keys`` and ``chain``) with ``first_difference``: the first step at which the recomputed
    row differs, an empty text where none does, ``missing`` where there is no such row. The chains alone are joined."""
    known = again.select(*keys, F.col("chain").alias("_again"))
    pairs = F.zip_with("chain", "_again", lambda a, b: ~a.eqNullSafe(b))
    place = F.array_position(pairs, F.lit(True))
    names = F.array(*[F.lit(s) for s in STEPS])
    first = F.when(F.col("_again").isNull(), F.lit("missing")).when(place > 0, F.get(names, (place - 1).cast("int"))).otherwise(F.lit(""))
    return recorded.select(*keys, "chain").join(known, list(keys), "left").select(*keys, first.alias("first_difference"))
