"""The operators of this package as queries over the given tables, and SQL where it can follow."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tellmark.llm import jaccard, langid, lines, neardup, neighbours, ngrams, packing, pieces, prefixes, ranked, substrings, toxicity, warc
from tellmark.llm.common import held_out, join_checked
from tellmark.llm.oracle import STATEMENTS as SQL  # noqa: F401

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_language_id(spark, d):
    docs = table(spark, d, "documents")
    trees = langid.train(docs.where(~held_out(F.col("doc_id"))))
    return langid.predict(docs, trees).withColumn("held_out", held_out(F.col("doc_id")))


@query
def op2_substrings(spark, d):
    return substrings.digests(table(spark, d, "documents"))


@query
def op3_warc(spark, d):
    return warc.round_trip(table(spark, d, "pages"))


@query
def op4_neighbours(spark, d):
    rows = table(spark, d, "embeddings")
    return neighbours.search(rows, F.col("vec_id") % 20 == 0, 20)


@query
def op5_jaccard(spark, d):
    return jaccard.near_duplicates(table(spark, d, "documents"))


@query
def op6_toxicity(spark, d):
    docs = table(spark, d, "documents")
    labels = table(spark, d, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    grammar = toxicity.learn(join_checked(docs.select("doc_id", "text"), labels, "doc_id", "inner", 16))
    scored = toxicity.score(docs, grammar)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op7_pieces(spark, d):
    return pieces.digests(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op8_near_duplicates(spark, d):
    return neardup.near_duplicates(table(spark, d, "embeddings"))


@query
def op9_lines(spark, d):
    return lines.digests(table(spark, d, "documents"))


@query
def op10_packing(spark, d):
    return packing.pack(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op11_prefixes(spark, d):
    return prefixes.trie(table(spark, d, "conversations"))


@query
def op12_language_model(spark, d):
    docs = table(spark, d, "documents")
    held = held_out(F.col("doc_id"), 7)
    return ngrams.score(docs, ~held).withColumn("held_out", held)


@query
def op13_ranked(spark, d):
    return ranked.search(ranked.build(table(spark, d, "documents")), table(spark, d, "benchmark"))
