"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utilnet.llm import bpe, centroids, decontaminate, graphs, html, idfiles, langid, prefixes, sharding, simhash, suffixes, toxicity, vectors

QUERIES = {}
ORACLES: dict[str, str] = {}

LANGUAGE_FOLDS, LANGUAGE_HELD_OUT = 4, 2
TOXIC_FOLDS = 5


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(count: int):
    """The documents' fold: crc32 of the id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % count


@_query
def op1_shards(spark: SparkSession, folder: str) -> DataFrame:
    found = sharding.assign(table(spark, folder, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


@_query
def op2_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return suffixes.digest(suffixes.remove_repeats(docs))


@_query
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


@_query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(TOXIC_FOLDS) == 0, F.lit(False))
    scorer = toxicity.learn(docs, table(spark, folder, "labels").filter(~held_out))
    return toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), scorer)


@_query
def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = fold(LANGUAGE_FOLDS) == LANGUAGE_HELD_OUT
    learnt = langid.samples(docs.filter(~held_out))
    found = langid.identify(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), learnt)
    return found.drop("text")


@_query
def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digest(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN)


@_query
def op7_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages").select("page_id", "url", "html"))


@_query
def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.contamination(docs, table(spark, folder, "benchmark")))


@_query
def op9_idfiles(spark: SparkSession, folder: str) -> DataFrame:
    files = idfiles.write(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return idfiles.read(files, ids=False)


@_query
def op10_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


@_query
def op11_graphs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return graphs.nearest(rows, rows.filter("vec_id % 50 = 0"), 5)


@_query
def op12_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.trie(*prefixes.shared_starts(prefixes.paths(table(spark, folder, "conversations"))))


@_query
def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster(table(spark, folder, "embeddings")))
