"""From raw documents to token ids: the five stages of the training corpus, in order.

Each stage takes (spark, docs, sf_dir), where ``docs`` is what its predecessor kept, and returns
the documents that it keeps; all but the last return the columns of ``documents``. ``run`` writes
every stage's rows as Parquet in the session's shared folder and reads them again for the next.
Further columns of the input are dropped; a missing ``n_chars`` or ``lang`` is not.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utilnet.llm import bpe, decontaminate, langid, simhash, suffixes
from utilnet.llm.queries import LANGUAGE_FOLDS, LANGUAGE_HELD_OUT, fold, table
from utilnet.session import written as cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Stage decisions rest on suffix automata, fingerprints, suffix arrays and transducers.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that was learnt; what has no letter (``und``) goes."""
    known = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learnt = langid.samples(known.filter(fold(LANGUAGE_FOLDS) != LANGUAGE_HELD_OUT))
    found = langid.identify(docs.select(*COLUMNS), learnt)
    return found.filter(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of linked fingerprints: the smallest id.

    A row without an id stays only if its group has none with an id. Of rows that tie on the id
    the smallest digest of id and text stays, and of rows equal in both one.
    """
    row = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text").isNull(), "text")
    docs = docs.select(*COLUMNS, F.sha2(row.cast("binary"), 256).alias("row_key"))
    groups = simhash.near_duplicates(docs, carry=["row_key"])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    keep = groups.groupBy("label").agg(first.alias("first")).select(F.col("first.row_key").alias("row_key")).distinct()
    return docs.join(keep, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out spans that an earlier document has; every document stays, if with less text.

    A cut may split a character of several bytes; what is left of that goes as well.
    """
    found = suffixes.remove_repeats(docs.select(*COLUMNS), as_text=True)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of which under a twentieth of the words are in benchmark windows."""
    found = decontaminate.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), clean=True)
    return found.select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the checksums of what they decode to."""
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats),
          ("benchmark", benchmark), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
