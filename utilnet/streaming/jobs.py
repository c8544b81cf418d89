"""Structured Streaming jobs: incremental import, duplicate refusal, live progress."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from utilnet.sources.features import parse_features, project


def feature_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Dropped newline-delimited feature files as parsed rows; the file is the dataset."""
    lines = (spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
             .select(F.input_file_name().alias("dataset_id"), F.lit(0).cast("long").alias("pos"),
                     F.col("value").alias("body")))
    return parse_features(lines)


def import_features(stream: DataFrame, target: str, rejects: str, checkpoint: str,
                    available_now: bool = True) -> StreamingQuery:
    """Append new features; ids the dataset already has, in the table or the batch, are refused.

    The table is keyed (dataset_id, id). A batch that is run again after a failure first finds its
    own rows by batch number and leaves them out of the comparison and of the append.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        rows = project(batch.filter("reject IS NULL").drop("reject", "body")).withColumn(
            "batch", F.lit(number).cast("long"))
        first = rows.groupBy("dataset_id", "id").agg(
            F.min_by(F.struct(*[c for c in rows.columns if c not in ("dataset_id", "id")]),
                     F.struct("object_type", "properties")).alias("_r"),
            F.count(F.lit(1)).alias("copies"))
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        fresh = first
        if there:
            known = spark.read.parquet(target)
            fresh = first.join(known.select("dataset_id", "id"), ["dataset_id", "id"], "left_anti")
        out = fresh.select("dataset_id", "id", "_r.*")
        again = first.join(fresh.select("dataset_id", "id"), ["dataset_id", "id"], "left_anti")
        if there:
            mine = known.filter(F.col("batch") == number).select("dataset_id", "id")
            again = again.join(mine, ["dataset_id", "id"], "left_anti")
        twice = fresh.filter("copies > 1").select("dataset_id", "id")
        refused = again.select("dataset_id", "id").unionByName(twice).select(
            "dataset_id", "id", F.lit("DUPLICATE_ID").alias("reject"))
        bad = batch.filter("reject IS NOT NULL").select("dataset_id", "id", "reject").unionByName(refused)
        # The two tables are written from what the batch alone decides, the rejects first: a rerun
        # replaces its own folder of rejects and appends only what is still missing.
        bad.write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        out.write.mode("append").parquet(target)
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def deduplicate(stream: DataFrame, arrival: str, delay: str = "1 hour") -> DataFrame:
    """First feature per id while the arrival column is at hand."""
    return stream.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(["dataset_id", "id"])


_BEST = "job_id long, attempt long, event_id long, score double, best_so_far double, improved boolean"
_STATE = "best double, attempts long"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    best, count = state.get if state.exists else (None, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    score = rows["score"].to_numpy(float)
    usable = rows["complete"].to_numpy(bool) & ~np.isnan(score)
    lows = np.minimum.accumulate(np.concatenate(([np.inf if best is None else best], np.where(usable, score, np.inf))))
    state.update((None if np.isinf(lows[-1]) else float(lows[-1]), count + len(rows)))
    yield pd.DataFrame({
        "job_id": key[0], "attempt": np.arange(count + 1, count + len(rows) + 1), "event_id": rows["event_id"].to_numpy(),
        "score": score, "best_so_far": pd.Series(lows[1:]).where(~np.isinf(lows[1:])),
        "improved": usable & (np.isinf(lows[:-1]) | (score < lows[:-1] - 1e-9))})


def live_best(attempts: DataFrame) -> DataFrame:
    """Running best per job over a stream of attempts (job_id, ts, event_id, complete, score).

    State per job is two numbers, and a job's attempts of one micro-batch meet in one call. Attempts
    are numbered in the order of (ts, event_id) inside a batch and of the batches among themselves:
    one that arrives a batch late is numbered when it arrives.
    """
    return attempts.groupBy("job_id").applyInPandasWithState(
        _advance, _BEST, _STATE, "append", GroupStateTimeout.NoTimeout)


def live_status(updates: DataFrame) -> DataFrame:
    """Latest status per job (job_id, status, updated) for update mode."""
    return updates.groupBy("job_id").agg(
        F.max_by(F.struct("status", "updated"), "updated").alias("_l")).select("job_id", "_l.*")
