"""Session helpers: written intermediate tables and local defaults."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A table of more rows is not collected for a broadcast: written values are packed, so its bytes on disk say little.
BROADCAST_ROWS = 10_000


def local_session(cores: str = "8", shuffle: str = "8") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("utilnet")
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        # Loop and spatial plans stack many aliases over few columns; inferring constraints over
        # them takes planning time that grows exponentially and adds only not-null filters.
        .config("spark.sql.constraintPropagation.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediate tables: the one the session names, or one for local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        folder = context.getCheckpointDir()
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="utilnet-checkpoint-")
            context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/utilnet-{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there.

    The plan behind stays short, lost executors cost no recomputation, and later joins plan with
    the true size of the table. (A checkpointed DataFrame keeps the size estimates of its origin;
    those multiply with every round of a loop until planning itself becomes slow.)
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def cut(df: DataFrame) -> DataFrame:
    """``written``, and a table of more than ``BROADCAST_ROWS`` rows is joined by sorting."""
    rows = Observation()
    out = written(df.observe(rows, F.count(F.lit(1)).alias("n")))
    if rows.get["n"] <= BROADCAST_ROWS:
        return out
    hinted = out.hint("merge")
    hinted.cut_path = out.cut_path
    return hinted


def discard(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that ``cut`` returned: nothing may read it any more."""
    _delete(df.sparkSession, df.cut_path)


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables that this application has written so far."""
    _delete(spark, shared_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
