"""Map windows, pages, extents and latest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utilnet.operators import spatial
from utilnet.operators.ordering import top_k


def in_window(features: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Boxes that meet the window, touching included; the four comparisons reach the scan."""
    return features.filter((F.col("maxx") >= x0) & (F.col("maxy") >= y0)
                           & (F.col("minx") <= x1) & (F.col("miny") <= y1))


def window_density(features: DataFrame, windows: DataFrame, max_objects: int, max_estimate: int,
                   keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Objects and estimated bytes per window (window_id and box), and whether that is too much.

    ``features`` carries geometry_bytes and property_bytes.
    """
    pairs = spatial.bbox_join(windows, features, 0.0, 256.0, keys)
    size = 5 * F.col("b_geometry_bytes") + 4 * F.col("b_property_bytes")
    found = pairs.groupBy(*keys, F.col("a_window_id").alias("window_id")).agg(
        F.count(F.lit(1)).alias("objects"), F.sum(size).alias("estimate"))
    return windows.select(*keys, "window_id").join(found, [*keys, "window_id"], "left").fillna(
        0, ["objects", "estimate"]).withColumn(
        "too_dense", (F.col("objects") > max_objects) | (F.col("estimate") > max_estimate))


def page_by_type(features: DataFrame, object_type: str, size: int, after: str | None = None) -> DataFrame:
    """Next page of one type in id order: a keyset page, so no earlier rows are read again."""
    rows = features.filter(F.col("object_type") == object_type)
    if after is not None:
        rows = rows.filter(F.col("id") > after)
    return rows.orderBy("id").limit(size)


def viewport(features: DataFrame, size: int, keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """First objects of each dataset by drawing priority and id, and whether some were left out."""
    kind = F.col("object_type")
    priority = (F.when(kind == "oks_future", 0).when(kind == "oks_connection_point", 1)
                .when(kind == "source", 2).when(kind == "heat_network", 3).otherwise(4))
    kept = top_k(features.withColumn("priority", priority), keys, ["priority", "id"], size + 1)
    more = kept.groupBy(*keys).agg((F.max("rank") > size).alias("truncated"))
    return kept.filter(F.col("rank") <= size).join(more, list(keys))


def variant_features(exported: DataFrame, size: int, keys: Sequence[str] = ("dataset_id", "variant_id")) -> DataFrame:
    """Drawable features of each variant, up to the page size, and whether some were left out."""
    kept = top_k(exported.filter("has_geometry"), keys, ["id"], size + 1)
    more = kept.groupBy(*keys).agg((F.max("rank") > size).alias("truncated"))
    return kept.filter(F.col("rank") <= size).join(more, list(keys))


def extent(features: DataFrame, keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    return features.groupBy(*keys).agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"),
                                       F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def latest_per_owner(rows: DataFrame, owner: str, created: str, tie: str, n: int = 100) -> DataFrame:
    return top_k(rows, [owner], [F.col(created).desc(), F.col(tie).desc()], n)


def latest_status(updates: DataFrame, job: str, at: str, columns: Sequence[str],
                  interrupted: Sequence[str] = ("RUNNING", "QUEUED")) -> DataFrame:
    """Last update of each job; jobs still open are the ones a restart would flag."""
    last = updates.groupBy(job).agg(F.max_by(F.struct(*columns), at).alias("_l")).select(job, "_l.*")
    return last.withColumn("interrupted", F.col("status").isin(*interrupted))
