"""Text, digest and label functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Option names that steer only the search and so do not split stored experience.
SEARCH_ONLY_OPTIONS = [
    "routingStrategy", "neuralGuidance", "rlEpisodes", "rlSeed", "rlTemperature", "rlLearning",
    "rlRemember", "rlBatchSize", "rlLearningRate", "variantLimit", "treeBeamWidth",
    "treeExpansion", "treeRepairPasses", "treeRepairCandidates", "treeGraphMaxNodes",
    "treeGroupRepair", "treeJunctionRepair", "treeGeometricSearch", "treeSingleRootTrial",
    "treeResumeFromBest", "treeLearning", "treeLearningRounds", "treeTrainingSteps",
    "treeTrainingRate",
]


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def valid_id(text: Column) -> Column:
    """Not blank and at most 256 characters."""
    return F.coalesce((F.trim(text) != "") & (F.char_length(text) <= 256), F.lit(False))


def is_digest(text: Column) -> Column:
    return F.coalesce(text.rlike("^[a-f0-9]{64}$"), F.lit(False))


def map_split(digest: Column) -> Column:
    """Every fifth map, by the first byte of its digest, is kept for validation."""
    first = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int")
    return F.when(first % 5 == 0, "validation").otherwise("train")


def options_key(options: Column, digest: Column) -> Column:
    """Digest of the engineering options of a run and of its input.

    ``options`` is a map of option name to JSON value text. Search-only names are dropped; the
    single-root switch counts only for tree routing that requires it.
    """
    # A name that is absent reads as NULL; the names are compared in one order.
    single = (F.coalesce(F.get(F.map_values(F.map_filter(
        options, lambda k, v: k == "treeSingleRootRequired")), F.lit(0)), F.lit("false")) == "true")
    tree = (F.coalesce(F.get(F.map_values(F.map_filter(
        options, lambda k, v: k == "routingStrategy")), F.lit(0)), F.lit("")).isin("tree", '"tree"'))
    keep = F.map_filter(options, lambda k, v: ~k.isin(SEARCH_ONLY_OPTIONS) & (
        (k != "treeSingleRootRequired") | (single & tree)))
    body = F.array_join(F.array_sort(F.transform(
        F.map_entries(keep), lambda e: F.concat_ws("=", e["key"], e["value"]))), "&")
    return sha256(F.concat_ws("#", body, digest))


def part_id(prefix: Column, edge: Column, ordinal: Column) -> Column:
    return F.concat(prefix, edge.cast("string"), F.lit(":"), ordinal.cast("string"))


def break_id(prefix: Column, edge: Column, ordinal: Column) -> Column:
    return F.concat(prefix, edge.cast("string"), F.lit(":node:"), ordinal.cast("string"))
