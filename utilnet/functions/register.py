"""Publish the scalar functions to SQL as parameterised SQL functions: no Python in the row path."""

from __future__ import annotations

from pyspark.sql import SparkSession

from utilnet.functions import rules


def _ladder(limits: list[float], slack: float, arg: str, values: list | None = None) -> str:
    out = values if values is not None else list(range(len(limits)))
    arms = " ".join(f"WHEN {arg} <= {c!r}D + {slack!r}D THEN {v}" for c, v in zip(limits, out))
    return f"CASE {arms} END"


def _by_dn(values: list, arg: str = "dn") -> str:
    arms = " ".join(f"WHEN {d} THEN {float(v)!r}D" for d, v in zip(rules.DN, values))
    return f"CASE {arg} {arms} END"


FUNCTIONS = {
    "tn_diameter": ("flow DOUBLE", "INT", _ladder(rules.CAPACITY, 1e-9, "flow", rules.DN)),
    "tn_capacity": ("dn INT", "DOUBLE", _by_dn(rules.CAPACITY)),
    "tn_price_new": ("dn INT", "DOUBLE", _by_dn(rules.PRICE_NEW)),
    "tn_price_recon": ("dn INT", "DOUBLE", _by_dn(rules.PRICE_RECON)),
    "tn_run_limit": ("dn INT", "DOUBLE", _by_dn(rules.RUN_LIMIT)),
    "tn_pipe_width": ("dn INT", "DOUBLE",
                      f"2D * {_by_dn(rules.HEIGHT)} + IF(dn <= 150, 0.15D, 0.25D)"),
    "tn_building_clearance": ("dn INT", "DOUBLE", "CASE WHEN dn < 500 THEN 5D "
                              "WHEN dn <= 800 THEN 7D ELSE 9D END"),
    "tn_chamber_price": ("dn INT", "DOUBLE", "CASE WHEN dn <= 200 THEN 3e6D "
                         "WHEN dn <= 500 THEN 5e6D WHEN dn <= 1000 THEN 8e6D ELSE 12e6D END"),
    "tn_depth_factor": ("h DOUBLE", "DOUBLE", "1D + 0.1D * greatest(0D, h - 3D)"),
    "tn_score": ("cost DOUBLE, len DOUBLE", "DOUBLE", "0.7D * cost / 25e6D + 0.3D * len / 100D"),
    "tn_score4": ("v DOUBLE", "DOUBLE",
                  "CAST(round(CAST(CAST(v AS STRING) AS DECIMAL(38,18)), 4) AS DOUBLE)"),
    "tn_rating": ("v DOUBLE, best DOUBLE", "DOUBLE",
                  "CASE WHEN isnan(v) OR best < 0D OR v < best THEN NULL "
                  "WHEN v = 0D THEN 100D ELSE 100D * (best / v) END"),
    "tn_coordinate_key": ("x DOUBLE, y DOUBLE", "STRING",
                          "concat_ws(':', CAST(floor(x * 1000D + 0.5D) AS STRING), "
                          "CAST(floor(y * 1000D + 0.5D) AS STRING))"),
    "tn_turn_angle": ("a DOUBLE, b DOUBLE", "DOUBLE",
                      "acos(greatest(-1D, least(1D, cos(a - b))))"),
    "tn_in_range": ("lon DOUBLE, lat DOUBLE", "BOOLEAN",
                    "coalesce(NOT isnan(lon) AND NOT isnan(lat) AND abs(lon) <= 180D "
                    "AND lat >= 0D AND lat <= 84D, false)"),
    "tn_map_split": ("sha STRING", "STRING",
                     "IF(CAST(conv(substring(sha, 1, 2), 16, 10) AS INT) % 5 = 0, "
                     "'validation', 'train')"),
}


def register_functions(spark: SparkSession) -> list[str]:
    for name, (args, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} "
                  f"RETURN {body}")
    return list(FUNCTIONS)
