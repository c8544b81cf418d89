"""Rule catalogue of the technical appendix and the column functions over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Nominal diameters and, per diameter, capacity (t/h), longest run of one
# diameter (m), price of new pipe and of reconstruction (rubles per m), outer height (m).
DN = [50, 65, 80, 100, 125, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900, 1000, 1200, 1400]
CAPACITY = [3.5, 8.3, 13.2, 22.3, 40.2, 65.1, 152.3, 274.9, 437.4, 943.1, 1663.4, 2627.7,
            3735.1, 5296.8, 7165.0, 9391.8, 15012.8, 22501.9]
RUN_LIMIT = [181.0, 245.0, 327.0, 419.0, 554.0, 696.0, 1042.0, 1379.0, 1718.0, 2477.0, 3245.0,
             4037.0, 4775.0, 5644.0, 6518.0, 7419.0, 9288.0, 11276.0]
PRICE_NEW = [74023.0, 78631.0, 83530.0, 89748.0, 97275.0, 105507.0, 120275.0, 135323.0,
             150022.0, 190299.0, 224137.0, 264790.0, 324298.0, 325996.0, 327693.0, 418777.0,
             428074.0, 683417.0]
PRICE_RECON = [96180.0, 109989.0, 117582.0, 133694.0, 148030.0, 152295.0, 181766.0, 202030.0,
               228707.0, 271317.0, 333884.0, 372703.0, 439571.0, 489918.0, 553607.0, 606679.0,
               825692.0, 978584.0]
HEIGHT = [0.125, 0.140, 0.160, 0.180, 0.225, 0.250, 0.315, 0.400, 0.450, 0.560, 0.710, 0.800,
          0.900, 1.0, 1.1, 1.2, 1.425, 1.6]

# Restriction type, hard, polygon, clearance, extension, cost factor,
# 45 degree rule, vertical gap, own height, depth of the top.
RESTRICTIONS = [
    ("park", True, True, 1.0, 0.0, 1.0, False, 0.0, 0.0, 0.0),
    ("social_area", True, True, 1.0, 0.0, 1.0, False, 0.0, 0.0, 0.0),
    ("prohibited_site", True, True, 1.0, 0.0, 1.0, False, 0.0, 0.0, 0.0),
    ("water", True, True, 1.0, 0.0, 1.0, False, 0.0, 0.0, 0.0),
    ("railway", True, True, 1.0, 0.0, 1.0, False, 0.0, 0.0, 0.0),
    ("oks", True, True, 5.0, 0.0, 1.0, False, 0.0, 0.0, 0.0),
    ("road", False, True, 1.5, 3.0, 1.60, True, 1.0, 0.0, 0.0),
    ("tram_tracks", False, True, 1.5, 3.0, 1.75, True, 1.2, 0.0, 0.0),
    ("gas_pipeline", False, False, 2.0, 2.0, 1.25, False, 0.2, 0.4, 2.8),
    ("power_cable", False, False, 2.0, 2.0, 1.15, False, 0.5, 0.2, 2.7),
    ("heat_network", False, False, 1.0, 2.0, 1.05, False, 0.5, 0.0, 3.0),
]
RESTRICTION_COLUMNS = ("rule string, hard boolean, is_polygon boolean, clearance double, "
                       "extension double, factor double, angle_rule boolean, vertical double, "
                       "own_height double, top double")
SPECIAL_FACTORS = sorted({r[5] for r in RESTRICTIONS if r[5] > 1})
OBJECT_TYPES = ["source", "heat_network", "heat_chamber", "oks_connection_point",
                "oks_existing", "oks_future", "restriction"]

SNAP = 0.25          # endpoints closer than this are one vertex, m
BASE_DEPTH = 3.0     # ordinary laying depth, m
MIN_DEPTH = 0.7
MAX_SLOPE = 0.10
TIE_COST = 5e6
CLEARANCES = (5.0, 7.0, 9.0)  # from buildings, by diameter, m
MISSING_BASE = 100e6
MISSING_PER_TPH = 500000.0


def restriction_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RESTRICTIONS, RESTRICTION_COLUMNS)


def _pick(values: list, idx: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), idx)


#: The row of a pipe that no diameter of the table can be. It takes part in maxima like any
#: other row, and has no diameter, capacity or price.
OVERSIZE = len(DN)


def _first_row(value: Column, limits: list[float], slack: float) -> Column:
    """Row of the first limit that covers the value; NULL only for NULL."""
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for i, limit in enumerate(limits):
        out = out.when(value <= limit + slack, i)
    return out.otherwise(OVERSIZE)


def flow_index(flow: Column) -> Column:
    """0-based table row of the smallest diameter that carries the flow; OVERSIZE above the largest."""
    return _first_row(flow, CAPACITY, 1e-9)


def run_index(length: Column) -> Column:
    """0-based row of the smallest diameter that may run this far; OVERSIZE beyond the largest."""
    return _first_row(length, RUN_LIMIT, 1e-3)


def dn_index(dn: Column) -> Column:
    """0-based row of a nominal diameter; NULL when it is not in the table."""
    out = F.when(dn == DN[0], 0)
    for i in range(1, len(DN)):
        out = out.when(dn == DN[i], i)
    return out


def dn_of(idx: Column) -> Column:
    return _pick(DN, idx)


def diameter(flow: Column) -> Column:
    return dn_of(flow_index(flow))


def capacity(idx: Column) -> Column:
    return _pick(CAPACITY, idx)


def run_limit(idx: Column) -> Column:
    return _pick(RUN_LIMIT, idx)


def price_new(idx: Column) -> Column:
    return _pick(PRICE_NEW, idx)


def price_recon(idx: Column) -> Column:
    return _pick(PRICE_RECON, idx)


def height(idx: Column) -> Column:
    return _pick(HEIGHT, idx)


def pipe_width(dn: Column) -> Column:
    return 2 * height(dn_index(dn)) + F.when(dn <= 150, 0.15).otherwise(0.25)


def building_clearance(dn: Column) -> Column:
    small, middle, large = CLEARANCES
    return F.when(dn < 500, small).when(dn <= 800, middle).otherwise(large)


def chamber_price(dn: Column) -> Column:
    return (F.when(dn <= 200, 3e6).when(dn <= 500, 5e6).when(dn <= 1000, 8e6).otherwise(12e6))


def depth_factor(h: Column) -> Column:
    return 1 + 0.1 * F.greatest(F.lit(0.0), h - BASE_DEPTH)


def approach_length(dn: Column) -> Column:
    return 2 * (building_clearance(dn) + pipe_width(dn) / 2) + 0.05


def score(cost: Column, length: Column, profile: str = "contest") -> Column:
    """Weighted cost and length; the protocol profile swaps the two weights."""
    wc, wl = (0.3, 0.7) if profile == "protocol" else (0.7, 0.3)
    return wc * cost / 25e6 + wl * length / 100


def score4(value: Column) -> Column:
    """Four places, halves up, judged on the shortest decimal form of the double."""
    return F.round(value.cast("string").cast("decimal(38,18)"), 4).cast("double")


def relative_rating(value: Column, best: Column) -> Column:
    """100 for the best network; NULL where the pair of scores cannot be ranked."""
    finite = ~F.isnan(value) & (F.abs(value) < float("inf")) & (F.abs(best) < float("inf"))
    ok = finite & (best >= 0) & (value >= best)
    return F.when(ok, F.when(value == 0, 100.0).otherwise(100 * (best / value)))
