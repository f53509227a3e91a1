"""Views over the driver's tables that stand for fleet tables, and the same views in DuckDB SQL.

``VIEWS`` holds the SQL; :func:`sql` puts the views that a text names in front of it.
"""

from __future__ import annotations

import re
from math import cos, pi, sin

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import REPORT_TYPES, VEHICLE_TYPES

#: Outlines in the unit square by shape: rectangle, L, rectangle with a hole, two parts.
SHAPES = {
    0: [((0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.1, 0.9))],
    1: [((0.05, 0.05), (0.95, 0.05), (0.95, 0.5), (0.5, 0.5), (0.5, 0.95), (0.05, 0.95))],
    2: [((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)), ((0.3, 0.3), (0.7, 0.3), (0.7, 0.7), (0.3, 0.7))],
    3: [((0.0, 0.0), (0.4, 0.0), (0.4, 1.0), (0.0, 1.0)), ((0.6, 0.0), (1.0, 0.0), (1.0, 1.0), (0.6, 1.0))],
}


#: Vocabulary of the survey views: words of issues, and the model that each bonus question belongs to.
ISSUES = (
    "app_vendor", "acceleration", "basket", "battery", "bell", "brakes", "connectivity", "customer_service",
    "dirty", "kickstand", "pedals", "phone_holder", "price", "speedometer", "site_issue", "vandalized",
)
BONUS_MODELS = {"front_basket": "model_1", "top_speed_mph": "model_2", "landscape_holder": "model_3"}


def shape_edges() -> list[tuple[int, float, float, float, float]]:
    """(shape, x1, y1, x2, y2) of all rings."""
    return [(s, *a, *b) for s, rings in SHAPES.items() for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]])]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(col: str | Column = "ts") -> Column:
    """Microseconds since 1970 of a time without zone."""
    return F.unix_micros((F.col(col) if isinstance(col, str) else col).cast("timestamp"))


def _common(e: DataFrame, *more: str) -> DataFrame:
    r = F.floor(F.col("value") * 100).cast("int")
    return e.select(
        "event_id", "user_id", F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("vehicle"), "ts",
        F.concat(F.lit("b"), F.col("user_id").cast("string"), F.lit("-"), F.expr("event_id div 7").cast("string")).alias("device_id"),
        ((F.col("user_id") % 5) + 1).cast("string").alias("type_id"),
        (F.col("event_type") == "error").alias("is_disabled"),
        F.when(F.col("event_type") != "signup", F.col("event_type") == "purchase").alias("is_reserved"),
        F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 2 == 0, 100 + 327 * F.floor(r / 327).cast("int")).otherwise(r).cast("int").alias("range_m"), *more,
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry points; one cycle is one UTC day."""
    e = _common(load(spark, sf_dir, "events"))
    glitch = F.col("event_id") % 97 == 0
    lat = F.when(glitch, F.lit(30.0)).otherwise(F.lit(39.58) + ((F.col("event_id") * 7919) % 3400) / F.lit(10000.0))
    lon = F.when(glitch, F.lit(110.0)).otherwise(F.lit(-105.25) + ((F.col("event_id") * 104729) % 7000) / F.lit(10000.0))
    return e.withColumns({"lat": lat, "lon": lon, "day": F.col("ts").cast("date")})


def moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with time compressed 120 times, whose position changes at every third event id; us is their time."""
    e = _common(load(spark, sf_dir, "events"))
    start = 1_704_067_200_000_000
    k = F.sum(F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumns({"us": F.lit(start) + F.floor((micros("ts") - F.lit(start)) / 120).cast("long"), "k": k})
    lat = F.lit(39.58) + ((F.col("user_id") * 7919 + F.col("k") * 131) % 3400) / F.lit(10000.0)
    lon = F.lit(-105.25) + ((F.col("user_id") * 104729 + F.col("k") * 257) % 7000) / F.lit(10000.0)
    return e.withColumns({"lat": lat, "lon": lon}).drop("ts", "k")


def terrain_cell(lat: Column, lon: Column) -> Column:
    """Number of the hundredth of a degree that a place lies in."""
    return (F.floor((lat - F.lit(39.58)) * 100) * 70 + F.floor((lon - F.lit(-105.25)) * 100)).cast("long")


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(cell, height)``: metres above the sea by :func:`terrain_cell`; cells that no part stands for have none."""
    p = load(spark, sf_dir, "part")
    return p.groupBy((F.col("p_partkey") % 2450).alias("cell")).agg((F.max("p_size").cast("long") * 8 + 1600).alias("height"))


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in real time (us) around sixty places, where vehicles stay for about a day; every 17th has no plate."""
    x = _common(load(spark, sf_dir, "events"), "value")
    k = F.sum(F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumns({"us": micros("ts"), "k": k, "plate": F.when(F.col("user_id") % 17 != 0, F.concat(F.lit("PL-"), F.lpad(F.col("user_id").cast("string"), 5, "0")))})
    lat = F.lit(39.6) + ((F.col("user_id") * 7919 + F.col("k") * 131) % 6) * F.lit(0.05) + ((F.col("user_id") * 31 + F.col("k") * 17) % 40) * F.lit(0.0002)
    lon = F.lit(-105.2) + ((F.col("user_id") * 104729 + F.col("k") * 257) % 10) * F.lit(0.06) + ((F.col("user_id") * 13 + F.col("k") * 7) % 40) * F.lit(0.0002)
    return x.withColumns({"lat": lat, "lon": lon}).drop("k")


def vehicle_types(spark: SparkSession) -> DataFrame:
    """Built-in vehicle types."""
    return spark.createDataFrame(list(VEHICLE_TYPES), "type_id string, form_factor string, use_type string, max_range int")


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(region_type, region_name, edges)``: one polygon per row, edges of all its rings."""
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"))

    edge = "named_struct('x1', {1}D, 'y1', {2}D, 'x2', {3}D, 'y2', {4}D)"
    own = ", ".join(f"{s}, array({', '.join(edge.format(*e) for e in shape_edges() if e[0] == s)})" for s in SHAPES)
    x, y = "-105.25D + (k % 5 + e.{0}) * 0.14D + 0.00005D", "39.58D + (floor(k / 5) + e.{0}) * 0.068D + 0.00005D"
    placed = ", ".join(f"'{c}', {form.format(c)}" for c, form in (("x1", x), ("y1", y), ("x2", x), ("y2", y)))
    edges = F.expr(f"transform(element_at(map({own}), k % 4), e -> named_struct({placed}))")
    kinds = F.array_compact(F.array(F.lit("neighborhood"), F.when(F.col("k") % 3 == 0, F.lit("v1")), F.when(F.col("k") % 4 == 0, F.lit("v2")), F.concat(F.lit("er"), (F.col("k") % 6 + 1).cast("string"))))
    return n.select(F.explode(kinds).alias("region_type"), F.concat(F.lit("r"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("region_name"), edges.alias("edges"))


def _star(points: int = 16, far: float = 0.003, near: float = 0.0012) -> list[tuple[float, float, float, float]]:
    """Edges (x1, y1, x2, y2) of a star around the origin, in degrees."""
    at = [((far if k % 2 else near) * cos(2 * pi * k / points), (far if k % 2 else near) * sin(2 * pi * k / points)) for k in range(points)]
    return [(*at[k], *at[(k + 1) % points]) for k in range(points)]


STAR = _star()


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(zone_id, edges)``: a star of 16 edges around a place for each order, a third of them in the city's centre."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("zone_id"))
    k = F.col("zone_id")
    lat = F.when(k % 3 == 0, F.lit(39.74) + (k * 7919 % 400) / F.lit(10000.0)).otherwise(F.lit(39.58) + (k * 7919 % 3400) / F.lit(10000.0)) + F.lit(0.00003)
    lon = F.when(k % 3 == 0, F.lit(-104.98) + (k * 104729 % 400) / F.lit(10000.0)).otherwise(F.lit(-105.25) + (k * 104729 % 7000) / F.lit(10000.0)) + F.lit(0.00003)
    at = F.struct(lat.alias("lat"), lon.alias("lon"))
    star = F.array(*[F.struct(*[(F.col("at")[c] + F.lit(v)).alias(n) for n, c, v in zip(("x1", "y1", "x2", "y2"), ("lon", "lat", "lon", "lat"), e)]) for e in STAR])
    return o.withColumn("at", at).select("zone_id", star.alias("edges"))


def device_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative reports: error events."""
    e = points(spark, sf_dir).join(load(spark, sf_dir, "events").where("event_type = 'error'").select("event_id"), "event_id")
    kind = F.element_at(F.array(*map(F.lit, REPORT_TYPES)), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", "vehicle", "ts", "lat", "lon", kind.alias("report_type"), F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("account_id"), F.concat(F.lit("10.0.0."), (F.col("event_id") % 5).cast("string")).alias("ip"))


def discount_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discount reports: orders."""
    o = load(spark, sf_dir, "orders")
    lat = F.lit(39.58) + ((F.col("o_orderkey") * 7919) % 3400) / F.lit(10000.0)
    lon = F.lit(-105.25) + ((F.col("o_orderkey") * 104729) % 7000) / F.lit(10000.0)
    return o.select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("account_id"), (F.floor("o_totalprice").cast("int") % 5000).alias("cents"), F.col("o_orderdate").alias("ts"), lat.alias("lat"), lon.alias("lon"))


def trip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips: order lines; ``tie`` makes their order total."""
    x = load(spark, sf_dir, "lineitem")
    tie = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return x.select(
        F.concat(F.lit("v"), F.col("l_suppkey").cast("string")).alias("vehicle"), (F.col("l_shipdate") + F.make_dt_interval(mins=(F.col("l_orderkey") % 1440).cast("int"))).alias("ts"),
        (F.lit(39.58) + ((F.col("l_orderkey") * 7919) % 3400) / F.lit(10000.0)).alias("lat"), (F.lit(-105.25) + ((F.col("l_partkey") * 104729) % 7000) / F.lit(10000.0)).alias("lon"),
        F.col("l_returnflag").alias("model"), F.col("l_partkey").alias("from_id"), tie.alias("tie"),
    )


def user_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points ledger: orders."""
    o = load(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("entry_id"), F.col("o_custkey").alias("account_id"), (2 * (1 + F.col("o_orderkey") % 10)).alias("points"), F.col("o_orderdate").alias("ts"),
        (F.col("o_orderkey") % 97).alias("cell"), F.when(F.col("o_orderstatus") == "P", F.lit("pending_review")).otherwise(F.lit("confirmed")).alias("status"),
        (F.col("o_orderkey") % 400).alias("source_id"), F.col("o_orderpriority").alias("action"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts: customers."""
    c = load(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("account_id"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_name")).alias("display_name"), (F.col("c_mktsegment") != "MACHINERY").alias("shows"), (F.col("c_acctbal") > 0).alias("public"),
        F.concat(F.when(F.col("c_custkey") % 3 == 0, F.lit("User")).otherwise(F.lit("user")), F.expr("c_custkey div 2").cast("string"), F.lit("@x.org")).alias("email"), F.col("c_acctbal").alias("balance"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web events."""
    e = load(spark, sf_dir, "events")
    campaign = F.element_at(F.array(*map(F.lit, ("spring", "Spring ", "none", "bad code!"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        "event_id", "ts", F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("visitor"), F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("ts").cast("date").cast("string")).alias("session_id"), "props", campaign.alias("campaign"), "value",
        F.element_at(F.array(*map(F.lit, ("Mozilla/5.0 (iPhone; CPU iPhone OS 17)", "Mozilla/5.0 (Linux; Android 14) Mobile", "Mozilla/5.0 (Windows NT 10.0)", "Googlebot/2.1", "Mozilla/5.0 (iPad; CPU OS 16)"))), (F.col("event_id") % 5 + 1).cast("int")).alias("ua"),
        F.element_at(F.array(F.lit("https://Example.org/a?b"), F.lit("news.site/x"), F.lit(""), F.lit(None).cast("string")), (F.col("event_id") % 4 + 1).cast("int")).alias("referrer"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request metrics: order lines."""
    x = load(spark, sf_dir, "lineitem")
    return x.select(F.col("l_returnflag").alias("route"), F.col("l_linestatus").alias("method"), (200 + 100 * (F.col("l_linenumber") % 4)).alias("status"), F.col("l_quantity").cast("int").alias("ms"), (F.col("l_linenumber") % 2 == 0).alias("authed"), F.col("l_shipdate").alias("ts"))


def ride_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ride tracks: the lines of each order; ``seq`` orders them."""
    x = load(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return x.select(
        F.col("l_orderkey").alias("ride_id"), F.row_number().over(order).alias("seq"), (F.lit(39.58) + (F.col("l_partkey") * 37 % 340) / F.lit(10000.0)).alias("lat"), (F.lit(-105.25) + (F.col("l_suppkey") * 53 % 350) / F.lit(10000.0)).alias("lon"), (F.col("l_partkey") % 80).cast("double").alias("acc"),
    )


def rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides: orders."""
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("ride_id"), F.col("o_custkey").alias("account_id"), F.col("o_orderdate").alias("ts"), F.floor("o_totalprice").cast("long").alias("claimed_m"), (60 + F.col("o_orderkey") % 7200).alias("seconds"), (F.col("o_orderkey") % 9000).alias("route_m"), F.col("o_orderstatus").alias("state"))


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waypoints of donated tracks: three near each ride point, 150 seconds apart."""
    p = ride_points(spark, sf_dir).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2))))
    n = F.col("seq") * 3 + F.col("j") - 3
    late = F.when((F.col("acc") > 78) & (F.col("j") == 1), 300).otherwise(0)
    issued = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ride_id"), (micros("o_orderdate") + (F.col("o_orderkey") % 86400) * 1_000_000).alias("issued_us"))
    x = p.withColumn("n", n.cast("long")).join(issued, "ride_id")
    return x.select("ride_id", "n", (F.col("issued_us") + (F.col("n") * 150 - late) * 1_000_000).alias("us"), (F.col("lat") + F.col("j") * F.lit(0.0002)).alias("lat"), (F.col("lon") + F.col("j") * F.lit(0.0002)).alias("lon"), "acc")


def donations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donated rides: orders, with what rider and feed say of start, end and charge."""
    o = load(spark, sf_dir, "orders")
    k, s = F.col("ride_id"), F.lit(1_000_000)
    p = ride_points(spark, sf_dir).groupBy(F.col("ride_id").alias("_r")).agg(F.min_by(F.struct("lat", "lon"), "seq").alias("a"), F.max_by(F.struct("lat", "lon"), "seq").alias("z"), F.count("*").alias("c"))
    x = o.select(F.col("o_orderkey").alias("ride_id"), F.col("o_custkey").alias("account_id"), F.concat(F.lit("v"), (F.col("o_custkey") % 1500).cast("string")).alias("vehicle"), (micros("o_orderdate") + (F.col("o_orderkey") % 86400) * 1_000_000).alias("issued_us"))
    x = x.join(p, F.col("ride_id") == F.col("_r"), "left").withColumn("c", F.coalesce("c", F.lit(0)))
    last = F.col("issued_us") + (F.col("c") * 3 - 1) * 150 * s
    x = x.withColumn("ended_us", last + ((k % 40) - 4) * 60 * s)
    x = x.withColumns({
        "start_lat": F.col("a.lat") + (k % 16) * F.lit(0.0001), "start_lon": F.col("a.lon"), "end_lat": F.col("z.lat") + (k % 150) * F.lit(0.0003), "end_lon": F.col("z.lon"),
        "feed_lat": F.when(k % 3 != 0, F.col("a.lat") + (k % 14) * F.lit(0.0001)), "feed_lon": F.when(k % 3 != 0, F.col("a.lon")), "left_us": F.when(k % 7 != 0, F.col("issued_us") + ((k % 25) - 12) * 60 * s),
        "back_us": F.when(k % 4 != 0, last + ((k % 23) - 11) * 60 * s), "back_lat": F.when(k % 4 != 0, F.col("z.lat") + (k % 17) * F.lit(0.0001)), "back_lon": F.when(k % 4 != 0, F.col("z.lon") + F.lit(0.0004)),
        "soc_feed": F.when(k % 6 != 0, 40 + k % 60), "soc_start": F.when(k % 5 != 0, 45 + k % 50), "soc_end": F.when(k % 3 == 0, k % 90), "soc_back": F.when(k % 8 != 0, k % 70),
        "battery": k % 2 == 0, "nav": k % 3 != 0, "own_device": k % 11 == 0,
    })
    x = x.withColumn("donated_us", F.col("ended_us") + (k % 41) * 900 * s).withColumn("settled_us", F.when(k % 9 != 0, F.col("donated_us") + (k % 10) * 3600 * s))
    return x.drop("_r", "a", "z", "c")


def mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rentals that were mined from the feed: near the start of every ride."""
    return donations(spark, sf_dir).select("vehicle", (F.col("issued_us") + ((F.col("ride_id") % 7) - 3) * 600_000_000).alias("departed_us"), (F.col("ride_id") % 50).cast("double").alias("burn"))


def hourly_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperatures: each hour of the compressed range, every 13th missing."""
    b = moving(spark, sf_dir).agg(F.expr("min(us) div 3600000000").alias("lo"), F.expr("max(us) div 3600000000").alias("hi"))
    h = b.select(F.explode(F.sequence("lo", F.col("hi") + 1)).alias("hour"))
    return h.where("hour % 13 <> 0").select("hour", ((F.col("hour") * 37) % 35 - 5).cast("double").alias("temp"))


def route_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of routes: order lines; ``seq`` orders them."""
    x = load(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return x.select(F.col("l_orderkey").alias("route_id"), F.row_number().over(order).alias("seq"), F.col("l_partkey").alias("way_id"), F.col("l_quantity").alias("metres"), (F.col("l_linenumber") % 2 == 0).alias("street"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of ways: parts; canopy is unmeasured for small ones."""
    p = load(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("way_id"), F.when(F.col("p_partkey") % 5 > 0, (F.col("p_partkey") % 100) / F.lit(100.0)).alias("canopy"), (F.col("p_partkey") % 3 == 0).alias("bikeway"))


def feature_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature reports: two flags by bits of the event id, null to abstain."""
    e = load(spark, sf_dir, "events")
    bit = lambda k: F.when(F.col("event_id") % 6 != 0, F.expr(f"event_id div {1 << k}") % 2 == 1)
    return e.select("event_id", "ts", F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("vehicle"), F.concat(F.lit("u"), (F.col("event_id") % 17).cast("string")).alias("reporter"), bit(1).alias("basket"), bit(2).alias("holder"), (F.col("event_id") % 8 != 0).alias("plate_valid"))


_LATLON = "(39.58::DOUBLE + (({a} * 7919) % 3400) / 10000.0::DOUBLE) AS lat, (-105.25::DOUBLE + (({b} * 104729) % 7000) / 10000.0::DOUBLE) AS lon"
_EVENT = """event_id, user_id, 'v' || user_id AS vehicle, {ts} 'b' || user_id || '-' || (event_id // 7) AS device_id, CAST(user_id % 5 + 1 AS VARCHAR) AS type_id,
  event_type = 'error' AS is_disabled, CASE WHEN event_type <> 'signup' THEN event_type = 'purchase' END AS is_reserved,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 100 + 327 * (CAST(floor(value * 100) AS INT) // 327) ELSE CAST(floor(value * 100) AS INT) END AS range_m"""
_SHAPE_ROWS = ", ".join(f"({s}, {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)" for s, x1, y1, x2, y2 in shape_edges())
_PICK = "[" + ", ".join(f"'{t}'" for t in REPORT_TYPES) + "]"

VIEWS = {
    "points": f"""SELECT *, CAST(ts AS DATE) AS day FROM (SELECT {_EVENT.format(ts="ts,")},
  CASE WHEN event_id % 97 = 0 THEN 30.0::DOUBLE ELSE 39.58::DOUBLE + ((event_id * 7919) % 3400) / 10000.0::DOUBLE END AS lat,
  CASE WHEN event_id % 97 = 0 THEN 110.0::DOUBLE ELSE -105.25::DOUBLE + ((event_id * 104729) % 7000) / 10000.0::DOUBLE END AS lon FROM events)""",
    "moving": f"""SELECT * EXCLUDE (k), 39.58::DOUBLE + ((user_id * 7919 + k * 131) % 3400) / 10000.0::DOUBLE AS lat, -105.25::DOUBLE + ((user_id * 104729 + k * 257) % 7000) / 10000.0::DOUBLE AS lon
  FROM (SELECT {_EVENT.format(ts="1704067200000000 + (epoch_us(ts) - 1704067200000000) // 120 AS us,")}, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS k FROM events)""",
    "tracked": f"""SELECT * EXCLUDE (k), 39.6::DOUBLE + ((user_id * 7919 + k * 131) % 6) * 0.05::DOUBLE + ((user_id * 31 + k * 17) % 40) * 0.0002::DOUBLE AS lat, -105.2::DOUBLE + ((user_id * 104729 + k * 257) % 10) * 0.06::DOUBLE + ((user_id * 13 + k * 7) % 40) * 0.0002::DOUBLE AS lon
  FROM (SELECT {_EVENT.format(ts="ts, epoch_us(ts) AS us, value, CASE WHEN user_id % 17 <> 0 THEN 'PL-' || lpad(CAST(user_id AS VARCHAR), 5, '0') END AS plate,")}, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS k FROM events)""",
    "vehicle_types": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {'NULL' if d is None else d}::INT)" for a, b, c, d in VEHICLE_TYPES) + ") t(type_id, form_factor, use_type, max_range)",
    "edges": f"""SELECT region_type, 'r' || lpad(CAST(k AS VARCHAR), 2, '0') AS region_name,
  -105.25::DOUBLE + (k % 5 + ux1) * 0.14::DOUBLE + 0.00005::DOUBLE AS x1, 39.58::DOUBLE + (k // 5 + uy1) * 0.068::DOUBLE + 0.00005::DOUBLE AS y1,
  -105.25::DOUBLE + (k % 5 + ux2) * 0.14::DOUBLE + 0.00005::DOUBLE AS x2, 39.58::DOUBLE + (k // 5 + uy2) * 0.068::DOUBLE + 0.00005::DOUBLE AS y2
  FROM (SELECT n_nationkey AS k, unnest(['neighborhood', CASE WHEN n_nationkey % 3 = 0 THEN 'v1' END, CASE WHEN n_nationkey % 4 = 0 THEN 'v2' END, 'er' || (n_nationkey % 6 + 1)]) AS region_type FROM nation)
  JOIN (VALUES {_SHAPE_ROWS}) s(shape, ux1, uy1, ux2, uy2) ON k % 4 = shape AND region_type IS NOT NULL""",
    "terrain": "SELECT p_partkey % 2450 AS cell, CAST(max(p_size) AS BIGINT) * 8 + 1600 AS height FROM part GROUP BY 1",
    "zones": f"""SELECT zone_id, lon + dx1 AS x1, lat + dy1 AS y1, lon + dx2 AS x2, lat + dy2 AS y2 FROM (SELECT o_orderkey AS zone_id,
      CASE WHEN o_orderkey % 3 = 0 THEN 39.74::DOUBLE + (o_orderkey * 7919 % 400) / 10000.0::DOUBLE ELSE 39.58::DOUBLE + (o_orderkey * 7919 % 3400) / 10000.0::DOUBLE END + 0.00003::DOUBLE AS lat,
      CASE WHEN o_orderkey % 3 = 0 THEN -104.98::DOUBLE + (o_orderkey * 104729 % 400) / 10000.0::DOUBLE ELSE -105.25::DOUBLE + (o_orderkey * 104729 % 7000) / 10000.0::DOUBLE END + 0.00003::DOUBLE AS lon FROM orders),
      (VALUES {", ".join("(" + ", ".join(f"{v!r}::DOUBLE" for v in e) + ")" for e in STAR)}) v(dx1, dy1, dx2, dy2)""",
    "tagged": """SELECT *, CASE WHEN lat BETWEEN 39.58::DOUBLE AND 39.92::DOUBLE AND lon BETWEEN -105.25::DOUBLE AND -104.55::DOUBLE THEN 'core'
  WHEN lat BETWEEN 18 AND 54 AND lon BETWEEN 73 AND 135 THEN 'glitch' ELSE 'outlier' END AS status FROM points""",
    "hits": """SELECT event_id, region_type, region_name FROM points JOIN edges e ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
  GROUP BY event_id, region_type, region_name HAVING count(*) % 2 = 1""",
    "refined": """SELECT t.* EXCLUDE (status), CASE WHEN status = 'core' AND h.event_id IS NULL THEN 'outlier' WHEN status = 'outlier' AND h.event_id IS NOT NULL THEN 'core' ELSE status END AS status, status AS tag
  FROM tagged t LEFT JOIN (SELECT DISTINCT event_id FROM hits WHERE region_type = 'neighborhood') h USING (event_id)""",
    "typed": "SELECT r.*, coalesce(form_factor, 'unknown') AS form_factor, use_type, max_range FROM refined r LEFT JOIN vehicle_types USING (type_id)",
    "device_reports": f"SELECT event_id, vehicle, ts, lat, lon, {_PICK}[event_id % 5 + 1] AS report_type, CASE WHEN event_id % 4 <> 0 THEN user_id END AS account_id, '10.0.0.' || (event_id % 5) AS ip FROM points WHERE is_disabled",
    "discount_reports": f"SELECT o_orderkey AS report_id, o_custkey AS account_id, CAST(floor(o_totalprice) AS INT) % 5000 AS cents, o_orderdate AS ts, {_LATLON.format(a='o_orderkey', b='o_orderkey')} FROM orders",
    "trip_events": f"SELECT 'v' || l_suppkey AS vehicle, l_shipdate + to_minutes(l_orderkey % 1440) AS ts, {_LATLON.format(a='l_orderkey', b='l_partkey')}, l_returnflag AS model, l_partkey AS from_id, l_orderkey AS t1, l_linenumber AS t2, l_partkey AS t3, l_suppkey AS t4, l_extendedprice AS t5 FROM lineitem",
    "user_points": "SELECT o_orderkey AS entry_id, o_custkey AS account_id, 2 * (1 + o_orderkey % 10) AS points, o_orderdate AS ts, o_orderkey % 97 AS cell, CASE WHEN o_orderstatus = 'P' THEN 'pending_review' ELSE 'confirmed' END AS status, o_orderkey % 400 AS source_id, o_orderpriority AS action FROM orders",
    "accounts": "SELECT c_custkey AS account_id, CASE WHEN c_custkey % 10 <> 0 THEN c_name END AS display_name, c_mktsegment <> 'MACHINERY' AS shows, c_acctbal > 0 AS public, CASE WHEN c_custkey % 3 = 0 THEN 'User' ELSE 'user' END || (c_custkey // 2) || '@x.org' AS email, c_acctbal AS balance FROM customer",
    "telemetry": """SELECT event_id, ts, event_type AS name, CAST(user_id AS VARCHAR) AS visitor, user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, props, ['spring', 'Spring ', 'none', 'bad code!'][event_id % 4 + 1] AS campaign, value,
  ['Mozilla/5.0 (iPhone; CPU iPhone OS 17)', 'Mozilla/5.0 (Linux; Android 14) Mobile', 'Mozilla/5.0 (Windows NT 10.0)', 'Googlebot/2.1', 'Mozilla/5.0 (iPad; CPU OS 16)'][event_id % 5 + 1] AS ua, ['https://Example.org/a?b', 'news.site/x', '', NULL][event_id % 4 + 1] AS referrer FROM events""",
    "requests": "SELECT l_returnflag AS route, l_linestatus AS method, 200 + 100 * (l_linenumber % 4) AS status, CAST(trunc(l_quantity) AS INT) AS ms, l_linenumber % 2 = 0 AS authed, l_shipdate AS ts FROM lineitem",
    "ride_points": "SELECT l_orderkey AS ride_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, 39.58::DOUBLE + (l_partkey * 37 % 340) / 10000.0::DOUBLE AS lat, -105.25::DOUBLE + (l_suppkey * 53 % 350) / 10000.0::DOUBLE AS lon, CAST(l_partkey % 80 AS DOUBLE) AS acc FROM lineitem",
    "rides": "SELECT o_orderkey AS ride_id, o_custkey AS account_id, o_orderdate AS ts, CAST(floor(o_totalprice) AS BIGINT) AS claimed_m, 60 + o_orderkey % 7200 AS seconds, o_orderkey % 9000 AS route_m, o_orderstatus AS state FROM orders",
    "track_points": """SELECT ride_id, n, issued_us + (n * 150 - CASE WHEN acc > 78 AND j = 1 THEN 300 ELSE 0 END) * 1000000 AS us, lat + j * 0.0002::DOUBLE AS lat, lon + j * 0.0002::DOUBLE AS lon, acc
  FROM (SELECT *, seq * 3 + j - 3 AS n FROM ride_points, (VALUES (0), (1), (2)) t(j)) JOIN (SELECT o_orderkey AS ride_id, epoch_us(o_orderdate) + (o_orderkey % 86400) * 1000000 AS issued_us FROM orders) USING (ride_id)""",
    "donations": """SELECT * EXCLUDE (alat, alon, zlat, zlon, last_us), alat + (ride_id % 16) * 0.0001::DOUBLE AS start_lat, alon AS start_lon, zlat + (ride_id % 150) * 0.0003::DOUBLE AS end_lat, zlon AS end_lon,
    CASE WHEN ride_id % 3 <> 0 THEN alat + (ride_id % 14) * 0.0001::DOUBLE END AS feed_lat, CASE WHEN ride_id % 3 <> 0 THEN alon END AS feed_lon, CASE WHEN ride_id % 7 <> 0 THEN issued_us + ((ride_id % 25) - 12) * 60000000 END AS left_us,
    CASE WHEN ride_id % 4 <> 0 THEN last_us + ((ride_id % 23) - 11) * 60000000 END AS back_us, CASE WHEN ride_id % 4 <> 0 THEN zlat + (ride_id % 17) * 0.0001::DOUBLE END AS back_lat, CASE WHEN ride_id % 4 <> 0 THEN zlon + 0.0004::DOUBLE END AS back_lon,
    CASE WHEN ride_id % 6 <> 0 THEN 40 + ride_id % 60 END AS soc_feed, CASE WHEN ride_id % 5 <> 0 THEN 45 + ride_id % 50 END AS soc_start, CASE WHEN ride_id % 3 = 0 THEN ride_id % 90 END AS soc_end, CASE WHEN ride_id % 8 <> 0 THEN ride_id % 70 END AS soc_back,
    ride_id % 2 = 0 AS battery, ride_id % 3 <> 0 AS nav, ride_id % 11 = 0 AS own_device, ended_us + (ride_id % 41) * 900000000 AS donated_us, CASE WHEN ride_id % 9 <> 0 THEN ended_us + (ride_id % 41) * 900000000 + (ride_id % 10) * 3600000000 END AS settled_us
  FROM (SELECT *, last_us + ((ride_id % 40) - 4) * 60000000 AS ended_us FROM (SELECT o_orderkey AS ride_id, o_custkey AS account_id, 'v' || (o_custkey % 1500) AS vehicle, epoch_us(o_orderdate) + (o_orderkey % 86400) * 1000000 AS issued_us, alat, alon, zlat, zlon,
    epoch_us(o_orderdate) + (o_orderkey % 86400) * 1000000 + (coalesce(c, 0) * 3 - 1) * 150000000 AS last_us FROM orders LEFT JOIN
    (SELECT ride_id AS r, arg_min(lat, seq) AS alat, arg_min(lon, seq) AS alon, arg_max(lat, seq) AS zlat, arg_max(lon, seq) AS zlon, count(*) AS c FROM ride_points GROUP BY 1) ON r = o_orderkey))""",
    "mined": "SELECT vehicle, issued_us + ((ride_id % 7) - 3) * 600000000 AS departed_us, CAST(ride_id % 50 AS DOUBLE) AS burn FROM donations",
    "hourly_temperature": "SELECT hour, CAST((hour * 37) % 35 - 5 AS DOUBLE) AS temp FROM (SELECT unnest(generate_series(min(us) // 3600000000, max(us) // 3600000000 + 1)) AS hour FROM moving) WHERE hour % 13 <> 0",
    "route_edges": "SELECT l_orderkey AS route_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, l_partkey AS way_id, l_quantity AS metres, l_linenumber % 2 = 0 AS street FROM lineitem",
    "ways": "SELECT p_partkey AS way_id, CASE WHEN p_partkey % 5 > 0 THEN (p_partkey % 100) / 100.0::DOUBLE END AS canopy, p_partkey % 3 = 0 AS bikeway FROM part",
    "feature_reports": "SELECT event_id, ts, 'v' || user_id AS vehicle, 'u' || (event_id % 17) AS reporter, CASE WHEN event_id % 6 <> 0 THEN (event_id // 2) % 2 = 1 END AS basket, CASE WHEN event_id % 6 <> 0 THEN (event_id // 4) % 2 = 1 END AS holder, event_id % 8 <> 0 AS plate_valid FROM events",
}


def sql(text: str) -> str:
    """The text with the views that it names (and those that they name) in front."""
    need: dict[str, None] = {}

    def visit(t: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", t) and name not in need:
                visit(VIEWS[name])
                need[name] = None

    visit(text)
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)
    text = text.strip()
    if not views:
        return text
    return f"WITH RECURSIVE {views}, {re.sub(r'^WITH (RECURSIVE )?', '', text)}" if text.startswith("WITH") else f"WITH {views} {text}"


def distance_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """The flat-earth distance in DuckDB."""
    m = "111320.0::DOUBLE"
    dx = f"(({lon2}) - ({lon1})) * {m} * cos(radians((({lat1}) + ({lat2})) / 2.0::DOUBLE))"
    return f"sqrt(({dx}) * ({dx}) + ((({lat2}) - ({lat1})) * {m}) * ((({lat2}) - ({lat1})) * {m}))"
