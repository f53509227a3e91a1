"""Route options: detours off the network, equal shapes, choice by profile, exports of rides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import fixtures as fx
from .rides import _RS, off_network_runs, route_scores

DETOUR_METRES = 200.0
#: Part of a bikeway's length that the network profile takes off.
NETWORK_DISCOUNT = 0.3
#: Orders in which each profile prefers the routes of a request; unmeasured values come last.
PROFILES = {
    "shade": "canopy DESC NULLS LAST, metres, route_id",
    "street": "street DESC NULLS LAST, metres, route_id",
    "network": "discounted NULLS LAST, metres, route_id",
    "battery": "burn NULLS LAST, metres, route_id",
}


def longest_detour(edges: DataFrame, ways: DataFrame, least: float = DETOUR_METRES) -> DataFrame:
    """The longest stretch off the network of each route, if it has ``least`` metres, with the bounds of its shape."""
    x = off_network_runs(edges, ways).where(F.col("metres") >= least)
    best = F.max_by(F.struct("metres", "island", "first", "last"), F.struct("metres", -F.col("island"))).alias("b")
    return x.groupBy("route_id").agg(best).select("route_id", "b.metres", "b.island", F.col("b.first").cast("long").alias("first"), F.col("b.last").cast("long").alias("last"))


def request_of(route: str = "route_id") -> Column:
    """The request that a route option belongs to: ten options each."""
    return F.expr(f"{route} div 10").alias("request")


def distinct_options(edges: DataFrame) -> DataFrame:
    """Options of a request with the same ways in the same order as one: the slowest stays, the others become labels.

    Shapes go by a digest of a route's own ways; only a request's few options are gathered.
    """
    way = F.transform(F.array_sort(F.collect_list(F.struct("seq", "way_id"))), lambda e: e["way_id"].cast("string"))
    routes = edges.groupBy("route_id").agg(F.md5(F.array_join(way, ",")).alias("shape"), F.sum("metres").alias("metres"))
    g = routes.groupBy(request_of(), "shape").agg(F.max("metres").alias("slowest"), F.max_by("route_id", F.struct("metres", -F.col("route_id"))).alias("route_id"), F.array_sort(F.collect_list("route_id")).alias("ids"))
    return g.select("request", "route_id", "slowest", F.array_join(F.array_remove("ids", F.col("route_id")).cast("array<string>"), ",").alias("labels"))


def chosen_routes(scores: DataFrame, profiles: dict[str, str] = PROFILES) -> DataFrame:
    """The best option of each request by each profile."""
    x = scores.withColumns({"request": request_of(), "discounted": F.round(F.col("metres") * (1 - NETWORK_DISCOUNT * F.col("network")), 6), "burn": F.round(F.col("metres") * (1.2 - 0.2 * F.col("street")), 6)})
    out = None
    for name, order in profiles.items():
        one = x.withColumn("n", F.expr(f"row_number() OVER (PARTITION BY request ORDER BY {order})")).where("n = 1").select(F.lit(name).alias("profile"), "request", "route_id")
        out = one if out is None else out.unionByName(one)
    return out


def ride_features(rides: DataFrame, points: DataFrame) -> DataFrame:
    """Rides as GeoJSON: a line of two positions or more, else start to end, else null; and the columns of the CSV export."""
    place = lambda lat, lon: F.concat(F.lit("["), lon.cast("decimal(9,5)").cast("string"), F.lit(","), lat.cast("decimal(9,5)").cast("string"), F.lit("]"))
    path = F.array_sort(F.collect_list(F.struct("seq", place(F.col("lat"), F.col("lon")).alias("p"))))
    x = rides.join(points.groupBy("ride_id").agg(path.alias("path")), "ride_id", "left")
    ends = F.when(F.col("start_lat").isNotNull() & F.col("end_lat").isNotNull(), F.array(place(F.col("start_lat"), F.col("start_lon")), place(F.col("end_lat"), F.col("end_lon"))))
    line = F.when(F.size("path") >= 2, F.transform("path", lambda e: e["p"])).otherwise(ends)
    geometry = F.concat(F.lit('{"type":"LineString","coordinates":['), F.array_join(line, ","), F.lit("]}"))
    return x.select("ride_id", "account_id", "issued_us", "ended_us", geometry.alias("geometry"))


E = fx.route_edges


QUERIES = {
    "longest_off_network_run": lambda s, d: longest_detour(E(s, d), fx.ways(s, d)),
    "route_options_dedupe": lambda s, d: distinct_options(E(s, d)),
    "route_rerank": lambda s, d: chosen_routes(route_scores(E(s, d), fx.ways(s, d))),
    "ride_export": lambda s, d: ride_features(fx.donations(s, d), fx.ride_points(s, d)),
}

_OFF = "SELECT route_id, island, sum(metres) AS metres, min(seq) AS first, max(seq) AS last FROM (SELECT e.*, coalesce(bikeway, false) AS on_net, CAST(sum(CASE WHEN bikeway THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM route_edges e LEFT JOIN ways USING (way_id)) WHERE NOT on_net GROUP BY 1, 2"
_PLACE = "'[' || CAST(CAST({b} AS DECIMAL(9,5)) AS VARCHAR) || ',' || CAST(CAST({a} AS DECIMAL(9,5)) AS VARCHAR) || ']'"
SQL = {
    "longest_off_network_run": fx.sql(f"SELECT route_id, metres, island, first, last FROM ({_OFF}) WHERE metres >= 200 QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY metres DESC, island) = 1"),
    "route_options_dedupe": fx.sql("""WITH r AS (SELECT route_id, string_agg(CAST(way_id AS VARCHAR), ',' ORDER BY seq) AS shape, sum(metres) AS m FROM route_edges GROUP BY 1), g AS (SELECT route_id // 10 AS request, shape, max(m) AS slowest, arg_max(route_id, {'a': m, 'b': -route_id}) AS route_id, list(route_id ORDER BY route_id) AS ids FROM r GROUP BY 1, 2)
      SELECT request, route_id, slowest, coalesce(array_to_string([i FOR i IN ids IF i <> route_id], ','), '') AS labels FROM g"""),
    "route_rerank": fx.sql(f"WITH sc AS (SELECT *, route_id // 10 AS request, round(metres * (1 - 0.3::DOUBLE * network), 6) AS discounted, round(metres * (1.2::DOUBLE - 0.2::DOUBLE * street), 6) AS burn FROM ({_RS}) q) " + " UNION ALL ".join(f"SELECT '{n}' AS profile, request, route_id FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY request ORDER BY {o}) = 1)" for n, o in PROFILES.items())),
    "ride_export": fx.sql(f"""WITH pa AS (SELECT ride_id, count(*) AS c, string_agg({_PLACE.format(a='lat', b='lon')}, ',' ORDER BY seq) AS line FROM ride_points GROUP BY 1)
      SELECT ride_id, account_id, issued_us, ended_us, '{{"type":"LineString","coordinates":[' || CASE WHEN c >= 2 THEN line WHEN start_lat IS NOT NULL AND end_lat IS NOT NULL THEN {_PLACE.format(a='start_lat', b='start_lon')} || ',' || {_PLACE.format(a='end_lat', b='end_lon')} END || ']}}' AS geometry FROM donations LEFT JOIN pa USING (ride_id)"""),
}
