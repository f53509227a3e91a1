"""Ride paths, route scores, track checks, vehicle states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.folds import ordered_fold
from ..registry import MOVED_METRES
from ..sources import fixtures as fx

LEG_CAP = 3_000.0
RIDE_CAP = 80_000.0


def legs(points: DataFrame) -> DataFrame:
    """Distance from the point before, per ride; null at the first."""
    w = Window.partitionBy("ride_id").orderBy("seq")
    m = geo.metres(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return points.withColumn("leg", m)


def path_length(points: DataFrame) -> DataFrame:
    """Length of each ride; legs above the cap count 0 and are counted apart."""
    x = legs(points)
    capped = F.when(F.col("leg") <= LEG_CAP, F.col("leg")).otherwise(F.lit(0.0))
    return x.groupBy("ride_id").agg(F.count("*").alias("points"), F.round(F.sum(capped), 3).alias("metres"), F.count_if(F.col("leg") > LEG_CAP).alias("dropped"))


def plausibility(rides: DataFrame) -> DataFrame:
    """Error code of a claim: too fast, or far beyond its route; null if plausible."""
    bound = F.least(F.greatest(3 * F.col("route_m"), F.col("route_m") + 1000), F.lit(80_000))
    return rides.withColumn("error", F.when(F.col("claimed_m") > 20 * F.col("seconds"), "too_fast").when(F.col("claimed_m") > bound, "too_far"))


def downsample(path: Column, most: int) -> Column:
    """At most ``most`` evenly spaced elements of an array, ends included."""
    n = F.size(path)
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: (F.bround(k * (n - 1) / (most - 1)) + 1).cast("int"))
    return F.when(n <= most, path).otherwise(F.transform(picks, lambda k: F.element_at(path, k)))


def route_scores(edges: DataFrame, ways: DataFrame) -> DataFrame:
    """Length-weighted canopy (measured ways alone), street share and network share of each route."""
    x = edges.join(ways, "way_id", "left")
    measured = F.sum(F.when(F.col("canopy").isNotNull(), F.col("metres")))
    return x.groupBy("route_id").agg(
        F.round(F.sum(F.col("metres") * F.col("canopy")) / F.nullif(measured, F.lit(0.0)), 9).alias("canopy"), F.round(F.sum(F.when(F.col("street"), F.col("metres")).otherwise(0.0)) / F.sum("metres"), 9).alias("street"),
        F.round(F.sum(F.when(F.col("bikeway"), F.col("metres")).otherwise(0.0)) / F.sum("metres"), 9).alias("network"), F.sum("metres").alias("metres"),
    )


def off_network_runs(edges: DataFrame, ways: DataFrame) -> DataFrame:
    """Runs of consecutive edges off the network: breaks summed over the order number the islands."""
    x = edges.join(ways.select("way_id", "bikeway"), "way_id", "left").withColumn("on", F.coalesce("bikeway", F.lit(False)))
    w = Window.partitionBy("route_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("island", F.sum(F.col("on").cast("long")).over(w)).where("NOT on")
    return x.groupBy("route_id", "island").agg(F.sum("metres").alias("metres"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def vehicle_step(state: tuple | None, reserved: bool, lat: float, lon: float) -> tuple[tuple, str]:
    """One sample: (stop latitude, stop longitude, in rental) before and after, and what happened.

    The distance is to the stored stop, not to the sample before, so slow drift never moves a
    vehicle; during a rental the stop is frozen.
    """
    from math import cos, radians, sqrt

    if state is None:
        return (lat, lon, reserved), "new"
    a, b, riding = state
    if reserved:
        return (a, b, True), "in_rental" if riding else "rental_start"
    dx, dy = (lon - b) * 111_320.0 * cos(radians((a + lat) / 2.0)), (lat - a) * 111_320.0
    moved = sqrt(dx * dx + dy * dy) > MOVED_METRES
    kind = ("trip_end" if moved else "failed_start") if riding else ("moved" if moved else "stationary")
    return (lat, lon, False) if moved else (a, b, False), kind


def vehicle_states(moving: DataFrame) -> DataFrame:
    """What happened at each sample, and where the vehicle stands after it: a fold per vehicle in time order."""

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        vehicle, us, event_id, lat, lon, reserved = row
        state, kind = vehicle_step(state, reserved, lat, lon)
        return state, (event_id, vehicle, us, kind, state[0], state[1])

    x = moving.select("vehicle", "us", "event_id", "lat", "lon", F.coalesce("is_reserved", F.lit(False)).alias("reserved"))
    return ordered_fold(x, ["vehicle"], ["us", "event_id"], step, "event_id long, vehicle string, us long, kind string, stop_lat double, stop_lon double")


WATCH_US = 3 * 3_600_000_000
ABSENT_US = 600_000_000


def ride_watch(watches: DataFrame, samples: DataFrame) -> DataFrame:
    """Where each watch stands: watching, left_feed, resolved or expired, and when the vehicle left and came back.

    ``watches(ride_id, vehicle, start)`` and ``samples(vehicle, us, reserved)`` in microseconds.
    A vehicle has left when it is reserved or unseen for ``ABSENT_US``; it is back at its next
    sample without reservation. Only what happens within ``WATCH_US`` counts. Watches meet
    samples by vehicle and time bucket, so a busy vehicle does not pair its whole history.
    """
    now = F.broadcast(samples.agg(F.max("us").alias("now")))
    bucket = lambda c: F.expr(f"{c} div {WATCH_US}")
    seen = samples.withColumn("before", F.lag("us").over(Window.partitionBy("vehicle").orderBy("us"))).withColumn("bucket", bucket("us"))
    asked = watches.withColumn("bucket", F.explode(F.array(bucket("start"), bucket("start") + 1)))
    x = asked.join(seen, ["vehicle", "bucket"]).where((F.col("us") > F.col("start")) & (F.col("us") <= F.col("start") + WATCH_US))
    since = F.greatest("start", "before")
    out = F.when(F.col("us") - since > ABSENT_US, since + ABSENT_US).when(F.col("reserved"), F.col("us"))
    g = x.groupBy("ride_id").agg(F.min(out).alias("left_us"), F.max("us").alias("last"), F.array_sort(F.collect_list(F.when(~F.col("reserved"), F.col("us")))).alias("free"))
    x = watches.join(g, "ride_id", "left").join(now, F.lit(True))
    silent = F.coalesce("last", "start") + ABSENT_US
    end = F.col("start") + WATCH_US
    left = F.coalesce("left_us", F.when(silent < F.least(end, F.col("now")), silent))
    x = x.withColumn("left_us", left).withColumn("back_us", F.array_min(F.filter("free", lambda t: t > F.col("left_us"))))
    state = F.when(F.col("back_us").isNotNull(), "resolved").when(F.col("now") > end, "expired").when(F.col("left_us").isNotNull(), "left_feed").otherwise("watching")
    return x.select("ride_id", state.alias("state"), "left_us", "back_us")


def watches(s, d) -> DataFrame:  # noqa: ANN001
    """A watch per click."""
    clicks = fx.load(s, d, "events").where("event_type = 'click'").select("event_id")
    return fx.moving(s, d).join(clicks, "event_id").select(F.col("event_id").alias("ride_id"), "vehicle", F.col("us").alias("start"))


P, E = fx.ride_points, fx.route_edges


QUERIES = {
    "leg_distance": lambda s, d: legs(P(s, d)).select("ride_id", F.col("seq").cast("long").alias("seq"), F.round("leg", 6).alias("leg")),
    "path_length": lambda s, d: path_length(P(s, d)),
    "clamp_ride_distance": lambda s, d: fx.rides(s, d).select("ride_id", F.least("claimed_m", F.lit(80_000)).alias("metres"), F.when(F.col("claimed_m") > 80_000, F.col("claimed_m")).alias("clamped_from")),
    "ride_plausibility": lambda s, d: plausibility(fx.rides(s, d)).select("ride_id", "error"),
    "provisional_validation": lambda s, d: fx.rides(s, d).select("ride_id", F.when(F.col("ride_id") % 3 == 0, "ineligible").when(F.col("state") == "P", "pending_feed").otherwise("pending").alias("validation")),
    "elevation_gain": lambda s, d: elevation_gain(s, d),
    "downsample_path": lambda s, d: P(s, d).groupBy("ride_id").agg(F.array_sort(F.collect_list(F.col("seq").cast("long"))).alias("path")).select("ride_id", F.array_join(downsample(F.col("path"), 3).cast("array<string>"), ",").alias("path")),
    "flatten_route_legs": lambda s, d: flatten_legs(s, d),
    "edge_attr_join": lambda s, d: E(s, d).join(fx.ways(s, d), "way_id", "left").select("route_id", F.col("seq").cast("long").alias("seq"), "canopy", "bikeway"),
    "route_scores": lambda s, d: route_scores(E(s, d), fx.ways(s, d)),
    "off_network_islands": lambda s, d: off_network_runs(E(s, d), fx.ways(s, d)).select("route_id", "island", "metres"),
    "adherence": lambda s, d: E(s, d).join(fx.ways(s, d).where("bikeway").select("way_id", F.lit(True).alias("hit")), "way_id", "left").groupBy("route_id").agg(F.round(F.sum(F.when(F.col("hit"), F.col("metres")).otherwise(0.0)) / F.sum("metres"), 6).alias("share")).withColumn("adheres", F.col("share") >= 0.85),
    "donation_to_ride": lambda s, d: fx.rides(s, d).join(P(s, d).groupBy("ride_id").agg(F.count("*").alias("n")).where("n >= 2"), "ride_id").where("state = 'O'").select("ride_id", "n"),
    "existing_route_semi": lambda s, d: fx.rides(s, d).join(E(s, d).select(F.col("route_id").alias("ride_id")), "ride_id", "left_semi").select("ride_id"),
    "expire_abandoned": lambda s, d: fx.rides(s, d).join(F.broadcast(fx.rides(s, d).agg(F.max("ts").alias("now"))), F.lit(True)).select("ride_id", F.when((F.col("state") == "O") & (F.col("ts") < F.col("now") - F.expr("INTERVAL 24 HOURS")), "expired").otherwise(F.col("state")).alias("state")),
    "union_all_rides": lambda s, d: fx.rides(s, d).where("state = 'F'").select("ride_id", F.lit("tracked").alias("kind")).unionByName(P(s, d).where("seq = 1").select("ride_id", F.lit("donated").alias("kind"))),
    "vehicle_state_machine": lambda s, d: vehicle_states(fx.moving(s, d)).select("event_id", "kind"),
    "trip_events": lambda s, d: vehicle_states(fx.moving(s, d)).where(F.col("kind").isin("trip_end", "moved")).select("event_id", "vehicle", "us"),
    "rental_outcomes": lambda s, d: vehicle_states(fx.moving(s, d)).groupBy("vehicle").agg(F.count_if(F.col("kind").isin("trip_end", "failed_start")).alias("rentals"), F.count_if(F.col("kind") == "failed_start").alias("failed")),
    "stop_intervals": lambda s, d: stop_intervals(vehicle_states(fx.moving(s, d))).drop("lat", "lon"),
    "ride_watch": lambda s, d: ride_watch(watches(s, d), fx.moving(s, d).select("vehicle", "us", F.coalesce("is_reserved", F.lit(False)).alias("reserved"))),
    "watch_vs_observed": lambda s, d: watch(s, d),
}


def elevation_gain(s, d) -> DataFrame:  # noqa: ANN001
    """Sum of climbs along a ride; null if any sample is missing."""
    x = P(s, d).withColumn("h", F.when(F.col("acc") < 78, F.col("acc") * 3 + 1600))
    w = Window.partitionBy("ride_id").orderBy("seq")
    x = x.withColumn("up", F.greatest(F.lit(0.0), F.col("h") - F.lag("h").over(w)))
    return x.groupBy("ride_id").agg(F.when(F.count("h") == F.count("*"), F.coalesce(F.sum(F.when(F.col("seq") > 1, F.col("up"))), F.lit(0.0))).alias("gain"))


def flatten_legs(s, d) -> DataFrame:  # noqa: ANN001
    """Vertices of a route's legs in one order: the first vertex of each later leg, which it shares, is dropped."""
    x = P(s, d).select("ride_id", "seq", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    x = x.where("k = 1 OR seq = 1")
    w = Window.partitionBy("ride_id").orderBy("seq", "k")
    return x.select("ride_id", F.col("seq").cast("long").alias("seq"), "k", (F.row_number().over(w) - 1).cast("long").alias("vertex"))


def stop_intervals(states: DataFrame) -> DataFrame:
    """Stops of each vehicle: opened when new or moved, closed by the next opening; failed starts within."""
    w = Window.partitionBy("vehicle").orderBy("us", "event_id")
    x = states.withColumn("stop", F.sum(F.col("kind").isin("new", "moved", "trip_end").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = x.groupBy("vehicle", "stop").agg(F.min("us").alias("arrive"), F.count_if(F.col("kind") == "failed_start").alias("failed"), F.min("stop_lat").alias("lat"), F.min("stop_lon").alias("lon"))
    return g.withColumn("depart", F.lead("arrive").over(Window.partitionBy("vehicle").orderBy("stop")))


def watch(s, d) -> DataFrame:  # noqa: ANN001
    """Watched vehicles against the last day: absent or reserved ones are checked out."""
    p = fx.points(s, d)
    last = p.join(F.broadcast(p.agg(F.max("day").alias("_d"))), F.col("day") == F.col("_d")).groupBy("vehicle").agg(F.max_by("is_reserved", F.struct("ts", "event_id")).alias("is_reserved"), F.lit(True).alias("seen"))
    return p.select("vehicle").distinct().join(last, "vehicle", "left").select("vehicle", F.when(F.col("seen").isNull() | F.coalesce("is_reserved", F.lit(False)), "checked_out").otherwise("parked").alias("state"))


_LEGS = f"lg AS (SELECT *, {fx.distance_sql('p_lat', 'p_lon', 'lat', 'lon')} AS leg FROM (SELECT *, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon FROM ride_points WINDOW w AS (PARTITION BY ride_id ORDER BY seq)))"
_PL = f"{_LEGS}, pl AS (SELECT ride_id, count(*) AS points, round(sum(CASE WHEN leg <= 3000 THEN leg ELSE 0 END), 3) AS metres, count(*) FILTER (WHERE leg > 3000) AS dropped FROM lg GROUP BY 1)"
_ERR = "CASE WHEN claimed_m > 20 * seconds THEN 'too_fast' WHEN claimed_m > least(greatest(3 * route_m, route_m + 1000), 80000) THEN 'too_far' END"
_RS = """SELECT route_id, round(sum(metres * canopy) / nullif(sum(CASE WHEN canopy IS NOT NULL THEN metres END), 0), 9) AS canopy, round(sum(CASE WHEN street THEN metres ELSE 0 END) / sum(metres), 9) AS street,
  round(sum(CASE WHEN bikeway THEN metres ELSE 0 END) / sum(metres), 9) AS network, sum(metres) AS metres FROM route_edges LEFT JOIN ways USING (way_id) GROUP BY 1"""
_RUN = "SELECT route_id, island, sum(metres) AS metres FROM (SELECT e.*, coalesce(bikeway, false) AS on_net, CAST(sum(CASE WHEN bikeway THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM route_edges e LEFT JOIN ways USING (way_id)) WHERE NOT on_net GROUP BY 1, 2"
_D = fx.distance_sql("s.lat", "s.lon", "o.lat", "o.lon")
_VS_OF = f"""vo AS (SELECT *, coalesce(is_reserved, false) AS res, row_number() OVER (PARTITION BY vehicle ORDER BY us, event_id) AS n FROM {{view}}),
  vs AS (SELECT vehicle, n, event_id, us, lat, lon, res AS riding, 'new' AS kind FROM vo WHERE n = 1 UNION ALL
    SELECT o.vehicle, o.n, o.event_id, o.us, CASE WHEN NOT o.res AND {_D} > 16 THEN o.lat ELSE s.lat END, CASE WHEN NOT o.res AND {_D} > 16 THEN o.lon ELSE s.lon END, o.res,
      CASE WHEN o.res THEN CASE WHEN s.riding THEN 'in_rental' ELSE 'rental_start' END WHEN s.riding THEN CASE WHEN {_D} > 16 THEN 'trip_end' ELSE 'failed_start' END WHEN {_D} > 16 THEN 'moved' ELSE 'stationary' END
    FROM vs s JOIN vo o ON o.vehicle = s.vehicle AND o.n = s.n + 1)"""
_VS = _VS_OF.format(view="moving")
SQL = {
    "leg_distance": fx.sql(f"WITH {_LEGS} SELECT ride_id, seq, round(leg, 6) AS leg FROM lg"),
    "path_length": fx.sql(f"WITH {_PL} SELECT * FROM pl"),
    "clamp_ride_distance": fx.sql("SELECT ride_id, least(claimed_m, 80000) AS metres, CASE WHEN claimed_m > 80000 THEN claimed_m END AS clamped_from FROM rides"),
    "ride_plausibility": fx.sql(f"SELECT ride_id, {_ERR} AS error FROM rides"),
    "provisional_validation": fx.sql("SELECT ride_id, CASE WHEN ride_id % 3 = 0 THEN 'ineligible' WHEN state = 'P' THEN 'pending_feed' ELSE 'pending' END AS validation FROM rides"),
    "elevation_gain": fx.sql("SELECT ride_id, CASE WHEN count(h) = count(*) THEN coalesce(sum(CASE WHEN seq > 1 THEN greatest(0.0, h - p) END), 0) END AS gain FROM (SELECT *, lag(h) OVER (PARTITION BY ride_id ORDER BY seq) AS p FROM (SELECT *, CASE WHEN acc < 78 THEN acc * 3 + 1600 END AS h FROM ride_points)) GROUP BY 1"),
    "downsample_path": fx.sql("WITH x AS (SELECT ride_id, list(seq ORDER BY seq) AS p, count(*) AS n FROM ride_points GROUP BY 1) SELECT ride_id, CASE WHEN n <= 3 THEN array_to_string(p, ',') ELSE p[1] || ',' || p[CAST(round_even((n - 1) / 2.0, 0) AS INT) + 1] || ',' || p[n] END AS path FROM x"),
    "flatten_route_legs": fx.sql("SELECT ride_id, seq, k, row_number() OVER (PARTITION BY ride_id ORDER BY seq, k) - 1 AS vertex FROM ride_points, (VALUES (0), (1)) t(k) WHERE k = 1 OR seq = 1"),
    "edge_attr_join": fx.sql("SELECT route_id, seq, canopy, bikeway FROM route_edges LEFT JOIN ways USING (way_id)"),
    "route_scores": fx.sql(_RS),
    "off_network_islands": fx.sql(_RUN),
    "adherence": fx.sql("SELECT *, share >= 0.85 AS adheres FROM (SELECT route_id, round(sum(CASE WHEN bikeway THEN metres ELSE 0 END) / sum(metres), 6) AS share FROM route_edges LEFT JOIN ways USING (way_id) GROUP BY 1)"),
    "donation_to_ride": fx.sql("SELECT ride_id, n FROM rides JOIN (SELECT ride_id, count(*) AS n FROM ride_points GROUP BY 1 HAVING count(*) >= 2) USING (ride_id) WHERE state = 'O'"),
    "existing_route_semi": fx.sql("SELECT ride_id FROM rides WHERE ride_id IN (SELECT route_id FROM route_edges)"),
    "expire_abandoned": fx.sql("SELECT ride_id, CASE WHEN state = 'O' AND ts < (SELECT max(ts) - INTERVAL 24 HOURS FROM rides) THEN 'expired' ELSE state END AS state FROM rides"),
    "union_all_rides": fx.sql("SELECT ride_id, 'tracked' AS kind FROM rides WHERE state = 'F' UNION ALL SELECT ride_id, 'donated' FROM ride_points WHERE seq = 1"),
    "vehicle_state_machine": fx.sql(f"WITH {_VS} SELECT event_id, kind FROM vs"),
    "trip_events": fx.sql(f"WITH {_VS} SELECT event_id, vehicle, us FROM vs WHERE kind IN ('trip_end', 'moved')"),
    "rental_outcomes": fx.sql(f"WITH {_VS} SELECT vehicle, count(*) FILTER (WHERE kind IN ('trip_end', 'failed_start')) AS rentals, count(*) FILTER (WHERE kind = 'failed_start') AS failed FROM vs GROUP BY 1"),
    "stop_intervals": fx.sql(f"WITH {_VS}, y AS (SELECT *, CAST(sum(CASE WHEN kind IN ('new', 'moved', 'trip_end') THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM vs), g AS (SELECT vehicle, stop, min(us) AS arrive, count(*) FILTER (WHERE kind = 'failed_start') AS failed FROM y GROUP BY 1, 2) SELECT *, lead(arrive) OVER (PARTITION BY vehicle ORDER BY stop) AS depart FROM g"),
    "ride_watch": fx.sql("""WITH sm AS (SELECT vehicle, us, coalesce(is_reserved, false) AS reserved, lag(us) OVER (PARTITION BY vehicle ORDER BY us) AS before FROM moving),
      wt AS (SELECT m.event_id AS ride_id, vehicle, us AS start FROM moving m JOIN events e ON e.event_id = m.event_id AND event_type = 'click'),
      jn AS (SELECT ride_id, start, us, reserved, CASE WHEN us - greatest(start, before) > 600000000 THEN greatest(start, before) + 600000000 WHEN reserved THEN us END AS out_us FROM wt LEFT JOIN sm ON sm.vehicle = wt.vehicle AND us > start AND us <= start + 10800000000),
      lf AS (SELECT ride_id, start, coalesce(min(out_us), CASE WHEN coalesce(max(us), start) + 600000000 < least(start + 10800000000, (SELECT max(us) FROM moving)) THEN coalesce(max(us), start) + 600000000 END) AS left_us FROM jn GROUP BY 1, 2),
      bk AS (SELECT lf.ride_id, lf.start, left_us, min(us) FILTER (WHERE NOT reserved AND us > left_us) AS back_us FROM lf JOIN jn USING (ride_id) GROUP BY 1, 2, 3)
      SELECT ride_id, CASE WHEN back_us IS NOT NULL THEN 'resolved' WHEN (SELECT max(us) FROM moving) > start + 10800000000 THEN 'expired' WHEN left_us IS NOT NULL THEN 'left_feed' ELSE 'watching' END AS state, left_us, back_us FROM bk"""),
    "watch_vs_observed": fx.sql("WITH l AS (SELECT vehicle, arg_max(coalesce(is_reserved, false), {'a': ts, 'b': event_id}) AS r FROM points WHERE day = (SELECT max(day) FROM points) GROUP BY 1) SELECT DISTINCT p.vehicle, CASE WHEN l.vehicle IS NULL OR r THEN 'checked_out' ELSE 'parked' END AS state FROM points p LEFT JOIN l USING (vehicle)"),
}
