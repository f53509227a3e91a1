"""Donated rides from close-out to training rows: path, track checks, settlement, awards, de-identification.

Every step is one grouped pass over the waypoints and equi-joins on the ride; mined rentals
meet donated ones by vehicle and hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources import fixtures as fx
from .rides import LEG_CAP, RIDE_CAP

SECOND = 1_000_000
#: Fixed values of the checks: slack of times, distance and time between track and feed, speeds, least track.
SLACK_US, NEAR_METRES, NEAR_US = 120 * SECOND, 150.0, 600 * SECOND
MOST_SPEED, FAST_SPEED, FAST_SHARE, MOST_ACCURACY = 20.0, 11.0, 0.10, 50.0
LEAST_POINTS, LEAST_METRES = 10, 500.0
#: Fixed values of training rows and of the sweep: a swap's rise and the largest burn in percent, hours after settling and donating.
SWAP_RISE, MOST_BURN = 20, 60
SETTLED_HOURS, DONATED_HOURS = 4, 28


def _metres(a: str, b: str) -> Column:
    return geo.metres(F.col(f"{a}_lat"), F.col(f"{a}_lon"), F.col(f"{b}_lat"), F.col(f"{b}_lon"))


def tracks(points: DataFrame) -> DataFrame:
    """Per ride: number of waypoints, length (legs over the cap left out and counted), ends, times and speeds."""
    w = Window.partitionBy("ride_id").orderBy("n")
    leg = geo.metres(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    dt = (F.col("us") - F.lag("us").over(w)) / SECOND
    slack = F.least(F.col("acc"), F.lit(MOST_ACCURACY)) + F.least(F.lag("acc").over(w), F.lit(MOST_ACCURACY))
    x = points.withColumns({"leg": leg, "dt": dt, "speed": F.when(dt > 0, F.greatest(F.lit(0.0), leg - slack) / dt)})
    at = lambda f, c: f(c, "n")
    return x.groupBy("ride_id").agg(
        F.count("*").alias("points"), F.sum(F.when(F.col("leg") <= LEG_CAP, F.col("leg")).otherwise(0.0)).alias("inner"), F.count_if(F.col("leg") > LEG_CAP).alias("dropped"),
        at(F.min_by, "lat").alias("first_lat"), at(F.min_by, "lon").alias("first_lon"), at(F.min_by, "us").alias("first_us"), at(F.max_by, "lat").alias("last_lat"), at(F.max_by, "lon").alias("last_lon"), at(F.max_by, "us").alias("last_us"),
        F.coalesce(F.bool_and(F.col("dt") > 0), F.lit(True)).alias("forward"), F.max("speed").alias("top"), F.count_if(F.col("speed") > FAST_SPEED).alias("fast"), F.count("speed").alias("timed"),
    )


def close_out(rides: DataFrame, tracks: DataFrame) -> DataFrame:
    """Points, distance and its source when a ride ends: start, track and reported end.

    A final leg over the cap leaves the path with the reported end; other such legs count 0;
    either makes the source partial. A ride without a track is its straight line, whatever its
    length. A distance over the ride cap is recorded at the cap, with what was measured beside it.
    """
    x = rides.join(tracks, "ride_id", "left").withColumn("points", F.coalesce("points", F.lit(0)))
    has = F.col("points") > 0
    x = x.withColumns({"to_first": _metres("start", "first"), "to_end": _metres("last", "end"), "straight": _metres("start", "end")})
    ends = F.coalesce(F.col("to_end") <= LEG_CAP, F.lit(False))
    start_off = has & F.coalesce(F.col("to_first") > LEG_CAP, F.lit(False))
    inner = F.coalesce("inner", F.lit(0.0)) + F.when(F.col("to_first") <= LEG_CAP, F.col("to_first")).otherwise(0.0) + F.when(ends, F.col("to_end")).otherwise(0.0)
    measured = F.round(F.when(has, inner).otherwise(F.coalesce("straight", F.lit(0.0))), 3)
    partial = has & (~ends | start_off | (F.col("dropped") > 0))
    source = F.when(~has, "straight_line").when(partial, "waypoints_partial").otherwise("waypoints")
    count = F.when(F.col("start_lat").isNotNull(), 1).otherwise(0) + F.col("points") + F.when(~has | ends, 1).otherwise(0)
    return x.select("ride_id", count.cast("long").alias("path_points"), source.alias("source"), F.least(F.lit(RIDE_CAP), measured).alias("metres"), F.when(measured > RIDE_CAP, measured).alias("clamped_from"))


def end_matches() -> Column:
    """Whether the track's last waypoint and the vehicle's return to the feed lie within 150 m and 10 minutes; false without either."""
    near = (_metres("last", "back") <= NEAR_METRES) & (F.abs(F.col("back_us") - F.col("last_us")) <= NEAR_US)
    return F.coalesce(near, F.lit(False))


def verdicts(rides: DataFrame, tracks: DataFrame) -> DataFrame:
    """Each check of a donated track in order, reasons, verdict and whether its points wait for review.

    Times must rise and keep within two minutes of the ride, else all later checks are
    skipped; so must speeds. Then start and end are held against the feed (a feed that has not
    answered makes the verdict pending_feed) and the track against its least size.
    """
    x = rides.join(tracks, "ride_id")
    timely = F.col("forward") & (F.col("first_us") >= F.col("issued_us") - SLACK_US) & (F.col("last_us") <= F.col("ended_us") + SLACK_US)
    slow = F.coalesce(F.col("top") <= MOST_SPEED, F.lit(True))
    anchored = geo.metres(F.col("first_lat"), F.col("first_lon"), F.coalesce("feed_lat", "start_lat"), F.coalesce("feed_lon", "start_lon")) <= NEAR_METRES
    start = F.coalesce(anchored, F.lit(False)) & F.coalesce(F.abs(F.col("issued_us") - F.col("left_us")) <= NEAR_US, F.lit(True))
    end = F.when(F.col("back_us").isNull(), "pending_feed").when(end_matches(), "ok").otherwise("end_mismatch")
    metres = F.least(F.lit(RIDE_CAP), F.col("inner"))
    volume = F.array_compact(F.array(F.when(F.col("points") < LEAST_POINTS, "too_few_waypoints"), F.when(metres < LEAST_METRES, "trip_too_short")))
    x = x.withColumns({"timely": timely, "slow": slow})
    reached = timely & slow
    skip = lambda c: F.when(reached, c).otherwise("skipped")
    x = x.withColumns({
        "monotonic": F.when(timely, "ok").otherwise("invalid_timing"), "speed": F.when(~timely, "skipped").when(slow, "ok").otherwise("too_fast"),
        "gbfs_start": skip(F.when(start, "ok").otherwise("start_mismatch")), "gbfs_end": skip(end), "volume": skip(F.when(F.size(volume) > 0, volume[0]).otherwise("ok")),
    })
    reasons = F.when(reached, F.concat(F.array_compact(F.array(F.when(~start, "start_mismatch"), F.when(F.col("gbfs_end") == "end_mismatch", "end_mismatch"))), volume)).otherwise(F.array().cast("array<string>"))
    verdict = F.when(~reached | (F.size(reasons) > 0), "ineligible").when(F.col("gbfs_end") == "pending_feed", "pending_feed").otherwise("eligible")
    review = F.when(timely & (F.col("fast") > FAST_SHARE * F.col("timed")), "pending_review").otherwise("ok")
    return x.withColumns({"metres": F.round(metres, 3), "reasons": F.array_join(reasons, ","), "verdict": verdict, "points_status": review})


def _burn() -> Column:
    """Charge used, if it is known at both ends and within bounds."""
    burn = (F.coalesce("soc_feed", "soc_start") - F.coalesce("soc_end", "soc_back")).cast("double")
    return F.when((burn > -SWAP_RISE) & (burn > 0) & (burn <= MOST_BURN), burn)


def training_rows(x: DataFrame) -> DataFrame:
    """Observations of burn from rides whose charge is known at both ends: the feed's reading at the start before the rider's, the rider's at the end before the feed's; burns out of bounds are left out."""
    return x.where(_burn().isNotNull()).select("ride_id", "vehicle", F.col("issued_us").alias("departed_us"), F.col("ended_us").alias("arrived_us"), "metres", _burn().alias("burn"), F.when(F.col("soc_end").isNotNull(), 0).otherwise(1).alias("offset_cycles"))


def settle(rides: DataFrame, tracks: DataFrame) -> DataFrame:
    """Late settlement of donations that waited for the feed: status, reason, awards, and whether a training row follows.

    A donation waited if the vehicle had not come back when it was made and nothing else was
    against it. Awards need points that do not wait for review: one for battery data (option
    on, not the rider's own vehicle, both charges known) and one for distance (option on).
    Rides meet their tracks once: what the feed said later is carried beside what it had said then.
    """
    waiting = F.col("back_us").isNull() | (F.col("back_us") > F.col("donated_us"))
    then = {"back_us": F.when(~waiting, F.col("back_us")), "back_lat": F.when(~waiting, F.col("back_lat")), "back_lon": F.when(~waiting, F.col("back_lon"))}
    own = rides.withColumns({f"_{c}": F.col(c) for c in then}).withColumns(then)
    x = verdicts(own, tracks).where("verdict = 'pending_feed'").withColumns({c: F.col(f"_{c}") for c in then})
    known = F.coalesce("soc_feed", "soc_start").isNotNull() & F.col("soc_end").isNotNull()
    x = x.withColumn("ok", end_matches())
    paid = F.col("ok") & (F.col("points_status") == "ok")
    x = x.withColumns({
        "battery_points": F.when(paid & F.col("battery") & ~F.col("own_device") & known, 8 + 2 * F.ceil(F.col("metres") / 2000)).otherwise(0).cast("long"),
        "nav_points": F.when(paid & F.col("nav"), 2 * F.ceil(F.col("metres") / 3000)).otherwise(0).cast("long"),
    })
    return x.select("ride_id", F.when(F.col("ok"), "eligible").otherwise("ineligible").alias("status"), F.when(~F.col("ok"), "end_mismatch").alias("reason"), "battery_points", "nav_points", (F.col("ok") & _burn().isNotNull()).alias("trained"))


def donated_observations(rides: DataFrame, tracks: DataFrame, mined: DataFrame) -> DataFrame:
    """Training rows of eligible donations, and the mined ones that no donated ride of the vehicle covers: a join on vehicle and hour."""
    own = training_rows(verdicts(rides, tracks).where("verdict = 'eligible'"))
    hour = 3_600_000_000
    spans = own.select(F.col("vehicle").alias("_v"), "departed_us", "arrived_us", F.explode(F.sequence(F.expr(f"departed_us div {hour}"), F.expr(f"arrived_us div {hour}"))).alias("_h")).withColumnsRenamed({"departed_us": "_lo", "arrived_us": "_hi"})
    on = (F.col("vehicle") == F.col("_v")) & (F.expr(f"departed_us div {hour}") == F.col("_h")) & F.col("departed_us").between(F.col("_lo"), F.col("_hi"))
    rest = mined.join(spans, on, "left_anti")
    return own.select("vehicle", "departed_us", "burn", F.lit("donated").alias("origin"), "offset_cycles").unionByName(rest.select("vehicle", "departed_us", "burn", F.lit("mined").alias("origin"), F.lit(None).cast("int").alias("offset_cycles")))


def deidentify(rides: DataFrame, points: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Donations with owners taken from those past a clock (settled over 4 or donated over 28 hours ago), and their waypoints with times cut to the minute.

    ``now`` is the latest donation's time if not given. Routes are swept by the second clock alone.
    """
    last = F.broadcast(rides.agg(F.max("donated_us").alias("now")))  # one row
    x = rides.crossJoin(last) if now is None else rides.withColumn("now", now)
    hour = 3_600 * SECOND
    forced = F.col("donated_us") < F.col("now") - DONATED_HOURS * hour
    x = x.withColumn("swept", forced | F.coalesce(F.col("settled_us") < F.col("now") - SETTLED_HOURS * hour, F.lit(False)))
    out = x.select("ride_id", F.when(~F.col("swept"), F.col("account_id")).alias("owner"), F.when(F.col("swept"), F.col("now")).alias("stamped_us"), F.when(~forced, F.col("account_id")).alias("route_owner"))
    swept = x.where("swept").select("ride_id", F.lit(True).alias("_swept"))
    ms = F.expr("us div 1000")
    cut = points.join(swept, "ride_id", "left").withColumn("recorded_ms", F.when(F.col("_swept"), F.floor(ms / 60_000) * 60_000).otherwise(ms).cast("long"))
    return out, cut.select("ride_id", "n", "recorded_ms")


D, TP = fx.donations, fx.track_points


def _verdicts(s, d):  # noqa: ANN001, ANN202
    return verdicts(D(s, d), tracks(TP(s, d)))


QUERIES = {
    "close_out_rides": lambda s, d: close_out(D(s, d), tracks(TP(s, d))),
    "monotonic_check": lambda s, d: _verdicts(s, d).select("ride_id", "monotonic"),
    "sustained_speed_flag": lambda s, d: _verdicts(s, d).select("ride_id", F.round("top", 6).alias("top"), "fast", "points_status"),
    "gbfs_end_match": lambda s, d: D(s, d).join(tracks(TP(s, d)), "ride_id").select("ride_id", end_matches().alias("matches")),
    "track_verdict": lambda s, d: _verdicts(s, d).select("ride_id", "monotonic", "speed", "gbfs_start", "gbfs_end", "volume", "reasons", "verdict", "points_status", "metres"),
    "finalize_validation": lambda s, d: settle(D(s, d), tracks(TP(s, d))),
    "donated_observation": lambda s, d: donated_observations(D(s, d), tracks(TP(s, d)), fx.mined(s, d)),
    "deidentify_sweep": lambda s, d: deidentify(D(s, d), TP(s, d))[0],
    "deidentify_points": lambda s, d: deidentify(D(s, d), TP(s, d))[1],
}

_M = fx.distance_sql
_TRACKS = f"""tl AS (SELECT *, {_M('p_lat', 'p_lon', 'lat', 'lon')} AS leg, (us - p_us) / 1000000 AS dt, least(acc, 50.0::DOUBLE) + least(p_acc, 50.0::DOUBLE) AS slack FROM
    (SELECT *, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lag(us) OVER w AS p_us, lag(acc) OVER w AS p_acc FROM track_points WINDOW w AS (PARTITION BY ride_id ORDER BY n))),
  tk AS (SELECT ride_id, count(*) AS points, sum(CASE WHEN leg <= 3000 THEN leg ELSE 0 END) AS inner_m, count(*) FILTER (WHERE leg > 3000) AS dropped, arg_min(lat, n) AS first_lat, arg_min(lon, n) AS first_lon, arg_min(us, n) AS first_us,
    arg_max(lat, n) AS last_lat, arg_max(lon, n) AS last_lon, arg_max(us, n) AS last_us, coalesce(bool_and(dt > 0), true) AS forward, max(speed) AS top, count(*) FILTER (WHERE speed > 11) AS fast, count(speed) AS timed
    FROM (SELECT *, CASE WHEN dt > 0 THEN greatest(0.0::DOUBLE, leg - slack) / dt END AS speed FROM tl) GROUP BY 1)"""
_END = f"coalesce({_M('last_lat', 'last_lon', '{b}_lat', '{b}_lon')} <= 150 AND abs({{b}}_us - last_us) <= 600000000, false)"
_END = _END.replace("{b}", "back")


def _verdict_sql(rides: str, name: str) -> str:
    """CTEs that end in ``name``: verdicts of ``rides`` (a table with what was known of the feed)."""
    start = f"(coalesce({_M('first_lat', 'first_lon', 'coalesce(feed_lat, start_lat)', 'coalesce(feed_lon, start_lon)')} <= 150, false) AND coalesce(abs(issued_us - left_us) <= 600000000, true))"
    return f"""{name}0 AS (SELECT *, forward AND first_us >= issued_us - 120000000 AND last_us <= ended_us + 120000000 AS timely, coalesce(top <= 20, true) AS slow, {start} AS started,
    CASE WHEN back_us IS NULL THEN 'pending_feed' WHEN {_END} THEN 'ok' ELSE 'end_mismatch' END AS ended, least(80000.0::DOUBLE, inner_m) AS m,
    concat_ws(',', CASE WHEN points < 10 THEN 'too_few_waypoints' END, CASE WHEN least(80000.0::DOUBLE, inner_m) < 500 THEN 'trip_too_short' END) AS vol FROM {rides} JOIN tk USING (ride_id)),
  {name}1 AS (SELECT *, timely AND slow AS reached, CASE WHEN timely AND slow THEN concat_ws(',', CASE WHEN NOT started THEN 'start_mismatch' END, CASE WHEN ended = 'end_mismatch' THEN 'end_mismatch' END, nullif(vol, '')) ELSE '' END AS reasons FROM {name}0),
  {name} AS (SELECT *, CASE WHEN timely THEN 'ok' ELSE 'invalid_timing' END AS monotonic, CASE WHEN NOT timely THEN 'skipped' WHEN slow THEN 'ok' ELSE 'too_fast' END AS speed, CASE WHEN NOT reached THEN 'skipped' WHEN started THEN 'ok' ELSE 'start_mismatch' END AS gbfs_start,
    CASE WHEN reached THEN ended ELSE 'skipped' END AS gbfs_end, CASE WHEN NOT reached THEN 'skipped' WHEN vol = '' THEN 'ok' ELSE string_split(vol, ',')[1] END AS volume, CASE WHEN NOT reached OR reasons <> '' THEN 'ineligible' WHEN ended = 'pending_feed' THEN 'pending_feed' ELSE 'eligible' END AS verdict,
    CASE WHEN timely AND fast > 0.1 * timed THEN 'pending_review' ELSE 'ok' END AS points_status, round(m, 3) AS metres FROM {name}1)"""


_VD = f"{_TRACKS}, {_verdict_sql('donations', 'vd')}"
_BURN = "CAST(coalesce(soc_feed, soc_start) - coalesce(soc_end, soc_back) AS DOUBLE)"
_FINE = f"coalesce({_BURN} > 0 AND {_BURN} <= 60, false)"
_OBS = f"ob AS (SELECT vehicle, issued_us AS departed_us, ended_us AS arrived_us, {_BURN} AS burn, CASE WHEN soc_end IS NOT NULL THEN 0 ELSE 1 END AS offset_cycles FROM vd WHERE verdict = 'eligible' AND {_FINE})"
_SWEPT = "dn AS (SELECT *, donated_us < now - 28 * 3600000000 AS forced, donated_us < now - 28 * 3600000000 OR coalesce(settled_us < now - 4 * 3600000000, false) AS swept FROM donations, (SELECT max(donated_us) AS now FROM donations))"
SQL = {
    "close_out_rides": fx.sql(f"""WITH {_TRACKS}, ec AS (SELECT *, coalesce(points, 0) AS np, coalesce({_M('last_lat', 'last_lon', 'end_lat', 'end_lon')} <= 3000, false) AS ends, {_M('start_lat', 'start_lon', 'first_lat', 'first_lon')} AS tf, {_M('last_lat', 'last_lon', 'end_lat', 'end_lon')} AS te, {_M('start_lat', 'start_lon', 'end_lat', 'end_lon')} AS sl FROM donations LEFT JOIN tk USING (ride_id)),
      em AS (SELECT *, round(CASE WHEN np > 0 THEN coalesce(inner_m, 0) + CASE WHEN tf <= 3000 THEN tf ELSE 0 END + CASE WHEN ends THEN te ELSE 0 END ELSE coalesce(sl, 0) END, 3) AS m FROM ec)
      SELECT ride_id, CASE WHEN start_lat IS NOT NULL THEN 1 ELSE 0 END + np + CASE WHEN np = 0 OR ends THEN 1 ELSE 0 END AS path_points, CASE WHEN np = 0 THEN 'straight_line' WHEN NOT ends OR coalesce(tf > 3000, false) OR dropped > 0 THEN 'waypoints_partial' ELSE 'waypoints' END AS source,
        least(80000.0::DOUBLE, m) AS metres, CASE WHEN m > 80000 THEN m END AS clamped_from FROM em"""),
    "monotonic_check": fx.sql(f"WITH {_VD} SELECT ride_id, monotonic FROM vd"),
    "sustained_speed_flag": fx.sql(f"WITH {_VD} SELECT ride_id, round(top, 6) AS top, fast, points_status FROM vd"),
    "gbfs_end_match": fx.sql(f"WITH {_TRACKS} SELECT ride_id, {_END} AS matches FROM donations JOIN tk USING (ride_id)"),
    "track_verdict": fx.sql(f"WITH {_VD} SELECT ride_id, monotonic, speed, gbfs_start, gbfs_end, volume, reasons, verdict, points_status, metres FROM vd"),
    "finalize_validation": fx.sql(f"""WITH {_TRACKS}, th AS (SELECT * REPLACE (CASE WHEN back_us <= donated_us THEN back_us END AS back_us, CASE WHEN back_us <= donated_us THEN back_lat END AS back_lat, CASE WHEN back_us <= donated_us THEN back_lon END AS back_lon) FROM donations),
      {_verdict_sql('th', 'vt')}, lt AS (SELECT ride_id, metres, points_status FROM vt WHERE verdict = 'pending_feed'),
      fz AS (SELECT *, {_END} AS ok, {_END} AND points_status = 'ok' AS paid FROM donations JOIN tk USING (ride_id) JOIN lt USING (ride_id))
      SELECT ride_id, CASE WHEN ok THEN 'eligible' ELSE 'ineligible' END AS status, CASE WHEN NOT ok THEN 'end_mismatch' END AS reason, CASE WHEN paid AND battery AND NOT own_device AND coalesce(soc_feed, soc_start) IS NOT NULL AND soc_end IS NOT NULL THEN CAST(8 + 2 * ceil(metres / 2000) AS BIGINT) ELSE 0 END AS battery_points,
        CASE WHEN paid AND nav THEN CAST(2 * ceil(metres / 3000) AS BIGINT) ELSE 0 END AS nav_points, ok AND {_FINE} AS trained FROM fz"""),
    "donated_observation": fx.sql(f"""WITH {_VD}, {_OBS} SELECT vehicle, departed_us, burn, 'donated' AS origin, offset_cycles FROM ob UNION ALL
      SELECT vehicle, departed_us, burn, 'mined', NULL FROM mined m WHERE NOT EXISTS (SELECT 1 FROM ob WHERE ob.vehicle = m.vehicle AND m.departed_us BETWEEN ob.departed_us AND ob.arrived_us)"""),
    "deidentify_sweep": fx.sql(f"WITH {_SWEPT} SELECT ride_id, CASE WHEN NOT swept THEN account_id END AS owner, CASE WHEN swept THEN now END AS stamped_us, CASE WHEN NOT forced THEN account_id END AS route_owner FROM dn"),
    "deidentify_points": fx.sql(f"WITH {_SWEPT} SELECT p.ride_id, n, CASE WHEN swept THEN us // 1000 // 60000 * 60000 ELSE us // 1000 END AS recorded_ms FROM track_points p JOIN dn USING (ride_id)"),
}
