"""One snapshot of the fleet: state, reports, dwell against peers, quality, reliability, device cards, cell aggregates.

The snapshot is each vehicle's latest sample; its time is that of the latest of all. Reports
and trips of the day before it are filtered by that one time and then meet vehicles by
equi-joins, so no vehicle pairs its history.

What all of this rests on, the stops of each vehicle (one ordered fold) and the snapshot with
the state that follows from them, is computed once and stored (:func:`stage`); dwell of peers,
reports and cells read the stored tables. Hours are compared as measured and rounded only in
what is put out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..sources import fixtures as fx
from ..sources import io
from . import fleet, rides, spatial
from .rollups import local

DAY_US = 86_400_000_000
#: Least charge of each tier, worst first, and the hours of the rules.
TIERS = (("poor", 0), ("acceptable", 28), ("good", 53), ("great", 75))
HARD_HOURS, SOFT_HOURS, DAYLIGHT_HOURS = 24.0, 12.0, 6.0
IDLE_HOURS, OUTLIER_HOURS, FLOOR_HOURS, FLOOR_TIMES = 72.0, 48.0, 36.0, 16.0
#: Report types that say nothing about whether a vehicle runs.
PARKING_TYPES = ("parking",)
METRES_PER_PERCENT = 364


def daylight_hours(start: Column, end: Column) -> Column:
    """Wall-clock hours between two local times that fall in 08:00 to 20:00 of the days they touch; 0 if they do not run forward."""
    days = F.sequence(F.to_date(start), F.greatest(F.to_date(start), F.to_date(end)), F.expr("INTERVAL 1 DAY"))

    def one(day: Column) -> Column:
        base = fx.micros(day.cast("timestamp_ntz"))
        lo, hi = F.greatest(fx.micros(start), base + F.lit(8 * 3_600_000_000)), F.least(fx.micros(end), base + F.lit(20 * 3_600_000_000))
        return F.greatest(F.lit(0).cast("long"), hi - lo)

    return F.aggregate(F.transform(days, one), F.lit(0).cast("long"), lambda a, x: a + x) / 3.6e9


def local_time(us: str) -> Column:
    """Wall-clock time of the study area for microseconds since 1970."""
    return local(F.timestamp_micros(F.col(us)).cast("timestamp_ntz"))


def quality_designation(soc: Column, disabled: Column, reserved: Column, failed: Column, elapsed_h: Column, daylight_h: Column, reported: Column, outlier: Column) -> Column:
    """N/A when disabled, reserved or without a reading; poor when reported or failed more than once; else the charge's tier with demerits.

    Demerits: one for a failed start; two for a day at one place, one for half a day or for six
    hours of daylight; one for a stay out of line with its peers.
    """
    base = F.lit(0)
    for k, (_, least) in enumerate(TIERS):
        base = F.when(soc >= least, k).otherwise(base)
    fails = F.coalesce(failed, F.lit(0))
    stay = F.when(elapsed_h >= HARD_HOURS, 2).when(elapsed_h >= SOFT_HOURS, 1).when(daylight_h >= DAYLIGHT_HOURS, 1).otherwise(0)
    steps = F.when(fails == 1, 1).otherwise(0) + stay + F.when(outlier, 1).otherwise(0)
    tier = F.element_at(F.array(*[F.lit(n) for n, _ in TIERS]), F.greatest(F.lit(0), base - steps) + 1)
    none = F.coalesce(disabled, F.lit(False)) | F.coalesce(reserved, F.lit(False)) | soc.isNull()
    return F.when(none, "N/A").when(reported | (fails > 1), "poor").otherwise(tier)


def reliability_tier(failed: Column, dwell_h: Column, designation: Column, reported: Column, outlier: Column, median_h: Column) -> Column:
    """high_risk, unknown or ok: the first rule that holds; ``failed`` and ``dwell_h`` are null for a vehicle that was never followed."""
    fails, dwell = F.coalesce(failed, F.lit(0)), F.coalesce(dwell_h, F.lit(0.0))
    high = reported | (fails >= 2) | ((fails == 1) & (dwell >= HARD_HOURS)) | (dwell >= IDLE_HOURS) | (outlier & (dwell >= OUTLIER_HOURS))
    slow = (median_h > 0) & (dwell >= 2 * median_h) & (dwell >= F.least(F.lit(FLOOR_HOURS), FLOOR_TIMES * median_h))
    unknown = (failed.isNull() & dwell_h.isNull()) | (designation == "N/A") | (fails == 1) | F.coalesce(slow, F.lit(False))
    return F.when(high, "high_risk").when(unknown, "unknown").otherwise("ok")


def stops(samples: DataFrame) -> DataFrame:
    """Stops of the followed vehicles (those with a plate) in time order."""
    return rides.stop_intervals(rides.vehicle_states(samples.where("plate IS NOT NULL")))


def device_state(stops: DataFrame) -> DataFrame:
    """``(vehicle, first_us, failed)``: since when each followed vehicle stands where it stands, and failed starts there."""
    return stops.where("depart IS NULL").select("vehicle", F.col("arrive").alias("first_us"), "failed")


def trips(stops: DataFrame) -> DataFrame:
    """``(vehicle, us, lat, lon)``: arrival of each trip and the place that it came from."""
    return stops.where("depart IS NOT NULL").select("vehicle", F.col("depart").alias("us"), "lat", "lon")


def latest(samples: DataFrame) -> DataFrame:
    """Each vehicle's latest sample."""
    rest = F.struct(*[c for c in samples.columns if c != "vehicle"])
    return samples.groupBy("vehicle").agg(F.max_by(rest, F.struct("us", "event_id")).alias("s")).select("vehicle", "s.*")


def snapshot(samples: DataFrame) -> DataFrame:
    """Each vehicle's latest sample with ``now``, the latest time of all (one row, sent to every task)."""
    return latest(samples).crossJoin(F.broadcast(samples.agg(F.max("us").alias("now"))))


def reports(samples: DataFrame) -> DataFrame:
    """Negative reports of two kinds at the vehicle's place, in one pass: typed ones on errors, plain ones on high values."""
    cell = geo.hex_name(geo.hex_cell(F.col("lat"), F.col("lon"), 10)).alias("cell")
    kind = F.element_at(F.array(*map(F.lit, fx.REPORT_TYPES)), (F.col("event_id") % 5 + 1).cast("int"))
    typed, plain = F.struct(F.coalesce("is_disabled", F.lit(False)).alias("made"), kind.alias("type")), F.struct(F.coalesce(F.col("value") > 95, F.lit(False)).alias("made"), F.lit(None).cast("string").alias("type"))
    made = samples.select("vehicle", "us", cell, F.explode(F.filter(F.array(typed, plain), lambda r: r["made"])).alias("r"))
    return made.select("vehicle", "us", "cell", F.col("r.type").alias("report_type"))


def with_reported(devices: DataFrame, reports: DataFrame) -> DataFrame:
    """``reported``: a report on the vehicle, in its cell of the finest grid, in the 24 hours before the snapshot; parking reports do not count."""
    now = F.broadcast(devices.agg(F.max("now").alias("_now")))  # one row
    near = reports.crossJoin(now).where((F.col("us") > F.col("_now") - DAY_US) & (F.col("us") <= F.col("_now")))
    near = near.where(F.col("report_type").isNull() | ~F.col("report_type").isin(*PARKING_TYPES))
    keys = near.select(F.col("vehicle").alias("_v"), F.col("cell").alias("_c")).distinct().withColumn("reported", F.lit(True))
    cell = geo.hex_name(geo.hex_cell(F.col("lat"), F.col("lon"), 10))
    x = devices.withColumn("cell10", cell).join(keys, (F.col("vehicle") == F.col("_v")) & (F.col("cell10") == F.col("_c")), "left")
    return x.withColumn("reported", F.coalesce("reported", F.lit(False))).drop("_v", "_c")


def stays(devices: DataFrame) -> DataFrame:
    """``(vehicle, q, r, hours)`` of followed vehicles, for :func:`fleet.dwell_peers`."""
    cell = geo.hex_cell(F.col("lat"), F.col("lon"), 9)
    return devices.where("first_us IS NOT NULL").select("vehicle", cell["q"].alias("q"), cell["r"].alias("r"), "hours")


def with_state(devices: DataFrame, state: DataFrame) -> DataFrame:
    """The snapshot with ``first_us``, ``failed`` and ``hours`` (of dwell); null for vehicles that were never followed."""
    x = devices.join(state, "vehicle", "left")
    return x.withColumn("hours", (F.col("now") - F.col("first_us")) / 3.6e9)


@dataclass
class Stage:
    """Stored tables that all cards are made of."""

    devices: DataFrame  # with_state of the snapshot
    stops: DataFrame


def stage(samples: DataFrame) -> Stage:
    """One fold over the samples for the stops, one grouped pass for the snapshot; both stored."""
    done = io.stored(stops(samples))
    seen = io.stored(latest(samples))
    now = seen.agg(F.max("us")).first()[0]
    return Stage(io.stored(with_state(seen.withColumn("now", F.lit(now).cast("long")), device_state(done))), done)


def cards(made: Stage, reports: DataFrame, lut: DataFrame) -> DataFrame:
    """Every vehicle of the snapshot with charge, state, dwell against peers, quality and reliability."""
    x = with_reported(made.devices, reports)
    peers = fleet.dwell_peers(stays(made.devices)).select("vehicle", "share", "median", "median_h", "outlier")
    x = fleet.battery_percent(x, lut).join(peers, "vehicle", "left").withColumn("outlier", F.coalesce("outlier", F.lit(False)))
    daylight = daylight_hours(local_time("first_us"), local_time("now"))
    x = x.withColumn("designation", quality_designation(F.col("soc"), F.col("is_disabled"), F.col("is_reserved"), F.col("failed"), F.col("hours"), daylight, F.col("reported"), F.col("outlier")))
    return x.withColumn("tier", reliability_tier(F.col("failed"), F.col("hours"), F.col("designation"), F.col("reported"), F.col("outlier"), F.col("median")))


def cell_aggregates(samples: DataFrame, lut: DataFrame, city: DataFrame, resolution: int = 8) -> DataFrame:
    """Per hexagon: devices of core status (refined by the polygons of ``city``), mean charge, share at high risk and mean dwell; trips of the 24 hours before the snapshot and their busiest clock hour."""
    cell = geo.hex_name(geo.hex_cell(F.col("lat"), F.col("lon"), resolution)).alias("cell")
    made = stage(samples)
    x = spatial.refine_status(spatial.envelope_tag(cards(made, reports(samples), lut)), city).where("status = 'core'")
    devices = x.groupBy(cell).agg(
        F.count("*").alias("devices"), F.bround(F.avg("soc")).cast("long").alias("mean_soc"),
        F.bround(F.count_if(F.col("tier") == "high_risk") / F.count("*"), 2).alias("risk_share"), F.bround(F.avg("hours"), 1).alias("mean_dwell"),
    )
    now = F.broadcast(made.devices.agg(F.max("now").alias("now")))  # one row
    recent = trips(made.stops).crossJoin(now).where(F.col("us") > F.col("now") - DAY_US)
    hours = recent.groupBy(cell, F.expr("us div 3600000000").alias("h")).agg(F.count("*").alias("n"))
    started = hours.groupBy("cell").agg(F.sum("n").alias("trips"), F.max("n").alias("peak"))
    return devices.join(started, "cell", "full").select("cell", F.coalesce("devices", F.lit(0)).alias("devices"), "mean_soc", "risk_share", "mean_dwell", F.coalesce("trips", F.lit(0)).alias("trips"), F.coalesce("peak", F.lit(0)).alias("peak"))


def column_groups(devices: DataFrame, ranks: bool = False, cells: bool = False) -> DataFrame:
    """The snapshot's plain columns, and those of the groups that are asked for."""
    cols = ["vehicle", "event_id"]
    if cells:
        devices = devices.withColumns({f"h{r}": geo.hex_name(geo.hex_cell(F.col("lat"), F.col("lon"), r)) for r in (8, 9, 10)})
        cols += ["h8", "h9", "h10"]
    if ranks:
        ranked = fleet.range_ranks(devices.withColumn("day", F.lit(0))).select("vehicle", "rank_x", "rank_y", "quartile")
        devices = devices.join(ranked, "vehicle", "left")
        cols += ["rank_x", "rank_y", "quartile"]
    return devices.select(*cols)


def features(devices: DataFrame) -> DataFrame:
    """GeoJSON features with id, point and properties; missing properties are null."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    own = F.struct(F.lit("Feature").alias("type"), F.col("vehicle").alias("id"), point.alias("geometry"), F.struct("device_id", "type_id", "range_m").alias("properties"))
    return devices.select("vehicle", F.to_json(own, {"ignoreNullFields": "false"}).alias("feature"))


S = fx.tracked


def _cards(s, d):  # noqa: ANN001, ANN202
    return cards(stage(S(s, d)), reports(S(s, d)), fleet.soc_lut(s))


def _peers(s, d):  # noqa: ANN001, ANN202
    return fleet.dwell_peers(stays(stage(S(s, d)).devices))


def device_card(s, d) -> DataFrame:  # noqa: ANN001
    """The public projection of a card."""
    x = _cards(s, d)
    return x.select("vehicle", "soc", "reported", fleet.status_of().alias("state"), "designation", "tier", "failed", F.round("hours", 3).alias("hours"), F.round(F.col("share") * 100, 4).alias("percentile"), "median_h", "outlier", (F.col("soc") * METRES_PER_PERCENT).alias("usable_m"))


def usable_range(s, d) -> DataFrame:  # noqa: ANN001
    """Metres left by charge, and how old the reading is: fresh within an hour, stale later, unknown without a reading."""
    x = fleet.battery_percent(snapshot(S(s, d)), fleet.soc_lut(s))
    age = (F.col("now") - F.col("us")) / 1e6
    return x.select("vehicle", (F.col("soc") * METRES_PER_PERCENT).alias("usable_m"), F.when(F.col("soc").isNull(), "unknown").when(age <= 3600, "fresh").otherwise("stale").alias("reading"))


def cell_dwell(s, d) -> DataFrame:  # noqa: ANN001
    """Mean dwell of the followed vehicles of each cell."""
    x = stays(with_state(snapshot(S(s, d)), device_state(stops(S(s, d)))))
    return x.groupBy("q", "r").agg(F.count("*").alias("n"), F.round(F.avg("hours"), 6).alias("mean_h"))


def dwell_peer_stats(s, d) -> DataFrame:  # noqa: ANN001
    """Scope, peers, share of peers not longer, median and verdict of each followed vehicle."""
    return _peers(s, d).select("vehicle", F.round("hours", 3).alias("hours"), "scope", "peers", "share", "median_h", "outlier")


def daylight(s, d) -> DataFrame:  # noqa: ANN001
    """Daylight hours of up to 60 hours from each event on, in local time."""
    e = fx.load(s, d, "events").withColumn("end", F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 60).cast("int")))
    return e.select("event_id", F.round(daylight_hours(local("ts"), local("end")), 6).alias("hours"))


QUERIES = {
    "points_with_state": lambda s, d: with_state(snapshot(S(s, d)), device_state(stops(S(s, d)))).select("vehicle", "event_id", "first_us", "failed"),
    "has_negative_report": lambda s, d: with_reported(snapshot(S(s, d)), reports(S(s, d))).select("vehicle", "reported"),
    "dwell_peer_rings": lambda s, d: _peers(s, d).select("vehicle", "scope", "peers", "median_h"),
    "dwell_peer_stats": dwell_peer_stats,
    "cell_dwell_mean": cell_dwell,
    "daylight_hours": daylight,
    "quality_designation": lambda s, d: _cards(s, d).select("vehicle", "designation"),
    "reliability_tier": lambda s, d: _cards(s, d).select("vehicle", "tier"),
    "usable_range": usable_range,
    "device_card": device_card,
    "cell_aggregates": lambda s, d: cell_aggregates(S(s, d), fleet.soc_lut(s), fx.boundaries(s, d).where("region_type = 'neighborhood'")),
    "optional_field_groups": lambda s, d: column_groups(snapshot(S(s, d)), ranks=True, cells=True),
    "devices_feature_collection": lambda s, d: features(snapshot(S(s, d))),
}

_STATES = rides._VS_OF.format(view="(SELECT * FROM tracked WHERE plate IS NOT NULL)")
_SNAP = "nw AS (SELECT max(us) AS now FROM tracked), sn AS (SELECT t.*, now FROM (SELECT * FROM tracked QUALIFY row_number() OVER (PARTITION BY vehicle ORDER BY us DESC, event_id DESC) = 1) t, nw)"
_STOPS = f"""{_STATES}, sy AS (SELECT *, CAST(sum(CASE WHEN kind IN ('new', 'moved', 'trip_end') THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM vs),
  sg AS (SELECT vehicle, stop, min(us) AS arrive, count(*) FILTER (WHERE kind = 'failed_start') AS failed, min(lat) AS lat, min(lon) AS lon FROM sy GROUP BY 1, 2), si AS (SELECT *, lead(arrive) OVER (PARTITION BY vehicle ORDER BY stop) AS depart FROM sg),
  ds AS (SELECT vehicle, arrive AS first_us, failed FROM si WHERE depart IS NULL), {_SNAP}, st AS (SELECT sn.*, first_us, failed, (now - first_us) / 3.6e9 AS hours FROM sn LEFT JOIN ds USING (vehicle)),
  sp AS (SELECT vehicle, {fleet._hex_sql(9, 'q')} AS q, {fleet._hex_sql(9, 'r')} AS r, hours FROM st WHERE first_us IS NOT NULL)"""
_RP = f"""rp AS (SELECT DISTINCT vehicle, {fleet.hex_sql(10)} AS cell FROM tracked, nw WHERE us > now - {DAY_US} AND ((is_disabled AND {fx._PICK}[event_id % 5 + 1] <> 'parking') OR value > 95)),
  re AS (SELECT sn.vehicle, rp.vehicle IS NOT NULL AS reported FROM sn LEFT JOIN rp ON rp.vehicle = sn.vehicle AND rp.cell = {fleet.hex_sql(10)})"""
_PEERS = """pa AS (SELECT a.vehicle, a.hours, b.hours AS h, greatest(abs(a.q - b.q), abs(a.r - b.r), abs(a.q - b.q + a.r - b.r)) AS k FROM sp a, sp b),
  pg AS (SELECT vehicle, hours, count(*) FILTER (WHERE k <= 1) AS n1, count(*) FILTER (WHERE k <= 2) AS n2, count(*) AS n0, median(h) FILTER (WHERE k <= 1) AS m1, median(h) FILTER (WHERE k <= 2) AS m2, median(h) AS m0,
    count(*) FILTER (WHERE k <= 1 AND h <= hours) AS c1, count(*) FILTER (WHERE k <= 2 AND h <= hours) AS c2, count(*) FILTER (WHERE h <= hours) AS c0 FROM pa GROUP BY vehicle, hours),
  ps AS (SELECT vehicle, hours, CAST(CASE WHEN n1 >= 5 THEN 1 WHEN n2 >= 5 THEN 2 WHEN n0 >= 5 THEN 0 END AS BIGINT) AS scope, CASE WHEN n1 >= 5 THEN n1 WHEN n2 >= 5 THEN n2 WHEN n0 >= 5 THEN n0 END AS peers,
    CASE WHEN n1 >= 5 THEN m1 WHEN n2 >= 5 THEN m2 WHEN n0 >= 5 THEN m0 END AS med, CASE WHEN n1 >= 5 THEN c1 / n1 WHEN n2 >= 5 THEN c2 / n2 WHEN n0 >= 5 THEN c0 / n0 END AS exact FROM pg),
  pe AS (SELECT *, round(med, 6) AS median_h, round(exact, 6) AS share, coalesce(exact >= 0.9 AND hours >= 3 * med AND hours >= 24, false) AS outlier FROM ps)"""
_LOCAL = "timezone('America/Denver', timezone('UTC', {}))"
_DAYLIGHT = "sum(greatest(0, epoch_us(least(e, day + INTERVAL 20 HOURS)) - epoch_us(greatest(b, day + INTERVAL 8 HOURS)))) / 3.6e9"
_CARDS = f"""{_STOPS}, {_RP}, {_PEERS}, dl0 AS (SELECT vehicle, {_LOCAL.format('make_timestamp(first_us)')} AS b, {_LOCAL.format('make_timestamp(now)')} AS e FROM st WHERE first_us IS NOT NULL),
  dl AS (SELECT vehicle, {_DAYLIGHT} AS daylight FROM (SELECT *, unnest(generate_series(date_trunc('day', b), date_trunc('day', e), INTERVAL 1 DAY)) AS day FROM dl0) GROUP BY 1),
  cx AS (SELECT st.*, {fleet._SOC} AS soc, reported, share, med, median_h, coalesce(outlier, false) AS outlier, coalesce(failed, 0) AS fails, coalesce(st.hours, 0) AS dwell, daylight
    FROM st JOIN re USING (vehicle) LEFT JOIN pe USING (vehicle) LEFT JOIN dl USING (vehicle) LEFT JOIN {fleet._LUT} l ON range_m = l.metres),
  cq AS (SELECT *, CASE WHEN coalesce(is_disabled, false) OR coalesce(is_reserved, false) OR soc IS NULL THEN 'N/A' WHEN reported OR fails > 1 THEN 'poor'
    ELSE ['poor', 'acceptable', 'good', 'great'][greatest(0, CASE WHEN soc >= 75 THEN 3 WHEN soc >= 53 THEN 2 WHEN soc >= 28 THEN 1 ELSE 0 END - CASE WHEN fails = 1 THEN 1 ELSE 0 END
      - CASE WHEN st.hours >= 24 THEN 2 WHEN st.hours >= 12 OR daylight >= 6 THEN 1 ELSE 0 END - CASE WHEN outlier THEN 1 ELSE 0 END) + 1] END AS designation FROM cx st),
  cd AS (SELECT *, CASE WHEN reported OR fails >= 2 OR (fails = 1 AND dwell >= 24) OR dwell >= 72 OR (outlier AND dwell >= 48) THEN 'high_risk'
    WHEN (failed IS NULL AND hours IS NULL) OR designation = 'N/A' OR fails = 1 OR coalesce(med > 0 AND dwell >= 2 * med AND dwell >= least(36.0::DOUBLE, 16 * med), false) THEN 'unknown' ELSE 'ok' END AS tier FROM cq)"""
SQL = {
    "points_with_state": fx.sql(f"WITH {_STOPS} SELECT vehicle, event_id, first_us, failed FROM st"),
    "has_negative_report": fx.sql(f"WITH {_SNAP}, {_RP} SELECT vehicle, reported FROM re"),
    "dwell_peer_rings": fx.sql(f"WITH {_STOPS}, {_PEERS} SELECT vehicle, scope, peers, median_h FROM pe"),
    "dwell_peer_stats": fx.sql(f"WITH {_STOPS}, {_PEERS} SELECT vehicle, round(hours, 3) AS hours, scope, peers, share, median_h, outlier FROM pe"),
    "cell_dwell_mean": fx.sql(f"WITH {_STOPS} SELECT q, r, count(*) AS n, round(avg(hours), 6) AS mean_h FROM sp GROUP BY 1, 2"),
    "daylight_hours": f"""SELECT event_id, round({_DAYLIGHT}, 6) AS hours FROM (SELECT event_id, b, e, unnest(generate_series(date_trunc('day', b), date_trunc('day', e), INTERVAL 1 DAY)) AS day FROM
      (SELECT event_id, {_LOCAL.format('ts')} AS b, {_LOCAL.format('ts + to_hours(event_id % 60)')} AS e FROM events)) GROUP BY event_id""",
    "quality_designation": fx.sql(f"WITH {_CARDS} SELECT vehicle, designation FROM cd"),
    "reliability_tier": fx.sql(f"WITH {_CARDS} SELECT vehicle, tier FROM cd"),
    "usable_range": fx.sql(f"WITH {_SNAP} SELECT vehicle, {fleet._SOC} * 364 AS usable_m, CASE WHEN range_m IS NULL THEN 'unknown' WHEN (now - us) / 1e6 <= 3600 THEN 'fresh' ELSE 'stale' END AS reading FROM sn LEFT JOIN {fleet._LUT} l ON range_m = l.metres"),
    "device_card": fx.sql(f"""WITH {_CARDS} SELECT vehicle, soc, reported, CASE WHEN coalesce(is_disabled, false) THEN 'disabled' WHEN coalesce(is_reserved, false) THEN 'reserved' ELSE 'available' END AS state, designation, tier, failed, round(hours, 3) AS hours,
      round(share * 100, 4) AS percentile, median_h, outlier, soc * 364 AS usable_m FROM cd"""),
    "cell_aggregates": fx.sql(f"""WITH {_CARDS}, cy AS (SELECT DISTINCT vehicle FROM (SELECT vehicle FROM cd JOIN edges e ON region_type = 'neighborhood' AND (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY vehicle, region_name HAVING count(*) % 2 = 1)),
      dv AS (SELECT {fleet.hex_sql(8)} AS cell, count(*) AS devices, CAST(round_even(avg(soc), 0) AS BIGINT) AS mean_soc, round_even(count(*) FILTER (WHERE tier = 'high_risk') / count(*), 2) AS risk_share, round_even(avg(hours), 1) AS mean_dwell
        FROM cd JOIN cy USING (vehicle) WHERE (lat BETWEEN 39.58::DOUBLE AND 39.92::DOUBLE AND lon BETWEEN -105.25::DOUBLE AND -104.55::DOUBLE) OR NOT (lat BETWEEN 18 AND 54 AND lon BETWEEN 73 AND 135) GROUP BY 1),
      hr AS (SELECT {fleet.hex_sql(8)} AS cell, depart // 3600000000 AS h, count(*) AS n FROM si, nw WHERE depart > now - {DAY_US} GROUP BY 1, 2), tr AS (SELECT cell, CAST(sum(n) AS BIGINT) AS trips, max(n) AS peak FROM hr GROUP BY 1)
      SELECT cell, coalesce(devices, 0) AS devices, mean_soc, risk_share, mean_dwell, coalesce(trips, 0) AS trips, coalesce(peak, 0) AS peak FROM dv FULL JOIN tr USING (cell)"""),
    "optional_field_groups": fx.sql(f"""WITH {_SNAP}, rk AS (SELECT *, count(range_m) OVER (PARTITION BY type_id ORDER BY range_m RANGE UNBOUNDED PRECEDING) AS rank_x, count(range_m) OVER (PARTITION BY type_id) AS rank_y, dense_rank() OVER (PARTITION BY type_id ORDER BY range_m) AS ux FROM sn WHERE range_m IS NOT NULL),
      rl AS (SELECT vehicle, rank_x, rank_y, CAST(CASE WHEN uy = 1 THEN 75 ELSE least(3, floor((ux - 1) / uy * 4)) * 25 END AS BIGINT) AS quartile FROM (SELECT *, max(ux) OVER (PARTITION BY type_id) AS uy FROM rk))
      SELECT vehicle, event_id, {', '.join(f'{fleet.hex_sql(r)} AS h{r}' for r in (8, 9, 10))}, rank_x, rank_y, quartile FROM sn LEFT JOIN rl USING (vehicle)"""),
    "devices_feature_collection": fx.sql(f"""WITH {_SNAP} SELECT vehicle, '{{"type":"Feature","id":"' || vehicle || '","geometry":{{"type":"Point","coordinates":[' || CAST(lon AS VARCHAR) || ',' || CAST(lat AS VARCHAR) || ']}},"properties":{{"device_id":"' || device_id || '","type_id":"' || type_id || '","range_m":' || coalesce(CAST(range_m AS VARCHAR), 'null') || '}}}}' AS feature FROM sn"""),
}
