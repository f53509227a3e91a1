"""Daily rollups of trips and web telemetry, service-level windows, analytics reads, privacy steps on events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import ordered_fold
from ..registry import LOCAL_ZONE
from ..sources import fixtures as fx


def local(ts: str | Column) -> Column:
    """Wall-clock time of the study area for a UTC time without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_ZONE), F.col(ts) if isinstance(ts, str) else ts)


def local_day(ts: str | Column) -> Column:
    """Local calendar day."""
    return local(ts).cast("date")


def top_k(rows: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    """The first k rows of each ``by`` (a ranked filter, which Spark limits before the shuffle)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def user_agent(ua: Column) -> tuple[Column, Column]:
    """Device class and system by ordered substring tests."""
    u = F.lower(F.coalesce(ua, F.lit("")))
    device = F.when(u.contains("bot"), "bot").when(u.contains("ipad"), "tablet").when(u.contains("mobile") | u.contains("iphone"), "mobile").when(u == "", "unknown").otherwise("desktop")
    system = F.when(u.contains("iphone") | u.contains("ipad"), "ios").when(u.contains("android"), "android").when(u.contains("windows"), "windows").otherwise("other")
    return device, system


def campaign(code: Column) -> Column:
    """A slug, or the sentinels none and other."""
    c = F.lower(F.trim(F.coalesce(code, F.lit(""))))
    return F.when((c == "") | (c == "none"), "none").when(c.rlike("^[a-z0-9][a-z0-9_-]{0,39}$"), c).otherwise("other")


def referrer_host(r: Column) -> Column:
    """Host of a referrer in lower case; empty is direct."""
    h = F.split(F.regexp_replace(F.coalesce(r, F.lit("")), "^[a-zA-Z]+://", ""), "[/?]").getItem(0)
    return F.coalesce(F.nullif(F.lower(h), F.lit("")), F.lit("direct"))


def props(t: DataFrame) -> DataFrame:
    """Events once per property: ``key``, ``val``."""
    return t.select("*", F.explode(F.from_json("props", "map<string,string>")).alias("key", "val"))


def sla_daily(s, d) -> DataFrame:  # noqa: ANN001
    """Average range and charge state from 06:00 to 09:00 local, counts, and pass at 30 points."""
    x = fx.points(s, d).withColumn("l", local("ts")).where((F.hour("l") >= 6) & (F.hour("l") < 9))
    g = x.groupBy(F.col("l").cast("date").alias("local_day")).agg(F.count("*").alias("n"), F.round(F.avg("range_m"), 6).alias("avg_range"), F.round(F.avg(F.col("is_disabled").cast("double")), 6).alias("avg_disabled"))
    return g.withColumn("passed", F.col("n") >= 30)


#: Size of a sketch, and the share of requests by which a percentile from it may be off at most.
SKETCH_K, SKETCH_ERROR = 800, 0.01


def request_sketches(requests: DataFrame, *by: str) -> DataFrame:
    """Per ``by`` (a day and a route): requests, errors and a KLL quantile sketch of the times, a column of a few kilobytes however many requests there are."""
    sketch = F.kll_sketch_agg_bigint(F.col("ms").cast("long"), F.lit(SKETCH_K))
    return requests.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("status") >= 500).alias("errors"), sketch.alias("sketch"))


def merged_sketches(rows: DataFrame, *by: str) -> DataFrame:
    """Stored rows of :func:`request_sketches` as rows of longer spans: counts add up, sketches merge; no request is read again."""
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.kll_merge_agg_bigint("sketch", F.lit(SKETCH_K)).alias("sketch"))


def quantiles(sketch: Column, *shares: float) -> Column:
    """Values at the given shares of a sketch."""
    return F.kll_sketch_get_quantile_bigint(sketch, F.array(*map(F.lit, shares)))


def trips_per_vehicle(s, d) -> DataFrame:  # noqa: ANN001
    """Trips per vehicle and local day with the latest attributes and a rank with ties."""
    t = fx.trip_events(s, d).withColumn("day", local_day("ts"))
    g = t.groupBy("day", "vehicle").agg(F.count("*").alias("trips"), F.max_by("model", F.struct("ts", "tie")).alias("model"))
    return g.withColumn("place", F.rank().over(Window.partitionBy("day").orderBy(F.desc("trips"))).cast("long"))


T, R = fx.telemetry, fx.requests
QUERIES = {
    "sla_daily": sla_daily,
    "sla_backfill": lambda s, d: sla_daily(s, d).where("local_day BETWEEN DATE'2024-01-05' AND DATE'2024-01-20'"),
    "trips_daily": lambda s, d: fx.trip_events(s, d).groupBy(local_day("ts").alias("day")).agg(F.count("*").alias("trips"), F.count_distinct("vehicle").alias("vehicles")),
    "trips_per_vehicle_ranked": trips_per_vehicle,
    "popularity_rank": lambda s, d: trips_per_vehicle(s, d).select("day", "vehicle", "place"),
    "telemetry_daily": lambda s, d: T(s, d).groupBy(local_day("ts").alias("day"), "name").agg(F.count("*").alias("events"), F.count_distinct("visitor").alias("visitors"), F.count_distinct("session_id").alias("sessions")),
    "prop_topk": lambda s, d: top_k(props(T(s, d)).groupBy("name", "key", "val").agg(F.count("*").alias("n")), 10, ["name", "key"], F.desc("n"), F.col("val")),
    "prop_value_counts": lambda s, d: props(T(s, d)).where("name = 'click' AND key = 'k'").groupBy("val").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "val").limit(15),
    "request_daily": lambda s, d: R(s, d).groupBy("ts", "route", "method", F.concat(F.substring(F.col("status").cast("string"), 1, 1), F.lit("xx")).alias("class")).agg(F.count("*").alias("n"), F.round(F.expr("percentile(ms, 0.5)"), 6).alias("p50"), F.round(F.expr("percentile(ms, 0.95)"), 6).alias("p95"), F.count_if("authed").alias("authed")),
    "status_class": lambda s, d: R(s, d).groupBy(F.concat(F.substring(F.col("status").cast("string"), 1, 1), F.lit("xx")).alias("class")).agg(F.count("*").alias("n")),
    "route_health": lambda s, d: R(s, d).groupBy("route").agg(F.count("*").alias("n"), F.round(F.expr("percentile(ms, 0.95)"), 6).alias("p95"), F.count_if(F.col("status") >= 500).alias("errors")).orderBy(F.desc("n"), "route").limit(25),
    "campaign_daily": lambda s, d: T(s, d).withColumn("c", campaign(F.col("campaign"))).where("c <> 'none'").groupBy(local_day("ts").alias("day"), "c").agg(F.count_distinct("visitor").alias("visitors"), F.count_if(F.col("name") == "signup").alias("signups"), F.count_if(F.col("name") == "purchase").alias("purchases")),
    "campaign_normalise": lambda s, d: T(s, d).select("event_id", campaign(F.col("campaign")).alias("campaign")),
    "daily_active": lambda s, d: T(s, d).groupBy(local_day("ts").alias("day")).agg(F.count_distinct("visitor").alias("visitors"), F.count_distinct("session_id").alias("sessions"), F.count("*").alias("events")),
    "top_events": lambda s, d: T(s, d).groupBy("name").agg(F.count("*").alias("events"), F.count_distinct("visitor").alias("visitors")).orderBy(F.desc("events"), "name"),
    "auth_funnel": lambda s, d: T(s, d).groupBy("name", F.expr("CASE WHEN event_id % 2 = 0 THEN 'email' ELSE 'sms' END").alias("method")).agg(F.count("*").alias("n")),
    "ua_classify": lambda s, d: T(s, d).select("event_id", *[c.alias(n) for c, n in zip(user_agent(F.col("ua")), ("device", "os"))]),
    "entry_mode": lambda s, d: T(s, d).groupBy("session_id").agg(F.min_by("name", F.struct("ts", "event_id")).alias("mode")).groupBy("mode").agg(F.count("*").alias("sessions")),
    "session_sets": lambda s, d: T(s, d).groupBy("session_id").agg(F.array_join(F.sort_array(F.collect_set("name")), " + ").alias("names")).groupBy("names").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "names").limit(15),
    "session_rollup": lambda s, d: T(s, d).groupBy("name").agg(F.count_distinct("session_id").alias("sessions")),
    "referrer_host": lambda s, d: T(s, d).select("event_id", referrer_host(F.col("referrer")).alias("host")),
    "visitor_hash": lambda s, d: T(s, d).select("event_id", F.sha2(F.concat_ws("|", F.sha2(F.concat(F.lit("salt"), F.col("ts").cast("date").cast("string")), 256), "visitor", "ua"), 256).alias("hash")),
    "hourly_status": lambda s, d: fx.points(s, d).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.max_by("is_disabled", F.struct("ts", "event_id")).alias("is_disabled"), F.max("ts").alias("last")),
    "hour_backfill": lambda s, d: hour_backfill(s, d),
    "trailing_window": lambda s, d: fx.trip_events(s, d).join(F.broadcast(fx.trip_events(s, d).agg(F.max("ts").alias("now"))), F.col("ts") > F.col("now") - F.expr("INTERVAL 28 DAYS")).groupBy("model").agg(F.count("*").alias("trips")),
    "latest_metrics": lambda s, d: fx.points(s, d).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), F.max("range_m").alias("best")).orderBy(F.desc("hour")).limit(1),
    "events_recent": lambda s, d: fx.load(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "ts"),
    "text_search_ilike": lambda s, d: fx.load(s, d, "part").where(F.col("p_name").ilike("%RE%")).select("p_partkey", "p_name"),
    "region_trend": lambda s, d: fx.points(s, d).where("type_id = '2'").groupBy("day").agg(F.count("*").alias("n"), F.round(F.avg("range_m"), 6).alias("avg_range")),
    "snapshot_asof": lambda s, d: snapshot_asof(s, d),
    "rate_window": lambda s, d: rate_window(fx.load(s, d, "events").select(F.col("user_id").alias("key"), fx.micros("ts").alias("us"), "event_id"), 3, 86_400_000_000),
}


def hour_backfill(s, d) -> DataFrame:  # noqa: ANN001
    """Hourly rows of the first table, and of the second where the first has none."""
    def hourly(kind: str, tag: str) -> DataFrame:
        e = fx.load(s, d, "events").where(F.col("event_type") == kind)
        return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n")).withColumn("origin", F.lit(tag))

    first, second = hourly("view", "first"), hourly("click", "second")
    return first.unionByName(second.join(first, "hour", "left_anti"))


def snapshot_asof(s, d) -> DataFrame:  # noqa: ANN001
    """For each order date of a month, the newest day with points at or before it."""
    asked = fx.load(s, d, "events").select(F.expr("to_date(ts) + 3").alias("asked")).distinct()
    days = fx.points(s, d).select("day").distinct().withColumn("m", F.trunc("day", "month"))
    months = asked.select("asked", F.explode(F.array(F.trunc("asked", "month"), F.add_months(F.trunc("asked", "month"), -1))).alias("m"))
    return months.join(days, "m").where("day <= asked").groupBy("asked").agg(F.max("day").alias("day"))


def rate_window(events: DataFrame, limit: int, window_us: int) -> DataFrame:
    """Events over a limit per key and trailing window; those rejected do not count.

    A fold over each key's time-ordered events keeps the times of the accepted ones that are
    still in the window, at most ``limit``.
    """

    def step(held: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
        key, us, event_id = row
        live = tuple(t for t in held or () if t > us - window_us)
        return (live, (key, event_id)) if len(live) >= limit else ((*live, us), None)

    return ordered_fold(events.select("key", "us", "event_id"), ["key"], ["us", "event_id"], step, "key long, event_id long")


_L = "CAST(timezone('America/Denver', timezone('UTC', {t})) AS DATE)"
_LD = _L.format(t="ts")
_LT = "timezone('America/Denver', timezone('UTC', ts))"
_CAMP = """CASE WHEN lower(trim(coalesce(campaign, ''))) IN ('', 'none') THEN 'none' WHEN regexp_full_match(lower(trim(campaign)), '[a-z0-9][a-z0-9_-]{0,39}') THEN lower(trim(campaign)) ELSE 'other' END"""
_DEV = """CASE WHEN contains(lower(ua), 'bot') THEN 'bot' WHEN contains(lower(ua), 'ipad') THEN 'tablet' WHEN contains(lower(ua), 'mobile') OR contains(lower(ua), 'iphone') THEN 'mobile' WHEN ua = '' THEN 'unknown' ELSE 'desktop' END AS device,
  CASE WHEN contains(lower(ua), 'iphone') OR contains(lower(ua), 'ipad') THEN 'ios' WHEN contains(lower(ua), 'android') THEN 'android' WHEN contains(lower(ua), 'windows') THEN 'windows' ELSE 'other' END AS os"""
_SLA = f"SELECT *, n >= 30 AS passed FROM (SELECT {_LD} AS local_day, count(*) AS n, round(avg(range_m), 6) AS avg_range, round(avg(CAST(is_disabled AS INT)), 6) AS avg_disabled FROM points WHERE hour({_LT}) >= 6 AND hour({_LT}) < 9 GROUP BY 1)"
_TPV = f"SELECT *, rank() OVER (PARTITION BY day ORDER BY trips DESC) AS place FROM (SELECT {_LD} AS day, vehicle, count(*) AS trips, arg_max(model, {{'a': ts, 'b': t1, 'c': t2, 'd': t3, 'e': t4, 'f': t5}}) AS model FROM trip_events GROUP BY 1, 2)"
_PROPS = "(SELECT t.*, unnest(json_keys(props)) AS key FROM telemetry t)"
_VAL = "json_extract_string(props, '$.' || key)"
SQL = {
    "sla_daily": fx.sql(_SLA),
    "sla_backfill": fx.sql(f"SELECT * FROM ({_SLA}) WHERE local_day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"),
    "trips_daily": fx.sql(f"SELECT {_LD} AS day, count(*) AS trips, count(DISTINCT vehicle) AS vehicles FROM trip_events GROUP BY 1"),
    "trips_per_vehicle_ranked": fx.sql(_TPV),
    "popularity_rank": fx.sql(f"SELECT day, vehicle, place FROM ({_TPV})"),
    "telemetry_daily": fx.sql(f"SELECT {_LD} AS day, name, count(*) AS events, count(DISTINCT visitor) AS visitors, count(DISTINCT session_id) AS sessions FROM telemetry GROUP BY 1, 2"),
    "prop_topk": fx.sql(f"SELECT name, key, val, n FROM (SELECT name, key, {_VAL} AS val, count(*) AS n FROM {_PROPS} GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY name, key ORDER BY n DESC, val) <= 10"),
    "prop_value_counts": fx.sql("SELECT json_extract_string(props, '$.k') AS val, count(*) AS n FROM telemetry WHERE name = 'click' AND json_exists(props, '$.k') GROUP BY 1 ORDER BY n DESC, val LIMIT 15"),
    "request_daily": fx.sql("SELECT ts, route, method, left(CAST(status AS VARCHAR), 1) || 'xx' AS class, count(*) AS n, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, count(*) FILTER (WHERE authed) AS authed FROM requests GROUP BY 1, 2, 3, 4"),
    "status_class": fx.sql("SELECT left(CAST(status AS VARCHAR), 1) || 'xx' AS class, count(*) AS n FROM requests GROUP BY 1"),
    "route_health": fx.sql("SELECT route, count(*) AS n, round(quantile_cont(ms, 0.95), 6) AS p95, count(*) FILTER (WHERE status >= 500) AS errors FROM requests GROUP BY 1 ORDER BY n DESC, route LIMIT 25"),
    "campaign_daily": fx.sql(f"SELECT {_LD} AS day, {_CAMP} AS c, count(DISTINCT visitor) AS visitors, count(*) FILTER (WHERE name = 'signup') AS signups, count(*) FILTER (WHERE name = 'purchase') AS purchases FROM telemetry WHERE {_CAMP} <> 'none' GROUP BY 1, 2"),
    "campaign_normalise": fx.sql(f"SELECT event_id, {_CAMP} AS campaign FROM telemetry"),
    "daily_active": fx.sql(f"SELECT {_LD} AS day, count(DISTINCT visitor) AS visitors, count(DISTINCT session_id) AS sessions, count(*) AS events FROM telemetry GROUP BY 1"),
    "top_events": fx.sql("SELECT name, count(*) AS events, count(DISTINCT visitor) AS visitors FROM telemetry GROUP BY 1"),
    "auth_funnel": fx.sql("SELECT name, CASE WHEN event_id % 2 = 0 THEN 'email' ELSE 'sms' END AS method, count(*) AS n FROM telemetry GROUP BY 1, 2"),
    "ua_classify": fx.sql(f"SELECT event_id, {_DEV} FROM telemetry"),
    "entry_mode": fx.sql("SELECT mode, count(*) AS sessions FROM (SELECT session_id, arg_min(name, {'a': ts, 'b': event_id}) AS mode FROM telemetry GROUP BY 1) GROUP BY 1"),
    "session_sets": fx.sql("SELECT names, count(*) AS n FROM (SELECT session_id, string_agg(DISTINCT name, ' + ' ORDER BY name) AS names FROM telemetry GROUP BY 1) GROUP BY 1 ORDER BY n DESC, names LIMIT 15"),
    "session_rollup": fx.sql("SELECT name, count(DISTINCT session_id) AS sessions FROM telemetry GROUP BY 1"),
    "referrer_host": fx.sql("SELECT event_id, coalesce(nullif(lower(regexp_extract(regexp_replace(coalesce(referrer, ''), '^[a-zA-Z]+://', ''), '^[^/?]*')), ''), 'direct') AS host FROM telemetry"),
    "visitor_hash": fx.sql("SELECT event_id, sha256(sha256('salt' || CAST(CAST(ts AS DATE) AS VARCHAR)) || '|' || visitor || '|' || ua) AS hash FROM telemetry"),
    "hourly_status": fx.sql("SELECT date_trunc('hour', ts) AS hour, arg_max(is_disabled, {'a': ts, 'b': event_id}) AS is_disabled, max(ts) AS last FROM points GROUP BY 1"),
    "hour_backfill": """WITH f AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1), g AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1)
      SELECT hour, n, 'first' AS origin FROM f UNION ALL SELECT hour, n, 'second' FROM g WHERE hour NOT IN (SELECT hour FROM f)""",
    "trailing_window": fx.sql("SELECT model, count(*) AS trips FROM trip_events WHERE ts > (SELECT max(ts) - INTERVAL 28 DAYS FROM trip_events) GROUP BY 1"),
    "latest_metrics": fx.sql("SELECT date_trunc('hour', ts) AS hour, count(*) AS n, max(range_m) AS best FROM points GROUP BY 1 ORDER BY 1 DESC LIMIT 1"),
    "events_recent": "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20",
    "text_search_ilike": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RE%'",
    "region_trend": fx.sql("SELECT day, count(*) AS n, round(avg(range_m), 6) AS avg_range FROM points WHERE type_id = '2' GROUP BY 1"),
    "snapshot_asof": fx.sql("SELECT asked, max(day) AS day FROM (SELECT DISTINCT CAST(ts AS DATE) + 3 AS asked FROM events) JOIN (SELECT DISTINCT day FROM points) ON day <= asked AND day >= date_trunc('month', asked) - INTERVAL 1 MONTH GROUP BY 1"),
    "rate_window": """WITH RECURSIVE o AS (SELECT user_id AS key, epoch_us(ts) AS us, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      f AS (SELECT key, n, event_id, [us] AS held, false AS is_over FROM o WHERE n = 1 UNION ALL
        SELECT o.key, o.n, o.event_id, CASE WHEN len([h FOR h IN f.held IF h > o.us - 86400000000]) >= 3 THEN [h FOR h IN f.held IF h > o.us - 86400000000] ELSE list_append([h FOR h IN f.held IF h > o.us - 86400000000], o.us) END, len([h FOR h IN f.held IF h > o.us - 86400000000]) >= 3 FROM f JOIN o ON o.key = f.key AND o.n = f.n + 1)
      SELECT key, event_id FROM f WHERE is_over""",
}
