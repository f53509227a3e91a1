"""Web telemetry cleaning, campaign and funnel reads, health, retention, stale snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import fixtures as fx
from .rollups import _CAMP, _DEV, _LD, campaign, local_day, user_agent

#: Events of a batch, keys and characters of a property, characters of a session id, clock skew.
BATCH, KEYS, CHARS, SID_CHARS, SKEW_US = 50, 12, 120, 16, 3_600_000_000
NAMES = ("click", "view", "purchase", "signup")
FUNNEL = ("view", "click", "signup", "purchase")
REGISTERED = ("spring",)


def telemetry_clean(events: DataFrame, props: Column | None = None) -> DataFrame:
    """Allowed events of each batch's first fifty: short session id, trusted time, plain properties.

    ``events(event_id, batch, name, sid, received_us, claimed_us, props)``. The claimed time
    holds within an hour of receipt. Properties keep their first twelve plain values, cut to
    120 characters. Batches are cut by rank, so none is gathered. ``props``, if given, makes the
    properties from the columns of an event after the cut, so that long ones are not sorted.
    """
    place = F.row_number().over(Window.partitionBy("batch").orderBy("received_us", "event_id"))
    x = events.withColumn("_place", place).where(F.col("_place") <= BATCH).where(F.col("name").isin(*NAMES))
    plain = F.filter(F.map_entries(F.from_json(F.col("props") if props is None else props, "map<string,string>")), lambda e: e["value"].isNotNull() & (e["key"] != "") & ~e["value"].rlike(r"^[\[{]"))
    text = F.transform(F.slice(plain, 1, KEYS), lambda e: F.concat(F.substring(e["key"], 1, CHARS), F.lit("="), F.substring(e["value"], 1, CHARS)))
    near = F.abs(F.col("claimed_us") - F.col("received_us")) <= SKEW_US
    return x.select("event_id", "name", F.coalesce(F.nullif(F.substring("sid", 1, SID_CHARS), F.lit("")), F.lit("?")).alias("sid"), F.when(near, F.col("claimed_us")).otherwise(F.col("received_us")).alias("us"), F.array_join(text, ";").alias("props"))


def _batches(s, d) -> DataFrame:  # noqa: ANN001
    """Events in batches by user, with a claimed time; :func:`_long_props` makes their properties."""
    t = fx.telemetry(s, d)
    return t.select("event_id", F.col("visitor").alias("batch"), "name", F.concat(F.lit("s"), "session_id", F.lit("/long")).alias("sid"), fx.micros("ts").alias("received_us"), (fx.micros("ts") + (F.col("event_id") % 5 - 2) * 2_400_000_000).alias("claimed_us"), "props")


def _long_props() -> Column:
    """Fifteen properties, one of them nested."""
    more = F.transform(F.sequence(F.lit(1), F.lit(13)), lambda k: F.concat(F.lit(', "a'), F.lpad(k.cast("string"), 2, "0"), F.lit('": "'), F.repeat(F.col("name"), k * 4), F.lit('"')))
    return F.concat(F.substring("props", F.lit(1), F.length("props") - 1), F.lit(', "b": {"c": 1}'), F.array_join(more, ""), F.lit("}"))


def campaign_alltime(s, d) -> DataFrame:  # noqa: ANN001
    """All-time totals of each campaign from its days, the days themselves, and codes that nobody registered."""
    t = fx.telemetry(s, d).withColumns({"c": campaign(F.col("campaign")), "day": local_day("ts")})
    daily = t.groupBy("c", "day").agg(F.count_distinct("visitor").alias("visitors"), F.count("*").alias("events"))
    total = daily.groupBy("c").agg(F.sum("visitors").alias("visitors"), F.sum("events").alias("events"), F.min("day").alias("day"), F.max("day").alias("last_day"))
    registered = s.createDataFrame([(c,) for c in REGISTERED], "c string")  # the list of campaigns
    orphan = total.where("c NOT IN ('none', 'other')").join(registered, "c", "left_anti")
    rows = [(total, "total"), (orphan, "orphan")]
    out = daily.select(F.lit("day").alias("kind"), "c", "day", F.col("day").alias("last_day"), "visitors", "events")
    for frame, kind in rows:
        out = out.unionByName(frame.select(F.lit(kind).alias("kind"), "c", "day", "last_day", "visitors", "events"))
    return out


def ride_funnel(s, d) -> DataFrame:  # noqa: ANN001
    """Visitors and sessions of each step in the order of the flow, and of each screen in numeric order, unnumbered ones last."""
    t = fx.telemetry(s, d)
    place = F.array_position(F.array(*map(F.lit, FUNNEL)), F.col("name"))
    steps = t.where(F.col("name").isin(*FUNNEL)).groupBy("name").agg(F.count_distinct("visitor").alias("visitors"), F.count_distinct("session_id").alias("sessions"))
    steps = steps.select(F.lit("step").alias("kind"), "name", place.cast("double").alias("place"), "visitors", "sessions")
    screens = t.select(F.get_json_object("props", "$.k").alias("name"), "visitor", "session_id").where("name IS NOT NULL").groupBy("name").agg(F.count_distinct("visitor").alias("visitors"), F.count_distinct("session_id").alias("sessions"))
    return steps.unionByName(screens.select(F.lit("screen").alias("kind"), "name", F.coalesce(F.expr("try_cast(name AS double)"), F.lit(99.0)).alias("place"), "visitors", "sessions"))


def viewport(value: Column) -> Column:
    """Width class by share of the screen."""
    return F.when(value < 20, "xs").when(value < 40, "sm").when(value < 60, "md").when(value < 80, "lg").otherwise("xl")


def client_mix(s, d) -> DataFrame:  # noqa: ANN001
    """Visitors by device, system and viewport."""
    device, system = user_agent(F.col("ua"))
    return fx.telemetry(s, d).groupBy(device.alias("device"), system.alias("os"), viewport(F.col("value")).alias("viewport")).agg(F.count_distinct("visitor").alias("visitors"))


def analytics_daily_read(s, d) -> DataFrame:  # noqa: ANN001
    """Rows of three kinds from the rollups: sums and largest counts per day, each event's day, requests per day and route."""
    daily = fx.telemetry(s, d).groupBy(local_day("ts").alias("day"), "name").agg(F.count("*").alias("events"), F.count_distinct("visitor").alias("visitors"), F.count_distinct("session_id").alias("sessions"))
    whole = daily.groupBy("day").agg(F.sum("events").alias("events"), F.max("visitors").alias("visitors"), F.max("sessions").alias("sessions")).withColumn("name", F.lit(None).cast("string"))
    calls = fx.requests(s, d).groupBy(F.col("ts").cast("date").alias("day"), F.col("route").alias("name")).agg(F.count("*").alias("events")).withColumns({"visitors": F.lit(None).cast("long"), "sessions": F.lit(None).cast("long")})
    cols = ["kind", "day", "name", "events", "visitors", "sessions"]
    return whole.withColumn("kind", F.lit("day")).select(*cols).unionByName(daily.withColumn("kind", F.lit("event")).select(*cols)).unionByName(calls.withColumn("kind", F.lit("request")).select(*cols))


def cycles(points: DataFrame) -> DataFrame:
    """A cycle per day: complete if it has points in at least twenty hours."""
    x = points.groupBy(F.col("day").alias("cycle")).agg(F.count_distinct(F.hour("ts")).alias("hours"), F.max("ts").alias("snapshot_at"))
    return x.withColumn("status", F.when(F.col("hours") >= 20, "complete").otherwise("running"))


def latest_cycle(s, d) -> DataFrame:  # noqa: ANN001
    """The newest complete cycle that has metrics (points in the study area)."""
    from .spatial import envelope_tag

    p = fx.points(s, d)
    metrics = envelope_tag(p).where("status = 'core'").groupBy(F.col("day").alias("cycle")).agg(F.count("*").alias("core"))
    return cycles(p).where("status = 'complete'").join(metrics, "cycle").orderBy(F.desc("snapshot_at")).limit(1).select("cycle", "snapshot_at", "core")


def hours_missing(s, d) -> DataFrame:  # noqa: ANN001
    """Per day of the span: hours without a reading, and whether that is within the tolerance of one."""
    hour = F.expr("unix_micros(cast(ts as timestamp)) div 3600000000")
    e = fx.load(s, d, "events")
    span = e.agg(F.min(hour).alias("lo"), F.max(hour).alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("hour"))
    missing = span.join(e.where("event_type <> 'error'").select(hour.alias("hour")).distinct().withColumn("seen", F.lit(True)), "hour", "left")
    g = missing.groupBy(F.expr("hour div 24").alias("day")).agg(F.count_if(F.col("seen").isNull()).alias("missing"))
    return g.withColumn("usable", F.col("missing") <= 1)


def retention(s, d) -> DataFrame:  # noqa: ANN001
    """What stays of five tables: events 90 days, requests 30 days, reports 2 days, runs 30 days, the ledger 18 calendar months, each back from its latest row."""
    def kept(kind: str, rows: DataFrame, key: Column, keep: str) -> DataFrame:
        last = F.broadcast(rows.agg(F.max("ts").alias("_last")))  # one row
        return rows.crossJoin(last).where(F.expr(f"ts >= _last - {keep}")).select(F.lit(kind).alias("kind"), key.cast("long").alias("key"))

    x = fx.load(s, d, "lineitem").select(F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"))
    out = kept("events", fx.load(s, d, "events"), F.col("event_id"), "INTERVAL 90 DAYS")
    for more in (kept("requests", x, F.col("key"), "INTERVAL 30 DAYS"), kept("reports", fx.device_reports(s, d), F.col("event_id"), "INTERVAL 2 DAYS"), kept("runs", fx.rides(s, d), F.col("ride_id"), "INTERVAL 30 DAYS"), kept("ledger", fx.user_points(s, d), F.col("entry_id"), "INTERVAL 18 MONTHS")):
        out = out.unionByName(more)
    return out


def snapshots(s, d) -> DataFrame:  # noqa: ANN001
    """A snapshot per day, one more with the same feed time every fifth day, one more without a feed time every seventh."""
    p = fx.points(s, d).select("day", "vehicle", "lat", "lon", "range_m")
    number = F.datediff("day", F.lit("2024-01-01").cast("date"))
    kinds = F.array_compact(F.array(F.lit(0), F.when(number % 5 == 0, F.lit(1)), F.when(number % 7 == 0, F.lit(2))))
    x = p.withColumn("k", F.explode(kinds))
    return x.select((number * 10 + F.col("k")).cast("long").alias("snapshot"), F.when((F.col("k") < 2) & (number % 7 != 1), number.cast("long") * 86400).alias("last_updated"), "vehicle", "lat", "lon", "range_m")


def stale_snapshots(snapshots: DataFrame) -> DataFrame:
    """``stale``: the feed's time equals the one before it; without a feed time, the content does.

    Content goes by count, exclusive or and sum of row hashes: sums that merge, so no snapshot
    is gathered. The window runs over one row per snapshot.
    """
    h = F.xxhash64("vehicle", "lat", "lon", "range_m")
    x = snapshots.groupBy("snapshot").agg(F.max("last_updated").alias("lu"), F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).alias("t"))
    w = Window.partitionBy(F.lit(0)).orderBy("snapshot")
    same = (F.col("n") == F.lag("n").over(w)) & (F.col("x") == F.lag("x").over(w)) & (F.col("t") == F.lag("t").over(w))
    stale = F.when(F.col("lu").isNotNull() & F.lag("lu").over(w).isNotNull(), F.col("lu") == F.lag("lu").over(w)).otherwise(same)
    return x.select("snapshot", F.coalesce(stale, F.lit(False)).alias("stale"))


def pipeline_health(s, d) -> DataFrame:  # noqa: ANN001
    """Last ingest, last complete cycle, and the last day whose archive was complete; one row."""
    p = fx.points(s, d)
    c = cycles(p)
    ingest = p.agg(F.max("ts").alias("last_ingest"))
    done = c.where("status = 'complete'").agg(F.max("cycle").alias("last_cycle"))
    sent = c.where("hours = 24").agg(F.max("cycle").alias("last_upload"))
    return ingest.crossJoin(F.broadcast(done)).crossJoin(F.broadcast(sent))  # one row each


QUERIES = {
    "telemetry_clean": lambda s, d: telemetry_clean(_batches(s, d), _long_props()),
    "campaign_alltime": campaign_alltime,
    "ride_funnel": ride_funnel,
    "client_mix": client_mix,
    "analytics_daily_read": analytics_daily_read,
    "latest_cycle": latest_cycle,
    "hours_missing": hours_missing,
    "retention_prune": retention,
    "drop_stale_snapshots": lambda s, d: stale_snapshots(snapshots(s, d)),
    "pipeline_health": pipeline_health,
}

_CYCLES = "cy AS (SELECT day AS cycle, count(DISTINCT hour(ts)) AS hours, max(ts) AS snapshot_at FROM points GROUP BY 1)"
_DAILY = f"dd AS (SELECT {_CAMP} AS c, {_LD} AS day, count(DISTINCT visitor) AS visitors, count(*) AS events FROM telemetry GROUP BY 1, 2), tt AS (SELECT c, min(day) AS day, max(day) AS last_day, CAST(sum(visitors) AS BIGINT) AS visitors, CAST(sum(events) AS BIGINT) AS events FROM dd GROUP BY 1)"
_N = "datediff('day', DATE '2024-01-01', day)"
SQL = {
    "telemetry_clean": fx.sql(f"""WITH b AS (SELECT *, epoch_us(ts) AS r, epoch_us(ts) + (event_id % 5 - 2) * 2400000000 AS c FROM telemetry QUALIFY row_number() OVER (PARTITION BY visitor ORDER BY ts, event_id) <= 50)
      SELECT event_id, name, left('s' || session_id || '/long', 16) AS sid, CASE WHEN abs(c - r) <= 3600000000 THEN c ELSE r END AS us,
        'k=' || json_extract_string(props, '$.k') || list_aggregate([';a' || lpad(CAST(i AS VARCHAR), 2, '0') || '=' || left(repeat(name, CAST(i * 4 AS INT)), 120) FOR i IN range(1, 12)], 'string_agg', '') AS props FROM b WHERE name IN ('click', 'view', 'purchase', 'signup')"""),
    "campaign_alltime": fx.sql(f"WITH {_DAILY} SELECT 'day' AS kind, c, day, day AS last_day, visitors, events FROM dd UNION ALL SELECT 'total', * FROM tt UNION ALL SELECT 'orphan', * FROM tt WHERE c NOT IN ('none', 'other', 'spring')"),
    "ride_funnel": fx.sql("""SELECT 'step' AS kind, name, CAST(list_position(['view', 'click', 'signup', 'purchase'], name) AS DOUBLE) AS place, count(DISTINCT visitor) AS visitors, count(DISTINCT session_id) AS sessions FROM telemetry WHERE name IN ('view', 'click', 'signup', 'purchase') GROUP BY 2
      UNION ALL SELECT 'screen', k, coalesce(TRY_CAST(k AS DOUBLE), 99), count(DISTINCT visitor), count(DISTINCT session_id) FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM telemetry) WHERE k IS NOT NULL GROUP BY 2"""),
    "client_mix": fx.sql(f"SELECT device, os, viewport, count(DISTINCT visitor) AS visitors FROM (SELECT visitor, {_DEV}, CASE WHEN value < 20 THEN 'xs' WHEN value < 40 THEN 'sm' WHEN value < 60 THEN 'md' WHEN value < 80 THEN 'lg' ELSE 'xl' END AS viewport FROM telemetry) GROUP BY 1, 2, 3"),
    "analytics_daily_read": fx.sql(f"""WITH dd AS (SELECT {_LD} AS day, name, count(*) AS events, count(DISTINCT visitor) AS visitors, count(DISTINCT session_id) AS sessions FROM telemetry GROUP BY 1, 2)
      SELECT 'day' AS kind, day, CAST(NULL AS VARCHAR) AS name, CAST(sum(events) AS BIGINT) AS events, max(visitors) AS visitors, max(sessions) AS sessions FROM dd GROUP BY 2 UNION ALL SELECT 'event', * FROM dd UNION ALL SELECT 'request', CAST(ts AS DATE), route, count(*), NULL, NULL FROM requests GROUP BY 2, 3"""),
    "latest_cycle": fx.sql(f"WITH {_CYCLES} SELECT cycle, snapshot_at, core FROM cy JOIN (SELECT day AS cycle, count(*) AS core FROM tagged WHERE status = 'core' GROUP BY 1) USING (cycle) WHERE hours >= 20 ORDER BY snapshot_at DESC LIMIT 1"),
    "hours_missing": """SELECT hour // 24 AS day, count(*) FILTER (WHERE p IS NULL) AS missing, count(*) FILTER (WHERE p IS NULL) <= 1 AS usable FROM (SELECT unnest(generate_series(min(epoch_us(ts)) // 3600000000, max(epoch_us(ts)) // 3600000000)) AS hour FROM events)
      LEFT JOIN (SELECT DISTINCT epoch_us(ts) // 3600000000 AS p FROM events WHERE event_type <> 'error') ON p = hour GROUP BY 1""",
    "retention_prune": fx.sql("""SELECT 'events' AS kind, event_id AS key FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 90 DAYS FROM events) UNION ALL SELECT 'requests', l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_shipdate >= (SELECT max(l_shipdate) - INTERVAL 30 DAYS FROM lineitem)
      UNION ALL SELECT 'reports', event_id FROM device_reports WHERE ts >= (SELECT max(ts) - INTERVAL 2 DAYS FROM device_reports) UNION ALL SELECT 'runs', ride_id FROM rides WHERE ts >= (SELECT max(ts) - INTERVAL 30 DAYS FROM rides)
      UNION ALL SELECT 'ledger', entry_id FROM user_points WHERE ts >= (SELECT max(ts) - INTERVAL 18 MONTHS FROM user_points)"""),
    "drop_stale_snapshots": fx.sql(f"""WITH sn AS (SELECT {_N} * 10 + k AS snapshot, CASE WHEN k < 2 AND {_N} % 7 <> 1 THEN {_N} * 86400 END AS lu, vehicle, lat, lon, range_m FROM points, (VALUES (0), (1), (2)) t(k) WHERE k = 0 OR (k = 1 AND {_N} % 5 = 0) OR (k = 2 AND {_N} % 7 = 0)),
      sh AS (SELECT snapshot, max(lu) AS lu, md5(string_agg(concat_ws('|', vehicle, lat, lon, coalesce(range_m, -1)), ';' ORDER BY vehicle, lat, lon, range_m)) AS h FROM sn GROUP BY 1)
      SELECT snapshot, coalesce(CASE WHEN lu IS NOT NULL AND lag(lu) OVER (ORDER BY snapshot) IS NOT NULL THEN lu = lag(lu) OVER (ORDER BY snapshot) ELSE h = lag(h) OVER (ORDER BY snapshot) END, false) AS stale FROM sh"""),
    "pipeline_health": fx.sql(f"WITH {_CYCLES} SELECT (SELECT max(ts) FROM points) AS last_ingest, (SELECT max(cycle) FROM cy WHERE hours >= 20) AS last_cycle, (SELECT max(cycle) FROM cy WHERE hours = 24) AS last_upload"),
}
