"""Queries that go through files or a stream: they write what they derive from the tables into the shared folder and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import community, people, rides, rollups, spatial
from ..registry import GROUPS
from ..sources import fixtures as fx
from ..sources import io
from ..sources.archive import Archive
from ..streaming import streams


def _archive(s, d) -> str:  # noqa: ANN001
    path = io.scratch(s)
    io.write_archive(fx.points(s, d), path)
    return path


def archive_manifest(s, d) -> DataFrame:  # noqa: ANN001
    """The points in appends of a week each, the first one twice, then merged; rows and first point per day."""
    box, points = Archive(s, io.scratch(s)), fx.points(s, d)
    weeks = [r[0] for r in points.select(F.date_trunc("week", "ts").alias("w")).distinct().orderBy("w").collect()]
    for week in [*weeks[:1], *weeks]:
        box.append(points.where(F.date_trunc("week", "ts") == F.lit(week)))
    box.merge(below=1 << 40)
    box.sweep()
    return box.read().groupBy("day").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def _staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read as a stream."""
    path = io.scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def _drained(stream: DataFrame) -> DataFrame:
    """All rows that an appending stream gives for what is there now."""
    spark = stream.sparkSession
    out, check = io.scratch(spark), io.scratch(spark)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def read_boundaries(s, d) -> DataFrame:  # noqa: ANN001
    """Layers as GeoJSON files, read into one polygon table; edges and boxes per region."""
    path = io.scratch(s)
    io.write_layer_files(fx.boundaries(s, d), path)
    layers = [io.read_boundaries(s, f"{path}/region_type={t}", t, "name") for t in ("neighborhood", *GROUPS)]
    out = layers[0]
    for more in layers[1:]:
        out = out.unionByName(more)
    e = out.select("region_type", "region_name", F.explode("edges").alias("e"))
    return e.groupBy("region_type", "region_name").agg(F.count("*").alias("edges"), F.min("e.x1").alias("west"), F.max("e.x2").alias("east"), F.min("e.y1").alias("south"), F.max("e.y2").alias("north"))


def scan_archive(s, d) -> DataFrame:  # noqa: ANN001
    """Files of two ages, the older without ranges, as one table."""
    p, old, new = fx.points(s, d), io.scratch(s), io.scratch(s)
    p.where("day < '2024-01-15'").select("event_id", "lat", "lon").write.parquet(old)
    p.where("day >= '2024-01-15'").select("event_id", "lat", "lon", "range_m").write.parquet(new)
    return io.scan_by_name(s, old, new).where("event_id IS NOT NULL")


def append_metrics(s, d) -> DataFrame:  # noqa: ANN001
    """Points and narrow counts appended in two batches; the counts as stored."""
    root, tagged = io.scratch(s), spatial.envelope_tag(fx.points(s, d))
    for half in ("day < '2024-01-15'", "day >= '2024-01-15'"):
        x = tagged.where(half)
        io.append_tables({"points": x, "metrics": x.groupBy("day", "status").agg(F.count("*").alias("n"))}, root)
    return s.read.parquet(f"{root}/metrics")


def request_quantiles(s, d) -> DataFrame:  # noqa: ANN001
    """Median and 95th percentile per route from stored daily sketches, held against the exact shares of requests at most as slow."""
    daily, requests = io.stored(rollups.request_sketches(fx.requests(s, d), "ts", "route")), fx.requests(s, d)
    x = rollups.merged_sketches(daily, "route").select("route", "n", "errors", rollups.quantiles(F.col("sketch"), 0.5, 0.95).alias("q"))
    share = lambda k, strict: F.count_if(F.col("ms") < F.col("q")[k] if strict else F.col("ms") <= F.col("q")[k]) / F.count("*")
    fits = lambda k, p: (share(k, True) <= p + rollups.SKETCH_ERROR) & (share(k, False) >= p - rollups.SKETCH_ERROR)
    held = requests.join(F.broadcast(x.select("route", "q")), "route").groupBy("route").agg(fits(0, 0.5).alias("p50_fits"), fits(1, 0.95).alias("p95_fits"))  # a row per route
    return x.select("route", "n", "errors").join(held, "route")


def replace_partition(s, d) -> DataFrame:  # noqa: ANN001
    """The daily rollup stored twice: the second run replaces."""
    path, daily = io.scratch(s), rollups.QUERIES["telemetry_daily"](s, d)
    for _ in range(2):
        io.replace_partitions(daily, path, "day")
    return s.read.parquet(path).select(*daily.columns)


def swap_if_complete(s, d) -> DataFrame:  # noqa: ANN001
    """A complete load is taken, a later one with too few rows is not."""
    path, ways = io.scratch(s), fx.ways(s, d)
    n = ways.count()
    io.swap_if_complete(ways, n, path)
    io.swap_if_complete(ways.where("bikeway"), n, path)
    return s.read.parquet(path)


def temperatures(s, d) -> DataFrame:  # noqa: ANN001
    """Days of parallel arrays with missing values as rows."""
    e = F.array_sort(F.collect_list(F.struct("hour", F.when(F.col("hour") % 5 != 0, F.col("temp")).alias("temp"))))
    x = fx.hourly_temperature(s, d).groupBy(F.expr("hour div 24").alias("day")).agg(e.alias("e"))
    return io.hourly_from_arrays(x.select(F.col("e.hour").alias("time"), F.col("e.temp").alias("temperature")))


def address_pages(s, d) -> DataFrame:  # noqa: ANN001
    """Address records as pages of JSON of at most a thousand, read back with a schema."""
    path, rows = io.scratch(s), people._address_rows(s, d)
    rows.write.option("maxRecordsPerFile", 1_000).json(path)
    return s.read.schema(rows.schema).json(path)


def way_tables(s, d) -> DataFrame:  # noqa: ANN001
    """Way attributes through a compressed CSV that has unusable rows among them."""
    path, ways = io.scratch(s), fx.ways(s, d)
    text = ways.withColumn("way_id", F.col("way_id").cast("string"))
    bad = text.where("bikeway").withColumn("way_id", F.concat(F.lit("?"), "way_id"))
    text.unionByName(bad).write.option("header", True).option("compression", "gzip").csv(path)
    return io.read_way_table(s, path, "way_id long, canopy double, bikeway boolean")


def _cycles(s, d) -> streams.CycleStore:  # noqa: ANN001
    """The points as daily feeds, a file each in pages of at most 2,000 bikes, through the cycle stream; then two of the files once more, which are stale."""
    feed, store, check = io.scratch(s), streams.CycleStore(s, io.scratch(s)), io.scratch(s)
    bike = F.struct(F.col("device_id").alias("bike_id"), "lat", "lon", F.col("type_id").alias("vehicle_type_id"))
    day = F.unix_timestamp(F.col("day").cast("timestamp")).alias("last_updated")
    pages = fx.points(s, d).groupBy(day, F.expr("event_id div 2000").alias("page")).agg(F.collect_list(bike).alias("bikes"))
    lines = io.stored(pages.select("last_updated", F.to_json(F.struct("last_updated", F.struct("bikes").alias("data"))).alias("value")))
    for time in [r[0] for r in lines.select("last_updated").distinct().orderBy("last_updated").collect()]:  # a feed grows by one file at a time
        lines.where(F.col("last_updated") == time).select("value").coalesce(1).write.mode("append").text(feed)
    run = lambda: streams.cycle_stream(s, feed, fx.boundaries(s, d), store, check, pages=True).awaitTermination()
    run()
    for share in ("min", "max"):
        lines.where(F.col("last_updated") == lines.agg({"last_updated": share}).first()[0]).select("value").coalesce(1).write.mode("append").text(feed)
    run()
    return store


def cycle_counts(s, d) -> DataFrame:  # noqa: ANN001
    """Points by feed time and refined status, as the cycle stream stored them."""
    return _cycles(s, d).read("points").groupBy("last_updated", "status").agg(F.count("*").alias("n"))


def cycle_regions(s, d) -> DataFrame:  # noqa: ANN001
    """Devices per region of each cycle, as the cycle stream stored them."""
    return _cycles(s, d).read("regions").select("last_updated", "region_type", "region_name", "count_total")


def _last_states(stream: DataFrame) -> DataFrame:
    """What an updating stream has put out, batch by batch, for what is there now."""
    spark = stream.sparkSession
    out, check = io.scratch(spark), io.scratch(spark)

    def store(frame: DataFrame, number: int) -> None:
        frame.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def hourly_windows(s, d) -> DataFrame:  # noqa: ANN001
    """Counts per hour as a stream: the last state of each hour."""
    x = _last_states(streams.hourly_status_stream(_staged(fx.points(s, d).withColumn("ts", F.col("ts").cast("timestamp")))))
    x = x.groupBy("hour").agg(F.max_by(F.struct("n", "disabled"), "batch").alias("x"))
    return x.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "x.n", "x.disabled")


def sla_windows(s, d) -> DataFrame:  # noqa: ANN001
    """The local morning average as a stream: the last state of each day."""
    x = _last_states(streams.sla_stream(_staged(fx.points(s, d)))).groupBy("local_day").agg(F.max_by(F.struct("n", "avg_range"), "batch").alias("x"))
    return x.select("local_day", "x.n", F.round("x.avg_range", 6).alias("avg_range"))


HOUR_MS = 3_600_000


def reports_stream(s, d) -> DataFrame:  # noqa: ANN001
    """Report acceptance in time order, with the last accepted time as state until the gap is over."""
    x = community._reports_us(s, d).select("event_id", "us", F.concat_ws("|", "reporter", "event_type").alias("key"))
    return _drained(streams.accepted_reports_stream(_staged(streams.closed(x, "key", HOUR_MS)), 1_800_000_000))


def _samples(s, d) -> DataFrame:  # noqa: ANN001
    return fx.moving(s, d).select("event_id", "vehicle", "us", "lat", "lon", F.coalesce("is_reserved", F.lit(False)).alias("reserved"))


def vehicle_states_stream(s, d) -> DataFrame:  # noqa: ANN001
    """What happened at each sample, from the stream with expiring state."""
    return _drained(streams.vehicle_state_stream(_staged(streams.closed(_samples(s, d), "vehicle", HOUR_MS)))).select("event_id", "kind")


def ended_watches(s, d) -> DataFrame:  # noqa: ANN001
    """Watches that have ended when the last sample is there, from the stream."""
    starts = rides.watches(s, d).select("vehicle", F.col("start").alias("us"), "ride_id", F.lit(False).alias("reserved"))
    both = _samples(s, d).select("vehicle", "us", F.lit(None).cast("long").alias("ride_id"), "reserved").unionByName(starts)
    return _drained(streams.ride_watch_stream(_staged(streams.closed(both, "vehicle", HOUR_MS)), delay="1 hour"))


def jdbc_scan(s, d) -> DataFrame:  # noqa: ANN001
    """Points kept in a database table, read back in parallel ranges of the key; the filter goes to the database.

    The database is the one at ``spark.fleetlake.jdbc.url``; where that is unset, a local
    session takes the in-memory one that comes with Spark, which no other process can reach.
    """
    url = s.conf.get("spark.fleetlake.jdbc.url", None)
    if not url:
        if not s.sparkContext.master.startswith("local[") and s.sparkContext.master != "local":
            raise ValueError("set spark.fleetlake.jdbc.url to a database that all executors reach")
        url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    points, name = fx.points(s, d).select("event_id", "lat", "lon", "range_m"), f"points_{uuid.uuid4().hex}"
    low, high, parts = *points.agg(F.min("event_id"), F.max("event_id")).first(), s.sparkContext.defaultParallelism
    points.coalesce(parts).write.format("jdbc").options(url=url, dbtable=name).save()
    return io.jdbc_scan(s, url, name, "event_id", low or 0, max(high or 0, (low or 0) + 1), parts).where("range_m >= 10000")


QUERIES = {
    "jdbc_scan": jdbc_scan,
    "read_boundaries": read_boundaries,
    "scan_archive_by_name": scan_archive,
    "archive_files_after_cutover": lambda s, d: io.archive_after(s, _archive(s, d), "2024-01-15").groupBy("day").agg(F.count("*").alias("n")),
    "write_archive": lambda s, d: s.read.parquet(_archive(s, d)).groupBy("day").agg(F.count("*").alias("n"), F.min("event_id").alias("first")),
    "archive_manifest": archive_manifest,
    "append_metrics": append_metrics,
    "request_quantiles": request_quantiles,
    "replace_partition": replace_partition,
    "swap_if_complete": swap_if_complete,
    "hourly_temps_from_arrays": temperatures,
    "edge_attribute_tables": way_tables,
    "address_points_load": lambda s, d: people.address_points(address_pages(s, d))[0],
    "cycle_stream": cycle_counts,
    "cycle_stream_regions": cycle_regions,
    "sla_window_stream": sla_windows,
    "hourly_status_stream": hourly_windows,
    "dedupe_reports_stream": reports_stream,
    "vehicle_state_stream": vehicle_states_stream,
    "ride_watch_stream": ended_watches,
}

SQL = {
    "jdbc_scan": fx.sql("SELECT event_id, lat, lon, range_m FROM points WHERE range_m >= 10000"),
    "read_boundaries": fx.sql("SELECT region_type, region_name, count(*) AS edges, min(x1) AS west, max(x2) AS east, min(y1) AS south, max(y2) AS north FROM edges GROUP BY 1, 2"),
    "scan_archive_by_name": fx.sql("SELECT event_id, lat, lon, CASE WHEN day >= DATE '2024-01-15' THEN range_m END AS range_m FROM points"),
    "archive_files_after_cutover": fx.sql("SELECT day, count(*) AS n FROM points WHERE day > DATE '2024-01-15' GROUP BY 1"),
    "write_archive": fx.sql("SELECT day, count(*) AS n, min(event_id) AS first FROM points GROUP BY 1"),
    "archive_manifest": fx.sql("SELECT day, count(*) AS n, min(event_id) AS first FROM points GROUP BY 1"),
    "request_quantiles": fx.sql("SELECT route, count(*) AS n, count(*) FILTER (WHERE status >= 500) AS errors, TRUE AS p50_fits, TRUE AS p95_fits FROM requests GROUP BY 1"),
    "append_metrics": fx.sql("SELECT day, status, count(*) AS n FROM tagged GROUP BY 1, 2"),
    "replace_partition": rollups.SQL["telemetry_daily"],
    "swap_if_complete": fx.sql("SELECT * FROM ways"),
    "hourly_temps_from_arrays": fx.sql('SELECT hour AS "time", temp AS temperature FROM hourly_temperature WHERE hour % 5 <> 0'),
    "edge_attribute_tables": fx.sql("SELECT * FROM ways"),
    "address_points_load": people.POINTS_SQL,
    "cycle_stream": fx.sql("SELECT CAST(epoch(day) AS BIGINT) AS last_updated, status, count(*) AS n FROM refined GROUP BY 1, 2"),
    "cycle_stream_regions": fx.sql("""WITH w AS (SELECT CAST(epoch(day) AS BIGINT) AS last_updated, event_id, status FROM refined)
      SELECT c.last_updated, r.region_type, r.region_name, CAST(count(t.event_id) AS BIGINT) AS count_total FROM (SELECT DISTINCT region_type, region_name FROM edges) r CROSS JOIN (SELECT DISTINCT last_updated FROM w) c
      LEFT JOIN (SELECT h.*, last_updated FROM hits h JOIN w USING (event_id) WHERE status = 'core') t ON t.region_type = r.region_type AND t.region_name = r.region_name AND t.last_updated = c.last_updated GROUP BY ALL"""),
    "sla_window_stream": fx.sql(f"SELECT local_day, n, avg_range FROM ({rollups._SLA})"),
    "hourly_status_stream": fx.sql("SELECT date_trunc('hour', ts) AS hour, count(*) AS n, count(*) FILTER (WHERE is_disabled) AS disabled FROM points GROUP BY 1"),
    "dedupe_reports_stream": community.SQL["report_dedupe_30min"],
    "vehicle_state_stream": rides.SQL["vehicle_state_machine"],
    "ride_watch_stream": f"SELECT * FROM ({rides.SQL['ride_watch']}) WHERE state IN ('resolved', 'expired')",
}
