"""Feed projections, ranks, quality grades and per-device cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, prefix
from ..sources import fixtures as fx

LUT_STEPS = 100
FULL_METRES = 100 + 327 * (LUT_STEPS - 1)
# Fixed values of the ride grade: the fleet's failure rate, its weight in rentals, points per unit of rate.
GRADE_RATE, GRADE_PRIOR, GRADE_SLOPE = 0.085, 20.0, 210.0


def soc_lut(spark) -> DataFrame:  # noqa: ANN001
    """``(soc_rank, metres)``: sorted range values by rank."""
    return spark.range(LUT_STEPS).select(F.col("id").alias("soc_rank"), (100 + 327 * F.col("id")).cast("int").alias("metres"))


#: Metres of range that are ordered together.
RANGE_PIECE = 1_000


def range_ranks(points: DataFrame) -> DataFrame:
    """Rank of each range among its type's, rank among distinct values, and the quartile label; points without a range are out.

    Ranks come from counts per (day, type, range) and meet the points by an equi-join on the
    range itself, so neither a day's type nor a frequent range is one task's.
    """
    ranks = prefix.value_ranks(points, "range_m", ["day", "type_id"], RANGE_PIECE)
    x = prefix.matched(points.where("range_m IS NOT NULL"), ranks, ["day", "type_id", "range_m"])
    x = x.withColumnsRenamed({"upto": "rank_x", "total": "rank_y", "place": "unique_x", "kinds": "unique_y"})
    label = F.when(F.col("unique_y") == 1, 75).otherwise((F.least(F.lit(3), F.floor((F.col("unique_x") - 1) / F.col("unique_y") * 4)) * 25)).cast("long")
    return x.withColumn("quartile", label)


def cell_ranks(points: DataFrame) -> DataFrame:
    """Ranks among the points of the same day and hexagon at three resolutions, from counts per (day, cell, range)."""
    x = points.where("range_m IS NOT NULL")
    for res in (8, 9, 10):
        x = x.withColumn(f"cell{res}", geo.hex_name(geo.hex_cell(F.col("lat"), F.col("lon"), res)))
    for res in (8, 9, 10):
        by = ["day", f"cell{res}"]
        ranks = prefix.value_ranks(x, "range_m", by).select(*by, "range_m", F.col("upto").alias(f"x{res}"), F.col("total").alias(f"y{res}"))
        x = prefix.matched(x, ranks, [*by, "range_m"])
    return x


def battery_percent(points: DataFrame, lut: DataFrame) -> DataFrame:
    """Charge in percent: exact place in the table, else the share of its last value, clamped; null without a range."""
    x = points.join(F.broadcast(lut), points.range_m == lut.metres, "left")  # LUT_STEPS rows
    exact = F.round(F.col("soc_rank") * 100.0 / (LUT_STEPS - 1))
    scaled = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.round(F.col("range_m") * 100.0 / FULL_METRES)))
    return x.withColumn("soc", F.coalesce(exact, F.when(F.col("range_m").isNotNull(), scaled)).cast("long"))


def status_of(disabled: str = "is_disabled", reserved: str = "is_reserved") -> Column:
    """disabled before reserved before available; missing flags mean available."""
    return F.when(F.coalesce(disabled, F.lit(False)), "disabled").when(F.coalesce(reserved, F.lit(False)), "reserved").otherwise("available")


def ride_grade(rentals: Column, bad: Column) -> Column:
    """65 to 100 from a failure rate drawn to the fleet's; null for fewer than five rentals. Rounds half to even."""
    rate = (F.least(F.greatest(bad, F.lit(0)), rentals) + GRADE_RATE * GRADE_PRIOR) / (rentals + GRADE_PRIOR)
    return F.when(rentals >= 5, F.bround(F.least(F.lit(100.0), F.greatest(F.lit(65.0), 100.0 - GRADE_SLOPE * rate))).cast("long"))


def _up_to(counts: DataFrame, k: str, by: list[str]) -> DataFrame:
    """``counts(<by>, hours, n)`` with ``below{k}`` (those not longer), ``n{k}`` and the median ``med{k}`` of each group."""
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    x = counts.withColumns({f"below{k}": F.sum("n").over(part.orderBy("hours")), f"n{k}": F.sum("n").over(part)})
    at = lambda p: F.min(F.when(F.col(f"below{k}") >= p, F.col("hours"))).over(part)
    return x.withColumn(f"med{k}", (at(F.floor((F.col(f"n{k}") + 1) / 2)) + at(F.floor(F.col(f"n{k}") / 2) + 1)) / 2).drop("n")


def dwell_peers(stays: DataFrame, least: int = 5) -> DataFrame:
    """Median stay (exact and rounded), share of peers not longer, and outlier flag, from the cell and its ring, then two rings, then the city.

    ``stays(vehicle, q, r, hours)``; a stay without a cell compares with the city. Peers
    depend on the cell alone, so counts per (cell, hours) travel to the neighbouring cells,
    and ranks and medians are window sums over them: at most 19 rows per different value of a
    cell, however many vehicles it holds. The second ring is built for cells that the first
    leaves short, the city's figures run over different values.
    """
    own = stays.groupBy("q", "r", "hours").agg(F.count("*").alias("n"))
    cells = own.where("q IS NOT NULL")

    def around(k: int, to: DataFrame) -> DataFrame:
        spread = cells.select("hours", "n", F.explode(geo.ring(F.struct("q", "r"), k)).alias("to"))
        spread = spread.select(F.col("to.q").alias("q"), F.col("to.r").alias("r"), "hours", "n").join(to, ["q", "r"], "left_semi")
        return _up_to(spread.groupBy("q", "r", "hours").agg(F.sum("n").alias("n")), str(k), ["q", "r"])

    first = around(1, cells.select("q", "r").distinct())
    second = around(2, first.where(F.col("n1") < least).select("q", "r").distinct())
    city = _up_to(own.groupBy("hours").agg(F.sum("n").alias("n")), "0", [])
    x = stays.join(first, ["q", "r", "hours"], "left").join(second, ["q", "r", "hours"], "left").join(city, "hours")
    ring1, ring2, whole = F.coalesce(F.col("n1") >= least, F.lit(False)), F.coalesce(F.col("n2") >= least, F.lit(False)), F.col("n0") >= least

    def chosen(name: str) -> Column:
        return F.when(ring1, F.col(f"{name}1")).when(ring2, F.col(f"{name}2")).when(whole, F.col(f"{name}0"))

    scope = F.when(ring1, 1).when(ring2, 2).when(whole, 0)
    x = x.withColumns({"scope": scope.cast("long"), "peers": chosen("n"), "median": chosen("med"), "exact": chosen("below") / chosen("n")})
    outlier = F.coalesce((F.col("exact") >= 0.9) & (F.col("hours") >= 3 * F.col("median")) & (F.col("hours") >= 24), F.lit(False))
    return x.select(*stays.columns, "scope", "peers", "median", F.round("median", 6).alias("median_h"), F.round("exact", 6).alias("share"), outlier.alias("outlier"))


def _hmac_plate(plate: Column, key: bytes) -> Column:
    """Keyed hash (HMAC with SHA-256) of a text column; first 16 hex digits."""
    block = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), plate.cast("binary")), 256))
    return F.substring(F.sha2(F.concat(F.lit(outer), first), 256), 1, 16)


def _hmac_sql(plate: str, key: bytes) -> str:
    """The keyed hash in DuckDB."""
    block = key.ljust(64, b"\0")
    inner, outer = ("'" + "".join(f"\\x{b ^ pad:02X}" for b in block) + "'::BLOB" for pad in (0x36, 0x5C))
    return f"substr(sha256({outer} || unhex(sha256({inner} || encode({plate})))), 1, 16)"


_LUT = "(SELECT i AS soc_rank, CAST(100 + 327 * i AS INT) AS metres FROM range(100) t(i))"
_SOC = f"CAST(coalesce(round(soc_rank * 100.0::DOUBLE / 99), CASE WHEN range_m IS NOT NULL THEN least(100.0, greatest(0.0, round(range_m * 100.0::DOUBLE / {FULL_METRES}))) END) AS BIGINT)"
_SOC_FROM = f"typed t LEFT JOIN {_LUT} l ON t.range_m = l.metres"


def _hex_sql(res: int, part: str) -> str:
    from math import cos, radians, sqrt

    size = f"{geo.HEX_EDGE[res]!r}::DOUBLE"
    x, y = f"((lon - {geo.LON0!r}::DOUBLE) * {111320.0 * cos(radians(geo.LAT0))!r}::DOUBLE)", f"((lat - {geo.LAT0!r}::DOUBLE) * 111320.0::DOUBLE)"
    q, r = f"(({sqrt(3.0) / 3.0!r}::DOUBLE * {x} - {y} / 3.0::DOUBLE) / {size})", f"(({2.0 / 3.0!r}::DOUBLE * {y}) / {size})"
    s = f"(-{q} - {r})"
    rq, rr, rs = (f"round_even({v}, 0)" for v in (q, r, s))
    dq, dr, ds = f"abs({rq} - {q})", f"abs({rr} - {r})", f"abs({rs} - {s})"
    if part == "q":
        return f"CAST(CASE WHEN {dq} > {dr} AND {dq} > {ds} THEN -{rr} - {rs} ELSE {rq} END AS BIGINT)"
    return f"CAST(CASE WHEN NOT ({dq} > {dr} AND {dq} > {ds}) AND {dr} > {ds} THEN -{rq} - {rs} ELSE {rr} END AS BIGINT)"


def hex_sql(res: int) -> str:
    """The cell's text in DuckDB."""
    return f"({_hex_sql(res, 'q')} || ':' || {_hex_sql(res, 'r')})"


def _typed(s, d):  # noqa: ANN001, ANN202
    from .spatial import _typed as typed

    return typed(s, d)


def _soc(s, d):  # noqa: ANN001, ANN202
    return battery_percent(fx.points(s, d), soc_lut(s))


def plate_extract(*uris: str) -> Column:
    """The plate in the first of the rental links, in their order, that holds one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(u, F.lit("")), r"[?&](?:plate|vehicle)=([A-Z0-9-]+)", 1), F.lit("")) for u in uris])


def vehicle_type_dim(feed: DataFrame, fallback: DataFrame) -> DataFrame:
    """Types that the feed describes, and built-in rows for those that it does not; ranges that are no whole numbers become null."""
    own = feed.withColumn("max_range", F.expr("try_cast(max_range AS int)"))
    return own.unionByName(fallback.join(feed, "type_id", "left_anti").select(*own.columns))


def archive_due(rows: DataFrame, archived: DataFrame, hours: int) -> DataFrame:
    """Rows past the last archived one, if that is at least ``hours`` older than the newest; else, and where nothing is new, none."""
    high = F.broadcast(archived.agg(F.max("ts").alias("_high")))  # one row
    now = F.broadcast(rows.agg(F.max("ts").alias("_now")))
    x = rows.crossJoin(high).crossJoin(now)
    return x.where(F.col("_high").isNull() | ((F.col("ts") > F.col("_high")) & (F.col("_now") >= F.col("_high") + F.make_dt_interval(hours=F.lit(hours))))).select(*rows.columns)


def _archived(points: DataFrame) -> DataFrame:
    last = F.broadcast(points.agg(F.max("day").alias("_last")))  # one row
    return points.crossJoin(last).where("day <= _last - INTERVAL 3 DAYS")


def _feed_types(s, d) -> DataFrame:  # noqa: ANN001
    """What the feed says of the types with odd numbers: their highest range as text, for one of them with a unit."""
    g = fx.points(s, d).where("type_id IN ('1', '3', '5')").groupBy("type_id").agg(F.max("range_m").alias("m"))
    return g.select("type_id", F.lit("scooter").alias("form_factor"), F.when(F.col("type_id") == "5", "sitting").alias("use_type"), F.concat(F.col("m").cast("string"), F.when(F.col("type_id") == "3", " m").otherwise("")).alias("max_range"))


def _uris(s, d) -> DataFrame:  # noqa: ANN001
    k = F.col("event_id")
    link = lambda head, tail: F.concat(F.lit(head), _plate(), F.lit(tail))
    return fx.points(s, d).select(
        "event_id", F.when(k % 3 == 0, link("app://ride?vehicle=", "")).when(k % 3 == 1, F.lit("app://home")).alias("android"),
        F.when(k % 2 == 0, link("app://ride?a=b&plate=", "I&c=d")).alias("ios"), F.when(k % 5 > 0, link("https://x.org/r?plate=", "W")).alias("web"),
    )


def _plate() -> Column:
    """The fixture plate of a user."""
    return F.concat(F.lit("PL-"), F.lpad(F.col("user_id").cast("string"), 5, "0"))


_WORDS = ("otter", "falcon", "maple", "comet", "willow", "badger", "canyon")
QUERIES = {
    "read_feed_snapshot": lambda s, d: feed_rows(s, d),
    "vehicle_type_dim": lambda s, d: vehicle_type_dim(_feed_types(s, d), fx.vehicle_types(s)),
    "soc_lut_table": lambda s, d: soc_lut(s).join(fx.points(s, d).groupBy("range_m").agg(F.count("*").alias("points")), F.col("metres") == F.col("range_m"), "left").select("soc_rank", "metres", F.coalesce("points", F.lit(0)).alias("points")),
    "drop_unusable_rows": lambda s, d: fx.points(s, d).withColumn("text_lat", F.when(F.col("event_id") % 13 == 0, "n/a").otherwise(F.col("lat").cast("string"))).where(F.expr("try_cast(text_lat AS double) IS NOT NULL AND device_id IS NOT NULL")).select("event_id"),
    "use_type_derive": lambda s, d: _typed(s, d).select("event_id", F.coalesce("use_type", F.when(F.col("form_factor") == "bicycle", "sitting").when(F.col("form_factor") == "scooter", "standing")).alias("use")),
    "coerce_optional_fields": lambda s, d: fx.load(s, d, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') AS int)").alias("k"), F.expr("try_cast(event_type AS boolean)").alias("flag")),
    "plate_extract": lambda s, d: _uris(s, d).select("event_id", plate_extract("android", "ios", "web").alias("plate")),
    "vehicle_pseudonym": lambda s, d: fx.points(s, d).select("user_id").distinct().select("user_id", _hmac_plate(_plate(), b"salt").alias("pseudonym")),
    "plate_display": lambda s, d: fx.points(s, d).select("user_id").distinct().select("user_id", F.translate(_plate(), "0123456789", "ABCDEFGHJK").alias("shown"), F.expr("right(regexp_replace(concat('PL-', lpad(cast(user_id as string), 5, '0')), '[^A-Za-z0-9]', ''), 3)").alias("last3")),
    "plate_normalise": lambda s, d: fx.points(s, d).select("user_id").distinct().select("user_id", F.regexp_replace(F.lower(F.trim(F.concat(F.lit("  "), _plate(), F.lit(" ")))), "[^a-z0-9]", "").alias("plate")),
    "public_name": lambda s, d: fx.points(s, d).select("vehicle").distinct().select("vehicle", F.element_at(F.array(*map(F.lit, _WORDS)), (F.conv(F.substring(F.sha2("vehicle", 256), 1, 8), 16, 10).cast("long") % len(_WORDS) + 1).cast("int")).alias("word"), (F.conv(F.substring(F.sha2("vehicle", 256), 9, 8), 16, 10).cast("long") % 12).alias("icon")),
    "region_name_derive": lambda s, d: fx.load(s, d, "nation").select("n_nationkey", F.coalesce(F.nullif(F.regexp_replace("n_name", "[^A-Za-z0-9]", ""), F.lit("")), F.concat(F.lit("region_"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))).alias("region_name")),
    "layer_feature_filter": lambda s, d: fx.load(s, d, "nation").withColumn("prop", F.when(F.col("n_nationkey") % 7 != 0, F.col("n_name"))).where("prop IS NOT NULL").select("n_nationkey", "prop"),
    "status_classify": lambda s, d: fx.points(s, d).groupBy(status_of().alias("state"), F.coalesce(F.nullif(F.trim("type_id"), F.lit("")), F.lit("Unknown")).alias("model")).agg(F.count("*").alias("n")),
    "device_filters": lambda s, d: _typed(s, d).where((status_of() == "available") & (F.col("form_factor") == "scooter") & F.col("lat").between(39.6, 39.8) & F.col("lon").between(-105.1, -104.8) & (F.col("status") == "core")).select("event_id", "device_id"),
    "battery_percent": lambda s, d: _soc(s, d).select("event_id", "soc"),
    "ride_grade": lambda s, d: fx.points(s, d).groupBy("vehicle").agg(F.count_if(F.col("is_reserved")).alias("rentals"), F.count_if(F.col("is_disabled")).alias("bad")).select("vehicle", "rentals", "bad", ride_grade(F.col("rentals"), F.col("bad")).alias("grade")),
    "rank_tie_top": lambda s, d: range_ranks(fx.points(s, d)).select("event_id", "rank_x", "rank_y"),
    "rank_unique": lambda s, d: range_ranks(fx.points(s, d)).select("event_id", "unique_x", "unique_y"),
    "range_quartile": lambda s, d: range_ranks(fx.points(s, d)).select("event_id", "quartile"),
    "rank_cell_peers": lambda s, d: cell_ranks(fx.points(s, d)).select("event_id", "x8", "y8", "x9", "y9", "x10", "y10"),
    "hex_cell": lambda s, d: fx.points(s, d).select("event_id", *[geo.hex_name(geo.hex_cell(F.col("lat"), F.col("lon"), r)).alias(f"h{r}") for r in (8, 9, 10)]),
    "latest_per_key": lambda s, d: fx.points(s, d).groupBy("vehicle").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")),
    "max_range_tracker": lambda s, d: fx.points(s, d).where("range_m IS NOT NULL").groupBy("vehicle").agg(F.max("range_m").alias("best"), F.max_by("ts", F.struct("range_m", -fx.micros("ts"), -F.col("event_id"))).alias("first_at")),
    "max_range_desc": lambda s, d: fx.points(s, d).groupBy("vehicle").agg(F.max("range_m").alias("best")).orderBy(F.desc_nulls_last("best"), "vehicle").limit(10),
    "model_caps": lambda s, d: fx.points(s, d).groupBy("type_id").agg(F.max("range_m").alias("cap"), F.count("range_m").alias("n")),
    "value_table_stability": lambda s, d: fx.points(s, d).where("range_m IS NOT NULL").groupBy("day").agg(F.count_distinct("range_m").alias("n_values"), F.min("range_m").alias("lo"), F.max("range_m").alias("hi")),
    "transmission_rollup": lambda s, d: fx.points(s, d).groupBy("day").agg(F.when(F.count_if(F.col("is_disabled")) == 0, "ok").when(F.count_if(F.col("is_disabled")) == F.count("*"), "none").otherwise("mixed").alias("outcome")),
    "batch_lookup_with_misses": lambda s, d: fx.load(s, d, "customer").select(F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("vehicle")).distinct().join(fx.points(s, d).groupBy("vehicle").agg(F.count("*").alias("n")), "vehicle", "left").select("vehicle", F.col("n").isNotNull().alias("found"), F.coalesce("n", F.lit(0)).alias("n")),
    "difference_missing": lambda s, d: fx.load(s, d, "customer").select(F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("vehicle")).exceptAll(fx.points(s, d).select("vehicle").distinct()),
    "insert_if_absent": lambda s, d: fx.user_points(s, d).where("status = 'confirmed'").groupBy("source_id", "action").agg(F.min("entry_id").alias("entry_id")).join(fx.user_points(s, d).where("status <> 'confirmed'").select("source_id", "action").distinct(), ["source_id", "action"], "left_anti"),
    "upsert_by_key": lambda s, d: upsert(fx.user_points(s, d).where("entry_id % 3 <> 0").groupBy("source_id").agg(F.sum("points").alias("points")), fx.user_points(s, d).where("entry_id % 3 = 0").groupBy("source_id").agg(F.sum("points").alias("points")), "source_id"),
    "archive_high_water": lambda s, d: archive_due(fx.points(s, d), _archived(fx.points(s, d)), 24).select("event_id"),
    "archive_day_chunks": lambda s, d: fx.load(s, d, "events").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select(F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"), F.expr("INTERVAL 1 DAY"))).alias("day")),
    "minute_coarsen": lambda s, d: fx.load(s, d, "events").select("event_id", (F.floor(fx.micros("ts") / 60_000_000) * 60_000).cast("long").alias("minute_ms")),
    "catalog_seed": lambda s, d: fx.points(s, d).groupBy("vehicle", "type_id").agg(F.max(F.when(F.col("event_id") % 9 == 0, F.col("is_disabled"))).alias("basket")).select("vehicle", F.coalesce("basket", F.col("type_id").isin("2", "4")).alias("basket")),
    "reclassify_cohort": lambda s, d: fx.points(s, d).join(fx.load(s, d, "supplier").select(F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("vehicle"), F.lit(True).alias("hit")), "vehicle", "left").select("event_id", F.when(F.col("hit") & (F.col("type_id") == "5"), "rover").otherwise(F.col("type_id")).alias("type_id")),
}


def feed_rows(s, d) -> DataFrame:  # noqa: ANN001
    """Feed files of at most 2,000 bikes of a day as JSON text, parsed with a schema and flattened to one row per bike."""
    bike = F.struct(F.col("device_id").alias("bike_id"), "lat", "lon", F.col("type_id").alias("vehicle_type_id"))
    text = fx.points(s, d).groupBy("day", F.expr("event_id div 2000")).agg(F.to_json(F.struct(F.unix_timestamp(F.col("day").cast("timestamp")).alias("last_updated"), F.struct(F.collect_list(bike).alias("bikes")).alias("data"))).alias("body"))
    schema = "last_updated long, data struct<bikes: array<struct<bike_id: string, id: string, lat: double, lon: double, vehicle_type_id: string>>>"
    x = text.select(F.from_json("body", schema).alias("f")).select("f.last_updated", F.explode("f.data.bikes").alias("b"))
    return x.select("last_updated", F.coalesce("b.bike_id", "b.id").alias("bike_id"), "b.lat", "b.lon", "b.vehicle_type_id")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key."""
    return old.join(new, key, "left_anti").unionByName(new)


_PL = "('PL-' || lpad(CAST(user_id AS VARCHAR), 5, '0'))"
_RANKS = """(SELECT *, count(range_m) OVER (PARTITION BY day, type_id ORDER BY range_m RANGE UNBOUNDED PRECEDING) AS rank_x, count(range_m) OVER (PARTITION BY day, type_id) AS rank_y,
  dense_rank() OVER (PARTITION BY day, type_id ORDER BY range_m) AS unique_x FROM points WHERE range_m IS NOT NULL)"""
_UNIQ = f"(SELECT *, max(unique_x) OVER (PARTITION BY day, type_id) AS unique_y FROM {_RANKS})"
SQL = {
    "read_feed_snapshot": fx.sql("SELECT CAST(epoch(day) AS BIGINT) AS last_updated, device_id AS bike_id, lat, lon, type_id AS vehicle_type_id FROM points"),
    "vehicle_type_dim": fx.sql("""WITH ft AS (SELECT type_id, 'scooter' AS form_factor, CASE WHEN type_id = '5' THEN 'sitting' END AS use_type, CASE WHEN type_id <> '3' THEN max(range_m) END AS max_range FROM points WHERE type_id IN ('1', '3', '5') GROUP BY 1)
      SELECT * FROM ft UNION ALL SELECT * FROM vehicle_types WHERE type_id NOT IN (SELECT type_id FROM ft)"""),
    "soc_lut_table": fx.sql(f"SELECT soc_rank, metres, count(event_id) AS points FROM {_LUT} l LEFT JOIN points ON metres = range_m GROUP BY 1, 2"),
    "drop_unusable_rows": fx.sql("SELECT event_id FROM points WHERE event_id % 13 <> 0"),
    "use_type_derive": fx.sql("SELECT event_id, coalesce(use_type, CASE form_factor WHEN 'bicycle' THEN 'sitting' WHEN 'scooter' THEN 'standing' END) AS use FROM typed"),
    "coerce_optional_fields": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(NULL AS BOOLEAN) AS flag FROM events",
    "plate_extract": fx.sql(f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN {_PL} WHEN event_id % 2 = 0 THEN {_PL} || 'I' WHEN event_id % 5 > 0 THEN {_PL} || 'W' END AS plate FROM points"),
    "plate_display": fx.sql(f"SELECT DISTINCT user_id, translate({_PL}, '0123456789', 'ABCDEFGHJK') AS shown, right(regexp_replace({_PL}, '[^A-Za-z0-9]', '', 'g'), 3) AS last3 FROM points"),
    "plate_normalise": fx.sql(f"SELECT DISTINCT user_id, regexp_replace(lower(trim('  ' || {_PL} || ' ')), '[^a-z0-9]', '', 'g') AS plate FROM points"),
    "public_name": fx.sql(f"SELECT DISTINCT vehicle, {list(_WORDS)}[CAST(('0x' || substr(sha256(vehicle), 1, 8)) AS BIGINT) % 7 + 1] AS word, CAST(('0x' || substr(sha256(vehicle), 9, 8)) AS BIGINT) % 12 AS icon FROM points"),
    "region_name_derive": "SELECT n_nationkey, coalesce(nullif(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g'), ''), 'region_' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0')) AS region_name FROM nation",
    "layer_feature_filter": "SELECT n_nationkey, n_name AS prop FROM nation WHERE n_nationkey % 7 <> 0 AND n_name IS NOT NULL",
    "status_classify": fx.sql("SELECT CASE WHEN coalesce(is_disabled, false) THEN 'disabled' WHEN coalesce(is_reserved, false) THEN 'reserved' ELSE 'available' END AS state, type_id AS model, count(*) AS n FROM points GROUP BY 1, 2"),
    "device_filters": fx.sql("SELECT event_id, device_id FROM typed WHERE NOT is_disabled AND coalesce(is_reserved, false) = false AND form_factor = 'scooter' AND lat BETWEEN 39.6::DOUBLE AND 39.8::DOUBLE AND lon BETWEEN -105.1::DOUBLE AND -104.8::DOUBLE AND status = 'core'"),
    "battery_percent": fx.sql(f"SELECT event_id, {_SOC} AS soc FROM {_SOC_FROM}"),
    "ride_grade": fx.sql("SELECT vehicle, rentals, bad, CASE WHEN rentals >= 5 THEN CAST(round_even(least(100.0::DOUBLE, greatest(65.0::DOUBLE, 100.0::DOUBLE - 210.0::DOUBLE * ((least(bad, rentals) + 0.085::DOUBLE * 20.0::DOUBLE) / (rentals + 20.0::DOUBLE)))), 0) AS BIGINT) END AS grade FROM (SELECT vehicle, count(*) FILTER (WHERE is_reserved) AS rentals, count(*) FILTER (WHERE is_disabled) AS bad FROM points GROUP BY vehicle)"),
    "vehicle_pseudonym": "SELECT user_id, " + _hmac_sql("'PL-' || lpad(CAST(user_id AS VARCHAR), 5, '0')", b"salt") + " AS pseudonym FROM (SELECT DISTINCT user_id FROM events)",
    "rank_tie_top": fx.sql(f"SELECT event_id, rank_x, rank_y FROM {_RANKS}"),
    "rank_unique": fx.sql(f"SELECT event_id, unique_x, unique_y FROM {_UNIQ}"),
    "range_quartile": fx.sql(f"SELECT event_id, CAST(CASE WHEN unique_y = 1 THEN 75 ELSE least(3, floor((unique_x - 1) / unique_y * 4)) * 25 END AS BIGINT) AS quartile FROM {_UNIQ}"),
    "rank_cell_peers": fx.sql("SELECT event_id, " + ", ".join(f"count(range_m) OVER (PARTITION BY day, c{r} ORDER BY range_m RANGE UNBOUNDED PRECEDING) AS x{r}, count(range_m) OVER (PARTITION BY day, c{r}) AS y{r}" for r in (8, 9, 10)) + " FROM (SELECT *, " + ", ".join(f"{hex_sql(r)} AS c{r}" for r in (8, 9, 10)) + " FROM points WHERE range_m IS NOT NULL)"),
    "hex_cell": fx.sql("SELECT event_id, " + ", ".join(f"{hex_sql(r)} AS h{r}" for r in (8, 9, 10)) + " FROM points"),
    "latest_per_key": fx.sql("SELECT vehicle, event_id FROM points QUALIFY row_number() OVER (PARTITION BY vehicle ORDER BY ts DESC, event_id DESC) = 1"),
    "max_range_tracker": fx.sql("SELECT vehicle, range_m AS best, ts AS first_at FROM points WHERE range_m IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vehicle ORDER BY range_m DESC, ts, event_id) = 1"),
    "max_range_desc": fx.sql("SELECT vehicle, max(range_m) AS best FROM points GROUP BY vehicle ORDER BY best DESC NULLS LAST, vehicle LIMIT 10"),
    "model_caps": fx.sql("SELECT type_id, max(range_m) AS cap, count(range_m) AS n FROM points GROUP BY 1"),
    "value_table_stability": fx.sql("SELECT day, count(DISTINCT range_m) AS n_values, min(range_m) AS lo, max(range_m) AS hi FROM points WHERE range_m IS NOT NULL GROUP BY day"),
    "transmission_rollup": fx.sql("SELECT day, CASE WHEN count(*) FILTER (WHERE is_disabled) = 0 THEN 'ok' WHEN count(*) FILTER (WHERE is_disabled) = count(*) THEN 'none' ELSE 'mixed' END AS outcome FROM points GROUP BY day"),
    "batch_lookup_with_misses": fx.sql("SELECT 'v' || c_custkey AS vehicle, count(event_id) > 0 AS found, count(event_id) AS n FROM customer LEFT JOIN points ON vehicle = 'v' || c_custkey GROUP BY 1"),
    "difference_missing": fx.sql("SELECT 'v' || c_custkey AS vehicle FROM customer EXCEPT ALL SELECT DISTINCT vehicle FROM points"),
    "insert_if_absent": fx.sql("SELECT source_id, action, min(entry_id) AS entry_id FROM user_points u WHERE status = 'confirmed' AND NOT EXISTS (SELECT 1 FROM user_points o WHERE o.status <> 'confirmed' AND o.source_id = u.source_id AND o.action = u.action) GROUP BY 1, 2"),
    "upsert_by_key": fx.sql("""WITH o AS (SELECT source_id, CAST(sum(points) AS BIGINT) AS points FROM user_points WHERE entry_id % 3 <> 0 GROUP BY 1), n AS (SELECT source_id, CAST(sum(points) AS BIGINT) AS points FROM user_points WHERE entry_id % 3 = 0 GROUP BY 1)
      SELECT source_id, coalesce(n.points, o.points) AS points FROM o FULL JOIN n USING (source_id)"""),
    "archive_high_water": fx.sql("SELECT event_id FROM points, (SELECT max(ts) AS high FROM points WHERE day <= (SELECT max(day) - 3 FROM points)) WHERE ts > high AND (SELECT max(ts) FROM points) >= high + INTERVAL 24 HOURS"),
    "archive_day_chunks": "SELECT CAST(unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM events",
    "minute_coarsen": "SELECT event_id, epoch_us(ts) // 60000000 * 60000 AS minute_ms FROM events",
    "catalog_seed": fx.sql("SELECT vehicle, coalesce(max(CASE WHEN event_id % 9 = 0 THEN is_disabled END), type_id IN ('2', '4')) AS basket FROM points GROUP BY vehicle, type_id"),
    "reclassify_cohort": fx.sql("SELECT event_id, CASE WHEN s_suppkey IS NOT NULL AND type_id = '5' THEN 'rover' ELSE type_id END AS type_id FROM points LEFT JOIN supplier ON vehicle = 'v' || s_suppkey"),
}
