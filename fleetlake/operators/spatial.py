"""Point-in-polygon joins, status refinement and the cycle's metric tables.

Polygons are the small side: one row each, edges in an array. They are listed by 0.02-degree
tile; a point looks up its tile's list (one equi-join), and the bounding boxes and the even-odd
test then filter the list inside the row. So one lookup gives all regions of a point, and the
metrics above it need no further join: while the tiles' lists have at most ``BROADCAST_EDGES``
edges (counted), points are not shuffled before the final aggregate.

Beyond, points meet the lists by an equi-join over tiles that adapt (:func:`split_tiles`): a
tile where edges crowd is cut into up to 16 x 16 parts, each with the edges that matter in it
alone, and one where points crowd is dealt out by a hash, its list going to every part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..registry import BUFFER_METRES, CORE_BOX, GLITCH_BOX, core_columns
from ..sources import fixtures as fx
from ..sources import io

BROADCAST_EDGES = 200_000
#: Edges that a tile's list has before the tile is cut, cuts at most (each halves both sides), and points of a tile that one task takes.
TILE_EDGES, DEEPEST, TILE_POINTS = 512, 4, 250_000
#: Degrees by which rounding may shift a point against its tile.
SLACK = 1e-9


def polygon_tiles(polygons: DataFrame, margin: float = 0.0) -> DataFrame:
    """Polygons once per tile of their box (widened by ``margin`` degrees), with the box."""
    ends = {n: f(F.concat(F.transform("edges", lambda e: e[a]), F.transform("edges", lambda e: e[b]))) for n, f, a, b in (("west", F.array_min, "x1", "x2"), ("east", F.array_max, "x1", "x2"), ("south", F.array_min, "y1", "y2"), ("north", F.array_max, "y1", "y2"))}
    p = polygons.withColumns(ends)
    xs = F.sequence(geo.tile(F.col("west") - margin), geo.tile(F.col("east") + margin))
    ys = F.sequence(geo.tile(F.col("south") - margin), geo.tile(F.col("north") + margin))
    return p.withColumn("tx", F.explode(xs)).withColumn("ty", F.explode(ys))


def _hinted(tiles: DataFrame) -> DataFrame:
    n = tiles.agg(F.sum(F.size("edges"))).first()[0] or 0
    return F.broadcast(tiles) if n <= BROADCAST_EDGES else tiles


def clipped(edges: Column, west: Column, south: Column, side: Column) -> tuple[Column, Column]:
    """The edges that decide in a tile whether its points are inside, and whether the others add an odd number of crossings for all of them.

    The even-odd rule counts edges east of a point at its latitude. In a tile, edges above,
    below or west of it count for no point, and an edge east of it that spans its latitudes
    counts for every one; the rest is kept, so the rule gives the same as over all edges.
    """
    low, high = lambda e: F.least(e["y1"], e["y2"]), lambda e: F.greatest(e["y1"], e["y2"])
    counts = lambda e: (high(e) > south - SLACK) & (low(e) < south + side + SLACK) & (F.greatest(e["x1"], e["x2"]) >= west - SLACK)
    always = lambda e: (low(e) <= south - SLACK) & (high(e) >= south + side + SLACK) & (F.least(e["x1"], e["x2"]) > west + side + SLACK)
    return F.filter(edges, lambda e: counts(e) & ~always(e)), F.size(F.filter(edges, always)) % 2 == 1


def split_tiles(points: DataFrame, polygons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points and polygon lists with the columns ``spot``, which a point shares with the list of its part of a tile.

    Both sides follow from counts per tile: the edges of its list give the depth of its cuts,
    its points the number of hash parts. Tiles that need neither are not in the table of them.
    """
    own = [c for c in polygons.columns if c != "edges"]
    # Polygons often come in one file; their cuts are work for all tasks.
    tiles = polygon_tiles(polygons.repartition(int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    corner = lambda t: t * F.lit(geo.TILE)
    edges, odd = clipped(F.col("edges"), corner(F.col("tx")), corner(F.col("ty")), F.lit(geo.TILE))
    tiles = tiles.withColumns({"edges": edges, "odd": odd}).where("odd OR size(edges) > 0")
    p = points.withColumns({"tx": geo.tile(F.col("lon")), "ty": geo.tile(F.col("lat"))})
    heavy = tiles.groupBy("tx", "ty").agg(F.sum(F.size("edges")).alias("e")).where(F.col("e") > TILE_EDGES)
    busy = p.groupBy("tx", "ty").agg(F.count("*").alias("n")).where(F.col("n") > TILE_POINTS)
    plan = heavy.join(busy, ["tx", "ty"], "full")
    depth = F.least(F.lit(DEEPEST), F.ceil(F.log2(F.col("e") / TILE_EDGES))).cast("int")
    plan = io.stored(plan.select(F.col("tx").alias("_tx"), F.col("ty").alias("_ty"), F.coalesce(depth, F.lit(0)).alias("depth"), F.coalesce(F.ceil(F.col("n") / TILE_POINTS).cast("int"), F.lit(1)).alias("parts")))
    small = plan.count() <= 1_000_000
    on = (F.col("tx") == F.col("_tx")) & (F.col("ty") == F.col("_ty"))

    def planned(x: DataFrame) -> DataFrame:
        x = x.join(F.broadcast(plan) if small else plan, on, "left").drop("_tx", "_ty")  # about a row per TILE_EDGES edges and TILE_POINTS points
        return x.withColumns({"depth": F.coalesce("depth", F.lit(0)), "parts": F.coalesce("parts", F.lit(1))})

    n = F.call_function("shiftleft", F.lit(1), F.col("depth"))
    part_at = lambda c, tile: F.greatest(F.lit(0), F.least(n - 1, F.floor((c / F.lit(geo.TILE) - F.col(tile)) * n).cast("int")))
    dealt = planned(p).withColumn("spot", F.struct("tx", "ty", part_at(F.col("lon"), "tx").alias("i"), part_at(F.col("lat"), "ty").alias("j"), F.pmod(F.xxhash64("lat", "lon", *[c for c, t in points.dtypes if t in ("bigint", "string")]), F.col("parts")).cast("int").alias("part")))
    touched = lambda low, high, tile: F.explode(F.sequence(part_at(F.col(low) - SLACK, tile), part_at(F.col(high) + SLACK, tile)))
    lists = planned(tiles).withColumn("i", touched("west", "east", "tx")).withColumn("j", touched("south", "north", "ty"))
    side = F.lit(geo.TILE) / n
    edges, odd = clipped(F.col("edges"), corner(F.col("tx")) + F.col("i") * side, corner(F.col("ty")) + F.col("j") * side, side)
    lists = lists.select(*own, "west", "east", "south", "north", "tx", "ty", "i", "j", "parts", edges.alias("edges"), (odd != F.col("odd")).alias("odd")).where("odd OR size(edges) > 0")
    lists = lists.groupBy("tx", "ty", "i", "j", "parts").agg(F.collect_list(F.struct(*own, "west", "east", "south", "north", "edges", "odd")).alias("polygons"))
    lists = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select(*points.columns, "spot"), lists.select(F.struct("tx", "ty", "i", "j", "part").alias("spot"), "polygons")


def with_regions(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """``regions``: the polygons that hold each point, as structs of their columns but the edges."""
    own = [c for c in polygons.columns if c != "edges"]
    tiles = polygon_tiles(polygons)
    n = tiles.agg(F.sum(F.size("edges"))).first()[0] or 0
    if n > BROADCAST_EDGES:
        dealt, lists = split_tiles(points, polygons)
        return _held(dealt.join(lists, "spot", "left"), points, polygons, own)
    lists = tiles.withColumn("odd", F.lit(False)).groupBy("tx", "ty").agg(F.collect_list(F.struct(*own, "west", "east", "south", "north", "edges", "odd")).alias("polygons"))  # a tile's polygons
    p = points.withColumns({"tx": geo.tile(F.col("lon")), "ty": geo.tile(F.col("lat"))})
    return _held(p.join(F.broadcast(lists), ["tx", "ty"], "left"), points, polygons, own)


def _held(x: DataFrame, points: DataFrame, polygons: DataFrame, own: list[str]) -> DataFrame:
    """``regions`` of points that have met their list of ``polygons``."""
    lat, lon = F.col("lat"), F.col("lon")

    def holds(g: Column) -> Column:
        return lon.between(g["west"], g["east"]) & lat.between(g["south"], g["north"]) & (geo.inside(g["edges"], lat, lon) != g["odd"])

    held = F.transform(F.filter("polygons", holds), lambda g: F.struct(*[g[c].alias(c) for c in own]))
    none = F.expr("filter(array(named_struct({})), g -> false)".format(", ".join(f"'{c}', cast(null as {t})" for c, t in polygons.select(*own).dtypes)) if own else "array()")
    # Through a generator of one element, so that filters and columns above read the list instead of testing the polygons again.
    return x.select(*points.columns, F.explode(F.array(F.coalesce(held, none))).alias("regions"))


def points_in_polygons(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Each pair of a point and a polygon that holds it: columns of both but the edges."""
    x = with_regions(points, polygons)
    return x.select(*points.columns, F.explode("regions").alias("region")).select(*points.columns, "region.*")


def near_polygons(points: DataFrame, polygons: DataFrame, metres: float = BUFFER_METRES) -> DataFrame:
    """Each pair of a point and a polygon that holds it or has an edge within ``metres``."""
    margin = metres / 80_000.0  # a degree of longitude is longer than 80 km in the study area
    tiles = _hinted(polygon_tiles(polygons, margin))
    p = points.withColumns({"tx": geo.tile(F.col("lon")), "ty": geo.tile(F.col("lat"))})
    lat, lon = F.col("lat"), F.col("lon")
    box = lon.between(F.col("west") - margin, F.col("east") + margin) & lat.between(F.col("south") - margin, F.col("north") + margin)
    hit = p.join(tiles, ["tx", "ty"]).where(box & (geo.inside(F.col("edges"), lat, lon) | (geo.edge_metres(F.col("edges"), lat, lon) <= metres)))
    return hit.select(*points.columns, *[c for c in polygons.columns if c != "edges"])


def envelope_tag(points: DataFrame) -> DataFrame:
    """``status``: core, glitch or outlier by inclusive boxes; nothing is dropped."""
    lat, lon = F.col("lat"), F.col("lon")
    return points.withColumn("status", F.when(geo.in_box(lat, lon, CORE_BOX), "core").when(geo.in_box(lat, lon, GLITCH_BOX), "glitch").otherwise("outlier"))


def refined(located: DataFrame, kind: str = "neighborhood") -> DataFrame:
    """The status of points with ``regions``: core ones outside every region of the kind become outliers, outliers inside one core; glitches stay. ``tag`` keeps the first status."""
    inside = F.exists("regions", lambda g: g["region_type"] == kind)
    status = F.when((F.col("status") == "core") & ~inside, "outlier").when((F.col("status") == "outlier") & inside, "core").otherwise(F.col("status"))
    return located.withColumns({"tag": F.col("status"), "status": status})


def refine_status(tagged: DataFrame, city: DataFrame) -> DataFrame:
    """:func:`refined` by the polygons of ``city``, whatever their kind."""
    x = with_regions(tagged, city.select("edges", F.lit("city").alias("region_type")))
    return refined(x, "city").drop("regions")


def with_types(points: DataFrame, types: DataFrame) -> DataFrame:
    """Form factor and use type by vehicle type; an unknown type gives form factor "unknown"."""
    return points.join(types, "type_id", "left").withColumn("form_factor", F.coalesce("form_factor", F.lit("unknown")))


def core_summary(points: DataFrame, polygons: DataFrame, *by: str) -> DataFrame:
    """One wide row (per ``by``): counts citywide, per group and per split value, and their percents.

    Points bring their ``regions`` or get them here; so all columns come from one conditional
    aggregate. A group that no boundary has counts 0; a zero total gives null percents.
    """
    core = points.where("status = 'core'")
    core = core if "regions" in core.columns else with_regions(core, polygons)
    x = core.withColumn("groups", F.transform("regions", lambda g: g["region_type"]))
    counts = []
    for name, group, col, value in core_columns():
        flag = F.lit(True)
        if group:
            flag = flag & F.array_contains("groups", group)
        if col:
            flag = flag & F.coalesce(F.col(col) == value, F.lit(False))
        counts.append(F.count_if(flag).alias(name))
    out = x.groupBy(*by).agg(*counts)
    percents = []
    for name, group, col, value in core_columns():
        if group:
            whole = f"total_{value}" if col else "total_count"
            percents.append(F.round(F.col(name).cast("double") / F.nullif(F.col(whole), F.lit(0)) * 100, 2).alias(f"{name}_pct"))
    return out.select("*", *percents)


def regional_breakdown(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Counts per region, zero for regions without points; a device counts once per region."""
    core = points.where("status = 'core'")
    core = core if "regions" in core.columns else with_regions(core, polygons)
    hits = core.select("form_factor", F.explode("regions").alias("g")).select("g.region_type", "g.region_name", "form_factor")
    n = hits.groupBy("region_type", "region_name").agg(F.count("*").alias("n"), F.count_if(F.col("form_factor") == "bicycle").alias("b"), F.count_if(F.col("form_factor") == "scooter").alias("s"))
    out = polygons.select("region_type", "region_name").join(n, ["region_type", "region_name"], "left")
    return out.select("region_type", "region_name", *[F.coalesce(c, F.lit(0)).alias(a) for c, a in (("n", "count_total"), ("b", "count_bike"), ("s", "count_scooter"))])


def fleet_status(points: DataFrame) -> DataFrame:
    """Available, reserved and out-of-order counts per form factor; missing flags mean available."""
    state = F.when(F.coalesce("is_disabled", F.lit(False)), "out").when(F.coalesce("is_reserved", F.lit(False)), "reserved").otherwise("available")
    x = points.withColumn("state", state)
    return x.groupBy("form_factor").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("available", "reserved", "out")])


def _typed(spark, d):  # noqa: ANN001, ANN202
    """Points with regions, refined status and vehicle type: one lookup of polygons, one of types."""
    return with_types(refined(with_regions(envelope_tag(fx.points(spark, d)), fx.boundaries(spark, d))), F.broadcast(fx.vehicle_types(spark)))  # five rows


def _core_sql(by: str = "") -> str:
    cols = []
    for name, group, col, value in core_columns():
        cond = " AND ".join([*([f"list_contains(groups, '{group}')"] if group else []), *([f"{col} = '{value}'"] if col else [])]) or "TRUE"
        cols.append(f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT) AS {name}")
    pct = [f"ROUND({n}::DOUBLE / nullif({f'total_{v}' if c else 'total_count'}, 0) * 100, 2) AS {n}_pct" for n, g, c, v in core_columns() if g]
    key = f"{by}, " if by else ""
    return fx.sql(f"""SELECT *, {', '.join(pct)} FROM (SELECT {key}{', '.join(cols)} FROM
      (SELECT t.*, coalesce(g.groups, []) AS groups FROM typed t LEFT JOIN (SELECT event_id, list(DISTINCT region_type) AS groups FROM hits GROUP BY event_id) g USING (event_id) WHERE status = 'core') q {f'GROUP BY {by}' if by else ''}) w""")


def zone_counts(s, d) -> DataFrame:  # noqa: ANN001
    """Zones around each point: how many hold it, and the least of them; zones are as many as orders, with 16 edges each."""
    return zones_around(fx.points(s, d).select("event_id", "lat", "lon"), fx.zones(s, d))


def zones_around(points: DataFrame, zones: DataFrame) -> DataFrame:
    """``(event_id, zones, first)`` of the points that zones hold: their number and the least ``zone_id``.

    Zones of one outline are a class with its size and least id, points of one place are one
    place, so a place meets a class once, however many zones and points share them.
    """
    kinds = io.stored(zones.groupBy("edges").agg(F.count("*").alias("n"), F.min("zone_id").alias("first")))
    places = points.groupBy("lat", "lon").agg(F.count("*").alias("_n")).select("lat", "lon")
    sums = lambda g: F.aggregate("regions", F.lit(0).cast("long"), lambda a, r: a + r[g])
    x = with_regions(places, kinds).where(F.size("regions") > 0)
    x = x.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), sums("n").alias("zones"), F.array_min(F.transform("regions", lambda g: g["first"])).alias("first"))
    return points.join(x, (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon"))).select("event_id", "zones", "first")


QUERIES = {
    "zone_counts": zone_counts,
    "point_in_polygon": lambda s, d: points_in_polygons(fx.points(s, d).select("event_id", "lat", "lon"), fx.boundaries(s, d)).select("event_id", "region_type", "region_name"),
    "envelope_tag": lambda s, d: envelope_tag(fx.points(s, d)).select("event_id", "status"),
    "refine_status_semi_anti": lambda s, d: refine_status(envelope_tag(fx.points(s, d)), fx.boundaries(s, d).where("region_type = 'neighborhood'")).select("event_id", "tag", "status"),
    "buffered_membership": lambda s, d: near_polygons(fx.points(s, d).select("event_id", "lat", "lon"), fx.boundaries(s, d).where("region_type = 'v1'")).select("event_id").distinct(),
    "core_summary": lambda s, d: core_summary(_typed(s, d), fx.boundaries(s, d)),
    "core_summary_daily": lambda s, d: core_summary(_typed(s, d), fx.boundaries(s, d), "day"),
    "regional_breakdown": lambda s, d: regional_breakdown(_typed(s, d), fx.boundaries(s, d)),
    "spatial_left_zero_fill": lambda s, d: regional_breakdown(_typed(s, d).where("is_disabled AND range_m > 9900"), fx.boundaries(s, d)).select("region_type", "region_name", "count_total"),
    "fleet_status": lambda s, d: fleet_status(_typed(s, d)),
    "form_factor_resolve": lambda s, d: _typed(s, d).select("event_id", "form_factor", "use_type"),
    "boundary_layer_summary": lambda s, d: fx.boundaries(s, d).select("region_type", "region_name", F.explode("edges").alias("e")).groupBy("region_type").agg(F.count_distinct("region_name").alias("features"), F.min(F.least("e.x1", "e.x2")).alias("west"), F.max(F.greatest("e.x1", "e.x2")).alias("east"), F.min(F.least("e.y1", "e.y2")).alias("south"), F.max(F.greatest("e.y1", "e.y2")).alias("north")),
    "union_layers": lambda s, d: fx.boundaries(s, d).select("region_type", "region_name", F.size("edges").cast("long").alias("edges")),
    "distinct_group_members": lambda s, d: points_in_polygons(fx.points(s, d).select("vehicle", "lat", "lon"), fx.boundaries(s, d).where("region_type <> 'neighborhood'")).select("region_type", "vehicle").distinct(),
}
QUERIES["refine_counts"] = lambda s, d: QUERIES["refine_status_semi_anti"](s, d).agg(F.count_if((F.col("tag") == "core") & (F.col("status") == "outlier")).alias("demoted"), F.count_if((F.col("tag") == "outlier") & (F.col("status") == "core")).alias("promoted"))

_K = "111320.0::DOUBLE"
_SEGMENT = f"""SELECT p.event_id, (x1 - lon) * {_K} * cos(radians(lat)) AS ax, (y1 - lat) * {_K} AS ay, (x2 - lon) * {_K} * cos(radians(lat)) - (x1 - lon) * {_K} * cos(radians(lat)) AS dx, (y2 - lat) * {_K} - (y1 - lat) * {_K} AS dy
  FROM points p JOIN edges e ON region_type = 'v1' AND lon BETWEEN least(x1, x2) - 0.003 AND greatest(x1, x2) + 0.003 AND lat BETWEEN least(y1, y2) - 0.003 AND greatest(y1, y2) + 0.003"""
SQL = {
    "zone_counts": fx.sql("""WITH z AS (SELECT zone_id, min(least(x1, x2)) AS west, max(greatest(x1, x2)) AS east, min(least(y1, y2)) AS south, max(greatest(y1, y2)) AS north FROM zones GROUP BY 1),
      t AS (SELECT z.*, tx, ty FROM (SELECT *, unnest(range(CAST(floor(west / 0.02) AS BIGINT), CAST(floor(east / 0.02) AS BIGINT) + 1)) AS tx FROM z) z, LATERAL (SELECT unnest(range(CAST(floor(south / 0.02) AS BIGINT), CAST(floor(north / 0.02) AS BIGINT) + 1)) AS ty)),
      c AS (SELECT event_id, zone_id, lat, lon FROM (SELECT *, CAST(floor(lon / 0.02) AS BIGINT) AS tx, CAST(floor(lat / 0.02) AS BIGINT) AS ty FROM points) p JOIN t USING (tx, ty) WHERE lon BETWEEN west AND east AND lat BETWEEN south AND north),
      h AS (SELECT event_id, zone_id FROM c JOIN zones e USING (zone_id) WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1)
      SELECT event_id, count(*) AS zones, min(zone_id) AS first FROM h GROUP BY 1"""),
    "point_in_polygon": fx.sql("SELECT event_id, region_type, region_name FROM hits"),
    "envelope_tag": fx.sql("SELECT event_id, status FROM tagged"),
    "refine_status_semi_anti": fx.sql("SELECT event_id, tag, status FROM refined"),
    "refine_counts": fx.sql("SELECT count(*) FILTER (WHERE tag = 'core' AND status = 'outlier') AS demoted, count(*) FILTER (WHERE tag = 'outlier' AND status = 'core') AS promoted FROM refined"),
    "buffered_membership": fx.sql(f"""SELECT event_id FROM hits WHERE region_type = 'v1' UNION SELECT event_id FROM
      (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(1.0, greatest(0.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) ELSE 0.0 END AS t FROM ({_SEGMENT}))
      WHERE sqrt((ax + t * dx) * (ax + t * dx) + (ay + t * dy) * (ay + t * dy)) <= 200"""),
    "core_summary": _core_sql(),
    "core_summary_daily": _core_sql("day"),
    "regional_breakdown": fx.sql("""SELECT r.region_type, r.region_name, CAST(count(t.event_id) AS BIGINT) AS count_total, CAST(count(*) FILTER (WHERE form_factor = 'bicycle') AS BIGINT) AS count_bike, CAST(count(*) FILTER (WHERE form_factor = 'scooter') AS BIGINT) AS count_scooter
      FROM (SELECT DISTINCT region_type, region_name FROM edges) r LEFT JOIN (SELECT h.*, form_factor FROM hits h JOIN typed USING (event_id) WHERE status = 'core') t USING (region_type, region_name) GROUP BY ALL"""),
    "spatial_left_zero_fill": fx.sql("""SELECT r.region_type, r.region_name, CAST(count(t.event_id) AS BIGINT) AS count_total
      FROM (SELECT DISTINCT region_type, region_name FROM edges) r LEFT JOIN (SELECT h.* FROM hits h JOIN typed USING (event_id) WHERE status = 'core' AND is_disabled AND range_m > 9900) t USING (region_type, region_name) GROUP BY ALL"""),
    "fleet_status": fx.sql("""SELECT form_factor, count(*) FILTER (WHERE st = 'available') AS available, count(*) FILTER (WHERE st = 'reserved') AS reserved, count(*) FILTER (WHERE st = 'out') AS out FROM
      (SELECT *, CASE WHEN coalesce(is_disabled, false) THEN 'out' WHEN coalesce(is_reserved, false) THEN 'reserved' ELSE 'available' END AS st FROM typed) GROUP BY form_factor"""),
    "form_factor_resolve": fx.sql("SELECT event_id, form_factor, use_type FROM typed"),
    "boundary_layer_summary": fx.sql("SELECT region_type, count(DISTINCT region_name) AS features, min(least(x1, x2)) AS west, max(greatest(x1, x2)) AS east, min(least(y1, y2)) AS south, max(greatest(y1, y2)) AS north FROM edges GROUP BY 1"),
    "union_layers": fx.sql("SELECT region_type, region_name, count(*) AS edges FROM edges GROUP BY 1, 2"),
    "distinct_group_members": fx.sql("SELECT DISTINCT region_type, vehicle FROM hits JOIN points USING (event_id) WHERE region_type <> 'neighborhood'"),
}
