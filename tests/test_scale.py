"""Ranks, running totals, adaptive tiles, sketches and the archive's commits against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fleetlake.functions import prefix
from fleetlake.operators import rollups, spatial
from fleetlake.sources import fixtures as fx
from fleetlake.sources import io
from fleetlake.sources.archive import Archive


@pytest.mark.parametrize("width", [None, 7, 1000])
def test_value_ranks_equal_brute_force(spark, width):
    rnd = random.Random(5)
    rows = [(k, rnd.choice(["a", "b", None]), rnd.choice([None, *range(-20, 60)])) for k in range(900)]
    frame = spark.createDataFrame(rows, "id long, g string, v int")
    got = prefix.matched(frame, prefix.value_ranks(frame, "v", ["g"], width), ["g", "v"]).collect()
    groups = defaultdict(list)
    for _, g, v in rows:
        if v is not None:
            groups[g].append(v)
    want = {k: (sum(x <= v for x in groups[g]), len(groups[g]), len({x for x in groups[g] if x <= v}), len(set(groups[g]))) for k, g, v in rows if v is not None}
    assert {r["id"]: (r["upto"], r["total"], r["place"], r["kinds"]) for r in got} == want


def test_ranks_order_no_points(spark, sf_dir):
    from fleetlake.operators import fleet

    for frame in (fleet.range_ranks(fx.points(spark, sf_dir)), fleet.cell_ranks(fx.points(spark, sf_dir))):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.split("\n") if "Window [" in line]
        assert windows and not any("event_id" in line for line in windows)


def test_running_totals_equal_brute_force(spark):
    rnd = random.Random(6)
    rows = [(k, rnd.randrange(3), rnd.randrange(5000), rnd.choice([None, 1, 2, 9])) for k in range(800)] + [(900, None, 3, 5), (901, None, 4, 6)]
    frame = spark.createDataFrame(rows, "id long, g long, t long, v long")
    got = {r["id"]: r["total"] for r in prefix.running_total(frame, "v", "g", ["t", "id"], F.expr("t div 100")).collect()}
    total, want = Counter(), {}
    seen = set()
    for k, g, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        total[g] += v or 0
        seen |= {g} if v is not None else set()
        want[k] = total[g]
    assert {k: v or 0 for k, v in got.items()} == want


def brute_inside(edges, lat, lon):
    return sum((y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in edges) % 2 == 1


@pytest.mark.parametrize("most, points_", [(4, 20), (64, 10**9)])
def test_adaptive_tiles_hold_the_same_polygons(spark, monkeypatch, most, points_):
    monkeypatch.setattr(spatial, "BROADCAST_EDGES", 0)
    monkeypatch.setattr(spatial, "TILE_EDGES", most)
    monkeypatch.setattr(spatial, "TILE_POINTS", points_)
    rnd = random.Random(most)
    polygons = []
    for k in range(60):  # rings of many shapes around a centre, some with holes, some over several tiles
        at, size = (39.7 + rnd.uniform(-0.03, 0.03), -105.0 + rnd.uniform(-0.03, 0.03)), rnd.choice((0.003, 0.02, 0.06))
        rings = []
        for shrink in (1.0, 0.4)[: rnd.choice((1, 2))]:
            n = rnd.choice((3, 8, 60))
            from math import cos, pi, sin

            ring = [(at[1] + shrink * size * rnd.uniform(0.5, 1) * cos(2 * pi * i / n), at[0] + shrink * size * rnd.uniform(0.5, 1) * sin(2 * pi * i / n)) for i in range(n)]
            rings += [(*ring[i], *ring[(i + 1) % n]) for i in range(n)]
        polygons.append((k, rings))
    points = [(k, 39.7 + rnd.uniform(-0.06, 0.06), -105.0 + rnd.uniform(-0.06, 0.06)) for k in range(400)] + [(500 + k, 39.70001, -105.00001) for k in range(60)] + [(600, 39.72, -105.0), (601, 39.70, -104.98), (602, 0.0, 0.0)]
    frame = spark.createDataFrame([(k, [dict(zip(("x1", "y1", "x2", "y2"), e)) for e in edges]) for k, edges in polygons], "zone_id long, edges array<struct<x1: double, y1: double, x2: double, y2: double>>")
    with io.scope(spark):
        x = spatial.with_regions(spark.createDataFrame(points, "id long, lat double, lon double"), frame)
        assert x.columns == ["id", "lat", "lon", "regions"]
        got = {r["id"]: sorted(g["zone_id"] for g in r["regions"]) for r in x.collect()}
        dealt, lists = spatial.split_tiles(spark.createDataFrame(points, "id long, lat double, lon double"), frame)
        longest = lists.select(F.aggregate("polygons", F.lit(0), lambda a, g: a + F.size(g["edges"])).alias("n")).agg(F.max("n")).first()[0]
        crowded = dealt.groupBy("spot").count().agg(F.max("count")).first()[0]
    assert got == {k: [z for z, edges in polygons if brute_inside(edges, lat, lon)] for k, lat, lon in points}
    assert longest < sum(len(e) for _, e in polygons) / 3
    assert crowded <= 3 * points_


def test_sketches_merge_and_hold_their_error(spark):
    rnd = random.Random(9)
    rows = [(k % 30, f"r{k % 2}", int(rnd.lognormvariate(4, 1.5)), 500 if k % 11 == 0 else 200) for k in range(60_000)]
    frame = spark.createDataFrame(rows, "day long, route string, ms long, status long").repartition(8)
    with io.scope(spark):
        daily = io.stored(rollups.request_sketches(frame, "day", "route"))
        assert daily.agg(F.max(F.octet_length("sketch"))).first()[0] < 20_000
        shares = (0.01, 0.25, 0.5, 0.95, 0.99)
        for by, size in ((["route"], 2), ([], 1)):
            got = rollups.merged_sketches(daily, *by).withColumn("q", rollups.quantiles(F.col("sketch"), *shares)).collect()
            assert len(got) == size
            for r in got:
                own = sorted(ms for _, route, ms, _ in rows if not by or route == r["route"])
                assert r["n"] == len(own) and r["errors"] == sum(s >= 500 for _, route, _, s in rows if not by or route == r["route"])
                for p, q in zip(shares, r["q"]):
                    assert sum(v < q for v in own) / len(own) <= p + rollups.SKETCH_ERROR and sum(v <= q for v in own) / len(own) >= p - rollups.SKETCH_ERROR


def test_archive_shows_whole_appends_alone(spark, sf_dir, tmp_path):
    points, box = fx.points(spark, sf_dir).select("event_id", "ts", "day", "lat"), Archive(spark, str(tmp_path / "archive"))
    with pytest.raises(FileNotFoundError):
        box.read()
    assert box.high_water() is None
    first = points.where("day < '2024-01-10'")
    assert box.append(first) == first.count() and box.append(first) == 0  # once more adds nothing
    high = box.high_water()
    broken = points.withColumn("lat", F.when(F.col("event_id") % 97 == 5, F.raise_error(F.lit("lost half-way")).cast("double")).otherwise(F.col("lat")))
    with pytest.raises(Exception, match="lost half-way"):
        box.append(broken)
    assert box.read().count() == first.count() and box.high_water() == high
    (tmp_path / "archive/manifest/0000000009.json").write_text('{"version": 9, "hi')  # a writer that broke off
    assert box.high_water() == high
    for lo, hi in (("2024-01-10", "2024-01-12"), ("2024-01-12", "2024-01-20"), ("2024-01-20", "2025-01-01")):
        box.append(points.where(F.col("day").between(lo, hi) & (F.col("day") < hi)).withColumn("more", F.lit(1)))  # a column that came later
    assert len(box.manifest()["appends"]) == 4
    old = Archive(spark, str(tmp_path / "archive")).manifest()
    assert box.merge(below=10**9) == 4 and len(box.manifest()["appends"]) == 1 and box.merge(below=10**9) == 0
    key = lambda df: sorted((r["event_id"], r["day"], r["lat"]) for r in df.collect())
    assert key(box.read()) == key(points)
    assert box.read().where("more IS NULL").count() == first.count()
    with pytest.raises(RuntimeError, match="another writer"):
        box._commit(old, None, [])
    assert len(box.sweep()) >= 4 and key(box.read()) == key(points) and box.sweep() == []
