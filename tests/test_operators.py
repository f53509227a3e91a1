"""Every registered query against its SQL on the smallest tables, and rules that the tables do not show."""

import os

import duckdb
import pytest

from fleetlake.operators import community, fleet, rides, rollups, spatial
from fleetlake.plans import catalog
from fleetlake.registry import core_columns
from fleetlake.sources import fixtures as fx
from fleetlake.sources import io

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="session")
def duck(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


def plain(x):
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, (list, tuple)):
        return str([plain(v) for v in x])
    return x.isoformat() if hasattr(x, "isoformat") else repr(x)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in catalog.SQL:
        assert rows
        return
    got = duck.execute(catalog.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    assert rows == sorted(str([plain(r[names.index(c)]) for c in cols]) for r in got.fetchall())


def test_hmac_is_rfc_2104(spark, sf_dir):
    import hashlib
    import hmac

    for r in catalog.QUERIES["vehicle_pseudonym"](spark, sf_dir).collect():
        plate = f"PL-{r['user_id']:05d}".encode()
        assert r["pseudonym"] == hmac.new(b"salt", plate, hashlib.sha256).hexdigest()[:16]


def test_core_summary_has_the_registered_order(spark, sf_dir):
    cols = catalog.QUERIES["core_summary"](spark, sf_dir).columns
    assert cols[: len(core_columns())] == [c[0] for c in core_columns()]


def test_polygons_with_holes_and_parts(spark):
    ring = lambda x, y, w: [[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]
    rings = {"hole": [ring(0, 0, 10), ring(4, 4, 2)], "parts": [ring(20, 0, 2), ring(25, 0, 2)]}
    rows = [("t", n, [(a[0] + 0.0, a[1] + 0.0, b[0] + 0.0, b[1] + 0.0) for r in rs for a, b in zip(r, r[1:])]) for n, rs in rings.items()]
    polygons = spark.createDataFrame(rows, "region_type string, region_name string, edges array<struct<x1: double, y1: double, x2: double, y2: double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 1.0, 21.0), (4, 1.0, 23.5), (5, 1.0, 26.0), (6, 1.0, 27.001)], "event_id long, lat double, lon double")
    got = {(r["event_id"], r["region_name"]) for r in spatial.points_in_polygons(points, polygons).collect()}
    assert got == {(1, "hole"), (3, "parts"), (5, "parts")}
    near = {r["event_id"] for r in spatial.near_polygons(points, polygons, 200.0).collect()}
    assert near == {1, 3, 5, 6}


def test_read_boundaries_and_feed(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"features": [{"properties": {"name": "A"}, "geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1],[0,0]]]}}, {"properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[2,0],[3,0],[3,1],[2,0]]],[[[4,0],[5,0],[5,1],[4,0]]]]}}]}')
    got = {r["region_name"]: len(r["edges"]) for r in io.read_boundaries(spark, str(tmp_path / "l.json"), "v1", "name").collect()}
    assert got == {"A": 3, "v1_002": 6}
    (tmp_path / "f.json").write_text('{"last_updated": 5, "data": {"bikes": [{"bike_id": "a", "lat": 39.6, "lon": -105.0}, {"id": "b", "lat": "x", "lon": 1}, {"lat": 1, "lon": 2}, {"id": "c", "lat": 1, "lon": 2, "is_disabled": "maybe"}]}}')
    got = {r["device_id"]: r["is_disabled"] for r in io.read_feed(spark, str(tmp_path / "f.json")).collect()}
    assert got == {"a": None, "c": None}


def test_slow_drift_never_moves_and_rental_freezes():
    state, kinds = None, []
    for k in range(40):  # 0.9 m at a time: moved once the stored stop is over 16 m away
        state, kind = rides.vehicle_step(state, False, 39.7 + 0.9 * k / 111_320, -105.0)
        kinds.append(kind)
    assert kinds[:18] == ["new"] + ["stationary"] * 17 and kinds[18] == "moved" and kinds.count("moved") == 2
    state, _ = rides.vehicle_step(None, False, 39.7, -105.0)
    state, a = rides.vehicle_step(state, True, 39.71, -105.0)
    state, b = rides.vehicle_step(state, True, 39.72, -105.0)
    state, c = rides.vehicle_step(state, False, 39.70001, -105.0)
    assert (a, b, c) == ("rental_start", "in_rental", "failed_start") and state == (39.7, -105.0, False)


def test_a_rejected_report_does_not_start_the_gap_anew(spark):
    df = spark.createDataFrame([(1, "r", 7), (2, "r", 1_000_000_000), (3, "r", 1_900_000_000), (4, "r", 3_600_000_000), (5, "s", 5)], "event_id long, reporter string, us long")
    got = {r["event_id"]: r["accepted"] for r in community.fold_accepted(df, ["reporter"], 1_800_000_000).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_ride_cap_and_even_points(spark, sf_dir):
    df = spark.createDataFrame([(1, 1, 34, 1), (2, 1, 48, 2), (3, 1, 52, 3), (4, 1, 6, 4)], "entry_id long, source_id long, points long, ts long")
    assert [r["paid"] for r in community.capped_awards(df).orderBy("entry_id").collect()] == [34, 48, 18, 0]
    assert all(r["paid"] % 2 == 0 for r in catalog.QUERIES["points_ledger"](spark, sf_dir).collect())


def test_dwell_peers_ladder(spark):
    rows = [(f"a{k}", 0, 0, h) for k, h in enumerate([2.5, 3.0, 9.0, 10.0, 11.0, 41.0])] + [("far", 50, 50, 30.0)]
    got = {r["vehicle"]: r for r in fleet.dwell_peers(spark.createDataFrame(rows, "vehicle string, q long, r long, hours double")).collect()}
    assert got["a5"]["median_h"] == 9.5 and got["a5"]["outlier"] and not got["a0"]["outlier"]
    assert got["far"]["scope"] == 0


def test_rank_ties_take_the_last_place(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 7), (4, None)], "event_id long, range_m int").selectExpr("*", "date'2024-01-01' AS day", "'1' AS type_id")
    got = {r["event_id"]: (r["rank_x"], r["rank_y"]) for r in fleet.range_ranks(df).collect()}
    assert got == {1: (2, 3), 2: (2, 3), 3: (3, 3)}


def test_sinks_replace_and_do_not_add(spark, sf_dir, tmp_path):
    p = fx.points(spark, sf_dir).select("event_id", "day")
    path = str(tmp_path / "archive")
    old = p.where("day < '2024-01-10'")
    assert io.archive_new(old, path) == old.count() and io.archive_new(old, path) == 0
    assert io.archive_new(p, path) == p.where("day >= '2024-01-10'").count()
    assert spark.read.parquet(path).count() == p.count()
    daily = rollups.QUERIES["telemetry_daily"](spark, sf_dir)
    for _ in range(2):
        io.replace_partitions(daily, str(tmp_path / "daily"), "day")
    assert spark.read.parquet(str(tmp_path / "daily")).count() == daily.count()
    assert not io.swap_if_complete(daily, daily.count() * 2, str(tmp_path / "swap")) and not os.path.exists(tmp_path / "swap")
    assert io.swap_if_complete(daily, daily.count(), str(tmp_path / "swap"))
    spark.range(3).write.parquet(str(tmp_path / "v/a"))
    spark.range(3).selectExpr("id", "id AS more").write.parquet(str(tmp_path / "v/b"))
    assert io.scan_by_name(spark, str(tmp_path / "v/a"), str(tmp_path / "v/b")).where("more IS NULL").count() == 3
    assert io.insert_absent(spark.range(3), spark.range(5), "id").count() == 2


def test_streams_equal_batch(spark, sf_dir, tmp_path):
    from fleetlake.streaming import streams

    moving = fx.moving(spark, sf_dir).selectExpr("event_id", "vehicle", "us", "lat", "lon", "coalesce(is_reserved, false) AS reserved")
    ended_ = streams.closed(moving, "vehicle", 3_600_000)  # a row that closes the stream: the last rows wait for the watermark
    for k, part in enumerate((moving.where("us < 1704080000000000"), ended_.where("us >= 1704080000000000"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p{k}"))
    for k in (0, 1):  # two micro-batches with state kept between them
        source = spark.readStream.schema(moving.schema).parquet(str(tmp_path / "in/p[0]" if k == 0 else tmp_path / "in/*"))
        q = streams.vehicle_state_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    want = sorted((r["event_id"], r["kind"]) for r in rides.vehicle_states(fx.moving(spark, sf_dir)).collect())
    assert sorted((r["event_id"], r["kind"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want

    starts = rides.watches(spark, sf_dir).selectExpr("vehicle", "start AS us", "ride_id", "false AS reserved")
    both = moving.selectExpr("vehicle", "us", "CAST(NULL AS long) AS ride_id", "reserved").unionByName(starts)
    both = streams.closed(both, "vehicle", 600_000)
    for k, part in enumerate((both.where("us < 1704080000000000"), both.where("us >= 1704080000000000"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"watch/p{k}"))
    for k in (0, 1):
        source = spark.readStream.schema(both.schema).parquet(str(tmp_path / "watch/p[0]" if k == 0 else tmp_path / "watch/*"))
        streams.ride_watch_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "ended")).option("checkpointLocation", str(tmp_path / "check3")).trigger(availableNow=True).start().awaitTermination()
    ended = {r["ride_id"]: tuple(r) for r in spark.read.parquet(str(tmp_path / "ended")).select("ride_id", "state", "left_us", "back_us").collect()}
    batch = {r["ride_id"]: tuple(r) for r in catalog.QUERIES["ride_watch"](spark, sf_dir).collect()}
    assert {i for i, r in batch.items() if r[1] == "resolved"} == {i for i, r in ended.items() if r[1] == "resolved"}
    assert all(batch[i] == r for i, r in ended.items())

    text = fleet.feed_rows(spark, sf_dir).selectExpr("last_updated", "struct(bike_id, lat, lon, vehicle_type_id) AS b").groupBy("last_updated").agg({"b": "collect_list"}).selectExpr("to_json(struct(last_updated, struct(`collect_list(b)` AS bikes) AS data)) AS value")
    text = text.where("get_json_object(value, '$.last_updated') < 1704326400")  # three days, a file each
    text.write.option("maxRecordsPerFile", 1).text(str(tmp_path / "feed"))
    seen = {}

    def sink(name, frame, number):
        seen.setdefault(name, []).extend(frame.collect())

    streams.cycle_stream(spark, str(tmp_path / "feed"), fx.boundaries(spark, sf_dir), sink, str(tmp_path / "check2")).awaitTermination()
    status = {}
    for r in seen["points"]:
        status[r["status"]] = status.get(r["status"], 0) + 1
    want = {r["status"]: r["count"] for r in catalog.QUERIES["refine_status_semi_anti"](spark, sf_dir).join(fx.points(spark, sf_dir).where("day < '2024-01-04'").select("event_id"), "event_id").groupBy("status").count().collect()}
    assert status == want


def test_burn_model_finds_known_coefficients(spark):
    from fleetlake.operators.rentals import train_burn_model

    rows = [(str(k % 3 + 1), float(k % 50), float(k % 7), 2.0 + 0.5 * (k % 50) + 0.25 * (k % 7) + (k % 3)) for k in range(300)]
    model = train_burn_model(spark.createDataFrame(rows, "type_id string, km double, climb double, burn double"), ["km", "climb"])
    w = model.stages[-1].coefficients
    assert abs(w[0] - 0.5) < 1e-3 and abs(w[1] - 0.25) < 1e-3
    with pytest.raises(ValueError):
        train_burn_model(spark.createDataFrame(rows[:50], "type_id string, km double, climb double, burn double"), ["km", "climb"])
