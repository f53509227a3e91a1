"""Streams with late rows, expiring state, repeated batches: equal to batch results."""

import os
import random

import pytest
from pyspark.sql import functions as F

from fleetlake.operators import rides
from fleetlake.plans import catalog
from fleetlake.sources import fixtures as fx
from fleetlake.streaming import streams

HOUR = 3_600_000_000


def files(frames, path):
    """One file per frame, in the order of their times of change."""
    for k, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            full = os.path.join(path, name)
            if os.path.getmtime(full) > 1e9:  # not yet dated
                os.utime(full, (1000 + k, 1000 + k))


def drained(stream, tmp_path, name):
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-check")).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / name)).collect(), query


def shuffled(spark, rows, schema, key, parts, delay_us, seed=1):
    """Frames of rows that come in another order than they happened, at most ``delay_us`` late, and a closing one."""
    rnd = random.Random(seed)
    come = sorted(rows, key=lambda r: r["us"] + rnd.random() * delay_us)
    size = -(-len(come) // parts)
    frames = [spark.createDataFrame(come[k : k + size], schema) for k in range(0, len(come), size)]
    whole = streams.closed(spark.createDataFrame(rows, schema), key, delay_us // 1000)
    return [*frames, whole.where(F.col(key).isNull())]


def test_late_samples_take_their_place(spark, sf_dir, tmp_path):
    moving = fx.moving(spark, sf_dir).selectExpr("event_id", "vehicle", "us", "lat", "lon", "coalesce(is_reserved, false) AS reserved")
    rows = moving.collect()
    files(shuffled(spark, rows, moving.schema, "vehicle", 6, 48 * HOUR), str(tmp_path / "in"))
    source = spark.readStream.schema(moving.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got, query = drained(streams.vehicle_state_stream(source, delay="48 hours"), tmp_path, "states")
    want = {r["event_id"]: r["kind"] for r in rides.vehicle_states(fx.moving(spark, sf_dir)).collect()}
    assert {r["event_id"]: r["kind"] for r in got} == want and len(got) == len(want)
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 7  # micro-batches with rows


def test_late_reports_are_judged_in_time_order(spark, tmp_path):
    rnd = random.Random(6)
    rows = [{"us": rnd.randrange(0, 40 * HOUR), "event_id": k, "key": f"k{k % 7}"} for k in range(400)]
    schema, gap = "us long, event_id long, key string", HOUR // 2
    files(shuffled(spark, rows, schema, "key", 8, 3 * HOUR), str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got, _ = drained(streams.accepted_reports_stream(source, gap, delay="3 hours"), tmp_path, "reports")
    want, last = {}, {}
    for r in sorted(rows, key=lambda r: (r["us"], r["event_id"])):
        fine = r["key"] not in last or r["us"] - last[r["key"]] >= gap
        want[r["event_id"]] = fine
        last[r["key"]] = r["us"] if fine else last[r["key"]]
    assert {r["event_id"]: r["accepted"] for r in got} == want and len(got) == len(want)
    left = {v: spark.read.format("statestore").option("path", str(tmp_path / "reports-check")).option("stateVarName", v).load() for v in ("own", "timer", "waiting")}
    # After the gap nothing is known of a key; only reports of the last half hour can still hold.
    end = max(r["us"] for r in rows)
    assert left["own"].count() == sum(end - us < gap for us in last.values())
    assert left["waiting"].count() <= 1  # the closing row


def test_silent_vehicles_are_forgotten(spark, tmp_path):
    machine = streams.vehicle_machine(keep_us=10 * HOUR)
    rows = [(t * HOUR, k, "v1", 39.7, -105.0, False) for k, t in enumerate((1, 2, 11, 22, 33))] + [(5 * HOUR, 8, "v3", 39.7, -105.0, False), (40 * HOUR, 9, "v2", 39.7, -105.0, False)]
    rows.sort()
    schema = "us long, event_id long, vehicle string, lat double, lon double, reserved boolean"
    files([spark.createDataFrame([r], schema) for r in rows], str(tmp_path / "in"))
    files([streams.closed(spark.createDataFrame(rows, schema), "vehicle", 1000).where("vehicle is null")], str(tmp_path / "in2"))
    os.rename(*[os.path.join(str(tmp_path / d), n) for d, n in (("in2", next(n for n in os.listdir(tmp_path / "in2") if n.endswith("parquet"))), ("in", "z.parquet"))])
    os.utime(tmp_path / "in/z.parquet", (2000, 2000))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got, _ = drained(streams.in_order(source, "vehicle", machine, "event_id long, vehicle string, us long, kind string", "1 second"), tmp_path, "kept")
    assert {r["event_id"]: r["kind"] for r in got} == {0: "new", 1: "stationary", 2: "stationary", 3: "new", 4: "new", 8: "new", 9: "new"}  # 11 hours of silence are more than ten
    own = spark.read.format("statestore").option("path", str(tmp_path / "kept-check")).option("stateVarName", "own").load()
    assert {r["key"]["vehicle"] for r in own.collect()} == {"v1", "v2"}  # v3 went without a further row of its own


@pytest.mark.parametrize("split", [1, 3, 10])
def test_machines_do_not_depend_on_batches(split):
    rnd = random.Random(split)
    machine = streams.watch_machine()
    rows = [(rnd.randrange(0, 20 * HOUR), None if rnd.random() < 0.8 else k, rnd.random() < 0.3) for k in range(300)]
    once = machine.run(None, rows, 30 * HOUR)
    state, made = None, []
    for k in range(split):
        lo, hi = 20 * HOUR * k // split, 20 * HOUR * (k + 1) // split
        state, out = machine.run(state, [r for r in rows if lo <= r[0] < hi], hi - 1)
        made += out
    state, out = machine.run(state, [], 30 * HOUR)
    assert (state, sorted(made + out, key=str)) == (once[0], sorted(once[1], key=str)) and state is None


def test_cycles_are_stored_once_and_stale_feeds_skipped(spark, sf_dir, tmp_path):
    polygons = fx.boundaries(spark, sf_dir)

    def feed(name, time, n):
        body = spark.range(n).selectExpr(f"{time}L AS last_updated", "struct(concat('b', id) AS bike_id, 39.6 + id * 0.01 AS lat, -105.2 + id * 0.02 AS lon, '1' AS vehicle_type_id) AS b").groupBy("last_updated").agg(F.collect_list("b").alias("bikes"))
        body.select(F.to_json(F.struct("last_updated", F.struct("bikes").alias("data"))).alias("value")).coalesce(1).write.mode("append").text(str(tmp_path / "feed"))

    class Failing(streams.CycleStore):
        """Fails once between the two frames of a batch."""

        fail_at, calls = 1, []

        def __call__(self, name, frame, number):
            self.calls.append((name, number))
            if name == "regions" and number == self.fail_at:
                self.fail_at = None
                raise OSError("lost between two frames")
            super().__call__(name, frame, number)

    store = Failing(spark, str(tmp_path / "store"))
    run = lambda: streams.cycle_stream(spark, str(tmp_path / "feed"), polygons, store, str(tmp_path / "check")).awaitTermination()
    feed("a", 100, 20)
    run()
    feed("b", 200, 25)
    with pytest.raises(Exception, match="lost between"):
        run()
    assert {r["last_updated"] for r in store.read("points").collect()} == {100}  # half a cycle shows nothing
    run()
    for time, n in ((200, 9), (150, 9), (300, 30)):
        feed("c", time, n)
        run()
    assert store.calls.count(("points", 1)) == 2  # the batch ran twice
    got = {r["last_updated"]: r["n"] for r in store.read("points").groupBy("last_updated").agg(F.count("*").alias("n")).collect()}
    assert got == {100: 20, 200: 25, 300: 30}
    regions = store.read("regions").groupBy("last_updated").agg(F.count("*").alias("n"), F.sum("count_total").alias("devices")).collect()
    assert {r["last_updated"]: r["n"] for r in regions} == dict.fromkeys((100, 200, 300), polygons.count())
    assert catalog.SQL["cycle_stream_regions"]


def test_rows_of_a_key_wait_as_one_and_late_ones_are_left_out(spark, tmp_path):
    schema = "us long, event_id long, key string"
    rows = [(HOUR * 10 + k * 1_000_000, k, f"k{k % 2}") for k in range(600)]
    late = [(HOUR * 20, 700, "k0"), (HOUR, 701, "k0"), (HOUR, 702, "k1"), (HOUR * 20, 703, None)]  # 701 comes with a row in time, 702 alone
    files([spark.createDataFrame(rows, schema), spark.createDataFrame(late, schema)], str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got, query = drained(streams.accepted_reports_stream(source, 1_000_000, delay="1 hour"), tmp_path, "out")
    assert sorted(r["event_id"] for r in got) == list(range(600)) and all(r["accepted"] for r in got)
    waiting = spark.read.format("statestore").option("path", str(tmp_path / "out-check")).option("stateVarName", "waiting")
    assert {r["key"]["key"] for r in waiting.load().collect()} == {"k0", None}  # 700 and the closing row
    assert waiting.option("batchId", 0).load().count() == 2  # 300 rows of each key in one element
