"""Rules on hand-made frames: both engines could share a mistake that the tables do not show."""

import itertools
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlake.functions.folds import ordered_fold
from fleetlake.operators import cards, fleet, people, rentals, rides, routes, settle, web
from fleetlake.sources import io
from fleetlake.plans import catalog
from fleetlake.sources import fixtures as fx


def test_quality_overrides_and_demerits(spark):
    schema = "id string, soc long, disabled boolean, reserved boolean, failed long, elapsed double, daylight double, reported boolean, outlier boolean"
    rows = [
        ("plain", 90, False, False, 0, 1.5, 1.5, False, False), ("good", 60, None, None, None, None, None, False, False), ("acceptable", 28, False, False, 0, 0.0, 0.0, False, False), ("low", 27, False, False, 0, 0.0, 0.0, False, False),
        ("reserved", 90, False, True, 0, 1.0, 1.0, False, False), ("disabled", 90, True, False, 0, 1.0, 1.0, True, False), ("unread", None, False, False, 0, 1.0, 1.0, True, False), ("reported", 95, False, False, 0, 1.0, 1.0, True, False),
        ("two_fails", 95, False, False, 2, 1.0, 1.0, False, False), ("one_fail", 95, False, False, 1, 1.0, 1.0, False, False), ("half_day", 95, False, False, 0, 13.0, 2.0, False, False), ("day", 95, False, False, 0, 25.0, 9.0, False, False),
        ("sunny", 95, False, False, 0, 7.0, 6.5, False, False), ("odd_stay", 95, False, False, 0, 1.0, 1.0, False, True), ("all", 95, False, False, 1, 30.0, 12.0, False, True),
    ]
    frame = spark.createDataFrame(rows, schema)
    got = {r["id"]: r["q"] for r in frame.select("id", cards.quality_designation(*[F.col(c) for c in ("soc", "disabled", "reserved", "failed", "elapsed", "daylight", "reported", "outlier")]).alias("q")).collect()}
    assert got == {
        "plain": "great", "good": "good", "acceptable": "acceptable", "low": "poor", "reserved": "N/A", "disabled": "N/A", "unread": "N/A", "reported": "poor",
        "two_fails": "poor", "one_fail": "good", "half_day": "good", "day": "acceptable", "sunny": "good", "odd_stay": "good", "all": "poor",
    }


def test_reliability_takes_the_first_rule(spark):
    schema = "id string, failed long, hours double, designation string, reported boolean, outlier boolean, median double"
    rows = [
        ("fresh", 0, 2.0, "great", False, False, 6.0), ("reported", 0, 2.0, "N/A", True, False, 6.0), ("fails", 3, 0.5, "poor", False, False, None), ("fail_and_day", 1, 26.0, "good", False, False, None), ("fail", 1, 5.0, "good", False, False, None),
        ("ghost", 0, 80.0, "great", False, False, None), ("out", 0, 50.0, "great", False, True, 15.0), ("out_early", 0, 40.0, "great", False, True, 30.0), ("never", None, None, "great", False, False, None), ("off", 0, 1.0, "N/A", False, False, None),
        ("slow", 0, 17.0, "great", False, False, 1.0), ("patient", 0, 15.0, "great", False, False, 1.0), ("floor", 0, 37.0, "great", False, False, 10.0), ("below_floor", 0, 35.0, "great", False, False, 10.0), ("zero", 0, 40.0, "great", False, False, 0.0),
    ]
    frame = spark.createDataFrame(rows, schema)
    got = {r["id"]: r["t"] for r in frame.select("id", cards.reliability_tier(*[F.col(c) for c in ("failed", "hours", "designation", "reported", "outlier", "median")]).alias("t")).collect()}
    assert got == {
        "fresh": "ok", "reported": "high_risk", "fails": "high_risk", "fail_and_day": "high_risk", "fail": "unknown", "ghost": "high_risk", "out": "high_risk", "out_early": "ok", "never": "unknown", "off": "unknown",
        "slow": "unknown", "patient": "ok", "floor": "unknown", "below_floor": "ok", "zero": "ok",
    }


def test_reports_count_by_vehicle_cell_and_time(spark):
    now, hour = 1_700_000_000_000_000, 3_600_000_000
    devices = spark.createDataFrame([(f"d{k}", 39.7 + k * 0.01, -105.0, now) for k in range(6)], "vehicle string, lat double, lon double, now long")
    at = {r["vehicle"]: r["cell10"] for r in cards.with_reported(devices, spark.createDataFrame([], "vehicle string, us long, cell string, report_type string")).collect()}
    rows = [("d0", now - hour, at["d0"], None), ("d1", now - 25 * hour, at["d1"], None), ("d2", now, at["d3"], "damaged"), ("d3", now, at["d3"], "parking"), ("d4", now, at["d4"], "damaged"), ("d4", now, at["d4"], None), ("d5", now + 1, at["d5"], None)]
    got = cards.with_reported(devices, spark.createDataFrame(rows, "vehicle string, us long, cell string, report_type string")).collect()
    assert {r["vehicle"] for r in got if r["reported"]} == {"d0", "d4"} and len(got) == 6


def test_daylight_is_local_and_knows_the_clock_change(spark):
    rows = [("2024-03-10 08:00:00", "2024-03-11 01:00:00"), ("2024-03-09 08:00:00", "2024-03-10 01:00:00"), ("2024-06-01 13:00:00", "2024-06-01 15:30:00"), ("2024-06-02 00:00:00", "2024-06-01 00:00:00")]
    frame = spark.createDataFrame([(datetime.fromisoformat(a), datetime.fromisoformat(b)) for a, b in rows], "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in frame.select(cards.daylight_hours(*[F.convert_timezone(F.lit("UTC"), F.lit("America/Denver"), F.col(c)) for c in "ab"])).collect()]
    assert got == [11.0, 10.0, 1.5, 0.0]  # local 01:00 to 19:00, 01:00 to 18:00, 07:00 to 09:30


def test_dwell_peers_equal_brute_force(spark):
    rnd = random.Random(2)
    rows = [(f"v{k}", rnd.randrange(6), rnd.randrange(6), float(rnd.randrange(1, 40))) for k in range(60)] + [(f"f{k}", 90 + 9 * k, 5, 30.5 + k) for k in range(3)] + [("none", None, None, 12.0)] + [(f"c{k}", 1, 1, 2.0) for k in range(40)]
    got = {r["vehicle"]: (r["scope"], r["peers"], r["median_h"], r["share"]) for r in fleet.dwell_peers(spark.createDataFrame(rows, "vehicle string, q long, r long, hours double")).collect()}
    far = lambda a, b: max(abs(a[1] - b[1]), abs(a[2] - b[2]), abs(a[1] - b[1] + a[2] - b[2])) if None not in (a[1], b[1]) else 99
    for v in rows:
        rings = [(k, [b[3] for b in rows if far(v, b) <= k]) for k in (1, 2)] + [(0, [b[3] for b in rows])]
        scope, peers = next((k, p) for k, p in rings if len(p) >= 5)
        assert got[v[0]] == (scope, len(peers), float(np.median(peers)), round(sum(h <= v[3] for h in peers) / len(peers), 6))


RIDE = {"ride_id": 1, "account_id": 5, "vehicle": "v1", "issued_us": 0, "ended_us": 2_000_000_000, "start_lat": 39.7, "start_lon": -105.0, "end_lat": 39.72, "end_lon": -105.0, "feed_lat": None, "feed_lon": None, "left_us": None,
        "back_us": 1_900_000_000, "back_lat": 39.7201, "back_lon": -105.0, "soc_feed": 80, "soc_start": 70, "soc_end": None, "soc_back": 66, "battery": True, "nav": True, "own_device": False, "donated_us": 1_800_000_000, "settled_us": None}
RIDE_SCHEMA = ("ride_id long, account_id long, vehicle string, issued_us long, ended_us long, start_lat double, start_lon double, end_lat double, end_lon double, feed_lat double, feed_lon double, left_us long, "
               "back_us long, back_lat double, back_lon double, soc_feed long, soc_start long, soc_end long, soc_back long, battery boolean, nav boolean, own_device boolean, donated_us long, settled_us long")  # fmt: skip


def tracked(spark, changes, track=None):
    """Rides that differ from RIDE, each with a track of 21 fixes over 2.2 km or its own, (us, lat, lon, acc)."""
    whole = [(k * 90_000_000, 39.7 + k * 0.001, -105.0, 5.0) for k in range(21)]
    rows = [{**RIDE, "ride_id": k + 1, **c} for k, c in enumerate(changes)]
    points = [(k + 1, n, *fix) for k in range(len(rows)) for n, fix in enumerate((track or {}).get(k, whole))]
    names = RIDE_SCHEMA.replace(",", "").split()[::2]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], RIDE_SCHEMA), spark.createDataFrame(points, "ride_id long, n long, us long, lat double, lon double, acc double")


def test_track_checks_in_order(spark):
    whole = [(k * 90_000_000, 39.7 + k * 0.001, -105.0, 5.0) for k in range(21)]
    changes = [{}, {}, {"ended_us": 1_600_000_000}, {}, {"feed_lat": 39.71, "feed_lon": -105.0}, {"left_us": 700_000_000}, {"back_us": None}, {"back_lat": 39.73}, {"back_us": 2_500_000_000}, {}, {}]
    track = {1: [*whole[:5], (whole[3][0], *whole[5][1:]), *whole[6:]], 3: [*whole[:-1], (whole[-2][0] + 1_000_000, *whole[-1][1:])], 9: whole[:9], 10: [(us, 39.7 + k * 0.0001, lon, acc) for k, (us, _, lon, acc) in enumerate(whole)]}
    rides_, points = tracked(spark, changes, track)
    got = {r["ride_id"]: (r["monotonic"], r["speed"], r["reasons"], r["verdict"]) for r in settle.verdicts(rides_, settle.tracks(points)).collect()}
    assert got[1] == ("ok", "ok", "", "eligible")
    assert got[2] == ("invalid_timing", "skipped", "", "ineligible") == got[3]
    assert got[4] == ("ok", "too_fast", "", "ineligible")
    assert got[5][2:] == ("start_mismatch", "ineligible") == got[6][2:]
    assert got[7][2:] == ("", "pending_feed") and got[8][2:] == ("end_mismatch", "ineligible") == got[9][2:]
    assert got[10][2:] == ("end_mismatch,too_few_waypoints", "ineligible")
    assert got[11][2:] == ("end_mismatch,trip_too_short", "ineligible")


def test_close_out_keeps_what_is_believed(spark):
    changes = [{}, {"end_lat": 39.76}, {"end_lat": 40.9}, {"start_lat": None, "start_lon": None}]
    rides_, points = tracked(spark, changes)
    points = points.where("ride_id <> 3")
    got = {r["ride_id"]: r for r in settle.close_out(rides_, settle.tracks(points)).collect()}
    assert got[1]["source"] == "waypoints" and got[1]["path_points"] == 23 and abs(got[1]["metres"] - 2226.4) < 0.1
    assert got[2]["source"] == "waypoints_partial" and got[2]["path_points"] == 22 and abs(got[2]["metres"] - 2226.4) < 0.1
    assert got[3]["source"] == "straight_line" and got[3]["path_points"] == 2 and got[3]["metres"] == 80_000 and got[3]["clamped_from"] > 133_000
    assert got[4]["path_points"] == 22


def test_late_settlement_pays_once_the_feed_answers(spark):
    late = {"donated_us": 1_850_000_000}
    changes = [late, {**late, "soc_end": 60}, {**late, "soc_end": 60, "own_device": True}, {**late, "back_lat": 39.74}, {**late, "back_us": None}, {"donated_us": 1_950_000_000}, {**late, "soc_end": 10, "nav": False}]
    rides_, points = tracked(spark, changes)
    got = {r["ride_id"]: (r["status"], r["battery_points"], r["nav_points"], r["trained"]) for r in settle.settle(rides_, settle.tracks(points)).collect()}
    assert got == {1: ("eligible", 0, 2, True), 2: ("eligible", 12, 2, True), 3: ("eligible", 0, 2, True), 4: ("ineligible", 0, 0, False), 5: ("ineligible", 0, 0, False), 7: ("eligible", 12, 0, False)}


def test_donated_rides_replace_mined_ones(spark):
    rides_, points = tracked(spark, [{}, {"vehicle": "v2", "back_lat": 39.8}])
    mined = spark.createDataFrame([("v1", 500_000_000, 3.0), ("v1", 2_100_000_000, 4.0), ("v2", 500_000_000, 5.0)], "vehicle string, departed_us long, burn double")
    got = sorted((r["vehicle"], r["departed_us"], r["burn"], r["origin"]) for r in settle.donated_observations(rides_, settle.tracks(points), mined).collect())
    assert got == [("v1", 0, 14.0, "donated"), ("v1", 2_100_000_000, 4.0, "mined"), ("v2", 500_000_000, 5.0, "mined")]


def test_owners_leave_after_their_clocks(spark):
    hour = 3_600_000_000
    changes = [{"donated_us": 100 * hour}, {"donated_us": 90 * hour, "settled_us": 97 * hour}, {"donated_us": 90 * hour, "settled_us": 95 * hour}, {"donated_us": 71 * hour}]
    rides_, points = tracked(spark, changes)
    owners, fixes = settle.deidentify(rides_, points)
    assert {r["ride_id"]: (r["owner"], r["route_owner"]) for r in owners.collect()} == {1: (5, 5), 2: (5, 5), 3: (None, 5), 4: (None, None)}
    cut = {r["ride_id"]: r["recorded_ms"] for r in fixes.where("n = 1").collect()}
    assert cut == {1: 90_000, 2: 90_000, 3: 60_000, 4: 60_000}


def test_consensus_machine_equals_brute_force(spark):
    rnd = random.Random(8)
    rows = [(k, f"v{rnd.randrange(40)}", k * 10, rnd.choice([True, True, False, None]), rnd.choice([True, False, None]), rnd.random() > 0.1) for k in range(900)]
    frame = spark.createDataFrame(rows, "event_id long, vehicle string, ts long, basket boolean, holder boolean, plate_valid boolean")
    got = {r["vehicle"]: tuple(r)[1:] for r in people.consensus_machine(frame).collect()}
    for v in {r[1] for r in rows}:
        stored, status, n, votes, resolved = None, None, 0, None, 0
        for own in ([r[3], r[4]] for r in rows if r[1] == v and r[5]):
            if stored is None:
                stored, n = own, 1
                status = "up_to_date" if None not in own else "partial"
            elif votes is not None:
                votes.append(own)
                if len(votes) == 3:
                    for k in (0, 1):
                        yes, no = sum(x[k] is True for x in votes), sum(x[k] is False for x in votes)
                        if yes + no:
                            stored = [*stored]
                            stored[k] = True if yes >= (yes + no) // 2 + 1 else False if no >= (yes + no) // 2 + 1 else stored[k]
                    status, n, votes, resolved = ("up_to_date" if None not in stored else "needs_confirmed"), 3, None, resolved + 1
            elif any(a is not None and b is not None and a != b for a, b in zip(stored, own)):
                votes, status = [own], "review"
            else:
                n, before = n + 1, stored
                stored = [b if a is None else a for a, b in zip(stored, own)]
                status = "up_to_date" if None not in stored else status
        assert got[v] == (*stored, status, n, resolved), v
    assert len({s for *_, s, _, _ in got.values()}) >= 2


def test_burn_model_equals_least_squares(spark):
    rng = np.random.default_rng(4)
    x, kind = rng.random((400, 4)) * [5, 3, 30, 60], rng.integers(0, 3, 400)
    y = x @ [2.0, 1.5, -0.05, 0.01] + np.array([1.0, 4.0, 9.0])[kind] + 0.3 * rng.standard_normal(400)
    frame = spark.createDataFrame([(*map(float, r), f"t{k}", float(v)) for r, k, v in zip(x, kind, y)], "km double, climb double, temp double, stale double, type_id string, burn double")
    model = rentals.fit_burn(frame)
    design = np.hstack((x, np.eye(3)[kind]))
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    rest = y - design @ want
    assert np.allclose([*model["slopes"].values(), *model["offsets"].values()], want, atol=1e-8)
    assert abs(model["r2"] - (1 - rest @ rest / ((y - y.mean()) ** 2).sum())) < 1e-9 and abs(model["sigma"] - np.sqrt(rest @ rest / 393)) < 1e-9
    assert abs(model["default"] - want[4:] @ np.bincount(kind) / 400) < 1e-8
    got = frame.select(rentals.predicted(model, {"km": F.col("km")}, F.lit("unseen")).alias("p"), "km").first()
    assert abs(got["p"] - (model["default"] + want[0] * got["km"])) < 1e-9
    assert rentals.fit_burn(frame.limit(90)) is None


def test_grade_is_drawn_to_the_fleet(spark):
    frame = spark.createDataFrame([(4, 0), (5, 0), (50, 0), (50, 3), (60, 40), (9, 30)], "rentals long, bad long")
    assert [r[0] for r in frame.select(fleet.ride_grade(F.col("rentals"), F.col("bad"))).collect()] == [None, 86, 95, 86, 65, 65]


def test_stale_snapshots_by_time_then_content(spark):
    rows = [(1, 10, "a"), (1, 10, "b"), (2, 10, "c"), (3, 20, "c"), (4, None, "c"), (5, 30, "c"), (6, None, "d"), (7, 30, "e")]
    frame = spark.createDataFrame([(s, lu, v, 1.0, 2.0, 3) for s, lu, v in rows], "snapshot long, last_updated long, vehicle string, lat double, lon double, range_m int")
    assert {r["snapshot"]: r["stale"] for r in web.stale_snapshots(frame).collect()} == {1: False, 2: True, 3: False, 4: True, 5: True, 6: False, 7: False}


def test_options_with_one_shape_become_labels(spark):
    ways = {10: [1, 2, 3], 11: [1, 2, 3], 12: [3, 2, 1], 13: [1, 2, 3], 25: [1, 2, 3]}
    rows = [(r, k + 1, w, 10.0 + (r == 11)) for r, ws in ways.items() for k, w in enumerate(ws)]
    got = {(r["request"], r["route_id"]): r["labels"] for r in routes.distinct_options(spark.createDataFrame(rows, "route_id long, seq int, way_id long, metres double")).collect()}
    assert got == {(1, 11): "10,13", (1, 12): "", (2, 25): ""}


def test_archive_waits_and_types_fall_back(spark):
    at = lambda h: datetime(2024, 5, 1 + h // 24, h % 24)
    rows = spark.createDataFrame([(k, at(k)) for k in range(40)], "event_id long, ts timestamp_ntz")
    assert fleet.archive_due(rows, rows.where("event_id <= 10"), 24).count() == 29
    assert fleet.archive_due(rows, rows.where("event_id <= 20"), 24).count() == 0
    assert fleet.archive_due(rows, rows.limit(0), 24).count() == 40 and fleet.archive_due(rows.limit(0), rows, 24).count() == 0
    schema = "type_id string, form_factor string, use_type string, max_range string"
    types = fleet.vehicle_type_dim(spark.createDataFrame([("1", "scooter", None, "12.5"), ("9", "bicycle", None, "700")], schema), spark.createDataFrame([("1", "x", "y", 5), ("2", "z", "y", 6)], schema.replace("max_range string", "max_range int")))
    assert sorted(map(tuple, types.collect())) == [("1", "scooter", None, None), ("2", "z", "y", 6), ("9", "bicycle", None, 700)]


def test_folds_stream_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k % 5, k, k % 3) for k in range(200)]
        frame = spark.createDataFrame(rows, "key long, us long, x long")
        step = lambda s, r: ((s or 0) + r[2], (r[0], (s or 0) + r[2]))
        got = sorted(map(tuple, ordered_fold(frame, ["key"], ["us"], step, "key long, total long").collect()))
        want = sorted((k, t) for k in range(5) for t in itertools.accumulate(x for key, _, x in rows if key == k))
        assert got == want
        ends = ordered_fold(frame, ["key"], ["us"], lambda s, r: ((s or 0) + r[2], None), "key long, total long", lambda key, s: (key[0], s))
        assert sorted(map(tuple, ends.collect())) == [(k, sum(x for key, _, x in rows if key == k)) for k in range(5)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("name", ["survey_validate", "feedback_clean", "consensus_vote", "contact_match", "address_match", "cumulative_threshold", "device_card", "cell_aggregates", "finalize_validation", "donated_observation", "fit_burn_model"])
def test_queries_of_the_rules_are_not_empty(spark, name):
    assert not catalog.QUERIES[name](spark, "/root/testdata/sf0.01").isEmpty()


def test_episodes_by_hand(spark):
    rows = [(0, False, 900), (1, True, None), (2, True, None), (3, False, None), (4, False, 700), (5, False, 690), (6, True, None), (7, False, 650)]
    frame = spark.createDataFrame([(k, "v1", "1", us * 1_000_000, 39.7 + us * 0.01, -105.0, res, rng) for k, (us, res, rng) in enumerate(rows)], "event_id long, vehicle string, type_id string, us long, lat double, lon double, is_reserved boolean, range_m int")
    got = [(r["episode"], r["pre_range"], r["post_range"], r["departed_us"], r["arrived_us"], r["ride_rows"], r["settled"]) for r in rentals.episodes(frame).orderBy("episode").collect()]
    assert got == [(1, 900, 690, 1_000_000, 3_000_000, 2, 3), (2, 690, 650, 6_000_000, 7_000_000, 1, 1)]


def test_stops_and_vehicle_states_of_a_long_history(spark, sf_dir):
    states = rides.vehicle_states(fx.moving(spark, sf_dir))
    assert states.count() == fx.moving(spark, sf_dir).count() and states.where("stop_lat IS NULL").isEmpty()


def _standing(spark, hours_us):
    """Samples of vehicles that stand since so many microseconds before the last sample of all, each far from the others."""
    now = 1_700_000_000_000_000
    rows = []
    for k, us in enumerate(hours_us):
        for j, t in enumerate((now - us, now)):
            rows.append((f"v{k}", t, 2 * k + j, 39.6 + 0.05 * k, -105.0, "P", False, False, 32_473, 0.0))
    return spark.createDataFrame(rows, "vehicle string, us long, event_id long, lat double, lon double, plate string, is_reserved boolean, is_disabled boolean, range_m int, value double")


def test_bounds_hold_for_hours_as_measured(spark):
    hour = 3_600_000_000
    samples = _standing(spark, [24 * hour, 24 * hour - 1000, 72 * hour, 72 * hour - 1000])  # a millisecond rounds away at three decimals
    none = spark.createDataFrame([], "vehicle string, us long, cell string, report_type string")
    with io.scope(spark):
        got = {r["vehicle"]: (r["designation"], r["tier"]) for r in cards.cards(cards.stage(samples), none, fleet.soc_lut(spark)).collect()}
    assert got == {"v0": ("acceptable", "ok"), "v1": ("good", "ok"), "v2": ("acceptable", "high_risk"), "v3": ("acceptable", "ok")}


def test_outliers_hold_for_medians_as_measured(spark):
    # Ten vehicles of one cell: nine stay 8 hours, one 24 hours, or a millisecond less than thrice the median.
    hour = 3_600_000_000
    for most, outlier in ((24 * hour, True), (24 * hour - 1000, False)):
        rows = [(f"v{k}", 0, 0, 8.0) for k in range(9)] + [("long", 0, 0, most / 3.6e9)]
        got = {r["vehicle"]: r["outlier"] for r in fleet.dwell_peers(spark.createDataFrame(rows, "vehicle string, q long, r long, hours double")).collect()}
        assert got["long"] is outlier and not any(got[f"v{k}"] for k in range(9))


def test_cards_fold_once_and_scan_thrice(spark, sf_dir):
    tracked = spark.read.parquet(f"{sf_dir}/events.parquet")  # stands for the samples: what matters is how often it is read
    x = tracked.select(F.concat(F.lit("v"), "user_id").alias("vehicle"), fx.micros("ts").alias("us"), "event_id", (39.6 + F.col("user_id") % 7 * 0.01).alias("lat"), F.lit(-105.0).alias("lon"), F.lit("P").alias("plate"), (F.col("event_id") % 3 == 0).alias("is_reserved"), F.lit(False).alias("is_disabled"), F.lit(5000).alias("range_m"), "value")
    with io.scope(spark):
        made = cards.stage(x)
        plan = cards.cards(made, cards.reports(x), fleet.soc_lut(spark))._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan  # the fold is stored
        assert plan.count("Relation [event_id") == 1  # only the reports read the events again
    assert made.devices.columns[-3:] == ["first_us", "failed", "hours"]


def test_climbs_follow_the_track(spark):
    rows = spark.createDataFrame([("v", 1, 20, 7, 0.0, 1.0, True), ("v", 1, 30, 8, 0.0, 2.0, True), ("v", 1, 5, 1, 0.0, 9.0, False), ("v", 2, 50, 9, 0.0, 3.0, True), ("w", 1, 20, 4, 0.0, 4.0, True)], "vehicle string, episode long, us long, event_id long, lat double, lon double, reserved boolean")
    e = spark.createDataFrame([("v", 1, 10, 0.0, 0.0, 40, 0.0, 3.0), ("v", 2, 45, 0.0, 0.0, 60, 0.0, 0.0), ("w", 1, 10, 0.0, 0.0, 40, 0.0, 1.0)], "vehicle string, episode long, pre_us long, pre_lat double, pre_lon double, arrived_us long, post_lat double, post_lon double")
    heights = spark.createDataFrame([(0, 100), (1, 130), (2, 90), (3, 95)], "cell long, height long")
    got = {(r["vehicle"], r["episode"]): r["climb"] for r in rentals.climbs(rows, e, heights, lambda lat, lon: lon.cast("long")).collect()}
    assert got == {("v", 1): 35, ("v", 2): 5, ("w", 1): None}  # up 30, down 40, up 5; down 5, up 5; cell 4 has no height
