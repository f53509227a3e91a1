"""Queries against their SQL where rounding, constant columns or equal rows decide."""

import os

import duckdb
from pyspark.sql import functions as F

from fleetlake.operators import rentals
from fleetlake.plans import catalog


def by_sql(text, sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}{'/*.parquet' if os.path.isdir(f'{sf_dir}/{f}') else ''}')")
    return con.execute(text).fetchall()


def changed(tmp_path, sf_dir, **tables):
    """A folder with the tables of ``sf_dir``, some of them replaced."""
    for f in os.listdir(sf_dir):
        name = f.removesuffix(".parquet")
        if name in tables:
            tables[name].write.parquet(str(tmp_path / f))
        else:
            os.symlink(f"{sf_dir}/{f}", tmp_path / f)
    return str(tmp_path)


def test_cells_round_half_to_even_as_decimals(spark):
    at = [k / 1000 for k in range(-105_300, -104_500, 5)] + [39.58 + k / 10_000 for k in range(0, 3_400, 50)] + [0.005, 0.015, 39.58500000000001, 39.584999999999994]
    frame = spark.createDataFrame([(v,) for v in at], "v double").select("v", F.bround("v", 2).alias("cell"))
    con = duckdb.connect()
    for v, cell in map(tuple, frame.collect()):
        assert round(cell * 100) == int(con.execute(f"SELECT {rentals._cell('v')} FROM (SELECT {v!r}::DOUBLE AS v)").fetchall()[0][0]), v


def test_a_feature_that_does_not_vary_has_the_slope_0(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    flat = changed(tmp_path, sf_dir, part=spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("p_size", F.lit(50)))  # one height everywhere
    for name in ("fit_burn_model", "burn_estimate"):
        frame = catalog.QUERIES[name](spark, flat)
        got, want = sorted(map(tuple, frame.collect())), sorted(by_sql(f"SELECT {', '.join(frame.columns)} FROM ({catalog.SQL[name]})", flat))
        assert got == want and got
    assert dict(map(tuple, catalog.QUERIES["fit_burn_model"](spark, flat).collect()))["climb"] == 0


def test_burn_fit_keeps_digits_far_from_zero(spark):
    rows = [(str(k % 2), 1e7 + k % 7, 3.0, float(k % 5), 1e6 + k * 0.001, 2.0 * (k % 7) + k % 5 + k % 2) for k in range(200)]
    model = rentals.fit_burn(spark.createDataFrame(rows, "type_id string, km double, climb double, temp double, stale double, burn double"))
    assert model["slopes"]["climb"] == 0 and abs(model["slopes"]["km"] - 2) < 1e-9 and abs(model["slopes"]["temp"] - 1) < 1e-9


def test_equal_zones_and_places_meet_once(spark, monkeypatch):
    from fleetlake.operators import spatial

    square = lambda x, y: [dict(zip(("x1", "y1", "x2", "y2"), e)) for e in ((x, y, x + 1, y), (x + 1, y, x + 1, y + 1), (x + 1, y + 1, x, y + 1), (x, y + 1, x, y))]
    scaled = lambda edges: [{k: v * 0.01 + (39.7 if k[0] == "y" else -105.0) for k, v in e.items()} for e in edges]
    zones = spark.createDataFrame([(100 + k, scaled(square(0, 0))) for k in range(40)] + [(7, scaled(square(0.5, 0.5))), (8, scaled(square(3, 3)))], "zone_id long, edges array<struct<x1: double, y1: double, x2: double, y2: double>>")
    points = spark.createDataFrame([(k, 39.70251, -104.99751) for k in range(30)] + [(50, 39.70751, -104.99249), (51, 39.0, -105.0), (52, None, None)], "event_id long, lat double, lon double")
    met = []
    plain = spatial.with_regions
    monkeypatch.setattr(spatial, "with_regions", lambda p, z: met.append((p.count(), z.count())) or plain(p, z))
    got = sorted(map(tuple, spatial.zones_around(points, zones).collect()))
    assert got == [*((k, 40, 100) for k in range(30)), (50, 41, 7)]
    assert met == [(4, 3)]


def test_window_totals_stand_beside_those_of_all_time(spark):
    from fleetlake.operators import community

    ledger = spark.createDataFrame([(1, 5, "2024-01-01"), (1, 2, "2022-12-31"), (2, 4, "2022-12-31"), (3, 1, "2023-06-01")], "cell long, points long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    cells = spark.createDataFrame([(1,), (2,), (9,)], "cell long")
    assert sorted(map(tuple, community.cell_totals(cells, ledger).collect())) == [(1, 5, 7), (2, 0, 4), (3, 1, 1), (9, 0, 0)]


def test_a_cycle_takes_a_day(spark, sf_dir, monkeypatch):
    from fleetlake.plans import stored
    from fleetlake.sources import fixtures as fx

    feeds = []

    class Done:
        def awaitTermination(self):  # noqa: N802
            pass

    monkeypatch.setattr(stored.streams, "cycle_stream", lambda s, feed, *a, **k: feeds.append(feed) or Done())
    stored._cycles(spark, sf_dir)
    times = {r[0] for r in spark.read.json(feeds[0]).select("last_updated").distinct().collect()}
    days = fx.points(spark, sf_dir).select(F.unix_timestamp(F.col("day").cast("timestamp"))).distinct().collect()
    assert times == {r[0] for r in days} and len(times) > 5
    assert {r[0] for r in by_sql(catalog.SQL["cycle_stream"], sf_dir)} == times


def plan_of(name, spark, sf_dir):
    return catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_long_properties_are_made_after_the_cut(spark, sf_dir):
    plan = plan_of("telemetry_clean", spark, sf_dir).split("\n")
    window = next(k for k, line in enumerate(plan) if "Window [" in line)
    assert any("repeat(" in line for line in plan[:window]) and not any("repeat(" in line for line in plan[window:])


def test_settlement_reads_tracks_once(spark, sf_dir):
    assert plan_of("finalize_validation", spark, sf_dir).count("Relation [l_orderkey") == 2  # the waypoints, and the ends of donations


def test_classes_of_addresses_hold_every_pair(spark):
    from fleetlake.operators import people

    queries = spark.createDataFrame([(k, q, k % 2, d, None) for k, (q, d) in enumerate([("maine", "N"), ("main", None), ("main", None), ("oak", "S"), (None, None)] * 4)], "query_id long, q string, number long, direction string, kind string")
    words = spark.createDataFrame([("main", 1), ("oak", 2), ("mains", 3)], "word string, word_id long")
    addresses = spark.createDataFrame([(1 + k % 3, k % 2, [None, "N", "S"][k % 3], "st" if k % 4 else None, 100 + k) for k in range(48)], "word_id long, number long, direction string, kind string, address_id long")
    rows = people.address_classes(queries, words, addresses).collect()
    of = lambda kind: {r["id"]: r["class_id"] for r in rows if r["kind"] == kind}
    asked, known, met = of("query"), of("address"), [(r["class_id"], r["id"], r["tier"], r["edits"]) for r in rows if r["kind"] == "match"]
    got = sorted((q, a, tier, edits) for cq, ca, tier, edits in met for q in asked if asked[q] == cq for a in known if known[a] == ca)
    assert got == sorted(map(tuple, people.address_match(queries, words, addresses).collect())) and len(met) < len(got) / 4
    assert set(asked) == set(range(20)) and set(known) == set(range(100, 148))


def test_every_question_gets_every_address(spark):
    sf_dir = "/root/testdata/sf0.01"
    frame = catalog.QUERIES["address_match"](spark, sf_dir)
    assert frame.columns == ["query_id", "address_id", "tier", "edits"]  # no classes in their place
    got = sorted(map(tuple, frame.collect()))
    assert got == sorted(by_sql(catalog.SQL["address_match"], sf_dir)) and len(got) == len(set(got)) > 3 * len({r[0] for r in got})


def test_pairs_of_addresses_in_packs_equal_brute_force(spark, monkeypatch):
    from fleetlake.operators import people

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    monkeypatch.setattr(people, "PACK", 3)
    asked = [(k, q, k % 2, d, t) for k, (q, d, t) in enumerate([("maine", "N", "st"), ("main", None, None), ("oka", "S", None), ("elm", "N", "ave"), ("zzzzzz", None, None), (None, None, None)] * 12)]
    words = [("main", 1), ("oak", 2), ("mains", 3), ("elmwood", 4)]
    known = [(1 + k % 4, k // 4 % 2, [None, "N", "S"][k // 8 % 3], ["st", None][k // 24 % 2], 100 + k) for k in range(192)]
    want = []
    for key, q, number, direction, kind in asked:
        near = {w: (0, 0) if q == word else (1, 0) if len(q) >= 3 and word.startswith(q) else (2, edits(q, word)) for word, w in words if q}
        near = {w: at for w, at in near.items() if at[1] <= 2}
        near = {w: at for w, at in near.items() if at == min(near.values())}
        there = [a for a in known if a[0] in near and a[1] == number]
        there = [a for a in there if a[2] == direction and direction] or there
        there = [a for a in there if a[3] == kind and kind] or there
        want += [(key, a[4], *near[a[0]]) for a in there]
    frame = people.address_pairs(spark.createDataFrame(asked, "query_id long, q string, number long, direction string, kind string"), spark.createDataFrame(words, "word string, word_id long"), spark.createDataFrame(known, "word_id long, number long, direction string, kind string, address_id long"))
    assert sorted(map(tuple, frame.collect())) == sorted(want) and len({r[0] for r in want}) == 48
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(address_ids") < plan.index("Coalesce") < plan.index("explode(query_ids")  # the rows of two packs are never held


def test_repeated_parts_ask_as_often_as_they_are_there(spark, tmp_path):
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    twice = changed(tmp_path, "/root/testdata/sf0.001", part=parts.unionByName(parts.where("p_partkey % 10 = 3")))
    assert sorted(map(tuple, catalog.QUERIES["address_match"](spark, twice).collect())) == sorted(by_sql(catalog.SQL["address_match"], twice))
