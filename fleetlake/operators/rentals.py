"""Rental episodes, mining filters, pair analysis and the burn model.

All window steps of an episode, its one grouped pass and the look back to the episode before
share one partitioning by vehicle, so they share a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources import fixtures as fx
from ..sources import io

SWAP_STEP = 3_000
FAST, SLOW = 240, 3_600


def marked(moving: DataFrame) -> DataFrame:
    """Points with ``starts`` (a reserved row after a free one) and ``episode``, the running count of starts."""
    w = Window.partitionBy("vehicle").orderBy("us", "event_id")
    reserved = F.coalesce("is_reserved", F.lit(False))
    x = moving.withColumn("reserved", reserved).withColumn("before", F.lag("reserved", 1, False).over(w))
    x = x.withColumn("starts", (F.col("reserved") & ~F.col("before")).cast("int"))
    return x.withColumn("episode", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def positioned(x: DataFrame) -> DataFrame:
    """Place and number of rows in each run of (vehicle, episode, reserved)."""
    part = Window.partitionBy("vehicle", "episode", "reserved")
    return x.withColumns({"place": F.row_number().over(part.orderBy("us", "event_id")), "n": F.count("*").over(part)})


def swap_flag(x: DataFrame) -> DataFrame:
    """``swapped``: once the range has jumped up by more than a swap's step within the free run."""
    w = Window.partitionBy("vehicle", "episode", "reserved").orderBy("us", "event_id")
    x = x.withColumn("step", F.col("range_m") - F.lag("range_m").over(w))
    return x.withColumn("swapped", F.coalesce(F.max((F.col("step") > SWAP_STEP).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))


def episodes(moving: DataFrame) -> DataFrame:
    """One row per rental: last free reading before, settled reading after, ride time and places.

    One grouped pass per (vehicle, episode) gives the ride, the stay after it and the stay's
    last row, which the next episode takes as what was before it. The reading after is the
    latest of the first five free rows that is not null and not swapped.
    """
    p = swap_flag(positioned(marked(moving)))
    free, at = ~F.col("reserved"), F.struct("us", "event_id")
    good = free & (F.col("place") <= 5) & F.col("range_m").isNotNull() & (F.col("swapped") == 0)
    first = lambda c: F.min_by(c, F.when(free, at))
    g = p.groupBy("vehicle", "episode").agg(
        F.min(F.when(F.col("reserved"), F.col("us"))).alias("departed_us"), F.count_if("reserved").alias("ride_rows"), F.max("type_id").alias("type_id"),
        F.max_by("range_m", F.when(good, at)).alias("post_range"), F.min(F.when(free, F.col("us"))).alias("arrived_us"), first("lat").alias("post_lat"), first("lon").alias("post_lon"), F.count_if(free).alias("settled"),
        F.max_by(F.struct("us", "range_m", "lat", "lon"), F.when(free, at)).alias("left"),
    )
    g = g.withColumn("pre", F.lag("left").over(Window.partitionBy("vehicle").orderBy("episode")))
    return g.where("ride_rows > 0 AND settled > 0 AND pre IS NOT NULL").select(
        "vehicle", "episode", "type_id", "departed_us", "ride_rows", F.col("pre.us").alias("pre_us"), F.col("pre.range_m").alias("pre_range"), F.col("pre.lat").alias("pre_lat"), F.col("pre.lon").alias("pre_lon"),
        "post_range", "arrived_us", "post_lat", "post_lon", "settled",
    )


def judged(e: DataFrame) -> DataFrame:
    """Episodes with duration, distance and the reason for leaving them out (or "ok")."""
    secs = F.floor((F.col("arrived_us") - F.col("departed_us")) / 1_000_000)
    x = e.withColumns({"secs": secs, "metres": F.round(geo.metres(F.col("pre_lat"), F.col("pre_lon"), F.col("post_lat"), F.col("post_lon")), 6), "burn": (F.col("pre_range") - F.col("post_range")) / 364.0})
    reason = F.when(F.col("pre_range").isNull() | F.col("post_range").isNull(), "no_reading").when((F.col("secs") < FAST) | (F.col("secs") > SLOW), "duration").when(F.col("burn") <= -20, "swap").when((F.col("burn") < 0) | (F.col("burn") > 60), "burn").otherwise("ok")
    return x.withColumn("reason", reason)


def rebalance_groups(e: DataFrame, least: int = 3) -> DataFrame:
    """Groups of vehicles that went from one cell to another in the same 20 minutes: moved by a van."""
    key = [F.bround(F.col("pre_lat"), 2).alias("a"), F.bround(F.col("pre_lon"), 2).alias("b"), F.bround(F.col("post_lat"), 2).alias("c"), F.bround(F.col("post_lon"), 2).alias("d"), F.expr("departed_us div 1200000000").alias("t")]
    return e.groupBy(*key).agg(F.count_distinct("vehicle").alias("vehicles")).where(F.col("vehicles") >= least)


def pair_deltas(moving: DataFrame) -> DataFrame:
    """Consecutive points 5 to 20 minutes apart with their distance and range difference."""
    w = Window.partitionBy("vehicle").orderBy("us", "event_id")
    x = moving.where("range_m IS NOT NULL")
    x = x.withColumns({f"_{c}": F.lag(c).over(w) for c in ("us", "lat", "lon", "range_m")})
    x = x.where((F.col("us") - F.col("_us")).between(300_000_000, 1_200_000_000))
    m = geo.metres_at_current(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
    return x.select("event_id", "vehicle", "type_id", "us", F.round(m, 6).alias("metres"), (F.col("_range_m") - F.col("range_m")).alias("used"))


def nearest_temperature(e: DataFrame, temps: DataFrame, us: str) -> DataFrame:
    """The temperature of the hour nearest to a time, within two hours: an equi-join on hour buckets, then the least gap."""
    hour = F.expr(f"{us} div 3600000000")
    wide = e.withColumn("_h", F.explode(F.array(*[hour + k for k in (-2, -1, 0, 1, 2)])))
    gap = F.abs(F.col("hour") * F.lit(3_600_000_000) - F.col(us))
    hit = wide.join(temps, wide["_h"] == temps["hour"]).where(gap <= 7_200_000_000)
    return hit.groupBy("vehicle", "episode").agg(F.min_by("temp", F.struct(gap, "hour")).alias("temp"))


def stops(moving: DataFrame) -> DataFrame:
    """Intervals at one position: a new one begins where the position differs from the row before."""
    w = Window.partitionBy("vehicle").orderBy("us", "event_id")
    x = moving.withColumn("new", F.coalesce((F.col("lat") != F.lag("lat").over(w)) | (F.col("lon") != F.lag("lon").over(w)), F.lit(True)).cast("int"))
    x = x.withColumn("stop", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = x.groupBy("vehicle", "stop").agg(F.min("us").alias("arrive"))
    return g.withColumn("depart", F.lead("arrive").over(Window.partitionBy("vehicle").orderBy("stop")))


def fit_line(x: DataFrame, y_col: str, x_col: str) -> DataFrame:
    """Slope, intercept, fit and residual spread of one straight line: grouped sums alone."""
    return x.agg(F.count("*").alias("n"), F.round(F.regr_slope(y_col, x_col), 6).alias("slope"), F.round(F.regr_intercept(y_col, x_col), 4).alias("intercept"), F.round(F.regr_r2(y_col, x_col), 6).alias("r2"))


def train_burn_model(obs: DataFrame, features: list[str], label: str = "burn", category: str = "type_id"):  # noqa: ANN201
    """A fitted pipeline: linear regression with one dummy per model but the most common; refuses fewer than 100 rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    if obs.count() < 100:
        raise ValueError("fewer than 100 observations")
    top = StringIndexer(inputCol=category, outputCol="_i", stringOrderType="frequencyAsc")
    hot = OneHotEncoder(inputCols=["_i"], outputCols=["_d"], dropLast=True)  # the last index is the most common model
    vector = VectorAssembler(inputCols=[*features, "_d"], outputCol="_x")
    return Pipeline(stages=[top, hot, vector, LinearRegression(featuresCol="_x", labelCol=label, solver="normal")]).fit(obs)


FEATURES = ("km", "climb", "temp", "stale")


def climbs(rows: DataFrame, e: DataFrame, heights: DataFrame, cell: Callable[[Column, Column], Column]) -> DataFrame:
    """``(vehicle, episode, climb)``: metres gained along each rental's track, null if the height of a place on it is unknown.

    The track is where the vehicle stood, the ``rows`` of the ride and where it came to stand;
    its places meet ``heights(cell, height)`` by an equi-join, and the gains of its pieces add up.
    """
    ends = F.array(F.struct(F.col("pre_us").alias("us"), F.lit(0).alias("k"), F.col("pre_lat").alias("lat"), F.col("pre_lon").alias("lon")), F.struct(F.col("arrived_us").alias("us"), F.lit(2).alias("k"), F.col("post_lat").alias("lat"), F.col("post_lon").alias("lon")))
    stands = e.select("vehicle", "episode", F.explode(ends).alias("p")).select("vehicle", "episode", "p.us", "p.k", F.lit(0).cast("long").alias("event_id"), "p.lat", "p.lon")
    ride = rows.where("reserved").join(e.select("vehicle", "episode"), ["vehicle", "episode"], "left_semi").select("vehicle", "episode", "us", F.lit(1).alias("k"), "event_id", "lat", "lon")
    x = stands.unionByName(ride).withColumn("cell", cell(F.col("lat"), F.col("lon"))).join(heights, "cell", "left")
    w = Window.partitionBy("vehicle", "episode").orderBy("us", "k", "event_id")
    x = x.withColumn("up", F.greatest(F.lit(0), F.col("height") - F.lag("height").over(w)))
    return x.groupBy("vehicle", "episode").agg(F.when(F.count("height") == F.count("*"), F.coalesce(F.sum("up"), F.lit(0))).alias("climb"))


def observations(s, d) -> DataFrame:  # noqa: ANN001
    """Usable rentals with what the burn model sees, stored: kilometres, metres climbed (0 if unknown), temperature of the hour (12.5 if none is near) and minutes since the reading before."""
    x = io.stored(_judged(s, d).where("reason = 'ok'"))
    up = climbs(marked(M(s, d)), x, fx.terrain(s, d), fx.terrain_cell)
    t = nearest_temperature(x.select("vehicle", "episode", "departed_us"), fx.hourly_temperature(s, d), "departed_us")
    x = x.join(t, ["vehicle", "episode"], "left").join(up, ["vehicle", "episode"], "left").select(
        "vehicle", "episode", "type_id", "departed_us", "burn", (F.col("metres") / 1000).alias("km"), F.coalesce("climb", F.lit(0)).cast("double").alias("climb"),
        F.coalesce("temp", F.lit(12.5)).alias("temp"), ((F.col("departed_us") - F.col("pre_us")) / 6e7).alias("stale"),
    )
    return io.stored(x)


def fit_burn(obs: DataFrame, features: tuple[str, ...] = FEATURES, label: str = "burn", by: str = "type_id") -> dict | None:
    """Least squares on the features with one offset per vehicle model; None for fewer than 100 rows.

    Means per model come from one grouped aggregate and products of what differs from them from
    another (a row per model reaches the driver); what is left is a system of as many equations
    as there are features. The default offset is the models' mean, weighted by their rows. A
    feature that is the same in all rows of each model has the slope 0.
    """
    import numpy as np

    n = len(features)
    cols = [*features, label]
    means = obs.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[(F.min(c) == F.max(c)).alias(f"e{i}") for i, c in enumerate(cols)])
    rows = means.orderBy(by).collect()
    total = sum(r["n"] for r in rows)
    if total < 100:
        return None
    m = {r[by]: np.array([r[f"m{i}"] for i in range(n + 1)]) for r in rows}
    own = F.broadcast(obs.sparkSession.createDataFrame([(r[by], *[float(v) for v in m[r[by]]], *[bool(r[f"e{i}"]) for i in range(n + 1)]) for r in rows], f"_by {obs.schema[by].dataType.simpleString()}, " + ", ".join([f"_m{i} double" for i in range(n + 1)] + [f"_e{i} boolean" for i in range(n + 1)])))  # a row per model
    x = obs.join(own, F.col(by).eqNullSafe(F.col("_by"))).select(*[F.when(~F.col(f"_e{i}"), F.col(c) - F.col(f"_m{i}")).otherwise(0.0).alias(f"x{i}") for i, c in enumerate(cols)])
    products = x.agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in range(n + 1) for j in range(i, n + 1)]).first()
    within = np.array([[products[f"p{min(i, j)}_{max(i, j)}"] for j in range(n + 1)] for i in range(n + 1)])
    varies = [i for i in range(n) if within[i, i] > 0]
    size = np.sqrt(within.diagonal()[varies])  # features of one scale
    slope = np.zeros(n)
    slope[varies] = np.linalg.lstsq(within[np.ix_(varies, varies)] / np.outer(size, size), within[varies, n] / size, rcond=None)[0] / size
    offsets = {r[by]: float(m[r[by]][n] - slope @ m[r[by]][:n]) for r in rows}
    residual = float(within[n, n] - slope @ within[:n, n])
    mean = sum(m[r[by]][n] * r["n"] for r in rows) / total
    whole = float(within[n, n] + sum(r["n"] * (m[r[by]][n] - mean) ** 2 for r in rows))
    return {
        "slopes": dict(zip(features, map(float, slope))), "offsets": offsets, "default": sum(offsets[r[by]] * r["n"] for r in rows) / total,
        "r2": 1 - residual / whole, "sigma": (residual / (total - n - len(rows))) ** 0.5, "n": total,
    }


def predicted(model: dict, at: dict[str, Column], by: Column) -> Column:
    """Burn by the model: its slopes at the given features (those left out count 0) and the model's offset, or the default one."""
    known = F.create_map(*[x for k, v in model["offsets"].items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(known[by], F.lit(model["default"])) + sum((F.lit(model["slopes"][f]) * c for f, c in at.items()), F.lit(0.0))


def burn_model(s, d, hours: int = 1) -> DataFrame:  # noqa: ANN001
    """Terms of the burn model fitted on all rentals but those of the last hours, and its mean error on these; no rows if it refuses."""
    obs = observations(s, d)
    last = F.broadcast(obs.agg((F.max("departed_us") - hours * 3_600_000_000).alias("_start")))  # one row
    x = obs.crossJoin(last)
    model = fit_burn(x.where("departed_us < _start"))
    if model is None:
        return s.createDataFrame([], "term string, value double")
    error = F.abs(F.col("burn") - predicted(model, {f: F.col(f) for f in FEATURES}, F.col("type_id")))
    held = x.where("departed_us >= _start").agg(F.avg(error)).first()[0]
    rows = [*model["slopes"].items(), *((f"offset_{k}", v) for k, v in model["offsets"].items()), ("offset_default", model["default"]), ("r2", model["r2"]), ("sigma", model["sigma"]), ("n", float(model["n"])), ("held_out_error", held)]
    return s.createDataFrame(rows, "term string, value double").select("term", F.round("value", 5).alias("value"))


def burn_estimates(s, d) -> DataFrame:  # noqa: ANN001
    """Predicted burn of each usable rental with a fresh reading: the model's offset, a band of one residual spread, all within 0 to 100, and the share that climbing takes."""
    obs = observations(s, d)
    model = fit_burn(obs)
    if model is None:
        return obs.where("false").select("vehicle", "episode", F.col("burn"), F.col("burn").alias("low"), F.col("burn").alias("high"), F.col("burn").alias("climb_share"))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    p = predicted(model, {f: F.col(f) for f in FEATURES if f != "stale"}, F.col("type_id"))
    band = F.lit(model["sigma"])
    share = F.when(p > 0, clamp(F.lit(model["slopes"]["climb"]) * F.col("climb") / p * 100))
    return obs.select("vehicle", "episode", *[F.round(clamp(c), 4).alias(n) for c, n in ((p, "burn"), (p - band, "low"), (p + band, "high"))], F.round(share, 3).alias("climb_share"))


def burn_offsets(s, d) -> DataFrame:  # noqa: ANN001
    """Slope and each model's offset of the used range over all pairs of readings: distance and dummies alone."""
    fitted = train_burn_model(pair_deltas(M(s, d)).select("type_id", F.col("metres").cast("double"), F.col("used").cast("double")).dropna(), ["metres"], "used")
    line, names = fitted.stages[-1], fitted.stages[0].labels  # as many as there are vehicle models
    rows = [(n, float(line.intercept + (line.coefficients[1 + k] if k + 1 < len(names) else 0.0)), float(line.coefficients[0])) for k, n in enumerate(names)]
    return s.createDataFrame(rows, "type_id string, offset double, slope double").select("type_id", F.round("offset", 3).alias("offset"), F.round("slope", 6).alias("slope"))


def idle_noise(s, d) -> DataFrame:  # noqa: ANN001
    """Per type: range change of idle pairs with its spread and share of zeros, swaps per day, and how often the range rises after a move."""
    x = pair_deltas(M(s, d))
    idle, moved = F.col("metres") < 16, F.col("metres") >= 16
    span = F.broadcast(M(s, d).agg(((F.max("us") - F.min("us")) / 86_400_000_000).alias("days")))  # one row
    g = x.groupBy("type_id").agg(
        F.count_if(idle).alias("n"), F.round(F.avg(F.when(idle, F.col("used"))), 4).alias("mean"), F.round(F.stddev_samp(F.when(idle, F.col("used"))), 4).alias("sigma"), F.round(F.count_if(idle & (F.col("used") == 0)) / F.nullif(F.count_if(idle), F.lit(0)), 6).alias("zero_share"),
        F.count_if(F.col("used") < -SWAP_STEP).alias("_swaps"), F.round(F.count_if(moved & (F.col("used") < 0)) / F.nullif(F.count_if(moved), F.lit(0)), 6).alias("rebound_share"),
    )
    return g.crossJoin(span).select("type_id", "n", "mean", "sigma", "zero_share", F.round(F.col("_swaps") / F.col("days"), 4).alias("swaps_per_day"), "rebound_share")


def burn_holdout(rides: DataFrame, hours: int = 72, least: int = 100) -> DataFrame:
    """Residual spread of the burn line on earlier rides and its mean error on those of the last ``hours``; one row.

    With fewer than ``least`` rides to fit on, both are null.
    """
    start = rides.agg((F.max("departed_us") - hours * 3_600_000_000).alias("start"))  # one row
    x = rides.crossJoin(F.broadcast(start)).withColumn("train", F.col("departed_us") < F.col("start"))
    line = fit_line(x.where("train"), "burn", "metres")
    enough = [F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("slope", "intercept")]
    x = x.crossJoin(F.broadcast(line.select(*enough)))
    off = F.col("burn") - (F.col("intercept") + F.col("slope") * F.col("metres"))
    n = F.count_if("train")
    sigma = F.sqrt(F.sum(F.when(F.col("train"), off * off)) / (n - 2))
    return x.agg(n.alias("fitted"), F.count_if(~F.col("train")).alias("held_out"), F.round(sigma, 4).alias("sigma"), F.round(F.avg(F.when(~F.col("train"), F.abs(off))), 4).alias("held_out_error"))


def burn_estimate(rides: DataFrame, model: DataFrame, band: Column) -> DataFrame:
    """Predicted burn with a band, clamped to 0..100; the model is one row of coefficients."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    x = rides.crossJoin(F.broadcast(model))
    p = F.col("intercept") + F.col("slope") * F.col("metres")
    return x.withColumns({"burn": F.round(clamp(p), 4), "low": F.round(clamp(p - band), 4), "high": F.round(clamp(p + band), 4)})


M = fx.moving


def _judged(s, d):  # noqa: ANN001, ANN202
    return judged(episodes(M(s, d)))


def mine_rentals(s, d) -> DataFrame:  # noqa: ANN001
    """The whole extraction: episodes, rebalancing left out, reasons, temperature, speed limit."""
    x = io.stored(_judged(s, d))  # read for the groups, for the rentals and for their temperatures
    out = rebalance_groups(x)
    keyed = x.withColumns({"a": F.bround("pre_lat", 2), "b": F.bround("pre_lon", 2), "c": F.bround("post_lat", 2), "d": F.bround("post_lon", 2), "t": F.expr("departed_us div 1200000000")})
    x = keyed.join(out, ["a", "b", "c", "d", "t"], "left_anti").where("reason = 'ok' AND metres <= secs * 20")
    t = nearest_temperature(x.select("vehicle", "episode", "departed_us"), fx.hourly_temperature(s, d), "departed_us")
    return x.join(t, ["vehicle", "episode"], "left").select("vehicle", "episode", "secs", "metres", F.round("burn", 6).alias("burn"), "temp")


QUERIES = {
    "episode_label": lambda s, d: marked(M(s, d)).select("event_id", "episode"),
    "run_position": lambda s, d: positioned(marked(M(s, d))).select("event_id", F.col("place").cast("long").alias("place"), "n"),
    "swap_sticky": lambda s, d: swap_flag(positioned(marked(M(s, d)))).where("NOT reserved").select("event_id", "swapped"),
    "settled_reading": lambda s, d: episodes(M(s, d)).select("vehicle", "episode", "post_range", "settled"),
    "episode_assemble": lambda s, d: episodes(M(s, d)).select("vehicle", "episode", "pre_range", "post_range", "departed_us", "arrived_us", "ride_rows"),
    "accept_filters": lambda s, d: _judged(s, d).groupBy("reason").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("burn") == 0) / F.count("*"), 6).alias("zero_share")),
    "rebalance_groups": lambda s, d: rebalance_groups(_judged(s, d), 1).groupBy("vehicles").agg(F.count("*").alias("groups")),
    "pair_deltas": lambda s, d: pair_deltas(M(s, d)).select("event_id", "metres", "used"),
    "burn_by_model": lambda s, d: pair_deltas(M(s, d)).groupBy("type_id").agg(F.count("*").alias("n"), F.round(F.avg("used"), 6).alias("mean_used"), F.round(F.avg("metres"), 4).alias("mean_m"), F.count_if(F.col("used") == 0).alias("zeros"), F.round(F.regr_slope("used", "metres"), 6).alias("slope"), F.round(F.regr_r2("used", "metres"), 6).alias("r2")),
    "idle_noise": idle_noise,
    "lut_double_join": lambda s, d: lut_double_join(s, d),
    "nearest_temperature": lambda s, d: nearest_temperature(episodes(M(s, d)), fx.hourly_temperature(s, d), "departed_us"),
    "temperature_fallback": lambda s, d: episodes(M(s, d)).select("vehicle", "episode").join(nearest_temperature(episodes(M(s, d)), fx.hourly_temperature(s, d), "departed_us"), ["vehicle", "episode"], "left").select("vehicle", "episode", F.coalesce("temp", F.lit(12.5)).alias("temp")),
    "anti_already_mined": lambda s, d: episodes(M(s, d)).join(episodes(M(s, d)).where("episode % 2 = 0").select("vehicle", "departed_us"), ["vehicle", "departed_us"], "left_anti").select("vehicle", "episode"),
    "anti_overlapping_donation": lambda s, d: anti_overlap(episodes(M(s, d)), M(s, d).where("event_id % 37 = 0").select(F.col("vehicle").alias("_v"), F.col("us").alias("lo"), (F.col("us") + 600_000_000).alias("hi"))).select("vehicle", "episode"),
    "stops_overlapping": lambda s, d: stops(M(s, d)).where("arrive <= 1704067200000000 + 7200000000 AND (depart IS NULL OR depart >= 1704067200000000 + 3600000000)").select("vehicle", "stop", "arrive", "depart"),
    "feed_start_asof": lambda s, d: feed_start(s, d),
    "mine_rentals": mine_rentals,
    "fit_burn_model": burn_model,
    "burn_offsets": burn_offsets,
    "burn_holdout": lambda s, d: burn_holdout(_judged(s, d).where("reason = 'ok'").select("departed_us", "burn", "metres"), hours=1),  # the view's rides span six hours
    "fit_burn_line": lambda s, d: fit_line(_judged(s, d).where("reason = 'ok'"), "burn", "metres"),
    "burn_estimate": burn_estimates,
    "arrival_battery": lambda s, d: burn_estimate(_judged(s, d).where("reason = 'ok'").select("vehicle", "episode", "metres", "pre_range"), fit_line(_judged(s, d).where("reason = 'ok'"), "burn", "metres"), F.lit(6.0)).select("vehicle", "episode", F.round(F.col("pre_range") / 364.0 - F.col("high"), 4).alias("worst"), (F.col("pre_range") / 364.0 - F.col("high") >= 10).alias("enough")),
}


def lut_double_join(s, d) -> DataFrame:  # noqa: ANN001
    """Charge ranks of a point's range and of the one before."""
    from .fleet import soc_lut

    w = Window.partitionBy("vehicle").orderBy("ts", "event_id")
    x = fx.points(s, d).withColumn("prev", F.lag("range_m").over(w))
    lut = soc_lut(s)
    now, then = F.broadcast(lut.toDF("rank_now", "range_m")), F.broadcast(lut.toDF("rank_prev", "prev"))
    return x.join(now, "range_m", "left").join(then, "prev", "left").select("event_id", "rank_now", "rank_prev")


def anti_overlap(e: DataFrame, spans: DataFrame) -> DataFrame:
    """Episodes that overlap no span of the same vehicle: both go by the hours that they touch, so only near ones meet."""
    hours = lambda lo, hi: F.explode(F.sequence(F.expr(f"{lo} div 3600000000"), F.expr(f"{hi} div 3600000000")))
    wide = e.select("vehicle", "episode", "departed_us", "arrived_us", hours("departed_us", "arrived_us").alias("_h"))
    near = wide.join(spans.withColumn("_g", hours("lo", "hi")), (F.col("vehicle") == F.col("_v")) & (F.col("_h") == F.col("_g")) & (F.col("departed_us") <= F.col("hi")) & (F.col("arrived_us") >= F.col("lo")))
    return e.join(near.select("vehicle", "episode").distinct(), ["vehicle", "episode"], "left_anti")


def feed_start(s, d) -> DataFrame:  # noqa: ANN001
    """For each rental's start, the latest earlier observation at most 30 minutes old, on half-hour buckets."""
    e = episodes(M(s, d)).select("vehicle", "episode", "departed_us")
    b = 1_800_000_000
    asked = e.withColumn("b", F.explode(F.array(F.expr(f"departed_us div {b}"), F.expr(f"departed_us div {b}") - 1)))
    seen = M(s, d).select("vehicle", "us", "event_id", F.expr(f"us div {b}").alias("b"))
    hit = asked.join(seen, ["vehicle", "b"]).where((F.col("us") < F.col("departed_us")) & (F.col("us") >= F.col("departed_us") - b))
    return hit.groupBy("vehicle", "episode").agg(F.max_by("event_id", F.struct("us", "event_id")).alias("event_id"))


_MARKED = """m0 AS (SELECT *, coalesce(is_reserved, false) AS reserved FROM moving), m1 AS (SELECT *, lag(reserved, 1, false) OVER w AS before FROM m0 WINDOW w AS (PARTITION BY vehicle ORDER BY us, event_id)),
  m2 AS (SELECT *, CAST(sum(CASE WHEN reserved AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM m1),
  m3 AS (SELECT *, row_number() OVER (PARTITION BY vehicle, episode, reserved ORDER BY us, event_id) AS place, count(*) OVER (PARTITION BY vehicle, episode, reserved) AS n, range_m - lag(range_m) OVER (PARTITION BY vehicle, episode, reserved ORDER BY us, event_id) AS step FROM m2),
  m4 AS (SELECT *, coalesce(max(CASE WHEN step > 3000 THEN 1 WHEN step IS NOT NULL THEN 0 END) OVER (PARTITION BY vehicle, episode, reserved ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), 0) AS swapped FROM m3)"""
_EPI = f"""{_MARKED}, pre AS (SELECT vehicle, episode + 1 AS episode, us AS pre_us, range_m AS pre_range, lat AS pre_lat, lon AS pre_lon FROM m4 WHERE NOT reserved AND place = n),
  post AS (SELECT vehicle, episode, arg_max(range_m, {{'a': us, 'b': event_id}}) FILTER (WHERE place <= 5 AND range_m IS NOT NULL AND swapped = 0) AS post_range, min(us) AS arrived_us, arg_min(lat, {{'a': us, 'b': event_id}}) AS post_lat, arg_min(lon, {{'a': us, 'b': event_id}}) AS post_lon, count(*) AS settled FROM m4 WHERE NOT reserved GROUP BY 1, 2),
  ride AS (SELECT vehicle, episode, min(us) AS departed_us, count(*) AS ride_rows FROM m4 WHERE reserved GROUP BY 1, 2), epi AS (SELECT * FROM ride JOIN pre USING (vehicle, episode) JOIN post USING (vehicle, episode))"""
_JUDGED = f"""{_EPI}, jd0 AS (SELECT *, (arrived_us - departed_us) // 1000000 AS secs, round({fx.distance_sql('pre_lat', 'pre_lon', 'post_lat', 'post_lon')}, 6) AS metres, (pre_range - post_range) / 364.0::DOUBLE AS burn FROM epi),
  jd AS (SELECT *, CASE WHEN pre_range IS NULL OR post_range IS NULL THEN 'no_reading' WHEN secs < 240 OR secs > 3600 THEN 'duration' WHEN burn <= -20 THEN 'swap' WHEN burn < 0 OR burn > 60 THEN 'burn' ELSE 'ok' END AS reason FROM jd0)"""


def _cell(c: str) -> str:
    """Hundredths of a degree, half to even on the decimal value as ``bround`` rounds; DuckDB's ``round_even`` multiplies doubles, so it misses ties."""
    k = f"CAST(CAST({c} AS VARCHAR) AS DECIMAL(38, 20)) * 100"
    return f"CASE WHEN abs({k} - trunc({k})) = 0.5 THEN 2 * round({k} * 0.5) ELSE round({k}) END"


_RB = f"SELECT {_cell('pre_lat')} AS a, {_cell('pre_lon')} AS b, {_cell('post_lat')} AS c, {_cell('post_lon')} AS d, departed_us // 1200000000 AS t, count(DISTINCT vehicle) AS vehicles FROM jd GROUP BY ALL"
_DX = "(lon - p_lon) * 111320.0::DOUBLE * cos(radians(lat))"
_PAIRS = f"""pd0 AS (SELECT *, lag(us) OVER w AS p_us, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lag(range_m) OVER w AS p_range FROM moving WHERE range_m IS NOT NULL WINDOW w AS (PARTITION BY vehicle ORDER BY us, event_id)),
  pd AS (SELECT event_id, vehicle, type_id, us, round(sqrt({_DX} * {_DX} + ((lat - p_lat) * 111320.0::DOUBLE) * ((lat - p_lat) * 111320.0::DOUBLE)), 6) AS metres, p_range - range_m AS used FROM pd0 WHERE us - p_us BETWEEN 300000000 AND 1200000000)"""
_TEMP = """SELECT vehicle, episode, arg_min(temp, {'a': abs(hour * 3600000000 - departed_us), 'b': hour}) AS temp FROM epi JOIN hourly_temperature ON abs(hour * 3600000000 - departed_us) <= 7200000000 GROUP BY 1, 2"""
_LINE = "SELECT count(*) AS n, round(regr_slope(burn, metres), 6) AS slope, round(regr_intercept(burn, metres), 4) AS intercept, round(regr_r2(burn, metres), 6) AS r2 FROM jd WHERE reason = 'ok'"
_P = "(intercept + slope * metres{})"
_CLIMB = """tk AS (SELECT vehicle, episode, pre_us AS us, 0 AS k, 0 AS event_id, pre_lat AS lat, pre_lon AS lon FROM jd UNION ALL SELECT vehicle, episode, arrived_us, 2, 0, post_lat, post_lon FROM jd
    UNION ALL SELECT m4.vehicle, m4.episode, us, 1, event_id, lat, lon FROM m4 JOIN jd ON m4.vehicle = jd.vehicle AND m4.episode = jd.episode WHERE reserved),
  th AS (SELECT tk.*, height, height - lag(height) OVER (PARTITION BY vehicle, episode ORDER BY us, k, event_id) AS up FROM tk LEFT JOIN terrain ON cell = CAST(floor((lat - 39.58::DOUBLE) * 100) * 70 + floor((lon - -105.25::DOUBLE) * 100) AS BIGINT)),
  cl AS (SELECT vehicle, episode, CASE WHEN count(height) = count(*) THEN coalesce(sum(greatest(0, up)), 0) END AS climb FROM th GROUP BY 1, 2)"""
_OBS = f"""{_JUDGED}, tm AS ({_TEMP}), {_CLIMB}, ob AS (SELECT jd.vehicle, jd.episode, CAST(CAST(substr(jd.vehicle, 2) AS INT) % 5 + 1 AS VARCHAR) AS type_id, departed_us, burn, metres / 1000 AS km, CAST(coalesce(climb, 0) AS DOUBLE) AS climb, coalesce(temp, 12.5::DOUBLE) AS temp, (departed_us - pre_us) / 6e7 AS stale
  FROM jd LEFT JOIN tm USING (vehicle, episode) LEFT JOIN cl USING (vehicle, episode) WHERE reason = 'ok')"""


def _ols(rows: str) -> str:
    """CTEs that end in ``md`` (slopes b1 to b4, default offset, fit) and ``mo`` (offsets): features made orthogonal one after the other, then solved backwards.

    A feature that is the same in all rows of each model is 0 when centred and gets the slope 0, as in :func:`fit_burn`.
    """
    x = ("km", "climb", "temp", "stale")
    mean = ", ".join(f"CASE WHEN min({c}) OVER t = max({c}) OVER t THEN 0 ELSE {c} - avg({c}) OVER t END AS x{k + 1}" for k, c in enumerate(x))
    out = [f"o0 AS (SELECT type_id, burn - avg(burn) OVER t AS y, {mean} FROM {rows} WINDOW t AS (PARTITION BY type_id))", "o1 AS (SELECT *, x1 AS z1 FROM o0)"]
    for k in (2, 3, 4):
        over = ", ".join(f"coalesce(sum(x{k} * z{j}) OVER () / nullif(sum(z{j} * z{j}) OVER (), 0), 0) AS b{k}{j}" for j in range(1, k))
        out.append(f"o{k} AS (SELECT *, x{k} - " + " - ".join(f"b{k}{j} * z{j}" for j in range(1, k)) + f" AS z{k} FROM (SELECT *, {over} FROM o{k - 1}))")
    held = ", ".join(f"any_value(b{k}{j}) AS b{k}{j}" for k in (2, 3, 4) for j in range(1, k))
    out.append("og AS (SELECT " + ", ".join(f"coalesce(sum(y * z{k}) / nullif(sum(z{k} * z{k}), 0), 0) AS g{k}" for k in (1, 2, 3, 4)) + f", {held}, sum(y * y) AS yy, " + " + ".join(f"coalesce(sum(y * z{k}) * sum(y * z{k}) / nullif(sum(z{k} * z{k}), 0), 0)" for k in (1, 2, 3, 4)) + " AS fitted, CAST(count(*) AS DOUBLE) AS n, count(DISTINCT type_id) AS kinds FROM o4)")
    out.append("ob4 AS (SELECT *, g4 AS b4, g3 - b43 * g4 AS b3 FROM og), ob2 AS (SELECT *, g2 - b32 * b3 - b42 * b4 AS b2 FROM ob4), ob1 AS (SELECT *, g1 - b21 * b2 - b31 * b3 - b41 * b4 AS b1 FROM ob2)")
    out.append(f"mo AS (SELECT type_id, avg(burn) - any_value(b1) * avg(km) - any_value(b2) * avg(climb) - any_value(b3) * avg(temp) - any_value(b4) * avg(stale) AS offset_t, count(*) AS c FROM {rows}, ob1 GROUP BY 1)")
    out.append(f"md AS (SELECT *, (SELECT sum(offset_t * c) / sum(c) FROM mo) AS offset_d, 1 - (yy - fitted) / (SELECT sum(burn * burn) - sum(burn) * sum(burn) / count(*) FROM {rows}) AS r2, sqrt((yy - fitted) / (n - 4 - kinds)) AS sigma FROM ob1)")
    return ", ".join(out)


SQL = {
    "episode_label": fx.sql(f"WITH {_MARKED} SELECT event_id, episode FROM m2 /* FROM moving */"),
    "run_position": fx.sql(f"WITH {_MARKED} SELECT event_id, place, n FROM m3 /* FROM moving */"),
    "swap_sticky": fx.sql(f"WITH {_MARKED} SELECT event_id, swapped FROM m4 WHERE NOT reserved"),
    "settled_reading": fx.sql(f"WITH {_EPI} SELECT vehicle, episode, post_range, settled FROM epi"),
    "episode_assemble": fx.sql(f"WITH {_EPI} SELECT vehicle, episode, pre_range, post_range, departed_us, arrived_us, ride_rows FROM epi"),
    "accept_filters": fx.sql(f"WITH {_JUDGED} SELECT reason, count(*) AS n, round(count(*) FILTER (WHERE burn = 0) / count(*), 6) AS zero_share FROM jd GROUP BY 1"),
    "rebalance_groups": fx.sql(f"WITH {_JUDGED} SELECT vehicles, count(*) AS groups FROM ({_RB}) GROUP BY 1"),
    "pair_deltas": fx.sql(f"WITH {_PAIRS} SELECT event_id, metres, used FROM pd"),
    "burn_by_model": fx.sql(f"WITH {_PAIRS} SELECT type_id, count(*) AS n, round(avg(used), 6) AS mean_used, round(avg(metres), 4) AS mean_m, count(*) FILTER (WHERE used = 0) AS zeros, round(regr_slope(used, metres), 6) AS slope, round(regr_r2(used, metres), 6) AS r2 FROM pd GROUP BY 1"),
    "idle_noise": fx.sql(f"""WITH {_PAIRS} SELECT type_id, count(*) FILTER (WHERE metres < 16) AS n, round(avg(used) FILTER (WHERE metres < 16), 4) AS mean, round(stddev_samp(used) FILTER (WHERE metres < 16), 4) AS sigma, round(count(*) FILTER (WHERE metres < 16 AND used = 0) / nullif(count(*) FILTER (WHERE metres < 16), 0), 6) AS zero_share,
      round(count(*) FILTER (WHERE used < -3000) / (SELECT (max(us) - min(us)) / 86400000000.0::DOUBLE FROM moving), 4) AS swaps_per_day, round(count(*) FILTER (WHERE metres >= 16 AND used < 0) / nullif(count(*) FILTER (WHERE metres >= 16), 0), 6) AS rebound_share FROM pd GROUP BY 1"""),
    "lut_double_join": fx.sql("WITH lut AS (SELECT i AS soc_rank, 100 + 327 * i AS m FROM range(100) t(i)), x AS (SELECT event_id, range_m, lag(range_m) OVER (PARTITION BY vehicle ORDER BY ts, event_id) AS prev FROM points) SELECT event_id, a.soc_rank AS rank_now, b.soc_rank AS rank_prev FROM x LEFT JOIN lut a ON range_m = a.m LEFT JOIN lut b ON prev = b.m"),
    "nearest_temperature": fx.sql(f"WITH {_EPI} {_TEMP}"),
    "temperature_fallback": fx.sql(f"WITH {_EPI} SELECT vehicle, episode, coalesce(temp, 12.5::DOUBLE) AS temp FROM epi LEFT JOIN ({_TEMP}) USING (vehicle, episode)"),
    "anti_already_mined": fx.sql(f"WITH {_EPI} SELECT vehicle, episode FROM epi WHERE episode % 2 <> 0"),
    "anti_overlapping_donation": fx.sql(f"WITH {_EPI} SELECT vehicle, episode FROM epi e WHERE NOT EXISTS (SELECT 1 FROM moving m WHERE event_id % 37 = 0 AND m.vehicle = e.vehicle AND departed_us <= m.us + 600000000 AND arrived_us >= m.us)"),
    "stops_overlapping": fx.sql("""WITH x AS (SELECT *, CASE WHEN lag(lat) OVER w IS NULL OR lat <> lag(lat) OVER w OR lon <> lag(lon) OVER w THEN 1 ELSE 0 END AS new FROM moving WINDOW w AS (PARTITION BY vehicle ORDER BY us, event_id)),
      y AS (SELECT *, CAST(sum(new) OVER (PARTITION BY vehicle ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM x), g AS (SELECT vehicle, stop, min(us) AS arrive FROM y GROUP BY 1, 2), h AS (SELECT *, lead(arrive) OVER (PARTITION BY vehicle ORDER BY stop) AS depart FROM g)
      SELECT * FROM h WHERE arrive <= 1704067200000000 + 7200000000 AND (depart IS NULL OR depart >= 1704067200000000 + 3600000000)"""),
    "feed_start_asof": fx.sql(f"WITH {_EPI} SELECT e.vehicle, episode, arg_max(event_id, {{'a': us, 'b': event_id}}) AS event_id FROM epi e JOIN moving m ON m.vehicle = e.vehicle AND us < departed_us AND us >= departed_us - 1800000000 GROUP BY 1, 2"),
    "mine_rentals": fx.sql(f"""WITH {_JUDGED}, rb AS (SELECT * FROM ({_RB}) WHERE vehicles >= 3), tm AS ({_TEMP}) SELECT vehicle, episode, secs, metres, round(burn, 6) AS burn, temp FROM jd LEFT JOIN tm USING (vehicle, episode)
      WHERE reason = 'ok' AND metres <= secs * 20 AND NOT EXISTS (SELECT 1 FROM rb WHERE a = {_cell('pre_lat')} AND b = {_cell('pre_lon')} AND c = {_cell('post_lat')} AND d = {_cell('post_lon')} AND t = departed_us // 1200000000)"""),
    "burn_offsets": fx.sql(f"""WITH {_PAIRS}, mn AS (SELECT type_id, avg(metres) AS mx, avg(used) AS my FROM pd WHERE metres IS NOT NULL AND used IS NOT NULL GROUP BY 1), sl AS (SELECT sum((metres - mx) * (used - my)) / sum((metres - mx) * (metres - mx)) AS b FROM pd JOIN mn USING (type_id))
      SELECT type_id, round(my - b * mx, 3) AS offset, round(b, 6) AS slope FROM mn, sl"""),
    "fit_burn_line": fx.sql(f"WITH {_JUDGED} {_LINE}"),
    "burn_holdout": fx.sql(f"""WITH {_JUDGED}, ok AS (SELECT burn, metres, departed_us < max(departed_us) OVER () - 3600000000 AS train FROM jd WHERE reason = 'ok'),
      line AS (SELECT CASE WHEN count(*) >= 100 THEN round(regr_slope(burn, metres), 6) END AS slope, CASE WHEN count(*) >= 100 THEN round(regr_intercept(burn, metres), 4) END AS intercept FROM ok WHERE train),
      res AS (SELECT train, burn - (intercept + slope * metres) AS gap FROM ok, line)
      SELECT count(*) FILTER (WHERE train) AS fitted, count(*) FILTER (WHERE NOT train) AS held_out, round(sqrt(sum(gap * gap) FILTER (WHERE train) / (count(*) FILTER (WHERE train) - 2)), 4) AS sigma, round(avg(abs(gap)) FILTER (WHERE NOT train), 4) AS held_out_error FROM res"""),
    "fit_burn_model": fx.sql(f"""WITH {_OBS}, tr AS (SELECT * FROM ob WHERE departed_us < (SELECT max(departed_us) - 3600000000 FROM ob)), {_ols('tr')}, he AS (SELECT avg(abs(burn - (coalesce(offset_t, offset_d) + b1 * km + b2 * climb + b3 * temp + b4 * stale))) AS held FROM ob LEFT JOIN mo USING (type_id), md WHERE departed_us >= (SELECT max(departed_us) - 3600000000 FROM ob))
      SELECT term, round(value, 5) AS value FROM (SELECT unnest(['km', 'climb', 'temp', 'stale', 'offset_default', 'r2', 'sigma', 'n', 'held_out_error']) AS term, unnest([b1, b2, b3, b4, offset_d, r2, sigma, n, held]) AS value FROM md, he UNION ALL SELECT 'offset_' || type_id, offset_t FROM mo) WHERE (SELECT n FROM md) >= 100"""),
    "burn_estimate": fx.sql(f"""WITH {_OBS}, {_ols('ob')}, pr AS (SELECT vehicle, episode, climb, b2, sigma, coalesce(offset_t, offset_d) + b1 * km + b2 * climb + b3 * temp AS p FROM ob LEFT JOIN mo USING (type_id), md WHERE n >= 100)
      SELECT vehicle, episode, """ + ", ".join(f"round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, p{k})), 4) AS {a}" for k, a in (("", "burn"), (" - sigma", "low"), (" + sigma", "high"))) + ", CASE WHEN p > 0 THEN round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, b2 * climb / p * 100)), 3) END AS climb_share FROM pr"),
    "arrival_battery": fx.sql(f"WITH {_JUDGED} SELECT vehicle, episode, round(pre_range / 364.0::DOUBLE - high, 4) AS worst, pre_range / 364.0::DOUBLE - high >= 10 AS enough FROM (SELECT *, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, {_P.format(' + 6.0')})), 4) AS high FROM jd, ({_LINE}) WHERE reason = 'ok')"),
}
