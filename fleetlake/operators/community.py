"""Points ledger, leaderboards, reports, votes, accounts, addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prefix
from ..functions.folds import ordered_fold
from ..registry import AWARDS
from ..sources import fixtures as fx
from .rollups import top_k

U, A = fx.user_points, fx.accounts


def keyset_page(rows: DataFrame, size: int, after: DataFrame | None = None) -> DataFrame:
    """The newest ``size`` rows, or those next to the last row of the page ``after``."""
    if after is not None:
        last = F.broadcast(after.agg(F.min(F.struct("ts", "entry_id")).alias("_last")))  # one row
        rows = rows.crossJoin(last).where(F.struct("ts", "entry_id") < F.col("_last")).drop("_last")
    return rows.orderBy(F.desc("ts"), F.desc("entry_id")).limit(size)


def eligible(totals: DataFrame, accounts: DataFrame) -> DataFrame:
    """Totals joined to accounts that show in leaderboards and have a name."""
    return totals.join(accounts.where("shows AND display_name IS NOT NULL"), "account_id")


def earned(ledger: DataFrame, *by: str) -> DataFrame:
    """Points and time of the first, confirmed alone."""
    return ledger.where("status = 'confirmed'").groupBy(*by, "account_id").agg(F.sum("points").alias("points"), F.min("ts").alias("first_at"))



def leaders(totals: DataFrame, k: int, *by: str) -> DataFrame:
    """The first k per ``by`` with their place."""
    order = [F.desc("points"), F.col("first_at"), F.col("account_id")]
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    if not by:  # first a distributed limit, then places over k rows
        totals = totals.orderBy(*order).limit(k)
    return totals.withColumn("place", F.row_number().over(w.orderBy(*order)).cast("long")).where(F.col("place") <= k)


def fold_accepted(rows: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """``accepted``: rows at least ``gap_us`` after the last accepted one of their key (a fold, as a lag cannot know that)."""
    n = len(keys)

    def step(last: int | None, row: tuple) -> tuple[int, tuple]:
        us, event_id = row[n], row[n + 1]
        ok = last is None or us - last >= gap_us
        return (us if ok else last), (event_id, ok)

    return ordered_fold(rows.select(*keys, "us", "event_id"), keys, ["us", "event_id"], step, "event_id long, accepted boolean")


def capped_awards(ledger: DataFrame, cap: int = 100) -> DataFrame:
    """Awards of one source trimmed in order to a total of ``cap``; trimming keeps them even. A source's days are summed apart."""
    day = F.to_date("ts") if ledger.schema["ts"].dataType.typeName().startswith(("timestamp", "date")) else F.floor(F.col("ts") / 86_400)  # numbers are seconds
    x = prefix.running_total(ledger, "points", "source_id", ["ts", "entry_id"], day)
    return x.withColumn("paid", F.least("total", F.lit(cap)) - F.least(F.col("total") - F.col("points"), F.lit(cap))).drop("total")


def first_awards(ledger: DataFrame) -> DataFrame:
    """The first entry of each kind of action of a source."""
    rest = F.struct(*[c for c in ledger.columns if c not in ("source_id", "action")])
    return ledger.groupBy("source_id", "action").agg(F.min_by(rest, F.struct("ts", "entry_id")).alias("e")).select("source_id", "action", "e.*")


def streaks(ledger: DataFrame, days: int = 7) -> DataFrame:
    """First day on which an account completes a run of consecutive days."""
    d = ledger.select("account_id", F.col("ts").cast("date").alias("day")).distinct()
    w = Window.partitionBy("account_id").orderBy("day")
    d = d.withColumn("island", F.date_sub("day", F.row_number().over(w)))
    d = d.withColumn("n", F.row_number().over(Window.partitionBy("account_id", "island").orderBy("day")))
    return d.where(F.col("n") == days).groupBy("account_id").agg(F.min("day").alias("earned"))


def address_match(queries: DataFrame, words: DataFrame) -> DataFrame:
    """Best candidates of a street word: equal, then prefix, then within two edits.

    Candidates come from equi-joins: on the word, on its first three letters, and on deletion
    variants (two words within two edits share a variant with at most two letters left out),
    so no query meets the whole gazetteer.
    """
    exact = queries.join(words, queries.q == words.word).select("query_id", "word_id", "word", F.lit(0).alias("tier"), F.lit(0).alias("edits"))
    p = words.withColumn("k", F.substring("word", 1, 3))
    prefix = queries.withColumn("k", F.substring("q", 1, 3)).join(p, "k").where(F.startswith("word", "q") & (F.col("word") != F.col("q"))).select("query_id", "word_id", "word", F.lit(1).alias("tier"), F.lit(0).alias("edits"))

    def variants(c: str) -> Column:
        one = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.length(c))))
        two = F.flatten(F.transform(one, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))
        return F.array_distinct(F.concat(F.array(F.col(c)), one, two))

    left = queries.withColumn("k", F.explode(variants("q")))
    right = words.withColumn("k", F.explode(variants("word")))
    near = left.join(right, "k").select("query_id", "q", "word_id", "word").distinct().withColumn("edits", F.levenshtein("q", "word")).where("edits BETWEEN 1 AND 2").select("query_id", "word_id", "word", F.lit(2).alias("tier"), "edits")
    both = exact.unionByName(prefix).unionByName(near)
    best = Window.partitionBy("query_id")
    return both.withColumn("_t", F.min(F.struct("tier", "edits")).over(best)).where(F.struct("tier", "edits") == F.col("_t")).drop("_t")


def _words(s, d):  # noqa: ANN001, ANN202
    w = fx.load(s, d, "part").select(F.lower(F.regexp_extract("p_name", r"([A-Za-z]+)$", 1)).alias("word")).where("word <> ''").distinct()
    return w.withColumn("word_id", F.crc32(F.col("word").cast("binary")))


def _asked(s, d, *more):  # noqa: ANN001, ANN002, ANN202
    p = fx.load(s, d, "part").select("p_partkey", F.lower(F.regexp_extract("p_name", r"([A-Za-z]+)$", 1)).alias("w")).where("w <> ''")
    k = F.col("p_partkey") % 3
    q = F.when(k == 0, F.col("w")).when(k == 1, F.expr("substring(w, 2)")).otherwise(F.concat(F.substring("w", 1, 1), F.col("w")))
    return p.select(F.col("p_partkey").alias("query_id"), q.alias("q"), *more)


def _reports_us(s, d):  # noqa: ANN001, ANN202
    return fx.load(s, d, "events").select("event_id", F.col("user_id").alias("reporter"), "event_type", fx.micros("ts").alias("us"))


def report_summary(s, d) -> DataFrame:  # noqa: ANN001
    """Weighted reports (an account counts 2) and half the discounts per region; zero for regions without."""
    from .spatial import points_in_polygons

    b = fx.boundaries(s, d).where("region_type = 'neighborhood'")
    r = fx.device_reports(s, d).select("lat", "lon", F.when(F.col("account_id").isNull(), 1).otherwise(2).alias("weight"), F.lit(0).alias("cents")).unionByName(fx.discount_reports(s, d).select("lat", "lon", F.lit(0).alias("weight"), "cents"))
    g = points_in_polygons(r, b).groupBy("region_name").agg(F.sum("weight").alias("w"), F.sum("cents").alias("c"))
    return b.select("region_name").join(g, "region_name", "left").select("region_name", F.coalesce("w", F.lit(0)).cast("long").alias("weighted"), F.expr("coalesce(c, 0) div 2").alias("overcharge"))


def corroboration(s, d) -> DataFrame:  # noqa: ANN001
    """Reports that another reporter (null-safe) made on the same vehicle within seven days: a join on vehicle and week."""
    week = lambda shift: F.expr(f"unix_micros(cast(ts as timestamp)) div 604800000000 + {shift}")
    r = fx.device_reports(s, d).withColumn("week", week(0))
    o = r.select(F.col("vehicle").alias("v2"), F.col("ts").alias("t2"), F.col("account_id").alias("a2"), F.explode(F.array(week(-1), week(0), week(1))).alias("w2"))
    on = (F.col("vehicle") == F.col("v2")) & (F.col("week") == F.col("w2")) & ~F.col("account_id").eqNullSafe(F.col("a2")) & F.col("t2").between(F.col("ts") - F.expr("INTERVAL 7 DAYS"), F.col("ts") + F.expr("INTERVAL 7 DAYS"))
    return r.join(o, on, "left_semi").select("event_id")


def universe(s, d) -> DataFrame:  # noqa: ANN001
    """Cells ever seen, by kind of evidence."""
    p = U(s, d).select("cell", F.lit(False).alias("devices"), F.lit(True).alias("points"))
    t = fx.load(s, d, "events").select((F.col("event_id") % 120).alias("cell"), F.lit(True).alias("devices"), F.lit(False).alias("points"))
    return p.unionByName(t).groupBy("cell").agg(F.bool_or("devices").alias("devices"), F.bool_or("points").alias("points"))


#: Days before the newest entry that the totals of a window take.
WINDOW_DAYS = 365


def cell_totals(cells: DataFrame, ledger: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """All cells ever seen with their points: those of the last ``days`` before the newest entry, and those of all time."""
    start = F.broadcast(ledger.agg((F.max("ts") - F.make_dt_interval(days=F.lit(days))).alias("_start")))  # one row
    t = ledger.crossJoin(start).groupBy("cell").agg(F.sum(F.when(F.col("ts") > F.col("_start"), F.col("points"))).alias("w"), F.sum("points").alias("a"))
    return cells.join(t, "cell", "full").select("cell", F.coalesce("w", F.lit(0)).alias("points"), F.coalesce("a", F.lit(0)).alias("all_time"))


QUERIES = {
    "points_balance": lambda s, d: U(s, d).where("status = 'confirmed'").groupBy("account_id").agg(F.sum("points").alias("points")),
    "keyset_page": lambda s, d: keyset_page(U(s, d), 20, keyset_page(U(s, d), 20)).select("entry_id", "ts"),
    "privacy_filter_join": lambda s, d: eligible(earned(U(s, d), *[]), A(s, d)).select("account_id", "points", F.when(F.col("public"), F.col("display_name")).alias("name")),
    "cell_leaders": lambda s, d: leaders(eligible(earned(U(s, d), "cell"), A(s, d)), 3, "cell").select("cell", "account_id", "points", "place"),
    "podium_per_cell": lambda s, d: leaders(eligible(earned(U(s, d), "cell"), A(s, d)), 3, "cell").groupBy("cell").agg(F.max(F.when(F.col("place") == 1, F.col("account_id"))).alias("gold"), F.count("*").alias("n")),
    "regional_leaders": lambda s, d: leaders(eligible(earned(U(s, d)), A(s, d)), 25).select("account_id", "points", "place"),
    "universe_outer": lambda s, d: cell_totals(universe(s, d), U(s, d)),
    "cell_universe": universe,
    "union_cells_distinct": lambda s, d: U(s, d).select("cell").union(fx.load(s, d, "events").select((F.col("event_id") % 120).alias("cell"))).distinct(),
    "ride_points_cap": lambda s, d: capped_awards(U(s, d)).select("entry_id", "paid"),
    "points_ledger": lambda s, d: capped_awards(first_awards(U(s, d))).where("paid > 0").select("entry_id", "account_id", "paid"),
    "nth_report": lambda s, d: fx.device_reports(s, d).where("account_id IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("account_id").orderBy("ts", "event_id")).cast("long")).where("n IN (1, 10)").select("account_id", "n", "ts"),
    "first_scan_award": lambda s, d: top_k(fx.load(s, d, "events").where("event_type = 'view'").select("event_id", "user_id", (F.col("event_id") % 50).alias("v"), "ts"), 1, ["user_id", "v"], F.col("ts"), F.col("event_id")).select("event_id", F.lit(AWARDS["scan"]).alias("points")),
    "photo_award_cap": lambda s, d: top_k(fx.load(s, d, "events").where("event_type = 'click'").select("event_id", (F.col("event_id") % 50).alias("v"), "ts"), 3, ["v"], F.col("ts"), F.col("event_id")).select("event_id", F.lit(AWARDS["photo"]).alias("points")),
    "profile_award_once": lambda s, d: A(s, d).where("display_name IS NOT NULL AND balance > 0").join(U(s, d).where("action = '1-URGENT'").select("account_id").distinct(), "account_id", "left_anti").select("account_id", F.coalesce(F.when(F.col("public"), F.lit("home")), F.lit("work")).alias("place")),
    "award_formulas": lambda s, d: fx.rides(s, d).select("ride_id", (8 + 2 * F.ceil(F.col("claimed_m") / 2000)).alias("ride"), (2 * F.ceil(F.col("route_m") / 3000)).alias("route")),
    "report_dedupe_30min": lambda s, d: fold_accepted(_reports_us(s, d), ["reporter", "event_type"], 1_800_000_000),
    "award_cooldown_24h": lambda s, d: fold_accepted(_reports_us(s, d).where("event_type = 'click'"), ["reporter"], 86_400_000_000),
    "report_alias": lambda s, d: fx.device_reports(s, d).groupBy(F.when(F.col("report_type") == "dead_battery", "not_rideable").otherwise(F.col("report_type")).alias("kind")).agg(F.count("*").alias("n")),
    "reliability_reports_only": lambda s, d: fx.device_reports(s, d).where(~F.col("report_type").isin("parking")).select("event_id", "report_type"),
    "report_summary": report_summary,
    "corroboration": corroboration,
    "qr_scan_counts": lambda s, d: fx.feature_reports(s, d).groupBy("vehicle").agg(F.min_by("reporter", F.struct("ts", "event_id")).alias("first"), F.max_by("reporter", F.struct("ts", "event_id")).alias("last"), F.count("*").alias("n")),
    "duplicate_accounts": lambda s, d: top_k(A(s, d).withColumn("e", F.lower(F.trim("email"))), 1, ["e"], F.desc_nulls_last("balance"), F.col("account_id")).select("e", "account_id"),
    "recommend_eligible": lambda s, d: recommend(s, d),
    "equity_estimate": lambda s, d: equity(s, d),
    "random_sample_limit": lambda s, d: top_k(fx.load(s, d, "events").select("event_id", F.col("ts").cast("date").alias("day")), 5, ["day"], F.md5(F.col("event_id").cast("string")), F.col("event_id")).select("day", "event_id"),
    "regions_desc": lambda s, d: regions_desc(s, d),
}


def recommend(s, d) -> DataFrame:  # noqa: ANN001
    """Latest vote of each rider and vehicle where the rider bought on that vehicle in the 24 hours before: each vote looks back to the last purchase by a window."""
    e = fx.load(s, d, "events").withColumn("v", F.col("event_id") % 3).where("event_type IN ('view', 'purchase')")
    w = Window.partitionBy("user_id", "v").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    x = e.withColumn("bought", F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w))
    ok = x.where("event_type = 'view' AND bought >= ts - INTERVAL 24 HOURS")
    return ok.groupBy("user_id", "v").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def _summary(s, d):  # noqa: ANN001, ANN202
    from .spatial import QUERIES as Q

    return Q["core_summary_daily"](s, d)


def equity(s, d) -> DataFrame:  # noqa: ANN001
    """Sum of chosen tiers in the latest daily summary, and its percent."""
    x = _summary(s, d).orderBy(F.desc("day")).limit(1)
    n = F.col("er1_count") + F.col("er2_count") + F.col("er3_count")
    return x.select("day", n.alias("n"), F.round(n * 100.0 / F.nullif("total_count", F.lit(0)), 4).alias("pct"))


def regions_desc(s, d) -> DataFrame:  # noqa: ANN001
    """Regions by the count of the latest snapshot, most first."""
    from . import spatial

    x = spatial._typed(s, d)
    last = F.broadcast(fx.points(s, d).agg(F.max("day").alias("_last")))  # one row
    now = x.crossJoin(last).where("day = _last")
    return spatial.regional_breakdown(now, fx.boundaries(s, d)).where("region_type = 'neighborhood'").orderBy(F.desc("count_total"), "region_name").select("region_name", "count_total")


_EARN = "SELECT {by} account_id, CAST(sum(points) AS BIGINT) AS points, min(ts) AS first_at FROM user_points WHERE status = 'confirmed' GROUP BY ALL"
_ELIG = "FROM (" + _EARN + ") e JOIN accounts a USING (account_id) WHERE shows AND display_name IS NOT NULL"
_CELL = f"SELECT cell, account_id, points, row_number() OVER (PARTITION BY cell ORDER BY points DESC, first_at, account_id) AS place {_ELIG.format(by='cell,')} QUALIFY place <= 3"
_FOLD = """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY us, event_id) AS n FROM (SELECT event_id, user_id AS reporter, event_type, epoch_us(ts) AS us FROM events {where})),
  f AS (SELECT {keys}, n, event_id, us AS last, true AS accepted FROM o WHERE n = 1 UNION ALL SELECT {okeys}, o.n, o.event_id, CASE WHEN o.us - f.last >= {gap} THEN o.us ELSE f.last END, o.us - f.last >= {gap} FROM f JOIN o ON {on} AND o.n = f.n + 1) SELECT event_id, accepted FROM f"""
_CAP = "least(t, 100) - least(t - points, 100)"
_UNI = "SELECT cell, bool_or(devices) AS devices, bool_or(points) AS points FROM (SELECT cell, false AS devices, true AS points FROM user_points UNION ALL SELECT event_id % 120, true, false FROM events) GROUP BY 1"
_STREET = "lower(regexp_extract(p_name, '([A-Za-z]+)$', 1))"
SQL = {
    "points_balance": fx.sql("SELECT account_id, CAST(sum(points) AS BIGINT) AS points FROM user_points WHERE status = 'confirmed' GROUP BY 1"),
    "keyset_page": fx.sql("SELECT entry_id, ts FROM user_points ORDER BY ts DESC, entry_id DESC LIMIT 20 OFFSET 20"),
    "privacy_filter_join": fx.sql(f"SELECT account_id, points, CASE WHEN public THEN display_name END AS name {_ELIG.format(by='')}"),
    "cell_leaders": fx.sql(_CELL),
    "podium_per_cell": fx.sql(f"SELECT cell, max(CASE WHEN place = 1 THEN account_id END) AS gold, count(*) AS n FROM ({_CELL}) GROUP BY 1"),
    "regional_leaders": fx.sql(f"SELECT account_id, points, row_number() OVER (ORDER BY points DESC, first_at, account_id) AS place {_ELIG.format(by='')} QUALIFY place <= 25"),
    "universe_outer": fx.sql(f"SELECT cell, coalesce(w, 0) AS points, coalesce(a, 0) AS all_time FROM ({_UNI}) FULL JOIN (SELECT cell, CAST(sum(points) FILTER (WHERE ts > (SELECT max(ts) FROM user_points) - INTERVAL {WINDOW_DAYS} DAYS) AS BIGINT) AS w, CAST(sum(points) AS BIGINT) AS a FROM user_points GROUP BY 1) USING (cell)"),
    "cell_universe": fx.sql(_UNI),
    "union_cells_distinct": fx.sql("SELECT cell FROM user_points UNION SELECT event_id % 120 FROM events"),
    "ride_points_cap": fx.sql(f"SELECT entry_id, {_CAP} AS paid FROM (SELECT *, CAST(sum(points) OVER (PARTITION BY source_id ORDER BY ts, entry_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS t FROM user_points)"),
    "points_ledger": fx.sql(f"SELECT entry_id, account_id, {_CAP} AS paid FROM (SELECT *, CAST(sum(points) OVER (PARTITION BY source_id ORDER BY ts, entry_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS t FROM (SELECT * FROM user_points QUALIFY row_number() OVER (PARTITION BY source_id, action ORDER BY ts, entry_id) = 1)) WHERE {_CAP} > 0"),
    "nth_report": fx.sql("SELECT account_id, n, ts FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ts, event_id) AS n FROM device_reports WHERE account_id IS NOT NULL) WHERE n IN (1, 10)"),
    "first_scan_award": "SELECT event_id, 100 AS points FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 50 ORDER BY ts, event_id) = 1",
    "photo_award_cap": "SELECT event_id, 50 AS points FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY event_id % 50 ORDER BY ts, event_id) <= 3",
    "profile_award_once": fx.sql("SELECT account_id, CASE WHEN public THEN 'home' ELSE 'work' END AS place FROM accounts WHERE display_name IS NOT NULL AND balance > 0 AND account_id NOT IN (SELECT account_id FROM user_points WHERE action = '1-URGENT')"),
    "award_formulas": fx.sql("SELECT ride_id, CAST(8 + 2 * ceil(claimed_m / 2000) AS BIGINT) AS ride, CAST(2 * ceil(route_m / 3000) AS BIGINT) AS route FROM rides"),
    "report_dedupe_30min": _FOLD.format(keys="reporter, event_type", okeys="o.reporter, o.event_type", where="", gap=1_800_000_000, on="o.reporter = f.reporter AND o.event_type = f.event_type"),
    "award_cooldown_24h": _FOLD.format(keys="reporter", okeys="o.reporter", where="WHERE event_type = 'click'", gap=86_400_000_000, on="o.reporter = f.reporter"),
    "report_alias": fx.sql("SELECT CASE report_type WHEN 'dead_battery' THEN 'not_rideable' ELSE report_type END AS kind, count(*) AS n FROM device_reports GROUP BY 1"),
    "reliability_reports_only": fx.sql("SELECT event_id, report_type FROM device_reports WHERE report_type <> 'parking'"),
    "report_summary": fx.sql("""WITH r AS (SELECT lat, lon, CASE WHEN account_id IS NULL THEN 1 ELSE 2 END AS w, 0 AS c, 'd' || event_id AS k FROM device_reports UNION ALL SELECT lat, lon, 0, cents, 'c' || report_id FROM discount_reports),
      h AS (SELECT k, region_name, any_value(w) AS w, any_value(c) AS c FROM r JOIN edges e ON region_type = 'neighborhood' AND (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1)
      SELECT b.region_name, CAST(coalesce(sum(w), 0) AS BIGINT) AS weighted, CAST(coalesce(sum(c), 0) // 2 AS BIGINT) AS overcharge FROM (SELECT DISTINCT region_name FROM edges) b LEFT JOIN h USING (region_name) GROUP BY 1"""),
    "corroboration": fx.sql("SELECT event_id FROM device_reports r WHERE EXISTS (SELECT 1 FROM device_reports o WHERE o.vehicle = r.vehicle AND o.account_id IS DISTINCT FROM r.account_id AND o.ts BETWEEN r.ts - INTERVAL 7 DAYS AND r.ts + INTERVAL 7 DAYS)"),
    "qr_scan_counts": fx.sql("SELECT vehicle, arg_min(reporter, {'a': ts, 'b': event_id}) AS first, arg_max(reporter, {'a': ts, 'b': event_id}) AS last, count(*) AS n FROM feature_reports GROUP BY 1"),
    "duplicate_accounts": fx.sql("SELECT lower(trim(email)) AS e, account_id FROM accounts QUALIFY row_number() OVER (PARTITION BY lower(trim(email)) ORDER BY balance DESC NULLS LAST, account_id) = 1"),
    "recommend_eligible": "SELECT user_id, event_id % 3 AS v, arg_max(event_id, {'a': ts, 'b': event_id}) AS event_id FROM events e WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'purchase' AND r.user_id = e.user_id AND r.event_id % 3 = e.event_id % 3 AND r.ts BETWEEN e.ts - INTERVAL 24 HOURS AND e.ts) GROUP BY 1, 2",
    "random_sample_limit": "SELECT CAST(ts AS DATE) AS day, event_id FROM events QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) <= 5",
}


def _from_spatial() -> None:
    """SQL of the reads that build on the spatial summaries."""
    from .spatial import SQL as S

    SQL["equity_estimate"] = f"SELECT day, er1_count + er2_count + er3_count AS n, round((er1_count + er2_count + er3_count) * 100.0::DOUBLE / nullif(total_count, 0), 4) AS pct FROM ({S['core_summary_daily']}) ORDER BY day DESC LIMIT 1"
    SQL["regions_desc"] = fx.sql("""SELECT r.region_name, CAST(count(t.event_id) AS BIGINT) AS count_total FROM (SELECT DISTINCT region_name FROM edges WHERE region_type = 'neighborhood') r
      LEFT JOIN (SELECT h.event_id, region_name FROM hits h JOIN typed USING (event_id) WHERE region_type = 'neighborhood' AND status = 'core' AND day = (SELECT max(day) FROM points)) t USING (region_name) GROUP BY 1""")


_from_spatial()
