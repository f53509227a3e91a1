"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import spatial
from ..operators.rides import ABSENT_US, WATCH_US, vehicle_step
from ..operators.rollups import local
from ..sources import io


class CycleStore:
    """Frames of cycles as tables under one folder, each cycle a partition that its batch replaces as a whole.

    ``cycles`` is written last and is the commit: readers see the cycles that it lists, so a
    batch that failed between two frames shows nothing, and one that runs again writes the
    same partitions once more. It is also the memory of what was the newest feed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __call__(self, name: str, frame: DataFrame, number: int) -> None:
        frame.write.mode("overwrite").parquet(f"{self.root}/{name}/cycle={number}")

    def _cycles(self) -> DataFrame:
        try:
            return self.spark.read.schema("last_updated long, taken boolean, cycle long").parquet(f"{self.root}/cycles")
        except AnalysisException:  # no cycle yet
            return self.spark.createDataFrame([], "last_updated long, taken boolean, cycle long")

    def newest(self, number: int) -> int | None:
        """Time of the newest feed taken before this batch."""
        return self._cycles().where(F.col("taken") & (F.col("cycle") < number)).agg(F.max("last_updated")).first()[0]

    def read(self, name: str) -> DataFrame:
        """A frame's rows of all cycles that are committed."""
        done = self._cycles().where("taken").select("cycle")
        return self.spark.read.parquet(f"{self.root}/{name}").join(F.broadcast(done), "cycle", "left_semi")  # a row per cycle


def cycle_stream(spark: SparkSession, path: str, polygons: DataFrame, sinks: Callable[[str, DataFrame, int], None], checkpoint: str, files_per_cycle: int = 1, pages: bool = False) -> StreamingQuery:
    """Each new feed file: tag, refine, count per region; ``sinks(name, frame, batch)`` stores the frames.

    One micro-batch is one cycle, a file by default; with ``pages`` a file has a part of the
    feed per line. The refined points are cached for the two frames, ``points`` and
    ``regions``; ``cycles`` follows when both are stored. A feed that is not newer than the
    newest one taken (known to sinks with ``newest``, as :class:`CycleStore`) is skipped.
    """
    files = spark.readStream.schema(io.FEED).option("multiLine", not pages).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_cycle).json(path)

    def cycle(batch: DataFrame, number: int) -> None:
        time = batch.agg(F.max("last_updated")).first()[0]
        newest = sinks.newest(number) if hasattr(sinks, "newest") else None
        taken = time is not None and (newest is None or time > newest)
        if taken:
            # a feed may repeat a device at another place: rows of one key must share a position
            rows = io.feed_rows(batch).withColumn("event_id", F.xxhash64("device_id", "last_updated", "lat", "lon"))
            city = polygons.where("region_type = 'neighborhood'")
            refined = spatial.refine_status(spatial.envelope_tag(rows), city).withColumn("form_factor", F.lit("unknown")).persist()
            sinks("points", refined, number)
            sinks("regions", spatial.regional_breakdown(refined, polygons).withColumn("last_updated", F.lit(time)), number)
            refined.unpersist()
        sinks("cycles", batch.sparkSession.createDataFrame([(time, taken)], "last_updated long, taken boolean"), number)

    return files.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_status_stream(points: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Counts per hour; an hour is final when the watermark has passed it."""
    return points.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.count_if(F.col("is_disabled")).alias("disabled")).select(F.col("window.start").alias("hour"), "n", "disabled")


def sla_stream(points: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Average range from 06:00 to 09:00 local per local day."""
    x = points.withColumn("l", local(F.col("ts").cast("timestamp_ntz")).cast("timestamp")).withWatermark("l", delay)
    return x.where("hour(l) >= 6 AND hour(l) < 9").groupBy(F.window("l", "1 day")).agg(F.count("*").alias("n"), F.avg("range_m").alias("avg_range")).select(F.col("window.start").cast("date").alias("local_day"), "n", "avg_range")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Machine:
    """A state machine over the rows of one key in time order.

    ``fields`` names the columns of a row, time in microseconds (``us``) first. ``step(state, row)`` takes a row and gives the next state and rows to put
    out; ``state`` is None where nothing is known. ``due(state)`` is the time from which
    ``tick(state, now)`` has something to do, such as to end what waits or, with None as the
    next state, to forget the key. ``order`` settles rows of one time.
    """

    fields: tuple[str, ...]
    state: str
    out: tuple[str, ...]
    step: Callable[[tuple | None, tuple], tuple[tuple | None, list[tuple]]]
    due: Callable[[tuple], int | None]
    tick: Callable[[tuple, int], tuple[tuple | None, list[tuple]]]
    order: Callable[[tuple], tuple] = lambda row: row

    def run(self, state: tuple | None, rows: list[tuple], now: int) -> tuple[tuple | None, list[tuple]]:
        """All rows in order, with what falls due before each, and what is due at ``now``."""
        made: list[tuple] = []
        for row in [*sorted(rows, key=self.order), None]:
            at = now if row is None else row[0]
            while state is not None and (due := self.due(state)) is not None and due <= at:
                state, out = self.tick(state, at)
                made += out
            if row is not None:
                state, out = self.step(state, row)
                made += out
        return state, made


#: Rows that a task groups by key at a time, and rows of a key that one element of its waiting list holds at most.
GROUPED, PACKED = 1 << 18, 4_096


def packed(rows: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """``(key, first, last, rows)``: the rows of one key that a task meets as one, with their first and last time.

    ``rows`` is a pickled list of tuples of ``fields``, time first. A stateful operator then
    handles a key's rows at the cost of one.
    """

    def groups(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        keys = t.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = keys.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        t, codes = t.take(pa.array(order)), codes[order]
        at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        at = np.concatenate([np.arange(lo, hi, PACKED) for lo, hi in zip(at, [*at[1:], len(codes)])])
        if t.column("us").null_count:
            raise ValueError("a row has no time")
        us = t.column("us").to_numpy()
        own = list(zip(*(t.column(c).to_pylist() for c in fields)))
        dumped = [pickle.dumps(own[lo:hi], pickle.HIGHEST_PROTOCOL) for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(own)])]
        yield pa.record_batch([keys.dictionary.take(pa.array(codes[at])), pa.array(np.minimum.reduceat(us, at)), pa.array(np.maximum.reduceat(us, at)), pa.array(dumped, pa.binary())], names=[key, "first", "last", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held += [batch] if batch.num_rows else []
            if sum(b.num_rows for b in held) >= GROUPED:
                yield from groups(held)
                held = []
        if held:
            yield from groups(held)

    own = rows.select(*dict.fromkeys((key, *fields))).repartition(key)
    return own.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, first long, last long, rows binary")


class InOrder(StatefulProcessor):
    """Runs a :class:`Machine` per key on a stream whose rows come out of order.

    Rows come :func:`packed` and wait so in a list state until the watermark has passed them,
    so a row that comes up to the watermark's delay late still takes its place. What comes
    later than that is left out: by Spark (and counted in its progress) where all rows of a
    pack are late, else here. A key has an event-time timer for the first row that a batch
    brought and one for what is due (``timer`` holds its time), so a silent key is taken up
    again, and forgotten, without new rows.

    Every call to a state is a message to the JVM and back, so a key's states are read once
    and written only where they change; what it puts out are arrays of rows.
    """

    def __init__(self, machine: Machine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.own = handle.getValueState("own", self.machine.state)
        self.timer = handle.getValueState("timer", "ms long")
        self.made = Row(*self.machine.out)

    def _wake(self, us: int) -> int:
        """A timer at the first full millisecond from ``us`` on; one that is there stays as it is."""
        self.handle.registerTimer(ms := -(-us // 1000))
        return ms

    def _due(self, before: tuple | None, state: tuple | None, now: int) -> None:
        """The timer of what is due: moved where the state's time has changed."""
        was, due = (None if x is None else self.machine.due(x) for x in (before, state))
        if was == due:
            return
        if was is not None and (old := self.timer.get()) is not None and old[0] * 1000 > now:
            self.handle.deleteTimer(old[0])
        if due is not None:
            self.timer.update((self._wake(due),))
        elif was is not None:
            self.timer.clear()

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        now, fresh, firsts = timerValues.getCurrentWatermarkInMs() * 1000, [], []
        for r in rows:
            first, own = r["first"], bytes(r["rows"])
            if first <= now:
                left = [x for x in pickle.loads(own) if x[0] > now]
                if not left:
                    continue
                first, own = min(x[0] for x in left), pickle.dumps(left, pickle.HIGHEST_PROTOCOL)
            fresh.append((own,))
            firsts.append(first)
        if fresh:
            self.waiting.appendList(fresh)
            self._wake(min(firsts))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [r for (some,) in self.waiting.get() for r in pickle.loads(some)]
        rest = [r for r in rows if r[0] > now]
        before = self.own.get()
        state, made = self.machine.run(before, [r for r in rows if r[0] <= now] if rest else rows, now)
        if rest and len(rest) < len(rows):
            self.waiting.put([(pickle.dumps(rest[k : k + PACKED], pickle.HIGHEST_PROTOCOL),) for k in range(0, len(rest), PACKED)])
        elif rows and not rest:
            self.waiting.clear()
        if rest:
            self._wake(min(r[0] for r in rest))
        if state is None and before is not None:
            self.own.clear()
        elif state != before:
            self.own.update(state)
        self._due(before, state, now)
        for k in range(0, len(made), PACKED):
            yield self.made(*map(list, zip(*made[k : k + PACKED])))

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, machine: Machine, out: str, delay: str) -> DataFrame:
    """What the machine puts out over ``rows``, a stream with ``us``, per ``key``; rows may come up to ``delay`` late."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # the store that has timers
    timed = packed(rows, key, machine.fields).withColumn("_ts", F.timestamp_micros("last")).withWatermark("_ts", delay)
    arrays = ", ".join("{} array<{}>".format(*c.split()) for c in out.split(", "))
    made = timed.groupBy(key).transformWithState(InOrder(machine), arrays, "Append", "EventTime")
    return made.select(F.inline(F.arrays_zip(*machine.out)))


def closed(rows: DataFrame, key: str, delay_ms: int) -> DataFrame:
    """A table with one more row, of the null ``key``, so late that the watermark of a stream over it passes all others.

    The watermark ends one to two milliseconds after the last row; the closing row itself is never taken up.
    """
    last = rows.agg(F.max("us").alias("us")).where("us is not null")
    end = last.select(*[((F.expr("us div 1000") + 2 + delay_ms) * 1000).alias("us") if c == "us" else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
    return rows.unionByName(end)


def reports_machine(gap_us: int) -> Machine:
    """``(event_id, accepted)``: a report is accepted at least ``gap_us`` after the last accepted one; after that time nothing is remembered."""

    def step(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        us, event_id = row
        accepted = state is None or us - state[0] >= gap_us
        return (us,) if accepted else state, [(event_id, accepted)]

    return Machine(("us", "event_id"), "last long", ("event_id", "accepted"), step, lambda state: state[0] + gap_us, lambda state, now: (None, []))


def accepted_reports_stream(reports: DataFrame, gap_us: int, delay: str = "1 hour") -> DataFrame:
    """``accepted`` for ``reports(event_id, key, us)``, in time order per key whatever order they come in."""
    return in_order(reports, "key", reports_machine(gap_us), "event_id long, accepted boolean", delay)


def watch_machine() -> Machine:
    """Ends of watches: resolved by a sample or expired; a vehicle without open watches is forgotten.

    Rows are samples and, with ``ride_id``, starts of watches. State: last sample, ids, starts
    and leaving times (-1: not yet) of the open watches.
    """

    def due(state: tuple) -> int | None:
        return min(state[2]) + WATCH_US + 1

    def packed(last: int | None, open_: dict[int, list]) -> tuple | None:
        return (last, list(open_), [w[0] for w in open_.values()], [-1 if w[1] is None else w[1] for w in open_.values()]) if open_ else None

    def opened(state: tuple | None) -> tuple[int | None, dict[int, list]]:
        last, ids, starts, lefts = state if state is not None else (None, [], [], [])
        return last, {i: [s, None if left < 0 else left] for i, s, left in zip(ids, starts, lefts)}

    def tick(state: tuple, now: int) -> tuple[tuple | None, list[tuple]]:
        last, open_ = opened(state)
        done = []
        for i in [i for i, (start, _) in open_.items() if start + WATCH_US < now]:
            start, left = open_.pop(i)
            silent = max(start, last or 0) + ABSENT_US
            done.append((i, "expired", silent if left is None and silent < start + WATCH_US else left, None))
        return packed(last, open_), done

    def step(state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        us, ride, reserved = row
        last, open_ = opened(state)
        if ride is not None:
            open_[ride] = [us, None]
            return packed(last, open_), []
        done = []
        for i, own in list(open_.items()):
            since = max(own[0], last or 0)
            if own[1] is None:
                own[1] = since + ABSENT_US if us - since > ABSENT_US else us if reserved else None
            if own[1] is not None and own[1] < us and not reserved:
                done.append((i, "resolved", own[1], us))
                del open_[i]
        return packed(us, open_), done

    order = lambda row: (row[0], row[1] is not None, row[1] or 0, bool(row[2]))
    return Machine(("us", "ride_id", "reserved"), "last long, ids array<long>, starts array<long>, lefts array<long>", ("ride_id", "state", "left_us", "back_us"), step, due, tick, order)


def ride_watch_stream(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Watches that end, as ``(ride_id, state, left_us, back_us)``, for ``rows(vehicle, us, ride_id, reserved)``, samples and starts of watches."""
    return in_order(rows, "vehicle", watch_machine(), "ride_id long, state string, left_us long, back_us long", delay)


#: How long the state of a vehicle that is not seen is kept.
KEEP_US = 90 * 86_400_000_000


def vehicle_machine(keep_us: int = KEEP_US) -> Machine:
    """``(event_id, vehicle, us, kind)`` per sample; a vehicle unseen for more than ``keep_us`` is forgotten and new when it is back."""

    def step(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        us, event_id, vehicle, lat, lon, reserved = row
        own, kind = vehicle_step(None if state is None else tuple(state[1:]), bool(reserved), lat, lon)
        return (us, *own), [(event_id, vehicle, us, kind)]

    fields = ("us", "event_id", "vehicle", "lat", "lon", "reserved")
    return Machine(fields, "last long, lat double, lon double, riding boolean", ("event_id", "vehicle", "us", "kind"), step, lambda state: state[0] + keep_us + 1, lambda state, now: (None, []), lambda row: row[:2])


def vehicle_state_stream(points: DataFrame, delay: str = "1 hour", keep_us: int = KEEP_US) -> DataFrame:
    """The vehicle state machine over a stream ``points(event_id, vehicle, us, lat, lon, reserved)``, in time order whatever order they come in."""
    return in_order(points, "vehicle", vehicle_machine(keep_us), "event_id long, vehicle string, us long, kind string", delay)
