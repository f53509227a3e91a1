"""Sources and sinks: feeds, boundaries, archives, keyed and partitioned replacement."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A feed file.
FEED = "last_updated long, data struct<bikes: array<struct<bike_id: string, id: string, lat: string, lon: string, is_disabled: string, is_reserved: string, vehicle_type_id: string, current_range_meters: string>>>"
#: A GeoJSON layer with polygons or parts of polygons as rings of positions.
LAYER = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
_RINGS, _PARTS = "array<array<array<double>>>", "array<array<array<array<double>>>>"


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session without that setting, as in tests, gets a temporary folder.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever file system it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_SCOPE: ContextVar[list[str] | None] = ContextVar("stored", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`stored` writes inside go when the block ends; for work whose result is stored or collected in it."""
    made: list[str] = []
    token = _SCOPE.set(made)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in made:
            remove(spark, path)


def _leave(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may have ended before
        remove(spark, path)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, whoever reads it, and reread where an executor is lost.

    It goes with its :func:`scope`, or when the program ends.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    made = _SCOPE.get()
    if made is not None:
        made.append(path)
    else:
        atexit.register(_leave, spark, path)
    return spark.read.parquet(path)


def feed_rows(files: DataFrame) -> DataFrame:
    """One row per bike of feed files read with ``FEED``: unusable ones dropped, odd values null."""
    x = files.select("last_updated", F.explode("data.bikes").alias("b"))
    number = lambda c, t: F.expr(f"try_cast(b.{c} AS {t})").alias(c)
    x = x.select("last_updated", F.coalesce("b.bike_id", "b.id").alias("device_id"), number("lat", "double"), number("lon", "double"), number("is_disabled", "boolean"), number("is_reserved", "boolean"), F.col("b.vehicle_type_id"), number("current_range_meters", "int"))
    return x.where("device_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Feed files of a folder as rows."""
    return feed_rows(spark.read.schema(FEED).option("multiLine", True).json(path))


def read_boundaries(spark: SparkSession, path: str, region_type: str, name_field: str) -> DataFrame:
    """``(region_type, region_name, edges)`` of a GeoJSON layer; a feature without the name gets its ordinal."""
    f = spark.read.schema(LAYER).option("multiLine", True).json(path).select(F.posexplode("features").alias("pos", "f"))
    rings = F.when(F.col("f.geometry.type") == "Polygon", F.from_json("f.geometry.coordinates", _RINGS)).otherwise(F.flatten(F.from_json("f.geometry.coordinates", _PARTS)))

    def ring_edges(r: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda k: F.struct(F.element_at(r, k)[0].alias("x1"), F.element_at(r, k)[1].alias("y1"), F.element_at(r, k + 1)[0].alias("x2"), F.element_at(r, k + 1)[1].alias("y2")))

    name = F.coalesce(F.element_at("f.properties", name_field), F.concat(F.lit(f"{region_type}_"), F.lpad((F.col("pos") + 1).cast("string"), 3, "0")))
    return f.select(F.lit(region_type).alias("region_type"), name.alias("region_name"), F.flatten(F.transform(rings, ring_edges)).alias("edges"))


def scan_by_name(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files of different ages: columns by name, null where a file has none."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def write_archive(points: DataFrame, path: str, day: str = "day") -> None:
    """Append points to the archive, a folder per day, compressed with zstd."""
    points.write.mode("append").option("compression", "zstd").partitionBy(day).parquet(path)


def archive_new(points: DataFrame, path: str, day: str = "day") -> int:
    """Archive the days after the archive's newest one; returns how many rows that were."""
    spark = points.sparkSession
    try:
        high = spark.read.parquet(path).agg(F.max(day)).first()[0]
    except Exception as e:  # the archive does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        high = None
    new = points if high is None else points.where(F.col(day) > F.lit(high))
    n = new.count()
    if n:
        write_archive(new, path, day)
    return n


def archive_after(spark: SparkSession, path: str, cutover: str, day: str = "day") -> DataFrame:
    """The archive's rows of folders dated after ``cutover``; folders whose name is no date are skipped.

    The condition is on the partition column alone, so other folders are not read.
    """
    return spark.read.parquet(path).where(F.expr(f"try_cast(CAST({day} AS string) AS date)") > F.lit(cutover).cast("date"))


def append_tables(frames: dict[str, DataFrame], root: str) -> None:
    """Append each frame to its table under ``root``, as a cycle stores its results."""
    for name, frame in frames.items():
        frame.write.mode("append").parquet(f"{root}/{name}")


def write_layer_files(polygons: DataFrame, path: str) -> None:
    """GeoJSON text of each layer in a folder ``region_type=...``; rings are cut where an edge does not go on from the last."""
    region = ["region_type", "region_name"]
    e = polygons.select(*region, F.posexplode("edges").alias("pos", "e")).select(*region, "pos", "e.*")
    w = Window.partitionBy(*region).orderBy("pos")
    goes_on = (F.lag("x2").over(w) == F.col("x1")) & (F.lag("y2").over(w) == F.col("y1"))
    e = e.withColumn("ring", F.sum(F.when(goes_on, 0).otherwise(1)).over(w))
    rings = e.groupBy(*region, "ring").agg(F.array_sort(F.collect_list(F.struct("pos", F.array("x1", "y1").alias("at")))).alias("at"), F.max_by(F.array("x2", "y2"), "pos").alias("end"))
    rings = rings.withColumn("line", F.concat(F.col("at.at"), F.array("end")))
    shapes = rings.groupBy(*region).agg(F.array_sort(F.collect_list(F.struct("ring", "line"))).alias("rings"))
    feature = F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("name"), F.col("region_name")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.col("rings.line").alias("coordinates")).alias("geometry"))
    layers = shapes.groupBy("region_type").agg(F.collect_list(feature).alias("features"))
    layers.select("region_type", F.to_json(F.struct("features")).alias("value")).write.partitionBy("region_type").text(path)


def replace_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Overwrite just the partitions that ``rows`` has, so a rerun replaces and never adds."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def insert_absent(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of ``new`` whose key ``old`` has not, once per key."""
    return new.dropDuplicates(list(key)).join(old, list(key), "left_anti")


def swap_if_complete(staged: DataFrame, expected: int, path: str, share: float = 0.98) -> bool:
    """Replace the table at ``path`` only if enough of the expected rows have come."""
    if staged.count() < share * expected:
        return False
    staged.write.mode("overwrite").parquet(path)
    return True


def jdbc_scan(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table read in parallel ranges of a numeric column (needs the database's driver on the class path)."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts).load()


def hourly_from_arrays(payload: DataFrame) -> DataFrame:
    """Parallel arrays ``time`` and ``temperature`` as rows, without null temperatures."""
    return payload.select(F.explode(F.arrays_zip("time", "temperature")).alias("z")).select("z.time", "z.temperature").where("temperature IS NOT NULL")


def read_way_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A gzip CSV of way attributes; rows that do not fit the schema are left out."""
    return spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").csv(path)
