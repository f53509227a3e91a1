"""An archive of points with a manifest: appends and merges that are seen as a whole or not at all.

Data files lie in a folder per append, a subfolder per day. What counts is the newest manifest,
a small file that lists the appends and their high-water mark; it is created under the next
version number, which only one writer gets. So an append that breaks off half-way, or a task
that ran twice, leaves files that no reader sees, the high-water mark needs no scan, and a
reader who began before a merge goes on with the old files, which :meth:`Archive.sweep` takes
later.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import remove


@dataclass
class Archive:
    """The archive under ``root``; ``time`` is the column of the high-water mark, ``day`` that of the folders."""

    spark: SparkSession
    root: str
    time: str = "ts"
    day: str = "day"

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def manifest(self) -> dict:
        """The newest whole manifest: version, high-water mark (text) and appends."""
        for name in reversed([n for n in self._names("manifest") if re.fullmatch(r"\d{10}\.json", n)]):
            try:
                return json.loads(self.spark.read.option("wholetext", True).text(f"{self.root}/manifest/{name}").first()[0])
            except (ValueError, TypeError):  # its writer broke off
                continue
        return {"version": 0, "high": None, "appends": []}

    def _commit(self, before: dict, high: str | None, appends: list[dict]) -> None:
        fs, _ = self._fs(self.root)
        names = [n for n in self._names("manifest") if re.fullmatch(r"\d{10}\.json", n)]
        if any(int(n[:10]) > before["version"] and self.manifest()["version"] > before["version"] for n in names):
            raise RuntimeError("another writer has committed since")
        version = max([before["version"], *(int(n[:10]) for n in names)]) + 1  # above what broke off
        out = fs.create(self._fs(f"{self.root}/manifest/{version:010}.json")[1], False)  # fails if another writer has this version
        try:
            out.write(bytearray(json.dumps({"version": version, "high": high, "appends": appends}).encode()))
        finally:
            out.close()

    def append(self, points: DataFrame) -> int:
        """Archive the points past the high-water mark; returns their number. What is there already is left out, so a repeated append adds nothing."""
        before = self.manifest()
        new = points if before["high"] is None else points.where(F.col(self.time) > F.lit(before["high"]).cast(points.schema[self.time].dataType))
        name = uuid.uuid4().hex
        new.repartition(self.day).write.option("compression", "zstd").partitionBy(self.day).parquet(f"{self.root}/data/{name}")
        return self._listed(before, name, points, [])

    def _listed(self, before: dict, name: str, like: DataFrame, instead: list[str]) -> int:
        """Commit the files of ``name`` in place of some appends; returns their rows."""
        path = f"{self.root}/data/{name}"
        rows, high = self.spark.read.schema(like.schema).parquet(path).agg(F.count("*"), F.max(self.time).cast("string")).first()
        if rows:
            kept = [a for a in before["appends"] if a["name"] not in instead]
            self._commit(before, max(filter(None, (before["high"], high)), default=None), [*kept, {"name": name, "rows": rows}])
        return rows

    def read(self) -> DataFrame:
        """The points of all listed appends, columns by name."""
        paths = [f"{self.root}/data/{a['name']}" for a in self.manifest()["appends"]]
        if not paths:
            raise FileNotFoundError(f"nothing is archived under {self.root}")
        parts = [self.spark.read.option("mergeSchema", True).parquet(p) for p in paths]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more, allowMissingColumns=True)
        return out

    def high_water(self) -> str | None:
        """The latest archived time, from the manifest alone."""
        return self.manifest()["high"]

    def merge(self, below: int) -> int:
        """Write the appends of fewer than ``below`` rows anew as one, a file per day; returns how many there were."""
        before = self.manifest()
        small = [a["name"] for a in before["appends"] if a["rows"] < below]
        if len(small) < 2:
            return 0
        parts = [self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/data/{n}") for n in small]
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more, allowMissingColumns=True)
        name = uuid.uuid4().hex
        rows.repartition(self.day).write.option("compression", "zstd").partitionBy(self.day).parquet(f"{self.root}/data/{name}")
        self._listed(before, name, rows, small)
        return len(small)

    def sweep(self) -> list[str]:
        """Remove files that no manifest in force lists: of broken appends and of appends that were merged."""
        listed = {a["name"] for a in self.manifest()["appends"]}
        gone = [n for n in self._names("data") if n not in listed]
        for n in gone:
            remove(self.spark, f"{self.root}/data/{n}")
        return gone
