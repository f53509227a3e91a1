"""Line deduplication through a sharded minimal perfect hash.

The key of a line is the line without ASCII white space at its ends and with A-Z in lower
case; keys go by 128-bit hashes. Grouped aggregation finds the keys that enough documents
hold, with their document count and largest doc_id. Those distinct hashes are dealt into
shards; each shard becomes a minimal perfect hash (levels of bit arrays with ranks) that
points into compact arrays: fingerprints, counts, last documents. Documents then probe the
arrays; lines are never joined with lines.

The arrays are broadcast if their measured size is within ``broadcast_bytes``. Beyond that
each line hash travels to its shard (salted, so that a very common line is dealt over many
tasks), streams past the shard's arrays there, and only the hits come back to the documents.

Defined results: a null or empty text is one empty line, which has no key; a text that loses
all its lines becomes empty and its row stays; repeated rows with one doc_id count as one
document; a row with a null doc_id is never counted and keeps no repeated line; an empty
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free, table

_BLANK = bytes([0x20, *range(0x09, 0x0E)])
#: Keys that one shard of the index holds on average.
SHARD_KEYS = 16_384
_U = np.uint64


def line_keys(text: bytes | None, min_points: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """The lines of a text, the positions of those that have a long enough key, and their keys."""
    data = text or b""
    lines = data.split(b"\n")
    at, keys = [], []
    for k, line in enumerate(data.lower().split(b"\n")):  # bytes.lower folds A-Z alone
        key = line.strip(_BLANK)
        if len(key) >= min_points and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_points):
            at.append(k)
            keys.append(key)
    return lines, at, keys


def hash_keys(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes as rows of two unsigned 64-bit numbers."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(k) for k in keys]), dtype=_U).reshape(-1, 2)


def line_hashes(docs: DataFrame, min_points: int, with_text: bool = False) -> DataFrame:
    """``(doc_id, h1, h2)``: the distinct line keys of each document; ``with_text`` adds ``th``, a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            counts = np.zeros(batch.num_rows, np.int64)
            for k, t in enumerate(batch.column(0).cast(pa.binary())):
                keys = list(dict.fromkeys(line_keys(t.as_py(), min_points)[2]))
                counts[k] = len(keys)
                found += keys
            h = hash_keys(found).view(np.int64)
            own = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            yield pa.record_batch([*(c.take(own) for c in batch.columns[1:]), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))], names=[*batch.schema.names[1:], "h1", "h2"])

    carried = [F.col("doc_id").cast("long").alias("doc_id"), *([F.xxhash64("text").alias("th")] if with_text else [])]
    return docs.select("text", *carried).mapInArrow(run, f"doc_id long, {'th long, ' if with_text else ''}h1 long, h2 long")


def _slots(h1: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h1 + _U((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return (x ^ (x >> _U(32))) % _U(size)


class PerfectHash:
    """Levels of bit arrays: a key's place is the rank of the first set bit that it alone has claimed."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes = sizes
        self.words = words
        self.ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
        self.first = np.concatenate(([0], np.cumsum([(s + 63) // 64 for s in sizes], dtype=np.int64)))

    @classmethod
    def build(cls, h1: np.ndarray) -> PerfectHash:
        """``h1``: distinct unsigned 64-bit hashes."""
        left, sizes, words = h1, [], []
        while len(left):
            size = max(64, 2 * len(left))
            slot = _slots(left, len(sizes), size).astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            bits = np.zeros((size + 63) // 64 * 64, np.uint8)
            bits[:size] = alone
            sizes.append(size)
            words.append(np.packbits(bits, bitorder="little").view(_U))
            left = left[~alone[slot]]
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, _U))

    def place(self, h1: np.ndarray) -> np.ndarray:
        """Places of the keys; -1, or the place of some other key, for hashes that were not indexed."""
        out = np.full(len(h1), -1, np.int64)
        open_ = np.arange(len(h1))
        for level, size in enumerate(self.sizes):
            slot = _slots(h1[open_], level, size).astype(np.int64)
            word, bit = self.first[level] + slot // 64, (slot % 64).astype(_U)
            held = (self.words[word] >> bit) & _U(1) == 1
            below = self.words[word[held]] & ((_U(1) << bit[held]) - _U(1))
            out[open_[held]] = self.ranks[word[held]] + np.bitwise_count(below)
            open_ = open_[~held]
        return out


class Shard:
    """A perfect hash with its arrays of fingerprints (the second hash), counts and last documents."""

    def __init__(self, sizes: list[int], words: bytes, fingerprints: bytes, counts: bytes, last: bytes):
        self.hash = PerfectHash(list(sizes), np.frombuffer(words, _U))
        self.fingerprints, self.counts, self.last = np.frombuffer(fingerprints, _U), np.frombuffer(counts, np.uint32), np.frombuffer(last, np.int64)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document counts (0: not indexed) and last documents of line hashes."""
        place = self.hash.place(h1)
        safe = np.maximum(place, 0)
        hit = (place >= 0) & (self.fingerprints[safe] == h2) if len(self.counts) else np.zeros(len(h1), bool)
        return np.where(hit, self.counts[safe], 0) if len(self.counts) else np.zeros(len(h1), np.int64), np.where(hit, self.last[safe], 0) if len(self.counts) else np.zeros(len(h1), np.int64)


_SHARD = "shard int, sizes array<long>, words binary, fingerprints binary, counts binary, last binary"


def build_index(stats: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard from ``stats(h1, h2, docs, last)``."""

    def build(key: tuple, batch: pa.Table) -> pa.Table:
        h1 = np.ascontiguousarray(batch.column("h1").to_numpy()).view(_U)
        first = np.unique(h1, return_index=True)[1]
        rest = np.setdiff1d(np.arange(len(h1)), first)
        if len(rest):  # two line hashes with one first half: not met among 2^64, but never to be dropped
            raise ValueError("two lines share the first 64 bits of their hash; change the hash")
        index = PerfectHash.build(h1)
        to = index.place(h1)
        arrays = []
        for name, kind in (("h2", np.int64), ("docs", np.uint32), ("last", np.int64)):
            x = np.zeros(len(h1), kind)
            x[to] = np.minimum(batch.column(name).to_numpy(), np.iinfo(kind).max)
            arrays.append(pa.array([x.tobytes()], pa.binary()))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([index.sizes], pa.list_(pa.int64())), pa.array([index.words.tobytes()], pa.binary()), *arrays], names=["shard", "sizes", "words", "fingerprints", "counts", "last"])

    return stats.withColumn("shard", F.pmod("h1", F.lit(n_shards)).cast("int")).groupBy("shard").applyInArrow(build, _SHARD)


def _probe_all(shards: dict[int, Shard], n_shards: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts, last = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    own = np.mod(np.ascontiguousarray(h[:, 0]).view(np.int64), n_shards)
    order = np.argsort(own, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1) if len(order) else []:
        if (shard := shards.get(int(own[part[0]]))) is not None:
            counts[part], last[part] = shard.probe(np.ascontiguousarray(h[part, 0]), np.ascontiguousarray(h[part, 1]))
    return counts, last


def _rebuild(batch: pa.RecordBatch, names: list[str], text_at: int, kept: list[bytes], n_lines: list[int], n_dropped: list[int]) -> pa.RecordBatch:
    cols = [batch.column(k) for k in range(len(names) - 2)]
    cols[text_at] = pa.array(kept, pa.binary()).cast(pa.string())
    return pa.record_batch([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=names)


def dedup_lines(docs: DataFrame, min_points: int = 20, min_docs: int = 3, broadcast_bytes: int = 32 << 20, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and two columns ``counts`` (in place of columns so called).

    Keys of at least ``min_points`` code points found in at least ``min_docs`` documents
    lose all their lines except in the largest doc_id that holds them.
    """
    spark = docs.sparkSession
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in {n.lower() for n in counts}])
    stats = cut(
        line_hashes(docs, min_points).groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("last")).where(F.col("docs") >= min_docs)
    )
    n_shards = max(1, -(-stats.count() // SHARD_KEYS))
    index = cut(build_index(stats, n_shards))
    arrays = ("words", "fingerprints", "counts", "last")
    size = index.agg(F.sum(sum((F.octet_length(c) for c in arrays), F.lit(0)))).first()[0] or 0
    out = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in counts)])
    names = docs.columns
    text_at, id_at = names.index("text"), names.index("doc_id")
    if size <= broadcast_bytes:
        held = spark.sparkContext.broadcast([tuple(r) for r in index.collect()])  # within the bound just measured

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shards = {r[0]: Shard(*map(bytes_or_list, r[1:])) for r in held.value}
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    split = [line_keys(t.as_py(), min_points) for t in part.column(text_at).cast(pa.binary())]
                    held_in, last = _probe_all(shards, n_shards, hash_keys([k for _, _, keys in split for k in keys]))
                    ids = part.column(id_at).cast(pa.int64()).to_pylist()
                    own = np.repeat(np.array([-1 if i is None else i for i in ids], np.int64), [len(at) for _, at, _ in split])
                    no_id = np.repeat(np.array([i is None for i in ids], bool), [len(at) for _, at, _ in split])
                    drop = (held_in >= min_docs) & ((own != last) | no_id)
                    kept, n_lines, n_dropped, k = [], [], [], 0
                    for lines, at, _ in split:
                        gone = {at[j] for j in np.flatnonzero(drop[k : k + len(at)])}
                        k += len(at)
                        kept.append(b"\n".join([x for j, x in enumerate(lines) if j not in gone]) if gone else b"\n".join(lines))
                        n_lines.append(len(lines))
                        n_dropped.append(len(gone))
                    yield _rebuild(part, out.names, text_at, kept, n_lines, n_dropped)

        return docs.mapInArrow(run, out)

    # By id and text: rows without an id, and repeated ids, do not gather in one group.
    hits = route(docs, index, n_shards, min_points, min_docs).distinct()
    own, text, pairs_ = free(docs, "_own"), free(docs, "_th"), free(docs, "_gone")
    gone = hits.groupBy(F.col("doc_id").alias(own), F.col("th").alias(text)).agg(F.collect_list(F.struct("h1", "h2")).alias(pairs_))
    joined = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(text)), "left").select(*docs.columns, pairs_)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for t, g in zip(batch.column(text_at).cast(pa.binary()), batch.column(len(names))):
                lines, at, keys = line_keys(t.as_py(), min_points)
                pairs = {(x["h1"], x["h2"]) for x in g.as_py() or []}
                gone = {at[j] for j, h in enumerate(hash_keys(keys).view(np.int64).tolist()) if tuple(h) in pairs} if pairs else set()
                kept.append(b"\n".join([x for j, x in enumerate(lines) if j not in gone]))
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
            yield _rebuild(batch, out.names, text_at, kept, n_lines, n_dropped)

    return joined.mapInArrow(strip, out)


def bytes_or_list(x):
    """Row values as Python holds them: byte arrays as bytes."""
    return bytes(x) if isinstance(x, bytearray) else x


def route(docs: DataFrame, index: DataFrame, n_shards: int, min_points: int, min_docs: int, salts: int = 32) -> DataFrame:
    """``(doc_id, th, h1, h2)`` of lines to drop, found where the shards are; ``th`` is the hash of the text.

    Shards are copied once per salt and sort before the lines of their (shard, salt), so a
    task holds one shard's arrays and streams lines past them.
    """
    lines = line_hashes(docs, min_points, True).select(
        F.pmod("h1", F.lit(n_shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "th"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"),
        "doc_id", "th", "h1", "h2", *[F.lit(None).cast(t).alias(c) for c, t in (("sizes", "array<long>"), ("words", "binary"), ("fingerprints", "binary"), ("counts", "binary"), ("last", "binary"))],
    )
    arrays = index.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"),
        *[F.lit(None).cast("long").alias(c) for c in ("doc_id", "th", "h1", "h2")], "sizes", "words", "fingerprints", "counts", "last",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = None, None
        for batch in batches:
            key = batch.column("shard").to_numpy().astype(np.int64) * salts + batch.column("salt").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                if part.num_rows and part.column("kind")[0].as_py() == 0:
                    own, shard = int(key[a]), Shard(*(part.column(c)[0].as_py() for c in ("sizes", "words", "fingerprints", "counts", "last")))
                    part = part.slice(1)
                if not part.num_rows or own != int(key[a]):
                    continue  # no indexed line has this shard
                h1, h2 = (np.ascontiguousarray(part.column(c).to_numpy()).view(_U) for c in ("h1", "h2"))
                counts, last = shard.probe(h1, h2)
                ids = part.column("doc_id")
                drop = (counts >= min_docs) & ((ids.fill_null(0).to_numpy() != last) | ids.is_null().to_numpy(zero_copy_only=False))
                yield part.select(["doc_id", "th", "h1", "h2"]).filter(pa.array(drop))

    return lines.unionByName(arrays).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(run, "doc_id long, th long, h1 long, h2 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: line counts and the digest of what stays, for every document."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, CASE WHEN length(key) >= 20 THEN key END AS key FROM (
    SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(generate_series(1, len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
  )
), keys AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE key IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN last IS NOT NULL AND doc_id <> last THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE last IS NULL OR doc_id = last), '')) AS kept_sha256
FROM lines LEFT JOIN keys USING (key) GROUP BY doc_id
"""
