"""Merkle manifest of a dataset: a DAG of content-addressed records, and proofs by descent from the root.

A row's leaf is the SHA-256 of its fields, each written with its length. Leaves of a group,
in order, are hashed by twos level after level up to the group's subroot, and subroots, in
the order of their groups, up to the root. What is stored are records "digest -> children":
a record holds the node lists of up to eight levels under one digest, so a lookup takes a
rank digit of eight bits. A proof request starts at the root, looks up the record of the
digest that it stands on, follows its rank's digit and collects the children that it does
not take; the path, reversed, is the proof from the leaf up.

Ranks come from one sort by ranges and the counts before each range, so a group of any size
is dealt over all tasks; records hold at most 256 leaves. Equal rows are one row with a count
until ranks are given. Records of upper levels (at most ``FEW``, which bounds their size)
are broadcast; lower ones meet their requests by an equi-join on the digest and its place, so
that even equal subtrees share no key.

Defined results: a null field counts as ``-``, an empty text as ``0:``; null groups and null
ids come first; rows equal in all fields are neighbours, each with its own place and proof;
a group of one row has its leaf as subroot, a table of one row also as root, with the hash of
nothing as proof; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, table

#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels in a record; a record has fewer than 2 ** (BITS + 1) digests.
BITS = 8
#: Records that are broadcast at most (34 KB each), and rows of group tables.
FEW, FEW_GROUPS = 256, 100_000
#: Copies of a row that are numbered in place; more are dealt out in pieces of this size.
PIECE = 4096


def field(col: Column) -> Column:
    """A field with its length in UTF-8 bytes before it; ``-`` for null."""
    s = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*cols: Column) -> Column:
    """Digest of a row's fields."""
    return F.sha2(F.concat(*map(field, cols)), 256)


def _ends(batches):  # noqa: ANN001, ANN202
    """Adds the partition and the running total of ``copies`` in it."""
    total, part = 0, TaskContext.get().partitionId()
    for b in batches:
        ends = total + np.cumsum(b.column("copies").to_numpy(zero_copy_only=False).astype(np.int64))
        total = int(ends[-1]) if len(ends) else total
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(ends), part, np.int64)), pa.array(ends, pa.int64())], names=[*b.schema.names, "part", "end"])


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows(..., copies)`` with ``start``, the number of copies before a row in the given order, in which rows must differ.

    Nulls come first. One sort by ranges; only the totals of the ranges are summed in one place.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    x = cut(x.mapInArrow(_ends, StructType([*x.schema.fields, StructField("part", LongType()), StructField("end", LongType())])))
    totals = sorted((r["part"], r["n"]) for r in x.groupBy("part").agg(F.max("end").alias("n")).collect())  # a row per task
    before = np.cumsum([0, *(k for _, k in totals)]).tolist()
    offsets = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(totals, before)], "part long, before long")
    return x.join(F.broadcast(offsets), "part").withColumn("start", F.col("before") + F.col("end") - F.col("copies")).drop("part", "end", "before")


def few(df: DataFrame, bound: int) -> DataFrame:
    """``df``, to be broadcast if it has at most ``bound`` rows; beyond, Spark chooses the join."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def _depth(size: Column) -> Column:
    """Levels above ``size`` nodes until one is left."""
    return F.when(size <= 1, 0).otherwise(F.length(F.bin(size - 1)))


def _pairs(nodes: Column) -> Column:
    """The next level: digests of each two consecutive nodes, of a last one alone."""
    one = lambda i: F.sha2(F.concat(F.get(nodes, (2 * i).cast("int")), F.coalesce(F.get(nodes, (2 * i + 1).cast("int")), F.lit(""))), 256)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), one)


def records(nodes: DataFrame) -> DataFrame:
    """``(base, size, block, levels, digest)``: the subtree of each run of 256 of ``nodes(base, size, at, digest)``.

    ``base`` names a tree, ``size`` is the number of its nodes on this level. ``levels`` has
    the nodes of each level below ``digest``, lowest first.
    """
    x = nodes.groupBy("base", "size", F.shiftright("at", BITS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).getField("digest").alias("l0"))
    x = x.withColumn("t", F.least(F.lit(BITS), _depth(F.col("size"))))
    for j in range(BITS):
        x = x.withColumn(f"l{j + 1}", F.when(F.col("t") > j, _pairs(F.col(f"l{j}"))))
    tops = F.coalesce(*[F.get(f"l{j}", F.lit(0)) for j in range(BITS, -1, -1)])
    return x.select("base", "size", "block", F.slice(F.array(*[f"l{j}" for j in range(BITS)]), F.lit(1), F.col("t")).alias("levels"), tops.alias("digest"))


@dataclass
class Forest:
    """Trees of a level table: records from the leaves up, and ``(base, digest)`` of the roots."""

    levels: list[DataFrame]
    roots: DataFrame


def grow(nodes: DataFrame, largest: int) -> Forest:
    """Records of all trees over ``nodes(base, size, at, digest)``, the largest of which has ``largest`` leaves."""
    levels = []
    while True:
        made = cut(records(nodes))
        levels.append(made)
        if (largest := (largest + (1 << BITS) - 1) >> BITS) <= 1:
            return Forest(levels, made.select("base", "digest"))
        nodes = made.select("base", F.shiftright(F.col("size") + ((1 << BITS) - 1), BITS).alias("size"), F.col("block").alias("at"), "digest")


def descend(requests: DataFrame, forest: Forest) -> DataFrame:
    """``requests(base, at, node, path, ...)`` led from the digest ``node`` to leaf ``at``.

    ``path`` grows by the children that are not taken, from the top down: an empty string
    where a node has no other child.
    """
    for s in range(len(forest.levels) - 1, -1, -1):
        own = forest.levels[s].select(F.col("base").alias("_base"), F.col("block").alias("_block"), F.col("digest").alias("_digest"), "levels")
        x = requests.join(few(own, FEW), (F.col("node") == F.col("_digest")) & (F.col("base") == F.col("_base")) & (F.shiftright("at", BITS * (s + 1)) == F.col("_block")))
        spot = [F.shiftright("at", BITS * s + j).bitwiseAND(F.lit((1 << (BITS - j)) - 1)).cast("int") for j in range(BITS)]
        missed = [F.when(F.size("levels") > j, F.coalesce(F.get(F.get("levels", F.lit(j)), spot[j].bitwiseXOR(F.lit(1))), F.lit(""))) for j in range(BITS)]
        path = F.concat("path", F.array_compact(F.array(*missed[::-1])))
        taken = F.coalesce(F.get(F.get("levels", F.lit(0)), spot[0]), "node")
        requests = x.select(*[c for c in requests.columns if c not in ("node", "path")], taken.alias("node"), path.alias("path"))
    return requests


def fold(start: Column, proof: Column, bit: object) -> Column:
    """The root that ``start`` and the siblings in ``proof``, from the leaf up, lead to; ``bit(i)`` is 1 where the sibling of level i stands left."""
    steps = F.transform(proof, lambda x, i: F.struct(x.alias("sibling"), bit(i).alias("left")))
    step = lambda a, x: F.sha2(F.when(x["left"] == 1, F.concat(x["sibling"], a)).otherwise(F.concat(a, x["sibling"])), 256)
    return F.aggregate(steps, start, step)


@dataclass
class Manifest:
    """The stored DAG: trees of the groups and the tree over their subroots; ``None`` as root for an empty table."""

    leaves: DataFrame  # (base, size, at, leaf and the columns that came with it)
    forest: Forest
    groups: DataFrame  # (base, place, subroot)
    upper: Forest
    root: str | None


def manifest(leaves: DataFrame) -> Manifest:
    """The DAG over ``leaves(grp, id, leaf, ...)``: groups by ``grp``, leaves by ``id``; further columns go with a leaf."""
    kinds = numbered(leaves.groupBy(*leaves.columns).agg(F.count("*").alias("copies")), *leaves.columns)
    sizes = cut(kinds.groupBy("grp").agg(F.min("start").alias("base"), F.sum("copies").alias("size")))
    total, largest = sizes.agg(F.count("*"), F.max("size")).first()
    own = few(sizes.withColumnRenamed("grp", "_grp"), FEW_GROUPS)
    x = kinds.join(own, F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp").withColumn("at", F.col("start") - F.col("base"))
    once = x.where(F.col("copies") <= PIECE).withColumn("more", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    pieces = x.where(F.col("copies") > PIECE).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(PIECE).cast("long"))))
    dealt = pieces.repartition("base", "at", "piece").withColumn("more", F.explode(F.sequence("piece", F.least(F.col("piece") + PIECE, F.col("copies")) - 1))).drop("piece")
    x = once.unionByName(dealt).withColumn("at", F.col("at") + F.col("more")).select("base", "size", "at", *leaves.columns)
    forest = grow(x.select("base", "size", "at", F.col("leaf").alias("digest")), largest or 0)
    groups = numbered(forest.roots.withColumn("copies", F.lit(1).cast("long")), "base").select("base", F.col("start").alias("place"), F.col("digest").alias("subroot"))
    tree = groups.select(F.lit(0).cast("long").alias("base"), F.lit(total).cast("long").alias("size"), F.col("place").alias("at"), F.col("subroot").alias("digest"))
    upper = grow(tree, total)
    root = upper.roots.first()
    return Manifest(x, forest, groups, upper, root["digest"] if root else None)


def proofs(made: Manifest) -> DataFrame:
    """The leaves of a manifest with ``subroot``, ``place`` of the group, ``lower`` (levels below the subroot) and ``proof``: siblings from the leaf up."""
    nothing = F.array().cast("array<string>")
    starts = made.groups.select(F.lit(0).cast("long").alias("base"), F.col("place").alias("at"), F.lit(made.root).alias("node"), nothing.alias("path"), F.col("base").alias("tree"))
    to_groups = descend(starts, made.upper).select("tree", F.col("at").alias("place"), F.col("node").alias("subroot"), F.col("path").alias("above"))
    x = made.leaves.join(few(cut(to_groups), FEW_GROUPS), F.col("base") == F.col("tree")).drop("tree")
    x = descend(x.withColumn("node", F.col("subroot")).withColumn("path", nothing), made.forest)
    return x.withColumn("lower", F.size("path")).withColumn("proof", F.concat(F.reverse("path"), F.reverse("above"))).drop("path", "above", "node")


def refolded(start: Column) -> Column:
    """The root that a row of :func:`proofs` leads to from the leaf ``start``."""
    shift = lambda c, i: F.call_function("shiftright", c, i).bitwiseAND(F.lit(1).cast("long"))
    return fold(start, F.col("proof"), lambda i: F.when(i < F.col("lower"), shift(F.col("at"), i)).otherwise(shift(F.col("place"), i - F.col("lower"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: leaf, subroot, root and proof of every document, and whether it still leads to the root after tampering."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    plain = leaf(*map(F.col, FIELDS))
    changed = F.when(hit, leaf(*[more if c == "n_chars" else F.col(c) for c in FIELDS]))
    made = manifest(docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("id"), plain.alias("leaf"), changed.alias("tampered")))
    x = proofs(made).withColumn("folded_root", refolded(F.coalesce("tampered", "leaf")))
    root = F.lit(made.root).cast("string")
    proof = F.sha2(F.concat_ws("", "proof"), 256)
    return x.select(F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"), proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))


SQL = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i)
), d AS (
  SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS hit
  FROM documents, crc
), l AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(n_chars + CAST(coalesce(hit, false) AS BIGINT) AS VARCHAR)) || ':' || (n_chars + CAST(coalesce(hit, false) AS BIGINT)), '-') || tail) AS tampered
  FROM d
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER () AS id FROM l
), nodes(g, lvl, spot, n, digest) AS (
  SELECT g, 0, spot, n, leaf FROM r
  UNION ALL
  SELECT g, lvl + 1, spot // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY spot)) FROM nodes WHERE n > 1 GROUP BY g, lvl, spot // 2, n
), subs AS (SELECT g, digest, count(*) OVER () AS n, (SELECT max(lvl) FROM nodes m WHERE m.g = nodes.g) AS depth FROM nodes WHERE n = 1),
tops(lvl, spot, n, digest) AS (
  SELECT 0, g, n, digest FROM subs
  UNION ALL
  SELECT lvl + 1, spot // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY spot)) FROM tops WHERE n > 1 GROUP BY lvl, spot // 2, n
), apex AS (SELECT digest AS root, lvl AS depth FROM tops WHERE n = 1),
steps AS (
  SELECT id, s.lvl, s.own, s.digest FROM (SELECT id, u.lvl, u.own, nodes.digest FROM (SELECT id, r.g, CAST(unnest(range(depth)) AS BIGINT) AS lvl, spot >> CAST(unnest(range(depth)) AS BIGINT) AS own FROM r JOIN subs USING (g)) u
    LEFT JOIN nodes ON nodes.g = u.g AND nodes.lvl = u.lvl AND nodes.spot = xor(u.own, 1)) s
  UNION ALL
  SELECT id, 1000 + u.lvl, u.own, tops.digest FROM (SELECT id, CAST(unnest(range(depth)) AS BIGINT) AS lvl, g >> CAST(unnest(range(depth)) AS BIGINT) AS own FROM r, apex) u
    LEFT JOIN tops ON tops.lvl = u.lvl AND tops.spot = xor(u.own, 1)
), p AS (
  SELECT id, sha256(coalesce(string_agg(digest, '' ORDER BY lvl), '')) AS proof_sha256,
    list(CASE WHEN digest IS NULL THEN '-' WHEN own % 2 = 1 THEN 'L' || digest ELSE 'R' || digest END ORDER BY lvl) AS path
  FROM steps GROUP BY id
), f AS (
  SELECT r.*, coalesce(proof_sha256, sha256('')) AS proof_sha256,
    list_reduce(list_prepend(tampered, coalesce(path, [])), lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END)) AS folded_root
  FROM r LEFT JOIN p USING (id)
)
SELECT doc_id, leaf, subs.digest AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM f JOIN subs USING (g), apex
"""
