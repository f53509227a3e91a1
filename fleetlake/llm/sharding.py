"""Resharding by minimum-cost flow.

From the sizes of the old shards and the capacities of the new ones, a minimum-cost flow
says how many bytes go from each old shard to each new shard so that the fewest bytes move.
Each old shard is a line of blocks of documents; the flow cuts the line into intervals, one
per new shard, its own first, and a block goes where its middle lies. The old shards are files
(:func:`lay_out` makes them, in the order of blocks). A file is affected if a row of it moves:
such files are rewritten, rows that stay to a file of their shard and the others to those of
their new shards; all other files stay as they are (:func:`rewrite_files`). As files follow the
line of blocks, an old shard has one file that is cut, so the bytes written are those that the
flow moves and a file for each old shard. Where the old shards are no files of their own,
:func:`relocate` writes what a shard gains, :func:`rewrite` and :func:`reshard` whole shards,
those affected or all.

Equal texts are groups: those of an old shard lie in one block, so they stay together. Only a
group of more than ``1 / SPLIT`` of a new shard's capacity is dealt over blocks row by row, as
shards would not come out equal otherwise; equal texts of different old shards meet only if
their blocks go to one new shard, since joining them would move more bytes than the flow.

The flow is solved over shards (hundreds of nodes at most, by parameter) and placement over
blocks (at most ``MOST_BLOCKS`` per old shard), never over documents. The texts are shuffled
once, to the files of the old shards; files are rewritten without a shuffle.

Defined results: a null text has 0 bytes and counts as equal to an empty one; texts of any
length stay whole, so shards differ by a block's length; repeated rows are rows of their own;
rows with a null doc_id are placed by their text; rows of one text and one doc_id share a
block, whatever their number; an empty table gives an empty result; other columns, whatever
their names, are written with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, free, shared_dir, table

#: Documents that a block of an old shard holds on average, and blocks of an old shard at least and at most.
BLOCK_ROWS, LEAST_BLOCKS, MOST_BLOCKS = 1_024, 1_024, 16_384
#: Groups of equal texts above this part of a new shard are split.
SPLIT = 32
#: Bytes of text in a written file, about, and files of a shard at least.
FILE_BYTES, LEAST_FILES = 128 << 20, 2
#: Files of an old shard at least.
OLD_FILES = 8


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[float]]) -> list[list[int]]:
    """Units to send from each source to each sink at the least cost, by shortest augmenting paths.

    The capacities must hold the whole supply. Paths are found with Dijkstra's method over
    reduced costs (node potentials), so costs must not be negative.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities do not hold the supply")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    up, vp = [0.0] * n, [0.0] * m  # potentials of sources and sinks
    for s in range(n):
        while left[s]:
            dist_u, dist_v = [float("inf")] * n, [float("inf")] * m
            from_u, from_v = [-1] * n, [-1] * m  # the sink before a source, the source before a sink
            dist_u[s] = 0.0
            open_u, open_v, target = set(range(n)), set(range(m)), -1
            while True:
                du = min(open_u, key=dist_u.__getitem__, default=-1)
                dv = min(open_v, key=dist_v.__getitem__, default=-1)
                a, b = dist_u[du] if du >= 0 else float("inf"), dist_v[dv] if dv >= 0 else float("inf")
                if b <= a:
                    if b == float("inf"):
                        break
                    open_v.discard(dv)
                    if room[dv]:
                        target = dv
                        break
                    for i in range(n):  # back along flow that can be undone
                        if flow[i][dv] and i in open_u and (x := b - (cost[i][dv] + up[i] - vp[dv])) < dist_u[i]:
                            dist_u[i], from_u[i] = x, dv
                else:
                    open_u.discard(du)
                    for j in range(m):
                        if j in open_v and (x := a + cost[du][j] + up[du] - vp[j]) < dist_v[j]:
                            dist_v[j], from_v[j] = x, du
            end = dist_v[target]
            for i in range(n):
                up[i] += min(dist_u[i], end)
            for j in range(m):
                vp[j] += min(dist_v[j], end)
            path, j = [], target
            while True:
                i = from_v[j]
                path.append((i, j, 1))
                if i == s:
                    break
                path.append((i, from_u[i], -1))
                j = from_u[i]
            amount = min(left[s], room[target], *(flow[i][j] for i, j, sign in path if sign < 0))
            for i, j, sign in path:
                flow[i][j] += sign * amount
            left[s] -= amount
            room[target] -= amount
    return flow


def transfers(old_sizes: Sequence[int], n_new: int) -> list[list[int]]:
    """Bytes from each old shard to each new one: equal capacities, the fewest bytes moved.

    Old shard i keeps its bytes in new shard i at no cost; a moved byte costs 1.
    """
    total = sum(old_sizes)
    capacity = [total * (j + 1) // n_new - total * j // n_new for j in range(n_new)]
    cost = [[0.0 if i == j else 1.0 for j in range(n_new)] for i in range(len(old_sizes))]
    return min_cost_flow(old_sizes, capacity, cost)


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8)).cast("long")


def text_crc(text: Column) -> Column:
    """Unsigned CRC-32 of a text's UTF-8 bytes."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")


def group_of(text: Column) -> Column:
    """What equal texts share."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


class Plan:
    """Where each block of the old shards goes: ``blocks(old, block, shard, start, n)`` and the flow."""

    def __init__(self, docs: DataFrame, old_shard: Column, n_old: int, n_new: int):
        self.docs, self.n_old, self.n_new = docs, n_old, n_new
        self.old = old_shard.cast("int")
        rows = docs.select(self.old.alias("old"), group_of(F.col("text")).alias("h"), F.col("doc_id").cast("long").alias("doc_id"), size_of(F.col("text")).alias("size"))
        groups = cut(rows.groupBy("old", "h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
        found = {r["old"]: r for r in groups.groupBy("old").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()}  # one row per old shard
        sizes = [int(found[i]["bytes"]) if i in found else 0 for i in range(n_old)]
        self.total, n = sum(sizes), sum(int(r["n"]) for r in found.values())
        self.flow = transfers(sizes, n_new)
        self.n_blocks = min(MOST_BLOCKS, max(LEAST_BLOCKS, n // (BLOCK_ROWS * n_old)))
        limit = max(1, self.total // (n_new * SPLIT))
        self.large = groups.where((F.col("bytes") > limit) & (F.col("n") > 1)).select(F.col("old").alias("_lo"), F.col("h").alias("_lh"), F.lit(True).alias("_large"))  # n_new * SPLIT rows at most
        small = groups.where((F.col("bytes") <= limit) | (F.col("n") == 1)).withColumn("block", self._block(F.lit(False), F.lit(0)))
        sums = small.groupBy("old", "block").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        if not self.large.isEmpty():
            split = rows.join(F.broadcast(self.large), (F.col("old") == F.col("_lo")) & (F.col("h") == F.col("_lh"))).withColumn("block", self._block(F.lit(True), F.col("doc_id")))
            split = split.groupBy("old", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
            sums = sums.unionByName(split).groupBy("old", "block").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        line = Window.partitionBy("old").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        middle = F.sum("bytes").over(line) - F.col("bytes") / 2
        placed = sums.withColumn("middle", middle).withColumn("shard", self._choice(F.col("old"), F.col("middle")))
        before = Window.partitionBy("shard").orderBy("old", "block").rowsBetween(Window.unboundedPreceding, -1)
        self.blocks = cut(placed.select("old", "block", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n"))

    def _block(self, large: Column, doc_id: Column) -> Column:
        key = F.when(large, F.xxhash64(F.coalesce(doc_id.cast("long"), F.lit(0)), F.lit(5))).otherwise(F.col("h"))
        return F.pmod(key, F.lit(self.n_blocks)).cast("int")

    def _choice(self, old: Column, middle: Column) -> Column:
        """The new shard of a block by the interval of its old shard's line that its middle lies in."""
        choice = F.lit(None).cast("int")
        for i in range(self.n_old):
            at, ends = 0, []
            for j in [i, *(j for j in range(self.n_new) if j != i)] if i < self.n_new else range(self.n_new):
                if self.flow[i][j]:
                    at += self.flow[i][j]
                    ends.append((at, j))
            if ends:
                inner = F.lit(ends[-1][1])
                for end, j in reversed(ends[:-1]):
                    inner = F.when(middle <= F.lit(end), F.lit(j)).otherwise(inner)
                choice = F.when(old == i, inner).otherwise(choice)
        return choice

    def affected(self) -> DataFrame:
        """``(shard)``: new shards, and old ones that gain or lose rows; at most n_new rows."""
        came = self.blocks.groupBy("shard").agg(F.count_if(F.col("shard") != F.col("old")).alias("came"))
        left = self.blocks.where("shard <> old").select(F.col("old").alias("shard")).distinct().withColumn("went", F.lit(True))
        return came.join(left, "shard", "left").where((F.col("came") > 0) | F.col("went").isNotNull() | (F.col("shard") >= self.n_old)).select("shard")

    def rows(self, only: DataFrame | None = None, without: bool = False, moved: bool | None = None) -> DataFrame:
        """All rows of ``docs`` with ``old_shard``, ``shard``, ``slot``, dealt by shard and file; ``only(shard)`` picks shards, or leaves them out; ``moved`` picks the blocks that move or those that stay."""
        docs = self.docs
        at, names = free(docs, "_at"), [c for c in docs.columns if c.lower() not in ("old_shard", "shard", "slot")]
        made = F.struct(self.old.alias("old"), group_of(F.col("text")).alias("h"), F.col("doc_id").cast("long").alias("doc_id"), size_of(F.col("text")).alias("size"))
        x = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), made.alias(at)).select("row", f"{at}.*")
        x = x.join(F.broadcast(self.large), (F.col("old") == F.col("_lo")) & (F.col("h") == F.col("_lh")), "left")
        x = x.withColumn("block", self._block(F.coalesce("_large", F.lit(False)), F.col("doc_id")))
        blocks = self.blocks
        if only is not None:
            blocks = blocks.join(F.broadcast(only), "shard", "left_anti" if without else "left_semi")
        if moved is not None:
            blocks = blocks.where("shard <> old" if moved else "shard = old")
        x = x.join(F.broadcast(blocks.select("old", "block", "shard", "start")), ["old", "block"])  # at most n_old * MOST_BLOCKS rows
        files = max(LEAST_FILES, -(-self.total // (self.n_new * FILE_BYTES)))
        # One task per file: the partition is the file's number, so no task gets two by chance.
        x = x.withColumn("file", (F.col("shard") * F.lit(files) + F.pmod(F.xxhash64("old", "block"), F.lit(files))).cast("int")).repartitionById(self.n_new * files, F.col("file"))
        inside = Window.partitionBy("shard", "file", "old", "block").orderBy("h", "doc_id")
        x = x.withColumn("slot", (F.col("start") + F.row_number().over(inside) - 1).cast("long"))
        return x.select("row.*", F.col("old").alias("old_shard"), F.col("shard").cast("int").alias("shard"), "slot")


def reshard(docs: DataFrame, old_shard: Column, n_old: int, n_new: int, target: str, everything: bool = True) -> tuple[DataFrame, list[list[int]]]:
    """Write the new shards of ``docs`` under ``target`` (one folder per shard) and return (what was written, flow).

    The written rows have the columns of ``docs`` and ``old_shard``, ``shard``, ``slot`` (in
    place of columns so called). With ``everything`` false only affected shards are written:
    new ones, and old ones that gain or lose rows.
    """
    plan = Plan(docs, old_shard, n_old, n_new)
    out = plan.rows(None if everything else plan.affected())
    out.write.partitionBy("shard").parquet(target)
    return docs.sparkSession.read.schema(out.schema).parquet(target), plan.flow


def rewrite(docs: DataFrame, old_shard: Column, n_old: int, n_new: int, target: str) -> tuple[DataFrame, list[list[int]]]:
    """Rewrite the affected shards under ``target`` and return (all rows in their new places, flow); the other shards are read where they are."""
    plan = Plan(docs, old_shard, n_old, n_new)
    affected = cut(plan.affected())
    out = plan.rows(affected)
    out.write.partitionBy("shard").parquet(target)
    written = docs.sparkSession.read.schema(out.schema).parquet(target).select(*out.columns)
    left = plan.blocks.join(F.broadcast(affected), "shard", "left_anti")
    return (written if left.isEmpty() else written.unionByName(plan.rows(affected, without=True))), plan.flow


def relocate(docs: DataFrame, old_shard: Column, n_old: int, n_new: int, target: str) -> tuple[DataFrame, list[list[int]]]:
    """Write what each new shard gains under ``target`` and return (all rows in their new places, flow); blocks that stay are read where they are."""
    plan = Plan(docs, old_shard, n_old, n_new)
    out = plan.rows(moved=True)
    out.write.partitionBy("shard").parquet(target)
    written = docs.sparkSession.read.schema(out.schema).parquet(target).select(*out.columns)
    return written.unionByName(plan.rows(moved=False)), plan.flow


def lay_out(docs: DataFrame, old_shard: Column, n_old: int, target: str, n_new: int | None = None) -> DataFrame:
    """Write the old shards under ``target``, a folder per shard, in files in the order of blocks, and return them as a table with ``old_shard``.

    Groups of equal texts that are dealt row by row in ``n_new`` shards (else in ``n_old``) lie dealt over the files.
    """
    plan = Plan(docs, old_shard, n_old, n_new or n_old)
    names = [c for c in docs.columns if c.lower() not in ("old_shard", "shard", "slot")]
    made = F.struct(plan.old.alias("old"), group_of(F.col("text")).alias("h"), F.col("doc_id").cast("long").alias("doc_id"))
    at = free(docs, "_at")
    x = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), made.alias(at)).select("row", f"{at}.*")
    x = x.join(F.broadcast(plan.large), (F.col("old") == F.col("_lo")) & (F.col("h") == F.col("_lh")), "left")
    files = max(OLD_FILES, -(-plan.total // (n_old * FILE_BYTES)))
    file = F.floor(plan._block(F.coalesce("_large", F.lit(False)), F.col("doc_id")).cast("long") * files / plan.n_blocks)
    x = x.withColumn("file", (F.col("old") * F.lit(files) + file).cast("int")).repartitionById(n_old * files, F.col("file"))
    out = x.select("row.*", F.col("old").alias("old_shard"))
    out.write.partitionBy("old_shard").parquet(target)
    return docs.sparkSession.read.schema(out.schema).parquet(target)


def rewrite_files(old: DataFrame, n_old: int, n_new: int, target: str) -> tuple[DataFrame, list[list[int]]]:
    """Rewrite the affected files of ``old``, a table of files with ``old_shard``, under ``target`` and return (all rows with ``shard`` and ``slot``, flow).

    A file is affected if a row of it moves. The other files are read where they are, and
    ``old`` itself stays as it is. A row's slot is its place in its file after the rows of the
    shard's files before.
    """
    spark, names = old.sparkSession, [c for c in old.columns if c != "old_shard"]
    plan = Plan(old, F.col("old_shard"), n_old, n_new)

    def placed(docs: DataFrame) -> DataFrame:
        made = F.struct(plan.old.alias("old"), group_of(F.col("text")).alias("h"), F.col("doc_id").cast("long").alias("doc_id"))
        x = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), made.alias("at"), F.col("_metadata.file_path").alias("path")).select("row", "path", "at.*")
        x = x.join(F.broadcast(plan.large), (F.col("old") == F.col("_lo")) & (F.col("h") == F.col("_lh")), "left")
        x = x.withColumn("block", plan._block(F.coalesce("_large", F.lit(False)), F.col("doc_id")))
        return x.join(F.broadcast(plan.blocks.select("old", "block", "shard")), ["old", "block"])  # at most n_old * MOST_BLOCKS rows

    by_file = placed(old).groupBy("path", "old").agg(F.max(F.col("shard") != F.col("old")).alias("affected")).collect()  # one row per file
    stay, cut_up = ([r for r in by_file if r["affected"] is what] for what in (False, True))
    base = by_file[0]["path"].rsplit("/old_shard=", 1)[0] if by_file else ""
    read = lambda rows: spark.read.schema(old.schema).option("basePath", base).parquet(*[r["path"] for r in rows]) if rows else old.where("false")
    moving = placed(read(cut_up))
    out = moving.select("row.*", F.col("old").alias("old_shard"), F.col("shard").cast("int").alias("shard"))
    out.write.partitionBy("shard").parquet(target)
    place = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row")]
    written = spark.read.schema(out.schema).parquet(target).select(*[F.col(f"`{c}`") for c in names], "old_shard", "shard", *place)
    kept = read(stay).select(*[F.col(f"`{c}`") for c in names], "old_shard", *place)
    rows = written.unionByName(kept.withColumn("shard", F.col("old_shard")))
    before = Window.partitionBy("shard").orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "_path").agg(F.count("*").alias("n")).select("_path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    rows = rows.join(F.broadcast(cut(starts)), "_path").withColumn("slot", (F.col("_start") + F.col("_row")).cast("long"))  # one row per file
    return rows.select(*[F.col(f"`{c}`") for c in names], "old_shard", "shard", "slot"), plan.flow


def old_layout(n_old: int) -> Column:
    """The layout that the query reshards: by text, so equal texts lie in one old shard, which a large group makes larger."""
    return F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(9)), F.lit(n_old))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: reshard all documents from 16 shards by text, which are written as files first, to 24 of equal bytes; affected files are rewritten."""
    import uuid

    root = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    old = lay_out(table(spark, sf_dir, "documents").select("doc_id", "text"), old_layout(16), 16, f"{root}/old", 24)
    placed, _ = rewrite_files(old, 16, 24, f"{root}/new")
    return placed.select(
        F.col("doc_id").cast("long"), size_of(F.col("text")).alias("size"), text_crc(F.col("text")).alias("text_crc32"),
        F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )
