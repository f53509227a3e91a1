"""Benchmark decontamination: token windows of training texts against a broadcast set of test n-grams.

Texts are lower-cased (A-Z) and split into words of digits, letters and characters beyond
ASCII. Every run of ten words of a test item is one of its n-grams; an item of fewer words is
one n-gram as a whole. The different n-grams go to all tasks as sorted 64-bit hashes with
their words and items. A task hashes the words of its texts and all their windows in numpy
over the UTF-8 bytes, looks the hashes up (a small bit table first) and verifies each hit
word by word. Documents are neither shuffled nor read twice.

The set is broadcast up to ``SET_BYTES``, which is measured. Beyond, tasks hold a bit table of
fixed size (32 MB) in its place; windows whose bit is set meet the n-grams by an equi-join on
their words, which verifies them, and what is found returns to the document's row.

Memory: a text takes about five times its bytes while it is scanned; words and texts of any
length are read whole, in blocks.

Defined results: a null or empty text has no words and no hits; an item without words or
without an id has no n-grams; repeated items count once; repeated documents are judged alike;
empty tables give empty or unmarked results; columns of ``docs``, whatever their names, pass
through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import cut, free, table

SPAN = 10
#: Bytes of n-grams, with 16 for each item of one, that are broadcast at most.
SET_BYTES = 48 << 20
#: Bits of the table that stands for a larger set, as a power of two.
TABLE_BITS = 28
#: Bytes that are hashed at once.
BLOCK = 1 << 20
MASK = (1 << 64) - 1
#: Odd multipliers of word and window hashes, and the inverse of the first.
STEP, WIDE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
BACK = pow(STEP, -1, 1 << 64)

#: What a byte stands for: itself, its small letter, or 0 if it is of no word.
LETTER = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of STEP and of its inverse for each place of a block."""
    if not _POWERS:
        for base in (STEP, BACK):
            p = np.full(BLOCK, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p))
    return _POWERS


def tokens(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word in UTF-8 bytes; texts begin at ``firsts``, and no word crosses into the next one."""
    power, back = _powers()
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    open_ = False
    for at in range(0, len(data), BLOCK):
        b = LETTER[data[at : at + BLOCK]]
        inside = b != 0
        begins = np.zeros(len(b) + 1, bool)
        lo, hi = np.searchsorted(firsts, (at, at + len(b)))
        begins[firsts[lo:hi] - at] = True
        before, after = np.concatenate(([False], inside[:-1])), np.concatenate((inside[1:], [False]))
        s = np.flatnonzero(inside & (~before | begins[:-1]))
        e = np.flatnonzero(inside & (~after | begins[1:])) + 1
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(b * power[: len(b)], dtype=np.uint64)))
        h = (sums[e] - sums[s]) * back[s]
        s, e = s + at, e + at
        if open_ and inside[0] and not begins[0]:  # the block before ends within this word
            ph, ps, pe = parts[-1]
            ph[-1] = (int(ph[-1]) + int(h[0]) * pow(STEP, int(pe[-1] - ps[-1]), 1 << 64)) & MASK
            pe[-1] = e[0]
            h, s, e = h[1:], s[1:], e[1:]
        open_ = bool(inside[-1])
        if len(h):
            parts.append((h, s, e))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, s, e = (np.concatenate(x) for x in zip(*parts))
    return h ^ (h >> np.uint64(29)), s, e


def windows(h: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """``(n, hashes of all runs of n words)`` for each of the lengths, shortest first."""
    total = np.zeros(len(h), np.uint64)
    for j in range(max(lengths, default=0)):
        if j >= len(h):
            return
        total[: len(h) - j] += h[j:] * np.uint64(pow(WIDE, j + 1, 1 << 64))
        if j + 1 in lengths:
            w = total[: len(h) - j] * np.uint64(STEP)
            yield j + 1, w ^ (w >> np.uint64(32))


def gram(data: np.ndarray, s: np.ndarray, e: np.ndarray, at: int, n: int) -> bytes:
    """The n words from word ``at`` on, small, with a space between."""
    return b" ".join(data[s[k] : e[k]].tobytes().lower() for k in range(at, at + n))


@dataclass
class GramSet:
    """All n-grams of a benchmark: by length their sorted hashes, then words and items of each by position."""

    hashes: dict[int, np.ndarray]
    at: dict[int, int]  # position of a length's first n-gram
    blob: bytes
    ends: np.ndarray
    item_ends: np.ndarray
    codes: np.ndarray
    items: list[str]

    def __post_init__(self) -> None:
        self.lengths = sorted(self.hashes)
        self.bits = {}
        for n, own in self.hashes.items():
            shift = np.uint64(64 - min(24, max(16, len(own).bit_length() + 5)))
            seen = np.zeros(1 << (64 - int(shift)), bool)
            seen[own >> shift] = True
            self.bits[n] = shift, seen

    def hits(self, data: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(word, n, position)`` of each verified window; ``text`` says which text a word is in."""
        for n, w in windows(h, self.lengths):
            shift, seen = self.bits[n]
            for k in np.flatnonzero(seen[w >> shift] & (text[: len(w)] == text[n - 1 :])).tolist():
                own, found = self.hashes[n], None
                g = int(np.searchsorted(own, w[k]))
                while g < len(own) and own[g] == w[k]:
                    found = gram(data, s, e, k, n) if found is None else found
                    p = self.at[n] + g
                    if self.blob[self.ends[p] : self.ends[p + 1]] == found:
                        yield k, n, p
                    g += 1

    def items_of(self, positions: set[int]) -> list[str]:
        """Items that hold any of the n-grams, in order."""
        codes = {c for p in positions for c in self.codes[self.item_ends[p] : self.item_ends[p + 1]].tolist()}
        return [self.items[c] for c in sorted(codes)]


def gram_set(pairs: pa.Table) -> GramSet:
    """The set from ``pairs(n, h, gram, item)``, which has each pair of n-gram and item once."""
    rows = sorted(zip(*(pairs.column(c).to_pylist() for c in ("n", "h", "gram", "item"))), key=lambda r: (r[0], r[1] & MASK, r[2]))
    items = sorted({r[3] for r in rows})
    code = {x: k for k, x in enumerate(items)}
    grams, owners = [], []
    for n, h, g, item in rows:
        if not grams or grams[-1] != (n, h & MASK, g):
            grams.append((n, h & MASK, g))
            owners.append([])
        owners[-1].append(code[item])
    hashes, at = {}, {}
    for n in {g[0] for g in grams}:
        hashes[n] = np.array([h for m, h, _ in grams if m == n], np.uint64)
        at[n] = next(k for k, g in enumerate(grams) if g[0] == n)
    ends = lambda sizes: np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int64)
    return GramSet(hashes, at, b"".join(g for _, _, g in grams), ends([len(g) for _, _, g in grams]), ends([len(x) for x in owners]), np.array([c for x in owners for c in x], np.int32), items)


def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, where each text begins and the last ends)`` for runs of texts of about a block, or one longer text."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    k = 0
    while k < n:
        to = max(k + 1, int(np.searchsorted(offs, offs[k] + BLOCK, "right")) - 1)
        yield k, data[offs[k] : offs[to]], offs[k : to + 1] - offs[k]
        k = to


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and text of each word."""
    h, s, e = tokens(data, bounds[:-1])
    return h, s, e, np.searchsorted(bounds, s, "right") - 1


def spans(s: np.ndarray, e: np.ndarray, first: int, hit: np.ndarray) -> list[dict]:
    """Runs of hit words of one text as byte ranges within it; ``first`` is where the text begins."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return [{"start": int(s[a] - first), "stop": int(e[b - 1] - first)} for a, b in zip(edge[::2], edge[1::2])]


FOUND = "struct<n_words: bigint, n_hit: bigint, items: array<string>, spans: array<struct<start: bigint, stop: bigint>>>"
MAYBE = "struct<n_words: bigint, maybe: array<struct<at: bigint, n: int, gram: binary>>>"
HITS = "struct<n_hit: bigint, spans: array<struct<start: bigint, stop: bigint>>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _scan(known: Callable[[], GramSet]) -> Callable:
    """Per text: words, hit words, items and spans, with the set that ``known`` gives."""

    def run(text: pa.Array) -> pa.Array:
        grams, out = known(), []
        for _, data, bounds in pieces(text):
            h, s, e, own = words_of(data, bounds)
            counts = np.bincount(own, minlength=len(bounds) - 1)
            hit, found = np.zeros(len(h) + 1, np.int64), {}
            for k, n, p in grams.hits(data, h, s, e, own):
                hit[k] += 1
                hit[k + n] -= 1
                found.setdefault(int(own[k]), set()).add(p)
            hit = np.cumsum(hit)[:-1] > 0
            ends = np.cumsum(counts)
            for t, n in enumerate(counts.tolist()):
                if t in found:
                    x = slice(int(ends[t]) - n, int(ends[t]))
                    out.append((n, int(hit[x].sum()), grams.items_of(found[t]), spans(s[x], e[x], int(bounds[t]), hit[x])))
                else:
                    out.append((n, 0, [], []))
        n, hits, items, cuts = zip(*out) if out else ((), (), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(cuts, _SPANS)], names=["n_words", "n_hit", "items", "spans"])

    return run


def _maybe(lengths: list[int], bits: Callable[[], np.ndarray]) -> Callable:
    """Per text: words, and the windows whose bit is set."""

    def run(text: pa.Array) -> pa.Array:
        seen, counts, out = bits(), [], []
        for _, data, bounds in pieces(text):
            h, s, e, own = words_of(data, bounds)
            own_counts = np.bincount(own, minlength=len(bounds) - 1)
            rows: list[list[dict]] = [[] for _ in own_counts]
            begin = np.cumsum(own_counts) - own_counts
            for n, w in windows(h, lengths):
                slot = w >> np.uint64(64 - TABLE_BITS)
                set_ = (seen[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
                for k in np.flatnonzero((set_ == 1) & (own[: len(w)] == own[n - 1 :])).tolist():
                    rows[own[k]].append({"at": k - int(begin[own[k]]), "n": n, "gram": gram(data, s, e, k, n)})
            counts += own_counts.tolist()
            out += rows
        kind = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int32()), ("gram", pa.binary())]))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(out, kind)], names=["n_words", "maybe"])

    return run


def _settle(text: pa.Array, hits: pa.Array) -> pa.Array:
    """Hit words and spans of texts from their verified windows (word, n)."""
    counts, cuts, hits = [], [], hits.to_pylist()
    for row, data, bounds in pieces(text):
        _, s, e, own = words_of(data, bounds)
        for t in range(len(bounds) - 1):
            x = slice(*np.searchsorted(own, (t, t + 1)).tolist())
            mark = np.zeros(x.stop - x.start, bool)
            for v in hits[row + t] or ():
                mark[v["at"] : v["at"] + v["n"]] = True
            counts.append(int(mark.sum()))
            cuts.append(spans(s[x], e[x], int(bounds[t]), mark))
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(cuts, _SPANS)], names=["n_hit", "spans"])


def grams_of(benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """``(n, h, gram, item)``: each pair of an n-gram of ``benchmark(item_id, text)`` and an item once."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            items = batch.column(0).to_pylist()
            for row, data, bounds in pieces(batch.column(1)):
                h, s, e, own = words_of(data, bounds)
                for t in range(len(bounds) - 1):
                    a, b = np.searchsorted(own, (t, t + 1)).tolist()
                    n = min(span, b - a)
                    for _, w in windows(h[a:b], [n] if n else []):
                        for lo in range(0, len(w), 10_000):
                            part = w[lo : lo + 10_000].view(np.int64)
                            texts = [gram(data, s, e, a + lo + k, n) for k in range(len(part))]
                            yield pa.record_batch([pa.array([n] * len(part), pa.int32()), pa.array(part), pa.array(texts, pa.binary()), pa.array([items[row + t]] * len(part), pa.string())], names=["n", "h", "gram", "item"])

    known = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string"), "text")
    return known.mapInArrow(run, "n int, h bigint, gram binary, item string").distinct()


def bit_table(pairs: DataFrame) -> np.ndarray:
    """The fixed table: bit h >> (64 - TABLE_BITS) is set for each n-gram's hash h."""
    slot = F.shiftrightunsigned("h", 64 - TABLE_BITS) + 1
    rows = pairs.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    for r in rows.toLocalIterator():
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def scan(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, set_bytes: int = SET_BYTES, name: str = "found") -> DataFrame:
    """``docs(text, ...)`` with a struct column ``name``: n_words, n_hit, items (as text, in order) and spans (byte ranges of hit words)."""
    sc = docs.sparkSession.sparkContext
    pairs = cut(grams_of(benchmark, span))
    size = pairs.agg(F.coalesce(F.sum(F.octet_length("gram") + 16), F.lit(0))).first()[0]
    if size <= set_bytes:
        known = sc.broadcast(gram_set(pairs.toArrow()))
        return docs.withColumn(name, arrow_udf(_scan(lambda: known.value), FOUND)("text"))
    lengths = sorted(r["n"] for r in pairs.select("n").distinct().collect())  # 1 to span at most
    bits = sc.broadcast(bit_table(pairs))
    key, seen = free(docs, "_row"), free(docs, "_seen")
    x = cut(docs.withColumn(key, F.monotonically_increasing_id()).withColumn(seen, arrow_udf(_maybe(lengths, lambda: bits.value), MAYBE)("text")))
    each = x.select(F.col(key).alias("row"), F.explode(F.col(seen)["maybe"]).alias("w")).select("row", "w.*")
    hits = each.join(pairs.select("gram").distinct(), "gram", "left_semi").groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("hits"))
    items = each.select("row", "gram").distinct().join(pairs.select("gram", "item"), "gram").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = hits.join(items, "row").select(F.struct("row", "hits", "items").alias(hit := free(docs, "_hit")))
    x = x.join(found, F.col(key) == F.col(hit)["row"], "left")
    part = arrow_udf(_settle, HITS)
    x = x.withColumn(free(docs, "_part"), part("text", F.col(hit)["hits"]))
    own = F.col(free(docs, "_part"))
    out = F.struct(F.col(seen)["n_words"].alias("n_words"), own["n_hit"].alias("n_hit"), F.coalesce(F.col(hit)["items"], F.array().cast("array<string>")).alias("items"), own["spans"].alias("spans"))
    return x.withColumn(name, out).select(*docs.columns, name)


def without(text: Column, ranges: Column) -> Column:
    """``text`` without the given byte ranges (in order); texts without ranges stay as they are."""
    raw = F.encode(text, "UTF-8")
    start = F.lit(0).cast("bigint")
    piece = lambda a, to: F.substring(raw, (a["at"] + 1).cast("int"), (to - a["at"]).cast("int"))
    first = F.struct(start.alias("at"), F.encode(F.lit(""), "UTF-8").alias("kept"))
    rest = F.aggregate(ranges, first, lambda a, r: F.struct(r["stop"].alias("at"), F.concat(a["kept"], piece(a, r["start"])).alias("kept")), lambda a: F.concat(a["kept"], piece(a, F.octet_length(raw).cast("bigint"))))
    return F.when(F.size(ranges) > 0, F.decode(rest, "UTF-8")).otherwise(text)


def remove(docs: DataFrame, benchmark: DataFrame, by: str = "spans", least: int = 1, **options: int) -> DataFrame:
    """``docs`` without what the benchmark has: hit spans (``by="spans"``) or documents of ``least`` or more hit words (``by="documents"``)."""
    name = free(docs, "_found")
    x = scan(docs, benchmark, name=name, **options)
    if by == "documents":
        return x.where(F.col(name)["n_hit"] < least).select(*docs.columns)
    if by != "spans":
        raise ValueError("by is spans or documents")
    return x.withColumn("text", without(F.col("text"), F.col(name)["spans"])).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: words, hit words and items found in every document."""
    x = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    f = F.col("found")
    return x.select("doc_id", f["n_words"].alias("n_words"), f["n_hit"].alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", f["items"]), 256).alias("items_sha256"), (f["n_hit"] > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS (
  SELECT DISTINCT item, least({SPAN}, len(w)) AS n, unnest(list_transform(range(1, greatest(1, len(w) - {SPAN - 1}) + 1), lambda i: array_to_string(w[i:i + {SPAN - 1}], ' '))) AS gram
  FROM b WHERE len(w) > 0
), h AS (
  SELECT id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'at': i, 'gram': array_to_string(w[i:i + n - 1], ' ')}})) AS x
  FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n
), k AS (SELECT id, n, x.at AS spot, x.gram AS gram FROM h WHERE x.gram IN (SELECT gram FROM g)),
hit AS (SELECT id, count(DISTINCT word) AS n_hit FROM (SELECT id, unnest(range(spot, spot + n)) AS word FROM k) GROUP BY id),
own AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM k JOIN g USING (gram)) GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (id) LEFT JOIN own USING (id)
"""
