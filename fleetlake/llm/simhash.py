"""SimHash near-duplicate groups with pigeonring filtering.

A text's fingerprint has 64 bits; two texts are linked when their fingerprints differ in at
most ``distance`` bits. The 64 bits are a ring of ``m = 4 * distance + 1`` segments. By the
pigeonring principle, if the differences over the ring are at most ``distance`` in total,
some segment starts a chain in which, for every length l, the first l segments hold at most
``l * distance / m`` differences. So the first four segments of that chain hold none: they
are an equality key of about 28 bits. Pairs that meet under a key must pass the budgets of
all longer chains before the full Hamming check.

Equal fingerprints become one class first, so thousands of copies cost one row. Keys that
hold more than ``chunk`` classes are dealt as pairs of chunks, so no task gets an unbounded
key and no pair is lost. A task returns a spanning forest of the links it finds, never all
pairs of a dense group.

:func:`similar_groups` links near copies of lower similarity by the same principle: its ring
has as many words as the differences ask for, each the SimHash fingerprint of one part of a
text's shingles (:func:`ring_rows`), and what it brings together is linked on the shingle
sets. :func:`wide_groups` is an estimate of those links from anchors and longer fingerprints.

Defined results: a null or empty text (or one of white space only) has fingerprint zero and
is linked like any other; a text of fewer words than ``shingle`` has one shingle, its whole
word sequence; rows with a null ``doc_id`` link like any other and join what they link, and get
a null component only if no row with an id is reachable; repeated rows stay and share a
component; an empty table gives an empty result; extra columns are ignored by
:func:`fingerprints`. In :func:`wide_groups` and :func:`similar_groups` texts that occur with
null ids alone link with nothing and have a null component, so no kept row rests on them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, free, merge_labels, table

SEED = 42
#: Wide sketches: 64-bit words of the fingerprint, anchors of a text, and least shingles joined in one anchor.
WIDE, ANCHORS, JOINED = 4, 10, 3
#: Bits in which near copies may differ: texts of similarity 0.8 (cosine 0.89) differ in 39 of 256, give or take 6.
WIDE_DISTANCE = 47
#: Words that a row of the ring of shingle parts carries after its key's, and rows that a task makes at a time, about.
TAIL, FLUSH = 16, 1 << 20
_UNKNOWN = np.uint64((1 << 4 * TAIL) - 1)
#: Least similarity of two linked texts, and the bits in which candidates for it may differ.
LEAST, CANDIDATE_DISTANCE = 0.8, 72
#: Shingle hashes of the texts that one task compares at a time, about (32 MB).
HELD = 1 << 22
#: Bytes of sets that stand for crowded parts and are broadcast at most.
PIVOT_BYTES = 32 << 20
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_ODD = (np.random.default_rng(SEED).integers(0, 1 << 63, WIDE + ANCHORS * JOINED, np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of a text, in blocks; nothing for a text without words."""
    import xxhash

    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower folds A-Z alone
    words = _WORDS.findall(data)
    if not words:
        return
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[len(words) - n :]
    digest, step = xxhash.xxh64_intdigest, 1 << 16
    for at in range(0, n, step):  # blocks keep the bit matrix small for very long texts
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + step)].tolist(), last[at : at + step].tolist())], np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text: bit j is 1 if it is set in over half of the shingle hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        ones, n = ones + _ones(hashes), n + len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The hashes of a text's distinct shingles in ascending order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(h) for h in shingle_hashes(text, shingle))]))


def set_digest(own: np.ndarray) -> bytes:
    """16 bytes that stand for a shingle set."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def text_sketch(text: str | None, shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Wide fingerprint (``WIDE`` words) and anchors of one text, see :func:`set_sketch`."""
    return set_sketch(shingle_set(text, shingle))


def set_sketch(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Wide fingerprint (``WIDE`` words) and anchors of one shingle set.

    The fingerprint's words are those of :func:`text_fingerprint` over remixed hashes. An
    anchor joins the least values of ``JOINED`` orders of the shingles: two texts agree in one
    with the probability similarity ** JOINED. A text without words has zeros.
    """
    if not len(own):
        return set_fingerprint(own), np.zeros(ANCHORS, np.uint64)
    least = np.array([(own * odd).min() for odd in _ODD[WIDE:]], np.uint64)
    anchors = np.zeros(ANCHORS, np.uint64)
    for part in least.reshape(ANCHORS, JOINED).T:
        anchors = _mix(anchors + part)
    return set_fingerprint(own), anchors


def set_fingerprint(own: np.ndarray) -> np.ndarray:
    """The wide fingerprint of one shingle set: zeros for an empty one."""
    ones = np.zeros((WIDE, 64), np.int64)
    for at in range(0, len(own), 1 << 16):
        for k in range(WIDE):
            ones[k] += _ones(_mix(own[at : at + (1 << 16)] * _ODD[k]))
    return np.packbits(2 * ones > len(own), axis=1, bitorder="little").view(np.uint64).ravel()


def ring_rows(own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys and tails of one shingle set on the rings of parts; sets of similarity ``least`` or more share a key.

    Sets of similarity t differ in at most (1 - t) / (1 + t) of their sizes together. A ring
    stands for the sizes below a power of two, and its m parts, into which a hash deals the
    shingles, are more than those differences. Two sets meet on the ring of the larger one. A
    set takes its parts that hold a shingle, in order, until they are one more than the
    differences it may have with any partner there. Of the set whose last such part comes
    first, one part at least is without a difference, and by the pigeonring principle one is
    followed by at most l - 1 differences in the next l - 1 parts, for every l. So each of
    these parts is a key, by its SimHash fingerprint, and the tail says of the ``TAIL`` next
    ones how many shingles they hold and one bit of their fingerprint, from which
    :func:`_tails_near` bounds the differences; 15 marks parts after the last one taken.

    A set with too few parts that hold a shingle takes them all. Two of those may share none,
    so they have each shingle as a key besides.
    """
    n, share = len(own), (1 - least) / (1 + least)
    keys, tails = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    largest = int(n / least + 1e-9)
    for level in range(n.bit_length(), largest.bit_length() + 1) if n else ():
        top = (1 << level) - 1
        most = int(share * (n + min(top, largest)) + 1e-9)
        m = int(np.ceil(2.3 * share * top)) + 2
        part = (((own * _ODD[0]) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        counts = np.bincount(part, minlength=m)
        filled = np.flatnonzero(counts)
        used, size = filled[: most + 1], counts[filled[: most + 1]]
        dealt, ends = own[np.argsort(part, kind="stable")], np.cumsum(size)
        words = []
        for at in range(0, len(used), 4096):
            starts = ends[at : at + 4096] - size[at : at + 4096]
            bits = np.unpackbits(dealt[starts[0] : ends[at : at + 4096][-1]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, starts - starts[0], axis=0, dtype=np.int64)
            words.append(np.packbits(2 * ones > size[at : at + 4096, None], axis=1, bitorder="little").view(np.uint64).ravel())
        word, sparse = np.concatenate(words), len(filled) <= most
        marks = np.full(m + TAIL + 1, 15, np.uint64)
        marks[: m if sparse else used[-1] + 1] = 0
        marks[used] = np.minimum(size, 6).astype(np.uint64) * np.uint64(2) + (_mix(word * _ODD[1]) & np.uint64(1))
        place = lambda k: _mix((np.asarray(k, np.uint64) + np.uint64(level << 40)) * _ODD[2])  # noqa: B023, E731
        keys.append(_mix(word ^ place(used)))
        tails.append(np.bitwise_or.reduce([marks[used + 1 + k] << np.uint64(4 * k) for k in range(TAIL)]))
        if sparse:
            keys.append(_mix(own ^ place([m])))
            tails.append(np.full(n, _UNKNOWN))
    return np.concatenate(keys), np.concatenate(tails)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row ``(doc_id, fp)`` per document; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((text_fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class Ring:
    """Segment widths, chain budgets and masks of the ring for one distance."""

    def __init__(self, distance: int):
        m = 4 * distance + 1 if distance else 1
        self.m, self.distance = m, distance
        edges = [64 * k // m for k in range(m + 1)]
        self.offsets = edges[:m]
        widths = [edges[k + 1] - edges[k] for k in range(m)]
        self.budgets = [length * distance // m for length in range(m + 1)]
        self.free = max(length for length in range(1, m + 1) if self.budgets[length] == 0)
        reach = [[sum(widths[(k + j) % m] for j in range(length)) for length in range(m + 1)] for k in range(m)]
        self.masks = np.array([[(1 << w) - 1 for w in row] for row in reach], dtype=np.uint64)


def ring_keys(classes: DataFrame, ring: Ring) -> DataFrame:
    """``classes(fp, id)`` once per chain start: the key is the fingerprint's difference-free first segments."""
    keys = []
    for k, off in enumerate(ring.offsets):
        turned = F.shiftrightunsigned("fp", off).bitwiseOR(F.shiftleft("fp", 64 - off)) if off else F.col("fp")
        keys.append(F.struct(F.lit(k).alias("start"), turned.bitwiseAND(F.lit(int(ring.masks[k][ring.free].view(np.int64)))).alias("key")))
    return classes.select("fp", "id", F.explode(F.array(*keys)).alias("k")).select("k.start", "k.key", "fp", "id")


def _forest(ids: np.ndarray, group: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray], labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside the groups (equal neighbours in ``group``).

    ``near(p, q)`` says which of the position pairs are links. Pairs that are already
    connected (``labels``, the least position of each set, may say so from the start) are not
    compared, and a group that is one component is left.
    """
    n, labels = len(ids), np.arange(len(ids)) if labels is None else labels
    at, d, first = np.arange(n), 0, np.searchsorted(group, group)
    while len(at):
        d += 1
        at = at[at < n - d]
        at = at[group[at] == group[at + d]]
        if d & (d - 1) == 0:  # at doubling distances
            whole = np.logical_and.reduceat(labels == labels[first], np.unique(first)) if n else np.zeros(0, bool)
            at = at[~whole[np.searchsorted(np.unique(first), first[at])]]
        open_ = at[labels[at] != labels[at + d]]
        if len(open_):
            fine = open_[near(open_, open_ + d)]
            labels = merge_labels(labels, fine, fine + d)
    child = np.flatnonzero(labels != np.arange(n))
    return ids[child], ids[labels[child]]


def _ring_near(start: np.ndarray, fp: np.ndarray, ring: Ring) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The chain budgets of the ring, then the full Hamming check."""
    offsets = np.array(ring.offsets, np.uint64)

    def near(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        off = offsets[start[p]]
        x = fp[p] ^ fp[q]
        x = np.where(off == 0, x, (x >> off) | (x << (np.uint64(64) - np.where(off == 0, np.uint64(1), off))))
        left = np.arange(len(p))
        for length in range(ring.free + 1, ring.m + 1):
            left = left[np.bitwise_count(x[left] & ring.masks[start[p[left]], length]) <= ring.budgets[length]]
            if not len(left):
                break
        out = np.zeros(len(p), bool)
        out[left] = np.bitwise_count(x[left]) <= ring.distance
        return out

    return near


def _tails_near(tail: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The chain budgets of the ring of parts: at most l - 1 differences in the l - 1 parts after the key's.

    A part differs by its counts at least, and by two if these agree and the bits do not;
    counts stop at 6.
    """

    def near(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        left, apart = np.arange(len(p)), np.zeros(len(p), np.int64)
        for k in range(TAIL):
            a, b = ((tail[x[left]] >> np.uint64(4 * k) & np.uint64(15)).astype(np.int64) for x in (p, q))
            counts = np.abs((a >> 1) - (b >> 1))
            bits = np.where(a == b, 0, np.where(a >> 1 == 6, 1, 2))
            apart += np.where((a == 15) | (b == 15), 0, np.where(counts > 0, counts, bits))
            fine = apart <= k + 1
            left, apart = left[fine], apart[fine]
        out = np.zeros(len(p), bool)
        out[left] = True
        return out

    return near


def _wide_near(fps: list[np.ndarray], distance: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The Hamming distance over all words."""
    return lambda p, q: sum(np.bitwise_count(x[p] ^ x[q]).astype(np.int32) for x in fps) <= distance


def _grouped_links(keyed: DataFrame, fps: list[str], near: Callable[[np.ndarray, list[np.ndarray]], Callable[[np.ndarray, np.ndarray], np.ndarray]], chunk: int) -> DataFrame:
    """Edges ``(a, b)`` of ``keyed(start, key, <fps>, id)``: a spanning forest of the links under each key.

    Keys of more than ``chunk`` rows are dealt as pairs of chunks. ``near(start, words)``
    gives the test of position pairs.
    """
    crowded = keyed.groupBy("start", "key").count().where(F.col("count") > chunk).select("start", "key", F.ceil(F.col("count") / (chunk / 2)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(*fps, F.lit(17)), F.col("parts")).cast("int")
    dealt = (
        keyed.join(crowded, ["start", "key"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("start", "key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), *fps, "id")
    )

    def found(t: pa.Table, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = [np.ascontiguousarray(t.column(c).to_numpy()).view(np.uint64) for c in fps]
        return _forest(t.column("id").to_numpy(), group, near(t.column("start").to_numpy(), words))

    return _links_by_group(dealt, ["start", "key", "lo", "hi"], found)


def _links_by_group(dealt: DataFrame, cols: list[str], found: Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Edges ``(a, b)`` that ``found(rows, group)`` gives over whole groups of equal ``cols``."""

    def marks(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for x in (t.column(c).to_numpy() for c in cols):
            new[1:] |= x[1:] != x[:-1]
        return new

    def edges(t: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        a, b = found(t, group)
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            new = marks(t)
            last = int(np.flatnonzero(new)[-1]) if new.any() else 0  # the open group waits for the next batch
            rest = t.slice(last)
            if last:
                yield edges(t.slice(0, last), np.cumsum(new[:last]))
        if rest is not None and rest.num_rows:
            yield edges(rest, np.cumsum(marks(rest)))

    return dealt.repartition(*cols).sortWithinPartitions(*cols).mapInArrow(run, "a long, b long")


def fingerprint_links(classes: DataFrame, distance: int = 2, chunk: int = 4096) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly what Hamming distance <= ``distance`` connects.

    ``classes`` holds distinct fingerprints: ``fp`` long and ``id`` long. The edges are a
    spanning forest of each key's links, not all links.
    """
    ring = Ring(distance)
    return _grouped_links(ring_keys(classes, ring), ["fp"], lambda start, words: _ring_near(start, words[0], ring), chunk)


def near_duplicates(docs: DataFrame, distance: int = 2, shingle: int = 3) -> DataFrame:
    """One row ``(doc_id, fp, component_id)`` per document; the component is the least doc_id reachable by links."""
    marked = cut(fingerprints(docs, shingle))
    # A fingerprint is its class's node: classes without any id still join others.
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).withColumn("id", F.col("fp")))
    found = connected_components(fingerprint_links(classes, distance))
    joined = classes.join(found, classes.fp == found.node, "left").select("fp", "doc_id", F.coalesce("component", "fp").alias("root"))
    named = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component = joined.join(named, "root").select("fp", "component_id")
    return marked.join(component, "fp", "left").select("doc_id", "fp", "component_id")


_FPS = [f"f{k}" for k in range(WIDE)]


def _sketched(docs: DataFrame, shingle: int, anchored: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, mark, digest, <fps>, anchors)`` per document, and one row per shingle set; anchors are null unless ``anchored``.

    ``mark`` is a hash of the text, which tells apart texts of one doc_id. A class, a shingle
    set that occurs under some doc_id, has a number ``id`` of its own (fixed as the table is
    written) and ``first``, the least (doc_id, mark) that it occurs under.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for t in batch.column(1):
                own = shingle_set(t.as_py(), shingle)
                made.append((*(set_sketch(own) if anchored else (set_fingerprint(own), None)), set_digest(own)))
            words = np.array([m[0] for m in made], np.uint64).reshape(-1, WIDE).view(np.int64)
            held = pa.array([None if m[1] is None else m[1].view(np.int64) for m in made], pa.list_(pa.int64()))
            digests = pa.array([m[2] for m in made], pa.binary())
            yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(2), digests, *(pa.array(words[:, k]) for k in range(WIDE)), held], names=["doc_id", "mark", "digest", *_FPS, "anchors"])

    schema = "doc_id long, mark long, digest binary, " + ", ".join(f"{f} long" for f in _FPS) + ", anchors array<long>"
    marked = cut(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(run, schema))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark")))
    return marked, cut(marked.groupBy("digest", *_FPS, "anchors").agg(first.alias("first")).where("first is not null").withColumn("id", F.monotonically_increasing_id()))


def _wide_links(classes: DataFrame, distance: int, chunk: int) -> DataFrame:
    """Edges that connect what agrees in an anchor and differs in at most ``distance`` bits."""
    keyed = classes.select(*_FPS, "id", F.posexplode("anchors").alias("start", "key"))
    # alone under a key: nothing to compare
    shared = keyed.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1").select("start", "key")
    return _grouped_links(keyed.join(shared, ["start", "key"]), _FPS, lambda _, words: _wide_near(words, distance), chunk)


def _node(digest: bytes) -> int:
    """The number under which a shingle set meets others on the ring; two sets that share one only become candidates."""
    return int.from_bytes(digest[:8], "big", signed=True)


def _ring_links(docs: DataFrame, least: float, shingle: int, chunk: int) -> DataFrame:
    """Edges between nodes (:func:`_node`) that connect at least what has a similarity of ``least`` or more.

    Rows that share a key of :func:`ring_rows` must pass the budgets of the longer chains. Under
    a key of more than ``chunk`` rows all are tied to one of them; a task that makes more than
    ``chunk`` / 16 of a key ties them first and sends one on, so no key fills a task.
    """
    crowd = max(1, chunk // 16)

    def packed(held: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        node = np.repeat(np.array([h[0] for h in held], np.int64), [len(h[1]) for h in held])
        key, tail = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        _, first, inverse, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        many = np.flatnonzero(counts[inverse] > crowd)
        if len(many):
            heads = first[counts > crowd]
            head_key, head_node = key[heads], node[heads]
            own_first = node[first[inverse[many]]].view(np.uint64)
            key[many], tail[many] = _mix(key[many] ^ _mix(own_first * _ODD[3])), _UNKNOWN
            key, node, tail = np.concatenate([key, head_key]), np.concatenate([node, head_node]), np.concatenate([tail, np.full(len(heads), _UNKNOWN)])
        for at in range(0, len(key), 1 << 16):
            cols = (x[at : at + (1 << 16)] for x in (key.view(np.int64), node, tail.view(np.int64)))
            yield pa.record_batch([pa.array(x) for x in cols], names=["key", "node", "tail"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for batch in batches:
            for t in batch.column(0):
                own = shingle_set(t.as_py(), shingle)
                digest = set_digest(own)
                if not len(own) or digest in seen:
                    continue
                seen.add(digest)
                held.append((_node(digest), *ring_rows(own, least)))
                size += len(held[-1][1])
                if size >= FLUSH:
                    yield from packed(held)
                    held, size, seen = [], 0, set()
        if held:
            yield from packed(held)

    def found(t: pa.Table, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        several = np.flatnonzero(np.bincount(group)[group] > 1)
        node, tail = (t.column(c).to_numpy()[several] for c in ("node", "tail"))
        group = group[several]
        order = np.lexsort((tail, node, group))
        node, tail, group = node[order], tail[order], group[order]
        new = np.ones(len(group), bool)  # copies of a text made in several batches
        new[1:] = (group[1:] != group[:-1]) | (node[1:] != node[:-1]) | (tail[1:] != tail[:-1])
        node, tail, group = node[new], tail[new].view(np.uint64), group[new]
        crowded = np.bincount(group)[group] > chunk if len(group) else np.zeros(0, bool)
        return _forest(node, group, _tails_near(tail), np.where(crowded, np.searchsorted(group, group), np.arange(len(group))))

    keyed = docs.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(rows, "key long, node long, tail long")
    return _links_by_group(keyed, ["key"], found)


def _components(marked: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """``(doc_id, mark, kept)`` per document: ``kept`` is the least (doc_id, mark) of its component, null for texts without ids."""
    found = connected_components(links)
    joined = classes.join(found, classes.id == found.node, "left").select("digest", "first", F.coalesce("component", "id").alias("root"))
    kept = joined.join(joined.groupBy("root").agg(F.min("first").alias("kept")), "root").select("digest", "kept")
    return marked.join(kept, "digest", "left").select("doc_id", "mark", "kept")


def wide_groups(docs: DataFrame, distance: int = WIDE_DISTANCE, shingle: int = 5, chunk: int = 4096) -> DataFrame:
    """One row ``(doc_id, component_id)`` per document, by an estimate of the similarity.

    Two texts are linked when they agree in an anchor and their wide fingerprints differ in at
    most ``distance`` bits. At such a distance the difference-free segments of a pigeonring
    chain hold five or six bits, which would compare a fixed share of all pairs; so anchors
    bring candidates together here. Texts of similarity 0.8 miss each other in every anchor
    with probability 0.001. Null ids, empty texts and repeated rows as in :func:`near_duplicates`.
    """
    marked, classes = _sketched(docs, shingle)
    return _components(marked, classes, _wide_links(classes, distance, chunk)).select("doc_id", F.col("kept.doc_id").alias("component_id"))


def _refined(rows: DataFrame, least: float) -> DataFrame:
    """``(id, part)``: ``rows(component, id, n, own)`` in parts of their groups outside of which they have no partner; rows without any are left out.

    Take the shingles of each set from the rarest of the group to the most frequent one. Two
    sets of similarity t or more have t / (1 + t) of their sizes together in common, so the
    first n - ceil(2 t n / (1 + t)) + 1 shingles of the smaller set and the first
    n - ceil(t n) + 1 of the larger one share one (prefix filtering; Bayardo et al., "Scaling
    Up All Pairs Similarity Search", 2007). Texts that have a frequent passage in common and
    are less alike differ in rare shingles, which fill the prefixes and are shared by none, so
    such a group falls apart at a cost that grows with its size alone.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                h = np.frombuffer(batch.column(3)[k].as_py(), np.uint64).view(np.int64)
                yield pa.record_batch([pa.repeat(batch.column(c)[k], len(h)) for c in range(3)] + [pa.array(h)], names=["component", "id", "n", "h"])

    shingles = rows.select("component", "id", "n", "own").mapInArrow(each, "component long, id long, n long, h long")
    shared = shingles.groupBy("component", "h").agg(F.count("*").alias("texts")).where("texts > 1")
    own = shingles.join(shared, ["component", "h"]).groupBy("component", "id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("texts", "h"))).alias("common"))
    # Shingles of one text alone come first and take up places.
    alone = F.col("n") - F.size("common")
    places = lambda share: (F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1 - alone).cast("int")
    own = own.withColumn("places", places(least)).withColumn("inner", places(2 * least / (1 + least))).where("places > 0")
    prefix = own.select("component", "id", "inner", F.posexplode(F.slice("common", F.lit(1), F.col("places"))).alias("at", "c"))
    prefix = cut(prefix.select("component", "id", "c.h", (F.col("at") < F.col("inner")).alias("short")))
    one = prefix.groupBy("component", "h").agg(F.min(F.when(F.col("short"), F.col("id"))).alias("b"), F.count("*").alias("texts")).where("texts > 1 AND b is not null")
    parts = connected_components(prefix.join(one, ["component", "h"]).select(F.col("id").alias("a"), "b"))
    return parts.select(F.col("node").alias("id"), F.col("component").alias("part"))


def _exact_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, least: float, distance: int, shingle: int, held: int) -> DataFrame:
    """Edges inside the candidate ``groups(node, component)``, by :func:`_node`, whose shingle sets have a similarity of ``least`` or more.

    A group's texts meet once, whatever keys brought them together. Groups of more than
    ``held`` hashes first fall into the parts of :func:`_refined`. In a part that is still as
    large each text is held against one of them; what is linked to that one is connected, and
    only the others then meet the whole part, dealt as pairs of chunks. So a large group of
    near copies costs one pass, and one that shares a frequent passage costs no pairs.
    """
    node = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    wanted = classes.withColumn("node", node).join(groups, "node").select("id", "component", "first.*", F.col("digest").alias("want"), *_FPS)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
            fits = pa.array([set_digest(s) == w.as_py() for s, w in zip(own, batch.column("want"))], pa.bool_())  # two texts of an id can share a mark
            rest = batch.select(["component", "id", *_FPS])
            yield pa.record_batch([*rest.columns, pa.array([len(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], names=[*rest.schema.names, "n", "own"]).filter(fits)

    own_text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    if own_text.where("doc_id is not null").groupBy("doc_id", "mark").count().where("count > 1").limit(1).count():
        own_text = own_text.dropDuplicates(["doc_id", "mark"])
    texts = own_text.join(wanted, ["doc_id", "mark"]).select("component", "id", "want", *_FPS, "text")
    row = "component long, id long, " + ", ".join(f"{f} long" for f in _FPS) + ", n long, own binary"
    rows = cut(texts.mapInArrow(sets, row))

    def found(t: pa.Table, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("own")]
        size = np.array([len(x) for x in own])
        bits = _wide_near([np.ascontiguousarray(t.column(c).to_numpy()).view(np.uint64) for c in _FPS], distance)

        def near(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            out = bits(p, q) & (np.minimum(size[p], size[q]) >= least * np.maximum(size[p], size[q]))
            at = np.flatnonzero(out)
            out[at] = [similarity(own[i], own[j]) >= least for i, j in zip(p[at].tolist(), q[at].tolist())]
            return out

        tied = t.column("tied").to_numpy(zero_copy_only=False).astype(bool)
        labels, first = np.arange(len(own)), {}
        for k in np.flatnonzero(tied).tolist():  # one set per group from the start
            labels[k] = first.setdefault(int(group[k]), k)
        return _forest(t.column("id").to_numpy(), group, near, labels)

    parts = lambda c: F.ceil(F.col(c) / (held / 2)).cast("int")
    sums = lambda x: cut(x.groupBy("component").agg(F.sum("n").alias("total"), F.min("id").alias("pivot")).where(F.col("total") > held))
    plain = lambda x: x.select(*rows.columns, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("tied"))
    crowded = sums(rows)
    whole = plain(rows.join(crowded.select("component"), "component", "left_anti"))
    if crowded.isEmpty():
        return _links_by_group(whole, ["component", "i", "j"], found)
    large = rows.join(crowded.select("component"), "component", "left_semi")
    rows = cut(large.join(_refined(large, least), "id").withColumn("component", F.col("part")).select(*rows.columns))
    crowded = sums(rows)
    whole = whole.unionByName(plain(rows.join(crowded.select("component"), "component", "left_anti")))
    if crowded.isEmpty():
        return _links_by_group(whole, ["component", "i", "j"], found)
    # First pass over crowded parts: each text against the part's first one.
    kept = [*rows.columns, "pivot"]
    pivots = rows.join(crowded, (rows.component == crowded.component) & (F.col("id") == F.col("pivot"))).groupBy(crowded.component, "pivot").agg(F.first("own").alias("pivot_own"))

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = [similarity(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)) >= least for a, b in zip(batch.column("own"), batch.column("pivot_own"))]
            rest = batch.select(kept)
            yield pa.record_batch([*rest.columns, pa.array(close, pa.bool_())], names=[*rest.schema.names, "tied"])

    pivots = cut(pivots)
    small = pivots.agg(F.sum(F.octet_length("pivot_own") + 64)).first()[0] <= PIVOT_BYTES
    large = cut(rows.join(F.broadcast(pivots) if small else pivots, "component").mapInArrow(tie, row + ", pivot long, tied boolean"))
    stars = large.where("tied AND id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    # Second pass: the others against all of their group.
    sizes = large.groupBy("component").agg(F.sum("n").alias("all"), F.sum(F.when(~F.col("tied"), F.col("n")).otherwise(0)).alias("loose"))
    x = large.join(sizes.where("loose > 0").select("component", parts("all").alias("all"), parts("loose").alias("loose")), "component")
    one, every = F.pmod(F.xxhash64("id", F.lit(17)), F.col("loose")).cast("int"), F.pmod(F.xxhash64("id", F.lit(19)), F.col("all")).cast("int")
    left = x.where("NOT tied").select(*rows.columns, one.alias("i"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"), "tied")
    right = x.select(*rows.columns, F.explode(F.sequence(F.lit(0), F.col("loose") - 1)).alias("i"), every.alias("j"), "tied")
    return _links_by_group(whole.unionByName(left).unionByName(right), ["component", "i", "j"], found).unionByName(stars)


def _similar(docs: DataFrame, least: float, shingle: int, chunk: int, held: int) -> DataFrame:
    """``(doc_id, mark, kept)`` as in :func:`_components`; links have a similarity of ``least`` or more.

    The pigeonring (:func:`_ring_links`) finds groups of candidates and misses none; inside
    each, pairs whose wide fingerprints differ in at most ``CANDIDATE_DISTANCE`` bits are linked
    on their shingle sets (64-bit hashes). A pair of similarity 0.8 is missed by the bits with a
    probability of 0.0001 at most (4 against 5 shingles, the worst case).
    """
    marked, classes = _sketched(docs, shingle, anchored=False)
    groups = connected_components(_ring_links(docs, least, shingle, chunk))
    return _components(marked, classes, _exact_links(docs, classes, groups, least, CANDIDATE_DISTANCE, shingle, held))


def similar_groups(docs: DataFrame, least: float = LEAST, shingle: int = 5, chunk: int = 4096, held: int = HELD) -> DataFrame:
    """``(doc_id, component_id)``, one row per document: the least doc_id of its :func:`_similar` component."""
    return _similar(docs, least, shingle, chunk, held).select("doc_id", F.col("kept.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, least: float = LEAST, shingle: int = 5, chunk: int = 4096, held: int = HELD) -> DataFrame:
    """The documents without near copies: of each group the text with the least doc_id stays, once.

    Rows without a doc_id stay. Of rows with one doc_id, equal texts and near copies stay
    once, and each text that is like no other stays.
    """
    groups = _similar(docs, least, shingle, chunk, held)
    own, mark = free(docs, "_id"), free(docs, "_mark")
    kept = groups.where((F.col("doc_id") == F.col("kept.doc_id")) & (F.col("mark") == F.col("kept.mark"))).select(F.col("doc_id").alias(own), F.col("mark").alias(mark)).distinct()
    x = docs.where(F.col("doc_id").isNotNull()).withColumn(own, F.col("doc_id").cast("long")).withColumn(mark, F.xxhash64("text"))
    x = x.join(kept, [own, mark], "left_semi").dropDuplicates([own, mark])
    return x.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
