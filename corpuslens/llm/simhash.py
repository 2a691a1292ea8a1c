"""SimHash near-dedup by anchor-point covering.

A fingerprint's 64 bits are cut into parts, each with a threshold; the thresholds are such that two fingerprints with at
most 4 differing bits must meet the threshold in at least one part (their sum is 4 - parts + 1). In each part a covering
code gives the anchors: the bits are a word of a perfect Hamming code (covering radius 1) and a few free bits (radius 0).
Every fingerprint has one home anchor, its nearest codeword, and is replicated to every anchor within covering radius
plus threshold, so at the home anchor of one of a pair the other is present too. Fingerprints are compared per anchor, and
each anchor gives the edges of a spanning forest of its links, not all pairs. The forests of all anchors together have the
components of the whole link graph, which are found by large-star and small-star rounds on written tables.

An anchor with more than HOT_ROWS members isn't one task's: its members are dealt again by the bits outside the part, cut
into five segments, of which two fingerprints with at most 4 differing bits must share one. A group that is still larger is
cut into slices, and each pair of slices is compared by itself. Both are exact.

The layout of parts is chosen by the number of distinct fingerprints: a finer code has more anchors, with fewer
fingerprints at each. Any layout is exact.

Defined results: a null or empty text has fingerprint 0, linked like any other; equal fingerprints are one node; a
null doc_id counts for a component's smallest id only if no other is there (then the id is null); repeated rows give a
row each; an empty table gives an empty result; extra columns aren't looked at; texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small_arrow_batches, stored, table, text_key, text_of

SHINGLE, THRESHOLD = 4, 4
#: Shingles hashed at a time: 64 bits are spread to bytes for that many.
HASH_BLOCK = 16_384
#: Nodes of a task's union-find, and edges of a partition of them: some 30 MB of a Python worker. The last partition of all,
#: which isn't flushed, may have two nodes an edge.
FOREST_NODES, FOREST_EDGES = 200_000, 200_000
#: Members of an anchor that are compared by one task.
HOT_ROWS = 50_000


# --- fingerprints ---------------------------------------------------------------------------------------------------


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """The majority of each bit over the XXH64 of all shingles of `width` words; a tie gives 0, and so do no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    h64, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, HASH_BLOCK):
        hashes = np.array([h64(joined[a:b], 42) for a, b in zip(starts[k : k + HASH_BLOCK], ends[k : k + HASH_BLOCK], strict=True)], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """rid, doc_id, text_key, fp (the 64 bits as a signed long) of each row of docs (doc_id, text), written once."""
    small_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(3).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(fps)], ["rid", "doc_id", "text_key", "fp"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), text_key().alias("text_key"), text_of().alias("text"))
    return stored(rows.mapInArrow(run, "rid long, doc_id long, text_key long, fp long"), "fingerprints")


# --- anchors --------------------------------------------------------------------------------------------------------


class Part(NamedTuple):
    """Bits [low, low + 2**m - 1 + free) of a fingerprint: a Hamming word of 2**m - 1 bits (none for m = 0), then free bits."""

    low: int
    m: int
    free: int
    threshold: int

    @property
    def code(self) -> int:
        return (1 << self.m) - 1


#: Up to 2**26 distinct fingerprints: 29 rows each at most, 2**17, 2**17 and 2**22 anchors. Beyond: 190 rows, 2**27 anchors in each half.
FINE = 1 << 26
LAYOUTS = {
    "coarse": (Part(0, 4, 6, 1), Part(21, 4, 6, 1), Part(42, 0, 22, 0)),
    "fine": (Part(0, 5, 1, 1), Part(32, 5, 1, 2)),
}


def syndromes(words: np.ndarray, code: int) -> np.ndarray:
    """The Hamming syndrome: the exclusive or of the positions, from 1, of the bits that are set."""
    s = np.zeros(len(words), np.uint64)
    for i in range(code):
        s ^= ((words >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return s


def patterns(code: int, weight: int) -> dict[int, np.ndarray]:
    """Syndrome -> all error patterns of at most that weight with it; a word xor such a pattern is a codeword near it."""
    out: dict[int, list[int]] = {}
    for w in range(weight + 1):
        for at in combinations(range(code), w):
            s = 0
            for i in at:
                s ^= i + 1
            out.setdefault(s, []).append(sum(1 << i for i in at))
    return {s: np.array(v, np.uint64) for s, v in out.items()}


def anchors(fps: np.ndarray, layout: tuple[Part, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index of the fingerprint, home) for every anchor within covering radius plus threshold, in all parts."""
    keys, rows, homes = [], [], []
    for number, p in enumerate(layout):
        part = fps >> np.uint64(p.low)
        word, free = part & np.uint64((1 << p.code) - 1), (part >> np.uint64(p.code)) & np.uint64((1 << p.free) - 1)
        s, radius = syndromes(word, p.code), int(p.m > 0)
        for flips in range(min(p.threshold, p.free) + 1):  # a home anchor has its own free bits, so the other's may differ in them
            near = patterns(p.code, radius + p.threshold - flips)
            flipped = [free ^ np.uint64(sum(1 << i for i in at)) for at in combinations(range(p.free), flips)]
            for syndrome, errors in near.items():
                own = np.flatnonzero(s == np.uint64(syndrome))
                if not len(own):
                    continue
                codewords = word[own, None] ^ errors[None, :]
                close = np.bitwise_count(errors) <= radius
                for f in flipped:
                    key = np.uint64(number << 40) | (f[own, None] << np.uint64(p.code)) | codewords
                    keys.append(key.ravel())
                    rows.append(np.repeat(own, len(errors)))
                    homes.append(np.tile(close & (flips == 0), len(own)))
    return np.concatenate(keys).astype(np.int64), np.concatenate(rows), np.concatenate(homes)


def links_at(fps: np.ndarray, home: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Edges (least, other) of a spanning forest of the links at one anchor that involve a home fingerprint.

    A search from each home fingerprint; what has been reached is compared no more, so a dense group costs few passes.
    Memory is 9 bytes a fingerprint.
    """
    edges: list[tuple[int, int]] = []
    open_ = np.ones(len(fps), bool)
    for seed in np.flatnonzero(home):
        if not open_[seed]:
            continue
        open_[seed] = False
        reached, k = [int(seed)], 0
        while k < len(reached):
            left = np.flatnonzero(open_)
            found = left[np.bitwise_count(fps[left] ^ fps[reached[k]]) <= threshold]
            open_[found] = False
            reached.extend(found.tolist())
            k += 1
        if len(reached) > 1:
            members = fps[reached].view(np.int64)
            least = int(members.min())
            edges += [(least, int(x)) for x in members if x != least]
    return edges


class Forest:
    """Union-find over the edges that one task has seen: whatever their number, a star for each component comes out."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def top(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]  # halves the path
        return x

    def join(self, edges: Iterable[tuple[int, int]]) -> None:
        for a, b in edges:
            a, b = self.top(a), self.top(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)

    def stars(self) -> pa.RecordBatch:
        out = np.array([(t, x) for x in self.parent if (t := self.top(x)) != x], np.int64).reshape(-1, 2)
        self.parent = {}
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])


def contract(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The edges (a, b) of a partition as stars (least, other), each time there are more than `most` nodes and at the end."""
    forest = Forest()
    for b in batches:
        forest.join(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        if len(forest.parent) > most:
            yield forest.stars()
    yield forest.stars()


def compare_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, fp, home) sorted by anchor -> edges, as stars of all the partition's links; an anchor that spans batches is carried along."""
    carried: list[tuple[np.ndarray, ...]] = []
    forest = Forest()

    def link(rows: tuple[np.ndarray, ...]) -> None:
        key, fps, home = rows
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
        some = np.add.reduceat(home.astype(np.int64), cuts[:-1])
        two = np.flatnonzero((some > 0) & (np.diff(cuts) > 1))
        for a, b in zip(cuts[two].tolist(), cuts[two + 1].tolist(), strict=True):
            forest.join(links_at(fps[a:b], home[a:b]))

    for b in batches:
        if not b.num_rows:
            continue
        new = tuple(c.to_numpy(zero_copy_only=False) for c in b.columns)
        new = (new[0], new[1].view(np.uint64), new[2])
        if carried and carried[0][0][0] == new[0][-1]:  # all of it goes on the same anchor
            carried.append(new)
            continue
        all_ = tuple(np.concatenate(x) for x in zip(*carried, new, strict=True))
        last = int(np.searchsorted(all_[0], all_[0][-1]))
        if last:
            link(tuple(x[:last] for x in all_))
        if len(forest.parent) > FOREST_NODES:
            yield forest.stars()
        carried = [tuple(x[last:] for x in all_)]
    if carried:
        link(tuple(np.concatenate(x) for x in zip(*carried, strict=True)))
    yield forest.stars()


def outside_segments(anchor: np.ndarray, fps: np.ndarray, layout: tuple[Part, ...]) -> Iterator[np.ndarray]:
    """For each segment of the bits outside an anchor's part: a key of (anchor, segment, its bits) of every fingerprint.

    Keys are mixed to 64 bits; two groups of one key are compared together, which only costs time.
    """
    number = (anchor >> np.int64(40)).astype(np.int64)
    for k in range(THRESHOLD + 1):
        key = np.zeros(len(fps), np.uint64)
        for i, p in enumerate(layout):
            width, low = p.code + p.free, np.uint64(p.low)
            below = fps & np.uint64((1 << p.low) - 1)
            above = fps >> np.uint64(p.low + width) if p.low + width < 64 else np.zeros_like(fps)
            rest, n = above << low | below, 64 - width
            first, last = k * n // (THRESHOLD + 1), (k + 1) * n // (THRESHOLD + 1)
            bits = (rest >> np.uint64(first)) & np.uint64((1 << (last - first)) - 1)
            key = np.where(number == i, np.uint64(k << 40) | bits, key)
        mixed = anchor.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ key * np.uint64(0xC2B2AE3D27D4EB4F)
        yield (mixed ^ mixed >> np.uint64(29)).view(np.int64)


def split_hot(placed: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of placed (anchor, fp, home) at anchors of at most `most` rows, and the others with their number n (None if there are none)."""
    hot = stored(placed.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > most), "hot")
    n_hot = hot.count()
    if not n_hot:
        return placed, None
    hot = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
    return placed.join(hot.select("anchor"), "anchor", "left_anti"), placed.join(hot, "anchor")


def near_links(nodes: DataFrame, layout: tuple[Part, ...], most: int | None = None) -> DataFrame:
    """a, b: edges, a < b, whose components are those of all links among the distinct fingerprints (fp).

    most: members of an anchor that one task compares (HOT_ROWS).
    """
    most = most or HOT_ROWS

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            if len(fps):
                key, row, home = anchors(fps.view(np.uint64), layout)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row]), pa.array(home)], ["anchor", "fp", "home"])

    def by_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            anchor, fps = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for key in outside_segments(anchor, fps.view(np.uint64), layout):
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(1), b.column(2)], ["anchor", "fp", "home"])

    schema = "anchor long, fp long, home boolean"
    rows, hot = split_hot(nodes.select("fp").mapInArrow(replicate, schema), most)
    if hot is not None:
        cut, still = split_hot(hot.select("anchor", "fp", "home").mapInArrow(by_segments, schema), most)
        rows = rows.unionByName(cut)
        if still is not None:
            slices = F.ceil(F.col("n") / F.lit(most)).cast("long")
            own = F.pmod(F.xxhash64("fp"), slices)
            cells = still.select("anchor", "fp", "home", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("other"))
            rows = rows.unionByName(cells.select(F.xxhash64("anchor", F.least("own", "other"), F.greatest("own", "other")).alias("anchor"), "fp", "home"))
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare_sorted, "a long, b long")


# --- components -----------------------------------------------------------------------------------------------------


def starred(edges: DataFrame, most_rounds: int = 60, block: int = FOREST_EDGES) -> DataFrame:
    """v, root: for every node with an edge that isn't its component's least, the least.

    In each round, partitions of `block` edges are contracted to stars by union-find; if there is only one, that is the result.
    Otherwise a large-star and a small-star step, by joins, carry least nodes across partitions, until nothing changes. Each
    step is written, so it can be read again after a loss, and its joins have plain exchanges on either side.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a").cast("long"))).first())

    def linked_to_least(both: DataFrame, larger: bool) -> DataFrame:
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        joined = both.join(least, "u")
        out = joined.filter(F.col("v") > F.col("u")) if larger else joined.filter(F.col("v") != F.col("m"))
        star = out.select(F.col("m").alias("a"), F.col("v").alias("b"))
        if not larger:
            star = star.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return stored(star.filter(F.col("a") != F.col("b")).distinct(), "star")

    edges = stored(edges, "edges")
    n, before = edges.count(), None
    for _ in range(most_rounds):
        parts = max(1, -(-n // block))
        most = 2 * n if parts == 1 else FOREST_NODES  # n edges have no more nodes than that, so a single partition is one forest
        edges = stored(edges.repartition(parts).mapInArrow(partial(contract, most=most), "a long, b long"), "contracted")
        if parts == 1:
            break
        ab = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        large = linked_to_least(ab.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), True)
        edges = linked_to_least(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), False)
        now = state(edges)
        if now == before:
            break
        n, before = now[0], now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("v"), F.col("a").alias("root"))


# --- the operator ---------------------------------------------------------------------------------------------------


def components(docs: DataFrame, layout: str | None = None) -> DataFrame:
    """rid, doc_id, text_key, fp, least (struct of the component's first row by doc_id, null last) for each row of docs."""
    rows = fingerprints(docs)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "rid")
    nodes = stored(rows.groupBy("fp").agg(F.min(first).alias("least")), "nodes")
    parts = LAYOUTS[layout or ("coarse" if nodes.count() <= FINE else "fine")]
    stars = starred(near_links(nodes, parts))
    # members of components of two or more fingerprints, and their least row; all others are their own component
    members = stored(stars.unionByName(stars.select(F.col("root").alias("v"), "root").distinct()), "members")
    small = members.count() <= BROADCAST_ROWS
    near = F.broadcast if small else lambda df: df
    least = stored(nodes.join(near(members), nodes["fp"] == members["v"]).groupBy("root").agg(F.min("least").alias("root_least")), "component")
    labels = stored(members.join(near(least), "root").select(F.col("v").alias("fp"), "root_least"), "labels")
    found = rows.join(nodes, "fp").join(near(labels), "fp", "left")
    return found.select("rid", "doc_id", "text_key", "fp", F.coalesce("root_least", "least").alias("least"))


def near_duplicates(docs: DataFrame, layout: str | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs (doc_id, text)."""
    found = components(docs, layout)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, kept for each row of docs: of each component the row that sorts first is kept."""
    return components(docs).select("doc_id", "text_key", (F.col("rid") == F.col("least.rid")).alias("kept"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
