"""Exact dedup with a static binary-fuse filter for an immutable snapshot.

Texts are equal when they are identical after each run of white space has become one space. A snapshot's distinct
digests (SHA-256 of the normalised text) are dealt into buckets; each bucket has one static binary-fuse filter of 8 bits a
key. Digests of the incoming batch are made distinct first (new-batch duplicates are grouped among themselves, with a
map-side combine, so a group of any size is a row for each task), then screened by the filter of their bucket. The
positives join the snapshot's exact buckets, whose group they then belong to, and the bytes of every incoming text with such
a digest are compared with the snapshot's own text. Two texts of one SHA-256 and different bytes would stop the job. What the
filters reject is in no group of the snapshot and keeps its own new-batch group.

Defined results: null counts as the empty text; a null doc_id sorts last and is a keep_id only if the group has no
other; of exactly repeated rows one is kept; an empty table gives an empty result; extra columns are not looked at;
very long texts are taken whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, same, stored, table, text_key, text_of

#: Keys of one filter on average: 64k keys take about 75 kB of filter and a few MB while it is built.
FILTER_KEYS = 65_536
LEAST_BUCKETS = 64


def normalised(text: Column) -> Column:
    """Each run of white space as one space; a single space needs no replacing, so the pattern passes it by."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


# --- the filter -----------------------------------------------------------------------------------------------------


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of the keys under a seed (multiply and shift, all bits depend on all)."""
    x = keys ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def fuse_shape(n: int) -> tuple[int, int]:
    """Length of a segment (a power of two) and number of segments for n keys."""
    length = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    return length, max(3, int(np.ceil(n * factor / length)) + 2)


def places(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """Three slots of each hash, in three neighbouring segments: an array of 3 rows."""
    first = ((h >> np.uint64(32)) * np.uint64(segments - 2)) >> np.uint64(32)
    mask = np.uint64(length - 1)
    within = (h & mask, (h >> np.uint64(18)) & mask, (h >> np.uint64(9) ^ h >> np.uint64(40)) & mask)
    return np.stack([(first + np.uint64(i)) * np.uint64(length) + w for i, w in enumerate(within)]).astype(np.int64)


def mark(h: np.ndarray) -> np.ndarray:
    """The 8 bits that the three slots of a key give together."""
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_fuse(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, slots) of distinct uint64 keys.

    Peeling goes in rounds: all keys that have a slot to themselves leave together, and are given their slot's value in
    the opposite order. If keys are left over, the next seed is tried.
    """
    length, segments = fuse_shape(len(keys))
    for seed in range(1, 200):
        h = mixed(keys, seed)
        at = places(h, length, segments)
        alive, rounds = np.arange(len(keys)), []
        while len(alive):
            here = at[:, alive]
            free = np.bincount(here.ravel(), minlength=length * segments)[here] == 1
            out = free.any(axis=0)
            if not out.any():
                break
            rounds.append((alive[out], here[free.argmax(axis=0), np.arange(len(alive))][out]))
            alive = alive[~out]
        if len(alive):
            if seed % 8 == 0:
                segments += max(1, segments // 8)
            continue
        slots = np.zeros(length * segments, np.uint8)
        for leaving, slot in reversed(rounds):
            a, b, c = at[:, leaving]
            slots[slot] = 0
            slots[slot] = mark(h[leaving]) ^ slots[a] ^ slots[b] ^ slots[c]
        return seed, length, segments, slots.tobytes()
    raise RuntimeError("no seed peels; are the keys distinct?")


def may_hold(keys: np.ndarray, seed: int, length: int, segments: int, slots: bytes) -> np.ndarray:
    """True for every key of the filter, and for about one other key of 256."""
    h = mixed(keys, seed)
    a, b, c = places(h, length, segments)
    s = np.frombuffer(slots, np.uint8)
    return mark(h) == s[a] ^ s[b] ^ s[c]


def digest_keys(digests: pd.Series) -> np.ndarray:
    """The first 8 bytes of each digest as a number."""
    return np.frombuffer(b"".join(bytes(d)[:8] for d in digests), ">u8").astype(np.uint64)


def bucket_of(n_buckets: int) -> Column:
    """A digest's bucket: its bytes 9 to 15 (which the filter doesn't use) modulo the number of buckets."""
    return F.pmod(F.conv(F.hex(F.substring("digest", 9, 7)), 16, 10).cast("long"), F.lit(n_buckets)).cast("int")


FILTER_SCHEMA = "bucket int, seed int, length int, segments int, slots binary"


def snapshot_filters(snapshot: DataFrame, n_buckets: int) -> DataFrame:
    """One filter for each bucket of the snapshot's distinct digests (digest binary)."""

    def build(keys: pd.DataFrame) -> pd.DataFrame:
        seed, length, segments, slots = build_fuse(np.unique(digest_keys(keys["digest"])))
        return pd.DataFrame({"bucket": [keys["bucket"].iloc[0]], "seed": [seed], "length": [length], "segments": [segments], "slots": [slots]})

    return snapshot.select(bucket_of(n_buckets).alias("bucket"), "digest").groupBy("bucket").applyInPandas(build, FILTER_SCHEMA)


def screened(incoming: DataFrame, filters: DataFrame, n_buckets: int) -> DataFrame:
    """The distinct incoming digests (digest binary) that the filter of their bucket may hold."""

    def look(keys: pd.DataFrame, filters_: pd.DataFrame) -> pd.DataFrame:
        if not len(keys) or not len(filters_):
            return keys.iloc[:0][["digest"]]
        f = filters_.iloc[0]
        return keys.loc[may_hold(digest_keys(keys["digest"]), int(f.seed), int(f.length), int(f.segments), f.slots), ["digest"]]

    return incoming.select(bucket_of(n_buckets).alias("bucket"), "digest").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(look, "digest binary")


# --- the operator ---------------------------------------------------------------------------------------------------


def row_digests(docs: DataFrame) -> DataFrame:
    """rid, doc_id, text_key, digest of each row, written once."""
    return stored(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text_key().alias("text_key"), F.unhex(F.sha2(normalised(text_of()).cast("binary"), 256)).alias("digest")), "digests")


def groups_of(rows: DataFrame) -> DataFrame:
    """digest, n, least: the row that sorts first by doc_id (null last), then rid."""
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid", "text_key")
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(first).alias("least"))


def byte_checked(docs: DataFrame, incoming: DataFrame, matched: DataFrame) -> None:
    """Compare the bytes of each incoming text whose digest the snapshot has with the snapshot's text.

    matched: digest, old (doc_id and text_key of the snapshot's row). The texts wanted are chosen by row key, broadcast
    up to BROADCAST_ROWS keys; a digest with very many rows is split by AQE's skew join, since only the join needs it.
    """
    near = F.broadcast if matched.count() <= BROADCAST_ROWS else lambda df: df  # else AQE turns to a broadcast after dealing by digest
    olds = matched.select(F.col("least.doc_id").alias("k_id"), F.col("least.text_key").alias("k_key"), F.col("digest").alias("k_digest"))
    news = incoming.join(near(matched.select("digest")), "digest", "left_semi").select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_key"), F.col("digest").alias("k_digest")).distinct()
    texts = docs.select("doc_id", text_key().alias("text_key"), text_of().alias("text"))

    def with_text(keys: DataFrame, name: str) -> DataFrame:
        keys = stored(keys, name)
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
        found = texts.join(keys, same(texts, keys, [("doc_id", "k_id"), ("text_key", "k_key")]))
        return found.select(F.col("k_digest").alias("digest"), normalised(F.col("text")).alias(name))

    pairs = with_text(news, "new_text").join(with_text(olds, "old_text"), "digest")
    if pairs.filter(F.col("new_text") != F.col("old_text")).head(1):
        raise RuntimeError("two texts of one SHA-256 differ in their bytes")


def merged_groups(old: DataFrame, new: DataFrame, matched: DataFrame) -> DataFrame:
    """digest, group_size, least: the snapshot's groups, with the new batch's where the screened digests matched, and its other groups."""
    near = F.broadcast if matched.count() <= BROADCAST_ROWS else lambda df: df
    of_old = matched.select("digest", F.col("n").alias("old_n"), F.col("least").alias("old_least"))
    grown = new.join(near(of_old), "digest", "left").select("digest", (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("group_size"), F.least("least", "old_least").alias("least"))
    same_as_before = old.join(near(matched.select("digest")), "digest", "left_anti").select("digest", F.col("n").alias("group_size"), "least")
    return grown.unionByName(same_as_before)


def exact_dedup(docs: DataFrame, in_snapshot: Column) -> DataFrame:
    """doc_id, text_key, keep_id, group_size, kept, text_sha256: a row for each row of docs (doc_id, text).

    in_snapshot: true for the rows (by doc_id) of the earlier, immutable batch; all others are the incoming batch.
    """
    rows = row_digests(docs)
    old = stored(groups_of(rows.filter(in_snapshot)), "snapshot")
    incoming = rows.filter(~F.coalesce(in_snapshot, F.lit(False)))
    new = stored(groups_of(incoming), "batch")
    n_buckets = max(LEAST_BUCKETS, -(-old.count() // FILTER_KEYS))
    filters = stored(snapshot_filters(old, n_buckets), "filters")
    positive = screened(new, filters, n_buckets)
    matched = stored(old.join(positive, "digest", "left_semi"), "matched")
    if matched.head(1):
        byte_checked(docs, incoming, matched)
    # Written, so that the join below has a plain exchange on either side and AQE can split a group of very many rows.
    both = stored(merged_groups(old, new, matched), "groups")
    out = rows.join(both, "digest")
    return out.select("doc_id", "text_key", F.col("least.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("least.rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def older_half(docs: DataFrame) -> Column:
    """The ids in the lower half of the range of ids: what came before, as a snapshot, where no other is at hand."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.col("doc_id") <= F.lit(0 if low is None else (low + high) // 2)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, older_half(docs)).drop("text_key")


OP6_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
