"""Importance resampling towards a target distribution, in DataFrame functions only.

A text's words are its runs of letters and digits (ASCII, letters in lower case) and characters beyond ASCII; its features are
all runs of 1 to `longest` consecutive words, joined by a space, repeats counted. A feature's bucket is its crc32 modulo the number
of buckets. Features of the corpus and of the target texts are counted by bucket, partly in each task before the shuffle, so a very
common word costs no more than a rare one. A bucket's gain is the logarithm of its share in the target over its share in the corpus
(both smoothed by one a bucket), in thousandths, rounded down. The gains are a table of one row a bucket, so it may be broadcast; its
join gives each feature its gain, and the sum over a document is its weight. With a seeded Gumbel number added, the highest
scores are a sample without replacement in proportion to exp(weight / 1000). They are ranked by a distributed sort: ranges, and the
number of rows before each range.

Defined results: a null or empty text has no features and weight 0; very long texts are taken whole; a null doc_id is seeded as the
empty string and comes last among ties; rows of one doc_id are ordered by a hash of their text, and rows that are repeated exactly
take neighbouring ranks; without target texts all gains come from the corpus alone; an empty table gives an empty result; extra
columns aren't looked at, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, keep_rows, numbered, stored, table, text_key, text_of

BUCKETS = 10_000
#: Between words, once A-Z are lowered.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, in order. `lower` is right, and faster, where all characters are ASCII."""
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.filter(F.split(lowered, BREAK), lambda w: w != "")


def features(found: Column, longest: int) -> Column:
    """All runs of 1 to `longest` consecutive words."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(found, i, n), " "))

    return found if longest == 1 else F.concat(found, *map(runs, range(2, longest + 1)))


def bucket_of(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % F.lit(buckets)


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: the features of all texts (column text) by bucket; a row for each bucket at most."""
    found = texts.select(words(text_of()).alias("words")).select(F.explode(features(F.col("words"), longest)).alias("feature"))
    return found.groupBy(bucket_of(F.col("feature"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gain_table(corpus: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for every bucket: 1000 times the log of (share in the target) / (share in the corpus), smoothed, rounded down."""
    counts = [stored(bucket_counts(df, longest, buckets), "buckets").withColumnRenamed("n", name) for df, name in ((corpus, "s"), (target, "t"))]
    totals = [F.broadcast(df.agg(F.coalesce(F.sum(name), F.lit(0)).alias(f"all_{name}"))) for df, name in zip(counts, "st", strict=True)]  # one row each
    every = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    for df in counts:
        every = every.join(df, "bucket", "left")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in "st")
    more = F.lit(float(buckets))
    gain = F.floor(F.lit(1000.0) * F.log((t + 1.0) * (F.col("all_s").cast("double") + more) / ((s + 1.0) * (F.col("all_t").cast("double") + more))))
    return every.crossJoin(totals[0]).crossJoin(totals[1]).select("bucket", gain.alias("gain"))


def gumbel(doc_id: Column, seed: str) -> Column:
    """The seeded Gumbel number of a document, in thousandths, rounded down: h is 32 bits of sha256(seed:doc_id)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def scored(docs: DataFrame, gains: DataFrame, longest: int = 1, buckets: int = BUCKETS, seed: str = "2024") -> DataFrame:
    """doc_id, text_key, n_words, n_features, weight, score for every row of docs.

    A row's features stay in the task that made them, so the sum's partial rows are one a document, and the shuffle is as small."""
    near = F.broadcast(gains) if buckets <= BROADCAST_ROWS else gains
    row = docs.select("doc_id", text_key().alias("text_key"), words(text_of()).alias("words"), F.monotonically_increasing_id().alias("rid"))
    every = row.select("doc_id", "text_key", "rid", F.size("words").cast("long").alias("n_words"), F.explode_outer(features(F.col("words"), longest)).alias("feature"))
    found = every.withColumn("bucket", bucket_of(F.col("feature"), buckets)).drop("feature").join(near, "bucket", "left")
    sums = found.groupBy("rid", "doc_id", "text_key", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    return sums.drop("rid").withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: str = "2024") -> DataFrame:
    """doc_id, text_key, n_features, weight, score, rank for every row of docs; rank is null for rows that aren't drawn.

    Drawn are floor(percent * N / 100) of the N rows with `least_words` words or more. docs: doc_id, text; target: text.
    Ties of score go to the smaller doc_id."""
    gains = stored(gain_table(docs, target, longest, buckets), "gains")
    rows = stored(scored(docs, gains, longest, buckets, seed), "scores")
    able = rows.filter(F.col("n_words") >= least_words)
    draw = percent * able.count() // 100
    ranked = numbered(able, [F.desc("score"), F.asc_nulls_last("doc_id"), "text_key"], "place")
    rank = F.when(F.col("place") < draw, F.col("place") + 1)
    both = ranked.withColumn("rank", rank).drop("place").unionByName(rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return both.select("doc_id", "text_key", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of docs that `resampled` has drawn, with all their columns. Of rows repeated exactly of which some are drawn, one stays."""
    return keep_rows(docs, judged.select("doc_id", "text_key", F.col("rank").isNotNull().alias("kept")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = rf"""
WITH crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i)
  )
), doc_words AS MATERIALIZED (
  SELECT doc_id, unnest({_WORDS}) AS word FROM documents
), target_words AS MATERIALIZED (
  SELECT unnest({_WORDS}) AS word FROM benchmark
), hexed AS (
  SELECT word, hex(encode(word)) AS digits FROM (SELECT word FROM doc_words UNION SELECT word FROM target_words)
), bytes AS (
  SELECT word, list_transform(range(length(digits) // 2), lambda i: (instr('0123456789ABCDEF', digits[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', digits[2 * i + 2]) - 1) AS codes FROM hexed
), buckets AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_prepend(4294967295, codes), lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)])), 4294967295) % {BUCKETS} AS bucket FROM bytes, crc_table
), counted AS (
  SELECT bucket, sum(s) AS s, sum(t) AS t FROM (
    SELECT bucket, 1 AS s, 0 AS t FROM doc_words JOIN buckets USING (word) UNION ALL SELECT bucket, 0, 1 FROM target_words JOIN buckets USING (word)
  ) GROUP BY bucket
), totals AS (SELECT (SELECT count(*) FROM doc_words) AS all_s, (SELECT count(*) FROM target_words) AS all_t),
gains AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000.0::DOUBLE * ln((t + 1)::DOUBLE * (all_s + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (all_t + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM counted, totals
), sums AS (
  SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM doc_words JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), seeded AS (
  SELECT doc_id, CAST(('0x' || substr(sha256('2024:' || doc_id), 1, 8)) AS BIGINT) AS h FROM documents
), scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM seeded d LEFT JOIN sums USING (doc_id)
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""
