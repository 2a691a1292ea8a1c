"""What the training-data operators share: tables in the shared folder, column names that don't clash, row removal."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Space, tab, LF, VT, FF, CR: the white space that the operators' contracts know.
WS = r"[\x20\x09-\x0D]"
#: A set of row keys is broadcast up to this many rows (about 30 MB); above it the join shuffles.
BROADCAST_ROWS = 400_000
#: Rows in one Arrow batch at most, so that a batch of very long texts fits a Python worker.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_arrow_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch for this session (a lower setting of the user's stays)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if not 0 < now <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; a
    cluster's executors couldn't meet there, so they get one in the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        local = spark.sparkContext.master.startswith("local")
        where = tempfile.mkdtemp(prefix="corpuslens-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/corpuslens-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def remove_tables(spark: SparkSession) -> None:
    """Delete every table that `stored` has written in this session's shared folder: for callers that have read their results."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df doesn't have yet (Spark compares them without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality of the named columns of two frames."""
    return reduce(lambda a, b: a & b, (left[a].eqNullSafe(right[b]) for a, b in pairs))


def text_key(column: str = "text") -> Column:
    """64 bits of the text; with doc_id it names a row up to exact repetition."""
    return F.xxhash64(text_of(column))


def keep_rows(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """docs without the rows that `judged` (doc_id, text_key, kept: a row for each row of docs) doesn't keep.

    The dropped keys go to the rows of docs by a left anti join: broadcast up to BROADCAST_ROWS keys, which are
    counted first, shuffled beyond. Of rows repeated exactly (same doc_id and text) of which one is kept, one row stays.
    All columns of docs stay as they are, whatever their names.
    """
    per = stored(judged.groupBy("doc_id", "text_key").agg(F.max("kept").alias("kept"), F.count("*").alias("n"), F.sum(F.col("kept").cast("long")).alias("n_kept")), "judged")
    drop_id, drop_key, key = fresh(docs, "drop_id", "drop_key", "text_key_")

    def keys(rows: DataFrame) -> DataFrame:
        out = rows.select(F.col("doc_id").alias(drop_id), F.col("text_key").alias(drop_key))
        return F.broadcast(out) if rows.count() <= BROADCAST_ROWS else out

    keyed = docs.withColumn(key, text_key())
    dropped = keys(per.filter(~F.col("kept")))
    left = keyed.join(dropped, same(keyed, dropped, [("doc_id", drop_id), (key, drop_key)]), "left_anti")
    some = per.filter(F.col("kept") & (F.col("n_kept") < F.col("n")))
    if some.head(1):
        again = keys(some)
        match = same(left, again, [("doc_id", drop_id), (key, drop_key)])
        left = left.join(again, match, "left_anti").unionByName(left.join(again, match, "left_semi").dropDuplicates(["doc_id", key]))
    return left.drop(key)


def numbered(rows: DataFrame, by: list, name: str) -> DataFrame:
    """rows, written, with their place from 0 in the given order over all rows: sorted ranges, whose counts give each range's offset.

    A row's place in its range is the low part of monotonically_increasing_id, the range's number its high part. The ranges are
    written, as two computations of them need not have the same bounds; no task holds more than a range, no window more than a row
    for each range."""
    at, part, before, part_ = fresh(rows, "at_", "part_", "before_", "of_part_")
    placed = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy(F.col(part).alias(part_)).agg(F.count("*").alias("n_"))
    earlier = F.sum("n_").over(Window.orderBy(part_).rowsBetween(Window.unboundedPreceding, -1))
    offsets = stored(sizes.select(part_, F.coalesce(earlier, F.lit(0)).alias(before)), "offsets")  # a row for each range
    return placed.join(F.broadcast(offsets), F.col(part) == F.col(part_)).withColumn(name, F.col(at) + F.col(before)).drop(at, part, part_, before)
