"""Stored results: a result's rows once, as sorted files with fences, so that a page reads the one or two files it is in.

A result is dealt into ranges of its order, sorted, numbered and written; the fences (each file's first row number and its rows) are a
small table beside it. Both lie in the shared folder under the result's id, so a cursor outlives the driver that gave it. A store keeps
the results used last, up to a number, and forgets those that have been idle; what is forgotten is deleted.
"""

from __future__ import annotations

import bisect
import json
import time
from collections import OrderedDict
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from corpuslens.sources.shared import shared_folder

#: Rows of a file at most: what a page may have to look through.
FILE_ROWS = 100_000
#: Results kept, and how long one may be idle.
MOST_RESULTS, IDLE_SECONDS = 20, 30 * 60


def total_order(rows: DataFrame, order: list) -> list:
    """The order, and a hash of all columns after it, so that only equal rows tie."""
    plain = [f.name for f in rows.schema.fields if not isinstance(f.dataType, MapType)]
    return [*order, F.xxhash64(*plain)]


class Fence(NamedTuple):
    """A file's first row, by its number in the result and by its own number, and how many it has."""

    first: int
    low: int
    rows: int
    file: str


class StoredResult:
    """The rows of a written result, by their number from 0."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = spark.read.parquet(f"{path}/about").first()
        self.schema, self.about = about["columns"], json.loads(about["about"])
        fences = spark.read.parquet(f"{path}/fences").orderBy("first").collect()  # a row for each file
        self.fences = [Fence(f["first"], f["low"], f["rows"], f["file"]) for f in fences]
        self.firsts = [f.first for f in self.fences]

    @staticmethod
    def write(rows: DataFrame, order: list, path: str, about: dict) -> None:
        spark, n = rows.sparkSession, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        by = total_order(rows, order)
        dealt = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("at_", F.monotonically_increasing_id())
        dealt.write.option("maxRecordsPerFile", str(FILE_ROWS)).parquet(f"{path}/rows")
        each = spark.read.schema("at_ long").parquet(f"{path}/rows").groupBy(F.input_file_name().alias("file")).agg(F.min("at_").alias("low"), F.count("*").alias("rows"))
        first = F.coalesce(F.sum("rows").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
        each.select("file", first.alias("first"), "rows", "low").coalesce(1).write.parquet(f"{path}/fences")
        spark.createDataFrame([(rows.schema.json(), json.dumps(about))], "columns string, about string").coalesce(1).write.parquet(f"{path}/about")  # last: now it is whole

    @property
    def count(self) -> int:
        return self.fences[-1].first + self.fences[-1].rows if self.fences else 0

    def all(self) -> DataFrame:
        """All rows, in no order."""
        return self.spark.read.schema(StructType.fromJson(json.loads(self.schema))).parquet(f"{self.path}/rows")

    def files_of(self, offset: int, most: int) -> list[Fence]:
        """The files that hold the rows from the offset on."""
        at = max(0, bisect.bisect_right(self.firsts, offset) - 1)
        return [f for f in self.fences[at : bisect.bisect_left(self.firsts, offset + most)] if f.first + f.rows > offset]

    def page(self, offset: int, most: int) -> list[Row]:
        """Up to `most` rows from the offset on. A file's own numbers are consecutive, so its first one says where to begin."""
        schema, out = StructType.fromJson(json.loads(self.schema)).add("at_", "long"), []
        for f in self.files_of(offset, most):
            at = F.col("at_") - f.low + f.first
            first = f.low + max(0, offset - f.first)  # compared with the column itself, so that the file's statistics are used
            rows = self.spark.read.schema(schema).parquet(f.file).filter((F.col("at_") >= first) & (at < offset + most))
            out += rows.orderBy("at_").drop("at_").collect()
        return out


class ResultStore:
    """The stored results of a session by id: the ones used last, none idle for too long."""

    def __init__(self, spark: SparkSession, most: int = MOST_RESULTS, idle: float = IDLE_SECONDS, clock: Callable[[], float] = time.time):
        self.spark, self.most, self.idle, self.clock = spark, most, idle, clock
        self.used: OrderedDict[str, tuple[float, StoredResult]] = OrderedDict()

    def path(self, id_: str) -> str:
        return f"{shared_folder(self.spark)}/results/{id_}"

    def put(self, id_: str, rows: DataFrame, order: list, about: dict) -> StoredResult:
        StoredResult.write(rows, order, self.path(id_), about)
        return self._use(id_, StoredResult(self.spark, self.path(id_)))

    def get(self, id_: str) -> StoredResult | None:
        """The result, from this session or from one before it; None if it was never written whole, or is gone."""
        self.sweep()
        if id_ in self.used:
            return self._use(id_, self.used[id_][1])
        path = self._hadoop(f"{self.path(id_)}/about/_SUCCESS")
        return self._use(id_, StoredResult(self.spark, self.path(id_))) if path.getFileSystem(self._conf).exists(path) else None

    def sweep(self) -> None:
        """Delete what has been idle, and the oldest beyond the number kept."""
        while self.used and (len(self.used) > self.most or self.clock() - next(iter(self.used.values()))[0] > self.idle):
            id_, _ = self.used.popitem(last=False)
            path = self._hadoop(self.path(id_))
            path.getFileSystem(self._conf).delete(path, True)

    def _use(self, id_: str, result: StoredResult) -> StoredResult:
        self.used[id_] = (self.clock(), result)
        self.used.move_to_end(id_)
        self.sweep()
        return result

    def _hadoop(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    @property
    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()
