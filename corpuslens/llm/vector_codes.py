"""Vector code compression: a codebook for each part of a vector, fitted by Lloyd's rounds with Hamerly's bounds, in integers.

Each component x becomes the integer floor(4096 * x). A vector is cut into equal consecutive parts, and every part position has a
codebook of its own. A round assigns each part to the nearest entry (squared distance, ties to the lower index), then moves each entry
to the componentwise mean of its parts, rounded down; unused entries stay.

A table in the shared folder holds, for every vector, its integers and for every part the entry, an upper bound of the distance to that
entry and a lower bound of the distance to the second nearest. When entries have moved, the bounds are widened by the moves. While the upper
bound is strictly below the lower bound, or below half the distance from the part's entry to the next entry, the entry is still the
only nearest one and nothing is computed; otherwise the distance to the entry is taken anew, and if that fails too, all entries are
scanned in integers, so an equal distance goes to the lower index as in a full scan. Bounds are doubles, rounded outwards.

A round is one pass without a shuffle: a task writes the new state and, as its last row, what its changed parts add to and
take from the entries' sums (integers of a bounded number, `entries` times the dimensions). Those few rows are summed by Spark, and
the driver gathers the sums alone. Each round's table takes the place of the one before it, which is then deleted.

Defined results: rows whose vector is null, or holds a null or a component that isn't finite, are dropped, and so are vectors of another
length than that of the smallest kept vec_id. A length that the parts don't divide is filled up with zeros. Fewer vectors than entries
give fewer entries. Rows of one vec_id are ordered by their vector; a null vec_id comes last. Rows that are repeated count each. An integer
beyond the range in which a squared distance fits 64 bits (2^27 for 64 dimensions, so |x| up to 32,768) is set to the end of
that range. An empty table gives an empty result; extra columns aren't looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import BROADCAST_ROWS, small_arrow_batches, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Relative margin of a bound: far above the rounding of doubles, far below any difference that matters.
MARGIN = 1e-12


def limit_of(dims: int) -> int:
    """The largest integer whose squared distances over all dimensions fit 64 bits."""
    return 1 << ((62 - max(1, dims - 1).bit_length()) // 2 - 1)


def integers(flat: np.ndarray, dims: int, parts: int) -> np.ndarray:
    """Vectors of `dims` components, one after the other -> (vectors, parts, components of a part)."""
    most = limit_of(dims)
    rows = np.clip(np.floor(np.asarray(flat, np.float64) * SCALE), -most, most).astype(np.int64).reshape(-1, dims)
    return np.pad(rows, ((0, 0), (0, -dims % parts))).reshape(len(rows), parts, -(-dims // parts))


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(rows, entries): squared distances in integers."""
    return ((x[:, None, :] - entries[None]) ** 2).sum(-1)


def above(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + MARGIN)


def below(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 - MARGIN)


class Codebooks:
    """The entries of all parts, what a pass needs to know of them, and of their moves since the last pass."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries  # (parts, entries, components)
        parts, n, _ = entries.shape
        self.half = np.full((parts, n), np.inf)  # half the distance to the nearest other entry, rounded down
        self.move = np.zeros((parts, n))
        self.others = np.zeros((parts, n))  # the largest move of another entry
        for p in range(parts):
            if n > 1:
                d2 = squared(entries[p], entries[p]).astype(np.float64)
                np.fill_diagonal(d2, np.inf)
                self.half[p] = below(d2.min(1)) / 2
            if before is not None:
                self.move[p] = above(((entries[p] - before[p]) ** 2).sum(-1))
                for k in range(n):
                    self.others[p, k] = np.delete(self.move[p], k).max(initial=0.0)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Full scan: entries, upper and lower bounds of x (rows, parts, components)."""
        shape = x.shape[:2]
        codes, upper, lower = np.zeros(shape, np.int64), np.zeros(shape), np.full(shape, np.inf)
        for p in range(shape[1]):
            codes[:, p], upper[:, p], lower[:, p] = self.scan(p, x[:, p])
        return codes, upper, lower

    def scan(self, p: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d2 = squared(x, self.entries[p])
        code = d2.argmin(1)  # the first of equal ones
        best = np.take_along_axis(d2, code[:, None], 1)[:, 0]
        second = below(np.partition(d2, 1, axis=1)[:, 1]) if d2.shape[1] > 1 else np.full(len(x), np.inf)
        return code, above(best), second

    def again(self, x: np.ndarray, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same after a move, from the state before it; and how many parts were scanned."""
        codes, upper, lower, scanned = codes.copy(), upper.copy(), lower.copy(), 0
        for p in range(codes.shape[1]):
            code = codes[:, p]
            upper[:, p] = (upper[:, p] + self.move[p, code]) * (1 + MARGIN)
            moved = self.others[p, code]
            lower[:, p] = lower[:, p] - moved - MARGIN * (np.where(np.isinf(lower[:, p]), 0, lower[:, p]) + moved)
            bound = np.maximum(lower[:, p], self.half[p, code])
            rows = np.flatnonzero(~(upper[:, p] < bound))
            if len(rows):
                upper[rows, p] = above(((x[rows, p] - self.entries[p, code[rows]]) ** 2).sum(-1))
                rows = rows[~(upper[rows, p] < bound[rows])]
            if len(rows):
                codes[rows, p], upper[rows, p], lower[rows, p] = self.scan(p, x[rows, p])
                scanned += len(rows)
        return codes, upper, lower, scanned

    def changes(self, x: np.ndarray, codes: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        """(parts, entries, components + 1): what the parts that changed their entry add to sums and counts."""
        out = np.zeros((*self.entries.shape[:2], self.entries.shape[2] + 1), np.int64)
        with_one = np.concatenate([x, np.ones((*x.shape[:2], 1), np.int64)], 2)
        for p in range(codes.shape[1]):
            rows = slice(None) if before is None else np.flatnonzero(codes[:, p] != before[:, p])
            np.add.at(out[p], codes[rows, p], with_one[rows, p])
            if before is not None:
                np.subtract.at(out[p], before[rows, p], with_one[rows, p])
        return out


def matrix(column: pa.ListArray, kind: type, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def listed(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    width = rows.shape[1] if rows.ndim > 1 else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(rows.ravel(), kind))


def whole_vectors(vectors: DataFrame, id_col: str, column: str, label: str) -> DataFrame:
    """id, vector (doubles), label of the rows that can be cut."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(column).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0)).filter(whole)


def start(whole: DataFrame, parts: int, entries: int) -> tuple[np.ndarray, int]:
    """The first codebooks, from the vectors of the smallest ids (`entries` rows are gathered), and the number of dimensions."""
    order = [F.asc_nulls_last("vec_id"), "vector"]
    first = whole.orderBy(*order).limit(1).collect()
    dims = len(first[0].vector) if first else 0
    rows = whole.filter(F.size("vector") == dims).orderBy(*order).limit(entries).collect() if first else []
    return integers(np.array([r.vector for r in rows]).ravel(), dims or parts, parts).swapaxes(0, 1).copy(), dims


def state_type(whole: DataFrame) -> StructType:
    doubles = ArrayType(DoubleType())
    own = [("ints", ArrayType(IntegerType())), ("codes", ArrayType(ByteType())), ("upper", doubles), ("lower", doubles), ("sums", ArrayType(LongType()))]
    return StructType([StructField("vec_id", whole.schema["vec_id"].dataType), StructField("label", whole.schema["label"].dataType), *(StructField(n, t) for n, t in own)])


def passed(rows: DataFrame, books: Codebooks, dims: int, first: bool) -> DataFrame:
    """The new state of every row of the state table (or of the vectors, at first), written; and a row of sums for each task."""
    schema = state_type(rows)
    parts, n, width = books.entries.shape
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, kinds = sent.value, np.zeros((parts, n, width + 1), np.int64), None
        for b in batches:
            kinds = (b.schema.field(0).type, b.schema.field(1).type)
            if first:
                x, codes = integers(b.column(2).flatten().to_numpy(), dims, parts), None
                now, upper, lower = own.assign(x)
            else:
                x = matrix(b.column(2), np.int64, parts * width).reshape(-1, parts, width)
                codes = matrix(b.column(3), np.int64, parts)
                now, upper, lower, _ = own.again(x, codes, matrix(b.column(4), np.float64, parts), matrix(b.column(5), np.float64, parts))
            total += own.changes(x, now, codes)
            sums = pa.nulls(len(x), pa.list_(pa.int64()))
            columns = [b.column(0), b.column(1), listed(x.reshape(len(x), -1), pa.int32()), listed(now, pa.int8()), listed(upper, pa.float64()), listed(lower, pa.float64()), sums]
            yield pa.RecordBatch.from_arrays(columns, schema.names)
        if kinds:
            lists = [pa.nulls(1, pa.list_(t)) for t in (pa.int32(), pa.int8(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), *lists, listed(total.reshape(1, -1), pa.int64())], schema.names)

    small_arrow_batches(rows.sparkSession)
    columns = ["vec_id", "label", "vector"] if first else ["vec_id", "label", "ints", "codes", "upper", "lower"]
    return stored(rows.select(*columns).mapInArrow(run, schema), "codes")


def summed(state: DataFrame, shape: tuple) -> np.ndarray:
    """The tasks' rows of sums, added up; `entries` times (dimensions + parts) numbers reach the driver."""
    each = state.filter(F.col("sums").isNotNull()).select(F.posexplode("sums").alias("at", "x"))
    out = np.zeros(math.prod(shape), object)
    for r in each.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        out[r["at"]] = int(r.x)
    return out.reshape(shape)


def mean_down(sums: np.ndarray, entries: np.ndarray) -> np.ndarray:
    out = entries.copy()
    for p, k in np.argwhere(sums[..., -1] > 0):
        out[p, k] = [int(x) // int(sums[p, k, -1]) for x in sums[p, k, :-1]]
    return out


def remove(table_: DataFrame) -> None:
    """Delete a table of this run that no later step reads."""
    sc = table_.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(table_.inputFiles()[0]).getParent()
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def fitted(whole: DataFrame, entries: np.ndarray, dims: int, rounds: int) -> tuple[np.ndarray, DataFrame]:
    """The codebooks after all rounds, and the state of every vector, assigned to them."""
    books, state, sums = Codebooks(entries), None, 0
    for k in range(rounds + 1):
        before, state = state, passed(whole if k == 0 else state.filter(F.col("sums").isNull()), books, dims, k == 0)
        if before is not None:
            remove(before)
        if k < rounds:
            sums = sums + summed(state, (*books.entries.shape[:2], books.entries.shape[2] + 1))
            books = Codebooks(mean_down(sums, books.entries), books.entries)
    return books.entries, state.filter(F.col("sums").isNull())


def digest(entries: np.ndarray) -> str:
    """sha256 of all entries' components, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def encoded(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of every kept vector, and the codebooks (parts, entries, components)."""
    if not 1 <= entries <= 128:
        raise ValueError("a codebook has 1 to 128 entries")
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, id_col, column, label)
    first, dims = start(whole, parts, entries)
    schema = StructType([whole.schema["vec_id"], whole.schema["label"], StructField("code", StringType()), StructField("error", LongType())])
    if not dims:
        return spark.createDataFrame([], schema), first
    books, state = fitted(whole.filter(F.size("vector") == dims), first, dims, rounds)
    sent = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        final = sent.value
        for b in batches:
            codes = matrix(b.column(3), np.int64, final.shape[0])
            x = matrix(b.column(2), np.int64, final.shape[0] * final.shape[2]).reshape(len(codes), *final.shape[::2])
            error = ((x - final[np.arange(final.shape[0])[None], codes]) ** 2).sum((1, 2))
            code = ["".join(map("{:02x}".format, c)) for c in codes.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], schema.names)

    return state.select("vec_id", "label", "ints", "codes").mapInArrow(run, schema), books


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """codes with `vector`: the entries that the code names, back in the components' scale."""
    parts, _, width = books.shape
    flat = [[float(x) / SCALE for x in entry] for part in books.tolist() for entry in part]
    book = F.lit(flat) if flat else F.array().cast("array<array<double>>")
    at = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.get(book, (p * books.shape[1] + F.conv(F.substring("code", p * 2 + 1, F.lit(2)), 16, 10).cast("int"))))
    return codes.withColumn("vector", F.flatten(at))


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows with the sum of errors over equal labels (nulls are equal). Labels are summed in each task first."""
    sums = stored(rows.groupBy(F.col("label").alias("label_")).agg(F.sum("error").alias("label_error")), "labels")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums
    return rows.join(sums, F.col("label").eqNullSafe(F.col("label_")), "left").drop("label_")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = encoded(table(spark, sf_dir, "embeddings"))
    rows = with_label_error(stored(codes, "errors"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same with a full scan in every round."""
    out = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT row, vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) r(p)
), book0 AS MATERIALIZED (
  SELECT p, k, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM parts) WHERE k < {entries}
)"""
    for r in range(rounds + 1):
        out += f"""
, near{r} AS MATERIALIZED (
  SELECT row, p, arg_min(k, d2 * {entries} + k) AS k, min(d2) AS d2 FROM (
    SELECT row, a.p, k, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d2 FROM parts a JOIN book{r} b ON a.p = b.p
  ) GROUP BY row, p
)"""
        if r < rounds:
            out += f"""
, sums{r} AS (
  SELECT p, k, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM near{r} JOIN parts USING (row, p), range(1, 1025) r(i) WHERE i <= len(x) GROUP BY p, k, i
), mean{r} AS (SELECT p, k, list(m ORDER BY i) AS c FROM sums{r} GROUP BY p, k)
, book{r + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON b.p = m.p AND b.k = m.k)"""
    return out + f"""
, coded AS (
  SELECT row, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d2) AS BIGINT) AS error FROM near{rounds} GROUP BY row
), digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row), digest
"""
