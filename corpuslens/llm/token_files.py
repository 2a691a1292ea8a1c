"""Token ids in Parquet files: list columns with controlled encodings, row groups and page indexes.

Documents are dealt into ranges of doc_id, sorted, encoded, and written in that order: a file for each range, with
doc_id and the place of a document in its file as delta-encoded integers (sorted, so a few bits each), the ids as a
list column that is dictionary-encoded (as many bits as the file's ids need), small row groups and pages, and the column
and offset indexes that Parquet writes beside them. A reader that wants some documents filters on doc_id and reads only the pages
that may hold them; a reader that wants lengths reads no ids.

The encoder gives the library's ids. A text of plain characters (below U+0250, no unusual controls) is lowered and cut
into words here, and the library encodes each distinct word once for a Python worker; any other text, or one with a
special string of the vocabulary, goes to the library whole.

Defined results: a null or empty text is written with the end id alone; rows with a null doc_id come first; repeated
doc_ids are ordered by text; an empty table gives an empty result; extra columns aren't looked at; texts are taken whole.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, shared_dir, small_arrow_batches, stored, table, text_key, text_of
from .token_count import CACHE_CHARS, LETTERS, LONG_TEXT, NUMBERS, SPACES, byte_alphabet, encoder

END_ID = 2
#: Words that a Python worker remembers, some 150 MB.
KNOWN_WORDS = 700_000
#: U+0130 lowers to two characters, one of them a mark.
NOT_PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa0-\\u012f\\u0131-\\u024f]")
#: As the file's own pattern, but letters first: no two of the alternatives before the last can start alike.
WORD = re.compile(f"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")

#: Writer settings: 16 MB row groups, 64 kB pages, version 2 pages (delta encoding of plain integers).
WRITE = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#file_start": "false",
    "compression": "zstd",
}
SCHEMA = "part int, file_start long, doc_id long, n_tokens long, ids array<int>"


class Words(dict):
    """Word -> its ids as little-endian bytes."""

    def __init__(self, path: str):
        super().__init__()
        self.encoder, self.room = encoder(path), KNOWN_WORDS
        self.model, self.shown = self.encoder.model, {b: c for c, b in byte_alphabet().items()}
        self.special = [x.content for x in self.encoder.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, "<i4").tobytes()

    def __missing__(self, word: str) -> bytes:
        # a word is a pre-token already, so the library's model alone is asked, in its byte alphabet
        shown = word if word.isascii() else "".join(map(self.shown.__getitem__, word.encode()))
        ids = np.array([t.id for t in self.model.tokenize(shown)], "<i4").tobytes()
        if len(word) <= CACHE_CHARS and self.room:
            self.room -= 1
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if NOT_PLAIN.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        low = text.lower()
        words = (m[0] for m in WORD.finditer(low)) if len(low) > LONG_TEXT else WORD.findall(low)
        return b"".join(map(self.__getitem__, words))


_words: dict[str, Words] = {}


def words_of(path: str) -> Words:
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int = END_ID) -> None:
    """Write docs (doc_id, text) as token files into the folder `out`, in ascending doc_id over the files and within them.

    Columns: part (the file's number), file_start (ids before the document in its file), doc_id, n_tokens, ids.
    """
    small_arrow_batches(docs.sparkSession)
    end = np.array([end_id], "<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, at = words_of(path), TaskContext.get().partitionId(), 0
        for b in batches:
            raw = [words.ids(t) + end for t in b.column(1).to_pylist()]
            offsets = np.cumsum([0, *(len(r) // 4 for r in raw)])
            flat = np.frombuffer(b"".join(raw), "<i4")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(raw), part, np.int32)), pa.array(at + offsets[:-1]), b.column(0), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))],
                ["part", "file_start", "doc_id", "n_tokens", "ids"],
            )
            at += int(offsets[-1])

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), text_key().alias("key"), F.monotonically_increasing_id().alias("rid"))
    by = ["doc_id", "key", "rid"]  # rid only parts rows that are repeated exactly
    rows.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text").mapInArrow(run, SCHEMA).write.options(**WRITE).parquet(out)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The documents with doc_id in [first, last], or all; the filter reaches the page indexes."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        df = df.filter(F.col("doc_id") >= first)
    if last is not None:
        df = df.filter(F.col("doc_id") <= last)
    return df


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, before: ids in all files before each. Reads two columns, without ids; a row for each file is windowed."""
    sizes = spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))


def checked_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, all from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False), np.concatenate(([0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))))
            crc = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["part", "file_start", "doc_id", "n_tokens", "ids_crc32"])

    small_arrow_batches(spark)
    rows = read_tokens(spark, path).select("part", "file_start", "doc_id", "ids").mapInArrow(run, "part int, file_start long, doc_id long, n_tokens long, ids_crc32 long")
    starts = stored(file_starts(spark, path), "starts")  # a row for each file
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts
    return rows.join(starts, "part").select("doc_id", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/tables/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), out)
    return checked_tokens(spark, out)
