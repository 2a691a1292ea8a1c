"""Best-fit packing of tokenized documents into sequences.

Every document is encoded whole and gets an end id. A document of more than `max_tokens` ids is cut into pieces of that length; what is
left over is its first piece, so every other piece fills a sequence. A sequence has three capacities: tokens, documents, and attention
cost (the sum of squared lengths); a piece of n tokens asks for (n, 1, n * n) of them. Pieces are placed from the longest to the
shortest. Each goes to the sequence that has room in every capacity and fits it best: the one with the least weighted norm of what
would be left ("norm"), or with the least weighted dot product of what the piece asks for and what is left ("dot"), each capacity counted
as a share of its whole; ties go to the sequence opened first. If none has room, a new one is opened.

That rule looks at a piece's length alone, so the whole placement follows from the number of pieces of each length, a table of
`max_tokens` rows at most, however many documents there are. `plan` makes it from those counts: sequences in the same state are one
run of sequence numbers, and pieces of one length fill a run in one step, with the result of placing them one by one. A run is parted
only where a length's pieces end, twice a length at most. Spark then ranks the pieces by length (ranges and their offsets), and a
piece's rank says its sequence and its place there. Texts and ids aren't shuffled for the digest; no task or driver holds all pieces.

Defined results: a null or empty text is one piece, the end id; special strings of the vocabulary are one token each, as is the
library's default; rows with a null doc_id and rows that are repeated exactly are packed each; pieces of one length are ordered by
doc_id, nulls last, then by a hash of the text; very long texts are encoded whole; an empty table gives an empty result; extra columns
aren't looked at, whatever their names.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable, Iterator
from struct import pack as packed_ints
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer

from .common import numbered, small_arrow_batches, stored, table, text_key, text_of
from .token_count import CACHE_CHARS, LONG_TEXT, NOT_PLAIN, Counts, byte_alphabet

MAX_TOKENS, END_ID = 1024, 2
#: Words, and pre-tokens of what isn't one word, that a Python worker remembers with their ids, some 200 MB.
KNOWN_WORDS, KNOWN = 700_000, 300_000
#: White space that may follow a space only where the pre-tokens of what is on either side depend on each other.
AFTER_SPACE = tuple(f" {c}" for c in " \t\n\r\xa0")


def merger(encoder: Tokenizer) -> Callable[[bytes], list[int]]:
    """The ids of a pre-token's bytes, by the vocabulary's merges.

    Where the merges make the tokens in the order of their ids, the rule is to join the neighbours that make the least id, and a
    function that knows ids alone, and costs a third, gives the same; otherwise the library's own model is asked, in its byte alphabet."""
    to_byte, model = byte_alphabet(), json.loads(encoder.to_str())["model"]
    special = {x.content for x in encoder.get_added_tokens_decoder().values()}
    ids = {bytes(map(to_byte.__getitem__, s)): i for s, i in model["vocab"].items() if s not in special}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    made = [model["vocab"]["".join(m)] for m in pairs]
    if made == sorted(set(made)) and len(made) + 256 == len(ids) and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return tiktoken.Encoding("merges", pat_str=".", mergeable_ranks=ids, special_tokens={})._core_bpe.encode_single_piece
    own, shown = encoder.model, {b: c for c, b in to_byte.items()}
    return lambda raw: [t.id for t in own.tokenize("".join(map(shown.__getitem__, raw)))]


class Words(dict):
    """What stands between two spaces -> the ids of it and the space before it, as little-endian bytes."""

    def __init__(self, ids: Ids):
        super().__init__()
        self.own, self.room = ids, KNOWN_WORDS

    def __missing__(self, word: str) -> bytes:
        ids = self.own.merged(f" {word}") if word.isalpha() else self.own.cut_ids(f" {word}")  # letters alone are one pre-token
        if len(word) <= CACHE_CHARS and self.room:
            self.room -= 1
            self[word] = ids
        return ids


class Ids(Counts):
    """Pre-token -> its ids as little-endian bytes: the cutting of `Counts`, with ids in place of numbers.

    A pre-token has a space at its start only, and a single space before other than white space is always the start of one. So
    a text in which no space is followed by white space, or ends it, is cut at its spaces, and each word is cut further once."""

    def __init__(self, path: str):
        super().__init__(path, frozenset())
        self.room, self.words = KNOWN, Words(self)
        self.merge = merger(self.encoder)

    def merged(self, word: str) -> bytes:
        """The ids of a pre-token."""
        return packed_ints(f"<{len(found := self.merge(word.encode()))}I", *found)

    def __missing__(self, word: str) -> bytes:
        ids = self.merged(word)
        if len(word) <= CACHE_CHARS and self.room:
            self.room -= 1
            self[word] = ids
        return ids

    def cut_ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pre_tokens(text)))

    def plain_ids(self, text: str) -> bytes:
        """The ids of a text without special strings."""
        if len(text) > LONG_TEXT or text.endswith(" ") or any(x in text for x in AFTER_SPACE) or NOT_PLAIN.search(text):
            return self.cut_ids(text)
        first, *words = text.split(" ")
        return self.cut_ids(first) + b"".join(map(self.words.__getitem__, words))

    def ids(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self.plain_ids(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self.plain_ids(text[at : m.start()]), np.array([self.encoder.token_to_id(m[0])], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.plain_ids(text[at:])])


_ids: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


def pieces(docs: DataFrame, path: str, longest: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, text_key, piece, start, length, ids_crc32 (and ids): the pieces of every row of docs (doc_id, text).

    path: a tokenizers .json with a byte-level BPE, present on every executor."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "text_key", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path)
        for b in batches:
            rows, which = [], []
            for k, text in enumerate(b.column(2)):
                raw = ids.ids(text.as_py()) + end
                n = len(raw) // 4
                first = n % longest or longest
                for piece, (x, y) in enumerate(zip([0, *range(first, n, longest)], [*range(first, n + 1, longest)], strict=True)):
                    own = raw[4 * x : 4 * y]
                    rows.append((piece, x, y - x, zlib.crc32(own), np.frombuffer(own, "<i4")) if with_ids else (piece, x, y - x, zlib.crc32(own)))
                    which.append(k)
            piece, start, length, crc, *own = zip(*rows, strict=True) if rows else [()] * (4 + with_ids)
            keys = b.select([0, 1]).take(pa.array(which, pa.int64()))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in own]
            yield pa.RecordBatch.from_arrays([keys.column(0), keys.column(1), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *lists], names)

    small_arrow_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_key().alias("text_key"), text_of().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class Capacity(NamedTuple):
    tokens: int
    documents: int
    cost: int

    def piece(self) -> int:
        """The longest piece that fits an empty sequence."""
        return min(self.tokens, math.isqrt(self.cost))


def capacity(tokens: int = MAX_TOKENS, documents: int | None = None, cost: int | None = None) -> Capacity:
    """By default documents and cost don't bind: a document has a token at least, and squares sum to the square of the sum at most."""
    out = Capacity(tokens, documents or tokens, cost or tokens * tokens)
    if min(out) < 1:
        raise ValueError("every capacity must be positive")
    return out


def fit(left: tuple, ask: tuple, whole: Capacity, score: str, weights: tuple) -> float:
    """How badly a piece fits: less is better, and it gets less with every further piece of the same length in a sequence."""
    if score == "norm":
        return sum(w * ((have - need) / most) ** 2 for w, have, need, most in zip(weights, left, ask, whole, strict=True))
    return sum(w * (have / most) * (need / most) for w, have, need, most in zip(weights, left, ask, whole, strict=True))


class Step(NamedTuple):
    """`pieces` pieces of one length, `each` to a sequence, into the sequences from `sequence` on, at `offset`."""

    pieces: int
    length: int
    each: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], whole: Capacity, score: str = "norm", weights: tuple = (1.0, 1.0, 1.0)) -> list[Step]:
    """The placement of counts[length] pieces of each length, in the order of the pieces (the longest first)."""
    if score not in ("norm", "dot") or min(weights) <= 0:
        raise ValueError("score must be norm or dot, with positive weights")
    runs: dict[tuple, list[list[int]]] = {}  # what is left in a sequence -> runs [first sequence, how many] in that state, by number
    opened, steps = 0, []

    def put(left: tuple, first: int, n: int) -> None:
        if n:
            own = runs.setdefault(left, [])
            own.append([first, n])
            own.sort()

    for length in sorted(counts, reverse=True):
        ask, todo = (length, 1, length * length), counts[length]
        while todo:
            fitting = [left for left in runs if all(a <= b for a, b in zip(ask, left, strict=True))]
            if fitting:
                left = min(fitting, key=lambda x: (fit(x, ask, whole, score, weights), runs[x][0][0]))
                first, n = runs[left].pop(0)
                if not runs[left]:
                    del runs[left]
            else:
                left, first, n = tuple(whole), opened, math.inf
            each = min(b // a for a, b in zip(ask, left, strict=True))
            full = min(n, todo // each)
            rest = min(todo - full * each, each - 1) if full < n else 0  # the pieces that end within one sequence more
            for k, m, at in ((each, full, first), (rest, 1 if rest else 0, first + full)):
                if m:
                    steps.append(Step(k * m, length, k, at, whole.tokens - left[0]))
                    put(tuple(b - k * a for a, b in zip(ask, left, strict=True)), at, m)
            used = full + (1 if rest else 0)
            todo -= full * each + rest
            if n is math.inf:
                opened += used
            else:
                put(left, first + used, n - used)
    return steps


def packed(cut: DataFrame, whole: Capacity, score: str = "norm", weights: tuple = (1.0, 1.0, 1.0)) -> DataFrame:
    """The pieces (of `pieces`, written) with sequence_id and offset. One count a length is gathered, `max_tokens` at most."""
    spark = cut.sparkSession
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps = np.array(plan(counts, whole, score, weights), np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast((np.cumsum(steps[:, 0]) - steps[:, 0], *steps[:, 1:].T))
    by = [F.desc("length"), F.asc_nulls_last("doc_id"), "text_key", "piece", "start"]
    ranked = numbered(cut, by, "place")
    at = ranked.columns.index("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, length, each, sequence, offset = sent.value
        for b in batches:
            place = b.column(at).to_numpy()
            k = np.searchsorted(before, place, "right") - 1
            own = place - before[k]
            out = [*(b.column(i) for i in range(b.num_columns) if i != at), pa.array(sequence[k] + own // each[k]), pa.array(offset[k] + own % each[k] * length[k])]
            yield pa.RecordBatch.from_arrays(out, [*(n for n in b.schema.names if n != "place"), "sequence_id", "offset"])

    small_arrow_batches(spark)
    schema = StructType([*cut.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, whole: Capacity | None = None, end_id: int = END_ID, score: str = "norm", weights: tuple = (1.0, 1.0, 1.0), with_ids: bool = False) -> DataFrame:
    """doc_id, text_key, piece, start, length, ids_crc32 (ids), sequence_id, offset for every piece of docs (doc_id, text)."""
    whole = whole or capacity()
    return packed(stored(pieces(docs, path, whole.piece(), end_id, with_ids), "pieces"), whole, score, weights)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids, lengths, doc_ids: a row for each sequence of `pack(..., with_ids=True)`, of bounded size. lengths are those of
    the pieces in order, from which a trainer masks attention across documents."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    rows = placed.groupBy("sequence_id").agg(ordered.alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.length").alias("lengths"), F.col("p.doc_id").alias("doc_ids"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
