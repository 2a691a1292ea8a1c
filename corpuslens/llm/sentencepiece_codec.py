"""SentencePiece encoding and decoding by suffix-array matching.

A BPE model of SentencePiece writes each space as U+2581, puts one in front, and merges neighbouring symbols, the best
scored piece first, the leftmost of equals first. No piece of the model has U+2581 after another character (proved when
the model is loaded), so no merge crosses into a run of U+2581, and a text can be cut in front of each such run. Of the
chunks of an Arrow batch, those not yet known to the Python worker are concatenated; the batch text gets a suffix array
(suffixes ordered by as many characters as the longest piece has), every piece of the vocabulary is binary-searched in it
for its range of occurrences, the occurrences are the edges, sorted by position, and each chunk is relaxed over its edges:
the best edge that spans two neighbouring symbols joins them, until none is left. Short chunks are relaxed together over a
dense table; a longer one over its edges as they lie, sorted by position, in plain arrays of a few bytes an edge, so that a
chunk of ten million characters fits a worker. What stays single and isn't a piece becomes its UTF-8 bytes' pieces.

Decoding puts pieces and bytes together again; `round_trip` says whether that gave the text back.

Defined results: null and empty texts have no ids; repeated rows are encoded each; of edges with equal scores the leftmost joins first; U+2581 in a text is decoded as a
space, so such a row's round_trip is false; an empty table gives an empty result; extra columns aren't looked at. Very
long texts are encoded whole: the index is built for blocks of INDEX_CHARS characters that overlap by a piece's length.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import small_arrow_batches, table, text_of

SPACE = "▁"
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Characters indexed at a time, known chunks of a worker, longest chunk that is remembered.
INDEX_CHARS, CACHE_ENTRIES, CACHE_CHARS = 500_000, 500_000, 48
#: Chunks up to this length are relaxed together.
ROUND_CHARS = 40


class Model:
    """The pieces of a BPE model file, as sorted search keys over a dense alphabet."""

    def __init__(self, path: str):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not proto.trainer_spec.byte_fallback:
            raise ValueError("expected a BPE model with identity normalisation, dummy prefix and byte fallback")
        self.pieces = [p.piece for p in proto.pieces]
        normal = [i for i, p in enumerate(proto.pieces) if p.type == 1]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece goes on after U+2581 within: chunks would not be independent")
        self.id_of = {self.pieces[i]: i for i in normal}
        singles = sorted((ord(self.pieces[i]), i) for i in normal if len(self.pieces[i]) == 1)
        self.single_points, self.single_ids = np.array([x for x, _ in singles], np.uint32), np.array([i for _, i in singles], np.int32)
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        #: Text of an id when decoding; control pieces have none.
        self.text_of = [self.pieces[i] if p.type == 1 else " ⁇ " if p.type == 2 else "" for i, p in enumerate(proto.pieces)]
        joined = [i for i in normal if len(self.pieces[i]) > 1]
        self.width = max(len(self.pieces[i]) for i in joined)
        #: Every character of a piece has a number from 2; 1 stands for any other; 0 pads.
        alphabet = np.array(sorted({ord(c) for i in joined for c in self.pieces[i]}), np.uint32)
        self.alphabet = alphabet
        scores = sorted({proto.pieces[i].score for i in joined}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        self.piece_ids = np.array(joined, np.int32)
        self.piece_len = np.array([len(self.pieces[i]) for i in joined], np.int64)
        self.piece_rank = np.array([rank[proto.pieces[i].score] for i in joined], np.int64)
        low = np.zeros((len(joined), self.width), ">u2")
        high = np.full((len(joined), self.width), 0xFFFF, ">u2")
        for k, i in enumerate(joined):
            codes = self.codes(self.pieces[i])
            low[k, : len(codes)] = high[k, : len(codes)] = codes
        self.low, self.high = (np.ascontiguousarray(x).view(f"S{2 * self.width}").ravel() for x in (low, high))

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 2, 1).astype(">u2")

    def edges(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, index of the piece) of every occurrence of every piece that ends before the next of bounds, sorted by start."""
        n, w = len(codes), self.width
        starts, lengths, which = [np.zeros(0, np.int32)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int32)]
        for block in range(0, n, INDEX_CHARS):
            part = codes[block : block + INDEX_CHARS + w - 1]
            m = min(INDEX_CHARS, n - block)
            padded = np.concatenate((part, np.zeros(w, ">u2"))).astype(">u2")  # byte order counts: keys are compared as bytes
            suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, w)[:m]).view(f"S{2 * w}").ravel()
            order = suffix_order(part, w)
            order = order[order < m]
            ordered = suffixes[order]
            first, last = np.searchsorted(ordered, self.low, "left"), np.searchsorted(ordered, self.high, "right")
            times = last - first
            k = np.repeat(np.arange(len(times), dtype=np.int32), times)
            at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
            s = order[at] + block
            length = self.piece_len[k]
            inside = s + length < bounds[np.searchsorted(bounds, s, "right")]
            s, length, k = s[inside], length[inside], k[inside]
            by = np.argsort(s, kind="stable")
            starts.append(s[by].astype(np.int32))
            lengths.append(length[by].astype(np.uint8))
            which.append(k[by])
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(which)


def suffix_order(codes: np.ndarray, width: int) -> np.ndarray:
    """The suffixes' starts, sorted by their first `width` characters at least, by prefix doubling from four characters."""
    n = len(codes)
    c = np.concatenate((codes.astype(np.uint64), np.zeros(3, np.uint64)))
    key = (c[:n] << np.uint64(48)) | (c[1 : n + 1] << np.uint64(32)) | (c[2 : n + 2] << np.uint64(16)) | c[3 : n + 3]
    k = 4
    while True:
        order = np.argsort(key)
        if k >= width:
            return order
        ordered = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1]))).astype(np.uint64) + np.uint64(1)
        key = rank << np.uint64(32)
        key[: max(0, n - k)] |= rank[k:]
        k *= 2


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def relaxed(n: int, start: np.ndarray, length: np.ndarray, which: np.ndarray, ranks: np.ndarray) -> tuple[array, array]:
    """(starts, edges or -1) of the symbols that cut [0, n): from single positions, the best edge (rank, then leftmost) over two
    neighbours joins them. start, length, which: the chunk's edges, by start; ranks: by piece.

    An edge is looked up among the few that start at a position. First pairs wait in one sorted array, later ones in a heap
    of numbers (rank and position in one), so there is no object for each edge.
    """
    first = np.searchsorted(start, np.arange(n + 1, dtype=np.int32)).astype(np.int32)
    pairs = np.flatnonzero(length == 2)
    waiting = memoryview(np.sort(ranks[which[pairs]] << 40 | start[pairs]))
    first, lengths, rank = memoryview(first), length.tobytes(), memoryview(ranks.astype(np.int32)[which])
    end, begin = array("i", range(1, n + 1)), array("i", range(n))  # end[start] of the symbol that starts there; begin[end - 1] of the one that ends there
    alive = bytearray(b"\x01") * n
    heap: list[int] = []
    i, mask = 0, (1 << 40) - 1

    def edge(a: int, b: int) -> int:
        """The edge of [a, b), -1 if there is none."""
        return lengths.find(b - a, first[a], first[a + 1]) if b - a < 256 else -1

    while heap or i < len(waiting):
        if heap and (i == len(waiting) or heap[0] < waiting[i]):
            key = heapq.heappop(heap)
        else:
            key, i = waiting[i], i + 1
        a = key & mask
        if not alive[a] or (m := end[a]) == n:
            continue
        b = end[m]
        if (e := edge(a, b)) < 0 or rank[e] != key >> 40:
            continue  # one of the two has been joined with another
        alive[m] = 0
        end[a], begin[b - 1] = b, a
        if a and (e := edge(left := begin[a - 1], b)) >= 0:
            heapq.heappush(heap, rank[e] << 40 | left)
        if b < n and (e := edge(a, end[b])) >= 0:
            heapq.heappush(heap, rank[e] << 40 | a)
    at, edges, a = array("i"), array("i"), 0
    while a < n:
        at.append(a)
        edges.append(edge(a, end[a]) if end[a] - a > 1 else -1)
        a = end[a]
    return at, edges


def relaxed_together(m: Model, bounds: np.ndarray, start: np.ndarray, length: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, piece or -1) of the symbols of all chunks, by start: `relaxed` for many short chunks at once.

    In each round every chunk merges its best pair (rank, then leftmost); chunks without a pair are done. Only the pairs
    beside a merge are looked up again.
    """
    n, none = int(bounds[-1]), len(m.piece_rank)
    table = np.full((n, m.width + 1), -1, np.int32)
    table[start, length] = which
    ranks = np.append(m.piece_rank, np.int64(1) << 31)  # at -1: no piece
    at, chunk = np.arange(n), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at, chunk = at[(keep := at + 1 != bounds[chunk + 1])], chunk[keep]  # separators are no symbols
    size = np.ones(len(at), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []

    def rank_of(i: np.ndarray) -> np.ndarray:
        """Rank of the pair of symbols i and i + 1."""
        j = np.minimum(i + 1, len(at) - 1)
        both = size[i] + size[j]
        ok = (j > i) & (chunk[i] == chunk[j]) & (both <= m.width)
        return ranks[np.where(ok, table[at[i], np.where(ok, both, 0)], -1)]

    rank = rank_of(np.arange(len(at)))
    while len(at):
        firsts = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
        best = np.minimum.reduceat(rank * len(at) + np.arange(len(at)), firsts)
        live = best < ranks[none] * len(at)
        merge = best[live] % len(at)
        size[merge] += size[merge + 1]
        stay = np.repeat(live, np.diff(np.append(firsts, len(at))))
        done.append((at[~stay], size[~stay]))
        stay[merge + 1] = False
        place = np.cumsum(stay) - 1
        at, size, chunk, rank = at[stay], size[stay], chunk[stay], rank[stay]
        merged = place[merge]
        rank[merged] = rank_of(merged)
        left = merged[(merged > 0)] - 1
        rank[left] = rank_of(left)
    at, size = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (at, size)
    order = np.argsort(at, kind="stable")
    at, size = at[order], size[order]
    return at, size, np.where(size > 1, table[at, size], -1)


def symbol_ids(m: Model, points: np.ndarray, at: np.ndarray, size: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """The id of each symbol; -1 for a character that is no piece."""
    k = np.minimum(np.searchsorted(m.single_points, points[at]), len(m.single_points) - 1)
    single = np.where(m.single_points[k] == points[at], m.single_ids[k], -1)
    return np.where(size > 1, m.piece_ids[piece], single).astype("<i4")


class Known(dict):
    """Chunk -> ids: those remembered, and behind them those of the present batch."""

    rest: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        return self.rest[chunk]


class Codec:
    """Encodes chunks by the index and remembers them; one for a Python worker and model."""

    def __init__(self, path: str):
        self.model = model(path)
        self.known = Known()

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids (little-endian int32) of each chunk, by one index over all of them."""
        m, out = self.model, {}
        chunks = sorted(chunks, key=lambda c: len(c) > ROUND_CHARS)
        text = "\n".join(chunks) + "\n"  # an edge that runs over a bound is left out, so the separator may be any character
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        bounds = np.cumsum(np.concatenate(([0], sizes + 1)))
        start, length, which = m.edges(m.codes(text), bounds)
        n_short = int(np.count_nonzero(sizes <= ROUND_CHARS))
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if n_short:
            short = bounds[: n_short + 1]
            mine = int(np.searchsorted(start, short[-1]))
            symbols = relaxed_together(m, short, start[:mine], length[:mine], which[:mine])
            ids = symbol_ids(m, points, *symbols)
            cuts, raw = np.searchsorted(symbols[0], short), ids.tobytes()
            unknown = np.add.reduceat(np.append(ids < 0, False), cuts[:-1]) > 0
            unknown &= cuts[1:] > cuts[:-1]
            for chunk, x, y in zip(chunks, (4 * cuts[:-1]).tolist(), (4 * cuts[1:]).tolist(), strict=False):
                out[chunk] = raw[x:y]
            for i in np.flatnonzero(unknown).tolist():  # characters that are no piece
                x, y = cuts[i], cuts[i + 1]
                out[chunks[i]] = self.spelled(points[symbols[0][x:y]], ids[x:y])
        edge_cuts = np.searchsorted(start, bounds)
        for i in range(n_short, len(chunks)):  # long chunks one by one
            x, y, at = edge_cuts[i], edge_cuts[i + 1], int(bounds[i])
            symbols, edges = (np.frombuffer(v, np.int32) for v in relaxed(int(sizes[i]), start[x:y] - np.int32(at), length[x:y], which[x:y], m.piece_rank))
            size = np.where(edges >= 0, length[x:y][edges] if y > x else 1, 1)
            ids = symbol_ids(m, points, symbols + at, size, which[x:y][edges] if y > x else edges)
            out[chunks[i]] = self.spelled(points[symbols + at], ids) if (ids < 0).any() else ids.tobytes()
        return out

    def spelled(self, points: np.ndarray, ids: np.ndarray) -> bytes:
        """ids, with the bytes of a character (points: of each symbol's first) instead of each -1."""
        m, out = self.model, array("i")
        for c, k in zip(points, ids, strict=True):
            if k >= 0:
                out.append(k)
            else:
                out.extend(m.byte_id[v] for v in chr(c).encode("utf-8", "surrogatepass"))
        return out.tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        chunked = [CHUNK.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = list(set().union(*chunked).difference(self.known)) if chunked else []
        found, block, size = {}, [], 0
        for c in new:
            block.append(c)
            size += len(c)
            if size >= INDEX_CHARS:
                found |= self.learn(block)
                block, size = [], 0
        if block:
            found |= self.learn(block)
        room = CACHE_ENTRIES - len(self.known)
        self.known.update([x for x in found.items() if len(x[0]) <= CACHE_CHARS][:room] if room > 0 else ())
        self.known.rest = found
        return [b"".join(map(self.known.__getitem__, cs)) for cs in chunked]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes joined, U+2581 as space, without the space put in front."""
        m = self.model
        listed = ids.tolist()
        if m.byte_of.keys().isdisjoint(listed):
            text = "".join(map(m.text_of.__getitem__, listed))
        else:
            raw = b"".join(bytes((m.byte_of[i],)) if i in m.byte_of else m.text_of[i].encode() for i in listed)
            text = raw.decode("utf-8", "replace")
        text = text.replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


SCHEMA = "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, decoded_chars long, round_trip boolean"


def encoded(docs: DataFrame, path: str, carried: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids, ids_crc32 (of the ids as little-endian 32-bit integers), decoded_chars, round_trip, and the carried columns of docs."""
    small_arrow_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), *carried)
    schema = ", ".join([SCHEMA, *(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            raw = c.encode(texts)
            ids = [np.frombuffer(r, "<i4") for r in raw]
            back = [c.decode(i) for i in ids]
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.frombuffer(b"".join(raw), "<i4")
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                    pa.array([len(t) for t in back], pa.int64()),
                    pa.array([x == y for x, y in zip(back, texts, strict=True)], pa.bool_()),
                    *b.columns[2:],
                ],
                ["doc_id", "n_tokens", "ids", "ids_crc32", "decoded_chars", "round_trip", *b.schema.names[2:]],
            )

    return rows.mapInArrow(run, schema)


def decoded(encoded_: DataFrame, path: str) -> DataFrame:
    """doc_id, text of each row of (doc_id, ids)."""
    small_arrow_batches(encoded_.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [c.decode(np.array(i or [], np.int32)) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded_.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
