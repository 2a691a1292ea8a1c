"""Occurrences in what changed between two versions: changed sources with their texts, changed lines as byte ranges, matches within them.

A source's two texts meet in one row, so the line comparison, the occurrences and the test of one against the other stay within
the row. Occurrences and changed ranges are both sorted and free of overlap, so each occurrence is tested against one range: the first
that ends where it ends or later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import scanners as sc
from corpuslens.functions import text as tx
from corpuslens.operators import compare as cm

RANGE = "struct<old:string,new:string,lines:string,first:array<bigint>,last:array<bigint>,start:array<bigint>,end:array<bigint>>"
HIT = "byte_start:bigint,byte_end:bigint,line_no:int"


def changed_sources(base: DataFrame, target: DataFrame, renames: bool = False) -> DataFrame:
    """path, change (added, removed, modified, renamed), old_path, similarity, old, new (texts; null on a side that lacks the source)
    of two versions (path, text, content_hash). A renamed source is one row, by its new path."""
    b = base.select("path", F.col("text").alias("old"), F.col("content_hash").alias("h"))
    t = target.select("path", F.col("text").alias("new"), F.col("content_hash").alias("g"))
    change = F.when(F.col("h").isNull(), "added").when(F.col("g").isNull(), "removed").when(F.col("h") != F.col("g"), "modified")
    none = lambda kind: F.lit(None).cast(kind)
    out = b.join(t, "path", "full_outer").select("path", change.alias("change"), none("string").alias("old_path"), none("long").alias("similarity"), "old", "new").filter("change is not null")
    if not renames:
        return out
    facts = lambda v: v.select("path", "text", "content_hash", F.octet_length("text").alias("size"))
    pairs = cm.rename_pairs(facts(base).join(target.select("path"), "path", "left_anti"), facts(target).join(base.select("path"), "path", "left_anti"))
    met = pairs.join(b.select(F.col("path").alias("old_path"), "old"), "old_path").join(t.select(F.col("path").alias("new_path"), "new"), "new_path")
    rest = out.join(pairs.select(F.col("old_path").alias("path")), "path", "left_anti").join(pairs.select(F.col("new_path").alias("path")), "path", "left_anti")
    return rest.unionByName(met.select(F.col("new_path").alias("path"), F.lit("renamed").alias("change"), "old_path", "similarity", "old", "new"))


def line_starts(text: str) -> np.ndarray:
    """Byte offsets of the lines of a text, and its length in bytes at the end; a last line feed opens no further line."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    after = np.flatnonzero(raw == 10) + 1
    return np.concatenate([[0], after, [len(raw)]] if len(raw) and (not len(after) or after[-1] < len(raw)) else [[0], after]).astype(np.int64)


def byte_ranges(lines: list[tuple[int, int]], text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends in bytes of line ranges (from 1, last included): a range ends with its last line's line feed."""
    at = line_starts(text)
    first, last = (np.array([r[i] for r in lines], np.int64) for i in (0, 1))
    return at[first - 1], at[last]


def inside(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray, size: int, unended: bool) -> np.ndarray:
    """Which sorted occurrences lie in a range of sorted ranges. An empty one at a range's end is in it at the end of the text only,
    if its last line has no line feed: else it is the start of a line that didn't change."""
    if not len(first):
        return np.zeros(len(starts), bool)
    k = np.minimum(np.searchsorted(last, ends, "left"), len(first) - 1)
    held = (starts >= first[k]) & (ends <= last[k])
    return held & ((ends > starts) | (starts < last[k]) | ((last[k] == size) & unended))


def changed_ranges(old: Column, new: Column, side: str, work: int | None = None) -> Column:
    """struct<old, new, lines, first, last, start, end>: the lines of both sides that a shortest edit script touches, as text, and those
    of the asked side also as numbers and bytes; a source that the other side lacks has all its lines. Null where the side has no source,
    or, if a number of steps is given, the comparison needs more: the caller has to say so."""
    all_lines = lambda text: [(1, n)] if text is not None and (n := len(line_starts(text)) - 1) else []

    @sc.batched_udf(RANGE)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for olds, news in batches:
            rows = []
            for a, b in zip(olds, news, strict=True):
                own = b if side == "new" else a
                try:
                    both = (all_lines(a), all_lines(b)) if a is None or b is None else sc.changed_ranges(a, b, work)
                except sc.WorkLimit:
                    both = None
                if own is None or both is None:
                    rows.append((None,) * 7)
                    continue
                lines = both[side == "new"]
                start, end = byte_ranges(lines, own)
                rows.append((*map(sc.written, both), sc.written(lines), [x for x, _ in lines], [y for _, y in lines], start, end))
            yield pd.DataFrame(rows, columns=["old", "new", "lines", "first", "last", "start", "end"])

    return run.asNondeterministic()(old, new)  # so that it is computed once for all its fields


def by_line(pattern: str) -> str:
    """A compiled pattern whose ^ and $ stand at line feeds too."""
    return pattern.replace("(?d", "(?dm", 1)


def with_hits(rows: DataFrame, found: Column, ranged: bool, characters: int = 0) -> DataFrame:
    """rows (text, ranges) with hits: array<struct<byte_start, byte_end, line_no>> of the given occurrences (`tx.occurrences`); if ranged, of
    those within the row's changed ranges; a text with occurrences and unknown ranges is an error, as no rows would look like no changes.
    With `characters`, also the start of the line that each begins in, so many long at most: a whole line with each of its occurrences
    would grow with the square of a long line. A text without an occurrence isn't passed on."""

    @sc.batched_udf(f"array<struct<{HIT}{',line:string' * bool(characters)}>>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            if ranged and any(text is not None and first is None for text, first in zip(columns[0], columns[3], strict=True)):
                raise ValueError("the changed lines of a source with occurrences are unknown")
            yield pd.Series([hits(*x, characters) for x in zip(*columns, strict=True)], dtype=object)

    bounds = [F.col(f"ranges.{c}") if ranged else F.lit(None).cast("array<bigint>") for c in ("start", "end")]
    placed = rows.withColumn("found_", found)
    text = F.when(F.size("found_") > 0, F.col("text"))
    return placed.withColumn("hits", run.asNondeterministic()(text, F.col("found_.byte_start"), F.col("found_.byte_end"), *bounds)).drop("found_")


def hits(text: str | None, starts, ends, first, last, characters: int | None = None) -> list[dict]:
    """The occurrences as `with_hits` gives them; without a number of characters, with whole lines."""
    if text is None:
        return []
    raw, at = text.encode("utf-8", "surrogatepass"), line_starts(text)
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    if first is not None:
        kept = inside(starts, ends, np.asarray(first, np.int64), np.asarray(last, np.int64), len(raw), not raw.endswith(b"\n"))
        starts, ends = starts[kept], ends[kept]
    number = np.clip(np.searchsorted(at, starts, "right"), 1, max(1, len(at) - 1))
    places = [{"byte_start": int(s), "byte_end": int(e), "line_no": int(k)} for s, e, k in zip(starts, ends, number, strict=True)]
    lines: dict[int, str] = {}
    for place in places if characters != 0 else ():
        if (k := place["line_no"]) not in lines:
            own = raw[at[k - 1] : at[k] if k < len(at) else len(raw)]
            lines[k] = own.decode("utf-8", "surrogatepass").removesuffix("\n")[:characters]
        place["line"] = lines[k]
    return places
