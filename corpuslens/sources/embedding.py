"""Text embeddings on executors: a caller's model, loaded once for each Python worker, behind the embedding cache; model asset checks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.sources import corpus as co
from corpuslens.sources.shared import written

#: Tokens of a window and how many two neighbours share; windows that go to the model together.
WINDOW, OVERLAP, TOGETHER = 256, 64, 4


def windows(tokens: list, size: int = WINDOW, overlap: int = OVERLAP) -> list[list]:
    """The windows that cover all tokens; one, perhaps empty, at least."""
    last = max(1, -(-(len(tokens) - overlap) // (size - overlap)))
    return [tokens[k * (size - overlap) : k * (size - overlap) + size] for k in range(last)]


def embedded(passages: DataFrame, load: Callable[[], tuple[Callable, Callable]], cache: DataFrame | None = None, role: str = "passage") -> DataFrame:
    """key, embedding (array of arrays: a unit vector for each window) of every distinct text of passages (text).

    load: called once in a Python worker, gives (tokens of a text, vectors of a list of windows). cache: key, embedding; what it has isn't
    embedded again. A null text counts as empty. Vectors of length 0 stay as they are."""
    wanted = passages.select(co.embedding_key(F.lit(role), F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    missing = wanted.dropDuplicates(["key"]) if cache is None else co.cache_misses(wanted, cache)

    @F.pandas_udf("array<array<float>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens, vectors = load()
        for texts in batches:
            cut = [windows(tokens(t)) for t in texts]
            flat = [w for ws in cut for w in ws]
            found = [v for k in range(0, len(flat), TOGETHER) for v in vectors(flat[k : k + TOGETHER])]
            unit = [(np.asarray(v, float) / (np.linalg.norm(v) or 1.0)).tolist() for v in found]
            ends = np.cumsum([0, *map(len, cut)])
            yield pd.Series([unit[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], dtype=object)

    new = written(missing.select("key", run("text").alias("embedding")), "embeddings")
    return new if cache is None else new.unionByName(cache.join(wanted.select("key").distinct(), "key", "left_semi").select("key", "embedding"))


def checked_assets(folder: str, pinned: Mapping[str, tuple[int, str]]) -> dict[str, str]:
    """Asset name -> ok, missing, wrong-size or wrong-hash, by pinned (bytes, sha256). Files are read in blocks, on the driver."""
    out = {}
    for name, (size, digest) in pinned.items():
        try:
            with open(f"{folder}/{name}", "rb") as f:
                h, n = hashlib.sha256(), 0
                while block := f.read(1 << 20):
                    h.update(block)
                    n += len(block)
        except FileNotFoundError:
            out[name] = "missing"
            continue
        out[name] = "wrong-size" if n != size else "ok" if h.hexdigest() == digest else "wrong-hash"
    return out
