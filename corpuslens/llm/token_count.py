"""Token counts by the whole-token shortcut.

A byte-level BPE cuts a text into pre-tokens first and merges within each. Which vocabulary strings come out of the
encoder as exactly one token, when encoded alone, is proved once per vocabulary file (`whole_tokens`). A pre-token that
equals a proved string counts 1 without any merge; the library merges only the others, each distinct one once for a
Python worker (bounded cache).

Pre-tokens are found with a plain pattern whose classes are spelled out for the characters below U+0250. A text with any
other character is cut by the file's own pre-tokenizer, so that the library's Unicode tables hold, and its pre-tokens are
looked up all the same. The vocabulary's special strings are cut out first; each is one token, as is the library's default.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows and rows of one doc_id are counted each, so there are no ties; an empty table gives an
empty result; very long texts are counted whole, by a running sum without a list of their pre-tokens; other columns of
the input, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from tokenizers import Tokenizer

from .common import small_arrow_batches, table, text_of

#: Characters whose class is the same in every Unicode version, and no control characters but tab, LF and CR.
PLAIN_END = 0x250
LONG_TEXT = 4_000_000
CACHE_ENTRIES, CACHE_CHARS = 400_000, 64


def char_class(kind: str) -> str:
    """The plain characters of a general category (L, N), as the inside of a pattern's [ ]."""
    return "".join(re.escape(c) for c in map(chr, range(PLAIN_END)) if unicodedata.category(c)[0] == kind)


LETTERS, NUMBERS = char_class("L"), char_class("N")
NOT_PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa0-\\u024f]")
SPACES = "\\t\\n\\r \\xa0"
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


@lru_cache(maxsize=4)
def encoder(path: str) -> Tokenizer:
    """The library's tokenizer of a file, one for a process."""
    return Tokenizer.from_file(path)


def byte_alphabet() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: itself if it is visible, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings that, encoded alone, give exactly one token: the shortcut's proof, by the library itself."""
    t, to_byte = encoder(path), byte_alphabet()
    special = {x.content for x in t.get_added_tokens_decoder().values()}
    strings = []
    for piece in t.get_vocab():
        if piece in special or not all(c in to_byte for c in piece):
            continue
        try:
            strings.append(bytes(to_byte[c] for c in piece).decode("utf-8"))
        except UnicodeDecodeError:
            continue  # part of a character: no pre-token equals it
    one = t.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, one, strict=True) if len(e.ids) == 1)


class Counts(dict):
    """Pre-token -> number of tokens; what isn't known is merged by the library."""

    def __init__(self, path: str, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.encoder, self.room = encoder(path), CACHE_ENTRIES
        added = list(self.encoder.get_added_tokens_decoder().values())
        if self.encoder.normalizer is not None or any(x.normalized or x.lstrip or x.rstrip or x.single_word for x in added):
            raise ValueError("expected a file without normalizer, whose special strings stand for themselves alone")
        self.special = re.compile("|".join(re.escape(x.content) for x in sorted(added, key=lambda x: -len(x.content)))) if added else None
        self.cut = self.encoder.pre_tokenizer.pre_tokenize_str

    def __missing__(self, word: str) -> int:
        n = len(self.encoder.encode(word, add_special_tokens=False).ids)
        if len(word) <= CACHE_CHARS and self.room:
            self.room -= 1
            self[word] = n
        return n

    def pre_tokens(self, text: str) -> Iterator[str]:
        """The pre-tokens of a text without special strings."""
        if not NOT_PLAIN.search(text):
            return (m[0] for m in PRE_TOKEN.finditer(text)) if len(text) > LONG_TEXT else iter(PRE_TOKEN.findall(text))
        return (text[a:b] for _, (a, b) in self.cut(text))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return sum(map(self.__getitem__, self.pre_tokens(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pre_tokens(p))) for p in parts if p)


_counts: dict[str, Counts] = {}


def counts_of(path: str, whole: frozenset[str]) -> Counts:
    """One table of counts for a Python worker, kept from task to task."""
    if path not in _counts:
        _counts[path] = Counts(path, whole)
    return _counts[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs (doc_id, text).

    path: a tokenizers .json with a byte-level BPE, present on every executor. The proof runs on the driver; its set of
    strings, bounded by the vocabulary, is broadcast.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    proved = spark.sparkContext.broadcast(whole_tokens(path))

    @F.pandas_udf(LongType())
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = counts_of(path, proved.value)
        for texts in batches:
            yield pd.Series([counts.count(t) for t in texts], dtype="int64")

    text = text_of()
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
