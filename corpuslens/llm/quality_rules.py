"""Quality rules: a threshold table compiled into one Spark projection.

Every rule is a row (name, value, lowest, highest): the value is an expression over measures of the text, the
rule fails outside [lowest, highest]. `compiled` turns the table into columns of one projection; there is no user
function, and the plan is a scan and a project, without a shuffle.

The measures are counted in whole texts. Words are runs of anything but space, tab, LF, VT, FF and CR. The repeated
windows of three words are found exactly: hashes of the windows tell whether a text has any; only such texts sort their
windows (with positions) and count the words that the repeated ones cover.

Defined results: null counts as the empty text (0 words, so it fails the base rule); ties and repeated rows are judged
each by itself; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")

#: Very common function words of the corpus's languages (en, de, fr, es), in lower case.
STOP_WORDS = sorted(
    set(
        "the of and to a in is that for it was on with as be by this are from or an "
        "der die das und in zu den ist von mit sich auf für ein eine dem nicht im auch er sie "
        "de la le et les des en un une du que est dans pour qui sur au par ou il pas "
        "que el en y a los se del las un por con no una para es al lo su".split()
    )
)


#: Languages that STOP_WORDS knows; a text said to be in another one isn't held to them.
LANGUAGES = ("en", "de", "fr", "es")


class Rule(NamedTuple):
    """Fails where value is below lowest or above highest (None: no bound)."""

    name: str
    value: Callable[[dict[str, Column]], Column]
    lowest: float | None
    highest: float | None


#: The base rule: fewer than 50 words, or repeated windows over more than half of the words.
BASE = [
    Rule("words", lambda m: m["n_words"], 50, None),
    Rule("repeat_words", lambda m: 100 * m["n_repeat_words"] - 50 * m["n_words"], None, 0),
]

#: The method's rules: mean word length 2 to 15, symbols at most a tenth of the words, duplicate lines at most half of the
#: lines, two different stop words at least (in languages that have them). Ratios are compared without division.
TABLE = [
    Rule("word_length", lambda m: m["word_chars"] - 2 * m["n_words"], 0, None),
    Rule("word_length_high", lambda m: m["word_chars"] - 15 * m["n_words"], None, 0),
    Rule("symbols", lambda m: 10 * m["n_symbols"] - m["n_words"], None, 0),
    Rule("duplicate_lines", lambda m: 10 * m["n_dup_lines"] - 5 * m["n_lines"], None, 0),
    Rule("stop_words", lambda m: m["n_stop_words"], 2, None),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: a lambda's variable isn't inlined by the optimizer."""
    return F.transform(F.array(value), body)[0]


def covered_words(words: Column, n: Column) -> Column:
    """Words inside windows of three that occur twice or more: exact, by sorted windows with their positions."""
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))

    def positions(s: Column) -> Column:
        alike = lambda x, other: F.coalesce(x["w"] == other["w"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: alike(x, F.get(s, k - 1)) | alike(x, F.get(s, k + 1))), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        # a window adds 3 words, less where the next one starts within it
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(F.sort_array(windows), lambda s: let(positions(s), covered))


def repeat_words(words: Column) -> Column:
    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def measured(w: Column) -> Column:
        n = F.size(w)
        any_twice = let(hashes(w), lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.when(n < 4, F.lit(0).cast("long")).when(any_twice, covered_words(w, n)).otherwise(F.lit(0).cast("long"))

    return let(words, measured)


def measures(t: Column, words: Column) -> list[Column]:
    """MEASURES of a text and its words."""
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stops = F.array(*(F.lit(w) for w in STOP_WORDS))
    count = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeat_words(words),
        "n_lines": F.size(lines),
        "n_stop_words": F.size(F.array_intersect(words, stops)),
    }
    return [count[k].cast("long").alias(k) for k in MEASURES]


def fails(rules: list[Rule], m: dict[str, Column]) -> Column:
    """True where a rule fails: the table as one Boolean expression."""
    failed = F.lit(False)
    for r in rules:
        v = r.value(m)
        for bad in ([v < F.lit(r.lowest)] if r.lowest is not None else []) + ([v > F.lit(r.highest)] if r.highest is not None else []):
            failed = failed | bad
    return failed


def compiled(text: str = "text", table_: list[Rule] = TABLE, base: list[Rule] = BASE, lang: Column | None = None) -> Column:
    """The table as one expression: a struct of MEASURES, base_failed and kept, every measure evaluated once.

    lang: the text's language; where it is one without stop words, that rule doesn't hold. None or null: it holds.
    """

    def judged(m: Column) -> Column:
        by_name = {k: m[k] for k in MEASURES}
        base_failed = fails(base, by_name)
        stops = [r for r in table_ if r.name == "stop_words"]
        failed = fails([r for r in table_ if r not in stops], by_name) | fails(stops, by_name) & (F.lit(True) if lang is None else F.coalesce(lang.isin(*LANGUAGES), F.lit(True)))
        return F.struct(*(m[k].alias(k) for k in MEASURES), base_failed.alias("base_failed"), (~base_failed & ~failed).alias("kept"))

    words = F.regexp_extract_all(text_of(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return let(let(words, lambda w: F.struct(*measures(text_of(text), w))), judged)


def language(docs: DataFrame) -> Column | None:
    return F.col("lang") if "lang" in docs.columns else None


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES, base_failed, kept for each row of docs (doc_id, text, lang if there is one)."""
    return docs.select("doc_id", compiled(lang=language(docs)).alias("v")).select("doc_id", *(F.col("v")[k].alias(k) for k in (*MEASURES, "base_failed", "kept")))


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their columns as they were."""
    return docs.filter(compiled(lang=language(docs))["kept"])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


OP10_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
windows AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS x FROM (SELECT rid, words, unnest(range(1, greatest(1, len(words) - 1))) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS c FROM windows) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
m AS (
  SELECT doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
         len(list_distinct(list_filter(words, lambda x: x IN ({", ".join(f"'{w}'" for w in STOP_WORDS)})))) AS n_stop_words
  FROM w LEFT JOIN covered USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT * EXCLUDE (lang), NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words AND 10 * n_symbols <= n_words AND 10 * n_dup_lines <= 5 * n_lines AND (n_stop_words >= 2 OR lang NOT IN ({", ".join(f"'{x}'" for x in LANGUAGES)}) IS TRUE) AS kept FROM b
"""
