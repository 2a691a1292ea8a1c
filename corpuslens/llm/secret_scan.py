"""Secret scans with a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is taken apart on the driver: stretches whose strings can be listed give alternatives,
an alternative gives the set of its trigrams (lower case), and the rule's Boolean query is an AND over stretches of an OR
over alternatives of an AND over trigrams. The index has a posting (trigram, row) for every trigram that some rule asks
for. The queries' intersections of postings give candidate rows, which the regular expression then verifies. A rule
without a stretch of mandatory trigrams (hex strings) is matched against every text.

Spans are found without a user function: the texts between matches and the matches, in turn, have lengths whose prefix
sums are the code point offsets.

Defined results: null counts as the empty text (no spans: empty strings and zeros); repeated rows are scanned each; spans that begin at
one place are ordered by the rules' order; every rule looks at a character a bounded number of times, so a text of any length takes time
in proportion; an empty table gives an empty result; extra columns aren't looked at; texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import product
from re import _constants as sre
from re import _parser as sre_parse
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, same, stored, table, text_key, text_of
from .quality_rules import let

#: Alternatives of a stretch, and characters of a class, beyond which the stretch ends there.
MOST_STRINGS, MOST_CHARS = 24, 8


class Rule(NamedTuple):
    """A kind of secret. A match counts if its `group` has at least `least` characters."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0


#: Fixed patterns: the first three are the base kinds, in their order.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"sk_live_[A-Za-z0-9]{16,}"),
    # not from within a run of such characters, so that a run is looked at once
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE_KINDS = 3


# --- trigram queries ------------------------------------------------------------------------------------------------


def stretches(pattern: str) -> list[set[str]]:
    """Finite sets of lower-case strings, each of which every match must run through, in order."""
    done: list[set[str]] = []
    run = {""}

    def close() -> None:
        nonlocal run
        if run != {""}:
            done.append(run)
        run = {""}

    def strings(items) -> set[str] | None:
        """All strings of a sub-pattern, if they can be listed."""
        out = {""}
        for op, arg in items:
            if op is sre.LITERAL:
                step = {chr(arg).lower()}
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= MOST_CHARS:
                step = {chr(c).lower() for _, c in arg}
            elif op is sre.SUBPATTERN:
                step = strings(arg[3])
            elif op is sre.BRANCH:
                parts = [strings(x) for x in arg[1]]
                step = None if None in parts else set().union(*parts)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] != sre.MAXREPEAT and arg[1] <= 4:
                inner = strings(arg[2])
                step = None if inner is None else {"".join(p) for k in range(arg[0], arg[1] + 1) for p in product(inner, repeat=k)}
            else:
                step = None
            if step is None or len(out) * len(step) > MOST_STRINGS:
                return None
            out = {a + b for a, b in product(out, step)}
        return out

    for item in sre_parse.parse(pattern):
        step = strings([item])
        if step is None:
            close()
            if item[0] in (sre.MAX_REPEAT, sre.MIN_REPEAT) and item[1][0] == 1 and (inner := strings(item[1][2])):
                run = inner  # once at least
                close()
        elif len(run) * len(step) > MOST_STRINGS:
            close()
            run = step
        else:
            run = {a + b for a, b in product(run, step)}
    close()
    return done


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND over stretches of OR over alternatives of AND over trigrams; an empty list says: scan fully."""
    out = []
    for run in stretches(pattern):
        sets = {trigrams(s) for s in run}
        if frozenset() in sets:
            continue  # an alternative without a trigram: the stretch demands nothing
        out.append(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))
    return out


# --- the index ------------------------------------------------------------------------------------------------------


def trigram_index(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """trigram, doc_id, text_key: a posting for each wanted trigram (lower case) of each row of docs, written sorted."""
    has = let(F.lower(text_of()), lambda t: F.array_compact(F.array(*(F.when(F.contains(t, F.lit(g)), F.lit(g)) for g in wanted))))
    postings = docs.select("doc_id", text_key().alias("text_key"), F.explode(has).alias("trigram"))
    return stored(postings.sortWithinPartitions("trigram"), "trigrams")


def candidates(index: DataFrame, queries: dict[str, list[list[frozenset[str]]]]) -> DataFrame:
    """doc_id, text_key, kinds: the rows whose postings satisfy a kind's query, and those kinds.

    One exchange, by row; the three steps of the Boolean query (all trigrams of an alternative, any alternative of a
    stretch, all stretches of a kind) are aggregations within it, over bit masks, so repeated rows change nothing.
    """
    asked = [(kind, 1 << i, j, 1 << k, (1 << len(alternative)) - 1, g) for kind, query in queries.items() for i, run in enumerate(query) for j, alternative in enumerate(run) for k, g in enumerate(sorted(alternative))]
    rows = ", ".join(f"('{kind}', {i}L, {j}, {bit}L, {full}L, {quoted(g)})" for kind, i, j, bit, full, g in asked)
    table_ = index.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(kind, stretch, alternative, bit, full, trigram)")  # grows with the rules only
    key = ["doc_id", "text_key"]
    hits = index.join(F.broadcast(table_), "trigram").repartition(*key)
    alternatives = hits.groupBy(*key, "kind", "stretch", "alternative").agg(F.bit_or("bit").alias("got"), F.max("full").alias("full")).filter("got = full")
    needed = F.create_map(*(F.lit(x) for kind, q in queries.items() for x in (kind, (1 << len(q)) - 1)))
    kinds = alternatives.groupBy(*key, "kind").agg(F.bit_or("stretch").alias("got")).filter(F.col("got") == needed[F.col("kind")])
    return kinds.groupBy(*key).agg(F.collect_set("kind").alias("kinds"))


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


# --- spans ----------------------------------------------------------------------------------------------------------


def prefix_sums(values: Column, block: int = 128) -> Column:
    """Running sums (inclusive) of an array of longs: folds of short blocks, then of the blocks' totals."""
    zero = F.lit(0).cast("long")

    def fold(a: Column) -> Column:
        start = F.struct(zero.alias("s"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(a, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"] + x)).alias("a")), lambda acc: acc["a"])

    def joined(v: Column) -> Column:
        n_blocks = F.ceil(F.size(v) / F.lit(block)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: fold(F.slice(v, b * block + 1, F.lit(block))))

        def shifted(bs: Column) -> Column:
            totals = fold(F.transform(bs, lambda x: F.element_at(x, -1)))
            return let(totals, lambda t: F.flatten(F.transform(bs, lambda x, i: F.transform(x, lambda y: y + F.coalesce(F.get(t, i - 1), zero)))))

        return F.when(F.size(v) > 0, let(blocks, shifted)).otherwise(F.array().cast("array<bigint>"))

    return let(values, joined)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, kind_order, end, kind>> of a rule's counted matches, leftmost and non-overlapping."""
    pattern = ("(?i)" if rule.ignore_case else "") + rule.pattern
    empty = F.array().cast("array<struct<start:bigint,kind_order:int,end:bigint,kind:string>>")

    def placed(found: Column) -> Column:
        lengths = F.transform(found, lambda m: F.length(m).cast("long"))
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))

        def spans(n: Column) -> Column:
            ends = prefix_sums(F.zip_with(F.slice(gaps, F.lit(1), F.size(n)), n, lambda g, m: g + m))
            return F.zip_with(ends, n, lambda e, m: F.struct((e - m).alias("start"), F.lit(order).alias("kind_order"), e.alias("end"), F.lit(rule.kind).alias("kind")))

        out = let(lengths, spans)
        if rule.least:
            counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
            out = let(counted, lambda c: F.filter(out, lambda _, i: F.length(F.get(c, i)) >= rule.least))
        return F.when(F.size(found) > 0, out).otherwise(empty)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, found (array of start, kind_order, end, kind; sorted) for each row of docs (doc_id, text)."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    wanted = sorted({g for q in queries.values() for run in q for alternative in run for g in alternative})
    docs = docs.select("doc_id", text_of().alias("text"), text_key().alias("text_key"))
    found = stored(candidates(trigram_index(docs, wanted), queries), "candidates") if queries else None
    if found is None:
        rows, kinds = docs.withColumn("kinds", F.array().cast("array<string>")), F.col("kinds")
    else:
        found = found.withColumnsRenamed({"doc_id": "c_id", "text_key": "c_key"})
        found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
        rows, kinds = docs.join(found, same(docs, found, [("doc_id", "c_id"), ("text_key", "c_key")]), "left"), F.col("kinds")
    none = F.array().cast("array<struct<start:bigint,kind_order:int,end:bigint,kind:string>>")
    text = F.col("text")
    each = [F.when(F.coalesce(F.array_contains(kinds, r.kind), F.lit(False)), spans_of(text, r, i)).otherwise(none) if r.kind in queries else spans_of(text, r, i) for i, r in enumerate(rules)]
    return rows.select("doc_id", F.sort_array(F.flatten(F.array(*each))).alias("found"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    written: Callable[[Column], Column] = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind_order"] == k)).cast("long")
    base = written(F.filter("found", lambda x: x["kind_order"] < BASE_KINDS))
    return found.select("doc_id", *(count(i).alias(f"n_{RULES[i].kind}") for i in range(BASE_KINDS)), F.sha2(base.cast("binary"), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for op2's rows: the same prefix sums over texts between matches, for each kind, without the index."""
    each = []
    for k, r in enumerate(rules):
        # DuckDB has no look-behind: the character before is matched too, and taken off the span again
        behind = re.match(r"\(\?<!\[(.*?)\]\)(.*)", r.pattern)
        p = ("(?i)" if r.ignore_case else "") + (f"(^|[^{behind[1]}])({behind[2]})" if behind else r.pattern)
        p = "'" + p.replace("'", "''") + "'"
        counted = f"regexp_extract_all(text, {p}, {2 if behind else r.group})"
        first = "s + n - counted" if behind else "s"
        each.append(
            f"SELECT rid, {k} AS o, '{r.kind}' AS kind, {first} AS s, s + n AS e FROM (SELECT rid, list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS s, length(m[k]) AS n, length(c[k]) AS counted"
            f" FROM (SELECT rid, m, g, c, unnest(range(1, len(m) + 1)) AS k FROM (SELECT rid, regexp_extract_all(text, {p}) AS m, regexp_split_to_array(text, {p}) AS g, {counted} AS c FROM t))) WHERE counted >= {r.least}"
        )
    written = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    return (
        "WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),\n spans AS (" + "\n UNION ALL ".join(each) + "),\n"
        + " l AS (SELECT rid, "
        + ", ".join(f"count(*) FILTER (o = {k}) AS n_{rules[k].kind}" for k in range(BASE_KINDS))
        + f", string_agg({written}, ',' ORDER BY s, o) FILTER (o < {BASE_KINDS}) AS base, string_agg({written}, ',' ORDER BY s, o) AS spans FROM spans GROUP BY rid)\n"
        + "SELECT doc_id, " + ", ".join(f"coalesce(n_{rules[k].kind}, 0) AS n_{rules[k].kind}" for k in range(BASE_KINDS)) + ", sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN l USING (rid)"
    )
