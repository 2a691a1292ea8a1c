"""Column functions on text: lines, occurrences with byte offsets, case policy, excerpts, tokens, redaction, paths.

Patterns are Java's with `(?d)`, so that only LF ends a line for `.`, `^` and `$`; `(?iu)` folds case in Unicode.
Byte offsets count UTF-8 bytes, lines start at 1, columns are in code points unless a name says UTF-16.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that retrieval passes over.
STOP_WORDS = ["the", "a", "an", "is", "are", "of", "to", "in", "and", "or", "for", "how", "where", "what", "的", "了", "是", "在", "和", "如何", "哪里", "什么"]
WORD = r"[\p{L}\p{N}_]"
MAX_LINE_CHARACTERS = 500


def let(value: Column, body) -> Column:
    """body(value), value evaluated once."""
    return F.transform(F.array(value), body)[0]


# --- patterns -------------------------------------------------------------------------------------------------------


def escaped(literal: str) -> str:
    """A pattern that matches the literal and nothing else."""
    return "".join(c if c.isalnum() or c == "_" else f"\\x{{{ord(c):x}}}" for c in literal)


def has_upper_literal(pattern: str) -> bool:
    """An upper-case literal character, escapes such as \\S and \\p{L} apart."""
    bare = re.sub(r"\\[pP]\{[^}]*\}|\\[pP].|\\x\{[^}]*\}|\\.", "", pattern)
    return any(c.isupper() for c in bare)


def compiled_pattern(pattern: str, *, literal: bool = False, ignore_case: bool | None = False, whole_word: bool = False) -> str:
    """The Java pattern of a request. ignore_case None is smart case: insensitive unless the pattern has an upper-case literal."""
    insensitive = (not any(c.isupper() for c in pattern) if literal else not has_upper_literal(pattern)) if ignore_case is None else ignore_case
    body = escaped(pattern) if literal else pattern
    if whole_word:
        body = f"(?<!{WORD})(?:{body})(?!{WORD})"
    return ("(?diu)" if insensitive else "(?d)") + body


def line_matches(line: Column, pattern: str, *, literal: bool = False, ignore_case: bool | None = False, whole_word: bool = False) -> Column:
    """Whether a line matches; a plain literal never becomes a regular expression."""
    sensitive = ignore_case is False or (ignore_case is None and any(c.isupper() for c in pattern))
    if literal and sensitive and not whole_word:
        return F.contains(line, F.lit(pattern))
    return line.rlike(compiled_pattern(pattern, literal=literal, ignore_case=ignore_case, whole_word=whole_word))


# --- lines and occurrences ------------------------------------------------------------------------------------------


def lines_of(text: Column) -> Column:
    """array<string>: LF-ended lines; the empty piece after a last LF isn't a line."""
    return let(F.split(text, "\n", -1), lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a))


def line_count(text: Column) -> Column:
    """Line feeds, and one more for an unterminated last line."""
    return F.regexp_count(text, F.lit("\n")) + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)


def running(values: Column, block: int = 128) -> Column:
    """Inclusive running sums of an array of longs, by blocks, so that a long array takes no quadratic time."""
    zero = F.lit(0).cast("long")

    def fold(a: Column) -> Column:
        start = F.struct(zero.alias("s"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(a, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"] + x)).alias("a")), lambda acc: acc["a"])

    def whole(v: Column) -> Column:
        last = F.ceil(F.size(v) / F.lit(block)).cast("int") - 1
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: fold(F.slice(v, b * block + 1, F.lit(block))))
        shifted = lambda bs: let(fold(F.transform(bs, lambda x: F.element_at(x, -1))), lambda t: F.flatten(F.transform(bs, lambda x, i: F.transform(x, lambda y: y + F.coalesce(F.get(t, i - 1), zero)))))
        return F.when(F.size(v) > 0, let(blocks, shifted)).otherwise(F.array().cast("array<bigint>"))

    return let(values, whole)


def occurrences(text: Column, pattern: str, unit=F.octet_length, names: tuple[str, str] = ("byte_start", "byte_end")) -> Column:
    """array<struct<byte_start,byte_end>> of the non-overlapping matches of a pattern that can't match nothing.

    unit: what offsets count (F.length: code points), and the names of the two."""
    size = lambda x: unit(x).cast("long")

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = running(F.zip_with(gaps, found, lambda g, m: size(g) + size(m)))
        return F.zip_with(ends, found, lambda e, m: F.struct((e - size(m)).alias(names[0]), e.alias(names[1])))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond U+FFFF count twice."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def byte_pages(text: Column, most: int) -> Column:
    """array<struct<byte_start,byte_end>>: the text's UTF-8 bytes in pieces of at most `most` (4 or more), each as long as it can be
    without a character cut in two. Of an empty text, none; of null, null."""

    def cut(raw: Column) -> Column:
        n = F.octet_length(raw)
        inside = lambda p: F.hex(F.substring(raw, p + 1, F.lit(1))).between("80", "BF")  # noqa: E731  a byte within a character
        snapped = lambda p: F.when(p >= n, n).when(~inside(p), p).when(~inside(p - 1), p - 1).when(~inside(p - 2), p - 2).otherwise(p - 3)
        steps = F.sequence(F.lit(0), F.ceil(n / F.lit(most - 3)).cast("int"))
        ends = F.aggregate(steps, F.array(F.lit(0)), lambda acc, _: F.when(F.element_at(acc, -1) >= n, acc).otherwise(F.concat(acc, F.array(snapped(F.element_at(acc, -1) + most)))))
        return let(ends, lambda e: F.zip_with(F.slice(e, F.lit(1), F.size(e) - 1), F.slice(e, F.lit(2), F.size(e) - 1), lambda a, b: F.struct(a.cast("long").alias("byte_start"), b.cast("long").alias("byte_end"))))

    return let(F.encode(text, "UTF-8"), cut)


# --- projections ----------------------------------------------------------------------------------------------------


def excerpt(text: Column, focus_start: Column, focus_end: Column, maximum: int = MAX_LINE_CHARACTERS) -> Column:
    """At most `maximum` characters around the focus, with ellipses where text was cut."""
    n = F.length(text)
    start = F.greatest(F.lit(0), F.least(F.floor(focus_start), n))
    end = F.greatest(start, F.least(F.floor(focus_end), n))
    width = end - start
    at = F.when(width >= maximum, F.least(start, n - maximum)).otherwise(F.least(F.greatest(F.lit(0), start - F.floor((maximum - width) / 2)), n - maximum))
    cut = F.concat(F.when(at > 0, "…").otherwise(""), F.substring(text, (at + 1).cast("int"), F.lit(maximum)), F.when(at + maximum < n, "…").otherwise(""))
    return F.when(n <= maximum, text).otherwise(cut)


def retrieval_tokens(text: Column) -> Column:
    """Words in lower case with camel case split, stop words left out, repeats kept; runs of three or more Han characters add their bigrams.
    What lies between words is split off, which is half the cost of collecting them."""
    words = F.split(F.lower(F.regexp_replace(text, r"([a-z\d])([A-Z])", "$1 $2")), r"[^\p{L}\p{N}_]+", -1)
    none = F.array(*map(F.lit, ["", *STOP_WORDS]))
    kept = F.filter(words, lambda w: ~F.array_contains(none, w))
    bigrams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))
    with_bigrams = F.flatten(F.transform(kept, lambda w: F.when(w.rlike(r"^\p{IsHan}{3,}$"), F.concat(F.array(w), bigrams(w))).otherwise(F.array(w))))
    return F.when(text.rlike(r"\p{IsHan}{3}"), with_bigrams).otherwise(kept)


def concept_ranking_score(cosine: Column, length: Column) -> Column:
    """Cosine less up to 0.02 for passages shorter than 500 units."""
    return cosine - F.lit(0.02) * (F.lit(1.0) - F.sqrt(F.least(length / F.lit(500.0), F.lit(1.0))))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


# --- paths ----------------------------------------------------------------------------------------------------------


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """From the last dot of the name, if it isn't the name's first character; lower case; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def directory(path: Column) -> Column:
    """The path before the last slash; '.' for the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(".")


def is_hidden(path: Column) -> Column:
    return path.rlike(r"(?:^|/)\.[^/]")


def in_git(path: Column) -> Column:
    return F.array_contains(F.split(F.lower(path), "/"), ".git")


def glob_pattern(glob: str) -> str:
    """The pattern of a glob over a whole path: ** crosses directories, * and ? don't; {a,b} and [abc] as usual. A glob without
    a slash matches at any depth."""
    g = glob[1:] if glob.startswith("!") else glob
    out, i, depth = "", 0, 0
    while i < len(g):
        c = g[i]
        if g.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if g.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in g[i + 1 :]:
            j = g.index("]", i + 1)
            inner = g[i + 1 : j].replace("\\", "\\\\").replace("&", "\\&")
            out, i = out + "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]", j + 1
            continue
        if c == "{":
            depth, out = depth + 1, out + "(?:"
        elif c == "}" and depth:
            depth, out = depth - 1, out + ")"
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or (c if c.isalnum() or c in "_/" else "\\" + c)
        i += 1
    out += ")" * depth
    body = out.lstrip("/").rstrip("/") + "/.*" if g.endswith("/") else out.lstrip("/")  # a folder is what lies in it
    return ("^" if "/" in g.rstrip("/") else "^(?:.*/)?") + body + "$"


def globs_admit(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Include globs first, excludes after; the last that matches decides; without includes everything starts admitted."""
    admitted = F.lit(not include)
    for glob, value in [*((g, not g.startswith("!")) for g in include), *((g, False) for g in exclude)]:
        admitted = F.when(path.rlike(glob_pattern(glob)), F.lit(value)).otherwise(admitted)
    return admitted


#: Credential and system roots that are never read, as parts of a path from one of its directories on.
DENIED = ["etc/shadow", ".ssh/", ".aws/credentials", ".gnupg/", "proc/"]


def is_protected(path: Column) -> Column:
    denied = F.lit(False)
    for d in DENIED:
        denied |= F.contains(F.concat(F.lit("/"), path), F.lit("/" + d))
    return denied


def in_scope(path: Column, scope: str) -> Column:
    s = scope.removeprefix("@").rstrip("/")
    return (path == s) | F.startswith(path, F.lit(s + "/"))


def subsequence_score(text: Column, query: str) -> Column:
    """round(40 * length / span) of the query's greedy walk through the text; null if the text doesn't have it in order."""
    letters = F.array(*map(F.lit, query))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("first"))

    def step(acc: Column, c: Column) -> Column:
        hit = F.when(acc["at"] < 0, F.lit(-1)).otherwise(F.call_function("locate", c, text, acc["at"] + 1))
        return F.struct(F.when(hit <= 0, -1).otherwise(hit).alias("at"), F.when((acc["first"] == 0) & (hit > 0), hit).otherwise(acc["first"]).alias("first"))

    walk = F.aggregate(letters, start, step)
    return let(walk, lambda w: F.when(w["at"] > 0, F.round(F.lit(40.0 * len(query)) / (w["at"] - w["first"] + 1)).cast("int")))


def file_score(path: Column, query: str) -> Column:
    """100 exact name, 95 stem, 85 within the name, 70 within the path, 60 all words, else the fuzzy walk; null: no candidate."""
    if not query:
        return F.lit(0)
    p, q = F.lower(path), query.lower()
    name = basename(p)
    stem = F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)
    terms = q.split()
    if len(terms) > 1:
        rest = F.when(F.array_min(F.array(*(F.contains(p, F.lit(t)).cast("int") for t in terms))) == 1, F.lit(60))
    else:
        rest = subsequence_score(p, terms[0]) if terms else F.lit(None).cast("int")
    has = lambda column: F.contains(column, F.lit(q))
    return F.when(name == q, 100).when(stem == q, 95).when(has(name), 85).when(has(p), 70).otherwise(rest)
