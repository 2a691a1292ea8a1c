"""Scanners that need sequential logic, as plain functions and as Arrow UDFs: Myers line ranges, Python outline and roles,
snapped passages, the full redaction rule, subsequence walks.

All of them take one text at a time; a row's memory is in proportion to its text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch at most, so that what a Python worker holds doesn't grow with a task's rows. A longer text is a batch of its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 256, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def batched_udf(kind: str) -> Callable:
    """pandas_udf of texts: batches are bounded for this session (lower settings of the user's stay)."""
    conf = SparkSession.active().conf
    for key, most in BATCH.items():
        now = re.fullmatch(r"(-?\d+)b?", conf.get(key))
        if now is None or not 0 < int(now[1]) <= most:
            conf.set(key, str(most))
    return F.pandas_udf(kind)

# --- line differences -----------------------------------------------------------------------------------------------

#: Steps of the comparison of two texts in a request; one that needs more is said to be unknown.
MYERS_WORK = 2_000_000
#: Steps of the greedy search beside one for each line, before lines are compared by bits.
GREEDY_WORK = 200_000
#: Rows of bits kept at each level of `bit_rows`, and bytes of lines' bits that are remembered (64 lines at least).
KEPT_ROWS, MASK_BYTES = 128, 16 << 20


class WorkLimit(Exception):
    """The comparison needs more steps than allowed."""


def split_lines(text: str) -> list[str]:
    """Lines with their line feed."""
    return [x for x in re.split(r"(?<=\n)", text) if x]


def as_ranges(numbers: list[int]) -> list[tuple[int, int]]:
    """Sorted line numbers as inclusive ranges."""
    out: list[tuple[int, int]] = []
    for n in numbers:
        if out and out[-1][1] == n - 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


def changed_ranges(old: str, new: str, work: int | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Line ranges (from 1) of the old and the new text that a shortest edit script deletes and inserts. With a number of steps, a
    comparison that needs more raises WorkLimit."""
    a, b = split_lines(old), split_lines(new)
    ids: dict[str, int] = {}
    x, y = [ids.setdefault(t, len(ids)) for t in a], [ids.setdefault(t, len(ids)) for t in b]
    lead = 0
    while lead < min(len(x), len(y)) and x[lead] == y[lead]:
        lead += 1
    tail = 0
    while tail < min(len(x), len(y)) - lead and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    x, y = x[lead : len(x) - tail], y[lead : len(y) - tail]
    if x and y:
        deleted, inserted = unlimited_edits(x, y) if work is None else edits(x, y, work)
    else:
        deleted, inserted = list(range(len(x))), list(range(len(y)))
    return as_ranges([lead + i + 1 for i in deleted]), as_ranges([lead + i + 1 for i in inserted])


def edits(x: list[int], y: list[int], work: int) -> tuple[list[int], list[int]]:
    """Indices deleted from x and inserted from y, by the greedy search for the furthest reaching paths."""
    furthest, history = {1: 0}, []
    for d in range(len(x) + len(y) + 1):
        history.append(dict(furthest))
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and furthest[k - 1] < furthest[k + 1])
            i = furthest[k + 1] if down else furthest[k - 1] + 1
            work -= 1
            while i < len(x) and i - k < len(y) and x[i] == y[i - k]:
                i += 1
                work -= 1
            if work < 0:
                raise WorkLimit
            furthest[k] = i
            if i >= len(x) and i - k >= len(y):
                return walked_back(history, len(x), len(y))
    raise AssertionError("an edit script always exists")


def walked_back(history: list[dict[int, int]], i: int, j: int) -> tuple[list[int], list[int]]:
    deleted, inserted = [], []
    for d in range(len(history) - 1, 0, -1):
        before, k = history[d], i - j
        down = k == -d or (k != d and before[k - 1] < before[k + 1])
        was = k + 1 if down else k - 1
        i = before[was]
        j = i - was
        (inserted if down else deleted).append(j if down else i)
    return deleted[::-1], inserted[::-1]


def unlimited_edits(x: list[int], y: list[int]) -> tuple[list[int], list[int]]:
    """The script of `edits`, however many steps it takes. Lines that the other side lacks are left out first, as they can't be kept."""
    both = set(x) & set(y)
    at, to = ([i for i, t in enumerate(side) if t in both] for side in (x, y))
    own, other = [x[i] for i in at], [y[j] for j in to]
    try:
        deleted, inserted = edits(own, other, GREEDY_WORK + len(own) + len(other))
    except WorkLimit:
        deleted, inserted = edits_by_bits(own, other)
    kept, met = set(at) - {at[i] for i in deleted}, set(to) - {to[j] for j in inserted}
    return [i for i in range(len(x)) if i not in kept], [j for j in range(len(y)) if j not in met]


def edits_by_bits(x: list[int], y: list[int]) -> tuple[list[int], list[int]]:
    """The script of `edits` in time of len(x) * len(y) / 30 and memory of some hundred rows of len(x) bits.

    Walked back from both ends, the greedy script inserts where that costs nothing of what is common, else deletes where that costs
    nothing, else keeps a line. Bit i of row j is 0 where x[i] makes a longer common subsequence with the first j lines of y."""
    places: dict[int, list[int]] = {}
    for i, t in enumerate(x):
        places.setdefault(t, []).append(i)
    full = (1 << len(x)) - 1

    @lru_cache(max(64, MASK_BYTES // (len(x) // 8 + 1)))
    def mask(line: int) -> int:
        own = places.get(line, [])
        if len(own) < 2:
            return 1 << own[0] if own else 0
        bits = np.zeros(len(x), bool)
        bits[own] = True
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def after(row: int, j: int) -> int:
        met = row & mask(y[j])
        return ((row + met) | (row ^ met)) & full

    deleted, inserted, i = [], [], len(x)
    rows = bit_rows(full, 0, len(y), after)
    row = next(rows)
    for j in range(len(y) - 1, -1, -1):
        before, low = next(rows), (1 << i) - 1
        if (before & low).bit_count() == (row & low).bit_count():
            inserted.append(j)
        else:
            keep = (~row & low).bit_length() - 1
            deleted += range(i - 1, keep, -1)
            i = keep
        row = before
    deleted += range(i - 1, -1, -1)
    return deleted[::-1], inserted[::-1]


def bit_rows(row: int, first: int, last: int, after: Callable[[int, int], int]) -> Iterator[int]:
    """Rows last, last - 1, ... first, where after(row j, j) is row j + 1. Only every so many are kept, the others are made again."""
    step = 1
    while step * KEPT_ROWS < last - first:
        step *= KEPT_ROWS
    kept = [(first, row)]
    for j in range(first, last):
        row = after(row, j)
        if (j + 1 - first) % step == 0 or j + 1 == last:
            kept.append((j + 1, row))
    yield row
    for (start, own), (end, _) in zip(kept[-2::-1], kept[:0:-1], strict=True):
        yield from bit_rows(own, start, end - 1, after)


def written(ranges: list[tuple[int, int]]) -> str:
    return ",".join(f"{a}-{b}" for a, b in ranges)


def changed_line_ranges(old: Column, new: Column) -> Column:
    """struct<old, new>: ranges as a-b,c-d, of all pairs however much work they need."""

    @batched_udf("old string, new string")
    def run(olds: pd.Series, news: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(olds, news, strict=True):
            o, n = changed_ranges(a or "", b or "")
            out.append((written(o), written(n)))
        return pd.DataFrame(out, columns=["old", "new"])

    return run(old, new)


# --- Python sources -------------------------------------------------------------------------------------------------

#: One token of Python source that the scanners care for. Unterminated strings end with their line, or with the text if triple.
TOKEN = re.compile(
    r"""(?P<comment>\#[^\n]*)
      | (?P<string>(?<![\w])(?:[rbuf]|br|rb|fr|rf)?(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)))
      | (?P<bare>\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z))
      | (?P<open>[(\[{]) | (?P<close>[)\]}]) | (?P<line>\n) | (?P<name>[^\W\d]\w*(?:\.[^\W\d]\w*)*)""",
    re.X | re.S | re.I,
)
#: Words that a bracket may follow without a call.
KEYWORDS = frozenset("and as assert async await break case class continue def del elif else except finally for from global if import in is lambda match nonlocal not or pass raise return try while with yield None True False".split())


def blanked(text: str) -> str:
    """The text with comments and strings as spaces, line feeds kept."""
    return TOKEN.sub(lambda m: "\n".join([" " * len(x) for x in m[0].split("\n")]) if m.lastgroup in ("comment", "string", "bare") else m[0], text)


def outline(text: str) -> list[tuple[str, str, int, int, str]]:
    """(name, kind, first line, last line, scope) of functions, methods and classes, by indentation.

    A declaration ends before the next line with code at its indentation or less, outside brackets; the last one with the text.
    """
    code = blanked(text).split("\n")
    depth, logical = 0, []
    for number, line in enumerate(code, 1):
        if line.strip() and depth == 0:
            width = 0
            for c in line[: len(line) - len(line.lstrip(" \t"))]:
                width = width + 1 if c == " " else width // 8 * 8 + 8
            logical.append((number, width, line))
        depth = max(0, depth + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
    out: list[list] = []
    open_: list[tuple[int, str, int, str]] = []  # indentation, kind, place in out, scope of what lies within

    def closed(width: int, last: int) -> None:
        while open_ and open_[-1][0] >= width:
            out[open_.pop()[2]][3] = last

    for number, width, line in logical:
        closed(width, number - 1)
        m = re.match(r"[ \t]*(?:async[ \t]+)?(def|class)[ \t]+([^\W\d]\w*)[ \t]*(?=[:(\[])", line)
        if not m:
            continue
        kind = "class" if m[1] == "class" else "method" if open_ and open_[-1][1] == "class" else "function"
        scope = open_[-1][3] if open_ else ""
        open_.append((width, "class" if m[1] == "class" else "function", len(out), f"{scope}.{m[2]}" if scope else m[2]))
        out.append([m[2], kind, number, len(code), scope])
    return [tuple(x) for x in out]


def roles(text: str) -> list[tuple[int, int, str]]:
    """(start, end, role) in characters: comment, string, code, import, declaration, call; sorted."""
    out, code_from, previous = [], 0, ""
    tokens = list(TOKEN.finditer(text))
    skip_to, fresh_line, depth = 0, True, 0
    for k, m in enumerate(tokens):
        kind = m.lastgroup
        if kind in ("comment", "string", "bare"):
            if m.start() > code_from:
                out.append((code_from, m.start(), "code"))
            code_from = m.end()
            out.append((m.start(), m.end(), "comment" if kind == "comment" else "string"))
        elif kind == "line":
            fresh_line = fresh_line or depth == 0
            continue
        elif kind in ("open", "close"):
            depth = max(0, depth + (1 if kind == "open" else -1))
        elif kind == "name" and m.start() >= skip_to:
            after = tokens[k + 1] if k + 1 < len(tokens) else None
            if fresh_line and m[0] in ("import", "from"):
                end, inner = m.end(), 0
                for j in range(k + 1, len(tokens)):
                    t = tokens[j]
                    inner += (t.lastgroup == "open") - (t.lastgroup == "close")
                    if t.lastgroup == "comment" or t.lastgroup == "line" and inner <= 0 and text[t.start() - 1] != "\\":
                        break
                    end = t.end() if t.lastgroup != "line" else end
                body = text[m.start() : end]
                if m[0] == "import" or re.search(r"\bimport\b", body):
                    out.append((m.start(), end, "import"))
                    skip_to = end
            elif previous in ("def", "class"):
                out.append((m.start(), m.end(), "declaration"))
            elif m[0] not in KEYWORDS and after is not None and after.lastgroup == "open" and after[0] == "(" and not text[m.end() : after.start()].strip(" \t"):
                out.append((m.start(), after.end(), "call"))
            previous = m[0]
            fresh_line = False
            continue
        previous, fresh_line = "", False
    if code_from < len(text):
        out.append((code_from, len(text), "code"))
    return sorted(out)


OUTLINE = "array<struct<name:string,kind:string,start_line:int,end_line:int,scope:string>>"


def python_outline(text: Column) -> Column:
    @batched_udf(OUTLINE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("name", "kind", "start_line", "end_line", "scope"), x, strict=True)) for x in outline(t or "")] for t in texts])

    return run(text)


def python_roles(text: Column) -> Column:
    @batched_udf("array<struct<start:int,end:int,role:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("start", "end", "role"), x, strict=True)) for x in roles(t or "")] for t in texts])

    return run(text)


def calls_inside(text: str) -> list[tuple[int, str]]:
    """(line, name) of the lines in which a call begins and the smallest declaration around each; a pass over both in order, as declarations
    lie one within another or apart. Lines outside all declarations are left out."""
    spans, open_, k, out = sorted((first, last, name) for name, _, first, last, _ in outline(text)), [], 0, []
    at, line = 0, 1
    for start, _, role in roles(text):
        if role != "call":
            continue
        line += text.count("\n", at, start)
        at = start
        while k < len(spans) and spans[k][0] <= line:
            open_.append(spans[k])
            k += 1
        while open_ and open_[-1][1] < line:
            open_.pop()
        if open_ and (not out or out[-1][0] != line):
            out.append((line, open_[-1][2]))
    return out


def python_calls_inside(text: Column) -> Column:
    @batched_udf("array<struct<line_no:bigint,inside:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"line_no": n, "inside": name} for n, name in calls_inside(t or "")] for t in texts], dtype=object)

    return run(text)


# --- passages -------------------------------------------------------------------------------------------------------


def snapped_passages(text: str, size: int = 1000, overlap: int = 160) -> list[tuple[int, int]]:
    """(start, end) in characters: a passage ends after the last line feed of its second half if it has one; the next one starts
    `overlap` before the end. For text beyond U+FFFF sizes are in UTF-16 units, and no character is cut."""
    if any(ord(c) > 0xFFFF for c in text):
        units = text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass")
        place = [0]
        for c in units:
            place.append(place[-1] + (2 if ord(c) > 0xFFFF else 1))
        index = {u: i for i, u in enumerate(place)}
        flat = "".join(c if ord(c) <= 0xFFFF else "\x00\x00" for c in units)
        return [(index.get(a, index.get(a + 1)), index.get(b, index.get(b - 1))) for a, b in snapped_passages(flat, size, overlap)]
    out, start, n = [], 0, len(text)
    while True:
        end = min(n, start + size)
        if end < n and (at := text.rfind("\n", 0, end + 1)) > start + size // 2:
            end = at + 1
        out.append((start, end))
        if end >= n:
            return out
        start = max(start + 1, end - overlap)


def passages(text: Column) -> Column:
    @batched_udf("array<struct<start:int,end:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"start": a, "end": b} for a, b in snapped_passages(t or "")] for t in texts])

    return run(text)


# --- redaction ------------------------------------------------------------------------------------------------------
#
# A rule finds the spans that it hides, with what is shown instead; the rules are applied one after the other. Every rule looks
# at a character a bounded number of times, so a long text takes time in proportion.

#: Labels of key blocks, words of sensitive names (joined by nothing, _ or -), starts of issued tokens, names of types.
KEY_MARK = re.compile(r"-----(BEGIN|END) ([^-\r\n]*PRIVATE KEY)-----")
SENSITIVE = ["password", "passwd", "secret", "token", "api key", "access key", "access token", "secret access key", "private key", "service key"]
ISSUED = re.compile(r"\b(?:sk|ghp|xox[baprs])[-_][A-Za-z0-9][A-Za-z0-9_-]{7,}\b")
TYPE_NAMES = frozenset("boolean number string unknown never undefined null".split())

Hidden = tuple[int, int, str]
HEAD = re.compile(r"""(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)["']?\s*+[:=]\s*+""")
VALUE = re.compile(r"""(["'])(?:(?!\1)[^\r\n])*+\1|[^\s,;}]++""")
CODE = re.compile(r"[A-Za-z_$][\w$]*+(?:\.[A-Za-z_$][\w$]*+)*+\s*+[(\[]")


def spellings(words: list[str]) -> set[tuple[str, ...]]:
    """The ways to write words as parts of a name: each two neighbours joined or apart."""
    if len(words) == 1:
        return {(words[0],)}
    rest = spellings(words[1:])
    return {(words[0], *r) for r in rest} | {(words[0] + r[0], *r[1:]) for r in rest}


NAME_PARTS = frozenset(x for name in SENSITIVE for x in spellings(name.split()))
MOST_PARTS = max(map(len, NAME_PARTS))
SENSITIVE_PART = re.compile("|".join(sorted({name.split()[-1] for name in SENSITIVE})), re.I)  # every sensitive name has one of these


def is_sensitive(name: str) -> bool:
    """Whether a name, cut at _ and -, has a sensitive word, behind parts that begin with a letter, before parts that aren't empty."""
    parts = re.split("[_-]", name.lower())
    bad = [k for k, x in enumerate(parts) if not x]
    for k, part in enumerate(parts):
        if not bad or bad[-1] < k:
            if any(tuple(parts[k : k + n]) in NAME_PARTS for n in range(1, MOST_PARTS + 1)):
                return True
        if not part or not part[0].isalpha():
            return False
    return False


def key_blocks(text: str) -> Iterator[Hidden]:
    """The inside of each key block: from a BEGIN mark to the next END mark of the same label."""
    marks = list(KEY_MARK.finditer(text))
    ends: dict[str, list[re.Match]] = {}
    for m in reversed(marks):
        if m[1] == "END":
            ends.setdefault(m[2], []).append(m)  # the first one last
    done = 0
    for m in marks:
        if m[1] == "END" or m.start() < done:
            continue
        own = ends.get(m[2], [])
        while own and own[-1].start() < m.end():
            own.pop()
        if own:
            yield m.end(), own[-1].start(), "\n[REDACTED]\n"
            done = own[-1].end()


def assigned_values(text: str) -> Iterator[Hidden]:
    """What is assigned to a sensitive name, within its quotes; names of types and code that reads a secret stay."""
    done = 0
    for head in HEAD.finditer(text):
        if head.start() < done or not SENSITIVE_PART.search(head[1]) or not is_sensitive(head[1]) or not (value := VALUE.match(text, head.end())):
            continue
        done = value.end()
        if value[0].strip("\"'").lower() in TYPE_NAMES or CODE.match(value[0]):
            continue
        quote = 1 if value[1] else 0
        ending = value[0][0] if not quote and value[0][0] in "\"'" else ""  # a quote that its line doesn't close
        yield value.start() + quote, value.end() - quote, f"{ending}[REDACTED]{ending}"


def issued_tokens(text: str) -> Iterator[Hidden]:
    return ((*m.span(), "[REDACTED]") for m in ISSUED.finditer(text))


RULES = (key_blocks, assigned_values, issued_tokens)


def redacted(text: str) -> tuple[str, int]:
    """The text for display and the number of replacements."""
    n = 0
    for rule in RULES:
        pieces, at = [], 0
        for start, end, shown in rule(text):
            pieces += [text[at:start], shown]
            at, n = end, n + 1
        text = "".join([*pieces, text[at:]])
    return text, n


def redaction(text: Column) -> Column:
    @batched_udf("shown string, hidden int")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([redacted(t or "") for t in texts], columns=["shown", "hidden"])

    return run(text)
