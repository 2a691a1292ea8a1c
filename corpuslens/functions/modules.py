"""Lexical facts of JavaScript, TypeScript and Go sources: imports and exports, declarations, roles, test cases; and own code.

There is no parser: a lexer knows comments, strings, names and brackets, and short grammars read its tokens. What it says is
certain only lexically (a quote within a regular expression literal may mislead it), which callers say as coverage `partial`.
All functions take one text at a time, whole, in one pass over its tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions import scanners as sc

TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
      | (?P<string>"(?:\\.|[^"\\\n])*+(?:"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*+(?:'|(?=\n)|\Z)|`(?:\\.|[^`\\])*+(?:`|\Z))
      | (?P<name>[^\W\d][\w$]*|\$[\w$]*) | (?P<arrow>=>) | (?P<sign>[{}()\[\];,=.*:<>]) | (?P<line>\n)""",
    re.X | re.S,
)
#: Extensions by language, words that a bracket may follow without a call, and single-character escapes.
LANGUAGES = {"python": (".py", ".pyi"), "script": (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts"), "go": (".go",)}
#: What can be said of each.
CAPABILITIES = {"python": ("outline", "roles", "tests"), "script": ("outline", "roles", "imports", "tests", "structure"), "go": ("outline", "roles", "tests", "structure")}
KEYWORDS = frozenset("await case catch const continue default delete do else export extends finally for from func function go if import in instanceof let new of range return select super switch throw try typeof var void while with yield".split())
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
#: Files that are tests by their path, and functions that declare a test case.
TEST_PATH = r"(?i)(?:^|/)(?:__tests__|tests?)(?:/|$)|(?:^|/)[^/]+\.(?:test|spec)\.(?:[cm]?[jt]s|[jt]sx)$|(?:^|/)test_[^/]*\.py$|_test\.go$"
TEST_FUNCTIONS = frozenset(("describe", "it", "test"))


def language_of(path: str) -> str:
    """python, script, go, or empty, by the extension."""
    name = path.rsplit("/", 1)[-1].lower()
    return next((k for k, ends in LANGUAGES.items() if name.endswith(ends) and name not in ends), "")


def decoded(literal: str) -> str | None:
    """The value of a quoted string literal with its escapes; None if it isn't one or isn't ended."""
    if len(literal) < 2 or literal[0] not in "\"'`" or literal[-1] != literal[0] or literal[0] == "`" and "${" in literal:
        return None

    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] in "xu" and len(x) > 1:
            return chr(int(x.strip("xu{}"), 16))
        return "" if x == "\n" else ESCAPES.get(x, x)

    try:
        return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]{1,6}\}|.)", one, literal[1:-1], flags=re.S)
    except (ValueError, OverflowError):
        return None


class Reader:
    """A cursor over the tokens that aren't comments or line ends."""

    def __init__(self, text: str):
        self.tokens = [m for m in TOKEN.finditer(text) if m.lastgroup not in ("comment", "line")]
        self.i = 0

    def text(self, k: int = 0) -> str:
        return self.tokens[self.i + k][0] if self.i + k < len(self.tokens) else ""

    def kind(self, k: int = 0) -> str:
        return self.tokens[self.i + k].lastgroup if self.i + k < len(self.tokens) else ""

    def take(self, *texts: str) -> bool:
        if self.text() in texts:
            self.i += 1
            return True
        return False

    def string(self) -> str | None:
        if self.kind() == "string" and (value := decoded(self.text())) is not None:
            self.i += 1
            return value
        return None

    def name(self) -> str:
        if self.kind() == "name":
            self.i += 1
            return self.tokens[self.i - 1][0]
        return ""

    def names_in_braces(self) -> list[tuple[str, str]]:
        """(name, as) of { a, b as c }, from after the brace."""
        out = []
        while self.i < len(self.tokens) and not self.take("}"):
            if self.text() == "type" and self.kind(1) == "name" and self.text(1) != "as":
                self.i += 1
            first = self.name() or self.string()
            if first:
                out.append((first, (self.name() or self.string() or first) if self.take("as") else first))
            elif not self.take(","):
                self.i += 1
        return out


Fact = tuple[str, str, str, str, int]
DECLARING = frozenset("const let var function class interface type enum".split())


def module_facts(text: str) -> list[Fact]:
    """(kind, specifier, imported, local, offset) of imports, re-exports, exports, side-effect, dynamic and required modules, in order."""
    r, out = Reader(text), []
    while r.i < len(r.tokens):
        at, word, before = r.tokens[r.i].start(), r.text(), r.tokens[r.i - 1][0] if r.i else ""
        r.i += 1
        if word not in ("import", "export", "require") or before == ".":
            continue
        if word == "require" or word == "import" and r.text() == "(":
            if r.take("(") and (spec := r.string()) is not None:
                out.append(("require" if word == "require" else "dynamic", spec, "", "", at))
        elif word == "import":
            if (spec := r.string()) is not None:
                out.append(("side-effect", spec, "", "", at))
                continue
            if r.text() == "type" and r.text(1) != "from":
                r.i += 1
            found = []
            while True:
                if r.take("*") and r.take("as"):
                    found.append(("*", r.name()))
                elif r.take("{"):
                    found += r.names_in_braces()
                elif local := r.name():
                    found.append(("default", local))
                if not r.take(","):
                    break
            if r.take("from") and (spec := r.string()) is not None:
                out += [("import", spec, a, b, at) for a, b in found]
        elif r.take("*"):
            local = r.name() if r.take("as") else "*"
            if r.take("from") and (spec := r.string()) is not None:
                out.append(("re-export", spec, "*", local, at))
        elif r.take("{") or r.text() == "type" and r.text(1) == "{" and r.take("type") and r.take("{"):
            found = r.names_in_braces()
            spec = r.string() if r.take("from") else None
            out += [("export" if spec is None else "re-export", spec or "", a, b, at) for a, b in found]
        else:
            default = r.take("default")
            while r.take("async", "abstract", "declare"):
                pass
            name = ""
            if r.take(*DECLARING):
                r.take("*")
                name = r.name()
            if name or default:
                out.append(("export", "", name or "default", "default" if default else name, at))
    return out


def declarations(text: str, language: str) -> list[tuple[str, str, int, int, str]]:
    """(name, kind, first line, last line, scope): functions, methods, classes, interfaces, types and enums with a body in braces."""
    lines = LineIndex(text)
    tokens = [m for m in TOKEN.finditer(text) if m.lastgroup not in ("comment", "line")]
    closes, stack = {}, []
    for k, m in enumerate(tokens):
        if m[0] in "([{" and m.lastgroup == "sign":
            stack.append(k)
        elif m[0] in ")]}" and m.lastgroup == "sign" and stack:
            closes[stack.pop()] = k
    out, open_ = [], []  # open_: (index of the closing brace, name, kind)
    word = lambda k: tokens[k][0] if 0 <= k < len(tokens) else ""
    named = lambda k: 0 <= k < len(tokens) and tokens[k].lastgroup == "name"

    def body_after(k: int) -> int | None:
        """The opening brace of a body after a parameter list that ends at k: return types stand between."""
        angle = 0
        while k < len(tokens) and (angle > 0 and word(k) != ";" or word(k) not in ("{", ";", "}", ")", ",")):
            angle += (word(k) == "<") - (word(k) == ">")
            k = closes.get(k, k) + 1 if word(k) in ("(", "[", "{") else k + 1
        return k if word(k) == "{" else None

    def put(name: str, kind: str, first: int, brace: int | None) -> None:
        if brace is None or brace not in closes:
            return
        last = closes[brace]
        out.append((name, kind, lines.of(tokens[first].start()), lines.of(tokens[last].start()), ".".join(o[1] for o in open_)))
        opened[brace] = (last, name, kind)

    opened: dict[int, tuple[int, str, str]] = {}
    for k, m in enumerate(tokens):
        while open_ and open_[-1][0] <= k:
            open_.pop()
        if k in opened:
            open_.append(opened[k])
            continue
        if not named(k) or word(k - 1) == ".":
            continue
        w = m[0]
        if w in ("class", "interface", "enum") and named(k + 1):
            brace = next((j for j in range(k + 2, len(tokens)) if word(j) in ("{", ";")), None)
            put(word(k + 1), w, k, brace if brace is not None and word(brace) == "{" else None)
        elif language == "go" and w == "type" and named(k + 1) and word(k + 2) in ("struct", "interface"):
            put(word(k + 1), word(k + 2), k, k + 3 if word(k + 3) == "{" else None)
        elif language == "go" and w == "func":
            receiver = word(k + 1) == "("
            n = closes.get(k + 1, k) + 1 if receiver else k + 1
            if named(n) and word(n + 1) == "(" and n + 1 in closes:
                put(word(n), "method" if receiver else "function", k, body_after(closes[n + 1] + 1))
        elif w == "function" and (n := k + 1 + (word(k + 1) == "*")) and named(n) and word(n + 1) == "(" and n + 1 in closes:
            put(word(n), "function", k, body_after(closes[n + 1] + 1))
        elif w in ("const", "let", "var") and named(k + 1) and word(k + 2) == "=":
            j = k + 3 + (word(k + 3) == "async")
            if word(j) == "function":
                j += 1 + (named(j + 1))
            end = closes.get(j, j) if word(j) == "(" else j
            if word(j) == "(" and (arrow := next((x for x in range(end + 1, min(end + 40, len(tokens))) if word(x) in ("=>", "{", ";")), None)) is not None:
                put(word(k + 1), "function", k, arrow if word(arrow) == "{" else arrow + 1 if word(arrow) == "=>" and word(arrow + 1) == "{" else None)
            elif named(j) and word(j + 1) == "=>" and word(j + 2) == "{":
                put(word(k + 1), "function", k, j + 2)
        elif open_ and open_[-1][2] == "class" and word(k + 1) == "(" and k + 1 in closes and w not in KEYWORDS:
            put(w, "method", k, body_after(closes[k + 1] + 1))
    return out


class LineIndex:
    """Line numbers, from 1, of offsets that don't go back."""

    def __init__(self, text: str):
        self.text, self.at, self.line = text, 0, 1

    def of(self, offset: int) -> int:
        if offset < self.at:
            return self.line - self.text.count("\n", offset, self.at)
        self.line += self.text.count("\n", self.at, offset)
        self.at = offset
        return self.line


def lexical_roles(text: str) -> list[tuple[int, int, str]]:
    """(start, end, role) in characters: comment, string, import, declaration, call, and code between comments and strings; sorted."""
    out, code_from = [], 0
    tokens = [m for m in TOKEN.finditer(text) if m.lastgroup != "line"]
    skip, previous = 0, ""
    for k, m in enumerate(tokens):
        if m.lastgroup in ("comment", "string"):
            if m.start() > code_from:
                out.append((code_from, m.start(), "code"))
            code_from = m.end()
            out.append((m.start(), m.end(), m.lastgroup))
        elif m.lastgroup == "name" and m.start() >= skip:
            after = tokens[k + 1][0] if k + 1 < len(tokens) else ""
            if m[0] in ("import", "export") and previous != "." and after != "(":
                end = next((t.end() for t in tokens[k + 1 : k + 400] if t.lastgroup == "string" or t[0] in (";", "(", "=")), m.end())
                if m[0] == "import" or re.search(r"\bfrom\s*[\"']", text[m.start() : end]):
                    out.append((m.start(), end, "import"))
                    skip = end
            elif previous in ("function", "class", "interface", "enum", "type", "func", "const", "let", "var"):
                out.append((m.start(), m.end(), "declaration"))
            elif after == "(" and m[0] not in KEYWORDS:
                out.append((m.start(), tokens[k + 1].end(), "call"))
        previous = m[0]
    if code_from < len(text):
        out.append((code_from, len(text), "code"))
    return sorted(out)


def roles_of(path: str, text: str) -> list[tuple[int, int, str]] | None:
    """The roles of a source by its language; None if it has none."""
    language = language_of(path)
    return None if not language else sc.roles(text) if language == "python" else lexical_roles(text)


def outline_of(path: str, text: str) -> list[tuple[str, str, int, int, str]]:
    language = language_of(path)
    return [] if not language else sc.outline(text) if language == "python" else declarations(text, language)


def own_code(path: str, text: str, only: set[int] | None = None) -> list[tuple[str, str, int, int, str]]:
    """(name, kind, first line, last line, own text) of functions and methods: their lines (with `only`, those of these numbers) less
    those of declarations within them."""
    lines = text.split("\n")
    spans = sorted(outline_of(path, text), key=lambda d: (d[2], -d[3]))
    out, open_ = [], []  # open_: (last line, own lines of the declaration), innermost last
    owner: dict[int, list[str]] = {}
    starts: dict[int, list] = {}
    for d in spans:
        starts.setdefault(d[2], []).append(d)
    for number, line in enumerate(lines, 1):
        while open_ and open_[-1][0] < number:
            open_.pop()
        for d in starts.get(number, ()):
            open_.append((d[3], owner.setdefault(id(d), [])))
            if d[1] in ("function", "method"):
                out.append((d[0], d[1], d[2], d[3], owner[id(d)]))
        if open_ and (only is None or number in only):
            open_[-1][1].append(line)
    return [(n, k, a, b, "\n".join(own)) for n, k, a, b, own in out]


def test_cases(path: str, text: str) -> list[tuple[str, str, int]]:
    """(kind, name, line) of describe, it and test calls of scripts, and of Python's and Go's test functions."""
    language, lines = language_of(path), LineIndex(text)
    if language in ("python", "go"):
        like = re.compile(r"test_|test$" if language == "python" else r"Test[A-Z_]")
        return [("test", n, a) for n, k, a, _, _ in outline_of(path, text) if k in ("function", "method") and like.match(n)]
    out, r = [], Reader(text)
    while r.i < len(r.tokens):
        word, at = r.text(), r.tokens[r.i].start()
        free = r.i == 0 or r.tokens[r.i - 1][0] != "."
        r.i += 1
        if word in TEST_FUNCTIONS and free:
            if r.take("."):
                r.name()  # only, skip, each
            if r.take("(") and (name := r.string()) is not None:
                out.append(("describe" if word == "describe" else "test", name, lines.of(at)))
    return out


def by_path(scan: Callable, names: tuple[str, ...], types: tuple[str, ...]) -> Callable[[Column, Column], Column]:
    """A column function of (path, text) whose rows are the scan's tuples, as an array of structs."""

    def column(path: Column, text: Column) -> Column:
        @sc.batched_udf(f"array<struct<{','.join(f'{n}:{t}' for n, t in zip(names, types, strict=True))}>>")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for paths, texts in batches:
                yield pd.Series([None if found is None else [dict(zip(names, x, strict=True)) for x in found] for found in (scan(p or "", t or "") for p, t in zip(paths, texts, strict=True))], dtype=object)

        return run(path, text)

    return column


facts = by_path(lambda p, t: module_facts(t) if language_of(p) == "script" else [], ("kind", "specifier", "imported", "local", "offset"), ("string", "string", "string", "string", "int"))
outline = by_path(outline_of, ("name", "kind", "start_line", "end_line", "scope"), ("string", "string", "int", "int", "string"))
roles = by_path(roles_of, ("start", "end", "role"), ("int", "int", "string"))
own = by_path(own_code, ("name", "kind", "start_line", "end_line", "own"), ("string", "string", "int", "int", "string"))
tests = by_path(test_cases, ("kind", "name", "line"), ("string", "string", "int"))


def own_in_lines(path: Column, text: Column, first: Column, last: Column) -> Column:
    """As `own`, of the lines of the given ranges (arrays of first and last numbers) alone."""
    names = ("name", "kind", "start_line", "end_line", "own")

    @sc.batched_udf("array<struct<name:string,kind:string,start_line:int,end_line:int,own:string>>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for rows in batches:
            found = (own_code(p or "", t or "", {n for a, b in zip(x, y, strict=True) for n in range(a, b + 1)}) for p, t, x, y in zip(*rows, strict=True))
            yield pd.Series([[dict(zip(names, f, strict=True)) for f in own] for own in found], dtype=object)

    return run(path, text, first, last)
