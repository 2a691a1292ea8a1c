"""Structural patterns over scripts and Go: code with `$NAME` for one expression and `$$$NAME` for a sequence, however it is laid out.

There is no parser. Pattern and source are cut into tokens (comments and white space are nothing) and brackets are paired;
`$NAME` takes an expression as a lexical grammar of operands, postfixes and binary operators sees it, `$$$NAME` any balanced
run within its brackets, even none. A name used again must take the same tokens; `$_` and names that begin with `_` need not.
A metavariable takes as little as lets the rest match, at the end of a pattern as much as the expression goes on. One match is
given for each start. Operator precedence isn't known, so this is certain only lexically, which callers say as `partial`.

Defined results: a null or empty text has no match; a source whose brackets don't pair, or that needs more than WORK steps,
withholds its matches and says so in one row with a status. Memory is in proportion to the text's tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import Column

from corpuslens.functions import modules as md

#: Bytes of a pattern (fixed value), and steps of one source.
PATTERN_BYTES, WORK = 4096, 2_000_000
STRING = r""""(?:\\.|[^"\\\n])*+"|'(?:\\.|[^'\\\n])*+'|`(?:\\.|[^`\\])*+`"""
NUMBER = r"\d(?:[eE][+-]|[\w.])*+"
OPERATOR = r"\.\.\.|===|!==|>>>=?|\*\*=?|<<=|>>=|&&=|\|\|=|\?\?=|&\^=?|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|<<|>>|:=|<-|[-+*/%&|^]="
SKIPPED = r"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))"
SOURCE = re.compile(rf"{SKIPPED}|(?P<string>{STRING})|(?P<number>{NUMBER})|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<sign>{OPERATOR}|.)", re.S)
PATTERN = re.compile(rf"{SKIPPED}|(?P<many>\$\$\$(?:[A-Z_][A-Z0-9_]*)?)|(?P<one>\$[A-Z_][A-Z0-9_]*)(?![\w$])|(?P<string>{STRING})|(?P<number>{NUMBER})|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<sign>{OPERATOR}|.)", re.S)
#: Words and signs that stand before an operand, between two, and words that begin a body in braces.
PREFIXES = frozenset("new typeof void await delete yield async ! - + ~ ++ -- ... & * <-".split())
BINARY = frozenset("+ - * / % ** & | ^ &^ << >> >>> && || ?? == != === !== < > <= >= = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &^= &&= ||= ??= := => instanceof in as satisfies <-".split())
BODIED = frozenset(("function", "func", "class"))
STATEMENT = md.KEYWORDS - PREFIXES - BODIED - {"super", "import"}
#: Paths (in lower case) of sources that patterns are for.
SOURCES = "[^/](?:" + "|".join(re.escape(x) for k in ("script", "go") for x in md.LANGUAGES[k]) + ")$"
OPENING, CLOSING = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")


class Withheld(Exception):
    """Why a source's matches can't be given."""


def parts(pattern: str) -> list[tuple[str, str]]:
    """(kind, text) of a pattern's tokens; kind `one` and `many` are metavariables. ValueError if it can't be a pattern."""
    if not pattern.strip() or len(pattern.encode("utf-8", "surrogatepass")) > PATTERN_BYTES or any("\ud800" <= c <= "\udfff" for c in pattern):
        raise ValueError(f"a structural pattern has 1 to {PATTERN_BYTES} bytes of well-formed text")
    out = [(m.lastgroup, m[0]) for m in PATTERN.finditer(pattern) if m.lastgroup != "skip"]
    if all(kind == "many" for kind, _ in out):
        raise ValueError("a structural pattern needs more than sequences and comments")
    return out


class Source:
    """Tokens of a text, with the partners of its brackets; counts the steps of its searches."""

    def __init__(self, text: str, language: str):
        self.go = language == "go"
        found = [m for m in SOURCE.finditer(text) if m.lastgroup != "skip"]
        self.words, self.kinds, self.spans = [m[0] for m in found], [m.lastgroup for m in found], [m.span() for m in found]
        self.breaks = [k > 0 and "\n" in text[self.spans[k - 1][1] : self.spans[k][0]] for k in range(len(found))]
        self.steps, self.partner, stack = 0, {}, []
        for k, (word, kind) in enumerate(zip(self.words, self.kinds, strict=True)):
            if kind == "sign" and word in OPENING:
                stack.append(k)
            elif kind == "sign" and word in CLOSING:
                if not stack or OPENING[self.words[stack[-1]]] != word:
                    raise Withheld("unbalanced")
                self.partner[stack.pop()] = k
        if stack:
            raise Withheld("unbalanced")

    def word(self, k: int) -> str:
        return self.words[k] if 0 <= k < len(self.words) else ""

    def step(self) -> None:
        self.steps += 1
        if self.steps > WORK:
            raise Withheld("work limit")

    def operand(self, k: int) -> int | None:
        """Where the operand that begins at k ends, before its postfixes; None if none begins there."""
        while self.word(k) in PREFIXES and self.kinds[k] in ("sign", "name"):
            self.step()
            k += 1
        if k >= len(self.words):
            return None
        word, kind = self.words[k], self.kinds[k]
        if kind == "name" and word in BODIED:
            while k < len(self.words) and self.words[k] not in ("{", ";", ")", ",", "}"):
                self.step()
                k = self.partner.get(k, k) + 1
            return self.partner[k] + 1 if self.word(k) == "{" else None
        if kind == "sign":
            return self.partner[k] + 1 if k in self.partner else None
        return None if kind == "name" and word in STATEMENT else k + 1

    def expressions(self, k: int) -> Iterator[int]:
        """Ends of the expressions that begin at k, the shortest first."""
        choices, end = 0, self.operand(k)
        while end is not None:
            self.step()
            if not choices:
                yield end
            word = self.word(end)
            if not word or self.go and self.breaks[end]:
                return
            if word in (".", "?.") and self.word(end + 1) not in ("(", "["):
                end = end + 2 if end + 1 < len(self.words) else None
            elif word == "?.":
                end += 1
            elif word in ("(", "[") or word == "{" and self.go:
                end = self.partner[end] + 1
            elif word in ("++", "--") and not self.breaks[end] or self.kinds[end] == "string" and word[0] == "`":
                end += 1
            elif word == "!" and not self.breaks[end]:
                end += 1
            elif word in BINARY:
                end = self.operand(end + 1)
            elif word == "?" or word == ":" and choices:
                choices += 1 if word == "?" else -1
                end = self.operand(end + 1)
            else:
                return

    def sequences(self, k: int) -> Iterator[int]:
        """Ends of the balanced runs that begin at k, the empty one first."""
        while True:
            self.step()
            yield k
            if k >= len(self.words) or self.kinds[k] == "sign" and self.words[k] in CLOSING:
                return
            k = self.partner.get(k, k) + 1

    def match(self, pattern: list[tuple[str, str]], at: int) -> int | None:
        """Where the pattern ends that begins at `at`, if it does."""

        def ends(p: int, k: int) -> Iterator[int]:
            kind, text = pattern[p]
            if kind == "many":
                found = self.sequences(k)
                return iter([list(found)[-1]]) if p == len(pattern) - 1 else found
            if kind == "one":
                found = self.expressions(k)
                return iter(list(found)[:-2:-1]) if p == len(pattern) - 1 else found
            return iter((k + 1,) if k < len(self.words) and self.words[k] == text else ())

        again = {x for x, n in Counter(pattern).items() if n > 1 and x[0] in ("one", "many") and x[1].lstrip("$")[:1] not in ("", "_")}
        tried, bound = [(at, ends(0, at))], [{}]
        while tried:
            self.step()
            p, (k, found) = len(tried) - 1, tried[-1]
            end = next(found, None)
            if end is None:
                tried.pop()
                bound.pop()
                continue
            taken = bound[-1]
            if pattern[p] in again:
                if pattern[p] in taken and not self.equal(*taken[pattern[p]], k, end):
                    continue
                taken = taken | {pattern[p]: (k, end)}
            if p == len(pattern) - 1:
                return end
            tried.append((end, ends(p + 1, end)))
            bound.append(taken)
        return None

    def equal(self, a: int, b: int, k: int, end: int) -> bool:
        """Whether the tokens from a to b are those from k to end."""
        if b - a != end - k:
            return False
        self.steps += (b - a) // 8
        return self.words[a:b] == self.words[k:end]

    def starts(self, pattern: list[tuple[str, str]]) -> Iterator[int]:
        """Tokens that the pattern may begin at: no name or value that only goes on with a member or an operand."""
        kind, text = pattern[0]
        literal = kind not in ("one", "many")
        for k, word in enumerate(self.words):
            if literal and word != text or kind == "many" and word in CLOSING:
                continue
            if k and self.words[k - 1] in (".", "?.") and self.kinds[k] != "sign":
                continue
            if kind == "one" and k and (self.words[k - 1] in PREFIXES and self.kinds[k - 1] == "name" or self.continues(k)):
                continue
            yield k

    def continues(self, k: int) -> bool:
        """Whether the bracket or sign at k goes on with the operand before it, so that no expression begins there."""
        if self.kinds[k] != "sign" or self.go and self.breaks[k] or self.words[k] in ("!", "~", "..."):
            return False
        before = self.words[k - 1]
        return before in (")", "]") or self.kinds[k - 1] in ("string", "number") or self.kinds[k - 1] == "name" and before not in STATEMENT and before not in PREFIXES


def structural_matches(pattern: list[tuple[str, str]], path: str, text: str) -> list[tuple[int | None, int | None, int | None, str]]:
    """(line, start, end, status) of a pattern's matches in a script or Go source, in characters; one row with the reason if withheld."""
    language = md.language_of(path)
    if language not in ("script", "go"):
        return []
    try:
        source = Source(text, language)
        found = [(source.spans[k][0], source.spans[end - 1][1]) for k in source.starts(pattern) if (end := source.match(pattern, k)) is not None and end > k]
    except Withheld as why:
        return [(None, None, None, str(why))]
    lines = md.LineIndex(text)
    return [(lines.of(a), a, b, "ok") for a, b in found]


def structural(pattern: str) -> Callable[[Column, Column], Column]:
    """A column function of (path, text): the matches of a pattern, as an array of structs."""
    asked = parts(pattern)
    return md.by_path(lambda p, t: structural_matches(asked, p, t), ("line_no", "start", "end", "status"), ("int", "int", "int", "string"))
