"""Requests: fields by mode, ranges, conflicts, typed errors, aliases, and cursors."""

from __future__ import annotations

import re
from typing import NamedTuple

COMMON = ("mode", "resultTokenBudget")
FILTERS = ("path", "glob", "exclude", "hidden")
ORDINARY = (*COMMON, "pattern", "literal", "ignoreCase", "wholeWord", *FILTERS, "ignorePolicy", "context", "limit", "cursor", "paths", "scope", "modifiedAfter", "modifiedBefore", "anyOf", "allOf", "allOfScope", "roles", "changes")
#: The fields that each mode knows.
FIELDS = {
    "auto": ORDINARY,
    "summary": ORDINARY,
    "matches": ORDINARY,
    "files": (*COMMON, "query", *FILTERS, "ignorePolicy", "limit", "scope", "modifiedAfter", "modifiedBefore"),
    "audit": (*COMMON, "patterns", *FILTERS, "ignorePolicy", "text"),
    "concept": (*COMMON, "query", *FILTERS),
    "hybrid": (*COMMON, "query", *FILTERS, "conceptLimit", "ranking"),
    "inspect": (*COMMON, "path", "line", "context", "targets"),
    "outline": (*COMMON, "path", "symbol"),
    "imports": (*COMMON, *FILTERS, "symbol"),
    "tests": (*COMMON, *FILTERS),
    "structure": (*COMMON, "pattern", *FILTERS),
    "validate": COMMON,
    "support": (*COMMON, "cursor", "matchIndex", "matchIndices", "supportQuestion", "supportClaim", "supportContextLines"),
    "media": (*COMMON, "query", "image", "kind", *FILTERS),
    "capabilities": (*COMMON, *FILTERS),
    "source-list": COMMON,
    "source-search": (*COMMON, "query", "limit", "pageToken"),
    "source-read": (*COMMON, "recordId", "revision"),
}
REQUIRED = {"files": (), "audit": ("patterns",), "concept": ("query",), "hybrid": ("query",), "outline": ("path",), "structure": ("pattern",), "support": ("cursor", "supportQuestion", "supportClaim"), "source-search": ("query",), "source-read": ("recordId", "revision")}
RANGES = {"context": (0, 20), "supportContextLines": (0, 20), "limit": (1, 100), "conceptLimit": (1, 20)}
MOST = {"anyOf": (1, 64), "allOf": (1, 3), "patterns": (1, 32), "glob": (1, 64), "exclude": (1, 64), "paths": (1, 20), "targets": (1, 20), "matchIndices": (1, 20)}
TERM_BYTES = 256
ROLES = ("comment", "string", "code", "import", "declaration", "call")
#: Fields of `changes` and their values; None: any text, needed.
CHANGES = {"base": None, "target": None, "scope": ("files", "lines"), "side": ("new", "old"), "renames": (True, False)}
#: Fields of an ordinary search that can't go together: the first says what the others don't do.
APART = {"anyOf": ("roles", "context"), "allOf": ("roles", "context"), "changes": ("context", "modifiedAfter", "modifiedBefore"), "roles": ("context",)}


class RequestError(ValueError):
    """A request that can't run, with a stable code and what would repair it."""

    def __init__(self, code: str, message: str, repair: str = ""):
        super().__init__(f"{code}: {message}" + (f" ({repair})" if repair else ""))
        self.code, self.repair = code, repair


def normalized(request: dict) -> tuple[dict, list[str]]:
    """The request with accepted aliases replaced, and a note on each."""
    out, notes = dict(request), []
    mode = out.get("mode")
    if mode in ("anyOf", "allOf"):
        if mode not in out:
            raise RequestError("E_MODE_UNKNOWN", f"{mode} is a field, not a mode", f"give {mode}: [terms] and no mode")
        del out["mode"]
        notes.append(f"{mode} is a field; it selects this search by itself")
    elif mode == "summary" and "anyOf" in out:
        del out["mode"]
        notes.append("a search for several terms comes with its statistics; no summary mode is needed")
    if out.get("cursor") == "":
        del out["cursor"]
        notes.append("an empty cursor was left out")
    return out, notes


def validated(request: dict) -> dict:
    """The request if it is well-formed; a RequestError otherwise."""
    mode = request.get("mode", "auto")
    if mode not in FIELDS:
        raise RequestError("E_MODE_UNKNOWN", f"no mode {mode!r}", "modes: " + ", ".join(FIELDS))
    for k in request:
        if k not in FIELDS[mode]:
            raise RequestError("E_FIELD_UNKNOWN", f"mode {mode} has no field {k!r}", "fields: " + ", ".join(FIELDS[mode]))
    for k in REQUIRED.get(mode, ()):
        if not request.get(k):
            raise RequestError("E_FIELD_MISSING", f"mode {mode} needs {k}")
    if mode in ("auto", "summary", "matches"):
        given = [k for k in ("pattern", "anyOf", "allOf", "cursor", "changes") if request.get(k) is not None]
        if not given:
            raise RequestError("E_FIELD_MISSING", "one of pattern, anyOf, allOf, changes or cursor is needed")
        if len([k for k in given if k in ("pattern", "anyOf", "allOf")]) > 1:
            raise RequestError("E_FIELD_CONFLICT", "only one of pattern, anyOf and allOf")
    for k, others in APART.items():
        if request.get(k) and (clash := [o for o in others if request.get(o)]):
            raise RequestError("E_FIELD_CONFLICT", f"{k} does not go with {', '.join(clash)}", f"leave out {clash[0]}")
    if request.get("changes") is not None:
        checked_changes(request)
    if unknown := set(request.get("roles", ())) - set(ROLES):
        raise RequestError("E_ROLE_UNKNOWN", f"no role {sorted(unknown)}", "roles: " + ", ".join(ROLES))
    if "resultTokenBudget" in request and not (isinstance(request["resultTokenBudget"], int) and request["resultTokenBudget"] > 0):
        raise RequestError("E_RANGE", "resultTokenBudget must be a positive number")
    if mode == "inspect" and not (request.get("path") or request.get("targets")):
        raise RequestError("E_FIELD_MISSING", "mode inspect needs path or targets")
    if mode == "support":
        if ("matchIndex" in request) == ("matchIndices" in request):
            raise RequestError("E_FIELD_CONFLICT", "mode support needs matchIndex or matchIndices, not both")
        asked = request.get("matchIndices", [request.get("matchIndex")])
        if not all(isinstance(i, int) and i > 0 for i in asked if isinstance(asked, (list, tuple))):
            raise RequestError("E_RANGE", "rows count from 1")
    if mode == "media":
        if bool(request.get("query")) == bool(request.get("image")):
            raise RequestError("E_FIELD_CONFLICT", "mode media needs a query or an image, not both")
        if request.get("kind", "all") not in ("all", "image", "scan"):
            raise RequestError("E_FIELD_VALUE", "kind is all, image or scan")
    for k, (low, high) in RANGES.items():
        if k in request and not (isinstance(request[k], int) and low <= request[k] <= high):
            raise RequestError("E_RANGE", f"{k} must be from {low} to {high}")
    for k, (low, high) in MOST.items():
        if k in request and not (isinstance(request[k], (list, tuple)) and low <= len(request[k]) <= high):
            raise RequestError("E_RANGE", f"{k} must have {low} to {high} items")
    for k in ("anyOf", "allOf", "patterns"):
        for term in request.get(k, ()):
            if not term or "\n" in term or "\0" in term or len(term.encode()) > TERM_BYTES:
                raise RequestError("E_TERM", f"a term of {k} must be one line of 1 to {TERM_BYTES} bytes")
    if request.get("pattern") is not None and not request.get("literal") and mode != "structure":
        checked_regex(request["pattern"])
    return request


def checked_changes(request: dict) -> None:
    """Refuse a `changes` object that names no two versions, or has a field or value that means nothing."""
    c = request["changes"]
    if not isinstance(c, dict):
        raise RequestError("E_FIELD_VALUE", "changes must be an object", "changes: {base, target}")
    if unknown := [k for k in c if k not in CHANGES]:
        raise RequestError("E_FIELD_UNKNOWN", f"changes has no field {unknown[0]!r}", "fields: " + ", ".join(CHANGES))
    for k, values in CHANGES.items():
        if values is None and not isinstance(c.get(k), str):
            raise RequestError("E_FIELD_MISSING", f"changes needs {k}")
        if values is not None and k in c and c[k] not in values:
            raise RequestError("E_FIELD_VALUE", f"{k} of changes is one of {', '.join(map(str, values))}")
    if "side" in c and c.get("scope") != "lines" and not any(request.get(k) for k in ("pattern", "anyOf", "allOf")):
        raise RequestError("E_FIELD_CONFLICT", "a list of changed files has no side", "give scope lines, or what is searched for")
    if request.get("roles") and request.get("pattern") is None:
        raise RequestError("E_FIELD_MISSING", "roles need a pattern")


def checked_regex(pattern: str) -> None:
    """Refuse what a linear-time matcher has not (look-around, back references) and what doesn't compile."""
    if re.search(r"\(\?(?:[=!]|<[=!])|(?<!\\)(?:\\\\)*\\[1-9]|\(\?P=", pattern):
        raise RequestError("E_REGEX_INVALID", "look-around and back references are not supported")
    try:
        re.compile(re.sub(r"\\p\{[^}]*\}|\\pL|\\pN", r"\\w", pattern))
    except re.error as e:
        raise RequestError("E_REGEX_INVALID", str(e)) from None


class Cursor(NamedTuple):
    """id.kind.offset36.selection: a place in a stored result."""

    id: str
    kind: str
    offset: int
    selection: str = "all"

    def __str__(self) -> str:
        digits, n = "", self.offset
        while True:
            digits, n = "0123456789abcdefghijklmnopqrstuvwxyz"[n % 36] + digits, n // 36
            if not n:
                return f"{self.id}.{self.kind}.{digits}.{self.selection}"


def parse_cursor(text: str) -> Cursor:
    m = re.fullmatch(r"(.+)\.(matches|summary|analysis)\.([0-9a-z]+)\.(all|[0-9a-f]{16})", text)
    if not m:
        raise RequestError("E_CURSOR_MALFORMED", "this is no cursor", "start a new search")
    return Cursor(m[1], m[2], int(m[3], 36), m[4])
