"""The search engine's front: one request in, evidence and coverage out.

    engine = Engine(spark, sources)              # path, text and, if known, mtime, ignored, content_hash
    result = engine.search({"pattern": "token", "literal": True})
    result.evidence, result.coverage, result.page()

Plans are lazy; the only actions inside are the emptiness test of a scope's expansion and the bounded page.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import modules as md
from corpuslens.functions import scanners as sc
from corpuslens.functions import structure as st
from corpuslens.functions import text as tx
from corpuslens.operators import changes as ch
from corpuslens.operators import compare as cm
from corpuslens.operators import graph as gr
from corpuslens.operators import ignoring as ig
from corpuslens.operators import intervals as iv
from corpuslens.operators import ranking as rk
from corpuslens.request import Cursor, RequestError, normalized, parse_cursor, validated
from corpuslens.sources import corpus as co
from corpuslens.sources.providers import ProviderError, supported
from corpuslens.sources.results import ResultStore, StoredResult, total_order
from corpuslens.sources.shared import written

PAGE, SUMMARY_PAGE, PAGE_BYTES = 100, 30, 16 * 1024
BYTES_OF_TOKEN = 4
#: Limits of features: targets of one inspection, files with previews of a summary, lines on either side of a preview's match.
TARGETS_SERVED, PREVIEW_FILES, AROUND = 5, 5, 3
MEDIA_HITS = 10


def page_bytes(r: dict) -> int:
    """Bytes of a page: PAGE_BYTES, or less if the request's budget of tokens is smaller."""
    return min(PAGE_BYTES, BYTES_OF_TOKEN * r.get("resultTokenBudget", PAGE_BYTES))


@dataclass
class Result:
    """evidence: a lazy DataFrame; order: how its pages are ordered; coverage: dimension -> status; notes: what was changed or assumed;
    parts: further tables, made when they are asked for; next: the request for what this one left."""

    evidence: DataFrame
    order: list
    kind: str
    page_size: int = PAGE
    coverage: dict[str, str] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)
    page_bytes: int = PAGE_BYTES
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    start: int = 0
    store: ResultStore | None = None
    stored: StoredResult | None = None
    parts: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    next: dict | None = None

    @property
    def complete(self) -> bool:
        return set(self.coverage.values()) <= {"complete", "not-applicable"}

    def page(self, offset: int | None = None) -> tuple[list[dict], str | None]:
        """Up to page_size rows from the offset (that of the request's cursor, if none is given), as dicts with sensitive text redacted last, and the next page's cursor."""
        offset = self.start if offset is None else offset
        rows = self.rows(offset, self.page_size + 1)
        more = len(rows) > self.page_size
        out, size = [], 0
        for r in rows[: self.page_size]:
            d = {k: sc.redacted(v)[0] if isinstance(v, str) else v for k, v in r.asDict(True).items()}
            size += len(str(d).encode())
            if out and size > self.page_bytes:
                more = True
                break
            out.append(d)
        return out, str(Cursor(self.id, self.kind, offset + len(out))) if more else None

    def rows(self, offset: int, most: int) -> list[Row]:
        """Up to `most` rows from the offset on. The first ones are a top-k; for any other the result is stored once, and sought in."""
        if self.stored is None and offset and self.store is not None:
            self.stored = self.store.get(self.id) or self.store.put(self.id, self.evidence, self.order, {"kind": self.kind, "page_size": self.page_size, "page_bytes": self.page_bytes, "coverage": self.coverage, "notes": self.notes})
        if self.stored is not None:
            return self.stored.page(offset, most)
        by = total_order(self.evidence, self.order)
        return self.evidence.orderBy(*by).limit(offset + most).collect()[offset:]

    @property
    def cursor(self) -> str:
        """The cursor of the whole result, for requests about its rows."""
        return str(Cursor(self.id, self.kind, self.start))

    def part(self, name: str) -> DataFrame:
        """What comes with a result of this kind beside its rows: statistics and windows of a summary."""
        if name not in self.parts:
            raise RequestError("E_PART_UNKNOWN", f"this result has no {name}", "parts: " + (", ".join(self.parts) or "none"))
        return self.parts[name]()

    def count(self) -> int:
        return self.evidence.count()

    def save(self, path: str) -> None:
        """The whole evidence as Parquet, its text redacted as a page's is."""
        text = {f.name for f in self.evidence.schema.fields if f.dataType.simpleString() == "string"}
        self.evidence.select(*(sc.redaction(F.col(c))["shown"].alias(c) if c in text else F.col(c) for c in self.evidence.columns)).write.parquet(path)


class Engine:
    def __init__(self, spark: SparkSession, sources: DataFrame, *, versions: dict[str, DataFrame] | None = None, records: DataFrame | None = None, edges: tuple[DataFrame, DataFrame] | None = None, embedder: Callable | None = None, vectors: DataFrame | None = None, assessor: Callable | None = None, media: DataFrame | None = None, media_embedder: Callable | None = None):
        """embedder: text -> list of floats, for queries; vectors: path, line_no, text, embedding of the corpus's passages.

        assessor: (question, claim, excerpts) -> supported, contradicted or insufficient; media: path, kind (image or scan), page,
        width, height, embedding of images and scanned pages; media_embedder: (query, image's path), one of them None -> list of floats."""
        self.spark, self.sources, self.versions, self.records, self.edges, self.embedder, self.vectors = spark, sources, versions or {}, records, edges, embedder, vectors
        self.assessor, self.media, self.media_embedder = assessor, media, media_embedder
        self.results: dict[str, Result] = {}
        self._left_out: DataFrame | None = None
        self.store = ResultStore(spark)

    def search(self, request: dict) -> Result:
        r, notes = normalized(request)
        validated(r)
        if "cursor" in r and r.get("mode") != "support":
            found, c = self._stored(r["cursor"])
            return replace(found, start=c.offset, notes=notes + found.notes)
        mode = r.get("mode", "auto")
        if r.get("changes"):
            result = self._changes(r)
        elif r.get("anyOf"):
            result = self._any_of(r)
        elif r.get("allOf"):
            result = self._all_of(r)
        else:
            result = getattr(self, "_" + mode.replace("-", "_"))(r)
        result.notes = notes + result.notes
        result.page_bytes, result.store = page_bytes(r), self.store
        self.results = {**dict(list(self.results.items())[-19:]), result.id: result}  # twenty at most, the oldest go
        return result

    def next_page(self, cursor: str) -> tuple[list[dict], str | None]:
        found, c = self._stored(cursor)
        return found.page(c.offset)

    def _stored(self, cursor: str) -> tuple[Result, Cursor]:
        """The result that a cursor is of; kind and selection must be those it was made with."""
        c = parse_cursor(cursor)
        if c.id not in self.results and re.fullmatch("[0-9a-f]{32}", c.id) and (stored := self.store.get(c.id)):
            about = stored.about  # of a session before this one
            self.results[c.id] = Result(stored.all(), [], about["kind"], about["page_size"], about["coverage"], about["notes"], about["page_bytes"], c.id, store=self.store, stored=stored)
        if c.id not in self.results:
            raise RequestError("E_CURSOR_NOT_FOUND", "the search of this cursor is gone", "start a new search")
        if c.kind != self.results[c.id].kind or c.selection != "all":
            raise RequestError("E_CURSOR_MISMATCH", "this cursor is of another kind of result or selection", "use the cursor as it was given")
        return self.results[c.id], c

    # --- admission ---------------------------------------------------------------------------------------------------

    def _admitted(self, r: dict, scope: str | None = None) -> tuple[DataFrame, dict[str, str]]:
        df = co.enumerated(self.sources, scope=scope, include=r.get("glob", ()), exclude=r.get("exclude", ()), hidden=r.get("hidden", True))
        coverage = {"filesystem": "complete"}
        if "ignored" in df.columns and r.get("ignorePolicy", "respect") == "respect":
            df, coverage["ignored"] = df.filter(~F.col("ignored")), "policy-filtered"
        elif r.get("ignorePolicy", "respect") == "respect" and (left_out := self._ignored_paths()) is not None:
            df, coverage["ignored"] = df.join(left_out.select("path"), "path", "left_anti"), "policy-filtered"
        if "mtime" in df.columns and ("modifiedAfter" in r or "modifiedBefore" in r):
            at = [F.timestamp_millis(F.lit(r[k])) if k in r else None for k in ("modifiedAfter", "modifiedBefore")]
            inside = F.lit(True) if at[0] is None else F.col("mtime") >= at[0]
            inside = inside if at[1] is None else inside & (F.col("mtime") < at[1])
            known = F.coalesce(inside, F.lit(r.get("mode") != "files"))  # an unknown time stays in a content search only
            df, coverage["time"] = df.filter(known), "partial"
        if "paths" in r:
            df = df.filter(F.col("path").isin(*r["paths"]))
        df = df if r.get("text") else df.filter(~F.contains("text", F.lit("\0")))  # an audit may ask for binary sources as text
        return df.filter(~tx.is_protected(F.col("path"))), coverage

    def _ignored_paths(self) -> DataFrame | None:
        """path, ignored_by of the sources that rule files among them leave out, written once for an engine; None if there are none."""
        if self._left_out is None:
            some = ig.rule_files(self.sources).head(1)
            found = ig.with_rule(self.sources.select("path", "text")).filter("ignored_by is not null").select("path", "ignored_by") if some else self.spark.createDataFrame([], "path string, ignored_by string")
            self._left_out = written(found, "ignored")
            self._n_left_out = self._left_out.count() if some else 0
        if not self._n_left_out:
            return None
        return F.broadcast(self._left_out) if self._n_left_out <= rk.BROADCAST_ROWS else self._left_out

    def ignored(self, r: dict) -> DataFrame:
        """path, ignored_by: the sources in the request's scope that ignore rules leave out of it."""
        left_out = self._ignored_paths()
        inside = self._admitted({**r, "ignorePolicy": "include"}, r.get("path"))[0].select("path")
        return inside.join(left_out, "path") if left_out is not None else inside.filter("false").withColumn("ignored_by", F.lit(None).cast("string"))

    def _said_of_ignored(self, r: dict) -> list[str]:
        """A note on the sources in scope that ignore rules leave out, with a sample of twenty and their rules."""
        if r.get("ignorePolicy", "respect") != "respect" or "ignored" in self.sources.columns or self._ignored_paths() is None:
            return []
        out = written(self.ignored(r), "ignored")
        n = out.count()
        shown = ", ".join(f"{x.path} ({x.ignored_by})" for x in out.orderBy("path").limit(20).collect())
        return [f"{n} sources are left out by ignore rules: {shown}"] if n else []

    def _missing(self, r: dict) -> list[str]:
        """A note on asked paths that aren't there. At most twenty paths are asked for."""
        if "paths" not in r:
            return []
        there = {x.path for x in self.sources.filter(F.col("path").isin(*r["paths"])).select("path").collect()}
        gone = [p for p in r["paths"] if p not in there]
        return [f"no such source: {', '.join(gone)}"] if gone else []

    def _how(self, r: dict) -> dict:
        return {"literal": bool(r.get("literal")), "ignore_case": r.get("ignoreCase"), "whole_word": bool(r.get("wholeWord"))}

    def _term(self, r: dict, term: str) -> str:
        """The pattern of a term of anyOf or allOf: literal, with the request's case and word fields."""
        return tx.compiled_pattern(term, literal=True, ignore_case=bool(r.get("ignoreCase")), whole_word=bool(r.get("wholeWord")))

    def _scan(self, r: dict) -> tuple[DataFrame, dict[str, str], list[str]]:
        how, notes = self._how(r), self._missing(r) + self._said_of_ignored(r)

        def lines(docs: DataFrame) -> DataFrame:
            if r.get("roles"):
                return co.role_lines(docs, r["pattern"], list(r["roles"]), **how)
            if r.get("context"):
                return co.matches_with_context(docs, r["pattern"], r["context"], **how)
            return co.matching_lines(docs, r["pattern"], **how)

        scope = r.get("path")
        docs, coverage = self._admitted(r, scope)
        if r.get("roles"):
            coverage["parser"] = "partial"
        found = lines(docs)
        if scope and r.get("scope") != "strict" and not found.head(1):
            docs, wider = self._admitted(r)
            return lines(docs), coverage | wider, [*notes, f"nothing matched in {scope}; the whole corpus was searched"]
        return found, coverage, notes

    # --- modes -------------------------------------------------------------------------------------------------------

    def _matches(self, r: dict) -> Result:
        lines, coverage, notes = self._scan(r)
        focus = F.regexp_instr("line", F.lit(tx.compiled_pattern(r["pattern"], literal=bool(r.get("literal")), ignore_case=r.get("ignoreCase")))) - 1
        more = ["context"] if "context" in lines.columns else []
        return Result(lines.select("path", "line_no", tx.excerpt(F.col("line"), focus, focus + 1).alias("excerpt"), *more), ["path", "line_no"], "matches", r.get("limit", PAGE), coverage, notes)

    def _summary(self, r: dict) -> Result:
        lines, coverage, notes = self._scan(r)
        counts = lines.groupBy("path").agg(F.count("*").alias("matches"), F.min(F.struct("line_no", F.substring("line", 1, tx.MAX_LINE_CHARACTERS).alias("line"))).alias("f"))
        counts = counts.select("path", "matches", F.col("f.line_no").alias("first_line"), F.col("f.line").alias("sample"))
        parts = {"statistics": lambda: cm.statistics(counts.select("path", F.col("matches").alias("n"))), "windows": lambda: self._windows(lines, counts)}
        return Result(counts, [F.desc("matches"), "path"], "summary", SUMMARY_PAGE, coverage, notes, parts=parts)

    def _windows(self, lines: DataFrame, counts: DataFrame) -> DataFrame:
        """path, first_line, last_line, excerpt: of the files with most matches, the first two windows around a match that don't overlap."""
        top = written(counts.orderBy(F.desc("matches"), "path").limit(PREVIEW_FILES).select("path", "first_line"), "top")
        second = lines.join(F.broadcast(top), "path").filter(F.col("line_no") > F.col("first_line") + 2 * AROUND).groupBy("path").agg(F.min("line_no").alias("at"))
        at = F.broadcast(top.select("path", F.col("first_line").alias("at")).unionByName(second))  # ten rows at most
        shown = co.plain_lines(self.sources.join(F.broadcast(top.select("path")), "path", "left_semi")).join(at, "path").filter(F.abs(F.col("line_no") - F.col("at")) <= AROUND)
        numbered = F.array_sort(F.collect_list(F.struct("line_no", F.substring("line", 1, tx.MAX_LINE_CHARACTERS).alias("line"))))
        rows = shown.groupBy("path", "at").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), numbered.alias("l"))
        return rows.select("path", "first_line", "last_line", F.array_join("l.line", "\n").alias("excerpt"))

    def _auto(self, r: dict) -> Result:
        """A page if everything fits on one, within its bytes, a summary otherwise."""
        page = self._matches(r)
        rows = page.evidence.head(PAGE + 1)
        fits = len(rows) <= PAGE and sum(len(str(x.asDict()).encode()) for x in rows) <= page_bytes(r)
        return page if fits or not rows else self._summary(r)

    def _any_of(self, r: dict) -> Result:
        docs, coverage = self._admitted(r, r.get("path"))
        each = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(i).alias("term_index"), tx.occurrences(F.col("text"), self._term(r, t)).alias("o")) for i, t in enumerate(r["anyOf"])))
        rows = docs.select("path", F.explode(each).alias("x")).select("path", F.col("x.term").alias("term"), F.col("x.term_index").alias("term_index"), F.inline("x.o"))
        return Result(rows, ["term_index", "path", "byte_start"], "analysis", r.get("limit", SUMMARY_PAGE), coverage, self._missing(r))

    def term_counts(self, r: dict) -> DataFrame:
        """term, term_index, occurrences, files for each term of an anyOf request, zeros included. Counted within the documents' rows."""
        docs, _ = self._admitted(r, r.get("path"))
        n = [F.regexp_count("text", F.lit(self._term(r, t))) for t in r["anyOf"]]
        sums = docs.agg(*(F.sum(x).alias(f"n{i}") for i, x in enumerate(n)), *(F.sum((x > 0).cast("long")).alias(f"f{i}") for i, x in enumerate(n)))
        return sums.select(F.inline(F.array(*(F.struct(F.lit(t).alias("term"), F.lit(i).alias("term_index"), F.coalesce(f"n{i}", F.lit(0)).alias("occurrences"), F.coalesce(f"f{i}", F.lit(0)).alias("files")) for i, t in enumerate(r["anyOf"])))))

    def _all_of(self, r: dict) -> Result:
        docs, coverage = self._admitted(r, r.get("path"))
        terms = [self._term(r, t) for t in r["allOf"]]
        holds = lambda c: reduce(lambda a, b: a & b, (c.rlike(t) for t in terms))
        docs = docs.filter(holds(F.col("text")))
        if r.get("allOfScope", "file") == "function":  # in a function's own code, without that of the functions within it
            own = docs.select("path", F.inline(md.own(F.col("path"), F.col("text")))).filter(holds(F.col("own")))
            return Result(own.select("path", F.col("start_line").alias("line_no"), F.col("name").alias("label")), ["path", "line_no"], "analysis", r.get("limit", SUMMARY_PAGE), coverage | {"parser": "partial"}, self._missing(r))
        counts = F.array(*(F.regexp_count("text", F.lit(t)) for t in terms))
        return Result(docs.select("path", counts.alias("occurrences")), ["path"], "analysis", r.get("limit", SUMMARY_PAGE), coverage, self._missing(r))

    def _changed(self, r: dict) -> tuple[DataFrame, dict[str, str], list[str]]:
        """path, change, old_path, similarity, text, ranges of the changed sources: the text of the asked side (null where it lacks the
        source), and the lines that changed there (all of a source that the other side lacks), if they are asked for."""
        c = r["changes"]
        if c["base"] not in self.versions or c["target"] not in self.versions:
            raise RequestError("E_VERSION_UNKNOWN", "base and target must be versions that the engine was given")
        coverage, side = {"versions": "complete"}, c.get("side", "new")

        def admit(version: DataFrame) -> DataFrame:
            df = co.enumerated(version, scope=r.get("path"), include=r.get("glob", ()), exclude=r.get("exclude", ()), hidden=r.get("hidden", True)).filter(~tx.is_protected(F.col("path")))
            if "ignored" in df.columns and r.get("ignorePolicy", "respect") == "respect":
                df, coverage["ignored"] = df.filter(~F.col("ignored")), "policy-filtered"
            return df.filter(F.col("path").isin(*r["paths"])) if "paths" in r else df

        rows = ch.changed_sources(admit(self.versions[c["base"]]), admit(self.versions[c["target"]]), bool(c.get("renames")))
        if c.get("scope") != "lines":
            return rows.withColumn("text", F.col(side)).withColumn("ranges", F.lit(None).cast(ch.RANGE)), coverage, []
        rows = written(rows.withColumn("ranges", ch.changed_ranges(F.col("old"), F.col("new"), side, sc.MYERS_WORK)).withColumn("text", F.col(side)), "changes")
        unknown = rows.filter("text is not null and ranges.lines is null").select("path").limit(20)  # a sample for the note
        paths = [x.path for x in unknown.collect()]
        if paths:
            coverage["versions"] = "partial"
        return rows, coverage, [f"changed lines are unknown, as the comparison needs too much work: {', '.join(sorted(paths))}"] if paths else []

    def _changes(self, r: dict) -> Result:
        """Changed sources, or what the pattern, the terms or the roles find in them: in their changed lines with scope lines."""
        rows, coverage, notes = self._changed(r)
        ranged = r["changes"].get("scope") == "lines"
        limit, own = r.get("limit", SUMMARY_PAGE), rows.filter("text is not null and ranges.lines is not null" if ranged else "text is not null")  # _changed says which are unknown
        occurrences = lambda pattern: tx.occurrences(F.col("text"), ch.by_line(pattern))
        if r.get("pattern") is not None:
            own = own.filter(F.col("text").rlike(ch.by_line(tx.compiled_pattern(r["pattern"], **self._how(r)))))
            if r.get("roles"):
                own, coverage["parser"] = own.filter(tx.extension(F.col("path")).isin(*(e for ends in md.LANGUAGES.values() for e in ends))), "partial"
            hits = ch.with_hits(own, occurrences(tx.compiled_pattern(r["pattern"], **self._how(r))), ranged, tx.MAX_LINE_CHARACTERS).select("path", "change", F.inline("hits"))
            if r.get("roles"):
                places = co.role_occurrences(own, r["pattern"], list(r["roles"]), **self._how(r)).select("path", "byte_start")
                hits = hits.join(places, ["path", "byte_start"], "left_semi")
            shown = hits.select("path", "change", "line_no", "byte_start", "byte_end", F.col("line").alias("excerpt"))
            return Result(shown, ["path", "byte_start"], "analysis", limit, coverage, notes)
        if r.get("anyOf"):
            each = own.select("path", "change", "text", "ranges", F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.lit(i).alias("term_index")) for i, t in enumerate(r["anyOf"])))).alias("t"))
            found = reduce(lambda rest, i: F.when(F.col("t.term_index") == i, occurrences(self._term(r, r["anyOf"][i]))).otherwise(rest), range(len(r["anyOf"])), F.lit(None).cast("array<struct<byte_start:bigint,byte_end:bigint>>"))
            hits = ch.with_hits(each, found, ranged).select("path", "change", "t.term", "t.term_index", F.inline("hits"))
            return Result(hits, ["term_index", "path", "byte_start"], "analysis", limit, coverage, notes)
        if r.get("allOf"):
            terms = [self._term(r, t) for t in r["allOf"]]
            holds = lambda c: reduce(lambda a, b: a & b, (F.col(c).rlike(t) for t in terms))
            own = own.filter(holds("text"))
            if r.get("allOfScope", "file") == "function":
                bodies = md.own_in_lines(F.col("path"), F.col("text"), F.col("ranges.first"), F.col("ranges.last")) if ranged else md.own(F.col("path"), F.col("text"))
                parts = own.select("path", "change", F.inline(bodies)).filter(holds("own"))
                return Result(parts.select("path", "change", F.col("start_line").alias("line_no"), F.col("name").alias("label")), ["path", "line_no"], "analysis", limit, coverage | {"parser": "partial"}, notes)
            for i, t in enumerate(terms):
                own = ch.with_hits(own, occurrences(t), ranged).withColumn(f"n{i}_", F.size("hits")).drop("hits")
            held = own.select("path", "change", F.array(*(f"n{i}_" for i in range(len(terms)))).alias("occurrences")).filter(F.forall("occurrences", lambda n: n > 0))
            return Result(held, ["path"], "analysis", limit, coverage, notes)
        if ranged:  # sources with changed lines on the asked side, and those whose changed lines are unknown
            rows = rows.filter("text is not null and coalesce(ranges.lines, '?') != ''")
        more = [F.when(F.col("ranges.lines").isNotNull(), F.struct("ranges.old", "ranges.new")).alias("ranges")] if ranged else []
        more += [F.col("old_path"), F.col("similarity")] if r["changes"].get("renames") else []
        return Result(rows.select("path", "change", *more), ["path"], "analysis", limit, coverage, notes)

    def _files(self, r: dict) -> Result:
        docs, coverage = self._admitted(r, r.get("path"))
        query, notes = r.get("query", "").strip(), []
        if set(query) <= set("*/."):
            scored, notes = docs.select("path", F.lit(0).alias("score")), [f"{query!r} lists every file"] if query else []
        elif set(query) & set("*?["):
            if r.get("glob") or set(query) & set("^$()|\\+ \t") or ".*" in query:
                raise RequestError("E_QUERY", "a file query is a name, a path or one glob, no regular expression", "give glob, or leave out query")
            scored, notes = docs.filter(tx.globs_admit(F.col("path"), [query], [])).select("path", F.lit(0).alias("score")), [f"{query!r} was taken as a glob"]
        else:
            scored = docs.select("path", tx.file_score(F.col("path"), query).alias("score")).filter("score is not null")
        return Result(scored, [F.desc("score"), "path"], "analysis", r.get("limit", SUMMARY_PAGE), coverage, notes)

    def _audit(self, r: dict) -> Result:
        docs, coverage = self._admitted(r, r.get("path"))
        inventory = lambda: written(docs.select("path", F.sha2("text", 256).alias("content_hash")), "inventory")
        before = inventory()
        found = written(cm.audit(co.plain_lines(docs), list(r["patterns"]), closed=set(coverage.values()) <= {"complete"}), "audit")
        moved = cm.changed(before, inventory()).limit(20).collect()  # a sample for the note
        coverage["inventory"] = "partial" if moved else "complete"
        if moved:  # absence can't be claimed of sources that changed while they were read
            found = found.withColumn("status", F.when(F.col("status") == "present", "present").otherwise("unknown"))
        notes = [f"sources changed during the audit: {', '.join(sorted(x.path for x in moved))}"] if moved else []
        return Result(found, ["pattern"], "analysis", SUMMARY_PAGE, coverage, notes)

    def _concept(self, r: dict) -> Result:
        if self.embedder is None or self.vectors is None:
            raise RequestError("E_CONCEPT_UNAVAILABLE", "the engine has no embedder or no vectors")
        q = self.spark.sql(f"SELECT array({', '.join(f'{float(x)}D' for x in self.embedder(r['query']))}) AS v")
        vectors = co.enumerated(self.vectors, scope=r.get("path"), include=r.get("glob", ()), exclude=r.get("exclude", ()), hidden=r.get("hidden", True)).filter(~tx.is_protected(F.col("path")))
        scored = vectors.crossJoin(F.broadcast(q))  # one row
        score = tx.cosine(F.col("embedding"), F.col("v"))
        out = scored.select("path", "line_no", "text", score.alias("score"), tx.concept_ranking_score(score, tx.utf16_length(F.col("text"))).alias("ranking_score"))
        return Result(out, [F.desc("ranking_score"), "path", "line_no"], "analysis", SUMMARY_PAGE, {"passages": "complete"})

    def _hybrid(self, r: dict) -> Result:
        concept = self._concept(r)
        keys = [c for c in concept.evidence.columns]
        ranges = concept.evidence.withColumn("start", F.col("line_no").cast("long")).withColumn("end", F.col("start") + F.regexp_count("text", F.lit("\n")) + 1)
        place = rk.ranked(ranges, concept.order, "place")
        kept = iv.kept_greedily(place, "path", "place")  # of passages that overlap the better one stays
        distinct = written(place.join(kept.select("path", "place"), ["path", "place"], "left_semi"), "passages")
        if r.get("ranking") == "relevance":
            words = self.spark.range(1).select(tx.retrieval_tokens(F.lit(r["query"])).alias("t")).first().t  # the query's own words
            evidence = distinct.select(keys)
            scores = rk.bm25(evidence.select(F.concat_ws("\0", "path", "line_no").alias("path"), "text"), words).withColumnRenamed("path", "key_")
            both = evidence.withColumn("key_", F.concat_ws("\0", "path", "line_no")).join(scores, "key_").drop("key_").withColumn("declaration", F.lit(0))
            return Result(rk.fused(both), ["rank"], "analysis", SUMMARY_PAGE, concept.coverage)
        literal = self._matches({"pattern": r["query"], "literal": True, **{k: r[k] for k in ("path", "glob", "exclude", "hidden") if k in r}})
        lines = literal.evidence.select("path", F.col("line_no").cast("long").alias("start"), (F.col("line_no") + 1).cast("long").alias("end"))
        free = iv.without_overlap(distinct, lines, "path", cell=1024)  # passages that hold a literal hit are said by it already
        best = free.orderBy("place").limit(r.get("conceptLimit", 3)).select(F.lit(1).alias("tier"), "place", "path", "line_no", F.col("text").alias("excerpt"))
        rows = literal.evidence.select(F.lit(0).alias("tier"), F.lit(0).cast("long").alias("place"), "path", "line_no", "excerpt").unionByName(best)
        return Result(rows, ["tier", "place", "path", "line_no"], "analysis", SUMMARY_PAGE, literal.coverage | concept.coverage, literal.notes)

    def _inspect(self, r: dict) -> Result:
        """Lines around a place, or around each of several targets (path, line, and the content hash that the caller has, if any).

        A target whose source has another content now is stale and shows no lines; one that is gone is unknown. Of several targets the
        first five are served; the result's `next` asks for the others."""
        asked_for = r.get("targets") or [{"path": r["path"], "line": r.get("line", 1)}]
        result = self._around(asked_for[:TARGETS_SERVED], r.get("context", 10))
        if len(asked_for) > TARGETS_SERVED:
            result.next = {**r, "targets": list(asked_for[TARGETS_SERVED:])}
            result.notes = [*result.notes, f"{TARGETS_SERVED} of {len(asked_for)} targets are served; next asks for the others"]
        return result

    def _around(self, targets: list[dict], around: int) -> Result:
        """The lines around the given targets, and what became of each."""
        coverage = "complete"
        asked = self.spark.createDataFrame([(i, t["path"], int(t.get("line", 1)), t.get("content_hash")) for i, t in enumerate(targets)], "target int, path string, at int, want string")
        now = self.sources.filter(F.col("path").isin(*{t["path"] for t in targets}) & ~tx.is_protected(F.col("path")))
        met = asked.join(now.select(F.col("path").alias("p_"), "text"), F.col("path") == F.col("p_"), "left")
        status = F.when(F.col("text").isNull(), "unknown").when(F.coalesce(F.sha2("text", 256) != F.col("want"), F.lit(False)), "stale").otherwise("current")
        met = written(met.withColumn("status", status), "targets")
        if met.filter("status != 'current'").head(1):
            coverage = "partial"
        shown = co.lines(met.filter("status = 'current'").select("path", "text").dropDuplicates(["path"]))
        rows = met.filter("status = 'current'").select("target", "path", "at", "status").join(shown, "path").filter(F.abs(F.col("line_no") - F.col("at")) <= around).select("target", "path", "status", "line_no", "line", "byte_start")
        lost = met.filter("status != 'current'").select("target", "path", "status", F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("string").alias("line"), F.lit(None).cast("long").alias("byte_start"))
        return Result(rows.unionByName(lost), ["target", "line_no"], "analysis", SUMMARY_PAGE, {"source": coverage})

    def _support(self, r: dict) -> Result:
        """What the assessor says of a claim on rows of a result, read from the sources as they are now: one row.

        matchIndex or matchIndices count the rows from the cursor's place, from 1. Without an assessor, or where a source is gone,
        the answer is unknown; the assessor sees redacted text."""
        found, c = self._stored(r["cursor"])
        if not {"path", "line_no"} <= set(found.evidence.columns):
            raise RequestError("E_SUPPORT_EVIDENCE", "the rows of this result have no line", "give the cursor of a search for lines")
        asked, around = list(r.get("matchIndices") or [r["matchIndex"]]), r.get("supportContextLines", 2)
        by_row = {i: {"path": x.path, "line": x.line_no} for i in set(asked) for x in found.rows(c.offset + i - 1, 1)}  # twenty at most
        if len(by_row) < len(set(asked)):
            raise RequestError("E_RANGE", "the result has no such row", "give an index of a row that was shown")
        read = self._around([by_row[i] for i in asked], around)
        shown = read.evidence.orderBy("target", "line_no").select("target", "status", "line").collect()  # 41 lines a target at most
        valid = all(x.status == "current" for x in shown) and {x.target for x in shown} == set(range(len(asked)))
        excerpts = [sc.redacted("\n".join(x.line for x in shown if x.target == i and x.line is not None))[0] for i in range(len(asked))]
        try:
            said = supported(r["supportQuestion"], r["supportClaim"], excerpts, self.assessor, valid)
        except ProviderError as e:
            raise RequestError(e.code, str(e), "ask for fewer rows or context lines") from None
        row = self.spark.createDataFrame([(said, asked, around, excerpts)], "assessment string, evidence_items array<int>, context_lines int, excerpts array<string>")
        return Result(row, ["assessment"], "analysis", SUMMARY_PAGE, read.coverage | {"assessor": "complete" if said != "unknown" else "unavailable"})

    def _media(self, r: dict) -> Result:
        """The ten images and scanned pages nearest to a query or an image (limit of the feature), of one kind or all."""
        if self.media is None or self.media_embedder is None:
            raise RequestError("E_MEDIA_UNAVAILABLE", "the engine has no media or no embedder of media")
        kind = r.get("kind", "all")
        media = co.enumerated(self.media, scope=r.get("path"), include=r.get("glob", ()), exclude=r.get("exclude", ()), hidden=r.get("hidden", True)).filter(~tx.is_protected(F.col("path")))
        media = media if kind == "all" else media.filter(F.col("kind") == kind)
        vector = self.media_embedder(r.get("query"), r.get("image"))
        asked = F.array(*(F.lit(float(x)) for x in vector))
        out = media.select("path", "kind", "page", "width", "height", tx.cosine(F.col("embedding"), asked).alias("score"))
        return Result(out.orderBy(F.desc("score"), "path", "page").limit(MEDIA_HITS), [F.desc("score"), "path", "page"], "analysis", SUMMARY_PAGE, {"media": "complete"})

    def _outline(self, r: dict) -> Result:
        rows = self.sources.filter((F.col("path") == r["path"]) & ~tx.is_protected(F.col("path"))).select("path", F.inline(md.outline(F.col("path"), F.col("text"))))
        rows = rows.filter(F.col("name") == r["symbol"]) if "symbol" in r else rows
        return Result(rows, ["start_line"], "analysis", SUMMARY_PAGE, {"parser": "partial"})

    def _structure(self, r: dict) -> Result:
        """Matches of a structural pattern in the admitted scripts and Go sources; a source that withholds its matches has one row that says why."""
        try:
            matches = st.structural(r["pattern"])
        except ValueError as e:
            raise RequestError("E_STRUCTURE_PATTERN", str(e), "write code with $NAME for an expression and $$$NAME for a sequence") from None
        docs, coverage = self._admitted(r, r.get("path"))
        known = docs.filter(F.lower("path").rlike(st.SOURCES))
        if not known.head(1) and docs.head(1):
            raise RequestError("E_STRUCTURE_SOURCES", "structural patterns are for script and Go sources, and none was found", "widen path or glob")
        rows = known.select("path", "text", F.inline(matches(F.col("path"), F.col("text"))))
        excerpt = F.substring(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")), 1, tx.MAX_LINE_CHARACTERS)
        return Result(rows.select("path", "line_no", "start", "end", "status", excerpt.alias("excerpt")), ["path", "start"], "analysis", SUMMARY_PAGE, coverage | {"parser": "partial"})

    def _imports(self, r: dict) -> Result:
        """Traces along import edges: those that the engine was given, or those of the admitted script sources."""
        if self.edges is None:
            docs, coverage = self._admitted(r, r.get("path"))
            edges, declared, _ = gr.module_edges(docs)
        else:
            (edges, declared), coverage = self.edges, {"graph": "complete"}
        out = gr.traced(edges, declared)
        out = out.filter(F.col("start_name") == r["symbol"]) if "symbol" in r else out
        return Result(out, ["start_path", "start_name"], "analysis", SUMMARY_PAGE, coverage | ({} if self.edges else {"parser": "partial"}))

    def _tests(self, r: dict) -> Result:
        """Test files of the admitted sources, or of those in scope, by how they are related, with their test cases."""
        docs, coverage = self._admitted({k: v for k, v in r.items() if k != "path"})
        related = gr.test_relations(docs, *gr.module_edges(docs), targets=tx.in_scope(F.col("path"), r["path"]) if "path" in r else None)
        cases = docs.filter(F.col("path").rlike(md.TEST_PATH)).select(F.col("path").alias("test_path"), F.filter(md.tests(F.col("path"), F.col("text")), lambda c: c["kind"] == "test").alias("cases"))
        order = F.when(F.col("relation") == "direct", 0).when(F.col("relation") == "indirect", 1).otherwise(2)
        return Result(related.join(cases, "test_path", "left"), ["path", order, "test_path"], "analysis", SUMMARY_PAGE, coverage | {"parser": "partial"})

    def _validate(self, r: dict) -> Result:
        if not {"saved", "current"} <= self.versions.keys():
            raise RequestError("E_VERSION_UNKNOWN", "the engine has no versions saved and current", "give both to the engine")
        base, target = self.versions["saved"], self.versions["current"]
        return Result(cm.validated(base, target), ["status", "path"], "analysis", SUMMARY_PAGE, {"sources": "complete"})

    def _capabilities(self, r: dict) -> Result:
        docs, coverage = self._admitted(r, r.get("path"))
        return Result(cm.capabilities(docs), [F.desc("files"), "extension"], "analysis", SUMMARY_PAGE, coverage)

    def _source_list(self, r: dict) -> Result:
        return Result(self.spark.sql("SELECT 'records' AS id, 'search,read' AS operations"), ["id"], "analysis", SUMMARY_PAGE, {"sources": "complete" if self.records is not None else "not-applicable"})

    def _records(self) -> DataFrame:
        if self.records is None:
            raise RequestError("E_SOURCES_UNAVAILABLE", "the engine was given no records")
        return self.records

    def _source_search(self, r: dict) -> Result:
        return Result(co.record_search(self._records(), r["query"], r.get("limit", 5), r.get("pageToken")).select("id", "title"), ["id"], "analysis", 50, {"records": "complete"})

    def _source_read(self, r: dict) -> Result:
        return Result(co.record_read(self._records(), r["recordId"], r["revision"]), ["id"], "analysis", 1, {"records": "complete"})
