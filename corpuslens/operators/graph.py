"""Import graphs: traces along edges, and module specifiers to files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import modules as md
from corpuslens.functions import scanners as sc
from corpuslens.functions import text as tx
from corpuslens.operators.ranking import BROADCAST_ROWS
from corpuslens.sources.shared import written

MAX_HOPS = 8
HOPS_WRITTEN = 3
#: Steps up that follow one another in a specifier.
UPWARDS = 4
#: How a trace ends, and why a specifier has no file.
CIRCULAR, RESOLVED, EXHAUSTED, MISSING, AMBIGUOUS, EXTERNAL = "circular-re-export", "resolved", "hop-budget-exhausted", "missing-or-excluded-module", "ambiguous-module-candidates", "external-package-or-path-alias-unsupported"
#: Suffixes tried for a specifier without one, and the sources of compiled names.
SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs"]
COMPILED = {".js": [".ts", ".tsx"], ".jsx": [".tsx"], ".mjs": [".mts"], ".cjs": [".cts"]}


def traced(edges: DataFrame, declared: DataFrame, max_hops: int = MAX_HOPS, starts: Column | None = None, with_seen: bool = False) -> DataFrame:
    """start_path, start_name, end_path, hops, status (and seen, the path:name of every step) of a walk from every edge's start, or from
    those of which `starts` holds.

    edges: from_path, from_name, to_path, to_name (one edge for each start); declared: path, name. A bounded loop of joins on the
    walk's present end; what has ended (by a cycle or without an edge) isn't carried through further joins.
    """
    key = lambda p, n: F.concat_ws(":", p, n)
    e = edges.select("from_path", "from_name", F.col("to_path").alias("t_path"), F.col("to_name").alias("t_name"))
    walk = (edges if starts is None else edges.filter(starts)).select(F.col("from_path").alias("start_path"), F.col("from_name").alias("start_name"), F.col("from_path").alias("path"), F.col("from_name").alias("name"), F.lit(0).alias("hops"), F.array(key("from_path", "from_name")).alias("seen"), F.lit(False).alias("cycle"))
    ended = None
    for hop in range(max_hops):
        if hop and hop % HOPS_WRITTEN == 0:  # a plan of a few joins at a time
            walk, ended = written(walk, "walk"), written(ended, "ended")
        step = walk.join(e, (walk.path == e.from_path) & (walk.name == e.from_name), "left")
        done = step.filter(F.col("t_path").isNull() | F.col("cycle")).select(walk.columns)
        ended = done if ended is None else ended.unionByName(done)
        go = step.filter(F.col("t_path").isNotNull() & ~F.col("cycle"))
        to = key("t_path", "t_name")
        walk = go.select("start_path", "start_name", F.col("t_path").alias("path"), F.col("t_name").alias("name"), (F.col("hops") + 1).alias("hops"), F.array_append("seen", to).alias("seen"), F.array_contains("seen", to).alias("cycle"))
    ends = ended.unionByName(walk)
    d = declared.select(F.col("path").alias("d_path"), F.col("name").alias("d_name"))
    more = edges.select(F.col("from_path").alias("m_path"), F.col("from_name").alias("m_name")).distinct()
    known = ends.join(d, (ends.path == d.d_path) & (ends.name == d.d_name), "left").join(more, (ends.path == more.m_path) & (ends.name == more.m_name), "left")
    status = F.when(F.col("cycle"), CIRCULAR).when(F.col("d_path").isNotNull(), RESOLVED).when(F.col("m_path").isNotNull(), EXHAUSTED).otherwise(MISSING)
    return known.select("start_path", "start_name", F.col("path").alias("end_path"), "hops", status.alias("status"), *(["seen"] if with_seen else []))


def resolved_modules(asked: DataFrame, files: DataFrame) -> DataFrame:
    """from_path, specifier, path, reason: a relative specifier's candidates are expanded and met with the existing files."""
    base = F.regexp_replace(F.concat(tx.directory(F.col("from_path")), F.lit("/"), F.col("specifier")), r"/\./", "/")
    plain = F.regexp_replace(base, r"^(?:\./)+", "")  # of a file at the root
    for _ in range(UPWARDS):
        plain = F.regexp_replace(plain, r"(?:^|(?<=/))(?!\.\./)[^/]+/\.\./", "")
    ext = tx.extension(plain)
    bare = [plain, *(F.concat(plain, F.lit(s)) for s in SUFFIXES), *(F.concat(plain, F.lit(f"/index{s}")) for s in SUFFIXES)]
    named = F.array(plain)
    for k, others in COMPILED.items():
        named = F.when(ext == k, F.array(plain, *(F.regexp_replace(plain, r"\.[^.]*$", o) for o in others))).otherwise(named)
    relative = F.startswith("specifier", F.lit("./")) | F.startswith("specifier", F.lit("../"))
    candidates = F.when(~relative, F.array().cast("array<string>")).when(ext == "", F.array(*bare)).otherwise(named)
    met = asked.withColumn("candidate", F.explode_outer(candidates)).join(files.select(F.col("path").alias("found")), F.col("candidate") == F.col("found"), "left")
    n = met.groupBy("from_path", "specifier").agg(F.count("found").alias("n"), F.min("found").alias("path"))
    reason = F.when(~relative, EXTERNAL).when(F.col("n") == 0, MISSING).when(F.col("n") > 1, AMBIGUOUS)
    return n.select("from_path", "specifier", F.when(F.col("n") == 1, F.col("path")).alias("path"), reason.alias("reason"))


def module_edges(sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of sources (path, text): edges (from_path, from_name, to_path, to_name) by imports and re-exports, declared names (path, name),
    and every imported module as from_path, specifier, path, reason.

    A module that isn't a file keeps its specifier as the edge's end, so a trace says that it is missing."""
    found = written(sources.select(F.col("path").alias("from_path"), F.inline(md.facts(F.col("path"), F.col("text")))), "facts")
    modules = written(resolved_modules(found.filter("specifier != ''").select("from_path", "specifier").distinct(), sources.select("path")), "modules")
    linked = found.filter(F.col("kind").isin("import", "re-export")).join(modules, ["from_path", "specifier"])
    edges = linked.select("from_path", F.col("local").alias("from_name"), F.coalesce("path", "specifier").alias("to_path"), F.col("imported").alias("to_name")).dropDuplicates(["from_path", "from_name"])
    return edges, found.filter("kind = 'export'").select(F.col("from_path").alias("path"), F.col("local").alias("name")).distinct(), modules


def stem_of(path: str) -> Column:
    """A file's name without the marks of tests and its extension."""
    return F.regexp_replace(tx.basename(F.col(path)), r"(?i)^test_|(?:[._](?:test|spec))?\.[^.]*$", "")


def finder(stems: Broadcast) -> Callable[[Column], Column]:
    """A column function: the stems of a broadcast list that a text has somewhere in it, found in one pass by an automaton."""

    @sc.batched_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for stem in stems.value:
            automaton.add_word(stem, stem)
        if stems.value:
            automaton.make_automaton()
        for column in batches:
            yield pd.Series([sorted({stem for _, stem in automaton.iter(t)}) if t and stems.value else [] for t in column], dtype=object)

    return found


def mentioned(texts: DataFrame, stems: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """path, stem: the stems that a text (path, text) has somewhere in it. All are looked for in one pass over a text; more than `most` of
    them go to the tasks by parts of some that size. No pair is made that isn't found."""
    stems = written(stems.filter("stem != ''").select("stem").distinct(), "stems")
    parts = max(1, -(-stems.count() // most))
    out = None
    for k in range(parts):
        own = stems if parts == 1 else stems.filter(F.pmod(F.xxhash64("stem"), F.lit(parts)) == k)
        sent = texts.sparkSession.sparkContext.broadcast([r.stem for r in own.collect()])  # some `most` of them
        hits = texts.select("path", F.explode(finder(sent)("text")).alias("stem"))
        out = hits if out is None else out.unionByName(hits)
    return out


def test_relations(sources: DataFrame, edges: DataFrame, declared: DataFrame, modules: DataFrame, targets: Column | None = None) -> DataFrame:
    """test_path, path, relation of test files and the others (or those of which `targets` holds): direct (the test imports the file),
    indirect (a name that it imports comes through the file, along re-exports, and is found), weak (neither, but their names' stems are
    the same, or the file's stem is in the test's text). The strongest of a pair counts.

    sources: path, text; edges, declared, modules: of `module_edges`."""
    is_test = F.col("path").rlike(md.TEST_PATH)
    tests_ = sources.filter(is_test).select(F.col("path").alias("test_path"))
    others = sources.filter(~is_test if targets is None else ~is_test & targets).select("path")
    direct = modules.filter("path is not null").select(F.col("from_path").alias("test_path"), "path").distinct().join(tests_, "test_path", "left_semi")
    walks = traced(edges, declared, starts=F.col("from_path").rlike(md.TEST_PATH), with_seen=True).filter(F.col("status") == RESOLVED)
    through = walks.select(F.col("start_path").alias("test_path"), F.explode(F.transform(F.slice("seen", F.lit(3), F.size("seen")), lambda x: F.regexp_replace(x, ":[^:]*$", ""))).alias("path"))
    stems = written(others.withColumn("stem", stem_of("path")), "targets")
    by_name = tests_.withColumn("stem", stem_of("test_path"))
    by_text = mentioned(sources.filter(is_test).select("path", "text"), stems).withColumnRenamed("path", "test_path")
    weak = stems.join(by_name.unionByName(by_text.select("test_path", "stem")), "stem").select("test_path", "path")
    rank = lambda df, k: df.select("test_path", "path", F.lit(k).alias("k"))
    every = rank(direct, 0).unionByName(rank(through, 1)).join(others, "path", "left_semi").unionByName(rank(weak, 2))
    best = every.groupBy("test_path", "path").agg(F.min("k").alias("k"))
    return best.select("test_path", "path", F.element_at(F.array(F.lit("direct"), F.lit("indirect"), F.lit("weak")), F.col("k") + 1).alias("relation"))
