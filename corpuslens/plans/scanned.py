"""Queries over sequential scanners (Arrow UDFs), with SQL where the fixture's answer can be said in it."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import modules as md
from corpuslens.functions import scanners as sc
from corpuslens.functions import structure as st
from corpuslens.functions import text as tx
from corpuslens.operators import changes as ch
from corpuslens.operators import compare as cm
from corpuslens.operators import ignoring as ig
from corpuslens.plans.comparisons import VERSIONS
from corpuslens.sources import corpus as co

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


@query(f"""WITH {VERSIONS}, p AS (SELECT b.path, b.text AS old, len(string_split(b.text, chr(10))) AS n FROM base b JOIN target t USING (path) WHERE b.content_hash <> t.content_hash)
 SELECT path, CASE WHEN old = '' OR right(old, 1) = chr(10) THEN '' ELSE n || '-' || n END AS old, CASE WHEN old = '' THEN '1-2' WHEN right(old, 1) = chr(10) THEN n || '-' || (n + 1) ELSE n || '-' || (n + 1) END AS new FROM p""")
def changed_line_ranges(spark, sf_dir):
    """Line ranges of a shortest edit script between two versions (here a line is added, so SQL can say the answer)."""
    base, target = co.two_versions(spark, sf_dir)
    pairs = base.select("path", F.col("text").alias("a"), F.col("content_hash").alias("h")).join(target.select("path", F.col("text").alias("b"), F.col("content_hash").alias("g")), "path").filter("h != g")
    return pairs.select("path", sc.changed_line_ranges(F.col("a"), F.col("b")).alias("r")).select("path", F.col("r.old").alias("old"), F.col("r.new").alias("new"))


def in_changed_lines(spark, sf_dir, side: str, literal: str):
    rows = ch.changed_sources(*co.two_versions(spark, sf_dir)).filter(F.contains(side, F.lit(literal)))
    rows = rows.withColumn("ranges", ch.changed_ranges(F.col("old"), F.col("new"), side)).withColumn("text", F.col(side))
    return ch.with_hits(rows, tx.occurrences(F.col("text"), tx.escaped(literal)), ranged=True).select("path", "change", F.inline("hits"))


def in_changed_lines_sql(side: str, other: str, change: str, literal: str) -> str:
    """A modified text's changed lines go from the start of the old text's last line on, as a line was added."""
    return f"""WITH {VERSIONS}, c AS (SELECT s.path, s.text, CASE WHEN o.path IS NULL THEN '{change}' ELSE 'modified' END AS change, CASE WHEN o.path IS NULL THEN 0 ELSE strlen(b.text) - strlen(string_split(b.text, chr(10))[-1]) END AS first_byte
  FROM {side} s LEFT JOIN {other} o ON s.path = o.path LEFT JOIN base b ON b.path = s.path WHERE o.content_hash IS DISTINCT FROM s.content_hash AND contains(s.text, '{literal}')),
 k AS (SELECT path, change, first_byte, pieces, unnest(range(1, len(pieces))) AS k FROM (SELECT *, string_split(text, '{literal}') AS pieces FROM c)),
 o AS (SELECT path, change, first_byte, array_to_string(pieces[1:k], '{literal}') AS before FROM k)
 SELECT path, change, CAST(strlen(before) AS BIGINT) AS byte_start, CAST(strlen(before) + {len(literal)} AS BIGINT) AS byte_end, CAST(len(string_split(before, chr(10))) AS INT) AS line_no FROM o WHERE strlen(before) >= first_byte"""


@query(in_changed_lines_sql("target", "base", "added", "line"))
def changed_line_occurrences(spark, sf_dir):
    """F16 with J3: occurrences within the lines that changed, on the new side."""
    return in_changed_lines(spark, sf_dir, "new", "line")


@query(in_changed_lines_sql("base", "target", "removed", "er"))
def changed_line_occurrences_old(spark, sf_dir):
    """F16 with J3: the same on the old side."""
    return in_changed_lines(spark, sf_dir, "old", "er")


@query("""WITH p AS (SELECT lang || '/' || source || '/' || doc_id || '.txt' AS path, lang, source, CAST(doc_id AS VARCHAR) AS d FROM documents),
 r AS (SELECT path, CASE WHEN source = 'src3' THEN lang || '/.gitignore:src3/' WHEN source = 'src2' AND right(d, 1) <> '5' THEN lang || '/src2/.ignore:*' WHEN source = 'src2' THEN NULL
  WHEN right(d, 1) = '7' AND NOT (source = 'src1' AND starts_with(d, '1')) THEN lang || '/.gitignore:*7.txt' END AS ignored_by FROM p) SELECT path, ignored_by FROM r WHERE ignored_by IS NOT NULL""")
def ignore_rules(spark, sf_dir):
    """The sources that rule files among them leave out, with the deciding rule. The rule files are derived from the documents'
    folders: one for each language, and one for each source src1 and src2."""
    d = co.document_sources(spark, sf_dir)
    at = lambda folder, name, text: d.select(F.concat_ws("/", *folder, F.lit(name)).alias("path"), F.lit(text).alias("text")).distinct()
    lang = at(["lang"], ".gitignore", "# left out\nsrc3/\n*7.txt\n!src1/1*7.txt\n")
    below = at(["lang", F.lit("src2")], ".ignore", "*\n!*5.txt\n").unionByName(at(["lang", F.lit("src3")], ".gitignore", "!*\n"))
    every = d.select("path", "text").unionByName(lang).unionByName(below)
    return ig.with_rule(every).filter("ignored_by is not null").filter(F.endswith("path", F.lit(".txt"))).select("path", "ignored_by")


PYTHON = f"""{VERSIONS}, py AS (SELECT doc_id, 'py/' || doc_id || '.py' AS path, string_split(text, chr(10)) AS l FROM src), k AS (SELECT doc_id, path, unnest(range(1, len(l) + 1)) AS i, len(l) AS n FROM py)"""


def python_sources(spark, sf_dir):
    """path, text: a class for each document, a method for each of its lines, with the line as a comment, a call and a nested function."""
    d = co.table(spark, sf_dir, "documents")
    method = lambda x, i: F.concat(F.lit("    def m"), (i + 1).cast("string"), F.lit("(self,\n            x=(1, 2)):\n        # def no(): "), x, F.lit("\n        def inner():\n            return 'class No:'\n        return call(x)\n"))
    body = F.array_join(F.transform(F.split("text", "\n", -1), method), "")
    return d.select(F.concat(F.lit("py/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("import os\nclass D"), F.col("doc_id").cast("string"), F.lit("(Base):\n"), body).alias("text"))


@query(f"""WITH {PYTHON} SELECT path, 'D' || doc_id AS name, 'class' AS kind, 2 AS start_line, 3 + 6 * len(l) AS end_line, '' AS scope FROM py
 UNION ALL SELECT path, 'm' || i, 'method', 3 + 6 * (i - 1), 2 + 6 * i + CASE WHEN i = n THEN 1 ELSE 0 END, 'D' || doc_id FROM k UNION ALL SELECT path, 'inner', 'function', 6 + 6 * (i - 1), 1 + 6 * i, 'D' || doc_id || '.m' || i FROM k""")
def python_outline(spark, sf_dir):
    """Declarations of Python text, by indentation."""
    return python_sources(spark, sf_dir).select("path", F.inline(sc.python_outline(F.col("text"))))


@query(f"WITH {PYTHON} SELECT path, role, n FROM (SELECT path, 'import' AS role, 1 AS n FROM py UNION ALL SELECT path, 'declaration', 1 + 2 * len(l) FROM py UNION ALL SELECT path, unnest(['comment', 'string', 'call']), len(l) FROM py)")
def python_roles(spark, sf_dir):
    """Lexical roles of Python text, counted for each file."""
    return python_sources(spark, sf_dir).select("path", F.inline(sc.python_roles(F.col("text")))).filter("role != 'code'").groupBy("path", "role").agg(F.count("*").alias("n"))


@query(f"WITH {PYTHON} SELECT path, name, own_lines FROM (SELECT path, 'm' || i AS name, CASE WHEN i = n THEN 5 ELSE 4 END AS own_lines FROM k UNION ALL SELECT path, 'inner', 2 FROM k)")
def own_code(spark, sf_dir):
    """A10: the lines of each function that aren't a nested one's."""
    rows = python_sources(spark, sf_dir).select("path", F.inline(md.own(F.col("path"), F.col("text"))))
    return rows.select("path", "name", (F.regexp_count("own", F.lit("\n")) + 1).alias("own_lines"))


@query(f"WITH {PYTHON}, r AS (SELECT path, 3 + 6 * (i - 1) + 5 AS line_no, 'm' || i AS inside FROM k) SELECT path, line_no, inside FROM r")
def calls_within_functions(spark, sf_dir):
    """The smallest declaration around each line with a call, from outlines and roles, which meet in a source's row."""
    return python_sources(spark, sf_dir).select("path", F.inline(sc.python_calls_inside(F.col("text"))))


@query("""WITH k AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
 SELECT 'src/' || doc_id || '.ts' AS path, 2 * i - 1 AS line_no, length('call(x0,' || chr(10) || '  x0, [' || i || ', "call(a, a)"])') AS chars FROM k WHERE i % 2 = i % 3""")
def structural_matches(spark, sf_dir):
    """A pattern's matches over scripts (two lines for each line of a document): calls whose first two arguments are the same."""
    number, chosen = lambda x: x.cast("string"), lambda i, n: F.pmod(i, F.lit(n)).cast("string")
    call = lambda _, i: F.concat(F.lit("call(x"), chosen(i + 1, 2), F.lit(",\n  x"), chosen(i + 1, 3), F.lit(", ["), number(i + 1), F.lit(', "call(a, a)"]);\n'))
    d = co.table(spark, sf_dir, "documents")
    s = d.select(F.concat(F.lit("src/"), number(F.col("doc_id")), F.lit(".ts")).alias("path"), F.array_join(F.transform(F.split("text", "\n", -1), call), "").alias("text"))
    rows = s.select("path", F.inline(st.structural("call($A, $A, $$$REST)")(F.col("path"), F.col("text"))))
    return rows.filter("status = 'ok'").select("path", "line_no", (F.col("end") - F.col("start")).alias("chars"))


@query()
def passages_snapped(spark, sf_dir):
    """X11: passages that end at line ends where they can; tests compare it with a plain loop."""
    d = co.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(sc.passages(F.col("text"))).alias("passage_no", "p")).select("doc_id", "passage_no", F.col("p.start").alias("char_start"), F.col("p.end").alias("char_end"))


@query()
def redact_full(spark, sf_dir):
    """The full redaction rule."""
    return co.table(spark, sf_dir, "documents").select("doc_id", sc.redaction(F.col("text")).alias("r")).select("doc_id", "r.shown", "r.hidden")


@query()
def rename_pairs(spark, sf_dir):
    """Removed and added paths that are each other's only best match by common lines."""
    base, target = co.two_versions(spark, sf_dir)
    return cm.rename_pairs(base.join(target.select("path"), "path", "left_anti"), target.join(base.select("path"), "path", "left_anti"))
