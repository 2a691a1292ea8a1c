"""Queries over scans, filters, occurrences and projections, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as tx
from corpuslens.sources import corpus as co

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


SRC = "src AS (SELECT concat(lang, '/', source, '/', doc_id, '.txt') AS path, text, lang, source, doc_id FROM documents)"
LINES = (
    SRC
    + r""", arr AS (SELECT path, string_split(text, chr(10)) AS a FROM src),
 every AS (SELECT path, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line, len(a) AS n FROM arr),
 lines AS (SELECT path, line_no, line FROM every WHERE NOT (line_no = n AND line = ''))"""
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.document_sources(spark, sf_dir)


# --- line scans -----------------------------------------------------------------------------------------------------


@query(f"WITH {LINES} SELECT path, line_no, line FROM lines WHERE contains(line, 'the')")
def scan_literal_lines(spark, sf_dir):
    """Lines that hold a literal."""
    return co.matching_lines(documents(spark, sf_dir), "the", literal=True)


@query(rf"WITH {LINES} SELECT path, line_no, line FROM lines WHERE regexp_matches(line, 'th[a-z]*ing|[0-9]{{3,}}')")
def scan_regex_lines(spark, sf_dir):
    """lines that match a regular expression."""
    return co.matching_lines(documents(spark, sf_dir), "th[a-z]*ing|[0-9]{3,}")


@query(rf"WITH {LINES} SELECT path, line_no FROM lines WHERE regexp_matches(line, '(^|[^\p{{L}}\p{{N}}_])the($|[^\p{{L}}\p{{N}}_])')")
def scan_whole_word(spark, sf_dir):
    """whole words, by Unicode letters and digits."""
    return co.matching_lines(documents(spark, sf_dir), "the", literal=True, whole_word=True).select("path", "line_no")


@query(f"WITH {LINES} SELECT path, line_no FROM lines WHERE regexp_matches(line, '(?i)éaux')")
def scan_ignore_case(spark, sf_dir):
    """case-insensitive, in Unicode."""
    return co.matching_lines(documents(spark, sf_dir), "ÉAUX", literal=True, ignore_case=True).select("path", "line_no")


@query(f"WITH {LINES} SELECT p AS pattern, count(*) AS matching_lines FROM lines, (VALUES ('the'), ('The')) t(p) WHERE CASE WHEN p = lower(p) THEN contains(lower(line), p) ELSE contains(line, p) END GROUP BY p")
def scan_smart_case(spark, sf_dir):
    """without a given case, a pattern without upper case matches in any case."""
    rows = co.plain_lines(documents(spark, sf_dir))
    which = F.array_compact(F.array(*(F.when(tx.line_matches(F.col("line"), p, literal=True, ignore_case=None), F.lit(p)) for p in ("the", "The"))))
    return rows.select(F.explode(which).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("matching_lines"))


@query("""WITH src AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, html FROM pages),
 every AS (SELECT page_id, path, unnest(string_split(html, chr(10))) AS line FROM src)
 SELECT page_id, path, count(*) AS matching_lines FROM every WHERE contains(line, '<article') GROUP BY page_id, path""")
def scan_html_pages(spark, sf_dir):
    """S2 on pages: matching lines for each page."""
    pages = co.page_sources(spark, sf_dir).filter(F.contains("text", F.lit("<article")))
    hits = F.filter(tx.lines_of(F.col("text")), lambda x: F.contains(x, F.lit("<article")))
    return pages.select("page_id", "path", F.size(hits).cast("long").alias("matching_lines"))


@query("SELECT role, count(*) AS turns, sum(CASE WHEN contains(text, 'the') THEN 1 ELSE 0 END) AS matching_turns FROM conversations GROUP BY role")
def scan_conversations(spark, sf_dir):
    """S2 on conversations: turns that hold a literal, by role."""
    c = co.conversation_sources(spark, sf_dir)
    return c.groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.contains("text", F.lit("the")).cast("long")).alias("matching_turns"))


@query(f"WITH {LINES} SELECT path, count(*) AS crowded_lines FROM lines WHERE strlen(line) > 2000 GROUP BY path")
def scan_oversized_lines(spark, sf_dir):
    """Lines over a byte cap, reported instead of scanned."""
    rows = co.plain_lines(documents(spark, sf_dir).filter(F.octet_length("text") > 2000))
    return rows.filter(F.octet_length("line") > 2000).groupBy("path").agg(F.count("*").alias("crowded_lines"))


# --- path, time and admission filters -------------------------------------------------------------------------------


@query("""WITH src AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages),
 v AS (SELECT page_id, path, regexp_matches(path, '^(?:[^/]*)/en/(?:.*)$') AS i1, regexp_matches(path, '^(?:[^/]*)/de/(?:.*)$') AS i2, regexp_matches(path, '^blog\\.(?:[^/]*)/(?:.*)$') AS x FROM src)
 SELECT page_id, path FROM v WHERE (i1 OR i2) AND NOT x""".replace("\\\\", "\\"))
def glob_include_exclude(spark, sf_dir):
    """include globs, then exclude globs; the last that matches decides."""
    return co.enumerated(co.page_sources(spark, sf_dir), include=["*/en/**", "*/de/**"], exclude=["blog.*/**"]).select("page_id", "path")


HIDDEN = "concat(lang, '/', CASE WHEN source = 'src3' THEN '.cache' WHEN source = 'src4' THEN '.GIT' ELSE source END, '/', doc_id, '.txt')"


@query(f"WITH s AS (SELECT {HIDDEN} AS path FROM documents) SELECT path, NOT regexp_matches(path, '(^|/)\\.[^/]') AS shown FROM s WHERE NOT list_contains(string_split(lower(path), '/'), '.git')")
def hidden_filter(spark, sf_dir):
    """hidden path parts, and .git, which is never searched."""
    folder = F.when(F.col("source") == "src3", ".cache").when(F.col("source") == "src4", ".GIT").otherwise(F.col("source"))
    path = F.concat_ws("/", "lang", folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return co.enumerated(documents(spark, sf_dir).select(path.alias("path"))).select("path", (~tx.is_hidden(F.col("path"))).alias("shown"))


WINDOW = ("2024-01-05 00:00:00", "2024-01-12 00:00:00")


@query(f"""WITH s AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS mtime FROM events)
 SELECT event_id, (mtime IS NULL OR (mtime >= TIMESTAMP '{WINDOW[0]}' AND mtime < TIMESTAMP '{WINDOW[1]}')) AS in_content, coalesce(mtime >= TIMESTAMP '{WINDOW[0]}' AND mtime < TIMESTAMP '{WINDOW[1]}', FALSE) AS in_files, mtime IS NULL AS unknown_time FROM s""")
def mtime_window(spark, sf_dir):
    """lower bound in, upper out; unknown times stay in a content search and go from a file search."""
    e = co.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("ts")).alias("mtime"))
    within = (F.col("mtime") >= F.lit(WINDOW[0]).cast("timestamp_ntz")) & (F.col("mtime") < F.lit(WINDOW[1]).cast("timestamp_ntz"))
    return e.select("event_id", (F.col("mtime").isNull() | within).alias("in_content"), F.coalesce(within, F.lit(False)).alias("in_files"), F.col("mtime").isNull().alias("unknown_time"))


@query(f"""WITH {LINES}, hits AS (SELECT path, line_no FROM lines WHERE contains(line, 'MIT License')), scoped AS (SELECT * FROM hits WHERE starts_with(path, 'none/here/'))
 SELECT path, line_no, FALSE AS expanded FROM scoped UNION ALL SELECT path, line_no, TRUE AS expanded FROM hits WHERE NOT EXISTS (SELECT 1 FROM scoped)""")
def scope_expand(spark, sf_dir):
    """a scope without a match is widened to the root, and that is said."""
    docs = documents(spark, sf_dir)
    scoped = co.matching_lines(docs.filter(tx.in_scope(F.col("path"), "none/here")), "MIT License", literal=True)
    expanded = not scoped.head(1)
    rows = co.matching_lines(docs, "MIT License", literal=True) if expanded else scoped
    return rows.select("path", "line_no", F.lit(expanded).alias("expanded"))


@query("""SELECT doc_id, CASE WHEN contains(text, chr(0)) THEN 'binary' WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 'empty' ELSE 'ok' END AS status,
 regexp_matches(text, '\\r([^\\n]|$)') AS bare_cr FROM documents""".replace("\\\\", "\\"))
def admission_status(spark, sf_dir):
    """binary, empty and ordinary sources; a carriage return alone is flagged."""
    d = documents(spark, sf_dir)
    status = F.when(F.contains("text", F.lit("\0")), "binary").when(F.trim(F.regexp_replace("text", r"\s+", " ")) == "", "empty").otherwise("ok")
    return d.select("doc_id", status.alias("status"), F.col("text").rlike(r"\r(?!\n)").alias("bare_cr"))


@query(f"WITH {SRC} SELECT path, sha256(text) AS content_hash, strlen(text) AS size FROM src")
def file_enumeration(spark, sf_dir):
    """All sources with their hash and size."""
    return co.enumerated(documents(spark, sf_dir)).select("path", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size"))


@query("SELECT doc_id, source FROM documents WHERE list_contains(['src1', 'src7'], source)")
def selected_paths(spark, sf_dir):
    """A semi join with a given list."""
    d = co.table(spark, sf_dir, "documents")
    wanted = spark.sql("SELECT * FROM VALUES ('src1'), ('src7'), ('missing') AS t(source)")
    return d.join(F.broadcast(wanted), "source", "left_semi").select("doc_id", "source")  # a list of the request


@query("SELECT t.source FROM (VALUES ('src1'), ('src7'), ('missing')) t(source) WHERE t.source NOT IN (SELECT source FROM documents)")
def missing_paths(spark, sf_dir):
    """What a given list names and the corpus lacks."""
    wanted = spark.sql("SELECT * FROM VALUES ('src1'), ('src7'), ('missing') AS t(source)")
    return wanted.join(co.table(spark, sf_dir, "documents").select("source").distinct(), "source", "left_anti")


# --- occurrences ----------------------------------------------------------------------------------------------------

OCC = r"""occ AS (SELECT path, p AS term, i, unnest(range(1, len(pieces))) AS k, pieces FROM (SELECT path, p, i, string_split(text, p) AS pieces FROM src, terms) WHERE len(pieces) > 1),
 placed AS (SELECT path, term, i, list_sum(list_transform(pieces[1:k], lambda x: strlen(x))) + (k - 1) * strlen(term) AS byte_start FROM occ)"""


@query(f"WITH {SRC}, terms(p, i) AS (VALUES ('the', 0)), {OCC} SELECT path, CAST(byte_start AS BIGINT) AS byte_start, CAST(byte_start + 3 AS BIGINT) AS byte_end FROM placed")
def occurrence_offsets_literal(spark, sf_dir):
    """Non-overlapping byte offsets of a literal."""
    d = documents(spark, sf_dir).filter(F.contains("text", F.lit("the")))
    return d.select("path", F.inline(tx.occurrences(F.col("text"), tx.escaped("the"))))


@query(rf"""WITH {SRC}, found AS (SELECT path, regexp_extract_all(text, 'th[a-z]+ing') AS m, regexp_split_to_array(text, 'th[a-z]+ing') AS g FROM src),
 each AS (SELECT path, m, g, unnest(range(1, len(m) + 1)) AS k FROM found),
 placed AS (SELECT path, list_sum(list_transform(g[1:k], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: strlen(x))), 0) AS s, strlen(m[k]) AS n FROM each)
 SELECT path, CAST(s AS BIGINT) AS byte_start, CAST(s + n AS BIGINT) AS byte_end FROM placed""")
def occurrence_offsets_regex(spark, sf_dir):
    """Byte ranges of a regular expression's matches."""
    return documents(spark, sf_dir).select("path", F.inline(tx.occurrences(F.col("text"), "(?d)th[a-z]+ing")))


TERMS = ["the", "er", "license", "zzz"]
TERM_VALUES = ", ".join(f"('{t}', {i})" for i, t in enumerate(TERMS))


def any_of(docs: DataFrame, terms: list[str]) -> DataFrame:
    """term, term_index, path, byte_start, byte_end: every occurrence of each term, overlapping ones of different terms too."""
    each = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(i).alias("term_index"), tx.occurrences(F.col("text"), tx.escaped(t)).alias("o")) for i, t in enumerate(terms)))
    return docs.select("path", F.explode(each).alias("x")).select("path", F.col("x.term").alias("term"), F.col("x.term_index").alias("term_index"), F.inline("x.o"))


@query(f"WITH {SRC}, terms(p, i) AS (VALUES {TERM_VALUES}), {OCC} SELECT term, CAST(i AS INT) AS term_index, path, CAST(byte_start AS BIGINT) AS byte_start, CAST(byte_start + strlen(term) AS BIGINT) AS byte_end FROM placed")
def any_of_occurrences(spark, sf_dir):
    """Occurrences of several terms, each attributed to its own; one plan for any number of terms."""
    return any_of(documents(spark, sf_dir), TERMS)


@query(f"""WITH {SRC}, terms(p, i) AS (VALUES {TERM_VALUES}) SELECT p AS term, CAST(i AS INT) AS term_index, CAST(coalesce(sum(len(string_split(text, p)) - 1), 0) AS BIGINT) AS occurrences,
 count(CASE WHEN contains(text, p) THEN 1 END) AS files FROM terms, src GROUP BY p, i""")
def any_of_term_counts(spark, sf_dir):
    """A4, A2: a row for each term, zeros included, in input order."""
    docs = documents(spark, sf_dir)
    sums = docs.agg(*(F.sum(F.size(F.split("text", tx.escaped(t), -1)) - 1).alias(f"n{i}") for i, t in enumerate(TERMS)), *(F.sum(F.contains("text", F.lit(t)).cast("long")).alias(f"f{i}") for i, t in enumerate(TERMS)))
    rows = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(i).alias("term_index"), F.coalesce(f"n{i}", F.lit(0)).alias("occurrences"), F.coalesce(f"f{i}", F.lit(0)).alias("files")) for i, t in enumerate(TERMS)))
    return sums.select(F.inline(rows))


@query(f"WITH {SRC} SELECT path FROM src WHERE contains(text, 'the') AND contains(text, 'ing') AND contains(text, 'tion.')")
def all_of_files(spark, sf_dir):
    """Files that hold all terms. The division needs no grouping while a file is a row."""
    d = documents(spark, sf_dir)
    return d.filter(F.contains("text", F.lit("the")) & F.contains("text", F.lit("ing")) & F.contains("text", F.lit("tion."))).select("path")


@query(f"WITH {LINES} SELECT path, count(DISTINCT t.p) AS terms FROM lines, (VALUES ('the'), ('ing'), ('tion.')) t(p) WHERE contains(line, t.p) GROUP BY path HAVING count(DISTINCT t.p) = 3")
def all_of_by_division(spark, sf_dir):
    """A9 as relational division over lines: groups that have every term."""
    terms = ("the", "ing", "tion.")
    which = F.array_compact(F.array(*(F.when(F.contains("line", F.lit(t)), F.lit(t)) for t in terms)))
    found = co.plain_lines(documents(spark, sf_dir)).select("path", F.explode(which).alias("term")).distinct()
    return found.groupBy("path").agg(F.count("*").alias("terms")).filter(F.col("terms") == len(terms))


# --- projections ----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS utf16, len(regexp_extract_all(text, chr(10))) + CASE WHEN text <> '' AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END AS source_lines, sha256('passage' || chr(0) || text) AS embedding_key FROM documents".replace("\\\\", "\\"))
def text_measures(spark, sf_dir):
    """UTF-16 length, line count, content keys."""
    d = co.table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.utf16_length(F.col("text")).cast("long").alias("utf16"), tx.line_count(F.col("text")).cast("long").alias("source_lines"), co.embedding_key(F.lit("passage"), F.col("text")).alias("embedding_key"))


@query("""WITH p AS (SELECT doc_id, text, length(text) AS n, strpos(text, 'the') - 1 AS f FROM documents WHERE contains(text, 'the')),
 q AS (SELECT *, least(greatest(0, f - (500 - 3) // 2), n - 500) AS a FROM p)
 SELECT doc_id, CASE WHEN n <= 500 THEN text ELSE (CASE WHEN a > 0 THEN '…' ELSE '' END) || substr(text, CAST(a + 1 AS BIGINT), 500) || (CASE WHEN a + 500 < n THEN '…' ELSE '' END) END AS excerpt FROM q""")
def excerpt_centered(spark, sf_dir):
    """At most 500 characters around the first match."""
    d = co.table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("the")))
    at = F.instr("text", "the") - 1
    return d.select("doc_id", tx.excerpt(F.col("text"), at, at + 3).alias("excerpt"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)((?:password|passwd|secret|token|api_key)\s*[:=]\s*)("[^"\r\n]*"|[^\s,;}\r\n]+)', '\1[REDACTED]', 'g'), '\b(?:sk|ghp)[-_][A-Za-z0-9][A-Za-z0-9_-]{7,}\b', '[REDACTED]', 'g') AS shown,
 len(regexp_extract_all(text, '(?i)((?:password|passwd|secret|token|api_key)\s*[:=]\s*)("[^"\r\n]*"|[^\s,;}\r\n]+)')) AS hidden FROM documents""")
def redact_text(spark, sf_dir):
    """F20, X19 in the simple form that SQL can say; functions.redaction has the full rule."""
    # fixed values: the words of sensitive names and the starts of issued tokens
    assign = r"""(?i)((?:password|passwd|secret|token|api_key)\s*[:=]\s*)("[^"\r\n]*"|[^\s,;}\r\n]+)"""
    d = co.table(spark, sf_dir, "documents")
    shown = F.regexp_replace(F.regexp_replace("text", assign, "$1[REDACTED]"), r"\b(?:sk|ghp)[-_][A-Za-z0-9][A-Za-z0-9_-]{7,}\b", "[REDACTED]")
    return d.select("doc_id", shown.alias("shown"), F.regexp_count("text", F.lit(assign)).cast("long").alias("hidden"))


@query(f"""WITH {LINES}, m AS (SELECT path, line_no FROM lines WHERE contains(line, 'License')),
 w AS (SELECT path, line_no, lag(line_no) OVER (PARTITION BY path ORDER BY line_no) AS p, lead(line_no) OVER (PARTITION BY path ORDER BY line_no) AS n FROM m)
 SELECT path, line_no, greatest(1, line_no - 2, coalesce((p + line_no) // 2 + 1, 1)) AS start_line, least(line_no + 2, coalesce((line_no + n) // 2, 9007199254740991)) AS end_line FROM w""")
def context_windows(spark, sf_dir):
    """Every context line belongs to its nearest match, ties to the earlier."""
    m = co.matching_lines(documents(spark, sf_dir), "License", literal=True).select("path", "line_no")
    w = Window.partitionBy("path").orderBy("line_no")
    p, n = F.lag("line_no").over(w), F.lead("line_no").over(w)
    start = F.greatest(F.lit(1), F.col("line_no") - 2, F.coalesce(F.floor((p + F.col("line_no")) / 2) + 1, F.lit(1)))
    end = F.least(F.col("line_no") + 2, F.coalesce(F.floor((F.col("line_no") + n) / 2), F.lit(2**53 - 1)))
    return m.select("path", "line_no", start.cast("long").alias("start_line"), end.cast("long").alias("end_line"))


@query(f"""WITH {SRC} SELECT path, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS directory, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+(\\.[^.]*)$', 1)) AS extension FROM src""".replace("\\\\", "\\"))
def path_parts(spark, sf_dir):
    """Directory and extension of a path."""
    return documents(spark, sf_dir).select("path", tx.directory(F.col("path")).alias("directory"), tx.extension(F.col("path")).alias("extension"))


@query("""WITH s AS (SELECT page_id, lower(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')) AS p FROM pages)
 SELECT page_id, CASE WHEN regexp_extract(p, '([^/]*)$', 1) = '25' THEN 100 WHEN regexp_replace(regexp_extract(p, '([^/]*)$', 1), '^(.+)[.][^.]*$', '\\1') = '25' THEN 95 WHEN contains(regexp_extract(p, '([^/]*)$', 1), '25') THEN 85 WHEN contains(p, '25') THEN 70
 WHEN strpos(p, '2') > 0 AND strpos(p[strpos(p, '2') + 1:], '5') > 0 THEN CAST(round(80.0 / (strpos(p[strpos(p, '2') + 1:], '5') + 1)) AS INT) END AS score
 FROM s WHERE strpos(p, '2') > 0 AND strpos(p[strpos(p, '2') + 1:], '5') > 0""")
def files_ranked(spark, sf_dir):
    """Scores of paths for a name query."""
    p = co.page_sources(spark, sf_dir)
    return p.select("page_id", tx.file_score(F.col("path"), "25").alias("score")).filter("score is not null")


@query("SELECT doc_id, 1 + k * 840 AS char_start, substr(text, CAST(1 + k * 840 AS BIGINT), 1000) AS passage FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 160) / 840.0) AS BIGINT)))) AS k FROM documents)")
def passages_fixed(spark, sf_dir):
    """X11 in fixed steps: passages of 1000 characters that overlap by 160."""
    d = co.table(spark, sf_dir, "documents")
    last = F.greatest(F.lit(1), F.ceil((F.length("text") - 160) / F.lit(840.0))) - 1
    k = F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("k")
    return d.select("doc_id", "text", k).select("doc_id", (1 + F.col("k") * 840).alias("char_start"), F.substring("text", (1 + F.col("k") * 840).cast("int"), F.lit(1000)).alias("passage"))
