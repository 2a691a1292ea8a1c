"""Queries over covers, previews, paging and other evidence shapes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslens.functions import text as tx
from corpuslens.operators import intervals as iv
from corpuslens.operators import ranking as rk
from corpuslens.plans.comparisons import VERSIONS
from corpuslens.plans.rankings import DOT, Q0, scored_vectors
from corpuslens.plans.relational import BASE, spans
from corpuslens.plans.scans import LINES, SRC, documents
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


COVER = BASE.replace("SELECT event_type", "SELECT event_id, event_type") + ", c AS (SELECT i.event_id AS id, o.event_type AS category, o.s AS o_start, o.e AS o_end FROM base i JOIN base o ON i.user_id = o.user_id AND i.s >= o.s AND i.e <= o.e WHERE i.event_type = 'purchase' AND o.event_type IN ('view', 'click'))"


def inner_outer(spark, sf_dir):
    s = spans(spark, sf_dir)
    outer = s.filter("event_type in ('view', 'click')").select("user_id", F.col("event_type").alias("category"), "start", "end")
    return s.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("id"), "start", "end"), outer


@query(f"WITH {COVER}, r AS (SELECT *, row_number() OVER (PARTITION BY id, category ORDER BY o_end DESC, o_start) AS k FROM c) SELECT id, category, o_start, o_end FROM r WHERE k = 1")
def interval_best_cover(spark, sf_dir):
    """For each interval and category, the covering interval that reaches furthest."""
    return iv.best_covers(*inner_outer(spark, sf_dir), "user_id", cell=3600)


@query(f"WITH {COVER}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o_end - o_start, o_start) AS k FROM c) SELECT id, o_start, o_end FROM r WHERE k = 1")
def nearest_enclosing(spark, sf_dir):
    """The smallest interval around each."""
    return iv.nearest_enclosing(*inner_outer(spark, sf_dir), "user_id", cell=3600)


@query(f"WITH {VERSIONS}, u AS (SELECT path, content_hash FROM base UNION ALL SELECT path, content_hash FROM target) SELECT path, min(content_hash) AS content_hash FROM u GROUP BY path HAVING count(DISTINCT content_hash) = 1")
def agreeing_references(spark, sf_dir):
    """Paths whose references agree; conflicting ones go on both sides."""
    base, target = co.two_versions(spark, sf_dir)
    both = base.select("path", "content_hash").unionByName(target.select("path", "content_hash"))
    return both.groupBy("path").agg(F.min("content_hash").alias("content_hash"), F.max("content_hash").alias("m")).filter("content_hash = m").drop("m")


@query("SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'unknown' WHEN d.n > 1 THEN 'duplicate' ELSE 'mapped' END AS status FROM labels l LEFT JOIN (SELECT doc_id, count(*) AS n FROM documents GROUP BY doc_id) d USING (doc_id)")
def map_back(spark, sf_dir):
    """Staged rows back to admitted sources; unknown and duplicate ones are named."""
    n = co.table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.count("*").alias("n"))
    staged = co.table(spark, sf_dir, "labels").select("doc_id").join(n, "doc_id", "left")
    return staged.select("doc_id", F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "duplicate").otherwise("mapped").alias("status"))


@query(f"""WITH RECURSIVE {LINES}, n AS (SELECT path, count(*) AS lines_ FROM lines GROUP BY path), m AS (SELECT path, line_no FROM lines WHERE contains(line, 'the')),
 top AS (SELECT path, count(*) AS c FROM m GROUP BY path ORDER BY c DESC, path LIMIT 5),
 f AS (SELECT path, min(line_no) AS line_no, 1 AS k FROM m WHERE path IN (SELECT path FROM top) GROUP BY path
  UNION ALL SELECT f.path, (SELECT min(m.line_no) FROM m WHERE m.path = f.path AND m.line_no > f.line_no + 6), k + 1 FROM f WHERE k < 2)
 SELECT path, greatest(1, line_no - 3) AS first_line, least(lines_, line_no + 3) AS last_line FROM f JOIN n USING (path) WHERE line_no IS NOT NULL""")
def preview_windows(spark, sf_dir):
    """For the five files with most matches, the first two windows of seven lines that don't overlap; a fold over a file's lines."""
    docs = documents(spark, sf_dir).filter(F.contains("text", F.lit("the")))
    hit = F.transform(tx.lines_of(F.col("text")), lambda x, i: F.when(F.contains(x, F.lit("the")), i + 1))
    top = docs.select("path", F.array_compact(hit).alias("at"), F.size(tx.lines_of(F.col("text"))).alias("n")).orderBy(F.desc(F.size("at")), "path").limit(5)
    start = F.array().cast("array<int>")
    kept = F.aggregate("at", start, lambda acc, x: F.when((F.size(acc) < 2) & ((F.size(acc) == 0) | (x - F.element_at(acc, -1) > 6)), F.concat(acc, F.array(x))).otherwise(acc))
    windows = top.select("path", "n", F.explode(kept).alias("line_no"))
    return windows.select("path", F.greatest(F.lit(1), F.col("line_no") - 3).alias("first_line"), F.least("n", F.col("line_no") + 3).alias("last_line"))


@query(f"""WITH {LINES}, m AS (SELECT path, line_no, row_number() OVER (ORDER BY path, line_no) AS rn FROM lines WHERE contains(line, 'License')) SELECT path, line_no, rn, CASE WHEN rn <= 5 THEN 'served' ELSE 'next' END AS part FROM m WHERE rn <= 20""")
def inspect_batches(spark, sf_dir):
    """Of twenty targets five are served, the rest is the next request (limits of the feature)."""
    m = co.matching_lines(documents(spark, sf_dir), "License", literal=True).select("path", "line_no")
    return rk.ranked(m, ["path", "line_no"], "rn", 20).withColumn("part", F.when(F.col("rn") <= 5, "served").otherwise("next"))


@query(f"""WITH {SRC}, t(p, i) AS (VALUES ('the', 0), ('er', 1), ('license', 2), ('zzz', 3)), c AS (SELECT p, i, sum(len(string_split(text, p)) - 1) AS n FROM t, src GROUP BY p, i),
 s AS (SELECT p AS term, CAST(n AS BIGINT) AS occurrences, sum(strlen(p) + 20) OVER (ORDER BY i) AS so_far FROM c) SELECT term, occurrences, so_far <= 60 AS inline FROM s""")
def term_count_page(spark, sf_dir):
    """Term counts inline while they fit, on a page of their own after that. As many rows as terms."""
    from corpuslens.plans.scans import TERMS, any_of_term_counts

    c = any_of_term_counts(spark, sf_dir)
    assert len(TERMS) <= 64  # a request's bound, so the window below is over that many rows
    so_far = F.sum(F.octet_length("term") + 20).over(Window.orderBy("term_index"))
    return c.select("term", "occurrences", (so_far <= 60).alias("inline"))


@query(f"""WITH {SRC}, o AS (SELECT path, substr(text, 1, strpos(text, 'License') - 1) AS b FROM src WHERE contains(text, 'License'))
 SELECT path, strlen(b) AS byte_start, len(string_split(b, chr(10))) AS line_no, length(replace(string_split(b, chr(10))[-1], chr(13), '')) + len(regexp_extract_all(string_split(b, chr(10))[-1], '[\\x{{10000}}-\\x{{10FFFF}}]')) AS column_no FROM o""")
def occurrence_positions(spark, sf_dir):
    """Byte, line and column (UTF-16 units, without CR) of the first occurrence."""
    d = documents(spark, sf_dir).filter(F.contains("text", F.lit("License")))
    before = F.substring("text", F.lit(1), F.instr("text", "License") - 1)
    d = d.select("path", before.alias("b"))
    return d.select("path", F.octet_length("b").cast("long").alias("byte_start"), (F.regexp_count("b", F.lit("\n")) + 1).cast("long").alias("line_no"), tx.utf16_length(F.replace(F.substring_index("b", "\n", -1), F.lit("\r"), F.lit(""))).cast("long").alias("column_no"))


@query(f"""WITH {SRC}, a AS (SELECT path, string_split(text, chr(10)) AS l, len(string_split(substr(text, 1, strpos(text, 'License') - 1), chr(10))) AS k FROM src WHERE contains(text, 'License'))
 SELECT path, k AS line_no, array_to_string(l[greatest(1, k - 2):k + 2], chr(10)) AS support FROM a""")
def support_excerpt(spark, sf_dir):
    """The selected line with two context lines on either side."""
    d = documents(spark, sf_dir).filter(F.contains("text", F.lit("License")))
    k = F.regexp_count(F.substring("text", F.lit(1), F.instr("text", "License") - 1), F.lit("\n")) + 1
    d = d.select("path", F.split("text", "\n", -1).alias("l"), k.alias("k"))
    first = F.greatest(F.lit(1), F.col("k") - 2)
    return d.select("path", F.col("k").cast("long").alias("line_no"), F.array_join(F.slice("l", first, F.col("k") + 2 - first + 1), "\n").alias("support"))


@query(f"""WITH {SRC}, w AS (SELECT doc_id, unnest([lang || 'Of' || source, lang || '_' || source, upper(lang) || source, source, lang || ' ' || source, '$' || lang || '_1', doc_id || 'a_b', string_split(text, ' ')[1]]) AS name FROM src)
 SELECT name, count(*) AS n, regexp_matches(name, '^[A-Za-z_$][A-Za-z0-9_$]*$') AND regexp_matches(name, '[a-z][A-Z]|_|^[A-Z].*[a-z]') AS identifier FROM w GROUP BY name""")
def identifier_queries(spark, sf_dir):
    """Which queries are a single code-shaped identifier (names made of documents' fields, and their first words)."""
    d, c = documents(spark, sf_dir), F.concat
    lang, source = F.col("lang"), F.col("source")
    made = [c(lang, F.lit("Of"), source), c(lang, F.lit("_"), source), c(F.upper(lang), source), source, c(lang, F.lit(" "), source), c(F.lit("$"), lang, F.lit("_1")), c(F.col("doc_id").cast("string"), F.lit("a_b")), F.split("text", " ", -1)[0]]
    n = d.select(F.explode(F.array(*made)).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return n.select("name", "n", (F.col("name").rlike(r"^[A-Za-z_$][\w$]*$") & F.col("name").rlike(r"[a-z][A-Z]|_|^[A-Z].*[a-z]")).alias("identifier"))


@query(f"""WITH {SRC}, p AS (SELECT CASE source WHEN 'src0' THEN 'home/' || lang || '/.ssh/' || doc_id WHEN 'src1' THEN 'proc/' || doc_id || '/mem' WHEN 'src2' THEN 'src/proc' || doc_id || '.c' WHEN 'src3' THEN lang || '/.aws/credentials' ELSE path END AS path FROM src)
 SELECT path, NOT list_has_any(list_transform({tx.DENIED!r}, lambda d: contains('/' || path, '/' || d)), [TRUE]) AS allowed FROM p""")
def protected_paths(spark, sf_dir):
    """paths of credentials and system roots are never read (documents at such paths, by their source)."""
    d, c, n = documents(spark, sf_dir), F.concat, F.col("doc_id").cast("string")
    at = lambda k: F.col("source") == k
    path = F.when(at("src0"), c(F.lit("home/"), "lang", F.lit("/.ssh/"), n)).when(at("src1"), c(F.lit("proc/"), n, F.lit("/mem"))).when(at("src2"), c(F.lit("src/proc"), n, F.lit(".c"))).when(at("src3"), c("lang", F.lit("/.aws/credentials"))).otherwise(F.col("path"))
    return d.select(path.alias("path")).select("path", (~tx.is_protected(F.col("path"))).alias("allowed"))


@query(r"""WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(0, greatest(1, CAST(ceil((n - 64) / 192.0) AS BIGINT)))) AS k FROM t)
 SELECT doc_id, k AS window_no, k * 192 AS first_token, least(n, k * 192 + 256) AS end_token FROM w""")
def token_windows(spark, sf_dir):
    """Windows of 256 tokens that overlap by 64."""
    t = co.table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n"))
    last = (F.greatest(F.lit(1), F.ceil((F.col("n") - 64) / 192.0)) - 1).cast("long")
    w = t.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("window_no"))
    return w.select("doc_id", "window_no", (F.col("window_no") * 192).alias("first_token"), F.least(F.col("n"), F.col("window_no") * 192 + 256).alias("end_token"))


@query(f"WITH {Q0}, s AS (SELECT vec_id, label, {DOT} AS score FROM embeddings e, q WHERE label IN (1, 2)) SELECT vec_id, CASE label WHEN 1 THEN 'image' ELSE 'scan' END AS kind, score FROM s ORDER BY score DESC, vec_id LIMIT 10")
def visual_retrieval(spark, sf_dir):
    """The ten best vectors of the visual kinds (a top-k)."""
    s = scored_vectors(spark, sf_dir).filter("label in (1, 2)")
    return s.select("vec_id", F.when(F.col("label") == 1, "image").otherwise("scan").alias("kind"), "score").orderBy(F.desc("score"), "vec_id").limit(10)


@query(f"""WITH {VERSIONS} SELECT path, 'worktree' AS origin, size FROM target WHERE starts_with(path, 'moved/') UNION ALL SELECT path, 'commit', size FROM base WHERE starts_with(path, 'fr/')""")
def versioned_read(spark, sf_dir):
    """The same folder read at two versions."""
    base, target = co.two_versions(spark, sf_dir)
    at = lambda df, folder, name: df.filter(tx.in_scope(F.col("path"), folder)).select("path", F.lit(name).alias("origin"), F.col("size").cast("long").alias("size"))
    return at(target, "moved", "worktree").unionByName(at(base, "fr", "commit"))


@query("SELECT source, CAST(sum(n_chars) AS BIGINT) AS searched, sum(CASE WHEN n_chars > 5000 THEN 1 ELSE 0 END) AS skipped, CASE WHEN bool_or(n_chars > 5000) THEN 'partial' ELSE 'complete' END AS coverage FROM documents GROUP BY source")
def coverage_by_folder(spark, sf_dir):
    """Coverage: what a size limit skips is said, so that nothing is claimed of it."""
    over = F.col("n_chars") > 5000
    return co.table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("searched"), F.sum(over.cast("long")).alias("skipped"), F.when(F.bool_or(over), "partial").otherwise("complete").alias("coverage"))


#: Bytes of a page of source text.
SOURCE_PAGE = 4096
SNAPPED = "CASE WHEN {0} >= n THEN n " + " ".join(f"WHEN substr(h, 2 * ({{0}} - {k}) + 1, 1) NOT IN ('8', '9', 'A', 'B') THEN {{0}} - {k}" for k in range(3)) + " ELSE {0} - 3 END"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, hex(encode(text)) AS h, CAST(strlen(text) AS BIGINT) AS n FROM documents WHERE text <> ''),
 f AS (SELECT doc_id, 1 AS page_no, CAST(0 AS BIGINT) AS byte_start, CAST({SNAPPED.format(SOURCE_PAGE)} AS BIGINT) AS byte_end FROM d
  UNION ALL SELECT doc_id, page_no + 1, byte_end, CAST({SNAPPED.format(f"(byte_end + {SOURCE_PAGE})")} AS BIGINT) FROM f JOIN d USING (doc_id) WHERE byte_end < n)
 SELECT doc_id, page_no, byte_start, byte_end, n - byte_end AS remaining FROM f JOIN d USING (doc_id)""")
def source_byte_pages(spark, sf_dir):
    """Sources in pages of bytes that cut no character, with what remains after each. Within the row; no shuffle."""
    d = co.table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"), F.posexplode(tx.byte_pages(F.col("text"), SOURCE_PAGE)).alias("p", "page"))
    return d.select("doc_id", (F.col("p") + 1).alias("page_no"), F.col("page.byte_start").alias("byte_start"), F.col("page.byte_end").alias("byte_end"), (F.col("n") - F.col("page.byte_end")).alias("remaining"))
