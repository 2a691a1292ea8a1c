"""Queries over versions, audits, coverage, graphs and capabilities, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import modules as md
from corpuslens.functions import text as tx
from corpuslens.operators import compare as cm
from corpuslens.operators import graph as gr
from corpuslens.operators import ranking as rk
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


VERSIONS = (
    SRC
    + """, base AS (SELECT path, doc_id, text, strlen(text) AS size, sha256(text) AS content_hash FROM src),
 tgt0 AS (SELECT CASE WHEN lang = 'fr' THEN 'moved/' || path ELSE path END AS path, doc_id, CASE WHEN source = 'src5' THEN text || chr(10) || 'An added line.' ELSE text END AS text FROM src WHERE source <> 'src3'),
 target AS (SELECT path, doc_id, text, strlen(text) AS size, sha256(text) AS content_hash FROM tgt0)"""
)


@query(f"WITH {VERSIONS} SELECT path, CASE WHEN b.content_hash IS NULL THEN 'added' WHEN t.content_hash IS NULL THEN 'removed' ELSE 'modified' END AS change FROM base b FULL JOIN target t USING (path) WHERE b.content_hash IS DISTINCT FROM t.content_hash")
def changed_documents(spark, sf_dir):
    """Files added, removed and modified between two versions."""
    return cm.changed(*co.two_versions(spark, sf_dir))


@query(f"WITH {VERSIONS} SELECT b.path, CASE WHEN t.content_hash IS NULL THEN 'unknown' WHEN t.content_hash = b.content_hash THEN 'current' ELSE 'stale' END AS status FROM base b LEFT JOIN target t USING (path)")
def validate_sources(spark, sf_dir):
    """Saved sources against the present ones."""
    return cm.validated(*co.two_versions(spark, sf_dir))


@query(f"""WITH {VERSIONS}, v AS (SELECT split_part(b.path, '/', 1) AS lang, CASE WHEN t.content_hash IS NULL THEN 'unknown' WHEN t.content_hash = b.content_hash THEN 'current' ELSE 'stale' END AS status FROM base b LEFT JOIN target t USING (path))
 SELECT lang, CASE WHEN bool_or(status = 'stale') THEN 'stale' WHEN bool_or(status = 'unknown') THEN 'unknown' ELSE 'current' END AS validity FROM v GROUP BY lang""")
def validity_aggregate(spark, sf_dir):
    """The validity of sets of sources."""
    v = cm.validated(*co.two_versions(spark, sf_dir))
    return v.groupBy(F.split("path", "/")[0].alias("lang")).agg(cm.validity().alias("validity"))


@query(f"WITH {VERSIONS} SELECT b.path, status, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY CASE status WHEN 'stale' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END, path) AS place FROM (SELECT b.path, CASE WHEN t.content_hash IS NULL THEN 'unknown' WHEN t.content_hash = b.content_hash THEN 'current' ELSE 'stale' END AS status FROM base b LEFT JOIN target t USING (path)) b")
def validation_listing(spark, sf_dir):
    """Stale, unknown, current, then path, within each folder."""
    v = cm.validated(*co.two_versions(spark, sf_dir))
    order = F.when(F.col("status") == "stale", 0).when(F.col("status") == "unknown", 1).otherwise(2)
    v = rk.numbered_within(v.withColumn("order_", order), F.split("path", "/")[0], ["order_", "path"], "place")
    return v.select("path", "status", "place")


@query(f"WITH {VERSIONS} SELECT b.path FROM base b JOIN target t ON b.path = t.path AND b.content_hash = t.content_hash")
def stable_revisions(spark, sf_dir):
    """Sources that are the same before and after."""
    return cm.stable(*co.two_versions(spark, sf_dir)).select("path")


@query(f"""WITH {VERSIONS}, a AS (SELECT path, len(string_split(text, 'the')) - 1 AS n, CASE WHEN contains(path, 'src9/') THEN NULL ELSE content_hash END AS h FROM base WHERE contains(text, 'the')),
 b AS (SELECT path, len(string_split(text, 'the')) - 1 AS n, content_hash AS h FROM target WHERE contains(text, 'the'))
 SELECT path, a.n AS a_n, b.n AS b_n, CASE WHEN a.h IS NULL OR b.h IS NULL THEN 'unknown' WHEN a.n = b.n AND a.h = b.h THEN 'same' ELSE 'changed' END AS verdict FROM a FULL JOIN b USING (path)""")
def scan_compare(spark, sf_dir):
    """Two scans side by side; without a revision nothing is claimed."""
    base, target = co.two_versions(spark, sf_dir)
    n = (F.size(F.split("text", "the", -1)) - 1).cast("long")
    scan = lambda df: df.filter(F.contains("text", F.lit("the"))).select("path", n.alias("n"), "content_hash")
    before = scan(base).withColumn("content_hash", F.when(~F.contains("path", F.lit("src9/")), F.col("content_hash")))
    return cm.scans_differ(before, scan(target), missing_is_change=False)


@query(f"WITH {SRC} SELECT path FROM src WHERE path NOT IN (SELECT path FROM src WHERE NOT starts_with(path, 'de/'))")
def ignored_difference(spark, sf_dir):
    """All sources less the admitted ones."""
    docs = documents(spark, sf_dir).select("path")
    return docs.join(docs.filter(~F.startswith("path", F.lit("de/"))), "path", "left_anti")


@query(f"""WITH {VERSIONS}, r AS (SELECT b.path AS old_path, b.content_hash, b.doc_id FROM base b LEFT JOIN target t USING (path) WHERE t.path IS NULL), a AS (SELECT t.path AS new_path, t.content_hash FROM target t LEFT JOIN base b USING (path) WHERE b.path IS NULL),
 m AS (SELECT old_path, new_path, 100 AS similarity FROM r JOIN a USING (content_hash)),
 u AS (SELECT *, count(*) OVER (PARTITION BY old_path) AS o, count(*) OVER (PARTITION BY new_path) AS n FROM m)
 SELECT old_path, new_path, CAST(similarity AS BIGINT) AS similarity FROM u WHERE o = 1 AND n = 1""")
def rename_pairs_exact(spark, sf_dir):
    """J10 for equal contents: removed and added paths that are each other's only match."""
    base, target = co.two_versions(spark, sf_dir)
    removed, added = base.join(target.select("path"), "path", "left_anti"), target.join(base.select("path"), "path", "left_anti")
    return cm.equal_pairs(removed, added)


SIMILARITY = """ln AS (SELECT v, path, x, count(*) AS n, strlen(x) AS b FROM (
   SELECT 'o' AS v, path, unnest(list_filter(list_concat(list_transform(string_split(text, chr(10))[:-2], lambda l: l || chr(10)), string_split(text, chr(10))[-1:]), lambda l: l <> '')) AS x FROM base
   UNION ALL SELECT 'n', path, unnest(list_filter(list_concat(list_transform(string_split(text, chr(10))[:-2], lambda l: l || chr(10)), string_split(text, chr(10))[-1:]), lambda l: l <> '')) FROM target) GROUP BY v, path, x)"""


@query(f"""WITH {VERSIONS}, {SIMILARITY}, p AS (SELECT b.path, b.size AS os, t.size AS ns, b.content_hash AS oh, t.content_hash AS nh FROM base b JOIN target t USING (path)),
 c AS (SELECT o.path, sum(least(o.n, n.n) * o.b) AS common FROM ln o JOIN ln n ON o.v = 'o' AND n.v = 'n' AND o.path = n.path AND o.x = n.x GROUP BY o.path)
 SELECT p.path AS old_path, p.path AS new_path, CAST(CASE WHEN oh = nh THEN 100 WHEN greatest(os, ns) = 0 OR least(os, ns) / greatest(os, ns) < 0.5 THEN 0 ELSE least(99, floor(100 * coalesce(common, 0) / greatest(os, ns))) END AS BIGINT) AS similarity FROM p LEFT JOIN c USING (path)""")
def line_multiset_similarity(spark, sf_dir):
    """Bytes of common lines of the two versions of each path."""
    base, target = co.two_versions(spark, sf_dir)
    pairs = base.select(F.col("path").alias("old_path")).join(target.select(F.col("path").alias("new_path")), F.col("old_path") == F.col("new_path"))
    return cm.line_similarity(pairs, base, target)


LITERALS = ["license", "All rights", "the", "nowhere to be found"]


@query(f"""WITH {LINES}, q AS (SELECT unnest({LITERALS!r}) AS pattern), m AS (SELECT pattern, path, line_no, row_number() OVER (PARTITION BY pattern ORDER BY path, line_no) AS r FROM lines, q WHERE CASE WHEN pattern = lower(pattern) THEN contains(lower(line), pattern) ELSE contains(line, pattern) END),
 c AS (SELECT pattern, count(*) AS matches, count(DISTINCT path) AS files, array_to_string(list_sort(list(path || ':' || line_no) FILTER (r <= 3)), ',') AS evidence FROM m GROUP BY pattern)
 SELECT pattern, coalesce(matches, 0) AS matches, coalesce(files, 0) AS files, coalesce(evidence, '') AS evidence, CASE WHEN matches > 0 THEN 'present' ELSE 'absent_with_complete_coverage' END AS status FROM q LEFT JOIN c USING (pattern)""")
def audit_receipt(spark, sf_dir):
    """What an audit says of each literal."""
    return cm.audit(co.plain_lines(documents(spark, sf_dir)), LITERALS)


@query(f"WITH {VERSIONS} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, bool_and(coalesce(b.content_hash = t.content_hash, FALSE) AND b.size <= 20000) AS closed, least(sum(CASE WHEN b.size <= 20000 THEN 1 ELSE 0 END), sum(CASE WHEN t.size <= 20000 THEN 1 ELSE 0 END)) AS searched, sum(CASE WHEN b.size > 20000 THEN 1 ELSE 0 END) AS skipped FROM base b LEFT JOIN target t USING (path) GROUP BY 1")
def audit_closure(spark, sf_dir):
    """Whether a folder's scan is complete: the same sources before and after, and none passed over."""
    return cm.closure(*co.two_versions(spark, sf_dir), most_bytes=20_000)


@query("SELECT content_hash, min(doc_id) AS first_id, count(*) AS copies FROM (SELECT doc_id, sha256(text) AS content_hash FROM documents) GROUP BY content_hash")
def content_hash_dedupe(spark, sf_dir):
    """Distinct contents by their hash."""
    d = co.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


#: Entries of an inventory that are hashed together.
INVENTORY_BLOCK = 1_000


@query(f"""WITH {SRC}, h AS (SELECT source, path || '=' || sha256(text) AS e FROM src), n AS (SELECT source, e, (row_number() OVER (PARTITION BY source ORDER BY e) - 1) // {INVENTORY_BLOCK} AS block FROM h),
 b AS (SELECT source, block, sha256(array_to_string(list_sort(list(e)), chr(10))) AS x FROM n GROUP BY source, block) SELECT source, sha256(string_agg(x, chr(10) ORDER BY block)) AS inventory_hash FROM b GROUP BY source""")
def inventory_hash(spark, sf_dir):
    """One hash for each folder's ordered inventory: the hash of its blocks' hashes, in order, so that no row holds a whole inventory."""
    h = documents(spark, sf_dir).select("source", F.concat_ws("=", "path", F.sha2("text", 256)).alias("e"))
    n = rk.numbered_within(h, F.col("source"), ["e"], "place").withColumn("block", F.floor((F.col("place") - 1) / INVENTORY_BLOCK))
    blocks = n.groupBy("source", "block").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("e")), "\n"), 256).alias("x"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("block", "x"))), lambda b: b["x"])
    return blocks.groupBy("source").agg(F.sha2(F.array_join(listed, "\n"), 256).alias("inventory_hash"))


@query("SELECT event_type, count(*) AS queries, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS complete, CASE WHEN count(value) = count(*) THEN round(sum(value), 3) END AS total FROM (SELECT event_type, CASE WHEN event_type = 'click' AND value < 1 THEN NULL ELSE value END AS value FROM events) GROUP BY event_type")
def session_counters(spark, sf_dir):
    """Counters over a log; a total is null if any part is."""
    e = co.table(spark, sf_dir, "events").select("event_type", F.when(~((F.col("event_type") == "click") & (F.col("value") < 1)), F.col("value")).alias("value"))
    return e.groupBy("event_type").agg(F.count("*").alias("queries"), F.sum(F.when(F.col("value") > 50, 1).otherwise(0)).alias("complete"), F.when(F.count("value") == F.count("*"), F.round(F.sum("value"), 3)).alias("total"))


@query("""WITH RECURSIVE d AS (SELECT source, reason, strlen(reason) + 3 AS size, row_number() OVER (PARTITION BY source ORDER BY reason) AS k FROM (SELECT DISTINCT source, substr(string_split(text, chr(10))[1], 1, 200) AS reason FROM documents WHERE lang <> 'de')),
 f AS (SELECT source, reason, k, CASE WHEN size <= 4094 THEN size ELSE 0 END AS used, CASE WHEN size <= 4094 THEN 1 ELSE 0 END AS n, size <= 4094 AS kept FROM d WHERE k = 1
  UNION ALL SELECT d.source, d.reason, d.k, f.used + CASE WHEN f.n < 64 AND f.used + d.size <= 4094 THEN d.size ELSE 0 END, f.n + CASE WHEN f.n < 64 AND f.used + d.size <= 4094 THEN 1 ELSE 0 END, f.n < 64 AND f.used + d.size <= 4094 FROM f JOIN d ON d.source = f.source AND d.k = f.k + 1),
 g AS (SELECT source, coalesce(string_agg(reason, '|' ORDER BY reason) FILTER (kept), '') AS reasons, sum(CASE WHEN kept THEN 0 ELSE 1 END) AS omitted FROM f GROUP BY source),
 u AS (SELECT source, sum(CASE WHEN lang = 'de' THEN 1 ELSE 0 END) AS unsupported, coalesce(array_to_string((list(lpad(CAST(doc_id AS VARCHAR), 12, '0') ORDER BY doc_id) FILTER (lang = 'de'))[1:3], ','), '') AS examples FROM documents GROUP BY source)
 SELECT source, coalesce(reasons, '') AS reasons, coalesce(omitted, 0) AS omitted, unsupported, examples FROM u LEFT JOIN g USING (source)""")
def distinct_reasons(spark, sf_dir):
    """Distinct reasons of each source within 64 and 4 KiB (bounds of the feature), unsupported ones counted (documents' first lines
    stand for reasons, German documents for unsupported ones)."""
    d = co.table(spark, sf_dir, "documents")
    reason = F.substring(F.split("text", "\n", -1)[0], 1, 200)
    return cm.bounded_reasons(d.select("source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"), reason.alias("reason"), (F.col("lang") == "de").alias("unsupported")), "source")


@query("SELECT 'lang-' || lang AS id, count(*) AS revision, min(doc_id) AS first_record FROM documents GROUP BY lang")
def source_list(spark, sf_dir):
    """The configured external sources."""
    return co.table(spark, sf_dir, "documents").groupBy(F.concat(F.lit("lang-"), "lang").alias("id")).agg(F.count("*").alias("revision"), F.min("doc_id").alias("first_record"))


@query("SELECT id, title FROM (SELECT lpad(CAST(item_id AS VARCHAR), 12, '0') AS id, text[1:40] AS title, text FROM benchmark) WHERE contains(lower(title), 'th') OR contains(lower(text), 'th') ORDER BY id LIMIT 5")
def source_search(spark, sf_dir):
    """The first page of records that hold a query (five, the feature's default)."""
    b = co.table(spark, sf_dir, "benchmark").select(F.lpad(F.col("item_id").cast("string"), 12, "0").alias("id"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("content"))
    return co.record_search(b, "th").select("id", "title")


@query("SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN sha256(text) = (SELECT sha256(text) FROM benchmark WHERE item_id = 1) THEN 'current' ELSE 'stale' END AS status, text AS content FROM benchmark WHERE item_id = 1")
def source_read(spark, sf_dir):
    """One record, if it has the revision asked for."""
    b = co.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.sha2("text", 256).alias("revision"), F.col("text").alias("content"))
    revision = b.filter("id = '1'").select("revision").first()
    return co.record_read(b, "1", revision[0] if revision else "")


# --- module facts ---------------------------------------------------------------------------------------------------

#: Script sources made of documents: German ones declare v, English ones re-export the next document's, French ones a file that
#: isn't there, Spanish ones a package's. Documents of src0 have an empty .js beside the .ts; those of src1 are a folder's index.
SCRIPTS = """s AS (SELECT doc_id, lang, source, CASE source WHEN 'src1' THEN 'src/' || doc_id || '/index.ts' ELSE 'src/' || doc_id || '.ts' END AS path, CASE source WHEN 'src1' THEN '../' ELSE './' END AS up FROM documents),
 f AS (SELECT path FROM s UNION ALL SELECT 'src/' || doc_id || '.js' FROM s WHERE source = 'src0' UNION ALL SELECT 'tests/' || doc_id || '.test.ts' FROM s WHERE lang IN ('en', 'es')),
 x AS (SELECT path AS from_path, CASE lang WHEN 'en' THEN up || (doc_id + 1) WHEN 'fr' THEN './gone' ELSE 'react' END AS specifier, lang, doc_id FROM s WHERE lang <> 'de'
  UNION ALL SELECT 'tests/' || doc_id || '.test.ts', '../src/' || doc_id, 'test', doc_id - 1 FROM s WHERE lang = 'en'),
 r AS (SELECT x.from_path, x.specifier, CASE WHEN x.lang IN ('en', 'test') AND t.source <> 'src0' THEN t.path END AS path,
  CASE WHEN x.lang = 'es' THEN 'external-package-or-path-alias-unsupported' WHEN x.lang = 'fr' OR t.path IS NULL THEN 'missing-or-excluded-module' WHEN t.source = 'src0' THEN 'ambiguous-module-candidates' END AS reason
  FROM x LEFT JOIN s t ON t.doc_id = x.doc_id + 1 AND x.lang IN ('en', 'test')),
 e AS (SELECT from_path, 'v' AS from_name, coalesce(path, specifier) AS to_path, 'v' AS to_name FROM r), d AS (SELECT path, 'v' AS name FROM s WHERE lang = 'de')"""


def script_sources(spark, sf_dir):
    """path, text of the sources that SCRIPTS says, each with the document's first line as a comment and an import within a string."""
    d = co.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.substring_index("text", "\n", 1).alias("line"))
    n, index = F.col("doc_id").cast("string"), F.col("source") == "src1"
    path = F.concat(F.lit("src/"), n, F.when(index, "/index.ts").otherwise(".ts"))
    to = F.when(F.col("lang") == "en", F.concat(F.when(index, "../").otherwise("./"), (F.col("doc_id") + 1).cast("string"))).when(F.col("lang") == "fr", "./gone").otherwise("react")
    head = F.concat(F.lit("// import { no } from './no' "), "line", F.lit("\nconst s = \"import './not'\";\n"))
    body = F.when(F.col("lang") == "de", "export function v(a: number) {\n  return call(s);\n}\n").otherwise(F.concat(F.lit("export {\n  v,\n} from '"), to, F.lit("';\n")))
    test = F.when(F.col("lang") == "en", F.concat(F.lit("import { v } from '../src/"), n, F.lit("';\n"))).otherwise("")
    cases = F.concat(test, F.lit('describe("of '), n, F.lit('", () => {\n  it.only("works", () => { v(); });\n  test("twice", f);\n  x.test("not");\n});\n'))
    return (
        d.select(path.alias("path"), F.concat(head, body).alias("text"))
        .unionByName(d.filter("source = 'src0'").select(F.concat(F.lit("src/"), n, F.lit(".js")).alias("path"), F.lit("").alias("text")))
        .unionByName(d.filter("lang in ('en', 'es')").select(F.concat(F.lit("tests/"), n, F.lit(".test.ts")).alias("path"), cases.alias("text")))
    )


@query(f"""WITH {SCRIPTS}, p AS (SELECT path FROM f UNION ALL SELECT doc_id || '.txt' FROM documents), x2 AS (SELECT regexp_extract(path, '\\.[a-z]+$') AS extension FROM p)
 SELECT extension, CASE WHEN extension IN ('.ts', '.js') THEN 'script' ELSE 'none' END AS language, CASE WHEN extension IN ('.ts', '.js') THEN 'outline,roles,imports,tests,structure' ELSE '' END AS capabilities, count(*) AS files FROM x2 GROUP BY extension""")
def capability_inventory(spark, sf_dir):
    """Files by extension, with their language and what can be said of it (scripts made of documents, and documents)."""
    return cm.capabilities(script_sources(spark, sf_dir).select("path").unionByName(documents(spark, sf_dir).select("path")))


@query(f"WITH {SCRIPTS} SELECT from_path, kind, specifier, imported, local FROM (SELECT from_path, CASE WHEN lang = 'test' THEN 'import' ELSE 're-export' END AS kind, specifier, 'v' AS imported, 'v' AS local FROM x UNION ALL SELECT path, 'export', '', 'v', 'v' FROM s WHERE lang = 'de')")
def module_facts(spark, sf_dir):
    """Imports, exports and re-exports of script sources; comments and strings have none."""
    s = script_sources(spark, sf_dir)
    return s.select(F.col("path").alias("from_path"), F.inline(md.facts(F.col("path"), F.col("text")))).select("from_path", "kind", "specifier", "imported", "local")


@query(f"""WITH RECURSIVE {SCRIPTS},
 w AS (SELECT from_path AS start_path, from_name AS start_name, from_path AS path, from_name AS name, 0 AS hops, [from_path || ':' || from_name] AS seen, FALSE AS cycle FROM e
  UNION ALL SELECT w.start_path, w.start_name, e.to_path, e.to_name, hops + 1, list_append(seen, e.to_path || ':' || e.to_name), list_contains(seen, e.to_path || ':' || e.to_name) FROM w JOIN e ON w.path = e.from_path AND w.name = e.from_name WHERE hops < 8 AND NOT cycle),
 l AS (SELECT *, row_number() OVER (PARTITION BY start_path, start_name ORDER BY hops DESC) AS r FROM w)
 SELECT start_path, start_name, path AS end_path, hops, CASE WHEN cycle THEN 'circular-re-export' WHEN EXISTS (SELECT 1 FROM d WHERE d.path = l.path AND d.name = l.name) THEN 'resolved' WHEN EXISTS (SELECT 1 FROM e WHERE e.from_path = l.path AND e.from_name = l.name) THEN 'hop-budget-exhausted' ELSE 'missing-or-excluded-module' END AS status FROM l WHERE r = 1""")
def import_trace(spark, sf_dir):
    """Traces along the import edges of script sources, eight hops at most, cycles and missing ends told apart."""
    edges, declared, _ = gr.module_edges(script_sources(spark, sf_dir))
    return gr.traced(edges, declared)


@query(f"WITH {SCRIPTS} SELECT from_path, specifier, path, reason FROM r")
def module_candidates(spark, sf_dir):
    """The candidate files of module specifiers; exactly one existing file resolves."""
    return gr.module_edges(script_sources(spark, sf_dir))[2]


@query(f"""WITH RECURSIVE {SCRIPTS}, direct AS (SELECT DISTINCT from_path AS test_path, path FROM r WHERE path IS NOT NULL AND starts_with(from_path, 'tests/')),
 w AS (SELECT from_path AS test_path, to_path AS path, to_name AS name, 1 AS hops, [from_path || ':' || from_name, to_path || ':' || to_name] AS seen, FALSE AS cycle FROM e WHERE starts_with(from_path, 'tests/')
  UNION ALL SELECT w.test_path, e.to_path, e.to_name, hops + 1, list_append(seen, e.to_path || ':' || e.to_name), list_contains(seen, e.to_path || ':' || e.to_name) FROM w JOIN e ON w.path = e.from_path AND w.name = e.from_name WHERE hops < 8 AND NOT cycle),
 l AS (SELECT *, row_number() OVER (PARTITION BY test_path ORDER BY hops DESC) AS back FROM w),
 found AS (SELECT test_path FROM l WHERE back = 1 AND NOT cycle AND EXISTS (SELECT 1 FROM d WHERE d.path = l.path AND d.name = l.name)),
 t AS (SELECT doc_id, 'tests/' || doc_id || '.test.ts' AS test_path FROM s WHERE lang IN ('en', 'es')), o AS (SELECT path, CASE WHEN source = 'src1' THEN 'index' ELSE CAST(doc_id AS VARCHAR) END AS stem FROM s UNION ALL SELECT 'src/' || doc_id || '.js', CAST(doc_id AS VARCHAR) FROM s WHERE source = 'src0'),
 every AS (SELECT test_path, path, 0 AS k FROM direct UNION ALL SELECT test_path, path, 1 FROM w SEMI JOIN found USING (test_path) WHERE hops > 1 UNION ALL SELECT test_path, path, 2 FROM t JOIN o ON contains(CAST(t.doc_id AS VARCHAR), o.stem))
 SELECT test_path, path, ['direct', 'indirect', 'weak'][min(k) + 1] AS relation FROM every GROUP BY test_path, path""")
def test_relation(spark, sf_dir):
    """Which tests are of which files: by import, by an imported name's way through re-exports, or by name or text only."""
    s = script_sources(spark, sf_dir)
    return gr.test_relations(s, *gr.module_edges(s))


@query("SELECT 'tests/' || doc_id || '.test.ts' AS path, kind, name, line + CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS line FROM documents, (VALUES ('describe', 1), ('test', 2), ('test', 3)) t(kind, line), LATERAL (SELECT CASE line WHEN 1 THEN 'of ' || doc_id WHEN 2 THEN 'works' ELSE 'twice' END AS name) WHERE lang IN ('en', 'es')")
def test_recognizer(spark, sf_dir):
    """The test cases of test files."""
    s = script_sources(spark, sf_dir).filter(F.col("path").rlike(md.TEST_PATH))
    return s.select("path", F.inline(md.tests(F.col("path"), F.col("text")))).select("path", "kind", "name", "line")


@query(f"WITH {SCRIPTS} SELECT path, 'v' AS name, 'function' AS kind, 3 AS start_line, 5 AS end_line, '' AS scope FROM s WHERE lang = 'de'")
def script_outline(spark, sf_dir):
    """Declarations of script sources, lexically."""
    s = script_sources(spark, sf_dir).filter(F.startswith("path", F.lit("src/")))
    return s.select("path", F.inline(md.outline(F.col("path"), F.col("text"))))


@query(f"WITH {SCRIPTS} SELECT path, role, n FROM s, (VALUES ('comment', 1, 1, 1), ('string', 1, 2, 2), ('import', 0, 1, 1), ('declaration', 2, 1, 1), ('call', 1, 0, 0)) t(role, a, b, n0), LATERAL (SELECT CASE WHEN lang = 'de' THEN a ELSE b END AS n) WHERE n > 0")
def script_roles(spark, sf_dir):
    """Lexical roles of script sources, counted for each file."""
    s = script_sources(spark, sf_dir).filter(F.startswith("path", F.lit("src/")))
    return s.select("path", F.inline(md.roles(F.col("path"), F.col("text")))).filter("role != 'code'").groupBy("path", "role").agg(F.count("*").alias("n"))
