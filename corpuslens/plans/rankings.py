"""Queries over relevance, vectors, lanes, pages and budgets, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as tx
from corpuslens.operators import intervals as iv
from corpuslens.operators import ranking as rk
from corpuslens.plans.scans import LINES, SRC, documents
from corpuslens.sources import corpus as co
from corpuslens.sources.shared import written

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


QUERY_TERMS = ["the", "tion", "ander", "license", "mit", "token"]
STOPS = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
TOKENS = rf"""toks AS (SELECT path, list_filter(regexp_extract_all(lower(regexp_replace(text, '([a-z\d])([A-Z])', '\1 \2', 'g')), '[\p{{L}}\p{{N}}_]+'), lambda w: w NOT IN ({STOPS})) AS tokens FROM src)"""
BM25 = (
    TOKENS
    + ", stat AS (SELECT count(*) AS n, greatest(1.0, sum(len(tokens)) / greatest(1, count(*))) AS average FROM toks)"
    + f", q AS (SELECT unnest([{', '.join(repr(t) for t in QUERY_TERMS if t not in tx.STOP_WORDS)}]) AS term)"
    + """, tf AS (SELECT path, term, len(tokens) AS length, len(list_filter(tokens, lambda w: w = term)) AS tf FROM toks, q),
 dfs AS (SELECT term, sum(CASE WHEN tf > 0 THEN 1 ELSE 0 END) AS df FROM tf GROUP BY term),
 bm AS (SELECT path, sum(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average)) ELSE 0 END) AS bm25 FROM tf JOIN dfs USING (term), stat GROUP BY path)"""
)


def terms() -> list[str]:
    return [t for t in QUERY_TERMS if t not in tx.STOP_WORDS]


# --- lexical and fused rankings -------------------------------------------------------------------------------------


@query(f"WITH {SRC}, {TOKENS} SELECT path, len(tokens) AS n_tokens, array_to_string(tokens[1:5], ' ') AS first_tokens FROM toks")
def retrieval_tokens(spark, sf_dir):
    """Tokens for retrieval."""
    return documents(spark, sf_dir).select("path", tx.retrieval_tokens(F.col("text")).alias("t")).select("path", F.size("t").cast("long").alias("n_tokens"), F.array_join(F.slice("t", 1, 5), " ").alias("first_tokens"))


@query(f"WITH {SRC}, {BM25} SELECT path, round(bm25, 6) AS bm25 FROM bm")
def bm25_documents(spark, sf_dir):
    """BM25 of every document for one query."""
    return rk.bm25(documents(spark, sf_dir), terms()).select("path", F.round("bm25", 6).alias("bm25"))


BEST_DOCUMENTS = rf"""WITH {SRC}, {TOKENS}, stat AS (SELECT count(*) AS n, greatest(1.0, sum(len(tokens)) / greatest(1, count(*))) AS average FROM toks),
 b AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: w NOT IN ({STOPS})))) AS term FROM benchmark),
 post AS (SELECT path, term, count(*) AS tf FROM (SELECT path, unnest(tokens) AS term FROM toks) WHERE term IN (SELECT term FROM b) GROUP BY path, term),
 dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term), lens AS (SELECT path, len(tokens) AS length FROM toks),
 s AS (SELECT item_id, path, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))) AS bm25 FROM b JOIN post USING (term) JOIN dfs USING (term) JOIN lens USING (path), stat GROUP BY item_id, path),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 6) DESC, path) AS rank FROM s)
 SELECT item_id, rank, path, round(bm25, 6) AS bm25 FROM r WHERE rank <= 3"""


def passages_asked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All documents' tokens, and all words of every benchmark passage as a query."""
    docs = documents(spark, sf_dir).select("path", tx.retrieval_tokens(F.col("text")).alias("tokens"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    stops = F.array(*map(F.lit, tx.STOP_WORDS))
    return docs, co.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(F.filter(words, lambda w: ~F.array_contains(stops, w)))).alias("term"))


@query(BEST_DOCUMENTS)
def bm25_benchmark_terms(spark, sf_dir):
    """A5, X8 for many queries at once: the three best documents for all words of every benchmark passage."""
    scores = rk.bm25_joined(*passages_asked(spark, sf_dir)).withColumn("bm25", F.round("bm25", 6))
    top = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bm25"), "path"))).filter("rank <= 3")
    return top.select(F.col("query").alias("item_id"), F.col("rank").cast("long").alias("rank"), "path", "bm25")


@query(BEST_DOCUMENTS)
def bm25_best_by_bounds(spark, sf_dir):
    """The same rows, by bounds of posting blocks: documents that can't be among the best aren't scored."""
    return rk.bm25_best(*passages_asked(spark, sf_dir), 3).select(F.col("query").alias("item_id"), "rank", "path", "bm25")


def candidates(spark, sf_dir) -> DataFrame:
    """Documents with two scores: the density of a frequent string stands for the semantic one, as no text encoder is at hand."""
    docs = documents(spark, sf_dir)
    density = F.round((F.size(F.split("text", "th", -1)) - 1) / F.greatest(F.lit(1), F.length("text")), 9)
    scored = rk.bm25(docs, terms()).select("path", F.round("bm25", 9).alias("bm25"))
    semantic = docs.select("path", density.alias("ranking_score"), F.contains("text", F.lit("License")).cast("int").alias("declaration"))
    return semantic.join(scored, "path").withColumn("line_no", F.lit(1))


CANDIDATES = (
    BM25
    + """, cand AS (SELECT s.path, round((len(string_split(text, 'th')) - 1) / greatest(1, length(text)), 9) AS ranking_score, CAST(contains(text, 'License') AS INT) AS declaration, round(bm25, 9) AS bm25 FROM src s JOIN bm USING (path)),
 sem AS (SELECT *, row_number() OVER (ORDER BY ranking_score DESC, path) AS semantic_rank FROM cand),
 lex AS (SELECT path, row_number() OVER (ORDER BY bm25 DESC, path) AS lexical_rank FROM cand WHERE bm25 > 0),
 rrf AS (SELECT sem.*, lexical_rank, 2 / (60 + semantic_rank) + coalesce(1 / (60 + lexical_rank), 0) AS relevance_score FROM sem LEFT JOIN lex USING (path)),
 fused AS (SELECT *, row_number() OVER (ORDER BY declaration DESC, relevance_score DESC, path) AS rank FROM rrf)"""
)


@query(f"WITH {SRC}, {CANDIDATES} SELECT rank, path, declaration, semantic_rank, lexical_rank, round(relevance_score, 9) AS relevance_score FROM fused")
def rrf_fusion(spark, sf_dir):
    """Semantic and lexical ranks of all documents, fused."""
    out = rk.fused(candidates(spark, sf_dir))
    return out.select("rank", "path", "declaration", "semantic_rank", "lexical_rank", F.round("relevance_score", 9).alias("relevance_score"))


#: Rows that a lane hands to the fusion: a page of the feature.
LANE_ROWS = 50


def lanes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = candidates(spark, sf_dir)
    c = written(c, "candidates")  # computed once for both lanes
    native = rk.ranked(c, [F.desc("ranking_score"), "path"], "rank", LANE_ROWS)
    current = rk.ranked(c.filter("bm25 > 0"), [F.desc("bm25"), "path"], "rank", LANE_ROWS)
    return current.select("path", "rank"), native.select("path", "rank")


LANES = """cur AS (SELECT path, lexical_rank AS rank FROM lex WHERE lexical_rank <= 50), nat AS (SELECT path, semantic_rank AS rank FROM sem WHERE semantic_rank <= 50)"""


@query(f"""WITH {SRC}, {CANDIDATES}, {LANES}, c AS (SELECT path, rank AS c_rank FROM cur WHERE rank <= 10), n AS (SELECT path, rank AS n_rank FROM nat WHERE rank <= 10),
 b AS (SELECT path, c_rank, n_rank, coalesce(1 / n_rank, 0) + coalesce(0.1 / c_rank, 0) AS score FROM c FULL JOIN n USING (path)),
 r AS (SELECT *, row_number() OVER (ORDER BY score DESC, n_rank NULLS LAST, c_rank NULLS LAST) AS rank FROM b) SELECT path, c_rank, n_rank, round(score, 9) AS score, rank FROM r WHERE rank <= 10""")
def lane_fusion(spark, sf_dir):
    """The first files of two lanes, fused."""
    return rk.lanes_fused(*lanes(spark, sf_dir)).select("path", "c_rank", "n_rank", F.round("score", 9).alias("score"), "rank")


@query(f"""WITH {SRC}, {CANDIDATES}, {LANES}, u AS (SELECT path, rank AS lane_rank, 'current' AS lane FROM cur UNION ALL SELECT path, rank, 'native' FROM nat)
 SELECT path, lane_rank, lane, row_number() OVER (ORDER BY lane_rank, lane) AS rank FROM u""")
def lane_interleave(spark, sf_dir):
    """Both lanes in turn."""
    return rk.lanes_interleaved(*lanes(spark, sf_dir)).select("path", "lane_rank", "lane", "rank")


@query(f"""WITH {LINES}, t AS (SELECT path, line_no, CASE WHEN contains(line, 'License') THEN 0 WHEN contains(line, 'reserved') THEN 1 ELSE 2 END AS tier FROM lines WHERE contains(line, 'License') OR contains(line, 'reserved') OR contains(line, 'worthless'))
 SELECT path, line_no, tier, row_number() OVER (PARTITION BY tier, path ORDER BY line_no) AS depth FROM t""")
def evidence_round_robin(spark, sf_dir):
    """Tiers of evidence, one line of each file before a second."""
    rows = co.plain_lines(documents(spark, sf_dir).filter(F.col("text").rlike("License|reserved|worthless"))).filter(F.col("line").rlike("License|reserved|worthless"))
    tier = F.when(F.contains("line", F.lit("License")), 0).when(F.contains("line", F.lit("reserved")), 1).otherwise(2)
    return rk.round_robin(rows.withColumn("tier", tier), "tier", ["line_no"]).select("path", "line_no", "tier", F.col("depth").cast("long").alias("depth"))


# --- vectors --------------------------------------------------------------------------------------------------------

DOT = "round(list_sum(list_transform(list_zip(e.embedding, q.v), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 6)"
Q0 = "q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


def scored_vectors(spark, sf_dir) -> DataFrame:
    """vec_id, label, score: all vectors against the query vector (that of the smallest id), a broadcast row."""
    e = co.table(spark, sf_dir, "embeddings")
    q = e.groupBy().agg(F.min_by("embedding", "vec_id").alias("v"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", "label", F.round(tx.cosine(F.col("embedding"), F.col("v")), 6).alias("score"))


@query(f"WITH {Q0}, s AS (SELECT vec_id, {DOT} AS score FROM embeddings e, q) SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk(spark, sf_dir):
    """The ten nearest vectors (a top-k)."""
    return scored_vectors(spark, sf_dir).select("vec_id", "score").orderBy(F.desc("score"), "vec_id").limit(10)


@query(f"WITH {Q0}, s AS (SELECT label, {DOT} AS score FROM embeddings e, q) SELECT label, max(score) AS score, count(*) AS windows FROM s GROUP BY label")
def cosine_label_maxpool(spark, sf_dir):
    """The best score of each group of windows."""
    return scored_vectors(spark, sf_dir).groupBy("label").agg(F.max("score").alias("score"), F.count("*").alias("windows"))


@query(f"WITH {Q0}, s AS (SELECT {DOT} AS score FROM embeddings e, q), t AS (SELECT list(score ORDER BY score DESC)[1:2] AS t FROM s) SELECT count(*) AS count, max(score) AS top, any_value(t.t[2]) AS second, round(max(score) - any_value(t.t[2]), 6) AS top_margin, round(quantile_cont(score, 0.5), 6) AS median, min(score) AS min, round(max(score) - min(score), 6) AS spread FROM s, t")
def score_profile(spark, sf_dir):
    """The profile of a column of scores."""
    p = rk.score_profile(scored_vectors(spark, sf_dir), "score")
    return p.select("count", "top", "second", F.round("top_margin", 6).alias("top_margin"), F.round("median", 6).alias("median"), "min", F.round("spread", 6).alias("spread"))


@query("WITH m AS (SELECT unnest(range(1, 65)) AS i, unnest(embedding) AS x, label FROM embeddings), a AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM m GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM a GROUP BY label) SELECT a.label, CAST(i AS INT) AS i, round(x / n, 6) AS x FROM a JOIN n USING (label)")
def mean_pooled_labels(spark, sf_dir):
    """Mean of each label's vectors, brought to unit length again."""
    e = co.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    mean = e.groupBy("label", "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    norm = mean.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return mean.join(norm, "label").select("label", (F.col("p") + 1).alias("i"), F.round(F.col("x") / F.col("n"), 6).alias("x"))


@query(f"WITH {Q0}, s AS (SELECT vec_id, label, {DOT} AS cosine FROM embeddings e, q) SELECT vec_id, cosine, round(cosine - 0.02 * (1 - sqrt(least(label * 100 / 500.0, 1))), 9) AS ranking_score FROM s")
def concept_ranking(spark, sf_dir):
    """Cosine with the length correction (a hundred units of length for each label step stand for passages)."""
    s = scored_vectors(spark, sf_dir)
    return s.select("vec_id", F.col("score").alias("cosine"), F.round(tx.concept_ranking_score(F.col("score"), F.col("label") * 100), 9).alias("ranking_score"))


# --- overlap, hybrid, judge -----------------------------------------------------------------------------------------

PASSAGES = "pas AS (SELECT path, k AS passage_no, k * 840 AS s, least(length(text), k * 840 + 1000) AS e, (len(string_split(substr(text, CAST(1 + k * 840 AS BIGINT), 1000), 'th')) - 1) AS hits FROM (SELECT path, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 160) / 840.0) AS BIGINT)))) AS k FROM src))"


def passages(docs: DataFrame) -> DataFrame:
    """path, passage_no, start, end, hits: fixed passages with the count of a frequent string."""
    last = (F.greatest(F.lit(1), F.ceil((F.length("text") - 160) / F.lit(840.0))) - 1).cast("long")
    k = docs.select("path", "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("passage_no"))
    start = F.col("passage_no") * 840
    body = F.substring("text", (start + 1).cast("int"), F.lit(1000))
    return k.select("path", "passage_no", start.alias("start"), F.least(F.length("text").cast("long"), start + 1000).alias("end"), (F.size(F.split(body, "th", -1)) - 1).alias("hits"))


@query()
def distinct_passages(spark, sf_dir):
    """Passages of each file by rank, those that overlap a better kept one left out. Sequential, so tests compare it with a loop."""
    p = passages(documents(spark, sf_dir)).withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("hits"), "start")).cast("long"))
    return iv.kept_greedily(p, "path", "rank")


LITERAL_RANGES = """lit AS (SELECT path, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + 7 * (k - 1) AS BIGINT) AS s, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + 7 * k AS BIGINT) AS e
 FROM (SELECT path, p, unnest(range(1, len(p))) AS k FROM (SELECT path, string_split(text, 'License') AS p FROM src WHERE contains(text, 'License'))))"""


def literal_ranges(docs: DataFrame, literal: str) -> DataFrame:
    """path, start, end (code points) of every occurrence of a literal."""
    found = tx.occurrences(F.col("text"), tx.escaped(literal), F.length, ("start", "end"))
    return docs.filter(F.contains("text", F.lit(literal))).select("path", F.inline(found))


@query(f"WITH {SRC}, {PASSAGES}, {LITERAL_RANGES} SELECT path, passage_no FROM pas p WHERE NOT EXISTS (SELECT 1 FROM lit l WHERE l.path = p.path AND l.s < p.e AND p.s < l.e)")
def concept_overlap_antijoin(spark, sf_dir):
    """Passages that overlap no literal range of their file, whichever occurrence it is."""
    docs = documents(spark, sf_dir)
    literal = literal_ranges(docs, "License")
    return iv.without_overlap(passages(docs), literal, "path").select("path", "passage_no")


@query(f"""WITH {SRC}, {PASSAGES}, {LITERAL_RANGES}, free AS (SELECT path, passage_no, hits FROM pas p WHERE NOT EXISTS (SELECT 1 FROM lit l WHERE l.path = p.path AND l.s < p.e AND p.s < l.e)),
 top AS (SELECT * FROM free ORDER BY hits DESC, path, passage_no LIMIT 3)
 SELECT 'literal' AS evidence_source, path, CAST(s AS BIGINT) AS at FROM lit UNION ALL SELECT 'concept', path, CAST(passage_no AS BIGINT) FROM top""")
def hybrid_exact_first(spark, sf_dir):
    """All literal hits, then the best concept passages that overlap none (three, a limit of the feature)."""
    docs = documents(spark, sf_dir)
    literal = literal_ranges(docs, "License")
    concept = iv.without_overlap(passages(docs), literal, "path").orderBy(F.desc("hits"), "path", "passage_no").limit(3)
    return literal.select(F.lit("literal").alias("evidence_source"), "path", F.col("start").alias("at")).unionByName(concept.select(F.lit("concept").alias("evidence_source"), "path", F.col("passage_no").alias("at")))


@query("""WITH top AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS slot FROM documents QUALIFY slot <= 20),
 j AS (SELECT slot, doc_id, CASE WHEN quality IS NULL THEN NULL WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 0 ELSE 1 END AS priority FROM top LEFT JOIN labels USING (doc_id)),
 o AS (SELECT slot, row_number() OVER (ORDER BY priority, slot) AS k FROM j WHERE priority IS NOT NULL), p AS (SELECT slot AS new_slot, row_number() OVER (ORDER BY slot) AS k FROM j WHERE priority IS NOT NULL)
 SELECT j.slot, doc_id, priority, coalesce(new_slot, j.slot) AS new_slot FROM j LEFT JOIN o ON o.slot = j.slot LEFT JOIN p ON p.k = o.k""")
def judge_reorder(spark, sf_dir):
    """Of the first twenty candidates the judged ones change places, by priority; unjudged ones keep theirs."""
    top = rk.ranked(co.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], "slot", 20)
    labels = co.table(spark, sf_dir, "labels")
    priority = F.when(F.col("quality").isNull(), None).when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    j = labels.join(F.broadcast(top), "doc_id", "right").select("slot", "doc_id", priority.alias("priority"), F.lit(1.0).alias("probability"))  # twenty rows
    return rk.judged_order(j).select("slot", "doc_id", "priority", "new_slot")


@query("SELECT CASE WHEN toxic = 1 THEN 'irrelevant' WHEN quality = 1 THEN 'implementation' ELSE 'uncertain' END AS classification, count(*) AS n FROM labels GROUP BY 1")
def classification_counts(spark, sf_dir):
    """Judged classes."""
    c = F.when(F.col("toxic") == 1, "irrelevant").when(F.col("quality") == 1, "implementation").otherwise("uncertain")
    return co.table(spark, sf_dir, "labels").groupBy(c.alias("classification")).agg(F.count("*").alias("n"))


@query(f"WITH {Q0}, s AS (SELECT {DOT} AS score FROM embeddings e, q), t AS (SELECT score FROM s ORDER BY score DESC LIMIT 2) SELECT round(max(score) - min(score), 6) AS margin, max(score) - min(score) < 0.01 AS close FROM t")
def close_ranking(spark, sf_dir):
    """Whether the first two scores are closer than 0.01."""
    t = scored_vectors(spark, sf_dir).select("score").orderBy(F.desc("score")).limit(2)
    d = F.max("score") - F.min("score")
    return t.agg(F.round(d, 6).alias("margin"), (d < 0.01).alias("close"))


# --- summaries, pages, budgets --------------------------------------------------------------------------------------


@query(f"WITH {LINES} SELECT path, count(*) AS matches FROM lines WHERE contains(line, 'the') GROUP BY path ORDER BY matches DESC, path LIMIT 30")
def summary_by_file(spark, sf_dir):
    """A1, L1: matching lines for each file, the largest thirty (a page). Counted within the row; the whole set is never exploded."""
    docs = documents(spark, sf_dir).filter(F.contains("text", F.lit("the")))
    n = F.size(F.filter(F.split("text", "\n", -1), lambda x: F.contains(x, F.lit("the")))).cast("long")
    return docs.select("path", n.alias("matches")).orderBy(F.desc("matches"), "path").limit(30)


@query(f"""WITH {LINES}, m AS (SELECT path, count(*) AS n FROM lines WHERE contains(line, 'the') GROUP BY path),
 k AS (SELECT 'extension' AS kind, '.txt' AS key, n FROM m UNION ALL SELECT 'directory', regexp_extract(path, '^(.*)/[^/]*$', 1), n FROM m UNION ALL SELECT 'file', path, n FROM m),
 g AS (SELECT kind, key, CAST(sum(n) AS BIGINT) AS matches, row_number() OVER (PARTITION BY kind ORDER BY sum(n) DESC, key) AS r, count(*) OVER (PARTITION BY kind) AS c FROM k GROUP BY kind, key)
 SELECT kind, key, matches, greatest(0, c - CASE WHEN kind = 'file' THEN 8 ELSE 5 END) AS omitted FROM g WHERE r <= CASE WHEN kind = 'file' THEN 8 ELSE 5 END""")
def statistics_groups(spark, sf_dir):
    """A3: the largest extensions, directories and files, with how many are left out."""
    from corpuslens.operators import compare as cm

    docs = documents(spark, sf_dir).filter(F.contains("text", F.lit("the")))
    n = F.size(F.filter(F.split("text", "\n", -1), lambda x: F.contains(x, F.lit("the")))).cast("long")
    return cm.statistics(docs.select("path", n.alias("n")))


@query(f"WITH {LINES}, m AS (SELECT path, line_no FROM lines WHERE contains(line, 'License')) SELECT path, line_no FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS r FROM m) WHERE r = 1")
def first_match_per_file(spark, sf_dir):
    """The first match of each file."""
    m = co.matching_lines(documents(spark, sf_dir), "License", literal=True)
    return m.groupBy("path").agg(F.min("line_no").alias("line_no"))


@query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) SELECT o_orderkey, rn FROM o WHERE rn > 100 AND rn <= 200")
def page_slice(spark, sf_dir):
    """The second page of a hundred rows (a page of the feature)."""
    top = rk.ranked(co.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], "rn", 200)
    return top.filter("rn > 100").select("o_orderkey", "rn")


@query("""WITH s AS (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS so_far FROM documents) SELECT source, count(*) AS kept, CAST(max(so_far) AS BIGINT) AS chars FROM s WHERE so_far <= 50000 GROUP BY source""")
def budget_prefix_stop(spark, sf_dir):
    """W9, stop rule: rows of each source while their running size fits the budget."""
    d = co.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return rk.numbered_within(d, F.col("source"), ["doc_id"], "so_far", "n_chars").filter("so_far <= 50000").groupBy("source").agg(F.count("*").alias("kept"), F.max("so_far").alias("chars"))


@query("SELECT doc_id, CAST(ceil(row_number() OVER (PARTITION BY source ORDER BY doc_id) / 8.0) AS BIGINT) AS batch, source FROM documents")
def judge_batches(spark, sf_dir):
    """Batches of eight candidates."""
    d = rk.numbered_within(co.table(spark, sf_dir, "documents").select("doc_id", "source"), F.col("source"), ["doc_id"], "rn")
    return d.select("doc_id", F.ceil(F.col("rn") / 8.0).cast("long").alias("batch"), "source")


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
 f AS (SELECT source, doc_id, k, CASE WHEN n_chars <= 50000 THEN n_chars ELSE 0 END AS used, n_chars <= 50000 AS kept FROM d WHERE k = 1
  UNION ALL SELECT d.source, d.doc_id, d.k, f.used + CASE WHEN f.used + d.n_chars <= 50000 THEN d.n_chars ELSE 0 END, f.used + d.n_chars <= 50000 FROM f JOIN d ON d.source = f.source AND d.k = f.k + 1)
 SELECT source, doc_id FROM f WHERE kept""")
def budget_skip(spark, sf_dir):
    """W9, skip rule: rows of each source that fit what is left of the budget; one that doesn't fit is passed over."""
    d = co.table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return rk.budget_skipping(d, "source", ["doc_id"], "n_chars", 50_000).select("source", "doc_id")


@query("""WITH f AS (SELECT lang, source, min(doc_id) AS first_id, count(*) * 40 AS metadata FROM documents GROUP BY lang, source),
 s AS (SELECT lang, source, sum(metadata) OVER (PARTITION BY lang ORDER BY first_id, source ROWS UNBOUNDED PRECEDING) AS so_far FROM f) SELECT d.lang, d.source, d.doc_id FROM documents d JOIN s USING (lang, source) WHERE so_far <= 200 * 40""")
def budget_latch(spark, sf_dir):
    """W9, latch rule: once a folder's entries fill the metadata share of their language, no further folder is begun."""
    d = co.table(spark, sf_dir, "documents").select("lang", "source", "doc_id")
    folders = d.groupBy("lang", "source").agg(F.min("doc_id").alias("first_id"), (F.count("*") * 40).alias("metadata"))
    open_ = rk.numbered_within(folders, F.col("lang"), ["first_id", "source"], "so_far", "metadata").filter(F.col("so_far") <= 200 * 40)
    return d.join(open_.select("lang", "source"), ["lang", "source"], "left_semi")


@query(f"WITH {Q0}, s AS (SELECT vec_id, {DOT} AS score FROM embeddings e, q) SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 300")
def candidate_retention(spark, sf_dir):
    """The candidates that a concept search retains, by score (three hundred here, a limit of the feature)."""
    return scored_vectors(spark, sf_dir).select("vec_id", "score").orderBy(F.desc("score"), "vec_id").limit(300)


@query(f"""WITH {SRC}, {PASSAGES}, {LITERAL_RANGES}, free AS (SELECT path, passage_no, hits FROM pas p WHERE NOT EXISTS (SELECT 1 FROM lit l WHERE l.path = p.path AND l.s < p.e AND p.s < l.e)),
 l3 AS (SELECT 'literal' AS evidence_source, path, s AS at FROM lit ORDER BY path, s LIMIT 3), c AS (SELECT 'concept' AS evidence_source, path, CAST(passage_no AS BIGINT) AS at FROM free ORDER BY hits DESC, path, passage_no LIMIT 27)
 SELECT * FROM l3 UNION ALL SELECT * FROM c""")
def hybrid_preview(spark, sf_dir):
    """The first three literal hits and the best concept passages, thirty rows at most (limits of the feature)."""
    docs = documents(spark, sf_dir)
    literal = literal_ranges(docs, "License")
    concept = iv.without_overlap(passages(docs), literal, "path").orderBy(F.desc("hits"), "path", "passage_no").limit(27)
    first = literal.orderBy("path", "start").limit(3)
    return first.select(F.lit("literal").alias("evidence_source"), "path", F.col("start").alias("at")).unionByName(concept.select(F.lit("concept").alias("evidence_source"), "path", F.col("passage_no").alias("at")))


@query(f"""WITH {SRC}, p AS (SELECT path, string_split(text, 'the') AS a FROM src WHERE contains(text, 'the')), q AS (SELECT path, string_split(text, 'the ') AS a FROM src WHERE contains(text, 'the ')),
 o AS (SELECT path, strlen(array_to_string(a[1:k], 'the')) AS byte_start FROM (SELECT path, a, unnest(range(1, len(a))) AS k FROM p) UNION SELECT path, strlen(array_to_string(a[1:k], 'the ')) FROM (SELECT path, a, unnest(range(1, len(a))) AS k FROM q))
 SELECT path, count(*) AS starts FROM o GROUP BY path""")
def occurrence_dedupe(spark, sf_dir):
    """Places that two patterns both find count once. Deduplicated within a document's row, so nothing is shuffled."""
    docs = documents(spark, sf_dir).filter(F.contains("text", F.lit("the")))
    starts = lambda p: F.transform(tx.occurrences(F.col("text"), tx.escaped(p)), lambda o: o["byte_start"])
    return docs.select("path", F.size(F.array_union(starts("the"), starts("the "))).cast("long").alias("starts"))


@query("""WITH d AS (SELECT source, doc_id, strlen(text) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS so_far FROM documents)
 SELECT source, doc_id, k AS place, CAST(so_far AS BIGINT) AS bytes_so_far, CASE WHEN k > 40 THEN 'file-budget' WHEN so_far > 200000 THEN 'byte-budget' ELSE 'read' END AS status FROM d""")
def read_ledger(spark, sf_dir):
    """The ledger of a reader's budgets: files in order, bytes so far, and which are left unread for which budget."""
    d = co.table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("size"))
    placed = rk.numbered_within(d, F.col("source"), ["doc_id"], "place")
    summed = rk.numbered_within(placed, F.col("source"), ["doc_id"], "bytes_so_far", "size")
    status = F.when(F.col("place") > 40, "file-budget").when(F.col("bytes_so_far") > 200_000, "byte-budget").otherwise("read")
    return summed.select("source", "doc_id", "place", "bytes_so_far", status.alias("status"))
