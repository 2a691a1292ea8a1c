"""Corpora as DataFrames: tables bound as sources, files read as sources, versions, the embedding cache, external records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.functions import modules as md
from corpuslens.functions import text as tx

#: Extensions of the media inventory.
MEDIA = {"image": [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff", ".heic", ".webp"], "pdf": [".pdf"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as sources: path, text, lang, source, doc_id."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text", "lang", "source", "doc_id")


def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as sources: the url without its scheme, query and fragment is the path."""
    return table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "").alias("path"), F.col("html").alias("text"), "page_id", "url")


def conversation_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), "text", "role")


def file_sources(spark: SparkSession, root: str, glob: str | None = None, max_bytes: int = 5 << 20) -> DataFrame:
    """Files under root: path relative to it, text (null unless UTF-8 text of at most max_bytes), status, size, mtime, content_hash.

    status: ok, empty (blank), binary (a NUL byte), unavailable (not UTF-8, or a UTF-16 mark), too-large.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root)
    content = F.when(F.col("length") <= max_bytes, F.col("content"))
    text = content.cast("string")
    status = (
        F.when(F.col("length") > max_bytes, "too-large")
        .when(F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF"), "unavailable")
        .when(F.contains(text, F.lit("\0")), "binary")
        .when(~F.is_valid_utf8(text), "unavailable")
        .when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", "empty")
        .otherwise("ok")
    )
    base = F.lit(spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/")
    relative = F.regexp_replace(F.col("path"), r"^[A-Za-z][A-Za-z0-9+.-]*:/*(?=/)", "")
    return files.select(
        F.substring(relative, F.length(base) + 1, F.length(relative)).alias("path"),
        F.when(status.isin("ok", "empty"), text).alias("text"),
        status.alias("status"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
        F.sha2("content", 256).alias("content_hash"),
    )


def enumerated(sources: DataFrame, *, scope: str | None = None, include: list[str] = (), exclude: list[str] = (), hidden: bool = True, max_files: int | None = None) -> DataFrame:
    """Admitted sources by scope, globs and the hidden flag; .git never; with max_files the first by path."""
    path = F.col("path")
    keep = tx.globs_admit(path, list(include), list(exclude)) & ~tx.in_git(path)
    if not hidden:
        keep &= ~tx.is_hidden(path)
    if scope:
        keep &= tx.in_scope(path, scope)
    out = sources.filter(keep)
    return out.orderBy("path").limit(max_files) if max_files else out


def lines(sources: DataFrame) -> DataFrame:
    """path, line_no, line, byte_start of every line."""
    arr = tx.lines_of(F.col("text"))
    starts = tx.running(F.transform(arr, lambda x: F.octet_length(x).cast("long") + 1))
    zipped = sources.select("path", F.posexplode(F.arrays_zip(arr.alias("line"), starts.alias("after"))).alias("p", "z"))
    return zipped.select("path", (F.col("p") + 1).alias("line_no"), F.col("z.line").alias("line"), (F.col("z.after") - F.octet_length("z.line") - 1).alias("byte_start"))


def plain_lines(sources: DataFrame) -> DataFrame:
    """path, line_no, line: without byte offsets, which cost a fold."""
    return sources.select("path", F.posexplode(tx.lines_of(F.col("text"))).alias("p", "line")).select("path", (F.col("p") + 1).alias("line_no"), "line")


def matching_lines(sources: DataFrame, pattern: str, **how) -> DataFrame:
    """path, line_no, line of matching lines. The same test goes to the whole text first if the pattern is a literal within one line,
    since the optimizer doesn't move a filter below the split into lines."""
    if how.get("literal") and "\n" not in pattern:
        sources = sources.filter(tx.line_matches(F.col("text"), pattern, **how))
    return plain_lines(sources).filter(tx.line_matches(F.col("line"), pattern, **how))


def two_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A base and a target version of documents: the target lacks source src3, src5's documents have one more line, French
    documents have moved to another folder. path, text, doc_id, size, content_hash."""
    base = document_sources(spark, sf_dir).select("path", "text", "doc_id", "source", "lang")
    moved = F.when(F.col("lang") == "fr", F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path"))
    grown = F.when(F.col("source") == "src5", F.concat(F.col("text"), F.lit("\nAn added line."))).otherwise(F.col("text"))
    target = base.filter("source != 'src3'").select(moved.alias("path"), grown.alias("text"), "doc_id", "source", "lang")
    facts = lambda df: df.select("path", "text", "doc_id", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("content_hash"))
    return facts(base), facts(target)


# --- caches and external records ------------------------------------------------------------------------------------


def embedding_key(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(role, F.lit("\0"), text), 256)


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct wanted rows (key, ...) that the cache lacks."""
    return wanted.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def evicted(cache: DataFrame, limit_bytes: int) -> DataFrame:
    """The oldest entries beyond the limit: the newest stay while their running size fits. Entries are dealt by day, so that only
    one row for a day meets in one task."""
    day = F.to_date("mtime")
    per_day = cache.groupBy(day.alias("day")).agg(F.sum("bytes").alias("b"))
    newer = F.coalesce(F.sum("b").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = per_day.select("day", newer.alias("newer"))
    own = F.sum("bytes").over(Window.partitionBy("day").orderBy(F.desc("mtime"), "key").rowsBetween(Window.unboundedPreceding, 0))
    return cache.withColumn("day", day).join(before, "day").withColumn("so_far", own + F.col("newer")).filter(F.col("so_far") > limit_bytes).drop("day", "newer", "so_far")


def record_search(records: DataFrame, query: str, limit: int = 5, after: str | None = None) -> DataFrame:
    """External records (id, revision, title, content) that hold the query, by id; `after` is the page token (the last id seen)."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be from 1 to 50")
    found = records.filter(F.contains(F.lower("title"), F.lit(query.lower())) | F.contains(F.lower("content"), F.lit(query.lower())))
    if after is not None:
        found = found.filter(F.col("id") > F.lit(after))
    return found.orderBy("id").limit(limit)


def record_read(records: DataFrame, record_id: str, revision: str) -> DataFrame:
    """id, status (current or stale), content (only if current) of one record."""
    current = F.col("revision") == F.lit(revision)
    return records.filter(F.col("id") == F.lit(record_id)).select("id", F.when(current, "current").otherwise("stale").alias("status"), F.when(current, F.col("content")).alias("content"))


def media_inventory(files: DataFrame, most_files: int = 512, most_bytes: int = 20 << 20, most_total: int = 256 << 20) -> DataFrame:
    """path, size, kind, status of image and PDF files: too-large ones are named, the others stay by path while the totals fit."""
    ext = tx.extension(F.col("path"))
    kind = F.when(ext.isin(MEDIA["image"]), "image").when(ext.isin(MEDIA["pdf"]), "pdf")
    media = files.select("path", "size", kind.alias("kind")).filter("kind is not null")
    fits = media.filter(F.col("size") <= most_bytes).orderBy("path").limit(most_files)  # at most most_files rows go on
    so_far = F.sum("size").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, 0))
    return media.join(fits.select("path", so_far.alias("so_far")), "path", "left").select(
        "path", "size", "kind", F.when(F.col("size") > most_bytes, "too-large").when(F.col("so_far").isNull(), "file-limit").when(F.col("so_far") > most_total, "total-limit").otherwise("admitted").alias("status")
    )


def matches_with_context(sources: DataFrame, pattern: str, context: int, **how) -> DataFrame:
    """path, line_no, line, context: each matching line with `context` lines on either side, of its file. Matches are found within the
    document's row, so its lines are copied for matches only."""
    if how.get("literal") and "\n" not in pattern:
        sources = sources.filter(tx.line_matches(F.col("text"), pattern, **how))
    arr = sources.select("path", tx.lines_of(F.col("text")).alias("l"))
    at = F.array_compact(F.transform("l", lambda x, i: F.when(tx.line_matches(x, pattern, **how), i + 1)))
    hits = arr.select("path", "l", F.explode(at).alias("line_no"))
    first = F.greatest(F.lit(1), F.col("line_no") - context)
    return hits.select("path", "line_no", F.col("l")[F.col("line_no") - 1].alias("line"), F.array_join(F.slice("l", first, F.col("line_no") + context - first + 1), "\n").alias("context"))


def role_occurrences(sources: DataFrame, pattern: str, wanted: list[str], **how) -> DataFrame:
    """path, text, start, end (characters), byte_start of the occurrences that lie within one of the wanted lexical roles. A source of no
    known language has no roles, so it has none."""
    known = sources.filter(tx.extension(F.col("path")).isin(*(e for ends in md.LANGUAGES.values() for e in ends)))
    if how.get("literal") and "\n" not in pattern:
        known = known.filter(tx.line_matches(F.col("text"), pattern, **how))
    by_line = tx.compiled_pattern(pattern, **how).replace("(?d", "(?dm", 1)
    spans = known.select("path", "text", F.filter(md.roles(F.col("path"), F.col("text")), lambda r: r["role"].isin(*wanted)).alias("spans")).filter(F.size("spans") > 0)
    both = F.zip_with(tx.occurrences(F.col("text"), by_line, F.length, ("start", "end")), tx.occurrences(F.col("text"), by_line), lambda c, b: F.struct(c["start"].alias("start"), c["end"].alias("end"), b["byte_start"].alias("byte_start")))
    hits = spans.select("path", "text", "spans", F.explode(both).alias("o"))
    return hits.filter(F.exists("spans", lambda r: (r["start"] <= F.col("o.start")) & (F.col("o.end") <= r["end"]))).select("path", "text", "o.*")


def role_lines(sources: DataFrame, pattern: str, wanted: list[str], **how) -> DataFrame:
    """path, line_no, line of the lines with a match that lies within one of the wanted lexical roles. A source of no known language
    has no roles, so it has no such line."""
    hits = role_occurrences(sources, pattern, wanted, **how)
    line_no = F.regexp_count(F.substring("text", F.lit(1), F.col("start").cast("int")), F.lit("\n")) + 1
    numbered = hits.select("path", line_no.alias("line_no"), "text").dropDuplicates(["path", "line_no"])
    return numbered.select("path", "line_no", F.split("text", "\n", -1)[F.col("line_no") - 1].alias("line"))
