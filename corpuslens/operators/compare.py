"""Comparing versions and scans: stable revisions, validation, scan comparison, changes, renames, audit receipts, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import modules as md
from corpuslens.functions import text as tx
from corpuslens.operators import ranking as rk
from corpuslens.sources.shared import written


def same_revision(a: str, b: str) -> Column:
    """Equality of two revision structs (size, mtime_ms, ctime_ms, inode, device): ctime only where both have it, the last two null-safe."""
    f = lambda s, k: F.col(f"{s}.{k}")
    return (f(a, "size") == f(b, "size")) & (f(a, "mtime_ms") == f(b, "mtime_ms")) & F.coalesce(f(a, "ctime_ms") == f(b, "ctime_ms"), F.lit(True)) & f(a, "inode").eqNullSafe(f(b, "inode")) & f(a, "device").eqNullSafe(f(b, "device"))


def stable(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of before (path, content_hash) that after has unchanged."""
    return before.join(after.select("path", "content_hash"), ["path", "content_hash"], "left_semi")


def validated(saved: DataFrame, current: DataFrame) -> DataFrame:
    """path, status: current, stale, or unknown where the source is gone."""
    c = current.select("path", F.col("content_hash").alias("now"))
    return saved.join(c, "path", "left").select("path", F.when(F.col("now").isNull(), "unknown").when(F.col("now") == F.col("content_hash"), "current").otherwise("stale").alias("status"))


def validity() -> Column:
    """The status of a set: stale before unknown before current; of nothing, unknown. For an aggregation over `status`."""
    has = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    return F.when(has("stale"), "stale").when(has("unknown") | (F.count("*") == 0), "unknown").otherwise("current")


def scans_differ(a: DataFrame, b: DataFrame, missing_is_change: bool) -> DataFrame:
    """path, a_n, b_n, verdict of two scans (path, n, content_hash): same, changed, or unknown where one side has no revision."""
    x = a.select("path", F.col("n").alias("a_n"), F.col("content_hash").alias("a_hash"))
    y = b.select("path", F.col("n").alias("b_n"), F.col("content_hash").alias("b_hash"))
    lacking = F.col("a_hash").isNull() | F.col("b_hash").isNull()
    verdict = F.when(lacking, "changed" if missing_is_change else "unknown").when((F.col("a_n") == F.col("b_n")) & (F.col("a_hash") == F.col("b_hash")), "same").otherwise("changed")
    return x.join(y, "path", "full_outer").select("path", "a_n", "b_n", verdict.alias("verdict"))


def changed(base: DataFrame, target: DataFrame) -> DataFrame:
    """path, change: added, removed or modified between two versions (path, content_hash)."""
    b = base.select("path", F.col("content_hash").alias("old"))
    t = target.select("path", F.col("content_hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return b.join(t, "path", "full_outer").select("path", change.alias("change")).filter("change is not null")


def line_counts(versions: DataFrame, text: str = "text") -> DataFrame:
    """path, line (a hash of its bytes with the line feed), n, bytes: the multiset of a source's lines, as a line is with its LF."""
    pieces = F.filter(F.split(F.col(text), "(?<=\n)", -1), lambda x: x != "")
    exploded = versions.select("path", F.explode(pieces).alias("line"))
    return exploded.groupBy("path", F.sha2("line", 256).alias("line")).agg(F.count("*").alias("n"), F.max(F.octet_length("line")).alias("bytes"))


def line_similarity(pairs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """old_path, new_path, similarity of the given pairs: 100 if equal, 0 if sizes differ by over half, else the bytes of common lines
    against the larger size, 99 at most. old, new: path, text, size, content_hash."""
    facts = lambda df, p: df.select(F.col("path").alias(f"{p}_path"), F.col("size").alias(f"{p}_size"), F.col("content_hash").alias(f"{p}_hash"))
    known = pairs.join(facts(old, "old"), "old_path").join(facts(new, "new"), "new_path")
    big, small = F.greatest("old_size", "new_size"), F.least("old_size", "new_size")
    counts = lambda df, p: line_counts(df).select(F.col("path").alias(f"{p}_path"), "line", F.col("n").alias(f"{p}_n"), F.col("bytes").alias(f"{p}_b"))
    common = pairs.join(counts(old, "old"), "old_path").join(counts(new, "new"), ["new_path", "line"]).groupBy("old_path", "new_path").agg(F.sum(F.least("old_n", "new_n") * F.col("old_b")).alias("common"))
    score = F.when(F.col("old_hash") == F.col("new_hash"), 100).when((big == 0) | (small / big < 0.5), 0).otherwise(F.least(F.lit(99), F.floor(100 * F.coalesce("common", F.lit(0)) / big)))
    return known.join(common, ["old_path", "new_path"], "left").select("old_path", "new_path", score.cast("long").alias("similarity"))


def equal_pairs(removed: DataFrame, added: DataFrame) -> DataFrame:
    """old_path, new_path, similarity (100): contents that are once on either side. Counted by hash first, so that k equal files on
    either side aren't joined to all their pairs."""
    once = lambda df, p: df.groupBy("content_hash").agg(F.count("*").alias("c"), F.min("path").alias(p)).filter("c = 1").select("content_hash", p)
    return once(removed, "old_path").join(once(added, "new_path"), "content_hash").select("old_path", "new_path", F.lit(100).cast("long").alias("similarity"))


def rename_pairs(removed: DataFrame, added: DataFrame, least: int = 50) -> DataFrame:
    """old_path, new_path, similarity: pairs of at least that similarity that are each other's only best.

    Candidates are equal contents, or share a line of both prefixes: with lines ordered by rarity, the common lines of a pair weigh at
    least half of either source, so the rarest of them has at least that weight from it on. Very common lines thus bring few pairs
    together, and none is lost. Ties on either side take a row out."""
    equal = equal_pairs(removed, added)
    # a path whose content the other side has too is in a pair of equal contents or, where it has several partners, in none
    removed, added = removed.join(added.select("content_hash"), "content_hash", "left_anti"), added.join(removed.select("content_hash"), "content_hash", "left_anti")
    old, new = line_counts(removed), line_counts(added)
    rarity = old.unionByName(new).groupBy("line").agg(F.count("*").alias("df"))

    def prefix(counts: DataFrame, p: str) -> DataFrame:
        w = Window.partitionBy("path").orderBy("df", "line")
        weight = F.col("n") * F.col("bytes")
        own = counts.join(rarity, "line").withColumn("size", F.sum(weight).over(Window.partitionBy("path"))).withColumn("before", F.sum(weight).over(w) - weight)
        return own.filter((F.col("size") - F.col("before")) * 100 >= F.col("size") * least).select(F.col("path").alias(p), "line")

    sharing = prefix(old, "old_path").join(prefix(new, "new_path"), "line").select("old_path", "new_path")
    scored = line_similarity(sharing.distinct(), removed, added).filter(F.col("similarity") >= least)
    best = lambda p: F.max("similarity").over(Window.partitionBy(p))
    top = scored.withColumn("old_best", best("old_path")).withColumn("new_best", best("new_path"))
    n = lambda p: F.sum((F.col("similarity") == F.col(f"{p}_best")).cast("int")).over(Window.partitionBy(f"{p}_path"))
    return top.withColumn("old_n", n("old")).withColumn("new_n", n("new")).filter("similarity = old_best and similarity = new_best and old_n = 1 and new_n = 1").select("old_path", "new_path", "similarity").unionByName(equal)


def audit(lines: DataFrame, literals: list[str], n_files: Column | None = None, closed: bool = True) -> DataFrame:
    """pattern, matches (lines), files, evidence (the first three path:line), status. lines: path, line_no, line. A literal without
    upper case is matched in any case. Absence is claimed only if the coverage is closed."""
    hits = [(x, tx.line_matches(F.col("line"), x, literal=True, ignore_case=None)) for x in literals]
    which = F.array_compact(F.array(*(F.when(m, F.lit(x)) for x, m in hits)))
    found = lines.select("path", "line_no", F.explode(which).alias("pattern"))
    counts = found.groupBy("pattern").agg(F.count("*").alias("matches"), F.count_distinct("path").alias("files"))
    first = found.withColumn("r", F.row_number().over(Window.partitionBy("pattern").orderBy("path", "line_no"))).filter("r <= 3")
    evidence = first.groupBy("pattern").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "path", "line_no"))), ",").alias("evidence"))
    asked = lines.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, literals))).alias("pattern"))
    absent = F.lit("absent_with_complete_coverage" if closed else "unknown")
    out = asked.join(counts, "pattern", "left").join(evidence, "pattern", "left")
    return out.select("pattern", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("evidence", F.lit("")).alias("evidence"), F.when(F.col("matches") > 0, "present").otherwise(absent).alias("status"))


def capabilities(sources: DataFrame) -> DataFrame:
    """extension, language, capabilities, files: what can be said of sources, by their extension."""
    ext, language, can = tx.extension(F.col("path")), F.lit("none"), F.lit("")
    for name, ends in md.LANGUAGES.items():
        language = F.when(ext.isin(*ends), name).otherwise(language)
        can = F.when(ext.isin(*ends), ",".join(md.CAPABILITIES[name])).otherwise(can)
    return sources.groupBy(ext.alias("extension"), language.alias("language"), can.alias("capabilities")).agg(F.count("*").alias("files"))


def closure(before: DataFrame, after: DataFrame, most_bytes: int) -> DataFrame:
    """folder, closed, searched, skipped of two scans (path, size, content_hash): a folder is closed if every source of it is the same
    in both and none was passed over for its size; searched is the lesser of the scans' counts."""
    b = before.select("path", F.col("size").alias("b_size"), F.col("content_hash").alias("b_hash"))
    a = after.select("path", F.col("size").alias("a_size"), F.col("content_hash").alias("a_hash"))
    fits = lambda c: F.sum(F.coalesce((F.col(c) <= most_bytes).cast("long"), F.lit(0)))
    same = F.coalesce(F.col("b_hash") == F.col("a_hash"), F.lit(False))
    return b.join(a, "path", "left").groupBy(tx.directory(F.col("path")).alias("folder")).agg(F.bool_and(same & (F.col("b_size") <= most_bytes)).alias("closed"), F.least(fits("b_size"), fits("a_size")).alias("searched"), F.sum((F.col("b_size") > most_bytes).cast("long")).alias("skipped"))


def bounded_reasons(rows: DataFrame, key: str, most: int = 64, most_bytes: int = 4094) -> DataFrame:
    """key, reasons, omitted, unsupported, examples: a group's distinct reasons in order while they fit the bounds (one that doesn't fit
    is passed over), how many were left out, and those of unsupported sources as a count with three examples.

    rows: the key, name, reason, unsupported. A group's reasons are distinct before they meet; at most some 1,000 fit the bytes."""
    rows = written(rows, "reasons")
    distinct = written(rows.filter("not unsupported").select(key, "reason").distinct().withColumn("size", F.octet_length("reason") + 3), "distinct")
    fit = rk.budget_skipping(distinct, key, ["reason"], "size", most_bytes)
    kept = fit.withColumn("r_", F.row_number().over(Window.partitionBy(key).orderBy("reason"))).filter(F.col("r_") <= most)
    shown = kept.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("reason")), "|").alias("reasons"), F.count("*").alias("shown_"))
    bare = rows.filter("unsupported")
    first = bare.withColumn("r_", F.row_number().over(Window.partitionBy(key).orderBy("name"))).filter("r_ <= 3").groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("examples"))
    n = rows.groupBy(key).agg(F.sum(F.col("unsupported").cast("long")).alias("unsupported"))
    out = n.join(distinct.groupBy(key).agg(F.count("*").alias("all_")), key, "left").join(shown, key, "left").join(first, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(key, F.coalesce("reasons", F.lit("")).alias("reasons"), (zero("all_") - zero("shown_")).alias("omitted"), "unsupported", F.coalesce("examples", F.lit("")).alias("examples"))


def statistics(matches: DataFrame, most: int = 5, most_files: int = 8) -> DataFrame:
    """kind (extension, directory, file), key, matches, omitted: the largest groups of each kind, and how many more there are.
    matches: path, n."""
    keyed = matches.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in (("extension", tx.extension(F.col("path"))), ("directory", tx.directory(F.col("path"))), ("file", F.col("path")))))).alias("g"), "n")
    sums = written(keyed.groupBy("g.kind", "g.key").agg(F.sum("n").alias("matches")), "sums")
    cut = F.when(F.col("kind") == "file", most_files).otherwise(most)
    of = lambda k, n: sums.filter(F.col("kind") == k).orderBy(F.desc("matches"), "key").limit(n)  # noqa: E731  heaps of a few rows in each task
    top = of("extension", most).unionByName(of("directory", most)).unionByName(of("file", most_files))
    totals = sums.groupBy("kind").agg(F.count("*").alias("groups"))
    return top.join(F.broadcast(totals), "kind").withColumn("omitted", F.greatest(F.lit(0), F.col("groups") - cut)).drop("groups")  # three rows
