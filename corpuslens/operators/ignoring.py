"""Ignore rules: files among the sources whose lines say which paths below their folder are left out.

A folder's rules are inherited by all folders below it. Spark joins each distinct folder to the rule files of the folders above it, so
a folder's row has its own chain of rules, root first, however many rule files there are; a path is then decided by its folder's chain
alone. Along the chain the last rule that matches decides, a deeper folder's rules after those above it; of the kinds of rule files the
first of KINDS with a matching rule decides. A folder that is left out is closed: nothing below it comes back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as tx
from corpuslens.operators.ranking import BROADCAST_ROWS
from corpuslens.sources.shared import written

#: Names of rule files, those that decide first in front.
KINDS = (".rgignore", ".ignore", ".gitignore")


class Rule(NamedTuple):
    """A line of a rule file: where it stands, what it matches (relative to its folder), and what it says."""

    line: str
    kept: bool
    folders_only: bool
    pattern: re.Pattern


def glob_body(glob: str) -> str:
    """The pattern of a rule's glob without its slashes at either end."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob[i:] == "**" and (i == 0 or glob[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif c == "*":
            while i < len(glob) and glob[i] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (m := re.compile(r"\[([!^]?)(\]?[^\]]*)\]").match(glob, i)):
            inside = m[2].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("~", "\\~").replace("|", "\\|")
            out, i = out + f"(?!/)[{'^' if m[1] else ''}{inside}]", m.end()
        elif c == "[":
            raise re.error("a class that isn't closed")
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def parsed(line: str) -> Rule | None:
    """The rule of a line; None for blank lines, comments and globs that can't be read."""
    line = line.removesuffix("\r")
    glob = re.sub(r"(?<!\\)((?:\\\\)*) +$", r"\1", line)
    if not glob or glob.startswith("#"):
        return None
    kept = glob.startswith("!")
    glob = glob[1:] if kept else glob
    folders_only = glob.endswith("/")
    glob = glob.rstrip("/")
    if not glob:
        return None
    anchored = "/" in glob
    try:
        body = re.compile(("" if anchored else "(?:.*/)?") + glob_body(glob.lstrip("/")), re.S)
    except re.error:
        return None
    return Rule(line, kept, folders_only, body)


@lru_cache(maxsize=4096)
def rules_of(text: str) -> tuple[Rule, ...]:
    """The rules of a rule file, the last one first."""
    return tuple(r for line in reversed(text.split("\n")) if (r := parsed(line)))


def decision(path: str, is_folder: bool, chain: list[tuple[str, str, str]]) -> tuple[bool, str] | None:
    """(left out, rule file:rule) of a path, by the chain (folder, kind, text) of rule files, root first; None if no rule matches."""
    for kind in KINDS:
        for folder, own, text in reversed(chain):
            if own != kind or (folder and not path.startswith(folder + "/")):
                continue
            relative = path[len(folder) + 1 :] if folder else path
            for rule in rules_of(text):
                if (is_folder or not rule.folders_only) and rule.pattern.fullmatch(relative):
                    return not rule.kept, f"{folder}/{kind}:{rule.line}".lstrip("/")
    return None


def ignored_by(path: str, chain: list[tuple[str, str, str]], closed: dict[str, str | None] | None = None) -> str | None:
    """The rule that leaves a path out, its own or that of a folder above it; None if it stays. closed: what is known of folders."""
    closed = {} if closed is None else closed
    parts = path.split("/")
    why = None
    for n in range(1, len(parts)):
        folder = "/".join(parts[:n])
        if folder not in closed:
            said = decision(folder, True, chain)
            closed[folder] = why or (said[1] if said and said[0] else None)
        why = closed[folder]
        if why:
            return why
    said = decision(path, False, chain)
    return said[1] if said and said[0] else None


def folder_of(path: Column) -> Column:
    """The folder of a path, '' for the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def rule_files(sources: DataFrame) -> DataFrame:
    """folder, kind, text of the rule files among sources (path, text)."""
    return sources.filter(tx.basename(F.col("path")).isin(*KINDS)).select(folder_of(F.col("path")).alias("rule_folder"), tx.basename(F.col("path")).alias("kind"), F.col("text").alias("rules"))


def chains(folders: DataFrame, rules: DataFrame) -> DataFrame:
    """folder, chain (array of rule_folder, kind, rules, root first) of the given folders (folder) that have rule files in or above them."""
    parts = F.split("folder", "/")
    above = F.concat(F.array(F.lit("")), F.when(F.col("folder") != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>")))
    rules = written(rules.filter("rules is not null"), "rules")
    near = F.broadcast(rules) if rules.count() <= BROADCAST_ROWS // 100 else rules  # texts of rule files
    met = folders.select("folder", F.explode(above).alias("rule_folder")).join(near, "rule_folder")
    each = F.struct(F.length("rule_folder").alias("depth"), "rule_folder", "kind", "rules")
    return met.groupBy("folder").agg(F.array_sort(F.collect_list(each)).alias("chain"))  # a folder's own depth times the kinds


def with_rule(sources: DataFrame) -> DataFrame:
    """sources (path, text) with ignored_by: the rule (file and line) that leaves a path out, or null."""
    keyed = sources.withColumn("folder_", folder_of(F.col("path")))
    found = chains(keyed.select(F.col("folder_").alias("folder")).distinct(), rule_files(sources)).withColumnRenamed("folder", "of_folder_")
    found = written(found, "chains")
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS // 100 else found

    @F.pandas_udf("string")
    def why(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for paths, chain in batches:
            closed: dict[str, dict] = {}  # by folder, what is known of the folders above, for one batch
            out = []
            for path, own in zip(paths, chain, strict=True):
                folder = path.rpartition("/")[0] if path else ""
                out.append(None if own is None or path is None else ignored_by(path, [(x["rule_folder"], x["kind"], x["rules"]) for x in own], closed.setdefault(folder, {})))
            yield pd.Series(out, dtype=object)

    joined = keyed.join(found, F.col("folder_") == F.col("of_folder_"), "left")
    return joined.withColumn("ignored_by", why(F.col("path"), F.col("chain"))).drop("folder_", "of_folder_", "chain")
