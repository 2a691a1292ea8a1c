"""Queries that SQL can't say, against plain loops over whole tables."""

from collections import Counter

from corpuslens.functions import scanners as sc
from corpuslens.plans import catalog
from corpuslens.sources import corpus as co

SF = "/root/testdata/sf0.001"


def texts(spark):
    return {r.path: r.text for r in co.document_sources(spark, SF).collect()}


def test_distinct_passages(spark):
    got = {}
    for r in catalog.QUERIES["distinct_passages"](spark, SF).collect():
        got.setdefault(r.path, set()).add((r.start, r.end))
    for path, t in texts(spark).items():
        k, all_ = 0, []
        while True:
            s, e = k * 840, min(len(t), k * 840 + 1000)
            all_.append((-(t[s:e].count("th")), s, e))
            k += 1
            if k * 840 >= len(t) - 160:
                break
        kept = []
        for _, s, e in sorted(all_):
            if not any(s < b and a < e for a, b in kept):
                kept.append((s, e))
        assert got[path] == set(kept)


def test_passages_snapped(spark):
    docs = {r.doc_id: r.text for r in co.table(spark, SF, "documents").collect()}
    got = {}
    for r in catalog.QUERIES["passages_snapped"](spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.passage_no, r.char_start, r.char_end))
    for i, t in docs.items():
        want, start = [], 0
        while True:
            end = min(len(t), start + 1000)
            if end < len(t):
                at = t[: end + 1].rfind("\n")
                end = at + 1 if at > start + 500 else end
            want.append((start, end))
            if end == len(t):
                break
            start = max(start + 1, end - 160)
        assert [x[1:] for x in sorted(got[i])] == want


def test_preview_windows(spark):
    hits = {}
    for path, t in texts(spark).items():
        lines = t.split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        hits[path] = [i for i, x in enumerate(lines, 1) if "the" in x]
    want = set()
    for path in sorted((p for p in hits if hits[p]), key=lambda p: (-len(hits[p]), p))[:5]:
        kept = []
        for n in hits[path]:
            if len(kept) < 2 and (not kept or n - kept[-1] > 6):
                kept.append(n)
        want |= {(path, max(1, n - 3), n + 3) for n in kept}
    assert {tuple(r) for r in catalog.QUERIES["preview_windows"](spark, SF).collect()} == want


def test_rename_pairs(spark):
    base, target = ({r.path: r.text for r in v.collect()} for v in co.two_versions(spark, SF))
    old, new = {p: t for p, t in base.items() if p not in target}, {p: t for p, t in target.items() if p not in base}

    def similarity(a, b):
        if a == b:
            return 100
        big = max(len(a.encode()), len(b.encode()))
        if not big or min(len(a.encode()), len(b.encode())) / big < 0.5:
            return 0
        x, y = Counter(sc.split_lines(a)), Counter(sc.split_lines(b))
        return min(99, 100 * sum(len(line.encode()) * min(n, y[line]) for line, n in x.items()) // big)

    scored = {(p, q): s for p in old for q in new if (s := similarity(old[p], new[q])) >= 50}
    best = {}
    for (p, q), s in scored.items():
        for k in (("old", p), ("new", q)):
            best.setdefault(k, []).append(s)
    only = lambda k, s: max(best[k]) == s and best[k].count(s) == 1
    want = {(p, q, s) for (p, q), s in scored.items() if only(("old", p), s) and only(("new", q), s)}
    assert {tuple(r) for r in catalog.QUERIES["rename_pairs"](spark, SF).collect()} == want


def test_redact_full(spark):
    docs = {r.doc_id: r.text for r in co.table(spark, SF, "documents").collect()}
    out = catalog.QUERIES["redact_full"](spark, SF).collect()
    assert {r.doc_id: (r.shown, r.hidden) for r in out} == {i: sc.redacted(t) for i, t in docs.items()}
