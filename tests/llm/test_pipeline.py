import random
import re

import numpy as np
import public_tokenizers
import sentencepiece
from test_quality_rules import by_definition as measures
from test_simhash import brute
from test_simhash import by_definition as fingerprint

import corpus_pipeline as cp
from corpuslens.llm import quality_rules as qr


def corpus():
    rng = random.Random(11)
    words = [w for w in qr.STOP_WORDS if len(w) > 1] + ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(60, 200)), rng.choice(["en", "de"]), rng.choice(["s1", "s1", "s2", "s3"])) for i in range(120)]
    rows += [(200 + i, rows[i][1].replace(" ", "  ", 2) + ("\t" if i % 2 else ""), "en", "s1") for i in range(0, 30, 2)]
    base = text(600)
    rows += [(300 + i, base.replace(words[50], words[60 + i], 1), "en", "s2") for i in range(25)]
    rows += [(400, None, None, None), (401, "", "en", "s1"), (402, "short text", "en", "s3"), (403, "% # & " * 80, "en", "s1"), (404, "the same old line\n" * 40, "en", "s2"), (405, base + " end", None, None)]
    rows += [rows[5], rows[6], (None, text(90), "en", "s1")]
    return [(*r, len(r[1] or "")) for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept_by_quality(t):
    n, chars, symbols, dup, _, base = measures(t)
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    stops = set(re.findall(r"[^\x20\x09-\x0D]+", t or "")) & set(qr.STOP_WORDS)
    return not base and 2 * n <= chars <= 15 * n and 10 * symbols <= n and 10 * dup <= 5 * len(lines) and len(stops) >= 2


def first_of(rows, group):
    """Of each group the row with the smallest id, null ids last."""
    best = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        best.setdefault(group(r), r)
    return list(best.values())


def test_stages_match_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sort = lambda rs: sorted(map(tuple, rs), key=str)
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        got = docs.collect()
        if name == "quality rules":
            rows = [r for r in rows if kept_by_quality(r[1])]
        elif name == "exact dedup":
            rows = first_of(rows, lambda r: re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""))
        elif name == "near dedup":
            fps = np.array([fingerprint(r[1]) for r in rows], np.uint64)
            root = dict(zip(map(id, rows), brute(fps), strict=True))
            rows = first_of(rows, lambda r: root[id(r)])
        if name == "encoding":
            assert sorted((str(r.doc_id), list(r.ids), r.round_trip) for r in got) == sorted((str(r[0]), library.encode(r[1]), True) for r in rows)
        else:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and sort(got) == sort(rows), name
    assert 100 < len(rows) < 130
    # the mix's order outlives the last stage: places are the rows' places in the files of the stage before
    before = {(r.f, r.i): r.doc_id for r in spark.read.parquet(str(tmp_path / "3")).selectExpr("_metadata.file_name f", "_metadata.row_index i", "doc_id").collect()}
    assert {(r.mix_file, r.mix_row): r.doc_id for r in got} == before and len(before) == len(rows)


def test_run_and_empty_table(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    n = cp.run(spark, str(tmp_path)).count()
    assert 100 < n < 130
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert cp.run(spark, str(tmp_path / "none")).collect() == []


def test_clashing_columns_and_a_very_long_text(spark, tmp_path):
    rng, rows = random.Random(5), corpus()
    words = [w for w in qr.STOP_WORDS if len(w) > 2]
    long_ = " ".join(rng.choice(words) + str(rng.randint(0, 10**6)) + " " + rng.choice(words) for _ in range(200_000))  # some 3 MB
    rows = [*rows, (900, long_, "en", "s3", len(long_))]
    more = "kept string, text_key int, drop_id int, judged string, fingerprint int, component_id string, part int, place string, slot int, digest string, n_words string, ids int"
    extra = ("k", 1, 2, "j", 3, "c", 4, "p", 5, "d", "n", 6)
    plain = spark.createDataFrame(rows, SCHEMA)
    docs = spark.createDataFrame([(*r, *extra) for r in rows], f"{SCHEMA}, {more}")
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / f"wide{k}"))
        stage(spark, plain, "").write.parquet(str(tmp_path / f"plain{k}"))
        docs, plain = spark.read.parquet(str(tmp_path / f"wide{k}")), spark.read.parquet(str(tmp_path / f"plain{k}"))
        assert sorted(str(r.doc_id) for r in docs.select("doc_id").collect()) == sorted(str(r.doc_id) for r in plain.select("doc_id").collect()), name
        if name != "encoding":
            assert len(docs.columns) == 17 and all(tuple(r)[5:] == extra for r in docs.collect())
    assert 900 in {r.doc_id for r in docs.select("doc_id").collect()}
