"""Requests for an assessment of a claim on found rows, and for images and scanned pages."""

import pytest

from corpuslens.engine import Engine
from corpuslens.request import RequestError

REFUND = "The allowance is thirty days.\nExcept for sales.\npassword = 'hunter22hunter'\n"


def code_of(engine, request):
    with pytest.raises(RequestError) as e:
        engine.search(request)
    return e.value.code


def test_support(spark):
    seen = []

    def assess(question, claim, excerpts):
        seen.append((question, claim, excerpts))
        return "contradicted"

    sources = spark.createDataFrame([("refund.txt", REFUND), ("other.txt", "no days\n" + "long " * 2000)], "path string, text string")
    engine = Engine(spark, sources, assessor=assess)
    found = engine.search({"pattern": "days", "literal": True, "mode": "matches"})
    ask = {"mode": "support", "cursor": found.cursor, "supportQuestion": "how long?", "supportClaim": "for ever"}
    row = engine.search({**ask, "matchIndex": 2, "supportContextLines": 2}).page()[0][0]
    assert (row["assessment"], row["evidence_items"], row["context_lines"]) == ("contradicted", [2], 2)
    assert seen[0][:2] == ("how long?", "for ever") and "Except for sales." in seen[0][2][0] and "hunter22" not in seen[0][2][0]
    engine.search({**ask, "matchIndices": [2, 1], "supportContextLines": 0})
    assert seen[1][2] == ["The allowance is thirty days.", "no days"]
    assert code_of(engine, {**ask, "matchIndex": 1, "supportContextLines": 1}) == "E_SUPPORT_TOO_LARGE"
    assert code_of(engine, {**ask, "matchIndex": 3}) == code_of(engine, {**ask, "matchIndex": 0}) == "E_RANGE"
    assert code_of(engine, ask) == code_of(engine, {**ask, "matchIndex": 1, "matchIndices": [1]}) == "E_FIELD_CONFLICT"
    assert code_of(engine, {**ask, "matchIndex": 1, "cursor": engine.search({"mode": "files"}).cursor}) == "E_SUPPORT_EVIDENCE"
    assert len(seen) == 2
    alone = Engine(spark, sources)
    again = alone.search({"pattern": "thirty", "literal": True, "mode": "matches"})
    result = alone.search({**ask, "cursor": again.cursor, "matchIndex": 1})
    assert result.page()[0][0]["assessment"] == "unknown" and result.coverage["assessor"] == "unavailable"


def test_media(spark):
    rows = [(f"m/{i:02}.png", "image", None, 10, 10, [1.0, i / 10]) for i in range(12)] + [("m/a.pdf", "scan", p, 20, 20, [0.0, 1.0]) for p in (1, 2)] + [("m/none.png", "image", None, 1, 1, None)]
    media = spark.createDataFrame(rows, "path string, kind string, page int, width int, height int, embedding array<float>")
    engine = Engine(spark, spark.createDataFrame([], "path string, text string"), media=media, media_embedder=lambda query, image: [1.0, 0.0] if query else [0.0, 1.0])
    got, more = engine.search({"mode": "media", "query": "a cat"}).page()
    assert [r["path"] for r in got] == [f"m/{i:02}.png" for i in range(10)] and more is None
    assert [(r["path"], r["page"]) for r in engine.search({"mode": "media", "image": "x.png", "kind": "scan"}).page()[0]] == [("m/a.pdf", 1), ("m/a.pdf", 2)]
    assert engine.search({"mode": "media", "query": "q", "glob": ["*.pdf"]}).count() == 2
    assert code_of(engine, {"mode": "media"}) == code_of(engine, {"mode": "media", "query": "a", "image": "b"}) == "E_FIELD_CONFLICT"
    assert code_of(engine, {"mode": "media", "query": "a", "kind": "video"}) == "E_FIELD_VALUE"
    assert code_of(Engine(spark, media), {"mode": "media", "query": "a"}) == "E_MEDIA_UNAVAILABLE"
