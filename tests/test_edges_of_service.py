"""What comes in and goes out: request bodies, nested rows, the table of states, searches for many vectors."""

import json

import numpy as np
import pytest

from folioworks.operators import vectors
from folioworks.plans import structuring
from folioworks.sinks import chunks as sink
from folioworks.sinks import states
from folioworks.sources import adapters, requests, settings

LONG = "# Titre\n" + " ".join(f"mot{i}" for i in range(20))


def bodies(spark, values):
    return spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "n int, body string")


def test_ocr_bodies(spark):
    whole = {"ocrText": LONG, "userId": "u", "projectId": "p", "documentId": "d", "other": [1]}
    values = [whole, {**whole, "source": "paddleocr", "pageCount": 3, "confidence": 88.5}, {**whole, "ocrText": " \n"}, {**whole, "ocrText": "court"}, {**whole, "userId": ""}, {k: v for k, v in whole.items() if k != "ocrText"}, '{"ocrText": "x', None, "", "[1]", '"texte"', "null", {**whole, "pageCount": "trois"}]
    rows = requests.ocr_requests(bodies(spark, values)).orderBy("n").collect()
    codes = [r.reject_code for r in rows]
    assert codes[:6] == [None, None, "EMPTY_TEXT", "TEXT_TOO_SHORT", "MISSING_OWNER", "EMPTY_TEXT"] and codes[6:12] == ["MALFORMED_BODY"] * 6
    assert (rows[0].source, rows[0].document_id, rows[1].source, rows[1].page_count, rows[1].confidence) == ("pymupdf", "d", "paddleocr", 3, 88.5)
    assert requests.accepted(requests.ocr_requests(bodies(spark, values[:6]))).count() == 2 and requests.refused(requests.ocr_requests(bodies(spark, values[:6]))).count() == 4


def test_markdown_bodies(spark):
    whole = {"text": LONG, "document_id": None, "user_id": "u", "project_id": "p", "metadata": {"module": "x"}}
    values = [whole, {**whole, "text": " " * 60}, {**whole, "text": "x"}, {**whole, "project_id": None}, {**whole, "text": " " * 60, "user_id": ""}]
    rows = requests.markdown_requests(bodies(spark, values)).orderBy("n").collect()
    assert [r.reject_code for r in rows] == [None, "OCR_PROCESSING_ERROR", "TEXT_TOO_SHORT", "MISSING_OWNER", "MISSING_OWNER"]


def test_paged_bodies(spark):
    page = lambda text, score=None: {"index": 0, "markdown": text} | ({"confidence_scores": {"average_page_confidence_score": score}} if score is not None else {})
    whole = {"ocr_response": {"pages": [page(LONG, 90), page(" ", 10), page("fin", 80), page("sans")]}, "document_id": "d", "user_id": "u", "project_id": "p"}
    values = [whole, {**whole, "ocr_response": {"pages": []}}, {**whole, "ocr_response": {}}, {**whole, "ocr_response": {"pages": [page("court")]}}, {**whole, "user_id": None}, {"user_id": "u"}]
    rows = requests.paged_requests(bodies(spark, values)).orderBy("n").collect()
    assert [r.reject_code for r in rows] == [None, "NO_PAGES", "NO_PAGES", "TEXT_TOO_SHORT", "MISSING_OWNER", "NO_PAGES"]
    assert (rows[0].text, rows[0].confidence, rows[0].page_count) == (f"{LONG}\n\nfin\n\nsans", 85.0, 4)


def test_requests_become_chunks(spark):
    rows = requests.accepted(requests.ocr_requests(bodies(spark, [{"ocrText": LONG, "userId": "u", "projectId": "p"}] * 2)))
    got = sink.nested(structuring.chunks(structuring.clean(rows), keep=("user_id", "project_id", "source"))).collect()
    assert len({r.chunk_id for r in got}) == 2 and {(r.user_id, r.metadata.ocrSource, r.metadata.chunkIndex) for r in got} == {("u", "pymupdf", 0)}


def test_pages_of_chunks(spark):
    words = " ".join(f"mot{i}" for i in range(12))
    pages = [(0, f"# A\n{words}\n# B\n{words} b", (90.0,)), (1, " ", (1.0,)), (2, f"{words} c\n## C\n{words}", None), (5, f"# D\n{words} d", (70.0,))]
    rows = spark.createDataFrame([("d", "u", "p", pages), ("e", "u", "p", [])], f"document_id string, user_id string, project_id string, pages {adapters.PAGES}")
    sections = structuring.structured(adapters.paged_lines(rows), keep=("user_id", "project_id", "source", "ocr_confidence", "pages"))
    maps = sink.page_maps(sections).first()
    assert maps.page_number == {0: 0, 1: 0, 2: 2, 3: 5} and maps.confidence == {0: 90.0, 1: 90.0, 3: 70.0}
    out = sink.to_json(sink.nested(structuring.as_chunks(sections).drop("pages"), sink.page_maps(sections), with_source=True)).orderBy("chunk_id").collect()
    found = [json.loads(r.json) for r in out]
    assert [c["metadata"].get("confidence", "absent") for c in found] == [90.0, 90.0, "absent", 70.0] and [c["metadata"]["page_number"] for c in found] == [0, 0, 2, 5]
    assert list(found[0]) == ["chunk_id", "document_id", "user_id", "project_id", "content", "enriched_content", "metadata"] and found[0]["metadata"]["h2"] is None and found[0]["metadata"]["source"] == "mistral-ocr-3"
    assert "page_number" not in sink.nested(structuring.as_chunks(sections)).schema["metadata"].dataType.names


def test_settings(spark):
    lines = "\n".join(f"ligne {i} " + " ".join(["mot"] * 20) for i in range(12))
    docs = spark.createDataFrame([("a", f"# T\n{lines}", "x"), ("b", f"# T\n{lines}", "y")], "document_id string, text string, source string")
    given = {"max_chunk_chars": "300", "max_chunk_tokens": "many", "enforce_cap": "true", "sources": '["x"]', "rate_per_minute": "7"}
    try:
        assert settings.Settings.of(spark) == settings.Settings()
        for name, value in given.items():
            spark.conf.set(settings.PREFIX + name, value)
        found = settings.Settings.of(spark)
        assert found == settings.Settings(300, 512, True, 7, ("x",))
        rows = structuring.chunks_as_set(docs, found).collect()
        assert {r.document_id for r in rows} == {"a"} and len(rows) > 3 and max(len(r.content) for r in rows) <= 300
        assert structuring.chunks_as_set(docs, settings.Settings()).count() == 2
        for broken in ("x]", "{}", "[1]"):
            assert settings.json_list(broken, ["d"]) == ["d"]
    finally:
        for name in given:
            spark.conf.unset(settings.PREFIX + name)


def table(spark, rows):
    return spark.createDataFrame(rows, "document_id string, state string, updated_at int")


def test_states(spark, tmp_path):
    root = f"file://{tmp_path}/states"
    assert states.read(spark, root) is None and states.current_batch(spark, root) is None
    assert states.upsert(table(spark, [("a", "new", 1), ("b", "new", 1)]), root, 0)
    held = states.read(spark, root)
    assert states.upsert(table(spark, [("a", "done", 2), ("b", "old", 0), ("c", "new", 2)]), root, 1)
    now = {r.document_id: r.state for r in states.read(spark, root).collect()}
    assert now == {"a": "done", "b": "new", "c": "new"} and {r.state for r in held.collect()} == {"new"}  # a reader under way
    # the same batch again, and an older one
    assert not states.upsert(table(spark, [("a", "again", 9)]), root, 1) and not states.upsert(table(spark, [("a", "again", 9)]), root, 0)
    assert {r.document_id: r.state for r in states.read(spark, root).collect()} == now
    # a version that was left half-written is not seen, and is written anew
    table(spark, [("z", "half", 5)]).write.parquet(f"{root}/version=2")
    assert {r.document_id: r.state for r in states.read(spark, root).collect()} == now
    assert states.upsert(table(spark, []), root, 2) and states.current_batch(spark, root) == 2
    assert {r.document_id: r.state for r in states.read(spark, root).collect()} == now
    assert sorted(p.name for p in (tmp_path / "states").iterdir() if not p.name.startswith(".")) == ["CURRENT", "version=1", "version=2"]


def test_stream_of_states(spark, tmp_path):
    for n in range(2):
        table(spark, [("a", f"s{n}", n), (f"k{n}", "x", n)]).write.parquet(str(tmp_path / f"in/{n}"))
        stream = spark.readStream.schema("document_id string, state string, updated_at int").parquet(str(tmp_path / "in/*"))
        states.start(stream, f"file://{tmp_path}/t", str(tmp_path / "check")).awaitTermination(60)
    assert {r.document_id: r.state for r in states.read(spark, f"file://{tmp_path}/t").collect()} == {"a": "s1", "k0": "x", "k1": "x"}


@pytest.mark.parametrize("block", [1 << 25, 400])
def test_searches(spark, block):
    random = np.random.default_rng(1)
    matrix = np.round(random.normal(size=(120, 5)), 1)
    matrix[7] = matrix[3]
    matrix[11] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)] + [(None, [1.0] * 5), (200, None), (220, []), (240, [1.0]), (3, [1.0, None, 1.0, 1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    queries = table.filter("vec_id % 20 = 0 OR vec_id = 3 OR vec_id = 11")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and len(v) == 5 and None not in v and np.linalg.norm(v)}
    want = {q: sorted(((-round(float(unit[q] @ unit[i]), 6), i) for i in unit if i is not None)) for q in [*range(0, 120, 20), 3]}
    got = vectors.nearest(table, queries, 4, block).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted((q, k + 1, i) for q, near in want.items() for k, (_, i) in enumerate(near[:4]))
    near = vectors.within(table, queries, 0.6, block).collect()
    assert sorted((r.query_id, r.vec_id) for r in near) == sorted((q, i) for q, all_ in want.items() for s, i in all_ if -s >= 0.6)
    assert vectors.nearest(table, queries.filter("false")).count() == 0 and vectors.within(table.filter("false"), queries, 0.1).count() == 0


