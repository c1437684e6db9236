"""Literal cases of the structuring functions."""

import pytest
from pyspark.sql import functions as F

from folioworks.functions import metadata, text
from folioworks.functions.tables import tables_to_sentences
from folioworks.operators import context, quality, statistics, structure
from folioworks.plans import structuring
from folioworks.queries import QUERIES
from folioworks.sources import adapters


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("before", "after"),
    [(r"Permis n^{\circ} 123", "Permis n° 123"), (r"TVA de 5 \% applicable", "TVA de 5% applicable"), (r"Texte$\quad$suite", "Texte suite"), (r"\square Case à cocher", "☐ Case à cocher"), (r"\mathrm{TOTAL}", "TOTAL")],
)
def test_latex(spark, before, after):
    assert one(spark, before, text.clean_latex) == after


def test_cleaning(spark):
    assert one(spark, "Titre <br> suite <b>x</b> ![a](b.png) | | | fin", text.clean_html_markers) == "Titre \n suite x fin"
    assert one(spark, "a &amp; b&nbsp;c", text.clean_html_entities) == "a & b\xa0c"
    assert one(spark, "# A ## B", text.split_inline_headers) == "# A\n## B"
    assert one(spark, "a\x07  b\n\n\n\nc", text.clean_noise) == "a b\n\nc"
    assert one(spark, "entete1\nx\n" * 4, text.repeated_lines) == ["entete1"]
    table = "x <table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table> y"
    assert one(spark, table, text.html_tables_to_markdown) == "x | a | b |\n|---|---|\n| 1 | 2 | y"
    assert one(spark, None, text.clean_noise) is None


def test_tables(spark):
    docs = spark.createDataFrame([("d", "avant\n| P | M |\n| --- | --- |\n| T | 5 |\n| - | 6 |\naprès\n| seul | x |"), ("e", "rien"), ("f", None)], "document_id string, text string")
    out = {r.document_id: r.text for r in tables_to_sentences(docs).collect()}
    assert out == {"d": "avant\nP : T. M : 5.\nM : 6.\naprès\nseul, x.", "e": "rien", "f": None}


@pytest.mark.parametrize(
    ("value", "column", "expected"),
    [
        ("DEVIS ESTIMATIF travaux", metadata.document_type, "devis"), ("Texte quelconque sans mot-clé", metadata.document_type, "document"),
        ("# " + "A" * 200, metadata.title, "A" * 150), ("", metadata.title, "Document sans titre"), ("Le bien se situe à MONTEVRAIN dans le département", metadata.location, "MONTEVRAIN"),
        ("du 08/01/1993", metadata.date, "08/01/1993"), ("du 1993-01-08", metadata.date, "1993-01-08"), ("SIREN sous le numéro 123456789", metadata.reference, "123456789"),
    ],
)
def test_metadata(spark, value, column, expected):
    assert one(spark, value, column) == expected


def test_parties(spark):
    found = one(spark, "Société dénommée ACME CORP au capital de 1 euro. Chez Dupont Freres SA, SIREN 123456789", metadata.parties)
    assert [(p["role"], p["name"]) for p in found][0] == ("vendor", "ACME CORP")
    assert any(p["role"] == "other" for p in found)


LONG = " ".join(f"mot{i}" for i in range(12))


def chunked(spark, value):
    docs = spark.createDataFrame([("d", value)], "document_id string, text string")
    return structure.chunk(docs).orderBy("position").collect()


def test_headings(spark):
    rows = chunked(spark, f"# CONTRAT\n{LONG}\n## A\n{LONG}\n### B\n{LONG}\n## C\n{LONG}\n# SOMMAIRE\n{LONG}\n## X\n{LONG}\n# FIN\ncourt")
    assert [r.title for r in rows] == ["CONTRAT", "CONTRAT > A", "CONTRAT > A > B", "CONTRAT > C"]
    assert chunked(spark, f"1/ SITUATION DU TERRAIN\n{LONG}")[0].h1 == "SITUATION DU TERRAIN"
    assert chunked(spark, f"Article 1.1 - Objet\n{LONG}")[0].h2 == "Article 1.1 – Objet"
    assert chunked(spark, f"ARTICLE Ua 1 - X\n{LONG}")[0].h2 == "Article U – a 1 - X"
    assert chunked(spark, "") == [] and chunked(spark, None) == []


def test_rejects(spark):
    docs = spark.createDataFrame([("a", "word " * 100, "u", "p"), ("b", " ", "u", "p"), ("c", "x", "u", "p"), ("d", "# T\n" + "mot " * 30, "u", None), ("e", "# T\n" + "mot " * 30, "u", "p")], "document_id string, text string, user_id string, project_id string")
    found = {r.document_id: r.reject_code for r in structuring.rejects(docs).collect()}
    assert found == {"a": "STRUCTURE_NOT_DETECTED", "b": "EMPTY_TEXT", "c": "TEXT_TOO_SHORT", "d": "MISSING_OWNER"}


def test_types_and_keywords(spark):
    assert one(spark, "Le prix et le montant en euros", structure.section_type) == "financial"
    assert one(spark, "bonjour", structure.section_type) == "general"
    rows = spark.createDataFrame([("d", 1, "avoir avoir avoir projet projet construction")], "document_id string, section_id int, content string")
    assert structure.keywords(rows).first()["keywords"] == ["projet", "construction"]


def test_split_and_consolidate(spark):
    paragraph = " ".join(["mot"] * 200)
    rows = spark.createDataFrame([("d", "\n\n".join([paragraph] * 3), "T", "H2", None)], "document_id string, content string, title string, h2 string, h3 string")
    # 799 characters each and blank lines: two are over 1500
    parts = [(r.part, r.title, r.h3) for r in structure.split_large(rows).orderBy("part").collect()]
    assert parts == [(0, "T", None), (1, "T (suite 1)", "H2 (suite 1)"), (2, "T (suite 2)", "H2 (suite 2)")]
    many = "# A\n" + "".join(f"## s{i}\n{LONG}\n" for i in range(60))
    sections = structure.chunk(spark.createDataFrame([("d", many)], "document_id string, text string"))
    merged = structure.consolidate(sections)
    assert merged.agg(F.sum("word_count")).first()[0] == 720
    assert [r.word_count for r in merged.orderBy("position").collect()] == [60] * 12


def test_context(spark):
    docs = spark.createDataFrame([("d", f"# T\n## A\n{LONG}\n## B\n{LONG} b\n### C\n{LONG} c")], "document_id string, text string")
    rows = context.siblings(structuring.structured(docs)).orderBy("position").collect()
    assert [r.siblings for r in rows] == [["B"], ["A"], []]
    assert rows[2].breadcrumb == "T > T > B > C" and rows[2].parent == "B"
    chunk = structuring.chunks(docs).orderBy("position").collect()[2]
    assert chunk.chunk_id == "chunk-d-002" and chunk.enriched_content.startswith("[Document: T | Section 3/3]\n[T > T > B > C]\n\nmot0")
    assert context.outline_depth(context.outline(structure.chunk(docs))).first().depth == 3


def test_quality_without_sections(spark):
    docs = spark.createDataFrame([("d", "unknown", "", None, 0)], "document_id string, document_type string, document_title string, document_reference string, n_parties int")
    none = context.siblings(structuring.structured(spark.createDataFrame([], "document_id string, text string")))
    row = quality.score(docs, none, context.outline(none)).first()
    assert row.overall < 50 and row.grade == "Mauvais" and row.needs_review


def test_issues(spark):
    """Severities, messages and order of a short document with short sections."""
    docs = spark.createDataFrame([("d", f"# T\n## A\n{LONG}\n## B\n{LONG} b")], "document_id string, text string")
    sections = context.siblings(structuring.structured(docs))
    about = spark.createDataFrame([("d", "contrat", "Titre", "R1", 1)], "document_id string, document_type string, document_title string, document_reference string, n_parties int")
    row = quality.score(about, sections).first()
    assert [(i.severity, i.message, i.impact) for i in row.issues][:2] == [
        ("error", "Trop peu de sections (2), document mal découpé", "-5 points"),
        ("warning", "2 sections trop courtes (<50 mots)", "-0.6 points"),
    ]
    assert "🔴 1 erreur(s) critique(s) détectée(s) - revue manuelle nécessaire" in row.recommendations and "📝 Vérifier les sections courtes : 1, 2" in row.recommendations
    assert one(spark, "x" + " " * 1_000_000 + "y", text.strip) == "x" + " " * 1_000_000 + "y"


def test_pages(spark):
    pages = [(0, "![x](y) a $b$", (90.0,)), (1, "  ", (10.0,)), (2, "c", None)]
    rows = spark.createDataFrame([("d", "u", "p", pages)], f"document_id string, user_id string, project_id string, pages {adapters.PAGES}")
    got = adapters.paged_texts(rows).first()
    assert got.text == "a b\n\nc" and got.confidence == 90.0


def test_statistics(spark):
    samples = spark.createDataFrame([("op", float(i), i, True, i) for i in range(5)], "operation string, duration_ms double, ts int, success boolean, sample_id int")
    assert statistics.metric_summary(samples, kept=2).first().avg_ms == 3.5


def test_stream(spark, tmp_path):
    from folioworks.streaming import micro_batches

    spark.createDataFrame([("d", f"# T\n{LONG}")], "document_id string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("document_id string, text string").parquet(str(tmp_path / "in"))
    query = micro_batches.start(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_source_md_is_bounded(spark, tmp_path):
    """Long documents hold a fixed range of ids, all rows among them; merging stays within one."""
    rows = [(i, f"mot{i} deux trois quatre cinq six sept huit neuf dix\nonze{i} un deux trois quatre cinq six sept huit neuf dix", "hot" if i % 3 else None) for i in range(2400)]
    rows += [(None, f"sans numéro {i}", "hot") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.document_id: r.text for r in adapters.source_md(spark, str(tmp_path)).collect()}
    assert {k for k in found if "text" not in k} == {"hot:0", "hot:1", "hot:2", "0", "1", "2"} and len(found) == 26
    for i, text, source in rows[:2400]:
        assert f"# Document {i}\n## L{i}.0\n{text.splitlines()[0]}\n" in found[f"{'hot:' if source else ''}{i // 1000}"] + "\n"
    assert all(sum(f"sans numéro {i}" in t.splitlines() for t in found.values()) == 1 for i in range(20))
    merged = QUERIES["consolidated"](spark, str(tmp_path)).agg(F.sum("word_count"), F.count_distinct("document_id"), F.max("n_sections")).first()
    whole = structure.chunk(adapters.source_md(spark, str(tmp_path))).agg(F.sum("word_count"), F.count_distinct("document_id")).first()
    assert tuple(merged[:2]) == tuple(whole) and merged[2] <= 2 * adapters.SOURCE_IDS
