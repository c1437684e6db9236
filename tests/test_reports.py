"""Reports of quality: literal cases of every rule, examples in issues, documents that cannot be scored."""

import json

from pyspark.sql import functions as F

from folioworks.operators import context, keys, quality, statistics, structure
from folioworks.plans import structuring

SECTION = "document_id string, position int, title string, h1 string, h2 string, h3 string, content string, word_count int, token_count int, type string, keywords array<string>, breadcrumb string, parent string, siblings array<string>"
ABOUT = "document_id string, document_type string, document_title string, document_reference string, n_parties int"


def section(doc="d", position=1, h1="T", h2=None, h3=None, content=None, words=60, keywords=("alpha", "bravo", "charlie"), breadcrumb="Doc > T", parent=None, siblings=(), title=None, kind="general"):
    headings = [h for h in (h1, h2, h3) if h]
    return (doc, position, title or " > ".join(headings), h1, h2, h3, content if content is not None else f"mot{position} " * 6, words, 20, kind, None if keywords is None else list(keywords), breadcrumb, parent, list(siblings))


def scored(spark, sections, about=(("d", "contrat", "Titre long", "R1", 1),)):
    rows = quality.score(spark.createDataFrame(list(about), ABOUT), spark.createDataFrame(sections, SECTION)).collect()
    return {r.document_id: r for r in rows}


def good(n=12, **more):
    return [section(position=i + 1, h2=f"S{i}", parent="T", **more) for i in range(n)]


def messages(row):
    return {i.message: i for i in row.issues}


def test_a_good_document(spark):
    row = scored(spark, good())["d"]
    assert (row.overall, row.grade, row.needs_review, row.issues, row.recommendations) == (100.0, "Excellent", False, [], ["✅ Document bien traité - aucune action requise"])


def test_positions_and_order(spark):
    sections = good()
    rows = spark.createDataFrame([(*s, i) for i, s in enumerate(sections[1:] + sections[:1])], SECTION + ", place int")
    row = quality.score(spark.createDataFrame([("d", "contrat", "Titre long", "R1", 1)], ABOUT), rows, order=("place",)).first()
    assert row.coherence == 7.0 and messages(row)["Positions de sections non séquentielles"].severity == "error"


def test_examples_are_the_first(spark):
    sections = [section(position=i + 1, h2=f"S{i}", parent="T", words=10 if i % 2 else 600) for i in range(20)]
    row = scored(spark, sections)["d"]
    found = messages(row)
    assert found["10 sections trop courtes (<50 mots)"].sections_affected == [2, 4, 6, 8, 10] and found["10 sections trop courtes (<50 mots)"].impact == "-3.0 points"
    assert found["10 sections très longues (>500 mots)"].sections_affected == [1, 3, 5, 7, 9]
    assert "📝 Vérifier les sections courtes : 2, 4, 6, 8, 10" in row.recommendations


def test_hierarchy_messages(spark):
    sections = [*good(9), section(position=10, h1=None, h2="A", h3=None, parent="x"), section(position=11, h1=None, h2=None, h3="B"), section(position=12, h1=None, h2="C", h3="D", parent="C"), section(position=13, h1="T", h3="E")]
    issue = messages(scored(spark, sections)["d"])["4 incohérences hiérarchiques"]
    assert issue.details == ["Section 10: H2 sans H1", "Section 11: H3 sans H2", "Section 12: H2 sans H1"] and issue.impact == "-4 points"


def test_ocr_rules(spark):
    noise = section(position=1, h2="S", parent="T", content="a || b ^^ c ## d ### \\\\ e\x01" + " | --" * 3, words=12)
    latex = section(position=2, h2="R", parent="T", content=" ".join(["\\frac{x}"] * 6), words=60)
    odd = section(position=3, h2="Q", parent="T", content="ABC DEF 123 mot mot", words=60)
    row = scored(spark, [noise, latex, odd, *[section(position=i, h2=f"S{i}", parent="T") for i in range(4, 14)]])["d"]
    found = messages(row)
    assert found["5 patterns de bruit détectés (LaTeX, symboles corrompus)"].impact == "-2.5 points" and found["5 patterns de bruit détectés (LaTeX, symboles corrompus)"].severity == "warning"
    assert found["6 commandes LaTeX résiduelles détectées"].impact == "-1.2 points" and found["2 sections avec du texte incohérent"].impact == "-1.0 points"


def test_content_rules(spark):
    sections = [section(position=i + 1, h2=f"S{i}", parent="T", keywords=(), words=1000 if i == 5 else 51, breadcrumb="x", siblings=["nulle part"]) for i in range(12)]
    row = scored(spark, sections)["d"]
    assert {"12 sections sans mots-clés", "Distribution très inégale des longueurs de sections", "Faible densité d'information (avg 0.0 mots-clés/section)", "12 breadcrumbs invalides", "12 sections avec références siblings invalides"} <= set(messages(row))
    assert row.content == 15 - 0.3 - 12 * 0.2 - 3 - 2 and row.coherence == 10 - 3 - 2


def test_half_even_means(spark):
    """A mean of 1.25 keywords is shown as 1.2, one of 1.75 as 1.8, 0.35 as its binary value says."""
    for total, n, shown in ((15, 12, "1.2"), (21, 12, "1.8"), (7, 20, "0.3"), (9, 20, "0.5")):
        sections = [section(position=i + 1, h2=f"S{i}", parent="T", keywords=["a"] * (total // n + (i < total % n))) for i in range(n)]
        assert f"Faible densité d'information (avg {shown} mots-clés/section)" in messages(scored(spark, sections)["d"])


def test_report(spark):
    about = [("d", "contrat", "Titre long", "R1", 1), ("vide", None, None, None, None), ("casse", "contrat", "Titre long", "R1", 1)]
    sections = [*good(kind="legal"), section(position=13, kind="risk", words=7), section(doc="casse", keywords=None), section(doc="casse", position=2)]
    rows = {r.document_id: r for r in quality.report(spark.createDataFrame(about, ABOUT), spark.createDataFrame(sections, SECTION)).collect()}
    d = rows["d"]
    assert d.scores["ocr_quality"] == 30.0 and set(d.scores) == {"ocr_quality", "structure_quality", "metadata_completeness", "content_quality", "coherence"}
    assert d.metrics.asDict() == {"n_sections": 13, "n_words": 727, "avg_words": 55.9, "min_words": 7, "max_words": 60, "sections_by_type": {"legal": 12, "risk": 1}, "hierarchy_depth": 2, "n_h1": 13, "n_h2": 12, "n_h3": 0, "avg_keywords": 3.0}
    empty = rows["vide"]
    assert empty.metrics.n_sections == 0 and empty.metrics.sections_by_type == {} and empty.metrics.hierarchy_depth == 0 and empty.grade == "Mauvais" and empty.overall_score == 15.0
    assert [i.severity for i in empty.issues] == sorted((i.severity for i in empty.issues), key=["error", "warning", "info"].index)
    broken = rows["casse"]
    assert (broken.overall_score, broken.grade, broken.needs_review, broken.scores, broken.metrics) == (0.0, "Erreur", True, {}, None)
    assert broken.issues[0].category == "system" and "keywords" in broken.issues[0].message and broken.recommendations == ["Erreur lors de l'évaluation - vérifier les logs"]


def test_repeated_ids_are_scored_apart(spark):
    texts = ["# Contrat\n" + "\n".join(f"## s{i}\n" + "mot " * 60 for i in range(n)) for n in (3, 12)]
    docs = keys.keyed(spark.createDataFrame([("x", t) for t in texts], "document_id string, text string"))
    about = docs.select(*keys.KEY, F.lit("contrat").alias("document_type"), F.lit("Contrat").alias("document_title"), F.lit("R").alias("document_reference"), F.lit(1).alias("n_parties"))
    sections = structuring.structured(docs)
    got = sorted((r.structure, r.document_id) for r in quality.score(about, sections).collect())
    assert got == [(20.0, "x"), (25.0, "x")]
    assert sorted(r.n_sections for r in statistics.detailed_metrics(docs, sections).collect()) == [3, 12]
    assert sorted(r.n_chunks for r in statistics.response_totals(docs, sections).collect()) == [3, 12]


def test_outline_tree(spark):
    words = " ".join(f"mot{i}" for i in range(12))
    docs = spark.createDataFrame([("d", "\n".join(f"{h}\n{words}" for h in ("# A", "## B", "### C", "### C", "## D", "# E", "# A", "## B"))), ("e", words)], "document_id string, text string")
    rows = context.outline_tree(context.outline(structure.chunk(docs))).select(F.to_json("nodes").alias("n")).collect()
    leaf = lambda title, position: {"level": 3, "title": title, "position": position, "children": []}
    assert [json.loads(r.n) for r in rows] == [[
        {"level": 1, "title": "A", "position": 1, "children": [{"level": 2, "title": "B", "position": 2, "children": [leaf("C", 3), leaf("C", 4)]}, {"level": 2, "title": "D", "position": 5, "children": []}]},
        {"level": 1, "title": "E", "position": 6, "children": []},
    ]]
