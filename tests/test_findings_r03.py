"""Findings of round 3: references that are cut off, and work that is done once."""

from pyspark.sql import functions as F

from folioworks.functions.text import clean_html_entities


def test_references_that_are_cut_off_stay(spark):
    rows = spark.createDataFrame([(1, "a &amp</title> &amp; &copyx; &eacute; &#233; &#xe9 &quo"), (2, None), (3, "&copy;&middot;&quot;")], "id int, t string")
    got = dict(rows.select("id", clean_html_entities(F.col("t"), closed=True)).collect())
    assert got == {1: "a &amp</title> & &copyx; é é &#xe9 &quo", 2: None, 3: '©·"'}
    whole = dict(rows.select("id", clean_html_entities(F.col("t"))).collect())
    assert whole[1] == "a &</title> & ©x; é é é &quo"


def _optimized(spark, name):
    from folioworks.queries import QUERIES

    from .compare import DATA

    return QUERIES[name](spark, str(DATA / "sf0.001"))._jdf.queryExecution().optimizedPlan().toString()


def test_headings_are_told_once(spark):
    # six patterns and guards in a pass; headings of both adapters
    assert _optimized(spark, "header_lines").count("RLIKE") <= 12


def test_words_are_counted_and_ranked_once(spark):
    assert _optimized(spark, "keywords_top5").count("regexp_extract_all") <= 2


def test_sections_are_made_once(spark):
    assert [_optimized(spark, name).count("Relation [") for name in ("outline_nodes", "outline_depth", "outline_tree", "consolidated")] == [1, 1, 1, 1]


def test_similarities_are_bounded(spark, monkeypatch):
    from folioworks.operators import vectors

    rows = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    whole = sorted(vectors.nearest(rows, rows).collect())
    monkeypatch.setattr(vectors, "SLICE_QUERIES", 7)
    assert sorted(vectors.nearest(rows, rows).collect()) == whole and len(whole) == 200


def test_reports_make_sections_once(spark):
    # documents with their metadata, and sections: one table each
    plan = _optimized(spark, "score_report")
    assert plan.count("Relation [") == 2
    # keywords are counted, not ranked: nothing is sorted for them but lines and examples
    assert _optimized(spark, "q_scores").count("sort_array") == _optimized(spark, "sections").count("sort_array")


def test_signs_are_those_of_every_word(spark):
    import re

    from folioworks.fixed_values import NOISE_WORDS
    from folioworks.operators.quality import section_signs

    texts = [
        "", " ", "mot", "-- :-- | ``` *** --- a-- --\u00a0--", "AB cd EF gh IJ", "AB cd EF gh", "Ab cd ef gh ij", "12 34 mot mot mot", "1 mot mot mot mot 2\u20283\u00a04",
        "x" * 20 + " " + "y" * 21 + " un deux trois", "x" * 21 + " " + "é" * 21 + " un deux trois", "\U0001d400\U0001d401 \U00010400b \U0001f600 mot mot", "ⅫⅫ Ⓐ mot mot mot", "\\\\a ^^ _^ __ || ### \x01\n\\frac{ \\A{ ##",
        "ǅ ǅ mot mot mot", "L'ÉTAT D'URGENCE N°12 a b c d", "a\u0301B C\u0301 d e f", "\ufeffA \u200bB c d e",
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, content string")
    capital = lambda t: sum(c.isupper() for c in t)
    space = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

    def plain(text):
        words = [w for w in re.split(space + "+", text) if w]
        suspects = sum(len(w) > 20 or not any(c.isalpha() for c in w) or capital(w) > 0.5 * len(w) for w in words)
        noise = sum(len(re.findall(p, text)) for p in (r"\\{2,}", r"[\^_]{2,}", r"\|{2,}", "#{3,}", r"[\x00-\x1f]"))
        return noise, len(re.findall(r"\\[a-z]+\{", text)), sum(w in NOISE_WORDS for w in words), suspects, len(words) >= 5 and suspects / len(words) > 0.3

    got = {r.i: tuple(r)[2:] for r in section_signs(rows).select("i", "content", "noise", "latex", "noise_words", "suspects", "gibberish").collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)} | {-1: (0, 0, 0, 0, False)}


def test_reports_have_the_metrics_of_sections(spark):
    from folioworks.operators import quality, statistics
    from folioworks.plans import structuring

    docs = spark.createDataFrame([("a", "# Un\n## Prix\n" + "montant total des travaux prix " * 4 + "\n## Lot\n" + "garantie assurance " * 9), ("b", ""), ("c", None), ("a", "Article 1\n" + "droit " * 12), (None, "# X\n" + "mot " * 30)], "document_id string, text string")
    from folioworks.operators.keys import KEY, keyed

    docs = keyed(docs)
    about = docs.select(*KEY, F.lit("plan").alias("document_type"), F.lit("Titre").alias("document_title"), F.lit("r").alias("document_reference"), F.lit(1).alias("n_parties"))
    ranked = structuring.structured(docs)
    told = quality.report(about, ranked).select(*KEY, "metrics.*")
    alone = statistics.detailed_metrics(docs, ranked)
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows.select(*KEY, *[c for c in alone.columns if c not in KEY]).collect())
    assert text(told) == text(alone) and told.columns == alone.columns
    whole = lambda rows: sorted(map(str, quality.report(about, rows).collect()))
    assert whole(structuring.structured(docs, ranked=False)) == whole(ranked)


def test_unranked_keywords_are_as_many(spark, monkeypatch):
    from folioworks.operators import structure

    texts = ["", None, "mots courts", "travaux garantie travaux prix délai société", "dans cette entre avant après aussi construction", "immeuble_ 1immeuble immeuble, Immeuble façade\u0301 façades bâtiments ouvrages permis", "alpha bravo charlie deltas echos foxtrot " * 3]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string").cache()
    count = lambda made: dict(made.select("i", F.size("keywords")).collect())
    words = lambda: dict(structure.unranked_keywords(rows).select("i", "keywords").collect())
    whole, ranked = words(), count(structure.keywords(rows))
    assert {i: len(k) for i, k in whole.items()} == ranked
    for n in (1, 7, 20, 33, 41, 60):
        monkeypatch.setattr(structure, "_BEGINNING", n)
        assert words() == whole
