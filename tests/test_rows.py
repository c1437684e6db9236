"""Rows stay apart whatever their ids, marks that are never closed cost nothing, and folds are linear."""

import time

import pytest
from pyspark.sql import functions as F

from folioworks.functions import metadata, numbers, tables, text
from folioworks.operators import context, keys, quality, structure
from folioworks.plans import structuring

LONG = " ".join(f"mot{i}" for i in range(12))
TABLE = "avant\n| P | M |\n| --- | --- |\n| T | {} |\naprès"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_tables_keep_every_row(spark):
    """Null and repeated ids: each row gets its own lines back."""
    rows = [(None, TABLE.format(1)), (None, TABLE.format(2)), ("a", TABLE.format(3)), ("a", TABLE.format(4)), ("a", None), (None, ""), ("b", "|"), ("b", "|-|-|")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "document_id string, text string, lines int")
    got = tables.tables_to_sentences(docs).collect()
    expected = [(i, None if t is None else "" if t in ("", "|", "|-|-|") else f"avant\nP : T. M : {t.split('| T | ')[1][0]}.\naprès", 7) for i, t in rows]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, expected))


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("| A | B |\n|---|---|\n| 1 | - |\n| - | - |\nx", "A : 1.\nx"), ("a|b|c", "a, b, c."), ("| seul |\n", "seul.\n"), ("| A | B |\n| A | 2 | 3 |", "A. B : 2. 3."),
        ("|:--|--:|\ntexte", "texte"), ("x\n| a | b |\ny\n| c | d |\n| 1 | 2 |", "x\na, b.\ny\nc : 1. d : 2."), ("pas | de table", "pas | de table"), ("||\n||", ""),
    ],
)
def test_table_cases(spark, value, expected):
    assert one(spark, value, tables.table_sentences) == expected


def test_keys(spark):
    texts = ["# T\n" + LONG, "# U\n" + LONG]
    rows = [(None, texts[0]), (None, texts[0]), ("", texts[1]), ("x", texts[0]), ("x", texts[1]), ("x", texts[1]), (None, None)]
    docs = spark.createDataFrame(rows, "document_id string, text string")
    got = keys.keyed(docs).collect()
    assert len(got) == len(rows) and len({(r.row_id, r.row_hash, r.row_copy) for r in got}) == len(rows)
    made = sorted(r.document_id for r in got if r.row_id == "")
    assert len(set(made)) == 4 and all(i.startswith("doc-") for i in made) and sum(i.endswith("-2") for i in made) == 1
    again = keys.keyed(docs.repartition(5)).collect()
    assert sorted(tuple(r) for r in again if r.text) == sorted(tuple(r) for r in got if r.text)
    chunks = structuring.chunks(docs).collect()
    assert len(chunks) == 6 and None not in {c.chunk_id for c in chunks} and sum(c.document_id == "x" for c in chunks) == 3
    assert structure.has_headers(docs).count() == len(rows)
    assert sorted(r.reject_code for r in structuring.rejects(docs.withColumns({"user_id": F.lit("u"), "project_id": F.lit("p")})).collect()) == ["EMPTY_TEXT"]


MARKS = ["<a", "![", "{", "\\mathrm{", "<table>", "<table", "picture [", "=", "![](", "![x](", "]", "<table><tr>", "<table><tr><td>", "1", "**=", "| ", "$", "<br", "> "]


def cleaned(t):
    return text.clean_latex(text.html_tables_to_markdown(text.clean_html_markers(F.concat(t, F.lit(" intentionally")))))


@pytest.mark.parametrize("mark", MARKS)
def test_unclosed_marks(spark, mark):
    """A million openers, each to the end of the text in vain."""
    one(spark, mark, cleaned)
    began = time.time()
    value = mark * (1_000_000 // len(mark)) + "x"
    assert one(spark, value, cleaned) is not None and one(spark, value, text.clean_page) is not None
    assert time.time() - began < 30


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("a **==> picture [10 x 20] intentionally omitted <==** b", "a b"), ("picture [x] picture [y] intentionally omitted", "picture [x]"), ("***=> picture [x] intentionally  omitted", "*"), ("picture [ a", "picture [ a"),
        ("![a](b)![c]d ![e]() ![f](g", "![c]d ![e]() ![f](g"), ("![a ![b](c) d", "d"), ("a < b <i>c</i> <d", "a < b c <d"), ("x <BR> y <brx> z</br>", "x y <brx> z"), ("![a]![b](c)", "![a]"), ("<a <b> c", "c"),
    ],
)
def test_markers(spark, value, expected):
    assert one(spark, value, text.clean_html_markers) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [("{a{b}c}", "a{bc}"), ("{a} {b", "a {b"), ("\\mathrm{x} \\mathrm{y", "x \\mathrm{y"), ("12 \\% et $5 \\%$ de 12\\%", "12% et 5% de 12%"), ("$a$ $b", "a $b"), ("{}x\\\\", "x"), ("\\mathrm{}", "\\mathrm")],
)
def test_latex_marks(spark, value, expected):
    assert one(spark, value, text.clean_latex) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("<table><tr><td>a</td></tr></table><table>", "| a |\n|---|<table>"), ("<table>x</table>", "<table>x</table>"), ("<table <tr><td>1</td></tr></table>", "| 1 |\n|---|"), ("<table </table>", "<table </table>"),
        ("<table><tr><td>1<td>2</td></tr><tr></table>y", "| 1<td>2 |\n|---|y"), ("a<table></table>b<table><tr></tr></table>", "a<table></table>b|  |\n||"),
    ],
)
def test_html_tables(spark, value, expected):
    assert one(spark, value, text.html_tables_to_markdown) == expected


def test_repeated_lines_go(spark):
    value = "\n".join(["En-tête  ", "corps un", "En-tête", "court", " En-tête", "court", "x", "En-tête", "court", "court", ""])
    assert one(spark, value, text.remove_repeated_lines) == "corps un\ncourt\ncourt\nx\ncourt\ncourt\n"
    many = "\n".join(f"ligne numéro {i % 25_000}" for i in range(100_000)) + "\nfin"
    began = time.time()
    assert one(spark, many, text.remove_repeated_lines) == "fin"
    assert time.time() - began < 30


def test_names_before_siren(spark):
    """Windows of 100 characters overlap, count characters beyond the first plane as one, and start with the text."""
    first = "Maison Dupont Freres, SIREN 123456789 et SIREN 987654321"
    assert [p["name"] for p in one(spark, first, metadata.parties)] == ["Maison Dupont Freres"]
    far = "Alpha Beta Gamma " + "😀" * 100 + " SIREN 123456789"
    near = "Alpha Beta Gamma," + "😀" * 80 + " SIREN 123456789"
    assert one(spark, far, metadata.parties) == [] and [p["name"] for p in one(spark, near, metadata.parties)] == ["Alpha Beta Gamma"]


@pytest.mark.parametrize("x", [0.35, 0.45, 1.25, 0.05, 0.15, 2.5, 3.0, 99.95, 6.25, 0.3, 5.15, 1.9999999, 12.349999999999998, 0.0, 1 / 3, 7.65, 29.449999999999996])
def test_one_decimal(spark, x):
    row = spark.createDataFrame([(x,)], "x double").select(numbers.one_decimal(F.col("x")).alias("s"), (numbers.tenths(F.col("x")) / 10).alias("r")).first()
    assert row.s == f"{x:.1f}" and row.r == round(x, 1)


def packed(paragraphs, limit=1500):
    parts, cur = [], ""
    for p in paragraphs:
        if cur and len(cur + p + "\n\n") > limit:
            parts.append(cur.strip())
            cur = ""
        cur += p + "\n\n"
    return [*parts, cur.strip()]


def test_folds_are_linear(spark):
    paragraphs = [" ".join(["mot"] * (1 + i * 7919 % 400)) for i in range(2000)] + [" ".join(["mot"] * 15)] * 100_000
    rows = spark.createDataFrame([("\n\n".join(paragraphs),)], "c string")
    began = time.time()
    got = rows.select(F.explode(structure.split_paragraphs(F.col("c"))).alias("p")).select("p.*").orderBy("part").collect()
    assert [r.content for r in got] == [p for p in packed(paragraphs) if len(p.split()) >= 10]
    n = 100_000
    sections = spark.range(n).select(
        F.lit("d").alias("document_id"), F.col("id").alias("section_id"), F.floor(F.col("id") / 1000).cast("string").alias("h1"), F.lit(None).cast("string").alias("h2"), F.lit(None).cast("string").alias("h3"),
        F.lit("t").alias("title"), F.lit("x").alias("content"), (10 + F.col("id") * 7919 % 60).cast("int").alias("word_count"), F.lit(1).alias("token_count"), F.lit(n).alias("n_sections"),
    )
    merged = structure.consolidate(sections).orderBy("section_id").select("section_id", "word_count").collect()
    expected, i = [], 0
    words, first = [10 + k * 7919 % 60 for k in range(n)], [k // 1000 for k in range(n)]
    while i < n:
        total, j = words[i], i + 1
        while total < 50 and j < n and first[j] == first[i] and total + words[j] <= 400:
            total, j = total + words[j], j + 1
        expected.append((i, total))
        i = j
    assert [tuple(r) for r in merged] == expected
    assert time.time() - began < 120


def test_cap(spark):
    lines = "\n".join(f"ligne {i} " + " ".join(["mot"] * 40) for i in range(30))
    docs = spark.createDataFrame([("d", f"# T\n## A\n{lines}\n## B\n{LONG}")], "document_id string, text string")
    whole, cut = (structure.chunk(docs, enforce_cap=x).orderBy("position").collect() for x in (False, True))
    assert len(whole) == 2 and [r.position for r in cut] == list(range(1, len(cut) + 1)) and max(len(r.content) for r in cut) <= 1500
    assert [r.title for r in cut[:2]] == ["T > A", "T > A (suite 1)"] and cut[1].h3 == "A (suite 1)" and cut[-1].title == "T > B"
    assert "\n".join(r.content for r in cut[:-1]) == whole[0].content


def listed(rows):
    """Siblings pair by pair, and whether one is no title."""
    titles = {r.title for r in rows}
    out = []
    for s in rows:
        own = []
        for t in rows:
            if (s.title, s.h1, s.h2, s.h3, s.content) == (t.title, t.h1, t.h2, t.h3, t.content):
                continue
            if s.h3 and t.h3 and (s.h1, s.h2) == (t.h1, t.h2):
                own.append(t.h3)
            elif s.h2 and t.h2 and not s.h3 and not t.h3 and s.h1 == t.h1:
                own.append(t.h2)
            elif s.h1 and t.h1 and not s.h2 and not t.h2:
                own.append(t.h1)
        out.append((own, any(x not in titles for x in own)))
    return out


def test_siblings_by_pairs(spark):
    import random

    draw = random.Random(4)
    docs = [(f"d{k}", "\n".join(f"{'#' * draw.randrange(1, 4)} {draw.choice(['A', 'B', 'C', '*'])}\n{LONG} {draw.choice('xy')}" for _ in range(draw.randrange(1, 14)))) for k in range(40)]
    rows = structure.chunk(spark.createDataFrame(docs, "document_id string, text string"))
    found = context.unknown_siblings(context.siblings(rows)).select(*keys.KEY, "position", F.col("unknown_siblings").alias("by_list"), "siblings")
    both = context.unknown_siblings(rows).join(found, [*keys.KEY, "position"]).orderBy("document_id", "position").collect()
    groups = {}
    for r in both:
        groups.setdefault(r.document_id, []).append(r)
    seen = set()
    for own in groups.values():
        for r, (siblings, unknown) in zip(own, listed(own), strict=True):
            assert r.siblings == siblings and r.by_list == unknown == r.unknown_siblings
            seen.add(unknown)
    assert seen == {True, False}
    members = context.sibling_groups(rows)
    assert members.filter("beside = 'first'").select(F.sum(F.size("members"))).first()[0] == rows.filter("coalesce(h1, '') <> '' AND coalesce(h2, '') = ''").count()


def test_a_document_of_many_sections(spark):
    """20 000 sections side by side: scored within a minute, no list of siblings on any row."""
    docs = spark.createDataFrame([("d", "# T\n" + "\n".join(f"## s{i}\n{LONG}" for i in range(20_000)))], "document_id string, text string")
    began = time.time()
    docs = keys.keyed(docs)
    about = docs.select(*keys.KEY, F.lit("contrat").alias("document_type"), F.lit("Titre").alias("document_title"), F.lit("R").alias("document_reference"), F.lit(1).alias("n_parties"))
    row = quality.score(about, structuring.structured(docs)).first()
    assert time.time() - began < 60
    issues = {i.message: i for i in row.issues}
    assert issues["20000 sections trop courtes (<50 mots)"].sections_affected == [1, 2, 3, 4, 5]
    assert "20000 sections avec références siblings invalides" in issues
