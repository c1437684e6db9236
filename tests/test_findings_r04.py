"""Findings of round 4: sections are cut within the row, and texts are looked through only where a sign calls for it."""

import re

from pyspark.sql import functions as F

from folioworks.functions import text
from folioworks.operators import structure

SPACE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
TEXTS = [
    None, "", "\n\n \n", "sans titre " * 6, "\n\n  \n" + "avant tout titre " * 5 + "\n\n# Un\n\n\nligne une de dix mots " * 3 + "\n  \nfin",
    "# Sommaire\n" + "mot " * 12 + "\n## Sous le sommaire\n" + "mot " * 12 + "\n# Un\n" + "mot " * 12,
    "### Trois\n" + "a b " * 6 + "\n## Deux\n" + "c d " * 6 + "\n### Trois\n" + "e f " * 6 + "\n# Un\n" + "g h " * 6 + "\n### Trois\n" + "i j " * 6 + "\n## Deux\n" + "k l " * 6,
    "#  Titre \n" + " mot mot\x0bmot\x0cmot\u3000mot " * 3 + "\n# court\nun deux\n#### **Quatre**\n" + "mot  mot\tmot " * 4,
    "CHAPITRE I - Objet\n" + "x y " * 6 + "\nArticle 2 - Prix\n" + "x y " * 6 + "\n1.2.3 Détail\n" + "x y " * 6 + "\n3/ GARANTIES ET\n" + "x y " * 6 + "\n٣.٢.١ Détail\n" + "x y " * 6,
    "# Un\n# Un\n# Un\n" + "\n".join(f"## T{i}\n" + "mot " * (8 + i % 5) for i in range(60)),
]


def test_sections_within_the_row_are_those_of_lines(spark):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "document_id string, text string")
    names = ["document_id", "section_id", "h1", "h2", "h3", "content", "word_count", "first_pos"]
    lines = structure.carry_headings(structure.classify_headers(structure.split_lines(docs)))
    of_lines = structure.reject_reason(structure.emit_sections(lines)).filter("rejected IS NULL").select(*names)
    whole = structure.sections(docs, kept=False)
    assert sorted(map(str, whole.select(*names).collect())) == sorted(map(str, structure.emit_sections(lines).select(*names).collect()))
    rows = structure.chunk(docs)
    assert sorted(map(str, rows.select(*names).collect())) == sorted(map(str, of_lines.collect()))
    found = {}
    for r in sorted(rows.collect(), key=lambda r: (r.document_id, r.section_id)):
        found.setdefault(r.document_id, []).append((r.position, r.n_sections))
    assert found and all(places == [(i + 1, len(places)) for i in range(len(places))] for places in found.values())


def test_no_line_of_a_chunk_is_moved(spark):
    from folioworks.queries import QUERIES

    from .compare import DATA

    plan = QUERIES["order_chunks"](spark, str(DATA / "sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    # copies of documents are numbered; there is no other window, and no group
    assert plan.count("Window [") == 1 and "Aggregate" not in plan


def test_orders_are_spread_before_they_are_texts(spark):
    from folioworks.sources import adapters

    from .compare import DATA

    assert adapters.orders_md(spark, str(DATA / "sf0.001")).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_cleaning_by_signs_is_that_of_every_text(spark):
    texts = ["", " ", "a", "été", "\x00 a \x7f", "a\x1c", "\x1ca", "\u200ba\u3000"] + [f"{c}mot{d}" for c in SPACE for d in ("", "é", " ")]
    texts += [f"un{s}{h} deux" for s in ("\n", " ", "\n\n", " \n", "\r\n", "\xa0", "　\n", " ", "") for h in ("#", "##", "###", "####")]
    texts += ["<b>x</b> y", "<b>x <i", "x < y > z <", "<br><b", "<b>a</b> <br/ ><c d", "> <a", "$12 \\%$ 3\\% a4 \\% ٣ \\% $x 5\\%", "12\\% $5$ {a} n^{\\circ} 3 \\square", "{a {b} \\quad $a$ n^\\circ", "^{\\ci^{\\circ}rc}"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    t = F.col("t")
    got = {r.i: r for r in rows.select("i", text.strip(t).alias("strip"), text.split_inline_headers(t).alias("inline"), text.clean_html_markers(t).alias("markers"), text.clean_latex(t).alias("latex")).collect()}
    white = r"\t-\r \x85\xa0  -     　"
    strip = lambda s: re.sub(rf"\A[{white}]+|[{white}]+\Z", "", s)

    def inline(s):
        for mark in (rf"###[{white}]+", rf"##[{white}]+(?!\#)", rf"\#[{white}]+(?!\#)"):
            s = re.sub(rf"([^{white}])[{white}]+({mark})", r"\1\n\2", s)
        return s

    def markers(s):
        s = re.sub(r"<(?!br)/?[a-zA-Z][^>]*>", "", re.sub(rf"<br[{white}]*/?>", "\n", s))
        return strip(re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", re.sub(rf"\|[{white}]+\|[{white}]+\|", "", s))))

    def latex(s):
        for mark, meaning in ((r"n\^\\circ", "n°"), (r"\^\{\\circ\}", "°"), (rf"(?:\$|(?<!\d))(\d+)[{white}]*\\%\$?", r"\1%"), (r"\$\\quad\$", " "), (r"\\square", "☐"), (rf"\\[{white}]", " "), (r"\$([^$]+)\$", r"\1"), (r"\{([^}]*)\}", r"\1"), (r"\\\\", "")):
            s = re.sub(mark, meaning, s)
        return strip(re.sub(r"[ \t]+", " ", s) if "  " in s or "\t" in s else s)

    for i, s in enumerate(texts):
        assert tuple(got[i])[1:] == (strip(s), inline(s), markers(s), latex(s)), repr(s)
    assert tuple(got[-1])[1:] == (None,) * 4


def test_keywords_are_the_most_frequent_or_the_first(spark):
    texts = ["", None, "alpha bravo charlie deltas echos foxtrot", "alpha bravo alpha charlie deltas echos foxtrot foxtrot foxtrot", "mot court"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    got = dict(structure.keywords(rows).select("i", "keywords").collect())
    assert got == {0: [], 1: [], 2: ["alpha", "bravo", "charlie", "deltas", "echos"], 3: ["foxtrot", "alpha", "bravo", "charlie", "deltas"], 4: ["court"]}
