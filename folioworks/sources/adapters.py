"""Inputs: the service's request tables and documents made of the driver's tables.

Every adapter gives ``document_id`` (string) and ``text``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import scan
from ..functions.text import clean_page, strip

#: Ids of a source that make one long document.
SOURCE_IDS = 1000

PAGES = "array<struct<index:int,markdown:string,confidence_scores:struct<average_page_confidence_score:double>>>"


def ocr_texts(rows: DataFrame) -> DataFrame:
    """Request rows with defaults: ``document_id, user_id, project_id, text, source, page_count, confidence``."""
    return rows.select("document_id", "user_id", "project_id", F.coalesce("ocr_text", F.lit("")).alias("text"), F.coalesce("source", F.lit("pymupdf")).alias("source"), "page_count", "confidence")


def markdown_texts(rows: DataFrame) -> DataFrame:
    """Rows of markdown extracted elsewhere (``text``); the source is always ``pymupdf``."""
    return rows.select("document_id", "user_id", "project_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("pymupdf").alias("source"), F.lit(None).cast("int").alias("page_count"), F.lit(None).cast("double").alias("confidence"))


def page_text(pages: Column) -> Column:
    """Cleaned and stripped pages in array order, joined by blank lines; blank pages are skipped."""
    kept = F.filter(pages, lambda p: F.length(strip(F.coalesce(p.markdown, F.lit("")))) > 0)
    return F.array_join(F.transform(kept, lambda p: clean_page(p.markdown)), "\n\n")


def page_confidence(pages: Column) -> Column:
    """Mean confidence of non-blank pages that have one; null without any."""
    kept = F.filter(pages, lambda p: (F.length(strip(F.coalesce(p.markdown, F.lit("")))) > 0) & p.confidence_scores.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda acc, p: acc + F.coalesce(p.confidence_scores.average_page_confidence_score, F.lit(0.0)))
    return F.when(F.size(kept) > 0, total / F.size(kept))


def paged_texts(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """OCR responses (``document_id, user_id, project_id, pages``) as texts; of other columns those of ``keep`` stay."""
    count = F.size(F.coalesce("pages", F.array().cast(PAGES)))
    return rows.select("document_id", "user_id", "project_id", page_text(F.col("pages")).alias("text"), F.lit("mistral-ocr-3").alias("source"), count.alias("page_count"), page_confidence(F.col("pages")).alias("confidence"), *keep)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with headings by line position."""
    line = lambda x, i: F.when(F.trim(x) == "", None).when(i == 0, F.concat(F.lit("# "), x)).when(i % 4 == 2, F.concat(F.lit("## "), x)).when(i % 8 == 5, F.concat(F.lit("### "), x)).otherwise(x)
    text = F.array_join(F.array_compact(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line)), "\n")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), text.alias("text"))


def documents_legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines as legal headings of the five forms, by turns."""
    n = lambda i: (i % 19 + 1).cast("string")
    upper = lambda x: F.regexp_replace(F.translate(F.substring(x, 1, 40), string.ascii_lowercase, string.ascii_uppercase), "[^A-Z ]", "")
    line = lambda x, i: (
        F.when(i % 8 == 0, F.concat(F.lit("CHAPITRE "), n(i), F.lit(" - "), x)).when(i % 8 == 1, F.concat(F.lit("**Article 1."), n(i), F.lit(" - "), x, F.lit("**")))
        .when(i % 8 == 2, F.concat(F.lit("1.2."), n(i), F.lit(" : "), x)).when(i % 8 == 3, F.concat(n(i), F.lit("/ "), upper(x))).when(i % 8 == 4, F.concat(F.lit("##### **"), x, F.lit("**")))
        .when(i % 8 == 5, F.concat(F.lit("ARTICLE Ua "), n(i))).when(i % 8 == 6, F.lit("Chapitre mixte")).otherwise(F.concat(x, F.lit(" 1.2")))
    )
    text = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("legal-"), F.col("doc_id").cast("string")).alias("document_id"), text.alias("text"))


def documents_odd_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`documents_md`, of which a seventh has no id, another an empty one, and a fifth of the rest one of two ids; those without are there twice."""
    docs = documents_md(spark, sf_dir)
    number = F.col("document_id").cast("long")
    odd = F.when(number % 7 == 0, None).when(number % 7 == 1, "").when(number % 5 == 0, F.concat(F.lit("shared-"), (number % 2).cast("string"))).otherwise(F.col("document_id"))
    times = F.when(number % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return docs.withColumn("_n", F.explode(times)).select(odd.alias("document_id"), "text")


def documents_para(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines as paragraphs."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")).alias("text"))


def source_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each source and range of ``SOURCE_IDS`` ids: a heading for each document and each of its lines (a long one, for merging).

    A document without an id is in one with its own copies alone, so that no row grows with the corpus.
    """
    docs, name = table(spark, sf_dir, "documents"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    headed = F.transform(F.split("text", "\n"), lambda x, i: F.when(F.trim(x) != "", F.concat(F.lit("## L"), name, F.lit("."), i.cast("string"), F.lit("\n"), x)))
    one = F.concat_ws("\n", F.concat(F.lit("# Document "), name), F.array_join(F.array_compact(headed), "\n"))
    block = F.coalesce(F.floor(F.col("doc_id") / SOURCE_IDS).cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))
    parts = docs.select(F.concat_ws(":", "source", block).alias("document_id"), "doc_id", one.alias("part")).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", "part"))).alias("parts"))
    return parts.select("document_id", F.array_join(F.transform("parts", lambda p: p.part), "\n").alias("text"))


def orders_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as contracts, invoices and quotes; spread before they become texts, as a file of small rows may be a task or two."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    key, total = F.col("o_orderkey").cast("string"), F.floor("o_totalprice").cast("string")
    word = F.when(F.col("o_orderstatus") == "P", "CONTRAT").when(F.col("o_orderstatus") == "F", "FACTURE").otherwise("DEVIS")
    text = F.concat(
        F.lit("# "), word, F.lit(" "), key, F.lit("\n## Parties\nSociété dénommée CLIENT "), F.col("c_custkey").cast("string"),
        F.lit(" au capital de 50000 euros, SIREN "), (F.col("o_orderkey") + 100000000).cast("string"),
        F.lit(" représentée par son gérant.\nLe bien se situe à "), "c_mktsegment", F.lit(" dans le secteur.\nDate: "), F.date_format("o_orderdate", "dd/MM/yyyy"),
        F.lit("\n## Prix et conditions\nLe prix est de "), total, F.lit(" euros avec une TVA de 20 \\% et un paiement n^{\\circ} "), key,
        F.lit(" selon les conditions &amp; annexes.\nLivraison<br>dans un <b>délai</b> de trois mois après signature.\n| Poste | Montant |\n| --- | --- |\n| Total | "), total, F.lit(" |"),
    )
    return rows.select(key.alias("document_id"), text.alias("text"))


def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as OCR responses, a page for each turn; every third page has no confidence."""
    turns = table(spark, sf_dir, "conversations")
    confidence = F.when(F.col("turn") % 3 != 2, F.struct((F.lit(90.0) + F.col("turn")).alias("average_page_confidence_score")))
    page = F.struct(F.col("turn").cast("int").alias("index"), F.concat(F.lit("## "), "role", F.lit("\n"), "text").alias("markdown"), confidence.alias("confidence_scores"))
    pages = F.array_sort(F.collect_list(page)).cast(PAGES)
    return turns.groupBy(F.col("conv_id").cast("string").alias("document_id")).agg(pages.alias("pages")).withColumns({"user_id": F.lit("u"), "project_id": F.lit("p")})


def paged_lines(rows: DataFrame) -> DataFrame:
    """:func:`paged_texts` with ``ocr_confidence`` and ``pages``: where each page that is kept begins (its first line in the text), its number and its confidence."""
    kept = F.filter("pages", lambda p: F.length(strip(F.coalesce(p.markdown, F.lit("")))) > 0)
    sized = F.transform(kept, lambda p: F.struct(F.size(F.split(clean_page(p.markdown), "\n")).alias("lines"), p["index"].alias("page"), p.confidence_scores.average_page_confidence_score.alias("confidence")))
    rows = paged_texts(rows.withColumn("sized", sized), keep=("sized",))
    # a blank line stands between pages
    before = scan(F.col("sized"), F.lit(0), lambda n, p: n + p.lines + 1, lambda n, _: n)
    pages = F.zip_with("sized", before, lambda p, line: F.struct(line.alias("first_line"), p.page.alias("page"), p.confidence.alias("confidence")))
    return rows.withColumns({"pages": pages, "ocr_confidence": F.col("confidence")}).drop("sized", "confidence", "page_count")


def request_bodies(spark: SparkSession, sf_dir: str, route: str) -> DataFrame:
    """``request_id, body``: a JSON body for each document (for pages: each conversation), some of them cut off, without owner, blank or of another kind."""
    if route == "pages":
        rows = ocr_pages(spark, sf_dir).select(F.col("document_id").cast("long").alias("request_id"), "pages")
        pages = F.when(F.col("request_id") % 11 == 3, F.slice("pages", 1, 0)).otherwise(F.col("pages"))
        fields = [F.struct(pages.alias("pages")).alias("ocr_response")]
    else:
        rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), "text")
        text = F.when(F.col("request_id") % 11 == 3, F.lit(" " * 60)).when(F.col("request_id") % 11 == 4, F.substring("text", 1, 30)).otherwise(F.col("text"))
        fields = [text.alias("ocrText" if route == "ocr" else "text")]
    request = F.col("request_id")
    names = {"document_id": "documentId", "user_id": "userId", "project_id": "projectId"} if route == "ocr" else {c: c for c in ("document_id", "user_id", "project_id")}
    owner = F.when(request % 11 != 5, F.lit("u"))
    fields += [F.when(request % 3 != 0, request.cast("string")).alias(names["document_id"]), owner.alias(names["user_id"]), F.lit("p").alias(names["project_id"])]
    if route == "ocr":
        fields += [F.when(request % 2 == 0, "paddleocr").alias("source"), (request % 9).cast("int").alias("pageCount"), (request % 100 / 2).alias("confidence")]
    whole = F.to_json(F.struct(*fields))
    body = F.when(request % 11 == 6, F.substring(whole, 1, 40)).when(request % 11 == 7, F.concat(F.lit("["), whole, F.lit("]"))).when(request % 11 == 8, F.lit(None).cast("string")).otherwise(whole)
    return rows.select("request_id", body.alias("body"))


def pages_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages with their level-1 headings in markdown."""
    text = F.replace(F.replace(F.coalesce("html", F.lit("")), F.lit("<h1>"), F.lit("\n# ")), F.lit("</h1>"), F.lit("\n"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("document_id"), text.alias("text"))
