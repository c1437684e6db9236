"""The whole transformation: raw texts to chunks, statistics and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import MIN_TEXT_CHARS
from ..functions import metadata
from ..functions.tables import tables_to_sentences
from ..functions.text import clean_html_entities, clean_html_markers, clean_latex, clean_noise, estimate_tokens, remove_repeated_lines, split_inline_headers, strip
from ..operators import context, structure
from ..operators.keys import by, keyed
from ..sources.settings import Settings


def reject_code() -> Column:
    """Why a request (``text, user_id, project_id``) is refused; null if it is not."""
    text = F.coalesce("text", F.lit(""))
    return (
        F.when(strip(text) == "", "EMPTY_TEXT")
        .when(F.length(text) < MIN_TEXT_CHARS, "TEXT_TOO_SHORT")
        .when((F.coalesce("user_id", F.lit("")) == "") | (F.coalesce("project_id", F.lit("")) == ""), "MISSING_OWNER")
    )


def clean(docs: DataFrame) -> DataFrame:
    """All cleaning steps over ``text`` in order, within the row; other columns stay."""
    docs = docs.withColumn("text", clean_html_markers(F.coalesce("text", F.lit(""))))
    docs = tables_to_sentences(docs.withColumn("text", clean_html_entities(F.col("text"))))
    docs = docs.withColumn("text", remove_repeated_lines(F.col("text")))
    return docs.withColumn("text", clean_noise(clean_latex(split_inline_headers(F.col("text")))))


def with_metadata(docs: DataFrame) -> DataFrame:
    """Add the metadata columns."""
    return docs.withColumns(metadata.metadata_columns(F.col("text")))


def structured(docs: DataFrame, consolidate: bool = False, keep: tuple[str, ...] = (), enforce_cap: bool = False, limits: tuple[int, int] = structure.LIMITS, ranked: bool = True) -> DataFrame:
    """Sections of cleaned ``docs`` with their keys, metadata, keywords, breadcrumb and parent, and the columns ``keep``.

    Metadata travel with the lines, so that ``docs`` (cleaning included) are evaluated once and not joined.
    Where keywords are only counted, as by scores and metrics, they need not be ``ranked``.
    """
    about = ("document_type", "document_title", "document_reference")
    docs = keyed(docs)
    columns = metadata.metadata_columns(F.col("text"))
    rows = structure.chunk(docs.select(*by(docs), "text", *keep, *(columns[c].alias(c) for c in about)), about + keep, enforce_cap, limits)
    if consolidate:
        rows = structure.consolidate(rows, about + keep)
    rows = structure.keywords(rows) if ranked else structure.unranked_keywords(rows)
    return rows.withColumns({"breadcrumb": context.breadcrumb(F.col("document_title")), "parent": context.parent()})


def as_chunks(sections: DataFrame) -> DataFrame:
    """Flat chunks of :func:`structured` sections: id, enriched content and its token count."""
    rows = sections.withColumn("enriched_content", context.enriched_content(F.col("document_title")))
    number = F.format_string("%03d", F.col("position") - 1)
    return rows.withColumns({"chunk_id": F.concat(F.lit("chunk-"), "document_id", F.lit("-"), number), "enriched_token_count": estimate_tokens(F.col("enriched_content"))})


def chunks(docs: DataFrame, consolidate: bool = False, keep: tuple[str, ...] = (), enforce_cap: bool = False) -> DataFrame:
    """Flat chunks of cleaned ``docs``; documents without an id get one, rows that share an id stay apart."""
    return as_chunks(structured(docs, consolidate, keep, enforce_cap))


def rejects(docs: DataFrame) -> DataFrame:
    """``document_id, reject_code`` of each row that is refused or has no heading; within the row."""
    code = F.coalesce(reject_code(), F.when(~structure.has_header(F.col("text")), F.lit("STRUCTURE_NOT_DETECTED")))
    return docs.select("document_id", code.alias("reject_code")).filter("reject_code IS NOT NULL")


def chunks_as_set(docs: DataFrame, settings: Settings) -> DataFrame:
    """:func:`chunks` of raw ``docs`` (with ``source``) as a run's settings ask: which sources, and whether and where sections are cut."""
    taken = docs.filter(F.col("source").isin(*settings.sources)) if settings.sources else docs
    return as_chunks(structured(clean(taken), keep=("source",), enforce_cap=settings.enforce_cap, limits=(settings.max_chunk_chars, settings.max_chunk_tokens)))
