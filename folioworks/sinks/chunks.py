"""Where chunks go: nested rows, JSON objects, parquet, and a table of the latest states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.keys import by, shared

# Metadata of a chunk in a response, and the columns they come from.
METADATA = {
    "chunkIndex": "position - 1",
    "h1": "h1",
    "h2": "h2",
    "h3": "h3",
    "title": "title",
    "type": "type",
    "wordCount": "word_count",
    "tokenCount": "token_count",
    "enrichedTokenCount": "enriched_token_count",
    "keywords": "keywords",
    "breadcrumb": "breadcrumb",
    "sectionPosition": "position",
    "documentType": "document_type",
    "documentTitle": "document_title",
    "documentReference": "document_reference",
    "ocrSource": "source",
    "ocrConfidence": "ocr_confidence",
    "parentSection": "parent",
    "siblingSections": "siblings",
}
_PAGE, _CONFIDENCE = "page_number", "confidence"


def page_maps(sections: DataFrame) -> DataFrame:
    """Keys, ``page_number, confidence``: two maps from a chunk's place (from 0) to its page and that page's confidence.

    ``sections`` come from paged texts with ``pages``, an array of ``first_line, page,
    confidence`` by first line; a chunk is on the page where its first line stands.  Places
    without a page, and pages without a confidence, are not in the maps.
    """
    page = F.get(F.col("pages"), F.size(F.filter("pages", lambda p: p.first_line <= F.col("first_pos"))) - 1)
    rows = sections.select(*by(sections), (F.col("position") - 1).alias("at"), page.alias("p"))
    entries = lambda value: F.map_from_entries(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("at", value.alias("v"))))))
    return rows.groupBy(*by(rows)).agg(entries(F.col("p.page")).alias(_PAGE), entries(F.col("p.confidence")).alias(_CONFIDENCE))


def nested(chunks: DataFrame, pages: DataFrame | None = None, with_source: bool = False) -> DataFrame:
    """``chunk_id, document_id, user_id, project_id, content, enriched_content, metadata`` (a struct).

    ``chunks`` may have ``user_id, project_id, source, ocr_confidence, siblings``; what is
    missing is null.  ``with_source`` repeats the source at the end, as the routes for
    markdown and pages do.  With ``pages`` (:func:`page_maps`, joined by document) metadata
    also have ``page_number`` and ``confidence``, null where the maps have no entry.
    """
    missing = {"user_id": "string", "project_id": "string", "source": "string", "ocr_confidence": "double", "siblings": "array<string>"}
    rows = chunks.withColumns({c: F.lit(None).cast(kind) for c, kind in missing.items() if c not in chunks.columns})
    fields = [F.expr(column).alias(name) for name, column in METADATA.items()] + [F.col("source").alias("source")] * with_source
    if pages is not None:
        on = shared(rows, pages)
        maps = pages.select(*on, F.col(_PAGE).alias("_pages"), F.col(_CONFIDENCE).alias("_confidences"))
        rows = rows.join(maps, on, "left")
        at = F.col("position") - 1
        fields += [F.try_element_at("_pages", at).alias(_PAGE), F.try_element_at("_confidences", at).alias(_CONFIDENCE)]
    return rows.select("chunk_id", "document_id", "user_id", "project_id", "content", "enriched_content", F.struct(*fields).alias("metadata"))


def to_json(rows: DataFrame) -> DataFrame:
    """``document_id, chunk_id, json``: an object for each :func:`nested` row; nulls are written, pages and confidences that are not known are left out."""
    names = rows.schema["metadata"].dataType.names
    optional = [c for c in (_PAGE, _CONFIDENCE) if c in names]
    always = [c for c in names if c not in optional]

    def json(extra: list[str]) -> Column:
        metadata = F.struct(*(F.col(f"metadata.{c}").alias(c) for c in [*always, *extra]))
        return F.to_json(F.struct(*(c for c in rows.columns if c != "metadata"), metadata.alias("metadata")), {"ignoreNullFields": "false"})

    known = lambda c: F.col(f"metadata.{c}").isNotNull()
    text = json([])
    for extra in ([c] for c in optional):
        text = F.when(known(extra[0]), json(extra)).otherwise(text)
    if len(optional) == 2:
        text = F.when(known(_PAGE) & known(_CONFIDENCE), json(optional)).otherwise(text)
    return rows.select("document_id", "chunk_id", text.alias("json"))


def write_json(rows: DataFrame, path: str) -> None:
    """:func:`nested` rows as files of JSON lines."""
    to_json(rows).select("json").write.mode("overwrite").text(path)


def write_parquet(chunks: DataFrame, path: str) -> None:
    """Chunks appended as parquet."""
    chunks.write.mode("append").parquet(path)


def latest_states(states: DataFrame, updates: DataFrame, key: str = "document_id", order: str = "updated_at") -> DataFrame:
    """Keyed upsert: the last row of each key of both tables, of equally late ones an update.

    Rows of one table that are equally late are told apart by a hash of all columns.
    :mod:`folioworks.sinks.states` keeps such a table on disk.
    """
    rows = states.withColumn("_update", F.lit(0)).unionByName(updates.withColumn("_update", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_update"), F.desc(F.xxhash64(*states.columns)))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_update")
