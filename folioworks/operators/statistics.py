"""Statistics of documents, operations and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import RATE_PER_MINUTE, SAMPLES_KEPT
from ..functions.numbers import tenths
from .keys import by, shared


def document_statistics(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections, words, tokens and their rounded means for every document, those without sections included."""
    sums = sections.groupBy(*by(sections)).agg(F.count("*").alias("n_sections"), F.sum("word_count").alias("n_words"), F.sum("token_count").alias("n_tokens"), F.bround(F.avg("word_count")).cast("long").alias("avg_words"), F.bround(F.avg("token_count")).cast("long").alias("avg_tokens"))
    on = shared(docs, sections)
    return docs.select(*on).join(sums.select(*on, "n_sections", "n_words", "n_tokens", "avg_words", "avg_tokens"), on, "left").fillna(0, ["n_sections", "n_words", "n_tokens", "avg_words", "avg_tokens"])


def response_totals(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks, words, tokens and tokens a chunk (whole, 0 without chunks) of what is returned for each document."""
    stats = document_statistics(docs, sections)
    return stats.select(*by(stats), F.col("n_sections").alias("n_chunks"), "n_words", "n_tokens", F.floor(F.col("n_tokens") / F.greatest("n_sections", F.lit(1))).alias("tokens_per_chunk"))


def type_histogram(sections: DataFrame) -> DataFrame:
    """Keys, ``type, count``."""
    return sections.groupBy(*by(sections), "type").count()


_METRICS = ["n_sections", "n_words", "avg_words", "min_words", "max_words", "sections_by_type", "hierarchy_depth", "n_h1", "n_h2", "n_h3", "avg_keywords"]


def section_metrics() -> list[Column]:
    """Aggregates of a document's sections that :func:`as_metrics` reads: the values of :func:`detailed_metrics` for an operator that groups sections anyway.

    Sections have ``type, word_count``, headings, ``_keywords`` (how many) and ``_of_type``
    (how many sections of the document have the type).
    """
    some = lambda h: F.coalesce(F.col(h), F.lit("")) != ""
    depth = F.when(some("h1") & some("h2") & some("h3"), 3).when(some("h1") & some("h2"), 2).otherwise(1)
    mean = lambda total: tenths(F.sum(total) / F.count("*")) / 10
    values = {
        "n_sections": F.count("*"), "n_words": F.sum("word_count"), "avg_words": mean("word_count"), "min_words": F.min("word_count"), "max_words": F.max("word_count"),
        "sections_by_type": F.map_from_entries(F.array_sort(F.collect_set(F.struct("type", F.col("_of_type").alias("n"))))), "hierarchy_depth": F.max(depth),
        **{f"n_{h}": F.count_if(some(h)) for h in ("h1", "h2", "h3")}, "avg_keywords": mean("_keywords"),
    }
    return [values[c].alias(f"_metric_{c}") for c in _METRICS]


def as_metrics(rows: DataFrame) -> Column:
    """A struct of what :func:`section_metrics` gave for the documents ``rows``: zeros and an empty map for those without sections."""
    kinds = dict(rows.dtypes)
    none = lambda c: F.create_map().cast("map<string,bigint>") if c == "sections_by_type" else F.lit(0).cast(kinds[f"_metric_{c}"])
    return F.struct(*(F.coalesce(F.col(f"_metric_{c}"), none(c)).alias(c) for c in _METRICS))


def detailed_metrics(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """Counts, bounds and means of the sections (with ``keywords``) of every document, zeros and an empty map for those without.

    ``sections_by_type`` is a map from the counts by type; the depth is that of the outline,
    1 where no section has a first heading.
    """
    some = lambda h: F.coalesce(F.col(h), F.lit("")) != ""
    key, on = by(sections), shared(docs, sections)
    depth = F.when(some("h1") & some("h2") & some("h3"), 3).when(some("h1") & some("h2"), 2).otherwise(1)
    # counts by type first, so that at most as many rows as there are types meet in a document
    by_type = sections.groupBy(*key, "type").agg(
        F.count("*").alias("n"), F.sum("word_count").alias("words"), F.min("word_count").alias("least"), F.max("word_count").alias("most"), F.max(depth).alias("depth"),
        *(F.count_if(some(h)).alias(h) for h in ("h1", "h2", "h3")), F.sum(F.size("keywords")).alias("keywords"),
    )
    mean = lambda total: tenths(F.sum(total) / F.sum("n")) / 10
    sums = by_type.groupBy(*key).agg(
        F.sum("n").alias("n_sections"), F.sum("words").alias("n_words"), mean("words").alias("avg_words"), F.min("least").alias("min_words"), F.max("most").alias("max_words"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("sections_by_type"), F.max("depth").alias("hierarchy_depth"),
        *(F.sum(h).alias(f"n_{h}") for h in ("h1", "h2", "h3")), mean("keywords").alias("avg_keywords"),
    )
    fields = [c for c in sums.columns if c not in key]
    joined = docs.select(*on).join(sums.select(*on, *fields), on, "left").fillna(0, [c for c in fields if c != "sections_by_type"])
    return joined.withColumn("sections_by_type", F.coalesce("sections_by_type", F.create_map().cast("map<string,bigint>")))


def metric_summary(samples: DataFrame, kept: int = SAMPLES_KEPT) -> DataFrame:
    """Count, mean, bounds and success rate of the last ``kept`` samples of each operation.

    ``samples`` has ``operation, duration_ms, ts, success`` and ``sample_id`` for ties.
    The row limit is a top-k by operation, so Spark prunes each partition first.
    """
    last = samples.withColumn("rank", F.row_number().over(Window.partitionBy("operation").orderBy(F.desc("ts"), F.desc("sample_id")))).filter(F.col("rank") <= kept)
    return last.groupBy("operation").agg(
        F.count("*").alias("count"), F.round(F.avg("duration_ms"), 2).alias("avg_ms"), F.round(F.min("duration_ms"), 2).alias("min_ms"),
        F.round(F.max("duration_ms"), 2).alias("max_ms"), F.round(F.avg(F.col("success").cast("int")), 3).alias("success_rate"),
    )


def rate_per_minute(events: DataFrame, limit: int = RATE_PER_MINUTE) -> DataFrame:
    """Requests of each user in each minute and whether they are over the limit."""
    minute = F.date_trunc("minute", "ts")
    return events.groupBy("user_id", minute.alias("minute")).agg(F.count("*").alias("requests")).withColumn("limited", F.col("requests") > limit)
