"""Quality of structured documents: five scores of rules, 100 points in all.

Sections bring counts, one group by document adds them up, and rules are column
expressions over these sums.  Examples in issues (positions, messages) are the first few
by place, told by running counts, so no document's sections are gathered in one row.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import FAILED, MESSAGES, NOISE_WORDS, RECOMMENDATIONS
from ..functions.arrays import bind
from ..functions.numbers import one_decimal, tenths
from ..functions.text import count_words
from .context import twin_key, unknown_siblings
from .keys import by, shared
from .statistics import as_metrics, section_metrics

# What counts as noise in a document's contents, with signs one of which such a text has (none: not known).
NOISE_PATTERNS = {r"[\\]{2,}": ["\\\\"], r"[\^_]{2,}": ["^^", "^_", "_^", "__"], r"[|]{2,}": ["||"], r"[#]{3,}": ["###"], r"[\x00-\x1F]": []}
# Words that may be suspect: those without a letter, of more than 20 characters or with a capital.
ODD_WORD = r"(?U)(?<!\S)(?:[^\s\p{L}]++(?!\S)|(?=\S{21}|\S*?\p{IsUppercase})\S++)"
#: Issues whose points are told with a decimal.
SCALED = {"noise", "noise_ratio", "latex", "gibberish", "short", "long", "no_keywords", "breadcrumbs", "orphans", "siblings"}
LATEX_LEFT = r"\\[a-z]+\{"
#: Positions and messages that an issue shows at most.
POSITIONS_SHOWN, DETAILS_SHOWN = 5, 3
MOST = {"ocr": 30, "structure": 25, "metadata": 20, "content": 15, "coherence": 10}
#: Names of the scores in a report.
REPORTED = {"ocr": "ocr_quality", "structure": "structure_quality", "metadata": "metadata_completeness", "content": "content_quality", "coherence": "coherence"}


def _points(count: Column, each: float, most: float) -> Column:
    return F.least(F.lit(float(most)), count * F.lit(float(each)))


def section_signs(sections: DataFrame) -> DataFrame:
    """Add the counts of noise, words and LaTeX that rules need, and ``gibberish``, to ``sections`` (``content``)."""
    content = F.col("content")
    capitals = lambda w: F.length(w) - F.length(F.regexp_replace(w, r"\p{IsUppercase}", ""))
    suspect = lambda w: (F.length(w) > 20) | ~w.rlike(r"\p{L}") | (capitals(w) > 0.5 * F.length(w))
    # texts without the signs of a pattern are not searched for it
    count = lambda p, *signs: F.when(reduce(Column.__or__, map(content.contains, signs)) if signs else content.isNotNull(), F.regexp_count(content, F.lit(p))).otherwise(0)
    noise_words = rf"(?U)(?<!\S)(?:{'|'.join(map(re.escape, NOISE_WORDS))})(?!\S)"
    rows = sections.withColumns({
        "noise": sum((count(p, *signs) for p, signs in NOISE_PATTERNS.items()), F.lit(0)), "latex": count(LATEX_LEFT, "\\"), "noise_words": count(noise_words, *NOISE_WORDS),
        "suspects": F.coalesce(F.size(F.filter(F.regexp_extract_all(content, F.lit(ODD_WORD), F.lit(0)), suspect)), F.lit(0)),
    })
    # of five words or more, a single one is no such share: words need not be counted for it
    share = bind(count_words(content), lambda n: (n >= 5) & (F.col("suspects") / n > 0.3))
    return rows.withColumn("gibberish", F.when(F.col("suspects") > 1, share).otherwise(False))


def _sums(sections: DataFrame, order: tuple[str, ...], metrics: bool = False) -> DataFrame:
    """What the rules read of each document with sections: counts, means and the first examples; with ``metrics`` also those of :func:`section_metrics`."""
    some = lambda h: F.coalesce(F.col(h), F.lit("")) != ""
    key = by(sections)
    rows = section_signs(sections.withColumn("_twin", twin_key()))
    level = F.when(some("h1") & some("h2") & some("h3"), 3).when(some("h1") & some("h2"), 2).when(some("h1"), 1)
    place = Window.partitionBy(*key).orderBy(*order)
    so_far = place.rowsBetween(Window.unboundedPreceding, 0)
    said = lambda what: F.concat(F.lit("Section "), F.col("position").cast("string"), F.lit(f": {what}"))
    rows = rows.withColumns({
        "_short": F.col("word_count") < 50, "_long": F.col("word_count") > 500,
        "_told": F.array_compact(F.array(F.when(some("h3") & ~some("h2"), said("H3 sans H2")), F.when(some("h2") & ~some("h1"), said("H2 sans H1")))),
        "_missing": F.concat_ws(", ", *(F.when(F.col(c).isNull(), F.lit(c)) for c in ("content", "word_count", "keywords", "position"))),
        "_keywords": F.size("keywords"), "_bad_crumb": F.size(F.split(F.coalesce("breadcrumb", F.lit("")), ">")) < 2, "_orphan": some("h2") & ~some("parent"),
    })
    # sections are moved several times from here on: without their texts, and what is not read
    kept = [*key, *order, "position", "title", "h1", "h2", "h3", "word_count", "noise", "noise_words", "latex", "gibberish", "siblings", *(("type",) if metrics else ())]
    rows = rows.select(*dict.fromkeys(c for c in rows.columns if c in kept or c.startswith("_")))
    rows = rows.withColumns({
        "_at": F.row_number().over(place), "_back": F.coalesce(F.lag("position").over(place) > F.col("position"), F.lit(False)),
        "_nth_short": F.count_if("_short").over(so_far), "_nth_long": F.count_if("_long").over(so_far),
        "_told_before": F.sum(F.size("_told")).over(so_far) - F.size("_told"),
    })
    if metrics:
        rows = rows.withColumn("_of_type", F.count("*").over(Window.partitionBy(*key, "type")))
    rows = unknown_siblings(rows, "_at")
    first = lambda when, value: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("_at", F.col(value).alias("x"))))), lambda x: x.x)
    counted = F.when(F.col("word_count") > 0, F.col("word_count"))
    return rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.sum("word_count").alias("total_words"), F.sum("noise").alias("noise"), F.sum("noise_words").alias("noise_words"),
        F.sum("latex").alias("latex"), F.count_if("gibberish").alias("gibberish"), F.sum(F.size("_told")).alias("incoherent"),
        F.count_if("_short").alias("short"), F.count_if("_long").alias("long"),
        first(F.col("_short") & (F.col("_nth_short") <= POSITIONS_SHOWN), "position").alias("short_at"),
        first(F.col("_long") & (F.col("_nth_long") <= POSITIONS_SHOWN), "position").alias("long_at"),
        F.slice(F.flatten(first((F.size("_told") > 0) & (F.col("_told_before") < DETAILS_SHOWN), "_told")), 1, DETAILS_SHOWN).alias("told"),
        F.count_if(F.col("_keywords") == 0).alias("no_keywords"), F.avg("_keywords").alias("avg_keywords"),
        F.count(counted).alias("n_counted"), F.try_divide(F.stddev_samp(counted), F.avg(counted)).alias("cv"),
        F.count_if("_bad_crumb").alias("bad_crumbs"), F.count_if("_orphan").alias("orphans"),
        F.count_if("unknown_siblings").alias("bad_siblings"), F.max(level).alias("depth"), F.bool_or("_back").alias("unsorted"),
        F.max("_missing").alias("missing"), *(section_metrics() if metrics else ()),
    )


def _rules(empty: Column, n: Column) -> list[tuple]:
    """Rules in order: category, when it applies, points, severity, message, its count, positions and details shown."""
    ratio = F.try_divide(F.col("noise_words"), "total_words")
    title, kind = F.coalesce("document_title", F.lit("")), F.coalesce("document_type", F.lit(""))
    no_outline = F.col("depth").isNull()
    full, planned = ~empty, ~no_outline
    noise = _points(F.col("noise"), 0.5, 10)
    return [
        ("ocr", empty, F.lit(30.0), "error", "no_sections", None),
        ("ocr", full & (F.col("noise") > 0), noise, F.when(noise < 5, "warning").otherwise("error"), "noise", F.col("noise")),
        ("ocr", full & (ratio > 0.05), _points(ratio, 100, 10), "error", "noise_ratio", one_decimal(100 * ratio)),
        ("ocr", full & (F.col("latex") > 5), _points(F.col("latex"), 0.2, 5), "warning", "latex", F.col("latex")),
        ("ocr", full & (F.col("gibberish") > 0), _points(F.col("gibberish"), 0.5, 5), "warning", "gibberish", F.col("gibberish")),
        ("structure", no_outline, F.lit(10.0), "error", "no_outline", None),
        ("structure", planned & (F.col("depth") < 2), F.lit(3.0), "warning", "shallow", F.col("depth")),
        ("structure", planned & (n < 5), F.lit(5.0), "error", "few_sections", n),
        ("structure", planned & ((n > 100) | ((n >= 5) & (n < 10))), F.lit(2.0), "info", "unusual_sections", n),
        ("structure", planned & (F.col("incoherent") > 0), _points(F.col("incoherent"), 1, 5), "warning", "incoherent", F.col("incoherent"), None, F.col("told")),
        ("metadata", F.length(title) < 5, F.lit(8.0), "error", "title", None),
        ("metadata", kind.isin("", "unknown"), F.lit(5.0), "warning", "type", None),
        ("metadata", F.coalesce("document_reference", F.lit("")) == "", F.lit(4.0), "info", "reference", None),
        ("metadata", F.coalesce("n_parties", F.lit(0)) == 0, F.lit(3.0), "info", "parties", None),
        ("content", empty, F.lit(15.0), "error", "no_sections", None),
        ("content", full & (F.col("short") > 0), _points(F.col("short"), 0.3, 3), "warning", "short", F.col("short"), F.col("short_at")),
        ("content", full & (F.col("long") > 0), _points(F.col("long"), 0.3, 3), "info", "long", F.col("long"), F.col("long_at")),
        ("content", full & (F.col("no_keywords") > 0), _points(F.col("no_keywords"), 0.2, 4), "warning", "no_keywords", F.col("no_keywords")),
        ("content", full & (F.col("n_counted") > 3) & (F.col("cv") > 2), F.lit(3.0), "info", "uneven", None),
        ("content", full & (F.col("avg_keywords") < 2), F.lit(2.0), "warning", "few_keywords", one_decimal(F.col("avg_keywords"))),
        ("coherence", empty, F.lit(10.0), "error", "no_sections", None),
        ("coherence", full & F.col("unsorted"), F.lit(3.0), "error", "unsorted", None),
        ("coherence", full & (F.col("bad_crumbs") > 0), _points(F.col("bad_crumbs"), 0.5, 3), "warning", "breadcrumbs", F.col("bad_crumbs")),
        ("coherence", full & (F.col("orphans") > 0), _points(F.col("orphans"), 0.3, 2), "warning", "orphans", F.col("orphans")),
        ("coherence", full & (F.col("bad_siblings") > 0), _points(F.col("bad_siblings"), 0.2, 2), "info", "siblings", F.col("bad_siblings")),
    ]


_ISSUE = "struct<severity:string,category:string,points:double,message:string,impact:string,sections_affected:array<int>,details:array<string>>"


def score(docs: DataFrame, sections: DataFrame, nodes: DataFrame | None = None, order: tuple[str, ...] = ("position",), metrics: bool = False) -> DataFrame:
    """Scores of every document of ``docs`` (``document_id, document_type, document_title, document_reference, n_parties``).

    ``sections`` have ``breadcrumb, parent, keywords`` and, where siblings were given,
    ``siblings``; ``order`` is the order they come in.  Returns the keys of ``docs``, the
    five scores, ``overall`` (one decimal), ``grade``, ``needs_review``, ``issues`` (by
    severity, in order of rules; with the first positions and messages) and
    ``recommendations``.  The depth is that of the outline ``nodes``, or of the headings
    of ``sections`` (which is the same) without them.  A document one of whose sections
    lacks its content, words, keywords or position has no scores, overall 0 and grade
    ``Erreur``.  With ``metrics`` (``sections`` also have ``type``) a struct of the metrics
    of :func:`detailed_metrics` is there as well, from the same pass over the sections; it
    is null where there are no scores.
    """
    key = by(docs)
    sums = _sums(sections, order, metrics)
    on = shared(docs, sums)
    d = docs.join(sums.select(*on, *[c for c in sums.columns if c not in key]), on, "left")
    if nodes is not None:
        d = d.drop("depth").join(nodes.groupBy(*on).agg(F.max("level").alias("depth")), on, "left")
    empty, n = F.col("n").isNull(), F.coalesce("n", F.lit(0))
    failed = F.coalesce("missing", F.lit("")) != ""
    rules = [(*r, None, None)[:8] for r in _rules(empty, n)]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    # points go one after the other, as sums of doubles depend on their order
    left = {c: reduce(Column.__sub__, (F.when(F.coalesce(on, F.lit(False)), zero(points)).otherwise(0.0) for k, on, points, *_ in rules if k == c), F.lit(float(m))) for c, m in MOST.items()}
    as_column = lambda s: s if isinstance(s, Column) else F.lit(s)
    rank = lambda s: F.when(as_column(s) == "error", 0).when(as_column(s) == "warning", 1).otherwise(2)
    said = lambda m, x: F.lit(MESSAGES[m]) if x is None else F.format_string(MESSAGES[m], x)
    impact = lambda m, points: F.concat(F.lit("-"), one_decimal(points) if m in SCALED else points.cast("int").cast("string"), F.lit(" points"))
    shown = lambda x, kind: F.lit(None).cast(kind) if x is None else x.cast(kind)
    issue = lambda i, c, points, s, m, x, at, told: F.struct(
        rank(s).alias("rank"), F.lit(i).alias("rule"),
        F.struct(as_column(s), F.lit(c), points, said(m, x), impact(m, points), shown(at, "array<int>"), shown(told, "array<string>")).cast(_ISSUE).alias("issue"),
    )
    issues = F.array(*(F.when(F.coalesce(on, F.lit(False)), issue(i, c, points, *rest)) for i, (c, on, points, *rest) in enumerate(rules)))
    d = d.withColumns({c: F.greatest(F.lit(0.0), left[c]) for c in MOST} | {"ranked": F.array_sort(F.array_compact(issues))})
    overall = sum((F.col(c) for c in MOST), F.lit(0.0))
    grade = F.when(overall >= 86, "Excellent").when(overall >= 71, "Bon").when(overall >= 41, "Moyen").otherwise("Mauvais")
    severe = lambda s: F.size(F.filter("ranked", lambda x: x.issue.severity == s))
    advice = F.array_compact(F.array(
        F.when(F.col("ocr") < 20, RECOMMENDATIONS["ocr"]), F.when(F.col("structure") < 15, RECOMMENDATIONS["structure"]), F.when(F.col("metadata") < 10, RECOMMENDATIONS["metadata"]),
        F.when(severe("error") > 0, F.format_string(RECOMMENDATIONS["errors"], severe("error"))), F.when(severe("warning") > 3, F.format_string(RECOMMENDATIONS["warnings"], severe("warning"))),
        F.when(~empty & (F.col("short") > 0), F.format_string(RECOMMENDATIONS["short"], F.array_join(F.col("short_at").cast("array<string>"), ", "))),
    ))
    d = d.withColumns({"_overall": overall, "_grade": grade, "_advice": advice})
    failure = F.array(F.struct(F.lit("error"), F.lit("system"), F.lit(None).cast("double"), F.format_string(FAILED["message"], F.col("missing")), F.lit(None).cast("string"), F.lit(None).cast("array<int>"), F.lit(None).cast("array<string>")).cast(_ISSUE))
    unless = lambda value, other: F.when(failed, other).otherwise(value)
    told = [F.when(~failed, as_metrics(d)).alias("metrics")] if metrics else []
    return d.select(
        *key, *(unless(F.col(c), F.lit(None)).alias(c) for c in MOST), unless(tenths(F.col("_overall")) / 10, F.lit(0.0)).alias("overall"), unless(F.col("_grade"), F.lit(FAILED["grade"])).alias("grade"),
        unless(F.col("_overall") < 71, F.lit(True)).alias("needs_review"), unless(F.transform("ranked", lambda x: x.issue), failure).alias("issues"),
        unless(F.when(F.size("_advice") > 0, F.col("_advice")).otherwise(F.array(F.lit(RECOMMENDATIONS["none"]))), F.array(F.lit(FAILED["recommendation"]))).alias("recommendations"), *told,
    )


def report(docs: DataFrame, sections: DataFrame, order: tuple[str, ...] = ("position",)) -> DataFrame:
    """A report on each document: ``overall_score, grade, needs_review, scores`` (a map), ``issues, recommendations, metrics`` (a struct).

    Documents that cannot be scored have empty scores and null metrics.
    """
    scored = score(docs, sections, order=order, metrics=True)
    failed = F.col("grade") == FAILED["grade"]
    scores = F.create_map(*(x for c, name in REPORTED.items() for x in (F.lit(name), F.col(c))))
    return scored.select(
        *by(scored), F.col("overall").alias("overall_score"), "grade", "needs_review", F.when(failed, F.create_map().cast("map<string,double>")).otherwise(scores).alias("scores"),
        "issues", "recommendations", "metrics",
    )
