"""Outline of documents and the place of sections in it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bind
from ..functions.text import strip
from .keys import by


def _some(heading: str) -> Column:
    return F.coalesce(F.col(heading), F.lit("")) != ""


def outline(sections: DataFrame) -> DataFrame:
    """Adjacency rows: keys, ``level, title, parent_h1, parent_h2, position``.

    Level 1 is there once for each title, level 2 once for each pair of headings,
    level 3 once for each section; position is that of the first section.
    """
    key, empty = by(sections), F.lit(None).cast("string")
    node = lambda level, title, h1, h2, at: F.struct(F.lit(level).alias("level"), title.alias("title"), h1.alias("parent_h1"), h2.alias("parent_h2"), at.alias("at"))
    h1, h2, h3, nowhere = F.col("h1"), F.col("h2"), F.col("h3"), F.lit(None).cast("int")
    # all levels in one pass over the sections; those of level 3 are told apart by their places
    nodes = F.array_compact(F.array(
        node(1, h1, empty, empty, nowhere), F.when(_some("h2"), node(2, h2, h1, empty, nowhere)), F.when(_some("h2") & _some("h3"), node(3, h3, h1, h2, F.col("position").cast("int"))),
    ))
    rows = sections.filter(_some("h1")).select(*key, "position", F.explode(nodes).alias("x")).select(*key, "position", "x.*")
    names = [*key, "level", "title", "parent_h1", "parent_h2"]
    return rows.groupBy(*names, "at").agg(F.min("position").alias("position")).select(*names, "position")


def outline_tree(nodes: DataFrame) -> DataFrame:
    """A row for each document of an outline: keys and ``nodes``, an array of nested level-1 nodes.

    A node is ``level, title, position, children``; third levels have none.  Children are gathered from the
    bottom up: third levels into arrays by pair of headings, these into arrays by
    first heading; all groups are within the document's keys.
    """
    key = by(nodes)
    leaf = "array<struct<level:int,title:string,position:int,children:array<string>>>"
    branch = "array<struct<level:int,title:string,position:int,children:" + leaf + ">>"
    node = lambda level, children: lambda x: F.struct(F.lit(level).alias("level"), x.title.alias("title"), x.position.alias("position"), children(x).alias("children"))
    no_leaf = lambda _: F.array().cast("array<string>")
    inside = lambda x: x.children
    # headings of the node itself, or of those it is below
    level = F.col("level")
    rows = nodes.select(*key, "level", "title", "position", F.when(level == 1, F.col("title")).otherwise(F.col("parent_h1")).alias("h1"), F.when(level == 2, F.col("title")).when(level == 3, F.col("parent_h2")).alias("h2"))
    in_order = lambda when, *fields: F.sort_array(F.collect_list(F.when(when, F.struct("position", *fields))))
    at = lambda n: F.min(F.when(level == n, F.col("position")))
    pairs = rows.groupBy(*key, "h1", "h2").agg(at(1).alias("first"), at(2).alias("position"), F.transform(in_order(level == 3, "title"), node(3, no_leaf)).cast(leaf).alias("children"))
    second = in_order(F.col("position").isNotNull(), F.col("h2").alias("title"), "children")
    heads = pairs.groupBy(*key, "h1").agg(F.min("first").alias("position"), F.transform(second, node(2, inside)).cast(branch).alias("children"))
    first = in_order(F.lit(True), F.col("h1").alias("title"), "children")
    return heads.filter("position IS NOT NULL").groupBy(*key).agg(F.transform(first, node(1, inside)).alias("nodes"))


def outline_depth(nodes: DataFrame) -> DataFrame:
    """Keys, ``depth, nodes`` of documents with an outline."""
    return nodes.groupBy(*by(nodes)).agg(F.max("level").alias("depth"), F.count("*").alias("nodes"))


def breadcrumb(document_title: Column) -> Column:
    """Document title and headings, joined."""
    return F.concat_ws(" > ", document_title, *(F.nullif(F.col(h), F.lit("")) for h in ("h1", "h2", "h3")))


def parent() -> Column:
    """Heading above a section's own, null at the top."""
    return F.when(_some("h3"), F.col("h2")).when(_some("h2"), F.col("h1"))


#: Groups of sections that are beside each other: which sections, below the same headings, and the heading shown; in order of precedence.
_BESIDE = {
    "third": (lambda: _some("h3"), ["h1", "h2"], "h3"),
    "second": (lambda: _some("h2") & ~_some("h3"), ["h1"], "h2"),
    "first": (lambda: _some("h1") & ~_some("h2"), [], "h1"),
}
#: Sections equal in all of this are twins, and not beside each other.
_TWIN = ["title", "h1", "h2", "h3", "content", "token_count"]


def _null_safe(heading: str) -> Column:
    return F.coalesce(F.col(heading), F.lit("\u0000"))


def sibling_groups(sections: DataFrame) -> DataFrame:
    """One row for each group of sections that are beside each other: keys, ``beside`` (which rule), ``under`` and ``members``.

    ``members`` (``position, twin, shown``, by position) is there once for all sections
    of the group, so the table is as large as the sections, however many stand together.
    """
    key = by(sections)
    parts = []
    for name, (inside, under, shown) in _BESIDE.items():
        rows = sections.filter(inside()).groupBy(*key, F.array(*map(_null_safe, under)).cast("array<string>").alias("under"))
        members = F.array_sort(F.collect_list(F.struct("position", F.xxhash64(*_TWIN).alias("twin"), F.col(shown).alias("shown"))))
        parts.append(rows.agg(members.alias("members")).withColumn("beside", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def siblings(sections: DataFrame) -> DataFrame:
    """Add ``siblings``: headings of sections beside each one, in order, repeats included.

    Beside are: level 3 under the same pair, else level 2 without a third under the
    same first, else level 1 without a second.  Sections equal in every value are not
    their own siblings.  Candidates are gathered for each group of headings, not for
    pairs of sections.  This is for the sink: each row has its whole list, so rows of a
    document grow with the square of its sections (:func:`sibling_groups` does not).
    """
    rows = sections.withColumn("twin", F.xxhash64(*_TWIN))
    for rule, (name, (inside, under, shown)) in enumerate(_BESIDE.items()):
        w = Window.partitionBy(*by(sections), *map(_null_safe, under))
        members = F.collect_list(F.when(inside(), F.struct("position", F.lit(rule).alias("rule"), "twin", F.col(shown).alias("shown")))).over(w)
        rows = rows.withColumn(name, F.when(inside(), members))
    none = F.array().cast("array<struct<position:int,rule:int,twin:bigint,shown:string>>")
    # one section may hold by two rules for different others: a third-level one without a second
    beside = F.array_sort(F.concat(*(F.coalesce(F.col(g), none) for g in _BESIDE)))
    seen = F.filter(beside, lambda s: s.twin != F.col("twin"))
    shown = lambda found: F.transform(F.filter(found, lambda s, i: ~F.coalesce(F.get(found, i - 1).position == s.position, F.lit(False))), lambda s: s.shown)
    return rows.withColumn("siblings", bind(seen, shown)).drop("twin", *_BESIDE)


def twin_key() -> Column:
    """A hash that twins share."""
    return F.xxhash64(*_TWIN)


def _strange(sections: DataFrame, labels: list[str], names: Column, place: str) -> DataFrame:
    """Add a boolean column for each of ``labels`` to ``sections``: whether one of the ``names`` (``array<struct<label, name>>``) with it is no title in the section's document.

    Titles and names of a document are stacked and told apart by one window within it; the
    section itself travels with its title, so it is made once and not joined.
    """
    own, rest = [*by(sections), place], [c for c in sections.columns if c not in (*by(sections), place)]
    stacked = sections.select(*own, F.struct(*rest).alias("_row"), F.explode(F.concat(F.array(F.struct(F.lit("title").alias("label"), F.col("title").alias("name"))), names)).alias("x"))
    stacked = stacked.select(*own, "x.*", F.when(F.col("x.label") == "title", F.col("_row")).alias("_row"))
    stacked = stacked.withColumn("known", F.max(F.col("label") == "title").over(Window.partitionBy(*by(sections), "name")))
    strange = lambda label: F.coalesce(F.bool_or((F.col("label") == label) & ~F.col("known")), F.lit(False)).alias(label)
    return stacked.groupBy(*own).agg(*map(strange, labels), F.first("_row", ignorenulls=True).alias("_row")).select(*own, "_row.*", *labels)


def unknown_siblings(sections: DataFrame, place: str = "position") -> DataFrame:
    """Add ``unknown_siblings``: whether a sibling of a section is no title of a section of its document.

    ``sections`` with a column ``siblings`` are judged by it.  Without, by what
    :func:`siblings` would list, and nothing is listed: a section has such a sibling if
    its groups hold more members with unknown headings than its twins do.  ``place``
    numbers the sections of a document.
    """
    key = by(sections)
    if "siblings" in sections.columns:
        named = F.filter(F.coalesce("siblings", F.array().cast("array<string>")), lambda x: x.isNotNull())
        return _strange(sections, ["unknown_siblings"], F.transform(named, lambda x: F.struct(F.lit("unknown_siblings").alias("label"), x.alias("name"))), place)
    rows = sections if "_twin" in sections.columns else sections.withColumn("_twin", twin_key())
    # only headings that a group shows are looked for, and none that is the section's own title
    headings = F.array_compact(F.array(*(F.when(inside() & ~F.col(h).eqNullSafe(F.col("title")), F.struct(F.lit(f"_no_{h}").alias("label"), F.col(h).alias("name"))) for inside, _, h in _BESIDE.values())))
    strange = [f"_no_{h}" for *_, h in _BESIDE.values()]
    rows = _strange(rows, strange, headings, place)
    unknown = lambda h: F.col(f"_no_{h}")
    count = lambda which, *under: F.coalesce(F.sum(which.cast("int")).over(Window.partitionBy(*key, *under)), F.lit(0))
    others = lambda which, *under: count(which, *under) - count(which, "_twin")
    below = {name: [F.when(inside(), F.lit(name)), *map(_null_safe, under)] for name, (inside, under, _) in _BESIDE.items()}
    third, first = _BESIDE["third"][0](), _BESIDE["first"][0]()
    bad = {f"_{name}": F.when(inside(), others(inside() & unknown(shown), *below[name])).otherwise(0) for name, (inside, _, shown) in _BESIDE.items()}
    # members of the first group that are also in a section's third group are shown by their third heading
    bad["_both"] = F.when(first & third, others(first & third & unknown("h1"), *below["third"])).otherwise(0)
    rows = rows.withColumns(bad).withColumn("unknown_siblings", F.col("_third") + F.col("_second") + F.col("_first") - F.col("_both") > 0)
    return rows.drop(*strange, *bad, *(() if "_twin" in sections.columns else ("_twin",)))


def enriched_content(document_title: Column) -> Column:
    """Content below its context: document, place and breadcrumb."""
    title = F.coalesce(F.nullif(document_title, F.lit("")), F.lit("Document"))
    crumb = F.coalesce(F.nullif(F.col("breadcrumb"), F.lit("")), F.nullif(F.col("title"), F.lit("")), F.lit(""))
    head = F.concat(F.lit("[Document: "), title, F.lit(" | Section "), F.col("position").cast("string"), F.lit("/"), F.col("n_sections").cast("string"), F.lit("]\n["), crumb, F.lit("]\n\n"))
    return strip(F.concat(head, "content"))
