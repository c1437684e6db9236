"""Segmentation of documents into sections under a three-level hierarchy of headings.

All windows and groups are by the keys of documents (``keys.py``): one shuffle, of
documents, serves line numbers, headings, sections and their positions.  Chunks are cut
within the row (:func:`sections_of`): no line is moved or sorted for them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import (
    CONSOLIDATE_OVER,
    CONTENTS_HEADINGS,
    GENERAL,
    KEYWORD_LETTERS,
    KEYWORDS,
    MAX_CHARS,
    MAX_TOKENS,
    MERGED_WORDS,
    MIN_WORDS,
    SECTION_TYPES,
    SMALL_WORDS,
    STOPWORDS,
    TOKEN_RATIO,
    UNTITLED_SECTION,
)
from ..functions.arrays import bind, groups, scan
from ..functions.text import count_words, estimate_tokens, strip
from .keys import by, keyed

# What headings look like.
_MARKDOWN = r"(?dU)^(#{1,6})\s+(.+)$"
_CHAPTER = r"(?diuU)^\*{0,2}CHAPITRE\s+([IVXLCDM\d]+)\s*[-–:]?\s*(.*?)\*{0,2}$"
_ARTICLE = r"(?diuU)^\*{0,2}Article\s+([A-Za-z0-9\s]+?\.?\d*)\s*[-–:]?\s*(.*?)\*{0,2}$"
_NUMBERED = r"(?dU)^(\d+\.\d+\.\d+(?:\.\d+)?)\s*[-–:]?\s*(.+)$"
_CAPITALS = r"(?dU)^\d+/\s+([A-Z\s]{3,80})$"


#: Characters of a content that are searched first for keywords that are only counted; results do not depend on it.
_BEGINNING = 300
#: Characters and tokens of a chunk at most.
LIMITS = (MAX_CHARS, MAX_TOKENS)


def split_lines(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keys, ``pos, line`` and the columns ``keep``: stripped lines that are not blank."""
    docs = keyed(docs)
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), strip)
    return docs.select(*by(docs), *keep, F.posexplode(lines).alias("pos", "line")).filter("line <> ''")


def _numbered(prefix: str, number: Column, dash: str, rest: Column) -> Column:
    rest = strip(F.regexp_replace(strip(rest), r"\*{1,2}", ""))
    return F.substring(F.concat(F.lit(prefix), number, F.when(rest != "", F.concat(F.lit(dash), rest)).otherwise("")), 1, 100)


def _kind(line: Column) -> Column:
    """Which of the five forms of headings a stripped line has; null for body lines, most of which their first character tells."""
    first = F.substring(line, 1, 1)
    number = ((first < ":") | (first > "~")) & first.rlike(r"(?U)\d")
    forms = F.when(line.startswith("#"), F.when(line.rlike(_MARKDOWN), "markdown"))
    forms = forms.when(first.isin("*", "C", "c", "A", "a"), F.when(line.rlike(_CHAPTER), "chapter").when(line.rlike(_ARTICLE), "article"))
    return forms.when(number, F.when(line.rlike(_CAPITALS), "capitals").when(line.rlike(_NUMBERED), "numbered"))


def _level(kind: Column, line: Column) -> Column:
    """Level of a heading (1 to 3) by its form."""
    hashes = F.length(F.regexp_extract(line, _MARKDOWN, 1))
    return F.when(kind == "markdown", (hashes - 1) % 3 + 1).when(kind.isin("chapter", "capitals"), 1).when(kind == "article", 2).when(kind == "numbered", 3).cast("int")


def _heading(kind: Column, line: Column) -> Column:
    """What a heading says, by its form."""
    part = lambda pattern, i: F.regexp_extract(line, pattern, i)
    markdown = F.substring(strip(F.regexp_replace(strip(part(_MARKDOWN, 2)), r"\*{1,2}", "")), 1, 100)
    numbered = F.substring(F.concat(part(_NUMBERED, 1), F.when(strip(part(_NUMBERED, 2)) != "", F.concat(F.lit(" – "), strip(part(_NUMBERED, 2)))).otherwise("")), 1, 100)
    return (
        F.when(kind == "markdown", markdown)
        .when(kind == "chapter", _numbered("CHAPITRE ", part(_CHAPTER, 1), " - ", part(_CHAPTER, 2)))
        .when(kind == "capitals", F.substring(strip(part(_CAPITALS, 1)), 1, 100))
        .when(kind == "article", _numbered("Article ", strip(part(_ARTICLE, 1)), " – ", part(_ARTICLE, 2)))
        .when(kind == "numbered", numbered)
    )


def classify_headers(lines: DataFrame) -> DataFrame:
    """Add ``level`` (1 to 3, null for body lines) and ``heading``."""
    line, kind = F.col("line"), F.col("kind")
    # a generator between, so that filters by level do not bring the patterns along several times
    lines = lines.select("*", F.explode(F.array(_kind(line))).alias("kind"))
    return lines.withColumns({"level": _level(kind, line), "heading": _heading(kind, line)}).drop("kind")


def carry_headings(lines: DataFrame) -> DataFrame:
    """Add ``section_id`` and the headings ``h1, h2, h3`` in force at each line; a heading resets those below it."""
    w = Window.partitionBy(*by(lines)).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    level = F.col("level")
    lines = lines.withColumns({
        "section_id": F.count("level").over(w),
        "g1": F.count(F.when(level == 1, 1)).over(w),
        "g2": F.count(F.when(level <= 2, 1)).over(w),
        "h1": F.last(F.when(level == 1, F.col("heading")), ignorenulls=True).over(w),
    })
    last = lambda n, group: F.last(F.when(level == n, F.struct(F.col(group).alias("g"), F.col("heading").alias("h"))), ignorenulls=True).over(w)
    lines = lines.withColumns({"l2": last(2, "g1"), "l3": last(3, "g2")})
    return lines.withColumns({"h2": F.when(F.col("l2.g") == F.col("g1"), F.col("l2.h")), "h3": F.when(F.col("l3.g") == F.col("g2"), F.col("l3.h"))}).drop("l2", "l3", "g1", "g2")


def emit_sections(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Body lines of each section as ``content`` with ``word_count``, ``first_pos`` (its first line) and the columns ``keep`` of its document; sections without a body are not there."""
    body = lines.filter("level IS NULL").groupBy(*by(lines), "section_id")
    rows = body.agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.first("h3").alias("h3"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"), F.min("pos").alias("first_pos"), *(F.first(c).alias(c) for c in keep))
    content = F.array_join(F.transform("lines", lambda x: x.line), "\n")
    # a generator between, so that filters by words do not join and count them again
    told = F.explode(F.array(bind(content, lambda c: F.struct(c.alias("content"), count_words(c).alias("word_count"))))).alias("x")
    return rows.select(*[c for c in rows.columns if c != "lines"], told).select("*", "x.content", "x.word_count").drop("x")


def _is_contents(h1: Column) -> Column:
    return F.coalesce(F.upper(h1), F.lit("")).isin(CONTENTS_HEADINGS)


def reject_reason(sections: DataFrame) -> DataFrame:
    """Add ``rejected``: ``contents`` (below a table of contents heading), ``short`` or null."""
    return sections.withColumn("rejected", F.when(_is_contents(F.col("h1")), "contents").when(F.col("word_count") < MIN_WORDS, "short"))


def sections_of(text: Column, kept: bool = True) -> Column:
    """Sections of a text in order, with a body and (if ``kept``) not rejected: ``array<struct>`` of ``section_id, h1, h2, h3, content, word_count, first_pos, position, n_sections``.

    The same as :func:`emit_sections` makes of lines, within the row.  Headings are grouped
    by the first level and these groups by the second, so that those in force are the
    first of their groups; each line is looked at a few times, however many sections there are.
    """

    def places(items: Column, begins: Callable[[Column], Column]) -> Column:
        every = F.transform(items, lambda x, i: F.when((i == 0) | begins(x), i))
        return F.array_compact(every)

    def grouped(items: Column, level: int, inside: Callable[[Column], Column]) -> Column:
        cut = bind(places(items, lambda x: x.level == level), lambda starts: groups(items, starts))
        return F.flatten(F.transform(cut, inside))

    def named(group: Column, level: int) -> Column:
        return bind(F.get(group, F.lit(0)), lambda first: F.when(first.level == level, first.heading))

    def below(first: Column, h1: Column) -> Column:
        section = lambda h2: lambda s: F.struct(s.section_id.alias("section_id"), h1.alias("h1"), h2.alias("h2"), F.when(s.level == 3, s.heading).alias("h3"), s["from"].alias("from"), s.to.alias("to"))
        return grouped(first, 2, lambda second: bind(named(second, 2), lambda h2: F.transform(second, section(h2))))

    def with_content(lines: Column, s: Column) -> Column:
        content = F.array_join(F.filter(F.slice(lines, s["from"] + 1, s.to - s["from"]), lambda x: x != ""), "\n")
        first = F.when(F.get(lines, s["from"]) != "", s["from"]).otherwise(F.get(F.filter(F.sequence(s["from"], s.to - 1), lambda i: F.get(lines, i) != ""), F.lit(0)))
        # a content begins and ends with a word, or is empty
        told = lambda c: F.struct(*(s[n].alias(n) for n in ("section_id", "h1", "h2", "h3")), c.alias("content"), F.when(c != "", F.size(F.split(c, r"(?U)\s++"))).otherwise(0).alias("word_count"), first.alias("first_pos"))
        return bind(content, told)

    def sections(lines: Column) -> Column:
        head = lambda at, line: bind(_kind(line), lambda kind: F.struct(at.alias("at"), _level(kind, line).alias("level"), _heading(kind, line).alias("heading")))
        heads = F.array_compact(F.transform(lines, lambda x, i: F.when(_kind(x).isNotNull(), head(i, x))))
        # what stands before the first heading has none
        none = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("heading")))
        item = lambda heads: lambda x, i: F.struct(i.cast("bigint").alias("section_id"), x.level.alias("level"), x.heading.alias("heading"), (x["at"] + 1).alias("from"), F.coalesce(F.get(heads, i + 1)["at"], F.size(lines)).alias("to"))
        items = bind(F.concat(none, heads), lambda heads: F.transform(heads, item(heads)))
        told = bind(items, lambda items: grouped(items, 1, lambda first: bind(named(first, 1), lambda h1: below(first, h1))))
        return F.transform(F.filter(told, lambda s: (s.to > s["from"]) & (F.lit(not kept) | ~_is_contents(s.h1))), lambda s: with_content(lines, s))

    found = F.filter(bind(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), sections), lambda s: s.word_count >= (MIN_WORDS if kept else 1))
    fields = ("section_id", "h1", "h2", "h3", "content", "word_count", "first_pos")
    return bind(found, lambda k: F.transform(k, lambda s, i: F.struct(*(s[n].alias(n) for n in fields), (i + 1).alias("position"), F.size(k).cast("bigint").alias("n_sections"))))


def sections(docs: DataFrame, keep: tuple[str, ...] = (), kept: bool = True) -> DataFrame:
    """A row for each section of ``docs`` (see :func:`sections_of`) with keys and the columns ``keep``."""
    docs = keyed(docs)
    return docs.select(*by(docs), *keep, F.explode(sections_of(F.col("text"), kept)).alias("x")).select(*by(docs), *keep, "x.*")


def section_type(content: Column) -> Column:
    """Type with most of its words in the content; ties go to the first, none is general."""

    def best(low: Column) -> Column:
        counts = {t: reduce(Column.__add__, [low.contains(w).cast("int") for w in words]) for t, words in SECTION_TYPES.items()}
        return F.array_max(F.array(*(F.struct(n.alias("n"), F.lit(-i).alias("order"), F.lit(t).alias("type")) for i, (t, n) in enumerate(counts.items()))))

    return bind(bind(F.lower(content), best), lambda x: F.when(x.n == 0, GENERAL).otherwise(x.type))


def _long_words(content: Column) -> Column:
    """Words that may be keywords, in order; letters are taken whole, as no word ends between two of them."""
    found = F.regexp_extract_all(F.lower(content), F.lit(rf"(?U)\b[{KEYWORD_LETTERS}]{{5,}}+\b"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(STOPWORDS))


def unranked_keywords(sections: DataFrame, top: int = KEYWORDS) -> DataFrame:
    """Add ``keywords``, as many as :func:`keywords` gives but the first, not the most frequent: for what counts them alone.

    Where the beginning of a content has as many, the rest is not searched; its last word is left out, as it may be cut off.
    """
    distinct = lambda words: F.slice(F.array_distinct(words), 1, top)
    begun = bind(_long_words(F.substring("content", 1, _BEGINNING)), lambda words: distinct(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))))
    found = bind(begun, lambda some: F.when(F.size(some) == top, some).otherwise(distinct(_long_words(F.col("content")))))
    return sections.select("*", F.explode(F.array(F.coalesce(found, F.array().cast("array<string>")))).alias("keywords"))


def keywords(sections: DataFrame, top: int = KEYWORDS) -> DataFrame:
    """Add ``keywords``: most frequent long words of ``content``, ties by first place; empty without any.

    Within the row: words with their places are sorted, so equal ones are side by side,
    and the first of each run counts by how far the next run is.
    """

    def ranked(words: Column) -> Column:
        return bind(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("pos")))), first_of_runs)

    def first_of_runs(words: Column) -> Column:
        runs = F.filter(F.transform(words, lambda x, k: F.struct(x.alias("own"), k.alias("k"))), lambda x: (x.k == 0) | (x.own.word != F.get(words, x.k - 1).word))
        return bind(runs, lambda runs: most_frequent(runs, F.size(words)))

    def most_frequent(runs: Column, n: Column) -> Column:
        counted = F.transform(runs, lambda x, i: F.struct((x.k - F.coalesce(F.get(runs, i + 1).k, n)).alias("n"), x.own.pos.alias("pos"), x.own.word.alias("word")))
        return F.transform(F.slice(F.sort_array(counted), 1, top), lambda x: x.word)

    # where no word is there twice, the first ones are it
    found = bind(_long_words(F.col("content")), lambda words: F.when(F.size(F.array_distinct(words)) == F.size(words), F.slice(words, 1, top)).otherwise(ranked(words)))
    # a generator between, so that filters by keywords do not rank them again
    return sections.select("*", F.explode(F.array(F.coalesce(found, F.array().cast("array<string>")))).alias("keywords"))


def section_title(h1: Column, h2: Column, h3: Column) -> Column:
    """Headings that are not empty, joined."""
    some = F.array_compact(F.array(*(F.nullif(h, F.lit("")) for h in (h1, h2, h3))))
    return F.when(F.size(some) > 0, F.array_join(some, " > ")).otherwise(UNTITLED_SECTION)


def with_positions(sections: DataFrame, order: tuple[str, ...] = ("section_id",)) -> DataFrame:
    """Number sections from 1 in each document and count them."""
    w = Window.partitionBy(*by(sections))
    return sections.withColumns({"position": F.row_number().over(w.orderBy(*order)), "n_sections": F.count("*").over(w)})


def chunk(docs: DataFrame, keep: tuple[str, ...] = (), enforce_cap: bool = False, limits: tuple[int, int] = LIMITS) -> DataFrame:
    """Sections of ``docs`` (``document_id, text``, columns ``keep``) that are kept, typed and titled, with their positions.

    Null and empty texts and texts whose sections are all rejected give no rows; rows
    with the same id, or none, stay apart.  With ``enforce_cap`` sections over the size
    limit are split between lines; without it they stay whole.
    """
    rows = sections(docs, keep).withColumn("title", section_title(F.col("h1"), F.col("h2"), F.col("h3")))
    content = F.col("content")
    told = {"type": section_type(content), "token_count": estimate_tokens(content)}
    if enforce_cap:
        return with_positions(split_large(rows.drop("position", "n_sections"), "\n", limits).withColumns(told), ("section_id", "part"))
    return rows.withColumns(told)


def has_header(text: Column) -> Column:
    """Whether a text has a heading of any form."""
    return F.exists(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: bind(strip(line), lambda s: _kind(s).isNotNull()))


def has_headers(docs: DataFrame) -> DataFrame:
    """``document_id, has_headers`` of each row of ``docs``, within the row."""
    return docs.select("document_id", has_header(F.col("text")).alias("has_headers"))


def is_oversize(content: Column, limits: tuple[int, int] = LIMITS) -> Column:
    """Over the limit of characters or tokens."""
    return (F.length(content) > limits[0]) | (estimate_tokens(content) > limits[1])


def split_paragraphs(content: Column, separator: str = "\n\n", limits: tuple[int, int] = LIMITS) -> Column:
    """Pack paragraphs greedily into parts within ``limits``; ``array<struct<part, content>>``.

    A paragraph over the limit stays whole; parts of fewer than ``MIN_WORDS`` words go
    after parts are numbered from 0.  Only lengths are folded; parts are cut out by place.
    """
    gap = len(separator)
    # the state is the length of the part so far, 0 before the first paragraph
    full = lambda state, p: (state > 0) & ((state + p.n + gap > limits[0]) | (((state + p.n + gap) / F.lit(TOKEN_RATIO)).cast("int") > limits[1]))
    cuts = lambda state, p: F.when((state == 0) | full(state, p), p.i)
    step = lambda state, p: F.when(full(state, p), p.n + gap).otherwise(state + p.n + gap)

    def parts(paragraphs: Column) -> Column:
        lengths = F.transform(paragraphs, lambda p, i: F.struct(F.length(p).alias("n"), i.alias("i")))
        packed = bind(scan(lengths, F.lit(0), step, cuts), lambda starts: groups(paragraphs, starts))
        return F.transform(packed, lambda g, i: F.struct(i.alias("part"), strip(F.array_join(g, separator)).alias("content")))

    return F.filter(bind(F.split(content, separator), parts), lambda p: count_words(p.content) >= MIN_WORDS)


def split_large(sections: DataFrame, separator: str = "\n\n", limits: tuple[int, int] = LIMITS) -> DataFrame:
    """Split oversize sections (``content, title, h2, h3``) into parts, from the second on marked ``(suite n)``; others stay as one."""
    rows = sections.withColumn("parts", F.when(is_oversize(F.col("content"), limits), split_paragraphs(F.col("content"), separator, limits)).otherwise(F.array(F.struct(F.lit(0).alias("part"), F.col("content").alias("content")))))
    rows = rows.select(*[c for c in sections.columns if c != "content"], F.explode("parts").alias("p")).select("*", "p.part", "p.content").drop("p", "parts")
    suffix = F.when(F.col("part") > 0, F.concat(F.lit(" (suite "), F.col("part").cast("string"), F.lit(")"))).otherwise("")
    h3 = F.when(F.coalesce("h3", F.lit("")) != "", F.concat("h3", suffix)).when((F.col("part") > 0) & (F.coalesce("h2", F.lit("")) != ""), F.concat("h2", suffix)).otherwise(F.col("h3"))
    return rows.withColumns({"title": F.concat("title", suffix), "h3": h3, "word_count": count_words(F.col("content")), "token_count": estimate_tokens(F.col("content"))})


_MERGED = "struct<section_id:bigint,h1:string,h2:string,h3:string,title:string,content:string,word_count:int,token_count:int>"


def merge_points(sections: Column) -> Column:
    """Places of the sections (``array<struct>`` with ``word_count, h1``) that begin a group of small ones.

    A section of fewer than ``SMALL_WORDS`` words takes what follows, under the same
    level-1 heading and up to ``MERGED_WORDS`` words, until it has as many.
    """
    joins = lambda state, s: (state.n > 0) & (state.words < SMALL_WORDS) & (state.words + s.words <= MERGED_WORDS) & state.h1.eqNullSafe(s.h1)
    # n: sections so far in the group, 0 before the first
    step = lambda state, s: F.struct(F.when(joins(state, s), state.n + 1).otherwise(1).alias("n"), F.when(joins(state, s), state.words + s.words).otherwise(s.words).alias("words"), F.when(joins(state, s), state.h1).otherwise(s.h1).alias("h1"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"), F.lit(None).cast("string").alias("h1"))
    light = F.transform(sections, lambda s, i: F.struct(s.word_count.cast("int").alias("words"), s.h1.alias("h1"), i.alias("i")))
    return scan(light, start, step, lambda state, s: F.when(~joins(state, s), s.i))


def consolidate(sections: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Merge small sections with followers under the same level-1 heading, in documents of more than ``CONSOLIDATE_OVER`` sections.

    Merged sections keep headings, title and token count of their first.  The fold is
    ordered, so a document's sections are one row there; the few of other documents are
    gathered too and stay as they are, so that sections are made once.
    """
    fields = [f.split(":")[0] for f in _MERGED[7:-1].split(",")]
    key = by(sections)
    listed = sections.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*fields).cast(_MERGED))).alias("all"), F.first("n_sections").alias("n_sections"), *(F.first(c).alias(c) for c in keep))
    places = F.transform("all", lambda _, i: i)
    listed = listed.withColumn("starts", F.when(F.col("n_sections") > CONSOLIDATE_OVER, merge_points(F.col("all"))).otherwise(places))

    def merged(group: Column) -> Column:
        first = F.get(group, F.lit(0))
        return first.withField("content", F.array_join(F.transform(group, lambda s: s.content), "\n\n")).withField("word_count", F.aggregate(group, F.lit(0), lambda n, s: n + s.word_count))

    packed = listed.select(*key, *keep, F.explode(groups(F.col("all"), F.col("starts"))).alias("g"))
    rows = packed.select(*key, *keep, F.explode(F.array(merged(F.col("g")))).alias("s")).select(*key, *keep, "s.*")
    return with_positions(rows.withColumn("type", section_type(F.col("content"))))
