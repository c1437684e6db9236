"""Personal data by bootstrapped contextual extraction.

Seeds are identifiers that patterns of their own form find for certain: e-mail
and IP addresses, card and phone numbers.  The places of seeds induce lexical
patterns: words before and after, and marks beside and shape of the token itself
(:func:`_patterns`).  Other tokens with a digit or ``@`` in such places are
candidates.  The graph of patterns and the strings (instances) found in them is
scored in rounds: a pattern is as trustworthy for a kind as the share of its
instances that are known to be of it, drawn to the share that patterns of its
family have on the whole; what trusted patterns hold counts as known in the next
round.  It ends when no pattern is new.  Candidates in the place of a trusted
pattern, of a form that suits the kind, become spans too.

Everything is built-in functions.  Spans are found within a row (``split`` gives
the gaps between matches, which add up to offsets); only the narrow edges of the
graph are shuffled, and only patterns with enough different instances stay in it.
All work within a row is linear in its text and in its matches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .source_mix import WORD
from .storage import release, settle

#: A pattern is trusted for a kind from so many known instances and such a share of all its
#: instances, with so many more reckoned at the rate of its family.
SUPPORT, TRUST, RECKONED = 3, 0.8, 2.0
#: Characters of the gap before or after a token that its context is taken from; a longer word counts by these.
CONTEXT_CHARS = 100
#: Elements that running values are computed over at a time, and characters of text cut at a time.
RUN, BLOCK = 64, 1024

_GAP = r"\x20\x09-\x0D"
# The forms of seeds, and cheap tests that a text may hold one.  Java may
# only start at the first character of a run, and repeated groups give nothing back (the
# groups cannot match otherwise), which keeps long runs linear and off the stack.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]"),
    "card": (r"[0-9]++(?:[\x20-][0-9]++)*+", r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
KINDS = tuple(BASE)
#: Forms of candidates that suit a kind (lower case, without punctuation around).
SUITS = {
    "email": r"^[^@]++@[^@]+$|^[a-z0-9._%+-]++[\[(]at[\])][a-z0-9.-]+$",
    "ip": r"^[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}$|^[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){2,7}$",
    "card": r"^[0-9](?:-?[0-9]){12,18}$",
    "phone": r"^(?=(?:[^0-9]*+[0-9]){7,12}[^0-9]*+$)[0-9().-]++$",
}
_CANDIDATE = rf"(?<![^{_GAP}])[^{_GAP}0-9@]*+[0-9@][^{_GAP}]*+"

_SPANS = "array<struct<start:int,end:int>>"
_NAMED = "array<struct<start:int,end:int,kind:string,token:string,before:string,after:string>>"
_PLACES = "array<struct<start:int,end:int,token:string,before:string,after:string>>"


def _raw(text: Column, name: str, pattern: str, may: Column) -> list[Column]:
    """Columns ``<name>_matches`` and ``<name>_gaps`` (one gap more than matches), empty where ``may`` is false."""
    none = F.array().cast("array<string>")
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return [F.when(may, x).otherwise(none).alias(f"{name}_{y}") for x, y in ((matches, "matches"), (gaps, "gaps"))]


def _running(name: str, combine: Callable[[Column, Column], Column]) -> Column:
    """For each integer of the array ``name`` what ``combine`` makes of those before it, from 0 on.

    An array that grows by an element is copied, so it is done in runs: over the totals
    of runs first, then within each.
    """
    values = F.col(name)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda k: F.slice(values, k * RUN + 1, F.lit(RUN)))
    grow = lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x)))
    totals = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda a, x: combine(a, x)))
    before = F.aggregate(totals, F.array(F.lit(0)), grow)
    inside = F.zip_with(runs, F.slice(before, F.lit(1), F.size(runs)), lambda run, start: F.slice(F.aggregate(run, F.array(start), grow), F.lit(1), F.size(run)))
    return F.when(F.size(values) > 0, F.flatten(inside)).otherwise(F.array().cast("array<int>"))


def _narrow(name: str) -> Column:
    """Matches of :func:`_raw` with the length of the gap before each and the text beside it."""
    matches, gaps = F.col(f"{name}_matches"), F.col(f"{name}_gaps")
    beside = lambda token, i: F.struct(
        F.length(F.get(gaps, i)).alias("skip"), F.length(token).alias("n"), token.alias("token"),
        F.right(F.get(gaps, i), F.lit(CONTEXT_CHARS)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT_CHARS)).alias("after"),
    )
    return F.transform(matches, beside)


def _placed(name: str) -> Column:
    """Places (offsets in code points, end exclusive) of the matches of :func:`_narrow`, with ``<name>_at`` added up."""

    def place(x: Column, at: Column) -> Column:
        start = at + x.skip
        return F.struct(start.alias("start"), (start + x.n).alias("end"), x.token.alias("token"), x.before.alias("before"), x.after.alias("after"))

    return F.zip_with(name, f"{name}_at", place).cast(_PLACES)


def _valid(kind: str, token: Column) -> Column:
    digits = F.regexp_replace(token, "[^0-9]", "")
    if kind == "ip":
        return token.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})){3}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _seed_matches(text: Column, kind: str) -> list[Column]:
    pattern, test = BASE[kind]
    return _raw(text, kind, pattern, text.contains(test) if kind == "email" else text.rlike(test))


def _trimmed(s: Column) -> Column:
    """A place without the punctuation around its token."""
    left = F.regexp_replace(s.token, r"^[^0-9A-Za-z@]+", "")
    core = F.regexp_replace(left, r"(?<=[0-9A-Za-z])[^0-9A-Za-z]+$", "")
    start = s.start + F.length(s.token) - F.length(left)
    cut = F.substring(s.token, F.lit(1), F.length(s.token) - F.length(left))
    rest = F.right(left, F.length(left) - F.length(core))
    return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("token"), F.concat(s.before, cut).alias("before"), F.concat(rest, s.after).alias("after"))


def _shape(token: Column) -> Column:
    """The token with runs of letters as ``a`` and digits as ``9``; at most 40 characters."""
    return F.left(F.regexp_replace(F.regexp_replace(token, "[0-9]", "9"), r"\p{L}++", "a"), F.lit(40))


def _mark(text: Column) -> Column:
    """What stands beside a token: a punctuation mark, the edge of a line (also of the text) or else a space."""
    return F.when(text == "", "line").when(text.rlike(r"^[\n\r]$"), "line").when(text.rlike(r"^[\p{L}\p{N}\s]$"), "space").otherwise(text)


def _signs(s: Column) -> Column:
    """What patterns of a place are made of."""
    before, after = (F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0)) for x in (s.before, s.after))
    return F.struct(
        s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"), F.lower(s.token).alias("token"), _shape(s.token).alias("shape"),
        F.slice(F.reverse(before), 1, 2).alias("before"), F.get(after, F.lit(0)).alias("after"), _mark(F.right(s.before, F.lit(1))).alias("open"), _mark(F.left(s.after, F.lit(1))).alias("close"),
    )


def _with_patterns(s: Column) -> Column:
    """Lexical patterns of a place, by family: two words before; words around; a word before or after, or the marks beside, with the shape of the token."""
    last, last_but_one = F.get(s.before, F.lit(0)), F.get(s.before, F.lit(1))
    families = {"2": (last_but_one, last), "1": (last, F.lit("_"), s.after), "b": (last, s["shape"]), "a": (s["shape"], s.after), "m": (s.open, s["shape"], s.close)}
    patterns = F.array(*(reduce(lambda x, y: F.concat(x, F.lit(" "), y), parts, F.lit(name)) for name, parts in families.items()))
    return F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"), s.token.alias("token"), F.array_compact(patterns).alias("patterns"))


def scan(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Find seeds and candidates: ``id, text_hash, <kind> ..`` (spans), the columns ``keep`` and ``places``.

    ``places`` holds ``start, end, kind, token, patterns`` of seeds, and of candidates with a null kind.
    """
    names = (*KINDS, "any")
    rows = docs.select("id", *keep, F.coalesce("text", F.lit("")).alias("_text"))
    raw = [c for k in KINDS for c in _seed_matches(F.col("_text"), k)] + _raw(F.col("_text"), "any", _CANDIDATE, F.col("_text").rlike("[0-9@]"))
    rows = rows.select("id", *keep, F.xxhash64("_text").alias("text_hash"), *raw)
    rows = rows.select("id", *keep, "text_hash", *(_narrow(k).alias(k) for k in names))
    rows = rows.select("*", *(F.transform(k, lambda x: x.skip + x.n).alias(f"{k}_long") for k in names))
    rows = rows.select("*", *(_running(f"{k}_long", lambda a, b: a + b).alias(f"{k}_at") for k in names))
    rows = rows.select("id", *keep, "text_hash", *(_placed(k).alias(k) for k in names))
    valid = lambda k: lambda s: _valid(k, s.token)
    some = lambda s: s.token.rlike("[0-9A-Za-z]")
    rows = rows.select("id", *keep, "text_hash", *(F.filter(k, valid(k)).alias(k) for k in KINDS), F.filter(F.transform("any", _trimmed), some).alias("any"))
    # candidates that overlap no seed: both in order, a seed first where they start together, and how far seeds before each one reach
    none = F.lit(None).cast("string")
    seeds = (F.transform(k, lambda s: F.struct(s.start.alias("start"), F.lit(0).alias("k"), s.end.alias("end"), none.alias("token"), none.alias("before"), none.alias("after"))) for k in KINDS)
    others = F.transform("any", lambda s: F.struct(s.start.alias("start"), F.lit(1).alias("k"), s.end.alias("end"), s.token.alias("token"), s.before.alias("before"), s.after.alias("after")))
    rows = rows.withColumn("order", F.when(F.size("any") > 0, F.array_sort(F.concat(*seeds, others))))
    rows = rows.withColumn("reach", F.transform("order", lambda x: F.when(x.k == 0, x.end).otherwise(0)))
    rows = rows.withColumn("ends", _running("reach", F.greatest))
    # a column that a lambda names once would be evaluated for each element, so neighbours are zipped
    beside = F.arrays_zip("order", "ends", F.slice("order", F.lit(2), F.greatest(F.size("order"), F.lit(1))).alias("next"))
    apart = lambda x: (x["order"].k == 1) & (x.ends <= x["order"].start) & ~F.coalesce((x.next.k == 0) & (x.next.start < x["order"].end), F.lit(False))
    rows = rows.withColumn("free", F.transform(F.filter(beside, apart), lambda x: x["order"]))
    named = lambda kind: lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), kind.alias("kind"), s.token.alias("token"), s.before.alias("before"), s.after.alias("after"))
    found = F.transform("free", named(none))
    places = F.concat(*(F.transform(k, named(F.lit(k))) for k in KINDS), F.coalesce(found, F.array().cast(_NAMED)))
    spans = [F.transform(k, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))).cast(_SPANS).alias(k) for k in KINDS]
    rows = rows.select("id", "text_hash", *keep, *spans, places.alias("places"))
    rows = rows.withColumn("places", F.transform("places", _signs))
    return rows.withColumn("places", F.transform("places", _with_patterns))


def _suiting(kind: str) -> Column:
    """Whether ``token`` has a form that suits the kind named by the column ``kind``."""
    return reduce(lambda rest, k: F.when(F.col(kind) == k, F.col("token").rlike(SUITS[k])).otherwise(rest), KINDS, F.lit(False))


def graph(scanned: DataFrame) -> DataFrame:
    """Edges ``pattern, token, kind`` (null: not a seed anywhere in that pattern), ``instances`` (of the pattern): those of patterns with ``SUPPORT`` instances."""
    edges = scanned.select(F.explode("places").alias("s")).select("s.token", "s.kind", F.explode("s.patterns").alias("pattern"))
    edges = edges.groupBy("pattern", "token").agg(F.max("kind").alias("kind"))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("instances")).filter(F.col("instances") >= SUPPORT)
    return edges.join(sizes, "pattern")


def trusted_patterns(edges: DataFrame) -> DataFrame:
    """``pattern, kind, trust`` of the patterns of :func:`graph` that earn trust in some round, as a settled table."""
    family = F.substring("pattern", 1, 1)
    rate = edges.groupBy(family.alias("family")).agg(F.count("*").alias("edges"), *(F.count_if(F.col("kind") == k).alias(k) for k in KINDS)).collect()
    share = {k: reduce(lambda rest, r: F.when(family == r["family"], r[k] / r["edges"]).otherwise(rest), rate, F.lit(0.0)) for k in KINDS}  # noqa: B023
    background = reduce(lambda rest, k: F.when(F.col("kind") == k, share[k]).otherwise(rest), KINDS, F.lit(0.0))
    trusted, n = None, 0
    while True:
        held = edges.withColumn("score", F.lit(1.0))
        if trusted is not None:  # instances of trusted patterns are known from now on
            found = edges.filter("kind IS NULL").join(trusted.select("pattern", F.col("kind").alias("as"), "trust"), "pattern").filter(_suiting("as"))
            found = found.groupBy("token").agg(F.max_by("as", F.struct("trust", "as")).alias("as"), F.max("trust").alias("trust"))
            held = edges.join(found, "token", "left").withColumn("score", F.when(F.col("kind").isNull(), F.col("trust")).otherwise(1.0)).withColumn("kind", F.coalesce("kind", "as"))
        scored = held.filter("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.sum("score").alias("score"), F.count("*").alias("support"), F.first("instances").alias("instances"))
        trust = (F.col("score") + RECKONED * background) / (F.col("instances") + RECKONED)
        new = scored.select("pattern", "kind", trust.alias("trust"), "support").filter((F.col("support") >= SUPPORT) & (F.col("trust") >= TRUST)).drop("support")
        if trusted is not None:  # what has earned trust keeps it, so the rounds end
            new = new.unionByName(trusted).groupBy("pattern", "kind").agg(F.max("trust").alias("trust"))
        last, trusted = trusted, settle(new)
        release(last)
        before, n = n, trusted.count()
        if n == before:
            return trusted


def find(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Find personal data in ``docs`` (``id, text``).

    Returns a row for each input row: ``id``, the columns ``keep`` and for each kind
    (``email, ip, card, phone``) two arrays of ``start, end``: ``<kind>``, the base
    spans, and ``<kind>_more``, those that patterns discovered; offsets are code
    points, both in order, and discovered spans overlap no base span.  Null and empty
    texts have none; repeated rows have the same; texts may be of any length; of
    patterns with equal trust the last kind by name counts; an empty table gives an
    empty one.
    """
    scanned = settle(scan(docs, keep))
    none = F.array().cast(_SPANS)
    edges = settle(graph(scanned))
    trusted = trusted_patterns(edges)
    release(edges)
    if trusted.isEmpty():
        return scanned.select("id", *keep, *KINDS, *(none.alias(f"{k}_more") for k in KINDS))
    places = scanned.select("id", "text_hash", F.explode("places").alias("c")).filter("c.kind IS NULL").select("id", "text_hash", "c.start", "c.end", "c.token", F.explode("c.patterns").alias("pattern"))
    places = places.filter(reduce(Column.__or__, (F.col("token").rlike(SUITS[k]) for k in KINDS)))
    places = places.join(trusted, "pattern").filter(_suiting("kind")).groupBy("id", "text_hash", "start", "end").agg(F.max_by("kind", F.struct("trust", "kind")).alias("kind"))
    own = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("start", "end")))).cast(_SPANS).alias(f"{k}_more")
    more = places.groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).agg(*map(own, KINDS))
    out = scanned.join(more, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return out.select("id", *keep, *KINDS, *(F.coalesce(f"{k}_more", none).alias(f"{k}_more") for k in KINDS))


def redact(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Replace personal data in ``text`` by its kind in square brackets; overlapping spans become one.

    Returns ``id``, ``text`` and the columns ``keep`` of ``docs``; null texts stay null.
    """
    found = find(docs, ("text", *keep))
    marked = lambda k: lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit(f"[{k.upper()}]").alias("mark"))
    rows = found.select("id", "text", *keep, F.array_sort(F.concat(*(F.transform(c, marked(k)) for k in KINDS for c in (k, f"{k}_more")))).alias("_spans"))
    rows = rows.withColumn("_reach", F.transform("_spans", lambda s: s.end))
    rows = rows.withColumn("_ends", _running("_reach", F.greatest))
    # the first span of each run of overlapping ones, and where the run before it ends
    first = F.filter(F.zip_with("_spans", "_ends", lambda s, before: F.struct(s.start.alias("start"), before.alias("before"), s.mark.alias("mark"))), lambda s: s.start >= s.before)
    rows = rows.withColumn("_first", first).withColumn("_blocks", F.when(F.size("_spans") > 0, F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))))

    def piece(start: Column, end: Column) -> Column:
        """Text between two offsets, from its blocks."""
        i, j = (F.floor(x / BLOCK).cast("int") for x in (start, end))
        block = lambda k: F.coalesce(F.get("_blocks", k), F.lit(""))
        far = F.concat(F.substring(block(i), F.pmod(start, F.lit(BLOCK)) + 1, F.lit(BLOCK)), F.array_join(F.slice("_blocks", i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(block(j), F.lit(1), F.pmod(end, F.lit(BLOCK))))
        return F.when(i == j, F.substring(block(i), F.pmod(start, F.lit(BLOCK)) + 1, end - start)).otherwise(far)

    cut = F.transform("_first", lambda s: F.concat(piece(s.before, s.start), s.mark))
    tail = piece(F.array_max("_reach"), F.length("text"))
    text = F.when(F.size("_spans") > 0, F.concat(F.array_join(cut, ""), tail)).otherwise(F.col("text"))
    return rows.select("id", text.alias("text"), *keep)


def redacted_documents(docs: DataFrame) -> DataFrame:
    """A ``documents`` table with :func:`redact` applied and ``n_chars`` counted anew; other columns stay.

    Null and empty texts stay; rows without an id and repeated rows are redacted as others; an empty table stays empty.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.struct(F.lit(0).alias("_"), *rest).alias("_row"))
    out = redact(rows, ("_row",))
    new = {"doc_id": F.col("id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in docs.columns))


def op5(docs: DataFrame) -> DataFrame:
    """Counts and spans of personal data for a ``documents`` table."""
    out = find(docs.select(F.col("doc_id").alias("id"), "text"))

    def listed(more: bool) -> Column:
        named = lambda k: lambda s: F.concat_ws(":", F.lit(k), s.start.cast("string"), s.end.cast("string"))
        parts = []
        for k in KINDS:
            spans = F.array_sort(F.concat(F.col(k), F.col(f"{k}_more"))) if more else F.col(k)
            parts.append(F.transform(spans, named(k)))
        return F.array_join(F.concat(*parts), ",")

    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed(False), 256).alias("base_sha256"), listed(True).alias("spans"))
