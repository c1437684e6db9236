"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, served again from the
start when it runs out (at most ``MAX_REPEATS`` times).  The weight of a queue is
its target in words, so a copy's virtual finish time is the words its source has
handed out by then, divided by that target.  All copies are range-sorted by
virtual finish time into one stream, which is truncated at the total budget: words
are added up by range of virtual time, and within the range where the budget ends
row by row (:func:`cut`).  So that no source misses its target by a long document,
a copy in service when targets are reached (at virtual time 1) is sent in packets
of a few words, as networks send them.

Running totals need no task that holds a whole source: documents are dealt by
the shuffle hash into slices of bounded size, slices are added up by window over
their sums alone, and documents within a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import release, settle

WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes, and how often a document may occur in it.
BUDGET = 1.5
MAX_REPEATS = 2
#: Documents in a slice of a source, about.
SLICE = 4000
#: Packets that a copy in service is sent in, at most; ranges of virtual time that words are
#: added up by, and how often the range where the budget ends is itself cut into so many.
PACKETS, RANGES, LEVELS = 1024, 4096, 2
SEED = 20_011
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, n_docs, target`` of each source of ``sized`` (``source, size``).

    Sources by code point, null last, weigh ``weights`` in turn.  A target stops at
    ``repeats`` times the source's size and the excess goes to the others by weight:
    with sources ordered by that cap per weight, those below the water level are
    the ones that are full.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    sums = sums.withColumn("weight", weight).withColumn("cap", (repeats * F.col("source_size")).cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = budget * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    # the level if this source and those above it are not full; right, and greatest, at the first that is not
    level = sums.withColumn("level", left / open_weight).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    water = F.max(F.when(F.col("fits"), F.col("level"))).over(every)
    target = F.least(F.coalesce(water, F.lit(0.0)) * F.col("weight"), F.col("cap"))
    return level.withColumn("target", target).select("source", "source_size", "n_docs", "target")


def schedule(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = MAX_REPEATS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Serve each document of ``docs`` (``id, source, text``; of other columns, those in ``keep`` come along).

    Returns a row for each input row: ``id, source, size, source_size, target``, ``keep`` and
    ``copies``, an array of ``copy, start, finish`` (virtual times) and ``taken``
    (words before the end of the budget) with one entry for each copy of which
    words are taken.  Null and empty texts have size 0 and no copies; null is a
    source of its own; repeated rows are documents of their own; copies that finish
    at the same time are served by a hash of id, text and size; texts of any length are
    counted whole; an empty table gives an empty one.
    """
    order = F.xxhash64("id", "text", F.lit(SEED))  # with the text, so that rows that share an id are dealt apart
    sized = settle(docs.select("id", "source", n_words(F.col("text")).alias("size"), order.alias("turn"), *keep))
    by_source = targets(sized, weights, budget, repeats)
    served = _served(sized, by_source, repeats, keep)
    end = cut(stream(_served(sized, by_source, repeats, ())), by_source)

    def taken(c: Column) -> Column:
        """Words of a copy's packets that the stream has before its end."""
        before = F.floor((end["finish"] * F.col("target") - c.served) / c.packet + 1e-6) if end else F.lit(0)  # a quotient of whole numbers, but for rounding
        packets = F.greatest(F.lit(0), F.least(c.size, before.cast("long") * c.packet))
        whole = (c.packet >= c.size) & ((c.finish < end["finish"]) | ((c.finish == end["finish"]) & (c.tie <= end["tie"]))) if end else F.lit(False)
        return F.when(whole, c.size).when(c.packet >= c.size, F.lit(0)).otherwise(packets)

    out = F.transform("copies", lambda c: F.struct(c["copy"].alias("copy"), c.start.alias("start"), c.finish.alias("finish"), taken(c).cast("long").alias("taken")))
    return served.select("id", "source", "size", "source_size", "target", *keep, F.filter(out, lambda c: c.taken > 0).alias("copies"))


def _served(sized: DataFrame, by_source: DataFrame, repeats: int, keep: tuple[str, ...]) -> DataFrame:
    """Add ``source_size, target`` and ``copies``: ``copy, served`` (words of the source before it), ``start, finish, size, packet, tie``."""
    rows = sized.join(by_source.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    slices = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / SLICE))
    rows = rows.withColumn("slice", F.floor((F.shiftrightunsigned("turn", 33) / F.lit(1 << 31)) * slices))
    # the sums of slices, added up
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("of"), F.col("slice").alias("part"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("words_before"))
    within = Window.partitionBy("source", "slice").orderBy(F.shiftrightunsigned("turn", 33), "turn", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("words_within", F.sum("size").over(within))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("part")))
    served = F.col("words_before") + F.col("words_within")

    def copy(i: int) -> Column:
        finish = served + i * F.col("source_size")
        start = finish - F.col("size")
        in_service = (start < F.col("target")) & (finish > F.col("target"))
        packet = F.when(in_service, F.ceil(F.col("size") / PACKETS)).otherwise(F.col("size"))
        return F.struct(
            F.lit(i).alias("copy"), start.alias("served"), F.try_divide(start, "target").alias("start"), F.try_divide(finish, "target").alias("finish"),
            F.col("size").alias("size"), packet.cast("long").alias("packet"), F.xxhash64("turn", "size", F.lit(i)).alias("tie"),
        )

    copies = F.filter(F.array(*map(copy, range(repeats))), lambda c: (c.size > 0) & c.finish.isNotNull())
    return rows.select("id", "source", "size", "source_size", "target", *keep, copies.alias("copies"))


def stream(served: DataFrame) -> DataFrame:
    """The mix in order: ``finish, tie, words`` of each copy or packet, range-sorted by virtual finish time; parts of it are sorted runs."""
    rows = served.select("target", F.explode("copies").alias("c")).select("target", "c.*")
    packets = F.ceil(F.col("size") / F.col("packet")).cast("int")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), packets)))
    ends = F.least(F.col("k") * F.col("packet"), F.col("size"))
    rows = rows.select(F.when(F.col("k") == packets, F.col("finish")).otherwise((F.col("served") + ends) / F.col("target")).alias("finish"), "tie", (ends - (F.col("k") - 1) * F.col("packet")).alias("words"))
    return rows.repartitionByRange("finish", "tie").sortWithinPartitions("finish", "tie")


def cut(sent: DataFrame, by_source: DataFrame) -> dict | None:
    """``finish, tie`` of the last row of the :func:`stream` that the budget (all targets) has room for; None if it has for none."""
    budget = by_source.agg(F.sum("target").alias("words")).first()["words"]
    if not budget:
        return None
    sent = settle(sent)
    limit, before, start, width, inside = int(budget + 0.5), 0, 0.0, float(MAX_REPEATS), sent
    upto = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for _ in range(LEVELS):
        # words of ranges of virtual time, added up: at most so many rows as there are ranges
        inside = inside.withColumn("range", F.least(F.floor((F.col("finish") - start) / (width / RANGES)), F.lit(RANGES)))
        sums = inside.groupBy("range").agg(F.sum("words").alias("words")).withColumn("upto", F.lit(before) + F.sum("words").over(upto("range")))
        crossed = sums.filter(F.col("upto") > limit).orderBy("range").first()
        if crossed is None:  # the budget has room for all
            break
        inside = inside.filter(F.col("range") == crossed["range"])
        before, start, width = crossed["upto"] - crossed["words"], start + crossed["range"] * (width / RANGES), width / RANGES
    last = inside.orderBy(F.desc("finish"), F.desc("tie")) if crossed is None else inside.withColumn("upto", F.lit(before) + F.sum("words").over(upto("finish", "tie"))).filter(F.col("upto") <= limit).orderBy(F.desc("finish"), F.desc("tie"))
    found = last.select("finish", "tie").first()
    release(sent)
    return found.asDict() if found else {"finish": start, "tie": -(1 << 63)}


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of a ``documents`` table that the mix takes, a row for each copy, in its columns.

    A copy that the end of the budget cuts keeps its first words, joined by one space.
    Each row has its own copies, with or without an id and whether or not others share
    it; null and empty texts have no words to take; an empty table stays empty.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "source", "n_chars")]
    rows = docs.select(F.col("doc_id").alias("id"), "text", "source", F.struct(F.lit(0).alias("_"), *rest).alias("_row"))
    scheduled = schedule(rows, keep=("text", "_row"))
    rows = scheduled.select("id", "text", "source", "_row", "size", F.explode("copies").alias("c")).select("*", "c.taken")
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("taken").cast("int"))
    text = F.when(F.col("taken") < F.col("size"), F.array_join(words, " ")).otherwise(F.col("text"))
    new = {"doc_id": F.col("id"), "text": text, "source": F.col("source"), "n_chars": F.length(text).cast("long")}
    return rows.select(*(new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in docs.columns))


def op4(docs: DataFrame) -> DataFrame:
    """Words that the mix takes of each document of a ``documents`` table."""
    out = schedule(docs.select(F.col("doc_id").alias("id"), "source", "text"))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c.taken)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", F.col("target").cast("double").alias("target"), taken.alias("taken"), F.get("copies", F.lit(0)).finish.alias("finish"))
