"""N-gram Jaccard join by token-combination prefixes.

Tokens are word shingles.  They are ordered by (frequent?, hash), so rare ones
come first; a document's prefix holds so many of its tokens that two documents
above the threshold share one of them.

* Rare tokens of the prefix are indexed one by one.
* A document with so many frequent tokens that it could be linked through them
  alone has its prefix extended to all of them, and combinations are indexed:
  its frequent tokens are dealt by hash into one group more than two linked
  documents of that length can differ in tokens, so one group at least is the
  same in both.  That takes about nine tokens a key at 90 % and as many keys as
  the plain prefix, where all k-subsets would grow as a power of the length.

Documents with the same token set are one *node*.  Documents that share a key
are verified: first each with one document of its keys (that settles groups of
copies in a pass linear in their size), at last every pair that shares a key and
is not yet known to be in one component.  A pair is first bounded by its
*sketches*, counts of the tokens in ``CELLS`` ranges of hashes: two sets share no
more than the sum of the lesser counts.  Only pairs that may pass fetch sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .components import connected_components
from .storage import release, settle
from .words import mix, text_slices, window_hashes, word_hashes

#: Tokens in more documents than this are frequent.
FREQUENT = 32
#: So many of them are told apart at most (8 bytes each, sent to every task): the most
#: frequent ones.  Others count as rare; that changes the order and no result.
MOST_FREQUENT = 1 << 20
#: Ranges of hashes whose tokens a sketch counts, a byte each.
CELLS = 256
#: Sketches made at a time.
ROWS = 4096
#: Keys that more sets share are compared in blocks of ``BLOCK`` sets, and only pairs that may be linked are emitted.
SMALL_GROUP, BLOCK = 16, 4096
#: Names of sets that a task remembers so as not to index copies again.
REMEMBERED = 200_000
#: Rounds in which each document is verified against one other, before all pairs left.
STAR_ROUNDS = 2

_U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct shingles of a slice of texts, sorted by both.

    A text of fewer than ``size`` words has all of them as its one shingle.
    """
    words, first = word_hashes(data, offsets, fold_case=True)
    count = np.diff(first)
    rows, hashes = [], []
    for length in range(1, size + 1):
        h = window_hashes(words, length)
        if length < size:
            own = np.flatnonzero(count == length)
            rows.append(own)
            hashes.append(h[first[own]])
        elif len(h):
            row = np.repeat(np.arange(len(count)), count)[: len(h)]
            whole = np.arange(len(h)) + size <= first[1:][row]
            rows.append(row[whole])
            hashes.append(h[whole])
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[keep], h[keep]


def _nodes(row: np.ndarray, h: np.ndarray, n_rows: int) -> tuple[np.ndarray, list[bytes | None]]:
    """Set sizes and 128-bit names of the sets; an empty set has no name."""
    size = np.bincount(row, minlength=n_rows)
    at = np.concatenate([[0], np.cumsum(size)[:-1]])[size > 0]
    name = np.zeros((n_rows, 2), _U)
    for i, salt in enumerate((0x2545F4914F6CDD1D, 0x94D049BB133111EB)):
        if len(at):
            name[size > 0, i] = np.add.reduceat(mix(h ^ _U(salt)), at)
    raw = name.tobytes()
    return size, [raw[16 * i : 16 * i + 16] if n else None for i, n in enumerate(size)]


def _needed(size: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a set shares with any linked one, at least."""
    return -(-percent * size // 100)


def length_class(size: int, percent: int) -> tuple[int, int]:
    """Index and greatest size of the class of set sizes that ``size`` is in.

    The sizes that can be linked lie in the same class or the next one.
    """
    low, index = 1, 0
    while True:
        high = max(low, 100 * low // percent)
        if size <= high:
            return index, high
        low, index = high + 1, index + 1


def _combinations(frequent: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Keys of one document's combinations of frequent tokens."""
    keys = []
    index, high = length_class(size, percent)
    classes = [(index, high)]
    if index:
        low = size
        while length_class(low, percent)[0] == index:
            low -= 1
        if -(-percent * size // 100) <= low:
            classes.append((index - 1, low))
    salted = mix(frequent ^ _U(0xD1B54A32D192ED03))
    for k, top in classes:
        groups = top * (100 - percent) // percent + 1
        name = np.zeros(groups, _U)
        np.add.at(name, (salted % _U(groups)).astype(np.int64), mix(frequent ^ _U(0xA24BAED4963EE407)))
        place = np.arange(groups, dtype=_U) + _U(k << 40) + _U(1 << 60)
        keys.append(mix(name + mix(place)))
    return np.concatenate(keys)


def _first_seen(names: list[bytes | None], seen: set[bytes]) -> np.ndarray:
    """True for the rows whose set is the first of its name among the last ``REMEMBERED`` of this task."""
    if len(seen) > REMEMBERED:
        seen.clear()
    out = np.zeros(len(names), bool)
    for i, x in enumerate(names):
        if x is not None and x not in seen:
            seen.add(x)
            out[i] = True
    return out


def _short(names: list[bytes | None]) -> np.ndarray:
    """First halves of names; sets that share one are told apart when they are compared."""
    return np.array([int.from_bytes(x[:8], "little", signed=True) if x else 0 for x in names], np.int64)


def _sketches(row: np.ndarray, h: np.ndarray, n_rows: int) -> list[bytes]:
    """Counts of tokens in each range of hashes; a full one stands for any number."""
    cell = (h >> _U(64 - CELLS.bit_length() + 1)).astype(np.int64)
    out = []
    for start in range(0, n_rows, ROWS):
        n = min(ROWS, n_rows - start)
        low, high = np.searchsorted(row, [start, start + n])
        counts = np.bincount((row[low:high] - start) * CELLS + cell[low:high], minlength=n * CELLS)
        raw = np.minimum(counts, 0xFF).astype(np.uint8).tobytes()
        out += [raw[CELLS * i : CELLS * (i + 1)] for i in range(n)]
    return out


def _may_link(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (``a, b, sa, sb``) whose sketches allow the similarity."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, CELLS) for i in (2, 3))
        shared, total = np.minimum(x, y).sum(1, dtype=np.int64), x.sum(1, dtype=np.int64) + y.sum(1, dtype=np.int64)
        full = (np.maximum(x, y) == 0xFF).any(1)
        use = pa.array(full | (100 * shared >= percent * (total - shared)))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(use)


def _close_in_blocks(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of ``rows`` (``key, rep, c, m``) that share a key, lie in different components and may be linked.

    The sets of a key are dealt into blocks by hash; a task compares two blocks.
    """
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = rows.join(sketches, "rep").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "c", "sketch")

    def compare(table: pa.Table) -> pa.Table:
        ids, c, own = (table[x].to_numpy() for x in ("rep", "c", "own"))
        cells = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, CELLS)
        size, full = cells.sum(1, dtype=np.int64), (cells == 0xFF).any(1)
        left, right = np.flatnonzero(own == table["low"][0].as_py()), np.flatnonzero(own == table["high"][0].as_py())
        found = []
        for i in left:
            alike = right[(c[right] != c[i]) & (100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i]) | full[right] | full[i])]
            shared = np.minimum(cells[alike], cells[i]).sum(1, dtype=np.int64)
            close = alike[full[alike] | full[i] | (100 * shared >= percent * (size[alike] + size[i] - shared))]
            found += [(max(ids[i], ids[k]), min(ids[i], ids[k])) for k in close]
        pairs = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.groupBy("key", "low", "high").applyInArrow(compare, "a long, b long")


def _members(docs: DataFrame, size: int) -> DataFrame:
    """``id, n, node, short, sketch`` of each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch.column(1)):
                row, h = shingles(data, offsets, size)
                n, names = _nodes(row, h, end - start)
                yield pa.record_batch({"id": batch.column(0).slice(start, end - start), "n": pa.array(n, pa.int64()), "node": pa.array(names, pa.binary()), "short": _short(names), "sketch": pa.array(_sketches(row, h, end - start), pa.binary())})

    return docs.mapInArrow(scan, "id long, n long, node binary, short long, sketch binary")


def _counted_tokens(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Tokens of prefixes by hash, longer by a quarter so that frequent ones at their ends are counted too."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for start, end, data, offsets in text_slices(batch.column(1)):
                row, h = shingles(data, offsets, size)
                n, names = _nodes(row, h, end - start)
                begin = np.concatenate([[0], np.cumsum(n)[:-1]])
                rank = np.arange(len(row)) - begin[row]
                use = _first_seen(names, seen)[row] & (4 * rank < 5 * (n - _needed(n, percent) + 1)[row])
                yield pa.record_batch({"h": h[use].view(np.int64)})

    return docs.mapInArrow(scan, "h long")


def _frequent(docs: DataFrame, size: int, percent: int) -> np.ndarray:
    counted = _counted_tokens(docs, size, percent).groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") > FREQUENT)
    top = counted.orderBy(F.desc("c"), "h").limit(MOST_FREQUENT).select("h").toPandas()
    return np.sort(top["h"].to_numpy(np.int64).view(_U))


def _postings(docs: DataFrame, size: int, percent: int, common: object) -> DataFrame:
    """``key, node``: index keys of each set; the first half of its name serves as node here."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held = common.value
        for batch in batches:
            for start, end, data, offsets in text_slices(batch.column(1)):
                row, h = shingles(data, offsets, size)
                n, names = _nodes(row, h, end - start)
                new = _first_seen(names, seen)
                row, h = row[new[row]], h[new[row]]
                if not len(row):
                    continue
                frequent = np.zeros(len(h), bool)
                if len(held):
                    frequent = held[np.minimum(np.searchsorted(held, h), len(held) - 1)] == h
                n_frequent = np.bincount(row[frequent], minlength=len(n))
                rare_row, rare = row[~frequent], h[~frequent]
                n_rare = np.bincount(rare_row, minlength=len(n))
                rank = np.arange(len(rare)) - np.concatenate([[0], np.cumsum(n_rare)[:-1]])[rare_row]
                use = rank < (n - _needed(n, percent) + 1)[rare_row]
                owners, keys = [rare_row[use]], [mix(rare[use])]
                at = np.concatenate([[0], np.cumsum(n_frequent)])
                tokens = h[frequent]
                for i in np.flatnonzero((n_frequent > 0) & (n_frequent >= _needed(n, percent))):
                    own = _combinations(tokens[at[i] : at[i + 1]], int(n[i]), percent)
                    owners.append(np.full(len(own), i))
                    keys.append(own)
                yield pa.record_batch({"key": np.concatenate(keys).view(np.int64), "node": _short(names)[np.concatenate(owners)]})

    return docs.mapInArrow(scan, "key long, node long")


def _with_shared_keys(postings: DataFrame, shared: DataFrame) -> DataFrame:
    """The ``postings`` whose key is in ``shared``.  A Bloom filter spares shuffling most others."""
    held = postings.sparkSession.sparkContext.broadcast(bloom.build(shared, F.xxhash64("key"), shared.count()))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = held.value.may_contain(batch.column(2).to_numpy(zero_copy_only=False).view(_U))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["key", "node"]).filter(pa.array(may))

    likely = postings.withColumn("i", F.xxhash64("key")).mapInArrow(keep, "key long, node long")
    return likely.join(shared, "key")


def _token_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``rep, tokens`` of the documents ``wanted`` (rep: their id)."""
    spark = docs.sparkSession
    seen = spark.sparkContext.broadcast(bloom.build(wanted, F.xxhash64("rep"), wanted.count()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(seen.value.may_contain(batch.column(2).to_numpy(zero_copy_only=False).view(_U))))
            for start, end, data, offsets in text_slices(batch.column(1)):
                row, h = shingles(data, offsets, size)
                bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=end - start))]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(bounds), pa.array(h.view(np.int64)))
                yield pa.record_batch({"rep": batch.column(0).slice(start, end - start), "tokens": tokens})

    found = docs.withColumn("i", F.xxhash64("id")).mapInArrow(scan, "rep long, tokens array<long>")
    return found.join(wanted, "rep", "left_semi").dropDuplicates(["rep"])


def _verified(docs: DataFrame, pairs: DataFrame, sketches: DataFrame, size: int, percent: int) -> DataFrame:
    """The ``pairs`` (``a, b``) that are linked, as a settled table: bounded by sketches, then compared set by set."""
    sketch = lambda x: sketches.select(F.col("rep").alias(x), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(sketch("a"), "a").join(sketch("b"), "b").select("a", "b", "sa", "sb")
    close = settle(both.mapInArrow(lambda batches: _may_link(batches, percent), "a long, b long"))
    wanted = settle(close.select(F.col("a").alias("rep")).union(close.select("b")).distinct())
    if wanted.isEmpty():
        return close
    sets = settle(_token_sets(docs, wanted, size))
    release(wanted)
    tokens = lambda x: sets.select(F.col("rep").alias(x), F.col("tokens").alias(f"t{x}"))
    joined = close.join(tokens("a"), "a").join(tokens("b"), "b").withColumn("both", F.size(F.array_intersect("ta", "tb")))
    linked = settle(joined.filter(100 * F.col("both") >= percent * (F.size("ta") + F.size("tb") - F.col("both"))).select("a", "b"))
    release(close, sets)
    return linked


def _grown(table: DataFrame | None, new: DataFrame) -> DataFrame:
    """``table`` with the rows of ``new``, both settled; the plan does not grow with the rounds."""
    if table is None:
        return new
    grown = settle(table.union(new))
    release(table, new)
    return grown


def link_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    ``docs`` has ``id`` (long) and ``text``; other columns are ignored.  Words are
    runs of non-space characters, A-Z lower-cased.  Returns ``id, n_shingles,
    component`` with a row for each input row; ``component`` is the least id that
    links lead to.  Texts that are null or have no words have no shingles and are
    linked with nothing; neither are rows with a null id (component null).  Rows
    that share an id should share the text: of several texts one is linked.  Texts of any
    length are one set each; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select("id", "text")
    known = docs.filter("id IS NOT NULL")
    members = settle(_members(docs, size))
    named = members.filter("id IS NOT NULL AND node IS NOT NULL")
    reps = settle(named.groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("short").alias("short"), F.first("sketch").alias("sketch")))

    common = spark.sparkContext.broadcast(_frequent(known, size, percent))
    postings = settle(_postings(known, size, percent, common))
    shared = settle(postings.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x < y").select("key"))
    index = settle(_with_shared_keys(postings, shared).join(reps.select(F.col("short").alias("node"), "rep", "n"), "node").select("key", "rep", "n").distinct())
    release(postings, shared)
    sketches = settle(reps.join(index.select("rep").distinct(), "rep", "left_semi").select("rep", "sketch"))

    component = sketches.select("rep", F.col("rep").alias("c"))
    tested = linked = None
    for step in range(STAR_ROUNDS + 1):
        held = index.join(component, "rep")
        open_keys = held.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("m"), F.min_by(F.struct("rep", "c", "n"), F.xxhash64("rep", F.lit(step)) if step else F.col("rep")).alias("hub")).filter("low < high")
        if step < STAR_ROUNDS:
            near = held.join(open_keys.select("key", "hub"), "key").filter("c <> hub.c").selectExpr("rep AS a", "n AS na", "hub.rep AS b", "hub.n AS nb")
        else:
            shared = held.join(open_keys.select("key", "m"), "key")
            left, right = shared.filter(F.col("m") <= SMALL_GROUP).alias("l"), held.alias("r")
            near = left.join(right, F.expr("l.key = r.key AND l.c < r.c")).selectExpr("l.rep AS a", "l.n AS na", "r.rep AS b", "r.n AS nb")
        near = near.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        pairs = near.groupBy(F.greatest("a", "b").alias("a0"), F.least("a", "b").alias("b0")).count().selectExpr("a0 AS a", "b0 AS b", "count AS keys")
        if step == STAR_ROUNDS:
            close = _close_in_blocks(shared.filter(F.col("m") > SMALL_GROUP), sketches, percent)
            pairs = pairs.select("a", "b").union(close).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        if step < STAR_ROUNDS:
            pairs = settle(pairs.groupBy("a").agg(F.max_by("b", F.struct("keys", F.negate("b"))).alias("b")))
        new = _verified(known, pairs.select("a", "b"), sketches, size, percent)
        if step < STAR_ROUNDS:
            tested = _grown(tested, pairs)
        if new.isEmpty():
            continue
        linked = _grown(linked, new)
        joined = connected_components(linked)
        last, component = component, settle(sketches.select("rep").join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("c")))
        release(joined, last)
    release(tested, linked, index)
    links = reps.select("node", "rep").join(component, "rep", "left").select("node", F.coalesce("c", "rep").alias("component"))
    out = members.drop("short", "sketch").join(links, "node", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), own.alias("component"))


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of a ``documents`` table without those whose group of near copies has a smaller id; all columns stay.

    Texts that are null, empty or without words and rows without an id are no copies and stay; rows that share an
    id are one document, so repeated rows stay or go together; an empty table stays empty.
    """
    linked = link_documents(docs.select(F.col("doc_id").alias("id"), "text"), size, percent)
    gone = linked.filter("component < id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op1(docs: DataFrame) -> DataFrame:
    """:func:`link_documents` with 3-word shingles at 90 % over a ``documents`` table."""
    out = link_documents(docs.select(F.col("doc_id").alias("id"), "text"), size=3, percent=90)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
