"""Quality by weak supervision: rules vote or abstain, EM weighs them.

Each rule looks at one statistic of a document and votes good (1), bad (0) or
abstains (null).  Documents with the same votes are counted together, so there
are at most 3 to the power of the number of rules patterns however large the
corpus is.  Expectation-maximisation over the patterns estimates how accurate
each rule is on good and on bad documents and how many are good; a document is
kept by its posterior probability of being good, not by passing every rule.

All statistics are taken within a row by built-in functions: no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .source_mix import WORD
from .storage import settle

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Rounds of EM at most; it stops when no estimate moves by more than ``SETTLED``.
ROUNDS, SETTLED = 30, 1e-4
#: Estimates start here: the start alone tells which side is the good one.
START_ON_GOOD, START_ON_BAD, START_GOOD = 0.98, 0.3, 0.85
#: Votes of each kind that are reckoned besides those counted, so that no accuracy is 0 or 1.
RECKONED = 1.0
KEEP = 0.5
#: Bits of a window's place in its text, below those of its hash.
PLACE_BITS = 20

#: Rule, statistic, good from .. to, bad below, bad above (None: no such vote).
RULES = (
    ("mean_word_chars", "n_words > 0", "word_chars / n_words", 3.0, 10.0, 2.0, 15.0),
    ("symbols", "n_words > 0", "n_symbols / n_words", 0.0, 0.1, None, 0.3),
    ("dup_lines", "n_lines > 0", "n_dup_lines / n_lines", 0.0, 0.1, None, 0.3),
    ("repeat_words", "n_words > 0", "n_repeat_words / n_words", 0.0, 0.25, None, 0.45),
    ("length", "true", "n_words", 80.0, 100000.0, 50.0, None),
    ("letters", "n_chars > 0", "n_letters / n_chars", 0.85, 1.0, 0.7, None),
    ("capitals", "n_letters > 0", "n_capitals / n_letters", 0.0, 0.15, None, 0.5),
    ("bars", "n_words > 0", "n_bars / n_words", 0.0, 0.05, None, 0.2),
    ("exclamations", "n_words > 0", "n_shouts / n_words", 0.0, 0.05, None, 0.25),
)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def statistics(docs: DataFrame) -> DataFrame:
    """Add the statistics that the rules read to ``docs`` (``id, text``); null texts count as empty."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("id", text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda line: F.length(_without(line, SPACES)) > 0))
    dense = _without(F.col("text"), SPACES)
    rows = rows.withColumn("n_words", F.size("words").cast("long")).withColumn("dense", dense)
    three = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    rows = rows.withColumn("windows", F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), three)))
    # a hash and its place in one number, so that sorting numbers puts equal windows side by side
    packed = F.transform("windows", lambda h, i: F.shiftleft(F.shiftrightunsigned(h, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long")))
    apart = F.size(F.array_distinct("windows")) == F.size("windows")
    rows = rows.withColumn("sorted", F.when(F.col("n_words").between(3, 1 << PLACE_BITS) & ~apart, F.array_sort(packed)))
    key, place = lambda w: F.shiftrightunsigned(w, PLACE_BITS), lambda w: w.bitwiseAND((1 << PLACE_BITS) - 1).cast("int")
    neighbours = F.arrays_zip("sorted", F.concat(F.array(F.lit(None).cast("long")), "sorted").alias("last"), F.slice("sorted", F.lit(2), F.greatest(F.size("sorted"), F.lit(1))).alias("next"))
    # of the hash only its upper bits are in the number, so the whole ones are compared too
    same = lambda x, y: F.coalesce((key(x) == key(y)) & (F.get("windows", place(x)) == F.get("windows", place(y))), F.lit(False))
    rows = rows.withColumn("places", F.array_sort(F.transform(F.filter(neighbours, lambda x: same(x["sorted"], x.last) | same(x["sorted"], x.next)), lambda x: place(x["sorted"]))))
    # a window covers three words, or as many as are before the next one
    covered = F.aggregate(F.zip_with("places", F.slice("places", F.lit(2), F.greatest(F.size("places"), F.lit(1))), lambda i, j: F.least(F.coalesce(j - i, F.lit(3)), F.lit(3))), F.lit(0), lambda a, n: a + n)
    # texts of more words than a place has room for
    long = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.withColumn("long", F.when(F.col("n_words") > 1 << PLACE_BITS, F.array_sort(long)))
    beside = F.filter("long", lambda w, k: (w.h == F.get(F.col("long"), k - 1).h) | (w.h == F.get(F.col("long"), k + 1).h))
    covered_long = F.size(F.array_distinct(F.flatten(F.transform(beside, lambda w: F.array(w.i, w.i + 1, w.i + 2)))))
    covered = F.when(F.col("long").isNotNull(), covered_long).otherwise(covered)
    letters = F.regexp_replace("dense", r"[^\p{L}]+", "")
    return rows.select(
        "id",
        "n_words",
        F.length("dense").cast("long").alias("word_chars"),
        (F.length("dense") - F.length(_without(F.col("dense"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("dense") - F.length(_without(F.col("dense"), "|"))).cast("long").alias("n_bars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.length("dense").cast("long").alias("n_chars"),
        F.length(letters).cast("long").alias("n_letters"),
        F.length(F.regexp_replace(letters, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        (F.length("dense") - F.length(_without(F.col("dense"), "!"))).cast("long").alias("n_shouts"),
    )


def vote(rule: tuple) -> Column:
    """1, 0 or null (abstains) of one of ``RULES``."""
    _, sensible, value, low, high, below, above = rule
    x = F.when(F.expr(sensible), F.expr(value).cast("double"))
    bad = F.lit(False)
    if below is not None:
        bad = bad | (x < below)
    if above is not None:
        bad = bad | (x > above)
    return F.when(bad, 0).when((x >= low) & (x <= high), 1)


def estimate(patterns: DataFrame, n_rules: int) -> tuple[list[tuple[float, float]], float]:
    """EM over ``patterns`` (``v0 .. v<n-1>`` and ``count``).

    Returns for each rule its accuracy on good and on bad documents, and the share
    of good ones.  Each round is one aggregation over the patterns.
    """
    accuracy, good = [(START_ON_GOOD, START_ON_BAD)] * n_rules, START_GOOD
    for _ in range(ROUNDS):
        p = posterior([F.col(f"v{i}") for i in range(n_rules)], accuracy, good)
        sums = [F.sum(F.col("count") * p).alias("good"), F.sum("count").alias("all")]
        for i in range(n_rules):
            v = F.col(f"v{i}")
            for name, side, right in (("g", p, 1), ("b", 1 - p, 0)):
                sums += [F.sum(F.when(v == right, F.col("count") * side)).alias(f"{name}{i}_right"), F.sum(F.when(v.isNotNull(), F.col("count") * side)).alias(f"{name}{i}_all")]
        got = patterns.agg(*sums).first()
        if not got["all"]:
            break

        share = lambda name: ((got[f"{name}_right"] or 0.0) + RECKONED) / ((got[f"{name}_all"] or 0.0) + 2 * RECKONED)  # noqa: E731, B023
        new = [(share(f"g{i}"), share(f"b{i}")) for i in range(n_rules)]
        new_good = (got["good"] + RECKONED) / (got["all"] + 2 * RECKONED)
        moved = max([abs(new_good - good), *(abs(x - y) for a, b in zip(new, accuracy, strict=True) for x, y in zip(a, b, strict=True))])
        accuracy, good = new, new_good
        if moved < SETTLED:
            break
    return accuracy, good


def posterior(votes: list[Column], accuracy: list[tuple[float, float]], good: float) -> Column:
    """Probability that a document with these votes is good; rules that abstain say nothing."""
    from math import log

    score = F.lit(log(good / (1 - good)))
    for v, (on_good, on_bad) in zip(votes, accuracy, strict=True):
        score = score + F.when(v == 1, log(on_good / (1 - on_bad))).when(v == 0, log((1 - on_good) / on_bad)).otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def judge(docs: DataFrame) -> DataFrame:
    """Return a row for each of ``docs`` (``id, text``; others are ignored): the statistics and ``quality``.

    ``quality`` is the posterior probability of a good document.  Null and empty
    texts have no words and get what the rules that can judge them say; repeated
    rows are judged alike; texts of any length are judged whole (those of more than 2 to the
    power of ``PLACE_BITS`` words by another sort, with the same result); an empty table
    gives an empty one.
    """
    rows = statistics(docs)
    names = [f"v{i}" for i in range(len(RULES))]
    rows = settle(rows.select("*", *(vote(r).alias(n) for r, n in zip(RULES, names, strict=True))))
    patterns = settle(rows.groupBy(*names).count().coalesce(1))  # at most 3 ** len(RULES) rows
    accuracy, good = estimate(patterns, len(RULES))
    return rows.withColumn("quality", posterior([F.col(n) for n in names], accuracy, good)).drop(*names)


def op8(docs: DataFrame) -> DataFrame:
    """Base statistics and verdict on every document of a ``documents`` table."""
    out = judge(docs.select(F.col("doc_id").alias("id"), "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("quality") >= KEEP)).alias("kept"), "quality",
    )
