"""Importance resampling of documents towards the distribution of a target table.

Words and their buckets stay arrays within the row: higher-order functions hash each
run of words into a bucket, and a document's weight is an ``aggregate`` that looks its
buckets up in one literal array of gains.  Counting is the only place where buckets
become rows, and they are summed before the shuffle: at most ``buckets`` rows leave a
task.  A bucket's gain tells how much likelier it is in the target than in the corpus.

Drawing needs no sort of all documents.  Scores are integers within a few ten thousand
of 0 (logarithms of counts and of 32-bit hashes), so a histogram of them is small
however large the corpus is; it tells the score at which the draw ends, and only
documents above it are dealt in ranges and numbered.
"""

from __future__ import annotations

import math
import string

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import settle

#: What is between words: all of ASCII that is no letter or digit.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, LONGEST, SEED = 10_000, 1, 2024
#: Documents of fewer words are not drawn; percent of the others that are.
LEAST_WORDS, PERCENT = 20, 10
_RANDOM = float(1 << 32)


def words(text: Column) -> Column:
    """Lower-cased words (A-Z only) of a text; none of a null one."""
    folded = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(folded, BETWEEN), "")


def bucket_array(words: Column, buckets: int = BUCKETS, longest: int = LONGEST) -> Column:
    """Buckets of all runs of 1 to ``longest`` words, repeats included: crc32 of the run, joined by spaces, by ``buckets``."""
    bucket = lambda run: (F.crc32(run.cast("binary")) % buckets).cast("int")

    def runs(n: int) -> Column:
        starts = F.filter(F.transform(words, lambda _, i: i + 1), lambda i: i + n - 1 <= F.size(words))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(words, i, n), " ")))

    return F.concat(F.transform(words, bucket), *map(runs, range(2, longest + 1)))


def totals(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all of ``rows`` (``buckets``: arrays); the driver gets one number a bucket."""
    counted = rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count()
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():
        out[row["bucket"]] = row["count"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket 1000 times the logarithm of its smoothed share in the target by that in the corpus, floored."""
    n, all_corpus, all_target = len(corpus), float(corpus.sum() + len(corpus)), float(target.sum() + len(corpus))
    return np.array([math.floor(1000 * math.log((float(target[i]) + 1) * all_corpus / ((float(corpus[i]) + 1) * all_target))) for i in range(n)], np.int64)


def weight(buckets: Column, gain: np.ndarray) -> Column:
    """Floored mean of the gains of a bucket array; 0 of an empty one."""
    table = F.lit(gain)
    total = F.aggregate(buckets, F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table, b + 1))
    size = F.size(buckets).cast("long")
    return F.when(size > 0, F.try_divide(total - F.pmod(total, size), size).cast("long")).otherwise(F.lit(0).cast("long"))


def gumbel(key: Column, seed: int = SEED) -> Column:
    """-1000 ln(-ln u), floored, of the uniform number that a hash of ``seed`` and ``key`` gives."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / _RANDOM))).cast("long")


def scored(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Return ``id, n_words, n_features, weight, score`` of each of ``docs`` against ``target`` (``id, text``; ``text``).

    Null and empty texts have no words and weigh 0; a null id is hashed as no text;
    repeated rows are scored each and alike; texts of any length are one array; other
    columns are ignored.  With an empty target or an empty table every count is 0 and
    gains come from smoothing alone.
    """
    spell = lambda rows: rows.withColumn("words", words(F.col("text")))
    arrays = settle(spell(docs).select("id", F.size("words").cast("long").alias("n_words"), bucket_array(F.col("words"), buckets, longest).alias("buckets")))
    wanted = spell(target.select("text")).select(bucket_array(F.col("words"), buckets, longest).alias("buckets"))
    gain = gains(totals(arrays, buckets), totals(wanted, buckets))
    weighed = arrays.select("id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight(F.col("buckets"), gain).alias("weight"))
    return weighed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))


def draw(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Add ``rank`` to ``scored`` rows: 1, 2, 3.. by falling score, then rising id, for the drawn ones; null for others.

    Of rows of at least ``least_words`` words, ``percent`` percent (floored) are drawn.
    Rows with equal score and id come in order of their features and weight; rows equal
    in all of these are interchangeable.  A null id comes before others.
    """
    rows = settle(rows)
    may = F.col("n_words") >= least_words
    histogram = sorted(rows.filter(may).groupBy("score").count().collect(), reverse=True)
    left = wanted = sum(row["count"] for row in histogram) * percent // 100
    none = F.lit(None).cast("long")
    last = None
    for row in histogram:
        if left <= 0:
            break
        last, left = row["score"], left - row["count"]
    if last is None:
        return rows.withColumn("rank", none)
    chosen = may & (F.col("score") >= last)
    order = [F.desc("score"), F.asc_nulls_first("id"), "n_features", "weight", "_row"]
    dealt = rows.filter(chosen).withColumn("_row", F.monotonically_increasing_id())
    dealt = settle(dealt.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before, parts = 0, []
    for row in sorted(dealt.groupBy("_part").count().collect()):
        parts += [F.lit(row["_part"]), F.lit(before)]
        before += row["count"]
    place = F.element_at(F.create_map(*parts), F.col("_part")) + F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    ranked = dealt.withColumn("rank", place.cast("long")).drop("_row", "_part")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return rows.filter(~chosen).withColumn("rank", none).unionByName(ranked)


def op12(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Weight, score and rank of every row of a ``documents`` table against a ``benchmark`` table."""
    out = draw(scored(docs.select(F.col("doc_id").alias("id"), "text"), target))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank", "n_words")


#: The same rows in DuckDB: crc32 is reckoned byte by byte over the distinct words.
SQL = r"""WITH crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
spelled AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
wanted AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
of_docs AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM spelled) GROUP BY ALL),
vocabulary AS (SELECT DISTINCT w FROM (SELECT w FROM of_docs UNION ALL SELECT w FROM wanted)),
spelt AS (SELECT w, list_transform(range(0, octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT)) AS b FROM vocabulary),
hashed AS (SELECT w, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1])), 4294967295) % 10000 AS bucket FROM spelt, crc_table),
s AS (SELECT bucket, sum(n) AS s FROM of_docs JOIN hashed USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (w) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS all_s, (SELECT coalesce(sum(t), 0) FROM t) AS all_t),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0)::DOUBLE * (all_s + 10000)::DOUBLE / ((coalesce(s, 0) + 1.0)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket), sums),
weighed AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE) AS BIGINT) AS weight FROM of_docs JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scores AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
 coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS score FROM spelled LEFT JOIN weighed USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count_if(n_words >= 20) OVER () AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= n * 10 // 100 THEN place END AS rank, n_words FROM placed"""
