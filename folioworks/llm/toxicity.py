"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (with word ends marked) and of itself, all
hashed to one table of embeddings; a document is the average of the bags of all its
words, and goes through a linear softmax of two classes.  Embeddings and softmax are
trained jointly in numpy.  A misspelt or inflected word shares most of its n-grams with
the known one.

Every text ends with a mark that has an embedding of its own and weighs as much as a
word.  The sign of the average's score is that of the sum over the text and its mark, so
a few insults count in a long text as they do in a short one, and one n-gram that is
common to insults and harmless words does not make a text toxic.  A text of its mark
alone is trained as a clean one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .folds import give_back, held_out, learn_in_task, per_class_sample
from .subwords import Marked, blocks, coded_texts, words_of

#: Training rows of each class, and the longest text used to train (scoring has no such bound).
SAMPLE = 8000
SAMPLE_CHARS = 12_000
BUCKETS = 1 << 18
DIMENSIONS = 12
SHORTEST, LONGEST = 3, 6
#: Subwords that the mark at a text's end weighs, and what an average is multiplied by before the softmax.
MARK, SHARPNESS = 20, 40.0
#: Training texts that a bucket must be in, else its embedding stays zero.
LEAST_TEXTS = 3
EPOCHS = 120
#: What a text without words, which is no toxic one, weighs in training beside all others.
EMPTY = 0.01
#: Word scores kept by a Python worker; it starts anew when they are more.
CACHED = 120_000

def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and their n-grams, word by word, and the number of them of each word."""
    each = [_bags(some) for some in blocks(words)] or [_bags([])]
    return np.concatenate([b for b, _ in each]), np.concatenate([n for _, n in each])


def _bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    marked = Marked(words)
    owners, hashes = [np.arange(len(words))], [marked.whole()]
    for n in range(SHORTEST, LONGEST + 1):
        owner, h = marked.grams(n)
        owners.append(owner)
        hashes.append(h)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    buckets = (np.concatenate(hashes) & np.uint64(BUCKETS - 1)).astype(np.int32)[order]
    return buckets, np.bincount(owner, minlength=len(words))


class Model:
    """Scores of single buckets (embedding times softmax difference), and that of the mark at the end."""

    def __init__(self, scores: np.ndarray, mark: float):
        self.scores, self.mark = scores, mark
        self.cache: dict[str, tuple[float, int]] = {}

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum over each word's bag and the size of the bag; ``words`` are different ones."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        missing = [w for w in words if w not in self.cache]
        for some in blocks(missing) if missing else ():
            buckets, sizes = bags(some)
            new = np.add.reduceat(self.scores[buckets], np.cumsum(sizes) - sizes)
            self.cache.update(zip(some, zip(new.tolist(), sizes.tolist(), strict=True), strict=True))
        found = [self.cache[w] for w in words]
        return np.array([x for x, _ in found], np.float64), np.array([n for _, n in found], np.int64)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability that each text is toxic, were both classes equally frequent; a text without words is its mark alone."""
        out = np.full(len(texts), self._probability(np.zeros(1), np.zeros(1))[0])
        for start, words, codes, counts in coded_texts(texts):
            some = np.flatnonzero(counts)
            if len(some):
                sums, sizes = self.word_scores(words)
                begin = (np.cumsum(counts) - counts)[some]
                out[start + some] = self._probability(np.add.reduceat(sums[codes], begin), np.add.reduceat(sizes[codes], begin))
        return out

    def _probability(self, sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return _sigmoid(SHARPNESS * (sums + MARK * self.mark) / (sizes + MARK))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _texts_with(ids: np.ndarray, owner: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Number of texts that each bucket is in (of words: ``ids`` by ``owner``, bags ``flat`` of ``sizes``)."""
    at = np.cumsum(sizes) - sizes
    once = np.unique(owner.astype(np.int64) * len(sizes) + ids)
    counts = np.zeros(BUCKETS, np.int64)
    for text in np.split(once % len(sizes), np.flatnonzero(np.diff(once // len(sizes))) + 1) if len(once) else ():
        own = sizes[text]
        counts[np.unique(flat[np.repeat(at[text] - (np.cumsum(own) - own), own) + np.arange(own.sum())])] += 1
    return counts


def train(texts: list[str], toxic: np.ndarray, share: float, seed: int = 7) -> Model:
    """Fit on ``texts`` and 0/1 labels, both classes weighing alike; ``share`` is that of label 1 among all labelled rows.

    Without both classes the model gives texts without words the share itself, and others about as much.
    """
    toxic = np.asarray(toxic, np.float64)
    index: dict[str, int] = {}
    coded = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int32) for t in texts]
    some = [i for i, x in enumerate(coded) if len(x)]
    coded, y = [coded[i] for i in some], toxic[some]
    share = min(max(share, 1e-3), 1 - 1e-3)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))) / SHARPNESS)
    weight = np.append(np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())), EMPTY)
    y = np.append(y, 0.0)
    ids, owner = np.concatenate(coded), np.repeat(np.arange(len(coded)), [len(x) for x in coded])
    flat, sizes = bags(list(index))
    weight_of = np.bincount(owner, sizes[ids], len(y)) + MARK
    learned = _texts_with(ids, owner, flat, sizes) >= LEAST_TEXTS
    word = np.repeat(np.arange(len(index), dtype=np.int32), sizes)[learned[flat]]
    flat = flat[learned[flat]]

    random = np.random.default_rng(seed)
    table = random.normal(0, 0.1, (BUCKETS + 1, DIMENSIONS)).astype(np.float32)  # the last is the mark's
    table[:-1][~learned] = 0
    softmax = random.normal(0, 0.3, (2, DIMENSIONS)).astype(np.float32)
    seen_table, seen_softmax = np.full((BUCKETS + 1, 1), 1e-6, np.float32), np.full((2, DIMENSIONS), 1e-6)
    for _ in range(EPOCHS):
        direction = softmax[1] - softmax[0]
        score = table @ direction
        sums = np.bincount(owner, np.bincount(word, score[flat], len(index))[ids], len(y)) + MARK * score[-1]
        error = (_sigmoid(SHARPNESS * sums / weight_of) - y) * weight * SHARPNESS / weight_of
        word_error = np.bincount(ids, error[owner], len(index))
        pull = np.append(np.bincount(flat, word_error[word], BUCKETS), MARK * error.sum())
        hit = np.flatnonzero(pull)
        step = pull[hit, None].astype(np.float32)
        gradient_direction = (step * table[hit]).sum(0)
        gradient = step * direction[None, :]
        seen_table[hit] += (gradient**2).mean(1, keepdims=True)
        table[hit] -= 0.3 * gradient / np.sqrt(seen_table[hit])
        for side, sign in ((1, 1.0), (0, -1.0)):
            seen_softmax[side] += gradient_direction**2
            softmax[side] -= (0.05 * sign * gradient_direction / np.sqrt(seen_softmax[side])).astype(np.float32)
    score = (table @ (softmax[1] - softmax[0])).astype(np.float64)
    return Model(score[:-1], float(score[-1]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train in a task on a bounded sample of the labelled rows that are not held out.

    ``docs`` has ``id``, ``text``; ``labels`` has ``id``, ``toxic``.
    """
    usable = labels.filter(~held_out(F.col("id")) & F.col("toxic").isin(0, 1)).select("id", "toxic")
    share = usable.agg(F.avg("toxic")).first()[0]
    chosen = per_class_sample(usable, "toxic", SAMPLE)  # bounded: twice SAMPLE rows, about
    rows = docs.join(F.broadcast(chosen), "id").filter(F.length("text") <= SAMPLE_CHARS).select("id", "text", "toxic")
    share = share or 0.0

    def learn(sample: list[tuple]) -> tuple[np.ndarray, float]:
        model = train([t for _, t, _ in sample], np.array([y for _, _, y in sample]), share)
        return model.scores.astype(np.float32), model.mark

    return Model(*learn_in_task(rows, learn, 3 * SAMPLE))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """Return ``id, text``, the columns ``keep`` and ``score``, a row for each row of ``docs``, repeated ones included.

    Whole texts of any length; those that are null or have no letters score as the mark at
    their end (equal texts have equal scores, 0.5 counts as toxic); an empty table gives an
    empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.scores.astype(np.float32), model.mark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(*sent.value)
        for batch in batches:
            scores = held.score(batch.column(1).to_pylist())
            yield batch.append_column("score", pa.array(scores, pa.float64()))
        held.cache.clear()
        give_back()

    docs = docs.select("id", "text", *keep)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of a ``documents`` table that are not predicted toxic, unchanged; learns as :func:`op9` does.

    All columns stay, whatever their names.  Null and empty texts, rows without an id and
    repeated rows are scored as any other; an empty table stays empty.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.struct(F.lit(0).alias("_"), *rest).alias("_row"))
    model = fit(rows.select("id", "text"), labels.select(F.col("doc_id").alias("id"), "toxic"))
    out = score(rows, model, ("_row",)).filter("score < 0.5")
    new = {"doc_id": F.col("id"), "text": F.col("text")}
    return out.select(*(new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in docs.columns))


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of every document: ``doc_id, held_out, score, predicted``."""
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    out = score(rows, fit(rows, labels.select(F.col("doc_id").alias("id"), "toxic")))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
