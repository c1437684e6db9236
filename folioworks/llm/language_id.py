"""Language identification by word-first backoff.

A word seen in training is scored by its log frequency in each language.  An
unseen word backs off to its character n-grams of the longest length that has a
known one, and from there to shorter ones.  A text's score per language is the
sum over its words; its probability is the normalised likelihood.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import SAMPLE_ROWS, give_back, held_out, learn_in_task, per_class_sample
from .subwords import Marked, blocks, coded_texts, words_of

#: Training rows of each language, and the longest text used to train (prediction has no such bound).
SAMPLE = 1500
SAMPLE_CHARS = 12_000
#: Words and n-grams kept of each language: the most frequent ones seen twice or more.
WORDS, GRAMS = 30_000, 30_000
LONGEST_GRAM = 5
#: Word scores kept by a Python worker; it starts anew when they are more.
CACHED = 120_000
UNDETERMINED = "und"

class Model:
    """Log frequencies of words and, by hash, of n-grams for each language (less the mean over languages)."""

    def __init__(self, languages: list[str], words: list[str], rows: np.ndarray, by_length: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.languages, self.words, self.rows, self.by_length = languages, words, rows, by_length
        self.known = {w: i for i, w in enumerate(words)}
        self.cache: dict[str, int] = {}
        self.held = np.empty((0, len(languages)), np.float32)

    def _backed_off(self, words: list[str]) -> np.ndarray:
        """Score of unseen words: mean over known n-grams of the longest length that has one; else zeros."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        open_words = np.arange(len(words))
        for n in range(LONGEST_GRAM, 0, -1):
            hashes, rows = self.by_length[n]
            if not len(open_words) or not len(hashes):
                continue
            owner, h = Marked([words[i] for i in open_words]).grams(n)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[at] == h
            owner, at = owner[hit], at[hit]
            count = np.bincount(owner, minlength=len(open_words))
            some = count > 0
            for k in range(len(self.languages)):
                sums = np.bincount(owner, rows[at, k], minlength=len(open_words))
                out[open_words[some], k] = sums[some] / count[some]
            open_words = open_words[~some]
        return out

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log score of different words in each language."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        place = np.array([self.known.get(w, -1) for w in words], np.int64)
        out[place >= 0] = self.rows[place[place >= 0]]
        unseen = np.flatnonzero(place < 0)
        if len(self.cache) > CACHED:
            self.cache.clear()
            self.held = np.empty((0, len(self.languages)), np.float32)
        missing = [words[i] for i in unseen if words[i] not in self.cache]
        self.cache.update(zip(missing, range(len(self.cache), len(self.cache) + len(missing)), strict=True))
        self.held = np.concatenate([self.held, *map(self._backed_off, blocks(missing))]) if missing else self.held
        out[unseen] = self.held[[self.cache[words[i]] for i in unseen]] if len(unseen) else 0
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and probability of each text; ``und`` and 0 without letters or without a model."""
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        for start, words, codes, counts in coded_texts(texts):
            some = np.flatnonzero(counts)
            if not len(some):
                continue
            own = self.word_scores(words).astype(np.float64)[codes]
            total = np.add.reduceat(own, np.cumsum(counts[some]) - counts[some], axis=0)
            best = total.argmax(1)
            p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            for i, b, x in zip(some, best, p, strict=True):
                names[start + i], scores[start + i] = self.languages[b], float(x)
        return names, scores


def train(texts: list[str], langs: list[str]) -> Model:
    """Count words and n-grams of ``texts`` per language."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], [], np.empty((0, 0), np.float32), {})
    counted = {x: Counter() for x in languages}
    for text, lang in zip(texts, langs, strict=True):
        counted[lang].update(words_of(text))
    words = sorted({w for counts in counted.values() for w, k in counts.most_common(WORDS) if k > 1})
    rows = _log_frequencies(np.array([[counts[w] for counts in counted.values()] for w in words], float).reshape(-1, len(languages)), np.array([sum(c.values()) for c in counted.values()], float))
    marked = {x: (Marked(list(c)), np.array(list(c.values()), float)) for x, c in counted.items()}
    by_length = {}
    for n in range(1, LONGEST_GRAM + 1):
        sums, kept = [], []
        for m, weight in marked.values():
            owner, h = m.grams(n)
            found, code = np.unique(h, return_inverse=True)
            count = np.bincount(code, weight[owner], minlength=len(found))
            sums.append((found, count))
            often = np.argsort(-count, kind="stable")[:GRAMS]
            kept.append(found[often[count[often] > 1]])
        hashes = np.unique(np.concatenate(kept)) if kept else np.empty(0, np.uint64)
        table = np.zeros((len(hashes), len(languages)))
        for k, (found, count) in enumerate(sums):
            if len(found):
                at = np.minimum(np.searchsorted(found, hashes), len(found) - 1)
                table[:, k] = np.where(found[at] == hashes, count[at], 0)
        by_length[n] = hashes, _log_frequencies(table, np.array([c.sum() for _, c in sums]))
    return Model(languages, words, rows, by_length)


def _log_frequencies(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Smoothed log frequency in each language, less the mean over languages."""
    rows = np.log((counts + 0.1) / (totals + 0.1 * len(counts) + 1))
    return (rows - rows.mean(axis=1, keepdims=True)).astype(np.float32)


def fit(docs: DataFrame) -> Model:
    """Train in a task on a bounded sample of the rows of ``docs`` (``id, text, lang``) that are not held out."""
    usable = docs.filter(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.filter(F.length("text") <= SAMPLE_CHARS).select("id", "text", "lang")

    def learn(sample: list[tuple]) -> tuple:
        model = train([t for _, t, _ in sample], [x for _, _, x in sample])
        return model.languages, model.words, model.rows, model.by_length

    return Model(*learn_in_task(per_class_sample(usable, "lang", SAMPLE), learn, 2 * SAMPLE_ROWS))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Return ``id, text, lang_pred, score``, a row for each row of ``docs``, repeated ones included.

    Whole texts of any length; ``und`` and 0 for null ones and those without letters.  Of
    languages with equal scores the first by name is returned; other columns are ignored;
    an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.words, model.rows, model.by_length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(*sent.value)
        for batch in batches:
            names, scores = held.predict(batch.column(1).to_pylist())
            yield batch.append_column("lang_pred", pa.array(names, pa.string())).append_column("score", pa.array(scores, pa.float64()))
        del held
        give_back()

    return docs.select("id", "text").mapInArrow(run, "id long, text string, lang_pred string, score double")


def op2(docs: DataFrame) -> DataFrame:
    """Language of every document: ``doc_id, held_out, lang_pred, score``."""
    rows = docs.select(F.col("doc_id").alias("id"), "text", "lang")
    out = identify(rows, fit(rows))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
