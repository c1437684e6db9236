"""Periodic runs against a version that tries every period of every stretch."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioworks.llm import periodic_runs as pr
from folioworks.llm.words import word_hashes


def brute(words, exponent=4, least=6):
    out = []
    n = len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q) and not any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def in_documents(texts, exponent=4, least=6):
    data = "\n".join(texts).encode()
    ends = np.cumsum([0] + [len(t.encode()) + 1 for t in texts])
    ends[-1] = len(data)
    words, first = word_hashes(np.frombuffer(data, np.uint8), ends)
    found = [[] for _ in texts]
    for a, b in zip(*(x.tolist() for x in pr.candidates(words, first, exponent, least)), strict=True):
        row = int(np.searchsorted(first, a, "right")) - 1
        assert b <= first[row + 1]
        found[row] += [(a - int(first[row]) + s, length, q) for s, length, q in pr.runs_of(np.unique(words[a:b], return_inverse=True)[1].tolist(), exponent, least)]
    return found


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([(4, 6), (2, 2), (3, 10), (2, 9)]))
def test_runs_of_short_alphabets(words, kind):
    assert pr.runs_of(words, *kind) == brute(words, *kind)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=5), st.integers(1, 6)), max_size=6), max_size=4), st.sampled_from([(4, 6), (2, 4), (3, 2)]))
def test_stretches_hold_all_runs(parts, kind):
    texts = [" ".join(w for unit, times in text for w in unit * times) for text in parts]
    assert in_documents(texts, *kind) == [brute(t.split(), *kind) for t in texts]


def test_runs_in_prose():
    draw = random.Random(3)
    texts = []
    for _ in range(60):
        w = [f"w{int(draw.expovariate(0.2))}" for _ in range(draw.randrange(1, 400))]
        for _ in range(draw.randrange(4)):
            at, unit, times = draw.randrange(len(w)), draw.randrange(1, 30), draw.randrange(3, 9)
            w[at:at] = (w[at : at + unit] * times)[: draw.randrange(1, 300)]
        texts.append(" ".join(w))
    got = in_documents(texts)
    assert got == [brute(t.split()) for t in texts] and sum(map(len, got)) > 30


def test_long_texts():
    """Work grows nearly in proportion for one word, a long period and nested periods."""
    for words, want in (([7] * 200_000, (0, 200_000, 1)), ([i % 40_000 for i in range(200_000)], (0, 200_000, 40_000)), ([i % 5 if i % 100 < 99 else 9 for i in range(200_000)], (0, 200_000, 100))):
        began = time.time()
        assert want in pr.runs_of(words)
        assert time.time() - began < 60


def planted(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(w)
    if i is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def test_op13(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    draw = random.Random(5)
    texts = [None, "", " \n ", "x", "la la la la la la la fin", "é è " * 30, "a b c\td\n" * 5 + "a b c", "q" * 3000] + [" ".join(f"w{draw.randrange(50)}" for _ in range(draw.randrange(300))) for _ in range(120)]
    rows = [(i, t, 1, "clash") for i, t in enumerate(texts)] + [(None, "oui " * 9, 1, "x"), (6, "non " * 9, 1, "x"), (6, "non " * 9, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, words string").repartition(3)
    want = []
    for i, t, *_ in rows:
        w = planted(i, t)
        found = brute(w)
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want.append((i, len(found), *(best[k] if best else None for k in range(3)), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)), len(w)))
    assert sorted(map(repr, (tuple(r) for r in pr.op13(docs).collect()))) == sorted(map(repr, want))
    assert sum(r[1] for r in want) > 10
    assert pr.op13(docs.filter("false")).count() == 0
