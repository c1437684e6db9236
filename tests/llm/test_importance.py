"""Importance resampling against a plain Python version, with nulls, ties, empty tables and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from folioworks.llm import importance, queries
from tests.compare import DATA, connect, difference

TEXTS = [None, "", "Un mot", "ÉTÉ été A-b 7x", "the cat " * 30, "the cat " * 30, "q" * 5000, " ".join(f"w{i}" for i in range(300)), "a.b,c;d " * 12, "😀 " * 40, "word " * 19, "word " * 20, "the dog sat on the mat " * 2000]
TARGET = ["the cat sat on the mat", None, "été", "w1 w2 w3"]


def brute(rows, target, longest=1, buckets=10_000, percent=10, least=20):
    def buckets_of(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    found = [(i, *buckets_of(t)) for i, t in rows]
    s, t = Counter(b for _, _, bs in found for b in bs), Counter(b for x in target for b in buckets_of(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, n, bs in found:
        weight = sum(map(gain, bs)) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = may[: len(may) * percent // 100]
    return out, [(r[0], r[4]) for r in drawn]


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (1, 60), (3, 100)])
def test_against_brute_force(spark, longest, percent):
    rows = [(i, t) for i, t in enumerate(TEXTS * 4)] + [(None, TEXTS[4]), (None, TEXTS[4]), (3, TEXTS[7])]
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "id long, text string, score int, words string").repartition(3)
    target = spark.createDataFrame([(t, 5) for t in TARGET], "text string, bucket int")
    got = importance.draw(importance.scored(docs, target, longest), percent).collect()
    want, drawn = brute(rows, TARGET, longest, percent=percent)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((list(r)[:5] for r in got), key=key) == sorted(want, key=key)
    assert [(r.id, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_one_id_for_many_rows(spark):
    """A third of the rows share an id and a text: all have one score, and ranks stay whole."""
    rows = [(None if i % 3 == 0 else i, "the cat " * 15 if i % 3 == 0 else f"mot{i} " * 25) for i in range(900)]
    docs = spark.createDataFrame(rows, "id long, text string")
    target = spark.createDataFrame([("the cat",)], "text string")
    got = importance.draw(importance.scored(docs, target), 50).collect()
    assert len(got) == 900 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 451))
    assert max(r.score for r in got if r["rank"] is None) <= min(r.score for r in got if r["rank"])


def test_empty_tables(spark):
    docs, target = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert importance.op12(docs.filter("false"), target).count() == 0
    assert importance.op12(docs, target).first()["rank"] is None  # a tenth of one document is none


@pytest.mark.skipif(not (DATA / "sf0.001").exists(), reason="the driver's tables are not here")
def test_against_sql(spark):
    sf = DATA / "sf0.001"
    assert difference(spark, connect(sf), queries.QUERIES["op12_importance"], importance.SQL, str(sf)) == ""
