"""The ten operators against brute force, exact round trips or held-out accuracy, with nulls, ties and clashing columns."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.llm import byte_bpe, fingerprint, jaccard_join, language_id, main_text, personal_data, quality, source_mix, substring_dedup, subwords, toxicity

WORD = r"[^\x20\x09-\x0D]+"
BASE = " ".join(f"word{i}" for i in range(60))
TEXTS = [None, "", "one", "A b", BASE, BASE, BASE + " tail", BASE.replace("word3 ", "x "), "x " * 40, BASE + "\n" + BASE, "é😀 " * 30, " ".join(f"other{i}" for i in range(200)), "q" * 5000, BASE.upper()]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr"][i % 2], [None, "b", "a", "c"][i % 4], 7, "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def words(text):
    return re.findall(WORD, text or "")


def components(size, percent):
    sets = []
    for t in TEXTS:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    return root, [len(s) for s in sets]


def test_op1(docs, empty):
    got, (root, sizes) = by_id(jaccard_join.op1(docs)), components(3, 90)
    assert [(got[i].component_id, got[i].n_shingles) for i in range(len(TEXTS))] == list(zip(root, sizes, strict=True))
    assert jaccard_join.op1(empty).count() == 0
    assert {r.doc_id for r in jaccard_join.keep_one_of_each(docs).collect()} == {i for i, c in enumerate(components(5, 80)[0]) if c == i}


def test_op1_hot_group(spark):
    """Many texts that share much and are linked in part: blocks give what all pairs give."""
    random = np.random.default_rng(5)
    texts = []
    for _ in range(120):
        w = [f"w{i}" for i in range(150)]
        for k in random.choice(150, random.integers(1, 8), replace=False):
            w[k] = f"n{random.integers(1 << 30)}"
        texts.append(" ".join(w))
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.component for r in jaccard_join.link_documents(rows, 3, 90).collect()}
    sets = [{tuple(t.split()[i : i + 3]) for i in range(148)} for t in texts]
    root = list(range(len(sets)))
    moved = True
    while moved:
        moved = False
        for i, a in enumerate(sets):
            for j in range(i):
                if root[i] != root[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
                    moved = True
    assert [got[i] for i in range(len(texts))] == root


def labelled(spark, n=300):
    random = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(n):
        lang = "en" if i % 2 else "fr"
        vocabulary = ["the", "thing", "ering", "shent"] if lang == "en" else ["le", "eau", "eaux", "tion"]
        text = [vocabulary[random.integers(4)] + str(vocabulary[random.integers(4)]) for _ in range(30)]
        if i % 3 == 0:
            text[7] = ["worthless", "worthles", "wortless"][random.integers(3)]
        rows.append((i, " ".join(text), lang))
        labels.append((i, int(i % 3 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_op2(spark, empty):
    rows, _ = labelled(spark)
    out = language_id.op2(rows).join(rows, "doc_id").filter("held_out")
    assert out.filter("lang_pred = lang").count() == out.count() > 30
    odd = spark.createDataFrame([(1, None, None), (2, "12 34", "en"), (3, "", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.op2(odd.unionByName(rows)).join(odd.select("doc_id"), "doc_id").filter("doc_id in (1)").collect()} >= {"und"}
    assert language_id.op2(empty).count() == 0


def test_long_runs(spark):
    """Runs of more than 64 letters (no spaces) are read to their end, by op9 and op2."""
    rows, labels = labelled(spark)
    glued = "thething" * 40
    texts = [glued, glued + "worthless", glued + "worthless" + glued, glued * 60, glued * 60 + "worthless" + glued * 60, "worthless " + "thing " * 20]
    out = by_id(toxicity.op9(rows.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts, 900)), "doc_id long, text string")), labels))
    scores = [out[900 + i].score for i in range(6)]
    assert scores[0] < min(scores[1:3]) and scores[3] < scores[4] and [out[900 + i].predicted for i in (0, 3, 5)] == [0, 0, 1]
    model = language_id.train(["thethe thing shentthe"] * 9 + ["eauxle tionle leeau"] * 9, ["en"] * 9 + ["fr"] * 9)
    assert model.predict(["q" * 70 + "thingshent" * 9, "q" * 70 + "eauxtion" * 9])[0] == ["en", "fr"]
    run = "".join(chr(0x4E00 + i) for i in range(200))
    for size in range(1, 200):
        pieces = subwords.words_of(run[:size])
        for n in range(1, 7):
            assert set(subwords.Marked(pieces).grams(n)[1].tolist()) == grams_of(f"<{run[:size]}>", n)


def grams_of(marked, n):
    hashes = []
    for i in range(len(marked) - n + 1):
        h = n
        for c in marked[i : i + n]:
            h = (h * 0xD6E8FEB86659FD93 + ord(c)) % 2**64
        hashes.append(h)
    return set(subwords.mix(np.array(hashes, np.uint64)).tolist())


def test_op3(spark):
    page = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a>Menu one two three</a></nav><div class='ad'>Buy this now</div><article><h1>Titre &amp; co</h1><p>Un  texte\n assez long pour rester ici, avec des mots.<p>Court.</article><div class='comments'>Nice post, I agree with all of it</div><footer>About us</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (3, "v", "<p>a"), (4, "w", "<")], "page_id long, url string, html string")
    got = main_text.op3(rows).collect()
    assert len(got) == 5
    assert next(r for r in got if r.page_id == 1).text == "Titre & co\nUn texte assez long pour rester ici, avec des mots.\nCourt."
    assert next(r for r in got if r.page_id == 2).n_chars == 0


def test_op3_whole_article():
    """Containers inside articles, wrappers with a class of parts set aside, and cores over two articles."""
    long, other = "lorem ipsum dolor sit amet " * 11 + "end", "consectetur adipiscing " * 8 + "end"
    article = f"<article><h1>T</h1><div class=content>{long}</div><p>closing</p></article>"
    assert main_text.main_text(article) == f"T\n{long}\nclosing"
    assert main_text.main_text(f"<body><div>Site</div><article><h1>T</h1><section>{long}</section><section>{other}</section></article><div>(c)</div></body>") == f"T\n{long}\n{other}"
    wrapped = f'<body><div class="page has-sidebar"><p>Blog</p>{article}<div class=sidebar>Side</div><div id=comments><article>{other}</article></div></div></body>'
    assert main_text.main_text(wrapped) == f"T\n{long}\nclosing"
    assert main_text.main_text(f"<div class=menu><main>{long}</main></div><div class=ad>{other}</div>") == long
    assert main_text.main_text(f"<body><article>{long}<p>e1</article><article>{other}<p>e2</article></body>") == f"{long}\ne1\n{other}\ne2"
    assert main_text.main_text(f"<div><h1>T</h1><div>{long}</div><p>closing</p></div>") == f"T\n{long}\nclosing"
    assert main_text.main_text(f"<p>{long}<span class=ad>{other}") == long


def test_op4(docs, empty):
    got = by_id(source_mix.op4(docs))
    sizes = [len(words(t)) for t in TEXTS]
    source = [[None, "b", "a", "c"][i % 4] for i in range(len(TEXTS))]
    total = {s: sum(n for n, x in zip(sizes, source, strict=True) if x == s) for s in ("a", "b", "c", None)}
    weight, target, left = dict(zip(("a", "b", "c", None), (5, 2, 1, 5), strict=True)), {}, 1.5 * sum(sizes)
    while True:
        free = [s for s in weight if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
    for i, s in enumerate(source):
        assert got[i]["size"] == sizes[i] and got[i].target == pytest.approx(target[s]) and 0 <= got[i].taken <= 2 * sizes[i]
    for s in total:
        assert abs(sum(got[i].taken for i in range(len(TEXTS)) if source[i] == s) - target[s]) <= 1
    assert {i: r.taken for i, r in by_id(source_mix.op4(docs.repartition(5))).items()} == {i: r.taken for i, r in got.items()}
    assert source_mix.op4(empty).count() == 0


def test_mixed_documents_by_row(spark):
    """Rows without an id and rows that share one are taken as they are served; sources come to their targets."""
    texts = [" ".join(f"r{i}w{k}" for k in range(20 + i)) for i in range(12)]
    ids = [None, None, None, 7, 7, 7, 8, 9, 10, 11, 12, 13]
    rows = spark.createDataFrame([(d, t, "en", "ab"[i % 2], 0) for i, (d, t) in enumerate(zip(ids, texts, strict=True))], "doc_id long, text string, lang string, source string, n_chars long")
    out = source_mix.mixed_documents(rows).collect()
    target = {"ab"[r["size"] % 2]: r.target for r in source_mix.op4(rows).collect()}
    for s in "ab":
        assert abs(sum(len(words(r.text)) for r in out if r.source == s) - target[s]) <= 1
    for r in out:
        i = int(re.match("r([0-9]+)w0", r.text)[1])
        assert texts[i].startswith(r.text) and (r.doc_id, r.source, r.n_chars) == (ids[i], "ab"[i % 2], len(r.text))


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum((d := int(c) * (1 + i % 2)) - 9 * (d > 9) for i, c in enumerate(reversed(digits))) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and luhn or kind == "phone" and 8 <= len(digits) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_op5(spark, empty):
    texts = [f"Please mail me at agent{i}@mail.example.com soon" for i in range(6)]
    texts += ["Please mail me at bob@localhost soon", "card 4111 1111 1111 1111 and ..1.2.3.4.5.6.7.8 999.1.1.1 a@b.c_d@e.f 010.0.0.001", None, "", "é😀 +33 (0)1 22-33-44 55. 😀a.b@c.dd", "a" * 3000 + "@", "1 " * 500, "+1 2 +1234567890123456"]
    got = by_id(personal_data.op5(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, t in enumerate(texts):
        spans = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(filter(None, got[i].spans.split(","))) >= set(spans)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k) for s in spans) for k in PATTERNS]
    assert got[6].spans == "email:18:31"  # found by its context alone
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert next(r.text for r in personal_data.redact(rows).collect() if r.id == 6) == "Please mail me at [EMAIL] soon"
    assert personal_data.op5(empty).count() == 0


def test_op6(docs, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(byte_bpe.op6(docs))
    for i, t in enumerate(TEXTS):
        ids = exact.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    place = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    back = byte_bpe.decode(byte_bpe.encode(docs.drop("id").withColumnRenamed("doc_id", "id"), *place), *place).collect()
    assert {r.id: bytes(r.decoded).decode() for r in back} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert byte_bpe.op6(empty).count() == 0


def test_op7(docs, empty):
    got = by_id(fingerprint.op7(docs))
    texts = [t or "" for t in TEXTS]
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[4].fingerprint == got[5].fingerprint and got[4].near_next == 1.0 and got[11].near_next < 0.5 < got[11].near_edited
    assert fingerprint.op7(empty).count() == 0


def test_op8(docs, empty):
    got = by_id(quality.op8(docs))
    for i, t in enumerate(TEXTS):
        w = words(t)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed)
        assert not (failed and r.kept)
    assert quality.op8(empty).count() == 0


def test_op9(spark, empty):
    rows, labels = labelled(spark)
    out = toxicity.op9(rows, labels).join(labels, "doc_id").filter("held_out")
    assert out.filter("predicted = toxic").count() >= 0.95 * out.count()
    assert by_id(toxicity.op9(spark.createDataFrame([(900, None)], "doc_id long, text string").unionByName(rows.select("doc_id", "text")), labels))[900].predicted == 0
    assert toxicity.op9(empty, labels).count() == 0


def test_op10(docs, empty):
    got = by_id(substring_dedup.op10(docs))
    first = {}
    for i, t in enumerate(TEXTS):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t in enumerate(TEXTS):
        w = words(t)
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substring_dedup.op10(empty).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows, labels = labelled(spark)
    rows = rows.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    rows.unionByName(rows.withColumn("doc_id", F.col("doc_id") + 1000)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    ids = {r.doc_id for r in out}
    assert ids and max(ids) < 1000 and len(ids & toxic) <= 0.05 * len(toxic)
