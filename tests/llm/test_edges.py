"""Long, nested and odd inputs, and the parts of methods that have a second implementation."""

import time

import numpy as np
from pyspark.sql import functions as F

from folioworks.llm import byte_bpe, fingerprint, folds, importance, jaccard_join, language_id, main_text, periodic_runs, personal_data, quality, sentence_pieces, source_mix, substring_dedup, subwords, toxicity

PARAGRAPH = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod."


def test_op3_sections_headers_and_names():
    parts = ["<div>" + f"<p>{PARAGRAPH}</p>" * n + "</div>" for n in (12, 3)]
    assert main_text.main_text(f"<body><main>{''.join(parts)}</main></body>").split("\n") == [PARAGRAPH] * 15
    page = f"<article><header class='article-header'><h1>Head</h1></header><p>{PARAGRAPH}</p><p class='notice-period'>{PARAGRAPH}</p><div class='comments'>{PARAGRAPH} x</div></article>"
    assert main_text.main_text(page) == f"Head\n{PARAGRAPH}\n{PARAGRAPH}"
    # no container: stretches with many short lines between them are both kept, the lines between are not
    far = f"<body><p>{PARAGRAPH}</p>{'<div>a</div>' * 12}<p>{PARAGRAPH} b</p></body>"
    assert main_text.main_text(far) == f"{PARAGRAPH}\n{PARAGRAPH} b"
    assert main_text.main_text(f"<body><div class='ad-slot'>{PARAGRAPH}</div><div class='has-sidebar'><p>{PARAGRAPH} c</p></div></body>") == f"{PARAGRAPH} c"
    assert main_text.main_text(f"<main><p>{PARAGRAPH}</p></main><article class='comment'>{PARAGRAPH * 3}</article>") == PARAGRAPH


def test_op3_class_words():
    """Words that style an article or its paragraphs do not empty it; comments and lists of other posts are left out."""
    for kind in ("post comment-open", "comments-closed entry", "has-comments"):
        assert main_text.main_text(f"<article class='{kind}'><p>{PARAGRAPH}</p></article>") == PARAGRAPH
    for kind in ("comment", "comment-17", "reply depth-2", "comment-body"):
        assert main_text.main_text(f"<main><p>{PARAGRAPH}</p></main><article class='{kind}'><p>{PARAGRAPH * 3}</p></article>") == PARAGRAPH
    page = f"<article><p class='login'>{PARAGRAPH}</p><p class='side'>{PARAGRAPH}</p><p class='ad'>{PARAGRAPH} x</p><div class='related-posts'>{PARAGRAPH} y</div></article>"
    assert main_text.main_text(page) == f"{PARAGRAPH}\n{PARAGRAPH}"


def test_op3_unclosed_ends():
    """Raw elements whose end tags never end cost a pass each at most."""
    began = time.time()
    assert main_text.main_text(f"<p>{PARAGRAPH}</p><script>" + "</script " * 200_000) == PARAGRAPH
    assert main_text.main_text(f"<p>{PARAGRAPH}</p>" + "<script></script " * 100_000) == PARAGRAPH
    assert main_text.main_text(f"<p>{PARAGRAPH}</p><script>x</SCRIPT\n><p>{PARAGRAPH}</p>") == f"{PARAGRAPH}\n{PARAGRAPH}"
    assert time.time() - began < 10


def test_op3_nesting():
    """Depth costs nothing (a walk of the open elements for each tag would take minutes)."""
    for page in ("<div>" * 100_000 + PARAGRAPH, f"<p>{PARAGRAPH}</p>" + "<span>" * 50_000 + "</b>" * 50_000, "<b><div>" + "<span>" * 50_000 + "</b>" * 50_000 + PARAGRAPH):
        assert main_text.main_text(page) == PARAGRAPH


def test_op5_long_texts(spark):
    """A match of 100 000 groups stays off the stack; 100 000 matches are placed and cut in time in proportion."""
    texts = ["a@b" + ".c" * 100_000, "x 4111 1111 1111 1111, 1.2.3.4 " * 20_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data.op5(rows).collect()}
    assert (got[0].n_email, got[0].spans) == (1, f"email:0:{len(texts[0])}")
    assert (got[1].n_card, got[1].n_ip) == (20_000, 20_000) and f",ip:{len(texts[1]) - 8}:{len(texts[1]) - 1}," in got[1].spans
    cut = {r.id: r.text for r in personal_data.redact(rows.withColumnRenamed("doc_id", "id")).collect()}
    assert cut == {0: "[EMAIL]", 1: "x [CARD], [IP] " * 20_000}


def test_op5_discovers_by_shape(spark):
    """Numbers that the base form misses are found in places where known ones stand."""
    valid = ["4111111111111111", "5500005555555559", "4012888888881881", "5105105105105100", "6011111111111117"]
    texts = [f"pay with {c} today" for c in valid] + ["pay with 4111111111111112 today"]
    got = {r.doc_id: r for r in personal_data.op5(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[5].n_card == 0 and got[5].spans == "card:9:25"


def test_op8_estimates_as_numpy_does(spark):
    random = np.random.default_rng(2)
    good = random.random(400) < 0.8
    votes = np.stack([np.where(random.random(400) < 0.2, -1, np.where(good, random.random(400) < 0.95, random.random(400) < 0.4).astype(int)) for _ in range(3)], 1)
    rows = spark.createDataFrame([tuple(None if v < 0 else int(v) for v in row) for row in votes], "v0 int, v1 int, v2 int").groupBy("v0", "v1", "v2").count()
    accuracy, share = quality.estimate(rows, 3)
    a, b, p = np.full(3, quality.START_ON_GOOD), np.full(3, quality.START_ON_BAD), quality.START_GOOD
    for _ in range(quality.ROUNDS):
        score = np.log(p / (1 - p)) + np.where(votes == 1, np.log(a / (1 - b)), np.where(votes == 0, np.log((1 - a) / b), 0)).sum(1)
        w = 1 / (1 + np.exp(-score))
        old = np.concatenate([a, b, [p]])
        a = np.array([((votes[:, i] == 1) @ w + 1) / ((votes[:, i] >= 0) @ w + 2) for i in range(3)])
        b = np.array([((votes[:, i] == 0) @ (1 - w) + 1) / ((votes[:, i] >= 0) @ (1 - w) + 2) for i in range(3)])
        p = (w.sum() + 1) / (len(w) + 2)
        if np.abs(np.concatenate([a, b, [p]]) - old).max() < quality.SETTLED:
            break
    assert np.allclose([x for x, _ in accuracy], a) and np.allclose([x for _, x in accuracy], b) and abs(share - p) < 1e-9


def test_levels_double():
    assert substring_dedup.levels(13) == [4, 7, 13] and substring_dedup.levels(3) == [3]
    assert all(long <= 2 * short for w in range(1, 100) for short, long in zip(substring_dedup.levels(w), substring_dedup.levels(w)[1:], strict=False))


def test_nothing_repeats(spark):
    """No candidate survives the first level: every word stays."""
    rows = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(4)], "doc_id long, text string")
    assert [(r.n_words, r.n_removed) for r in substring_dedup.op10(rows).collect()] == [(30, 0)] * 4


def test_stages_keep_other_columns(spark):
    rows = spark.createDataFrame([(1, "mail a@b.cc now", "s", "en", 15, "t", 7)], "doc_id long, text string, source string, lang string, n_chars long, spans string, taken int")
    out = personal_data.redacted_documents(rows)
    assert out.columns == rows.columns and tuple(out.first()) == (1, "mail [EMAIL] now", "s", "en", 16, "t", 7)
    mixed = source_mix.mixed_documents(rows)
    assert mixed.columns == rows.columns and {r.taken for r in mixed.collect()} == {7}


def test_words_are_letters_with_their_marks():
    assert subwords.words_of("\u0928\u092e\u0938\u094d\u0924\u0947 A\u00bdb e\u0301t\u00e9 x_1y") == ["\u0928\u092e\u0938\u094d\u0924\u0947", "a", "b", "e\u0301t\u00e9", "x", "y"]
    assert subwords.words_of("\u00bd \u00b2 \u2167 \u0301 12 _") == subwords.words_of(None) == []
    model = language_id.train(["the thing"] * 3 + ["le truc"] * 3, ["en"] * 3 + ["fr"] * 3)
    assert model.predict(["\u00bd \u2167", "12", "", None, "the \u00bd"])[0] == ["und"] * 4 + ["en"]


def test_language_scores_by_hand():
    """Known words by frequency, unseen ones by the mean over their longest known n-grams, in plain Python."""
    texts, langs = ["abab cd cd ab", "abab ab cd", "xyx yy xyx zz", "yy xyx ab zz"], ["a", "a", "b", "b"]
    model = language_id.train(texts, langs)
    counts = {x: [w for t, lang in zip(texts, langs, strict=True) if lang == x for w in t.split()] for x in "ab"}

    def centred(rows):
        logs = [np.log((k + 0.1) / (total + 0.1 * kinds + 1)) for k, total, kinds in rows]
        return np.array(logs) - np.mean(logs)

    known = {w for x in "ab" for w in counts[x] if counts[x].count(w) > 1}
    grams = {n: {x: [m[i : i + n] for w in counts[x] for m in [f"<{w}>"] for i in range(len(m) - n + 1)] for x in "ab"} for n in range(1, 6)}
    kept = {n: {g for x in "ab" for g in grams[n][x] if grams[n][x].count(g) > 1} for n in grams}

    def score(word):
        if word in known:
            return centred([(counts[x].count(word), len(counts[x]), len(known)) for x in "ab"])
        for n in range(5, 0, -1):
            own = [g for i in range(len(word) + 3 - n) for g in [f"<{word}>"[i : i + n]] if g in kept[n]]
            if own:
                return np.mean([centred([(grams[n][x].count(g), len(grams[n][x]), len(kept[n])) for x in "ab"]) for g in own], axis=0)
        return np.zeros(2)

    tested = ["abab", "cd", "zz", "abx", "xyxyx", "qqq", "yab"]
    assert np.allclose(model.word_scores(tested), [score(w) for w in tested], atol=1e-5)


def test_toxicity_scores_by_hand():
    """The average over all subwords and the mark at the end, in plain Python."""
    random = np.random.default_rng(1)
    model = toxicity.Model(random.normal(size=toxicity.BUCKETS), -0.7)
    text = "you are a wonderful worthles thing and more besides"

    def by_hand(words):
        each = [-0.7] * toxicity.MARK
        for word in words:
            marked = subwords.Marked([word])
            each += [model.scores[int(h) % toxicity.BUCKETS] for h in np.concatenate([marked.whole()] + [marked.grams(n)[1] for n in range(3, 7)])]
        return 1 / (1 + np.exp(-np.clip(toxicity.SHARPNESS * np.mean(each), -30, 30)))

    assert np.allclose(model.score([text, text.split()[0], "", None]), [by_hand(text.split()), by_hand(text.split()[:1]), by_hand([]), by_hand([])])


def test_toxicity_learns_as_plain_gradients_do(monkeypatch):
    """The score after one round, with buckets, texts and weights gone through one by one."""
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    texts, y = ["you idiot go", "good day to you", "idiots idiot", "a good day", "you go good idiot", "day to day you"], np.array([1, 0, 1, 0, 1, 0])
    model = toxicity.train(texts, y, 0.5)
    split = [[int(h) % toxicity.BUCKETS for w in t.split() for m in [subwords.Marked([w])] for h in np.concatenate([m.whole()] + [m.grams(n)[1] for n in range(3, 7)])] for t in texts]
    learned = {b for t in split for b in t if sum(b in x for x in split) >= toxicity.LEAST_TEXTS}
    random = np.random.default_rng(7)
    table = random.normal(0, 0.1, (toxicity.BUCKETS + 1, toxicity.DIMENSIONS)).astype(np.float32)
    softmax = random.normal(0, 0.3, (2, toxicity.DIMENSIONS)).astype(np.float32)
    direction = softmax[1] - softmax[0]
    pull = {}
    for bag, label, weight in [*((b, v, 1 / 6) for b, v in zip(split, y, strict=True)), ([], 0, toxicity.EMPTY)]:
        size = len(bag) + toxicity.MARK
        total = sum(float(table[b] @ direction) for b in bag if b in learned) + toxicity.MARK * float(table[-1] @ direction)
        error = (1 / (1 + np.exp(-toxicity.SHARPNESS * total / size)) - label) * weight * toxicity.SHARPNESS / size
        for b in [b for b in bag if b in learned] + [toxicity.BUCKETS] * toxicity.MARK:
            pull[b] = pull.get(b, 0) + error
    towards = sum(p * table[b] for b, p in pull.items())
    for b, p in pull.items():
        g = p * direction
        table[b] -= 0.3 * g / np.sqrt(1e-6 + (g**2).mean())
    softmax[1] -= 0.05 * towards / np.sqrt(1e-6 + towards**2)
    softmax[0] += 0.05 * towards / np.sqrt(1e-6 + towards**2)
    after = table @ (softmax[1] - softmax[0])
    assert np.allclose([model.scores[b] for b in learned] + [model.mark], [after[b] for b in learned] + [after[-1]], atol=1e-3)


def test_samples_of_many_classes(spark):
    """A thousand classes are planned in no time; rows without an id are chosen by their texts."""
    rows = spark.range(20_000).selectExpr("IF(id % 2 = 0, NULL, id) AS id", "concat('text ', id) AS text", "concat('l', id % 1000) AS lang")
    chosen = folds.per_class_sample(rows, "lang", 1500)
    assert chosen.select("lang").distinct().count() == 1000 and chosen.count() == 20_000
    some = folds.per_class_sample(rows.withColumn("lang", F.lit("l")), "lang", 2000)
    assert 1500 < some.count() < 2500 and 700 < some.filter("id IS NULL").count() < 1300
    assert folds.per_class_sample(rows.filter("false"), "lang", 10).count() == 0
    name = lambda k: "".join("abcdefghij"[int(d)] for d in f"{k:03d}")
    texts = [f"{name(k)} {name(k)}x {name(k)}x" for k in range(1000)] * 2
    model = language_id.train(texts, [f"l{k % 1000}" for k in range(2000)])
    assert model.predict([f"{name(7)} {name(7)}x", f"{name(421)}x"])[0] == ["l7", "l421"]


ODD = [(1, None), (1, None), (2, ""), (None, "no id here"), (3, "one"), (4, "w " * 30_000), (5, " ".join(f"t{i}" for i in range(20_000))), (6, "q" * 100_000)]


def test_odd_rows_and_empty_tables(spark):
    """Nulls, repeated rows, no ids, long texts and clashing columns give a row each; empty tables none."""
    rows = spark.createDataFrame([(i, t, None, None, None, "c", 0.5, 9) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, id string, score double, component long")
    labels = spark.createDataFrame([(i, int(i == 19)) for i in range(20)], "doc_id long, toxic int")
    target = spark.createDataFrame([("one t1 t2",)], "text string")
    base = (jaccard_join.op1, language_id.op2, lambda d: toxicity.op9(d, labels), quality.op8, substring_dedup.op10, source_mix.op4, personal_data.op5)
    for run in (*base, byte_bpe.op6, fingerprint.op7, sentence_pieces.op11, lambda d: importance.op12(d, target), periodic_runs.op13):
        assert run(rows).count() == len(ODD) and run(rows.filter("false")).count() == 0
    for stage in (lambda d: toxicity.keep_clean(d, labels), jaccard_join.keep_one_of_each, personal_data.redacted_documents):
        kept = stage(rows)
        assert kept.columns == rows.columns and stage(rows.filter("false")).count() == 0
        assert sorted((r.doc_id or 0, r.text or "", r.id, r.score, r.component) for r in kept.collect()) == sorted((i or 0, t or "", "c", 0.5, 9) for i, t in ODD)
    assert main_text.op3(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_op4_without_ids(spark):
    """Rows without an id, or that share one, are dealt by their texts: reruns over other partitions take the same words of the same texts."""
    rows = [(None if i % 3 else 7, " ".join(f"t{i}w{k}" for k in range(1 + i * 37 % 50)), "ab"[i % 2], 1) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    once, again = (sorted(r.text for r in source_mix.mixed_documents(docs.repartition(n)).collect()) for n in (2, 5))
    assert once == again and len(once) > 240
    assert len({r.finish for r in source_mix.op4(docs).filter("taken > 0").collect()}) > 200


def digest_by_hand(text):
    """Length and classes of the bucket counts, triplet by triplet."""
    data = text.encode()

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 % (1 << 64)
        x ^= x >> 27
        x = x * 0x94D049BB133111EB % (1 << 64)
        return x ^ x >> 31

    counts = [0] * 256
    kinds = fingerprint.TRIPLETS + (fingerprint.SHORT_TRIPLETS if len(data) < fingerprint.SHORT else ())
    for k, offsets in enumerate(kinds):
        for i in range(len(data) - max(offsets)):
            key = k + 1
            for at in offsets:
                key = key << 8 | data[i + at]
            counts[mixed(key) % 256] += 1
    ordered = sorted(counts)
    limits = [ordered[q * 64 - 1] for q in (1, 2, 3)]
    return min(255, round(4 * float(np.log2(1 + len(data))))), [sum(c > limit for limit in limits) for c in counts]


def test_op7_by_hand():
    texts = ["", "a", "abc", "été à l'île " * 3, PARAGRAPH, PARAGRAPH * 20, PARAGRAPH[5:] + "x", "x" * 400, "日本語" * 9]
    hexes = fingerprint._digests_of(texts)
    held = [digest_by_hand(t) for t in texts]
    for text, (length, classes) in zip(hexes, held, strict=True):
        packed = bytes([length]) + bytes(sum(classes[4 * i + k] << 2 * k for k in range(4)) for i in range(64))
        assert text == packed.hex()
    for (n, a) in held:
        for (m, b) in held:
            steps = sum({0: 0, 1: 1, 2: 3, 3: 6}[abs(x - y)] for x, y in zip(a, b, strict=True))
            want = min(1.0, max(0.0, 1 - (steps / 256 + abs(n - m) / 32) / 2))
            got = fingerprint.likeness([hexes[held.index((n, a))]], [hexes[held.index((m, b))]])[0]
            assert abs(got - want) < 1e-12


def test_op8_long_texts(spark, monkeypatch):
    """Texts of more words than a place has bits for take another path, with the same counts."""
    monkeypatch.setattr(quality, "PLACE_BITS", 5)
    random = np.random.default_rng(3)
    texts = [" ".join(f"w{random.integers(k)}" for _ in range(n)) for k in (2, 4, 30) for n in (20, 33, 64, 200)] + ["a b c " * 30, "x"]
    got = {r.doc_id: r.n_repeat_words for r in quality.op8(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        assert got[i] == len({k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)})
