"""SentencePiece ids and texts against the library itself."""

import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from folioworks.llm import sentence_pieces as sp

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = [None, "", " ", "  ", "a ", " a", "a  b   c", "▁", "▁ ▁▁x▁", "Un été à l'île\n\tfin.", "é😀　ｆ\x00", "<s> </s> <unk> <0x41>", "x" * 3000, "word " * 2000, "\n", "日本語のテキスト です", "tab\tand  ends  ", "الْعَرَبِيَّة नमस्ते"]


def alone(texts):
    chunks, ends = sp.chunks_of(texts)
    ids = sp.Pieces(PATH).segment(chunks)
    starts = [0, *ends][: len(ends)]
    return [[i for c in ids[a:b] for i in c] for a, b in zip(starts, ends, strict=True)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" ▁\nabé😀<0x>"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_chunks_are_segmented_as_texts_are(texts):
    ids = alone(texts)
    assert ids == [MODEL.encode(t) for t in texts]
    flat, ends = np.array([i for x in ids for i in x], np.int32), np.cumsum([0, *map(len, ids)])
    assert sp.Pieces(PATH).decode_batch(flat, ends) == [MODEL.decode(x) for x in ids]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 700), max_size=12), max_size=4))
def test_any_ids_are_decoded_as_the_library_does(ids):
    flat, ends = np.array([i for x in ids for i in x], np.int32), np.cumsum([0, *map(len, ids)])
    assert sp.Pieces(PATH).decode_batch(flat, ends) == [MODEL.decode(x) for x in ids]


@pytest.mark.parametrize("size", [0, 3, 200_000])
def test_documents(spark, size):
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in enumerate(TEXTS * 2)] + [(None, "a b", "x", 1), (1, "repeated id", "x", 1)], "id long, text string, ids string, n int").repartition(3)
    rows = sp.encode(docs, PATH, size, and_decode=True)
    want = [(i, t) for i, t in enumerate(TEXTS * 2)] + [(None, "a b"), (1, "repeated id")]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r.id, r.ids, r.decoded) for r in rows.collect()), key=key) == sorted(((i, MODEL.encode(t or ""), MODEL.decode(MODEL.encode(t or ""))) for i, t in want), key=key)
    again = sp.decode(rows, PATH).collect()
    assert all(r.decoded == MODEL.decode(r.ids) for r in again)
    assert sp.encode(docs.filter("false"), PATH, size).count() == 0


def test_op11(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in sp.op11(docs).collect():
        ids = MODEL.encode(TEXTS[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(MODEL.decode(ids)))


def test_the_table_holds_the_most_frequent(spark):
    docs = spark.createDataFrame([("a a a b b c",), ("a b c d",), (None,)], "text string")
    assert {r.chunk: r.n for r in sp.chunk_counts(docs).collect()} == {"▁a": 4, "▁b": 3, "▁c": 2, "▁d": 1}
    assert {r.chunk for r in sp.chunk_table(docs, PATH, 2).collect()} == {"▁a", "▁b"}
