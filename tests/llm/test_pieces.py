"""SentencePiece encoding against the library, over made texts and odd rows."""

import random

import numpy as np
import public_tokenizers
import pytest

from rayloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, ids string"
rnd = random.Random(3)


@pytest.fixture(scope="module")
def model():
    return pieces.Model(PATH)


def made(vocabulary):
    kind = rnd.randrange(6)
    if kind == 0:
        return "".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(30)))
    if kind == 1:
        return "".join(rnd.choice("ab theing  \t\n▁") for _ in range(rnd.randrange(400)))
    if kind == 2:
        return "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x500), rnd.randrange(0x3000, 0x9FFF), rnd.randrange(0x1F300, 0x1F9FF)])) for _ in range(rnd.randrange(60)))
    if kind == 3:
        return "".join(rnd.choice("theinrsatoud") for _ in range(rnd.randrange(1500)))  # past LONG: the heap
    if kind == 4:
        return rnd.choice("aht ▁9") * rnd.randrange(900)
    return " ".join(rnd.choice(["the", "internationalization", "x", "Straße", "  ", "éè"]) for _ in range(40))


def test_made_texts_equal_the_library(model):
    vocabulary = [model.lib.id_to_piece(i) for i in range(model.n)]
    texts = [made(vocabulary) for _ in range(3000)]
    enc = pieces.Encoder(PATH)
    for lo in range(0, len(texts), 500):
        ids, each, shown = enc(texts[lo : lo + 500])
        theirs = model.lib.encode(texts[lo : lo + 500], add_eos=True)
        assert [x.tolist() for x in np.split(ids, np.cumsum(each))[:-1]] == theirs
        assert shown == model.lib.decode(theirs)


def test_rounds_and_heap_agree(model, monkeypatch):
    words = ["▁" + "".join(rnd.choice("theinrsatoud") for _ in range(rnd.randrange(1, 120))) for _ in range(300)]
    ids, sizes = model.merge(words)
    monkeypatch.setattr(pieces, "LONG", 1)
    again, sizes2 = model.merge(words)
    assert ids.tolist() == again.tolist() and sizes.tolist() == sizes2.tolist()


def test_decode_any_ids(model):
    for _ in range(3000):
        ids = [rnd.choice([rnd.randrange(model.n), rnd.randrange(3, 259), rnd.randrange(3), model.lib.piece_to_id("▁"), model.lib.piece_to_id("▁▁")]) for _ in range(rnd.randrange(9))]
        assert model.decode(ids) == model.lib.decode(ids)


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 20)
    enc = pieces.Encoder(PATH)
    first = [enc([f"word{i} other{i} the"])[0].tolist() for i in range(60)]
    assert first == [enc([f"word{i} other{i} the"])[0].tolist() for i in range(60)]


@pytest.mark.parametrize("rows", [[], [(1, None, "clash"), (None, "", "clash"), (2, "a b", None), (2, "a b", None), (3, "word " * 50_000, ""), (4, "ab" * 200_000, ""), (5, "<s> ▁ \x00", "")]])
def test_operator(spark, model, rows):
    df = spark.createDataFrame(rows, DOCS)
    out = pieces.encode(df, PATH, ["doc_id", "ids"])
    assert out.columns == ["doc_id", "ids", "decoded"]
    got = sorted(((r.doc_id or 0, list(r.ids), r.decoded) for r in out.collect()))
    assert got == sorted((i or 0, ids := model.lib.encode(t or "", add_eos=True), model.lib.decode(ids)) for i, t, _ in rows)
    assert pieces.check(df, PATH, ["doc_id"]).count() == 0
    back = pieces.decode(out.withColumnRenamed("decoded", "was"), PATH, ["doc_id", "was"])
    assert back.where("was <> decoded").count() == 0 and back.count() == len(rows)


def test_other_models_are_refused():
    with pytest.raises((ValueError, RuntimeError, OSError)):
        pieces.Model(public_tokenizers.path("byte_bpe_50k.json"))
