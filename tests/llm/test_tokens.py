"""Encoders against the tokenizers library, and the file format by round trips."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rayloom.llm import bpe, tokens

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
rnd = random.Random(2)
POOL = [*"aaabcdeAB''s  \n\t.,!éÉßΣσς१२३Ⅷ中文🙂<|>İ Ᲊ՘", "<|endoftext|>", "<|startoftext|>", "'ll", "'S", " the", " and", "  "]
TEXTS = ["".join(rnd.choice(POOL) for _ in range(rnd.randrange(50))) for _ in range(600)] + ["", "a" * 3000, "ab " * 2000, " lead", "trail \n", "x  y   z"]


def lib(path):
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def test_word_bpe_is_the_library(spark):
    t = lib(WORD)
    df = spark.createDataFrame([*enumerate(TEXTS), (None, None)], "doc_id long, text string")
    for r in bpe.encode(df, WORD, ["doc_id"]).collect():
        ids = t.encode(TEXTS[r.doc_id] if r.doc_id is not None else "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert r.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode(df.limit(0), WORD, ["doc_id"]).count() == 0


def test_word_bpe_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    e, t = bpe.Encoder(WORD), lib(WORD)
    for lo in range(0, len(TEXTS), 50):
        for text, (ids, _) in zip(TEXTS[lo : lo + 50], e(TEXTS[lo : lo + 50]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_byte_words_are_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 100)
    e, t = tokens.WordEncoder(BYTE), lib(BYTE)
    for lo in range(0, len(TEXTS), 50):
        for text, ids in zip(TEXTS[lo : lo + 50], e(TEXTS[lo : lo + 50]), strict=True):
            assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def test_spaces_among_other_white_space_are_the_library():
    white = [" ", " ", " ", "\u00a0", "\u3000", "\t", "\n", "\r", "\x1c", "\x85", "\u2028", "a", "b", ".", "é"]
    texts = ["a \u00a0 \u00a0 b", "a \u3000 \u3000 b", "a\n ", "a\t \tb", " \u00a0 " * 4 + "x", "x\n \n \ny"] + ["".join(rnd.choice(white) for _ in range(rnd.randrange(12))) for _ in range(4000)]
    texts += ["a" + " \u00a0" * n + end for n in (1, 2, 4, 8) for end in ("", " ", " b", "b")]
    e, t = tokens.WordEncoder(BYTE), lib(BYTE)
    for text, ids in zip(texts, e(texts), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_pieces_of_any_kind_are_the_library(monkeypatch):
    """Words of vocabulary entries, digits, marks and line ends, so that pieces stand joint, between line ends and alone."""
    t = lib(BYTE)
    parts = [t.id_to_token(rnd.randrange(50_000)).replace("Ġ", " ").replace("Ċ", "\n") for _ in range(3000)] + ["\n", "\n\n", ".\nThe", "'s", "'re", "1234", "##", "日本", "é", "a\u0301", "ﬁ", "½", "²"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", "", " ", "\n"]) for _ in range(rnd.randrange(40))) for _ in range(2000)]
    e = tokens.WordEncoder(BYTE)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5000)
    for lo in range(0, len(texts), 200):
        some = texts[lo : lo + 200]
        for text, ids, own in zip(some, e(some), t.encode_batch(some, add_special_tokens=False), strict=True):
            assert ids.tolist() == own.ids, text


@pytest.mark.parametrize("per_file", [40, 1 << 20])
def test_files_round_trip(spark, tmp_path, per_file, monkeypatch):
    monkeypatch.setattr(tokens, "PART_BYTES", 1000)
    t, rows = lib(BYTE), [(rnd.randrange(-50, 500), x) for x in TEXTS[:60]] + [(None, None), (9, "same"), (9, "same")]
    to = f"file://{tmp_path}/t"
    manifest = tokens.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), BYTE, to, file_bytes=per_file)
    got = sorted(tokens.read_back(manifest, to).collect(), key=lambda r: r.start)
    assert [r.key for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    ends = 0
    for r in got:
        assert r.start == ends
        ends += r.n_tokens
        crcs = [zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for k, x in rows if k == r.key]
        assert r.ids_crc32 in crcs
    # one document alone, from any file
    file = manifest.orderBy("part", "file_no").first()["file"]
    one = tokens.Reader(to, file)
    assert [x.tolist()[-1] for x in one.find(one.keys[-1])][0] == 2


def test_ids_that_repeat_or_lack_fill_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "PART_BYTES", 100)
    rows = [(None, f"none {k}") for k in range(40)] + [(5, f"five {k}") for k in range(60)] + [(k, f"own {k}") for k in range(40)]
    to = f"file://{tmp_path}/t"
    manifest = tokens.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), BYTE, to, file_bytes=60)
    made = manifest.collect()
    # null ids and those that are five stand in several parts, and a part in several files
    assert max(r.n_docs for r in made) <= 25 and len({r.part for r in made}) > 8 and max(r.file_no for r in made) > 0 and manifest.agg({"n_docs": "sum"}).first()[0] == 140
    got = sorted(tokens.read_back(manifest, to).collect(), key=lambda r: r.start)
    assert [r.key for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))


def test_file_is_seekable_zstandard(spark, tmp_path):
    import zstandard

    to = f"file://{tmp_path}/t"
    manifest = tokens.write(spark.createDataFrame([(1, "one text"), (2, "two")], "doc_id long, text string"), BYTE, to).collect()
    raw = (tmp_path / "t" / manifest[0]["file"]).read_bytes()
    n, flags, magic = struct.unpack("<IBI", raw[-9:])
    assert (n, flags, magic) == (2, 0x80, 0x8F92EAB1)
    with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as r:
        plain = r.read(1000)
    ids = lib(BYTE).encode("one text", add_special_tokens=False).ids
    assert np.frombuffer(plain, "<u2").tolist()[: len(ids) + 1] == [*ids, 2]
    broken = bytearray(raw)
    broken[6] ^= 1
    (tmp_path / "t" / "broken.zst").write_bytes(broken)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokens.Reader(to, "broken.zst").ids(0)


def test_no_documents(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.tokenize_to_files(spark, empty, BYTE, f"file://{tmp_path}/t").count() == 0
