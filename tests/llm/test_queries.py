"""Every registered query of the subpackage on whole small tables: against its SQL, or brute force."""

import hashlib
import os
import zlib
from collections import Counter

import __spark_entry__ as entry
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rayloom.llm.oracles import ORACLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def rows(spark, name):
    return entry.queries()[name](spark, DATA).collect()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA)
    cur = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(str(r[c]) for c in names) for r in got.collect()) == Counter(tuple(map(str, r)) for r in cur.fetchall())


def test_op1(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op1_shard_shuffle")}
    assert len(got) == len(docs) and {r.law for r in got.values()} == {"rows"}
    for d in docs:
        raw = (d.text or "").encode()
        assert (got[d.doc_id].size, got[d.doc_id].text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    n = Counter(r.shard for r in got.values())
    assert set(n) == set(range(40)) and max(n.values()) - min(n.values()) <= 1
    assert all(sorted(r.slot for r in got.values() if r.shard == k) == list(range(n[k])) for k in n)


@pytest.mark.parametrize("name", ["op2_bpe", "op3_token_files"])
def test_tokens(spark, docs, name):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json" if name == "op2_bpe" else "byte_bpe_50k.json"))
    t.no_padding()
    t.no_truncation()
    got, start = {r.doc_id: r for r in rows(spark, name)}, 0
    for d in sorted(docs, key=lambda d: d.doc_id):
        ids, r = t.encode(d.text or "", add_special_tokens=False).ids, got[d.doc_id]
        if name == "op2_bpe":
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        else:
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
            start += len(ids) + 1


def test_op5(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in v], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = (x @ x.T >= 0.95).sum(1) - 1
    got = {r.vec_id: r for r in rows(spark, "op5_embedding_dedup")}
    assert all(got[r.vec_id].n_links == k for r, k in zip(v, n.tolist(), strict=True))
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())


def test_op6(spark, docs):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = rows(spark, "op6_toxicity")
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.8 * len(held)


def test_op11(spark, docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in rows(spark, "op11_sentencepiece")}
    assert len(got) == len(docs)
    for d in docs:
        ids, r = lib.encode(d.text or "", add_eos=True), got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_op8(spark, docs):
    sets = {}
    for d in docs:
        w = (d.text or "").encode().lower().split()
        sets[d.doc_id] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows(spark, "op8_minhash")}
    assert got == {k: (len(s), root(k), root(k) == k) for k, s in sets.items()}


def test_op10(spark, docs):
    raws = {d.doc_id: (d.text or "").encode() for d in docs}
    n = Counter(b[i : i + 400] for b in raws.values() for i in range(len(b) - 399))
    got = {r.doc_id: r for r in rows(spark, "op10_suffix_dedup")}
    for k, b in raws.items():
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 399):
            if n[b[i : i + 400]] > 1:
                gone[i : i + 400] = 1
        left = bytes(np.frombuffer(b, np.uint8)[gone[:-1] == 0])
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(left).hexdigest())


def test_pipeline(spark, docs):
    """The rows of the last stage are what the library makes of the texts that the stages before it kept."""
    import corpus_pipeline as p

    out = docs_ = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, out, DATA)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    expected = Counter()
    for r in out.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        expected[r.doc_id, r.source, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += 1
    got = rows(spark, "pipeline")
    assert Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256) for r in got) == expected
    assert {r.doc_id for r in got} <= {d.doc_id for d in docs_.collect()} and len(got) > 50
