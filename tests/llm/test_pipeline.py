"""Each stage of the pipeline on its own input."""

import random
from collections import Counter

import corpus_pipeline as p
import public_tokenizers
import pytest
from tokenizers import Tokenizer

rnd = random.Random(6)
WORDS = "the of and to a in is it for on with garden window river paper stone light evening number letter".split()


@pytest.fixture(scope="module")
def docs(spark):
    text = lambda n: "\n".join(" ".join(rnd.choice(WORDS) + rnd.choice(["", "s", "ly", "er"]) for _ in range(10)) for _ in range(n))
    rows = [[i, ("Sign up here now\n" if i % 2 else "") + text(rnd.randrange(3, 12)), "en", f"src{i % 3}"] for i in range(120)]
    rows += [[200 + i, rows[i][1], "en", "src0"] for i in range(10)] + [[300, "###", "en", "src1"], [301, None, None, None], [302, "", "en", "src1"]]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs):
    kept = p.quality_rules(spark, docs, "")
    assert kept.columns == list(p.COLUMNS)
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {300, 301, 302} and len(ids) == 130
    lined = p.line_dedup(spark, kept, "")
    rows = lined.collect()
    assert len(rows) == 130 and not any("Sign up" in r.text for r in rows) and all(r.n_chars == len(r.text) for r in rows)
    one = p.near_dedup(spark, lined, "")
    left = {r.doc_id for r in one.collect()}
    assert left == set(range(120))
    mixed = p.mix_sources(spark, one, "").collect()
    sizes = {r.doc_id: len(r.text.split()) for r in one.collect()}
    n = Counter(r.doc_id for r in mixed)
    assert max(n.values()) <= 3 and set(n) <= left
    total = sum(sizes[i] * k for i, k in n.items())
    assert abs(total - sum(sizes.values())) < 0.05 * sum(sizes.values()) + 6 * max(sizes.values())
    enc = p.encode(spark, one, "").collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in one.collect()}
    assert all(r.n_tokens == len(t.encode(text[r.doc_id], add_special_tokens=False).ids) for r in enc)


def test_rows_that_repeat_as_a_whole(spark, docs):
    twice = docs.where("doc_id < 20").unionByName(docs.where("doc_id < 20"))
    assert Counter(r.doc_id for r in p.near_dedup(spark, twice, "").collect()) == Counter(range(20))


def test_no_documents(spark, docs):
    out = docs.limit(0)
    for _, stage in p.STAGES:
        out = stage(spark, out, "")
        assert out.count() == 0
