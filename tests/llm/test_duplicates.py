"""Near and exact duplicates against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from rayloom.llm import common, components, embeddings, minhash, repeats

rnd = random.Random(4)
VOCAB = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in "mnrst"]


def near_texts():
    out = []
    for _ in range(25):
        base = [rnd.choice(VOCAB) for _ in range(rnd.randrange(3, 120))]
        out.append(" ".join(base))
        for _ in range(rnd.randrange(0, 5)):
            w = list(base)
            for _ in range(rnd.randrange(0, 5)):
                w[rnd.randrange(len(w))] = rnd.choice(VOCAB)
            out.append("\n".join(w).upper() if rnd.random() < 0.2 else " ".join(w))
    family = [rnd.choice(VOCAB) for _ in range(150)]
    for _ in range(60):  # copies of one text, most too far from each other
        w = list(family)
        for _ in range(rnd.randrange(1, 7)):
            w[rnd.randrange(len(w))] = rnd.choice(VOCAB)
        out.append(" ".join(w))
    return [*out, None, "", " \t\n", "one", "ONE", "one two", "É é", out[3], out[3], "long " + " ".join(VOCAB) * 200]


def roots(pairs, ids):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("length", [4, 5])
def test_minhash(spark, length):
    texts = near_texts()
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + length]) for i in range(len(w) - length + 1)} or ({tuple(w)} if w else set()))
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = roots(pairs, range(len(sets)))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    got = minhash.near_duplicates(df, length=length).collect()
    assert {r.key: (r.n, r.component) for r in got} == {i: (len(s), expected[i]) for i, s in enumerate(sets)}
    assert all(r.first == (r.key == r.component) for r in got)


def test_minhash_edges(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    # null and repeated ids: told apart by their texts
    rows = [(None, "a b c d e f g"), (5, "a b c d e f g"), (5, "other words stand here in a row"), (5, "a b c d e f g"), (9, "other words stand here in a row")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert Counter((r.key, r.component) for r in got) == Counter({(None, 5): 1, (5, 5): 3, (9, 5): 1})
    assert sum(r.first for r in got) == 2


def test_family_cells_meet(spark, monkeypatch):
    """Cells of two rows give the same links as one cell."""
    monkeypatch.setattr(minhash.families, "__defaults__", (2,))
    test_minhash(spark, 4)


def test_components(spark):
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    expected = roots(edges, {x for e in edges for x in e})
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in expected.items() if k != v}


@pytest.mark.parametrize(("window", "block", "hot"), [(40, 16, 3), (33, 4, 2), (48, 64, 4000)])
def test_repeats(spark, window, block, hot):
    passages = ["".join(rnd.choice("abcdé") for _ in range(rnd.randrange(20, 90))) for _ in range(6)]
    texts = ["".join(rnd.choice([rnd.choice(passages), "".join(rnd.choice("abc ") for _ in range(rnd.randrange(1, 40)))]) for _ in range(rnd.randrange(0, 5))) for _ in range(100)]
    texts += ["a" * 200, "ab" * 80, "", None, texts[5], texts[5], texts[7] + "x", "abc" * 40]
    raws = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + window] for b in raws for i in range(len(b) - window + 1))
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ranges int").repartition(3)
    got = {r.doc_id: r for r in repeats.remove_repeats(df, ["doc_id", "ranges"], window=window, block=block, hot=hot).collect()}
    for k, b in enumerate(raws):
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if n[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)), k


def test_repeats_edges(spark, monkeypatch):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0
    monkeypatch.setattr(repeats, "PIECE", 64)  # a text in overlapping pieces
    b = bytes(rnd.choice(b"abcd") for _ in range(500))
    runs = [repeats.anchors(np.frombuffer(b[lo:hi], np.uint8), 40) for lo, hi in repeats.pieces(len(b), 40)]
    assert sum(int((last - first + 1).sum()) for _, _, first, last in runs) == len(b) - 40 + 1


def test_columnwise(tmp_path):
    docs = [(bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 6))), rnd.randrange(2), 10, bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 6)))) for _ in range(40)]
    c = repeats.Columnwise(docs, str(tmp_path))
    flat = [[*a, 1000 + core, *b] for a, core, _, b in docs]
    weight = lambda s: sum(10 if x >= 1000 else 1 for x in s)
    order = list(zip(c.read("doc").tolist(), c.read("size").tolist(), strict=True))
    suffixes = [flat[d][len(flat[d]) - s :] for d, s in order]
    assert suffixes == sorted(suffixes) and len(suffixes) == sum(len(f) + 1 for f in flat)
    for k, lcp in enumerate(c.read("lcp").tolist()):
        x, y = suffixes[k - 1] if k else [], suffixes[k]
        n = next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
        assert lcp == weight(y[:n])


def test_columnwise_without_files(tmp_path):
    """In memory the columns are those of the files, and the files are written anew, not over each other."""
    docs = [(bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 9))), rnd.randrange(5), 20, bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(0, 9)))) for _ in range(300)]
    held, filed = repeats.Columnwise(docs), repeats.Columnwise(docs, str(tmp_path))
    for name in ("bwt", "lcp", "doc", "size"):
        assert held.read(name).tolist() == filed.read(name).tolist()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["bwt", "doc", "lcp", "size"]
    assert all(x.tolist() == y.tolist() for x, y in zip(held.repeated(22), filed.repeated(22), strict=True))


def test_construction_leaves_the_disk_alone(monkeypatch):
    """A collection's rounds wrote and replaced four files each, and waited for the disk."""
    import tempfile

    import pyarrow as pa

    class Rows:
        """Stands for a table: the function that its tasks would run."""

        select = repartition = sortWithinPartitions = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    def no_files(*_, **__):
        raise AssertionError("a file")

    monkeypatch.setattr(tempfile, "TemporaryDirectory", no_files)
    core = b"k" * 16
    # windows of 8 bytes of one core of 5: the left or right bytes of two blocks agree in part
    blocks = [(1, b"c1", 10, 4, core, b"xyz", b"abc"), (1, b"c2", 20, 4, core, b"qyz", b"abd"), (1, b"c3", 30, 4, core, b"mno", b"pqr")]
    names = ["anchor", "ctx", "at", "size", "key", "left", "right"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*blocks, strict=True)], names=names)
    out = [r for b in repeats.construct(Rows(), 8)(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["ctx"], r["lo"], r["hi"]) for r in out) == [(b"c1", 11, 13), (b"c2", 21, 23)]


def test_range_minima():
    x = np.array([rnd.randrange(1000) for _ in range(200)], np.uint16)
    lo = np.array([rnd.randrange(200) for _ in range(500)])
    hi = np.array([rnd.randrange(a, 200) for a in lo.tolist()])
    assert repeats._range_minima(x, lo, hi).tolist() == [int(x[a : b + 1].min()) for a, b in zip(lo, hi, strict=True)]


def test_embeddings(spark):
    g = np.random.default_rng(3)
    base = g.normal(size=(60, 32))
    v = [b + g.normal(scale=s, size=32) * 0.2 for b in base for s in (0, 0.5, 1, 1.3)] + [base[0] + g.normal(size=32) * 0.02 for _ in range(400)]
    v = [x.astype(np.float32).tolist() for x in v]
    v += [v[0], [3 * x for x in v[1]], None, [], [0.0] * 32, [float("nan")] * 32, [None] * 32, [float("inf")] * 32, [1.0] * 31]
    ok = [x is not None and len(x) == 32 and all(y is not None and np.isfinite(y) for y in x) and any(x) for x in v]
    m = np.array([x if k else [0] * 32 for x, k in zip(v, ok, strict=True)], float)
    m[ok] /= np.linalg.norm(m[ok], axis=1, keepdims=True)
    linked = m @ m.T >= 0.95
    np.fill_diagonal(linked, False)
    expected = roots([(i, j) for i, j in zip(*np.nonzero(linked), strict=True) if i < j], range(len(v)))
    df = spark.createDataFrame([(i, x, "c") for i, x in enumerate(v)], "vec_id long, embedding array<float>, code string")
    got = {r.key: r for r in embeddings.near_vectors(df).collect()}
    n = np.array([got[i].n_links for i in range(len(v))])
    assert (n <= linked.sum(1)).all() and n.sum() >= 0.98 * linked.sum()
    assert sum(got[i].component == expected[i] for i in range(len(v))) >= 0.98 * len(v)
    assert all(got[i].n_links == 0 and got[i].component == i for i, k in enumerate(ok) if not k)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_balanced_codes():
    g = np.random.default_rng(1)
    x = g.normal(size=(2000, 16)) @ g.normal(size=(16, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, p = embeddings.fit(x)
    assert np.abs(((x - mean) @ p > 0).mean(0) - 0.5).max() < 0.1


@pytest.mark.parametrize("n", [2_000, 60_000, 400_000, 100_000_000])
def test_neighbours_reach_is_the_same_at_any_row_count(spark, n):
    near, far = [], []
    for k in range(12):
        a = rnd.getrandbits(64)
        for flips, out in ((11, near), (17, far)):
            b = a
            for i in range(flips):  # spread evenly, so that no table has few of them
                b ^= 1 << (64 * i // flips + k % 3)
            out.append(tuple(sorted(np.array([a, b], np.uint64).view(np.int64).tolist())))
    classes = spark.createDataFrame([(c,) for c in {c for p in near + far for c in p}], "code long")
    got = {tuple(r) for r in embeddings.neighbours(classes, 64, n).collect()}
    assert got.issuperset(near) and got.isdisjoint(far)


@pytest.mark.parametrize(("words", "gram"), [(12, 8), (20, 8), (50, 32)])
def test_shared_passages(spark, words, gram):
    passages = [" ".join(rnd.choice(VOCAB) for _ in range(rnd.randrange(gram - 4, words + 8))) for _ in range(8)]
    texts = ["\n ".join(rnd.choice([rnd.choice(passages), " ".join(rnd.choice(VOCAB[:40]) for _ in range(rnd.randrange(1, 40)))]) for _ in range(rnd.randrange(0, 5))) for _ in range(80)]
    alone = " ".join(f"only{k}" for k in range(60))
    texts += [alone + " " + alone, "a " * 60, "b " * 60, "b " * 70, "", None, " \n", "w " * (words - 1), *[" ".join(f"copy{k}" for k in range(70))] * 2]

    def shared(size):
        runs = [(lambda w: {tuple(w[i : i + size]) for i in range(len(w) - size + 1)})((t or "").encode().split()) for t in texts]
        n = Counter(x for r in runs for x in r)
        return {i for i, r in enumerate(runs) if any(n[x] > 1 for x in r)}

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in repeats.remove_repeats(df, ["doc_id"], window=40, words=words).where("shares_passage").collect()}
    assert shared(words) <= got <= shared(gram)
    assert len(texts) - 10 not in got and {len(texts) - 1, len(texts) - 2} <= got


def test_word_hashes_do_not_depend_on_what_is_remembered():
    texts = [" ".join(rnd.choice(VOCAB) for _ in range(30)).encode() for _ in range(40)]
    assert all((a == b).all() for a, b in zip(common.WordHashes()(texts), common.WordHashes(most=5)(texts), strict=True))


def test_repeats_win_over_clashing_names(spark):
    df = spark.createDataFrame([(1, "ab", "x", "y")], "doc_id long, text string, n_bytes string, __text string")
    out = repeats.remove_repeats(df, ["doc_id", "n_bytes", "__text"])
    assert out.columns == ["doc_id", "__text", "n_bytes", "n_removed", "n_spans", "kept", "shares_passage"]
    assert (out.first().n_bytes, out.first()["__text"]) == (2, "y")


@pytest.mark.parametrize("dims", [64, 128])
def test_recall_with_the_tables_of_large_inputs(dims):
    """Pairs at cosine 0.95 to 0.96, looked up with as many tables as 2 thousand to 10^10 codes get."""
    g = np.random.default_rng(9)
    x = g.normal(size=(10_000, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, p = embeddings.fit(x, rounds=20)
    a = x[:5000]
    side = g.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = g.uniform(0.95, 0.96, (len(a), 1))
    b = cosine * a + np.sqrt(1 - cosine**2) * side
    differ = ((a - mean) @ p > 0) != ((b - mean) @ p > 0)
    bits = differ.shape[1]
    for n in (2_000, 60_000, 10**6, 10**8, 10**10):
        tables = min(bits, max(2, round(bits / np.log2(n))))
        edges = [bits * i // tables for i in range(tables + 1)]
        per = np.stack([differ[:, lo:hi].sum(1) for lo, hi in zip(edges, edges[1:], strict=False)])
        found = (per.min(axis=0) <= max(1, embeddings.REACH // tables)) & (differ.sum(1) <= embeddings.RADIUS)
        assert found.mean() >= 0.95, (n, tables)


def test_rows_without_an_id_meet_their_own_texts_only(spark):
    """A third of the rows has no id: each is compared by its own text, and copies of whole rows are one class."""
    words = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(words[:40] + [f"own{k}"] * 1 + words[40 : 45 + k % 3])) for k in range(40)] + [(None, "the same text of six words")] * 30 + [(k, " ".join(words[k:] + words[:k])) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df, length=4).collect()
    assert len(got) == len(rows)
    lone = [r for r in got if r.key is None]
    assert sum(r.first for r in lone) == 2  # the family of forty and the copies
    assert all(r.component is None for r in lone)
