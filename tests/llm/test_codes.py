"""Vector codes and importance resampling against plain loops, and odd rows."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from rayloom.llm import codes, resample

VECTORS = "vec_id long, embedding array<double>, label int, code string"
NAN = float("nan")


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(id, label) -> code and error by Python's integers, one vector at a time."""
    good = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    size = len(good[0][1]) if good else 0
    good = [r for r in good if len(r[1]) == size]
    step = size // parts
    cut = [[v[p * step : (p + 1) * step] for p in range(parts)] for _, v, _ in good]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda c: [min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)]
    for _ in range(rounds):
        got = [near(c) for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, g in zip(cut, got, strict=True) if g[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = []
    for (i, _, label), c in zip(good, cut, strict=True):
        g = near(c)
        out.append((i, label, "".join(f"{e:02x}" for e in g), min(codes.TOP, sum(far(c[p], books[p][g[p]]) for p in range(parts)))))
    total = Counter()
    for r in out:
        total[r[1]] += r[3]
    text = ",".join(str(x) for b in books for e in b for x in e)
    return Counter((*r, min(codes.TOP, total[r[1]]), sha256(text.encode()).hexdigest()) for r in out)


def vectors(n, scale=1.0, seed=0):
    rnd = random.Random(seed)
    return [(i * 3 % 101 + i // 101 * 101, [rnd.gauss(0, scale) for _ in range(16)], rnd.choice([0, 0, 0, 1, 2, None]), "clash") for i in range(n)]


ODD = [(500, None, 1, ""), (501, [NAN] + [0.0] * 15, 1, ""), (502, [float("inf")] * 16, None, ""), (503, [None] + [0.5] * 15, 2, ""), (504, [], 2, ""), (505, [1.0] * 8, 2, ""), (None, [0.25] * 16, None, ""), (7, [0.1] * 16, 9, ""), (7, [0.1] * 16, 9, "")]


@pytest.mark.parametrize("rows", [[], ODD[:5], vectors(5), vectors(120) + ODD, [(i, [1.5] * 16, 0, "") for i in range(40)], vectors(60, 1e7), vectors(20, 1e12) + ODD])
def test_codes(spark, rows):
    df = spark.createDataFrame(rows, VECTORS)
    out = codes.compress(df, "vec_id", "embedding", "label").collect()
    got = Counter((r.vec_id, r.label, r.code.hex(), r.error, r.label_error, r.codebooks_sha256) for r in out)
    assert got == plain_codes(rows)


def test_codes_of_a_length_that_no_parts_make(spark):
    rows = [(i, [0.1 * i] * 10, 0, "") for i in range(4)]
    assert codes.compress(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", "label").count() == 0


def test_labels_large_and_small(spark):
    """Both ways back for the sums of labels, with `many` so low that most labels are small."""
    rows = [(i, i % 7 if i % 3 else None, i) for i in range(300)] + [(1000 + i, 100 + i, 5) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, label int, error long")
    got = codes.label_totals(df, "label", many=4).collect()
    total = Counter()
    for _, label, e in rows:
        total[label] += e
    assert Counter((r.vec_id, r.label_error) for r in got) == Counter((i, total[label]) for i, label, _ in rows)


def test_nearest_is_exact_past_doubles():
    big = np.array([[[codes.MOST, 0]], [[codes.MOST - 1, 0]]], object)
    code, least = codes.nearest(big, np.array([[[codes.MOST, 0], [codes.MOST - 1, 0]]], object))
    assert code[:, 0].tolist() == [0, 1] and least[:, 0].tolist() == [0, 0]


DOCS = "doc_id long, text string, score string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_resample(docs, target, percent=25, least=20):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        w = WORD.findall((text or "").translate(lower))
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]

    s, t = Counter(), Counter()
    for _, x, _ in docs:
        s.update(features(x)[1])
    for _, x, _ in target:
        t.update(features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out = []
    for i, x, _ in docs:
        n, f = features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return Counter((*r, rank.get(id(r))) for r in out)


rnd = random.Random(8)
WORDS = ["Alpha", "beta", "Straße", "ÄÖ", "x1", "don't", "the", "日本", "9"]
TEXTS = [(i, rnd.choice([" ", ", ", "\n"]).join(rnd.choice(WORDS) for _ in range(rnd.randrange(60))), "clash") for i in range(150)]
TEXTS += [(200, None, None), (201, "", None), (202, "the " * 30_000, None), (None, "beta " * 25, None), (203, "one\x00two" * 12, None)]
TARGET = [(0, "the Straße x1 " * 9, None), (1, None, None)]


@pytest.mark.parametrize(("docs", "target"), [([], TARGET), (TEXTS, []), (TEXTS, TARGET), (TEXTS[:3], TARGET)])
def test_resample(spark, docs, target):
    got = resample.resample(spark.createDataFrame(docs, DOCS), spark.createDataFrame(target, DOCS))
    assert got.columns == ["key", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == plain_resample(docs, target)


def test_ranks_of_rows_that_repeat(spark):
    """Equal ids and texts share a score; ranks are still 1 to the number drawn."""
    docs = [(i // 4, TEXTS[5][1] + " the" * 20, "") for i in range(200)]
    got = resample.resample(spark.createDataFrame(docs, DOCS), spark.createDataFrame(TARGET, DOCS)).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 51))
    assert min(r.score for r in got if r["rank"]) >= max(r.score for r in got if not r["rank"])


def test_reruns_agree_over_other_partitions(spark):
    a, b = (Counter(map(tuple, resample.resample(spark.createDataFrame(TEXTS, DOCS).repartition(n), spark.createDataFrame(TARGET, DOCS)).collect())) for n in (1, 5))
    assert a == b
