"""Sharding, mixing, line dedup and quality rules against brute force on small fixtures."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rayloom.llm import lines, mixing, quality, sharding

DOCS = "doc_id long, text string, source string, mix string"
rnd = random.Random(1)
ROWS = [(i, " ".join(rnd.choice(["alpha", "beta", "the", "of", "x#", "z"]) for _ in range(rnd.randrange(0, 40))), rnd.choice(["a", "b", "é", None]), "clash") for i in range(200)]
ROWS += [(None, "nameless words here", "a", "clash"), (7, ROWS[7][1], ROWS[7][2], "clash"), (300, None, "b", None), (301, "", None, None), (302, "word " * 30_000, "a", None)]
EDGES = [[], ROWS[:1], ROWS]


@pytest.mark.parametrize("rows", EDGES)
def test_sharding(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    out = sharding.external_shuffle(df, shards=6, bucket_rows=20)
    got = out.collect()
    assert out.columns == [*df.columns, "shard", "slot"]
    assert Counter(tuple(r)[:4] for r in got) == Counter(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    if rows:
        counts = [len(by[k]) for k in range(6)]
        assert max(counts) - min(counts) <= 1


def test_sharding_reruns_and_digests(spark, tmp_path):
    df = spark.createDataFrame(ROWS, DOCS).repartition(3)
    # files that are split otherwise make no difference
    a, b = (sorted(map(tuple, sharding.external_shuffle(x, shards=5, bucket_rows=30).collect()), key=str) for x in (df, df.repartition(7, "text")))
    assert a == b
    for r in sharding.shard_documents(df, shards=5).collect():
        text = next(t for i, t, *_ in ROWS if i == r.doc_id) or ""
        assert (r.size, r.text_crc32) == (len(text.encode()) + 16, zlib.crc32(text.encode()))


def test_many_buckets_in_one_task(spark, monkeypatch):
    """More arrays than Spark gathers at once, so that it goes on by sorting."""
    monkeypatch.setattr(sharding, "MOST_TASKS", 1)
    df = spark.createDataFrame([(k, "t" * (k % 9), "a", None) for k in range(3000)], DOCS)
    got = sharding.external_shuffle(df, shards=7, bucket_rows=10).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    for k in range(7):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert max(n := Counter(r.shard for r in got).values()) - min(n) <= 1


def test_written_shards_hold_the_records(spark, tmp_path):
    df = spark.createDataFrame(ROWS, DOCS).withColumn("slot", F.lit("clash"))
    out = sharding.write_shards(df, f"{tmp_path}/s", shards=4, bucket_bytes=2_000)
    assert out.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "shard", "slot"]
    assert Counter(tuple(r)[:4] for r in out.collect()) == Counter(ROWS)
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == [f"shard={k}" for k in range(4)]


def test_records_that_are_equal_in_all_columns_are_spread(spark):
    rows = [(1, "same", "a", None)] * 300 + ROWS[:100]
    df = spark.createDataFrame(rows, DOCS)
    got = sharding.external_shuffle(df, shards=3, bucket_rows=20).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(rows)
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got))) for k in range(3))
    assert min(sum(r.doc_id == 1 for r in got if r.shard == k) for k in range(3)) > 30


def fill(sizes, weights, cap):
    total, target, free = sum(sizes.values()), {}, set(sizes)
    while free:
        rest = total - sum(target.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        target |= {s: cap * sizes[s] for s in over}
        free -= over
    return target


@pytest.mark.parametrize("rows", EDGES)
def test_mixing(spark, rows):
    got = mixing.mix(spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit(1), "target": F.lit("t")}), "doc_id", "source", mixing.n_words(F.col("text"))).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source, _ in rows:
        sizes[source] += len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = fill(dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.mix.source_size == sizes[r.source] and r.mix.target == pytest.approx(target[r.source])
        assert 0 <= r.mix.taken <= 3 * r.mix.size
        taken[r.source] += r.mix.taken
        largest[r.source] = max(largest[r.source], r.mix.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * largest[s]


def test_mixing_near_targets(spark):
    rows = [(i, " ".join(["w"] * rnd.randrange(1, 60)), "abc"[min(i % 7, 2)]) for i in range(2000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "source", mixing.n_words(F.col("text"))).select("source", "mix.*").collect()
    for s in "abc":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) / mine[0].target - 1) < 0.02


def test_repeat_rows(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 3)], "a int, n int")
    assert sorted(r.a for r in mixing.repeat_rows(df, F.col("n")).collect()) == [2, 3, 3, 3]


def test_line_dedup(spark):
    rows = [(i, "h" if i < 60 else ("g" if i < 64 else None), f"menu\nown line {i}\n\n menu \n{'foot' if i % 2 else 'toes'} {i % 3 if i >= 60 else ''}", "x") for i in range(70)]
    rows += [(70, "h", None, "x"), (71, "h", "", "x"), (3, rows[3][1], rows[3][2], "x")]
    df = spark.createDataFrame(rows, "id long, host string, text string, n_lines string")
    got = lines.line_dedup(df, F.col("host"), ratio=0.1, min_pages=5).collect()
    pages, n = Counter(r[1] for r in rows), Counter()
    strip = lambda x: x.strip(" \t\r")
    for _, h, t, _ in rows:
        n.update({(h, strip(x)) for x in (t or "").split("\n") if strip(x)})
    expected = Counter()
    for i, h, t, c in rows:
        ls = None if t is None else t.split("\n")
        gone = [bool(strip(x)) and n[h, strip(x)] >= 5 and n[h, strip(x)] > 0.1 * pages[h] for x in ls or []]
        kept = None if t is None else "\n".join(x for x, g in zip(ls, gone, strict=True) if not g)
        expected[i, h, kept, c, sum(bool(strip(x)) for x in ls or []), sum(gone)] += 1
    assert Counter((r.id, r.host, r.text, r["n_lines"], r.line_dedup.n_lines, r.line_dedup.n_dropped) for r in got) == expected
    assert sum(k[-1] for k in expected) > 100
    assert lines.line_dedup(df.limit(0), F.col("host")).count() == 0


def test_html_lines(spark):
    html = "<html><head><style>p{}</style><script>a='</p>'\nb</script></head><body><nav><li>One <b>bold</b></li><li>Two</li></nav><!-- x -->\n<p>Text</p></body>"
    row = spark.createDataFrame([("http://U@Host.example:80/a?b", html), (None, None), ("none", "")], "url string, html string").select(lines.host_of(F.col("url")).alias("h"), lines.html_lines(F.col("html")).alias("t")).collect()
    assert [tuple(r) for r in row] == [("host.example", "One bold\nTwo\nText"), (None, None), (None, "")]


def brute_quality(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    base = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(covered), base


def test_quality(spark):
    texts = [r[1] for r in ROWS] + ["a b c d e f g\na b c d e f g\nü # *   |", "x " * 50, "\t\n\r\x0b\x0c ", "one two three four five " * 3 + "six"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for r in quality.quality_rules(df).collect():
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute_quality(texts[r.doc_id]), texts[r.doc_id][:80]
        assert not (q.kept and q.base_failed)
    assert quality.quality_rules(df.limit(0)).count() == 0
    assert quality.passing(df).count() == quality.quality_rules(df).where("quality.kept").count()


def test_quality_keeps_clean_and_drops_junk(spark):
    w = ["the", "of", "reader", "letter", "garden", "and", "window", "river", "to", "paper", "stone", "light", "evening", "number", "a"]
    clean = [" ".join(rnd.choice(w) for _ in range(n)) + "." for n in (80, 150, 400)]
    junk = ["### " * 40, "Word%%% other### thing&&& more*** " * 30, " ".join(f"SHOUT{i}!!" for i in range(100)), "too short"]
    got = {r.i: r.quality.kept for r in quality.quality_rules(spark.createDataFrame(list(enumerate(clean + junk)), "i int, text string")).collect()}
    assert [got[i] for i in range(len(got))] == [True] * 3 + [False] * 4
