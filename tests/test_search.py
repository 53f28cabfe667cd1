"""Dense, lexical and hybrid search against plain loops."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import search

VECTORS = "vec_id long, embedding array<float>, route string"
QUERIES = "query_id long, text string, query_vector array<float>"


def cosine(a, b):
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def brute_nearest(vectors, queries, top, grouped):
    out = []
    for q, _, qv in queries:
        if q is None or not usable(qv):
            continue
        scored = [(g if grouped else None, round(cosine(qv, v), 6), i) for i, v, g in vectors if i is not None and i != q and usable(v) and len(v) == len(qv)]
        for group in {g for g, _, _ in scored}:
            best = sorted(((-s, i) for g, s, i in scored if g == group))[:top]
            out += [(q, *((group,) if grouped else ()), i, round(-s, 5), k) for k, (s, i) in enumerate(best, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("grouped", [False, True])
@pytest.mark.parametrize("block", [64, 1 << 20])
def test_nearest(spark, monkeypatch, grouped, block):
    monkeypatch.setattr(search, "BLOCK_BYTES", block)
    monkeypatch.setattr(search, "PRODUCT", 8)
    rng = random.Random(block)
    grid = lambda n: [float(rng.randrange(-2, 3)) for _ in range(n)]  # noqa: E731  many ties
    vectors = [(i, grid(4), rng.choice(["a", "b", None])) for i in range(120)]
    vectors += [(200, None, "a"), (201, [1.0, None, 0.0, 0.0], "a"), (202, [float("nan")] * 4, "a"), (203, [float("inf"), 0.0, 0.0, 0.0], "b"), (204, [1.0, 2.0], "a"), (205, [], "a"), (206, [0.0] * 4, "b"), (None, grid(4), "a")]
    queries = [(i, None, v) for i, v, _ in vectors if i is not None and i % 20 == 0] + [(501, None, [0.5, 0.5]), (502, None, None), (503, None, [0.0] * 4), (None, None, grid(4)), (504, None, [])]
    df = search.nearest(spark.createDataFrame(vectors, VECTORS).repartition(3), spark.createDataFrame(queries, QUERIES), 3, "route" if grouped else None)
    got = sorted(((r.query_id, *((r.route,) if grouped else ()), r.vec_id, round(r.score, 5), r["rank"]) for r in df.collect()), key=repr)
    assert got == brute_nearest(vectors, queries, 3, grouped)


def test_nearest_without_queries(spark):
    none = spark.createDataFrame([], QUERIES)
    assert search.nearest(spark.createDataFrame([(1, [1.0], "a")], VECTORS), none).count() == 0
    assert search.nearest(spark.createDataFrame([], VECTORS), spark.createDataFrame([(1, "", [1.0])], QUERIES)).count() == 0


def brute_bm25(docs, queries, top):
    split = lambda t: [w for w in (t or "").lower().split() if w]
    held = [(d, Counter(split(t))) for d, t in docs]
    df = Counter(w for _, c in held for w in c)
    n, mean = len(docs), sum(sum(c.values()) for _, c in held) / len(docs)
    raw = {w: math.log((n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    out = []
    for q, text, _ in queries:
        asked = Counter(split(text))
        scored = []
        for d, c in held:
            if d is None or not set(c) & set(asked):
                continue
            size = sum(c.values()) / mean
            s = sum(t * (raw[w] if raw[w] >= 0 else floor) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * size)) for w, t in asked.items() if w in c)
            scored.append((-round(s, 6), d))
        out += [(q, d, round(-s, 4), k) for k, (s, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_bm25_prunes_without_loss(spark, monkeypatch, seed):
    monkeypatch.setattr(search, "SEED_DOCS", 30)
    monkeypatch.setattr(search, "BLOCK_TERMS", [40, 1000, 7][seed])
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(["the", "a", *words], [40, 30, *(60 // (i + 1) + 1 for i in range(60))], k=n))
    docs = [(i, text(rng.randrange(0, 40))) for i in range(200)] + [(300, None), (301, ""), (302, " \t\n"), (None, "W1 W2"), (303, "w1 " * 5000)]
    queries = [(i, text(rng.randrange(1, 12)), None) for i in range(15)] + [(90, "", None), (91, None, None), (92, "unseen words", None), (93, "the the a", None)]
    df = search.bm25(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(queries, QUERIES), 4)
    assert sorted((r.query_id, r.doc_id, round(r.score, 4), r["rank"]) for r in df.collect()) == brute_bm25(docs, queries, 4)


def test_common_terms_pair_nothing(spark):
    """A document that holds only a common term of a query is never scored, where rare terms bring enough."""
    docs = [(i, "common " * 3 + ("rare" if i < 10 else f"other{i}")) for i in range(500)]
    queries = spark.createDataFrame([(1, "rare common", None)], QUERIES)
    rows = search.bm25(spark.createDataFrame(docs, "doc_id long, text string"), queries, 5).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r["rank"])] == [0, 1, 2, 3, 4]


def test_hybrid(spark):
    docs = [(1, "red fox"), (2, "red fox"), (3, "blue whale"), (4, "green"), (5, None)]
    vectors = [(1, [1.0, 0.0], ""), (3, [0.0, 1.0], ""), (4, [0.9, 0.1], ""), (9, [1.0, 0.0], "")]
    queries = [(50, "red fox jumps", [1.0, 0.0]), (51, "nothing fits", None), (52, "Blue", [0.0, 1.0])]
    run = lambda threshold: {r.query_id: (r.context, list(r.doc_ids), r.n) for r in search.hybrid_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(vectors, VECTORS), spark.createDataFrame(queries, QUERIES), threshold=threshold).collect()}
    got = run(0.5)
    assert got[50] == ("red fox", [1], 1) and got[51] == ("", [], 0) and got[52] == ("blue whale", [3], 1)
    assert run(0.0)[50] == ("red fox\n\n---\n\nblue whale\n\n---\n\ngreen", [1, 3, 4], 3)
    assert run(2.0)[50] == ("", [], 0)


def test_coverage(spark):
    rows = [("a B c", "b C d"), ("", "a"), (None, None), ("a a", "A")]
    got = spark.createDataFrame(rows, "q string, t string").select(search.coverage(F.col("q"), F.col("t"))).collect()
    assert [r[0] for r in got] == [0.666667, 0.0, 0.0, 1.0]
