"""The operators on pairs against brute force, and their edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest

from saltmarsh.llm import _text as X
from saltmarsh.llm import embedding_dedup as E
from saltmarsh.llm import ngram_join as N
from saltmarsh.llm import substring_dedup as S
from saltmarsh.llm._graph import components
from saltmarsh.llm._store import stored
from saltmarsh.llm.decontamination import find_contained, remove_contaminated

DOC = "doc_id long, text string"


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)} if w else set()


def classes(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def varied(seed, groups=25, long=120):
    """Texts in groups of copies with more and more changes, a passage that all share, and odd ones."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = r.choices(vocabulary, k=40)
    texts = []
    for _ in range(groups):
        base = r.choices(vocabulary, k=r.randint(1, long))
        for _ in range(r.randint(1, 6)):
            copy = [r.choice(vocabulary) if r.random() < r.choice([0, 0.01, 0.03, 0.05]) else w for w in base]
            texts.append(" ".join(copy + (common if r.random() < 0.3 else [])))
    return [*texts, None, "", "  \n ", "one", "One", "one two", texts[0].upper()]


def test_words_of_pieces_and_batches(monkeypatch):
    texts = ["A b\tC\x0bd", None, "", " é  É ", "x" * 50, "a b " * 3000]
    whole = {}
    for piece in (1 << 20, 64):
        monkeypatch.setattr(X, "PIECE", piece)
        got = []
        for w in X.words_of(pa.array(texts)):
            got += [w.hashes[a:b].tolist() for a, b in zip(w.bounds, w.bounds[1:], strict=False)]
        assert [len(g) for g in got] == [len(words(t)) for t in texts]
        for t, g in zip(texts, got, strict=True):
            for word, h in zip(words(t), g, strict=True):
                assert whole.setdefault(word, h) == h
    assert len(set(whole.values())) == len(whole)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("k", "percent", "blocks"), [(4, 85, 256), (5, 80, 3)])
def test_ngram_classes(spark, monkeypatch, k, percent, blocks):
    monkeypatch.setattr(N, "BLOCK_NODES", blocks)
    texts = varied(k)
    sets = [shingles(t, k) for t in texts]
    links = [
        (i, j)
        for i in range(len(texts))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    want = classes(range(len(texts)), links)
    df = spark.createDataFrame(list(enumerate(texts)), DOC).selectExpr("*", "1 AS node", "2 AS component_id").repartition(3)
    got = {r.doc_id: r for r in N.ngram_classes(df, k=k, percent=percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}


def test_ngram_ties_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None)], DOC)
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in N.ngram_classes(df).collect())
    assert got == [(0, 0), (0, 5), (5, 5), (5, 5)]
    assert N.ngram_classes(df.limit(0)).count() == 0
    assert N.keep_one(df).count() == 4  # rows of the class's own id, and null ids, stay


def test_signatures_meet():
    """Any two sets that are similar enough share a signature in the larger one's class."""
    r = np.random.default_rng(1)
    for percent in (80, 85):
        c = N.Classes(percent)
        for _ in range(300):
            n = int(r.integers(6, 400))
            a = X.distinct(r.integers(0, 2**64, n, dtype=np.uint64))
            most = int((100 - percent) * len(a) / 100)
            drop, add = r.integers(0, most + 1), r.integers(0, most + 1)
            b = X.distinct(np.concatenate([r.permutation(a)[drop:], r.integers(0, 2**64, add, dtype=np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)) or (len(a) == len(b) and (a == b).all()):
                continue
            k = max(c.of(len(a)), c.of(len(b)))
            assert min(c.of(len(a)), c.of(len(b))) >= k - 1
            m, spare = c.ranges(k)
            assert set(N.signatures(a, k, m, spare).tolist()) & set(N.signatures(b, k, m, spare).tolist())


def test_sketches_rule_out_no_link():
    r = np.random.default_rng(5)
    for size in (2, 9, 300, 5_000, 60_000):
        for changed in (0.0, 0.05, 0.1, 0.3, 1.0):
            a = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
            b = np.unique(np.concatenate([a[int(changed * len(a)) :], r.integers(0, 1 << 63, int(changed * len(a)), dtype=np.uint64)]))
            common, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            may = bool(N.may_link([N.sketch(a)], np.array([len(a)]), [N.sketch(b)], np.array([len(b)]), 80)[0])
            assert may or 100 * common < 80 * union
            index = N.SketchIndex([N.sketch(b[:1]), N.sketch(b), N.sketch(b)], np.array([1, len(b), len(b)]), 80)
            assert (1 in index.candidates(N.sketch(a), len(a), np.array([True, True, False]))) == may
            if size >= 300 and changed == 1.0:
                assert not may


def test_prefix_tree():
    r = np.random.default_rng(2)
    universe = np.sort(r.integers(0, 2**64, 600, dtype=np.uint64))
    sets = [np.sort(r.choice(universe, int(r.integers(1, 500)), replace=False)) for _ in range(60)]
    sets += [s[: len(s) * 9 // 10] for s in sets[:20] if len(s) > 10] + [sets[0]]
    tree = N.PrefixTree(sets)
    for percent in (50, 80):
        pairs = set()
        for j, probe in enumerate(sets):
            want = {(i, len(np.intersect1d(s, probe))) for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= percent * len(np.union1d(s, probe))}
            assert set(tree.overlaps(probe, percent)) == want
            pairs |= {(j, i) for i, _ in want}
        assert set(tree.overlaps_many(sets, percent)) == pairs == set(tree.overlaps_many(sets, percent, cells=2000))


def test_contained(spark):
    texts, r = varied(9), random.Random(1)
    items = [" ".join(words(t)[3:20][i].decode() for i in range(len(words(t)[3:20]))) for t in texts[:20] if len(words(t)) > 24]
    items += ["one two", "", None, "w1", "nowhere to be found in any text"]
    items.append(" ".join(x if r.random() < 0.95 else "zz" for x in items[0].split()))

    def runs(text, k):
        w = words(text)
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = set()
    for i, item in enumerate(items):
        k = min(5, len(words(item)))
        s = runs(item, k) if k else set()
        want |= {(d, i, len(s & runs(t, k))) for d, t in enumerate(texts) if s and 100 * len(s & runs(t, k)) >= 80 * len(s)}
    docs = spark.createDataFrame(list(enumerate(texts)), DOC).repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for block in (2_000_000, 40):
        got = find_contained(docs, bench, block=block).collect()
        assert {(r.doc_id, r.item_id, r.n_found) for r in got} == want and len(got) == len(want)
    assert remove_contaminated(docs, bench).count() == len(texts) - len({d for d, _, _ in want})
    assert find_contained(docs.limit(0), bench).count() == find_contained(docs, bench.limit(0)).count() == 0


def test_embeddings(spark):
    r = np.random.default_rng(4)
    rows = []
    for g in range(40):
        base = r.normal(size=64)
        for _ in range(int(r.integers(1, 8))):
            v = base + r.normal(size=64) * r.choice([0, 0.05, 0.12, 0.15])
            rows.append((v.astype(np.float32).tolist(), int(g % 3) if r.random() > 0.1 else None))
    base = r.normal(size=64)
    rows += [((base + r.normal(size=64) * 0.13).astype(np.float32).tolist(), 1) for _ in range(60)]
    rows += [(base.astype(np.float32).tolist(), 1)] * 10 + [((2 * base).astype(np.float32).tolist(), 1)]
    rows += [(None, 1), ([0.0] * 64, 1), ([float("nan")] * 64, 1), ([float("inf")] + [1.0] * 63, 1), ([], 1), ([None, 1.0], 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1)]
    good = [i for i, (v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for i in good:
        for j in good:
            if j < i and rows[i][1] == rows[j][1] and len(rows[i][0]) == len(rows[j][0]):
                a, b = np.array(rows[i][0]), np.array(rows[j][0])
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98:
                    links.append((i, j))
    counts = dict.fromkeys(range(len(rows)), 0)
    for i, j in links:
        counts[i] += 1
        counts[j] += 1
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node").repartition(4)
    for block in (2048, 16):
        got = {x.vec_id: x for x in E.embedding_links(df, block=block).collect()}
        found = sum(x.n_links for x in got.values())
        assert found >= 0.99 * sum(counts.values()) and all(got[i].n_links <= counts[i] for i in counts)
        if found == sum(counts.values()):
            assert {i: x.component_id for i, x in got.items()} == classes(range(len(rows)), links)
        assert all(x.kept == (x.vec_id == x.component_id) for x in got.values())
    assert E.embedding_links(df.limit(0)).count() == 0


def test_nearest_lattice_points():
    """Decoded points are in E8 and no neighbour is nearer."""
    x = np.random.default_rng(0).normal(size=(500, 8)) * 3
    p = E.nearest_e8(x)
    twice = 2 * p
    assert (twice == np.rint(twice)).all() and ((p.sum(axis=1) % 2) == 0).all() and ((twice % 2 == 0).all(axis=1) | (twice % 2 != 0).all(axis=1)).all()
    assert len(E.NEIGHBOURS) == 240 and ((E.NEIGHBOURS**2).sum(axis=1) == 2).all()
    near = ((x - p) ** 2).sum(axis=1)
    assert (((x[:, None] - p[:, None] - E.NEIGHBOURS) ** 2).sum(axis=2) >= near[:, None] - 1e-12).all()


def quadratic_chains(pos, spos, k, gap):
    """The best score that ends in each match."""
    best = []
    for j in range(len(pos)):
        before = [best[i] - gap * (pos[j] - pos[i] + spos[j] - spos[i]) for i in range(j) if pos[i] < pos[j] and spos[i] < spos[j]]
        best.append(k + max([0.0, *before]))
    return best


def test_chains_against_all_pairs():
    r = np.random.default_rng(3)
    for _ in range(60):
        n = int(r.integers(1, 60))
        at = sorted({(int(a), int(b)) for a, b in zip(r.integers(0, 150, n), r.integers(0, 150, n), strict=True)})
        pos, spos = (np.array(x) for x in zip(*at, strict=True))
        got = list(S.chains(pos, spos, 5, 0.1, 10**6))
        assert sorted(i for c in got for i in c.tolist()) == list(range(len(pos)))
        for c in got:
            assert (np.diff(pos[c]) > 0).all() and (np.diff(spos[c]) > 0).all()
        score = max(5 * len(c) - 0.1 * (pos[c[-1]] - pos[c[0]] + spos[c[-1]] - spos[c[0]]) for c in got)
        best = max(quadratic_chains(pos, spos, 5, 0.1))
        if not ((np.diff(pos) > 0).all() and (np.diff(spos) > 0).all()):
            assert score == pytest.approx(best)


def test_passages_against_all_runs(spark):
    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    passages = [r.choices(vocabulary, k=r.randint(55, 90)) for _ in range(4)]
    texts = []
    for i in range(40):
        parts = [r.choices(vocabulary, k=r.randint(5, 80))]
        for p in passages:
            if r.random() < 0.4:
                parts += [p, r.choices(vocabulary, k=r.randint(5, 60))]
        texts.append(" ".join(w for p in parts for w in p) if i % 9 else None)
    texts += [texts[1], texts[2] + " tail", "", "same same " * 60, "same same " * 60]
    df = spark.createDataFrame(list(enumerate(texts)), DOC).repartition(4)
    found = S.repeated_passages(df).collect()
    covered = {}
    for f in found:
        assert f.src_id < f.doc_id
        a, b = words(texts[f.doc_id])[f.start_word : f.end_word], words(texts[f.src_id])[f.src_start : f.src_end]
        assert len(a) >= 50 and 100 * f.n_same >= 80 * max(len(a), len(b)) and f.n_same <= min(len(a), len(b))
        covered.setdefault(f.doc_id, set()).update(range(f.start_word, f.end_word))
    seen = {}
    for d, t in enumerate(texts):
        w = words(t)
        need = {j for i in range(len(w) - 49) if seen.get(tuple(w[i : i + 50]), d) != d for j in range(i, i + 50)}
        assert need <= covered.get(d, set())
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), d)
        assert len(covered.get(d, set()) - need) <= 30
    left = {x.doc_id: x.text for x in S.cut_passages(df, spark.createDataFrame(found)).collect()}
    assert 40 not in left and left[43] == texts[43] and left[0] is None
    for d, t in left.items():
        assert words(t) == [w for i, w in enumerate(words(texts[d])) if i not in covered.get(d, set())]
    assert S.repeated_passages(df.limit(0)).count() == 0


def test_fuzzy_passage(spark):
    r = random.Random(5)
    p = [f"p{i}" for i in range(80)]
    changed = [w for i, w in enumerate(p) if i != 40]
    changed[20] = "other"
    df = spark.createDataFrame([(1, " ".join(p)), (2, " ".join([f"x{r.random()}"] * 3 + changed))], DOC)
    (f,) = S.repeated_passages(df).collect()
    assert (f.doc_id, f.src_id, f.start_word, f.end_word, f.src_start, f.src_end, f.n_same) == (2, 1, 3, 82, 0, 80, 78)


@pytest.mark.parametrize("parts", [1, 3, 101])
@pytest.mark.parametrize("batch", ["2", "10000"])
def test_exact_passage_behind_a_quote(spark, parts, batch):
    p, odd = [f"p{i}" for i in range(60)], lambda d, n: [f"d{d}x{i}" for i in range(n)]
    texts = {1: [*odd(1, 20), *p, *odd(-1, 20)], 100: [*odd(100, 20), *p[:36], *odd(-100, 20)], 101: [*odd(101, 20), *p, *odd(-101, 20)]}
    df = spark.createDataFrame([(d, " ".join(texts.get(d, odd(d, 30)))) for d in range(1, 102)], DOC).repartitionByRange(parts, "doc_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = S.repeated_passages(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {j for f in found if f.doc_id == 101 for j in range(f.start_word, f.end_word)} == set(range(20, 80))


def test_parts_of_a_chain(spark):
    w, z = [f"w{i}" for i in range(140)], [f"z{i}" for i in range(140)]
    for kept in ([(0, 60), (85, 101)], [(0, 55), (85, 140)]):
        n = kept[-1][1]
        b = [w[i] if any(x <= i < y for x, y in kept) else z[i] for i in range(n)]
        found = S.repeated_passages(spark.createDataFrame([(1, " ".join(w[:n])), (2, " ".join(b))], DOC)).collect()
        long = {j for x, y in kept if y - x >= 50 for j in range(x, y)}
        assert long <= {j for f in found for j in range(f.start_word, f.end_word)}
        assert all(100 * f.n_same >= 80 * max(f.end_word - f.start_word, f.src_end - f.src_start) for f in found)


def test_chains_in_order_are_scored_too():
    pos = np.array([0, 1, 2, 90, 91, 200])
    got = list(S.chains(pos, pos + 7, 5, 0.1, 10**6))
    score = max(5 * len(c) - 0.1 * 2 * (pos[c[-1]] - pos[c[0]]) for c in got)
    assert score == pytest.approx(max(quadratic_chains(pos, pos + 7, 5, 0.1)))


def test_passage_three_times_in_one_document(spark):
    p = [f"p{i}" for i in range(60)]
    odd = lambda d: [f"{d}x{i}" for i in range(30)]
    b = [*odd("a"), *p, *odd("b"), *p, *odd("c"), *p, *odd("d")]
    found = S.repeated_passages(spark.createDataFrame([(1, " ".join([*odd("e"), *p])), (2, " ".join(b))], DOC)).collect()
    assert {j for f in found for j in range(f.start_word, f.end_word)} == {i for i, x in enumerate(b) if x[0] == "p"}


def test_recall_of_changed_passages(spark):
    rows, n = [], 40
    for step in (6, 8, 10, 12):
        for i in range(n):
            at = 1000 * step + 2 * i
            p = [f"s{at}w{j}" for j in range(60 + i)]
            changed = [f"c{at}w{j}" if j % step == step - 1 else x for j, x in enumerate(p)]
            odd = [[f"o{at + e}w{j}" for j in range(20)] for e in (0, 1)]
            rows += [(at, " ".join(odd[0] + p)), (at + 1, " ".join(odd[1] + changed))]
    found = {f.doc_id for f in S.repeated_passages(spark.createDataFrame(rows, DOC)).collect()}
    for step in (6, 8, 10, 12):
        assert sum(1000 * step + 2 * i + 1 in found for i in range(n)) == n


def test_passage_whose_seeds_are_quoted_elsewhere(spark):
    """The changed copy's seeds come first and last in documents that merely quote its runs of seven words, each apart."""
    p = [f"p{i}" for i in range(88)]
    changed = [f"c{i}" if i % 8 == 7 else x for i, x in enumerate(p)]
    odd = lambda d, n: [f"d{d}x{i}" for i in range(n)]
    runs = [p[i : i + 7] for i in range(0, 88, 8)]
    quotes = [[w for i, q in enumerate(random.Random(d).sample(runs, len(runs))) for w in [*q, *odd(f"{d}q{i}", 60)]] for d in (0, 2)]
    texts = [[*quotes[0]], [*odd(1, 60), *p], [*quotes[1]], [*odd(3, 60), *changed]]
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], DOC)
    (f,) = S.repeated_passages(df).collect()
    assert (f.doc_id, f.src_id, f.start_word, f.end_word, f.src_start, f.src_end, f.n_same) == (3, 1, 60, 147, 60, 147, 77)


def test_tables_of_pairs_do_not_grow_with_their_number(spark, monkeypatch):
    """Texts whose stretches meet those of most others: words are held once for each, the rest is worked out in passes, which give the same."""
    r, tables, keep = random.Random(4), [], S.stored
    lines = [[f"l{i}w{j}" for j in range(r.randint(24, 44))] for i in range(4)]
    texts = []
    for d in range(60):
        text = [f"d{d}a"]
        for i in r.sample(range(4), 4):
            line = list(lines[i])
            line[r.randrange(len(line))] = f"d{d}c{i}"
            text += [*line, *(f"d{d}n{i}g{j}" for j in range(r.choice([0, 1, 3, 8, 30])))]
        texts.append((d, " ".join(text)))
    df = spark.createDataFrame(texts, DOC).repartition(4)

    def counted(docs, name, *more):
        out = keep(docs, name, *more)
        tables.append((name, out.count()))
        return out

    monkeypatch.setattr(S, "stored", counted)
    found = sorted(S.repeated_passages(df).collect())
    rows = lambda name: [n for x, n in tables if x == name]
    assert len(rows("matches")) == 2 and rows("words")[-1] <= len(texts) < sum(rows("pairs"))
    tables.clear()
    monkeypatch.setattr(S, "LEAST_BYTES", 1 << 20)
    assert sorted(S.repeated_passages(df).collect()) == found
    assert len(rows("more")) > 1 and len(rows("meetings")) > 1


@pytest.mark.parametrize("holders", [1, 3, 20])
def test_passages_whose_seeds_have_many_holders(spark, holders):
    """Texts of common lines with changed words and other words between them, against all pairs."""
    r = random.Random(holders)
    lines = [[f"l{i}w{j}" for j in range(r.randint(24, 44))] for i in range(4 if holders == 20 else 12)]
    texts, n = [], 0
    for d in range(max(12, 3 * holders)):
        text = [f"d{d}a"]
        for i in r.sample(range(len(lines)), min(6, len(lines))):
            line = list(lines[i])
            if r.random() < 0.5:
                line[r.randrange(len(line))] = f"d{d}c{i}"
            n += 1
            text += [*line, *(f"d{d}n{n}g{j}" for j in range(r.choice([0, 1, 3, 8, 30])))]
        texts.append(text)
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], DOC).repartition(4)
    covered = {}
    for f in S.repeated_passages(df).collect():
        covered.setdefault(f.doc_id, set()).update(range(f.start_word, f.end_word))
    ids = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    coded = [np.array([ids[w] for w in t], np.uint32) for t in texts]
    lost = total = 0
    for d, a in enumerate(coded):
        for b in coded[:d]:
            for x, x2, y, y2, _ in S._compared(a, b, 5, 50, 80):
                total += 1
                both = {tuple(b[j : j + 5]) for j in range(y, y2 - 4)}
                seeds = [j for j in range(x, x2 - 4) if tuple(a[j : j + 5]) in both]
                lost += not all(set(range(j, j + 5)) <= covered.get(d, set()) for j in seeds)
    assert total and not lost


def test_buckets_go_by_the_size_of_texts(spark, monkeypatch):
    """One partition of 3 GB of text has as many buckets as many partitions; a bucket of ordinary size is unpacked once."""
    docs = spark.range(0, 100, 1, 1).selectExpr("id AS doc_id", "repeat('some word ', 3000000) AS text")
    assert S._bits(docs, "text") == S._bits(docs.repartition(40), "text") == 8
    assert S._bits(docs.limit(0), "text") == 6
    times = []
    monkeypatch.setattr(S, "unpack", lambda *a: times.append(1) or X.unpack(*a))
    h = np.arange(3 << 19, dtype=np.int64)
    packed = [(X.pack([h, h // 7, h % 7], 1), len(h))]
    assert [len(x[0]) for x in S._split(packed)] == [len(h)] and len(times) == 1
    monkeypatch.setattr(S, "SPLIT_ROWS", 1 << 19)
    assert sum(len(x[0]) for x in S._split([(X.pack([h << 15, h, h % 7], 1), len(h))])) == len(h)


def test_a_bucket_is_unpacked_once_and_worked_out_in_parts(monkeypatch):
    """No part has more than a small share of the rows, all parts together have all of them."""
    r = np.random.default_rng(4)
    columns = [[r.integers(0, 1 << S.PART_BITS, 5000), np.sort(r.integers(0, 10**12, 5000)), r.integers(0, 9000, 5000)] for _ in range(40)]
    packed = [(X.pack(c, 1), 5000) for c in columns]
    monkeypatch.setattr(S, "SPLIT_ROWS", 1 << 15)
    monkeypatch.setattr(S, "PART_ROWS", 1 << 14)
    for held, times in ((16, 1), (4, 4), (3, 6)):
        monkeypatch.setattr(S, "PARTS_HELD", held)
        calls = []
        monkeypatch.setattr(S, "unpack", lambda *a: calls.append(1) or X.unpack(*a))  # noqa: B023
        parts = list(S._split(packed))
        assert len(parts) >= 16 and len(calls) == times * len(packed) and max(len(x[0]) for x in parts) < 20000
        assert sorted(zip(*(np.concatenate(x).tolist() for x in zip(*parts, strict=True)), strict=True)) == sorted(zip(*(np.concatenate(x).tolist() for x in zip(*columns, strict=True)), strict=True))


def test_matches_are_dealt_finer_than_hashes():
    """A bucket of matches is chained at once, so it has a small share of the documents."""
    doc = np.arange(1 << 16)
    assert max(S._by_doc([doc, doc, doc, doc], 6).column(2).to_pylist()) < len(doc) / 128
    assert max(S._by_doc([doc, doc, doc, doc], 16).column(0).to_pylist()) < 1 << 16


def test_python_gets_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    wide = spark.range(0, 400, 1, 1).selectExpr("repeat('x', 50000) AS text").mapInArrow(sizes, "n long")
    assert max(r.n for r in stored(wide, "sizes", 1 << 20).collect()) < 1 << 21
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_dense_matches_are_chained_without_the_tree(monkeypatch):
    """In texts of repeated lines; the chains are those of the tree."""
    r = np.random.default_rng(5)
    for _ in range(20):
        at = sorted({(int(a), int(b)) for a, b in zip(r.integers(0, 40, 600), r.integers(0, 150, 600), strict=True)})
        pos, spos = (np.array(x) for x in zip(*at, strict=True))
        monkeypatch.setattr(S, "DENSE", 10**9)
        tree = [c.tolist() for c in S.chains(pos, spos)]
        monkeypatch.undo()
        with monkeypatch.context() as m:
            m.setattr(S.PrefixMaxima, "add", None)
            assert [c.tolist() for c in S.chains(pos, spos)] == tree


def test_only_what_may_hold_an_open_seed_is_aligned(monkeypatch):
    """The same passages as of all seeds, and fewer chains aligned: not those beside words that the source lacks, nor short ones."""
    r = random.Random(6)
    lines = [[r.randrange(60) for _ in range(r.randint(6, 14))] for _ in range(12)]
    calls, align = [], S.align
    monkeypatch.setattr(S, "align", lambda *x: calls.append(1) or align(*x))
    most = [0, 0]
    for _ in range(12):
        a, b = ([w for _ in range(30) for w in [*r.choice(lines), *(r.randrange(100, 10**6) for _ in range(r.choice([0, 0, 1, 9])))]] for _ in range(2))
        a, b, seeds = np.array(a, np.uint32), np.array(b, np.uint32), np.array([40, 41, 42, 160])
        found = []
        for i, given in enumerate((None, seeds)):
            calls.clear()
            rows = S._compared(a, b, 5, 50, 80, given)
            found.append({j for x in rows if ((seeds >= x[0]) & (seeds + 5 <= x[1])).any() for j in range(x[0], x[1])})
            most[i] += len(calls)
        assert found[0] == found[1]
    assert most[1] < most[0]
