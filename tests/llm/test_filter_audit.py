"""The filter audit against counting every order row by row."""

import random
import re
from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from saltmarsh.llm.filter_audit import audit_filters, audit_orders, corpus_rules, failure_cells, orders, path_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def fails(rows):
    """The letters that each row fails, from its text alone and from the ids of equal texts."""
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        words = [w for w in re.split("[ \t-\r]+", text) if w]
        found = "A" if len(words) < 200 else ""
        found += "B" if 100 * len(set(words)) < 50 * len(words) else ""
        found += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else ""
        found += "D" if set(text) & set("#$%&*|") else ""
        if doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, *_ in rows):
            found += "E"
        out.append(found)
    return out


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    out, failed = {}, fails(rows)
    for part in {r[3] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, failed, strict=True) if (r[3] or "") == part]
        removals = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(d, f) for d, f in left if letter in f]
                left = [(d, f) for d, f in left if letter not in f]
                removals[letter] += len(gone)
                redundant = sum(letter in f for _, f in own) - len(gone)
                unique = sum(f == letter for _, f in own)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, unique, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), letter]
        for (p, _, _), row in out.items():
            if p == part:
                row[-1] = removals.get(row[-1], row[-1])
    return out


def texts(rng):
    pool = [None, "", "  \t ", "a b", "word " * 250, " ".join(f"w{i}" for i in range(210)), "ABC DEF", "x | y", "É Ü " * 110, "w" * 300_000, "Aa " * 3 + "b " * 300]
    return [rng.choice(pool) for _ in range(60)]


@pytest.mark.parametrize("seed", range(2))
def test_against_every_order(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, i, None]), t, None, rng.choice(["a", "b", None, ""]), 0) for i, t in enumerate(texts(rng))]
    rows += rows[:5]  # ids that repeat
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)]
    got = audit_filters(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got} == brute(rows, labels)
    assert len(got) == 600 * len({r[3] or "" for r in rows})


def test_labels_that_repeat_count_once(spark):
    docs = spark.createDataFrame([(1, "short", "en", "s", 5)], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1)], LABELS)
    rows = [r for r in audit_filters(docs, labels).collect() if r.filter_order == "ABCDE" and r.step == 1]
    assert [(r.removed, r.good_lost, r.toxic_lost, r.unique_fails, r.shapley) for r in rows] == [(1, 1, 1, 1, 120)]


def test_empty_tables_and_further_columns(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit_filters(none, labels).count() == 0
    clash = spark.createDataFrame([(1, "a b", "en", "s", 3)], DOCS)
    for name in ("part", "mask", "good", "toxic", "n", "salt", "digest", "_text", "_n_words"):
        clash = clash.withColumn(name, F.lit("x"))
    assert audit_filters(clash, labels).count() == 600


def test_paths_are_factorials_and_follow_constraints():
    forward, backward = path_counts(5)
    assert all(forward[s] == factorial(s.bit_count()) and backward[s] == factorial(5 - s.bit_count()) for s in range(32))
    before = ((0, 2), (1, 2))  # the third filter comes behind the first two
    forward, backward = path_counts(4, before)
    found = orders("ABCD", (("A", "C"), ("B", "C")))
    assert forward[15] == backward[0] == len(found) == 8
    for s in range(16):
        members = {x for i, x in enumerate("ABCD") if s >> i & 1}
        assert forward[s] * backward[s] == sum(set(o[: len(members)]) == members for o in found)


def test_constrained_orders_of_three(spark):
    cells = spark.createDataFrame([("p", 3, 5, 1, 0), ("p", 6, 2, 0, 2), ("p", 0, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in audit_orders(cells, "XYZ", (("Y", "X"),)).collect()}
    assert got["YXZ", 1] == (1, 7, 7 + 7 + 5)  # Y before X: YXZ, YZX remove 7 with Y, ZYX 5
    assert {o for o, _ in got} == {"YXZ", "YZX", "ZYX"}
    with pytest.raises(ValueError, match="filters"):
        audit_orders(cells, "XX")


def test_cells_without_a_copies_filter(spark):
    docs = spark.createDataFrame([(i, "a b", "en", "s", 3) for i in range(4)], DOCS)
    labels = spark.createDataFrame([(0, 1, 1)], LABELS)
    assert [tuple(r) for r in failure_cells(docs, labels, corpus_rules()).collect()] == [("s", 1, 4, 1, 1)]
