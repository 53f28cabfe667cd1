"""Document fingerprints against sets of paragraphs."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from saltmarsh.llm import doc_fingerprints as fp

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def parts(text):
    found = re.findall(fp.PARAGRAPH, text)
    return {x for x in (p.strip(" \t\r\x0b\x0c") for p in found) if x}


def alike(a, b):
    a, b = parts(a), parts(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
    out = []
    for i, (doc_id, text, *_) in enumerate(known):
        text, after = text or "", known[(i + 1) % len(known)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(alike(text, edited), 9), round(alike(text, after), 9)))
    for doc_id, text, *_ in rows:
        if doc_id is None:
            text = text or ""
            edited = text[: len(text) - len(text) // 4]
            out.append((None, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(alike(text, edited), 9), None))
    return sorted(out, key=repr)


def got(df):
    near = lambda x: None if x is None else round(x, 9)
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, near(r.near_edited), near(r.near_next)) for r in df.collect()), key=repr)


def some_texts(rng, n):
    def line():
        return "".join(rng.choice("abcde fghé漢。.!? ") for _ in range(rng.randrange(0, 300)))

    pool = [line() for _ in range(40)]
    texts = ["\n".join(rng.choice(pool) if rng.random() < 0.5 else line() for _ in range(rng.randrange(0, 60))) for _ in range(n)]
    return texts + [None, "", " \n\t\n", "x" * 9, "no ends " * 9000, "\n".join(str(i) * 9 for i in range(9000)), texts[0], texts[0]]


@pytest.mark.parametrize("seed", range(2))
def test_against_sets(spark, seed):
    rng = random.Random(seed)
    texts = some_texts(rng, 40)
    ids = rng.sample(range(-(10**12), 10**12), len(texts)) if seed else list(range(len(texts)))
    rows = [(i, t, None, None, None) for i, t in zip(ids, texts, strict=True)]
    rows += [rows[3], rows[3], (rows[3][0], "other text of the same id", None, None, None), (None, "a null id. " * 9, None, None, None), (None, None, None, None, None)]
    rng.shuffle(rows)
    assert got(fp.version_likeness(spark.createDataFrame(rows, DOCS).repartition(5))) == brute(rows)


def test_many_ranges_of_ids(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS", 1)
    monkeypatch.setattr(fp, "RANGES", 4)
    rng = random.Random(5)
    rows = [(i, f"text {i}. " + "same line\n" * (i % 3), None, None, None) for i in [*range(50), *rng.sample(range(10**6, 10**9), 50), 2**62, -(2**62)]]
    assert got(fp.version_likeness(spark.createDataFrame(rows, DOCS))) == brute(rows)


def test_no_rows_one_row_and_further_columns(spark):
    none = spark.createDataFrame([], DOCS)
    assert fp.version_likeness(none).count() == 0
    rows = [(7, "one line\nand another", None, None, None)]
    one = spark.createDataFrame(rows, DOCS)
    for name in ("a", "e", "b", "row", "bucket", "halo", "next", "pair", "first", "before", "fingerprint"):
        one = one.withColumn(name, F.lit("x"))
    assert got(fp.version_likeness(one)) == brute(rows)


def test_small_tables_are_retried(spark, monkeypatch):
    monkeypatch.setattr(fp, "LOAD", 40)  # too many digests for a block: the first retries fail
    rng = random.Random(9)
    rows = [(i, "\n".join(f"{rng.random()}" for _ in range(100)), None, None, None) for i in range(12)]
    tries = []
    inner = fp._retried
    monkeypatch.setattr(fp, "_retried", lambda left, again: tries.append(again) or inner(left, again))
    assert got(fp.version_likeness(spark.createDataFrame(rows, DOCS))) == brute(rows)
    assert len(tries) > 1


def test_compare_by_fingerprints_alone(spark):
    base = [f"paragraph number {i}" for i in range(200)]
    texts = {k: "\n".join(base[:150] + [f"new {i}" for i in range(k)]) for k in (0, 1, 4, 90)}
    df = spark.createDataFrame([(k, texts[0], t) for k, t in texts.items()], "k int, a string, b string")
    rows = {r.k: (r.same, r.a == r.b) for r in df.select("k", fp.fingerprint(F.col("a")).alias("a"), fp.fingerprint(F.col("b")).alias("b")).select("k", "a", "b", fp.compare(F.col("a"), F.col("b")).alias("same")).collect()}
    assert rows[0] == (1.0, True)
    assert rows[1][0] == pytest.approx(150 / 151) and rows[4][0] == pytest.approx(150 / 154) and not rows[4][1]
    assert rows[90][0] is None  # larger tables are needed
    assert len({len(x) for (x,) in df.select(fp.fingerprint(F.col("b"))).collect()}) == 1  # of one size, whatever the text's
