"""JSON within texts: against loops over characters, and the cases that a reader of model output meets."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import extraction as X


def is_object(block):
    try:
        return isinstance(json.loads(block, parse_constant=lambda _: 1 / 0), dict)
    except (ValueError, ZeroDivisionError, RecursionError):
        return False


def loop_first(text):
    text = text or ""
    if not text:
        return None, X.EMPTY
    start = text.find("{")
    if start < 0:
        return None, X.NONE
    depth, inside, skip = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if skip or c == "\\":
            skip = not skip
        elif c == '"':
            inside = not inside
        elif not inside and c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                block = text[start : i + 1]
                return (block, None) if is_object(block) else (None, X.INVALID)
    return None, X.OPEN


def loop_blocks(text, floored):
    depth, start, out = 0, -1, []
    for i, c in enumerate(text or ""):
        if c == "{":
            if not depth:
                start = i
            depth += 1
        elif c == "}" and (depth > 0 or not floored):
            depth -= 1
            if not depth and start >= 0:
                out.append(text[start : i + 1])
                start = -1
    return out


def fences(text):
    return re.findall(X.FENCE, text or "")


def loop_any(text, fenced):
    return next((b for b in [*(fences(text) if fenced else []), *loop_blocks(text, False)] if is_object(b)), None)


def loop_keyed(text):
    found = [b for b in [*fences(text), *loop_blocks(text, True)] if is_object(b)]
    keyed = [b for b in found if "action" in json.loads(b)]
    return (keyed or found or [None])[-1]


CASES = [
    None,
    "",
    "no object",
    '{"a": 1}',
    'so: {"a": {"b": "}"}} and more }',
    'a "quoted {" word {"a": "x\\"}"} tail',
    '{"a": "\\\\"} {"action": 2}',
    "{never closed",
    '{"a": 1,}',
    '} {"a": 1}',
    '}} {"a": 1} {{"b": 2}',
    '```json\n{"action": "x", "n": {"m": 1}}\n``` {"b": 2}',
    '```\n{"b": 1}\n``` {"action": 1} {"c": 3}',
    "{margin:0} {\"a\": [1, {\"b\": null}]}",
    '{"a": "é漢🙂"} x',
    '{"a": "line\nbreak"}',
    '{"a": 1} {"a"',
    "\\{\"a\": 1}",
    '{\\"a\\": 1}',
    "[1, 2]",
    "{}",
    '{"a": "' + "b{" * 50_000 + '"}',
    "{" * 3000 + "}" * 3000,
    "ends with a backslash {\\",
    '"starts with a quote {"a": 1}',
]


def random_text(rng):
    return "".join(rng.choice(['{', '}', '"', "\\", "a", "1", ":", ",", ' ', '{"a": 1}', '{"action": 2}', "```json\n", "\n```", "é"]) for _ in range(rng.randrange(0, 25)))


@pytest.mark.parametrize("batch", [3, 10_000])
def test_against_loops(spark, batch):
    rng = random.Random(batch)
    texts = CASES + [random_text(rng) for _ in range(1500)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        t = F.col("t")
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
        rows = df.select("i", X.first_object(t).alias("f"), X.any_object(t).alias("a"), X.any_object(t, fences=True).alias("m"), X.keyed_object(t).alias("k")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.i]
        assert (tuple(r.f), r.a, r.m, r.k) == (loop_first(text), loop_any(text, False), loop_any(text, True), loop_keyed(text)), repr(text)[:200]


def test_values_are_variants(spark):
    df = spark.createDataFrame([('x {"action": "go", "n": [1, {"m": "deep"}]}',), ('{"a": 1, "a": 2}',), (None,)], "t string")
    got = df.select(X.value(X.keyed_object(F.col("t"))).alias("v")).select(F.try_variant_get("v", "$.action", "string"), F.try_variant_get("v", "$.n[1].m", "string")).collect()
    assert [tuple(r) for r in got] == [("go", "deep"), (None, None), (None, None)]


def test_explainable(spark):
    rows = [
        (1, 0, "assistant", '{"ranked": [1]}'),
        (1, 1, "assistant", 'see {"warnings": []}'),
        (1, 2, "assistant", '{"other": 1}'),
        (1, 3, "user", '{"explain": 1}'),
        (2, 0, "assistant", "prose"),
        (2, 1, "assistant", None),
        (3, 0, "assistant", '{"a": {"explain": 1}}'),
        (None, 0, "assistant", '{"internal": 1}'),
    ]
    got = X.explainable(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.conv_id: (r.turn, r.block) for r in got} == {1: (1, '{"warnings": []}'), None: (0, '{"internal": 1}')}


def test_empty_table(spark):
    none = spark.createDataFrame([], "t string")
    assert none.select(X.first_object(F.col("t")), X.any_object(F.col("t")), X.keyed_object(F.col("t"))).count() == 0


def test_texts_of_a_batch_are_scanned_in_slices(monkeypatch):
    """No more than a slice of a batch is scanned at once, and the blocks are those of each text alone."""
    import pyarrow as pa

    texts = [None, "", '{"a": "}\\\\"}', "x" * 70 + '{"b": 1}', "{", '{"c": {"d": 2}} }', "no", '{"e": 3} {"f": 4}'] * 40
    sizes = []
    made = X._Texts.__init__
    monkeypatch.setattr(X._Texts, "__init__", lambda self, column: made(self, column) or sizes.append(len(self.data)))
    for udf in (X._first_block, X._counted_blocks, X._floored_blocks):
        monkeypatch.setattr(X, "SLICE_BYTES", 1 << 22)
        whole = udf.func(pa.array(texts)).to_pylist()
        monkeypatch.setattr(X, "SLICE_BYTES", 100)
        sizes.clear()
        assert udf.func(pa.array(texts)).to_pylist() == whole and max(sizes) <= 100 and sum(sizes) == sum(len(t or "") for t in texts)
        assert udf.func(pa.array(texts).slice(3, 50)).to_pylist() == whole[3:53]
        assert udf.func(pa.array([], pa.string())).to_pylist() == []
    lists = pa.array([['{"a": 1}', "{"], [], ['{"b": 2}'], [None]] * 30)
    assert X._objects.func(lists).to_pylist() == [['{"a": 1}'], [], ['{"b": 2}'], []] * 30
