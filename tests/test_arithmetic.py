"""The calculator against Python's own parser."""

import ast
import operator
import random

import pytest
from pyspark.sql import functions as F

from saltmarsh.functions import arithmetic as A

OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod}


def walk(node):
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return node.value
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Pow):
        a, b = walk(node.left), walk(node.right)
        if abs(b) > A.MAX_POWER or abs(a) > A.MAX_BASE:
            raise ValueError
        return a**b
    if isinstance(node, ast.BinOp) and type(node.op) in OPS:
        return OPS[type(node.op)](walk(node.left), walk(node.right))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
        return -walk(node.operand) if isinstance(node.op, ast.USub) else +walk(node.operand)
    raise ValueError


def python(text):
    try:
        return str(walk(ast.parse((text or "").strip(), mode="eval").body))
    except (ArithmeticError, SyntaxError, TypeError, ValueError):
        return "Error"


CASES = ["2 + 3 * 4", "__import__('os')", "1/0", None, "", " ", "-2**2", "2**-1", "2**3**2", "-(-3)", "--3", "+-+4", "7 % -3", "-7 % 3", "7.5 % 2", "1 2", "(1)(2)", "()", "(", ")", "1 +", "* 2", "2 // 3", "2***3", "007", "00", "0.5", ".5", "5.", "1e3", "1e", "1.5.2", "10**64", "10**65", "9999999**2", "2**0.5", "(-8)**0.5", "0**-1", "0.0/0", "12345678901234567890 * 98765432109876543210", "1 - 2 - 3", "2 / 4 / 8", "2 * 3 % 4", "1e308 * 10", "((((1))))", "1,5", "x + 1", "1 + 2)", "5 -- 3", "2 * -3 ** 2", "9" * 400 + " / 7"]


def random_expression(rng, depth=0):
    kind = rng.random()
    if depth > 4 or kind < 0.3:
        return rng.choice(["0", "1", "2", "3.5", "10", ".25", "7"])
    if kind < 0.45:
        return rng.choice("+-") + random_expression(rng, depth + 1)
    if kind < 0.6:
        return f"({random_expression(rng, depth + 1)})"
    return f"{random_expression(rng, depth + 1)} {rng.choice(['+', '-', '*', '/', '%', '**'])} {random_expression(rng, depth + 1)}"


@pytest.mark.parametrize("seed", range(2))
def test_against_python(spark, seed):
    rng = random.Random(seed)
    texts = CASES + [random_expression(rng) for _ in range(600)] + ["".join(rng.choice("12 +-*/%().") for _ in range(rng.randrange(1, 12))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    wrong = [(texts[r.i], r.v, python(texts[r.i])) for r in df.select("i", A.calculate(F.col("t")).alias("v")).collect() if r.v != python(texts[r.i])]
    assert not wrong, wrong[:10]


def test_long_expression_and_empty_table(spark):
    long = " + ".join(["1"] * 3000)
    df = spark.createDataFrame([(long,), ("(" * 200 + "5" + ")" * 200,)], "t string")
    assert [r.v for r in df.select(A.calculate(F.col("t")).alias("v")).collect()] == ["3000", "5"]
    assert spark.createDataFrame([], "t string").select(A.calculate(F.col("t"))).count() == 0


def test_equal_expressions_are_worked_out_once(monkeypatch):
    import pyarrow as pa

    times = []
    apply = A._apply
    monkeypatch.setattr(A, "_apply", lambda *x: times.append(1) or apply(*x))
    got = A._evaluated.func(pa.array(["1 + 2", "3 / 0", None, "2 * 3"] * 1000))
    assert got.to_pylist() == ["3", None, None, "6"] * 1000 and len(times) == 3


def test_one_failure_fails_its_row():
    import pyarrow as pa

    assert A._worked_out(pa.array(["( 1 / 0 ) + ( 4 / 2 )", "( 4 / 2 ) + ( 1 / 0 )", "1 + 1"])) == [None, None, "2"]
