"""Arithmetic expressions, evaluated for all rows of an Arrow batch at once.

Expressions are arrays of tokens. In each round every operator that binds tighter than both neighbours and has its operands beside it is worked out,
in all rows together, and the arrays are closed up; a row is done when one value is left. There are as many rounds as the deepest expression needs.
Equal expressions of a batch are worked out once, and tokens are read once for each distinct one.
"""

from __future__ import annotations

import operator
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERROR = "Error"
MAX_POWER, MAX_BASE = 64, 1e6
_TOKEN = r"((?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|\*\*|[-+*/%()])"
_OPS: dict[str, Callable] = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "%": operator.mod}
_SIGNS = ("", "+", "-", "*", "/", "%", "**", "(", ")", "end")  # a token's code is its place here; values have 0
_LEVELS = np.array([0, 1, 1, 2, 2, 2, 4, 0, 0, 0], np.int8)
_PLUS, _MINUS, _POWER, _OPEN, _CLOSE, _END = (_SIGNS.index(x) for x in ("+", "-", "**", "(", ")", "end"))
_UNARY = 3  # binds tighter than a product, less than a power


def _number(text: str):
    """A literal's value; None for one that Python doesn't take, such as 007."""
    if text.isdigit():
        return int(text) if text == "0" * len(text) or text[0] != "0" else None
    return float(text)


def _apply(sign: str, a, b):
    """A value, or None where there is none."""
    try:
        if sign == "**":
            return None if abs(b) > MAX_POWER or abs(a) > MAX_BASE else a**b
        return _OPS[sign](a, b)
    except (ArithmeticError, TypeError, ValueError):
        return None


def _worked_out(texts: pa.Array) -> list[str | None]:
    """The values of expressions, given as tokens parted by spaces; None where there is none."""
    lists = pc.split_pattern(texts, " ")
    told = lists.flatten().dictionary_encode()
    distinct, which = told.dictionary.to_pylist(), told.indices.to_numpy()
    codes = np.array([_SIGNS.index(x) if x in _SIGNS else 0 for x in distinct], np.int8)
    values = np.array([None if c or not x else _number(x) for x, c in zip(distinct, codes.tolist(), strict=True)] + [None], object)[:-1]
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    sign, value = codes[which], values[which]
    failed = np.zeros(len(texts), bool)
    failed[row[(sign == 0) & np.equal(values, None)[which].astype(bool)]] = True
    while len(row):
        n = len(row)
        # places beside each token, with an end on both sides of a row
        before = np.where(np.append(True, row[1:] != row[:-1]), n, np.arange(-1, n - 1))
        after = np.where(np.append(row[1:] != row[:-1], True), n, np.arange(1, n + 1))
        signs = np.append(sign, np.int8(_END))
        valued = np.append(sign == 0, False)
        ends_value = valued | (signs == _CLOSE)
        is_sign = (sign == _PLUS) | (sign == _MINUS)
        unary = is_sign & ~ends_value[before]
        level = np.append(np.where(unary, np.int8(_UNARY), _LEVELS[sign]), np.int8(0))
        left2 = np.append(before, n)[before]
        right2 = np.append(after, n)[after]
        power = sign == _POWER
        binary = (level[:-1] > 0) & ~unary & valued[before] & valued[after]
        ready = binary & (level[left2] < level[:-1]) & ((level[right2] < level[:-1]) | ((level[right2] == level[:-1]) & ~power))
        ready |= binary & power & (level[left2] == level[:-1]) & (level[right2] < level[:-1])
        alone = unary & valued[after] & (signs[right2] != _POWER)
        closed = (sign == _OPEN) & valued[after] & (signs[right2] == _CLOSE)
        i, u, c = np.flatnonzero(ready), np.flatnonzero(alone), np.flatnonzero(closed)
        if not len(i) + len(u) + len(c):
            break
        drop = np.zeros(n + 1, bool)
        done = [_apply(_SIGNS[k], x, y) for k, x, y in zip(sign[i].tolist(), value[before[i]].tolist(), value[after[i]].tolist(), strict=True)]
        value[i] = np.array([*done, None], object)[:-1]
        failed[row[i][np.array([x is None for x in done], bool)]] = True  # a row may have several
        drop[before[i]] = drop[after[i]] = True
        done = [-x if k == _MINUS else +x for k, x in zip(sign[u].tolist(), value[after[u]].tolist(), strict=True)]
        value[u] = np.array([*done, None], object)[:-1]
        drop[after[u]] = True
        value[c] = value[after[c]]
        drop[after[c]] = drop[right2[c]] = True
        sign[np.concatenate([i, u, c])] = 0
        keep = ~drop[:-1] & ~failed[row]
        row, sign, value = row[keep], sign[keep], value[keep]
    left = np.bincount(row, minlength=len(texts))
    single = (left == 1)[row] & (sign == 0)
    out: list[str | None] = [None] * len(texts)
    for r, v in zip(row[single].tolist(), value[single], strict=True):
        out[r] = str(v)
    return out


@F.arrow_udf(T.StringType())
def _evaluated(column: pa.Array) -> pa.Array:
    told = column.dictionary_encode()
    return pa.array(_worked_out(told.dictionary), pa.string()).take(told.indices)


def calculate(expression: Column) -> Column:
    """The value of an expression of decimal numbers, + - * / % ** and brackets, as text; ``Error`` for all else: null, empty, other names, a division by
    zero, a power beyond 64 or of a base beyond a million.

    Whole numbers stay whole, and as large as they get; / gives a fraction, as in Python. Powers go from the right, a sign binds less than a power.
    """
    tokens = F.regexp_extract_all(expression, F.lit(_TOKEN), F.lit(1))
    whole = F.array_join(tokens, "") == F.regexp_replace(expression, r"\s", "")
    return F.coalesce(_evaluated(F.when(whole, F.array_join(tokens, " "))), F.lit(ERROR))
