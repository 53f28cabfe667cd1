"""JSON objects within texts of a language model, found by prefix sums over the bytes of Arrow batches.

A brace counts +1 or -1; the sums over a text's braces are depths, and an object goes from a brace that leaves depth 0 to the next one that comes back to it. All
texts of a slice of a batch are scanned at once, so that memory goes by slices. Whether a block is JSON is asked of a strict parser in the same batches, as Spark's own functions take single quotes and
whatever follows an object; keys and values are Spark's functions again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.sources.shared import give_back

FENCE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
#: Keys of results that can be explained. Fixed values.
EXPLAINABLE = ("explain", "ranked", "internal", "periods", "warnings")
EMPTY, NONE, OPEN, INVALID = "empty output", "no JSON object found", "unbalanced braces", "invalid JSON"
_QUOTE, _BACK, _LEFT, _RIGHT = 34, 92, 123, 125
SLICE_BYTES = 1 << 22  # of texts that are scanned at once; a longer text is a slice of its own


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    """The rows of a batch, texts or lists of texts, in slices of some bytes."""
    of_lists = pa.types.is_list(column.type)
    sizes = pc.fill_null(pc.binary_length(column.flatten() if of_lists else column), 0).to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
    if of_lists:
        offsets = column.offsets.to_numpy()
        ends = ends[offsets - offsets[0]]
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + SLICE_BYTES, "right")) - 1)
        yield column.slice(begin, end - begin)
        begin = end


def _by_slices(work: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """``work`` on one slice of a batch after the other; its memory is returned behind each batch."""

    @wraps(work)
    def run(column: pa.Array) -> pa.Array:
        done = [work(part) for part in _slices(column)] or [work(column)]
        found = pa.concat_arrays(done)
        del done
        give_back()
        return found

    return run


class _Texts:
    """The bytes of some texts, one behind the other, and their braces."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        self.n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + self.n + 1]
        data = column.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.pos = np.flatnonzero((self.data == _LEFT) | (self.data == _RIGHT))
        self.row = self.rows_of(self.pos)

    def rows_of(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, pos, "right") - 1

    def depths(self, keep: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place, row, sign and depth behind it of the braces, summed within each text."""
        pos, row = self.pos[keep], self.row[keep]
        sign = np.where(self.data[pos] == _LEFT, 1, -1)
        total = np.append(0, np.cumsum(sign))
        return pos, row, sign, total[1:] - total[np.searchsorted(row, row)]

    def cut(self, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(begin.tolist(), (end + 1).tolist(), strict=True)]

    def lists(self, begin: np.ndarray, end: np.ndarray) -> pa.Array:
        """The blocks of each text."""
        bounds = np.searchsorted(begin, self.offsets)
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(self.cut(begin, end), pa.binary()).cast(pa.string()))


def _paired(opens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end with the last opening before it."""
    return opens[np.searchsorted(opens, ends) - 1], ends


@F.arrow_udf(T.ArrayType(T.StringType()))
@_by_slices
def _counted_blocks(column: pa.Array) -> pa.Array:
    texts = _Texts(column)
    pos, _, sign, depth = texts.depths()
    return texts.lists(*_paired(pos[(sign == 1) & (depth == 1)], pos[(sign == -1) & (depth == 0)]))


@F.arrow_udf(T.ArrayType(T.StringType()))
@_by_slices
def _floored_blocks(column: pa.Array) -> pa.Array:
    texts = _Texts(column)
    pos, row, sign, depth = texts.depths()
    step = 2 * len(pos) + 2  # each text's sums lie below those before, so one running minimum serves all
    sums = depth - row * step
    floored = sums - np.minimum.accumulate(np.minimum(sums, -row * step)) if len(pos) else sums
    before = np.append(0, floored[:-1])[: len(pos)]
    before[np.append(True, row[1:] != row[:-1])[: len(pos)]] = 0
    return texts.lists(*_paired(pos[(sign == 1) & (before == 0)], pos[(sign == -1) & (before == 1)]))


@F.arrow_udf(T.StructType([T.StructField("block", T.StringType()), T.StructField("reason", T.StringType())]))
@_by_slices
def _first_block(column: pa.Array) -> pa.Array:
    texts = _Texts(column)
    starts = texts.offsets[1:].copy()  # where the first object begins, or the text's end
    left = texts.data[texts.pos] == _LEFT
    first_rows, first = np.unique(texts.row[left], return_index=True)
    starts[first_rows] = texts.pos[left][first]
    back = np.flatnonzero(texts.data == _BACK)
    back = back[back > starts[texts.rows_of(back)]]
    rows = texts.rows_of(back)
    new = np.append(True, (back[1:] != back[:-1] + 1) | (rows[1:] != rows[:-1]))[: len(back)]
    run = np.maximum.accumulate(np.where(new, back, 0)) if len(back) else back
    escaped = np.zeros(len(texts.data) + 1, bool)
    escaped[back[(back - run) % 2 == 0] + 1] = True
    escaped[texts.offsets] = False  # a backslash at a text's end escapes nothing of the next one
    quotes = np.flatnonzero(texts.data == _QUOTE)
    quotes = quotes[(quotes > starts[texts.rows_of(quotes)]) & ~escaped[quotes]]
    begin = starts[texts.row]
    inside = (np.searchsorted(quotes, texts.pos) - np.searchsorted(quotes, begin)) % 2 == 1
    pos, row, _, depth = texts.depths((texts.pos >= begin) & ~inside & ~escaped[texts.pos])
    closed_rows, closed = np.unique(row[depth == 0], return_index=True)
    blocks: list[bytes | None] = [None] * texts.n
    for i, block in zip(closed_rows.tolist(), texts.cut(starts[closed_rows], pos[depth == 0][closed]), strict=True):
        blocks[i] = block
    has = np.zeros(texts.n, bool)
    has[first_rows] = True
    empty = np.diff(texts.offsets) == 0
    reasons = [EMPTY if e else NONE if not h else OPEN if b is None else None for e, h, b in zip(empty, has, blocks, strict=True)]
    return pa.StructArray.from_arrays([pa.array(blocks, pa.binary()).cast(pa.string()), pa.array(reasons, pa.string())], names=["block", "reason"])


def _not_json(constant: str) -> None:
    raise ValueError(constant)


def _is_object(block: str | None) -> bool:
    try:
        return block is not None and isinstance(json.loads(block, parse_constant=_not_json), dict)
    except (ValueError, RecursionError):
        return False


@F.arrow_udf(T.ArrayType(T.StringType()))
@_by_slices
def _objects(column: pa.Array) -> pa.Array:
    """Of each list of blocks those that are JSON."""
    good = pa.array(map(_is_object, column.flatten().to_pylist()), pa.bool_())
    kept = np.append(0, np.cumsum(good.to_numpy(zero_copy_only=False)))
    offsets = column.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(kept[offsets - offsets[0]].astype(np.int32)), column.flatten().filter(good))


def first_object(text: Column) -> Column:
    """(block, reason): the first object of a text by braces outside strings; null, and why, where there is none that is JSON.

    Reasons: ``empty output`` (null too), ``no JSON object found``, ``unbalanced braces`` (it never ends), ``invalid JSON`` (NaN and
    Infinity too, and what is nested too deep for a parser's stack). Nothing is mended.
    """
    found = _first_block(text)
    block = F.try_element_at(_objects(F.array(found["block"])), F.lit(1))
    return F.struct(block.alias("block"), F.coalesce(found["reason"], F.when(block.isNull(), INVALID)).alias("reason"))


def _fenced(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FENCE), F.lit(1))


def any_object(text: Column, fences: bool = False) -> Column:
    """The first block that is JSON, by braces alone, also within strings; with ``fences``, what stands in a code fence goes first. Null without any.

    Closing braces without an opening one count: behind one too many, no block begins at depth 0.
    """
    blocks = _counted_blocks(text)
    if fences:
        blocks = F.concat(_fenced(text), blocks)
    return F.try_element_at(_objects(blocks), F.lit(1))


def keyed_object(text: Column, key: str = "action") -> Column:
    """Of the objects in code fences, then of those by braces (closing ones too many are passed over): the last one with ``key``, or else the last one. Null without any."""
    found = _objects(F.concat(_fenced(text), _floored_blocks(text)))
    with_key = F.filter(found, lambda b: F.array_contains(F.json_object_keys(b), key))
    return F.coalesce(F.try_element_at(with_key, F.lit(-1)), F.try_element_at(found, F.lit(-1)))


def value(block: Column) -> Column:
    """A block's value as a variant; null where a key comes twice, which a variant can't hold."""
    return F.try_parse_json(block)


def explainable(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, block) of each conversation's latest assistant message whose first object has one of the keys of a result that can be explained.

    messages: conv_id, turn, role, text. A conversation without such a message has no row; of equal turns the one with the larger block counts.
    """
    said = messages.filter(F.col("role") == "assistant").select("conv_id", "turn", first_object(F.col("text"))["block"].alias("block"))
    said = said.filter(F.arrays_overlap(F.json_object_keys("block"), F.array(*map(F.lit, EXPLAINABLE))))
    return said.groupBy("conv_id").agg(F.max(F.struct("turn", "block")).alias("m")).select("conv_id", "m.turn", "m.block")
