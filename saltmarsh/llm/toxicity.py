"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A document's features are the n-grams (5 to 8 bytes of UTF-8, in lower case, with other ASCII signs as spaces) that it holds
anywhere at least once, twice, 4 or 8 times, each of these a feature of its own. Feature f has the value
r_f = log((p_f + a) / (P + 2a)) - log((q_f + a) / (Q + 2a)), where p_f of P toxic and q_f of Q other
training documents hold it, and logistic regression learns a weight for each r_f. Features are picked by G, the
likelihood ratio of their counts in both classes, which few documents with a rare n-gram can't drive up as they can r_f. N-grams of up to 8
bytes are told apart exactly, as 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm._store import stored
from saltmarsh.llm._text import give_back, mix, pack, text_buffers, unpack

SIZES = (5, 6, 7, 8)
LEVELS = (1, 2, 4, 8)
PIECE = 1 << 18
ROWS = 256  # rows whose texts are copied at a time
TABLE_BITS = 18
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_PLAIN = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


@dataclass(frozen=True)
class Model:
    """N-grams in rising order, for each the sum of the weights (w_f times r_f) that it has when it comes as often as each level says, and the bias."""

    grams: np.ndarray
    weights: np.ndarray
    bias: float


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts in lower case, each between two spaces."""
    texts = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    return text_buffers(pc.binary_join_element_wise(space, texts, space, none))


def _grams(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each size, the n-gram that begins at each byte; shorter ones have zero bytes at the top."""
    found = _PLAIN[data].astype(np.uint64)
    for size in range(2, max(SIZES) + 1):
        if len(data) < size:
            return
        found = found[:-1] | (_PLAIN[data[size - 1 :]].astype(np.uint64) << np.uint64(8 * size - 8))
        if size in SIZES:
            yield size, found


def _slots(grams: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (grams * _SPREAD) >> np.uint64(64 - TABLE_BITS)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, rising, with the sums of their counts."""
    if len(parts) == 1:
        return parts[0]
    values = np.concatenate([np.zeros(0, np.uint64), *[v for v, _ in parts]])
    counts = np.concatenate([np.zeros(0, np.int64), *[c for _, c in parts]])
    values, at = np.unique(values, return_inverse=True)
    return values, np.bincount(at, counts, len(values)).astype(np.int64)


def document_grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one document's bytes, read in pieces, and how often each comes."""
    found = []
    for at in range(0, len(data), PIECE):
        for size, grams in _grams(data[at : at + PIECE + max(SIZES) - 1]):
            found.append(np.unique(grams[: PIECE], return_counts=True))
    return _summed(found)


class Finder:
    """Finds a model's n-grams in texts: a bit table first, then an exact search."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[_slots(grams)] = True

    def __call__(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row, n-gram (its place in the model) and how often it comes there, for some rows at a time."""
        for at in range(0, len(column), ROWS):
            for rows, which, counts in self._found(column.slice(at, ROWS)):
                yield rows + at, which, counts

    def _found(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        data, offsets = _lowered(column)
        row = 0
        while row < len(column):
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
            stop = min(stop, len(column))
            parts = []
            for at in range(int(offsets[row]), int(offsets[stop]), PIECE):
                piece = data[at : min(at + PIECE + max(SIZES) - 1, int(offsets[stop]))]
                for size, grams in _grams(piece):
                    grams = grams[:PIECE]
                    place = np.flatnonzero(self.table[_slots(grams)])
                    which = np.searchsorted(self.grams, grams[place])
                    which[which == len(self.grams)] = 0
                    exact = self.grams[which] == grams[place] if len(self.grams) else np.zeros(0, bool)
                    place, which = place[exact] + at, which[exact]
                    rows = np.searchsorted(offsets, place, "right") - 1
                    inside = place + size <= offsets[rows + 1]
                    parts.append(np.unique((rows[inside] << 32 | which[inside]).astype(np.uint64), return_counts=True))
            pairs, counts = _summed(parts)
            yield (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), counts
            row = stop


def _level(counts: np.ndarray) -> np.ndarray:
    """Place of the highest level that a count reaches."""
    return np.searchsorted(np.array(LEVELS), counts, "right") - 1


def _regression(rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, ratio: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression on the features scaled by ``ratio``, by Adam over all rows: weights and bias."""
    n, k = len(labels), len(ratio)
    value = ratio[cols]
    w, b = np.zeros(k), float(np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(rows, value * w[cols], n)
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        grad = np.append(np.bincount(cols, value * error[rows], k) + l2 * w, error.sum()) / n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


_COUNT = np.dtype([("gram", "<u8"), ("level", "u1"), ("positive", "<u4"), ("both", "<u4")])
BUCKET_BITS = 6  # n-grams are counted in so many buckets, each held by one task at a time; ``max_rows`` bounds their size


def _counted(grams: np.ndarray, positive: np.ndarray, both: np.ndarray, level: int) -> np.ndarray:
    """Sums of the counts of each n-gram."""
    grams, at = np.unique(grams, return_inverse=True)
    out = np.zeros(len(grams), _COUNT)
    out["gram"], out["level"] = grams, level
    out["positive"], out["both"] = (np.bincount(at, x, len(grams)).astype(np.uint32) for x in (positive, both))
    return out


def _packed(found: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> pa.RecordBatch:
    """How many of some documents, and of the toxic ones, hold each n-gram so many times: one packed row for each bucket."""
    rows = []
    for level, least in enumerate(LEVELS):
        each = [g[c >= least] for g, c in found]
        toxic = np.repeat(labels, [len(x) for x in each])
        rows.append(_counted(np.concatenate([*each, np.zeros(0, np.uint64)]), toxic, np.ones(len(toxic)), level))
    rows = np.concatenate(rows)
    bucket = (mix(np.ascontiguousarray(rows["gram"])) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]), len(bucket))
    data = [pack([rows[n][a:b] for n in _COUNT.names]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(np.diff(cuts).astype(np.int32)), pa.array(data, pa.binary())], ["bucket", "n", "data"])


def _merged(held: list[tuple[bytes, int]], min_rows: int) -> pa.RecordBatch:
    """The n-grams of one bucket that ``min_rows`` documents hold, with their counts."""
    gram, level, positive, both = (np.concatenate(x) for x in zip(*(unpack(data, n, len(_COUNT.names)) for data, n in held), strict=True))
    rows = np.concatenate([_counted(gram.view(np.uint64)[x], positive[x], both[x], i) for i in range(len(LEVELS)) for x in [level == i]])
    rows = rows[rows["both"] >= min_rows]
    arrays = [pa.array(np.ascontiguousarray(rows["gram"]).view(np.int64)), *[pa.array(rows[n].astype(t)) for n, t in (("level", np.int32), ("positive", np.int64), ("both", np.int64))]]
    return pa.RecordBatch.from_arrays(arrays, ["gram", "level", "p", "n"])


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 8000,
    max_features: int = 5000,
    features_a_row: int = 7,
    min_rows: int = 3,
    alpha: float = 0.5,
    l2: float = 0.1,
    steps: int = 300,
) -> Model:
    """Fit a model on at most ``max_rows`` labelled documents: those with the smallest hash of their id.

    Of the features that at least ``min_rows`` of them hold, the ``max_features`` with the largest G
    are kept, and no more than ``features_a_row`` for each of the documents, as few documents let many n-grams look telling by chance. The driver gets these counts and, for each row, which of them it
    holds. Rows whose id or label is null, and ids with a label but no document, count for nothing; of labels of one id the smallest does, and of
    rows of one id the smallest text. Where one of the labels is missing the model has no features and gives all documents the (smoothed) share of toxic rows.
    """
    spark = docs.sparkSession
    picked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna().groupBy("id").agg(F.min("label").alias("label"))
    picked = picked.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(max_rows)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    sample = stored(sample.groupBy("id").agg(F.min("label").alias("label"), F.min("text").alias("text")).select("label", "text"), "labelled")  # max_rows at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            labels_, (data, offsets) = batch.column(0).to_numpy(), _lowered(batch.column(1))
            cuts = np.flatnonzero(np.diff((offsets[:-1] - offsets[0]) // PIECE, prepend=-1, append=-1))
            for first, end in zip(cuts, cuts[1:], strict=False):
                found = [document_grams(data[offsets[i] : offsets[i + 1]]) for i in range(first, end)]
                yield _packed(found, labels_[first:end])
        give_back()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != now and held:
                    yield _merged(held, min_rows)
                    held = []
                now = bucket
                held.append((data, n))
        if held:
            yield _merged(held, min_rows)

    totals = sample.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    positives, negatives = int(totals[0]), int(totals[1] - totals[0])
    if not positives or not negatives:
        share = (positives + 0.5) / (positives + negatives + 2)
        return Model(np.zeros(0, np.uint64), np.zeros((0, len(LEVELS))), float(np.log(share / (1 - share))))
    packed = sample.mapInArrow(count, "bucket int, n int, data binary").repartition("bucket").sortWithinPartitions("bucket")
    counts = packed.mapInArrow(merge, "gram long, level int, p long, n long")
    p, q = F.col("p"), F.col("n") - F.col("p")
    r = F.log((p + alpha) / (positives + 2 * alpha)) - F.log((q + alpha) / (negatives + 2 * alpha))
    rows = positives + negatives
    cells = [(p, positives, F.col("n")), (q, negatives, F.col("n")), (positives - p, positives, rows - F.col("n")), (negatives - q, negatives, rows - F.col("n"))]
    worth = sum((F.when(seen > 0, seen * F.log(seen * rows / (size * of))).otherwise(0.0) for seen, size, of in cells), F.lit(0.0))
    kept = counts.select("gram", "level", r.alias("r"), worth.alias("worth")).orderBy(F.desc("worth"), "gram", "level").limit(min(max_features, features_a_row * rows)).toPandas()
    ratio = kept["r"].to_numpy(float)
    grams, at = np.unique(kept["gram"].to_numpy().astype(np.int64).view(np.uint64), return_inverse=True)
    feature = np.full((len(grams), len(LEVELS)), -1, np.int32)
    feature[at, kept["level"].to_numpy(int)] = np.arange(len(kept))
    held = spark.sparkContext.broadcast((grams, feature))

    def held_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, feature = held.value
        finder = Finder(grams)
        for batch in batches:
            held_ = [b""] * batch.num_rows
            for rows, which, times in finder(batch.column(1)):
                reached = np.where(np.arange(len(LEVELS)) <= _level(times)[:, None], feature[which], -1)
                for a, b in zip(*_bounds(rows), strict=True):
                    held_[rows[a]] = np.sort(reached[a:b][reached[a:b] >= 0]).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held_, pa.binary())], ["label", "held"])

    rows = sample.mapInArrow(held_by, "label int, held binary").toPandas().sort_values(["held", "label"])
    which = [np.frombuffer(x, np.int32) for x in rows["held"]]
    place = np.repeat(np.arange(len(which)), [len(x) for x in which])
    weights, bias = _regression(place, np.concatenate(which).astype(np.int64), rows["label"].to_numpy(float), ratio, l2, steps)
    each = np.where(feature >= 0, np.append(weights * ratio, 0.0)[feature], 0.0)
    return Model(grams, np.cumsum(each, axis=1), bias)


def _bounds(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place (exclusive) of each run of equal rows."""
    begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])[: len(rows)])
    return begins, np.append(begins[1:], len(rows)) if len(rows) else begins


def score(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) to each row, from the text alone.

    Whole texts are read. Null and empty texts hold no features and get the bias's score. Columns of ``docs`` of these
    names are replaced; all others, rows that repeat and null ids stay as they are.
    """
    docs = docs.drop("score", "predicted")
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, finder = held.value, Finder(held.value.grams)
        for texts in parts:
            total = np.full(len(texts), model.bias)
            for at in range(0, len(texts), ROWS):
                for rows, which, times in finder(pa.array(texts.iloc[at : at + ROWS], pa.large_string(), from_pandas=True)):
                    total += np.bincount(rows + at, model.weights[which, _level(times)], len(texts))
            yield pd.Series(1 / (1 + np.exp(-np.clip(total, -500, 500))))

    return docs.withColumn("score", scored(text_col)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are kept from training: crc32 of the id as text, modulo 4, is 2 (never null)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
