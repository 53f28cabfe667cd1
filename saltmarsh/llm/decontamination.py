"""Benchmark decontamination: short test items inside long documents.

Items are partitioned by size (number of distinct shingles, doubling from partition to partition). Each
item is sketched by its smallest MinHash values, as many as its partition needs so that no document that holds
the asked share of any item in it can miss all of them: with u shingles and containment t, u - ceil(t u) + 1. A
document is searched with all of its shingles, whatever its length, and an item that is hit is verified by its
exact containment. So there are no false negatives, and nothing of a document is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.llm._store import stored
from saltmarsh.llm._text import distinct, grams, shingle_set, words_of

BLOCK = 2_000_000  # shingles of items that are broadcast at a time, 16 bytes each
_TABLE_BITS = 20


class ItemIndex:
    """Sketches and shingle sets of a block of items."""

    def __init__(self, ids: pa.Array, sizes: np.ndarray, widths: np.ndarray, sets: list[np.ndarray], percent: int):
        self.ids, self.sizes, self.widths, self.sets, self.percent = ids, sizes, widths, sets, percent
        values, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, (n, shingles) in enumerate(zip(sizes.tolist(), sets, strict=True)):
            top = (1 << (n - 1).bit_length()) if n else 0  # the largest size of the item's partition
            sketch = shingles[: top - -(-percent * top // 100) + 1]
            values.append(sketch)
            owners.append(np.full(len(sketch), i))
        value, owner = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(value, kind="stable")
        self.value, self.owner = value[order], owner[order]
        self.lengths = sorted(set(widths[sizes > 0].tolist()))
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.value >> np.uint64(64 - _TABLE_BITS)] = True

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item, shingles of the item that the row holds) where these are enough."""
        for words in words_of(column):
            hits = []
            for k in self.lengths:
                found = grams(words.hashes, k)
                at = np.flatnonzero(self.table[found >> np.uint64(64 - _TABLE_BITS)])
                low, high = np.searchsorted(self.value, found[at], "left"), np.searchsorted(self.value, found[at], "right")
                at, low, count = at[high > low], low[high > low], (high - low)[high > low]
                rows = np.searchsorted(words.bounds, at, "right") - 1
                inside = at + k <= words.bounds[rows + 1]
                rows, low, count = rows[inside], low[inside], count[inside]
                each = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                hits.append(distinct((np.repeat(rows, count) << 32 | self.owner[each]).astype(np.uint64)))
            last, held = -1, {}
            for pair in distinct(np.concatenate([*hits, np.zeros(0, np.uint64)])).tolist():
                row, item = pair >> 32, pair & 0xFFFFFFFF
                if row != last:
                    last, held = row, {}
                k = int(self.widths[item])
                if k not in held:
                    held[k] = distinct(grams(words.hashes[words.bounds[row] : words.bounds[row + 1]], k))
                shingles = self.sets[item]
                place = np.searchsorted(held[k], shingles)
                place[place == len(held[k])] = 0
                n = int((held[k][place] == shingles).sum())
                if 100 * n >= self.percent * int(self.sizes[item]):
                    yield words.first + row, item, n


def item_shingles(items: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, n, width (words of a shingle: k, or all of a shorter item) and the sorted shingle hashes of each item."""
    schema = T.StructType([T.StructField("id", items.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, widths = [], []
            for words in words_of(batch.column(1)):
                for a, b in zip(words.bounds, words.bounds[1:], strict=False):
                    sets.append(shingle_set(words.hashes[a:b], k))
                    widths.append(min(k, int(b - a)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(widths, pa.int32()), pa.array([x.tobytes() for x in sets], pa.binary())], names=schema.names
            )

    return items.select(id_col, text_col).mapInArrow(run, schema)


def find_contained(
    docs: DataFrame,
    items: DataFrame,
    *,
    k: int = 5,
    percent: int = 80,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """Pairs of a document and an item of whose distinct ``k``-word shingles it holds ``percent`` or more.

    Returns ``doc_id``, ``item_id``, ``n_shingles`` (of the item), ``n_found`` and ``containment``. An item of fewer
    than ``k`` words is one shingle, its whole sequence; an item without words is in no document. Words as in
    ``_text``. Null texts count as empty, repeated rows each give their pairs, null ids are ids. Items are broadcast in
    blocks of about half of ``block`` shingles (or of one item, if longer), one after the other; there are as many passes as blocks. Equal items are
    searched for once. Very long texts are read whole; further columns aren't read.
    """
    schema = T.StructType([docs.schema[doc_id], *[T.StructField(n, T.LongType()) for n in ("key", "n_shingles", "n_found")]])
    shingled = stored(item_shingles(items, k, item_id, item_text).filter("n > 0").withColumn("key", F.xxhash64("shingles", "width")), "items")
    sets = shingled.dropDuplicates(["key"])  # equal items are searched for once
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // block)) if total > block else 1
    spark, found = docs.sparkSession, []
    for b in range(blocks):
        table = sets.filter(F.pmod("key", F.lit(blocks)) == b).toArrow()
        shingles = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        keys = table.column("key").combine_chunks()
        index = ItemIndex(keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys, table.column("n").to_numpy(), table.column("width").to_numpy(), shingles, percent)
        held = spark.sparkContext.broadcast(index)
        pairs = docs.select(doc_id, doc_text).mapInArrow(_searcher(held, schema.names), schema)
        if blocks > 1:  # one block is held at a time
            pairs = stored(pairs, "contained")
            held.destroy()
        found.append(pairs)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    named = out.join(shingled.select("key", F.col("id").alias("_item")), "key")
    return named.select(doc_id, F.col("_item").alias(item_id), "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def _searcher(held, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = held.value
        for batch in batches:
            hits = list(index.search(batch.column(1)))
            rows, which, n = (np.array(x, np.int64) for x in (zip(*hits, strict=True) if hits else ((), (), ())))
            sizes = index.sizes[which] if len(which) else np.zeros(0, np.int64)
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), index.ids.take(pa.array(which, pa.int64())), pa.array(sizes, pa.int64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def remove_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no item; rows with the id of one that does go too."""
    key = options.get("doc_id", "doc_id")
    return docs.join(find_contained(docs, items, **options).select(key).distinct(), key, "left_anti").select(docs.columns)
