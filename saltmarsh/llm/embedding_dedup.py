"""Near-duplicate embeddings by lattice hashing.

A vector of length 1 is projected at random to eight-dimensional blocks, and each block is decoded to the nearest
point of a scaled E8 lattice. The blocks' points are its cell in a table; it is stored in its own cell and looks
into neighbouring cells too (one block's point moved to a near one of its 240 neighbours), in several tables. Pairs that
meet are verified by their cosine in double precision.

Equal vectors are one node with a count. What a cell gives is, for each node, the number of vectors that it links with there, and
a spanning forest of the links, so rows that come out grow with the nodes, not with the pairs. A pair may meet in several
cells; it counts in the first of them, which both vectors tell. A cell with more than ``block`` vectors is split over tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm._graph import components
from saltmarsh.llm._salted import salted_lookup
from saltmarsh.llm._store import stored
from saltmarsh.llm._text import mix

#: The 240 shortest vectors of E8.
NEIGHBOURS = np.array(
    [v for v in itertools.product((-1.0, 0.0, 1.0), repeat=8) if sum(map(abs, v)) == 2]
    + [v for v in itertools.product((-0.5, 0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
)
SEED = 20_24


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8: integers with an even sum."""
    near = np.rint(x)
    error = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    worst = np.abs(error[odd]).argmax(axis=1)
    near[odd, worst] += np.where(error[odd, worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, which is D8 and D8 moved by a half in each coordinate."""
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    better = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(better[:, None], whole, half)


class Lattice:
    """Cells of unit vectors of one dimension."""

    def __init__(self, dim: int, cosine: float, tables: int, probes: int):
        self.dim = dim
        self.size = max(8, -(-dim // 8) * 8)
        self.blocks = min(2, self.size // 8)
        self.tables, self.probes = tables, probes
        # links are at most sqrt(2 - 2 cosine) apart; a block sees sqrt(8 / dim) of that
        self.scale = 3.5 * max(1e-3, np.sqrt(max(0.0, 2 - 2 * cosine))) * np.sqrt(8 / self.size)
        self.turns = [np.linalg.qr(np.random.default_rng([SEED, dim, t]).normal(size=(self.size, self.size)))[0][:, : 8 * self.blocks] for t in range(tables)]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Hashes (vector, table, 1 + blocks * probes) of each vector's own cell, then of those it looks into."""
        wide = np.zeros((len(unit), self.size))
        wide[:, : unit.shape[1]] = unit
        out = np.zeros((len(unit), self.tables, 1 + self.blocks * self.probes), np.uint64)
        for t, turn in enumerate(self.turns):
            x = np.round(wide @ turn / self.scale, 9)
            points, moved = [], []
            for b in range(self.blocks):
                part = x[:, 8 * b : 8 * b + 8]
                near = nearest_e8(part)
                closest = np.argsort(-((part - near) @ NEIGHBOURS.T), axis=1, kind="stable")[:, : self.probes]
                points.append(self._hash(near, self.dim, t, b))
                moved.append(self._hash((near[:, None, :] + NEIGHBOURS[closest]).reshape(-1, 8), self.dim, t, b).reshape(-1, self.probes))
            with np.errstate(over="ignore"):
                total = sum(points)
                out[:, t, 0] = mix(total)
                for b in range(self.blocks):
                    out[:, t, 1 + b * self.probes : 1 + (b + 1) * self.probes] = mix((total - points[b])[:, None] + moved[b])
        return out

    @staticmethod
    def _hash(points: np.ndarray, dim: int, table: int, block: int) -> np.ndarray:
        twice = (2 * points).astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            total = np.full(len(points), np.uint64((dim << 32) + 64 * table + block + 1))
            for j in range(8):
                total = mix(total * np.uint64(0x9E3779B97F4A7C15) + twice[:, j])
        return total


@lru_cache(16)
def lattice(dim: int, cosine: float, tables: int, probes: int) -> Lattice:
    return Lattice(dim, cosine, tables, probes)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision of a list column whose vectors have one length."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values**2).sum(axis=1, keepdims=True))


def _by_dim(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    """Dimension and rows of the vectors of each length."""
    lengths = batch.column(column).value_lengths().to_numpy()
    for dim in np.unique(lengths):
        yield int(dim), np.flatnonzero(lengths == dim)


def _placed(nodes: DataFrame, cosine: float, tables: int, probes: int) -> DataFrame:
    """(label, cell, own, node, copies, embedding): each node in its own cells (own = 1) and where it looks (own = 0)."""
    names = ["label", "cell", "own", "node", "copies", "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                for dim, rows in _by_dim(batch, 3):
                    part = batch.take(pa.array(rows))
                    cells = lattice(dim, cosine, tables, probes).cells(_matrix(part.column(3)))
                    n, t, k = cells.shape
                    own = np.tile(np.repeat([1, 0], [1, k - 1]), n * t).astype(np.int8)
                    each = pa.array(np.repeat(np.arange(n), t * k))
                    label, node, copies, embedding = (part.column(i).take(each) for i in range(4))
                    yield pa.RecordBatch.from_arrays([label, pa.array(cells.reshape(-1).view(np.int64)), pa.array(own), node, copies, embedding], names=names)

    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    return nodes.select("label", "node", "copies", "embedding").mapInArrow(
        run, f"label {kinds['label']}, cell long, own byte, node long, copies long, embedding {kinds['embedding']}"
    )


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of vectors, given all their cells: the first cell, by table and then by hash, in which they meet."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(len(a), top)
    for t in range(a.shape[1]):
        at_a = np.where((b[:, t] == a[:, t, :1]).any(axis=1), a[:, t, 0], top)
        at_b = np.where((a[:, t] == b[:, t, :1]).any(axis=1), b[:, t, 0], top)
        best = np.where(best == top, np.minimum(at_a, at_b), best)
    return best


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links."""
    names, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept: tuple[list[int], list[int]] = ([], [])
    for i, j in zip(at[: len(left)].tolist(), at[len(left) :].tolist(), strict=True):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept[0].append(int(names[i]))
            kept[1].append(int(names[j]))
    return kept


class _Side:
    """Rows of one side of a cell: nodes, copies, own and unit vectors."""

    def __init__(self, rows: pa.RecordBatch | pa.Table):
        column = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns]
        self.own, self.node, self.copies = (column[i].to_numpy() for i in (4, 5, 6))
        self.unit = _matrix(column[7])


def _compared(placed: DataFrame, cosine: float, tables: int, probes: int, block: int) -> DataFrame:
    """(a, b, n): for b null, node a links with n more vectors; else a link of the forest."""
    sizes = placed.filter("own = 1").groupBy("label", "cell").count()
    hot = sizes.filter(F.col("count") > block).select("label", "cell", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    if hot.take(1):
        placed = placed.join(hot, ["label", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    else:
        placed = placed.withColumn("blocks", F.lit(1))
    # the stored vectors of a cell are dealt to blocks, and each block meets all vectors of the cell
    rest = ["own", "node", "copies", "embedding"]
    held = placed.filter("own = 1").select("label", "cell", F.pmod("node", "blocks").cast("int").alias("block"), F.lit(0).cast("byte").alias("side"), *rest)
    others = placed.select("label", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).cast("byte").alias("side"), *rest)
    rows = held.unionByName(others).repartition("label", "cell", "block").sortWithinPartitions("label", "cell", "block", "side", "node")

    def links(cell: int, left: _Side, right: _Side) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Linked (a, b) whose first meeting is in this cell, with the copies of both."""
        for at in range(0, len(left.node), 256):
            i, j = np.nonzero(left.unit[at : at + 256] @ right.unit.T >= cosine)
            i += at
            keep = np.where(right.own[j] == 1, left.node[i] < right.node[j], left.node[i] != right.node[j])
            i, j = i[keep], j[keep]
            if len(i):
                grid = lattice(left.unit.shape[1], cosine, tables, probes)
                some_i, at_i = np.unique(i, return_inverse=True)
                some_j, at_j = np.unique(j, return_inverse=True)
                cells_i, cells_j = grid.cells(left.unit[some_i]), grid.cells(right.unit[some_j])
                for k in range(0, len(i), 4096):
                    part = slice(k, k + 4096)
                    mine = _first_meeting(cells_i[at_i[part]], cells_j[at_j[part]]) == np.int64(cell).astype(np.uint64)
                    x, y = i[part][mine], j[part][mine]
                    yield left.node[x], right.node[y], left.copies[x], right.copies[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, left = None, [], None  # the cell that goes on: rows of its left side, and these put together
        for batch in batches:
            label, cell, piece, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(cell):
                continue
            change = (cell[1:] != cell[:-1]) | (piece[1:] != piece[:-1]) | (label[1:] != label[:-1])
            starts = np.append(0, np.flatnonzero(change) + 1)
            ends = np.append(starts[1:], len(cell))
            n_left = np.add.reduceat(side == 0, starts)
            worth = (n_left > 0) & (ends - starts - n_left > 1)
            worth[[0, -1]] = True
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            for g in np.flatnonzero(worth):
                a, b, middle = starts[g], ends[g], starts[g] + n_left[g]
                if key != (now := (label[a], cell[a], piece[a])):
                    key, parts, left = now, [], None
                if middle > a:
                    parts.append(batch.slice(a, middle - a))
                if b > middle and parts:
                    left = left or _Side(pa.Table.from_batches(parts))
                    out.extend(links(cell[a], left, _Side(batch.slice(middle, b - middle))))
            if out:
                x, y, cx, cy = (np.concatenate(v) for v in zip(*out, strict=True))
                nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
                sums = np.zeros(len(nodes), np.int64)
                np.add.at(sums, at, np.concatenate([cy, cx]))
                f, g = _forest(x, y)
                a = pa.array(np.concatenate([nodes, np.array(f, np.int64)]))
                b = pa.concat_arrays([pa.nulls(len(nodes), pa.int64()), pa.array(g, pa.int64())])
                n = pa.array(np.concatenate([sums, np.zeros(len(f), np.int64)]))
                yield pa.RecordBatch.from_arrays([a, b, n], names=["a", "b", "n"])

    return rows.mapInArrow(run, "a long, b long, n long")


def embedding_links(
    df: DataFrame,
    *,
    cosine: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    tables: int = 4,
    probes: int = 4,
    block: int = 2048,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of each row.

    Rows of equal labels (not null) link when the cosine of their vectors, in double precision, is ``cosine`` or more.
    ``n_links`` counts the other rows that a row links with, ``component_id`` is the smallest id that it reaches (itself
    included), ``kept`` says that this is its own. Vectors that are null, empty, zero, or hold null or non-finite
    components, and those without a label, link with nothing; vectors of different lengths don't link. Repeated rows
    link with each other; a null id is never the smallest one. No rows give no rows; further columns aren't read.

    Of links right at a cosine of 0.98 about 99.9 % meet with 4 tables and 4 probes, of closer ones more. Hashes of
    (label, vector) have 64 bits; two different ones are taken for equal with a probability of about n*n / 2**65.
    """
    vector = F.col(vector_col)
    sound = F.col(label_col).isNotNull() & vector.isNotNull() & (F.size(vector) > 0)
    sound &= F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0)
    rows = df.select(
        F.col(id_col),
        F.col(label_col).alias("label"),
        F.when(sound, vector).alias("embedding"),
        F.when(sound, F.xxhash64(F.lit(1), label_col, vector_col)).alias("node"),
    )
    kept_rows = rows.dropna(subset=["node"])
    nodes = kept_rows.groupBy("node").agg(F.first("label").alias("label"), F.count("*").alias("copies"), F.min(id_col).alias("least"), F.first("embedding").alias("embedding"))
    nodes = stored(nodes, "vectors")
    found = stored(_compared(stored(_placed(nodes, cosine, tables, probes), "cells"), cosine, tables, probes, block), "found")
    sums = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    classes = components(found.filter("b is not null")).withColumnRenamed("node", "n2")
    placed = nodes.select("node", "copies", "least").join(classes, F.col("node") == F.col("n2"), "left").select("node", "copies", "least", F.coalesce("component", "node").alias("component"))
    label = placed.groupBy("component").agg(F.min("least").alias("smallest"))
    lookup = placed.join(label, "component").join(sums, "node", "left")
    lookup = lookup.select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "smallest")
    out = salted_lookup(rows.select(id_col, "node"), lookup, "node", [id_col])
    component = F.when(F.col("node").isNull(), F.col(id_col)).otherwise(F.col("smallest"))
    return out.select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.col(id_col).eqNullSafe(F.col("component_id"))
    )
