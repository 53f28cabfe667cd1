"""N-gram Jaccard join: documents whose sets of word shingles are alike, and their classes.

Exact in three steps, none of which compares all pairs of anything:

1. Documents with equal sets are one node. A node of the size class c (sizes in which a partner's size
   is at most one class up) deals its shingles, ordered by hash, to m ranges of the hash. Two sets whose
   Jaccard similarity is high enough differ in d <= m - r shingles, so at least r of m ranges hold the same
   shingles in both. The ranges' signatures are the candidates' meeting places; those that only hold the shingles of a common
   passage are few, as a range is given by all of its shingles.
   Each node has a sketch: how many of its shingles fall into each of some buckets. Two sets have at most the sum of the
   smaller counts in common, so pairs whose sketches rule out a link are left before any text is shuffled.
2. Of the nodes that meet, each is verified against the smallest one (the pivot) by a prefix-tree join: the sets, in
   global order, form a trie; its paths are walked with the pivot's set, nodes of equal prefixes share the
   overlap counted so far, and a subtree is left as soon as what remains can't reach the required overlap.
3. Nodes that meet but aren't yet in one class are verified against each other in the same way, many at a time.
   Copies and most near copies are one class after step 2, so few are left.

Shingle hashes have 64 bits; two different sets are taken for equal with a probability of about n*n / 2**65 for n texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.llm._graph import components
from saltmarsh.llm._salted import salted_lookup
from saltmarsh.llm._store import dropped, stored
from saltmarsh.llm._text import mix, shingle_set, words_of

BLOCK_NODES = 256  # nodes of one place that are compared at a time, on either side
BLOCK_SKETCHES = 512  # the same, of sketches
BLOCK_BYTES = 4 << 20  # text that is joined with one pivot at a time
SEEN = 200_000  # nodes of which a task knows that it has dealt them
SLOTS = 1 << 21  # places of the table that tells most nodes that meet none from the others
CHUNK = 128  # shingles between two looks at the bound
BUCKETS = 256  # counters of a node's sketch, at least; a large set has one for each four shingles or fewer
_ROOT = np.uint64(0xA24BAED4963EE407)


class Classes:
    """Size classes for a similarity of ``percent``/100, and how many ranges each has."""

    def __init__(self, percent: int):
        self.percent = percent
        self.bounds = [1, 2]

    def of(self, n: int) -> int:
        while self.bounds[-1] <= n:
            last = self.bounds[-1]
            self.bounds.append(max(last + 1, (last - 1) * 100 // self.percent + 1))
        return int(np.searchsorted(self.bounds, n, "right")) - 1

    def ranges(self, c: int) -> tuple[int, int]:
        """m and r for pairs whose larger set is of class c; (0, 0) if such sets link when equal only."""
        while len(self.bounds) < c + 2:
            self.of(self.bounds[-1])
        differ = 2 * (self.bounds[c + 1] - 1) * (100 - self.percent) // (100 + self.percent)
        spare = 2 + differ // 32
        return (differ + spare, spare) if differ else (0, 0)


def fingerprint(shingles: np.ndarray) -> int:
    """64 bits (signed) that stand for a set."""
    with np.errstate(over="ignore"):
        total = mix(shingles ^ _ROOT).sum(dtype=np.uint64) + np.uint64(len(shingles)) * _ROOT
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def sketch(shingles: np.ndarray) -> bytes:
    """How many of a set's shingles fall into each bucket, counted up to 255; the buckets are a power of two."""
    width = max(BUCKETS, 1 << max(0, len(shingles) // 4 - 1).bit_length())
    return np.minimum(np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width), 255).astype(np.uint8).tobytes()


def _stacked(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches of one width as rows, folded to fewer buckets."""
    rows = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1, width)
    return rows[:, 0] if rows.shape[1] == 1 else np.minimum(rows.sum(axis=1, dtype=np.uint32), 255).astype(np.uint8)


def _sized(na: np.ndarray, nb: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """What sets of these sizes need to have in common, and whether they can."""
    need = -(-percent * (na + nb) // (100 + percent))
    return need, np.minimum(na, nb) >= need


def _enough(a: np.ndarray, b: np.ndarray, need: np.ndarray) -> np.ndarray:
    common = np.minimum(a, b)  # a bucket that is full on both sides rules nothing out
    return (common.sum(axis=1, dtype=np.int64) >= need) | (common == 255).any(axis=1)


def may_link(a: list[bytes], na: np.ndarray, b: list[bytes], nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of sets with these sketches and sizes may be alike enough."""
    need, out = _sized(na, nb, percent)
    widths = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    for wa, wb in np.unique(widths[out], axis=0):
        at = np.flatnonzero(out & (widths == (wa, wb)).all(axis=1))
        for some in np.array_split(at, len(at) // 512 + 1):
            x, y = (_stacked([side[i] for i in some], min(wa, wb)) for side in (a, b))
            out[some] = _enough(x, y, need[some])
    return out


class SketchIndex:
    """Sketches that many others are held against."""

    def __init__(self, sketches: list[bytes], sizes: np.ndarray, percent: int):
        self.sketches, self.sizes, self.percent = sketches, sizes, percent
        widths = np.array([len(x) for x in sketches])
        self.rows = {int(w): np.flatnonzero(widths == w) for w in np.unique(widths)}
        self.folded: dict[tuple[int, int], np.ndarray] = {}

    def candidates(self, probe: bytes, size: int, wanted: np.ndarray) -> np.ndarray:
        """Places of those ``wanted`` that may link with the probe."""
        need, fits = _sized(self.sizes, np.int64(size), self.percent)
        fits &= wanted
        found = []
        for w, rows in self.rows.items():
            if len(pick := np.flatnonzero(fits[rows])):
                width = min(w, len(probe))
                if (w, width) not in self.folded:
                    self.folded[w, width] = _stacked([self.sketches[i] for i in rows], width)
                found.append(rows[pick][_enough(_stacked([probe], width), self.folded[w, width][pick], need[rows[pick]])])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def signatures(shingles: np.ndarray, c: int, m: int, r: int) -> np.ndarray:
    """Signatures of the ranges of a set, for pairs of class c.

    Ranges without shingles are left out: of the r that two linked sets have in common, one isn't empty,
    unless both sets have r empty ones. A set that has so many gives the empty ones too.
    """
    which = ((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
    with np.errstate(over="ignore"):
        place = mix(np.arange(m, dtype=np.uint64) + np.uint64(c << 32))
        held = which[first].astype(np.int64)
        sums = np.add.reduceat(mix(shingles ^ _ROOT), first)
        out = mix(sums + place[held])
        if m - len(held) >= r:
            empty = np.ones(m, bool)
            empty[held] = False
            out = np.append(out, mix(place[empty] ^ _ROOT))
    return out


def _sets(batch: pa.RecordBatch, column: int, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for words in words_of(batch.column(column)):
        for i in range(len(words)):
            yield words.first + i, shingle_set(words.hashes[words.bounds[i] : words.bounds[i + 1]], k)


def _nodes(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, node) of each row; node is null without shingles."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), fingerprint(s) if len(s) else None) for _, s in _sets(batch, 1, k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in sets], pa.int64()), pa.array([f for _, f in sets], pa.int64())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _dealt(docs: DataFrame, k: int, percent: int, text_col: str) -> DataFrame:
    """(sig, node) for each range of each node; a copy in another task gives the same rows again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = Classes(percent), set()
        for batch in batches:
            sigs, nodes, size = [], [], 0
            for _, s in _sets(batch, 0, k):
                if not len(s) or (node := fingerprint(s)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                own = classes.of(len(s))
                for c in (own, own + 1):
                    m, r = classes.ranges(c)
                    if m:
                        sigs.append(signatures(s, c, m, r))
                        nodes.append(np.full(len(sigs[-1]), node, np.int64))
                        size += len(sigs[-1])
                if size > 1 << 18:
                    yield _pairs(sigs, nodes, ["sig", "node"])
                    sigs, nodes, size = [], [], 0
            yield _pairs(sigs, nodes, ["sig", "node"])

    return docs.select(text_col).mapInArrow(run, "sig long, node long")


def _pairs(a: list[np.ndarray], b: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *[x.view(np.int64) for x in y]])) for y in (a, b)], names=names)


def _meetings(dealt: DataFrame) -> DataFrame:
    """(sig, node, pivot) for each node of a signature that several nodes have; the pivot is the smallest of them.

    Rows of a partition come in order, so a signature is a run of rows, read in batches and never held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_sig = last_node = pivot = None  # of the run that goes on
        told = False  # the pivot's own row has been given
        for batch in batches:
            sig, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(sig):
                continue
            fresh = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))
            if last_sig is not None:
                fresh[0] = sig[0] != last_sig or node[0] != last_node
            sig, node = sig[fresh], node[fresh]
            if not len(sig):
                continue
            goes_on = last_sig is not None and sig[0] == last_sig
            starts = np.append(not goes_on, sig[1:] != sig[:-1])
            run_of = np.cumsum(starts) - (0 if goes_on else 1)
            pivots = node[starts] if not goes_on else np.append(np.int64(pivot), node[starts])
            of = pivots[run_of]
            size = np.bincount(run_of, minlength=len(pivots))
            keep = size[run_of] > 1
            out = [sig[keep], node[keep], of[keep]]
            if goes_on and size[0] >= 1:
                mine = run_of == 0
                keep |= mine
                out = [sig[keep], node[keep], of[keep]]
                if not told:
                    out = [np.append(x, np.int64(y)) for x, y in zip(out, (last_sig, pivot, pivot), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["sig", "node", "pivot"])
            last = run_of[-1]
            told = bool(size[last] > 1 or (goes_on and last == 0))
            last_sig, last_node, pivot = sig[-1], node[-1], of[-1]

    ordered = dealt.repartition("sig").sortWithinPartitions("sig", "node")
    return ordered.mapInArrow(run, "sig long, node long, pivot long")


def _texts(docs: DataFrame, nodes: DataFrame, k: int, text_col: str) -> DataFrame:
    """(node, text, n, sketch) of the given nodes: one of the node's texts, the size and the sketch of its set."""
    slots = nodes.select(F.pmod("node", F.lit(SLOTS)).cast("int").alias("slot")).distinct().toArrow()  # SLOTS rows at most
    table = np.zeros(SLOTS, bool)
    table[slots.column("slot").to_numpy()] = True
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = held.value, set()
        for batch in batches:
            rows, found, sizes, sketches = [], [], [], []
            for i, s in _sets(batch, 0, k):
                if len(s) and table[(node := fingerprint(s)) % SLOTS] and node not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    rows.append(i)
                    found.append(node)
                    sizes.append(len(s))
                    sketches.append(sketch(s))
            texts = batch.column(0).take(pa.array(rows, pa.int64())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), texts, pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], names=["node", "text", "n", "sketch"])

    some = docs.select(text_col).mapInArrow(run, "node long, text string, n long, sketch binary")
    return some.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))


def _plausible(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sketches allow for a link."""

    def side(name: str) -> DataFrame:
        return texts.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("sketch").alias(f"s{name}"))

    both = salted_lookup(pairs, side("a"), "a", ["b"]).join(side("b"), "b")  # a pivot may have many partners

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            keep = pa.array(may_link(batch.column(4).to_pylist(), na, batch.column(5).to_pylist(), nb, percent))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


class PrefixTree:
    """Sets in global order as a trie, kept as the sorted sets and the depth that each shares with the one before."""

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u8").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = sets
        self.shared = []
        for at, i in enumerate(self.order):
            a, b = sets[self.order[at - 1]] if at else sets[i][:0], sets[i]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            self.shared.append(int(differ[0]) if len(differ) else n)

    def overlaps(self, probe: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
        """(set, overlap with the probe) of the sets whose overlap is large enough.

        ``hits[d]`` is the overlap of the first d shingles of the path that is walked; a set begins with what it shares
        with the one before it. A path is left where its overlap so far and the shorter of what remains
        on both sides are less than the set needs; so are the sets below that place, unless smaller ones need less.
        """
        hits, known = np.zeros(1, np.int64), 0  # known: the depth down to which hits are counted
        for i, shared in zip(self.order, self.shared, strict=True):
            own = self.sets[i]
            need = -(-percent * (len(own) + len(probe)) // (100 + percent))
            depth = min(shared, known)
            hits = hits[: depth + 1]
            parts, count = [hits], int(hits[-1])
            left = len(probe) - int(np.searchsorted(probe, own[depth - 1], "right")) if depth else len(probe)
            alive = min(len(own), len(probe)) >= need and count + min(len(own) - depth, left) >= need
            while alive and depth < len(own):
                piece = own[depth : depth + CHUNK]
                place = np.searchsorted(probe, piece)
                found = place < len(probe)
                found[found] = probe[place[found]] == piece[found]
                parts.append(count + np.cumsum(found))
                count = int(parts[-1][-1])
                depth += len(piece)
                left = len(probe) - int(np.searchsorted(probe, piece[-1], "right"))
                alive = count + min(len(own) - depth, left) >= need
            hits, known = np.concatenate(parts), depth
            if alive and count >= need:
                yield i, count


    def overlaps_many(self, probes: list[np.ndarray], percent: int, cells: int = 1 << 24) -> Iterator[tuple[int, int]]:
        """(probe, set) of those whose overlap is large enough: the same walk for many probes at once.

        ``hits[d, p]`` is the overlap of the path's first d shingles with probe p; a path is left where no probe can
        still reach what it needs with the shingles that remain of the set.
        """
        known_all = np.unique(np.concatenate(self.sets))
        places = [np.searchsorted(known_all, s) for s in self.sets]
        step = max(1, cells // len(known_all))
        for at in range(0, len(probes), step):
            some = probes[at : at + step]
            held = np.zeros((len(known_all), len(some)), np.uint8)
            for j, probe in enumerate(some):
                place = np.searchsorted(known_all, probe)
                place[place == len(known_all)] = 0
                held[place[known_all[place] == probe], j] = 1
            sizes = np.array([len(x) for x in some])
            hits, known = np.zeros((1, len(some)), np.int32), 0
            for i, shared in zip(self.order, self.shared, strict=True):
                own, n = places[i], len(self.sets[i])
                need = -(-percent * (n + sizes) // (100 + percent))
                fits = np.minimum(n, sizes) >= need
                depth = min(shared, known)
                hits = hits[: depth + 1]
                parts, count = [hits], hits[-1]
                alive = fits & (count + n - depth >= need)
                while alive.any() and depth < n:
                    piece = own[depth : depth + CHUNK]
                    parts.append(count + np.cumsum(held[piece], axis=0, dtype=np.int32))
                    count = parts[-1][-1]
                    depth += len(piece)
                    alive = fits & (count + n - depth >= need)
                hits, known = np.concatenate(parts), depth
                for j in np.flatnonzero(alive & (count >= need)) if depth == n else ():
                    yield at + int(j), i


def _grid(rows: DataFrame, payload: DataFrame, block: int) -> DataFrame:
    """(sig, i, j, side, node, component and the payload's columns), sorted by cells of a grid for each sig.

    rows: (sig, node, component, rest). Nodes with ``rest`` are dealt to the grid's rows (side 0), all nodes to its columns (side 1), and each
    goes to all cells of its row or column. Where no node is ``rest`` or there is one node only, nothing is to be compared.
    """
    groups = rows.groupBy("sig").agg(F.count_if("rest").alias("nx"), F.count("*").alias("ny")).filter("nx > 0 and ny > 1")
    blocks = [F.ceil(F.col(n) / block).cast("int").alias(m) for n, m in (("nx", "bx"), ("ny", "by"))]
    members = rows.join(groups.select("sig", *blocks), "sig")
    numbers = [F.sequence(F.lit(0), F.col(n) - 1) for n in ("bx", "by")]
    own = [F.pmod(F.xxhash64("node"), n).cast("int") for n in ("bx", "by")]
    probes = members.filter("rest").select("sig", own[0].alias("i"), F.explode(numbers[1]).alias("j"), F.lit(0).alias("side"), "node", "component")
    held = members.select("sig", F.explode(numbers[0]).alias("i"), own[1].alias("j"), F.lit(1).alias("side"), "node", "component")
    cells = probes.unionByName(held).join(payload, "node").select("sig", "i", "j", "side", "node", "component", *[c for c in payload.columns if c != "node"])
    return cells.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "side")


def _hopeful(rows: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of the rows (sig, node, component, rest) that another class's node of the place may link with, by the sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])
        found: set[tuple[int, int]] = set()

        def close() -> None:
            if sides[0] and sides[1]:
                node, component, sizes, sketches = zip(*sides[1], strict=True)
                node, component = np.array(node), np.array(component)
                index = SketchIndex(list(sketches), np.array(sizes), percent)
                for x, own, size, probe in sides[0]:
                    if len(at := index.candidates(probe, size, component != own)):
                        found.update((key[0], int(v)) for v in [x, *node[at]])

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], pa.int64()) for c in (0, 1)], names=["sig", "node"])
            found.clear()
            return out

        for batch in batches:
            for sig, i, j, side, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (sig, i, j) != key:
                    close()
                    key, sides = (sig, i, j), ([], [])
                sides[side].append(row)
            yield told()
        close()
        yield told()

    some = _grid(rows, texts.select("node", "n", "sketch"), BLOCK_SKETCHES).mapInArrow(run, "sig long, node long")
    return rows.join(some.distinct(), ["sig", "node"], "left_semi")


def _met_unlinked(placed: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b), stored, between nodes that meet in one place and are of two classes.

    placed: (sig, pivot, node, component, rest) without the pivots themselves. Nodes that aren't of the pivot's class (``rest``) are probes for all nodes of
    the place but the pivot, which each has been verified with: first for their sketches, place by place, where of places with the same nodes
    one is enough. Nodes that these leave a chance are then looked into by pivot, so a node's text goes to a pivot once.
    """
    hashes = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"h{i}") for i in (1, 2)]
    places = placed.groupBy("sig").agg(F.count_if("rest").alias("nx"), F.count("*").alias("ny"), *hashes).filter("nx > 0 and ny > 1")
    places = places.groupBy("h1", "h2", "ny").agg(F.min("sig").alias("sig")).select("sig")
    rows = stored(placed.join(places, "sig", "left_semi"), "unlinked")
    hopeful = _hopeful(rows, texts, percent).select(F.col("pivot").alias("sig"), "node", "component", "rest").distinct()
    hopeful = stored(hopeful, "hopeful")
    dropped(rows)
    tasks = _grid(hopeful, texts.select("node", "text"), BLOCK_NODES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])
        found: list[tuple[int, int]] = []

        def close() -> None:
            probes, held = sides
            done = set()
            if probes and held:
                for x, y in PrefixTree([s for _, _, s in held]).overlaps_many([s for _, _, s in probes], percent):
                    (a, ca, _), (b, cb, _) = probes[x], held[y]
                    if ca != cb and (ca, cb) not in done:  # one link joins two classes
                        done.add((ca, cb))
                        found.append((a, b))

        for batch in batches:
            sig, i, j, side, node, component = (batch.column(c).to_pylist() for c in range(6))
            for row, s in _sets(batch, 6, k):
                if (now := (sig[row], i[row], j[row])) != key:
                    close()
                    key, sides = now, ([], [])
                sides[side[row]].append((node[row], component[row], s))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=["a", "b"])
            found.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=["a", "b"])

    links = stored(tasks.mapInArrow(run, "a long, b long"), "links")
    dropped(hopeful)
    return links


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes that link. A pivot with many partners is joined with them in blocks."""
    members = pairs.join(texts.withColumnRenamed("node", "b"), "b")
    sizes = members.groupBy("a").agg(F.sum(F.length("text") + 64).alias("bytes")).select("a", F.ceil(F.col("bytes") / BLOCK_BYTES).alias("blocks"))
    blocks = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"))
    pivots = blocks.join(texts.withColumnRenamed("node", "a"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "text")
    salted = members.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), "b", "text")
    rows = pivots.unionByName(salted).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, probe, sets, names = None, None, [], []
        out_a: list[int] = []
        out_b: list[int] = []

        def close() -> None:
            for i, _ in PrefixTree(sets).overlaps(probe, percent):
                out_a.append(key[0])
                out_b.append(names[i])

        for batch in batches:
            a, block, b = (batch.column(i).to_pylist() for i in range(3))
            for i, s in _sets(batch, 3, k):
                if (a[i], block[i]) != key:
                    if sets:
                        close()
                    key, probe, sets, names = (a[i], block[i]), s, [], []
                else:
                    sets.append(s)
                    names.append(b[i])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
                out_a.clear(), out_b.clear()
        if sets:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def ngram_classes(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of each row of ``docs``.

    Two rows link when 100 * intersection >= ``percent`` * union of their sets of distinct ``k``-word shingles (of a
    text with fewer words the whole sequence as one). ``component_id`` is the smallest id that is reachable by links, itself
    included. A null or empty text, or one without words, has no shingles and links with nothing. Repeated rows link with each
    other. Rows with a null id take part; theirs is never the smallest one, and a class of such rows only has a null.
    No rows give no rows; further columns aren't read.
    """
    nodes = stored(_nodes(docs, k, id_col, text_col), "nodes")
    met = stored(_meetings(_dealt(docs, k, percent, text_col)), "met")
    involved = stored(met.select("node").distinct(), "involved")
    texts = stored(_texts(docs, involved, k, text_col), "texts")
    dropped(involved)
    first = met.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    first = stored(_plausible(first, texts, percent), "pairs")
    links = stored(_verified(first, texts.select("node", "text"), k, percent), "links")
    dropped(first)
    classes = stored(components(links), "classes")

    # Those that meet in one place and aren't in one class yet.
    of_node = met.filter("node <> pivot").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_pivot = classes.select(F.col("node").alias("pivot"), F.col("component").alias("pivot_component"))
    rest = F.col("component") != F.coalesce("pivot_component", "pivot")
    placed = stored(of_node.join(of_pivot, "pivot", "left").select("sig", "pivot", "node", "component", rest.alias("rest")), "placed")
    dropped(met)
    links2 = _met_unlinked(placed, texts, k, percent)
    dropped(placed)
    dropped(texts)
    if links2.take(1):
        before, classes = classes, stored(components(links.unionByName(links2)), "classes")
        dropped(before)
    dropped(links)
    dropped(links2)

    smallest = nodes.dropna(subset=["node"]).groupBy("node").agg(F.min(id_col).alias("least"))
    joined = smallest.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    label = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    lookup = joined.join(label, "component").select("node", "component_id")
    found = salted_lookup(nodes, lookup, "node", [id_col])
    return found.select(id_col, "n_shingles", F.when(F.col("node").isNull(), F.col(id_col)).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: that whose id is the class's; rows without a class of their own stay."""
    classes = ngram_classes(docs, k=k, percent=percent, id_col=id_col, text_col=text_col)
    gone = classes.filter(F.col(id_col) != F.col("component_id")).select(id_col)
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
