"""Alignment of two tokenizers over the same texts, as an Arrow pipeline within Spark's tasks.

Both tokenizers' ids of some texts are lists; these are flattened beside their parents' indices, sizes in bytes are looked up,
and segmented cumulative sums give where each token ends. A hash join (Acero) on (document, end) finds the ends
that both have: these are the links, and cut both sides into groups. The links' id pairs are counted by ``Table.group_by`` within a
task, and Spark merges these partial counts.

For what a document's links are worth in the whole corpus, each slice of texts keeps its (pair, document, times), packed in
buckets of pairs. A bucket's merged counts go ahead of the slices' packs in the same shuffle, to each of a few salts, so no task holds more than
one bucket's counts and one pack, and nothing passes through the driver.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm._store import stored
from saltmarsh.llm._text import give_back, pack, unpack
from saltmarsh.llm.sentencepiece_codec import BYTE, MARK, MODEL, Model, _no_cycles, model_bytes

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
SLICE = 2 << 20  # bytes of text that are aligned at a time, or one text
PAIRS = 1 << 21  # distinct pairs that a task counts before it hands them on
PACKED = 1 << 20  # pairs in a pack of merged counts
BUCKET_BITS = 4
SALTS = 1024  # of a bucket, at most
_WIDE = 20  # bits of a second tokenizer's id
_PERM_BITS = 40
_ODD = np.uint64(0x9E3779B97F)
_PERM = np.uint64((1 << _PERM_BITS) - 1)
_DOC = np.uint64((1 << (64 - _PERM_BITS)) - 1)
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: how byte-level tokenizers split


def _bytes_of_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _filled(by_id: dict[int, bytes]) -> pa.Array:
    return pa.array([by_id.get(i, b"") for i in range(max(by_id) + 1)], pa.large_binary())


class ByteLevel:
    """A byte-level BPE file of the tokenizers library, encoded without special tokens.

    Where the ids are the merges' ranks and nothing but the usual splitting comes before, the faster tiktoken library gives the
    same ids; it can't take long runs of white space, so texts with these, and other files, go through the tokenizers library.
    """

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        said = json.loads(content)
        letters = _bytes_of_letters()
        vocab, merges = said["model"]["vocab"], said["model"]["merges"]
        tokens = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.slow = Tokenizer.from_str(content.decode())
        self.slow.encode_special_tokens = True
        self.fast = None
        before = said.get("pre_tokenizer") or {}
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not said.get("normalizer")
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        if usual and len(tokens) == len(vocab) and [vocab[m] for m in joined] == list(range(256, 256 + len(joined))):
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=_PIECES, mergeable_ranks={t: i for i, t in tokens.items()}, special_tokens={})
        self.bytes = _filled(tokens)
        self.long_space = re.compile(r"\s{500}")

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.fast:
            return [e.ids for e in self.slow.encode_batch_fast(texts, add_special_tokens=False)]
        return [self.slow.encode(x, add_special_tokens=False).ids if self.long_space.search(x) else self.fast.encode_ordinary(x) for x in texts]


class Pieces:
    """A SentencePiece file."""

    def __init__(self, content: bytes):
        import sentencepiece

        model = Model(content)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=content)
        each = zip(model.pieces, model.types, strict=True)
        self.bytes = _filled({i: bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() for i, (p, t) in enumerate(each)})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)


class Tokens:
    """The tokens of some texts, flat: ids, their text's index, and the byte behind each one's last."""

    def __init__(self, ids: list[list[int]], vocab: pa.Array, sizes: pa.Array):
        lists = pa.array(ids, pa.large_list(pa.int32()))
        self.ids, self.parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
        upto = pc.cumulative_sum(sizes.take(self.ids))
        bounds = lists.offsets
        before = pa.concat_arrays([pa.array([0], pa.int64()), upto]).take(bounds)
        self.ends = pc.subtract(upto, before.take(self.parent))
        joined = vocab.take(self.ids)
        self.joined = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, before.buffers()[1], joined.buffers()[2] or pa.py_buffer(b"")])

    def keep(self, rows: pa.Array) -> None:
        """Only the tokens of these texts."""
        if not pc.all(rows).as_py():
            mask = rows.take(self.parent)
            self.ids, self.parent, self.ends = (x.filter(mask) for x in (self.ids, self.parent, self.ends))

    def keys(self) -> pa.Array:
        return pc.bit_wise_or(pc.shift_left(self.parent.cast(pa.int64()), pa.scalar(32, pa.int64())), self.ends)


class Aligned:
    """Both tokenizers' tokens of some texts, and their links: places of the first's tokens and of the second's that end together, in order."""

    def __init__(self, texts: pa.Array, pair: Pair):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        self.n = len(texts)
        with _no_cycles():
            spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
            self.a = Tokens(pair.first.encode(spaced.to_pylist()), pair.first.bytes, pair.a_sizes)
            self.b = Tokens(pair.second.encode(texts.to_pylist()), pair.second.bytes, pair.b_sizes)
        wanted = spaced.cast(pa.large_binary())
        good = pc.and_(pc.equal(self.a.joined, wanted), pc.equal(self.b.joined, wanted))
        good = pc.and_(good, pc.greater(pc.binary_length(texts), 0))
        for side in (self.a, self.b):
            del side.joined
            side.keep(good)
        left = pa.table({"end": self.a.keys(), "a": self.a.ids, "at_a": np.arange(len(self.a.ids))})
        right = pa.table({"end": self.b.keys(), "b": self.b.ids, "at_b": np.arange(len(self.b.ids))})
        self.links = left.join(right, "end", join_type="inner", use_threads=False).sort_by("at_a").combine_chunks()
        self.at_a, self.at_b = (self.links.column(x).to_numpy() for x in ("at_a", "at_b"))
        self.rows = (self.links.column("end").to_numpy() >> 32).astype(np.int64)

    def counts(self, parent: pa.Array | np.ndarray) -> np.ndarray:
        return np.bincount(np.asarray(parent), minlength=self.n).astype(np.int64)

    def told(self, pair: Pair) -> list[str]:
        """SHA-256 of each text's groups as text; empty without tokens."""
        n_a, n_b = len(self.a.ids), len(self.b.ids)
        ends_a, ends_b = np.zeros(n_a, bool), np.zeros(n_b, bool)
        ends_a[self.at_a] = ends_b[self.at_b] = True
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b  # which group each token is in
        upto_a, upto_b = np.append(0, self.at_a + 1), np.append(0, self.at_b + 1)
        last = np.zeros(n_b, bool)  # a text's last token
        parent = self.b.parent.to_numpy()
        last[:-1] = parent[1:] != parent[:-1]
        last[-1:] = True
        codes = np.empty(n_a + n_b, np.int32)
        size_a, size_b = len(pair.first.bytes), len(pair.second.bytes)
        codes[np.arange(n_a) + upto_b[group_a]] = self.a.ids.to_numpy() + ends_a * np.int32(size_a)
        codes[np.arange(n_b) + upto_a[group_b + 1]] = self.b.ids.to_numpy() + np.int32(2 * size_a) + (ends_b.astype(np.int32) + last) * np.int32(size_b)
        strings = pair.strings.take(pa.array(codes))
        offsets = np.frombuffer(strings.buffers()[1], np.int64)[: len(codes) + 1] if len(codes) else np.zeros(1, np.int64)
        data = memoryview(strings.buffers()[2] or b"")
        cuts = offsets[np.append(0, np.cumsum(self.counts(self.a.parent) + self.counts(self.b.parent)))].tolist()
        return [hashlib.sha256(data[x:y]).hexdigest() if y > x else "" for x, y in zip(cuts, cuts[1:], strict=False)]

    def groups(self) -> pa.Array:
        """Each text's groups: first and last byte (exclusive) of space and text, and both sides' ids."""
        cut = lambda at: pa.array(np.append(0, at + 1).astype(np.int32))
        ends = self.links.column("end").to_numpy() & 0xFFFFFFFF
        first = np.append(True, self.rows[1:] != self.rows[:-1])[: len(self.rows)]
        starts = np.where(first, 0, np.append(0, ends[:-1])[: len(ends)])
        a, b = pa.ListArray.from_arrays(cut(self.at_a), self.a.ids), pa.ListArray.from_arrays(cut(self.at_b), self.b.ids)
        structs = pa.StructArray.from_arrays([pa.array(starts.astype(np.int64)), pa.array(ends.astype(np.int64)), a, b], names=["start", "end", "a_ids", "b_ids"])
        bounds = np.append(0, np.cumsum(self.counts(self.rows)))
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), structs)

    def pairs(self) -> np.ndarray:
        """The id pair of each link as one number."""
        return (self.links.column("a").to_numpy().astype(np.int64) << _WIDE) | self.links.column("b").to_numpy()


class Pair:
    """Two tokenizers, with what is looked up by id."""

    def __init__(self, first: bytes, second: bytes):
        self.first, self.second = ByteLevel(first), Pieces(second)
        if len(self.first.bytes) >= 1 << _WIDE or len(self.second.bytes) >= 1 << _WIDE:
            raise ValueError(f"vocabularies of {1 << _WIDE} ids or more")
        self.a_sizes, self.b_sizes = (pc.binary_length(x).cast(pa.int64()) for x in (self.first.bytes, self.second.bytes))
        marked = [f"{i}{mark}" for n, marks in ((len(self.first.bytes), ",|"), (len(self.second.bytes), [",", ";", ""])) for mark in marks for i in range(n)]
        self.strings = pa.array(marked, pa.large_string())


@lru_cache(2)
def _pair(first: bytes, second: bytes) -> Pair:
    return Pair(first, second)


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with some text each, or with one long text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE, prepend=-1, append=-1))
        for at, end in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(at, end - at)


def _permuted(pairs: np.ndarray) -> np.ndarray:
    """The same pairs as numbers of 40 bits in which any range holds a like share of the pairs."""
    with np.errstate(over="ignore"):
        return (pairs.astype(np.uint64) * _ODD) & _PERM


_ROWS = "kind int, row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pair long, bucket int, n long, data binary"
_DOCUMENT, _COUNT, _PACK = 0, 1, 2


def _batch(kind: int, length: int, **columns: pa.Array) -> pa.RecordBatch:
    types = {"kind": pa.int32(), "bucket": pa.int32(), "groups_sha256": pa.string(), "data": pa.binary()}
    names = [x.split()[0] for x in _ROWS.split(", ")]
    columns["kind"] = pa.array(np.full(length, kind, np.int32))
    return pa.RecordBatch.from_arrays([columns[x] if x in columns else pa.nulls(length, types.get(x, pa.int64())) for x in names], names=names)


def _packs(aligned: Aligned, first_row: int) -> pa.RecordBatch | None:
    """(pair, text, times) of a slice's links, packed by bucket."""
    if not len(aligned.rows):
        return None
    key = np.sort((_permuted(aligned.pairs()) << np.uint64(64 - _PERM_BITS)) | aligned.rows.astype(np.uint64))
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    times, key = np.diff(np.append(new, len(key))), key[new]
    perm, doc = key >> np.uint64(64 - _PERM_BITS), (key & _DOC).astype(np.int64)
    bucket = (perm >> np.uint64(_PERM_BITS - BUCKET_BITS)).astype(np.int32)
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    data = [pack([perm[x:y], doc[x:y], times[x:y]]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    n = len(data)
    return _batch(_PACK, n, row=pa.array(np.full(n, first_row)), bucket=pa.array(bucket[cuts[:-1]]), n=pa.array(np.diff(cuts)), data=pa.array(data, pa.binary()))


def _summed(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])


def _first_pass(docs: DataFrame, first: bytes, second: bytes, id_col: str, text_col: str) -> DataFrame:
    """Rows of three kinds: documents, partial counts of pairs, packs of a slice's links."""
    held = docs.sparkSession.sparkContext.broadcast((first, second))  # the files' contents: a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*held.value)
        row, parts, size = TaskContext.get().partitionId() << 40, [], 0
        for part in _slices(batches, 1):
            now = Aligned(part.column(1), pair)
            n_links = now.counts(now.rows)
            rows = row + np.arange(part.num_rows)
            counts = {"n_a": now.counts(now.a.parent), "n_b": now.counts(now.b.parent), "n_groups": n_links}
            yield _batch(_DOCUMENT, part.num_rows, row=pa.array(rows), doc_id=part.column(0), groups_sha256=pa.array(now.told(pair), pa.string()), **{k: pa.array(v) for k, v in counts.items()})
            packs = _packs(now, row)
            if packs:
                yield packs
                few = pa.table({"pair": now.pairs()}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "n"])
                parts.append(few)
                size += few.num_rows
                if size > 2 * PAIRS:
                    parts = [_summed(parts)]
                    size = parts[0].num_rows
            if size > PAIRS and len(parts) == 1:
                yield from _counted(parts)
                parts, size = [], 0
            row += part.num_rows
        if parts:
            yield from _counted([_summed(parts)])
        give_back()

    def _counted(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        for b in parts[0].combine_chunks().to_batches(max_chunksize=1 << 16):
            yield _batch(_COUNT, b.num_rows, pair=b.column(0), n=b.column(1))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _ROWS)


def _count_packs(counts: DataFrame) -> DataFrame:
    """(bucket, n, data): the merged counts of each bucket's pairs, and whether each is its second id's highest."""
    shift = _PERM_BITS - BUCKET_BITS

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            perm = _permuted(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array((perm >> np.uint64(shift)).astype(np.int32)), pa.array(perm.astype(np.int64)), *batch.columns[1:]], names=["bucket", "perm", "n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def given() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            bucket, perm, n, best = (whole.column(i).to_numpy() for i in range(4))
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            data = [pack([perm[x:y], n[x:y], best[x:y]]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(np.diff(cuts)), pa.array(data, pa.binary())], names=["bucket", "n", "data"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= PACKED:
                yield from given()
                held = []
        if held:
            yield from given()
        give_back()

    dealt = counts.select("pair", "n", F.col("best").cast("int")).mapInArrow(permute, "bucket int, perm long, n long, best int")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "perm").mapInArrow(run, "bucket int, n long, data binary")


def _worth(links: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) of each document, summed over the buckets."""
    salts = min(SALTS, links.filter("bucket = 0").count() // 64 + 1)
    salt = F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")
    packs = links.select("bucket", salt.alias("salt"), F.lit(1).alias("side"), "row", "n", "data")
    ahead = _count_packs(counts).select("bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("row"), "n", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, known = None, [], None
        for batch in batches:
            for bucket, salt, side, row, n, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (bucket, salt) != now:
                    now, parts, known = (bucket, salt), [], None
                if side == 0:
                    parts.append(unpack(data, n, 3))
                    continue
                if known is None:
                    known = [np.concatenate(x) for x in zip(*parts, strict=True)]
                    order = np.argsort(known[0])
                    known, parts = [x[order] for x in known], []
                perm, doc, times = unpack(data, n, 3)
                at = np.searchsorted(known[0], perm)
                total, best = np.zeros(int(doc.max()) + 1, np.int64), np.zeros(int(doc.max()) + 1, np.int64)
                np.add.at(total, doc, times * known[1][at])
                np.add.at(best, doc, times * known[2][at])
                docs = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(row + docs), pa.array(best[docs]), pa.array(total[docs])], names=["row", "n_best", "count_sum"])
        give_back()

    met = packs.unionByName(ahead).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "side")
    return met.mapInArrow(run, "row long, n_best long, count_sum long").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def _merged(partial: DataFrame) -> DataFrame:
    """(pair, n): how many links hold each pair, over all tasks."""
    return partial.filter(F.col("kind") == _COUNT).groupBy("pair").agg(F.sum("n").alias("n"))


def alignment_counts(docs: DataFrame, first: bytes, second: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document how two tokenizers' tokens meet, and what its links are worth in the corpus.

    ``first``: a byte-level BPE file of the tokenizers library, for a space and the text; ``second``: a SentencePiece file, for the text. A link is
    a token of each that end at one byte; links cut both into groups. Returns ``doc_id``, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``, ``n_best`` (links of
    a pair that no other pair of its second id outnumbers in the corpus), ``count_sum`` (how often the corpus links the pair, over links) and ``groups_sha256``.

    A null or empty text, and one whose tokens don't give back its bytes (a model that normalises, an unknown character), has no tokens: zeros and ''. Special
    tokens' strings in a text are plain text. Rows with a null id, and rows that repeat, each count and stay. Very long texts are encoded whole. An empty table gives no rows. Other columns aren't read.
    """
    seen = stored(_first_pass(docs, first, second, id_col, text_col), "aligned")
    counts = stored(_merged(seen), "pairs")
    second_id = F.col("pair").bitwiseAND(F.lit((1 << _WIDE) - 1))
    highest = counts.groupBy(second_id.alias("b")).agg(F.max("n").alias("most"))  # one row for each id of the second vocabulary: less than 2**20
    counts = counts.withColumn("b", second_id).join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    worth = _worth(seen.filter(F.col("kind") == _PACK), counts)
    rows = seen.filter(F.col("kind") == _DOCUMENT).select("row", "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups_sha256")
    nothing = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return rows.join(worth, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", nothing("n_best"), nothing("count_sum"), "groups_sha256")


def pair_counts(docs: DataFrame, first: bytes, second: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a_id, b_id, n): how often tokens of both tokenizers end together, over all documents."""
    merged = _merged(_first_pass(docs, first, second, id_col, text_col))
    return merged.select(F.shiftright("pair", _WIDE).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << _WIDE) - 1)).cast("int").alias("b_id"), "n")


def token_groups(docs: DataFrame, first: bytes, second: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, groups): of each document its groups (start, end: bytes of space and text; a_ids, b_ids), in order; none without tokens."""
    held = docs.sparkSession.sparkContext.broadcast((first, second))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), Aligned(part.column(1), _pair(*held.value)).groups()], names=[id_col, "groups"])
        give_back()

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, groups array<struct<start:long,end:long,a_ids:array<int>,b_ids:array<int>>>"
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def aligned_documents(docs: DataFrame, first_path: str = BYTE_LEVEL, second_path: str = MODEL) -> DataFrame:
    """``alignment_counts`` with tokenizers by path."""
    spark = docs.sparkSession
    return alignment_counts(docs, model_bytes(spark, first_path), model_bytes(spark, second_path))
