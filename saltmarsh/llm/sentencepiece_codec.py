"""SentencePiece models on the tokenizers library: encoding and decoding of whole texts.

The model file (a protobuf message) is parsed here: pieces with scores and types, the trainer's
model type and byte fallback, the normaliser's settings. From these the same model is rebuilt with
the tokenizers library: normaliser, white space marker, unigram scores (or, of a BPE model, merges
ordered by score) and byte fallback.

No piece of a usual model has the white space marker behind another character, so a merge never
crosses from a character to a marker behind it. A text is then encoded in units of a run of spaces
and the characters up to the next one; equal units are encoded once for many texts, in multithreaded
batches, and compared with what the SentencePiece library gives for them. Where a model has such pieces,
or isn't BPE, the unit is the whole text. A text's ids are decoded as a whole.
"""

from __future__ import annotations

import gc
import os
import re
import struct
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.llm._text import give_back, text_buffers

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNITS = 250_000  # units that a task keeps encoded; beyond it, those of the texts at hand
SLICE = 2 << 20  # bytes of text that are encoded at a time, or one text
ROWS = 256  # rows that are decoded at a time
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _message(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """Fields of a protobuf message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        elif kind == 5:
            yield key >> 3, struct.unpack("<f", data[at : at + 4])[0]
            at += 4
        elif kind == 1:
            yield key >> 3, struct.unpack("<d", data[at : at + 8])[0]
            at += 8
        else:
            raise ValueError(f"not a protobuf message: wire type {kind}")


class Model:
    """What a model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer: dict[int, int | float | bytes] = {}
        normaliser: dict[int, int | float | bytes] = {}
        for number, value in _message(data):
            if number == 1:
                piece = dict(_message(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(float(piece.get(2, 0.0)))
                self.types.append(int(piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_message(value))
            elif number == 3:
                normaliser = dict(_message(value))
        self.kind = int(trainer.get(3, UNIGRAM))
        self.byte_fallback = bool(trainer.get(35, 0))
        self.suffix_mark = bool(trainer.get(24, 0))
        self.charsmap = normaliser.get(2, b"")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.trim_spaces = bool(normaliser.get(4, 1))
        self.unknown = self.types.index(UNKNOWN)
        if self.kind not in (UNIGRAM, BPE) or self.suffix_mark:
            raise ValueError("only unigram and BPE models with a prefix marker are supported")

    @property
    def by_units(self) -> bool:
        """Whether a text may be encoded in units that begin with white space."""
        plain = (p for p, t in zip(self.pieces, self.types, strict=True) if t in (NORMAL, USER))
        return self.kind == BPE and self.dummy_prefix and not self.charsmap and not self.trim_spaces and not any(re.search(f"[^{MARK}]{MARK}", p) for p in plain)


def build(model: Model):
    """The same model in the tokenizers library."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if model.kind == UNIGRAM:
        core = models.Unigram(list(zip(model.pieces, model.scores, strict=True)), model.unknown, model.byte_fallback)
    else:
        ids = {p: i for i, p in enumerate(model.pieces)}
        plain = {p for p, t in zip(model.pieces, model.types, strict=True) if t in (NORMAL, USER)}
        merges = []
        for piece in plain:
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in plain and right in plain:
                    merges.append((-model.scores[ids[piece]], ids[piece], ids[left], ids[right], left, right))
        core = models.BPE(ids, [x[4:] for x in sorted(merges)], unk_token=model.pieces[model.unknown], fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trim_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if model.dummy_prefix else []
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence([*undo, decoders.Strip(" ", 1, 0)] if model.dummy_prefix else undo)
    own = [AddedToken(p, normalized=False) for p, t in zip(model.pieces, model.types, strict=True) if t == USER]
    if own:
        tokenizer.add_tokens(own)
    return tokenizer


class Codec:
    """Encodes and decodes texts, and compares with the SentencePiece library."""

    def __init__(self, data: bytes, threads: int = 2):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        self.model = Model(data)
        self.tokenizer = build(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.by_units = self.model.by_units
        self.forget()

    def forget(self) -> None:
        """Keep no encoded units."""
        self.index: dict[str, int] = {}
        self.ids, self.starts, self.sizes, self.same = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _keep(self, units: list[str], places: np.ndarray) -> None:
        """Keep only these encoded units."""
        counts = self.sizes[places]
        ends = np.cumsum(counts)
        self.ids = self.ids[np.arange(counts.sum()) + np.repeat(self.starts[places] - ends + counts, counts)]
        self.starts, self.sizes, self.same = ends - counts, counts, self.same[places]
        self.index = dict(zip(units, range(len(units)), strict=True))

    def _learn(self, units: list[str]) -> None:
        """Encode new units. One begins with a space, which the prepended marker stands for."""
        texts = [x[1:] for x in units] if self.by_units else units
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        expected = self.reference.encode(texts, num_threads=1)
        same = [got == want or (self.by_units and not t) for got, want, t in zip(found, expected, texts, strict=True)]
        self.same = np.append(self.same, np.array(same, bool))
        if self.by_units:  # the marker isn't prepended to an empty text
            lone = self.tokenizer.token_to_id(MARK)
            found = [x if t else [lone] for x, t in zip(found, texts, strict=True)]
        self.index.update(zip(units, range(len(self.index), len(self.index) + len(units)), strict=True))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(found), np.int32))

    def _units(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct units, which of them stand in the texts one after the other, and the bounds of each text's."""
        space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        full = pc.not_equal(pc.binary_length(texts), 0)
        if not self.by_units:
            found = texts.filter(full).dictionary_encode()
            return found.dictionary.to_pylist(), found.indices.to_numpy(), np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
        data, offsets = text_buffers(pc.if_else(full, pc.binary_join_element_wise(space, texts, none), none))
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        is_space = data == 32
        begins = is_space.copy()
        begins[1:] &= ~is_space[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        cuts = np.append(starts, len(data))
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        return found.dictionary.to_pylist(), found.indices.to_numpy(), np.searchsorted(starts, offsets)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the bounds of each text's ids, whether each unit's equal what SentencePiece gives, and whether they decode to the text."""
        column = column.cast(pa.large_string())
        units, which, rows = self._units(column)
        places = np.fromiter(map(self.index.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(places < 0)
        if len(new):
            if len(self.index) + len(new) > UNITS:  # those of these texts stay
                old = np.flatnonzero(places >= 0)
                self._keep([units[i] for i in old], places[old])
                places[old] = np.arange(len(old))
            places[new] = len(self.index) + np.arange(len(new))
            self._learn([units[i] for i in new])
        at = places[which]
        counts = self.sizes[at]
        ends = np.cumsum(counts)
        ids = self.ids[np.arange(counts.sum()) + np.repeat(self.starts[at] - ends + counts, counts)]
        bounds = np.append(0, ends)[rows]
        odd = np.append(0, np.cumsum(~self.same[at]))[rows]
        flat, cuts = ids.tolist(), bounds.tolist()
        decoded = self.decode([flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        back = np.fromiter((a == b for a, b in zip(decoded, column.to_pylist(), strict=True)), bool, len(decoded))
        return ids, bounds, odd[1:] == odd[:-1], back

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def model_bytes(spark: SparkSession, path: str = MODEL) -> bytes:
    """The model file, by Spark's reader or, if only this machine has it, from its disk."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


@contextmanager
def _no_cycles() -> Iterator[None]:
    """Without the search for reference cycles, which many small lists set off again and again and which finds none."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


@lru_cache(2)
def _codec(data: bytes, threads: int) -> Codec:
    return Codec(data, threads)


def encode(df: DataFrame, model: bytes, *, text_col: str = "text", threads: int = 2) -> DataFrame:
    """Add ``ids`` (array of int), ``n_tokens``, ``parity`` and ``round_trip`` to each row.

    ``parity``: the SentencePiece library gives the same ids, unit by unit. ``round_trip``: decoded as a whole,
    they give the text (of a model that normalises the text, or of a text with the marker U+2581 itself, they need not). A null text has null
    ids, no tokens and true in both; an empty text has no ids; a very long text is encoded whole. Rows that repeat stay. Columns of ``df`` of these names are
    replaced; all others stay. ``model`` is the file's content, of a few MB.
    """
    added = [("ids", T.ArrayType(T.IntegerType())), ("n_tokens", T.LongType()), ("parity", T.BooleanType()), ("round_trip", T.BooleanType())]
    df = df.drop(*[n for n, _ in added])
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in added]])
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value, threads)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0).to_numpy().astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE, prepend=-1, append=-1))
            for at, end in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(at, end - at)
                texts = part.column(part.schema.get_field_index(text_col))
                with _no_cycles():
                    ids, bounds, same, back = codec.encode(pc.fill_null(texts, ""))
                offsets = pa.array(bounds.astype(np.int32), mask=np.append(texts.is_null().to_numpy(zero_copy_only=False), False))
                columns = [pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(np.diff(bounds)), pa.array(same), pa.array(back)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *[n for n, _ in added]])
        codec.forget()
        give_back()

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: bytes, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the text that ``ids_col`` stands for; null for null, empty for no ids."""
    df = df.drop(out_col)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value, 2)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = part.column(part.schema.get_field_index(ids_col)).to_pylist()
                texts = codec.decode([[i for i in x or [] if i is not None] for x in ids])
                texts = [None if x is None else t for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out_col])

    return df.mapInArrow(run, schema)


def encoded_documents(spark: SparkSession, docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens, parity and round_trip of each document."""
    return encode(docs.select("doc_id", "text"), model_bytes(spark, model_path)).select(F.col("doc_id"), "ids", "n_tokens", "parity", "round_trip")
