"""WARC archives: writing with segments and chunked framing, reading back, and reassembly.

A record whose block is longer than ``segment_bytes`` is written as a first segment and
continuation records (``WARC-Segment-Number``, ``WARC-Segment-Origin-ID``, and
``WARC-Segment-Total-Length`` in the last one). Reading groups the segments by their origin,
orders them by number, checks the total length and undoes the chunked transfer framing.

Archives are written by Spark's text sink, one record a row, with the record's end
(CR LF CR LF) as separator, and read as binary files, so any store that Spark reaches will do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.llm._salted import with_group_values

END = b"\r\n\r\n"
CHUNK = 8192
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"

RECORD = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("intact", T.BooleanType()),
    ]
)
SEGMENT = T.StructType(
    [
        T.StructField("origin", T.StringType()),
        T.StructField("number", T.IntegerType()),
        T.StructField("total", T.LongType()),
        T.StructField("head", T.BinaryType()),
        T.StructField("block", T.BinaryType()),
    ]
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(data: bytes, size: int = CHUNK) -> bytes:
    """Frame ``data`` for chunked transfer."""
    parts = []
    for at in range(0, len(data), size):
        part = data[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(data: bytes) -> tuple[bytes, bool]:
    """Undo chunked framing; false if the framing is broken or ends early (what came before is kept)."""
    parts, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            return b"".join(parts), False
        try:
            size = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            return b"".join(parts), False
        if not size:
            return b"".join(parts), True
        part = data[end + 2 : end + 2 + size]
        parts.append(part)
        at = end + 4 + size
        if len(part) < size or data[at - 2 : at] != b"\r\n":
            return b"".join(parts), False


def _head(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{k}: {str(v).translate({10: '%0A', 13: '%0D'})}" for k, v in fields if v is not None]
    return "\r\n".join(["WARC/1.1", *lines]).encode() + END


def _records(source: str | None, url: str | None, kind: str, refers: str | None, payload: bytes, segment_bytes: int) -> Iterator[bytes]:
    """One page's records, without the separator that ends each."""
    name = f"<urn:uuid:{uuid.uuid4()}>"
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    fields = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("X-Source-ID", source)]
    digest = ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload))
    mime = ("Content-Type", "application/http; msgtype=response")
    if kind == "revisit":
        block = f"{http}Content-Length: {len(payload)}\r\n\r\n".encode()
        yield _head([("WARC-Type", kind), *fields, ("WARC-Profile", PROFILE), ("X-Refers-To-Source-ID", refers), digest, mime, ("Content-Length", len(block))]) + block
        return
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
    pieces = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    number = [("WARC-Segment-Number", 1)] if len(pieces) > 1 else []
    yield _head([("WARC-Type", kind), *fields, *number, digest, mime, ("Content-Length", len(pieces[0]))]) + pieces[0]
    for k, piece in enumerate(pieces[1:], 2):
        total = [("WARC-Segment-Total-Length", len(block))] if k == len(pieces) else []
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE)]
        yield _head([*own, ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), *total, ("Content-Length", len(piece))]) + piece


def write_warc(
    df: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    segment_bytes: int = 1 << 16,
    records_per_file: int = 5000,
) -> None:
    """Write a gzipped WARC archive with a record for each row.

    The payload is the text in UTF-8 (null: empty). Of rows with equal payloads of at least
    ``min_bytes`` bytes, those with the largest id are ``response`` records and the others
    ``revisit`` records without a payload; smaller payloads are all ``response``. A null id is
    below all others; where all ids of a group are null, all of it is ``response``.
    """
    text = F.coalesce(F.col(payload_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text.alias("payload"), F.sha1(text.cast("binary")).alias("digest"))
    rows = with_group_values(rows, ["digest"], {"newest": ("max", F.col("id"))}, ["id", "url"])
    kept = (F.octet_length("payload") < min_bytes) | F.col("newest").isNull() | F.col("id").eqNullSafe(F.col("newest"))
    rows = rows.select(
        F.col("id").cast("string").alias("id"),
        "url",
        "payload",
        F.when(kept, "response").otherwise("revisit").alias("kind"),
        F.when(~kept, F.col("newest").cast("string")).alias("refers"),
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for source, url, payload, kind, refers in batch.itertuples(index=False, name=None):
                for record in _records(source, url, kind, refers, payload.encode(), segment_bytes):
                    held.append(record)
                    size += len(record)
                if size > 1 << 22:
                    yield pd.DataFrame({"record": held})
                    held, size = [], 0
            yield pd.DataFrame({"record": held})

    written = rows.mapInPandas(write, "record binary").select(F.col("record").cast("string").alias("value"))
    # The cast keeps the bytes as they are, also where a segment ends inside a character.
    written.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """The records of an archive: fields, head, block. Reading ends at a place that is no record."""
    at = 0
    while data[at : at + 5] == b"WARC/":
        end = data.find(END, at)
        if end < 0:
            return
        head = data[at:end]
        fields = _fields(head)
        try:
            size = int(fields["content-length"])
        except (KeyError, ValueError):
            return
        yield fields, head, data[end + 4 : end + 4 + size]
        at = end + 4 + size
        while data[at : at + 2] == b"\r\n":
            at += 2


def _record(fields: dict[str, str], block: bytes, whole: bool, with_payload: bool) -> tuple:
    """A row of RECORD, from the block put together."""
    http, _, body = block.partition(END)
    inner = _fields(http)
    kind = fields.get("warc-type")
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    own = (fields.get("x-source-id"), fields.get("warc-target-uri"), kind, fields.get("x-refers-to-source-id"))
    if kind == "revisit":
        size = inner.get("content-length", "")
        return (*own, int(size) if size.isdigit() else None, stated, None, whole)
    if inner.get("transfer-encoding", "").lower() == "chunked":
        body, ended = unchunked(body)
        whole = whole and ended
    digest = sha1_base32(body)
    return (*own, len(body), digest, body if with_payload else None, whole and stated in (None, digest))


def _frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=schema.names, dtype=object)


def read_warc(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """Read an archive: a row for each response or revisit record, in no order.

    ``payload_bytes`` and ``payload_digest`` (SHA-1, base32) are those of the full payload; for
    revisits, which hold no payload, as the record states them. ``intact`` is false if a segment
    is missing or repeated, the stated total length or digest differs, or chunked framing is broken. Other
    record types (warcinfo, request, metadata) aren't returned. An empty archive gives no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
        for batch in batches:
            for content in batch["content"]:
                yield from _parse(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for fields, _, block in blocks(batches):
            if fields.get("warc-type") in ("response", "revisit") and "warc-segment-number" not in fields:
                rows.append(_record(fields, block, True, with_payload))
                size += len(block) * with_payload + 200
                if size > 1 << 22:
                    yield _frame(rows, RECORD)
                    rows, size = [], 0
        yield _frame(rows, RECORD)

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for fields, head, block in blocks(batches):
            if "warc-segment-number" in fields and fields.get("warc-type") in ("response", "continuation"):
                first = fields.get("warc-type") != "continuation"
                origin = fields.get("warc-record-id") if first else fields.get("warc-segment-origin-id")
                total = fields.get("warc-segment-total-length")
                rows.append((origin, int(fields["warc-segment-number"]), int(total) if total else None, head if first else None, block))
                size += len(block)
                if size > 1 << 22:
                    yield _frame(rows, SEGMENT)
                    rows, size = [], 0
        yield _frame(rows, SEGMENT)

    def put_together(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("number")
        heads = [x for x in group["head"] if x is not None]
        if not heads:  # continuations without their first segment
            return _frame([], RECORD)
        totals = [int(x) for x in group["total"] if pd.notna(x)]
        block = b"".join(group["block"])
        complete = list(group["number"]) == list(range(1, len(group) + 1)) and totals == [len(block)]
        return _frame([_record(_fields(heads[0]), block, complete, with_payload)], RECORD)

    # A group is one record, whose length its page sets.
    joined = files.mapInPandas(segments, SEGMENT).groupBy("origin").applyInPandas(put_together, RECORD)
    return files.mapInPandas(whole, RECORD).unionByName(joined)
