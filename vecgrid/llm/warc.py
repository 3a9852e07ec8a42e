"""WARC archives as a chunked record table.

Writing: one record for each page, payloads over ``segment_bytes`` as a response record and continuation
records. Every record ends with two line ends, so Spark's text writer makes the files with them as line separator:
any file system, gzip, task commit and recovery come from Spark. Reading: lines stream through a parser
in file order and come out as (record, chunk number) rows of at most ``chunk_bytes`` with a running digest; no
record is ever held whole.
"""

from __future__ import annotations

import hashlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecgrid.llm.common import stored

CRLF = "\r\n"
SEGMENT_BYTES, CHUNK_BYTES = 8 << 20, 1 << 16
#: Fixed by RFC 4648.
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
_DATE = "2000-01-01T00:00:00Z"
_ROWS, _BYTES = 512, 16 << 20  # of an output batch

CHUNKS = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("declared_digest", T.StringType()),
        T.StructField("declared_bytes", T.LongType()),
        T.StructField("chunk_no", T.LongType()),
        T.StructField("chunk", T.BinaryType()),
        T.StructField("bytes_so_far", T.LongType()),
        T.StructField("last", T.BooleanType()),
        T.StructField("digest", T.StringType()),
    ]
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a binary column: 20 bits of the hex form make four characters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def plan_records(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """(id, digest, refers_to) of the rows that revisit another: of records with equal payloads of at least ``min_bytes``
    bytes, that with the largest id is the response and the others revisit it.

    Rows are reduced to id, digest and size; equal payloads are aggregated before the shuffle, and the join back is one of
    two scans, which can be split if a third of all pages are equal. Only revisits come out.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).alias("_id"), base32_sha1(payload).alias("_digest"), F.octet_length(payload).alias("_bytes")
    ).filter(F.col("_bytes") >= min_bytes)
    rows = stored(rows, "warc-rows")
    shared = rows.groupBy("_digest", "_bytes").agg(F.max("_id").alias("_first"), F.count(F.lit(1)).alias("n"))
    shared = stored(shared.filter("n > 1 AND _first IS NOT NULL").drop("n"), "warc-shared")
    found = rows.join(shared, ["_digest", "_bytes"]).filter(~F.col("_id").eqNullSafe(F.col("_first")))
    return stored(found.select("_id", "_digest", F.col("_first").alias("_refers")).distinct(), "warc-revisits")


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for NULL; line ends in a value become spaces."""
    line = F.concat(F.lit(f"{name}: "), F.translate(value.cast("string"), "\r\n", "  "), F.lit(CRLF))
    return F.coalesce(line, F.lit(""))


def write(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    uri_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    segment_bytes: int = SEGMENT_BYTES,
) -> None:
    """Write gzip WARC files to folder ``path``, one record (and its continuations) for each row.

    A record's id is ``urn:record:<id>``. NULL payloads are empty, a NULL uri leaves its line out, a NULL id
    is written as an empty one and is never the response that others refer to. Rows that repeat id and payload
    are records of their own. No rows give an archive without records. Other columns are not read.
    """
    revisits = plan_records(pages, id_col, payload_col, min_bytes)
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).alias("_id"),
        F.col(uri_col).cast("string").alias("_uri"),
        payload.alias("_payload"),
        base32_sha1(payload).alias("_digest"),
    )
    # The revisits are a written table, so its true size decides whether payloads need a shuffle at all.
    same = F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_digest") == F.col("_rdigest"))
    found = revisits.select(F.col("_id").alias("_rid"), F.col("_digest").alias("_rdigest"), "_refers")
    rows = rows.join(found, same, "left").drop("_rid", "_rdigest")

    whole = F.octet_length("_payload")
    parts = F.when(F.col("_refers").isNotNull(), F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.ceil(whole / F.lit(segment_bytes)).cast("int"))
    )
    rows = rows.select("*", whole.cast("long").alias("_bytes"), parts.alias("_parts")).select(
        "*", F.explode(F.sequence(F.lit(1), F.col("_parts"))).alias("_part")
    )
    body = F.when(F.col("_refers").isNotNull(), F.lit("").cast("binary")).otherwise(
        F.expr(f"substring(_payload, (_part - 1) * {segment_bytes} + 1, {segment_bytes})")
    )
    name = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    urn = F.concat(F.lit("<urn:record:"), name, F.lit(">"))
    own = F.when(F.col("_part") == 1, urn).otherwise(
        F.concat(F.lit("<urn:record:"), name, F.lit("#"), F.col("_part"), F.lit(">"))
    )
    kind = F.when(F.col("_part") > 1, "continuation").when(F.col("_refers").isNotNull(), "revisit").otherwise("response")
    first, split = F.col("_part") == 1, F.col("_parts") > 1
    http = F.when(first, F.lit(_HTTP)).otherwise(F.lit("")).cast("binary")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header("WARC-Type", kind),
        _header("WARC-Record-ID", own),
        _header("WARC-Date", F.lit(_DATE)),
        _header("WARC-Target-URI", F.col("_uri")),
        _header("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("_digest")))),
        _header("X-Payload-Length", F.when(first, F.col("_bytes"))),
        _header("WARC-Refers-To", F.when(first, F.concat(F.lit("<urn:record:"), F.col("_refers"), F.lit(">")))),
        _header(
            "WARC-Profile",
            F.when(kind == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ),
        _header("WARC-Segment-Number", F.when(split, F.col("_part"))),
        _header("WARC-Segment-Origin-ID", F.when(~first, urn)),
        _header(
            "WARC-Segment-Total-Length",
            F.when(split & (F.col("_part") == F.col("_parts")), F.col("_bytes") + len(_HTTP)),
        ),
        _header("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))),
        _header("Content-Length", F.octet_length(body) + F.octet_length(http)),
        F.lit(CRLF),
    ).cast("binary")
    record = F.concat(head, http, body).cast("string").alias("value")  # bytes as they are
    rows.select(record).write.option("compression", "gzip").option("lineSep", CRLF * 2).text(path)


class _Parser:
    """State machine over the bytes of one file: feed(bytes) gives chunk rows as they become complete."""

    def __init__(self, file: str, chunk_bytes: int):
        self.file, self.size = file, chunk_bytes
        self.line, self.headers = bytearray(), None
        self.left = 0  # bytes of the block still to come
        self.http = False  # inside the HTTP head of a block
        self.held: dict | None = None  # the record whose chunks are being made

    def feed(self, data: bytes) -> Iterator[dict]:
        view, at = memoryview(data), 0
        while at < len(view):
            if self.left and not self.http:
                n = min(self.left, len(view) - at)
                yield from self._payload(view[at : at + n])
                self.left -= n
                at += n
                continue
            end = data.find(b"\n", at)
            stop = len(view) if end < 0 else end + 1
            if self.left:  # a line of the HTTP head never reaches past its block
                stop = min(stop, at + self.left)
                self.left -= stop - at
            self.line += view[at:stop]
            at = stop
            if self.line.endswith(b"\n") or (self.http and not self.left):
                line, self.line = bytes(self.line), bytearray()
                yield from self._line(line)

    def _line(self, line: bytes) -> Iterator[dict]:
        bare = line.rstrip(b"\r\n")
        if self.http:
            self.http = bool(bare) and self.left > 0
        elif self.headers is None:
            if bare.startswith(b"WARC/"):
                self.headers = {}
        elif bare:
            name, _, value = bare.partition(b":")
            self.headers[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
        else:
            h, self.headers = self.headers, None
            yield from self._start(h)

    def _start(self, h: dict[str, str]) -> Iterator[dict]:
        self.left = int(h.get("content-length", "0") or 0)
        if h.get("warc-type") != "continuation":
            yield from self.close()
            digest = h.get("warc-payload-digest", "")
            self.held = {
                "file": self.file,
                "record_id": _bare(h.get("warc-record-id")),
                "record_type": h.get("warc-type"),
                "target_uri": h.get("warc-target-uri"),
                "refers_to": _bare(h.get("warc-refers-to")),
                "declared_digest": digest.removeprefix("sha1:") or None,
                "declared_bytes": int(h["x-payload-length"]) if "x-payload-length" in h else None,
            }
            self.no, self.sum, self.bytes, self.part = 0, hashlib.sha1(), 0, bytearray()
            self.http = self.left > 0 and h.get("content-type", "").startswith("application/http")

    def _payload(self, view: memoryview) -> Iterator[dict]:
        if self.held is None:
            return
        at = 0
        while at < len(view):
            n = min(self.size - len(self.part), len(view) - at)
            self.part += view[at : at + n]
            at += n
            if len(self.part) == self.size:
                yield self._chunk(False)

    def _chunk(self, last: bool) -> dict:
        self.sum.update(self.part)
        self.bytes += len(self.part)
        row = self.held | {
            "chunk_no": self.no,
            "chunk": bytes(self.part),
            "bytes_so_far": self.bytes,
            "last": last,
            "digest": b32encode(self.sum.digest()).decode() if last else None,
        }
        self.no, self.part = self.no + 1, bytearray()
        return row

    def close(self) -> Iterator[dict]:
        """The last chunk of the record at hand: the rest, or an empty one."""
        if self.held is not None:
            yield self._chunk(True)
            self.held = None


def _bare(urn: str | None) -> str | None:
    return None if urn is None else urn.strip("<>").removeprefix("urn:record:")


def read(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of all archives in ``path``; see ``CHUNKS`` for its columns.

    Chunks of a record are numbered from 0; each has the bytes so far, the one with ``last`` the digest of the whole
    payload, computed as the bytes pass by. A record without payload is one empty chunk; continuation records
    carry on the chunks of the record before. The files are gzip, hence read whole, in order, by one task each.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser: _Parser | None = None
        rows: list[dict] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        def made() -> Iterator[dict]:
            nonlocal parser
            for b in batches:
                for line, file in zip(b.column(0), b.column(1), strict=True):
                    name = file.as_py()
                    if parser is None or parser.file != name:
                        if parser is not None:
                            yield from parser.close()
                        parser = _Parser(name, chunk_bytes)
                    yield from parser.feed(line.as_py() + b"\n")
            if parser is not None:
                yield from parser.close()

        for row in made():
            rows.append(row)
            size += len(row["chunk"])
            if len(rows) >= _ROWS or size >= _BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    types = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary(), T.BooleanType(): pa.bool_()}
    arrow = pa.schema([(f.name, types[f.dataType]) for f in CHUNKS])
    return lines.mapInArrow(run, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk, no shuffle: (record_id, record_type, target_uri, refers_to, payload_bytes,
    payload_digest, intact). For a revisit bytes and digest are those declared, of the payload that it stands for; ``intact``
    says whether the payload that was read agrees with what its header declares (NULL for revisits)."""
    revisit = F.col("record_type") == "revisit"
    same = F.col("digest").eqNullSafe(F.col("declared_digest")) & F.col("bytes_so_far").eqNullSafe(F.col("declared_bytes"))
    return chunks.filter("last").select(
        "record_id",
        "record_type",
        "target_uri",
        "refers_to",
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        F.when(~revisit, same).alias("intact"),
    )
