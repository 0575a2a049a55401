"""WARC archives written and read as a chunked record table.

A record is never held whole by a Python worker: both ways its payload is a
run of rows (record id, chunk number, bytes), at most ``chunk_bytes`` each,
and digests are carried from chunk to chunk. The writer streams chunk rows
into gzip members, one for each record; the reader inflates an archive piece
by piece and gives back chunk rows with the SHA-1 of the payload so far.

Which records are revisits is settled by digests alone (thin rows); payloads
are joined with that decision by record id, so a payload shared by a third of
all pages never meets in one place.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import Any, BinaryIO
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import TaskFile, bounded_batches, few, filesystem, shared_dir, shuffle_parts, written

CHUNK_BYTES = 64 << 10
#: An archive is closed after the record that takes it past this size.
ARCHIVE_BYTES = 64 << 20
#: Payloads below this are kept even if another record has the same.
MIN_REVISIT_BYTES = 1000
WARC_DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_urn(record_id: Any, single: bool = True) -> str:
    """A record's name: made from its id if no other record has that id, else a fresh one, so names are unique."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{record_id}') if single else uuid.uuid4()}>"


def revisits(records: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(record_id, payload_digest) -> refers_to, from rows of record_id, payload_digest, payload_bytes."""
    large = records.filter(F.col("payload_bytes") >= min_bytes)
    kept = large.groupBy("payload_digest").agg(F.max("record_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    kept = written(kept, "warc-shared-digests")
    # A digest that very many records share meets them where they lie, unless there are too many such digests to send.
    return large.join(few(kept), "payload_digest").filter("record_id < refers_to").select("record_id", "payload_digest", "refers_to").distinct()


def chunk_table(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows record_id, url, payload_digest, payload_bytes, refers_to, single, refers_single, chunk_no, chunk: a revisit has one empty chunk.

    single: no other row has the record's id, nor is it null; refers_single
    says so of the record that a revisit refers to.
    Chunks are cut one after the other as the rows are asked for; beside the
    table's own row there is one chunk in memory.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("record_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    thin = rows.select("record_id", "payload_digest", "payload_bytes")
    again = revisits(thin)
    many = written(thin.filter("record_id is not null").groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("record_id", F.lit(True).alias("many")), "warc-repeated-ids")
    n = many.count()
    again = written(again.join(few(many.select(F.col("record_id").alias("refers_to"), F.col("many").alias("refers_many")), n), "refers_to", "left"), "warc-revisits")
    rows = rows.join(again, ["record_id", "payload_digest"], "left").join(few(many, n), "record_id", "left")
    rows = rows.withColumns({"single": F.col("record_id").isNotNull() & F.col("many").isNull(), "refers_single": F.col("refers_many").isNull()}).drop("many", "refers_many")
    last = F.when(F.col("refers_to").isNull(), F.expr(f"cast(greatest(payload_bytes - 1, 0) div {chunk_bytes} as int)")).otherwise(F.lit(0))
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    chunk = F.when(F.col("refers_to").isNull(), F.substring(F.col("payload"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))).otherwise(F.lit(b""))
    return rows.select("record_id", "url", "payload_digest", "payload_bytes", "refers_to", "single", "refers_single", "chunk_no", chunk.alias("chunk"))


def _escaped(text: str) -> str:
    return "".join(f"%{b:02X}" for b in text.encode("utf-8", "surrogatepass"))


def _id_field(record_id: Any) -> str:
    """An id as a header value, whatever a text id holds; ``unquote`` is the way back."""
    return "".join(c if c.isascii() and (c.isalnum() or c in "-._~") else _escaped(c) for c in str(record_id))


def _head(record_id: Any, url: str | None, digest: str, size: int, refers_to: Any, single: bool = True, refers_single: bool = True) -> bytes:
    """The WARC and HTTP headers of a record; a revisit's block is the HTTP header alone.

    A revisit names its response (WARC-Refers-To) where one record alone has
    that id; where several have, it gives the page's id and the digest.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    target = "".join(c if 0x20 < ord(c) < 0x7F else _escaped(c) for c in url or "about:blank")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_urn(record_id, single)}",
        f"WARC-Date: {WARC_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", *([f"WARC-Refers-To: {record_urn(refers_to)}"] if refers_single else []), f"X-Refers-To-Page: {_id_field(refers_to)}"]
    if record_id is not None:
        lines.append(f"X-Page: {_id_field(record_id)}")
    body = len(http) + (size if refers_to is None else 0)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {body}", "", ""]
    return "\r\n".join(lines).encode() + http


def write_archives(chunks: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the chunk table, in its order, as .warc.gz files; returns the manifest uri, n_records, n_bytes.

    Chunks of a record must follow one another inside a partition, as
    ``chunk_table`` makes them. The manifest is a written table: it names the
    files of committed task attempts and no others.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, packer, records, done = None, None, 0, []

        def end_record() -> None:
            nonlocal out, packer, records
            if packer is None:
                return
            out.write(packer.compress(b"\r\n\r\n") + packer.flush())
            packer, records = None, records + 1
            if out.size >= archive_bytes:
                end_file()

        def end_file() -> None:
            nonlocal out, records
            if out is not None:
                out.close()
                done.append((out.uri, records, out.size))
                out, records = None, 0

        for batch in batches:
            columns = [batch[c] for c in ("record_id", "url", "payload_digest", "payload_bytes", "refers_to", "single", "refers_single", "chunk_no", "chunk")]
            for row in zip(*columns, strict=True):
                *head, chunk_no, chunk = (x.as_py() for x in row)
                if chunk_no == 0:
                    end_record()
                    out = out or TaskFile(folder, ".warc.gz")
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(packer.compress(_head(*head)))
                if chunk:
                    out.write(packer.compress(chunk))
        end_record()
        end_file()
        names = ["uri", "n_records", "n_bytes"]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names)

    return written(chunks.mapInArrow(run, "uri string, n_records long, n_bytes long"), "warc-manifest")


class _Inflated:
    """Bytes of a file of gzip members, one after the other, inflated as asked for."""

    def __init__(self, source: BinaryIO, step: int = CHUNK_BYTES):
        self.source, self.step = source, step
        self.held, self.rest, self.unpack = bytearray(), b"", zlib.decompressobj(31)

    def _more(self) -> bool:
        data = self.rest or self.source.read(self.step)
        if not data:
            return False
        self.held += self.unpack.decompress(data, self.step)
        self.rest = self.unpack.unconsumed_tail
        if self.unpack.eof:
            self.rest, self.unpack = self.unpack.unused_data, zlib.decompressobj(31)
        return True

    def read(self, n: int) -> bytes:
        """Up to n bytes; fewer only at the end."""
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def head(self) -> bytes | None:
        """Up to and with the next empty line; None at the end."""
        at = -1
        while (at := self.held.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.held.strip():
                    raise ValueError("archive ends inside a header")
                return None
        out = bytes(self.held[: at + 4])
        del self.held[: at + 4]
        return out


def _fields(head: bytes) -> dict[str, str]:
    lines = (line.split(":", 1) for line in head.decode("utf-8").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in lines}


def records_of(source: BinaryIO, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """(record no., page, type, refers to, chunk no., payload bytes so far, SHA-1 so far, is last, chunk) of an archive.

    A revisit gives one row, with the size and digest that its headers state.
    A payload that does not match its stated digest raises.
    """
    stream, number = _Inflated(source), 0
    while (head := stream.head()) is not None:
        fields = _fields(head.lstrip(b"\r\n"))
        http = stream.head() or b""
        left = int(fields["content-length"]) - len(http)
        stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        page, other = (None if (x := fields.get(name)) is None else unquote(x) for name in ("x-page", "x-refers-to-page"))
        own = (number, page, fields["warc-type"], other)
        if fields["warc-type"] == "revisit":
            yield *own, 0, int(_fields(http)["content-length"]), stated, True, b""
        else:
            digest, seen, k = hashlib.sha1(), 0, 0
            while True:
                chunk = stream.read(min(left, chunk_bytes))
                if left and not chunk:
                    raise ValueError("archive ends inside a payload")
                digest.update(chunk)
                seen, left = seen + len(chunk), left - len(chunk)
                if not left and digest.hexdigest() != stated:
                    raise ValueError(f"payload of record {own[1]} does not match its digest")
                yield *own, k, seen, digest.hexdigest(), not left, chunk
                k += 1
                if not left:
                    break
        stream.read(4)  # the two line ends behind a record
        number += 1


def read_archives(manifest: DataFrame, *, id_type: str = "long", with_payload: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of the archives that a manifest (uri) names:
    uri, record_no, page_id, record_type, refers_to, chunk_no, seen_bytes, seen_sha1, is_last, chunk.

    An archive is one task's stream, whatever the size of its records.
    """
    fields = [("uri", pa.string()), ("record_no", pa.int64()), ("page", pa.string()), ("record_type", pa.string()), ("refers", pa.string()),
              ("chunk_no", pa.int64()), ("seen_bytes", pa.int64()), ("seen_sha1", pa.string()), ("is_last", pa.bool_()), ("chunk", pa.binary())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (x for batch in batches for x in batch["uri"].to_pylist()):
            fs, path = filesystem(uri)
            with fs.open_input_stream(path, compression=None) as source:
                rows, held = [], 0
                for row in records_of(source, chunk_bytes):
                    rows.append((uri, *row[:-1], row[-1] if with_payload else None))
                    held += len(row[-1]) if with_payload else 64
                    if held >= 4 << 20:
                        yield _batch(rows, fields)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, fields)

    schema = "uri string, record_no long, page string, record_type string, refers string, chunk_no long, seen_bytes long, seen_sha1 string, is_last boolean, chunk binary"
    files = manifest.select("uri").repartition(shuffle_parts(manifest.sparkSession), "uri")
    out = files.mapInArrow(run, schema)
    return out.select(
        "uri", "record_no", F.col("page").cast(id_type).alias("page_id"), "record_type", F.col("refers").cast(id_type).alias("refers_to"),
        "chunk_no", "seen_bytes", "seen_sha1", "is_last", "chunk",
    )


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def archive(pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes one WARC record for each row of ``pages``; returns the manifest.

    Of records with equal payloads of ``MIN_REVISIT_BYTES`` or more, that with
    the largest id is the response and the others revisit it. Null payloads
    are empty, a null URL is about:blank, a null id is left out of the record.
    Repeated rows of the largest id are responses each. Other columns are
    ignored; an empty table gives an empty manifest.
    """
    bounded_batches(pages.sparkSession)
    folder = folder or shared_dir(pages.sparkSession, "warc")
    return write_archives(chunk_table(pages, id_col=id_col, url_col=url_col, payload_col=payload_col), folder)


def inventory(manifest: DataFrame, *, id_type: str = "long") -> DataFrame:
    """What archives hold, from their bytes: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    chunks = read_archives(manifest, id_type=id_type, with_payload=False)
    last = chunks.filter("is_last")
    return last.select("page_id", F.col("seen_bytes").alias("payload_bytes"), F.col("seen_sha1").alias("payload_digest"), "record_type", "refers_to")
