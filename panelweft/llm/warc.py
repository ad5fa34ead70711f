"""WARC archives through a chunked record table.

A page becomes rows (record, chunk_no, last, data): payloads of any size flow through
Python in chunks of `chunk_bytes`, with the digest so far carried from chunk to chunk, so
neither writer nor reader holds a whole record.  Each task writes compressed archives (one
gzip member a record) that appear only when whole, and reports them in a manifest.

Of records with equal payloads of at least `min_revisit_bytes`, the one of largest page id
is a response and the others revisit it; smaller payloads are all responses.

Null html is an empty payload; a null url is archived as urn:page:<id>.  A null page id is
a response (it is below every other id, and revisits the response of an equal payload).
Repeated rows each have a record; those that repeat the largest id are all responses.
Extra columns don't matter; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweft.llm import common as C
from panelweft.llm.files import opened, written

CHUNK = 1 << 18
#: Payload bytes after which a task begins its next archive.
ARCHIVE_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunked(pages: DataFrame, html: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """pages with html replaced by rows (chunk_no, last, data) in order; other columns repeat."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.length("_payload") / chunk_bytes)).cast("int")
    others = [c for c in pages.columns if c != html]
    # Chunk numbers are exploded, not chunks: each is cut from the payload as its row is made.
    rows = pages.withColumn("_payload", payload).withColumn("_n", n).select(*others, "_payload", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("chunk_no"))
    return rows.select(*others, "chunk_no", (F.col("chunk_no") == F.col("_n") - 1).alias("last"), F.substring(F.col("_payload"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data"))


def digests(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, payload_bytes, digest) of each record of a chunk table whose records' chunks stand in order."""
    kinds = ", ".join(f"{k} {chunks.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        h, n = hashlib.sha1(), 0
        for batch in batches:
            rows, size, sums = [], [], []
            for i, (last, data) in enumerate(zip(C.column(batch, "last").to_pylist(), C.column(batch, "data"), strict=True)):
                raw = data.as_buffer()
                h.update(raw)
                n += raw.size
                if last:
                    rows.append(i), size.append(n), sums.append(base32(h.digest()))
                    h, n = hashlib.sha1(), 0
            if rows:
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(C.column(batch, k).take(at) for k in keys), pa.array(size, pa.int64()), pa.array(sums)], [*keys, "payload_bytes", "digest"])

    return chunks.select(*keys, "last", "data").mapInArrow(C.tidy(run), f"{kinds}, payload_bytes long, digest string")


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _urn(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}')}>"


def head_of(page_id, url: str | None, size: int, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """A record's header and the archived HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_line(url) if url else f'urn:page:{page_id}'}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(http) + (0 if revisit else size)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def decided(pages: DataFrame, *, id_col: str, html_col: str, min_revisit_bytes: int, chunk_bytes: int) -> DataFrame:
    """(_id, _row, payload_bytes, digest, refers_to) of each distinct row of pages."""
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(html_col).alias("_row"), F.col(html_col).alias("_html"))
    sums = digests(chunked(rows, "_html", chunk_bytes), ["_id", "_row"]).distinct()
    largest = sums.groupBy("digest", "payload_bytes").agg(F.max("_id").alias("_most"))
    kept = F.col("_most").isNotNull() & (F.col("_most") != F.coalesce("_id", F.col("_most") - 1)) & (F.col("payload_bytes") >= min_revisit_bytes)
    return sums.join(largest, ["digest", "payload_bytes"]).select("_id", "_row", "payload_bytes", "digest", F.when(kept, F.col("_most")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, chunk_bytes: int = CHUNK, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of pages under path; the manifest (path, n_records) names the finished archives."""
    spark = pages.sparkSession
    C.ship(spark)
    marks = decided(pages, id_col=id_col, html_col=html_col, min_revisit_bytes=min_revisit_bytes, chunk_bytes=chunk_bytes)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    keyed = rows.join(marks, F.col("page_id").eqNullSafe(F.col("_id")) & (F.xxhash64("html") == F.col("_row"))).drop("_id", "_row")
    # A revisit has no payload, so its html goes no further.
    keyed = keyed.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))
    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64())])

    def run(batches):
        z, h = None, None
        out = name = context = None
        n, size = 0, 0
        try:
            for batch in batches:
                for page, url, total, digest, refers, no, last, data in zip(*(C.column(batch, c) for c in ("page_id", "url", "payload_bytes", "digest", "refers_to", "chunk_no", "last", "data")), strict=True):
                    revisit = refers.is_valid
                    if out is None:
                        name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                        context = written(name)
                        out = context.__enter__()
                    if no.as_py() == 0:
                        z, h = zlib.compressobj(4, zlib.DEFLATED, 31), hashlib.sha1()
                        out.write(z.compress(head_of(page.as_py(), url.as_py(), total.as_py(), digest.as_py(), refers.as_py(), revisit, date)))
                    if not revisit:
                        raw = data.as_buffer()
                        h.update(raw)
                        out.write(z.compress(raw))
                        size += raw.size
                    if last.as_py():
                        if not revisit and base32(h.digest()) != digest.as_py():
                            raise ValueError(f"page {page}: the payload changed between the passes")
                        out.write(z.compress(b"\r\n\r\n") + z.flush())
                        n += 1
                        if size >= archive_bytes:
                            context.__exit__(None, None, None)
                            yield C.batch_of(schema, [name], [n])
                            out, n, size = None, 0, 0
            if out is not None:
                context.__exit__(None, None, None)
                yield C.batch_of(schema, [name], [n])
        except BaseException as e:
            if out is not None:
                context.__exit__(type(e), e, e.__traceback__)
            raise

    cut = chunked(keyed, "html", chunk_bytes)
    return C.stored(cut.select("page_id", "url", "payload_bytes", "digest", "refers_to", "chunk_no", "last", "data").mapInArrow(C.tidy(run), "path string, n_records long"), f"{path}/manifest")


class _Inflated:
    """Reads a file of gzip members as one stream, some bytes at a time."""

    def __init__(self, f, step: int = 1 << 18) -> None:
        self.f, self.step, self.z, self.held, self.raw = f, step, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.f.read(self.step)
                if not self.raw:
                    return False
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(self.raw, self.step)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                self.held += got
                return True

    def upto(self, mark: bytes) -> bytes | None:
        """Bytes before mark, which is passed over; None at the end."""
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record")
                return None
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        """Up to n bytes, one at least."""
        if not self.held and not self.more():
            raise ValueError("the archive ends inside a record")
        out, self.held = self.held[:n], self.held[n:]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def read_records(f, chunk_bytes: int = CHUNK):
    """(fields, chunk_no, last, data, bytes so far, digest so far) of each chunk of each record of an archive."""
    s = _Inflated(f)
    while (head := s.upto(b"\r\n\r\n")) is not None:
        fields = _fields(head.lstrip(b"\r\n"))
        left = int(fields["content-length"])
        http = s.upto(b"\r\n\r\n")
        fields["payload-length"] = _fields(http)["content-length"]
        left -= len(http) + 4
        h, n, no = hashlib.sha1(), 0, 0
        while True:
            data = b""
            while left and len(data) < chunk_bytes:
                data += (got := s.take(min(left, chunk_bytes - len(data))))
                left -= len(got)
            h.update(data)
            n += len(data)
            yield fields, no, not left, data, n, h.copy()
            no += 1
            if not left:
                break
        if s.upto(b"\r\n\r\n") != b"":
            raise ValueError("a record doesn't end where its length says")


def read_archives(manifest: DataFrame, *, with_data: bool = False, chunk_bytes: int = CHUNK) -> DataFrame:
    """The chunk table of the manifest's archives: page_id, url, record_type, refers_to, chunk_no, last, bytes_so_far, digest_so_far, payload_bytes, payload_digest and, if asked for, data.

    Without data only each record's last chunk is returned.
    """
    names = ["page_id", "url", "record_type", "refers_to", "chunk_no", "last", "bytes_so_far", "digest_so_far", "payload_bytes", "payload_digest", "data"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    whole = lambda x: None if x is None else int(x)

    def run(batches):
        for batch in batches:
            for uri in C.column(batch, "path").to_pylist():
                system, path = opened(uri)
                with system.open_input_stream(path, compression=None) as f:
                    out, held = [], 0
                    for fields, no, last, data, n, h in read_records(f, chunk_bytes):
                        digest, said, kind = base32(h.digest()), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                        if last and kind == "response" and (digest != said or n != int(fields["payload-length"])):
                            raise ValueError(f"{uri}: a payload doesn't have its digest")
                        if with_data or last:
                            out.append((whole(fields.get("x-page-id")), fields["warc-target-uri"], kind, whole(fields.get("x-refers-to-page-id")), no, last, n, digest, int(fields["payload-length"]), said, data if with_data else None))
                            held += len(data) if with_data else 1
                        if held >= (1 << 22 if with_data else 4096):
                            yield C.batch_of(schema, *map(list, zip(*out, strict=True)))
                            out, held = [], 0
                    if out:
                        yield C.batch_of(schema, *map(list, zip(*out, strict=True)))

    spread = manifest.select("path").repartition(C.width(manifest.sparkSession))
    return spread.mapInArrow(C.tidy(run), "page_id long, url string, record_type string, refers_to long, chunk_no int, last boolean, bytes_so_far long, digest_so_far string, payload_bytes long, payload_digest string, data binary")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Archives pages and reads the archives back."""
    manifest = write_archives(C.table(spark, sf_dir, "pages"), C.shared_dir(spark))
    return read_archives(manifest).filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
