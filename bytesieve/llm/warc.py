"""WARC archives written from and read into tables.

Writing: one task writes its rows as gzip members, one per record, into archives of bounded size, header and payload fed
to the compressor piece by piece; a row per finished archive goes into a manifest, so what a lost or repeated task left
behind is never read. A page whose payload another
page has already is a `revisit` that points at it and carries no payload.

Reading: an archive is decompressed as a stream. A record becomes rows of (record_id, chunk_no) with at most `chunk`
bytes each; every row carries the bytes so far and the SHA-256 so far, the last one those of the whole payload, so a
payload of any size is checked without being held. The digests that headers state are compared with those of what was
read, a revisit's with that of the record it points at; a difference ends the job."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytesieve import session
from bytesieve.llm.tables import stored, tasks
from bytesieve.llm.words import slices

ARCHIVE_BYTES, CHUNK, PIECE, LEAST = 64 << 20, 1 << 20, 1 << 18, 100
HEAD = "record_id string, page_id long, record_type string, refers_to long, url string"
RECORD = HEAD + ", chunk_no long, last boolean, payload_bytes long, sha256 string, stated string, data binary"


def record_types(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url",
                 least: int = LEAST) -> DataFrame:
    """page_id, url, payload (UTF-8 bytes; null: empty), digest, and refers_to: the smallest page_id among equal
    payloads of at least `least` bytes where that is another page, else null. Rows that repeat the smallest id are all
    responses; rows with a null id never are what others refer to."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    firsts = (rows.where(F.octet_length("payload") >= least).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
              .where("copies > 1 and first is not null").drop("copies"))
    return rows.join(firsts, "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first")).alias("refers_to"))


def _line(value) -> str:
    return " ".join(str(value).split())


def _head(page_id, url, size: int, digest: str, refers_to) -> bytes:
    """What stands before a payload of `size` bytes; a revisit has none."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = len(http) + (size if refers_to is None else 0)
    name = "none" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 2024-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {body}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http


def _packed(page_id, url, payload: memoryview, digest: str, refers_to, piece: int = PIECE) -> Iterator[bytes]:
    """A record as one gzip member, in pieces; no copy of the payload is made."""
    pack = zlib.compressobj(5, zlib.DEFLATED, 31)
    yield pack.compress(_head(page_id, url, len(payload), digest, refers_to))
    if refers_to is None:
        for at in range(0, len(payload), piece):
            yield pack.compress(payload[at:at + piece])
    yield pack.compress(b"\r\n\r\n")
    yield pack.flush()


def write_archives(rows: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives below path from rows of record_types(); returns the manifest (archive, records). A row is compressed by
    itself; the path must be one that all machines share."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(path)
        files.create_dir(base, recursive=True)
        out, name, size, records, done = None, "", 0, 0, []
        for batch in (part for whole in batches for part in slices(whole, 2)):
            ids, urls, digests, refers = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for i, payload in enumerate(batch.column(2)):
                if out is None:
                    name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                for part in _packed(ids[i], urls[i], memoryview(payload.as_buffer()), digests[i], refers[i]):
                    out.write(part)
                    size += len(part)
                records += 1
                if size >= archive_bytes:
                    out.close()
                    done.append((name, records))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records))
        yield pa.RecordBatch.from_arrays([pa.array([f"{path.rstrip('/')}/{n}" for n, _ in done], pa.string()),
                                          pa.array([r for _, r in done], pa.int64())], names=["archive", "records"])

    return stored(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(
        of, "archive string, records long"), "manifest")


class _Stream:
    """Decompressed bytes of a file of gzip members, taken by line or by count."""

    def __init__(self, source, step: int = 1 << 18):
        self.source, self.step, self.held, self.at, self.unzip = source, step, b"", 0, None

    def more(self) -> bool:
        while True:
            raw = self.unzip.unused_data if self.unzip is not None and self.unzip.eof else b""
            raw = raw or self.source.read(self.step)
            if not raw:
                return False
            if self.unzip is None or self.unzip.eof:
                self.unzip = zlib.decompressobj(31)
            made = self.unzip.decompress(raw)
            if made:
                self.held, self.at = self.held[self.at:] + made, 0
                return True

    def line(self) -> bytes | None:
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self.more():
                return None
        line, self.at = self.held[self.at:end + 1], end + 1
        return line.rstrip(b"\r\n")

    def take(self, n: int) -> bytes:
        """At most n bytes, at least one unless the end is reached."""
        if self.at == len(self.held) and not self.more():
            return b""
        part = self.held[self.at:self.at + n]
        self.at += len(part)
        return part


def _header(stream: _Stream) -> dict[str, str]:
    out = {}
    while line := stream.line():
        key, _, value = line.partition(b":")
        out[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _page(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def records(stream: _Stream, chunk: int):
    """(header, chunk_no, last, bytes so far, sha256 so far, data) of every record's payload, in order; a record
    without payload gives one empty last chunk. Raises on an archive that ends inside a record."""
    while (first := stream.line()) is not None:
        if not first:
            continue
        head = _header(stream)
        left = int(head["content-length"])
        if head.get("content-type", "").startswith("application/http"):
            while True:
                line = stream.line()
                if line is None:
                    raise EOFError("the archive ends inside a record")
                left -= len(line) + 2
                if not line:
                    break
        number, total, sha = 0, 0, hashlib.sha256()
        while True:
            data = bytearray()
            while left and len(data) < chunk:
                part = stream.take(min(left, chunk - len(data)))
                if not part:
                    raise EOFError("the archive ends inside a record")
                data += part
                left -= len(part)
            sha.update(data)
            total += len(data)
            yield head, number, not left, total, sha.hexdigest(), bytes(data)
            if not left:
                break
            number += 1


def read_archives(spark: SparkSession, manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk rows of all archives of a manifest (column archive); without with_data the bytes are hashed and
    counted but left out. sha256 and payload_bytes are of the payload up to and with this chunk, stated is the digest
    in the record's header."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(),
                 pa.string(), pa.string(), pa.binary()]
        names = [c.split()[0] for c in RECORD.split(", ")]

        def packed(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                files, name = pafs.FileSystem.from_uri(archive)
                held, rows = 0, []
                with files.open_input_stream(name, compression=None) as source:
                    for head, number, last, total, sha, data in records(_Stream(source), chunk):
                        urn = head.get("warc-record-id")
                        rows.append((urn, _page(urn), head.get("warc-type"), _page(head.get("warc-refers-to")),
                                     head.get("warc-target-uri"), number, last, total, sha,
                                     head.get("warc-payload-digest", "").removeprefix("sha256:") or None,
                                     data if with_data else None))
                        held += len(data) if with_data else 0
                        if held >= 4 << 20 or len(rows) >= 5000:
                            yield packed(rows)
                            held, rows = 0, []
                if rows:
                    yield packed(rows)

    return manifest.select("archive").repartition(3 * tasks(spark)).mapInArrow(of, RECORD)


def _agreed(found, stated, page_id):
    """The digest found, if it is the one stated (or none is); else the job ends."""
    told = F.concat(F.lit("the payload of page "), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(" has the digest "),
                    F.coalesce(found, F.lit("none")), F.lit(", its record says "), stated)
    return F.when(stated.isNull() | F.coalesce(found == stated, F.lit(False)), found).otherwise(F.raise_error(told).cast("string"))


def payload_digests(chunks: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, sha256, stated of every record, from its last chunk row. A payload
    of one chunk is digested anew from that row's data; a longer one has the running digest. Responses must agree with
    their headers."""
    last = chunks.where("last").withColumn("sha256", F.when(F.col("chunk_no") == 0, F.sha2("data", 256)).otherwise(F.col("sha256")))
    response = F.col("record_type") == "response"
    return last.select("page_id", "record_type", "refers_to", "payload_bytes", "stated", F.when(
        response, _agreed(F.col("sha256"), F.col("stated"), F.col("page_id"))).otherwise(F.col("sha256")).alias("sha256"))


def restored(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest of the full payload, record_type, refers_to per record; a revisit's are those
    of the record it points at, and must be what its own header states."""
    rows = stored(payload_digests(chunks), "records")
    pointed = rows.where("record_type = 'revisit'").select("refers_to").distinct()
    full = rows.where("record_type = 'response'").join(
        pointed.withColumnRenamed("refers_to", "page_id"), "page_id", "left_semi").groupBy("page_id").agg(
        F.max(F.struct("payload_bytes", "sha256")).alias("full"))
    back = rows.where("record_type = 'revisit'").join(full.withColumnRenamed("page_id", "refers_to"), "refers_to", "left")
    return rows.where("record_type = 'response'").select(
        "page_id", "payload_bytes", F.col("sha256").alias("payload_digest"), "record_type", "refers_to").unionByName(
        back.select("page_id", F.col("full.payload_bytes").alias("payload_bytes"),
                    _agreed(F.col("full.sha256"), F.col("stated"), F.col("page_id")).alias("payload_digest"), "record_type", "refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as archives into the shared folder and read back as chunk rows with their data: page_id, payload_bytes
    and payload_digest of the full payload, record_type, refers_to. An empty table gives no archive and no rows."""
    spark = pages.sparkSession
    manifest = write_archives(record_types(pages), session.new_path(spark, "warc"))
    return restored(read_archives(spark, manifest))
