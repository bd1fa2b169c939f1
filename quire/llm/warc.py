"""WARC archives: a writer, a normaliser of monolithic gzip files, and a reader by offsets.

A whole-file gzip stream can't be entered in the middle. The normaliser inflates such a file
once, as a stream, writes every record as a gzip member of its own, and notes the member's place
in a sidecar index (a Parquet table beside the archives); record bodies pass through in chunks,
so memory doesn't follow record or file size. The reader opens members by the index alone.

Archives of any writer are taken: all record types, record ids of any form, no other headers than
the type and the length. The payload is the block, less the HTTP header where the content type is
application/http; its size and SHA-1 are measured as it passes through. A revisit without payload
has the digest its header names, and the size of the record it refers to, as far as its own
writer's private header tells. An archive that ends within a record or can't be read gives the
records up to there and one row with an error.

Archives lie in the shared folder and are opened through pyarrow's file systems, by URI. File
names are new for every attempt and only those of tasks that succeeded get into the index, so
lost executors and repeated tasks leave no wrong records.

Defined results of ``archive``: a null payload is empty; records with equal payloads of at least
``least`` bytes are revisits of the one with the smallest id, shorter ones are all responses; rows
that repeat id and payload are responses each; null ids come last; ids are integers, others raise
a ValueError. A null URL is written as an empty target. Empty tables give empty results; other
columns are not looked at. A page is held whole by its task, and no longer.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_session, integral, new_path, settings, stage

CHUNK = 1 << 20
#: Bytes of records after which a task begins another archive.
ARCHIVE = 64 << 20
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: An archive: its name, records and bytes before compression.
FILES = "file string, n long, size long"
#: What an index row holds; page_id and refers_to are the numbers of ids that this writer makes.
INDEX = "file string, offset long, length long, record_id string, record_type string, refers_to_id string, uri string, payload_bytes long, payload_digest string, error string"
#: Groups of equal payloads that go to all tasks, as digest and first id (under a hundred bytes each); the revisits of more are joined by id.
SENT = 200_000
#: Pages that Spark's Parquet reader holds at once, if the session has no smaller number: it keeps a batch in one array, which grows by doubling.
READ, READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize", 128


def _open(uri: str, mode: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path, compression=None)
    return system.open_input_file(path)


def _urn(page) -> str:
    return f"<urn:quire:page:{'' if page is None else page}>"


def page_of(record_id: Column) -> Column:
    """The page of a record id that this writer made, else null."""
    return F.regexp_extract(record_id, "^<urn:quire:page:(-?[0-9]+)>$", 1).try_cast("long")


def record(page, url: str | None, payload: bytes, digest: str, response: bool, refers_to) -> bytes:
    """One WARC record."""
    block = HTTP + payload if response else HTTP
    lines = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe=_PRINTED)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if not response:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_PRINTED = "".join(chr(c) for c in range(33, 127))


def _write(batches, folder: str):
    """Rows (page_id, url, html, response, refers_to) to monolithic gzip archives; gives their names."""
    out = packer = name = None
    size = n = 0

    def close():
        out.write(packer.flush())
        out.close()
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["file", "n", "size"])

    for batch in batches:
        for page, url, html, response, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if out is None:
                name, size, n = f"{folder}/whole-{uuid.uuid4().hex}.warc.gz", 0, 0
                out, packer = _open(name, "w"), zlib.compressobj(1, zlib.DEFLATED, 31)
            payload = (html or "").encode()
            raw = record(page, url, payload, base64.b32encode(hashlib.sha1(payload).digest()).decode(), response, refers)
            out.write(packer.compress(raw))
            size, n = size + len(raw), n + 1
            if size >= ARCHIVE:
                yield close()
                out = None
    if out is not None:
        yield close()


class Inflated:
    """A gzip file of one or more members as one stream of bytes."""

    def __init__(self, source):
        self.source, self.unpacker, self.held, self.at = source, zlib.decompressobj(31), bytearray(), 0

    def more(self) -> bool:
        """Inflates one more chunk; False at the end."""
        raw = self.unpacker.unconsumed_tail
        if self.unpacker.eof:
            raw = self.unpacker.unused_data
            self.unpacker = zlib.decompressobj(31)
        raw = raw or self.source.read(CHUNK)
        if not raw:
            return False
        if self.at:
            del self.held[: self.at]
            self.at = 0
        self.held += self.unpacker.decompress(raw, CHUNK)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with mark; None at the end of the stream."""
        seen = 0
        while (found := self.held.find(mark, self.at + seen)) < 0:
            seen = max(0, len(self.held) - self.at - len(mark))
            if not self.more():
                if self.held[self.at :].strip(b"\r\n\0"):
                    raise ValueError("the archive ends within a record")
                return None
        out = bytes(self.held[self.at : found + len(mark)])
        self.at = found + len(mark)
        return out

    def take(self, n: int):
        """n bytes in chunks."""
        while n:
            if self.at == len(self.held) and not self.more():
                raise ValueError("the archive ends within a record")
            part = bytes(self.held[self.at : self.at + n])
            self.at += len(part)
            n -= len(part)
            if part:
                yield part


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").strip("\r\n").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class Payload:
    """Measures a payload as its block passes through: an HTTP header, if there is one, doesn't count."""

    def __init__(self, h: dict[str, str]):
        self.h, self.size, self.sha, self.head = h, 0, hashlib.sha1(), b"" if h.get("content-type", "").lower().startswith("application/http") else None

    def add(self, part: bytes) -> None:
        if self.head is not None:
            self.head, gap, part = (self.head + part).partition(b"\r\n\r\n")
            if not gap:
                return
            self.head = None
        self.size += len(part)
        self.sha.update(part)

    def found(self) -> tuple:
        """(record_id, record_type, refers_to_id, uri, payload_bytes, payload_digest)."""
        h, size, digest = self.h, self.size, base64.b32encode(self.sha.digest()).decode()
        if h.get("warc-type") == "revisit" and not size:
            own = h.get("x-payload-length", "")
            size, digest = int(own) if own.isdigit() else None, h.get("warc-payload-digest", "").rpartition(":")[2] or None
        return h.get("warc-record-id"), h.get("warc-type"), h.get("warc-refers-to"), h.get("warc-target-uri"), size, digest


def _members(uri: str, folder: str, level: int):
    """Index rows of one file: it is inflated once and rewritten member by member."""
    at, name = 0, f"{folder}/record-{uuid.uuid4().hex}.warc.gz"
    try:
        with _open(uri, "r") as source, _open(name, "w") as out:
            stream = Inflated(source)
            while (head := stream.until(b"\r\n\r\n")) is not None:
                if not (head := head.lstrip(b"\r\n\0")):
                    continue  # what ends the record before
                h, packer, start = headers(head), zlib.compressobj(level, zlib.DEFLATED, 31), at
                payload, parts = Payload(h), [packer.compress(head)]
                for part in stream.take(int(h["content-length"])):
                    payload.add(part)
                    parts.append(packer.compress(part))
                    if sum(map(len, parts)) >= CHUNK:
                        at += sum(map(len, parts))
                        out.write(b"".join(parts))
                        parts = []
                parts.append(packer.compress(b"\r\n\r\n") + packer.flush())
                at += sum(map(len, parts))
                out.write(b"".join(parts))
                yield name, start, at - start, *payload.found(), None
    except (ValueError, KeyError, OSError, zlib.error) as e:
        yield uri, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]


def _normalise(batches, folder: str, level: int):
    """File names to index rows."""
    for batch in batches:
        rows = []
        for uri in batch.column(0).to_pylist():
            for row in _members(uri, folder, level):
                rows.append(row)
                if len(rows) >= 10_000:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)


_ARROW = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_ARROW)], names=[x.split()[0] for x in INDEX.split(", ")])


def _read(batches):
    """Index rows to what their members hold, measured anew."""
    held, source = None, None
    for batch in batches:
        out = []
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r[-1] is not None:
                out.append(r)
                continue
            if r[0] != held:
                if source is not None:
                    source.close()
                held, source = r[0], _open(r[0], "r")
            head, _, block = zlib.decompress(source.read_at(r[2], r[1]), 31).partition(b"\r\n\r\n")
            h = headers(head)
            payload = Payload(h)
            payload.add(block[: int(h["content-length"])])
            out.append((*r[:3], *payload.found(), None))
        yield _batch(out)
    if source is not None:
        source.close()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Writes one record per page to monolithic archives in folder; gives (file, n, size).

    Only ids and digests are shuffled to find the revisits; pages stay where they are read while
    the groups of equal ones are few enough to go to all tasks, else revisits and pages are joined
    by id. Archives' names (one a task, or for each ARCHIVE bytes) come to the driver: Spark's writers
    run chmod for every file in a local folder, so tables of a few small rows a task cost more in
    processes than in bytes."""
    integral(pages, id_col)
    spark = pages.sparkSession
    arrow_session(spark)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("q_id"), F.col(url_col).alias("q_url"), html.alias("q_html"), F.sha2(html, 256).alias("q_digest"))
    with settings(spark, {READ: str(min(READ_ROWS, int(spark.conf.get(READ))))}):
        keys = rows.filter(F.octet_length("q_html") >= least).select("q_id", "q_digest")
        groups = keys.groupBy("q_digest").agg(F.min("q_id").alias("q_first"), F.max("q_id").alias("q_last"), F.count(F.lit(1)).alias("n"), F.count("q_id").alias("named"))
        groups = groups.filter("q_first < q_last or (named > 0 and named < n)")
        groups = stage(groups.select(F.col("q_digest").alias("r_digest"), F.col("q_first").alias("refers_to")), "warc-groups")
        if groups.count() <= SENT:
            tagged = rows.join(F.broadcast(groups), F.col("q_digest") == F.col("r_digest"), "left")
        else:
            again = keys.join(groups, F.col("q_digest") == F.col("r_digest")).filter(~F.col("q_id").eqNullSafe(F.col("refers_to")))
            again = stage(again.select(F.col("q_id").alias("r_id"), "r_digest", "refers_to").distinct(), "warc-revisits")
            tagged = rows.join(again, F.col("q_id").eqNullSafe(F.col("r_id")) & (F.col("q_digest") == F.col("r_digest")), "left")
        response = F.col("refers_to").isNull() | F.col("q_id").eqNullSafe(F.col("refers_to"))
        tagged = tagged.select("q_id", "q_url", "q_html", response.alias("response"), "refers_to")
        return spark.createDataFrame(tagged.mapInArrow(partial(_write, folder=folder), FILES).collect(), FILES)


def normalise(files: DataFrame, folder: str, level: int = 5) -> DataFrame:
    """files: (file, ...) of gzip archives, of one or many members. Writes them record by record into folder, and the index beside them; gives the index."""
    arrow_session(files.sparkSession)
    spark = files.sparkSession
    n = files.count()
    dealt = files.select("file").repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism, 10_000)))
    dealt.mapInArrow(partial(_normalise, folder=folder, level=level), INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read(index: DataFrame) -> DataFrame:
    """The records behind index rows, opened by their offsets."""
    return index.mapInArrow(_read, INDEX)


def archive(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Pages to monolithic archives, to archives by record with an index, and back to rows: INDEX, with page_id and refers_to."""
    folder = folder or new_path(pages.sparkSession, "warc")
    return read(normalise(write(pages, folder, **columns), folder)).withColumns({"page_id": page_of(F.col("record_id")), "refers_to": page_of(F.col("refers_to_id"))})
