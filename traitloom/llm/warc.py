"""WARC archives of web pages: writer, sequential reader and digest verification.

Each record is one gzip member. The reader inflates a member piece by piece, cuts its header
and its block by content length, and hashes the payload as it passes, so it holds one piece
of one record at a time. After a damaged member it goes on at the next one. Archives are written under a temporary name and then renamed: a
task that is run again replaces its archive as a whole.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.llm.shared import materialise, scratch_path

#: Payloads of fewer bytes are always written out.
REVISIT_BYTES = 100
ARCHIVE_BYTES = 256 << 20
PIECE = 1 << 16
#: Fixed value: how a gzip member begins.
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "archive string, records long, bytes long"
READ = ("archive string, position long, record_id string, record_type string, target_uri string, payload_bytes long, "
        "payload_digest string, refers_to string, error string")


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page what its record holds: id, url, payload, its digest, and the response it revisits.

    Of equal payloads of at least 100 bytes the smallest id is the response and the others
    revisit it. A null page is an empty payload. A null id revisits the smallest non-null id
    with its payload, if there is one. Repeated rows with the smallest id are responses each.
    Ids may be of any type that Spark can sort and read from text. Other columns are not read.
    """
    digested = pages.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    repeated = (digested.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest")
                .agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"))
    other = F.col("id").isNull() | (F.col("id") != F.col("first"))
    return digested.join(repeated, "digest", "left").select(
        "id", "url", "payload", "digest", F.when(F.col("first").isNotNull() & other, F.col("first")).alias("refers_to"))


def _record(page: dict, date: str) -> bytes:
    payload = page["payload"].encode("utf-8", "surrogatepass")
    name = lambda key: f"<urn:x-page:{'' if key is None else 'i' + quote(str(key), safe='')}:{page['digest'][:16]}>"
    revisit = page["refers_to"] is not None
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": name(page["id"]), "WARC-Date": date}
    if page["url"] is not None:
        fields["WARC-Target-URI"] = quote(page["url"], safe=":/?#[]@!$&'()*+,;=%-._~")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": name(page["refers_to"])}
    else:
        block += payload
    fields |= {"WARC-Payload-Digest": f"sha256:{page['digest']}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
               "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def write_archives(planned: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records of :func:`plan_records`; returns the archives (path, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        store.create_dir(root, recursive=True)
        done, out = [], None

        def close() -> None:
            out.close()
            store.move(draft, f"{root}/{name}")
            done.append((f"{folder}/{name}", records, size))

        for batch in batches:
            for page in batch.to_pylist():
                if out is None:
                    name = f"pages-{task.partitionId():06d}-{len(done):04d}.warc.gz"
                    draft, records, size = f"{root}/.{name}.{task.taskAttemptId()}", 0, 0
                    out = store.open_output_stream(draft, compression=None)
                member = _record(page, date)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({k: [x[i] for x in done] for i, k in enumerate(("archive", "records", "bytes"))},
                                         pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return planned.mapInArrow(run, WRITTEN)


def _inflated(stream, pending: bytes) -> Iterator[tuple[bytes, bytes | None]]:
    """The pieces of one gzip member; with the last piece come the bytes that follow the member."""
    inflate = zlib.decompressobj(wbits=31)
    while not inflate.eof:
        piece = inflate.decompress(pending, PIECE)
        pending = inflate.unconsumed_tail
        if not pending and not inflate.eof and not (pending := stream.read(PIECE)) and not piece:
            raise ValueError("truncated member")
        yield piece, None
    yield b"", inflate.unused_data


def read_member(stream, pending: bytes) -> tuple[dict, bytes]:
    """One record, its digests verified, and the bytes read beyond its member."""
    pieces = _inflated(stream, pending)
    buffer, rest = b"", None
    while b"\r\n\r\n" not in buffer and rest is None:
        piece, rest = next(pieces)
        buffer += piece
    head, _, buffer = buffer.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not version.startswith("WARC/") or not fields.get("content-length", "").isdigit():
        raise ValueError("no record header")
    left, block, payload, declared, http = int(fields["content-length"]), hashlib.sha256(), hashlib.sha256(), None, b""
    stored, trailer = 0, b""
    while True:
        body, after = buffer[:left], buffer[left:]
        left -= len(body)
        trailer += after[:8]
        block.update(body)
        if declared is None:
            http += body
            if b"\r\n\r\n" in http:
                lines, _, body = http.partition(b"\r\n\r\n")
                declared = next((int(x.split(b":")[1]) for x in lines.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
        if declared is not None:
            payload.update(body)
            stored += len(body)
        if rest is not None:
            break
        buffer, rest = next(pieces)
    revisit, digest = fields.get("warc-type") == "revisit", fields.get("warc-payload-digest", "").removeprefix("sha256:")
    error = None
    if left or trailer != b"\r\n\r\n":
        error = "content length"
    elif fields.get("warc-block-digest", "") != f"sha256:{block.hexdigest()}":
        error = "block digest"
    elif not revisit and (payload.hexdigest() != digest or stored != declared):
        error = "payload digest"
    return {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"),
            "payload_bytes": declared, "payload_digest": digest if revisit else payload.hexdigest(), "refers_to": fields.get("warc-refers-to"), "error": error}, rest


def _next_member(source, at: int) -> tuple[int, bytes] | None:
    """Where, from ``at`` on, a member may begin, and the bytes read from there."""
    source.seek(at)
    held = b""
    while piece := source.read(PIECE):
        held += piece
        if (found := held.find(MAGIC)) >= 0:
            return at + found, held[found:]
        at += max(0, len(held) - 2)
        held = held[-2:]
    return None


def read_archive(store, path: str) -> Iterator[dict]:
    """The records of one archive in order; for each damaged stretch a row that says so."""
    with store.open_input_file(path) as source:
        start, pending, damaged = 0, source.read(PIECE), False
        while pending:
            try:
                record, rest = read_member(source, pending)
            except (ValueError, zlib.error, StopIteration) as e:
                if not damaged:
                    yield {"position": start, "error": f"unreadable member: {e}"}
                damaged = True
                start, pending = _next_member(source, start + 1) or (start, b"")
                continue
            yield record | {"position": start}
            start, damaged = source.tell() - len(rest), False
            pending = rest or source.read(PIECE)


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of the archives whose paths are in ``archives.archive``, about one task for each archive.

    The number of tasks is given, since paths are too few bytes for Spark to see the work.
    """
    spread = archives.select("archive").repartitionByRange(max(1, archives.count()), "archive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if n in ("position", "payload_bytes") else pa.string()) for n in (c.split()[0] for c in READ.split(", "))])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, root = fs.FileSystem.from_uri(path)
                rows = []
                for record in read_archive(store, root):
                    rows.append({"archive": path} | record)
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spread.mapInArrow(run, READ)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per page, read the archives back and return what they hold, per page.

    Columns: the id, ``payload_bytes``, ``payload_digest`` (of the payload as read; that which
    a revisit declares), ``record_type``, ``refers_to`` (an id) and ``error`` (null where all
    digests and lengths agree). A damaged stretch of an archive is a row with ``error`` alone.
    A very long page is compressed whole by its task and read back in pieces. Equal pages are
    rows each, and pages of equal ids too. No rows give no archives.
    """
    archives = materialise(write_archives(plan_records(pages, id_col, url_col, html_col), scratch_path(pages.sparkSession, "warc")), "archives")
    kind = pages.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()

    def page(urn: str) -> Column:
        part = F.split_part(F.col(urn), F.lit(":"), F.lit(3))
        return F.when(part.startswith("i"), F.url_decode(F.substring(part, 2, 1 << 20))).try_cast(kind)

    return read_archives(archives).select(
        page("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "error")
