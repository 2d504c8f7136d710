"""WARC archives of a page table, read back as a table of record chunks.

Archives are gzip members, one a record, in the session's shared folder (through pyarrow's file systems, so
any store that has one). Payloads go in and out in chunks: reading yields a row for each record and chunk
number, with the digest of all bytes up to its end, and holds one chunk at a time.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .filters import slot_of, split
from .store import keep, shared_dir, small_batches

#: Bytes of a chunk; bytes after which an archive is closed and the next begins.
CHUNK, ROLL = 1 << 18, 64 << 20
#: Equal payloads of this many bytes or more are stored once.
REVISIT_FROM = 1000
RECORDS = "archive string, record_id string, page_id long, url string, record_type string, refers_to long, chunk long, chunk_bytes long, payload_bytes long, payload_digest string, stated_digest string, last boolean, payload binary"


def _open(uri: str):
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def roles(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """pages with payload_digest (SHA-1), record_type and refers_to.

    Of equal payloads of `least` bytes or more, that with the largest page_id is the response and the others
    revisit it; a revisit's payload is null. A null html is an empty payload; a null page_id is never referred to.
    Rows that repeat a page_id with other payloads are judged each with its own. An empty table gives an empty one.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    pages = pages.withColumn("payload_digest", F.sha1("payload")).withColumn("large", F.length("payload") >= least)
    found = pages.where("large and page_id is not null").groupBy("payload_digest").agg(F.max("page_id").alias("response"), F.count("*").alias("copies"))
    found = keep(found.where("copies > 1").drop("copies"), "copied")
    # bodies that aren't copied stay where they are; those that are go by page, and only ids meet by digest
    maybe, clear = split(pages, slot_of("payload_digest"), found.select(slot_of("payload_digest").alias("slot")))
    of_page = maybe.where("large").select("page_id", "payload_digest").distinct().join(found, "payload_digest")
    of_page = of_page.select(F.col("page_id").alias("of"), F.col("payload_digest").alias("digest"), "response")
    maybe = maybe.join(of_page, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("payload_digest") == F.col("digest")), "left")
    revisit = F.col("response").isNotNull() & ((F.col("page_id") != F.col("response")) | F.col("page_id").isNull())
    kind, refers = F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("response")).alias("refers_to")
    body = F.when(~revisit, F.col("payload")).alias("payload")
    return maybe.select("page_id", "url", body, "payload_digest", kind,
        refers).unionByName(clear.select("page_id", "url", "payload", "payload_digest", F.lit("response").alias("record_type"),
            F.lit(None).cast("long").alias("refers_to")))


def _name(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of roles(); returns (archive, n_records). Repeated rows are records each; none, no archive.

    An archive has a name of its own for each attempt and counts only if its task's row is returned, so a
    task that is run again leaves no record twice.
    """

    def write(batches):
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        out = name = None
        n, size = 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, digest, kind, refers = (batch.column(c)[i].as_py() for c in ("page_id", "url", "payload_digest", "record_type", "refers_to"))
                payload = memoryview(batch.column("payload")[i].as_buffer() if kind == "response" else b"")
                if out is None:
                    name = f"{root}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    out, n, size = store.open_output_stream(name, compression=None), 0, 0
                head = {"WARC-Type": kind, "WARC-Record-ID": _name(page_id), "WARC-Date": "1970-01-01T00:00:00Z",
                    "Content-Type": "text/html; charset=utf-8", "X-Page-ID": page_id, "WARC-Payload-Digest": f"sha1:{digest}"}
                if url is not None:
                    head["WARC-Target-URI"] = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
                if kind == "revisit":
                    head |= {"WARC-Refers-To": _name(refers), "X-Refers-To-Page": refers,
                        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                head["Content-Length"] = len(payload)
                member = zlib.compressobj(1, zlib.DEFLATED, 31)
                text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None) + "\r\n"
                out.write(member.compress(text.encode()))
                for at in range(0, len(payload), CHUNK):
                    out.write(member.compress(payload[at : at + CHUNK]))
                out.write(member.compress(b"\r\n\r\n") + member.flush())
                n, size = n + 1, size + len(payload)
                if size >= ROLL:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"archive": [name.rpartition("/")[2]], "n_records": pa.array([n], pa.int64())})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name.rpartition("/")[2]], "n_records": pa.array([n], pa.int64())})

    return records.mapInArrow(write, "archive string, n_records long")


def _records(stream):
    """(headers, iterator of payload chunks) for each record of an open archive; a chunk has CHUNK bytes at most."""
    buffer, inflate = b"", None

    def more() -> bool:
        nonlocal buffer, inflate
        while True:
            left = inflate.unused_data if inflate is not None and inflate.eof else inflate.unconsumed_tail if inflate is not None else b""
            data = left or stream.read(CHUNK)
            if not data:
                return False
            if inflate is None or inflate.eof:
                inflate = zlib.decompressobj(31)
            got = inflate.decompress(data, CHUNK)
            if got:
                buffer += got
                return True

    while True:
        while b"\r\n\r\n" not in buffer:
            if not more():
                return
        head, _, buffer = buffer.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])

        def chunks(left=int(headers["Content-Length"])):
            nonlocal buffer
            while left:
                while len(buffer) < min(left, CHUNK) and more():
                    pass
                piece, buffer = buffer[: min(left, CHUNK)], buffer[min(left, CHUNK) :]
                if not piece:
                    raise ValueError("an archive ends within a record")
                left -= len(piece)
                yield piece

        yield headers, chunks()
        while len(buffer) < 4 and more():
            pass
        if buffer[:4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        buffer = buffer[4:]


def read_chunks(archives: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The chunk table of archives (rows as of write_archives): a row for each record and chunk number.

    payload_bytes and payload_digest cover the record up to the chunk's end; `last` marks the row that covers
    all of it, stated_digest is that of the record's header. A record without payload has one row. Without payload,
    that column is null. A response whose payload isn't that of its digest is an error.
    """

    def read(batches):
        store, root = _open(folder)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                with store.open_input_stream(f"{root}/{archive}", compression=None) as stream:
                    rows = []
                    for head, parts in _records(stream):
                        total, size, k, rest, stated = hashlib.sha1(), 0, 0, int(head["Content-Length"]), head.get("WARC-Payload-Digest",
                            "").removeprefix("sha1:") or None
                        for part in parts if rest else [b""]:
                            total.update(part)
                            size += len(part)
                            number = lambda name: int(head[name]) if name in head else None  # noqa: B023, E731
                            rows.append((archive, head["WARC-Record-ID"], number("X-Page-ID"), head.get("WARC-Target-URI"), head["WARC-Type"],
                                number("X-Refers-To-Page"), k, len(part), size, total.hexdigest(), stated, size == rest, part if payload else None))
                            k += 1
                            if len(rows) >= (16 if payload else 2000):
                                yield _batch(rows)
                                rows = []
                        if head["WARC-Type"] == "response" and stated not in (None, total.hexdigest()):
                            raise ValueError(f"{archive}: the payload of {head['WARC-Record-ID']} isn't that of its digest")
                    if rows:
                        yield _batch(rows)

    # archives are dealt in turn: one a task where there are as many tasks
    return archives.select("archive").repartition(max(1, min(archives.count(), 10_000))).mapInArrow(read, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(),
        pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write pages (page_id integer, url, html) as WARC records and read them back.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, n_chunks, archive. Bytes and digest
    are those of the chunks read; a revisit has those of the response with its digest that it refers to.

    Null html is an empty payload. A null page_id is never a response to others: with a copy that has an id, it
    revisits that. Rows that repeat the largest page_id of a payload are all responses. Url may be null. Other
    columns are ignored. An empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    archives = keep(write_archives(roles(pages), folder), "archives")
    chunks = read_chunks(archives, folder, payload=False)
    whole = keep(chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "stated_digest", "record_type", "refers_to",
        (F.col("chunk") + 1).alias("n_chunks"), "archive"), "records")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_chunks", "archive"]
    responses, revisits = (whole.where(F.col("record_type") == kind) for kind in ("response", "revisit"))
    full = responses.where("page_id is not null").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated_digest"),
        F.col("payload_bytes").alias("full_bytes")).distinct()
    revisits = revisits.join(full, ["refers_to", "stated_digest"], "left").withColumn("payload_bytes",
        F.col("full_bytes")).withColumn("payload_digest", F.col("stated_digest"))
    return responses.select(columns).unionByName(revisits.select(columns))
