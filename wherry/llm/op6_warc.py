"""WARC records in ZIP archives: write pages, then read them back by ranges.

Every task writes one archive with two stored members: ``archive/data.warc.gz`` (one gzip member for
each record) and ``indexes/index.cdx``, a line for each record with offset and length. The reader
parses the archive's directories, reads the index, and range-reads the records that follow one another
in pieces of ``READ_BYTES``; nothing is extracted.

Of records with equal payloads of at least ``REVISIT_BYTES``, the one with the largest page_id is the
response and the others are revisits without payload. Only digests and ids are grouped, never html;
the html is joined to the few digests that occur twice.

Attempts of a task write different files, and only the file whose name the finished task returned is
read, so lost executors leave unread files at most.

Defined cases: null html is the empty payload; null page_ids never win over others; rows that repeat the
winning id and payload are all responses; null urls become ``urn:page:<id>``; an empty table writes
nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wherry.llm.common import materialize, pieces, shared_dir, table
from wherry.llm.zipstore import StoredZipReader, StoredZipWriter, open_store

REVISIT_BYTES = 1000
READ_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _gzip(b: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(b) + z.flush()


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit (``refers_to`` given) has no payload block."""
    target = "".join(url.split()) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{_base32(digest)}",
        f"WARC-Payload-Length: {size}",
    ]
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case and the payload (the bytes after the HTTP header)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]))
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def record_kinds(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, size and refers_to (null: a response)."""
    made = pages.select(
        "page_id",
        "url",
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    again = made.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).filter("n > 1").select("digest", "winner")
    again = materialize(again)  # a plain table: Spark can then split the join's hot digests
    kinds = made.join(again, "digest", "left")
    return kinds.select("page_id", "url", "html", "digest", "size", F.when(F.col("page_id").eqNullSafe(F.col("winner")), F.lit(None)).otherwise(F.col("winner")).alias("refers_to"))


def write_archives(kinds: DataFrame, folder: str, zip64: bool = False) -> DataFrame:
    """Write the rows of ``record_kinds`` below ``folder``; one row (path, records) for each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = index = None
        for batch in pieces(batches):
            for page_id, url, html, digest, size, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    store, root = open_store(folder)
                    store.create_dir(root, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.zip"
                    sink = store.open_output_stream(f"{root}/{name}", compression=None)
                    writer, index = StoredZipWriter(sink, zip64), []
                    writer.start(DATA)
                packed = _gzip(warc_record(page_id, url, b"" if refers_to is not None else html.encode("utf-8"), digest, size, refers_to))
                index.append(f"{writer.write(packed)} {len(packed)}\n")
        if writer is not None:
            writer.start(INDEX)
            for s in range(0, len(index), 10_000):
                writer.write("".join(index[s : s + 10_000]).encode())
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64())], names=["path", "records"])

    return kinds.select("page_id", "url", "html", "digest", "size", "refers_to").mapInArrow(run, "path string, records long")


def _runs(index: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Records that lie side by side, in runs of about READ_BYTES."""
    run: list[tuple[int, int]] = []
    for offset, n in index:
        if run and (offset != run[-1][0] + run[-1][1] or offset + n - run[0][0] > READ_BYTES):
            yield run
            run = []
        run.append((offset, n))
    if run:
        yield run


def read_records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and payload of every record of an archive, by range reads."""
    store, name = open_store(path)
    with store.open_input_file(name) as source:
        archive = StoredZipReader(source)
        index = [tuple(map(int, line.split())) for line in archive.read(INDEX).decode().splitlines()]
        for run in _runs(index):
            base = run[0][0]
            piece = archive.read(DATA, base, run[-1][0] + run[-1][1] - base)
            for offset, n in run:
                yield parse_record(zlib.decompress(piece[offset - base : offset - base + n], 31))


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _id(urn: str | None) -> int | None:
    number = urn[len("<urn:page:") : -1] if urn else ""
    return int(number) if number else None


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records in the archives (path).

    A response's length and digest are taken from the bytes that were read; a revisit's from its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )

        for batch in batches:
            for path in batch.column(0).to_pylist():
                for head, payload in read_records(path):
                    if head["warc-type"] == "response":
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        if head["warc-payload-digest"] != f"sha1:{_base32(digest)}":
                            raise ValueError(f"{path}: the payload of {head['warc-record-id']} is not what its digest says")
                    else:
                        size, digest = int(head["warc-payload-length"]), base64.b32decode(head["warc-payload-digest"][5:]).hex()
                    rows.append((_id(head["warc-record-id"]), size, digest, head["warc-type"], _id(head.get("warc-refers-to"))))
                    if len(rows) >= 10_000:
                        yield out()
                        rows = []
        if rows:
            yield out()

    return archives.select("path").mapInArrow(run, READ_SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read every record back."""
    spark = pages.sparkSession
    archives = materialize(write_archives(record_kinds(pages), shared_dir(spark)))
    return read_archives(archives.repartition(max(1, archives.count())))  # a task for each archive; by number, so that they are not merged


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), w AS (
  SELECT d, max(page_id) AS winner FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1
)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN w.winner IS NULL OR w.winner = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN w.winner = p.page_id THEN NULL ELSE w.winner END AS refers_to
FROM p LEFT JOIN w ON p.d = w.d
"""
