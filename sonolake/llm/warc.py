"""WARC archives: writer of monolithic files, normaliser, indexed reader.

``write`` makes WARC files that are one gzip stream each, with Spark's text writer: records are its lines, and what
ends a record is its separator.  ``normalise`` reads such files, from here or elsewhere, with Spark's text reader, which
inflates a whole file's stream once, front to back, in bounded memory; it rewrites every record as its own gzip member
and writes archives with sidecar indexes (offset, length, record).  ``read`` opens single members by their offsets.  All
files are written by executors under Spark's commit protocol, in any store that Spark reaches: ``name=X.warc.gz`` and
``name=X.cdx`` are folders of one file.

The text writer ends each file with its separator, one zero byte here.  In an archive that byte is the last of a gzip
member, the highest of its length: where a member's is another, an empty member follows.  An index has it after its
last line.

Defined results: a null payload is empty; a null url is an empty target; repeated rows of the smallest page_id are all
responses; a null page_id never is a response that others refer to, and is itself a response unless a page with an id
has the same payload; a payload of any length that a row can hold is one record; columns other than page_id, url and
html are not read, whatever their names; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, new_folder, stage, tasks_for

RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
DATE = b"2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes after which an archive is closed.
ROTATE = 8 << 20
EMPTY = zlib.compressobj(6, wbits=31).flush()


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to and its url (null for responses): equal payloads refer to their smallest page_id."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("sha", F.unhex(F.sha1("payload")))
    firsts = base.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    firsts = stage(firsts.select("sha", "first", "first_url"), "firsts")  # so that both sides of the join have an exchange, which AQE can split
    own = F.col("page_id").eqNullSafe(F.col("first"))
    return base.join(firsts, "sha", "left").select("page_id", "url", "payload", F.when(~own, F.col("first")).alias("refers_to"), F.when(~own, F.col("first_url")).alias("refers_url"))


def _target(url: str) -> bytes:
    return url.encode().replace(b"\r", b"%0D").replace(b"\n", b"%0A")


def record(name: str, page, url: str, payload: bytes, refers, refers_url: str | None) -> bytes:
    """One uncompressed WARC record; a revisit keeps its payload's digest and length, not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    kind, body = (b"response", payload) if refers is None else (b"revisit", b"")
    head = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:x-record:%s>" % name.encode(), b"WARC-Target-URI: " + _target(url), b"WARC-Date: " + DATE, b"WARC-Payload-Digest: sha1:" + digest, b"X-Payload-Length: %d" % len(payload)]
    if page is not None:
        head.append(b"X-Page: %d" % page)
    if refers is not None:
        head += [b"WARC-Refers-To-Target-URI: " + _target(refers_url or ""), b"WARC-Refers-To-Date: " + DATE, b"WARC-Profile: " + PROFILE, b"X-Refers-To-Page: %d" % refers]
    return b"\r\n".join([*head, b"Content-Length: %d" % len(body), b"", b""]) + body + END


def parse(raw: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """Headers and block of one record."""
    head, _, rest = raw.partition(END)
    fields = dict(x.split(b": ", 1) if b": " in x else (x.rstrip(b":"), b"") for x in head.split(b"\r\n")[1:])
    return fields, rest[: int(fields[b"Content-Length"])]


def _records(batches):
    part, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))
            made = []
            for page, url, payload, refers, refers_url in rows:
                made.append(record(f"{part}-{k}", page, url, payload, refers, refers_url)[: -len(END)])
                k += 1
            yield pa.record_batch([pa.array(made, pa.binary())], names=["value"])


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """Monolithic WARC files of a table of pages, one gzip stream each."""
    records = mark_revisits(pages, least_bytes).mapInArrow(_records, "value binary")
    records.select(F.col("value").cast("string").alias("value")).write.option("compression", "gzip").option("lineSep", END.decode()).text(folder)


def split_stream(pieces):
    """Whole raw records of an inflated stream that arrives in pieces; holds one record at a time."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(END)
                if end < 0:
                    break
                at = held.find(b"\r\nContent-Length: ", 0, end)
                if at < 0:
                    raise ValueError("a record has no Content-Length")
                need = end + 4 + int(held[at + 18 : end].split(b"\r\n")[0]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("the stream ends inside a record")


class Archive:
    """Members and index lines of an archive while it is written."""

    def __init__(self, stem: str):
        self.stem, self.part = stem, 0
        self.members, self.lines, self.size = [], [], 0

    def add(self, raw: bytes) -> None:
        fields, _ = parse(raw)
        pack = zlib.compressobj(6, wbits=31)
        member = pack.compress(raw) + pack.flush()
        self.lines.append(f"{self.size} {len(member)} {fields[b'WARC-Type'].decode()} {fields[b'WARC-Record-ID'].decode()}\n")
        self.members.append(member)
        self.size += len(member)

    def close(self) -> pa.RecordBatch:
        """The archive and its index as files without the last byte, which is zero."""
        name = f"{self.stem}-{self.part:05d}"
        if self.members[-1][-1]:
            self.members.append(EMPTY)
        files = pa.array([b"".join(self.members)[:-1], "".join(self.lines).encode()], pa.binary())
        self.part, self.members, self.lines, self.size = self.part + 1, [], [], 0
        return pa.record_batch([pa.array([f"{name}.warc.gz", f"{name}.cdx"]), files], names=["name", "value"])


def _normalise(rotate: int):
    def work(batches):
        # (file, piece) rows in order to batches of files; a file's pieces follow one another.
        rows = ((p, v) for b in batches for p, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        first = next(rows, None)
        while first is not None:
            mine = first[0]
            name = mine.rsplit("/", 1)[-1]
            out = Archive(f"{hashlib.md5(mine.encode()).hexdigest()[:8]}-{name.removesuffix('.gz').removesuffix('.txt').removesuffix('.warc')}")
            following: list = []

            def mine_only(first=first, mine=mine, following=following):
                yield first[1] + END
                for at, piece in rows:
                    if at != mine:
                        following.append((at, piece))
                        return
                    yield piece + END

            for raw in split_stream(mine_only()):
                out.add(raw)
                if out.size >= rotate:
                    yield out.close()
            if out.members:
                yield out.close()
            first = following[0] if following else None

    return work


def normalise(spark: SparkSession, source: str, folder: str, rotate: int = ROTATE) -> None:
    """Archives of a member for each record, with sidecar indexes, of all gzip files in a folder."""
    lines = spark.read.option("lineSep", END.decode()).text(source)
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value"))
    files = rows.mapInArrow(_normalise(rotate), "name string, value binary")
    files.select("name", F.col("value").cast("string").alias("value")).write.partitionBy("name").option("lineSep", "\0").text(folder)


def read_record(body: bytes, offset: int, length: int) -> tuple:
    """One record by its index entry, its digest checked against its payload."""
    fields, block = parse(zlib.decompress(body[offset : offset + length], 31))
    digest, size = fields[b"WARC-Payload-Digest"].partition(b":")[2].decode(), int(fields[b"X-Payload-Length"])
    kind = fields[b"WARC-Type"].decode()
    if kind == "response" and (len(block) != size or base64.b32encode(hashlib.sha1(block).digest()).decode() != digest):
        raise ValueError(f"payload and digest differ: {fields[b'WARC-Record-ID']!r}")
    page, refers = fields.get(b"X-Page"), fields.get(b"X-Refers-To-Page")
    return None if page is None else int(page), size, digest, kind, None if refers is None else int(refers)


def _read(batches):
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for body, index in zip(batch.column(0), batch.column(1)):
            body = memoryview(body.as_buffer())
            rows = [read_record(body, *map(int, x.split(b" ", 2)[:2])) for x in index.as_py().strip(b"\0\n").split(b"\n") if x]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of normalised archives, by their indexes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    named = files.select(F.regexp_extract("path", "name=([^/]+)[.](warc[.]gz|cdx)/", 1).alias("stem"), F.regexp_extract("path", "[.](warc[.]gz|cdx)/", 1).alias("kind"), "content")
    index = named.where("kind = 'cdx'").select("stem", F.col("content").alias("index"))
    tasks = tasks_for(index.select("stem").count())  # so that a task's archives do not grow with their number
    bodies = named.where("kind = 'warc.gz'").select("stem", "content").repartition(tasks, "stem")
    return bodies.join(index.repartition(tasks, "stem"), "stem").select("content", "index").mapInArrow(_read, RECORD)


def round_trip(pages: DataFrame, least_bytes: int = 0, rotate: int = ROTATE) -> DataFrame:
    """What is read back of a table of pages: written as monolithic files, normalised, opened by index."""
    spark = pages.sparkSession
    source, folder = new_folder(spark, "monoliths"), new_folder(spark, "archives")
    write(pages, source, least_bytes)
    normalise(spark, source, folder, rotate)
    delete(spark, source)
    return read(spark, folder)
