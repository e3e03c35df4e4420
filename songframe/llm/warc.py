"""WARC archives with an index first, and range reads by that index.

Each task writes archives of gzip members, one per record, into the shared folder and hands on one
index row per record: archive, offset, length, URL and payload digest. Readers select index rows, sort
them by place and fetch neighbours with one range read. Archive names are new for every attempt of a
task, and only what the index names is read, so lost or repeated tasks leave nothing that counts.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.llm.storage import Workspace

#: Payloads of at least this many bytes are written once.
LEAST_SHARED = 1000
#: Bytes after which a task starts its next archive.
ARCHIVE_BYTES = 1 << 30
#: Reads of one archive are joined over gaps up to GAP bytes, into ranges of at most about RANGE bytes.
GAP, RANGE = 1 << 16, 1 << 22
#: Bytes of an archive that one reading task takes at least.
STRETCH = 1 << 25

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, start long, length long"


def with_types(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """page_id, url, html, payload_digest, record_type, refers_to.

    Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is the
    response, and the others revisit it; rows that share that id are responses. A null payload is
    empty. A null id counts as smaller than any other.
    """
    keyed = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("payload_digest"))
    large = keyed.where(F.octet_length("html") >= least).select("page_id", "payload_digest")
    groups = large.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("c"))
    groups = groups.where("c > 1 and refers_to is not null").select("payload_digest", "refers_to")
    later = large.join(groups, "payload_digest").where("page_id is null or page_id <> refers_to").distinct()
    later = later.select(F.col("page_id").alias("own"), F.col("payload_digest").alias("digest"), "refers_to")
    out = keyed.join(later, F.expr("page_id <=> own and payload_digest = digest"), "left")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return out.select("page_id", "url", "html", "payload_digest", kind.alias("record_type"), "refers_to")


def record_name(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record. A revisit has the HTTP header of its payload, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_name(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=_PRINTED)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_PRINTED = "".join(map(chr, range(0x21, 0x7F)))


def parsed(raw: bytes) -> dict:
    """What a record says: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-ID"),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": int(http.rpartition(b"Content-Length: ")[2]),
        "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(),
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page"),
        "payload": None if fields["WARC-Type"] == "revisit" else payload,
    }


def _squeezed(raw: bytes) -> bytes:
    made = zlib.compressobj(1, zlib.DEFLATED, 31)
    return made.compress(raw) + made.flush()


def _writer(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, digest, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= limit:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    payload = (html or "").encode()
                    member = _squeezed(record(page_id, url, payload, digest, kind, refers_to))
                    out.write(member)
                    rows.append((page_id, url, len(payload), digest, kind, refers_to, name, at, len(member)))
                    at += len(member)
                columns = list(zip(*rows, strict=True)) or [()] * 9
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return run


def write(pages: DataFrame, space: Workspace, limit: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """Write a record per row of ``pages`` (page_id, url, html); the archives' folder and their index.

    The index is a table on disk before anything is read. Repeated rows get a record each; no rows
    give an empty index. Other columns of ``pages`` are not stored.
    """
    spark = pages.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    folder = space.folder("archives")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    return folder, space.keep(with_types(pages).mapInArrow(_writer(folder, limit), INDEX), "index")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        file, opened = None, None
        for batch in batches:
            archives, starts, lengths = (c.to_pylist() for c in batch.columns)
            at = 0
            while at < len(starts):
                end, stop = at + 1, starts[at] + lengths[at]
                while (
                    end < len(starts)
                    and archives[end] == archives[at]
                    and starts[end] - stop <= GAP
                    and starts[end] + lengths[end] - starts[at] <= RANGE
                ):
                    stop = max(stop, starts[end] + lengths[end])
                    end += 1
                if opened != archives[at]:
                    if file is not None:
                        file.close()
                    file, opened = store.open_input_file(f"{base}/{archives[at]}"), archives[at]
                data = file.read_at(stop - starts[at], starts[at])
                found = [
                    parsed(zlib.decompress(data[s - starts[at] : s - starts[at] + n], 31))
                    for s, n in zip(starts[at:end], lengths[at:end], strict=True)
                ]
                for one in found:
                    payload = one["payload"]
                    one["digest_ok"] = None if payload is None else hashlib.sha1(payload).hexdigest() == one["payload_digest"]
                yield pa.RecordBatch.from_pylist(found, _RECORDS)
                at = end
        if file is not None:
            file.close()

    return run


_RECORDS = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("digest_ok", pa.bool_()),
    ]
)


def read(folder: str, selected: DataFrame) -> DataFrame:
    """The records that rows of the index select, parsed from the archives in ``folder``.

    Index rows are dealt out by stretches of their archives and sorted by place, so neighbours share
    a read. ``payload`` and ``digest_ok`` are null for revisits; ``digest_ok`` tells whether the bytes
    read still have the recorded digest.
    """
    spark = selected.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    stretch = F.floor(F.col("start") / STRETCH)
    # index rows are tiny and what they point to is not, so the number of tasks follows the latter
    tasks = max(1, -(-selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] // STRETCH))
    places = selected.select("archive", "start", "length").repartition(tasks, "archive", stretch).sortWithinPartitions("archive", "start")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, digest_ok boolean"
    return places.mapInArrow(_reader(folder), schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op10: every page written and read back."""
    space = Workspace(spark)
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    archives, index = write(pages, space)
    return read(archives, index).drop("payload", "url")


ORACLE = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
g AS (SELECT payload_digest, max(page_id) AS last, count(*) AS c FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN c > 1 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN c > 1 AND page_id <> last THEN last END AS refers_to,
       CASE WHEN c > 1 AND page_id <> last THEN NULL ELSE TRUE END AS digest_ok
FROM p LEFT JOIN g USING (payload_digest)
"""
