"""WARC archives with dictionary-compressed records.

Of records with equal payloads of at least ``least`` bytes, the one with the largest page_id is a response and
the others are revisits of it. Each record is a Zstandard frame of its own, compressed with a dictionary built from a
bounded sample of the records; an archive begins with the dictionary in a skippable frame (magic 0x184D2A5D), and an
empty skippable frame ends each record, which readers step over.

Archives go through Spark's text writer: a row is the bytes of one frame, and the "line separator" is that
empty skippable frame. So they reach any file system that Spark writes to, under its commit protocol, and a lost task is
written again. An archive ends after RECORDS records, or ARCHIVE_BYTES if that comes first: empty skippable frames then fill up its
rows, for Spark's writer counts rows. So an archive, which is read back as one binary file, is never longer than ARCHIVE_BYTES and one
record. The text writer takes the frames as they are, for Spark's cast from binary to string checks nothing.

Only payloads that may be in a group are shuffled: a bitmap of the groups' digests (8 MiB at most) sends the others straight to the writer.

Defined results: a null html is an empty payload; rows of one page_id with equal payloads are all responses, under one
record id; a null page_id is never referred to, so its record is a response; an empty table gives an empty one. A payload must fit
into a row (2 GB). Other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

LEAST = 1000
DICTIONARY_FRAME = struct.pack("<I", 0x184D2A5D)
GAP = b"P*M\x18\0\0\0\0"
FRAME = b"\x28\xb5\x2f\xfd"
#: Records after which an archive ends; one row more goes to a file, for the dictionary.
RECORDS, ARCHIVE_BYTES = 2000, 64 << 20
#: A group's row is repeated this many times for the join, so that the rows of a hot payload go to as many tasks.
SALTS = 16
#: The dictionary's sample: about this many records of at most SAMPLE_BYTES.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 600, 1 << 16, 1 << 16
LEVEL = 3
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
STAMP = "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header only."""
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    target = (url or "").replace("\r", "").replace("\n", "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}|{target}|{digest}')}>",
        f"WARC-Date: {STAMP}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its block headers."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    size = flags >> 6
    at += 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[size]
    while True:
        head = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + (4 if flags >> 2 & 1 else 0)


def frames(archive: bytes) -> Iterator[bytes]:
    """Decompressed records of an archive."""
    view, at = memoryview(archive), 0
    decompressor = zstandard.ZstdDecompressor()
    while at < len(view):
        magic = bytes(view[at : at + 4])
        if magic == FRAME:
            end = frame_end(view, at)
            yield decompressor.decompress(view[at:end])
            at = end
        elif magic[1:] == b"\x2a\x4d\x18" and magic[0] >> 4 == 5:
            size = struct.unpack("<I", view[at + 4 : at + 8])[0]
            if magic == DICTIONARY_FRAME:
                found = bytes(view[at + 8 : at + 8 + size])
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(found))
            at += 8 + size
        else:
            raise ValueError(f"no frame at byte {at}")


def _payload_digest():
    return F.sha1(F.coalesce(F.col("html"), F.lit("")))


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses)."""
    base = pages.select("page_id", "url", "html", _payload_digest().alias("digest"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes"))
    large = base.where((F.col("bytes") >= least) & F.col("page_id").isNotNull())
    groups = large.groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.min("page_id").alias("last")).where("first <> last")
    groups = runtime.cut(groups.select(F.col("digest").alias("g"), F.col("bytes").alias("gb"), "first"))
    marked, maybe = runtime.marked(base, F.col("digest"), runtime.bitmap(groups, "g"))
    maybe = maybe & (F.col("bytes") >= least) & F.col("page_id").isNotNull()
    out = ["page_id", "url", "html", "digest"]
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = (F.col("digest") == F.col("g")) & (F.col("bytes") == F.col("gb")) & (F.pmod(F.xxhash64("page_id"), F.lit(SALTS)) == F.col("salt"))
    joined = marked.where(maybe).select(*out, "bytes").join(salted, same, "left")
    joined = joined.select(*out, F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))
    return joined.unionByName(marked.where(~maybe).select(*out, F.lit(None).cast(base.schema["page_id"].dataType).alias("refers_to")))


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from about SAMPLE records; empty where there are too few of them."""
    n = pages.count()
    if n < 8:
        return b""
    share = min(1.0, SAMPLE / n)
    low = F.xxhash64("page_id") < min(2**63 - 1, int(-(2**63) + share * 2**64))
    rows = pages.where(low & (F.octet_length("html") <= SAMPLE_BYTES)).select("page_id", "url", "html", _payload_digest()).limit(2 * SAMPLE).collect()
    samples = [record(r[0], r[1], (r[2] or "").encode(), None, r[3]) for r in sorted(rows, key=lambda r: (r[0] is None, r[0]))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:  # too little to learn from
        return b""


def write(pages: DataFrame, path: str, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of all pages in the folder ``path``."""
    runtime.prepare(pages.sparkSession)
    dictionary = train_dictionary(pages)
    shared = pages.sparkSession.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(found)) if found else zstandard.ZstdCompressor(level=LEVEL)
        first = DICTIONARY_FRAME + struct.pack("<I", len(found)) + found if found else GAP
        written = size = 0
        for batch in batches:
            out = []
            for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= archive_bytes:
                    out += [b""] * (-written % RECORDS)
                    written, size = 0, 0
                if written % RECORDS == 0:
                    out.append(first)
                    size = len(first)
                out.append(compressor.compress(record(page_id, url, (html or "").encode(), refers, digest)))
                written += 1
                size += len(out[-1]) + len(GAP)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    rows = plan(pages, least).mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    rows.write.option("lineSep", GAP.decode()).option("maxRecordsPerFile", RECORDS + 1).option("compression", "none").mode("overwrite").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, url, record_type, refers_to, payload_digest (of the header), payload (null for revisits)."""
    runtime.prepare(spark)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows: list[tuple] = []
                size = 0
                for data in frames(archive.as_py()):
                    fields, payload = parse(data)
                    revisit = fields["warc-type"] == "revisit"
                    digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                    page = fields["x-page-id"]
                    rows.append((int(page) if page else None, fields["warc-target-uri"], fields["warc-type"], int(fields["x-refers-to-page-id"]) if revisit else None, digest, None if revisit else payload))
                    size += len(payload)
                    if size >= runtime.ARROW_BYTES:
                        yield packed(rows)
                        rows, size = [], 0
                if rows:
                    yield packed(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary")


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write archives to the shared folder, read them back, and tell what each page's record holds.

    A response's bytes and digest are those of the payload read back; a revisit's are those of the response that it
    refers to, provided that its own digest says the same (an error otherwise).
    """
    spark = pages.sparkSession
    path = f"{runtime.shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages.select("page_id", "url", "html"), path, least)
    found = read(spark, path).withColumns({"payload_bytes": F.length("payload").cast("long"), "read_digest": F.sha1("payload")}).drop("payload", "url")
    found = runtime.cut(found)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    referred = found.where("refers_to IS NULL AND page_id IS NOT NULL").select(F.col("page_id").alias("r"), F.col("read_digest").alias("d"), F.col("payload_bytes").alias("b")).distinct()
    both = found.join(referred, (F.col("refers_to") == F.col("r")) & (F.col("payload_digest") == F.col("d")), "left")
    digest = F.coalesce("read_digest", "d")
    checked = F.when(digest == F.col("payload_digest"), digest).otherwise(F.raise_error(F.concat(F.lit("digest of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))).cast("string")))
    return both.select("page_id", F.coalesce("payload_bytes", "b").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST} AND page_id <> top THEN top END AS refers_to
FROM s
"""
