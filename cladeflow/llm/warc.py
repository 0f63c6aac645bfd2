"""WARC archives: an index first, then byte-range reads of the selected records.

Each task writes one archive of gzip members, a member for each record, and returns the index: file, offset, length,
URL and digest. Payloads that are equal, of ``LEAST_REVISIT`` bytes or more, are kept once: the record with the largest
page id is the response, the others are revisits that refer to it. Readers take any selection of index rows, sort them
by file and offset, join neighbours into one range, and read only these ranges.

Scale: the archives are written where the pages are. Equal payloads are found by one aggregation of digests. Reads are
dealt out by file and range. An archive is named after the task's attempt, and only the index of attempts that were
committed names it, so lost executors leave no wrong records.

Null payloads are empty. Pages with null ids take part, but are named ``none`` and are never referred to if another has
an id. Rows with the largest id and the same payload are all responses. Line breaks in URLs become ``%0A`` and ``%0D``.
A payload is one member, however long it is. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .spark_util import fresh_path, small_batches, stored

LEAST_REVISIT = 1000
#: Bytes between two records that are still read in one range, bytes of a range, and bytes of a file that one task reads.
MOST_GAP, MOST_RANGE, SHARE = 64 << 10, 8 << 20, 8 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset bigint, length bigint, url string, payload_digest string, record_type string, refers_to bigint"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit has the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    named = lambda x: f"<urn:page:{'none' if x is None else x}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {named(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {named(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + pack.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (names in lower case) and its payload."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest and refers_to (null for responses).

    Payloads that very many pages have are fewer than twice the partitions, so they are looked up by broadcast. Pages
    that need no look-up are dealt out by themselves, so neither small payloads nor common ones meet in one task.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select("page_id", "url", html.alias("payload"), F.sha1(html).alias("payload_digest"))
    large = pages.select("page_id", F.sha1(html).alias("same"), F.octet_length(html).alias("bytes")).filter(F.col("bytes") >= LEAST_REVISIT)
    copies = stored(large.groupBy("same").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "copies")
    common = F.col("n") > pages.count() // (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1
    hot = copies.filter(common).select(F.col("same").alias("hot_same"), F.col("first").alias("hot_first"))
    rest = copies.filter(~common).select("same", "first")
    looked = own.join(F.broadcast(hot), F.col("payload_digest") == F.col("hot_same"), "left")
    searched = F.col("hot_same").isNull() & (F.octet_length("payload") >= LEAST_REVISIT)
    key = F.when(searched, F.col("payload_digest")).otherwise(F.concat(F.lit("page "), F.xxhash64("page_id", "url").cast("string")))
    joined = looked.withColumn("key", key).join(rest, F.col("key") == F.col("same"), "left").withColumn("found", F.coalesce("first", "hot_first"))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("found")), F.col("found")).cast("bigint").alias("refers_to"))


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write the archives below ``path``; returns the index, with page_id, as a stored table."""
    small_batches(pages.sparkSession)
    schema = StructType([pages.schema["page_id"], *StructType.fromDDL(INDEX).fields])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        out, offset, file = None, 0, f"{path}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        try:
            for batch in batches:
                if out is None:
                    store, at = fs.FileSystem.from_uri(path)
                    store.create_dir(at, recursive=True)
                    out = store.open_output_stream(f"{at}/{file.rpartition('/')[2]}", compression=None)
                offsets, lengths = [], []
                columns = [c.to_pylist() for c in batch.columns]
                for page_id, url, payload, digest, refers_to in zip(*columns, strict=True):
                    member = record(page_id, url, payload.encode(), digest, refers_to)
                    out.write(member)
                    offsets.append(offset)
                    lengths.append(len(member))
                    offset += len(member)
                kinds = ["response" if x is None else "revisit" for x in columns[4]]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([file] * len(kinds), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), batch.column(1), batch.column(3), pa.array(kinds, pa.string()), batch.column(4)], names=schema.names)
        finally:
            if out is not None:
                out.close()

    return stored(with_revisits(pages).mapInArrow(write, schema), "warc-index")


def ranges(rows: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, int]]:
    """Neighbours among sorted (file, offset, length) joined: file, offset, end, and how many records."""
    now: list | None = None
    for file, offset, length in rows:
        if now and now[0] == file and offset - now[2] <= MOST_GAP and offset + length - now[1] <= MOST_RANGE:
            now[2], now[3] = max(now[2], offset + length), now[3] + 1
        else:
            if now:
                yield tuple(now)
            now = [file, offset, offset + length, 1]
    if now:
        yield tuple(now)


def read_records(selected: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows: page_id, record_type, url, payload_digest, refers_to, payload_bytes, payload.

    The payload and its size are null for revisits, which have none; so is the payload if it isn't asked for.
    """
    small_batches(selected.sparkSession)
    added = "record_type string, url string, payload_digest string, refers_to bigint, payload_bytes bigint" + ", payload binary" * with_payload
    schema = StructType([selected.schema["page_id"], *StructType.fromDDL(added).fields])
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        file, source = None, None
        for batch in batches:
            rows, out = list(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)), []
            k = 0
            for name, begin, end, count in ranges(iter(rows)):
                if name != file:
                    store, at = fs.FileSystem.from_uri(name)
                    file, source = name, store.open_input_file(at)
                source.seek(begin)
                data = source.read(end - begin)
                for _, offset, length in rows[k : k + count]:
                    headers, payload = parse_record(data[offset - begin : offset - begin + length])
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    refers = headers.get("warc-refers-to")
                    if refers is None and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{name} at {offset}: the payload doesn't match its digest")
                    whole = refers is None
                    out.append((headers["warc-type"], headers.get("warc-target-uri"), digest, None if whole else int(refers[len("<urn:page:") : -1]), len(payload) if whole else None, payload if whole else None))
                k += count
            columns = list(zip(*out, strict=True)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))][: len(schema)], names=schema.names)

    share = F.floor(F.col("offset") / SHARE)
    dealt = selected.select("page_id", "file", "offset", "length").repartition("file", share).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, schema)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url; a revisit's size is that of its response."""
    read = stored(records.select("page_id", "record_type", "url", "payload_digest", "refers_to", "payload_bytes"), "warc-records")
    originals = read.filter("record_type = 'response'").groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("same")).agg(F.max("payload_bytes").alias("size"))
    referred = read.filter("refers_to is not null").select(F.col("refers_to").alias("of"), F.col("payload_digest").alias("same")).distinct()
    sizes = stored(originals.join(referred, ["of", "same"]), "warc-sizes")
    joined = read.join(sizes, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("same")), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest", "record_type", F.col("refers_to").cast(read.schema["page_id"].dataType).alias("refers_to"), "url")


def archived(pages: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Write all pages, read all records back, and say what each is."""
    path = fresh_path(spark or pages.sparkSession, "warc")
    return resolved(read_records(write_archives(pages, path), with_payload=False))
