"""WARC archives of web pages: a deterministic sharded writer, and a reader that verifies what it reads.

Records are sorted by page and cut into ranges of about equal size. The cuts are sums over the sorted records, so they
depend on the pages alone, not on how Spark dealt them; one task writes a range and rolls its files by compressed
size. So the same pages give the same files, byte for byte. Of pages with equal payloads of some length only
one is written whole (`response`); the others point to it (`revisit`). Which it is, and where the cuts are, is found on
rows without payloads; payloads are shuffled once, each straight to the range of its response.

Files get temporary names; once the whole job has ended they are renamed, and a manifest that names them is
published last by one rename. Readers go through the manifest, so half-written archives cannot be read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.settings import discard, settle

#: Fixed values of the archive format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31
#: Bytes that headers add to a record, for the cuts between ranges.
HEADER_BYTES = 600

FILES = "name string, temporary string, records long, bytes long, sha256 string"
RECORDS = ("file string, record_id string, record_type string, page_id string, target_uri string, "
           "payload_bytes long, payload_digest string, refers_to string, payload binary")


# Which records there are -----------------------------------------------------------------------------

def _key(prefix: str = "") -> Column:
    """Page and address as a struct that sorts nulls last."""
    page, url = F.col(f"{prefix}page_id"), F.col(f"{prefix}url")
    return F.struct(page.isNull().alias("no_page"), page.alias("page_id"), url.isNull().alias("no_url"), url.alias("url"))


def plan_records(pages: DataFrame, least_bytes: int) -> DataFrame:
    """One row per distinct (page, address, payload): how many copies, how many of them whole, what the others mean."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    size = F.octet_length(html).cast("long")
    keys = settle(pages.select(
        "page_id", F.col("url").cast("string").alias("url"), size.alias("payload_bytes"),
        F.sha2(html, 256).alias("digest"), F.when(size < least_bytes, html).alias("inline"))
        .groupBy("page_id", "url", "payload_bytes", "digest", "inline").agg(F.count(F.lit(1)).alias("copies")), "page_keys")
    shared = keys.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(
        F.min(_key()).alias("first"), F.sum("copies").alias("total")).where("total > 1").drop("total")
    own = F.when(F.col("payload_bytes") < least_bytes, F.col("copies")).when(
        F.col("first").isNull() | _key().eqNullSafe(F.col("first")), F.lit(1)).otherwise(0)
    return keys.join(shared, "digest", "left").withColumn("whole", own.cast("long"))


def in_ranges(records: DataFrame, range_bytes: int, most_ranges: int) -> tuple[DataFrame, int]:
    """The records in order with the range each belongs to, and the number of ranges.

    A range holds about `range_bytes`, or more where there would be over `most_ranges` of them.
    """
    columns = ["page_id", "url", "payload_bytes", "digest", "inline", "copies", "first", "whole"]
    order = [F.col("page_id").asc_nulls_last(), "digest", F.col("url").asc_nulls_last()]
    size = F.col("copies") * HEADER_BYTES + F.col("whole") * F.col("payload_bytes")

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        before = 0
        for batch in batches:
            ends = pc.add(pc.cumulative_sum(batch.column(batch.num_columns - 1)), before)
            yield pa.RecordBatch.from_arrays([*batch.columns, ends], [*batch.schema.names, "upto"])
            before = ends[len(ends) - 1].as_py() if len(ends) else before

    dealt = records.select(*columns, size.alias("size")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "part", F.spark_partition_id()).select("part", *columns, "size")
    schema = dealt.select("*", F.col("size").alias("upto")).schema
    placed = settle(dealt.mapInArrow(running, schema), "placed")
    parts = placed.groupBy("part").agg(F.max("upto").alias("held"))
    total = parts.agg(F.sum("held")).first()[0] or 0
    step = max(range_bytes, -(-int(total) // most_ranges))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    parts = parts.select("part", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"))
    copy = F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    single = placed.join(F.broadcast(parts), "part").select(
        "*", F.struct(F.col("digest"), "page_id", "url").alias("own"), copy.alias("copy", "_"))
    start = F.col("ahead") + F.col("upto") - F.col("size") + F.col("copy") * HEADER_BYTES + \
        F.least(F.col("copy"), "whole") * F.col("payload_bytes")
    return single.select(
        F.floor(start / step).cast("int").alias("range"), "page_id", "url", "payload_bytes", "digest", "inline",
        F.col("copy").cast("long").alias("copy"), (F.col("copy") < F.col("whole")).alias("response"),
        F.col("first.page_id").alias("first_page"), F.col("first.url").alias("first_url")), -(-int(total) // step)


# One record ------------------------------------------------------------------------------------------

def _text(value: object) -> str:
    """A value that is safe in a header line."""
    return quote(str(value), safe=":/?#[]@!$&'()*+,;=%-._~")


def record_id(page: object, digest: str, url: str | None, copy: int) -> str:
    name = "\0".join([repr(page), digest, repr(url), str(copy)])
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(name.encode()).hexdigest()[:32])}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers),
             f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def page_record(row: dict, payload: bytes | None, date: str) -> bytes:
    """The gzip member of a page: a response with its payload, or a revisit without."""
    digest = row["digest"] if payload is None else hashlib.sha256(payload).hexdigest()
    length = row["payload_bytes"] if payload is None else len(payload)
    if (digest, length) != (row["digest"], row["payload_bytes"]):
        raise ValueError(f"page {row['page_id']}: its payload is not the one of its digest")
    headers = [("WARC-Type", "revisit" if payload is None else "response"),
               ("WARC-Record-ID", record_id(row["page_id"], digest, row["url"], row["copy"])), ("WARC-Date", date),
               ("WARC-Target-URI", _text(row["url"] if row["url"] is not None else "about:blank")),
               ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if row["page_id"] is not None:
        headers.append(("Page-ID", quote(str(row["page_id"]), safe="")))
    if payload is None:
        headers += [("WARC-Profile", REVISIT_PROFILE),
                    ("WARC-Refers-To", record_id(row["first_page"], digest, row["first_url"], 0))]
        if row["first_page"] is not None:
            headers.append(("Refers-To-Page-ID", quote(str(row["first_page"]), safe="")))
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"
    return _record(headers, head.encode() + (payload or b""))


def info_record(name: str, date: str) -> bytes:
    own = hashlib.sha256(name.encode()).hexdigest()[:32]
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(own)}>"), ("WARC-Date", date),
                    ("WARC-Filename", name), ("Content-Type", "application/warc-fields")],
                   b"software: packetloom\r\nformat: WARC File Format 1.1\r\n")


# Files -----------------------------------------------------------------------------------------------

def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


class _File:
    """An archive under a temporary name, unique to the attempt of its task."""

    def __init__(self, folder: str, name: str, date: str):
        system, path = _filesystem(folder)
        self.name, self.temporary = name, f"{name}.{uuid.uuid4().hex}.tmp"
        self.stream = system.open_output_stream(f"{path}/{self.temporary}")
        self.records, self.bytes, self.digest = 0, 0, hashlib.sha256()
        self.add(info_record(name, date))

    def add(self, member: bytes) -> None:
        self.stream.write(member)
        self.digest.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> dict:
        self.stream.close()
        return {"name": self.name, "temporary": self.temporary, "records": self.records, "bytes": self.bytes,
                "sha256": self.digest.hexdigest()}


def _order(page: object, digest: str, url: str | None) -> tuple:
    """What records are sorted by, as a tuple that sorts like Spark's columns, nulls last."""
    return page is None, page, digest, url is None, url


class _Key:
    """A tuple of `_order` and a copy number; fields that are null are only met by other nulls."""

    __slots__ = ("value",)

    def __init__(self, value: tuple):
        self.value = value

    def __lt__(self, other: _Key) -> bool:
        for a, b in zip(self.value, other.value):
            if a != b:
                return a < b
        return False


def _sender(starts: list[tuple[int, tuple]], most_known: int = 200_000):
    """Give payloads the range of their response. A page that comes after another with its payload in the same task
    is a revisit whatever the other tasks hold, and is not sent; so copies meet before the shuffle."""
    ranges, keys = [r for r, _ in starts], [_Key(k) for _, k in starts]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Key] = {}
        for batch in batches:
            held, to = [], []
            for row, (page, url, digest) in enumerate(zip(*[batch.column(k).to_pylist() for k in range(3)])):
                own = _Key((*_order(page, digest, url), 0))
                seen = known.get(digest)
                if seen is None or own < seen:
                    if seen is not None or len(known) < most_known:
                        known[digest] = own
                    held.append(row)
                    to.append(ranges[bisect_right(keys, own) - 1])
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(held, pa.int64())).columns, pa.array(to, pa.int32())],
                                             [*batch.schema.names, "range"])
    return send


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one by one; a payload is taken out of it only when its turn comes."""
    columns = dict(zip(batch.schema.names, batch.columns))
    payloads = columns.pop("payload")
    for row, values in enumerate(zip(*[c.to_pylist() for c in columns.values()])):
        yield dict(zip(columns, values)) | {"payload": payloads[row]}


def _writer(folder: str, roll_bytes: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, done, sent = None, (-1, 0), [], (None, b"")
        for batch in batches:
            for row in _rows(batch):
                key = row["page_id"], row["digest"], row["url"]
                if row["turn"] == 0:  # the payload of the records that follow
                    sent = key, row["payload"]
                    continue
                if held is not None and (row["range"] != at[0] or held.bytes >= roll_bytes):
                    done.append(held.close())
                    held = None
                if held is None:
                    at = (row["range"], at[1] + 1 if row["range"] == at[0] else 0)
                    held = _File(folder, f"pages-{at[0]:06d}-{at[1]:05d}.warc.gz", date)
                payload = None
                if row["response"]:
                    text = row["payload"] if row["payload"].is_valid or sent[0] != key else sent[1]
                    payload = text.as_buffer().to_pybytes()
                held.add(page_record(row, payload, date))
        if held is not None:
            done.append(held.close())
        if done:
            yield pa.RecordBatch.from_pylist(done)
    return write


def _renamer(folder: str):
    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                final = f"{path}/{row['name']}"
                if system.get_file_info(final).size != row["bytes"]:  # not yet renamed by an earlier attempt
                    system.move(f"{path}/{row['temporary']}", final)
                if system.get_file_info(final).size != row["bytes"]:
                    raise OSError(f"{final} has not the size that was written")
            yield batch
    return rename


def _path(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 100, roll_bytes: int = 64 << 20,
                   range_bytes: int = 32 << 20, most_ranges: int = 20_000, date: str = "1970-01-01T00:00:00Z"
                   ) -> DataFrame:
    """Write `pages` (page_id, url, html) as WARC files into the new folder, and return its manifest.

    Of equal payloads of at least `least_bytes` the smallest page is a response, by address among equal page ids; a
    null page id counts as larger than any, a null html is empty, a null url is written `about:blank`. Repeated
    rows are further records. Without pages there are no files and an empty manifest. Other columns are not
    looked at. A page must fit in a task; a file ends with the record that reaches `roll_bytes`.
    """
    spark = pages.sparkSession
    system, target = _path(spark, f"{folder}/manifest")
    if system.exists(target):
        raise FileExistsError(f"{folder} holds archives already")
    system.mkdirs(target.getParent())
    records, ranges = in_ranges(plan_records(pages, least_bytes), range_bytes, most_ranges)
    records = settle(records, "records")
    starts = records.groupBy("range").agg(F.min(F.struct(
        F.col("page_id").isNull(), "page_id", "digest", F.col("url").isNull(), "url", "copy")).alias("start")).orderBy("range")
    starts = [(r["range"], tuple(r.start)) for r in starts.collect()]  # at most `most_ranges`
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    large = pages.select("page_id", F.col("url").cast("string").alias("url"), F.sha2(html, 256).alias("digest"),
                         html.alias("payload")).where(F.octet_length("payload") >= least_bytes)
    light = records.withColumnRenamed("inline", "payload")
    heavy = large.mapInArrow(_sender(starts), T.StructType([*large.schema.fields, light.schema["range"]]))
    dealt = light.withColumn("turn", F.lit(1)).unionByName(
        heavy.withColumn("turn", F.lit(0)), allowMissingColumns=True).repartitionById(
        max(1, ranges), F.col("range")).sortWithinPartitions(
        "range", F.col("page_id").asc_nulls_last(), "digest", F.col("url").asc_nulls_last(), "turn", "copy")
    written = settle(dealt.mapInArrow(_writer(folder, roll_bytes, date), FILES), "files")
    renamed = written.mapInArrow(_renamer(folder), FILES)
    staged = f"{folder}/manifest-{uuid.uuid4().hex}.tmp"
    renamed.drop("temporary").write.parquet(staged)
    if not system.rename(_path(spark, staged)[1], target):
        raise OSError(f"{folder}: its manifest cannot be published")
    for left in system.globStatus(_path(spark, f"{folder}/*.tmp")[1]) or []:  # of attempts that failed
        system.delete(left.getPath(), True)
    discard(records, written)
    return spark.read.schema(FILES).parquet(f"{folder}/manifest").drop("temporary")


# Reading ---------------------------------------------------------------------------------------------

def members(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file one by one."""
    squeezed, opener, parts = b"", zlib.decompressobj(GZIP), []
    while True:
        if not squeezed:
            squeezed = stream.read(step)
            if not squeezed:
                break
        parts.append(opener.decompress(squeezed))
        squeezed = opener.unused_data
        if opener.eof:
            yield b"".join(parts)
            opener, parts = zlib.decompressobj(GZIP), []
        else:
            squeezed = b""
    if parts and any(parts):
        raise ValueError("an archive ends inside a record")


def parse_record(data: bytes) -> tuple[dict, bytes]:
    """Headers and block of a record; its length and its block digest are verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a record: {lines[0][:40]}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    length = int(headers["Content-Length"])
    block = rest[:length]
    if rest[length:] != b"\r\n\r\n" or f"sha256:{hashlib.sha256(block).hexdigest()}" != headers["WARC-Block-Digest"]:
        raise ValueError(f"{headers['WARC-Record-ID']} is damaged")
    return headers, block


def _row(file: str, headers: dict, block: bytes, with_payload: bool) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(head.rpartition(b"Content-Length: ")[2])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{headers['WARC-Record-ID']}: its payload is damaged")
    page, refers = headers.get("Page-ID"), headers.get("Refers-To-Page-ID")
    return {"file": file, "record_id": headers["WARC-Record-ID"], "record_type": kind,
            "page_id": None if page is None else unquote(page), "target_uri": headers["WARC-Target-URI"],
            "payload_bytes": length, "payload_digest": digest,
            "refers_to": None if refers is None else unquote(refers),
            "payload": payload if with_payload and kind == "response" else None}


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True, task_bytes: int = 256 << 20) -> DataFrame:
    """The page records of the archives that the folder's manifest names, every length and digest verified.

    A task reads whole files one after another, about `task_bytes` of them at least if there are many.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(folder)
        schema = pa.schema([(f, pa.int64() if f == "payload_bytes" else pa.binary() if f == "payload" else pa.string())
                            for f in (c.split(" ")[0] for c in RECORDS.split(", "))])
        for batch in batches:
            for name, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held, found = [], 0, 0
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for data in members(stream):
                        found += 1
                        headers, block = parse_record(data)
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        rows.append(_row(name, headers, block, with_payload))
                        held += len(rows[-1]["payload"] or b"") + HEADER_BYTES
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if found != count:
                    raise ValueError(f"{name} has {found} records, its manifest {count}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.schema(FILES).parquet(f"{folder}/manifest")
    count, size = files.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    tasks = max(1, min(count, max(spark.sparkContext.defaultParallelism, (size or 0) // task_bytes)))
    place = (F.row_number().over(Window.orderBy("name")) - 1) % tasks  # a row for each file
    dealt = files.select("name", "records", place.cast("int").alias("place")).repartitionById(tasks, F.col("place"))
    return dealt.mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, folder: str, **options) -> DataFrame:
    """Write pages as archives, read them back, and return one row per record without its payload."""
    write_archives(pages, folder, **options)
    kind = pages.schema["page_id"].dataType
    spark = pages.sparkSession
    found = settle(read_archives(spark, folder, with_payload=False).select(
        F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind)), "read_back")
    system, path = _path(spark, folder)
    system.delete(path, True)
    return found
