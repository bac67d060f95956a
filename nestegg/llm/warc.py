r"""WARC archives: written as one gzip stream a file, normalised to one member a record, read back by an index.

1. :func:`typed_pages` decides each page's record. Of pages with equal payloads of at least
   ``min_bytes`` bytes the smallest page id is the ``response``; the others ``revisit`` it. Only
   digests that two or more pages share are kept for the lookup (a staged table: the planner sees
   its measured size and shuffles the pages only if it is large; keys are salted, so that one
   payload on a third of all pages is spread over ``SALT`` tasks).
2. :func:`write_archives` writes the records with Spark's own text writer, ``\r\n\r\n`` between
   records: each file is one monolithic gzip stream.
3. :func:`normalised` inflates every such stream once, in steps of ``STEP`` bytes, writes each
   record as a gzip member of its own, and returns the sidecar index (archive, offset, length,
   record id, type, target), which is staged. A task writes to a file named after its attempt, and
   the index holds the files of the attempts that Spark committed: a lost or repeated task leaves
   at most a file that no index row names.
4. :func:`records` reads single members back through the index.

Archives lie below the shared folder and are opened with ``pyarrow.fs`` (local or mounted paths, S3,
GCS, HDFS where libhdfs is installed), therefore tasks need nothing on their own disks. Memory is
bounded by a step and the largest record.

Defined cases: a null html is an empty payload; a null url becomes the target ``about:blank``, and
spaces and control characters of a url become ``%20``; rows that repeat the smallest page id of
their payload are responses too; null ids come last (they revisit the smallest id, and are
responses where no copy has an id); an empty table gives no archive and an empty result; a stream that
ends inside a record, or a record without a length, is an error; a stream that already consists of
several members is read like any other.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestegg.llm.common import bound_batches, shared_folder, shuffle_partitions, stage

MIN_BYTES = 100
SALT = 64
STEP, READ = 1 << 20, 64 << 10
END = b"\r\n\r\n"
GZIP = zlib.MAX_WBITS | 16
INDEX = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("record_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("target", T.StringType())])


class Record(NamedTuple):
    """The headers (names in lower case) and the block of one record, and its bytes as they stand in the archive."""

    headers: dict[str, str]
    block: bytes
    raw: bytes

    def http(self) -> tuple[dict[str, str], bytes]:
        """The headers and the payload of the http message in the block."""
        head, _, payload = self.block.partition(END)
        return parsed(head), payload


def parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}


def inflated(stream: BinaryIO, step: int = STEP) -> Iterator[bytes]:
    """What a gzip file holds, in steps: one stream or several members behind one another."""
    member, rest = zlib.decompressobj(GZIP), stream.read(READ)
    while rest:
        out = member.decompress(rest, step)
        if out:
            yield out
        while not member.eof and len(out) == step:  # there may be more, and no further input is needed
            out = member.decompress(member.unconsumed_tail, step)
            if out:
                yield out
        if member.eof:
            rest = member.unused_data or stream.read(READ)
            member = zlib.decompressobj(GZIP)
        elif not (rest := stream.read(READ)):
            raise ValueError("a gzip stream ends before its trailer")


def split_records(chunks: Iterable[bytes]) -> Iterator[Record]:
    """The records of a WARC stream; an incomplete one is an error."""
    chunks, held = iter(chunks), bytearray()

    def more() -> bool:
        held.extend(chunk := next(chunks, b""))
        return bool(chunk)

    while held or more():
        while (at := held.find(END)) < 0:
            if not more():
                raise ValueError("the archive ends inside the headers of a record")
        headers = parsed(bytes(held[:at]))
        if not held.startswith(b"WARC/") or not headers.get("content-length", "").isdigit():
            raise ValueError("this is no WARC record, or it has no length")
        block, end = at + len(END), at + 2 * len(END) + int(headers["content-length"])
        while len(held) < end:
            if not more():
                raise ValueError("the archive ends inside a record")
        raw = bytes(held[:end])
        del held[:end]
        if not raw.endswith(END):
            raise ValueError("a record is longer than its length says")
        yield Record(headers, raw[block : -len(END)], raw)


def as_member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return packer.compress(raw) + packer.flush()


def typed_pages(pages: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "page_id", url_col: str = "url",
                payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to; other columns take no part."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    shared = (
        rows.filter(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("digest"))
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .filter((F.col("copies") > 1) & F.col("first_id").isNotNull()).drop("copies"))
    shared = stage(shared, "warc-shared").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = rows.withColumn("dealt", F.when(F.col("payload_bytes") >= min_bytes, F.floor(F.rand(7) * SALT).cast("int")))
    joined = dealt.join(shared, (F.col("payload_digest") == F.col("digest")) & (F.col("dealt") == F.col("salt")), "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(*rows.columns, F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("first_id")).alias("refers_to"))


def urn(page_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(page_id.cast("string")), F.lit(">")), F.lit("<urn:page>"))


def page_id(record_id: str, kind: T.DataType) -> Column:
    """The id inside a record's name; null for pages without one."""
    inside = F.when(F.col(record_id).startswith("<urn:page:"), F.url_decode(F.regexp_extract(record_id, "^<urn:page:(.*)>$", 1)))
    return inside.cast(kind)


def record_texts(pages: DataFrame, date: str) -> DataFrame:
    """One column ``value``: the record of each row of :func:`typed_pages`, without the bytes that end it.

    A revisit's block is the http header of the full message, with its length, and no payload.
    """
    eol, revisit = F.lit("\r\n"), F.col("record_type") == "revisit"
    target = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), eol, eol)
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, eol)
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Target-URI", target), line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")))
    return pages.select(F.concat(head, eol, block).alias("value"))


def write_archives(records: DataFrame, folder: str) -> str:
    """Write ``value`` as monolithic archives: every file one gzip stream."""
    records.write.option("compression", "gzip").option("lineSep", END.decode()).text(folder)
    return folder


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a Hadoop path or URI; ``file:/x`` is a local path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (pafs.LocalFileSystem(), uri) if "://" not in uri else pafs.FileSystem.from_uri(uri)


def normalised(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """The index of the normalised archives of all ``.gz`` files in ``folder``; its rows are staged."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path")
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=INDEX.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                at = TaskContext.get()
                archive = f"{out}/{path.rsplit('/', 1)[-1].split('.')[0]}-{at.taskAttemptId()}.warc.gz"
                source, source_path = opened(path)
                target, target_path = opened(archive)
                target.create_dir(target_path.rsplit("/", 1)[0], recursive=True)
                rows, offset = [], 0
                with source.open_input_stream(source_path, compression=None) as stream, target.open_output_stream(target_path, compression=None) as sink:
                    for r in split_records(inflated(stream)):
                        sink.write(member := as_member(r.raw))
                        rows.append((archive, offset, len(member), r.headers["warc-record-id"], r.headers["warc-type"], r.headers.get("warc-target-uri")))
                        offset += len(member)
                        if len(rows) == 10_000:
                            yield as_batch(rows)
                            rows = []
                if rows:
                    yield as_batch(rows)

    return stage(files.mapInArrow(run, INDEX), "warc-index")


def records(index: DataFrame) -> DataFrame:
    """record_id, type, target, headers (map), http_headers (map), payload (binary) of the members that ``index`` names.

    Rows of one archive that follow one another are read through one open file.
    """
    text_map = T.MapType(T.StringType(), T.StringType())
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in ("record_id", "type", "target")), T.StructField("headers", text_map),
                           T.StructField("http_headers", text_map), T.StructField("payload", T.BinaryType())])
    arrow_map = pa.map_(pa.string(), pa.string())
    bound_batches(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows, held = [], 0
            for archive, offset, length, target in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length", "target"))):
                if archive != name:
                    if source is not None:
                        source.close()
                    system, path = opened(archive)
                    name, source = archive, system.open_input_file(path)
                (record,) = split_records([zlib.decompress(source.read_at(length, offset), GZIP)])
                http, payload = record.http()
                rows.append((record.headers["warc-record-id"], record.headers["warc-type"], target, list(record.headers.items()), list(http.items()), payload))
                held += len(payload)
                if held > 4 * STEP:
                    yield as_batch(rows)
                    rows, held = [], 0
            if rows:
                yield as_batch(rows)

    def as_batch(rows: list) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), arrow_map, arrow_map, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=schema.names)

    return index.mapInArrow(run, schema)


def archived(pages: DataFrame, date: str = "2026-01-01T00:00:00Z", min_bytes: int = MIN_BYTES, id_col: str = "page_id",
             url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """The sidecar index of ``pages``, written as WARC archives below the shared folder and normalised."""
    folder = shared_folder(pages.sparkSession, "warc")
    typed = typed_pages(pages, min_bytes, id_col, url_col, payload_col)
    write_archives(record_texts(typed, date), f"{folder}/monolithic")
    return normalised(pages.sparkSession, f"{folder}/monolithic", f"{folder}/normalised")


def checked(found: DataFrame) -> DataFrame:
    """record_id, payload_bytes, payload_digest, record_type, refers_to, from what :func:`records` read.

    A response's payload is measured and hashed anew, and must agree with its headers; a revisit
    states both for the payload it refers to.
    """
    schema = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
                           T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                headers, http = dict(r["headers"]), dict(r["http_headers"])
                size, digest = int(http["content-length"]), headers["warc-payload-digest"].removeprefix("sha256:")
                if r["type"] == "response" and (size, digest) != (len(r["payload"]), hashlib.sha256(r["payload"]).hexdigest()):
                    raise ValueError(f"record {r['record_id']} doesn't hold what its headers say")
                rows.append((r["record_id"], size, digest, r["type"], headers.get("warc-refers-to")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), *[pa.string()] * 3))], names=schema.names)

    return found.mapInArrow(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, as read back from its archives."""
    kind = pages.schema[id_col].dataType
    index = archived(pages, id_col=id_col, **options)
    members = index.repartition(shuffle_partitions(pages.sparkSession), "archive", F.floor(F.col("offset") / (8 * STEP))).sortWithinPartitions("archive", "offset")
    return checked(records(members)).select(
        page_id("record_id", kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", page_id("refers_to", kind).alias("refers_to"))
