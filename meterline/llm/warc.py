"""WARC archives: range-sorted deterministic shards, files rolled by compressed size, commit by rename and manifest."""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm import common

#: Compressed bytes after which a file is closed; payload bytes from which equal payloads are revisits.
ROLL_BYTES, LEAST_PAYLOAD = 64 << 20, 1000
DATE = "1970-01-01T00:00:00Z"
#: WARC/1.1 profile of a revisit with an identical payload (fixed value of the format).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_NAMESPACE = uuid.UUID("5b0c3c0e-6a0b-4f0a-9c52-6a1f6a3c1c11")
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"
_FILES = "temporary string, name string, records long, bytes long"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path; hdfs, s3 and the like work where pyarrow has them."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _sha(data: bytes) -> str:
    """Digest as WARC writes it: sha1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, digest: str, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {digest} {url}')}>"


def _uri(url: str | None) -> str:
    """A URL without bytes that would break a header line."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record, uncompressed. All headers come from the arguments, so equal arguments give equal bytes."""
    digest = hashlib.sha1(payload).hexdigest()
    target = _uri(url)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest, target)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: {_sha(payload)}",
        f"WARC-Block-Digest: {_sha(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if target:
        head.append(f"WARC-Target-URI: {target}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri); raises if digests do not hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(named["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or _sha(block) != named["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {named.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = base64.b32decode(named["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if named["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in {named.get('WARC-Record-ID')}")
    number = lambda key: int(named[key]) if key in named else None
    return number("X-Page-Id"), size, digest, named["WARC-Type"], number("X-Refers-To-Page-Id"), named.get("WARC-Target-URI")


class _Roller:
    """Writes a shard's records into numbered files under temporary names, one gzip member per record."""

    def __init__(self, root: str, attempt: str, roll: int) -> None:
        self.fs, self.root = _open(root)
        self.attempt, self.roll, self.out = attempt, roll, None
        self.done: list[tuple[str, str, int, int]] = []
        self.fs.create_dir(posixpath.join(self.root, "_temporary"))

    def write(self, shard: int, raw: bytes) -> None:
        if self.out is not None and (shard != self.shard or self.bytes >= self.roll):
            self.number = self.number + 1 if shard == self.shard else 0
            self.close()
        elif self.out is None:
            self.number = 0
        if self.out is None:
            self.shard, self.records, self.bytes = shard, 0, 0
            self.name = f"pages-{shard:07d}-{self.number:05d}.warc.gz"
            self.temporary = f"_temporary/{self.attempt}-{self.name}"
            self.out = self.fs.open_output_stream(posixpath.join(self.root, self.temporary))
        member = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = member.compress(raw) + member.flush()
        self.out.write(data)
        self.records += 1
        self.bytes += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.temporary, self.name, self.records, self.bytes))
            self.out = None


def _dealt(pages: DataFrame, shards: int, least_payload: int) -> DataFrame:
    """page_id, url, payload, refers_to and shard, the shards being equal ranges of page_id.

    Ranges come from the smallest and largest id and the number of rows, not from a sample, so every run cuts alike. A
    range with far more rows than its share is cut further by digest.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least_payload).groupBy("digest")
    twins = common.stored(large.agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "first"), "twins")
    low, high, n = rows.agg(F.min("page_id"), F.max("page_id"), F.count(F.lit(1))).first()
    low, width = low or 0, ((high or 0) - (low or 0)) // shards + 1
    cell = F.coalesce(F.floor((F.col("page_id") - low) / width), F.lit(0)).cast("long")
    counts = rows.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("in_cell"))
    share = max(1, -(-4 * n // shards))
    cuts = common.stored(counts.select("c", F.ceil(F.col("in_cell") / share).alias("cuts")).where("cuts > 1"), "heavy-ranges")
    joined = rows.withColumn("c", cell).join(cuts, "c", "left").join(twins, "digest", "left")
    cut = F.pmod(F.xxhash64("digest", "page_id", "url"), F.coalesce("cuts", F.lit(1)))
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"), (F.col("c") * (1 << 20) + cut).alias("shard"))


def write_archives(pages: DataFrame, path: str, shards: int | None = None, roll_bytes: int = ROLL_BYTES, least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """Writes ``pages`` as WARC files into the new folder ``path`` and returns the manifest: name, records, bytes.

    Of records with equal payloads of at least ``least_payload`` bytes the one with the largest page_id is a response,
    the others are revisits of it. Rows are dealt to ``shards`` (Spark's shuffle partitions unless given) ranges of
    page_id, sorted by page_id, digest and url, and written by one task per shard as a stream; a file is closed at
    ``roll_bytes`` compressed. Equal pages and shards give equal files, byte by byte.

    Tasks write under temporary names that hold their attempt. Spark's own commit keeps one attempt's list of files per
    task; only listed files are renamed, which may be repeated, and the manifest is written last. A reader takes files
    from the manifest alone, so lost executors and repeated tasks leave no trace in it.

    Null html is an empty payload, a null url has no target, a null page_id has no id header and lies in the first
    range; rows that repeat the largest id of equal payloads are all responses; an empty table gives an empty manifest;
    other columns are ignored. Payloads of up to 2 GB (Spark's limit) are held one at a time.
    """
    spark = pages.sparkSession
    shards = shards or common.partitions(spark)
    dealt = _dealt(pages, shards, least_payload)
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "page_id", F.sha1("payload"), "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        roller = _Roller(path, f"{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex}", roll_bytes)
        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i].as_py() for c in ("page_id", "url", "payload", "refers_to", "shard")]
                roller.write(row[4], record(*row[:4]))
        roller.close()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("temporary", "name", "records", "bytes"), f, strict=True)) for f in roller.done],
            schema=pa.schema([("temporary", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]),
        )

    dealt.mapInArrow(run, _FILES).write.mode("overwrite").parquet(f"{path}/_files")
    files = spark.read.schema(_FILES).parquet(f"{path}/_files")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(path)
        for batch in batches:
            for temporary, name, size in zip(*(batch.column(c).to_pylist() for c in ("temporary", "name", "bytes")), strict=True):
                source, target = posixpath.join(root, temporary), posixpath.join(root, name)
                if store.get_file_info(source).type == fs.FileType.File:
                    store.move(source, target)
                elif store.get_file_info(target).size != size:
                    raise OSError(f"{name} is neither under its temporary nor under its final name")
            yield batch

    files.mapInArrow(rename, _FILES).select("name", "records", "bytes").write.mode("overwrite").parquet(f"{path}/_manifest")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, records long, bytes long").parquet(f"{path}/_manifest")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files in the manifest, read as streams of members: page_id, payload_bytes, payload_digest
    (bare hex), record_type, refers_to, target_uri. Digests and the number of records are checked."""

    def members(stream) -> Iterator[bytes]:
        data = b""
        while True:
            inflate, out = zlib.decompressobj(31), []
            while not inflate.eof:
                data = data or stream.read(1 << 20)
                if not data:
                    if out:
                        raise EOFError("file ends inside a record")
                    return
                out.append(inflate.decompress(data))
                data = b""
            data = inflate.unused_data
            yield b"".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(path)
        schema = pa.schema(
            [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
             ("refers_to", pa.int64()), ("target_uri", pa.string())]
        )
        for batch in batches:
            for name, records in zip(batch.column("name").to_pylist(), batch.column("records").to_pylist(), strict=True):
                held, count = [], 0
                with store.open_input_stream(posixpath.join(root, name)) as stream:
                    for raw in members(stream):
                        held.append(dict(zip(schema.names, parse(raw), strict=True)))
                        count += 1
                        if len(held) == 4096:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held = []
                if count != records:
                    raise ValueError(f"{name} has {count} records, its manifest {records}")
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    files = manifest(spark, path)
    return files.repartition(common.partitions(spark), F.xxhash64("name")).mapInArrow(run, _RECORDS)
