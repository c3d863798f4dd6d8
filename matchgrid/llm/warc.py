r"""WARC archives: one gzip member per record, written and read by Spark.

The format is a Spark data source (``df.write.format("warc")``,
``spark.read.format("warc")``) whose tasks stream to and from files.

Writing: of pages with equal payloads of at least ``LEAST_REVISIT`` bytes the
smallest page_id becomes the response, the others are revisit records that
name it. Only digests are grouped, and the repeated ones come back to the
pages: broadcast while they are at most ``BROADCAST_ROWS``, else in a join that AQE
splits where a payload is hot. Each record is a gzip member of its own; a file
is closed once it has ``FILE_BYTES``. Files carry the name of their attempt and are
moved to their place when the job commits, so a repeated task leaves nothing behind.
The commit fails unless the driver finds each file with the bytes that its task wrote,
and a reading task fails unless it sees a file as large as the driver does.

Paths are resolved as Hadoop's settings say, like those of Spark's own formats. On
a cluster a path on local disks is refused outside the folder that the cluster shares.
Tasks reach the file system through Arrow: local or mounted disks, hdfs and viewfs
(with libhdfs), s3 (s3a and s3n are taken for it), gs, abfs; credentials are those of the machines.

Reading is sequential within a file, in chunks of ``CHUNK`` bytes: zlib
decompresses chunk by chunk, a member's end starts the next record, header lines
and Content-Length frame its block, and block and payload digests (sha256, sha1,
md5; hex or base32) are computed as they stream by and verified. ``checked`` names the
digests that were, or ``unknown`` where a digest is of another kind. Records may be of any size:
``payload`` is null beyond ``LONGEST`` bytes, what a row can hold, while payload_bytes,
digests and checks are those of the whole. A record that is cut off, badly framed (or has
header lines of more than ``HEAD`` bytes) or fails a digest is returned with ``error`` set; after
damage reading goes back and on at the next member that holds a record. A task holds one
payload at a time besides the batch that it gives out, so files may be of any size.
The payload is what follows the HTTP header, in records that are not HTTP the whole block.

Null html is an empty payload. Ties: pages that share page_id and payload are all
responses if theirs is the smallest id; if all ids of a payload are null, all are responses.
Null page_ids come after all others. Null urls leave out the target header. Very long
payloads are one record each. An empty table gives no records. Other columns of ``pages``
are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from matchgrid.sources.store import discard, shared_dir, stored

LEAST_REVISIT = 100
#: Compressed bytes after which a file is closed; small files are read together up to GROUP_BYTES.
FILE_BYTES, GROUP_BYTES = 64 << 20, 4 << 20
CHUNK = 1 << 16
#: Bytes read from a file system at once.
READ_BYTES = 4 << 20
#: Payload bytes that a row holds, and bytes of header lines that are looked at.
LONGEST, HEAD = 1 << 30, 16 << 20
#: Repeated digests (some 100 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 200_000
MAGIC = b"\x1f\x8b\x08"
BLANK = b"\r\n\r\n"
#: Hadoop's schemes that Arrow knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, checked string, error string"


def sized(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, size) of every page."""
    payload = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"))


def repeated(rows: DataFrame) -> DataFrame:
    """(digest, first) of the payloads that several pages have, as a written table."""
    large = rows.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    return stored(large.filter("n > 1 and first is not null").select("digest", "first"), "repeated-payloads")


def typed(rows: DataFrame, several: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to) of every page."""
    if several.count() <= BROADCAST_ROWS:
        several = F.broadcast(several)
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.join(several, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to")
    )


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def member(page_id, url, payload: bytes, digest: str, record_type: str, refers_to) -> bytes:
    """One record as a gzip member."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if record_type == "response":
        block += payload
    lines = [f"WARC-Type: {record_type}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if record_type == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(3, wbits=31)
    return pack.compress("\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n") + pack.flush()


class Until:
    """Takes what streams in up to the first blank line and hands on what follows."""

    def __init__(self):
        self.kept, self.size, self.end, self.done = bytearray(), 0, b"", False

    def feed(self, data: bytes) -> bytes:
        if self.done:
            return data
        seen = self.end + data
        at = seen.find(BLANK)
        self.kept += data[: HEAD - len(self.kept)]
        if at < 0:
            self.size += len(data)
            self.end = seen[-3:]
            return b""
        self.done = True
        del self.kept[self.size - len(self.end) + at :]
        return seen[at + len(BLANK) :]

    def lines(self, code: str) -> list[str]:
        return bytes(self.kept).decode(code, "replace").split("\r\n")


def fields(lines: list[str]) -> dict[str, str]:
    """Header fields of the lines after the first."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def hashing(claim: str | None):
    """A hash of the kind that a digest header names; None for no digest or one of an unknown kind."""
    kind = (claim or "").partition(":")[0].strip().lower().replace("-", "")
    return hashlib.new(kind) if kind in ("sha256", "sha1", "md5") else None


def agrees(claim: str | None, found) -> bool | None:
    """Whether the digest header agrees with a hash of ``hashing``; None without one."""
    if found is None:
        return None
    value, digest = claim.partition(":")[2].strip(), found.digest()
    return value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def verified(claim: str | None, data: bytes) -> bool | None:
    """Whether the digest header agrees with the data; None for no digest or one of an unknown kind."""
    found = hashing(claim)
    if found is not None:
        found.update(data)
    return agrees(claim, found)


class Record:
    """One record as it streams in: its header, the sizes and hashes of block and payload, and a payload of up to LONGEST bytes."""

    def __init__(self, keep: bool = True):
        self.head, self.http, self.keep = Until(), None, keep
        self.start, self.size, self.headers, self.tail, self.error = b"", 0, None, b"", None
        self.payload, self.payload_size, self.block_hash, self.payload_hash = bytearray(), 0, None, None

    def feed(self, data: bytes) -> None:
        self.start += data[: 5 - len(self.start)]
        self.size += len(data)
        rest = self.head.feed(data)
        if not self.head.done:
            return
        if self.headers is None:
            self.begin()
        if self.left is not None:
            rest, after = rest[: self.left], rest[self.left :]
            self.left -= len(rest)
            self.tail += after[: 5 - len(self.tail)]
        if self.block_hash is not None:
            self.block_hash.update(rest)
        if self.http is not None:
            rest = self.http.feed(rest)
        self.payload_size += len(rest)
        if self.payload_hash is not None:
            self.payload_hash.update(rest)
        if self.keep:
            self.payload += rest
            if len(self.payload) > LONGEST:
                self.payload, self.keep = bytearray(), False

    def begin(self) -> None:
        """The header is whole: what is the block's size, and what is to be hashed?"""
        lines = self.head.lines("utf-8")
        self.headers = h = fields(lines)
        size, kind = h.get("content-length", ""), h.get("warc-type")
        good = self.head.size < HEAD and lines[0].startswith("WARC/") and size.isascii() and size.isdigit()
        self.error = None if good else "bad header"
        self.left = int(size) if good else None
        content = h.get("content-type", "").lower()
        if content.startswith("application/http") or (not content and kind in ("response", "request", "revisit")):
            self.http = Until()
        self.block_hash = hashing(h.get("warc-block-digest"))
        if kind == "revisit":  # its payload is in another record
            self.keep = False
        else:
            self.payload_hash = hashing(h.get("warc-payload-digest"))

    def row(self, error: str | None) -> tuple:
        """One row of RECORD."""
        if self.headers is None:
            self.headers, self.error = fields(self.head.lines("utf-8")), "bad header"
        elif self.error is None and (self.left or self.tail != BLANK):
            self.error = "bad length"
        h, error = self.headers, error or self.error
        kind, size = h.get("warc-type"), self.payload_size
        checked = []
        if error is None:
            for name, found in (("block", self.block_hash), ("payload", self.payload_hash)):
                claim = h.get(f"warc-{name}-digest") if name == "block" or kind != "revisit" else None
                good = agrees(claim, found)
                if good is False:
                    error = error or f"{name} digest"
                elif good or claim:
                    checked.append(name if good else "unknown")
        if kind == "revisit":
            own = fields(self.http.lines("latin-1")) if self.http else {}
            size = int(own["content-length"]) if own.get("content-length", "").isdigit() else 0
        payload = bytes(self.payload) if self.keep else None
        digest = h.get("warc-payload-digest", "").partition(":")[2].lower()
        return page_of(h.get("warc-record-id")), h.get("warc-target-uri"), kind, page_of(h.get("warc-refers-to")), size, digest, payload, ",".join(checked), error


def record(data: bytes | Record, error: str | None) -> tuple:
    """The row of a record that has streamed in, or of one given as bytes."""
    if not isinstance(data, Record):
        whole, data = data, Record()
        data.feed(whole)
    return data.row(error)


def members(stream, keep: bool = True) -> Iterator[tuple[Record, str | None]]:
    """The records of a file that is read in turn, each with an error or None; ``keep`` their payloads."""
    feed, at, lost = b"", 0, False  # bytes read but not used yet, and the place of the first of them
    while True:
        while lost and (found := feed.find(MAGIC)) != 0:
            # After damage: on to the next place that looks like a member.
            gone = found if found > 0 else max(0, len(feed) - 2)
            feed, at = feed[gone:], at + gone
            if found < 0:
                chunk = stream.read(CHUNK)
                if not chunk:
                    return
                feed += chunk
        one, unpack, error, zeros, used = Record(keep), zlib.decompressobj(wbits=31), None, True, 0
        while not unpack.eof:
            piece = feed or stream.read(CHUNK)
            feed = b""
            if not piece:
                break
            used += len(piece)
            zeros = zeros and not piece.strip(b"\0")
            try:
                one.feed(unpack.decompress(piece))
            except zlib.error:
                error = "cut off" if one.size else "not gzip"
                break
        if unpack.eof:
            feed = unpack.unused_data
            at += used - len(feed)
            if one.size and (not lost or one.start == b"WARC/"):
                yield one, None
                lost = False
            continue
        if zeros:  # padding
            if error is None:
                return
            at, lost = at + used, True
            continue
        if not lost or one.start == b"WARC/":
            yield one, error or "cut off"
        at, lost = at + 1, True
        stream.seek(at)


def resolved(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and place that Hadoop's settings give it; an error for one that only its machine would see."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()

    def qualified(given: str) -> str:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(given)
        return at.getFileSystem(hadoop).makeQualified(at).toString()

    full, master = qualified(path), spark.sparkContext.master
    if full.startswith("file:") and master != "local" and not master.startswith("local["):
        if not full.startswith(qualified(shared_dir(spark)) + "/"):
            raise ValueError(f"{full} is on the local disk of each machine: give a path in the folder of spark.checkpoint.dir or on a shared file system")
    if full.partition(":")[0] in SCHEMES:
        options = {"endpoint_override": hadoop.get("fs.s3a.endpoint"), "region": hadoop.get("fs.s3a.endpoint.region")}
        full += "?" * any(options.values()) + "&".join(f"{k}={quote(v, safe=':/')}" for k, v in options.items() if v)
    return full


def store_of(path: str):
    """The file system of a path of ``resolved`` and the path in it."""
    from pyarrow import fs

    scheme, given, rest = path.partition(":")
    if not given or "/" in scheme:
        return fs.LocalFileSystem(), path
    return (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


@dataclass
class Written(WriterCommitMessage):
    """The files of a task, as they are and as they shall be named, and their bytes."""

    files: list[tuple[str, str, int]]


class Writer(DataSourceArrowWriter):
    """Writes rows of ``typed``."""

    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes, self.job = path, file_bytes, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = store_of(self.path)
        store.create_dir(f"{folder}/_temporary", recursive=True)
        attempt, files, sizes, out = uuid.uuid4().hex, [], [], None
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    one = member(*(batch.column(c)[i].as_py() for c in ("page_id", "url", "payload", "digest", "record_type", "refers_to")))
                    if out is None:
                        name = f"{attempt}-{len(files):05}.warc.gz"
                        files.append((f"{folder}/_temporary/{name}", f"{folder}/{name}"))
                        sizes.append(0)
                        out = store.open_output_stream(files[-1][0], compression=None)
                    out.write(one)
                    sizes[-1] += len(one)
                    if sizes[-1] >= self.file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written([(*names, size) for names, size in zip(files, sizes, strict=True)])

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = store_of(self.path)
        for source, target, size in (f for m in messages if m for f in m.files):
            found = store.get_file_info(source)
            if found.size != size:
                raise OSError(f"{source} has {found.size} bytes here, its task wrote {size}: driver and executors do not see the same folder")
            store.move(source, target)
        store.create_dir(f"{folder}/_temporary", recursive=True)
        store.delete_dir(f"{folder}/_temporary")

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = store_of(self.path)
        for source, _, _ in (f for m in messages if m for f in m.files):
            store.delete_file(source)


@dataclass
class Files(InputPartition):
    """Files that one task reads in turn, with their bytes."""

    names: list[tuple[str, int]]


class Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, folder = store_of(self.path)
        found = store.get_file_info(fs.FileSelector(folder, recursive=True)) if store.get_file_info(folder).type == fs.FileType.Directory else [store.get_file_info(folder)]
        out, size = [], 0
        for f in sorted((f for f in found if f.path.endswith(".warc.gz") and "/_" not in f.path[len(folder) :]), key=lambda f: f.path):
            if not out or size + f.size > GROUP_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].names.append((f.path, f.size))
            size += f.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        rows, size = [], 0
        for name, length in partition.names:
            with store.open_input_file(name) as file:
                if file.size() != length:
                    raise OSError(f"{name} has {file.size()} bytes here, {length} where it was listed")
                for data, error in members(io.BufferedReader(file, READ_BYTES), "payload" in self.names):
                    rows.append(record(data, error))
                    size += len(rows[-1][6] or b"")
                    if size > 4 << 20 or len(rows) == 10_000:
                        yield self.batch(rows)
                        rows, size = [], 0
        yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        every = dict(zip(TYPES, zip(*rows, strict=True), strict=True)) if rows else dict.fromkeys(TYPES, ())
        return pa.RecordBatch.from_arrays([pa.array(every[n], TYPES[n]) for n in self.names], self.names)


TYPES = {c.split()[0]: {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in RECORD.split(", ")}


class WarcSource(DataSource):
    """Format ``warc``. Options: path; file_bytes (writing); payload, false to leave the payloads out (reading)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def columns(self) -> list[str]:
        bare = str(self.options.get("payload", "true")).lower() == "false"
        return [c for c in RECORD.split(", ") if not (bare and c == "payload binary")]

    def schema(self) -> str:
        return ", ".join(self.columns())

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], [c.split()[0] for c in self.columns()])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)))


def write(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write the records of ``pages`` (page_id, url, html) as archives under ``path``."""
    pages.sparkSession.dataSource.register(WarcSource)
    rows = sized(pages)
    several = repeated(rows)
    records = typed(rows, several).withColumn("payload", F.col("payload").cast("binary"))
    records.write.format("warc").option("file_bytes", file_bytes).mode("append").save(resolved(pages.sparkSession, path))
    discard(several)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Every record of the archives under ``path``."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(resolved(spark, path))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: what the archives of ``pages`` say of every page; the archives are deleted once they are read."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = stored(read(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "checked", "error"), "warc-pages")
    store, folder = store_of(resolved(spark, path))
    store.delete_dir(folder)
    return found


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to,
       CASE WHEN first IS NULL OR first = page_id THEN 'block,payload' ELSE 'block' END AS checked, NULL::VARCHAR AS error
FROM p LEFT JOIN f USING (d)
"""
