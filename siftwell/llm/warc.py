"""WARC: a deterministic sharded writer and a reader.

Writing
1. Payload digests (SHA-1) and sizes are gathered for all pages.  Of pages with equal
   payloads of at least ``least_revisit`` bytes the one with the largest id is a response
   and the others revisit it; smaller payloads are responses all.
2. Shards are ranges of ids.  Ids and sizes, without payloads, are sorted over all partitions
   and added up; a new shard begins with the id that passes the next multiple of
   ``shard_bytes``.  So edges depend on the pages alone, not on partitions, a shard is larger
   than planned by one id's payloads at most, and the driver holds one id for each shard
   (choose ``shard_bytes`` for some 100,000 shards at most: 1 GB for 100 TB).
3. Pages and verdicts are shuffled once, each shard to a task of its own, and sorted by id; the
   task writes a run of files, rolled when their compressed size passes ``roll_bytes``.  Each
   record is a gzip member of its own; headers, block and payload digests are regenerated.
4. A file gets a temporary name of its attempt and is renamed when complete; its content is
   the same in every attempt, so retries and speculative copies do no harm.  The manifest of
   final files is written by Spark's own committer, last of all; readers follow the manifest
   only, so files of failed jobs are never read.  Temporary files that lost attempts have
   left are deleted then.

Files go through pyarrow's file systems by the folder's URI, so executors need no common
local disk but the folder itself.

Defined results
- null payload: empty payload.  null URL: the record has the target ``urn:x-no-url``.
- Rows that repeat an id and a payload: the first is as any other page, the next ones
  revisit that page's response.  One id with several payloads: separate records.
- null id: sorts below all others; a payload held only under null ids is a response each.
- Other columns are ignored; an empty table gives a manifest without files.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, power_of, shuffle_width, stored

# Names of the WARC 1.1 and HTTP/1.1 standards, and the date of a rewritten record.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
NO_URL = "urn:x-no-url"
MANIFEST = "_manifest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, payload_digest: str, turn: int = 0) -> str:
    """A version 8 UUID that holds the page id: others can be told it without a lookup."""
    tag = int.from_bytes(hashlib.sha1(f"{payload_digest}|{turn}".encode()).digest()[:6], "big")
    own = 0 if page_id is None else page_id & (1 << 64) - 1
    value = tag << 80 | 8 << 76 | (page_id is None) << 75 | own >> 62 << 64 | 2 << 62 | own & (1 << 62) - 1
    return uuid.UUID(int=value).urn


def page_of(urn: str) -> int | None:
    value = uuid.UUID(urn).int
    own = (value >> 64 & 3) << 62 | value & (1 << 62) - 1
    return None if value >> 75 & 1 else own - (own >> 63 << 64)


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member; the same bytes for the same record."""
    lines = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)  # 31: with a gzip header, which zlib leaves without time or name
    return deflate.compress(raw) + deflate.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, turn: int) -> bytes:
    digest = base32(hashlib.sha1(payload).digest())
    target = NO_URL if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    headers = [("WARC-Record-ID", f"<{record_id(page_id, digest, turn)}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(refers_to, digest)}>")]
    return record("revisit" if revisit else "response", headers, http if revisit else http + payload)


class ShardFiles:
    """The files of one shard; ``rows`` is their part of the manifest."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.rows, self.out = shard, roll_bytes, [], None

    def open(self) -> None:
        self.name = f"part-{self.shard:06d}-{len(self.rows):05d}.warc.gz"
        self.temp = posixpath.join(self.folder, f".{self.name}.{uuid.uuid4().hex}.tmp")
        self.out, self.size, self.n, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
        self.put(record("warcinfo", [("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, self.name).urn}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"software: siftwell\r\nformat: WARC File Format 1.1\r\n"))

    def put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.open()
        self.put(member)
        self.n += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, posixpath.join(self.folder, self.name))
            self.rows.append((self.shard, self.name, self.n, self.size, self.sha.hexdigest()))
            self.out = None


def shard_edges(meta: DataFrame, shard_bytes: int, partitions: int) -> list[int]:
    """The ids at which a new shard begins, ascending, from (page_id, n_bytes)."""
    by_id = meta.where("page_id is not null").groupBy("page_id").agg(F.sum(F.col("n_bytes") + 512).alias("size"))
    ordered = stored(by_id.repartitionByRange(partitions, "page_id").select(F.spark_partition_id().alias("p"), "page_id", "size"), "warc-sizes")
    before, sums = 0, []
    for p, size in ordered.groupBy("p").agg(F.sum("size")).orderBy("p").collect():
        sums.append((p, before))
        before += size
    if before <= shard_bytes:
        return []
    offset = meta.sparkSession.createDataFrame(sums, "p int, offset long")
    within = Window.partitionBy("p").orderBy("page_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = ordered.join(F.broadcast(offset), "p").select("page_id", F.floor((F.col("offset") + F.sum("size").over(within) - F.col("size")) / shard_bytes).alias("shard"))
    return sorted(r[0] for r in reached.groupBy("shard").agg(F.min("page_id").alias("first")).where("shard > 0").select("first").collect())


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = 0, shard_bytes: int = 8 << 20, roll_bytes: int = 2 << 20) -> DataFrame:
    """Write ``pages`` under ``folder``; returns the manifest (shard, file, n_records, n_bytes, sha256)."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))

    runs = power_of(4, max(64, shuffle_width(spark)), 4096)
    meta = rows.select("page_id", F.octet_length("payload").alias("n_bytes"), F.sha1("payload").alias("sha1"))
    meta = stored(meta.withColumn("run", F.pmod(F.xxhash64("page_id"), F.lit(runs))), "warc-meta")

    # A large group of equal payloads is spread over the runs, as in the exact dedup.
    by_run = meta.where(F.col("n_bytes") >= least_revisit).groupBy("run", "sha1", "n_bytes").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    groups = by_run.groupBy("sha1", "n_bytes").agg(F.max("last").alias("refers_to"), F.sum("n").alias("n")).where("n > 1 and refers_to is not null")
    spread = by_run.select("run", "sha1", "n_bytes").join(groups.drop("n"), ["sha1", "n_bytes"])
    verdicts = meta.join(spread, ["run", "sha1", "n_bytes"]).select("page_id", "sha1", "refers_to").distinct()

    edges = shard_edges(meta, shard_bytes, max(1, shuffle_width(spark)))
    # The shard of an id is the number of edges at or below it, found by halving.
    shard = F.lit(0)
    if edges:
        table, steps = F.array(*[F.lit(e) for e in edges]).cast("array<bigint>"), [1 << k for k in reversed(range(len(edges).bit_length()))]
        reached = lambda n, step: F.get(table, n + step - 1) <= F.col("page_id")  # noqa: E731  null past the end
        shard = F.aggregate(F.array(*[F.lit(k) for k in steps]), F.lit(0), lambda n, step: F.when(reached(n, step), n + step).otherwise(n))
    shard = F.coalesce(shard, F.lit(0)).cast("int")
    both = (
        rows.withColumn("sha1", F.lit(None).cast("string")).withColumn("refers_to", F.lit(None).cast("long")).withColumn("kind", F.lit(1))
        .unionByName(verdicts.withColumn("url", F.lit(None).cast("string")).withColumn("payload", F.lit(None).cast("binary")).withColumn("kind", F.lit(0)))
        .withColumn("shard", shard)
        .repartitionById(len(edges) + 1, F.col("shard"))
        .sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "kind", F.xxhash64("payload"), "payload", "url")
    )

    def write(batches):
        files, page, wanted, seen = None, "none yet", {}, {}
        for pdf in batches:
            for shard, page_id, url, payload, sha1, refers_to, kind in zip(pdf["shard"], pdf["page_id"], pdf["url"], pdf["payload"], pdf["sha1"], pdf["refers_to"], pdf["kind"]):
                page_id = None if pd.isna(page_id) else int(page_id)
                if files is None or files.shard != shard:
                    if files is not None:
                        files.close()
                        yield pd.DataFrame(files.rows, columns=["shard", "file", "n_records", "n_bytes", "sha256"])
                    files, page = ShardFiles(folder, int(shard), roll_bytes), "none yet"
                if page != page_id:
                    page, wanted, seen = page_id, {}, {}
                if not kind:
                    wanted[sha1] = int(refers_to)
                    continue
                own = hashlib.sha1(payload).hexdigest()
                turn = seen[own] = seen.get(own, -1) + 1
                target = wanted.get(own)
                revisit = target is not None and (target != page_id or turn > 0)
                files.add(page_record(page_id, url, payload, target, revisit, turn))
        if files is not None:
            files.close()
            yield pd.DataFrame(files.rows, columns=["shard", "file", "n_records", "n_bytes", "sha256"])

    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)
    done = both.select("shard", "page_id", "url", "payload", "sha1", "refers_to", "kind").mapInPandas(write, "shard int, file string, n_records long, n_bytes long, sha256 string")
    manifest = stored(done, "warc-manifest", f"{folder}/{MANIFEST}")
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for left in system.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/.part-*.tmp")) or []:
        system.delete(left.getPath(), False)
    return manifest


def records(stream):
    """(headers, block) of each record of a stream of gzip members, one member in memory at a time."""
    rest = b""
    while True:
        inflate, raw = zlib.decompressobj(31), []
        while not inflate.eof:
            rest = rest or stream.read(1 << 16)
            if not rest:
                break
            raw.append(inflate.decompress(rest))
            rest = inflate.unused_data if inflate.eof else b""
        if not raw:
            return
        if not inflate.eof:
            raise ValueError("a record is cut short")
        head, _, body = b"".join(raw).partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines)
        if first != VERSION or body[-4:] != b"\r\n\r\n" or len(body) - 4 != int(headers["Content-Length"]):
            raise ValueError(f"a record is damaged: {first}")
        yield headers, body[:-4]


def read_warc(spark, folder: str) -> DataFrame:
    """The page records of the files in the manifest, digests and file checksums verified.

    Columns: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null in revisits), file.
    """
    manifest = spark.read.schema("shard int, file string, n_records long, n_bytes long, sha256 string").parquet(f"{folder}/{MANIFEST}")

    def read(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            for name, n_records in zip(pdf["file"], pdf["n_records"]):
                rows = []
                n = size = 0
                with system.open_input_stream(posixpath.join(base, name), compression=None) as stream:
                    for headers, block in records(stream):
                        if headers["WARC-Block-Digest"] != f"sha1:{base32(hashlib.sha1(block).digest())}":
                            raise ValueError(f"{name}: a block differs from its digest")
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != length or base32(hashlib.sha1(payload).digest()) != digest):
                            raise ValueError(f"{name}: a payload differs from its digest")
                        back = page_of(headers["WARC-Refers-To"].strip("<>")) if kind == "revisit" else None
                        url = None if headers["WARC-Target-URI"] == NO_URL else headers["WARC-Target-URI"]
                        rows.append((page_of(headers["WARC-Record-ID"].strip("<>")), url, length, digest, kind, back, payload if kind == "response" else None, name))
                        n, size = n + 1, size + len(block)
                        if size >= 4 << 20:
                            yield frame(rows)
                            rows, size = [], 0
                if n != n_records:
                    raise ValueError(f"{name}: {n} records, {n_records} in the manifest")
                if rows:
                    yield frame(rows)

    def frame(rows):
        out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "file"], dtype=object)
        for c in ("page_id", "refers_to"):
            out[c] = out[c].astype("Int64")
        return out.astype({"payload_bytes": "int64"})

    # A file is the unit of work: it is one row here, dealt out by its name.
    files = manifest.select("file", "n_records").repartition(max(shuffle_width(spark), 16), "file")
    return files.mapInPandas(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, file string")


def warc_round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write ``pages`` and read the archives back."""
    folder = folder or new_path(pages.sparkSession, "warc")
    write_warc(pages, folder, **options)
    return read_warc(pages.sparkSession, folder)
