"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent frames, each holding whole records, and ends with a seek table in a
skippable frame (the published seekable format). An index maps record identifiers to the bundle, the frame
and the offset inside the decompressed frame, so one record costs one ranged read and one frame.

Records with equal payloads are stored once: the one with the smallest id is the response, the others are
revisits that point to it. A task writes its bundles under names of its own attempt and reports them in the
index, which Spark commits; files of failed or repeated attempts are in no index and are never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, fresh

# Fixed values of the seekable format and of the WARC standard.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

INDEX_SCHEMA = "record_id string, bundle string, frame int, frame_start long, frame_bytes long, offset long, length long"
RECORD_SCHEMA = "record_id string, target_uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary, bundle string"
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 64 << 20
# Compressed bytes that a task reads back, more or less; tasks at most.
READ_BYTES, READ_TASKS = 16 << 20, 20_000


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value: str | None) -> str:
    """A header value on one line."""
    return " ".join((value or "").split())


def record(record_id: str, uri: str, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """One record; a revisit carries the HTTP header of its response and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:record:{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:record:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, start: int) -> tuple[dict, int]:
    """The record at an offset, and where the next one begins."""
    end = data.index(b"\r\n\r\n", start)
    lines = data[start:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at offset {start}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    body = end + 4
    stop = body + int(head["Content-Length"])
    http_end = data.index(b"\r\n\r\n", body) + 4
    http = dict(x.split(": ", 1) for x in data[body : http_end - 4].decode().split("\r\n")[1:])
    name = lambda v: None if v is None else v[len("<urn:record:") : -1]
    payload = None if head["WARC-Type"] == "revisit" else data[http_end:stop]
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and base32_sha1(payload) != digest:
        raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't match its digest")
    out = {"record_id": name(head["WARC-Record-ID"]), "target_uri": head["WARC-Target-URI"], "record_type": head["WARC-Type"]}
    out |= {"refers_to": name(head.get("WARC-Refers-To")), "payload_bytes": int(http["Content-Length"]), "payload_digest": digest, "payload": payload}
    return out, stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, decompressed) bytes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(start, compressed, decompressed) of each frame of an open bundle, from its last bytes."""
    size = f.seek(0, 2) or f.tell()
    f.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the file has no seek table")
    entry = 12 if flags & 0x80 else 8
    f.seek(size - 9 - count * entry)
    table, out, start = f.read(count * entry), [], 0
    for i in range(count):
        c, d = struct.unpack_from("<II", table, i * entry)
        out.append((start, c, d))
        start += c
    return out


def _store(uri: str):
    """Filesystem and path of a URI; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class BundleWriter:
    """Writes records to bundles under a folder and keeps the index rows; holds one frame in memory."""

    def __init__(self, folder: str, stem: str, frame_bytes: int, bundle_bytes: int, level: int):
        import zstandard

        self.store, self.path = _store(folder)
        self.folder, self.stem, self.frame_bytes, self.bundle_bytes = folder, stem, frame_bytes, bundle_bytes
        self.press = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.n, self.out, self.rows = 0, None, []

    def add(self, record_id: str, data: bytes) -> None:
        if self.out is None:
            name = f"{self.stem}-{self.n:04d}.warc.zst"
            self.name, self.n = f"{self.folder}/{name}", self.n + 1
            self.out = self.store.open_output_stream(f"{self.path}/{name}", compression=None)
            self.frames, self.at, self.buffer, self.pending = [], 0, bytearray(), []
        self.pending.append((record_id, len(self.buffer), len(data)))
        self.buffer += data
        if len(self.buffer) >= self.frame_bytes:
            self.flush()
            if self.at >= self.bundle_bytes:
                self.close()

    def flush(self) -> None:
        if self.pending:
            packed = self.press.compress(bytes(self.buffer))
            self.out.write(packed)
            self.rows += [(i, self.name, len(self.frames), self.at, len(packed), off, n) for i, off, n in self.pending]
            self.frames.append((len(packed), len(self.buffer)))
            self.at += len(packed)
            self.buffer, self.pending = bytearray(), []

    def close(self) -> None:
        if self.out is not None:
            self.flush()
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.out = None


def mark_revisits(df: DataFrame, record_id: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """df with _digest (hex), _size and _refers (id of the response, null for responses), with more underscores
    before a name that df has.

    Rows that share the smallest id of their group are each a response. A null id is the smallest only where
    a group has no other. Two thirds of the work is on narrow rows; the join on the digest is left to the
    adaptive planner, which splits a digest that many rows share.
    """
    digest, size, refers, first = fresh(df, "_digest", "_size", "_refers", "_first")
    marked = df.withColumns({digest: F.sha1(F.coalesce(F.col(payload), F.lit(b""))), size: F.coalesce(F.octet_length(payload), F.lit(0)).cast("long")})
    firsts = marked.where(F.col(size) >= least_bytes).groupBy(digest, size).agg(F.min(record_id).alias(first))
    joined = marked.join(firsts, [digest, size], "left")
    later = F.col(first).isNotNull() & ~F.col(record_id).eqNullSafe(F.col(first))
    return joined.withColumn(refers, F.when(later, F.col(first))).drop(first)


def write_bundles(df: DataFrame, folder: str, record_id: str, uri: str, payload: str, least_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 3) -> DataFrame:
    """Write one record per row below a folder that all executors share; returns the index as a lazy DataFrame.

    Write the index once (see archive) and use that copy: evaluating it writes the bundles. payload: string,
    taken as UTF-8, or binary; null counts as empty. Null ids are written as empty ids, null URIs as empty ones.
    A record longer than frame_bytes is a frame of its own. An empty table gives no bundles.
    """
    rows = df.select(F.col(record_id).alias("id"), F.col(uri).cast("string").alias("uri"), F.col(payload).cast("binary").alias("payload"))
    rows = mark_revisits(rows, "id", "payload", least_bytes)
    rows = rows.select(F.col("id").cast("string"), "uri", F.when(F.col("_refers").isNull(), F.col("payload")).alias("payload"), "_digest", "_size", F.col("_refers").cast("string").alias("refers"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = BundleWriter(folder, f"bundle-{uuid.uuid4().hex}", frame_bytes, bundle_bytes, level)
        names = [x.split()[0] for x in INDEX_SCHEMA.split(", ")]
        for b in batches:
            for i, u, p, digest, size, refers in b.itertuples(index=False):
                i = i or ""
                writer.add(i, record(i, clean(u), p or b"", base64.b32encode(bytes.fromhex(digest)).decode(), size, refers))
            if len(writer.rows) > 10_000:
                yield pd.DataFrame(writer.rows, columns=names)
                writer.rows = []
        writer.close()
        yield pd.DataFrame(writer.rows, columns=names)

    return rows.mapInPandas(write, INDEX_SCHEMA)


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the bundles in an index, read back frame by frame, with digests verified.

    A task takes a range of frames of one bundle: it reads the seek table and then only those frames.
    """
    sizes = index.groupBy("bundle").agg((F.max("frame") + 1).alias("n"), F.max(F.col("frame_start") + F.col("frame_bytes")).alias("bytes"))
    parts = F.least(F.col("n"), F.ceil(F.col("bytes") / READ_BYTES)).cast("int")
    pieces = sizes.select("bundle", parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    n_pieces = sizes.agg(F.coalesce(F.sum(parts), F.lit(0))).first()[0]
    # an explicit number of partitions, which the adaptive planner leaves alone
    pieces = pieces.repartition(max(1, min(READ_TASKS, n_pieces)), "bundle", "part")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        for b in batches:
            for bundle, parts, part in zip(b["bundle"], b["parts"], b["part"]):
                store, path = _store(bundle)
                with store.open_input_file(path) as f:
                    frames = read_seek_table(f)
                    for start, packed, size in frames[len(frames) * part // parts : len(frames) * (part + 1) // parts]:
                        f.seek(start)
                        data, at, found = press.decompress(f.read(packed), max_output_size=size), 0, []
                        while at < len(data):
                            one, at = parse_record(data, at)
                            found.append(one | {"bundle": bundle})
                        yield pd.DataFrame(found, columns=names)

    return pieces.mapInPandas(read, RECORD_SCHEMA)


def read_record(entry: dict) -> dict:
    """One record by its index row: seeks to its frame and decompresses only that."""
    import zstandard

    store, path = _store(entry["bundle"])
    with store.open_input_file(path) as f:
        f.seek(entry["frame_start"])
        data = zstandard.ZstdDecompressor().decompress(f.read(entry["frame_bytes"]))
    return parse_record(data, entry["offset"])[0]


def archive(spark: SparkSession, df: DataFrame, record_id: str, uri: str, payload: str, **options) -> tuple[DataFrame, str]:
    """Write df's bundles and their index in the shared folder; returns the committed index and the folder."""
    work = Workspace(spark, "warc")
    folder = work.path("bundles")
    if "://" not in folder and not folder.startswith("/"):
        folder = folder.removeprefix("file:")
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    return work.stash(write_bundles(df, folder, record_id, uri, payload, **options), "index"), folder
