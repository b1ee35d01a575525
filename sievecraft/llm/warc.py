"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page into shards by splitters that depend on the rows alone; each shard is one task's and is written as a series
of gzip-per-record files that roll at a compressed size. Files are written under temporary names and renamed when complete; a manifest in
parts, itself renamed into place, commits the whole. A repeated or lost task writes the same bytes again under the same final name.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import move_path, path_exists, remove_path, shuffle_partitions, written

MANIFEST = "file string, shard int, n_records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space of URLs


def _fs(uri: str):
    """The folder's file system and its path there; Hadoop's names of S3 are known."""
    from pyarrow import fs

    uri = re.sub(r"\As3[an]://", "s3://", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str | None, page_id: int | None) -> str:
    """Blanks and control characters, which would break the header, are percent-encoded."""
    if not url:
        return f"urn:page:{'' if page_id is None else page_id}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record(page_id, url, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One gzip member. A revisit has the headers but not the payload; both give the digest and length of the full payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    named = lambda i: f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{i}/{digest}')}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {named(page_id)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_uri(url, page_id)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"WARC-Block-Digest: sha1:{_digest(block)}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}", f"X-Has-URL: {int(bool(url))}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {named(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class _Roller:
    """Writes the files of the shards that one task holds, one after another."""

    def __init__(self, out: str, roll_bytes: int) -> None:
        self.fs, self.root = _fs(out)
        self.out, self.roll, self.shard, self.seq, self.file, self.done = out, roll_bytes, None, 0, None, []

    def add(self, shard: int, data: bytes) -> None:
        if self.file and (shard != self.shard or self.size + len(data) > self.roll and self.n):
            self.close()
        if shard != self.shard:
            self.shard, self.seq = shard, 0
        if not self.file:
            self.name, self.temp = f"part-{shard:06d}-{self.seq:05d}.warc.gz", f"{self.root}/_temporary/{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
            self.file, self.size, self.n, self.sha = self.fs.open_output_stream(self.temp), 0, 0, hashlib.sha256()
        self.file.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.n += 1

    def close(self) -> None:
        if self.file:
            self.file.close()
            self.fs.move(self.temp, f"{self.root}/{self.name}")
            self.done.append((self.name, self.shard, self.n, self.size, self.sha.hexdigest()))
            self.file, self.seq = None, self.seq + 1


def _splitters(meta: DataFrame, shards: int, oversample: int = 64) -> np.ndarray:
    """Quantiles by bytes of a sample of the different page_ids, chosen by their hash, so that the same rows give the same shards on any cluster.

    About oversample ids for each shard reach the driver.
    """
    if shards < 2:
        return np.zeros(0, np.int64)
    pages = meta.where("page_id is not null").groupBy("page_id").agg(F.sum(F.col("bytes").cast("long") + 512).alias("bytes"))
    pages = written(pages, "warc-pages")
    share = min(1.0, shards * oversample / max(1, pages.count()))
    picked = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 40)) < int(share * (1 << 40)) + 1).orderBy("page_id").toPandas()
    if not len(picked):
        return np.zeros(0, np.int64)
    upto = picked["bytes"].to_numpy(np.int64).cumsum()
    return np.unique(picked["page_id"].to_numpy(np.int64)[np.searchsorted(upto, upto[-1] * np.arange(1, shards) // shards)])


def _shard_of(spark: SparkSession, cuts: np.ndarray) -> Column:
    """The number of cuts not above page_id, by binary search; rows without page_id are dealt by their payload."""
    if not len(cuts):
        return F.lit(0)
    shared = spark.sparkContext.broadcast(cuts)  # at most most_shards numbers

    @F.arrow_udf("int")
    def place(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(shared.value, np.asarray(ids.to_numpy(zero_copy_only=False), np.int64), side="right").astype(np.int32))

    dealt = F.pmod(F.xxhash64("payload"), F.lit(len(cuts) + 1)).cast("int")
    return F.when(F.col("page_id").isNull(), dealt).otherwise(place(F.coalesce(F.col("page_id"), F.lit(0).cast("long"))))


def write_warc(
    pages: DataFrame, out: str, shard_bytes: int = 32 << 20, roll_bytes: int = 16 << 20, min_payload: int = 0, date: str = "2020-01-01T00:00:00Z", most_shards: int = 1 << 16
) -> DataFrame:
    """Writes a record per row of page_id, url, html under the folder `out`; returns the manifest (file, shard, n_records, bytes, sha256).

    shard_bytes: payload bytes of a shard, more if there would be more than most_shards of them; roll_bytes: compressed bytes at which a
    file is closed. Of records with equal payloads of at least min_payload bytes the smallest page_id is a response and the others are
    revisits of it; of repeated rows with that page_id the first by url is the response. Rows that share a page_id stay in one shard.
    Null html is an empty payload; a null url gives a urn; rows with null page_id are all responses, dealt over the shards, first in
    each. A payload of any length is one record, held in memory while it is written. An empty table gives an empty manifest. Other columns
    are ignored, whatever their names.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    meta = written(rows.select("page_id", F.sha2("payload", 256).alias("sha"), F.octet_length("payload").alias("bytes")), "warc-meta", compact=True)
    firsts = meta.where(F.col("bytes") >= min_payload).groupBy("sha", "bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", F.col("bytes").alias("b"), "first")
    total = meta.agg(F.sum(F.col("bytes").cast("long") + 512)).first()[0] or 0
    cuts = _splitters(meta, min(most_shards, max(1, -(-total // shard_bytes))))
    shard = _shard_of(spark, cuts)

    # which payload came first is found on digests alone; payloads are shuffled once, into their shard
    links = written(meta.where(F.col("page_id").isNotNull()).join(firsts, ["sha"], "inner").where("bytes = b and first is not null").select("page_id", "sha", "first").distinct(), "warc-links")
    keyed = rows.select("*", shard.alias("shard"))
    links = links.select(F.col("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), shard.alias("shard"), "sha", "first", F.lit(0).alias("kind"))
    both = keyed.select("*", F.lit(None).cast("string").alias("sha"), F.lit(None).cast("long").alias("first"), F.lit(1).alias("kind")).unionByName(links)
    both = both.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "kind", "url", "payload")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = _Roller(out, roll_bytes)
        now, first, served = object(), {}, set()
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "shard", "sha", "first", "kind")]
            for i in range(batch.num_rows):
                page_id, kind = cols[0][i].as_py(), cols[6][i].as_py()
                if page_id != now:
                    now, first, served = page_id, {}, set()
                if kind == 0:
                    first[cols[4][i].as_py()] = cols[5][i].as_py()
                    continue
                data = cols[2][i].as_py()
                sha = hashlib.sha256(data).hexdigest()
                refers = first.get(sha)
                if refers == page_id and page_id is not None and sha not in served:
                    served.add(sha)
                    refers = None
                roller.add(cols[3][i].as_py(), _record(page_id, cols[1][i].as_py(), data, _digest(data), refers, date))
        roller.close()
        names = ["file", "shard", "n_records", "bytes", "sha256"]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        yield pa.record_batch([pa.array([x[k] for x in roller.done], t) for k, t in enumerate(kinds)], names=names)

    files = written(both.mapInArrow(write, MANIFEST), "warc-files")
    _commit(files, out)
    return files


def _commit(files: DataFrame, out: str) -> None:
    """The manifest names every file, so a file that it does not name is no part of the archive."""
    spark, temp = files.sparkSession, f"{out}/_manifest-{uuid.uuid4().hex}"
    files.write.json(temp)
    move_path(spark, temp, f"{out}/manifest")
    if path_exists(spark, f"{out}/_temporary"):
        remove_path(spark, f"{out}/_temporary")  # what lost attempts left


def _members(fs, path: str, step: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, each decompressed; the file is streamed."""
    with fs.open_input_stream(path, compression=None) as f:
        rest, unpack, got = b"", None, []
        while True:
            if not rest:
                rest = f.read(step)
                if not rest:
                    if unpack:
                        raise ValueError(f"{path} ends within a record")
                    return
            unpack = unpack or zlib.decompressobj(31)
            got.append(unpack.decompress(rest))
            rest = unpack.unused_data
            if unpack.eof:
                yield b"".join(got)
                unpack, got = None, []


def parse_record(data: bytes, verify: bool = True) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if verify:
        if f"sha1:{_digest(block)}" != h["WARC-Block-Digest"]:
            raise ValueError(f"block digest of {h['WARC-Record-ID']}")
        if h["WARC-Type"] == "response" and (_digest(payload) != digest or len(payload) != int(h["X-Payload-Length"])):
            raise ValueError(f"payload digest of {h['WARC-Record-ID']}")
    number = lambda x: int(x) if x else None
    return {
        "page_id": number(h["X-Page-ID"]), "url": h["WARC-Target-URI"] if h["X-Has-URL"] == "1" else None, "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": digest,
        "record_type": h["WARC-Type"], "refers_to": number(h.get("X-Refers-To-Page-ID")), "payload": payload if h["WARC-Type"] == "response" else None,
    }


def read_warc(spark: SparkSession, out: str, with_payload: bool = True) -> DataFrame:
    """The records of the files that the manifest names, digests verified: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    Null page_ids, null urls, empty payloads and repeated rows come back as they were written; a null html comes back as an empty payload. Files
    are streamed record by record. A damaged record or a file that ends within one raises ValueError. An empty manifest gives no rows.
    """
    files = spark.read.schema(MANIFEST).json(f"{out}/manifest").select("file")
    schema = T.StructType.fromDDL(RECORD)
    if not with_payload:
        schema = T.StructType([f for f in schema if f.name != "payload"])
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names = [(f.name, kinds[f.dataType.simpleString().replace("bigint", "long")]) for f in schema]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(out)

        def batch(found: list[dict]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[n] for x in found], t) for n, t in names], names=[n for n, _ in names])

        for b in batches:
            for name in b.column(0).to_pylist():
                found, size = [], 0
                for data in _members(fs, f"{root}/{name}"):
                    found.append(parse_record(data))
                    size += len(data)
                    if size > 4 << 20:
                        yield batch(found)
                        found, size = [], 0
                if found:
                    yield batch(found)

    return files.repartition(max(shuffle_partitions(spark), 1), "file").mapInArrow(read, schema)
