"""Media files as rows: discovery, identity, sidecars and listings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.functions.text import casefold, stem

from .stores import chunks

# The media suffixes.
AVIF_SUFFIX = ".avif"
IMAGE_SUFFIXES = (".bmp", ".gif", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp")
VIDEO_SUFFIXES = (".avi", ".flv", ".m4v", ".mkv", ".mov", ".mp4", ".mpeg", ".mpg", ".webm")


#: Files up to this size are hashed as a cell; larger ones are streamed.
CELL_BYTES = 1 << 30


def image_suffixes(avif: bool = False) -> tuple[str, ...]:
    """The image suffixes; AVIF among them where something can decode it."""
    return tuple(sorted((*IMAGE_SUFFIXES, AVIF_SUFFIX))) if avif else IMAGE_SUFFIXES


def item_id(relative_path: Column) -> Column:
    """A rename makes a new item; new content does not."""
    return F.substring(F.sha2(casefold(relative_path).cast("binary"), 256), 1, 24)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def media_type(path: Column) -> Column:
    return F.when(suffix(path).isin(*VIDEO_SUFFIXES), "video").otherwise("image")


def _relative(path: Column, root: str) -> Column:
    bare = root.removeprefix("file://").removeprefix("file:").rstrip("/")
    plain = F.regexp_replace(path, r"\Afile:/*(?=/)", "")
    return F.substring(plain, F.lit(len(bare) + 2), F.length(plain))


def discover(spark: SparkSession, root: str, recursive: bool = True, excluded: tuple[str, ...] = (), suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """item_id, path, relative_path, content_hash, size, mtime of the media files under root; nothing under an excluded folder (relative to root).

    Files are hashed by the executors, whole cells up to CELL_BYTES and in a stream above. Rows have no order; sort by casefold(relative_path).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    rel = _relative(F.col("path"), root)
    rows = files.where(suffix(F.col("path")).isin(*suffixes)).withColumn("relative_path", rel)
    if not recursive:
        rows = rows.where(~F.contains("relative_path", F.lit("/")))
    for folder in excluded:
        rows = rows.where(~F.col("relative_path").startswith(folder.rstrip("/") + "/"))
    named = [item_id(F.col("relative_path")).alias("item_id"), "path", "relative_path"]
    facts = [F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    small = rows.where(F.col("length") <= CELL_BYTES).select(*named, F.sha2("content", 256).alias("content_hash"), *facts)
    large = rows.where(F.col("length") > CELL_BYTES).select(*named, *facts)
    hashed = large.mapInArrow(_stream_hashes, "item_id string, path string, relative_path string, content_hash string, size long, mtime timestamp")
    return small.unionByName(hashed)


def _stream_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = []
        for path in b.column(1).to_pylist():
            digest = hashlib.sha256()
            for part in chunks(path):
                digest.update(part)
            done.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(done, pa.string()), *b.columns[3:]], names=["item_id", "path", "relative_path", "content_hash", "size", "mtime"])


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path and size of every file under root; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """relative_stem and caption of the .txt files; a byte-order mark and outer blanks are dropped."""
    texts = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root)
    rows = texts.select(_relative(F.col("_metadata.file_path"), root).alias("rel"), F.col("value"))
    return rows.select(stem(F.col("rel")).alias("relative_stem"), F.trim(F.regexp_replace("value", r"\A\x{FEFF}|\s+\z|\A\s+", "")).alias("caption"))


def with_source_captions(items: DataFrame, captions: DataFrame) -> DataFrame:
    """items with source_caption of the sidecar that shares their path but for the suffix."""
    keyed = captions.select(F.col("relative_stem").alias("c_stem"), F.col("caption").alias("source_caption"))
    return items.join(keyed, stem(F.col("relative_path")) == F.col("c_stem"), "left").drop("c_stem")
