"""Sinks: sidecar files, snapshots of the item table, reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.plans.storage import path_exists

from . import stores

__all__ = ["put_files", "write_sidecars", "move_files", "Snapshots", "write_report", "write_json", "cached", "append_cache", "harvest_source", "original_video", "path_exists"]


def put_files(rows: DataFrame, existing: str = "overwrite") -> DataFrame:
    """Writes text (null: empty) of rows (path, text) to their paths, each under a temporary name that is then renamed; returns path and written.

    Paths lie on a file system that all executors share. existing: overwrite or skip.
    """
    if existing not in ("overwrite", "skip"):
        raise ValueError("existing must be 'overwrite' or 'skip'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                wanted = existing == "overwrite" or not stores.is_file(path)
                if wanted:
                    stores.put_bytes(path, (text or "").encode())
                done.append(wanted)
            yield pa.record_batch([b.column(0), pa.array(done, pa.bool_())], names=["path", "written"])

    return rows.select("path", "text").mapInArrow(run, "path string, written boolean")


def write_sidecars(rows: DataFrame, folder: str, existing: str = "overwrite") -> DataFrame:
    """put_files of rows (stem, text) as folder/stem.txt; returns stem and written."""
    at = F.concat(F.lit(f"{folder.rstrip('/')}/"), "stem", F.lit(".txt"))
    out = put_files(rows.select(at.alias("path"), "text"), existing)
    return out.select(F.regexp_extract("path", r"([^/]*)\.txt\z", 1).alias("stem"), "written")


def move_files(moves: DataFrame, together: bool = False) -> DataFrame:
    """item_id, moved, ok after moving src to dst of rows (item_id, src, dst). An absent src is nothing to do, so a repeated task does no harm.

    together: if one of an item's files cannot be moved, those moved before it go back. An item has a few files, so its list is short.
    """
    lists = moves.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            moved, ok = [], []
            for pairs in b.column(1).to_pylist():
                done: list[tuple[str, str]] = []
                good = True
                for p in pairs:
                    try:
                        if stores.is_file(p["src"]):
                            stores.move(p["src"], p["dst"])
                            done.append((p["src"], p["dst"]))
                    except OSError:
                        good = False
                        if together:
                            for src, dst in reversed(done):
                                stores.move(dst, src)
                            done = []
                            break
                moved.append(len(done))
                ok.append(good)
            yield pa.record_batch([b.column(0), pa.array(moved, pa.int64()), pa.array(ok, pa.bool_())], names=["item_id", "moved", "ok"])

    return lists.mapInArrow(run, "item_id string, moved long, ok boolean")


class Snapshots:
    """Versions of a table as folders version=N; a pointer file, renamed into place, names the current one."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> int:
        return json.loads(stores.read_bytes(f"{self.root}/current"))["version"] if stores.is_file(f"{self.root}/current") else 0

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/version={self.current()}").drop("version")

    def commit(self, df: DataFrame) -> int:
        """Writes df as the next version and points at it. A crash before the last step leaves the old version in place."""
        version = self.current() + 1
        df.write.mode("overwrite").parquet(f"{self.root}/version={version}")
        stores.put_bytes(f"{self.root}/current", json.dumps({"version": version}).encode())
        return version


def write_report(report: DataFrame, path: str) -> None:
    """One JSON object; the report is a single row."""
    stores.put_bytes(path, report.select(F.to_json(F.struct("*"))).first()[0].encode())


def write_json(payload: dict, path: str) -> None:
    stores.put_bytes(path, json.dumps(payload, ensure_ascii=False, indent=2).encode())


def cached(requests: DataFrame, cache: DataFrame, schema_version: int = 2) -> tuple[DataFrame, DataFrame]:
    """Requests (signature and more) that the cache answers, and those it does not; entries of another schema version do not count."""
    current = cache.where(F.col("schema_version") == schema_version).drop("schema_version")
    return requests.join(current, "signature"), requests.join(current, "signature", "left_anti")


def append_cache(results: DataFrame, path: str, schema_version: int = 2) -> None:
    results.withColumn("schema_version", F.lit(schema_version)).write.mode("append").parquet(path)


# Where a clip folder names the film its clips were cut from.
CLIP_MANIFEST = "clip_harvester_source.json"


def harvest_source(manifest_text: str | None) -> str | None:
    """The original video that a clip manifest names; a manifest that cannot be read raises ValueError."""
    if manifest_text is None:
        return None
    try:
        return str(json.loads(manifest_text).get("source_video") or "") or None
    except (ValueError, AttributeError) as e:
        raise ValueError("The clip manifest cannot be read") from e


def original_video(folder: str, explicit: str = "") -> str | None:
    """The original of a folder of clips: the path given, which must exist, else the one its clip manifest names, if that exists."""
    if explicit:
        path = stores.normalized_path(explicit)
        if not stores.is_file(path):
            raise FileNotFoundError(f"The original video does not exist: {path}")
        return path
    manifest = f"{folder.rstrip('/')}/{CLIP_MANIFEST}"
    named = harvest_source(stores.read_bytes(manifest).decode()) if stores.is_file(manifest) else None
    return named if named and stores.is_file(named) else None
