"""Append accelerator: new files enter as a stream; the full listing stays the authority on changes and removals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievecraft.sources.files import IMAGE_SUFFIXES, item_id, suffix

_FILES = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, per_trigger: int = 10_000) -> DataFrame:
    rows = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)
    bare = root.removeprefix("file://").removeprefix("file:").rstrip("/")
    rel = F.substring(F.regexp_replace("path", r"\Afile:/*(?=/)", ""), F.lit(len(bare) + 2), F.length("path"))
    return rows.where(suffix(F.col("path")).isin(*suffixes)).select(item_id(rel).alias("item_id"), "path", rel.alias("relative_path"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size"))


def ingest_available(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there now, batch by batch, to out/batch=N and ends. A replayed batch overwrites its own folder, so it counts once."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates(["item_id"]).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
