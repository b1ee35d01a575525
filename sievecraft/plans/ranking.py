"""Global ranks without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import shuffle_partitions, written


def global_rank(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """df with its rank from 1 on in the order given, which should be total.

    Rows are range-partitioned; counts of the ranges, one number each, give each range its offset.
    """
    spark = df.sparkSession
    ranged = written(df.repartitionByRange(shuffle_partitions(spark), *order).withColumn("__range", F.spark_partition_id()), "ranked")
    counts = {r[0]: r[1] for r in ranged.groupBy("__range").count().collect()}
    offsets, total = [], 0
    for k in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(k, 0)
    offset = F.get(F.array(*(F.lit(x).cast("long") for x in offsets or [0])), F.col("__range"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.select("*", (offset + inside).alias(name)).drop("__range")
