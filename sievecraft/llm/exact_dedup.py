"""Exact dedup by content sort.

Splitters sampled from the normalised text's leading characters cut the key space into buckets; one shuffle brings each bucket
together, an external sort places equal texts side by side, and neighbouring rows are compared in full. The key ends in a hash of
the identifier and the row's place, so that splitters can fall inside a large group of copies, even of one identifier: such a group spreads
over several buckets, and the few groups that touch a splitter (at most one class per splitter) are added up again from one small row per
bucket.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_within, files_for, internal, let, shuffle_partitions, written

PREFIX = 24
#: Up to so many buckets there are several for each partition.
SPARE_BUCKETS = 1 << 16
_KEY = "struct<p:string,x:bigint,y:bigint>"


def _key(norm: Column, ident: Column, place: Column) -> Column:
    return F.struct(F.substring(norm, 1, PREFIX).alias("p"), F.xxhash64(norm).alias("x"), F.xxhash64(ident, place).alias("y"))


def sample_splitters(docs: DataFrame, norm: Column, ident: Column, buckets: int, n: int, oversample: int = 10, seed: int = 17) -> list[tuple]:
    """At most buckets-1 increasing keys of a table of n rows. The sample (about buckets * oversample keys of bounded length) affects balance alone."""
    if not n or buckets < 2:
        return []
    share = min(1.0, buckets * oversample / n)
    rows = (docs.sample(fraction=share, seed=seed) if share < 1 else docs).select(_key(norm, ident, F.monotonically_increasing_id()).alias("k")).limit(buckets * oversample * 2)
    keys = sorted((k.p.encode(), k.x, k.y) for (k,) in rows.collect())
    step = max(1.0, len(keys) / buckets)
    picked = sorted({keys[int(i * step)] for i in range(1, buckets) if int(i * step) < len(keys)})
    return [(p.decode(), x, y) for p, x, y in picked]


def _bucket(key: Column, splitters: list[tuple]) -> Column:
    """b: the number of splitters not above the key; edge: whether the key's text class is that of a neighbouring splitter."""
    if not splitters:
        return F.struct(F.lit(0).alias("b"), F.lit(False).alias("edge"))
    width = max(1, round(len(splitters) ** 0.5))
    rows = [[{"p": p, "x": x, "y": y} for p, x, y in splitters[i : i + width]] for i in range(0, len(splitters), width)]
    nested = F.from_json(F.lit(json.dumps(rows)), f"array<array<{_KEY}>>")
    flat = F.flatten(nested)
    heads = F.transform(nested, lambda r: F.get(r, F.lit(0)))

    def place(k: Column) -> Column:
        def fine(c: Column) -> Column:
            return F.when(c == 0, F.lit(0)).otherwise((c - 1) * width + F.size(F.filter(F.get(nested, c - 1), lambda s: s <= k)))

        return let(F.size(F.filter(heads, lambda s: s <= k)), fine)

    def placed(k: Column) -> Column:
        def out(b: Column) -> Column:
            same = lambda s: F.coalesce((s["p"] == k["p"]) & (s["x"] == k["x"]), F.lit(False))
            return F.struct(b.alias("b"), (same(F.get(flat, b - 1)) | same(F.get(flat, b))).alias("edge"))

        return let(place(k), out)

    return let(key, placed)


def exact_dedup(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    keep: str = "smallest",
    carry: bool = False,
    buckets_per_partition: int = 8,
) -> DataFrame:
    """One row per input row: <id_col>, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. keep: which identifier of a group stays, 'smallest' or 'largest'.
    carry=True returns the whole input row instead, as struct column `row`, with `kept`.

    Null texts count as empty and empty texts equal each other. Null identifiers lose to any other; a group of null identifiers alone
    keeps one row, with keep_id null. Of repeated rows with the identifier that stays exactly one has kept = true. Very long texts are
    compared whole. An empty table gives an empty result. Other columns are ignored (carry: returned untouched), whatever their names.

    There are buckets_per_partition buckets for each shuffle partition, fewer above SPARE_BUCKETS in all but never less than one, so that
    buckets follow the partitions, which follow the data; the driver holds ten sampled keys for each.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    spark = docs.sparkSession
    ident, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    parts = shuffle_partitions(spark)
    n = docs.count()
    splitters = sample_splitters(docs, ascii_lower(text), ident, parts * max(1, min(buckets_per_partition, SPARE_BUCKETS // parts)), n)
    place = F.monotonically_increasing_id().alias("place")

    if carry:
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), ident.alias("id"), ascii_lower(text).alias("norm"), place)
    else:
        rows = docs.select(ident.alias("id"), ascii_lower(text).alias("norm"), place)
    rows = rows.select("*", _bucket(_key(F.col("norm"), F.col("id"), F.col("place")), splitters).alias("at"))
    if carry:  # the row holds the text already; it is normalised again on the other side
        rows = rows.select("row", "id", F.col("at.b").alias("b"), F.col("at.edge").alias("edge")).repartition(parts, "b")
        rows = rows.withColumn("norm", ascii_lower(F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))))
    else:
        rows = rows.select("norm", "id", F.col("at.b").alias("b"), F.col("at.edge").alias("edge")).repartition(parts, "b")

    best, order = (F.min, F.asc_nulls_last) if keep == "smallest" else (F.max, F.desc_nulls_last)
    ordered = Window.partitionBy("norm", "b").orderBy(order("id"))
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = rows.select(
        *(["row"] if carry else []),
        "id",
        "edge",
        "b",
        F.row_number().over(ordered).alias("rn"),
        F.count(F.lit(1)).over(whole).alias("n"),
        best("id").over(whole).alias("best"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("sha"),
        F.octet_length("norm").alias("bytes"),
    )
    runs = written(runs, "exact-runs", files=files_for(docs))

    # one row for each bucket and text class at a splitter: no more than two per bucket but for hash collisions
    if keep == "smallest":
        first = F.min(F.struct(F.col("best").isNull().alias("none"), "best", F.col("b").alias("at")))
    else:
        first = F.max(F.struct(F.col("best").isNotNull().alias("some"), "best", (-F.col("b")).alias("at")))
    sums = runs.where(F.col("edge") & (F.col("rn") == 1)).groupBy("sha", "bytes").agg(F.sum("n").alias("all_n"), first.alias("f"))
    sums = sums.select(F.col("sha").alias(internal("sha")), F.col("bytes").alias(internal("bytes")), "all_n", F.col("f.best").alias("all_best"), F.abs("f.at").alias("all_at"))
    sums = broadcast_within(written(sums, "exact-sums", compact=True), 4 * SPARE_BUCKETS)
    joined = runs.join(sums, F.col("edge") & (F.col("sha") == F.col(internal("sha"))) & (F.col("bytes") == F.col(internal("bytes"))), "left")
    split = F.col("all_n").isNotNull()
    size, best_id = F.coalesce("all_n", "n"), F.when(split, F.col("all_best")).otherwise(F.col("best"))
    # of the best identifier's rows the first in the first of their buckets stays
    kept = (F.col("rn") == 1) & F.col("id").eqNullSafe(best_id) & F.coalesce(F.col("b") == F.col("all_at"), F.lit(True))
    if carry:
        return joined.select("row", kept.alias("kept"))
    return joined.select(F.col("id").alias(id_col), best_id.alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))
