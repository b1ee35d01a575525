"""Exact and near duplicates of items, and duplicate captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.functions.hashing import covering_masks, hamming
from sievecraft.functions.text import casefold
from sievecraft.plans.storage import shuffle_partitions, written

from .components import connected_components


def exact_duplicate_groups(items: DataFrame) -> DataFrame:
    """source_hash, n and first path of every content found twice or more. Counts and minima, so a large group is no large row."""
    return items.groupBy("source_hash").agg(F.count(F.lit(1)).alias("n"), F.min("source_relative_path").alias("first_path")).where("n > 1")


def exact_duplicate_decisions(items: DataFrame) -> DataFrame:
    """item_id, source_hash, keeper_id, keeper_path, group_size, action (keep, exclude, reinstate, none) of the active items.

    The keeper is the first by (complete first, path, item_id) of those not excluded; without any, of those not excluded as duplicates; else of all. The keeper of a
    group comes from a partial aggregate, and the join back is an equi-join that AQE can split.
    """
    active = items.where("active").select("item_id", "source_hash", "source_relative_path", "status", "review_status")
    copy = F.col("review_status") == "exact_duplicate_excluded"
    tier = F.when(F.col("status") != "excluded", 0).when(~copy, 1).otherwise(2)
    order = F.struct(tier.alias("tier"), F.when(F.col("status") == "complete", 0).otherwise(1).alias("rank"), casefold(F.col("source_relative_path")).alias("cf"), F.col("item_id"), F.col("source_relative_path").alias("path"))
    keepers = active.groupBy(F.col("source_hash").alias("k_hash")).agg(F.min(order).alias("k"), F.count(F.lit(1)).alias("group_size"))
    rows = active.join(keepers, F.col("source_hash").eqNullSafe(F.col("k_hash")))
    excluded, single, mine = F.col("status") == "excluded", F.col("group_size") == 1, F.col("item_id") == F.col("k.item_id")
    action = (
        F.when(single, F.when(excluded & copy, "reinstate").otherwise("none"))
        .when(mine, F.when(excluded & copy, "reinstate").otherwise("keep"))
        .when(excluded, "none").otherwise("exclude")
    )
    return rows.select("item_id", "source_hash", F.col("k.item_id").alias("keeper_id"), F.col("k.path").alias("keeper_path"), "group_size", action.alias("action"))


def caption_key(caption: Column) -> Column:
    """Captions equal but for blanks and case have one key."""
    return casefold(F.trim(F.regexp_replace(caption, r"(?U)\s+", " ")))


def caption_groups(captions: DataFrame) -> DataFrame:
    """caption_key, n, first_image of captions equal but for blanks and case; empty captions are left out."""
    return captions.select(caption_key(F.col("caption")).alias("caption_key"), "image").where("caption_key <> ''").groupBy("caption_key").agg(F.count(F.lit(1)).alias("n"), F.min(casefold(F.col("image"))).alias("first_image")).where("n > 1")


def caption_group_members(captions: DataFrame) -> DataFrame:
    """caption_key, n, image of every member of the groups; groups are counted first and joined back, so none is gathered in a row."""
    keyed = captions.select(caption_key(F.col("caption")).alias("caption_key"), "image")
    groups = caption_groups(captions).select(F.col("caption_key").alias("g_key"), "n")
    return keyed.join(groups, F.col("caption_key") == F.col("g_key")).select("caption_key", "n", "image")


def near_duplicate_pairs(hashes: DataFrame, distance: int = 6) -> DataFrame:
    """a, b, distance of distinct hash values within the distance, a < b; hashes has hash. Copies of a hash are one value here.

    Candidates share their bits under one of the covering masks, about 32 of 64, so chance meetings stay rare as the table grows. A hash has 127 keys
    at a distance of 6: hashes are spread over all partitions before their keys are made, and the join is never broadcast, as its size is estimated from the few
    bytes of the hashes.
    """
    tables = F.array(*(F.lit(m).cast("long") for m in covering_masks(distance)))
    keys = F.transform(tables, lambda m, i: F.xxhash64(F.col("hash").bitwiseAND(m), i))
    spread = hashes.select("hash").where("hash is not null").repartition(shuffle_partitions(hashes.sparkSession), "hash")
    rows = spread.distinct().select("hash", F.explode(keys).alias("k"))
    left, right = rows.withColumnRenamed("hash", "a"), rows.withColumnRenamed("hash", "b")
    d = hamming(F.col("a"), F.col("b"))
    return left.join(right.hint("merge"), "k").where((F.col("a") < F.col("b")) & (d <= distance)).select("a", "b", d.alias("distance")).distinct()


def near_duplicate_groups(hashes: DataFrame, distance: int = 6) -> DataFrame:
    """id, hash, group_id, group_size, minimum_distance for members of groups of two or more items.

    hashes has id, hash and content; items of equal content are no pair of their own, but each is linked to the items near its hash. A group's
    minimum distance is 0 if two contents share a hash.
    """
    pairs = written(near_duplicate_pairs(hashes, distance), "near-pairs", compact=True)
    nodes = connected_components(pairs.select("a", "b"))
    per_hash = hashes.where("hash is not null").groupBy("hash").agg(F.min("id").alias("first"), F.min("content").alias("c0"), F.max("content").alias("c1"))
    labelled = per_hash.join(nodes.withColumnRenamed("node", "hash"), "hash", "left").select("hash", "first", (F.col("c0") != F.col("c1")).alias("mixed"), F.coalesce("component", "hash").alias("root"), F.col("component").isNotNull().alias("linked"))
    nearest = pairs.join(labelled.select(F.col("hash").alias("a"), "root"), "a").groupBy("root").agg(F.min("distance").alias("d"))
    groups = labelled.groupBy("root").agg(F.min("first").alias("group_id"), F.max("mixed").alias("mixed"), F.max("linked").alias("linked")).where("mixed or linked")
    groups = groups.join(nearest, "root", "left").select("root", "group_id", F.when(F.col("mixed"), F.lit(0)).otherwise(F.col("d")).cast("long").alias("minimum_distance"))
    member = labelled.select(F.col("hash").alias("l_hash"), "root").join(groups, "root")
    rows = hashes.join(member, F.col("hash") == F.col("l_hash")).select("id", "hash", "group_id", "minimum_distance", "root")
    sizes = rows.groupBy(F.col("root").alias("s_root")).agg(F.count(F.lit(1)).alias("group_size"))
    return rows.join(sizes, F.col("root") == F.col("s_root")).select("id", "hash", "group_id", "group_size", "minimum_distance")
