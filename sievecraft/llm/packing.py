"""Packing into length buckets of least padding.

Lengths are counted in one distributed aggregation. A dynamic programme over that global histogram places the bucket boundaries so
that padding every document to its bucket's boundary wastes the fewest tokens; documents of a bucket then form batches under a budget of
padded tokens.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count

def optimal_boundaries(tops: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most `buckets` boundaries out of the increasing lengths `tops` minimising sum(counts * boundary).

    cost[j] with one bucket more = min over i < j of cost[i] + tops[j] * (documents in (i, j]). For a fixed i that is a line in tops[j], and
    later lines are flatter, so a layer is a lower hull that is queried from left to right: time in proportion to the lengths. Whole
    numbers throughout, so the optimum is exact at any size.
    """
    m = len(tops)
    if not m:
        return []
    height, before = [int(t) for t in tops], [0, *np.cumsum(counts.astype(np.int64)).tolist()]
    cost = [h * c for h, c in zip(height, before[1:])]  # one bucket
    choice = []
    for _ in range(1, min(buckets, m)):
        new, arg = cost[:], np.full(m, -1, np.int32)
        hull: list[int] = []  # lines cost[i] - x * before[i + 1], of falling slope
        head = 0
        for j in range(1, m):
            i, offset, slope = j - 1, cost[j - 1], before[j]
            while len(hull) - head >= 2:
                a, b = hull[-2], hull[-1]  # b is not needed if the new line passes a no later than b does
                if (offset - cost[a]) * (before[b + 1] - before[a + 1]) <= (cost[b] - cost[a]) * (slope - before[a + 1]):
                    hull.pop()
                else:
                    break
            hull.append(i)
            x = height[j]
            while len(hull) - head >= 2 and cost[hull[head + 1]] - x * before[hull[head + 1] + 1] <= cost[hull[head]] - x * before[hull[head] + 1]:
                head += 1
            best = hull[head]
            value = cost[best] - x * before[best + 1] + x * before[j + 1]
            if value < new[j]:
                new[j], arg[j] = value, best
        choice.append(arg)
        cost = new
    ends, j = [m - 1], m - 1
    for arg in reversed(choice):
        if arg[j] >= 0:
            j = int(arg[j])
            ends.append(j)
    return sorted(int(tops[e]) for e in ends)


def pack(lengths: DataFrame, buckets: int = 16, batch_tokens: int = 65_536, shard_rows: int = 2_048) -> DataFrame:
    """From doc_id, n_tokens: doc_id, n_tokens, bucket, bucket_tokens, shard, batch, slot, padding; every row appears once.

    bucket_tokens: the bucket's boundary; a batch holds at most max(1, batch_tokens // bucket_tokens) documents, so its padded size
    exceeds the budget only for a document that does so alone. A large bucket is split into shards by a hash of doc_id and length, so that no task
    holds a whole bucket; each shard ends in at most one unfilled batch. batch numbers the batches of a shard from 0.

    The boundaries are the optimum over all lengths that occur. The driver holds the histogram of different lengths: d of them add up to
    d^2 / 2 tokens at least, so 100 TB of text has at most some six million.

    Null lengths count as 0. Null doc_ids, ties and repeated rows get slots of their own. An empty table gives an empty result.
    """
    lengths = lengths.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    hist = lengths.groupBy(F.col("n_tokens").alias("top")).agg(F.count(F.lit(1)).alias("n")).orderBy("top").toPandas()
    tops, counts = hist["top"].to_numpy(np.int64), hist["n"].to_numpy(np.int64)
    ends = optimal_boundaries(tops, counts, buckets)
    if not ends:
        ends = [0]
    caps = [max(1, batch_tokens // max(1, e)) for e in ends]
    inside = [int(counts[(tops <= e) & (tops > (ends[k - 1] if k else -1))].sum()) for k, e in enumerate(ends)]
    shards = [max(1, -(-n // max(shard_rows, 8 * c))) for n, c in zip(inside, caps)]

    at = lambda values, i: F.get(F.array(*(F.lit(v).cast("long") for v in values)), i)
    bucket = F.size(F.filter(F.array(*(F.lit(e).cast("long") for e in ends)), lambda e: e < F.col("n_tokens")))
    rows = lengths.select("doc_id", "n_tokens", bucket.alias("bucket"))
    rows = rows.select("*", at(ends, F.col("bucket")).alias("bucket_tokens"), F.pmod(F.xxhash64("doc_id", "n_tokens"), at(shards, F.col("bucket"))).alias("shard"))
    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "n_tokens")) - 1
    rows = rows.select("*", rank.alias("rank"), at(caps, F.col("bucket")).alias("cap"))
    return rows.select(
        "doc_id", "n_tokens", "bucket", "bucket_tokens", "shard",
        F.floor(F.col("rank") / F.col("cap")).cast("long").alias("batch"),
        (F.col("rank") % F.col("cap")).cast("long").alias("slot"),
        (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
    )


def pack_documents(docs: DataFrame, **kwargs) -> DataFrame:
    """pack over documents; the length is the number of words of the whole text, 0 for a null text."""
    return pack(docs.select("doc_id", word_count(F.col("text")).alias("n_tokens")), **kwargs)
