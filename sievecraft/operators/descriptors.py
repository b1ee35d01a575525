"""Phrases that recur across captions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.functions.captions import DESCRIPTOR_STOPWORDS, descriptor_tokens
from sievecraft.plans.storage import broadcast_within, written

#: Bits of the filter that stands for a set of hashes inside an expression; what passes it by chance is counted and dropped later.
_FILTER_BITS = 1 << 20


def _filter_of(hashes: DataFrame, column: str) -> Column:
    """hash -> whether it may be in the column. The set's bits are gathered by words of 64, so the driver holds at most _FILTER_BITS of them."""
    at = F.pmod(F.col(column), F.lit(_FILTER_BITS))
    words = hashes.groupBy((at / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("bits")).collect()
    table = [0] * (_FILTER_BITS // 64)
    for r in words:
        table[r.w] = r.bits
    literal = F.from_json(F.lit(str(table)), "array<bigint>")

    def may(h: Column) -> Column:
        here = F.pmod(h, F.lit(_FILTER_BITS))
        return F.call_function("shiftrightunsigned", F.get(literal, (here / 64).cast("int")), (here % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

    return may


def _grams(tokens: Column, fits: Column, size: int) -> Column:
    """Positions at which `size` tokens in a row fit; fits: 0 unfit, 1 fit, 2 fit and all digits."""
    at = F.when(F.size(tokens) >= size, F.sequence(F.lit(0), F.size(tokens) - size)).otherwise(F.array().cast("array<int>"))

    def good(i: Column) -> Column:
        kinds = [F.get(fits, i + k) for k in range(size)]
        whole, digits = kinds[0] > 0, kinds[0] == 2
        for k in kinds[1:]:
            whole, digits = whole & (k > 0), digits & (k == 2)
        return whole & ~digits

    return F.filter(at, good)


def phrase_counts(captions: DataFrame, trigger: str, minimum_fraction: float) -> tuple[DataFrame, int, int]:
    """phrase and n of the phrases of two or three words without stop words that stand in at least `least` captions; the captions with words; least.

    Captions are read once and their tokens written. A phrase is no more frequent than its words, so only runs of frequent words are counted, by
    their hashes; the texts of the phrases that pass are looked up at the end. A phrase counts once a caption.
    """
    stop = F.array(*(F.lit(w) for w in DESCRIPTOR_STOPWORDS))
    rows = captions.select(descriptor_tokens(F.col("caption"), trigger).alias("tokens")).where(F.size("tokens") > 0)
    rows = written(rows, "descriptor-tokens")
    total = rows.count()
    least = max(3, math.ceil(total * minimum_fraction))
    words = rows.select(F.explode(F.transform(F.array_except(F.array_distinct("tokens"), stop), lambda t: F.xxhash64(t))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    frequent = _filter_of(words, "w")
    # a stop word may pass the filter by chance, so it is looked for too, but only among what passed
    fit = lambda t: F.when(~frequent(F.xxhash64(t)), 0).when(F.array_contains(stop, t), 0).when(t.rlike(r"(?U)\A\d+\z"), 2).otherwise(1)
    rows = written(rows.select("tokens", F.transform("tokens", fit).alias("fits")), "descriptor-fits")
    spell = lambda i, n: [F.get("tokens", i + k) for k in range(n)]
    hashes = lambda n: F.transform(_grams(F.col("tokens"), F.col("fits"), n), lambda i: F.xxhash64(*spell(i, n)))
    keys = F.concat(hashes(3), hashes(2))
    counted = written(rows.select(F.explode(F.array_distinct(keys)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "descriptor-counts")
    passed = _filter_of(counted, "key")

    def texts(n: int) -> Column:
        return F.transform(_grams(F.col("tokens"), F.col("fits"), n), lambda i: F.when(passed(F.xxhash64(*spell(i, n))), F.struct(F.xxhash64(*spell(i, n)).alias("key"), F.concat_ws(" ", *spell(i, n)).alias("phrase"))))

    found = rows.select(F.explode(F.array_distinct(F.array_compact(F.concat(texts(3), texts(2))))).alias("p")).select("p.key", "p.phrase").distinct()
    return found.join(broadcast_within(counted, 200_000), "key").select("phrase", "n"), total, least


def frequent_phrases(captions: DataFrame, trigger: str = "", minimum_fraction: float = 0.6) -> DataFrame:
    """phrase, n, fraction of the phrases in at least max(3, minimum_fraction of the captions)."""
    counts, total, _ = phrase_counts(captions, trigger, minimum_fraction)
    return counts.select("phrase", "n", F.round(F.col("n") / F.lit(max(total, 1)), 4).alias("fraction"))


def _ranked(counts: DataFrame, total: int, limit: int) -> DataFrame:
    ranked = counts.select("phrase", "n", F.round(F.col("n") / F.lit(max(total, 1)), 4).alias("fraction"))
    words = F.size(F.split("phrase", " "))
    one = ranked.agg(F.array_sort(F.collect_list(F.struct((-F.col("fraction")).alias("f"), (-words).alias("w"), F.col("phrase"), F.col("n"), F.col("fraction")))).alias("all"))
    kind = "array<struct<phrase:string,n:bigint,fraction:double>>"

    def step(acc, x):
        full = (F.size(acc) >= limit) | F.exists(acc, lambda s: F.contains(s["phrase"], x["phrase"]))
        return F.when(full, acc).otherwise(F.array_append(acc, F.struct(x["phrase"].alias("phrase"), x["n"].alias("n"), x["fraction"].alias("fraction"))))

    picked = F.aggregate("all", F.array().cast(kind), step)
    return one.select(F.posexplode(picked).alias("rank", "p")).select((F.col("rank") + 1).alias("rank"), "p.phrase", "p.n", "p.fraction")


def recurring_descriptors(captions: DataFrame, trigger: str = "", minimum_fraction: float = 0.6, limit: int = 10) -> DataFrame:
    """The first `limit` frequent phrases by share, length and text that are no part of one before them.

    At a share of half the captions or more the candidates are few: a caption of w words has at most 2w phrases, so no more than
    2 * mean(w) / minimum_fraction phrases can pass. They are gathered in one array for the greedy pass.
    """
    counts, total, _ = phrase_counts(captions, trigger, minimum_fraction)
    return _ranked(counts, total, limit)


def caption_recurrence(captions: DataFrame, trigger: str = "", minimum_fraction: float = 0.6, limit: int = 10) -> dict:
    """caption_count, minimum_count and the recurring descriptors (at most `limit`) as plain values, for a report."""
    counts, total, least = phrase_counts(captions, trigger, minimum_fraction)
    found = [{"text": r.phrase, "count": r.n, "fraction": r.fraction} for r in _ranked(counts, total, limit).orderBy("rank").collect()]
    return {"caption_count": total, "minimum_fraction": float(minimum_fraction), "minimum_count": least if total else 0, "recurring_descriptors": found, "trigger_bleed_review_recommended": bool(found)}
