"""Mixing sources to target weights by entropy balancing.

Each source has a token target. Document rates r minimise the relative entropy to one copy each, subject to r <= cap and to the
source's token constraint, so r = min(cap, exp(lambda * size / scale)) with one multiplier per source. The multipliers solve the convex
dual by safeguarded Newton steps; a step is one distributed aggregation over the (source, size) histogram. Rates become whole copies by
systematic rounding along cumulative fractions, and one document per source takes up the rest of the rounding error in words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_within, files_for, internal, word_count, written

WEIGHTS = (3.0, 1.0, 2.0)
#: Above this many sources, tables of one row per source are joined by sort-merge instead of a broadcast.
MAX_BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target: share of all tokens dealt by weight, none above cap times its source, the excess reshared by weight.

    sizes has source and source_size. Sources come in order of code points, null last, and weights repeat along that order. Resharing
    until nothing is above its cap ends at the level where the capped sources are those with the smallest cap by weight, so sorting by
    that ratio finds it in one pass. The windows here run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*(F.lit(float(x)) for x in weights)), (F.row_number().over(by_name) - 1) % len(weights))
    t = sizes.withColumn("w", w).withColumn("top", F.col("source_size") * F.lit(float(cap)))
    ratio = F.col("top") / F.col("w")
    order = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    t = t.select(
        "*",
        ratio.alias("ratio"),
        F.coalesce(F.sum("top").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("top_before"),
        F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("w_from"),
        (F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(float(share))).alias("total"),
    )
    t = t.withColumn("capped", F.col("ratio") * F.col("w_from") <= F.col("total") - F.col("top_before"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("capped"), F.col("top"))).over(whole), F.lit(0.0)).alias("fixed"),
        F.sum(F.when(~F.col("capped"), F.col("w"))).over(whole).alias("w_free"),
    )
    target = F.when(F.col("capped"), F.col("top")).otherwise(F.least("top", (F.col("total") - F.col("fixed")) * F.col("w") / F.col("w_free")))
    return t.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def _solve(hist: DataFrame, targets: DataFrame, cap: float, steps: int, tolerance: float) -> DataFrame:
    """source, scale, lam: Newton on log g(lam) = log target, kept inside a bracket that every step tightens."""
    lam = targets.select(
        "source", "target", "source_size",
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
        (F.col("target") >= cap * F.col("source_size")).alias("done"),
    )
    scales = hist.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("scale"))
    files = max(1, targets.count() // 20_000)
    lam = written(_join_source(lam, scales), "mix-dual", files=files)
    for _ in range(steps):
        if lam.where(~F.col("done")).limit(1).count() == 0:
            break
        x = F.col("size") / F.col("scale")
        raw = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        mass = F.col("n") * F.col("size") * F.least(raw, F.lit(cap))
        slope = F.when(raw < cap, F.col("n") * F.col("size") * x * raw).otherwise(0.0)
        open_rows = _join_source(hist, broadcast_within(lam.where(~F.col("done")).select("source", "lam", "scale"), MAX_BROADCAST_SOURCES), "inner")
        sums = open_rows.groupBy("source").agg(F.sum(mass).alias("g"), F.sum(slope).alias("dg"))
        got = _join_source(lam, sums)
        g, t = F.col("g"), F.col("target")
        lo = F.when(g < t, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(g > t, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") + (F.log(t) - F.log(g)) * g / F.col("dg")
        # without a bound on that side the step doubles outwards; between two bounds a step that leaves them becomes the middle
        beside = F.when(lo.isNull(), hi - 2 * F.abs(hi) - 1).when(hi.isNull(), lo + 2 * F.abs(lo) + 1).otherwise((lo + hi) / 2)
        inside = newton.isNotNull() & ~F.isnan(newton) & (F.abs(newton - F.col("lam")) < 20) & (lo.isNull() | (newton > lo)) & (hi.isNull() | (newton < hi))
        near = F.abs(g - t) <= tolerance * F.greatest(t, F.lit(1.0))
        step = F.when(F.col("done") | near, F.col("lam")).when((F.col("dg") > 0) & (g > 0) & (t > 0) & inside, newton).otherwise(beside)
        lam = written(got.select("source", "target", "source_size", step.alias("lam"), lo.alias("lo"), hi.alias("hi"), (F.col("done") | near).alias("done"), "scale"), "mix-dual", files=files)
    return lam


def _join_source(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    right = right.withColumnRenamed("source", "source_r")
    return left.join(right, left["source"].eqNullSafe(right["source_r"]), how).drop("source_r")


def entropy_mix(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    steps: int = 40,
    tolerance: float = 1e-7,
    block_rows: int = 50_000,
) -> DataFrame:
    """From doc_id, source, size: doc_id, source, size, source_size, target, rate, copies, taken.

    copies: whole copies, 0 to cap; taken: words taken, copies * size but for one document per source that gives or takes part of a
    copy so that the source's sum meets its target. Documents without words take 0 words and 1 copy. The result depends on the rows
    alone, not on their order or partitioning; repeated rows are told apart by their rank. A null source is a source; null doc_ids are
    documents each. An empty table gives an empty result.

    Rounding runs along each source's documents, larger sizes first (by classes of half a doubling, then blocks by a hash, of which there are 64
    and one more for every block_rows rows of the table): what was taken before a document decides whether its fraction becomes a copy.
    """
    n, files = sizes.count(), files_for(sizes)
    sizes = written(sizes.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size")), "mix-sizes", compact=True, files=files)  # texts are read once
    hist = written(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist", files=files)
    targets = written(source_targets(hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, cap), "mix-targets", files=1)
    blocks = 64 + n // block_rows
    dual = broadcast_within(_solve(hist, targets, cap, steps, tolerance).select("source", "lam", "scale", "target", "source_size"), MAX_BROADCAST_SOURCES)

    full = F.col("target") >= cap * F.col("source_size")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(full, F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0)))))
    docs = _join_source(sizes, dual)
    docs = docs.select("doc_id", "source", "size", "source_size", "target", rate.alias("rate"))
    # rounded up a little so that a rate of exactly 2 is 2 copies
    docs = docs.select(
        "*",
        F.floor(F.col("rate") + 1e-9).cast("long").alias("base"),
        F.greatest(F.lit(0.0), F.col("rate") - F.floor(F.col("rate") + 1e-9)).alias("frac"),
        F.floor(2 * F.log2(F.col("size") + 1)).cast("int").alias("cls"),
        F.pmod(F.xxhash64("doc_id", "size"), F.lit(blocks)).alias("block"),
    )

    # cumulative fractions: over (source, size class, block) first, a bounded number per source, then inside each of these
    cells = docs.groupBy("source", "cls", "block").agg(F.sum(F.round(F.col("frac") * 1e6).cast("long")).alias("f"))
    upto = Window.partitionBy("source").orderBy(F.col("cls").desc(), "block")
    cells = cells.select("source", "cls", "block", (F.sum("f").over(upto) - F.col("f")).alias("f0"))
    right = cells.select(F.col("source").alias("s_r"), F.col("cls").alias("c_r"), F.col("block").alias("b_r"), "f0")
    placed = docs.join(right, docs["source"].eqNullSafe(right["s_r"]) & (docs["cls"] == right["c_r"]) & (docs["block"] == right["b_r"])).drop("s_r", "c_r", "b_r")
    inner = Window.partitionBy("source", "cls", "block").orderBy(F.col("size").desc(), F.xxhash64("doc_id", "size"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f = F.round(F.col("frac") * 1e6).cast("long")
    end = F.col("f0") + F.sum(f).over(inner)
    half = F.lit(500_000)
    extra = (F.floor((end + half) / 1_000_000) - F.floor((end - f + half) / 1_000_000))
    copies = F.least(F.lit(int(cap)), F.col("base") + extra).cast("long")
    rounded = written(placed.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), F.monotonically_increasing_id().alias("rid")), "mix-copies", files=files)

    # the rest of each source's rounding error goes to its largest document that can take most of it
    off = rounded.groupBy("source").agg((F.round(F.first("target")).cast("long") - F.sum(F.col("copies") * F.col("size"))).alias("off"))
    room = F.when(F.col("off") > 0, F.least("off", F.col("size") * int(cap) - F.col("copies") * F.col("size"))).otherwise(F.greatest("off", -F.col("copies") * F.col("size")))
    near = _join_source(rounded, broadcast_within(off, MAX_BROADCAST_SOURCES)).withColumn("room", room)
    taker = near.groupBy("source").agg(F.max(F.struct(F.abs("room").alias("r"), "size", "doc_id", "room", "rid")).alias("m"))
    taker = taker.select("source", F.col("m.rid").alias("t_rid"), F.col("m.room").alias("t_room"))
    out = _join_source(rounded, broadcast_within(taker, MAX_BROADCAST_SOURCES))
    whole = F.col("copies") * F.col("size")
    bound = F.when(F.col("rid") == F.col("t_rid"), F.greatest(F.lit(0), F.least(whole + F.col("t_room"), F.col("size") * int(cap)))).otherwise(whole)
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", bound.cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **kwargs) -> DataFrame:
    """entropy_mix over documents; size is the number of words of the text, 0 for a null text."""
    return entropy_mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), **kwargs)


def apply_mix(docs: DataFrame, **kwargs) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, in as many whole copies as the mix takes.

    Rows are told apart by doc_id, source and text together (64 bits of hash). Rows alike in all three take the same number of copies each, the
    rounded mean of what the mix gives them. Null texts are documents without words, which come once. An empty table gives an empty result.
    """
    key = F.xxhash64("doc_id", "source", "text")
    sizes = docs.select(key.alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    copies = entropy_mix(sizes, **kwargs).groupBy("doc_id").agg(F.round(F.avg("copies")).cast("long").alias(internal("copies")))
    copies = copies.where(F.col(internal("copies")) > 0).withColumnRenamed("doc_id", internal("right"))
    joined = docs.withColumn(internal("key"), key).join(copies, F.col(internal("key")) == F.col(internal("right")))
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col(internal("copies")))).alias(internal("copy"))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), times).drop(internal("copy"))
