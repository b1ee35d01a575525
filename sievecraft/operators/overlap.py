"""Interval joins by time buckets: an equi-join on key and bucket, then the exact condition; transcripts of windows on top of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.functions.intervals import segment_line, window_bounds
from sievecraft.functions.text import strip


def overlap_join(left: DataFrame, right: DataFrame, key: str, bucket: float) -> DataFrame:
    """Rows of both sides with equal key whose closed intervals start..end meet; columns are prefixed l_ and r_.

    Each interval enters every bucket that it touches, and a pair is taken in the first bucket that both touch, so it appears once.
    Choose a bucket about as long as a typical interval. Rows with a null bound or an end before their start meet nothing.
    """

    def dealt(df: DataFrame, p: str) -> DataFrame:
        cell = lambda c: F.floor(F.col(c) / F.lit(float(bucket))).cast("long")
        rows = df.where(F.col("start").isNotNull() & (F.col("end") >= F.col("start")))
        return rows.select(*(F.col(c).alias(f"{p}{c}") for c in df.columns), cell("start").alias(f"{p}__first"), F.explode(F.sequence(cell("start"), cell("end"))).alias(f"{p}__cell"))

    a, b = dealt(left, "l_"), dealt(right, "r_")
    on = (F.col(f"l_{key}") == F.col(f"r_{key}")) & (F.col("l___cell") == F.col("r___cell"))
    meet = (F.col("l_end") >= F.col("r_start")) & (F.col("l_start") <= F.col("r_end")) & (F.col("l___cell") == F.greatest("l___first", "r___first"))
    return a.join(b, on).where(meet).drop("l___first", "l___cell", "r___first", "r___cell")


def window_transcripts(segments: DataFrame, clips: DataFrame, key: str, bucket: float, margin: float = 0.2) -> DataFrame:
    """clip and transcript of every clip: the words, or the texts of segments without words, that meet its window, in order of `order`.

    segments: key, order, start, end, text, reliable, words (array of word, start, end). clips: clip, key, start, duration. Unreliable segments are left
    out. Only what meets a window is brought together, so a row's size follows the window, not the recording.
    """
    low, high = window_bounds(F.col("start"), F.col("duration"), margin)
    windows = clips.select("clip", key, low.alias("start"), high.alias("end"))
    words = F.coalesce("words", F.array().cast("array<struct<word:string,start:double,end:double>>"))
    first, last = (f(F.concat(F.array(F.coalesce(F.col(c), F.col("start"))), F.transform(words, pick))) for f, c, pick in ((F.array_min, "start", lambda w: w["start"]), (F.array_max, "end", lambda w: F.coalesce(w["end"], w["start"]))))
    spoken = segments.where(F.coalesce("reliable", F.lit(True))).select(key, "order", first.alias("start"), last.alias("end"), F.struct("start", "end", "text", words.alias("words")).alias("segment"))
    met = overlap_join(spoken, windows, key, bucket)
    lines = met.select(F.col("r_clip").alias("clip"), F.col("l_order").alias("order"), segment_line(F.col("l_segment"), F.col("r_start"), F.col("r_end")).alias("line")).where("line <> ''")
    texts = lines.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("order", "line"))).alias("lines")).select(F.col("clip").alias("t_clip"), strip(F.array_join(F.col("lines.line"), " ")).alias("transcript"))
    return clips.select("clip").join(texts, F.col("clip") == F.col("t_clip"), "left").select("clip", F.coalesce("transcript", F.lit("")).alias("transcript"))
