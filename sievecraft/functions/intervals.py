"""Transcript reliability and time windows as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The limits of an acceptable transcript segment.
MIN_LOGPROB, MAX_NO_SPEECH, MAX_COMPRESSION, MIN_WORD_PROBABILITY, AUDIO_SLACK = -1.0, 0.6, 2.4, 0.4, 0.75


def harvested_start(stem: Column) -> Column:
    """Seconds from a clip name's _t and ten digits of milliseconds, else null."""
    digits = F.regexp_extract(stem, r"_t(\d{10})(?:_|$)", 1)
    return F.when(digits != "", digits.cast("double") / 1000.0)


def segment_reasons(logprob: Column, no_speech: Column, compression: Column, words: Column, end: Column, audio: Column) -> Column:
    """Codes of what makes a segment unreliable; missing confidence counts as none. words: array of structs with word and probability."""
    spoken = F.filter(words, lambda w: strip(F.coalesce(w["word"], F.lit(""))) != "")
    least = F.array_min(F.transform(spoken, lambda w: F.coalesce(w["probability"], F.lit(0.0))))
    return F.array_compact(F.array(
        F.when(F.coalesce(logprob, F.lit(-99.0)) < MIN_LOGPROB, "low_segment_probability"),
        F.when(F.coalesce(no_speech, F.lit(1.0)) > MAX_NO_SPEECH, "probable_non_speech"),
        F.when(F.coalesce(compression, F.lit(99.0)) > MAX_COMPRESSION, "repetitive_transcript"),
        F.when(least < MIN_WORD_PROBABILITY, "low_word_probability"),
        F.when(end > audio + AUDIO_SLACK, "timestamp_outside_audio"),
    ))


def window_bounds(start: Column, duration: Column, margin: float = 0.2) -> tuple[Column, Column]:
    return F.greatest(F.lit(0.0), start - margin), start + F.greatest(F.lit(0.0), duration) + margin


def segment_line(s: Column, low: Column, high: Column) -> Column:
    """The words of a segment that meet low..high, or its text if it has no words and meets them itself."""
    near = F.filter(s["words"], lambda w: (F.coalesce(w["end"], w["start"]) >= low) & (w["start"] <= high))
    spoken = strip(F.array_join(F.transform(near, lambda w: F.coalesce(w["word"], F.lit(""))), ""))
    inside = (F.coalesce(s["end"], s["start"]) >= low) & (s["start"] <= high)
    return F.when(F.size(F.coalesce(s["words"], F.array().cast("array<struct<word:string,start:double,end:double>>"))) > 0, spoken).when(inside, strip(F.coalesce(s["text"], F.lit(""))))


def transcript_for_window(segments: Column, start: Column, duration: Column, margin: float = 0.2) -> Column:
    """The words, or the texts of segments without words, that overlap the window; unreliable segments are left out. For one recording's segments in a row."""
    low, high = window_bounds(start, duration, margin)
    kept = F.filter(segments, lambda s: F.coalesce(s["reliable"], F.lit(True)))
    return strip(F.array_join(F.filter(F.transform(kept, lambda s: segment_line(s, low, high)), lambda x: x != ""), " "))


def context_window(start: Column, duration: Column, padding: float = 5.0, minimum: float = 5.0) -> Column:
    """Start and length of the audio to transcribe around a clip."""
    at = F.greatest(F.lit(0.0), start)
    begin = F.greatest(F.lit(0.0), at - padding)
    return F.struct(begin.alias("start"), (F.greatest(duration, F.lit(minimum)) + (at - begin) + padding).alias("duration"))


def cache_signature(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 20)


def audio_evidence(stem: Column, clip_offset: Column, has_original: Column) -> Column:
    """Where a clip's words are looked for: on the original from its harvested start, else on the clip itself."""
    start = harvested_start(stem)
    on_original = has_original & start.isNotNull()
    return F.struct(F.when(on_original, "original").otherwise("clip").alias("source"), F.when(on_original, start + clip_offset).otherwise(clip_offset).alias("start"))
