"""Item quality: warnings, scores, distributions and the hand-off to training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.functions.geometry import orientation

# What each warning takes off a score of 100.
PENALTIES = {
    "video_metadata_missing": 25, "low_resolution": 25, "low_megapixels": 10, "media_missing": 60, "very_dark": 12, "very_bright": 12, "low_contrast": 10,
    "low_edge_detail": 10, "duplicate_caption": 8, "caption_over_profile_limit": 15, "caption_missing": 40, "crop_near_profile_limit": 5,
}


def quality_rules(settings: dict) -> list[tuple[str, Column]]:
    """Each warning with its condition over media_exists, is_video, width, height, brightness_mean, contrast_stddev, edge_sharpness, caption_exists, caption_words, duplicate_caption, removed_area_fraction."""
    s = lambda k, d: float(settings.get(k, d))
    c = F.col
    sized = c("media_exists") & (F.coalesce(c("width"), F.lit(0)) > 0) & (F.coalesce(c("height"), F.lit(0)) > 0)
    limit = s("crop_max_removed_fraction", 1.0)
    return [
        ("video_metadata_missing", c("media_exists") & c("is_video") & ~sized),
        ("low_resolution", sized & (F.least("width", "height") < s("quality_minimum_dimension", 512))),
        ("low_megapixels", sized & (c("width") * c("height") / 1e6 < s("quality_minimum_megapixels", 0.35))),
        ("media_missing", ~sized),
        ("very_dark", c("brightness_mean") < s("quality_dark_threshold", 22)),
        ("very_bright", c("brightness_mean") > s("quality_bright_threshold", 238)),
        ("low_contrast", c("contrast_stddev") < s("quality_low_contrast_threshold", 18)),
        ("low_edge_detail", c("edge_sharpness") < s("quality_low_sharpness_threshold", 1.5)),
        ("duplicate_caption", c("caption_exists") & c("duplicate_caption")),
        ("caption_over_profile_limit", c("caption_exists") & (c("caption_words") > int(s("caption_max_words", 120)))),
        ("caption_missing", ~c("caption_exists")),
        ("crop_near_profile_limit", F.lit(limit < 1.0) & (c("removed_area_fraction") >= limit * 0.9)),
    ]


def item_quality(items: DataFrame, settings: dict) -> DataFrame:
    """items with warnings, score, orientation and megapixels; a rule about a figure that is null does not apply."""
    rules = quality_rules(settings)
    warnings = F.array_compact(F.array(*(F.when(cond, F.lit(code)) for code, cond in rules)))
    loss = sum((F.when(cond, F.lit(PENALTIES[code])).otherwise(F.lit(0)) for code, cond in rules), F.lit(0))
    sized = F.col("media_exists") & (F.col("width") > 0) & (F.col("height") > 0)
    return items.select(
        "*", warnings.alias("warnings"), F.greatest(F.lit(0), 100 - loss).alias("score"),
        F.when(sized, orientation(F.col("width"), F.col("height"))).otherwise("unknown").alias("orientation"),
        F.when(sized, F.round(F.col("width") * F.col("height") / 1e6, 4)).otherwise(0.0).alias("megapixels"),
    )


def with_duplicate_captions(items: DataFrame, key: Column) -> DataFrame:
    """items with duplicate_caption: another item has the same caption key. Counted by a partial aggregate, joined back on the key."""
    counts = items.where(key != "").groupBy(key.alias("d_key")).agg(F.count(F.lit(1)).alias("d_n")).where("d_n > 1")
    return items.join(counts, key == F.col("d_key"), "left").withColumn("duplicate_caption", F.col("d_key").isNotNull()).drop("d_key", "d_n")


def warning_counts(quality: DataFrame) -> DataFrame:
    return quality.select(F.explode("warnings").alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


def score_summary(quality: DataFrame) -> DataFrame:
    return quality.agg(
        F.coalesce(F.round(F.avg("score"), 2), F.lit(0.0)).alias("average_score"), F.coalesce(F.min("score"), F.lit(0)).alias("minimum_score"), F.coalesce(F.max("score"), F.lit(0)).alias("maximum_score"),
        F.count_if(F.size("warnings") > 0).alias("warning_item_count"), F.count(F.lit(1)).alias("items"),
    )


def caption_word_summary(quality: DataFrame) -> DataFrame:
    w = F.col("caption_words")
    return quality.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.round(F.avg(w), 2), F.lit(0.0)).alias("average_words"), F.coalesce(F.min(w), F.lit(0)).alias("minimum_words"), F.coalesce(F.max(w), F.lit(0)).alias("maximum_words"))


def training_handoff(quality: DataFrame, profile: dict) -> DataFrame:
    """One row: how many sized items reach the preferred area, coverage, megapixels, and items of another profile version."""
    target = handoff_target(profile)
    area = target**2 if target else None
    pixels = F.when(F.col("media_exists") & (F.col("width") > 0) & (F.col("height") > 0), (F.col("width") * F.col("height")).cast("long"))
    at = F.count_if(pixels >= area) if area else F.lit(0).cast("long")
    n = F.count(pixels)
    version = profile.get("profile_version", "")
    return quality.agg(
        n.alias("evaluated_image_count"), at.alias("at_or_above_target_area_count"), (n - at if area else F.lit(0).cast("long")).alias("below_target_area_count"),
        (F.when(n > 0, F.round(at / n, 4)) if area else F.lit(None).cast("double")).alias("target_area_coverage_fraction"),
        F.round(F.min(pixels) / 1e6, 4).alias("minimum_source_megapixels"), F.round(F.avg(pixels) / 1e6, 4).alias("average_source_megapixels"),
        F.count_if(F.col("profile_version").isNotNull() & (F.col("profile_version") != "") & (F.col("profile_version") != version) & F.lit(bool(version))).alias("outdated_caption_profile_count"),
    )


def handoff_target(profile: dict) -> int | None:
    """The first preferred resolution."""
    return next((int(v) for v in profile["settings"].get("preferred_resolutions", []) if int(v) > 0), None)


def histogram(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def naming_summary(items: DataFrame) -> DataFrame:
    numbered = F.col("output_naming_mode") == "lora_name_numbered"
    seq = F.when(numbered, F.col("naming_sequence"))
    return items.agg(F.count_if(numbered).alias("numbered_pair_count"), F.min(seq).alias("sequence_minimum"), F.max(seq).alias("sequence_maximum"), (F.count(seq) == F.count_if(numbered)).alias("stable_sequence_complete"))
