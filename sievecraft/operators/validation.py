"""Validation of items and data sets, audits and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.functions.captions import caption_lines, joined_caption, normalize_error, profile_error, strip_reasoning, tags_of
from sievecraft.functions.geometry import orientation, video_orientation
from sievecraft.functions.text import basename, casefold, first_match, fixed, strip
from sievecraft.sources.files import media_type

CLEAN_STATES = ("not_detected", "removed", "verified_clean", "cleaned_universal", "skipped_video")
QUIET_VERIFICATIONS = ("not_requested", "verification_processing", "verified_clean", "skipped_video")


def caption_verdict(captions: DataFrame, profile: dict) -> DataFrame:
    """captions with normalized and caption_error (null if the caption passes)."""
    s = profile["settings"]
    rows = captions.withColumn("__lines", caption_lines(strip_reasoning(F.col("caption")))).withColumn("__joined", joined_caption(F.col("__lines")))
    rows = rows.withColumn("caption_error", F.coalesce(normalize_error(F.col("__lines"), F.col("__joined"), s.get("caption_max_characters", 4000)), profile_error(F.col("__joined"), profile)))
    shown = F.array_join(tags_of(F.col("__joined")), ", ") if s.get("caption_output_format") == "comma_separated_tags" else F.col("__joined")
    return rows.withColumn("normalized", F.when(F.col("caption_error").isNull(), shown)).drop("__lines", "__joined")


def record_errors(profile: dict) -> Column:
    """Error codes over media_exists, is_video, corrupt, width, height, fps, duration, frames, target_fps, target_frames, expected_width, expected_height, caption_exists, caption and caption_error.

    A condition on a value that is null does not apply.
    """
    c = F.col
    seen = c("media_exists") & ~c("corrupt")
    video = seen & c("is_video")
    text = strip(F.coalesce(c("caption"), F.lit("")))
    trigger, needed = profile.get("trigger", "").strip(), profile["settings"].get("trigger_required", False)
    caption = F.when(c("caption_exists"), text).otherwise("")
    rules = [
        (~c("media_exists") & c("is_video"), "video_missing"),
        (~c("media_exists") & ~c("is_video"), "image_missing"),
        (video & ((c("duration") <= 0) | (c("fps") <= 0)), "video_invalid_timing"),
        (video & (c("target_frames") > 0) & (c("frames") != c("target_frames")), "video_frame_count_mismatch"),
        (video & (c("target_fps") > 0) & (F.abs(c("fps") - c("target_fps")) > 0.01), "video_fps_mismatch"),
        (video & ((c("width") != c("expected_width")) | (c("height") != c("expected_height"))), "video_orientation_size_mismatch"),
        (c("media_exists") & c("corrupt") & c("is_video"), "video_corrupt"),
        (c("media_exists") & c("corrupt") & ~c("is_video"), "image_corrupt"),
        (~c("caption_exists"), "caption_missing"),
        (c("caption_exists") & (text == ""), "caption_empty"),
        (c("caption_exists") & (text != "") & (c("caption_error") == "absence_language"), "caption_negative_or_absence_language"),
        (c("caption_exists") & (text != "") & c("caption_error").isNotNull() & (c("caption_error") != "absence_language"), "caption_profile_invalid"),
        (F.lit(bool(needed and trigger)) & ~F.contains(casefold(caption), casefold(F.lit(trigger))), "trigger_missing"),
    ]
    return F.array_compact(F.array(*(F.when(cond, F.lit(code)) for cond, code in rules)))


def expected_video_size(width: Column, height: Column, config: dict, prepared_orientation: Column | None = None) -> Column:
    """width and height that a clip normalised by orientation should have; null where any size will do."""
    if config.get("size_strategy") != "normalize_by_orientation" or config.get("resize_mode") not in ("crop_to_fill", "pad_to_fit", "stretch"):
        return F.lit(None).cast("struct<width:int,height:int>")
    own = video_orientation(width, height)
    kind = own if prepared_orientation is None else F.when(prepared_orientation.isin("landscape", "portrait"), prepared_orientation).otherwise(own)
    side = lambda s: F.when(kind == "landscape", config[f"landscape_{s}"]).otherwise(config[f"portrait_{s}"])
    return F.struct(side("width").alias("width"), side("height").alias("height"))


def every(condition: Column) -> Column:
    """Whether a condition holds for all rows; true without rows, and a null counts as false."""
    return F.coalesce(F.bool_and(F.coalesce(condition, F.lit(False))), F.lit(True))


def watermark_clean() -> Column:
    video = media_type(F.col("output_image_path")) == "video"
    w = F.col("watermark_status")
    checked = (w == "verified_clean") & (F.col("cleanup_verification_status") == "verified_clean")
    return F.when(video, w == "skipped_video").when(F.col("cleanup_verifier_version") != "none", checked).otherwise(w.isin(*CLEAN_STATES))


def audits(items: DataFrame) -> DataFrame:
    """One row of the audits that decide about readiness, over active items that are not excluded."""
    eligible = items.where(F.col("active") & (F.col("status") != "excluded"))
    return eligible.agg(
        F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("status") == "complete").alias("complete"), every(watermark_clean()).alias("watermark_audit_complete"),
        every(F.col("analysis_status").rlike("^(analyzed_|skipped_video)")).alias("analysis_audit_complete"),
        every((F.col("crop_provider_version") == "none") | F.col("crop_status").rlike("^(cropped_|prepared_|not_needed_|skipped_)")).alias("crop_audit_complete"),
    )


def training_ready(audit: DataFrame, valid: Column) -> DataFrame:
    good = valid & F.col("watermark_audit_complete") & F.col("analysis_audit_complete") & F.col("crop_audit_complete")
    return audit.select("*", (good & (F.col("eligible") > 0) & (F.col("complete") == F.col("eligible"))).alias("training_ready"))


def image_reference(output: Column, source: Column) -> Column:
    return F.coalesce(F.when(F.coalesce(output, F.lit("")) != "", basename(output)), source)


def issue_stage() -> Column:
    ends = lambda c: F.coalesce(F.col(c), F.lit("")).endswith("failed")
    return F.coalesce(
        first_match([
            (~F.coalesce(F.col("cleanup_verification_status"), F.lit("not_requested")).isin(*QUIET_VERIFICATIONS), "cleanup_verification"),
            (F.col("review_status") == "exact_duplicate_excluded", "duplicate_detection"),
            (ends("watermark_status"), "cleanup"), (ends("analysis_status"), "analysis"), (ends("crop_status"), "crop"),
        ]),
        F.lit("caption_or_validation"),
    )


def issues(items: DataFrame) -> DataFrame:
    """One row per active failed or excluded item with the stage that stopped it, the reason and where its evidence would lie."""
    rows = items.where(F.col("active") & F.col("status").isin("failed", "excluded"))
    verification = F.coalesce(F.col("cleanup_verification_status"), F.lit("not_requested"))
    short = F.substring("source_hash", 1, 12)
    copy = F.col("review_status") == "exact_duplicate_excluded"
    where = F.when(copy, F.concat(F.lit("duplicates/exact/"), "item_id", F.lit("-"), short)).otherwise(F.concat(F.lit("cleanup_verification/"), "item_id", F.lit("-"), short, F.lit("-"), F.coalesce("profile_version", F.lit("None"))))
    reason = F.coalesce(*(F.when(c != "", c) for c in (F.col("error"), verification)), F.lit("Unknown processing error"))
    return rows.select("item_id", image_reference(F.col("output_image_path"), F.col("source_relative_path")).alias("image"), F.col("source_relative_path").alias("source_image"), "status", issue_stage().alias("stage"), reason.alias("reason"), verification.alias("cleanup_verification_status"), "review_status", where.alias("review_path"))


_DETECTIONS = "struct<status:string,passed:boolean,confidence_threshold:double,residual_detection_count:int,override_applied:boolean,fidelity_failures:array<string>,residual_detections:array<struct<label:string,confidence:double,bbox:array<double>,bbox_normalized:array<double>>>>"


def verification_payload(json_text: Column) -> Column:
    """The verification's struct; bad or missing JSON gives null fields."""
    return F.from_json(F.coalesce(json_text, F.lit("{}")), _DETECTIONS)


def override_keys(lines: DataFrame) -> DataFrame:
    """key: a user's list entries without blanks, quotes and a leading "- ", comments left out; each by its full path and by its name."""
    entry = F.regexp_replace(F.regexp_replace(F.trim("line"), r"\A\"+|\"+\z", ""), r"\A'+|'+\z", "")
    entry = F.when(entry.startswith("- "), F.trim(F.substring(entry, F.lit(3), F.length(entry)))).otherwise(entry)
    rows = lines.select(entry.alias("e")).where((F.col("e") != "") & ~F.col("e").startswith("#"))
    return rows.select(F.explode(F.array(casefold(F.replace("e", F.lit("\\"), F.lit("/"))), casefold(basename(F.col("e"))))).alias("key")).distinct()


def override_matches(items: DataFrame, keys: DataFrame) -> DataFrame:
    """item_id and matched_name: the first of relative path, its name and the output's name that a key names."""
    rel, out = F.col("source_relative_path"), F.col("output_image_path")
    names = F.array(*(F.struct(F.lit(i).alias("order"), v.alias("name"), casefold(v).alias("cf")) for i, v in enumerate((rel, basename(rel), basename(out)))))
    rows = items.select("item_id", F.explode(names).alias("n")).select("item_id", "n.order", "n.name", "n.cf")
    hit = rows.join(keys, F.col("cf") == F.col("key"))
    return hit.groupBy("item_id").agg(F.min(F.struct("order", "name")).alias("m")).select("item_id", F.col("m.name").alias("matched_name"))


def override_applies(matched: Column, status: Column, detections: Column, failures: Column) -> Column:
    return matched.isNotNull() & (status == "residual_artifact") & (F.coalesce(F.size(detections), F.lit(0)) > 0) & (F.coalesce(F.size(failures), F.lit(0)) <= 0)


def verification_folder() -> Column:
    """Where the evidence of a clean-up that did not pass lies, below the review folder."""
    return F.concat(F.lit("cleanup_verification/"), "item_id", F.lit("-"), F.substring("source_hash", 1, 12), F.lit("-"), F.coalesce("profile_version", F.lit("None")))


def orphan_outputs(listing: DataFrame, items: DataFrame) -> DataFrame:
    """Paths of the listing that no active item which is not excluded claims."""
    known = items.where(F.col("active") & (F.col("status") != "excluded")).select(F.explode(F.array("output_image_path", "caption_path")).alias("path"))
    return listing.select("path").join(known, "path", "left_anti").distinct()


def quarantine_moves(candidates: DataFrame, items: DataFrame, reason: str) -> DataFrame:
    """src, dst of the outputs of candidates (inactive or remapped items) that no active item claims."""
    claimed = items.where("active").select(F.explode(F.array("output_image_path", "caption_path")).alias("path"))
    folder = F.concat(F.lit(f"{reason}/"), "item_id", F.lit("-"), F.substring("source_hash", 1, 12), F.lit("-"), F.coalesce("profile_version", F.lit("None")))
    paths = candidates.select("item_id", folder.alias("folder"), F.explode(F.array("output_image_path", "caption_path")).alias("path")).where("path <> ''")
    return paths.join(claimed, "path", "left_anti").select("item_id", F.col("path").alias("src"), F.concat("folder", F.lit("/"), basename(F.col("path"))).alias("dst"))


def duplicate_evidence(decisions: DataFrame, items: DataFrame) -> DataFrame:
    """dst and evidence (JSON) of the record that each newly excluded exact duplicate leaves for review."""
    paths = items.select(F.col("item_id").alias("p_id"), "source_relative_path", "source_path")
    rows = decisions.where("action = 'exclude'").join(paths, F.col("item_id") == F.col("p_id"))
    body = F.struct(F.lit("exact_duplicate_excluded").alias("status"), F.col("source_relative_path").alias("image"), F.col("keeper_path").alias("duplicate_of"), "source_hash", "item_id", "keeper_id")
    where = F.concat(F.lit("duplicates/exact/"), "item_id", F.lit("-"), F.substring("source_hash", 1, 12), F.lit("/duplicate.json"))
    return rows.select(where.alias("dst"), F.to_json(body).alias("evidence"))


def record_warnings() -> Column:
    small = F.col("media_exists") & ~F.col("corrupt") & (F.least("width", "height") < 512)
    return F.array_compact(F.array(F.when(small, F.lit("low_resolution_below_512"))))


def item_results(items: DataFrame, profile: dict) -> DataFrame:
    """item_id, source_relative_path, source_hash, valid, errors, warnings, caption, width, height, aspect_ratio, media_type of the eligible items.

    items has the columns of record_errors besides those of the item table; a corrupt or missing file has no dimensions.
    """
    rows = caption_verdict(items.where(F.col("active") & (F.col("status") != "excluded")), profile)
    seen = F.col("media_exists") & ~F.col("corrupt")
    width, height = F.when(seen, F.col("width")), F.when(seen, F.col("height"))
    caption = F.when(F.col("caption_exists"), strip(F.coalesce("caption", F.lit("")))).otherwise("")
    errors = record_errors(profile)
    return rows.select(
        "item_id", "source_relative_path", "source_hash", (F.size(errors) == 0).alias("valid"), errors.alias("errors"), record_warnings().alias("warnings"), caption.alias("caption"),
        width.alias("width"), height.alias("height"), F.round(width / height, 6).alias("aspect_ratio"), F.when(F.col("is_video"), "video").otherwise("image").alias("media_type"),
    )


def exact_duplicate_members(items: DataFrame) -> DataFrame:
    """source_hash, source_relative_path of eligible items whose content another eligible item has; groups are counted and joined back."""
    rows = items.where(F.col("active") & (F.col("status") != "excluded")).select("source_hash", "source_relative_path")
    several = rows.groupBy(F.col("source_hash").alias("s_hash")).agg(F.count(F.lit(1)).alias("s_n")).where("s_n > 1").select("s_hash")
    return rows.join(several, F.col("source_hash") == F.col("s_hash"), "left_semi")


_COUNTS = "struct<counts:struct<faces:int,persons:int,objects:int>>"


def detection_counts(analysis_json: Column) -> Column:
    """faces, persons and objects of an analysis; 0 for missing or bad JSON."""
    got = F.from_json(F.coalesce(analysis_json, F.lit("{}")), _COUNTS)["counts"]
    return F.struct(*(F.coalesce(got[c], F.lit(0)).alias(c) for c in ("faces", "persons", "objects")))


#: Histograms of a data set's validation, by field.
VALIDATION_HISTOGRAMS = ("watermark_status_counts", "cleanup_verification_status_counts", "analysis_status_counts", "crop_status_counts", "orientation_counts", "aspect_ratio_counts", "media_type_counts")
VALIDATION_FLAGS = ("valid", "watermark_audit_complete", "analysis_audit_complete", "crop_audit_complete", "training_ready")


def validation_facts(items: DataFrame, listing: DataFrame, profile: dict) -> DataFrame:
    """section, field, key, value: every figure and histogram of a data set's validation, in one pass over the items and one over their results.

    items has the columns of record_errors, cleanup_verification_json and analysis_json besides those of the item table; listing has path.
    """
    from sievecraft.plans import facts
    from sievecraft.plans.storage import written

    results = written(item_results(items, profile), "validation-results")
    active = items.where("active")
    eligible = F.col("status") != "excluded"
    status = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    override = F.coalesce(F.from_json(F.coalesce("cleanup_verification_json", F.lit("{}")), "struct<override_applied:boolean>")["override_applied"], F.lit(False))
    seen = detection_counts(F.col("analysis_json"))
    one = active.agg(
        F.count(F.lit(1)).alias("active_items"), F.count_if(F.col("review_status") == "cleanup_review_required").alias("cleanup_review_items"),
        F.count_if(~eligible & (F.col("review_status") == "cleanup_excluded")).alias("cleanup_excluded_items"), F.count_if(eligible & override).alias("cleanup_override_applied_count"),
        F.count_if(eligible & (seen["faces"] > 0)).alias("face_visible_items"), F.count_if(eligible & (seen["persons"] > 0)).alias("person_visible_items"),
    )
    audit = audits(items).select("watermark_audit_complete", "analysis_audit_complete", "crop_audit_complete", "eligible", "complete")
    bad = F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("long")
    totals = results.agg(F.count(F.lit(1)).alias("items"), F.count_if("valid").alias("valid_items"), F.count_if(~F.col("valid")).alias("invalid_items"), bad.alias("error_count"))
    copies = results.where("caption <> ''").groupBy("caption").count().where("count > 1").agg(F.count(F.lit(1)).alias("duplicate_caption_count"))
    groups = results.groupBy("source_hash").count().where("count > 1").agg(F.count(F.lit(1)).alias("exact_duplicate_group_count"))
    loose = orphan_outputs(listing, items)
    is_caption = F.lower("path").endswith(".txt")
    orphans = loose.agg(F.count_if(~is_caption).alias("orphan_image_count"), F.count_if(is_caption).alias("orphan_caption_count"))
    row = one
    for other in (audit, totals, copies, groups, orphans):  # each a single row
        row = row.join(other, F.lit(True))
    valid = (F.col("error_count") == 0) & (F.col("orphan_image_count") == 0) & (F.col("orphan_caption_count") == 0)
    row = training_ready(row.withColumn("valid", valid), F.col("valid")).drop("eligible", "complete")
    sized = F.col("width").isNotNull() & F.col("height").isNotNull()
    return facts.union(
        facts.from_row(row, "validation", row.columns),
        facts.counts(active, [
            ("validation", "watermark_status_counts", status("watermark_status", "not_requested")), ("validation", "cleanup_verification_status_counts", status("cleanup_verification_status", "not_requested")),
            ("validation", "analysis_status_counts", F.when(eligible, status("analysis_status", "not_started"))), ("validation", "crop_status_counts", F.when(eligible, status("crop_status", "not_requested"))),
        ]),
        facts.counts(results, [
            ("validation", "orientation_counts", F.when(sized, orientation(F.col("width"), F.col("height")))), ("validation", "aspect_ratio_counts", F.when(sized, fixed(F.col("aspect_ratio"), 3))), ("validation", "media_type_counts", F.col("media_type")),
        ]),
        facts.counts(results.select(F.explode("errors").alias("e")), [("validation", "error_counts", F.col("e"))]),
    )
