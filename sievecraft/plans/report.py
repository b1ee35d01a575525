"""The dataset report: figures as facts, lists as tables, and their JSON and text forms."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.operators.dedup import caption_group_members, caption_key, near_duplicate_groups
from sievecraft.operators.descriptors import caption_recurrence
from sievecraft.operators.quality import caption_word_summary, handoff_target, item_quality, naming_summary, score_summary, training_handoff, with_duplicate_captions
from sievecraft.operators.validation import detection_counts, image_reference

from . import facts
from .storage import written

SCHEMA_VERSION = 2
FLAGS = ("training_ready", "stable_sequence_complete")
HISTOGRAMS = (("counts", "media_types"), ("quality", "warning_counts"), ("training_handoff", "caption_profile_version_counts"), ("naming", "mode_counts"), ("distribution", "orientation_counts"), ("distribution", "resolution_counts"), ("distribution", "crop_status_counts"))


def assessment(ready: bool, near: int, captions: int, guidance: int, warned: int, total: int, average: float) -> str:
    if not ready:
        return "NOT_READY"
    review = near or captions or guidance or (total and warned / total > 0.25) or (total and average < 80)
    return "REVIEW_RECOMMENDED" if review else "GOOD"


def guidance(profile: dict, below_target: int, recurring: int, outdated: int) -> list[str]:
    krea, character = profile.get("model") == "krea2", profile.get("model") == "krea2" and profile.get("dataset_type") == "character"
    rules = [
        (character and not profile.get("trigger", "").strip(), "krea_character_trigger_missing"),
        (krea and below_target > 0, "krea_1024_bucket_source_coverage_incomplete"),
        (character and recurring > 0, "krea_character_recurring_descriptors"),
        (character and outdated > 0, "krea_caption_recipe_revision_mixed"),
    ]
    return [code for holds, code in rules if holds]


def guidance_message(code: str, handoff: dict) -> str:
    return {
        "krea_character_trigger_missing": "No trigger is set; a trigger would carry the character's identity.",
        "krea_1024_bucket_source_coverage_incomplete": f"{handoff.get('below_target_area_count', 0)} image(s) have fewer pixels than {handoff.get('target_bucket_resolution')}\u00b2; training may have to enlarge them.",
        "krea_character_recurring_descriptors": "Some descriptors stand in most captions and may be learnt beside the trigger; see the list.",
        "krea_caption_recipe_revision_mixed": f"{handoff.get('outdated_caption_profile_count', 0)} caption(s) come from another revision of the profile; a rebuild with a new revision writes them again.",
    }[code]


@dataclass
class DatasetReport:
    """facts: section, field, key, value. The other tables hold one row per item or member, as large as the data set."""

    facts: DataFrame
    recurrence: dict
    quality: DataFrame
    warning_items: DataFrame
    exact_excluded: DataFrame
    near_duplicate_members: DataFrame
    duplicate_caption_members: DataFrame
    failed: DataFrame
    excluded: DataFrame


def dataset_report(items: DataFrame, profile: dict, ready: bool) -> DatasetReport:
    """The report over the active complete items. What the figures are taken from is written once; each table of figures is one pass over it.

    items: the item table with caption, perceptual_hash and the columns of item_quality.
    """
    settings = profile["settings"]
    active = items.where("active")
    done = active.where(F.col("status") == "complete")
    quality = written(item_quality(with_duplicate_captions(done.withColumn("image", image_reference(F.col("output_image_path"), F.col("source_relative_path"))), F.when(F.col("caption_exists"), caption_key(F.col("caption")))), settings), "report-quality")
    distance = int(settings.get("near_duplicate_maximum_hamming_distance", 6))
    stills = quality.where(~F.col("is_video") & F.col("perceptual_hash").isNotNull())
    near = near_duplicate_groups(stills.select(F.col("item_id").alias("id"), F.col("perceptual_hash").alias("hash"), F.col("source_hash").alias("content")), distance)
    named = quality.select(F.col("item_id").alias("q_id"), "image")
    near = written(near.join(named, F.col("id") == F.col("q_id")).select("group_id", "group_size", "minimum_distance", F.col("id").alias("item_id"), "image"), "report-near")
    copies = written(caption_group_members(quality.where("caption_exists").select("caption", "image")), "report-captions")

    character = profile.get("model") == "krea2" and profile.get("dataset_type") == "character"
    n = quality.count()
    recurrence = {"caption_count": n, "minimum_fraction": 0.6, "minimum_count": 0, "recurring_descriptors": [], "trigger_bleed_review_recommended": False}
    if character:
        recurrence = caption_recurrence(quality.where("caption_exists").select("caption"), profile.get("trigger", ""))

    of_status = lambda s: F.count_if(F.col("status") == s)
    exact = (F.col("status") == "excluded") & (F.col("review_status") == "exact_duplicate_excluded")
    counts = active.agg(F.count(F.lit(1)).alias("active"), of_status("complete").alias("eligible"), of_status("failed").alias("failed"), of_status("excluded").alias("excluded"), F.count_if(exact).alias("exact_excluded_count"))
    score, words, handoff, naming = score_summary(quality), caption_word_summary(quality), training_handoff(quality, profile), naming_summary(quality)
    seen = detection_counts(F.col("analysis_json"))
    visible = quality.agg(F.count_if(seen["faces"] > 0).alias("face_visible_items"), F.count_if(seen["persons"] > 0).alias("person_visible_items"))
    groups = near.agg(F.count_distinct("group_id").alias("near_duplicate_group_count")).join(copies.agg(F.count_distinct("caption_key").alias("duplicate_caption_group_count")), F.lit(True)).withColumn("near_duplicate_maximum_hamming_distance", F.lit(distance))

    numbered = F.when(F.col("output_naming_mode") == "lora_name_numbered", F.when(F.col("lora_name") != "", F.col("lora_name")))
    sized = F.col("media_exists") & (F.col("width") > 0) & (F.col("height") > 0)
    table = written(facts.union(
        facts.from_row(counts, "counts", ["active", "eligible", "failed", "excluded"]),
        facts.from_row(counts.join(groups, F.lit(True)), "duplicates", ["exact_excluded_count", "near_duplicate_group_count", "duplicate_caption_group_count", "near_duplicate_maximum_hamming_distance"]),
        facts.from_row(score, "quality", ["average_score", "minimum_score", "maximum_score", "warning_item_count"]),
        facts.from_row(words, "captions", ["count", "average_words", "minimum_words", "maximum_words"]),
        facts.from_row(handoff, "training_handoff", handoff.columns),
        facts.from_row(naming, "naming", naming.columns),
        facts.from_row(visible, "distribution", visible.columns),
        facts.counts(quality, [
            ("counts", "media_types", F.when(F.col("is_video"), "video").otherwise("image")), ("training_handoff", "caption_profile_version_counts", F.when(F.col("profile_version") != "", F.col("profile_version"))),
            ("naming", "mode_counts", F.coalesce("output_naming_mode", F.lit("preserve_source_names"))), ("naming", "lora_names", numbered), ("distribution", "orientation_counts", F.col("orientation")),
            ("distribution", "resolution_counts", F.when(sized, F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")))), ("distribution", "crop_status_counts", F.coalesce("crop_status", F.lit("not_requested"))),
        ]),
        facts.counts(quality.select(F.explode("warnings").alias("w")), [("quality", "warning_counts", F.col("w"))]),
    ), "report-facts")

    figures = facts.nested(table)
    codes = guidance(profile, figures["training_handoff"]["below_target_area_count"], len(recurrence["recurring_descriptors"]), figures["training_handoff"]["outdated_caption_profile_count"])
    q = figures["quality"]
    verdict = assessment(ready, figures["duplicates"]["near_duplicate_group_count"], figures["duplicates"]["duplicate_caption_group_count"], len(codes), q["warning_item_count"], n, q["average_score"])
    judged = [("guidance", "warnings", c, 1.0) for c in codes] + [("guidance", "warning_count", None, float(len(codes))), ("report", "assessment", verdict, 1.0), ("report", "training_ready", None, float(ready))]
    judged += [("captions", f, None, float(recurrence[f])) for f in ("caption_count", "minimum_count")] + [("captions", "recurring_descriptors", d["text"], float(d["count"])) for d in recurrence["recurring_descriptors"]]
    table = table.unionByName(items.sparkSession.createDataFrame(judged, facts.SCHEMA))

    ref = ("image", F.col("source_relative_path").alias("source_image"))
    listed = active.withColumn("image", image_reference(F.col("output_image_path"), F.col("source_relative_path")))
    reason = lambda otherwise: F.coalesce(F.when(F.col("error") != "", F.col("error")), F.lit(otherwise)).alias("reason")
    return DatasetReport(
        table, recurrence, quality,
        quality.where(F.size("warnings") > 0).select(*ref, "score", "warnings", "width", "height", "megapixels", "orientation", "caption_words", "brightness_mean", "contrast_stddev", "edge_sharpness"),
        listed.where(exact).select(*ref, reason("Exact duplicate excluded")), near, copies,
        listed.where("status = 'failed'").select(*ref, reason("Failed")), listed.where("status = 'excluded'").select(*ref, reason("Excluded"), "review_status"),
    )


def report_json(report: DatasetReport, profile: dict, generated_at: str, most_listed: int = 1_000) -> dict:
    """The report as one nested object. Lists hold the first most_listed rows in order of their image; `*_listed` says how many of the counted that is.

    write_lists puts the lists out whole.
    """
    out = facts.nested(report.facts, FLAGS, HISTOGRAMS)
    settings = profile["settings"]
    top = out.pop("report")
    out = {"schema_version": SCHEMA_VERSION, "generated_at": generated_at, "assessment": next(iter(top["assessment"])), "training_ready": top["training_ready"]} | out
    target = handoff_target(profile)
    out["training_handoff"] |= {
        "training_checkpoint": settings.get("training_checkpoint"), "preferred_resolutions": settings.get("preferred_resolutions", []), "target_bucket_resolution": target,
        "target_pixel_area": target**2 if target else None, "current_profile_version": profile.get("profile_version", ""), "advisory_only": True,
    }
    out["naming"]["lora_names"] = sorted(out["naming"].get("lora_names", {}), key=str.casefold)
    recurrence = report.recurrence
    out["captions"] = {k: v for k, v in out["captions"].items() if k in ("count", "average_words", "minimum_words", "maximum_words")} | {"recurrence": recurrence}
    codes = out["guidance"].get("warnings", {})
    out["guidance"]["warnings"] = [{"code": c, "message": guidance_message(c, out["training_handoff"])} for c in codes]
    first = lambda df, *order: [r.asDict() for r in df.orderBy(*order).limit(most_listed).collect()]
    out["quality"]["warning_items"] = first(report.warning_items, "image", "source_image")
    out["duplicates"]["exact_excluded"] = first(report.exact_excluded, "image", "source_image")
    grouped: dict[str, dict] = {}
    for r in first(report.near_duplicate_members, "group_id", "image"):
        g = grouped.setdefault(r["group_id"], {"minimum_distance": r["minimum_distance"], "images": []})
        g["images"].append(r["image"])
    out["duplicates"]["near_duplicate_groups"] = list(grouped.values())
    texts: dict[str, list] = {}
    for r in first(report.duplicate_caption_members, "caption_key", "image"):
        texts.setdefault(r["caption_key"], []).append(r["image"])
    out["duplicates"]["duplicate_caption_groups"] = [sorted(v, key=str.casefold) for v in texts.values()]
    out["review"] = {"failed": first(report.failed, "image", "source_image"), "excluded": first(report.excluded, "image", "source_image")}
    out["quality"]["warning_items_listed"] = len(out["quality"]["warning_items"])
    out["duplicates"]["near_duplicate_members_listed"] = sum(len(g["images"]) for g in grouped.values())
    return out


def write_lists(report: DatasetReport, folder: str) -> None:
    """The report's lists, whole, as JSON lines in a folder each."""
    for name in ("warning_items", "exact_excluded", "near_duplicate_members", "duplicate_caption_members", "failed", "excluded"):
        getattr(report, name).write.mode("overwrite").json(f"{folder}/{name}")


def verdict(ready: bool, failed: int) -> str:
    return "TRAINING READY" if ready else "ATTENTION REQUIRED" if failed else "NOT READY"


# The wording of the summary's lines.


def _counted(values: dict) -> str:
    return json.dumps(values, ensure_ascii=False, sort_keys=True)


def _report_lines(r: dict) -> list[str]:
    d, q, c, dist, naming, handoff = (r.get(k) or {} for k in ("duplicates", "quality", "captions", "distribution", "naming", "training_handoff"))
    get = lambda x, k: x.get(k) or 0
    lines = [
        "", "DATASET REPORT", f"Assessment: {r.get('assessment', 'UNKNOWN')}",
        f"Duplicates: {get(d, 'exact_excluded_count')} exact excluded, {get(d, 'near_duplicate_group_count')} near-duplicate group(s), {get(d, 'duplicate_caption_group_count')} duplicate-caption group(s)",
        f"Quality: average {float(get(q, 'average_score')):.1f}/100, {get(q, 'warning_item_count')} item(s) with warnings",
        f"Captions: {get(c, 'count')} total, {float(get(c, 'average_words')):.1f} average words, range {get(c, 'minimum_words')}\u2013{get(c, 'maximum_words')}",
        f"Orientation: {_counted(dist.get('orientation_counts', {}))}", f"Crop outcomes: {_counted(dist.get('crop_status_counts', {}))}",
        f"Visibility: faces in {get(dist, 'face_visible_items')}, people in {get(dist, 'person_visible_items')}",
    ]
    target, checkpoint, evaluated = handoff.get("target_bucket_resolution"), handoff.get("training_checkpoint"), get(handoff, "evaluated_image_count")
    if target or checkpoint:
        lines.append("Training target: " + ", ".join(x for x in (checkpoint, f"{target} buckets" if target else "") if x))
    if target and evaluated:
        lines.append(f"{target} bucket source coverage: {get(handoff, 'at_or_above_target_area_count')}/{evaluated} at or above {target}\u00b2 pixel area; {get(handoff, 'below_target_area_count')} below target")
    advice = (r.get("guidance") or {}).get("warnings") or []
    lines += ["Training guidance:", *(f"- {w['message']}" for w in advice)] if advice else []
    recurrence = c.get("recurrence") or {}
    recurring = recurrence.get("recurring_descriptors") or []
    lines += ["Recurring caption descriptors (trigger-bleed review):", *(f"- {x['text']}: {x['count']}/{recurrence.get('caption_count', 0)} captions ({x['fraction']:.1%})" for x in recurring[:5])] if recurring else []
    if naming.get("mode_counts"):
        lines.append(f"Naming: {_counted(naming['mode_counts'])}")
        lines += ["LoRA name: " + ", ".join(naming["lora_names"])] if naming.get("lora_names") else []
        lines += [f"Stable numbered pairs: {naming['numbered_pair_count']} (sequence {naming.get('sequence_minimum')}\u2013{naming.get('sequence_maximum')})"] if naming.get("numbered_pair_count") else []
    near = d.get("near_duplicate_groups") or []
    lines += ["Near-duplicate review groups:", *(f"- Group {i} (distance {g['minimum_distance']}): {', '.join(g['images'])}" for i, g in enumerate(near, 1))] if near else []
    warned = q.get("warning_items") or []
    return lines + (["Quality warnings:", *(f"- {w['image']}: {', '.join(w['warnings'])} (score {w['score']})" for w in warned)] if warned else [])


def _issue_lines(issue: dict) -> list[str]:
    image, source = issue.get("image") or "unknown image", issue.get("source_image") or ""
    shown = image if source in ("", image) else f"{image} (source: {source})"
    lines = [f"- [{str(issue.get('status') or 'issue').upper()}] {shown} ({issue.get('stage') or 'processing'}): {issue.get('reason') or 'No reason recorded'}"]
    if issue.get("detector_confidence_threshold") is not None:
        lines.append(f"  Verifier threshold: {issue['detector_confidence_threshold']:.1%}")
    found = issue.get("residual_detections") or []
    for x in found[:3]:
        text = f"  Detector: {x.get('label') or 'artifact'}" + (f" at {x['confidence']:.1%} confidence" if x.get("confidence") is not None else "")
        box = x.get("bbox_normalized") or ()
        lines.append(text + (f"; region x {box[0]:.1%}\u2013{box[2]:.1%}, y {box[1]:.1%}\u2013{box[3]:.1%}" if len(box) == 4 else ""))
    lines += [f"  Detector: {len(found) - 3} additional hit(s) in issues_json"] if len(found) > 3 else []
    return lines + ([f"  Review: {issue['review_directory']}"] if issue.get("review_directory") else [])


def text_summary(status: dict) -> str:
    """A run's status, its report and its issues as text."""
    get = lambda k: int(status.get(k) or 0)
    issues = status.get("issues") if isinstance(status.get("issues"), list) else []
    ready, label = bool(status.get("training_ready")), "videos" if status.get("media_type") == "videos" else "images"
    passed = lambda k: "pass" if status.get(k) else "fail"
    lines = [
        verdict(ready, get("failed") or sum(i.get("status") == "failed" for i in issues)), f"Media: {label}",
        f"Eligible pairs: {get('complete')}/{int(status.get('eligible', status.get('total', 0)) or 0)} complete",
        f"This run: {get('processed_this_run')} processed, {get('failed_this_run')} failed, {get('excluded_this_run')} excluded",
        f"Current state: {get('pending')} pending, {get('processing')} processing, {get('failed')} failed, {get('excluded')} excluded",
        f"Audits: dataset={passed('audit_valid')}, cleanup={passed('watermark_audit_complete')}, analysis={passed('analysis_audit_complete')}, crop={passed('crop_audit_complete')}",
    ]
    mode = status.get("residual_detection_mode")
    if mode == "trust_klein":
        lines.append("Watermark scan: disabled (the clean-up is trusted); image-fidelity verification remains enabled.")
    elif mode == "verify_residual_watermarks":
        lines.append("Watermark scan: enabled; image-fidelity verification remains enabled.")
    if get("inactive"):
        lines.append(f"Inactive history: {get('inactive')} source item(s); this does not block training readiness.")
    if get("cleanup_override_applied_count"):
        lines.append(f"Cleanup overrides: {get('cleanup_override_applied_count')} explicitly approved image(s); detector evidence retained.")
    if status.get("dataset_report"):
        lines += _report_lines(status["dataset_report"])
        lines += [f"Full report: {status['dataset_report_path']}"] if status.get("dataset_report_path") else []
    if issues:
        lines += ["", f"{label.title()} needing attention or excluded from training:", *(x for i in issues for x in _issue_lines(i))]
    else:
        lines += ["", f"No active {label} errors or exclusions."]
    return "\n".join(lines)


def display_lines(summary: str, columns: int = 84, most: int = 72) -> list[str]:
    """The summary wrapped to so many characters for a picture of the report; beyond `most` lines the last one says how many are left."""
    out: list[str] = []
    for line in (summary or "No dataset report was produced.").splitlines():
        now, indent = "", "  " if line.startswith("- ") else ""
        for word in line.split():
            if now and len(now) + 1 + len(word) > columns:
                out.append(now)
                now = indent + word
            else:
                now = f"{now} {word}" if now else word
        out.append(now)
    if len(out) > most:
        out = [*out[:most], f"\u2026 {len(out) - most} additional line(s) are available in dataset_report.json"]
    return out
