"""Boxes, aspect ratios, crop decisions and video dimensions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import casefold, first_match, let


def orientation(width: Column, height: Column) -> Column:
    return F.when(width == height, "square").when(width > height, "landscape").otherwise("portrait")


def video_orientation(width: Column, height: Column) -> Column:
    """A square video counts as landscape."""
    return F.when(width >= height, "landscape").otherwise("portrait")


def even_dimension(value: Column) -> Column:
    return F.greatest(F.lit(2), (F.floor(value) / 2).cast("int") * 2)


def normalized_box(box: Column, width: Column, height: Column) -> Column:
    """bbox in pixels and as fractions, clamped to the image; right and bottom are never before left and top."""
    clamp = lambda v, low, high: F.least(F.greatest(v, low), high)
    zero = F.lit(0.0)
    w, h = width.cast("double"), height.cast("double")
    left, top = clamp(F.get(box, F.lit(0)), zero, w), clamp(F.get(box, F.lit(1)), zero, h)
    right, bottom = clamp(F.get(box, F.lit(2)), left, w), clamp(F.get(box, F.lit(3)), top, h)
    return F.struct(
        F.array(*(F.round(v, 3) for v in (left, top, right, bottom))).alias("bbox"),
        F.array(*(F.round(v / s, 6) for v, s in ((left, w), (top, h), (right, w), (bottom, h)))).alias("bbox_normalized"),
    )


def union_box(boxes: Column) -> Column:
    """left, top, right, bottom of all boxes; null without one."""
    side = lambda pick, i: pick(F.transform(boxes, lambda b: F.get(b, F.lit(i))))
    return F.when(F.size(boxes) > 0, F.array(side(F.array_min, 0), side(F.array_min, 1), side(F.array_max, 2), side(F.array_max, 3)))


def expanded_union(boxes: Column, width: Column, height: Column, padding: float) -> Column:
    u = union_box(boxes)
    at = lambda i: F.get(u, F.lit(i))
    w, h = width.cast("double"), height.cast("double")
    return F.when(u.isNotNull(), F.array(F.greatest(F.lit(0.0), at(0) - w * padding), F.greatest(F.lit(0.0), at(1) - h * padding), F.least(w, at(2) + w * padding), F.least(h, at(3) + h * padding)))


def ratio_of(label: str) -> float:
    a, b = label.split(":", 1)
    ratio = float(a) / float(b)
    if ratio <= 0:
        raise ValueError(f"Invalid aspect ratio: {label}")
    return ratio


def protected_detections(subjects: Column, faces: Column, strategy: str) -> Column:
    if strategy == "identity_preserving":
        return F.concat(F.filter(subjects, lambda d: casefold(d["label"]) == "person"), faces)
    if strategy == "semantic":
        return F.concat(subjects, faces)
    return F.slice(faces, F.lit(1), F.lit(0))


def crop_decision(width: Column, height: Column, boxes: Column, settings: dict, minimum_dimension: int = 512) -> Column:
    """status, target_aspect, crop_box, output_dimensions, removed_area_fraction for an image and its protected boxes.

    Unless the nearest allowed aspect is close enough already, each aspect's largest window is a candidate if it removes little enough, stays large
    enough and can hold the protected area; the one that removes least wins, and of equals the aspect listed first.
    """
    strategy = settings.get("crop_strategy", "composition_preserving")
    labels = settings.get("allowed_aspect_ratios", ["1:1"])
    ratios = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(label).alias("label"), F.lit(ratio_of(label)).alias("r")) for i, label in enumerate(labels)))
    most, tolerance = settings.get("crop_max_removed_fraction", 0.18), settings.get("crop_aspect_tolerance", 0.035)
    given = F.struct(
        width.cast("int").alias("width"), height.cast("int").alias("height"), width.cast("double").alias("w"), height.cast("double").alias("h"), (width / height).alias("current"),
        expanded_union(boxes, width, height, settings.get("crop_subject_padding_fraction", 0.06)).alias("guarded"), (F.size(boxes) == 0).alias("unguarded"),
    )

    def place(size: Column, full: Column, low: Column, high: Column) -> Column:
        kept = F.least(F.greatest((low + high) / 2 - size / 2, F.greatest(F.lit(0.0), high - size)), F.least(low, full - size))
        return F.when(low.isNull(), (full - size) / 2).otherwise(kept)

    def candidate(c: Column):
        g = lambda k: F.get(c["guarded"], F.lit(k))
        size = lambda q: F.struct(q["i"].alias("i"), q["label"].alias("label"), F.when(c["current"] > q["r"], c["h"] * q["r"]).otherwise(c["w"]).alias("cw"), F.when(c["current"] > q["r"], c["h"]).otherwise(c["w"] / q["r"]).alias("ch"))

        def window(z: Column) -> Column:
            removed = 1.0 - z["cw"] * z["ch"] / (c["w"] * c["h"])
            fits = c["guarded"].isNull() | ((g(2) - g(0) <= z["cw"]) & (g(3) - g(1) <= z["ch"]))
            ok = (removed <= most) & (F.least(z["cw"], z["ch"]) >= minimum_dimension) & fits
            left, top = place(z["cw"], c["w"], g(0), g(2)), place(z["ch"], c["h"], g(1), g(3))
            return F.when(ok, F.struct(removed.alias("removed"), z["i"].alias("i"), z["label"].alias("label"), left.alias("l"), top.alias("t"), z["cw"].alias("cw"), z["ch"].alias("ch")))

        return lambda q: let(size(q), window)

    def decide(c: Column) -> Column:
        nearest = F.array_min(F.transform(ratios, lambda q: F.struct(F.abs(q["r"] - c["current"]).alias("d"), q["i"].alias("i"), q["r"].alias("r"), q["label"].alias("label"))))
        best = F.array_min(F.filter(F.transform(ratios, candidate(c)), lambda x: x.isNotNull()))
        return let(F.struct(nearest.alias("near"), best.alias("best")), lambda x: outcome(c, x["near"], x["best"]))

    def outcome(c: Column, near: Column, best: Column) -> Column:
        whole = lambda v: F.bround(v).cast("int")
        clamp = lambda v, low, high: F.greatest(low, F.least(v, high))
        status = F.coalesce(
            first_match([(F.abs(near["r"] - c["current"]) / near["r"] <= tolerance, "not_needed_allowed_aspect"), (F.lit(strategy in ("identity_preserving", "semantic")) & c["unguarded"], "skipped_no_protected_subjects"), (best.isNull(), "skipped_crop_safety_limits")]),
            F.lit(f"cropped_{strategy}"),
        )
        left, top = clamp(whole(best["l"]), F.lit(0), c["width"] - 1), clamp(whole(best["t"]), F.lit(0), c["height"] - 1)
        box = let(F.struct(left.alias("l"), top.alias("t")), lambda k: F.array(k["l"], k["t"], clamp(whole(best["l"] + best["cw"]), k["l"] + 1, c["width"]), clamp(whole(best["t"] + best["ch"]), k["t"] + 1, c["height"])))
        return let(F.struct(status.alias("status"), F.when(best.isNotNull(), box).alias("box")), lambda k: F.struct(
            k["status"].alias("status"),
            F.when(k["status"] == "not_needed_allowed_aspect", near["label"]).when(k["status"] == f"cropped_{strategy}", best["label"]).alias("target_aspect"),
            F.when(k["status"] == "not_needed_allowed_aspect", F.array(F.lit(0), F.lit(0), c["width"], c["height"])).when(k["status"] == f"cropped_{strategy}", k["box"]).alias("crop_box"),
            F.when(k["status"] == f"cropped_{strategy}", F.array(F.get(k["box"], F.lit(2)) - F.get(k["box"], F.lit(0)), F.get(k["box"], F.lit(3)) - F.get(k["box"], F.lit(1)))).otherwise(F.array(c["width"], c["height"])).alias("output_dimensions"),
            F.when(k["status"] == "not_needed_allowed_aspect", F.lit(0.0)).when(k["status"] == f"cropped_{strategy}", F.round(best["removed"], 6)).alias("removed_area_fraction"),
        ))

    return let(given, decide)


def scaled_to_budget(width: Column, height: Column, megapixels: float, mode: str) -> Column:
    """Width and height within a pixel budget. mode: 'truncate', 'round' (to even on ties) or 'even' (down to even numbers, 2 at least)."""
    scale = F.least(F.lit(1.0), F.sqrt(F.lit(megapixels * 1e6) / F.greatest(F.lit(1), width * height)))
    fit = {"truncate": lambda v: F.greatest(F.lit(1), F.floor(v * scale).cast("int")), "round": lambda v: F.greatest(F.lit(1), F.bround(v * scale).cast("int")), "even": lambda v: even_dimension(v * scale)}[mode]
    within = (lambda v: F.when(width * height <= megapixels * 1e6, v.cast("int")).otherwise(fit(v))) if mode != "even" else fit
    return F.struct(within(width).alias("width"), within(height).alias("height"))


def target_dimensions(config: dict, width: Column, height: Column) -> Column:
    """Of a normalised video configuration; null when native dimensions are kept."""
    if config["resize_mode"] == "keep_native":
        return F.lit(None).cast("struct<width:int,height:int>")
    if config["size_strategy"] == "normalize_by_orientation":
        pick = lambda side: F.when(width >= height, config[f"landscape_{side}"]).otherwise(config[f"portrait_{side}"])
        return F.struct(pick("width").alias("width"), pick("height").alias("height"))
    return F.struct(F.lit(config["width"]).alias("width"), F.lit(config["height"]).alias("height"))


# X and y of the crop for each anchor.
_X, _Y = {"left": "0", "center": "(iw-ow)/2", "right": "iw-ow"}, {"top": "0", "center": "(ih-oh)/2", "bottom": "ih-oh"}


def crop_offsets(anchor: str) -> tuple[str, str]:
    parts = set(anchor.split("_"))
    x = next((v for k, v in _X.items() if k in parts and k != "center"), _X["center"])
    y = next((v for k, v in _Y.items() if k in parts and k != "center"), _Y["center"])
    return x, y


def filter_chain(config: dict, width: Column, height: Column) -> Column:
    """The encoder's filter string for one source."""
    d, mode = target_dimensions(config, width, height), config["resize_mode"]
    size = F.concat_ws(":", d["width"].cast("string"), d["height"].cast("string"))
    chain = [F.lit(f"fps={config['fps']:g}")]
    if mode == "keep_native":
        chain.append(F.lit("pad=ceil(iw/2)*2:ceil(ih/2)*2:0:0:color=black"))
    elif mode == "crop_to_fill":
        x, y = crop_offsets(config["crop_position"])
        chain += [F.concat(F.lit("scale="), size, F.lit(":force_original_aspect_ratio=increase:flags=lanczos")), F.concat(F.lit("crop="), size, F.lit(f":{x}:{y}"))]
    elif mode == "pad_to_fit":
        chain += [F.concat(F.lit("scale="), size, F.lit(":force_original_aspect_ratio=decrease:force_divisible_by=2:flags=lanczos")), F.concat(F.lit("pad="), size, F.lit(":(ow-iw)/2:(oh-ih)/2:color=black"))]
    elif mode == "fit_within":
        chain.append(F.concat(F.lit("scale="), size, F.lit(":force_original_aspect_ratio=decrease:force_divisible_by=2:flags=lanczos")))
    else:
        chain.append(F.concat(F.lit("scale="), size, F.lit(":flags=lanczos")))
    if config["target_frame_count"] > 0:
        chain.append(F.lit(f"tpad=stop_mode=clone:stop_duration={config['target_frame_count'] / config['fps']:g}"))
    elif config["pad_short_video"]:
        chain.append(F.lit(f"tpad=stop_mode=clone:stop_duration={config['duration']:g}"))
    return F.concat_ws(",", *chain)


def frame_timestamps(duration: Column, fps: Column, frames: Column, count: int = 8) -> Column:
    """Evenly spaced times from 0 to the last frame; 2 to 32 of them, no more than there are frames."""
    n = F.lit(min(32, max(2, count)))
    n = F.when(frames > 0, F.least(n, frames.cast("int"))).otherwise(n)
    last = F.greatest(F.lit(0.0), F.greatest(F.lit(0.001), duration) - 1.0 / F.greatest(fps, F.lit(1.0)))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: last * i / F.greatest(F.lit(1), n - 1))


def fidelity_decision(ssim: Column, corr: Column, mae: Column, changed: Column, aspect: Column, residual: Column, limits: dict | None = None) -> Column:
    """status, failures, observations. Low structure or a large mean change is only observed where the luminance is correlated."""
    limit = {"ssim": 0.72, "mae": 0.12, "changed": 0.20, "aspect": 0.02, "corr": 0.90} | (limits or {})
    tonal = corr >= limit["corr"]
    low, far = ssim < limit["ssim"], mae > limit["mae"]
    some = lambda *rules: F.array_compact(F.array(*(F.when(c, F.lit(code)) for c, code in rules)))
    failures = some(
        (low & ~tonal, "structural_similarity_below_limit"), (far & ~tonal, "mean_absolute_difference_above_limit"),
        (changed > limit["changed"], "changed_area_fraction_above_limit"), (aspect > limit["aspect"], "aspect_ratio_changed"),
    )
    observations = some((low & tonal, "low_structural_similarity_tolerated_by_luminance_correlation"), (far & tonal, "mean_absolute_difference_tolerated_as_global_tonal_change"))
    bad = F.size(failures) > 0
    status = F.when(residual & bad, "residual_artifact_and_excessive_change").when(residual, "residual_artifact").when(bad, "excessive_change").otherwise("verified_clean")
    return F.struct(status.alias("status"), failures.alias("failures"), observations.alias("observations"))
