"""Transitions of the item table, each a function from DataFrame to DataFrame. Persisting a state writes a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.functions.text import casefold
from sievecraft.plans.ranking import global_rank
from sievecraft.plans.schema import RESET, RUN_MODES, STATUSES, VERSIONS


def _set(items: DataFrame, condition: Column, values: dict) -> DataFrame:
    """items with the values put where the condition, judged on the old row, holds."""
    known = {c: v for c, v in values.items() if c in items.columns}
    return items.select(*(F.when(condition, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(items.schema[c].dataType).alias(c) if (v := known.get(c, items)) is not items else F.col(c) for c in items.columns))


def source_order() -> list[Column]:
    return [casefold(F.col("source_relative_path")), F.col("item_id")]


def sync(items: DataFrame, source: DataFrame, versions: dict, preserve: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Reconciles items with a full listing of the source.

    source: item_id, source_path, source_relative_path, source_hash, source_size, source_mtime_ns, output_image_path, caption_path, naming_sequence. Items that are not
    listed become inactive. A listed item is reset if its content changed, or if an output path did and preserve (item_id) does not name it; then it takes the
    versions given, otherwise it keeps its own, so that a new configuration leaves finished work alone. created_at and attempts survive.
    """
    now = F.lit(None).cast("string") if now is None else now
    s = source.select(*(F.col(c).alias(f"s_{c}") for c in source.columns))
    joined = items.join(s, items["item_id"] == s["s_item_id"], "full_outer")
    if preserve is not None:
        joined = joined.join(preserve.select(F.col("item_id").alias("p_id")).distinct(), F.col("s_item_id") == F.col("p_id"), "left")
    kept_mapping = F.col("p_id").isNotNull() if preserve is not None else F.lit(False)
    new, listed = F.col("item_id").isNull(), F.col("s_item_id").isNotNull()
    moved = ~(F.col("output_image_path").eqNullSafe(F.col("s_output_image_path")) & F.col("caption_path").eqNullSafe(F.col("s_caption_path")))
    changed = listed & ~new & (~F.col("source_hash").eqNullSafe(F.col("s_source_hash")) | (~kept_mapping & moved))
    fresh = new | changed
    out = []
    for c in items.columns:
        old = F.col(c)
        if c == "item_id":
            v = F.coalesce(F.col("s_item_id"), old)
        elif c == "active":
            v = listed
        elif c in ("created_at",):
            v = F.when(new, now).otherwise(old)
        elif c == "updated_at":
            v = F.when(listed, now).otherwise(old)
        elif c == "attempts":
            v = F.when(new, F.lit(0)).otherwise(old)
        elif c == "naming_sequence":
            v = F.coalesce(F.col("s_naming_sequence"), old)
        elif c in VERSIONS:
            v = F.when(listed if c == "profile_id" else fresh, F.lit(versions.get(c))).otherwise(old)
        elif c in ("output_naming_mode", "lora_name"):
            v = F.when(listed, F.lit(versions.get(c, "preserve_source_names" if c == "output_naming_mode" else ""))).otherwise(old)
        elif f"s_{c}" in s.columns:
            v = F.when(listed, F.col(f"s_{c}")).otherwise(old)
        elif c in RESET:
            v = F.when(fresh, F.lit(RESET[c])).otherwise(old)
        else:
            v = old
        out.append(v.cast(items.schema[c].dataType).alias(c))
    return joined.select(*out)


def naming_sequences(items: DataFrame, source: DataFrame) -> DataFrame:
    """item_id, naming_sequence of the source's items: kept where there is one, else counted on from the largest number of all items in order of path."""
    known = items.select(F.col("item_id").alias("k_id"), F.col("naming_sequence").alias("k_seq"))
    rows = source.select("item_id", "source_relative_path").join(known, F.col("item_id") == F.col("k_id"), "left").select("item_id", "source_relative_path", "k_seq")
    top = items.agg(F.coalesce(F.max("naming_sequence"), F.lit(0))).first()[0]
    fresh = global_rank(rows.where("k_seq is null").select("item_id", "source_relative_path"), source_order())
    return rows.where("k_seq is not null").select("item_id", F.col("k_seq").cast("long").alias("naming_sequence")).union(fresh.select("item_id", (F.col("rank") + top).cast("long")))


def update_pending_versions(items: DataFrame, versions: dict, now: Column | None = None) -> DataFrame:
    stamp = {} if now is None else {"updated_at": now}
    return _set(items, F.col("active") & (F.col("status") == "pending"), {k: versions[k] for k in VERSIONS if k in versions} | stamp)


def prepare_run(items: DataFrame, mode: str, revision: int = 0, previous_revision: int | None = None) -> tuple[DataFrame, int | None]:
    """The items at a run's start and the rebuild revision to store.

    Interrupted items return to pending in any mode. reprocess_failed also resets failed items and those excluded by clean-up; force_rebuild resets every active item,
    once for each revision above 0.
    """
    if mode not in RUN_MODES:
        raise ValueError(f"Unknown run mode: {mode}")
    if mode == "force_rebuild" and revision <= 0:
        raise ValueError("force_rebuild needs a revision above 0; raise it only for a new rebuild")
    active = F.col("active")
    items = _set(items, active & (F.col("status") == "processing"), {"status": "pending", "error": "Interrupted before completion", "started_at": None})
    if mode == "reprocess_failed":
        again = (F.col("status") == "failed") | ((F.col("status") == "excluded") & (F.col("review_status") == "cleanup_excluded"))
        return _set(items, active & again, RESET), previous_revision
    if mode == "force_rebuild" and previous_revision != revision:
        return _set(items, active, RESET), revision
    return items, previous_revision


def missing_outputs(items: DataFrame, listing: DataFrame) -> DataFrame:
    """item_id of active complete items that lack a file; listing has path."""
    done = items.where(F.col("active") & (F.col("status") == "complete")).select("item_id", F.explode(F.array("output_image_path", "caption_path")).alias("path"))
    return done.join(listing.select("path"), "path", "left_anti").select("item_id").distinct()


def reset_missing_outputs(items: DataFrame, listing: DataFrame) -> DataFrame:
    gone = missing_outputs(items, listing).select(F.col("item_id").alias("gone_id"))
    joined = items.join(gone, items["item_id"] == gone["gone_id"], "left")
    return _set(joined, F.col("gone_id").isNotNull(), {"status": "pending", "validation_status": "not_started", "error": "Completed output was missing", "completed_at": None}).drop("gone_id")


def claim_next(items: DataFrame, n: int | None = 1) -> DataFrame:
    """The next n pending items, as they are while processed; with None all of them, unsorted. Paths compare without regard to ASCII case."""
    first = items.where(F.col("active") & (F.col("status") == "pending"))
    if n is not None:
        first = first.orderBy(F.lower("source_relative_path"), "item_id").limit(n)
    return _set(first, F.lit(True), {"status": "processing", "attempts": F.col("attempts") + 1, "error": None})


def apply_results(items: DataFrame, results: DataFrame) -> DataFrame:
    """Puts the non-null columns of results, one row per item_id, into items."""
    r = results.select(*(F.col(c).alias(f"r_{c}") for c in results.columns))
    joined = items.join(r, items["item_id"] == r["r_item_id"], "left")
    return joined.select(*(F.coalesce(F.col(f"r_{c}"), F.col(c)).alias(c) if f"r_{c}" in r.columns and c != "item_id" else F.col(c) for c in items.columns))


def mark_complete(items: DataFrame, ids: DataFrame, caption_status: str = "written") -> DataFrame:
    return _mark(items, ids, {"status": "complete", "normalization_status": "converted_png", "caption_status": caption_status, "validation_status": "valid", "error": None})


def mark_failed(items: DataFrame, ids: DataFrame, error: str) -> DataFrame:
    return _mark(items, ids, {"status": "failed", "validation_status": "error", "error": error})


def mark_watermark(items: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    return _mark(items, ids, {"watermark_status": status})


def mark_verification(items: DataFrame, ids: DataFrame, status: str, payload: str, review_status: str) -> DataFrame:
    return _mark(items, ids, {"cleanup_verification_status": status, "cleanup_verification_json": payload, "review_status": review_status})


def mark_analysis(items: DataFrame, ids: DataFrame, status: str, payload: str) -> DataFrame:
    return _mark(items, ids, {"analysis_status": status, "analysis_json": payload})


def mark_crop(items: DataFrame, ids: DataFrame, status: str, payload: str) -> DataFrame:
    return _mark(items, ids, {"crop_status": status, "crop_json": payload})


def mark_excluded(items: DataFrame, ids: DataFrame, reason: str, review_status: str = "cleanup_excluded") -> DataFrame:
    return _mark(items, ids, {"status": "excluded", "validation_status": "excluded", "review_status": review_status, "error": reason})


def reinstate_exact_duplicate(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Only items that were excluded as exact duplicates go back to pending."""
    return _mark(items, ids, {"status": "pending", "review_status": "not_requested", "validation_status": "not_started", "error": None}, (F.col("status") == "excluded") & (F.col("review_status") == "exact_duplicate_excluded"))


def _mark(items: DataFrame, ids: DataFrame, values: dict, guard: Column | None = None) -> DataFrame:
    named = ids.select(F.col("item_id").alias("m_id")).distinct()
    joined = items.join(named, items["item_id"] == named["m_id"], "left")
    condition = F.col("m_id").isNotNull() if guard is None else F.col("m_id").isNotNull() & guard
    return _set(joined, condition, values).drop("m_id")


def summary(items: DataFrame) -> DataFrame:
    """One row: total, a count per status, eligible (not excluded) of active items, and inactive."""
    active = F.col("active")
    counts = [F.count_if(active & (F.col("status") == s)).alias(s) for s in STATUSES]
    return items.agg(F.count_if(active).alias("total"), *counts, F.count_if(active & (F.col("status") != "excluded")).alias("eligible"), F.count_if(~active).alias("inactive"))


def upsert_metadata(metadata: DataFrame, changes: DataFrame) -> DataFrame:
    """key, value, updated_at with the changes' rows in place of those of the same key."""
    return metadata.join(changes.select("key"), "key", "left_anti").unionByName(changes)
