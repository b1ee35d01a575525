"""Item tables derived from the driver's tables by integer arithmetic, so that Spark and SQL agree on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SPARK = {"sha": "sha2({}, 256)", "div": "{} div {}", "json": "cast({} as string)"}
_DUCK = {"sha": "sha256({})", "div": "{} // {}", "json": "cast({} as varchar)"}


def _columns(d: dict) -> dict[str, str]:
    sha, div = (lambda x: d["sha"].format(x)), (lambda a, b: "(" + d["div"].format(a, b) + ")")
    num = lambda x: f"cast({x} as varchar(20))"
    text = "coalesce(text, '')"
    stem = f"concat(CASE WHEN doc_id % 4 = 0 THEN 'IMG' ELSE 'img' END, '_', cast({div('doc_id', 3)} as varchar(20)))"
    rel = f"concat(CASE WHEN doc_id % 5 = 0 THEN upper(coalesce(source, 'none')) ELSE coalesce(source, 'none') END, '/', cast(doc_id % 3 as varchar(20)), '/', {stem}, CASE WHEN doc_id % 19 = 0 THEN '.mp4' ELSE '.png' END)"
    pick = lambda n, *v: "CASE " + " ".join(f"WHEN doc_id % {n} = {i} THEN '{x}'" for i, x in enumerate(v[:-1])) + f" ELSE '{v[-1]}' END"
    return {
        "doc_id": "doc_id",
        "item_id": f"substring({sha(f'replace(lower({rel}), chr(223), chr(115) || chr(115))')}, 1, 24)",
        "source_relative_path": rel,
        "source_hash": sha(text),
        "caption": text,
        "output_image_path": f"concat('dataset/', {stem}, '_', cast(doc_id % 3 as varchar(20)), CASE WHEN doc_id % 19 = 0 THEN '.mp4' ELSE '.png' END)",
        "caption_path": f"concat('dataset/', {stem}, '_', cast(doc_id % 3 as varchar(20)), '.txt')",
        "status": pick(10, "complete", "complete", "complete", "complete", "complete", "complete", "pending", "processing", "failed", "excluded"),
        "review_status": "CASE WHEN doc_id % 10 = 9 THEN CASE WHEN doc_id % 30 = 9 THEN 'exact_duplicate_excluded' WHEN doc_id % 30 = 19 THEN 'cleanup_excluded' ELSE 'orientation_filtered' END WHEN doc_id % 23 = 0 THEN 'cleanup_review_required' ELSE 'not_requested' END",
        "watermark_status": pick(7, "not_requested", "cleanup_failed", "verified_clean", "verified_clean", "cleaned_universal", "skipped_video", "verified_clean"),
        "cleanup_verification_status": pick(11, "residual_artifact", "excessive_change", "not_requested", "verified_clean", "not_requested", "skipped_video", "verified_clean", "not_requested", "not_requested", "not_requested", "verified_clean"),
        "analysis_status": pick(6, "analysis_failed", "analyzed_basic", "analyzed_basic", "not_started", "analyzed_ultralytics", "skipped_video"),
        "crop_status": pick(8, "crop_failed", "not_requested", "cropped_semantic", "not_needed_allowed_aspect", "skipped_crop_safety_limits", "prepared_ffmpeg", "cropped_semantic", "not_requested"),
        "cleanup_verifier_version": pick(3, "none", "v7", "none"),
        "crop_provider_version": pick(5, "none", "c1", "c1", "c1", "c1"),
        "profile_version": pick(6, "old", "now", "now", "now", "now", "now"),
        "output_naming_mode": pick(2, "preserve_source_names", "lora_name_numbered"),
        "error": "CASE WHEN doc_id % 10 = 8 THEN concat('failed at ', cast(doc_id as varchar(20))) END",
        "naming_sequence": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id * 2 + 1 END",
        "attempts": "doc_id % 4",
        "active": "doc_id % 17 <> 0",
        "is_video": "doc_id % 19 = 0",
        "width": "cast(256 + doc_id * 37 % 1800 as int)",
        "height": "cast(256 + doc_id * 53 % 1500 as int)",
        "media_exists": "doc_id % 29 <> 0",
        "caption_exists": "doc_id % 31 <> 0",
        "brightness_mean": "CASE WHEN doc_id % 12 = 0 THEN NULL ELSE cast(doc_id * 7 % 256 as double) END",
        "contrast_stddev": "cast(doc_id * 11 % 80 as double)",
        "edge_sharpness": "cast(doc_id * 13 % 60 as double) / 10",
        "removed_area_fraction": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE cast(doc_id * 3 % 40 as double) / 100 END",
        "analysis_json": f"CASE WHEN doc_id % 25 = 0 THEN 'no json' WHEN doc_id % 25 = 1 THEN NULL ELSE concat('{{\"counts\": {{\"faces\": ', {num('doc_id % 5 % 3')}, ', \"persons\": ', {num('doc_id % 4')}, ', \"objects\": 1}}}}') END",
        "cleanup_verification_json": "CASE WHEN doc_id % 9 = 0 THEN '{\"status\": \"verified_clean_override\", \"override_applied\": true}' WHEN doc_id % 9 = 1 THEN 'no json' WHEN doc_id % 9 = 2 THEN '{\"override_applied\": false}' END",
        "lora_name": pick(3, "Zoe", "anna", ""),
        "faces": "doc_id % 5 % 3",
        "persons": "doc_id % 4",
    }


#: The same table as a common table expression for SQL.
ITEMS_SQL = "items AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _columns(_DUCK).items()) + " FROM documents)"

#: Every text with a name: documents and the turns of conversations.
CAPTIONS_SQL = "captions AS (SELECT concat('d', cast(doc_id as varchar)) AS image, coalesce(text, '') AS caption FROM documents UNION ALL SELECT concat('c', cast(conv_id as varchar), '-', cast(turn as varchar)) AS image, coalesce(text, '') AS caption FROM conversations)"

#: case folding: lower case, sharp s and final sigma.
CF = "replace(replace(lower({}), 'ß', 'ss'), 'ς', 'σ')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*(f"{e} AS {n}" for n, e in _columns(_SPARK).items()))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("concat('d', cast(doc_id as string)) as image", "coalesce(text, '') as caption")
    return docs.union(table(spark, sf_dir, "conversations").selectExpr("concat('c', cast(conv_id as string), '-', cast(turn as string))", "coalesce(text, '')"))
