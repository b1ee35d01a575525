"""The item table: columns, states, and what a reset puts back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATUSES = ("pending", "processing", "complete", "failed", "excluded")
RUN_MODES = ("resume", "reprocess_failed", "force_rebuild")

_KINDS = {"string": T.StringType(), "long": T.LongType(), "boolean": T.BooleanType()}
# name, kind, default
COLUMNS = (
    ("item_id", "string", None), ("source_path", "string", None), ("source_relative_path", "string", None), ("source_hash", "string", None),
    ("source_size", "long", None), ("source_mtime_ns", "long", None), ("output_image_path", "string", None), ("caption_path", "string", None),
    ("status", "string", "pending"), ("normalization_status", "string", "not_started"), ("analysis_status", "string", "not_started"), ("analysis_json", "string", None),
    ("watermark_status", "string", "not_requested"), ("cleanup_verification_status", "string", "not_requested"), ("cleanup_verification_json", "string", None),
    ("crop_status", "string", "not_requested"), ("crop_json", "string", None), ("caption_status", "string", "not_started"), ("validation_status", "string", "not_started"),
    ("error", "string", None), ("review_status", "string", "not_requested"), ("profile_id", "string", None), ("profile_version", "string", None),
    ("caption_provider_version", "string", "phase1"), ("cleanup_provider_version", "string", "none"), ("cleanup_verifier_version", "string", "none"),
    ("analysis_provider_version", "string", "none"), ("crop_provider_version", "string", "none"), ("naming_sequence", "long", None),
    ("output_naming_mode", "string", "preserve_source_names"), ("lora_name", "string", ""), ("attempts", "long", 0), ("active", "boolean", True),
    ("created_at", "string", None), ("updated_at", "string", None), ("started_at", "string", None), ("completed_at", "string", None),
)
ITEMS = T.StructType([T.StructField(n, _KINDS[k]) for n, k, _ in COLUMNS])
#: What a changed source or a rebuild puts back to the start.
RESET = {
    "status": "pending", "normalization_status": "not_started", "analysis_status": "not_started", "analysis_json": None, "watermark_status": "not_requested",
    "cleanup_verification_status": "not_requested", "cleanup_verification_json": None, "review_status": "not_requested", "crop_status": "not_requested", "crop_json": None,
    "caption_status": "not_started", "validation_status": "not_started", "error": None, "started_at": None, "completed_at": None,
}
VERSIONS = ("profile_id", "profile_version", "caption_provider_version", "cleanup_provider_version", "cleanup_verifier_version", "analysis_provider_version", "crop_provider_version")


def migrated(items: DataFrame) -> DataFrame:
    """items with every column of the schema, in its order and type; late columns get their defaults. Doing it twice changes nothing."""
    have = set(items.columns)
    return items.select(*((F.col(n) if n in have else F.lit(d)).cast(_KINDS[k]).alias(n) for n, k, d in COLUMNS))
