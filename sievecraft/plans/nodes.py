"""The configuration surface: one table of settings for each kind of configuration, one reader for all, and what is run with them.

Configuring functions return the configuration and its version; bad values raise ValueError.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from sievecraft.functions.hashing import config_version
from sievecraft.operators.http_caption import BASE_URLS, KEYS, SECRETS
from sievecraft.operators.providers import MINIMUM_CONFIDENCE, residual_mode
from sievecraft.sources import files, stores
from sievecraft.sources.probe import video_config

from .engine import CurationRun
from .profiles import ProfileRegistry
from .report import text_summary
from .report_picture import render_summary


@dataclass(frozen=True)
class Setting:
    name: str
    kind: type = str
    default: object = ""
    low: float | None = None
    high: float | None = None
    choices: tuple = ()
    needed: bool = False

    def read(self, values: dict):
        raw = values.get(self.name)
        value = self.default if raw is None else self.kind(raw)
        if self.kind is str:
            value = str(value).strip()
            if self.needed and not value:
                raise ValueError(f"{self.name} is required")
        if self.choices and value not in self.choices:
            raise ValueError(f"Unknown {self.name}: {value}")
        if self.low is not None:
            value = max(self.kind(self.low), value)
        return value if self.high is None else min(self.kind(self.high), value)


_SEED = Setting("seed", int, 0, 0, 0xFFFFFFFFFFFFFFFF)
_DETECTOR = (Setting("confidence", float, 0.3, 0.05, 0.95), Setting("image_size", int, 640, 320, 1280), Setting("device", str, "cpu"))
# Every setting with its kind, default and bounds.
CLEANUP_PROMPT = "Remove every visible watermark, logo, signature, username, URL, timestamp, stock-photo mark, caption, sticker, interface element, and overlaid text. Reconstruct only the pixels hidden by those additions using the surrounding image context. Preserve everything else exactly: subject identity, facial features, anatomy, pose, expression, clothing, objects, background, composition, crop, perspective, lighting, color, texture, sharpness, and visual style. Do not add, beautify, restyle, reframe, or alter any other content. If no removable overlay is present, keep the image visually unchanged."
SETTINGS = {
    "caption_provider": (
        Setting("backend", str, "Ollama", choices=tuple(BASE_URLS)), Setting("api_url"), Setting("api_key"), *(Setting(k) for k in KEYS.values()), Setting("model_name", str, "llama3.2-vision", needed=True),
        Setting("max_tokens", int, 512, 64, 4096), _SEED, Setting("timeout", int, 120, 10, 600),
    ),
    "image_analyzer": (Setting("subject_model", str, "bbox/yolov8s.pt"), Setting("face_model", str, "bbox/face_yolov8n.pt"), *_DETECTOR),
    "smart_crop": (Setting("minimum_output_dimension", int, 512, 64, 4096),),
    "cleanup": (
        Setting("diffusion_model", str, "flux-2-klein-9b.safetensors", needed=True), Setting("text_encoder", str, "qwen_3_8b_fp8mixed.safetensors", needed=True), Setting("vae", str, "flux2-vae.safetensors", needed=True),
        Setting("prompt", str, CLEANUP_PROMPT, needed=True), Setting("steps", int, 4, 1, 50), _SEED, Setting("megapixels", float, 1.0, 0.25, 4.0), Setting("weight_dtype", str, "default"),
    ),
    "cleanup_verifier": (
        Setting("watermark_model", str, "bbox/watermark.pt"), Setting("confidence", float, MINIMUM_CONFIDENCE, MINIMUM_CONFIDENCE, 0.95), *_DETECTOR[1:], Setting("minimum_structural_similarity", float, 0.72, 0.0, 1.0),
        Setting("maximum_mean_absolute_difference", float, 0.12, 0.01, 1.0), Setting("maximum_changed_area_fraction", float, 0.20, 0.01, 1.0), Setting("pixel_change_threshold", float, 0.30, 0.05, 1.0),
        Setting("maximum_aspect_ratio_delta", float, 0.02, 0.0, 0.5), Setting("residual_detection_mode", str, "trust_klein"),
    ),
}
PROVIDERS = {"caption_provider": "openai_compatible", "image_analyzer": "ultralytics", "smart_crop": "profile_safe_crop", "cleanup": "klein9b_universal_cleanup", "cleanup_verifier": "ultralytics_cleanup_verifier"}
NAMING_MODES = ("preserve_source_names", "lora_name_numbered")
#: Where the front end's defaults for clips differ from those of the configuration.
VIDEO_DEFAULTS = {"resize_mode": "crop_to_fill", "keep_audio": True, "target_frame_count": 107, "size_strategy": "normalize_by_orientation", "transcribe_audio": True}


def _configured(node: str, values: dict) -> tuple[dict, str]:
    known = {s.name for s in SETTINGS[node]}
    if set(values) - known:
        raise ValueError(f"Unknown settings: {', '.join(sorted(set(values) - known))}")
    config = {s.name: s.read(values) for s in SETTINGS[node]} | {"provider": PROVIDERS[node], "schema_version": 1}
    return config, config_version(config, SECRETS)


def profile(training_model: str, dataset_type: str, trigger: str = "", additional_instructions: str = "", advanced_overrides: str = "{}") -> dict:
    overrides = json.loads(advanced_overrides or "{}")
    if not isinstance(overrides, dict):
        raise ValueError("advanced_overrides must be a JSON object")
    if additional_instructions.strip():
        overrides = overrides | {"additional_caption_instructions": additional_instructions.strip()}
    return ProfileRegistry().recipe(training_model, dataset_type, trigger, overrides)


def source(source_directory: str, recursive: bool = True, media_type: str = "images", spark=None) -> dict:
    """The source; with a session also `discovered`, the number of supported files in it."""
    if not source_directory.strip():
        raise ValueError("A source directory is required")
    out = {"source_directory": stores.normalized_path(source_directory), "recursive": bool(recursive), "media_type": "videos" if media_type in ("video", "videos") else "images"}
    if spark is not None:
        suffixes = files.VIDEO_SUFFIXES if out["media_type"] == "videos" else files.image_suffixes()
        out["discovered"] = files.discover(spark, out["source_directory"], out["recursive"], suffixes=suffixes).select("item_id").count()
    return out


def caption_provider(**values) -> tuple[dict, str]:
    config, _ = _configured("caption_provider", values)
    config["api_url"] = config["api_url"] or BASE_URLS[config["backend"]]
    return config, config_version(config, SECRETS)


def image_analyzer(**values) -> tuple[dict, str]:
    return _configured("image_analyzer", values)


def smart_crop(**values) -> tuple[dict, str]:
    return _configured("smart_crop", values)


def cleanup(**values) -> tuple[dict, str]:
    return _configured("cleanup", values)


def cleanup_verifier(**values) -> tuple[dict, str]:
    values = values | {"residual_detection_mode": residual_mode(values.get("residual_detection_mode"))}
    return _configured("cleanup_verifier", values)


def video_prep(**values) -> tuple[dict, str]:
    """A front end fills frames to their size, keeps sound, cuts to 107 frames, sizes by orientation and transcribes, unless told otherwise."""
    config = video_config(VIDEO_DEFAULTS | values)
    return config, config_version(config, ascii_only=True)


def builder(
    spark, source: dict, profile: dict, destination_directory: str, run_mode: str = "resume", force_rebuild_revision: int = 0, output_naming_mode: str = "preserve_source_names", name: str = "",
    caption_provider: dict | None = None, cleanup_provider: dict | None = None, cleanup_verifier: dict | None = None, analysis_provider: dict | None = None, crop_provider: dict | None = None,
    video_prep: dict | None = None, cleanup_override_images: str = "", progress=None, max_items: int = 0, **options,
) -> tuple[str, str]:
    """Runs the whole data set; returns the status as JSON and the folder of the item table. options go to CurationRun as they are."""
    if output_naming_mode not in NAMING_MODES:
        raise ValueError(f"Unknown output naming mode: {output_naming_mode}")
    if output_naming_mode == "lora_name_numbered" and not name.strip():
        raise ValueError("Numbered output needs a name")
    run = CurationRun(
        spark, source["source_directory"], destination_directory, profile, source.get("recursive", True), name.strip() if output_naming_mode == "lora_name_numbered" else "", caption_provider, cleanup_provider,
        cleanup_verifier, analysis_provider, crop_provider, source.get("media_type", "images"), video_prep, override_lines=cleanup_override_images.splitlines(), progress=progress, **options,
    )
    try:
        status = run.run(run_mode, force_rebuild_revision, max_items)
    except Exception as e:
        run._tell("error", processed=0, total=0, failed=1, excluded=0, message=str(e))
        raise
    return json.dumps(status | {"automatic_full_run": not max_items}, ensure_ascii=False, indent=2), run.items_store.root


def _status(status_json: str) -> dict:
    status = json.loads(status_json or "")
    if not isinstance(status, dict):
        raise ValueError("status_json must contain a JSON object")
    return status


def run_summary(status_json: str) -> tuple[str, str, str]:
    """The summary as text, the issues and the report as JSON."""
    status = _status(status_json)
    issues = status.get("issues") if isinstance(status.get("issues"), list) else []
    report = status.get("dataset_report") if isinstance(status.get("dataset_report"), dict) else {}
    return text_summary(status), json.dumps(issues, ensure_ascii=False, indent=2), json.dumps(report, ensure_ascii=False, indent=2)


def app_report(spark, status_json: str, path: str) -> str:
    """The summary, which is also drawn as a PNG at path."""
    summary = text_summary(_status(status_json))
    stores.put_bytes(path, render_summary(spark, summary))
    return summary


def validator(spark, destination_directory: str, profile: dict) -> str:
    """The validation of a finished data set, as JSON."""
    root = stores.normalized_path(destination_directory)
    run = CurationRun(spark, f"{root}/.none", root, profile, media_type="videos" if profile["model"] == "minimax_h3" else "images")
    if not run.items_store.current():
        raise FileNotFoundError(f"The data set has no item table: {root}")
    return json.dumps(run.validate(), ensure_ascii=False, indent=2)
