"""Training profiles: defaults of a model, then of a dataset type, then a caller's overrides."""

from __future__ import annotations

import copy

from sievecraft.functions.hashing import config_version

SCHEMA_VERSION = 7
DATASET_TYPES = ("character", "style", "concept")

# Limits of the captions, crops and quality checks of each model.
_SHARED = {
    "positive_caption_only": True,
    "preferred_resolutions": [1024],
    "allowed_aspect_ratios": ["1:1", "3:4", "4:3", "9:16", "16:9"],
    "crop_aspect_tolerance": 0.035,
    "crop_subject_padding_fraction": 0.06,
    "exclude_exact_duplicates": True,
    "quality_minimum_dimension": 512,
    "quality_minimum_megapixels": 0.35,
}
_PIXELS = {"quality_dark_threshold": 22, "quality_bright_threshold": 238, "quality_low_contrast_threshold": 18, "quality_low_sharpness_threshold": 1.5}
_REMOVED = {"character": 0.35, "style": 0.12, "concept": 0.25}
_CROPS = {"character": "identity_preserving", "style": "composition_preserving", "concept": "semantic"}
_VIDEO_CROPS = {"character": "video_temporal_identity", "style": "video_composition_preserving", "concept": "video_motion_concept"}
_PROSE_TRIGGERS = {"character": "contextual_prefix", "style": "prefix", "concept": "contextual_prefix"}
# What captions of each model and dataset type are asked for, which aspects they describe, and the order of tags.
CAPTION_INSTRUCTIONS = {
    "krea2": {
        "character": "Focus on visible factors that vary from image to image using concise natural language: clothing, accessories, pose, expression, gaze, framing, action, lighting, and setting. The trigger represents the recurring subject. Do not routinely repeat invariant facial features, eye color, or characteristic hair; mention hair only when its style, arrangement, or visibility is important to this specific image. Use concrete visual statements and keep background details brief.",
        "style": "Describe the visible subject matter, composition, spatial layout, objects, setting, lighting, color relationships, and camera or rendering medium using concise natural language and concrete visual statements.",
        "concept": "Clearly describe the visible subjects, action, pose, objects, camera framing, spatial relationships, direction, and interaction. Make the depicted interaction unambiguous and keep clothing and background details brief.",
    },
    "anima": {
        "character": "Return one concise comma-separated Anima/Danbooru tag list in native order: optional quality/meta/year/safety tags, subject-count tags such as 1girl or 1boy, then general visible tags. Tag salient clothing, pose, expression, gaze, hair, accessories, framing, orientation, action, and background. Use lowercase tags separated by comma and space.",
        "style": "Return one concise comma-separated Anima/Danbooru tag list in native order. Tag subject count, visible subjects, clothing, actions, composition, viewpoint, setting, objects, lighting, palette, and background. Use lowercase tags separated by comma and space.",
        "concept": "Return one concise comma-separated Anima/Danbooru tag list in native order. Tag subject count and the visible subjects, action, pose, objects, direction, framing, and relationships needed to describe the depicted interaction. Add only salient clothing and background tags. Use lowercase tags separated by comma and space.",
    },
    "minimax_h3": {
        "character": "Identify the recurring subject with only the visible appearance details needed to distinguish them. Describe clothing, expression, pose, framing, chronological body movement, interactions, camera behavior, relevant secondary motion, setting, and ending state. Avoid over-captioning invariant identity details that the trigger should carry.",
        "style": "Describe visible subjects, scene content, composition, chronological action, camera behavior, and important secondary motion. Leave the shared target visual style primarily represented by the trigger unless a varying visible style attribute must be conditioned explicitly.",
        "concept": "Give particular attention to the repeated motion concept. Clearly distinguish subject motion from camera motion and describe the initial state, continuous motion progression, consequence or transition, and ending state. Include enough scene content to separate it from the motion without over-captioning irrelevant static details.",
    },
}
CAPTION_ASPECTS = {
    "krea2": {
        "character": {"describe_identity": False, "describe_clothing": True, "describe_pose": True, "describe_camera": True, "describe_background": True, "describe_lighting": True, "describe_style": False},
        "style": {"describe_subject": True, "describe_composition": True, "describe_environment": True, "describe_lighting": True, "describe_color_relationships": True, "describe_style": False},
        "concept": {"describe_subject": True, "describe_action": True, "describe_relationships": True, "describe_camera": True, "describe_environment": True},
    },
    "anima": {
        "character": {"format": "tags", "describe_identity": False, "describe_clothing": True, "describe_pose": True, "describe_expression": True, "describe_background": True, "omit_character_series_artist": True},
        "style": {"format": "tags", "describe_subject": True, "describe_composition": True, "describe_environment": True, "describe_style": False, "omit_character_series_artist": True},
        "concept": {"format": "tags", "describe_subject": True, "describe_action": True, "describe_relationships": True, "describe_environment": True, "omit_character_series_artist": True},
    },
}
OFFICIAL_TAG_ORDER = ["quality_meta_year_safety", "subject_count", "character", "series", "artist", "general"]
MODELS = {
    "krea2": {
        "display_name": "Krea 2",
        "defaults": _SHARED | _PIXELS | {"caption_style": "concise_natural_language", "caption_output_format": "single_paragraph", "caption_max_characters": 1800, "caption_max_words": 120, "training_checkpoint": "Krea 2 Raw", "trigger_required": False, "near_duplicate_maximum_hamming_distance": 6},
        "datasets": {k: {"trigger_behavior": _PROSE_TRIGGERS[k], "crop_strategy": _CROPS[k], "crop_max_removed_fraction": _REMOVED[k], "caption_max_words": w} for k, w in (("character", 110), ("style", 120), ("concept", 110))},
    },
    "anima": {
        "display_name": "Anima",
        "defaults": _SHARED | _PIXELS | {"caption_style": "anima_danbooru_tags", "caption_output_format": "comma_separated_tags", "caption_max_characters": 1400, "caption_max_words": 120, "trigger_required": True, "near_duplicate_maximum_hamming_distance": 6, "official_tag_order": OFFICIAL_TAG_ORDER},
        "datasets": {k: {"trigger_behavior": "anima_subject_slot", "crop_strategy": _CROPS[k], "crop_max_removed_fraction": _REMOVED[k]} for k in DATASET_TYPES},
    },
    "minimax_h3": {
        "display_name": "MiniMax H3",
        "defaults": _SHARED | {"caption_style": "concise_temporal_natural_language", "caption_output_format": "single_paragraph", "caption_max_characters": 2200, "caption_max_words": 150, "training_checkpoint": "MiniMax H3", "trigger_required": False, "near_duplicate_maximum_hamming_distance": 0},
        "datasets": {k: {"trigger_behavior": _PROSE_TRIGGERS[k], "crop_strategy": _VIDEO_CROPS[k], "crop_max_removed_fraction": _REMOVED[k]} for k in DATASET_TYPES},
    },
}


def merged(base: dict, over: dict) -> dict:
    """base with the values of over; dicts found on both sides are merged in turn."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


class ProfileRegistry:
    def __init__(self, models: dict | None = None) -> None:
        self.config = models or MODELS

    @property
    def models(self) -> tuple[str, ...]:
        return tuple(self.config)

    def display_name(self, model: str) -> str:
        return self.config[model]["display_name"]

    def model_for(self, name: str) -> str:
        """The key of a model by its key or display name."""
        for key, value in self.config.items():
            if name in (value["display_name"], key):
                return key
        raise ValueError(f"Unknown training model: {name}")

    def recipe(self, model: str, dataset_type: str, trigger: str = "", overrides: dict | None = None) -> dict:
        key, kind = self.model_for(model), str(dataset_type).strip().lower()
        if kind not in self.config[key]["datasets"]:
            raise ValueError(f"Unknown dataset type: {dataset_type}")
        recipe = {"caption_instruction": CAPTION_INSTRUCTIONS.get(key, {}).get(kind), "caption": CAPTION_ASPECTS.get(key, {}).get(kind)}
        dataset = {k: v for k, v in recipe.items() if v is not None} | self.config[key]["datasets"][kind]
        settings = merged(merged(self.config[key]["defaults"], dataset), overrides or {})
        out = {"model": key, "model_display_name": self.display_name(key), "dataset_type": kind, "trigger": trigger.strip(), "settings": settings, "schema_version": SCHEMA_VERSION}
        return out | {"profile_version": config_version(out), "profile_id": f"{key}:{kind}"}
