"""Instructions for caption models, and captions that are asked for again when they break the policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievecraft.functions.captions import apply_trigger, apply_video_trigger, video_error
from sievecraft.operators.providers import apply_provider
from sievecraft.operators.validation import caption_verdict
from sievecraft.plans.storage import written

# The wording of the instructions.
VIDEO_POLICY = """You are a video dataset captioning model for MiniMax H3 LoRA training.

Your job is to create one accurate sidecar caption for each training video. The attached images are ordered frames sampled chronologically from one prepared video. Treat them as temporal evidence for the complete clip, not as separate images.

The caption must describe what is visibly present in the video, how it changes over time, and any dialogue or audible event supplied as transcript evidence.

Write one concise natural-language paragraph. Do not output reasoning, bullets, numbering, metadata, analysis, headings, or explanations.

Describe the main subject or subjects; important visible appearance details needed to distinguish them; the environment and scene; primary subject motion in chronological order; camera movement, if any; important secondary motion such as hair, clothing, vehicles, water, smoke, foliage, or objects moving through the scene; and framing or composition when it materially affects the clip.

For motion-concept training, give particular attention to the demonstrated motion. Describe it clearly and consistently across clips. Use chronological language when useful: describe the initial state, the motion that occurs, and the ending state. Do not narrate every frame.

For a stationary-camera clip, explicitly state that the camera remains stationary when this helps distinguish subject motion from camera motion. For a camera-motion concept, distinguish camera movement from subject movement.

Caption only supported evidence, not assumptions. Do not use uncertain language such as "appears to," "seems to," "probably," or "possibly." Do not add intentions, emotions that are not visibly expressed, production metadata, quality ratings, or speculative context. Never infer or invent dialogue from facial expressions, mouth movement, subtitles, or visual frames. When reliable transcript evidence is supplied, include all clearly spoken words in quotation marks and place them in the correct point of the chronological action. Mention music, singing, vocalizations, or sound effects only when the transcript evidence explicitly identifies them. Treat automatic transcripts as fallible: omit garbled text and never invent a speaker identity.

Do not use generic quality tags such as "masterpiece," "best quality," "4K," "highly detailed," or "professional." Do not describe a target visual style unless that style is intentionally meant to be caption-conditioned.

For a style LoRA, describe the visible content while leaving the shared target style primarily represented by the trigger. For a motion LoRA, describe enough scene content to separate it from the repeated motion concept, but do not over-caption irrelevant static details.

Use natural English rather than tag-style captions. Keep the caption focused. Accurately identify the subject, scene, motion, camera behavior, and important visible changes that the LoRA should learn around."""
IMAGE_OPENING = "Write one direct positive image caption for the attached image."
IMAGE_LANGUAGE = "Use concrete declarative visual language. Every sentence must work unchanged as a positive generation prompt."
RETRIES = (
    "Generate a fresh caption in affirmative language. State present subjects, objects, actions, camera movement, sounds, and dialogue using the required format.",
    "Create a concise replacement caption. Use affirmative sentences naming present visual events and chronological motion. Return only the finished caption.",
)


def caption_instruction(profile: dict, media: str = "image") -> str:
    """What a profile asks of a caption model: its style, length, format, recipe and further wishes; for videos the policy with the trigger."""
    s = profile["settings"]
    words, recipe = int(s.get("caption_max_words", 120)), str(s.get("caption_instruction", "Describe the visible media content accurately.")).strip()
    more = str(s.get("additional_caption_instructions", "")).strip()
    if media == "video":
        trigger = profile.get("trigger", "").strip()
        named = f'The required trigger is "{trigger}". Begin the caption with that exact trigger followed by a comma.' if trigger else "No trigger word was supplied. Do not invent one."
        parts = [VIDEO_POLICY, named, f"Dataset type: {profile.get('dataset_type', 'dataset')}. Maximum length: {words} words.", f"Dataset-type-specific emphasis: {recipe}", "Return only the finished sidecar caption."]
    else:
        form = f"Required output format: {s.get('caption_output_format', 'single_paragraph')}."
        parts = [IMAGE_OPENING, f"Use {s.get('caption_style', 'natural_language')}. Maximum length: {words} words.", form, recipe, IMAGE_LANGUAGE, "Return only the caption content in the requested format."]
    return "\n\n".join(parts + ([f"Additional dataset-specific instructions: {more}"] if more else []))


def retry_instruction(base: str, attempt: int) -> str:
    """The instruction of a further attempt after a caption broke the policy."""
    return base if attempt < 1 else f"{base}\n\n{RETRIES[min(attempt, len(RETRIES)) - 1]}"


def generated_captions(rows: DataFrame, config: dict, profile: dict, media: str = "image", attempts: int = 3) -> DataFrame:
    """item_id, caption, caption_status, caption_problem of the rows' captions by a provider.

    A caption that breaks the policy is asked for again with another instruction, `attempts` times in all; only the rows that need it are. What a
    provider cannot do is the row's problem at once (it has retried by itself). Each attempt is written, so none is asked for twice.
    """
    base, trigger = caption_instruction(profile, media), profile.get("trigger", "").strip()
    out_type = T.StructType([T.StructField("caption", T.StringType())])
    put = apply_video_trigger(F.col("normalized"), trigger) if media == "video" else apply_trigger(F.col("normalized"), trigger, profile["settings"].get("trigger_behavior", "prefix"))
    columns, open_, done = rows.columns, rows, []
    for k in range(attempts):
        asked = open_.select(*columns, F.lit(retry_instruction(base, k)).alias("instruction"), F.lit(trigger).alias("trigger"))
        got = caption_verdict(apply_provider(asked, "caption", config, out_type), profile)
        if media == "video":
            got = got.withColumn("caption_error", F.coalesce("caption_error", video_error(F.col("normalized"))))
        got = written(got, "captioned")
        failed, good = F.col("provider_error").isNotNull(), F.col("provider_error").isNull() & F.col("caption_error").isNull()
        settled = got if k + 1 == attempts else got.where(failed | good)
        status = F.lit("generated" if k == 0 else "generated_after_validation_retry")
        done.append(settled.select("item_id", F.when(good, put).alias("caption"), F.when(good, status).alias("caption_status"), F.coalesce("provider_error", "caption_error").alias("caption_problem")))
        open_ = got.where(~failed & ~good).select(*columns)
        if k + 1 < attempts and not open_.limit(1).count():
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out
