"""A resumable curation run: scan, name, reconcile, exclude copies, process, validate, report.

Each step is a transition of the item table; the state is committed as a snapshot when the run ends, so a run that breaks off leaves the old one in place
and is simply repeated. Work per item (decoding, models, captions, moving and writing files) happens in Arrow batches on the executors; the driver
holds counts and the first rows of lists.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.functions.captions import apply_trigger, apply_video_trigger, whitespace_words
from sievecraft.functions.geometry import crop_decision, protected_detections
from sievecraft.functions.hashing import config_version
from sievecraft.operators import dedup, manifest, media, naming, validation
from sievecraft.operators.captioning import generated_captions
from sievecraft.operators.http_caption import SECRETS
from sievecraft.operators.providers import residual_mode
from sievecraft.sources import files, sinks, stores
from sievecraft.sources.probe import video_config

from . import facts
from .report import dataset_report, report_json, write_lists
from .schema import ITEMS, VERSIONS
from .storage import written

#: Up to so many claimed files are named to the reader one by one; for more, the source folder is read as a whole.
NAMED_FILES = 10_000
#: Rows of a list that a report on the driver shows; the lists themselves are written whole.
LISTED = 1_000


def check_media(profile: dict, media: str) -> None:
    """Video profiles take videos and the others images; a profile that needs a trigger has one."""
    if (media == "videos") != (profile["model"] == "minimax_h3"):
        raise ValueError(f"Profile {profile['profile_id']} does not take {media}")
    if profile["settings"].get("trigger_required") and not profile["trigger"]:
        raise ValueError(f"Profile {profile['profile_id']} needs a trigger")


def _plain(path):
    return F.regexp_replace(path, r"\Afile:/*(?=/)", "")


def _version(config: dict | None, none: str = "none") -> str:
    """Of a provider's configuration without its secrets, so that no key is ever written."""
    return config_version(config, SECRETS) if config else none


@dataclass
class CurationRun:
    """source, destination: folders that driver and executors share, as URIs, or as plain paths where these are Spark's default file system and mounted everywhere.

    Providers are configurations, named by `provider`.
    """

    spark: SparkSession
    source: str
    destination: str
    profile: dict
    recursive: bool = True
    numbered_name: str = ""
    caption_provider: dict | None = None
    cleanup_provider: dict | None = None
    cleanup_verifier: dict | None = None
    analysis_provider: dict | None = None
    crop_provider: dict | None = None
    media_type: str = "images"
    video: dict | None = None
    prober: dict = field(default_factory=lambda: {"provider": "ffprobe"})
    encoder: dict = field(default_factory=lambda: {"provider": "ffmpeg"})
    sampler: dict = field(default_factory=lambda: {"provider": "ffmpeg"})
    transcriber: dict = field(default_factory=lambda: {"provider": "whisper"})
    override_lines: list[str] = field(default_factory=list)
    now: str = ""
    progress: Callable[[dict], None] | None = None

    def __post_init__(self) -> None:
        check_media(self.profile, self.media_type)
        self.source, self.destination = stores.normalized_path(self.source).rstrip("/"), stores.normalized_path(self.destination).rstrip("/")
        if self.source == self.destination:
            raise ValueError("Source and destination folders must differ")
        self.is_video = self.media_type == "videos"
        self.video = video_config(self.video) if self.is_video else None
        self.dataset, self.review, self.reports = (f"{self.destination}/{n}" for n in ("dataset", "review", "reports"))
        self.items_store, self.meta_store = (sinks.Snapshots(self.spark, f"{self.destination}/manifest/{n}") for n in ("items", "metadata"))
        self.numbered_name = self.numbered_name.strip()
        more = f"+video-{config_version(self.video, ascii_only=True)}" if self.is_video else ""
        self.versions = {v: "none" for v in VERSIONS} | {
            "profile_id": self.profile["profile_id"], "profile_version": self.profile["profile_version"], "caption_provider_version": _version(self.caption_provider, "phase1") + more,
            "cleanup_provider_version": _version(self.cleanup_provider), "cleanup_verifier_version": _version(self.cleanup_verifier), "analysis_provider_version": _version(self.analysis_provider, "basic-v1") + more,
            "crop_provider_version": _version(self.crop_provider) + more, "output_naming_mode": "lora_name_numbered" if self.numbered_name else "preserve_source_names", "lora_name": self.numbered_name,
        }

    def _tell(self, status: str, **figures) -> None:
        """Progress is for watching; what a listener raises does not stop a run."""
        if self.progress:
            try:
                self.progress({"status": status} | figures)
            except Exception:  # noqa: BLE001
                pass

    # --- state ---

    def items(self) -> DataFrame:
        return self.items_store.read() if self.items_store.current() else self.spark.createDataFrame([], ITEMS)

    def _revision(self) -> int | None:
        if not self.meta_store.current():
            return None
        row = self.meta_store.read().where("key = 'force_rebuild_revision'").first()
        return json.loads(row.value) if row else None

    def _listing(self) -> DataFrame:
        if not sinks.path_exists(self.spark, self.dataset):
            return self.spark.createDataFrame([], "path string")
        return files.listing(self.spark, self.dataset).select(_plain(F.col("path")).alias("path"))

    # --- steps ---

    def discover(self, items: DataFrame) -> DataFrame:
        """The source's listing with output paths."""
        inside = (self.destination[len(self.source) + 1 :],) if self.destination.startswith(self.source + "/") else ()
        found = files.discover(self.spark, self.source, self.recursive, inside, files.VIDEO_SUFFIXES if self.is_video else files.image_suffixes())
        rows = found.select("item_id", _plain(F.col("path")).alias("source_path"), F.col("relative_path").alias("source_relative_path"), F.col("content_hash").alias("source_hash"), F.col("size").alias("source_size"), (F.unix_micros("mtime") * 1000).alias("source_mtime_ns"))
        rows = written(rows, "discovered")
        stems = naming.numbered_names(manifest.naming_sequences(items, rows), self.numbered_name) if self.numbered_name else naming.output_stems(rows).withColumn("naming_sequence", F.lit(None).cast("long"))
        stems = stems.withColumnRenamed("item_id", "n_id")
        named = rows.join(stems, rows["item_id"] == stems["n_id"]).drop("n_id")
        at = lambda suffix: F.concat(F.lit(f"{self.dataset}/"), "output_stem", F.lit(suffix))
        return named.select(*rows.columns, at(".mp4" if self.is_video else ".png").alias("output_image_path"), at(".txt").alias("caption_path"), F.col("naming_sequence").cast("long").alias("naming_sequence"))

    def _move(self, moves: DataFrame, base: str = "", together: bool = False) -> DataFrame:
        """item_id, moved, ok; the moves are done when this returns."""
        to = F.concat(F.lit(f"{base}/"), "dst") if base else F.col("dst")
        return written(sinks.move_files(moves.select("item_id", "src", to.alias("dst")), together), "moved")

    @staticmethod
    def _count(moved: DataFrame) -> int:
        return moved.agg(F.coalesce(F.sum("moved"), F.lit(0))).first()[0]

    def _put(self, rows: DataFrame) -> None:
        sinks.put_files(rows).write.format("noop").mode("overwrite").save()

    def _outputs_to(self, items: DataFrame, folder: Column) -> DataFrame:
        """item_id, src, dst of an item's outputs into a folder below the review folder."""
        rows = items.select("item_id", folder.alias("folder"), F.explode(F.array("output_image_path", "caption_path")).alias("src"))
        return rows.select("item_id", "src", F.concat("folder", F.lit("/"), F.element_at(F.split("src", "/"), -1)).alias("dst"))

    def _exclude_copies(self, items: DataFrame) -> tuple[DataFrame, int, int]:
        if not self.profile["settings"].get("exclude_exact_duplicates", True):
            return items, 0, 0
        decisions = written(dedup.exact_duplicate_decisions(items), "decisions")
        back = decisions.where("action = 'reinstate'")
        items = manifest.reinstate_exact_duplicate(items, back)
        out = decisions.where("action = 'exclude'").select("item_id", "keeper_path")
        gone = items.join(out.select("item_id"), "item_id", "left_semi")
        self._move(self._outputs_to(gone, F.concat(F.lit("duplicates/exact/"), "item_id", F.lit("-"), F.substring("source_hash", 1, 12))), self.review)
        self._put(validation.duplicate_evidence(decisions, items).select(F.concat(F.lit(f"{self.review}/"), "dst").alias("path"), F.col("evidence").alias("text")))
        items = manifest.mark_excluded(items, out, "", "exact_duplicate_excluded")
        reasons = out.select("item_id", F.concat(F.lit("Exact duplicate of "), "keeper_path", F.lit("; excluded from training")).alias("error"))
        return manifest.apply_results(items, reasons), out.count(), back.count()

    def _decoded(self, claimed: DataFrame, n: int) -> DataFrame:
        """The claimed pictures with h, w, n and data; h is -1 or null where nothing could be decoded. A few files are read by name, many as their folder."""
        reader = self.spark.read.format("image").option("dropInvalid", "false")
        if n <= NAMED_FILES:
            quoted = [re.sub(r"([\[\]{}*?\\,])", r"\\\1", r.source_path) for r in claimed.select("source_path").collect()]
            images = reader.load(quoted)
        else:
            images = reader.option("recursiveFileLookup", "true").load(self.source)
        i = F.col("image")
        images = images.select(_plain(i["origin"]).alias("origin"), i["height"].alias("h"), i["width"].alias("w"), i["nChannels"].alias("n"), i["data"].alias("data"))
        return claimed.join(images, F.col("source_path") == F.col("origin"), "left")

    def _overrides(self, items: DataFrame) -> DataFrame:
        lines = self.spark.createDataFrame([(x,) for x in self.override_lines], "line string")
        return validation.override_matches(items, validation.override_keys(lines)).select(F.col("item_id").alias("o_id"), "matched_name")

    def _process_pictures(self, claimed: DataFrame, n: int) -> DataFrame:
        """item_id and the columns that processing sets, problem and excluded among them; what stops an item stops it alone."""
        own = claimed.select("item_id", "source_path", "source_relative_path", "source_hash", "profile_version", "output_image_path", "caption_path")
        made = media.prepare_pictures(self._decoded(own, n), self.cleanup_provider, self.cleanup_verifier, self.analysis_provider)
        rows = written(own.join(made.withColumnRenamed("item_id", "m_id"), F.col("item_id") == F.col("m_id")).drop("m_id"), "prepared")
        rows = rows.join(self._overrides(own), F.col("item_id") == F.col("o_id"), "left").drop("o_id")
        checked = media.verification(self.cleanup_verifier, F.col("matched_name")) if self.cleanup_verifier else F.lit(None).cast("struct<status:string,passed:boolean>")
        rows = rows.withColumn("verified", F.when(F.col("fidelity").isNotNull(), checked))
        failed_check = F.col("verified.passed") == F.lit(False)
        excluded = F.when(failed_check, F.concat(F.lit("Excluded after cleanup verification ("), F.col("verified.status"), F.lit(")")))
        problem = F.when(F.col("corrupt"), "Validation failed: image_corrupt")
        problem = F.coalesce(problem, F.concat(F.lit("Clean-up failed: "), "cleanup_error"), F.concat(F.lit("Clean-up verification failed: "), "verify_error"), F.when(~F.coalesce(failed_check, F.lit(False)), F.concat(F.lit("Analysis failed: "), "analysis_error")))
        good = F.col("problem").isNull() & F.col("excluded").isNull()
        settings = self.profile["settings"]
        boxes = F.transform(protected_detections(F.col("subjects"), F.col("faces"), settings.get("crop_strategy", "composition_preserving")), lambda d: d["bbox"])
        plan = crop_decision(F.col("width"), F.col("height"), boxes, settings, int((self.crop_provider or {}).get("minimum_output_dimension", 512)))
        rows = rows.withColumns({"problem": problem, "excluded": excluded})
        rows = written(rows.withColumn("crop", F.when(good & F.lit(self.crop_provider is not None), plan)), "planned")
        cut = media.crop_outputs(rows.where(F.col("crop.status").startswith("cropped")).select("item_id", "output_image_path", F.col("crop.crop_box").alias("box")))
        cut = written(cut, "cropped").select(F.col("item_id").alias("x_id"), F.col("width").alias("x_width"), F.col("height").alias("x_height"), F.col("perceptual_hash").alias("x_hash"))
        rows = rows.join(cut, F.col("item_id") == F.col("x_id"), "left").drop("x_id")

        cleaned = F.when(F.col("corrupt"), "not_requested").when(F.col("cleanup_error").isNotNull(), "cleanup_failed").when(F.col("verify_error").isNotNull(), "verification_failed")
        cleaned = cleaned.when(F.col("verified").isNotNull(), F.when(failed_check, F.col("verified.status")).otherwise("verified_clean"))
        checked_as = F.when(F.col("verify_error").isNotNull(), "verification_failed").when(F.col("verified").isNotNull(), F.when(failed_check, F.col("verified.status")).otherwise("verified_clean")).otherwise("not_requested")
        provider = (self.analysis_provider or {"provider": "basic"})["provider"]
        analysed = ~F.col("corrupt") & F.col("analysis_error").isNull()
        return rows.select(
            *own.columns, "problem", "excluded", "corrupt", F.coalesce("x_width", "width").alias("width"), F.coalesce("x_height", "height").alias("height"), "brightness_mean", "contrast_stddev", "edge_sharpness",
            F.coalesce("x_hash", "perceptual_hash").alias("perceptual_hash"), F.when(~F.col("corrupt"), "converted_png").alias("normalization_status"),
            cleaned.otherwise("cleaned_universal" if self.cleanup_provider else "not_requested").alias("watermark_status"), checked_as.alias("cleanup_verification_status"),
            F.coalesce(F.when(F.col("verify_error").isNotNull(), F.to_json(F.struct(F.lit("verification_failed").alias("status"), F.lit(False).alias("passed"), F.col("verify_error").alias("error")))), F.to_json("verified")).alias("cleanup_verification_json"),
            F.when(F.col("verify_error").isNotNull(), "cleanup_review_required").when(failed_check, "cleanup_excluded").otherwise("not_requested").alias("review_status"),
            F.when(analysed, f"analyzed_{provider}").otherwise("analysis_failed").alias("analysis_status"), F.when(analysed, media.analysis_json(provider)).alias("analysis_json"),
            F.col("crop.status").alias("crop_status"), F.to_json("crop").alias("crop_json"), F.col("crop.removed_area_fraction").alias("removed_area_fraction"),
        )

    def _process_clips(self, claimed: DataFrame) -> DataFrame:
        own = claimed.select("item_id", "source_path", "source_relative_path", "source_hash", "profile_version", "output_image_path", "caption_path")
        made = media.prepare_clips(own.select("item_id", "source_path", "source_relative_path", "output_image_path"), self.video, self.prober, self.encoder)
        made = made.select(F.col("item_id").alias("m_id"), "orientation", "excluded", "problem", "output")
        rows = own.join(written(made, "clips"), F.col("item_id") == F.col("m_id")).drop("m_id")
        o = F.col("output")
        video = F.struct(*(o[c].alias(c) for c in ("width", "height", "rotation", "fps", "frames", "duration")), F.col("orientation").alias("source_orientation"))
        raw = F.lit(json.dumps(self.video))
        settings = F.from_json(raw, F.schema_of_json(raw))
        done = F.col("output").isNotNull() & F.col("problem").isNull()
        return rows.select(
            *own.columns, "problem", "excluded", F.col("output").isNull().alias("corrupt"), o["width"].alias("width"), o["height"].alias("height"), *(F.lit(None).cast("double").alias(c) for c in ("brightness_mean", "contrast_stddev", "edge_sharpness")),
            F.lit(None).cast("long").alias("perceptual_hash"), F.when(done, "prepared").alias("normalization_status"), F.when(done, "skipped_video").alias("watermark_status"), F.when(done, "skipped_video").alias("cleanup_verification_status"),
            F.when(done, F.lit('{"media_type": "video"}')).alias("cleanup_verification_json"), F.when(F.col("excluded").isNotNull(), "orientation_filtered").otherwise("not_requested").alias("review_status"),
            F.when(done, "skipped_video").alias("analysis_status"), F.when(done, F.to_json(F.struct(F.lit("ffprobe").alias("provider"), F.lit("video").alias("media_type"), video.alias("video")))).alias("analysis_json"),
            F.when(done, "cropped_ffmpeg" if self.video["resize_mode"] == "crop_to_fill" else "prepared_ffmpeg").alias("crop_status"),
            F.when(done, F.to_json(F.struct(F.lit("ffmpeg").alias("provider"), settings.alias("settings"), video.alias("output")))).alias("crop_json"), F.lit(None).cast("double").alias("removed_area_fraction"), "output",
        )

    def _captions(self, rows: DataFrame) -> DataFrame:
        """item_id, caption, caption_status, caption_problem."""
        trigger = self.profile["trigger"]
        if self.caption_provider:
            asked = rows.select("item_id", "source_relative_path", F.col("output_image_path").alias("image_path"))
            if self.is_video:
                frames = media.clip_frames(rows, self.video, self.sampler).withColumnRenamed("item_id", "f_id")
                asked = asked.join(frames, F.col("item_id") == F.col("f_id"), "left").drop("f_id")
                if self.video["transcribe_audio"]:
                    original = sinks.original_video(self.source, self.video["original_video_path"])
                    heard = media.transcripts(rows, self.video, self.transcriber, original, f"{self.destination}/transcripts").withColumnRenamed("item_id", "t_id")
                    asked = asked.join(heard, F.col("item_id") == F.col("t_id"), "left").drop("t_id")
            return generated_captions(written(asked, "asked"), self.caption_provider, self.profile, "video" if self.is_video else "image")
        base = files.with_source_captions(rows.select("item_id", F.col("source_relative_path").alias("relative_path")), files.sidecars(self.spark, self.source))
        text = F.coalesce("source_caption", F.lit(trigger))
        done = apply_video_trigger(text, trigger) if self.is_video else apply_trigger(text, trigger, self.profile["settings"].get("trigger_behavior", "prefix"))
        status = F.when(F.col("source_caption").isNotNull(), "copied_source").otherwise("trigger_placeholder")
        return base.select("item_id", done.alias("caption"), F.concat(status, F.when(done != text, "_with_trigger").otherwise("")).alias("caption_status"), F.lit(None).cast("string").alias("caption_problem"))

    def _process(self, claimed: DataFrame, n: int) -> DataFrame:
        """item_id and the columns that processing the claimed items sets; an item's failure is its own."""
        rows = written(self._process_clips(claimed) if self.is_video else self._process_pictures(claimed, n), "processed")
        good = rows.where("problem is null and excluded is null")
        captions = written(self._captions(good), "captions")
        self._put(good.join(captions.where("caption_problem is null").select("item_id", "caption"), "item_id").select(F.col("caption_path").alias("path"), F.col("caption").alias("text")))
        c = captions.select(F.col("item_id").alias("c_id"), "caption", "caption_status", "caption_problem")
        rows = self._fields(rows.join(c, F.col("item_id") == F.col("c_id"), "left").drop("c_id"))
        checked = validation.caption_verdict(rows, self.profile).withColumn("errors", validation.record_errors(self.profile))
        error = F.coalesce("problem", F.concat(F.lit("Caption failed: "), "caption_problem"), F.when(F.size("errors") > 0, F.concat(F.lit("Validation failed: "), F.concat_ws(", ", F.array_distinct(F.transform("errors", lambda e: F.when(e.isin("caption_profile_invalid", "caption_negative_or_absence_language"), F.coalesce("caption_error", e)).otherwise(e)))))))
        stopped = F.col("excluded").isNotNull()
        out = checked.withColumn("stop", F.coalesce("excluded", error))
        results = written(out.select(
            *(k for k in rows.columns if k not in ("problem", "excluded", "corrupt", "caption_problem", "output", *_RECORD_ONLY)), F.col("stop").alias("error"),
            F.when(stopped, "excluded").when(F.col("stop").isNull(), "complete").otherwise("failed").alias("status"), F.when(stopped, "excluded").when(F.col("stop").isNull(), "valid").otherwise("error").alias("validation_status"),
        ), "results")
        self._review(results)
        return results

    def _fields(self, rows: DataFrame) -> DataFrame:
        """rows with what record_errors looks at."""
        v, o = self.video or {}, F.col("output") if "output" in rows.columns else None
        none = lambda kind: F.lit(None).cast(kind)
        size = validation.expected_video_size(F.col("width"), F.col("height"), v, F.get_json_object("crop_json", "$.output.source_orientation")) if self.is_video else F.lit(None).cast("struct<width:int,height:int>")
        return rows.withColumns({
            "media_exists": F.lit(True), "is_video": F.lit(self.is_video), "fps": o["fps"] if o is not None else none("double"), "duration": o["duration"] if o is not None else none("double"), "frames": o["frames"] if o is not None else none("int"),
            "target_fps": F.lit(v.get("fps")).cast("double"), "target_frames": F.lit(v.get("target_frame_count")).cast("int"), "expected_width": size["width"], "expected_height": size["height"], "caption_exists": F.col("caption").isNotNull(),
        })

    def _review(self, results: DataFrame) -> None:
        """Outputs and evidence of clean-ups that did not pass go to the review folder."""
        routed = results.where("review_status in ('cleanup_excluded', 'cleanup_review_required')")
        if not routed.limit(1).count():
            return
        folder = validation.verification_folder()
        self._move(self._outputs_to(routed, folder), self.review)
        self._put(routed.select(F.concat(F.lit(f"{self.review}/"), folder, F.lit("/verification.json")).alias("path"), F.col("cleanup_verification_json").alias("text")))

    # --- the run ---

    def run(self, mode: str = "resume", revision: int = 0, max_items: int = 0) -> dict:
        before = written(self.items(), "items")
        stamp = self.now or self.spark.sql("select date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")").first()[0]
        now = F.lit(stamp)
        source = written(self.discover(before), "source")
        wanted = source.select("item_id", "output_image_path", "caption_path")
        kept = before.join(source.select(F.col("item_id").alias("s_id"), F.col("source_hash").alias("s_hash")), (F.col("item_id") == F.col("s_id")) & (F.col("source_hash") == F.col("s_hash")), "left_semi")
        renamed = self._move(naming.rename_moves(kept, wanted, self._listing()), together=True).where("ok").select("item_id")
        items = written(manifest.sync(before, source, self.versions, preserve=renamed, now=now), "synced")
        changed = before.join(wanted.select(F.col("item_id").alias("w_id"), F.col("output_image_path").alias("w_path")), (F.col("item_id") == F.col("w_id")) & (F.col("output_image_path") != F.col("w_path")), "left_semi").join(renamed, "item_id", "left_anti")
        remapped = self._count(self._move(validation.quarantine_moves(changed, items, "remapped"), self.review))
        quarantined = self._count(self._move(validation.quarantine_moves(before.join(items.where("not active").select("item_id"), "item_id", "left_semi"), items, "inactive"), self.review))
        items, new_revision = manifest.prepare_run(items, mode, revision, self._revision())
        gone = written(manifest.missing_outputs(items, self._listing()), "missing")
        items = manifest.reset_missing_outputs(items, self._listing())
        items = written(manifest.update_pending_versions(items, self.versions, now), "prepared")
        items, copies, reinstated = self._exclude_copies(items)
        items = written(items, "deduplicated")

        waiting = items.where("active and status = 'pending'").count()
        self._tell("running", processed=0, total=waiting, failed=0, excluded=copies)
        claimed = written(manifest.claim_next(items, max_items or None), "claimed")
        processed, failed_now, excluded_now = claimed.count(), 0, 0
        if processed:
            results = self._process(claimed, processed)
            failed_now, excluded_now = (results.where(f"status = '{s}'").count() for s in ("failed", "excluded"))
            items = manifest.apply_results(items, claimed.select("item_id", "attempts"))
            done = results.select([c for c in results.columns if c in items.columns])
            items = written(manifest.apply_results(items, done.withColumn("error", F.coalesce("error", F.lit("")))).withColumn("error", F.when(F.col("error") != "", F.col("error"))), "applied")
            self._quality(results)
        self._tell("running", processed=processed, total=waiting, failed=failed_now, excluded=copies + excluded_now)
        self.items_store.commit(items)
        if new_revision is not None:
            self.meta_store.commit(self.spark.createDataFrame([("force_rebuild_revision", json.dumps(new_revision), stamp)], "key string, value string, updated_at string"))
        figures = {
            "media_type": self.media_type, "video_config": self.video, "source_directory": self.source, "destination_directory": self.destination, "output_naming_mode": self.versions["output_naming_mode"], "lora_name": self.numbered_name,
            "discovered": source.count(), "processed_this_run": processed, "failed_this_run": failed_now, "excluded_this_run": copies + excluded_now, "exact_duplicates_excluded_this_run": copies, "exact_duplicates_reinstated_this_run": reinstated,
            "repaired_missing_outputs": gone.count(), "quarantined": quarantined, "quarantined_remapped_outputs": remapped,
            "residual_detection_mode": residual_mode((self.cleanup_verifier or {}).get("residual_detection_mode")) if self.cleanup_verifier else "disabled",
        }
        return self._finish(figures, stamp)

    def _quality(self, results: DataFrame) -> None:
        """What the report needs of each item's picture is kept beside the items, newest last."""
        keep = ("item_id", "brightness_mean", "contrast_stddev", "edge_sharpness", "perceptual_hash", "width", "height", "removed_area_fraction", "caption")
        store = sinks.Snapshots(self.spark, f"{self.destination}/manifest/quality")
        rows = results.select(*keep)
        if store.current():
            rows = store.read().join(results.select("item_id"), "item_id", "left_anti").unionByName(rows)
        store.commit(rows)

    def described(self) -> DataFrame:
        """The items with what validation and report look at; outputs count as there if they are listed."""
        items = self.items_store.read()
        store = sinks.Snapshots(self.spark, f"{self.destination}/manifest/quality")
        kinds = "item_id string, brightness_mean double, contrast_stddev double, edge_sharpness double, perceptual_hash long, width int, height int, removed_area_fraction double, caption string"
        quality = store.read() if store.current() else self.spark.createDataFrame([], kinds)
        there = written(self._listing(), "listing")
        listed = lambda c, name: there.select(F.col("path").alias(c)).withColumn(name, F.lit(True))
        q = quality.withColumnRenamed("item_id", "q_id")
        rows = items.join(q, F.col("item_id") == F.col("q_id"), "left").drop("q_id")
        rows = rows.join(listed("output_image_path", "media_there"), "output_image_path", "left").join(listed("caption_path", "caption_there"), "caption_path", "left")
        exists = F.coalesce("media_there", F.lit(False))
        clip = F.from_json("analysis_json", "struct<video:struct<width:int,height:int,fps:double,frames:int,duration:double>>")["video"]
        target = F.from_json("crop_json", "struct<settings:struct<fps:double,target_frame_count:int>,output:struct<source_orientation:string>>")
        size = validation.expected_video_size(F.col("width"), F.col("height"), self.video or {}, target["output"]["source_orientation"])
        return rows.withColumns({
            "media_exists": exists, "is_video": files.media_type(F.col("output_image_path")) == "video", "corrupt": exists & F.col("width").isNull(), "caption_exists": F.coalesce("caption_there", F.lit(False)),
            "fps": clip["fps"], "duration": clip["duration"], "frames": clip["frames"], "target_fps": target["settings"]["fps"], "target_frames": target["settings"]["target_frame_count"],
            "expected_width": size["width"], "expected_height": size["height"], "caption_words": whitespace_words(F.col("caption")),
        }).drop("media_there", "caption_there")

    def validate(self) -> dict:
        """The data set's validation as one object; lists show their first rows."""
        items = written(self.described(), "described")
        table = validation.validation_facts(items, self._listing(), self.profile)
        out = facts.nested(table, validation.VALIDATION_FLAGS, tuple(("validation", h) for h in validation.VALIDATION_HISTOGRAMS))["validation"]
        loose = validation.orphan_outputs(self._listing(), items).orderBy("path")
        text = F.lower("path").endswith(".txt")
        results = validation.item_results(items, self.profile)
        members: dict[str, list] = {}
        for r in validation.exact_duplicate_members(items).orderBy("source_hash", "source_relative_path").limit(LISTED).collect():
            members.setdefault(r.source_hash, []).append(r.source_relative_path)
        return out | {
            "orphan_images": [r.path for r in loose.where(~text).limit(LISTED).collect()], "orphan_captions": [r.path for r in loose.where(text).limit(LISTED).collect()], "exact_duplicate_groups": list(members.values()),
            "item_results": [r.asDict() for r in results.drop("source_hash").orderBy("source_relative_path").limit(LISTED).collect()],
        }

    def issues(self) -> list[dict]:
        """The first issues in order of their image, with what a verification found and where the evidence lies."""
        rows = validation.issues(self.items_store.read())
        notes = self.items_store.read().select(F.col("item_id").alias("v_id"), validation.verification_payload(F.col("cleanup_verification_json")).alias("v"))
        rows = rows.join(notes, F.col("item_id") == F.col("v_id"), "left").orderBy("image", "item_id").limit(LISTED)
        out = []
        for r in rows.collect():
            found = [d.asDict() for d in (r.v.residual_detections or [])] if r.v else []
            folder = f"{self.review}/{r.review_path}"
            shown = {k: r[k] for k in ("image", "source_image", "status", "stage", "reason", "cleanup_verification_status", "review_status")}
            out.append(shown | {
                "detector_confidence_threshold": r.v.confidence_threshold if r.v else None, "residual_detections": found, "residual_detection_count": len(found),
                "review_directory": folder if sinks.path_exists(self.spark, folder) else "",
            })
        return out

    def _finish(self, figures: dict, stamp: str) -> dict:
        """The run's status, with its reports written: reports/run_report.json, reports/dataset_report.json and the lists beside it."""
        checked = self.validate()
        s = manifest.summary(self.items_store.read()).first().asDict()
        ready = bool(checked["training_ready"])
        report = dataset_report(written(self.described(), "described"), self.profile, ready)
        shown = report_json(report, self.profile, stamp, LISTED)
        write_lists(report, f"{self.reports}/dataset_report")
        sinks.write_json(shown, f"{self.reports}/dataset_report.json")
        named = ("watermark_audit_complete", "analysis_audit_complete", "crop_audit_complete", "cleanup_verification_status_counts", "cleanup_review_items", "cleanup_excluded_items", "cleanup_override_applied_count", "analysis_status_counts", "crop_status_counts")
        status = figures | s | {k: checked[k] for k in named} | {
            "orphans": checked["orphan_image_count"] + checked["orphan_caption_count"], "audit_valid": checked["valid"], "training_ready": ready, "issues": self.issues(), "dataset_report": shown, "dataset_report_path": f"{self.reports}/dataset_report.json",
        }
        sinks.write_json({"run": status, "validation": checked, "profile": self.profile}, f"{self.reports}/run_report.json")
        self._tell("complete", processed=figures["processed_this_run"], total=s["total"], failed=s["failed"], excluded=s["excluded"])
        return status


#: Columns that a record is judged by and that are no result.
_RECORD_ONLY = ("media_exists", "is_video", "fps", "duration", "frames", "target_fps", "target_frames", "expected_width", "expected_height", "caption_exists")
