"""Items to outputs: pictures through their providers in one pass, crops, and clips through probe, encoder, frames and transcripts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sievecraft.functions.geometry import fidelity_decision, filter_chain, frame_timestamps, normalized_box, scaled_to_budget, target_dimensions, video_orientation
from sievecraft.functions.intervals import audio_evidence, cache_signature, context_window, segment_reasons
from sievecraft.functions.text import basename, stem
from sievecraft.sources import sinks
from sievecraft.sources.probe import orientation_excluded, probe
from sievecraft.sources.stores import put_bytes, read_bytes

from .overlap import window_transcripts
from .pixels import basic_metrics, crop, decode_png, difference_hash, encode_png, fidelity_metrics, image_notes, oriented, pixels_of, within_megapixels
from .providers import apply_provider, confidence_floor, provider_class, residual_mode, with_retries

_BOXES = "array<struct<label:string,confidence:double,bbox:array<double>>>"
_METRICS = ("structural_similarity", "luminance_correlation", "mean_absolute_difference", "changed_area_fraction", "aspect_ratio_delta")


def _record(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


_FOUND = T.ArrayType(_record(label=T.StringType(), confidence=T.DoubleType(), bbox=T.ArrayType(T.DoubleType())))
PREPARED = _record(
    item_id=T.StringType(), corrupt=T.BooleanType(), width=T.IntegerType(), height=T.IntegerType(), has_alpha=T.BooleanType(), brightness_mean=T.DoubleType(), contrast_stddev=T.DoubleType(),
    edge_sharpness=T.DoubleType(), perceptual_hash=T.LongType(), cleanup_error=T.StringType(), verify_error=T.StringType(), analysis_error=T.StringType(),
    fidelity=_record(**{m: T.DoubleType() for m in _METRICS}), detections=_FOUND, subjects=_FOUND, faces=_FOUND,
)


def prepare_pictures(rows: DataFrame, cleanup: dict | None = None, verifier: dict | None = None, analyzer: dict | None = None) -> DataFrame:
    """Decoded rows (item_id, source_path, source_relative_path, output_image_path, h, w, n, data) to their PNGs and PREPARED.

    Each picture is decoded once: turned by its EXIF orientation, with alpha and colour profile kept, cleaned, compared with what it was, analysed
    and written. Providers are one client each per task. What one of them cannot do with a picture is that row's error.
    """
    arrow = to_arrow_schema(PREPARED)
    configs = {"cleanup": cleanup, "verify": verifier, "analyze": analyzer or {"provider": "basic"}}
    classes = {kind: provider_class(kind, config["provider"]) for kind, config in configs.items() if config}  # names are known where they were registered

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clients = {kind: classes[kind](config) if kind in classes else None for kind, config in configs.items()}
        try:
            for b in batches:
                names = b.schema.names
                out = []
                for i in range(b.num_rows):
                    row = {k: b.column(j)[i].as_py() for j, k in enumerate(names)}
                    out.append(_prepared(row, clients, verifier))
                yield from pa.Table.from_pylist(out, schema=arrow).combine_chunks().to_batches()
        finally:
            for c in clients.values():
                if hasattr(c, "close"):
                    c.close()

    return rows.select("item_id", "source_path", "source_relative_path", "output_image_path", "h", "w", "n", "data").mapInArrow(run, PREPARED)


def _prepared(row: dict, clients: dict, verifier: dict | None) -> dict:
    out = {f: None for f in PREPARED.fieldNames()} | {"item_id": row["item_id"], "corrupt": True}
    if not row["h"] or row["h"] <= 0:
        return out
    orientation, icc = image_notes(read_bytes(row["source_path"], 4 << 20))
    picture = np.ascontiguousarray(oriented(pixels_of(row["data"], row["h"], row["w"], row["n"]), orientation))
    context = {"item_id": row["item_id"], "source_path": row["source_path"], "source_relative_path": row["source_relative_path"]}
    before = within_megapixels(picture[:, :, :3], 1.0, rounded=True) if verifier else None

    def ask(kind: str) -> dict:
        try:
            return with_retries(lambda: clients[kind](context | {"picture": picture}))
        except Exception as e:  # noqa: BLE001  an item's failure is a result
            out[{"cleanup": "cleanup_error", "verify": "verify_error", "analyze": "analysis_error"}[kind]] = f"{type(e).__name__}: {e}"
            return {}

    if clients["cleanup"]:
        picture = ask("cleanup").get("picture", picture)
    if clients["verify"] and out["cleanup_error"] is None:
        found = ask("verify").get("detections")
        if found is not None:
            out["detections"] = found
            out["fidelity"] = fidelity_metrics(before, picture[:, :, :3], float(verifier.get("pixel_change_threshold", 0.30)))
    seen = ask("analyze")
    rgb = picture[:, :, :3]
    brightness, contrast, sharpness = basic_metrics(rgb)
    put_bytes(row["output_image_path"], encode_png(picture, icc))
    return out | {
        "corrupt": False, "width": picture.shape[1], "height": picture.shape[0], "has_alpha": picture.shape[2] == 4, "brightness_mean": brightness, "contrast_stddev": contrast, "edge_sharpness": sharpness,
        "perceptual_hash": difference_hash(rgb), "subjects": seen.get("subjects"), "faces": seen.get("faces"),
    }


def verification(verifier: dict, override: Column) -> Column:
    """The verification's struct over fidelity, detections, width and height; override: a name by which a user approved what is left, or null."""
    limits = {k: float(verifier.get(n, d)) for k, n, d in (("ssim", "minimum_structural_similarity", 0.72), ("mae", "maximum_mean_absolute_difference", 0.12), ("changed", "maximum_changed_area_fraction", 0.20), ("aspect", "maximum_aspect_ratio_delta", 0.02), ("corr", "minimum_luminance_correlation", 0.90))}
    m, found = F.col("fidelity"), F.coalesce("detections", F.array().cast(_BOXES))
    d = fidelity_decision(m["structural_similarity"], m["luminance_correlation"], m["mean_absolute_difference"], m["changed_area_fraction"], m["aspect_ratio_delta"], F.size(found) > 0, limits)
    approved = override.isNotNull() & (d["status"] == "residual_artifact") & (F.size(d["failures"]) == 0)
    boxed = F.transform(found, lambda x: F.struct(x["label"].alias("label"), x["confidence"].alias("confidence"), *(normalized_box(x["bbox"], F.col("width"), F.col("height"))[k].alias(k) for k in ("bbox", "bbox_normalized"))))
    mode = residual_mode(verifier.get("residual_detection_mode"))
    return F.struct(
        F.when(approved, "verified_clean_override").otherwise(d["status"]).alias("status"), (approved | (d["status"] == "verified_clean")).alias("passed"), F.lit(mode).alias("residual_detection_mode"),
        F.lit(confidence_floor(verifier) if mode == "verify_residual_watermarks" else None).cast("double").alias("confidence_threshold"), boxed.alias("residual_detections"), F.size(found).alias("residual_detection_count"),
        m.alias("fidelity_metrics"), d["failures"].alias("fidelity_failures"), d["observations"].alias("fidelity_observations"), approved.alias("override_applied"),
        F.when(approved, override).alias("override_matched_name"), F.when(approved, d["status"]).alias("override_original_status"),
    )


def analysis_json(provider: str) -> Column:
    """The analysis of a prepared picture as JSON, with its detections, their counts and the box around them all."""
    boxed = lambda c: F.transform(F.coalesce(c, F.array().cast(_BOXES)), lambda x: F.struct(x["label"].alias("label"), x["confidence"].alias("confidence"), *(normalized_box(x["bbox"], F.col("width"), F.col("height"))[k].alias(k) for k in ("bbox", "bbox_normalized"))))
    subjects, faces = boxed(F.col("subjects")), boxed(F.col("faces"))
    every = F.transform(F.concat(subjects, faces), lambda x: x["bbox"])
    side = lambda f, k: f(F.transform(every, lambda x: F.get(x, F.lit(k))))
    w, h = F.col("width"), F.col("height")
    shape = F.when(w == h, "square").when(w > h, "landscape").otherwise("portrait")
    return F.to_json(F.struct(
        F.lit(provider).alias("provider"),
        F.struct(w.alias("width"), h.alias("height"), F.round(w / h, 6).alias("aspect_ratio"), shape.alias("orientation"), F.round(w * h / 1e6, 4).alias("megapixels"), "has_alpha").alias("dimensions"),
        F.struct("brightness_mean", "contrast_stddev", "edge_sharpness").alias("quality"), subjects.alias("subjects"), faces.alias("faces"),
        F.struct(F.size(subjects).alias("objects"), F.size(F.filter(subjects, lambda x: F.lower(x["label"]) == "person")).alias("persons"), F.size(faces).alias("faces")).alias("counts"),
        F.when(F.size(every) > 0, F.array(side(F.array_min, 0), side(F.array_min, 1), side(F.array_max, 2), side(F.array_max, 3))).alias("content_bounds"),
    ))


def crop_outputs(rows: DataFrame) -> DataFrame:
    """item_id, width, height, perceptual_hash after cutting the outputs (item_id, output_image_path, box) to their boxes, in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, box in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = read_bytes(path)
                cut = decode_png(data)
                if cut.shape[:2] != (box[3] - box[1], box[2] - box[0]):  # a repeated task finds it done
                    cut = crop(cut, box)
                    put_bytes(path, encode_png(cut, image_notes(data)[1]))
                out.append((cut.shape[1], cut.shape[0], difference_hash(cut[:, :, :3])))
            kinds = (pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], names=["item_id", "width", "height", "perceptual_hash"])

    return rows.select("item_id", "output_image_path", "box").mapInArrow(run, "item_id string, width int, height int, perceptual_hash long")


def prepare_clips(rows: DataFrame, config: dict, prober: dict, encoder: dict) -> DataFrame:
    """rows (item_id, source_path, source_relative_path, output_image_path) with excluded, problem, orientation and output (the probe of what was made).

    Sources are probed, those of an unwanted orientation left out, the others encoded with the filter chain for their size and probed again; an
    exact number of frames that was not met is a problem.
    """
    probed = apply_provider(rows.withColumn("path", F.col("source_path")), "probe", config | prober, _record(payload=T.StringType())).withColumnRenamed("provider_error", "probe_error")
    p = probe(F.col("payload"))
    rows = probed.select("*", p.alias("source")).drop("payload", "path")
    w, h = F.col("source.width"), F.col("source.height")
    no_stream = F.when(F.col("probe_error").isNull() & F.col("source").isNull(), F.concat(F.lit("No video stream found in "), basename(F.col("source_relative_path"))))
    side = video_orientation(w, h)
    unwanted = F.coalesce(orientation_excluded(w, h, config["orientation_filter"]), F.lit(False))
    reason = F.when(unwanted, F.concat(F.lit("Excluded "), basename(F.col("source_relative_path")), F.lit(": source is "), side, F.lit(f", filter is {config['orientation_filter']}")))
    rows = rows.select("*", side.alias("orientation"), reason.alias("excluded"), F.coalesce("probe_error", no_stream).alias("problem"), filter_chain(config, w, h).alias("filter"), target_dimensions(config, w, h).alias("target"))
    good = F.col("excluded").isNull() & F.col("problem").isNull()
    made = apply_provider(rows.where(good).select("item_id", "source_path", "output_image_path", "filter"), "encode", config | encoder, _record(encoded=T.BooleanType()))
    made = made.select("item_id", F.col("output_image_path").alias("path"), F.col("provider_error").alias("encode_error"))
    again = apply_provider(made.where("encode_error is null"), "probe", config | prober, _record(payload=T.StringType()))
    again = again.select("item_id", F.lit(None).cast("string").alias("encode_error"), F.col("provider_error").alias("again_error"), probe(F.col("payload")).alias("output"))
    failed = made.where("encode_error is not null").select("item_id", "encode_error", F.lit(None).cast("string").alias("again_error"), F.lit(None).cast(again.schema["output"].dataType).alias("output"))
    done = again.union(failed)
    frames = config["target_frame_count"]
    short = F.when((F.lit(frames) > 0) & (F.col("output.frames") != frames), F.concat(F.lit("The encoder made "), F.col("output.frames").cast("string"), F.lit(f" frames; expected exactly {frames}")))
    joined = rows.drop("probe_error").join(done.withColumnRenamed("item_id", "d_id"), F.col("item_id") == F.col("d_id"), "left")
    return joined.select("item_id", "source_path", "source_relative_path", "output_image_path", "orientation", "target", "excluded", F.coalesce("problem", "encode_error", "again_error", short).alias("problem"), "output")


def clip_frames(clips: DataFrame, config: dict, sampler: dict) -> DataFrame:
    """item_id, frames: base64 pictures at even times of the prepared clips, within the pixel budget."""
    o = F.col("output")
    size = scaled_to_budget(o["width"], o["height"], config["caption_megapixels"], "even")
    asked = clips.select("item_id", "output_image_path", size["width"].cast("int").alias("frame_width"), size["height"].cast("int").alias("frame_height"), frame_timestamps(o["duration"], o["fps"], o["frames"], config["caption_frames"]).alias("times"))
    got = apply_provider(asked, "sample", config | sampler, _record(frames=T.ArrayType(T.StringType())))
    return got.select("item_id", F.coalesce("frames", F.array().cast("array<string>")).alias("frames"))


_SEGMENT = "struct<start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double,compression_ratio:double,words:array<struct<word:string,start:double,end:double,probability:double>>>"


def transcripts(clips: DataFrame, config: dict, transcriber: dict, original: str | None, cache: str) -> DataFrame:
    """item_id, audio_evidence of prepared clips. Words come from the original film around the clip's harvested start, else from the clip's own source.

    A stretch of sound is transcribed once and kept in the cache, a Parquet folder, under a signature of its source, stretch and model.
    """
    spark = clips.sparkSession
    where = audio_evidence(stem(basename(F.col("source_relative_path"))), F.lit(config["start_time"]), F.lit(original is not None))
    length = F.greatest(F.coalesce(F.col("output.duration"), F.lit(config["duration"])), F.lit(0.01))
    rows = clips.select("item_id", "source_path", where.alias("at"), length.alias("length"))
    around = context_window(F.col("at.start"), F.col("length"))
    on_original = F.col("at.source") == "original"
    rows = rows.select(
        "item_id", F.col("at.start").alias("start"), F.col("length").alias("duration"), F.when(on_original, F.lit(original)).otherwise(F.col("source_path")).alias("source"),
        F.when(on_original, around["start"]).otherwise(0.0).alias("from"), F.when(on_original, around["duration"]).otherwise(1e6).alias("span"),
    )
    rows = rows.withColumn("signature", cache_signature(F.col("source"), F.format_string("%.3f:%.3f", "from", "span"), F.lit(config["whisper_model"]), F.lit(config["whisper_language"] or "auto")))
    wanted = rows.select("signature", "source", F.col("from").alias("start"), F.col("span").alias("duration")).distinct()
    if sinks.path_exists(spark, cache):
        _, wanted = sinks.cached(wanted, spark.read.parquet(cache))
    heard = apply_provider(wanted, "transcribe", config | transcriber, _record(segments=T.StringType(), audio_end=T.DoubleType()))
    sinks.append_cache(heard.where("provider_error is null").select("signature", "segments", "audio_end"), cache)
    kept = spark.read.parquet(cache).where("schema_version = 2").dropDuplicates(["signature"]).select("signature", "audio_end", F.posexplode(F.from_json("segments", f"array<{_SEGMENT}>")).alias("order", "s"))
    s = F.col("s")
    reasons = segment_reasons(s["avg_logprob"], s["no_speech_prob"], s["compression_ratio"], s["words"], s["end"], F.coalesce("audio_end", s["end"]))
    words = F.transform(s["words"], lambda w: F.struct(w["word"].alias("word"), w["start"].alias("start"), w["end"].alias("end")))
    segments = kept.select("signature", "order", s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), (F.size(reasons) == 0).alias("reliable"), words.alias("words"))
    out = window_transcripts(segments, rows.select(F.col("item_id").alias("clip"), "signature", "start", "duration"), "signature", 15.0)
    return out.select(F.col("clip").alias("item_id"), F.col("transcript").alias("audio_evidence"))
