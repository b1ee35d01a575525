"""Pluggable model providers: one client per partition, rows in Arrow batches.

A provider is a class made from a configuration dict; its method takes and returns plain values. The ones registered here need no model; others are
registered by name.
"""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

KINDS = ("caption", "cleanup", "verify", "analyze", "crop", "transcribe", "probe", "encode", "sample")
_REGISTRY: dict[tuple[str, str], type] = {}
# Replies worth another attempt.
TRANSIENT_HTTP = (408, 425, 429, 500, 502, 503, 504)


class TransientError(Exception):
    """A failure that may pass: a time-out, a broken connection or one of TRANSIENT_HTTP."""


def register(kind: str, name: str) -> Callable[[type], type]:
    if kind not in KINDS:
        raise ValueError(f"Unknown provider kind: {kind}")

    def put(cls: type) -> type:
        _REGISTRY[kind, name] = cls
        return cls

    return put


def provider_class(kind: str, name: str) -> type:
    if (kind, name) not in _REGISTRY:
        raise ValueError(f"Unknown {kind} provider: {name}")
    return _REGISTRY[kind, name]


def with_retries(call: Callable, attempts: int = 3, sleep: Callable[[float], None] = time.sleep):
    """The call's result; transient failures are tried again after 1, 2, 4, 4 ... seconds."""
    for n in range(attempts):
        try:
            return call()
        except TransientError:
            if n + 1 == attempts:
                raise
            sleep(min(4.0, 2.0**n))


def apply_provider(rows: DataFrame, kind: str, config: dict, output: T.StructType, attempts: int = 3) -> DataFrame:
    """rows with the provider's output columns and provider_error. A row that fails has nulls and the error; the others go on."""
    cls = provider_class(kind, config["provider"])
    schema = T.StructType([*rows.schema.fields, *output.fields, T.StructField("provider_error", T.StringType())])
    names, arrow = rows.columns, to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = cls(config)
        try:
            for b in batches:
                done = []
                for row in b.to_pylist():
                    try:
                        got = with_retries(lambda row=row: client(row), attempts)
                        done.append({f.name: got.get(f.name) for f in output.fields} | {"provider_error": None})
                    except Exception as e:  # noqa: BLE001  an item's failure is a result
                        done.append({f.name: None for f in output.fields} | {"provider_error": f"{type(e).__name__}: {e}"})
                more = [pa.array([d[n] for d in done], arrow.field(n).type) for n in arrow.names[len(names) :]]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], names=arrow.names)
        finally:
            if hasattr(client, "close"):
                client.close()

    return rows.mapInArrow(run, schema)


@register("caption", "template")
class TemplateCaption:
    """A caption from the row's own columns; stands in for a model."""

    def __init__(self, config: dict) -> None:
        self.template = config.get("template", "{trigger}")

    def __call__(self, row: dict) -> dict:
        return {"caption": self.template.format(**row)}


# The least confidence at which a residual mark counts.
MINIMUM_CONFIDENCE = 0.30


def confidence_floor(config: dict) -> float:
    return max(MINIMUM_CONFIDENCE, float(config.get("confidence", MINIMUM_CONFIDENCE)))


@register("verify", "fixed_detections")
class FixedDetections:
    """The configured detections of at least the confidence floor, unless the mode trusts the clean-up; stands in for a detector."""

    def __init__(self, config: dict) -> None:
        self.floor = confidence_floor(config)
        self.trusting = config.get("residual_detection_mode") == "trust_klein"
        self.found = config.get("detections", {})

    def __call__(self, row: dict) -> dict:
        if "error" in self.found:
            raise RuntimeError(self.found["error"])
        return {"detections": [] if self.trusting else [d for d in self.found.get(row["item_id"], []) if d["confidence"] >= self.floor]}


@register("analyze", "basic")
class BasicAnalysis:
    """No detections; the metrics of the picture are taken anyway."""

    def __init__(self, config: dict) -> None:
        pass

    def __call__(self, row: dict) -> dict:
        return {"subjects": [], "faces": []}


@register("analyze", "fixed_boxes")
class FixedBoxes:
    """The configured subjects and faces by the source's relative path (lists of label, confidence, bbox); stands in for a detector."""

    def __init__(self, config: dict) -> None:
        self.subjects, self.faces = config.get("subjects", {}), config.get("faces", {})

    def __call__(self, row: dict) -> dict:
        at = row["source_relative_path"]
        if self.subjects.get(at) == "error":
            raise RuntimeError("detector failed")
        return {"subjects": self.subjects.get(at, []), "faces": self.faces.get(at, [])}


class _Yolo:
    """Detections of ultralytics models, which are loaded once per client; needs that package and model files by path."""

    def __init__(self, config: dict) -> None:
        try:
            from ultralytics import YOLO
        except ImportError as e:
            raise RuntimeError("This provider needs the ultralytics package; register another one to do without") from e
        self.config, self.make, self.models = config, YOLO, {}

    def detect(self, field: str, picture, label: str | None) -> list[dict]:
        name = str(self.config.get(field) or "none")
        if name.lower() == "none":
            return []
        if name not in self.models:
            self.models[name] = self.make(name)
        found = self.models[name].predict(source=picture[:, :, 2::-1], conf=float(self.config.get("confidence", 0.3)), imgsz=int(self.config.get("image_size", 640)), device=self.config.get("device", "cpu"), verbose=False)
        boxes = found[0].boxes if found else None
        return [] if boxes is None else [{"label": label or str(found[0].names.get(int(b.cls[0]))), "confidence": round(float(b.conf[0]), 6), "bbox": [float(x) for x in b.xyxy[0]]} for b in boxes]


@register("analyze", "ultralytics")
class YoloAnalysis(_Yolo):
    def __call__(self, row: dict) -> dict:
        return {"subjects": self.detect("subject_model", row["picture"], None), "faces": self.detect("face_model", row["picture"], "face")}


@register("verify", "ultralytics_cleanup_verifier")
class YoloVerifier:
    """Residual marks by a detector; without one in the mode that trusts the clean-up."""

    def __init__(self, config: dict) -> None:
        self.yolo = _Yolo(config | {"confidence": confidence_floor(config)}) if residual_mode(config.get("residual_detection_mode")) == "verify_residual_watermarks" else None

    def __call__(self, row: dict) -> dict:
        return {"detections": self.yolo.detect("watermark_model", row["picture"], None) if self.yolo else []}


@register("cleanup", "unchanged")
class UnchangedCleanup:
    """Gives the picture back; stands in for a model."""

    def __init__(self, config: dict) -> None:
        pass

    def __call__(self, row: dict) -> dict:
        return {"picture": row["picture"]}


@register("cleanup", "fill_boxes")
class FillBoxes:
    """Fills the configured boxes (left, top, right, bottom by the source's relative path) with their surroundings' mean; stands in for a model."""

    def __init__(self, config: dict) -> None:
        self.boxes = config.get("boxes", {})

    def __call__(self, row: dict) -> dict:
        picture = row["picture"].copy()
        for left, top, right, bottom in self.boxes.get(row["source_relative_path"], []):
            picture[top:bottom, left:right] = picture.reshape(-1, picture.shape[2]).mean(axis=0)
        return {"picture": picture}


@register("cleanup", "klein9b_universal_cleanup")
class DiffusionCleanup:
    """Names the diffusion clean-up of a configuration; its runtime is registered in its place where there is one."""

    def __init__(self, config: dict) -> None:
        raise RuntimeError("Clean-up by diffusion needs a model runtime; register one as ('cleanup', 'klein9b_universal_cleanup')")


@register("transcribe", "fixed_segments")
class FixedSegments:
    """The configured segments of a source; stands in for a speech model."""

    def __init__(self, config: dict) -> None:
        self.segments = config.get("segments", {})

    def __call__(self, row: dict) -> dict:
        return {"segments": json.dumps(self.segments.get(os.path.basename(row["source"]), []))}


@register("transcribe", "whisper")
class WhisperTranscriber:
    """Segments with word times by openai-whisper from a mono window of the sound; needs that package and ffmpeg."""

    def __init__(self, config: dict) -> None:
        try:
            import whisper
        except ImportError as e:
            raise RuntimeError("Transcription needs the openai-whisper package; register another provider to do without") from e
        self.whisper, self.config, self.model = whisper, config, None

    def __call__(self, row: dict) -> dict:
        if self.model is None:
            device = self.config.get("whisper_device", "auto")
            self.model = self.whisper.load_model(self.config["whisper_model"], device=None if device == "auto" else device)
        audio = run_command(dialogue_command(row["source"], row["start"], row["duration"], self.config))
        import numpy as np

        sound = np.frombuffer(audio, np.int16).astype(np.float32) / 32768
        got = self.model.transcribe(sound, language=self.config.get("whisper_language") or None, condition_on_previous_text=False, word_timestamps=True, temperature=0.0, hallucination_silence_threshold=1.0)
        shift = row["start"]
        moved = [s | {"start": s["start"] + shift, "end": s["end"] + shift, "words": [w | {"start": w["start"] + shift, "end": w["end"] + shift} for w in s.get("words", [])]} for s in got["segments"]]
        return {"segments": json.dumps(moved), "audio_end": shift + len(sound) / 16000}

    def close(self) -> None:
        self.model = None


def tool(name: str, config: dict) -> str:
    """The path of ffmpeg or a tool beside it: as configured, else on the search path."""
    given = str(config.get("ffmpeg_path") or "").strip()
    beside = os.path.join(os.path.dirname(given), name) if given else None
    found = given if given and name == "ffmpeg" else beside if beside and os.path.isfile(beside) else shutil.which(name)
    if not found or not os.path.isfile(found):
        raise RuntimeError(f"{name} was not found")
    return found


def run_command(command: list[str]) -> bytes:
    done = subprocess.run(command, capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"{os.path.basename(command[0])} failed: {done.stderr.decode(errors='replace').strip()[-2000:] or done.returncode}")
    return done.stdout


def dialogue_command(source: str, start: float, duration: float, config: dict, channels: int = 2) -> list[str]:
    """Sound of a window as 16 kHz mono samples; of three channels and more the centre, where speech is, has full weight."""
    mix = ["-af", "pan=mono|c0=0.5*c0+0.5*c1+1.0*c2"] if channels >= 3 else ["-af", "pan=mono|c0=0.5*c0+0.5*c1"] if channels == 2 else ["-ac", "1"]
    return [tool("ffmpeg", config), "-nostdin", "-loglevel", "error", "-ss", f"{start:.6f}", "-i", source, "-t", f"{duration:.6f}", "-map", "0:a:0", *mix, "-ar", "16000", "-f", "s16le", "-"]


def probe_command(source: str, config: dict) -> list[str]:
    entries = "stream=width,height,avg_frame_rate,nb_frames:stream_tags=rotate:stream_side_data=rotation:format=duration"
    return [tool("ffprobe", config), "-v", "error", "-select_streams", "v:0", "-show_entries", entries, "-of", "json", source]


def encode_command(row: dict, config: dict, target: str) -> list[str]:
    """The encoder's arguments for a source, its filter chain and a video configuration."""
    command = [tool("ffmpeg", config), "-nostdin", "-hide_banner", "-loglevel", "error", "-y", "-ss", f"{config['start_time']:.6f}", "-i", row["source_path"], "-map", "0:v:0"]
    command += ["-map", "0:a?"] if config["keep_audio"] else []
    command += ["-vf", row["filter"], "-c:v", "libx264", "-preset", config["encoder_preset"], "-crf", str(config["crf"]), "-pix_fmt", "yuv420p"]
    frames = config["target_frame_count"]
    command += ["-frames:v", str(frames), "-t", f"{frames / config['fps']:.9f}"] if frames else ["-t", f"{config['duration']:.6f}"]
    command += ["-c:a", "aac", "-ac", "2", "-b:a", "192k"] if config["keep_audio"] else ["-an"]
    return [*command, "-movflags", "+faststart", target]


@register("probe", "ffprobe")
class FfprobeRunner:
    def __init__(self, config: dict) -> None:
        self.config = config

    def __call__(self, row: dict) -> dict:
        return {"payload": run_command(probe_command(row["path"], self.config)).decode()}


@register("probe", "fixed_payloads")
class FixedPayloads:
    """The configured payload of a file by its name; stands in for a probe."""

    def __init__(self, config: dict) -> None:
        self.payloads = config.get("payloads", {})

    def __call__(self, row: dict) -> dict:
        name = os.path.basename(row["path"])
        if name not in self.payloads:
            raise RuntimeError(f"No video stream found in {name}")
        return {"payload": json.dumps(self.payloads[name])}


@register("encode", "ffmpeg")
class FfmpegEncoder:
    """Prepares a clip under a temporary name and renames it."""

    def __init__(self, config: dict) -> None:
        self.config = config

    def __call__(self, row: dict) -> dict:
        folder, _, name = row["output_image_path"].rpartition("/")
        os.makedirs(folder, exist_ok=True)
        temp = f"{folder}/.{name}.{os.getpid()}.tmp.mp4"
        try:
            run_command(encode_command(row, self.config, temp))
            os.replace(temp, row["output_image_path"])
        finally:
            if os.path.exists(temp):
                os.remove(temp)
        return {"encoded": True}


@register("encode", "copy")
class CopyEncoder:
    """Copies the clip; stands in for an encoder."""

    def __init__(self, config: dict) -> None:
        pass

    def __call__(self, row: dict) -> dict:
        from sievecraft.sources.stores import put_bytes, read_bytes

        put_bytes(row["output_image_path"], read_bytes(row["source_path"]))
        return {"encoded": True}


@register("sample", "ffmpeg")
class FfmpegFrames:
    """Frames at the given times as base64 PNGs of the given size."""

    def __init__(self, config: dict) -> None:
        self.config = config

    def __call__(self, row: dict) -> dict:
        import base64

        scale = f"scale={row['frame_width']}:{row['frame_height']}:flags=lanczos"
        command = lambda t: [tool("ffmpeg", self.config), "-nostdin", "-loglevel", "error", "-ss", f"{t:.6f}", "-i", row["output_image_path"], "-frames:v", "1", "-vf", scale, "-f", "image2pipe", "-c:v", "png", "-"]
        return {"frames": [base64.b64encode(run_command(command(t))).decode() for t in row["times"]]}


@register("sample", "none")
class NoFrames:
    def __init__(self, config: dict) -> None:
        pass

    def __call__(self, row: dict) -> dict:
        return {"frames": []}


def residual_mode(mode: str | None) -> str:
    return mode if mode in ("trust_klein", "verify_residual_watermarks") else "trust_klein"


def model_ids(payload: dict) -> list[str]:
    """Distinct names of a model listing (data or models; name, id or model), sorted without regard to case."""
    rows = payload.get("data") or payload.get("models") or []
    found = {str(r.get("id") or r.get("name") or r.get("model") or "") if isinstance(r, dict) else str(r) for r in rows}
    return sorted(found - {""}, key=str.casefold)


_MODELS = "struct<data:array<struct<id:string,name:string,model:string>>,models:array<struct<id:string,name:string,model:string>>>"


def listed_models(payload: Column) -> Column:
    """model_ids for a column of payloads whose entries are objects."""
    p = F.from_json(payload, _MODELS)
    entries = F.coalesce(F.when(F.size(p["data"]) > 0, p["data"]), p["models"], F.array().cast("array<struct<id:string,name:string,model:string>>"))
    names = F.array_distinct(F.filter(F.transform(entries, lambda m: F.coalesce(m["id"], m["name"], m["model"], F.lit(""))), lambda x: x != ""))
    return F.transform(F.array_sort(F.transform(names, lambda x: F.struct(F.lower(x).alias("key"), x.alias("name")))), lambda x: x["name"])
