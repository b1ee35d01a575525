import json

import pytest
from pyspark.sql import functions as F

from sievecraft.functions import intervals as iv
from sievecraft.operators.http_caption import HttpCaption, HttpError, available_models, error_text, message_text, within_budget
from sievecraft.operators.providers import TransientError
from sievecraft.plans import nodes
from sievecraft.sources import sinks


def test_configurations():
    p = nodes.profile("Krea 2", "style", "t", advanced_overrides='{"caption_max_words": 7}')
    assert p["settings"]["caption_max_words"] == 7
    with pytest.raises(ValueError):
        nodes.profile("Krea 2", "style", advanced_overrides="[]")
    a, b = nodes.caption_provider(model_name="m", api_key="1"), nodes.caption_provider(model_name="m", api_key="2")
    assert a[1] == b[1] and a[0]["api_key"] == "1" and a[0]["timeout"] == 120
    assert nodes.cleanup_verifier(confidence=0.1, residual_detection_mode="?")[0]["confidence"] == 0.30
    v = nodes.video_prep()[0]
    assert (v["resize_mode"], v["target_frame_count"], v["landscape_width"], v["keep_audio"]) == ("crop_to_fill", 107, 896, True)
    assert nodes.smart_crop()[0]["minimum_output_dimension"] == 512 and nodes.image_analyzer()[0]["image_size"] == 640
    assert nodes.cleanup()[0]["steps"] == 4 and nodes.cleanup(steps=99)[0]["steps"] == 50 and nodes.caption_provider(backend="Kobold")[0]["api_url"] == "http://localhost:5001/v1"
    for bad in (
        lambda: nodes.caption_provider(model_name=" "), lambda: nodes.caption_provider(backend="x"), lambda: nodes.source(" "), lambda: nodes.cleanup(vae=" "), lambda: nodes.cleanup(speed=1),
        lambda: nodes.builder(None, {}, {}, "d", output_naming_mode="lora_name_numbered"), lambda: nodes.video_prep(encoder_preset="x"), lambda: nodes.video_prep(whisper_device="x"),
    ):
        with pytest.raises(ValueError):
            bad()
    assert nodes.run_summary('{"training_ready": true}')[0].startswith("TRAINING READY")
    with pytest.raises(ValueError):
        nodes.run_summary("[]")


def test_http_captions():
    sent = []

    def server(url, payload, headers, timeout):
        sent.append((url, payload, headers))
        return {"choices": [{"message": {"content": [{"text": " a "}, {"text": "cat"}]}}]}

    client = HttpCaption({"backend": "NanoGPT", "model_name": "m", "nanogpt_key": "k", "seed": 3}, server)
    assert client({"instruction": "say", "image": "AAAA"}) == {"caption": "a cat"}
    url, payload, headers = sent[0]
    assert url.endswith("/chat/completions") and payload["seed"] == 3 and headers["X-API-Key"] == "k" and payload["messages"][1]["content"][1]["image_url"]["url"].startswith("data:image/png")
    client({"instruction": "say", "frames": ["x", "y"]})
    assert len(sent[1][1]["messages"][1]["content"]) == 3

    def old(url, payload, headers, timeout):
        if url.endswith("/chat/completions") or url.endswith("/models"):
            raise HttpError(404)
        return {"models": [{"name": "b"}, {"name": "a"}]} if payload is None else {"message": {"content": "", "reasoning": " seen "}}

    assert HttpCaption({"model_name": "m"}, old)({"instruction": "i", "image": "x"}) == {"caption": "seen"}
    assert available_models({}, old) == ["a", "b"]

    def broken(code):
        def f(*_):
            raise HttpError(code, b'{"error": {"message": "too much"}}')

        return HttpCaption({"model_name": "m", "backend": "Kobold"}, f)

    with pytest.raises(TransientError, match="too much"):
        broken(429)({"instruction": "i", "image": "x"})
    with pytest.raises(RuntimeError, match="HTTP 400 from Kobold. too much"):
        broken(400)({"instruction": "i", "image": "x"})
    assert error_text("X", HttpError(500, b"no json")) == "Caption request failed: HTTP 500 from X" and message_text({}) == ""


def test_frames_shrink_to_the_budget():
    tried = []

    def encode(frame, quality, scale):
        tried.append((quality, round(scale, 2)))
        return b"x" * int(1000 * quality * scale**2)

    out = within_budget([1, 2], encode, budget=100_000)
    assert sum(map(len, out)) <= 100_000 and tried[0] == (90, 1.0) and tried[-1][1] < 1
    with pytest.raises(ValueError):
        within_budget([1], lambda *_: b"x" * 10_000, budget=10)


def test_caches_and_evidence(spark, tmp_path):
    requests = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "signature string, clip int")
    sinks.append_cache(spark.createDataFrame([("a", "text")], "signature string, transcript string"), f"{tmp_path}/cache")
    sinks.append_cache(spark.createDataFrame([("b", "old")], "signature string, transcript string"), f"{tmp_path}/cache", schema_version=1)
    hit, miss = sinks.cached(requests, spark.read.parquet(f"{tmp_path}/cache"))
    assert [(r.signature, r.transcript) for r in hit.collect()] == [("a", "text")] and sorted(r.signature for r in miss.collect()) == ["b", "c"]
    assert sinks.harvest_source(None) is None and sinks.harvest_source(json.dumps({"source_video": "v"})) == "v"
    with pytest.raises(ValueError):
        sinks.harvest_source("x")
    rows = spark.createDataFrame([("c_t0000002000", True), ("c_t0000002000", False), ("c", True)], "s string, o boolean").select(iv.audio_evidence(F.col("s"), F.lit(0.5), F.col("o")).alias("e")).collect()
    assert [tuple(r.e) for r in rows] == [("original", 2.5), ("clip", 0.5), ("clip", 0.5)]
