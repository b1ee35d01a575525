import base64
import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from sievecraft.operators.http_caption import HttpCaption
from sievecraft.operators.pixels import decode_png, encode_png, image_notes, oriented
from sievecraft.operators.providers import register
from sievecraft.plans import nodes
from sievecraft.plans.engine import CurationRun, check_media
from sievecraft.plans.profiles import ProfileRegistry
from sievecraft.plans.report import text_summary
from sievecraft.sources import sinks

REG = ProfileRegistry()
PROFILE = REG.recipe("krea2", "style", "subject_token")


def picture(n, size=64):
    return encode_png(np.full((size, size, 3), n, np.uint8))


def put(folder, **names):
    for name, data in names.items():
        p = folder / name.replace("__", "/").replace("_png", ".png").replace("_txt", ".txt").replace("_jpg", ".jpg")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)


def engine(spark, tmp_path, **more):
    return CurationRun(spark, str(tmp_path / "src"), str(tmp_path / "out"), PROFILE, now="t", **more)


def test_resume_change_and_removal(spark, tmp_path):
    src, data = tmp_path / "src", tmp_path / "out/dataset"
    put(src, a_png=picture(1), b_png=picture(2), sub__c_png=picture(3), b_txt=b"a red barn")
    r = engine(spark, tmp_path).run(max_items=2)
    assert (r["complete"], r["pending"], r["processed_this_run"]) == (2, 1, 2)
    r = engine(spark, tmp_path).run()
    assert (r["complete"], r["pending"], r["processed_this_run"]) == (3, 0, 1)
    assert engine(spark, tmp_path).run()["processed_this_run"] == 0
    assert (data / "b.txt").read_text() == "subject_token, a red barn" and (data / "a.txt").read_text() == "subject_token"
    assert sorted(p.name for p in data.iterdir()) == ["a.png", "a.txt", "b.png", "b.txt", "c.png", "c.txt"]
    put(src, a_png=picture(9))  # new content, same item
    (data / "c.txt").unlink()  # a lost output
    r = engine(spark, tmp_path).run()
    assert r["processed_this_run"] == 2 and r["complete"] == 3
    rows = {x.source_relative_path: x for x in engine(spark, tmp_path).items().collect()}
    assert rows["a.png"].attempts == 2 and rows["b.png"].attempts == 1 and rows["b.png"].caption_status == "copied_source_with_trigger"
    (data / "stray.txt").write_text("x")
    (src / "b.png").unlink()
    r = engine(spark, tmp_path).run()
    assert (r["total"], r["inactive"], r["quarantined"], r["orphans"]) == (2, 1, 2, 1)
    assert json.loads((tmp_path / "out/reports/run_report.json").read_text())["run"]["complete"] == 2


def test_copies_failures_and_collisions(spark, tmp_path):
    src = tmp_path / "src"
    put(src, a_png=picture(1), b_png=picture(1), x__p_png=picture(5), y__p_png=picture(6), bad_png=b"no picture")
    put(src, x__p_txt=b"a room without windows")
    r = engine(spark, tmp_path).run()
    assert (r["excluded"], r["failed"], r["complete"]) == (1, 2, 2)
    issues = {x.source_image: (x.stage, x.reason) for x in engine(spark, tmp_path).run() and _issues(spark, tmp_path)}
    assert issues["b.png"][0] == "duplicate_detection" and issues["bad.png"] == ("analysis", "Validation failed: image_corrupt") and issues["x/p.png"][1] == "Validation failed: absence_language"
    stems = sorted(p.stem for p in (tmp_path / "out/dataset").glob("*.png"))
    assert stems[0] == "a" and stems[1] == "p" and stems[2].startswith("p--") and len(stems) == 3
    assert len(list((tmp_path / "out/review/duplicates/exact").iterdir())) == 1
    (src / "a.png").unlink()  # the copy takes its place
    r = engine(spark, tmp_path).run()
    assert (r["excluded"], r["complete"]) == (0, 2)


def _issues(spark, tmp_path):
    from sievecraft.operators.validation import issues

    return issues(engine(spark, tmp_path).items()).collect()


def test_numbering_and_rebuild(spark, tmp_path):
    put(tmp_path / "src", a_png=picture(1), b_png=picture(2))
    run = lambda name, **k: engine(spark, tmp_path, numbered_name=name).run(**k)
    run("one")
    put(tmp_path / "src", aa_png=picture(3))
    run("one")
    names = lambda: {x.source_relative_path: x.output_image_path.rsplit("/", 1)[-1] for x in engine(spark, tmp_path).items().collect()}
    assert names() == {"a.png": "one_0001.png", "b.png": "one_0002.png", "aa.png": "one_0003.png"}
    assert run("two")["processed_this_run"] == 0 and set(names().values()) == {f"two_000{k}.png" for k in (1, 2, 3)}
    with pytest.raises(ValueError):
        run("two", mode="force_rebuild")
    assert run("two", mode="force_rebuild", revision=1)["processed_this_run"] == 3
    assert run("two", mode="force_rebuild", revision=1)["processed_this_run"] == 0


def test_a_provider_writes_captions(spark, tmp_path):
    put(tmp_path / "src", a_png=picture(1))
    r = engine(spark, tmp_path, caption_provider={"provider": "template", "template": "{trigger}, a plain wall"}).run()
    assert r["complete"] == 1 and (tmp_path / "out/dataset/a.txt").read_text() == "subject_token, a plain wall"


def test_media_and_profiles_agree():
    check_media(PROFILE, "images")
    for profile, media in ((PROFILE, "videos"), (REG.recipe("minimax_h3", "style"), "images"), (REG.recipe("anima", "style"), "images")):
        with pytest.raises(ValueError):
            check_media(profile, media)


def test_keys_of_providers_are_never_written(spark, tmp_path):
    put(tmp_path / "src", a_png=picture(1))
    config = {"provider": "template", "template": "{trigger}, a plain wall", "api_key": "s3cr3t-one", "nanogpt_key": "s3cr3t-two", "openrouter_key": "s3cr3t-three"}
    a = engine(spark, tmp_path, caption_provider=config)
    a.run()
    assert a.items().first().caption_provider_version == engine(spark, tmp_path, caption_provider=config | {"api_key": "other"}).versions["caption_provider_version"]
    for p in (tmp_path / "out").rglob("*"):
        if p.is_file():
            assert b"s3cr3t" not in p.read_bytes(), p
    for r in a.items().collect():
        assert "s3cr3t" not in str(r)


def noisy(seed, h=900, w=1400):
    return np.random.default_rng(seed).integers(0, 255, (h, w, 3), dtype=np.uint8)


def smooth(seed, h=900, w=1400):
    y, x = np.mgrid[0:h, 0:w]
    waves = [127 + 120 * np.sin(x / (90 + 20 * seed) + k) * np.cos(y / (70 + 10 * seed)) for k in range(3)]
    return np.stack(waves, axis=2).astype(np.uint8)


def test_cleanup_verification_analysis_and_crop(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    put(src, good_png=encode_png(smooth(1)), marked_png=encode_png(smooth(2)), approved_png=encode_png(smooth(3)), spoilt_png=encode_png(smooth(4)), broken_png=encode_png(smooth(5)))
    person = [{"label": "Person", "confidence": 0.9, "bbox": [500.0, 100.0, 700.0, 800.0]}]
    mark = [{"label": "logo", "confidence": 0.8, "bbox": [0.0, 0.0, 90.0, 45.0]}]
    ids = {r.source_relative_path: r.item_id for r in engine(spark, tmp_path).discover(engine(spark, tmp_path).items()).collect()}
    run = engine(
        spark, tmp_path, cleanup_provider={"provider": "fill_boxes", "boxes": {"spoilt.png": [[0, 0, 1300, 900]]}},
        cleanup_verifier={"provider": "fixed_detections", "residual_detection_mode": "verify_residual_watermarks", "detections": {ids["marked.png"]: mark, ids["approved.png"]: mark}},
        analysis_provider={"provider": "fixed_boxes", "subjects": {n: person for n in ids} | {"broken.png": "error"}}, crop_provider={"provider": "profile_safe_crop"}, override_lines=["# mine", "- approved.png"],
    )
    run.profile = REG.recipe("krea2", "character", "subject_token")
    status = run.run()
    rows = {r.source_relative_path: r for r in run.items().collect()}
    good = rows["good.png"]
    assert (good.status, good.watermark_status, good.cleanup_verification_status, good.analysis_status, good.crop_status) == ("complete", "verified_clean", "verified_clean", "analyzed_fixed_boxes", "cropped_identity_preserving")
    plan = json.loads(good.crop_json)
    assert decode_png((out / "dataset/good.png").read_bytes()).shape[:2] == (plan["output_dimensions"][1], plan["output_dimensions"][0]) == (900, 1200)
    assert json.loads(good.analysis_json)["counts"] == {"objects": 1, "persons": 1, "faces": 0} and json.loads(good.analysis_json)["content_bounds"] == [500.0, 100.0, 700.0, 800.0]
    marked = rows["marked.png"]
    assert (marked.status, marked.review_status, marked.watermark_status) == ("excluded", "cleanup_excluded", "residual_artifact")
    evidence = list((out / "review/cleanup_verification").glob(f"{marked.item_id}-*/verification.json"))
    assert len(evidence) == 1 and json.loads(evidence[0].read_text())["residual_detection_count"] == 1 and (evidence[0].parent / "marked.png").is_file() and not (out / "dataset/marked.png").exists()
    assert rows["approved.png"].status == "complete" and json.loads(rows["approved.png"].cleanup_verification_json)["override_matched_name"] == "approved.png"
    assert rows["spoilt.png"].status == "excluded" and "changed_area_fraction_above_limit" in rows["spoilt.png"].cleanup_verification_json
    assert (rows["broken.png"].status, rows["broken.png"].analysis_status) == ("failed", "analysis_failed") and "detector failed" in rows["broken.png"].error
    assert status["cleanup_override_applied_count"] == 1 and status["residual_detection_mode"] == "verify_residual_watermarks" and not status["training_ready"]
    shown = {i["image"]: i for i in status["issues"]}
    assert shown["marked.png"]["residual_detections"][0]["bbox_normalized"] == [0.0, 0.0, 0.064286, 0.05] and shown["marked.png"]["review_directory"].endswith(evidence[0].parent.name)
    text = text_summary(status)
    assert text.startswith("ATTENTION REQUIRED") and "Detector: logo at 80.0% confidence; region x 0.0%" in text and "Cleanup overrides: 1" in text and "DATASET REPORT" in text


def test_a_verifier_that_fails_calls_for_review(spark, tmp_path):
    put(tmp_path / "src", a_png=picture(1))
    run = engine(spark, tmp_path, cleanup_verifier={"provider": "fixed_detections", "detections": {"error": "no model"}})
    run.run()
    r = run.items().first()
    assert (r.status, r.review_status, r.cleanup_verification_status) == ("failed", "cleanup_review_required", "verification_failed") and "no model" in r.error
    missing = engine(spark, tmp_path, cleanup_provider={"provider": "klein9b_universal_cleanup"})
    with pytest.raises(Exception, match="register one"):
        missing.run("reprocess_failed")


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test module


@register("caption", "sequence")
class Sequence:
    """A caption by the wording of the instruction: wrong at first, then right or never."""

    def __init__(self, config):
        pass

    def __call__(self, row):
        tries = 0 if "affirmative" not in row["instruction"] else 1 if "fresh" in row["instruction"] else 2
        plans = {"a.png": ["A room without windows", "A bright room"], "b.png": ["A red barn"], "c.png": ["No one is there"] * 3, "d.png": ["Not a cat", "Nothing", "A grey cat"]}
        got = plans[row["source_relative_path"]]
        return {"caption": got[min(tries, len(got) - 1)]}


def test_captions_are_asked_for_again(spark, tmp_path):
    put(tmp_path / "src", **{f"{n}_png": picture(k) for k, n in enumerate("abcd")})
    run = engine(spark, tmp_path, caption_provider={"provider": "sequence"})
    status = run.run()
    rows = {r.source_relative_path: r for r in run.items().collect()}
    assert {k: (r.status, r.caption_status) for k, r in rows.items()} == {
        "a.png": ("complete", "generated_after_validation_retry"), "b.png": ("complete", "generated"), "c.png": ("failed", "not_started"), "d.png": ("complete", "generated_after_validation_retry"),
    }
    assert (tmp_path / "out/dataset/d.txt").read_text() == "subject_token, A grey cat" and rows["c.png"].error == "Caption failed: absence_language" and status["failed_this_run"] == 1


class Server:
    """A chat server that keeps what it is sent."""

    sent: list = []

    def __call__(self, url, payload, headers, timeout):
        Server.sent.append((url, payload))
        return {"choices": [{"message": {"content": "A plain wall"}}]}


def test_the_chat_provider_gets_the_picture(spark, tmp_path):
    (tmp_path / "big.png").write_bytes(encode_png(noisy(1, 1100, 1000)))
    client = HttpCaption({"backend": "NanoGPT", "model_name": "m"}, Server())
    assert client({"instruction": "i", "image_path": str(tmp_path / "big.png")}) == {"caption": "A plain wall"}
    url = Server.sent[-1][1]["messages"][1]["content"][1]["image_url"]["url"]
    shape = decode_png(base64.b64decode(url.split(",")[1])).shape
    assert shape[0] * shape[1] <= 1_000_000 and shape[:2] == (1048, 953)
    client({"instruction": "i", "frames": ["AA", "BB"], "audio_evidence": "hello there"})
    assert [c["type"] for c in Server.sent[-1][1]["messages"][1]["content"]] == ["text", "text", "image_url", "image_url"]
    old = HttpCaption({"model_name": "m"}, Server())
    old.close()
    assert Server.sent[-1][0].endswith("/api/generate") and Server.sent[-1][1]["keep_alive"] == 0


def payload(w, h, frames=107, fps="24/1", duration="4.458333"):
    return {"streams": [{"width": w, "height": h, "avg_frame_rate": fps, "nb_frames": str(frames)}], "format": {"duration": duration}}


def test_videos_through_stand_ins(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    names = ("wide_t0000002000.mp4", "tall.mp4", "short.mp4", "none.mp4")
    for n in names:
        (src / n).parent.mkdir(parents=True, exist_ok=True)
        (src / n).write_bytes(n.encode())
    (tmp_path / "film.mkv").write_bytes(b"film")
    words = lambda t, *w: {"start": t, "end": t + 1, "text": " ".join(w), "avg_logprob": -0.1, "no_speech_prob": 0.0, "compression_ratio": 1.0, "words": [{"word": f" {x}", "start": t + 0.1 * i, "end": t + 0.1 * i + 0.05, "probability": 0.9} for i, x in enumerate(w)]}
    probes = {"wide_t0000002000.mp4": payload(896, 512), "tall.mp4": payload(512, 896), "short.mp4": payload(896, 512, 50)}
    profile = REG.recipe("minimax_h3", "concept", "tok")
    run = lambda **k: CurationRun(
        spark, str(src), str(out), profile, now="t", media_type="videos", prober={"provider": "fixed_payloads", "payloads": probes}, encoder={"provider": "copy"}, sampler={"provider": "none"},
        transcriber={"provider": "fixed_segments", "segments": {"film.mkv": [words(2.5, "hello", "there"), words(40.0, "late")], "tall.mp4": [words(0.5, "other")]}},
        video={"resize_mode": "crop_to_fill", "size_strategy": "normalize_by_orientation", "target_frame_count": 107, "transcribe_audio": True, "original_video_path": str(tmp_path / "film.mkv"), "orientation_filter": k.pop("wanted", "both")},
        caption_provider={"provider": "template", "template": "A slow pan over a wall while someone says {audio_evidence}"}, **k)
    a = run()
    status = a.run()
    rows = {r.source_relative_path: r for r in a.items().collect()}
    wide = rows["wide_t0000002000.mp4"]
    assert (wide.status, wide.watermark_status, wide.analysis_status, wide.crop_status) == ("complete", "skipped_video", "skipped_video", "cropped_ffmpeg")
    assert (out / "dataset/wide_t0000002000.txt").read_text() == "tok, A slow pan over a wall while someone says hello there"
    assert (out / "dataset/tall.txt").read_text().endswith("says other") and (out / "dataset/tall.mp4").read_bytes() == b"tall.mp4"
    assert json.loads(wide.analysis_json)["video"]["source_orientation"] == "landscape" and json.loads(wide.crop_json)["settings"]["landscape_width"] == 896
    assert rows["short.mp4"].error == "The encoder made 50 frames; expected exactly 107" and "No video stream" in rows["none.mp4"].error
    assert status["media_type"] == "videos" and (status["complete"], status["failed"]) == (2, 2) and spark.read.parquet(f"{out}/transcripts").count() == 2
    assert json.loads(nodes.validator(spark, str(out), profile))["media_type_counts"]["video"] == 4
    only = run(wanted="portrait_only")
    only.run("force_rebuild", 1)
    rows = {r.source_relative_path: r for r in only.items().collect()}
    assert rows["tall.mp4"].status == "complete" and (rows["wide_t0000002000.mp4"].status, rows["wide_t0000002000.mp4"].review_status) == ("excluded", "orientation_filtered")
    assert rows["wide_t0000002000.mp4"].error == "Excluded wide_t0000002000.mp4: source is landscape, filter is portrait_only"


def test_moves_go_back_together(spark, tmp_path):
    put(tmp_path / "d", a_png=b"1", a_txt=b"2", b_png=b"3")
    (tmp_path / "d/taken").write_bytes(b"")
    d = str(tmp_path / "d")
    moves = [("a", f"{d}/a.png", f"{d}/x.png"), ("a", f"{d}/a.txt", f"{d}/taken/x.txt"), ("b", f"{d}/b.png", f"{d}/new/y.png"), ("c", f"{d}/none", f"{d}/z")]
    df = spark.createDataFrame(moves, "item_id string, src string, dst string")
    got = {r.item_id: (r.moved, r.ok) for r in sinks.move_files(df, together=True).collect()}
    assert got == {"a": (0, False), "b": (1, True), "c": (0, True)}
    assert (tmp_path / "d/a.png").read_bytes() == b"1" and (tmp_path / "d/new/y.png").read_bytes() == b"3" and not (tmp_path / "d/x.png").exists()


def test_nodes_run_and_report(spark, tmp_path):
    put(tmp_path / "src", a_png=encode_png(noisy(1)), b_png=encode_png(noisy(1) // 2), c_png=encode_png(noisy(2)))
    put(tmp_path / "src", a_txt=b"a wall of coloured dots", b_txt=b"A wall of  coloured dots", c_txt=b"a second wall")
    source = nodes.source(str(tmp_path / "src"), spark=spark)
    assert source["discovered"] == 3
    seen = []
    status, root = nodes.builder(spark, source, PROFILE, str(tmp_path / "out"), output_naming_mode="lora_name_numbered", name="dots", progress=seen.append, now="t")
    assert root.endswith("/manifest/items") and [p["status"] for p in seen] == ["running", "running", "complete"] and seen[-1]["total"] == 3
    report = json.loads(status)["dataset_report"]
    assert report["counts"] == {"active": 3, "eligible": 3, "failed": 0, "excluded": 0, "media_types": {"image": 3}} and report["naming"]["lora_names"] == ["dots"] and report["naming"]["sequence_maximum"] == 3
    assert report["duplicates"]["near_duplicate_groups"] == [{"minimum_distance": report["duplicates"]["near_duplicate_groups"][0]["minimum_distance"], "images": ["dots_0001.png", "dots_0002.png"]}]
    assert report["duplicates"]["duplicate_caption_groups"] == [["dots_0001.png", "dots_0002.png"]] and report["quality"]["warning_counts"]["duplicate_caption"] == 2
    assert json.loads((tmp_path / "out/reports/dataset_report.json").read_text()) == report and report["training_handoff"]["target_bucket_resolution"] == 1024
    text, issues, again = nodes.run_summary(status)
    assert "Group 1 (distance" in text and issues == "[]" and json.loads(again) == report and "Stable numbered pairs: 3 (sequence 1\u20133)" in text
    assert nodes.app_report(spark, status, str(tmp_path / "r.png")) == text and (tmp_path / "r.png").read_bytes().startswith(b"\x89PNG")
    checked = json.loads(nodes.validator(spark, str(tmp_path / "out"), PROFILE))
    assert checked["valid"] and checked["items"] == 3 and checked["orphan_images"] == [] and [r["valid"] for r in checked["item_results"]] == [True] * 3
    with pytest.raises(FileNotFoundError):
        nodes.validator(spark, str(tmp_path / "nowhere"), PROFILE)


def test_turns_alpha_and_profiles_are_kept(spark, tmp_path):
    rgba = np.dstack([noisy(1, 40, 60), np.full((40, 60), 128, np.uint8)])
    icc = b"profile bytes" * 20
    put(tmp_path / "src", alpha_png=encode_png(rgba, icc))
    engine(spark, tmp_path).run()
    data = (tmp_path / "out/dataset/alpha.png").read_bytes()
    assert (decode_png(data) == rgba).all() and image_notes(data) == (1, icc)
    tiff = b"II*\0\x08\0\0\0" + b"\x01\0" + b"\x12\x01\x03\0\x01\0\0\0\x06\0\0\0" + b"\0\0\0\0"
    segment = lambda kind, body: b"\xff" + kind + (len(body) + 2).to_bytes(2, "big") + body
    jpeg = b"\xff\xd8" + segment(b"\xe1", b"Exif\0\0" + tiff) + segment(b"\xe2", b"ICC_PROFILE\0\x02\x02bc") + segment(b"\xe2", b"ICC_PROFILE\0\x01\x02a") + b"\xff\xda"
    assert image_notes(jpeg) == (6, b"abc") and image_notes(jpeg[:30]) == (1, None) and image_notes(b"GIF89a") == (1, None)
    a = np.arange(6).reshape(2, 3, 1)
    assert oriented(a, 6)[:, :, 0].tolist() == [[3, 0], [4, 1], [5, 2]] and oriented(a, 8)[:, :, 0].tolist() == [[2, 5], [1, 4], [0, 3]] and oriented(a, 3)[:, :, 0].tolist() == [[5, 4, 3], [2, 1, 0]]
    assert oriented(a, 2)[:, :, 0].tolist() == [[2, 1, 0], [5, 4, 3]] and oriented(a, 4)[:, :, 0].tolist() == [[3, 4, 5], [0, 1, 2]] and oriented(a, 5)[:, :, 0].tolist() == [[0, 3], [1, 4], [2, 5]] and oriented(a, 7)[:, :, 0].tolist() == [[5, 2], [4, 1], [3, 0]]
    with pytest.raises(ValueError):
        decode_png(b"\x89PNG\r\n\x1a\n")
