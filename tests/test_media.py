import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievecraft.functions import geometry as geo
from sievecraft.functions import hashing
from sievecraft.functions import intervals as iv
from sievecraft.operators import pixels, providers, quality, validation
from sievecraft.plans.profiles import ProfileRegistry, merged
from sievecraft.operators import captioning
from sievecraft.plans.report import assessment, display_lines, guidance, report_json, text_summary
from sievecraft.sources import files, probe, sinks, stores
from sievecraft.sources.sinks import write_report, write_sidecars
from sievecraft.streaming.ingest import ingest_available, new_files

REG = ProfileRegistry()


def crop(spark, w, h, boxes, settings):
    df = spark.createDataFrame([(w, h, boxes)], "w int, h int, b array<array<double>>")
    return df.select(geo.crop_decision(F.col("w"), F.col("h"), F.col("b"), settings).alias("c")).first().c


def test_crop_keeps_the_person(spark):
    s = {"crop_strategy": "identity_preserving", "allowed_aspect_ratios": ["1:1"], "crop_max_removed_fraction": 0.5}
    c = crop(spark, 1600, 900, [[500.0, 50.0, 1100.0, 850.0]], s)
    assert c.status == "cropped_identity_preserving" and c.output_dimensions == [900, 900]
    assert c.crop_box[0] <= 500 and c.crop_box[2] >= 1100


def test_crop_refusals(spark):
    style = REG.recipe("krea2", "style")["settings"]
    assert crop(spark, 2000, 500, [], style).status == "skipped_crop_safety_limits"
    assert crop(spark, 1024, 1024, [], style).status == "not_needed_allowed_aspect"
    person = REG.recipe("krea2", "character")["settings"]
    assert crop(spark, 1600, 1000, [], person).status == "skipped_no_protected_subjects"
    assert crop(spark, 1600, 1000, [[0.0, 0.0, 50.0, 50.0], [1500.0, 900.0, 1600.0, 1000.0]], person).status == "skipped_crop_safety_limits"


@pytest.mark.parametrize("w,h,want", [(320, 240, (96, 64)), (240, 320, (64, 96)), (300, 300, (96, 64))])
def test_video_planning(spark, w, h, want):
    cfg = probe.video_config({"resize_mode": "stretch", "size_strategy": "normalize_by_orientation", "landscape_width": 96, "landscape_height": 64, "portrait_width": 64, "portrait_height": 96, "target_frame_count": 13, "fps": 6})
    row = spark.createDataFrame([(w, h)], "w int, h int").select(geo.target_dimensions(cfg, F.col("w"), F.col("h")).alias("d"), geo.filter_chain(cfg, F.col("w"), F.col("h")).alias("f")).first()
    assert tuple(row.d) == want and row.f == f"fps=6,scale={want[0]}:{want[1]}:flags=lanczos,tpad=stop_mode=clone:stop_duration=2.16667"


def test_video_config():
    a, b = probe.video_config({"resize_mode": "keep_native", "width": 10}), probe.video_config({"resize_mode": "keep_native", "width": 99})
    assert hashing.config_version(a) == hashing.config_version(b) and a["width"] == 0
    assert probe.video_config({"target_frame_count": 48})["duration"] == 2.0 and probe.video_config({"width": 101})["width"] == 100
    for bad in ({"resize_mode": "x"}, {"size_strategy": "normalize_by_orientation"}, {"orientation_filter": "x"}):
        with pytest.raises(ValueError):
            probe.video_config(bad)
    assert geo.crop_offsets("top_left") == ("0", "0") and geo.crop_offsets("center") == ("(iw-ow)/2", "(ih-oh)/2") and geo.crop_offsets("right") == ("iw-ow", "(ih-oh)/2")


def test_probe(spark):
    rows = [{"streams": [{"width": 10, "height": 20, "avg_frame_rate": "30000/1001", "nb_frames": "5", "tags": {"rotate": "0"}, "side_data_list": [{}, {"rotation": -90}]}], "format": {"duration": "1.5"}}, {"streams": []}, {"streams": [{"width": 4, "height": 2, "avg_frame_rate": "25/0"}]}]
    got = [r.p for r in spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(probe.probe(F.col("j")).alias("p")).collect()]
    assert tuple(got[0]) == (20, 10, -90, 29.97003, 5, 1.5) and got[1] is None and tuple(got[2]) == (4, 2, 0, 25.0, 0, 0.0)


def test_transcripts(spark):
    kind = "s array<struct<start:double,end:double,text:string,reliable:boolean,words:array<struct<word:string,start:double,end:double>>>>"
    segs = [(260.0, 262.0, "early", None, None), (264.0, 266.0, "one", True, None), (269.0, 273.0, "two", None, []), (266.0, 267.0, "bad", False, None), (268.0, 275.0, "x", True, [(" in", 268.0, 269.0), (" out", 274.0, 275.0)])]
    df = spark.createDataFrame([(segs,)], kind)
    assert df.select(iv.transcript_for_window(F.col("s"), F.lit(265.0), F.lit(5.0)).alias("t")).first().t == "one two in"
    w = spark.range(1).select(iv.context_window(F.lit(3170.0), F.lit(107 / 24)).alias("w")).first().w
    assert tuple(w) == (3165.0, 15.0)
    names = spark.createDataFrame([("clip_t0000003170",), ("a_t0000001500_b",), ("t123",)], "n string").select(iv.harvested_start(F.col("n")).alias("t")).collect()
    assert [r.t for r in names] == [3.17, 1.5, None]


def test_reliability(spark):
    kind = "lp double, ns double, cr double, w array<struct<word:string,probability:double>>, e double"
    rows = [(-0.75, 0.1, 1.0, [("a", 0.9)], 5.0), (-2.7, 0.1, 1.0, [("a", 0.12)], 5.0), (None, None, None, [(" ", 0.0)], 99.0)]
    got = [r.r for r in spark.createDataFrame(rows, kind).select(iv.segment_reasons(F.col("lp"), F.col("ns"), F.col("cr"), F.col("w"), F.col("e"), F.lit(60.0)).alias("r")).collect()]
    assert got == [[], ["low_segment_probability", "low_word_probability"], ["low_segment_probability", "probable_non_speech", "repetitive_transcript", "timestamp_outside_audio"]]


def gradient(h=96, w=96):
    x = np.linspace(0, 255, w)[None, :] * np.ones((h, 1))
    return np.stack([x, x, x], axis=2).astype(np.uint8)


def test_hash_and_metrics():
    a = gradient()
    b = a.copy()
    b[10, 10] = 255 - b[10, 10]
    assert pixels.difference_hash(a) == -1  # rises everywhere
    assert bin((pixels.difference_hash(a) ^ pixels.difference_hash(b)) & (2**64 - 1)).count("1") <= 6
    assert pixels.basic_metrics(np.full((4, 4, 3), 10, np.uint8)) == (10.0, 0.0, 0.0)
    assert pixels.basic_metrics(np.array([[[0, 0, 0], [255, 255, 255]]], np.uint8))[2] == 255.0


def test_a_tonal_shift_is_only_observed(spark):
    before = gradient() // 2
    m = pixels.fidelity_metrics(before, before + 52)
    assert m["luminance_correlation"] > 0.99 and m["mean_absolute_difference"] > 0.12
    d = spark.range(1).select(geo.fidelity_decision(*(F.lit(m[k]) for k in ("structural_similarity", "luminance_correlation", "mean_absolute_difference", "changed_area_fraction", "aspect_ratio_delta")), F.lit(False)).alias("d")).first().d
    assert d.status == "verified_clean" and d.observations == ["mean_absolute_difference_tolerated_as_global_tonal_change"]
    noise = np.random.default_rng(1).integers(0, 255, before.shape, dtype=np.uint8)
    assert pixels.fidelity_metrics(before, noise, ssim=True)["structural_similarity"] < 0.3
    assert pixels.structural_similarity(before[:, :, 0] / 255, before[:, :, 0] / 255) == pytest.approx(1.0)
    assert pixels.correlation(np.zeros(4), np.zeros(4)) == 1.0 and pixels.correlation(np.zeros(4), np.ones(4)) == 0.0
    assert pixels.fidelity_metrics(before, before[:, ::2])["aspect_ratio_delta"] == 0.5


def decode_png(data):
    """height, width, channels and bytes of an unfiltered PNG."""
    w, h = (int.from_bytes(data[16 + 4 * k : 20 + 4 * k]) for k in (0, 1))
    n = 4 if data[25] == 6 else 3
    at, body = 8, b""
    while at < len(data):
        size, kind = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
        body += data[at + 8 : at + 8 + size] * (kind == b"IDAT")
        at += 12 + size
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)[:, 1:].reshape(h, w, n)


def test_media_folder(spark, tmp_path):
    root = tmp_path / "src"
    for name, data in (("a/one.png", pixels.encode_png(gradient(20, 30))), ("b/Two.PNG", pixels.encode_png(gradient(16, 16))), ("bad.png", b"not a picture"), ("skip/x.png", b"y"), ("note.txt", "\ufeff a caption \n".encode()), ("a/one.txt", b"first")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    found = files.discover(spark, str(root), excluded=("skip",))
    rows = {r.relative_path: r for r in found.collect()}
    assert set(rows) == {"a/one.png", "b/Two.PNG", "bad.png"} and all(len(r.item_id) == 24 for r in rows.values())
    assert {r.relative_path for r in files.discover(spark, str(root), recursive=False).collect()} == {"bad.png"}
    captions = {r.relative_path: r.source_caption for r in files.with_source_captions(found, files.sidecars(spark, str(root))).collect()}
    assert captions == {"a/one.png": "first", "b/Two.PNG": None, "bad.png": None}
    assert files.listing(spark, str(root)).count() == 6
    images = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{png,PNG}").load(str(root))
    seen = {r.path.rsplit("/", 1)[-1]: r for r in pixels.analyze_images(images).collect()}
    assert (seen["one.png"].width, seen["one.png"].height, seen["one.png"].perceptual_hash) == (30, 20, -1) and seen["bad.png"].corrupt
    png = {r.path.rsplit("/", 1)[-1]: r.png for r in pixels.to_png(images).collect()}
    assert (decode_png(bytes(png["one.png"])) == gradient(20, 30)).all() and "bad.png" not in png
    assert pixels.crop(gradient(20, 30), [2, 3, 12, 9]).shape == (6, 10, 3)


def test_streaming_takes_new_files_once(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    for n in ("a", "b"):
        (root / f"{n}.png").write_bytes(n.encode())
    run = lambda: ingest_available(new_files(spark, str(root)), out, str(tmp_path / "ck"))
    run()
    (root / "c.png").write_bytes(b"c")
    run()
    rows = spark.read.parquet(out).collect()
    assert sorted(r.relative_path for r in rows) == ["a.png", "b.png", "c.png"] and len({r.batch for r in rows}) == 2


def test_sidecars_and_report(spark, tmp_path):
    rows = spark.createDataFrame([("a", "one\n"), ("b", None)], "stem string, text string")
    folder = f"file://{tmp_path}/d"
    assert all(r.written for r in write_sidecars(rows, folder).collect())
    assert not any(r.written for r in write_sidecars(rows, folder, "skip").collect())
    assert (tmp_path / "d/a.txt").read_bytes() == b"one\n" and len(list((tmp_path / "d").glob("*.txt"))) == 2
    write_report(spark.createDataFrame([(1, "x")], "n int, s string"), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"n": 1, "s": "x"}


def test_providers(spark):
    rows = spark.createDataFrame([("a", "tok"), ("b", None)], "item_id string, trigger string")
    out = providers.apply_provider(rows, "caption", {"provider": "template", "template": "{trigger} {item_id}"}, T.StructType([T.StructField("caption", T.StringType())])).collect()
    assert [(r.caption, r.provider_error) for r in out] == [("tok a", None), ("None b", None)]
    out = providers.apply_provider(rows, "caption", {"provider": "template", "template": "{missing}"}, T.StructType([T.StructField("caption", T.StringType())])).collect()
    assert all(r.caption is None and "KeyError" in r.provider_error for r in out)
    with pytest.raises(ValueError):
        providers.provider_class("caption", "nobody")
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise providers.TransientError
        return "ok"

    assert providers.with_retries(flaky, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    assert providers.model_ids({"models": [{"name": "b"}, {"name": "A"}, {"name": "b"}, {}]}) == ["A", "b"]
    assert providers.FixedDetections({"confidence": 0.1, "detections": {"a": [{"confidence": 0.2}, {"confidence": 0.4}]}})({"item_id": "a"}) == {"detections": [{"confidence": 0.4}]}
    assert providers.residual_mode("x") == "trust_klein" and providers.residual_mode(None) == "trust_klein"
    p = REG.recipe("krea2", "style", "tok", {"additional_caption_instructions": "Mind the light."})
    text = captioning.caption_instruction(p)
    assert "single_paragraph" in text and p["settings"]["caption_instruction"] in text and "Maximum length: 120 words" in text and text.endswith("Mind the light.")
    video = captioning.caption_instruction(REG.recipe("minimax_h3", "style", "tok"), "video")
    assert '"tok"' in video and "Dataset type: style" in video and "No trigger word" in captioning.caption_instruction(REG.recipe("minimax_h3", "style"), "video")
    retry = captioning.retry_instruction
    assert retry("a", 0) == "a" != retry("a", 1) != retry("a", 2) == retry("a", 5)
    assert REG.recipe("anima", "style", "t")["settings"]["official_tag_order"][0] == "quality_meta_year_safety"


def test_profiles():
    p = REG.recipe("Krea 2", "Character", " t ", {"caption_max_words": 9, "new": {"a": 1}})
    assert p["settings"]["caption_max_words"] == 9 and p["settings"]["crop_strategy"] == "identity_preserving" and p["trigger"] == "t" and p["profile_id"] == "krea2:character"
    assert p["profile_version"] != REG.recipe("krea2", "character", "t")["profile_version"] == REG.recipe("krea2", "character", "t")["profile_version"]
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert hashing.config_version({"a": 1, "api_key": "s"}, ("api_key",)) == hashing.config_version({"a": 1})
    for bad in (("nope", "style"), ("krea2", "nope")):
        with pytest.raises(ValueError):
            REG.recipe(*bad)


def test_quality_rules(spark):
    kind = "media_exists boolean, is_video boolean, width int, height int, brightness_mean double, contrast_stddev double, edge_sharpness double, caption_exists boolean, caption_words long, duplicate_caption boolean, removed_area_fraction double"
    rows = [
        (True, False, 96, 96, 10.0, 5.0, 1.0, True, 5, False, 0.0), (False, False, None, None, None, None, None, False, 0, False, None), (True, True, None, None, None, None, None, True, 200, True, None),
        (True, False, 1024, 1024, 100.0, 50.0, 9.0, True, 5, False, 0.32), (True, False, 1024, 1024, 240.0, None, None, True, 110, False, 0.31),
    ]
    got = [(r.score, r.warnings) for r in quality.item_quality(spark.createDataFrame(rows, kind), REG.recipe("krea2", "character")["settings"]).collect()]
    assert got == [
        (33, ["low_resolution", "low_megapixels", "very_dark", "low_contrast", "low_edge_detail"]), (0, ["media_missing", "caption_missing"]),
        (0, ["video_metadata_missing", "media_missing", "duplicate_caption", "caption_over_profile_limit"]), (95, ["crop_near_profile_limit"]), (88, ["very_bright"]),
    ]


def test_report_parts():
    assert assessment(False, 0, 0, 0, 0, 1, 100) == "NOT_READY" and assessment(True, 0, 0, 0, 0, 0, 0) == "GOOD"
    assert assessment(True, 1, 0, 0, 0, 9, 100) == assessment(True, 0, 0, 0, 3, 10, 100) == assessment(True, 0, 0, 0, 0, 10, 79) == "REVIEW_RECOMMENDED"
    assert guidance(REG.recipe("krea2", "character"), 2, 1, 1) == ["krea_character_trigger_missing", "krea_1024_bucket_source_coverage_incomplete", "krea_character_recurring_descriptors", "krea_caption_recipe_revision_mixed"]
    assert guidance(REG.recipe("krea2", "style"), 2, 1, 1) == ["krea_1024_bucket_source_coverage_incomplete"] and guidance(REG.recipe("anima", "style"), 2, 1, 1) == []
    issue = {"image": "a", "source_image": "b", "status": "failed", "stage": "crop", "reason": "r", "residual_detections": [{"label": "l", "confidence": 0.5, "bbox_normalized": [0, 0, 1, 1]}] * 5}
    text = text_summary({"complete": 1, "eligible": 2, "failed": 1, "issues": [issue] * 2})
    assert text.startswith("ATTENTION REQUIRED\nMedia: images\nEligible pairs: 1/2 complete") and text.count("- [FAILED] a (source: b) (crop): r") == 2 and text.count("2 additional hit(s)") == 2
    lines = display_lines("\n".join(["- " + "word " * 40] * 60))
    assert len(lines) == 73 and lines[-1].startswith("\u2026") and all(len(x) <= 84 for x in lines[:-1]) and lines[1].startswith("  word")


def test_expected_sizes(spark):
    cfg = probe.video_config({"resize_mode": "crop_to_fill", "size_strategy": "normalize_by_orientation"})
    df = spark.createDataFrame([(640, 480, None), (640, 480, "portrait")], "w int, h int, o string")
    assert [tuple(r.e) for r in df.select(validation.expected_video_size(F.col("w"), F.col("h"), cfg, F.col("o")).alias("e")).collect()] == [(896, 512), (512, 896)]


def test_boxes(spark):
    df = spark.createDataFrame([([-5.0, 10.0, 120.0, 5.0], 100, 50)], "b array<double>, w int, h int")
    n = df.select(geo.normalized_box(F.col("b"), F.col("w"), F.col("h")).alias("n")).first().n
    assert n.bbox == [0.0, 10.0, 100.0, 10.0] and n.bbox_normalized == [0.0, 0.2, 1.0, 0.2]
    assert df.select(geo.union_box(F.array().cast("array<array<double>>")).alias("u")).first().u is None


def test_report_of_the_tables(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    from sievecraft.plans.queries import KREA, _report

    report = _report(spark, "/root/testdata/sf0.001")
    shown = report_json(report, KREA, "now", most_listed=7)
    assert shown["assessment"] == "REVIEW_RECOMMENDED" and shown["counts"]["eligible"] <= shown["counts"]["active"] and len(shown["quality"]["warning_items"]) == 7 and len(shown["review"]["failed"]) == 7
    assert set(shown) == {"schema_version", "generated_at", "assessment", "training_ready", "counts", "duplicates", "quality", "captions", "training_handoff", "guidance", "naming", "distribution", "review"}
    assert "Training guidance:" in text_summary({"dataset_report": shown})


def test_paths():
    assert stores.normalized_path('"a/../b"', "/x") == "/x/b" and stores.normalized_path("s3a://b/c/") == "s3a://b/c" and stores.is_within("/a/b", "/a") and not stores.is_within("/ab", "/a")
    with pytest.raises(ValueError):
        stores.normalized_path("  ")


def test_large_files_are_streamed(spark, tmp_path, monkeypatch):
    import hashlib

    (tmp_path / "a.png").write_bytes(b"x" * 3_000_000)
    (tmp_path / "b.png").write_bytes(b"y")
    monkeypatch.setattr(files, "CELL_BYTES", 1_000_000)
    got = {r.relative_path: r.content_hash for r in files.discover(spark, str(tmp_path)).collect()}
    assert got == {"a.png": hashlib.sha256(b"x" * 3_000_000).hexdigest(), "b.png": hashlib.sha256(b"y").hexdigest()}
    assert ".avif" in files.image_suffixes(True) and ".avif" not in files.image_suffixes()


def test_commands(monkeypatch):
    monkeypatch.setattr(providers, "tool", lambda name, config: name)
    config = probe.video_config({"target_frame_count": 48, "keep_audio": True, "start_time": 1})
    command = providers.encode_command({"source_path": "s", "filter": "f"}, config, "t")
    assert command[command.index("-t") + 1] == "2.000000000" and command[-1] == "t" and "aac" in command and command[command.index("-ss") + 1] == "1.000000"
    assert "-an" in providers.encode_command({"source_path": "s", "filter": "f"}, probe.video_config({}), "t") and "pan=mono|c0=0.5*c0+0.5*c1+1.0*c2" in providers.dialogue_command("s", 0, 1, {}, 6)
    with pytest.raises(RuntimeError):
        providers.run_command(["false"])


def test_original_video(tmp_path):
    (tmp_path / "film.mkv").write_bytes(b"f")
    assert sinks.original_video(str(tmp_path)) is None
    (tmp_path / sinks.CLIP_MANIFEST).write_text(json.dumps({"source_video": str(tmp_path / "film.mkv")}))
    assert sinks.original_video(str(tmp_path)) == str(tmp_path / "film.mkv")
    with pytest.raises(FileNotFoundError):
        sinks.original_video(str(tmp_path), str(tmp_path / "gone.mkv"))


def test_overlap_join_matches_nested_loops(spark):
    import random

    from sievecraft.operators.overlap import overlap_join

    r = random.Random(6)
    make = lambda n: [(i, i % 3, s, s + r.choice([0.0, 0.5, 3.0, 40.0, -1.0])) for i in range(n) for s in [float(r.randrange(-50, 200))]] + [(n, 0, None, 3.0)]
    a, b = make(60), make(50)
    kind = "id long, k long, start double, `end` double"
    got = sorted((x.l_id, x.r_id) for x in overlap_join(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), "k", 7.0).collect())
    ok = lambda x: x[2] is not None and x[3] >= x[2]
    assert got == sorted((x[0], y[0]) for x in a for y in b if ok(x) and ok(y) and x[1] == y[1] and x[3] >= y[2] and x[2] <= y[3])
