import pytest
from pyspark.sql import functions as F

from sievecraft.functions.hashing import covering_masks
from sievecraft.functions.text import fixed
from sievecraft.operators import dedup, manifest, naming, validation
from sievecraft.plans.schema import COLUMNS, ITEMS, RESET, migrated
from sievecraft.sources import probe
from sievecraft.sources.sinks import Snapshots

SOURCE = "item_id string, source_path string, source_relative_path string, source_hash string, source_size long, source_mtime_ns long, output_image_path string, caption_path string, naming_sequence long"


def items(spark, *rows):
    default = {n: d for n, _, d in COLUMNS}
    return spark.createDataFrame([tuple((default | r)[n] for n, *_ in COLUMNS) for r in rows], ITEMS)


def source(spark, *rows):
    return spark.createDataFrame([(i, f"/s/{p}", p, h, 1, 1, f"d/{i}.png", f"d/{i}.txt", None) for i, p, h in rows], SOURCE)


def by_id(df):
    return {r.item_id: r for r in df.collect()}


def item(i, **more):
    return {"item_id": i, "source_relative_path": f"{i}.png", "source_hash": f"h{i}", "output_image_path": f"d/{i}.png", "caption_path": f"d/{i}.txt"} | more


def test_sync(spark):
    have = items(spark, item("a", status="complete", attempts=1, profile_version="v1", created_at="t0"), item("b", status="complete", attempts=1, profile_version="v1", error="x"), item("c", status="failed"))
    out = manifest.sync(have, source(spark, ("a", "a.png", "ha"), ("b", "b.png", "new"), ("n", "n.png", "hn")), {"profile_version": "v2", "profile_id": "p"}, now=F.lit("t1"))
    got = by_id(out)
    assert (got["a"].status, got["a"].profile_version, got["a"].profile_id, got["a"].created_at, got["a"].active) == ("complete", "v1", "p", "t0", True)
    assert (got["b"].status, got["b"].profile_version, got["b"].attempts, got["b"].error, got["b"].source_hash) == ("pending", "v2", 1, None, "new")
    assert (got["c"].active, got["c"].status) == (False, "failed")
    assert (got["n"].status, got["n"].attempts, got["n"].created_at, got["n"].active) == ("pending", 0, "t1", True)
    again = manifest.sync(out, source(spark, ("a", "a.png", "ha"), ("b", "b.png", "new"), ("n", "n.png", "hn")), {"profile_version": "v3", "profile_id": "p"}, now=F.lit("t1"))
    assert by_id(again) == got
    moved = source(spark, ("a", "a.png", "ha")).withColumn("caption_path", F.lit("elsewhere"))
    assert by_id(manifest.sync(have, moved, {}))["a"].status == "pending"
    kept = manifest.sync(have, moved, {}, preserve=spark.createDataFrame([("a",)], "item_id string"))
    assert by_id(kept)["a"].status == "complete" and by_id(kept)["a"].caption_path == "elsewhere"


def test_run_modes(spark):
    have = items(spark, item("a", status="processing"), item("b", status="failed", error="e"), item("c", status="excluded", review_status="cleanup_excluded"), item("d", status="excluded", review_status="exact_duplicate_excluded"), item("e", status="complete"), item("f", status="failed", active=False))
    status = lambda mode, rev=0, prev=None: {k: r.status for k, r in by_id(manifest.prepare_run(have, mode, rev, prev)[0]).items()}
    assert status("resume") == {"a": "pending", "b": "failed", "c": "excluded", "d": "excluded", "e": "complete", "f": "failed"}
    assert status("reprocess_failed") == {"a": "pending", "b": "pending", "c": "pending", "d": "excluded", "e": "complete", "f": "failed"}
    assert status("force_rebuild", 1) == {k: "failed" if k == "f" else "pending" for k in "abcdef"}
    assert status("force_rebuild", 1, 1)["e"] == "complete" and status("force_rebuild", 2, 1)["e"] == "pending"
    assert manifest.prepare_run(have, "force_rebuild", 2, 1)[1] == 2
    assert by_id(manifest.prepare_run(have, "resume")[0])["a"].error == "Interrupted before completion"
    for bad in (("force_rebuild", 0), ("other", 1)):
        with pytest.raises(ValueError):
            manifest.prepare_run(have, *bad)


def test_claim_mark_and_missing(spark):
    have = items(spark, item("a", source_relative_path="B.png"), item("b", source_relative_path="a.png"), item("c", status="complete"), item("d", active=False))
    assert [(r.item_id, r.status, r.attempts) for r in manifest.claim_next(have, 1).collect()] == [("b", "processing", 1)]
    ids = spark.createDataFrame([("a",)], "item_id string")
    assert by_id(manifest.mark_complete(have, ids))["a"].validation_status == "valid"
    assert by_id(manifest.mark_failed(have, ids, "x"))["a"].error == "x"
    out = manifest.mark_excluded(have, ids, "why", "exact_duplicate_excluded")
    assert by_id(out)["a"].status == "excluded" and by_id(manifest.reinstate_exact_duplicate(out, ids))["a"].status == "pending"
    assert by_id(manifest.reinstate_exact_duplicate(manifest.mark_excluded(have, ids, "why"), ids))["a"].status == "excluded"
    files = spark.createDataFrame([("d/c.png",)], "path string")
    assert by_id(manifest.reset_missing_outputs(have, files))["c"].error == "Completed output was missing"
    s = manifest.summary(have).first()
    assert (s.total, s.pending, s.complete, s.inactive, s.eligible) == (3, 2, 1, 1, 3)
    merged = manifest.apply_results(have, spark.createDataFrame([("a", "cropped_x")], "item_id string, crop_status string"))
    assert by_id(merged)["a"].crop_status == "cropped_x" and by_id(merged)["b"].crop_status == "not_requested"


def test_sequences_are_stable(spark):
    have = items(spark, item("a", naming_sequence=1), item("b", naming_sequence=2), item("z", naming_sequence=7, active=False))
    listed = source(spark, ("a", "a.png", "1"), ("aa", "aa.png", "2"), ("b", "b.png", "3"), ("ab", "AB.png", "4"))
    got = {r.item_id: r.naming_sequence for r in manifest.naming_sequences(have, listed).collect()}
    assert got == {"a": 1, "b": 2, "aa": 8, "ab": 9}
    names = {r.item_id: r.output_stem for r in naming.numbered_names(manifest.naming_sequences(have, listed), "lora").collect()}
    assert names["aa"] == "lora_0008"
    empty = manifest.naming_sequences(have.limit(0), listed.limit(0))
    assert empty.count() == 0 and naming.numbered_names(empty, "x").count() == 0


def test_stems(spark):
    df = spark.createDataFrame([("11111111aaaa", "a/photo.jpg"), ("22222222bbbb", "b/Photo.png"), ("33333333cccc", "c/photo--22222222.png"), ("44444444dddd", "d/other.png")], "item_id string, source_relative_path string")
    got = {r.item_id[:1]: r.output_stem for r in naming.output_stems(df).collect()}
    assert got["1"] == "photo" and got["4"] == "other" and len({v.lower() for v in got.values()}) == 4
    names = ["dir/a.b.png", "C:\\pics\\x?.JPG", "con.txt", "nul", "com1.png", "name . ", "...", "a/b/c.tar.gz", "clip.MP4"]
    stems = {r.n: r.s for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", naming.sidecar_stem(F.col("n")).alias("s")).collect()}
    assert stems == {"dir/a.b.png": "a.b", "C:\\pics\\x?.JPG": "x_", "con.txt": "_con.txt", "nul": "_nul", "com1.png": "_com1", "name . ": "name", "...": None, "a/b/c.tar.gz": "c.tar.gz", "clip.MP4": "clip"}


def test_duplicate_decisions(spark):
    have = items(
        spark, item("a", source_hash="x"), item("b", source_hash="x", status="complete"), item("c", source_hash="x", status="excluded", review_status="cleanup_excluded"),
        item("d", source_hash="y", status="excluded", review_status="exact_duplicate_excluded"), item("e", source_hash="z", status="excluded", review_status="exact_duplicate_excluded"),
        item("f", source_hash="z", status="excluded", review_status="exact_duplicate_excluded"), item("g", source_hash="w"), item("h", source_hash="w", active=False),
    )
    got = {r.item_id: (r.keeper_id, r.action) for r in dedup.exact_duplicate_decisions(have).collect()}
    assert got == {"a": ("b", "exclude"), "b": ("b", "keep"), "c": ("b", "none"), "d": ("d", "reinstate"), "e": ("e", "reinstate"), "f": ("e", "none"), "g": ("g", "none")}


def test_near_duplicates_are_exact_pairs(spark):
    import random

    r = random.Random(2)
    base = [r.getrandbits(64) - (1 << 63) for _ in range(60)]
    hashes = base + [b ^ sum(1 << r.randrange(63) for _ in range(r.randrange(9))) for b in base]
    df = spark.createDataFrame([(i, h, f"c{i % 100}") for i, h in enumerate(hashes)], "id long, hash long, content string")
    mask = (1 << 64) - 1
    for limit in (0, 3, 6):
        values = sorted(set(hashes))
        want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & mask).bit_count() <= limit}
        assert {(x.a, x.b) for x in dedup.near_duplicate_pairs(df, limit).collect()} == want
    groups = dedup.near_duplicate_groups(df, 6).collect()
    assert groups and all(g.group_size >= 2 and g.minimum_distance <= 6 for g in groups)


def test_fixed_decimals_round_exact_values(spark):
    """Ties in binary go to even; decimals that only look like ties go by the double that stands for them."""
    values = [k / 1e6 for k in range(500, 6_000_000, 1000)] + [0.0, 0.8125, 5.6625, 0.7715, 0.8015, 1.9995, 0.9996, 12.3456789]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed(F.col("v"), 3).alias("s")).collect()
    assert [(r.v, r.s) for r in rows if r.s != f"{r.v:.3f}"] == []


def test_masks_are_selective():
    """A mask of few bits would let a share of all pairs through, which grows with the square of the hashes."""
    for radius in (4, 5, 6, 7):
        assert min((m & (2**64 - 1)).bit_count() for m in covering_masks(radius)) >= 20


def test_near_pairs_are_not_broadcast(spark):
    """The keys of a hash are 127 times its size, which the optimiser does not see."""
    pairs = dedup.near_duplicate_pairs(spark.range(50).select(F.xxhash64("id").alias("hash")))
    pairs.collect()
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_snapshots_and_migration(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/t")
    assert store.current() == 0
    have = items(spark, item("a"))
    assert store.commit(have) == 1 and store.commit(manifest.claim_next(store.read(), 1)) == 2
    assert store.read().first().status == "processing" and store.current() == 2
    old = have.select("item_id", "status")
    assert migrated(migrated(old)).schema.simpleString() == ITEMS.simpleString() and by_id(migrated(old))["a"].crop_status == "not_requested"
    assert set(RESET) <= {n for n, *_ in COLUMNS}


def test_issues_and_overrides(spark):
    have = items(spark, item("a", status="failed", error="boom", crop_status="crop_failed"), item("b", status="excluded", review_status="exact_duplicate_excluded", output_image_path=""), item("c", status="failed", cleanup_verification_status="residual_artifact"), item("d", status="complete"))
    got = {r.item_id: (r.stage, r.reason, r.image) for r in validation.issues(have).collect()}
    assert got == {"a": ("crop", "boom", "a.png"), "b": ("duplicate_detection", "not_requested", "b.png"), "c": ("cleanup_verification", "residual_artifact", "c.png")}
    lines = spark.createDataFrame([('"A.png"',), ("# c.png",), ("- dir\\B.PNG",), ("",)], "line string")
    assert {r.item_id: r.matched_name for r in validation.override_matches(have, validation.override_keys(lines)).collect()} == {"a": "a.png", "b": "b.png"}
    p = spark.createDataFrame([('{"passed": true, "override_applied": true}',), ("bad",), (None,)], "j string").select(validation.verification_payload(F.col("j")).alias("p")).collect()
    assert p[0].p.override_applied and p[1].p.passed is None and p[2].p.passed is None


def test_audits_hold_for_no_rows(spark):
    a = validation.training_ready(validation.audits(items(spark)), F.lit(True)).first()
    assert a.watermark_audit_complete and a.analysis_audit_complete and a.crop_audit_complete and not a.training_ready


def test_probe_parses_once(spark):
    df = spark.range(1).select(probe.probe(F.concat(F.lit("{}"), F.col("id").cast("string"))).alias("p")).select("p.*")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
