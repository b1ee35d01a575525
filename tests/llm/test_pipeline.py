import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
SMALL = "/root/testdata/sf0.001"
pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("name", ["odd_docs", "no_docs"])
def test_stages_on_odd_rows(spark, request, name, tmp_path):
    docs = request.getfixturevalue(name)
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_run_packs_what_the_stages_keep(spark):
    rows = pipeline.run(spark, SMALL).collect()
    assert rows and all(r.n_tokens <= r.bucket_tokens for r in rows)
    ids = {r.doc_id for r in rows}
    text = {r.doc_id: (r.text or "").lower() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    kept = [text[i] for i in ids]
    assert len(set(kept)) == len(kept)


def test_run_matches_brute_force(spark, prose, tmp_path):
    """Every stage redone in plain Python from the stage's definition, on texts with copies, near copies, insults and nulls."""
    import random
    from collections import Counter, defaultdict

    import numpy as np
    from test_mixing_and_packing import brute_rate, water_fill

    from sievecraft.llm import simhash, toxicity

    r = random.Random(3)
    rows = [(x.doc_id, x.text, x.lang, x.source, x.n_chars) for x in prose.collect()]
    rows += [(5_000 + i, rows[i][1].upper(), "en", "s1", 1) for i in range(20)] + [(6_000, None, "en", None, None), (6_001, "", None, "s2", 0)]
    insulted = [(7_000 + i, " ".join([*rows[i][1].split()[:40], r.choice(["idiot", "scum"]), f"u{i}"]), "en", "s3", 1) for i in range(40)]
    docs = spark.createDataFrame(rows + insulted, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(d, 0, int(d >= 7_000)) for d, *_ in rows[::3] + insulted], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()

    from pyspark.sql import functions as F

    score = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id")))).scorer()
    kept = [x for x in rows + insulted if score((x[1] or "").encode()) < 0.5]
    assert sum(x[0] >= 7_000 for x in kept) < 10 and sum(x[0] < 7_000 for x in kept) > 0.9 * len(rows)
    first = {}
    for x in sorted(kept):
        first.setdefault((x[1] or "").lower(), x)
    kept = list(first.values())
    sets = [set(simhash.shingle_set((x[1] or "").encode(), 5).tolist()) for x in kept]
    root = list(range(len(kept)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(kept)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)), key=lambda k: kept[k][0])
                root[b] = a
    kept = [x for i, x in enumerate(kept) if find(i) == i]
    size = {x[0]: len((x[1] or "").split()) for x in kept}
    copies = Counter(x.doc_id for x in got)
    assert set(copies) <= set(size) and all(x.n_tokens == size[x.doc_id] for x in got)
    by = defaultdict(list)
    for x in kept:
        by[x[3]].append(x[0])
    targets = water_fill({s: sum(size[d] for d in ids) for s, ids in by.items()})
    for s, ids in by.items():
        rates = brute_rate([size[d] for d in ids], targets[s])
        for d, rate in zip(ids, rates):
            rate = 1.0 if size[d] == 0 else rate
            assert np.floor(rate - 1e-6) <= copies[d] <= min(2, np.ceil(rate + 1e-6))
        assert abs(sum(copies[d] * size[d] for d in ids) - targets[s]) <= max(size[d] for d in ids) + 1
    ends = sorted({x.bucket_tokens for x in got})
    lengths = Counter(x.n_tokens for x in got)
    assert set(ends) <= set(lengths) and all(x.bucket_tokens == min(e for e in ends if e >= x.n_tokens) for x in got)
    tops = sorted(lengths)
    before = np.concatenate([[0], np.cumsum([lengths[t] for t in tops])])
    layer = np.array(tops) * before[1:]
    for _ in range(15):
        layer = np.array([min([layer[j], *(layer[:j] + tops[j] * (before[j + 1] - before[1 : j + 1]))]) for j in range(len(tops))])
    assert sum(x.bucket_tokens for x in got) == layer[-1]


def test_entry_works_without_these_folders(tmp_path):
    """A copy of the repository without them still imports and registers the other queries."""
    import shutil

    shutil.copytree(ROOT / "sievecraft", tmp_path / "sievecraft", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q); assert set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_every_operator_is_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)
