import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sievecraft.llm import exact_dedup as ex
from sievecraft.llm import simhash as sh

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def norm(t):
    return (t or "").encode().translate(LOWER)


def brute_exact(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        best = (max if keep == "largest" else min)(ids) if ids else None
        out.append((i, best, len(groups[norm(t)]), hashlib.sha256(norm(t)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("name", ["odd_docs", "prose", "no_docs"])
def test_exact_matches_brute_force(request, keep, name):
    docs = request.getfixturevalue(name)
    got = ex.exact_dedup(docs, keep=keep).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_exact(rows, keep)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({norm(t) for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_a_group_over_many_buckets_is_added_up(spark):
    docs = spark.createDataFrame([(i, "Copy" if i % 3 else f"own {i}") for i in range(900)], "doc_id long, text string")
    got = ex.exact_dedup(docs, keep="smallest", buckets_per_partition=40)
    sizes = {r.keep_id: r.group_size for r in got.where("kept").collect()}
    assert sizes[1] == 600 and len(sizes) == 301


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_copies_of_one_identifier_spread_over_buckets(spark, keep):
    """Rows with null or one repeated identifier and equal text, a third of the table each, and still one row stays."""
    rows = [(None, "Copy"), (7, "copy"), (7, "Other"), (None, "nulls only")] * 300 + [(i, f"own {i % 50}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    splitters = ex.sample_splitters(docs, ex.ascii_lower(docs.text), docs.doc_id, 160, docs.count())
    assert len({y for p, x, y in splitters if p == "copy"}) > 3  # so the group's rows lie in several buckets
    got = ex.exact_dedup(docs, keep=keep, buckets_per_partition=40).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_exact(rows, keep)
    kept = [(r.keep_id, r.text_sha256) for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({norm(t) for _, t in rows})


def test_carry_returns_whole_rows(odd_docs):
    out = ex.exact_dedup(odd_docs, carry=True).where("kept").select("row.*")
    assert out.columns == odd_docs.columns
    assert {norm(r.text) for r in out.collect()} == {norm(r.text) for r in odd_docs.collect()}


@given(st.text(max_size=200))
@settings(max_examples=60, deadline=None)
def test_fingerprint_by_its_definition(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text.encode("utf-8", "replace").decode()))]
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    assert sh.fingerprint(text.encode("utf-8", "replace")) == want


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_cover_the_radius(radius):
    import itertools
    import random

    masks = [m & (2**64 - 1) for m in sh.covering_masks(radius)]
    assert len(masks) == 2 ** (radius + 1) - 1
    r = random.Random(1)
    pairs = itertools.combinations(range(64), radius) if radius < 3 else (r.sample(range(64), radius) for _ in range(20_000))
    for bits in pairs:
        flip = sum(1 << b for b in bits)
        assert any(m & flip == 0 for m in masks)


def components(fps, radius, linked=None):
    """Smallest id reachable; fps: list of (id, fingerprint)."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x] = parent[parent[x]]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    best = defaultdict(list)
    for i, (d, _) in enumerate(fps):
        best[find(i)].append(d)
    return [min((x for x in best[find(i)] if x is not None), default=None) for i in range(len(fps))]


@pytest.mark.parametrize("name", ["odd_docs", "prose", "no_docs"])
@pytest.mark.parametrize("block", [3, 4096])
def test_near_duplicates_match_brute_force(request, name, block):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, sh.fingerprint((r.text or "").encode())) for r in docs.select("doc_id", "text").collect()]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(rows, components(rows, 4))), key=str)
    got = sorted((tuple(r) for r in sh.near_duplicates(docs, block=block).collect()), key=str)
    assert got == want


def test_chains_and_large_buckets(spark):
    """A chain of single-bit steps is one component, through buckets split into blocks."""
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, 40)
    chain = [int(base[0])]
    for k in range(60):
        chain.append(chain[-1] ^ (1 << (k % 63)))
    fps = sorted({*chain, *map(int, base)})
    distinct = spark.createDataFrame([(f,) for f in fps], "fp long")
    from sievecraft.operators.components import connected_components

    got = {r.node: r.component for r in connected_components(sh.fingerprint_links(distinct, 4, block=2)).collect()}
    mask = 2**64 - 1
    want = components([(f, f & mask) for f in fps], 4)
    assert [got.get(f, f) for f in fps] == [min(x for x in fps if want[fps.index(x)] == w) for w in want]


def jaccard(a, b, n=5):
    def shingles(t):
        w = norm(t).split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("block", [2, 4096])
def test_similar_texts_are_grouped_and_others_left(spark, block):
    import random

    r = random.Random(9)
    words = [f"v{i}" for i in range(3000)]
    texts, near = {}, []
    for i in range(60):
        w = [r.choice(words) for _ in range(r.randint(150, 400))]
        texts[i] = " ".join(w)
        for k in range(2):
            v = list(w)
            for _ in range(max(1, len(v) // 120)):
                v[r.randrange(len(v))] = r.choice(words)
            j = 1000 + 2 * i + k
            texts[j] = " ".join(v)
            near.append((i, j))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    group = {x.doc_id: x.component_id for x in sh.similar_groups(docs, block=block).collect()}
    close = [(i, j) for i, j in near if jaccard(texts[i], texts[j]) >= 0.85]
    assert len(close) > 80
    assert sum(group[i] == group[j] for i, j in close) >= 0.98 * len(close)
    assert all(jaccard(texts[d], texts[c]) > 0.5 for d, c in group.items())


@pytest.mark.parametrize("name", ["odd_docs", "no_docs"])
def test_drop_near_duplicates_keeps_columns(request, name):
    docs = request.getfixturevalue(name)
    out = sh.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert out.where("doc_id is null").count() == docs.where("doc_id is null").count()
    out.collect()


def test_short_texts_meet_in_a_prefix(spark):
    """Texts of 20 to 60 words, one of which is changed: every pair of similarity 0.8 or more has a common key, whatever shingles count as frequent."""
    import random

    r = random.Random(21)
    for trial in range(2000):
        w = [f"v{r.randrange(5000)}" for _ in range(r.randint(20, 60))]
        v = list(w)
        v[r.randrange(-4, 4)] = "changed"
        if trial % 2:
            v.insert(0, "more")
        a, b = (" ".join(x) for x in (w, v))
        x, y = (sh.shingle_set(t.encode(), 5) for t in (a, b))
        some = np.unique(np.r_[x[::3], y[::2]])
        frequent = (some, np.arange(len(some)) % 7)
        if jaccard(a, b) >= 0.8:
            assert np.intersect1d(*(sh.prefix_keys(s, 0.8, frequent) for s in (x, y))).size


def test_shared_keys_across_batches():
    import pyarrow as pa

    rows = [(1, 1), (1, 1), (2, 5), (2, 6), (2, 7), (3, 1), (4, 1), (4, 2), (5, 9), (5, 9)]
    want = [x for x in rows if len({n for k, n in rows if k == x[0]}) > 1]
    for size in (1, 2, 3, 10):
        batches = [pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size])], names=["k", "node"]) for i in range(0, len(rows), size)]
        assert [(r["k"], r["node"]) for b in sh._shared(iter(batches)) for r in b.to_pylist()] == want


def short_pairs(words=30, n=400, seed=5):
    """Pairs of random texts of so many words, one word near an end changed; similarity by the place: 0.86 and more."""
    import random

    r = random.Random(seed)
    for i in range(n):
        w = [f"v{r.randrange(20_000)}" for _ in range(words)]
        v = list(w)
        v[r.choice((0, 1, -1, -2))] = f"c{i}"
        yield i, " ".join(w), " ".join(v)


@pytest.mark.parametrize("words", [20, 30, 50])
def test_short_near_copies_are_grouped(spark, words):
    pairs = list(short_pairs(words))
    docs = spark.createDataFrame([(k, t) for i, a, b in pairs for k, t in ((i, a), (1000 + i, b))], "doc_id long, text string")
    group = {x.doc_id: x.component_id for x in sh.similar_groups(docs).collect()}
    close = [i for i, a, b in pairs if jaccard(a, b) >= 0.85]
    assert len(close) > 150
    assert [i for i in close if group[i] != group[1000 + i]] == []


@pytest.mark.parametrize("block", [4, 4096])
def test_groups_are_those_of_exact_similarity(spark, block):
    """Texts around the limit, of 1 to 300 words: groups match a comparison of all pairs, on either side of it."""
    import random

    r = random.Random(33)
    texts = [None, "", " \n", "one", "ONE", "two words", "a a a a a a a a a", "a a a a a a"]
    for i in range(70):
        w = [f"v{r.randrange(4000)}" for _ in range(r.choice((5, 12, 20, 30, 45, 80, 300)))]
        texts.append(" ".join(w))
        for _ in range(3):
            w = list(w)
            for _ in range(max(1, round(len(w) * r.choice((0.005, 0.02, 0.03))))):
                w[r.randrange(len(w))] = r.choice(("x", f"v{r.randrange(4000)}"))
            texts.append(" ".join(w).upper() if r.random() < 0.1 else " ".join(w))
    sets = [set(sh.shingle_set((t or "").encode(), 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in sh.similar_groups(docs, block=block).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert 100 < len(set(got.values())) < len(texts) - 50


@pytest.mark.parametrize("block", [4, 4096])
def test_simhash_gives_candidates(spark, monkeypatch, block):
    """With no prefix to meet in, texts whose fingerprints lie within the radius still form groups, and the sets decide within these."""
    import random

    import pyarrow as pa

    sketches = sh._sketches

    def without_prefixes(*args):
        run = sketches(*args)

        def bare(batches):
            for b in run(batches):
                yield pa.record_batch([pa.array([[]] * b.num_rows, pa.list_(pa.int64())) if name == "keys" else b[name] for name in b.schema.names], names=b.schema.names)

        return bare

    monkeypatch.setattr(sh, "_sketches", without_prefixes)
    r = random.Random(8)
    texts = ["", " \n", "one", "a a a a a a a", "a a a a a a a a a"]
    for _ in range(25):
        w = [f"v{r.randrange(4000)}" for _ in range(r.randint(100, 500))]
        texts.append(" ".join(w))
        for _ in range(3):
            w = list(w)
            w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    sets = [sh.shingle_set(t.encode(), 5) for t in texts]
    close = components([(i, int(sh.majority(s)[0]) if len(s) else 0) for i, s in enumerate(sets)], 4)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if close[i] == close[j] and (common >= 0.8 * (len(sets[i]) + len(sets[j]) - common)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(x.doc_id for x in sh.drop_near_duplicates(docs, block=block).collect())
    assert got == [i for i in range(len(texts)) if find(i) == i]
    assert len(got) < 0.7 * len(texts)
