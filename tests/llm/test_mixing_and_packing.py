import itertools
import math
from collections import defaultdict

import numpy as np
import pytest

from sievecraft.llm import mixing, packing


def water_fill(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total >= cap * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500, None: 70}, {"a": 1}, {"b": 0, "a": 100}, {f"s{i}": 10 + i * i for i in range(25)}])
def test_targets_match_repeated_resharing(spark, sizes):
    df = spark.createDataFrame([(k, float(v)) for k, v in sizes.items()], "source string, source_size double")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = water_fill(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


@pytest.mark.parametrize("name", ["prose", "odd_docs"])
def test_mix_meets_targets_and_caps(request, name):
    docs = request.getfixturevalue(name)
    rows = mixing.mix_documents(docs).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and 0 <= r.copies <= 2
        by[r.source].append(r)
    want = water_fill({s: sum(r.size for r in x) for s, x in by.items()})
    for s, x in by.items():
        assert math.isclose(x[0].target, want[s], rel_tol=1e-9, abs_tol=1e-9) and x[0].source_size == sum(r.size for r in x)
        if name == "prose":
            assert abs(sum(r.taken for r in x) - want[s]) <= max(2, 0.01 * want[s])


def test_rates_are_exponentially_tilted(prose):
    """Within a source, log rate is proportional to size below the cap."""
    rows = [r for r in mixing.mix_documents(prose).collect() if r.size and 0 < r.rate < 2 - 1e-9]
    by = defaultdict(set)
    for r in rows:
        by[r.source].add(round(math.log(r.rate) / r.size, 10))
    assert by and all(max(v) - min(v) < 1e-8 for v in by.values())


def brute_rate(sizes, target):
    """One source: the rates by bisection over the multiplier."""
    total, mean = sum(sizes), sum(sizes) / len(sizes)
    if target >= 2 * total:
        return [2.0 if n else 1.0 for n in sizes]
    rate = lambda lam: [min(2.0, math.exp(min(lam * n / mean, 50.0))) for n in sizes]
    lo, hi = -1e4, 1e4
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(r * n for r, n in zip(rate(mid), sizes)) < target else (lo, mid)
    return rate(lo)


@pytest.mark.parametrize("block_rows", [50_000, 25])
def test_rates_copies_and_words_match_brute_force(spark, block_rows):
    rng = np.random.default_rng(12)
    rows = [(int(i), ["a", "b", "c", "d", None, "hot"][min(5, int(rng.integers(0, 9)))], int(rng.choice([0, 1, 5, 40, 300, 7_000])) + int(rng.integers(0, 9))) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = [r.asDict() for r in mixing.entropy_mix(df, block_rows=block_rows).collect()]
    assert sorted((r["doc_id"], str(r["source"]), r["size"]) for r in got) == sorted((a, str(b), c) for a, b, c in rows)
    from pyspark.sql import functions as F

    blocks = 64 + len(rows) // block_rows
    hashed = {r.doc_id: (-math.floor(2 * math.log2(r.size + 1)), r.b, -r.size, r.h, r.doc_id) for r in df.select("doc_id", "size", F.pmod(F.xxhash64("doc_id", "size"), F.lit(blocks)).alias("b"), F.xxhash64("doc_id", "size").alias("h")).collect()}
    targets = water_fill({s: sum(n for _, t, n in rows if t == s) for s in {t for _, t, _ in rows}})
    for s, target in targets.items():
        mine = sorted((r for r in got if r["source"] == s), key=lambda r: hashed[r["doc_id"]])
        rates = brute_rate([r["size"] for r in mine], target)
        done, off = 0, []
        for r, rate in zip(mine, rates):
            rate = 1.0 if r["size"] == 0 else rate
            assert math.isclose(r["rate"], rate, rel_tol=2e-5, abs_tol=1e-9) and r["target"] == pytest.approx(target)
            base, frac = math.floor(r["rate"] + 1e-9), max(0.0, r["rate"] - math.floor(r["rate"] + 1e-9))
            f = math.floor(frac * 1e6 + 0.5)
            copies = base + (done + f + 500_000) // 1_000_000 - (done + 500_000) // 1_000_000
            done += f
            assert r["copies"] == min(2, copies)
            off.append(r["taken"] - r["copies"] * r["size"])
        assert sum(x != 0 for x in off) <= 1  # one document takes up the rest
        rest = math.floor(target + 0.5) - sum(r["copies"] * r["size"] for r in mine)
        room = [min(rest, (2 - r["copies"]) * r["size"]) if rest > 0 else max(rest, -r["copies"] * r["size"]) for r in mine]
        assert sum(off) == max(room, key=abs)
        assert abs(sum(r["taken"] for r in mine) - target) <= max(1, abs(rest - max(room, key=abs)) + 1)


def test_apply_mix_takes_the_copies_of_the_mix(spark, prose):
    from collections import Counter

    odd = prose.withColumnRenamed("n_chars", "a.b")
    same_id = odd.selectExpr("7L as doc_id", "concat(text, ' ', doc_id) as text", "lang", "source", "`a.b`")
    docs = odd.union(same_id)
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.source, r.text) for r in out.collect())
    sizes = Counter()
    for (_, source, text), n in got.items():
        assert n <= 2
        sizes[source] += n * len(text.split())
    own = Counter()
    for r in docs.collect():
        own[r.source] += len(r.text.split())
    for source, target in water_fill(own).items():
        assert abs(sizes[source] - target) < 0.05 * target + 300


def test_mix_repeats_itself(prose):
    a, b = ({r.doc_id: r.taken for r in mixing.mix_documents(d).collect()} for d in (prose, prose.repartition(3)))
    assert a == b


def test_empty_and_columns(no_docs, odd_docs):
    assert mixing.mix_documents(no_docs).count() == 0
    assert mixing.apply_mix(no_docs).columns == no_docs.columns and mixing.apply_mix(no_docs).count() == 0
    out = mixing.apply_mix(odd_docs)
    assert out.columns == odd_docs.columns and out.count() > 0


def best_cost(tops, counts, k):
    m = len(tops)
    best = math.inf
    for ends in itertools.chain.from_iterable(itertools.combinations(range(m - 1), n) for n in range(min(k, m))):
        cost, start = 0, 0
        for e in (*ends, m - 1):
            cost += tops[e] * counts[start : e + 1].sum()
            start = e + 1
        best = min(best, cost)
    return best


def test_boundaries_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        m, k = int(rng.integers(1, 9)), int(rng.integers(1, 6))
        tops = np.sort(rng.choice(np.arange(0, 300), m, replace=False))
        counts = rng.integers(1, 50, m)
        ends = packing.optimal_boundaries(tops, counts, k)
        assert len(ends) <= k and ends[-1] == tops[-1]
        got = sum(c * min(e for e in ends if e >= t) for t, c in zip(tops, counts))
        assert got == best_cost(tops, counts, k)


@pytest.mark.parametrize("name", ["prose", "odd_docs", "no_docs"])
def test_every_row_is_packed_once(request, name):
    docs = request.getfixturevalue(name)
    rows = packing.pack_documents(docs, buckets=4, batch_tokens=1000, shard_rows=20).collect()
    assert len(rows) == docs.count()
    cells = defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.bucket_tokens and r.padding == r.bucket_tokens - r.n_tokens
        cells[r.bucket, r.shard, r.batch].append(r)
    for cell in cells.values():
        assert sorted(r.slot for r in cell) == list(range(len(cell)))
        assert len(cell) == 1 or sum(r.bucket_tokens for r in cell) <= 1000
    assert len({r.bucket for r in rows}) <= 4


def test_boundaries_are_the_optimum_over_many_lengths(spark):
    """20,000 different lengths, no rounding: the padding is that of a plain quadratic programme over a fine sample and never above any other choice."""
    rng = np.random.default_rng(9)
    tops = np.sort(rng.choice(np.arange(1, 200_000), 20_000, replace=False))
    counts = rng.integers(1, 60, len(tops))
    cost = lambda ends: sum(int(e) * int(counts[(tops > a) & (tops <= e)].sum()) for a, e in zip([-1, *ends], ends))
    ends = packing.optimal_boundaries(tops, counts, 6)
    assert len(ends) == 6 and set(ends) <= set(tops.tolist()) and ends[-1] == tops[-1]
    least = cost(ends)
    for k in range(5):  # no boundary can move alone
        lo, hi = (ends[k - 1] if k else -1), ends[k + 1]
        for e in rng.choice(tops[(tops > lo) & (tops < hi)], 40):
            assert cost([*ends[:k], int(e), *ends[k + 1 :]]) >= least


def test_boundaries_match_the_quadratic_programme():
    rng = np.random.default_rng(10)
    tops = np.sort(rng.choice(np.arange(0, 20_001), 400, replace=False))
    counts = rng.integers(1, 10**6, len(tops))
    before = np.concatenate([[0], np.cumsum(counts)])
    layer = tops * before[1:]
    for k in range(2, 9):
        new = layer.copy()
        for j in range(1, len(tops)):
            new[j] = min(new[j], (layer[:j] + tops[j] * (before[j + 1] - before[1 : j + 1])).min())
        layer = new
        ends = packing.optimal_boundaries(tops, counts, k)
        assert sum(int(e) * int(counts[(tops > a) & (tops <= e)].sum()) for a, e in zip([-1, *ends], ends)) == layer[-1]


def test_boundaries_are_actual_lengths(spark):
    lengths = [3, 9, 700, 701, 1025, 1026, 1030, 5003, 5004, 9001, 20_000]
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n_tokens long")
    rows = packing.pack(docs, buckets=4).collect()
    assert {r.bucket_tokens for r in rows} <= set(lengths)
    assert sum(r.bucket_tokens for r in rows) == best_cost(np.array(lengths), np.ones(len(lengths), np.int64), 4)
