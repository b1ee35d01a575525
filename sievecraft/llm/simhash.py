"""SimHash near-dedup with a covering family of bit masks.

For radius r every bit gets a vector of r+1 binary digits, and each non-zero vector v of r+1 digits gives a mask of the bits whose vector has an
odd product with v. Whatever r bits two fingerprints differ in, some v is orthogonal to all their vectors, so its mask leaves none of them
and the two collide in that table: 2^(r+1) - 1 tables find every pair within the radius, without chance.

Copies are merged into one fingerprint first. Inside a table's bucket the links are reduced to a spanning forest by a search that compares
each fingerprint with the ones not reached yet. A bucket above a block's size is no task's: pivots link its members in a few distributed
rounds, and only what they do not reach is compared, in blocks, with the rest of the bucket (see spanning_links). No group of pairs is
emitted, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.functions.hashing import covering_masks
from sievecraft.operators.components import connected_components

from .common import ascii_lower, broadcast_within, files_for, internal, shuffle_partitions, written


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words make one shingle, none make none. Blanks are the six ASCII ones, as bytes.split() has them."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    size = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist()
    return np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts, ends)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> np.ndarray:
    """The words of 64 bits in which a bit is 1 if set in over half the rows of `hashes`."""
    hashes = hashes.reshape(len(hashes), -1)
    ones, step = np.zeros(64 * hashes.shape[1], np.int64), 1 << 13
    for k in range(0, len(hashes), step):
        part = np.ascontiguousarray(hashes[k : k + step])
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """64 bits; a bit is 1 if set in over half the XXH64 of the shingles; zero without words."""
    h = shingle_hashes(text, words, seed)
    return int(majority(h)[0]) if len(h) else 0


def fingerprints(docs: DataFrame, words: int = 4, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns and fp, a signed long, of every whole text; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py() or b"", words) for t in b.column(len(keys))], np.uint64).view(np.int64)
            yield pa.record_batch([*(b.column(i) for i in range(len(keys))), pa.array(fps)], names=[*keys, "fp"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", fp long"
    return docs.select(*keys, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(run, schema)


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(fingerprint, smallest fingerprint of its component) under links within the radius; fps are signed and distinct."""
    rest, out = np.sort(fps), []
    while len(rest) > 1:
        root, rest, queue = rest[0], rest[1:], [rest[0]]
        while queue and len(rest):
            near = np.bitwise_count((rest ^ queue.pop()).view(np.uint64)) <= radius
            if near.any():
                found = rest[near]
                out += [(int(x), int(root)) for x in found]
                queue += list(found)
                rest = rest[~near]
    return out


_LINKS = "a long, b long"


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _scan_buckets(radius: int):
    """Over rows k, fp sorted by k: the links of each bucket's spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def flush() -> None:
            nonlocal held
            if sum(map(len, held)) > 1:
                out.extend(forest(np.unique(np.concatenate(held)), radius))
            held = []

        for batch in batches:
            k, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            ends = np.r_[starts[1:], len(k)]
            last = len(starts) - 1
            for i in np.flatnonzero((ends - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == last)):
                if k[starts[i]] != key:
                    flush()
                    key = k[starts[i]]
                held.append(fp[starts[i] : ends[i]])
            if len(out) > 20_000:
                yield _links(out)
                out.clear()
        flush()
        yield _links(out)

    return run


def _large(rows: DataFrame, block: int, files: int | None = None) -> DataFrame | None:
    """big: the keys k with more than `block` rows; None if there are none. Sizes are partial aggregates."""
    big = written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select(F.col("k").alias("big")), "large-keys", files=files)
    return big if big.limit(1).count() else None


def _parted(rows: DataFrame, big: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of other keys, and those of the keys in big."""
    if big is None:
        return rows, None
    known = broadcast_within(big, 100_000)
    return rows.join(known, F.col("k") == F.col("big"), "left_anti"), rows.join(known, F.col("k") == F.col("big"), "left_semi")


def spanning_links(rows: DataFrame, test: Callable, both: Callable, block: int, weight: int = 1 << 62, rounds: int = 4, pivots: int = 8) -> DataFrame:
    """Links a, b whose components are those of all similar pairs within each group k, for groups of any size.

    rows: k, node, item, w, a node once in a group. The first node of a group is its first pivot, and what is similar to it is linked to it. Later
    rounds take about `pivots` of the nodes linked last as pivots for what is left, so all that is linked is one connected set, within
    which no pair needs a look. In the end what no pivot reached is compared with its whole group, both dealt into blocks of `block` nodes
    and `weight` of w. test: Arrow rows k, node, item, p (array of the pivots' node, item) to k, node, item, hit, a similar pivot's node.
    both: rows g, node, item sorted by g and node to the links of each g.
    """
    sizes = written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("s"), F.min("node").alias("first")), "span-sizes")
    kinds = dict(rows.dtypes)
    seeds, open_, links, left = sizes.select("k", F.col("first").alias("node")), rows.select("k", "node", "item"), [], 0
    for r in range(rounds):
        chosen = rows.join(seeds, ["k", "node"]).groupBy("k").agg(F.collect_list(F.struct("node", "item")).alias("p"))
        tested = open_.join(chosen, "k", "left").select("k", "node", "item", "p").mapInArrow(test, f"k long, node long, item {kinds['item']}, hit long")
        tested = written(tested, "span-tested")
        links.append(tested.where("hit is not null and hit <> node").select(F.col("node").alias("a"), F.col("hit").alias("b")))
        open_ = tested.where("hit is null").select("k", "node", "item")
        left = open_.count()
        new = tested.where("hit is not null").select("k", "node")
        if not left or not new.limit(1).count():
            break
        spread = F.greatest(F.col("n") / pivots, F.lit(1)).cast("long")
        seeds = new.join(sizes, "k").where(F.pmod(F.xxhash64("node", F.lit(r)), spread) == 0).select("k", "node")
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    if not left:
        return out
    cut = lambda n, s: F.greatest(F.ceil(F.greatest(n / block, s / weight)), F.lit(1)).cast("long")
    rest = open_.join(rows.select("k", "node", "w"), ["k", "node"])
    plan = rest.groupBy("k").agg(F.count(F.lit(1)).alias("u_n"), F.sum("w").alias("u_s")).join(sizes, "k").select("k", cut(F.col("u_n"), F.col("u_s")).alias("u"), cut(F.col("n"), F.col("s")).alias("v"))
    plan = written(plan, "span-plan")
    every = lambda top: F.explode(F.sequence(F.lit(0).cast("long"), F.col(top) - 1))
    ours = rest.join(plan, "k").select("k", "node", "item", F.pmod(F.xxhash64("node", F.lit(7)), F.col("u")).alias("i"), every("v").alias("j"))
    theirs = rows.join(plan, "k").select("k", "node", "item", F.pmod(F.xxhash64("node", F.lit(8)), F.col("v")).alias("j"), every("u").alias("i")).select("k", "node", "item", "i", "j")
    dealt = ours.union(theirs).select(F.xxhash64("k", "i", "j").alias("g"), "node", "item")
    dealt = dealt.repartition(shuffle_partitions(rows.sparkSession), "g").sortWithinPartitions("g", "node")
    return out.union(dealt.mapInArrow(both, _LINKS))


def _near_pivots(radius: int):
    """test() of spanning_links for items that are fingerprints: the first pivot within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[list, np.ndarray]] = {}
        for b in batches:
            k = b.column(0).to_numpy()
            items = b.column(2).to_pylist()
            hit = [None] * len(k)
            for key in np.unique(k):
                at = np.flatnonzero(k == key)
                if key not in known:
                    if len(known) > 1_000:
                        known.clear()
                    p = b.column(3)[int(at[0])].as_py() or []
                    known[key] = [x["node"] for x in p], np.frombuffer(b"".join(x["item"] for x in p), np.uint64)
                nodes, fps = known[key]
                if not nodes:
                    continue
                mine = np.frombuffer(b"".join(items[i] for i in at), np.uint64).reshape(len(at), -1)
                near = np.array([np.bitwise_count(mine ^ f).sum(axis=1) <= radius for f in fps.reshape(len(nodes), -1)])
                for i, some, first in zip(at, near.any(axis=0), near.argmax(axis=0)):
                    if some:
                        hit[i] = nodes[first]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(hit, pa.int64())], names=["k", "node", "item", "hit"])

    return run


def _linked_items(radius: int):
    """both() of spanning_links for items that are fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, fps = None, [], []

        def links() -> pa.RecordBatch:
            return _links([(nodes[i], nodes[j]) for i, j in _near(np.frombuffer(b"".join(fps), np.uint64).reshape(len(fps), -1), radius)])

        for batch in batches:
            for g, n, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if g != group:
                    if len(nodes) > 1:
                        yield links()
                    group, nodes, fps = g, [], []
                if not nodes or n != nodes[-1]:
                    nodes.append(n)
                    fps.append(f.as_py())
        if len(nodes) > 1:
            yield links()

    return run


def fingerprint_links(distinct: DataFrame, radius: int = 4, block: int = 4096) -> DataFrame:
    """Links a, b between the distinct fingerprints fp whose components are those of all pairs within the radius."""
    masks = covering_masks(radius)
    tables = F.array(*(F.lit(m).cast("long") for m in masks))
    parts = shuffle_partitions(distinct.sparkSession)
    spread = distinct.repartition(parts, "fp")  # few narrow rows lie in few tasks, which would hold all their keys
    keys = spread.select("fp", F.explode(F.transform(tables, lambda m, i: F.xxhash64(F.col("fp").bitwiseAND(m), i))).alias("k")).select("k", "fp")
    small, large = _parted(keys, _large(keys, block))
    links = written(small.repartition(parts, "k").sortWithinPartitions("k").mapInArrow(_scan_buckets(radius), _LINKS), "simhash-links")
    if large is not None:
        items = large.select("k", F.col("fp").alias("node"), F.unhex(hex16(F.col("fp"))).alias("item"), F.lit(1).cast("long").alias("w"))
        links = links.union(spanning_links(items, _near_pivots(radius), _linked_items(radius), block))
    return links


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, block: int = 4096) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id reachable over links within the radius.

    Texts are taken whole; a text with fewer words than a shingle is one shingle, and one without words, empty or null has fingerprint
    zero and is linked like any other. Rows with null doc_id take part, but an identifier that is not null names their component if there
    is one. Repeated rows are returned each. An empty table gives an empty result. Other columns are ignored.
    """
    fps = written(fingerprints(docs, words), "simhash-fp", compact=True)
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    nodes = connected_components(fingerprint_links(distinct, radius, block))
    named = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"), "doc_id")
    named = written(named, "simhash-roots")
    smallest = written(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")  # a scan, so that AQE may split the join
    label = named.join(smallest, "root").select(F.col("fp").alias("label_fp"), "component_id")
    joined = fps.join(label, F.col("fp") == F.col("label_fp"))
    return joined.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


#: 64-bit words of a wide fingerprint.
WIDE = 8
_MIX = np.random.default_rng(11).integers(1, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """512 bits from shingle hashes; the first word is the 64-bit fingerprint."""
    out = np.zeros(WIDE, np.uint64)
    for k in range(0, WIDE, 4):
        x = h[:, None] * _MIX[None, k : k + 4]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        if k == 0:
            x[:, 0] = h
        out[k : k + 4] = majority(x)
    return out


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return np.unique(shingle_hashes(text, words))


def frequent_shingles(rows: DataFrame, words: int, n: int, sample: int = 20_000, least: int = 4, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes and their counts in about `sample` of the n texts, for at most `most` that `least` of these have.

    They say which shingles come last in the order of prefix_keys(), which gives all pairs in any order: the counts bear on cost alone.
    """
    every = max(1, n // sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.zeros(0, np.uint64), *(shingle_set(t.as_py(), words) for t in b.column(0))]
            yield pa.record_batch([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").mapInArrow(run, "h long")
    top = some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(most).collect()
    h, n = np.array([r.h for r in top], np.int64).view(np.uint64), np.array([r.n for r in top], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefix_keys(s: np.ndarray, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set, by their frequency and then their hash: of two sets of that Jaccard similarity both have one of these.

    The sets then share at least `similarity` of the larger one's shingles, so no more than the rest can come before the first common one.
    """
    if not len(s):
        return np.zeros(1, np.uint64)
    h, n = frequent
    seen = np.zeros(len(s), np.int64)
    if len(h):
        at = np.minimum(np.searchsorted(h, s), len(h) - 1)
        seen = np.where(h[at] == s, n[at], 0)
    return s[np.lexsort((s, seen))[: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1]]


#: Of 512 bits, what a pair of similarity 0.8 may differ in and still be compared by shingles. The mean there is 78, and 96 for sets of four and
#: five shingles, the farthest; five deviations of 8.8 more. Wider than need be costs comparisons, no results.
PRESELECT = 140


def preselect(similarity: float) -> int:
    """PRESELECT for 0.8 and more; below, the expected bits of two equally large sets and eight deviations more."""
    share, bits = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi), 64 * WIDE
    return max(PRESELECT, round(bits * share + 8 * (bits * share * (1 - share)) ** 0.5))


def _sketches(words: int, similarity: float, frequent: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), words) for t in b.column(2)]
            wide = [wide_fingerprint(s) if len(s) else np.zeros(WIDE, np.uint64) for s in sets]
            keys = [prefix_keys(s, similarity, frequent).view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            fps, sizes = pa.array([int(x[0].view(np.int64)) for x in wide], pa.int64()), pa.array([len(s) for s in sets], pa.int64())
            yield pa.record_batch([b.column(0), b.column(1), fps, pa.array([x.tobytes() for x in wide], pa.binary()), sizes, lists], names=["doc_id", "node", "fp", "wide", "n", "keys"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows k, node sorted by both: those whose k has several nodes, without repeats."""
    last, done = None, False  # the last row, and whether it was given out
    for b in batches:
        k, n = (np.asarray(b.column(i).to_numpy(), np.int64) for i in (0, 1))
        if not len(k):
            continue
        if last is not None:
            k, n = np.r_[last[0], k], np.r_[last[1], n]
        new = np.r_[True, (k[1:] != k[:-1]) | (n[1:] != n[:-1])]
        k, n = k[new], n[new]
        same = k[1:] == k[:-1]
        out = np.r_[False, same] | np.r_[same, False]
        out[0] &= not done
        last, done = (k[-1], n[-1]), bool(out[-1]) or len(k) == 1 and done
        yield pa.record_batch([pa.array(k[out]), pa.array(n[out])], names=["k", "node"])


def _near(wide: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Positions i, j of actual links that span the components under links within the radius; rows of `wide` are fingerprints."""
    rest, out = np.arange(len(wide)), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            near = np.bitwise_count(wide[rest] ^ wide[i]).sum(axis=1) <= radius
            if near.any():
                found = rest[near]
                out += [(int(j), int(i)) for j in found]
                queue += list(found)
                rest = rest[~near]
    return out


def _scan_wide(radius: int):
    """Over rows k, node, wide sorted by k: the links of each bucket's spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, fps, out = None, [], [], []

        def flush() -> None:
            nonlocal nodes, fps
            if len(nodes) > 1:
                wide = np.frombuffer(b"".join(fps), np.uint64).reshape(-1, WIDE)
                out.extend((nodes[i], nodes[j]) for i, j in _near(wide, radius))
            nodes, fps = [], []

        for batch in batches:
            for k, n, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if k != key:
                    flush()
                    key = k
                nodes.append(n)
                fps.append(f.as_py())
            if len(out) > 20_000:
                yield _links(out)
                out.clear()
        flush()
        yield _links(out)

    return run


def similar_sets(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Positions i, j of pairs of that Jaccard similarity or more that span the components under all such pairs; empty sets are alike."""
    size = np.array([max(1, len(s)) for s in sets], np.int64)
    ids = np.unique(np.concatenate([s if len(s) else np.zeros(1, np.uint64) for s in sets]), return_inverse=True)[1].ravel()
    starts = np.cumsum(size) - size
    mark, rest, out = np.zeros(len(ids), bool), np.arange(len(sets)), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            own = ids[starts[i] : starts[i] + size[i]]
            mark[own] = True
            fit = rest[np.minimum(size[rest], size[i]) >= similarity * np.maximum(size[rest], size[i]) - 1e-6]
            common = np.array([np.count_nonzero(mark[ids[starts[j] : starts[j] + size[j]]]) for j in fit], np.int64)
            mark[own] = False
            found = fit[common / (size[fit] + size[i] - common) >= similarity]
            if len(found):
                out += [(int(j), int(i)) for j in found]
                queue += list(found)
                rest = np.setdiff1d(rest, found, assume_unique=True)
    return out


def _confirm(words: int, similarity: float):
    """Over rows g, node, text sorted by g: links a, b between the nodes of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sets = None, [], []

        def links() -> pa.RecordBatch:
            pairs = similar_sets(sets, similarity) if len(sets) > 1 else []
            return pa.record_batch([pa.array([nodes[i] for i, _ in pairs], pa.int64()), pa.array([nodes[j] for _, j in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            for g, n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if g != group:
                    if len(sets) > 1:
                        yield links()
                    group, nodes, sets = g, [], []
                if not nodes or n != nodes[-1]:
                    nodes.append(n)
                    sets.append(shingle_set(t.as_py(), words))
        yield links()

    return run


def _similar_pivots(words: int, similarity: float):
    """test() of spanning_links for items that are texts: the first pivot of that Jaccard similarity or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[tuple[int, np.ndarray]]] = {}
        for b in batches:
            hit = []
            for i, (k, text) in enumerate(zip(b.column(0).to_pylist(), b.column(2))):
                if k not in known:
                    if len(known) > 100:
                        known.clear()
                    known[k] = [(x["node"], shingle_set(x["item"], words)) for x in b.column(3)[i].as_py() or []]
                own = shingle_set(text.as_py(), words)
                for node, s in known[k]:
                    common = len(np.intersect1d(own, s, assume_unique=True))
                    if not len(own) and not len(s) or common and common / (len(own) + len(s) - common) >= similarity:
                        hit.append(node)
                        break
                else:
                    hit.append(None)
            item = pa.array([None if h is not None else t.as_py() for h, t in zip(hit, b.column(2))], pa.binary())  # linked texts are not needed again
            yield pa.record_batch([b.column(0), b.column(1), item, pa.array(hit, pa.int64())], names=["k", "node", "item", "hit"])

    return run


def simhash_links(nodes: DataFrame, radius: int = 4, block: int = 4096, files: int | None = None) -> DataFrame:
    """Links a, b between the nodes of the rows node, fp whose components are those of all pairs of fingerprints within the radius."""
    heads = written(nodes.groupBy("fp").agg(F.min("node").alias("head")), "similar-heads", files=files)
    end = lambda name: heads.select(F.col("fp").alias(name), F.col("head").alias(f"{name}_head")).hint("merge")
    links = fingerprint_links(heads.select("fp"), radius, block).join(end("a"), "a").join(end("b"), "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    return links.union(nodes.join(heads.hint("merge"), "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")))


def confirmed_links(rows: DataFrame, sketches: DataFrame, groups: DataFrame, words: int, similarity: float, block: int = 4096, shingles: int = 2_000_000, files: int | None = None) -> DataFrame:
    """Links a, b whose components are those of all pairs of that Jaccard similarity within the groups node, component.

    Each text of a group is read once, and its shingles are compared with those of the whole group. A group of more than `block` texts
    or `shingles` shingles is no task's, see spanning_links.
    """
    spark = rows.sparkSession
    groups = written(groups.join(sketches.select("node", "n"), "node").select(F.col("component").alias("k"), "node", F.greatest("n", F.lit(1)).alias("w")), "similar-candidates", files=files)
    sizes = groups.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.sum("w").alias("s"))
    big = written(sizes.where((F.col("m") > block) | (F.col("s") > shingles)).select(F.col("k").alias("big")), "large-groups", files=files)
    small, large = _parted(groups, big if big.limit(1).count() else None)
    texts = rows.join(broadcast_within(small.select("node", "k"), 200_000), "node").select("k", "node", "text")
    links = texts.repartition(shuffle_partitions(spark), "k").sortWithinPartitions("k", "node").mapInArrow(_confirm(words, similarity), _LINKS)
    if large is not None:
        once = rows.join(large.select("node"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("item"))  # copies share a node
        items = written(once.join(large, "node").select("k", "node", "item", "w"), "similar-large")
        links = links.union(spanning_links(items, _similar_pivots(words, similarity), _confirm(words, similarity), block, shingles))
    return links


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, block: int = 4096, radius: int = 4) -> DataFrame:
    """doc_id, component_id over links of texts whose sets of shingles have a Jaccard similarity of `similarity` or more.

    Candidates are what SimHash links: every pair of 64-bit fingerprints of the sets within the radius, by the tables of near_duplicates(). Sets of
    that similarity may lie farther apart, so a second way adds those. Prefix filtering: shingles have one order for all texts, rare ones first, and
    two sets of that similarity have a common shingle among the first ones of both, so texts that share one of these are compared, whatever their
    length. 512-bit SimHash fingerprints leave out pairs that are far apart (see PRESELECT). Both give spanning links alone, over distinct texts,
    keys of more than `block` texts by pivots (see spanning_links). They form candidate groups, within which the similarity of the sets
    themselves decides.

    Nulls count as empty texts; texts without words are alike; texts of any length are compared whole. Rows with null doc_id get component_id
    from the others of their group. Repeated rows are returned each. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    parts, limit = shuffle_partitions(docs.sparkSession), preselect(similarity)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.xxhash64(ascii_lower(F.col("text"))).alias("node"), F.col("text").cast("binary").alias("text"))
    n, files = docs.count(), files_for(docs)
    sketch = _sketches(words, similarity, frequent_shingles(rows, words, n))
    sketched = written(rows.mapInArrow(sketch, "doc_id long, node long, fp long, wide binary, n long, keys array<long>"), "similar-sketch", files=files)
    nodes = sketched.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("wide").alias("wide"), F.first("n").alias("n"))  # copies merge here
    keys = sketched.select(F.explode("keys").alias("k"), "node")
    shared = written(keys.repartition(parts, "k").sortWithinPartitions("k", "node").mapInArrow(_shared, "k long, node long"), "similar-shared", files=files)
    small, large = _parted(shared, _large(shared, block, files))
    wide = nodes.select("node", "wide")  # most keys have one text; fingerprints travel with the others alone
    links = small.join(wide, "node").select("k", "node", "wide").repartition(parts, "k").sortWithinPartitions("k").mapInArrow(_scan_wide(limit), _LINKS)
    if large is not None:
        items = written(large.distinct().join(wide, "node").select("k", "node", F.col("wide").alias("item"), F.lit(1).cast("long").alias("w")), "similar-hot", files=files)
        links = links.union(spanning_links(items, _near_pivots(limit), _linked_items(limit), block))
    links = links.union(simhash_links(sketched.select("node", "fp").distinct(), radius, block, files))
    groups = connected_components(links)
    comps = connected_components(confirmed_links(rows, nodes, groups, words, similarity, block, files=files))
    named = written(nodes.join(comps, "node", "left").select("node", F.coalesce("component", "node").alias("root"), "doc_id"), "similar-roots", files=files)
    smallest = written(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest", files=files)  # a scan, so that AQE may split the join
    label = named.join(smallest, "root").select(F.col("node").alias("label_node"), "component_id")
    return sketched.join(label, F.col("node") == F.col("label_node")).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, **kwargs) -> DataFrame:
    """The rows of docs, with all their columns, without those of a group of similar texts but its smallest doc_id.

    Rows with null doc_id stay, and so do all rows that share the smallest doc_id. Null texts count as empty. An empty table gives an empty result.
    """
    gone = similar_groups(docs, **kwargs).where("doc_id <> component_id").select(F.col("doc_id").alias(internal("gone"))).distinct()
    return docs.join(gone, docs["doc_id"] == gone[internal("gone")], "left_anti")
