"""Suffix-array dedup: removes every byte covered by a string of `width` bytes that also starts earlier in the corpus.

Windows of `width` bytes are dealt into shards by content. A window belongs to its anchor, the leftmost of its k-grams with the smallest
hash, so equal windows share anchor and shard; neighbouring windows with one anchor travel as one segment. Segments that are equal
as a whole (128 bits of hash) are merged before they travel: the first stays for all. The segments left go, in corpus order, through their
shard's family of suffix arrays. There a new batch gets a suffix array of its window starts, is merge-scanned against the arrays of all
levels for common prefixes of full width, and enters as the smallest level; levels of equal size merge, so a shard of n windows has log n
levels and each window is merged log n times.

`SuffixIndex` keeps the levels of its shards in a folder, so batches can be added run after run. `repeated_spans` is the run over one whole
table whose index is not kept afterwards: there, segments whose anchor has no other surroundings in the table cannot match anything and do
not enter a family.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_within, path_exists, path_names, remove_path, shuffle_partitions, written

WIDTH, GRAM = 100, 32
_CHUNK = 1 << 18
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two adjoining strings from their hashes."""
    x = left * _A
    x ^= x >> np.uint64(32)
    x += right * _B
    x ^= x >> np.uint64(29)
    return x


def _hashes(data: np.ndarray, size: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """Hash of the `size` bytes from each position on, from hashes of powers of two; known keeps those."""
    done, out = 0, None
    while done < size:
        power = 1 << ((size - done).bit_length() - 1)
        p = 1
        while p < power:
            if 2 * p not in known:
                h = known[p]
                known[2 * p] = _join(h[:-p], h[p:])
            p *= 2
        h = known[power]
        n = len(data) - size + 1
        out = h[:n] if out is None else _join(out[:n], h[done : done + n])
        done += power
    return out


def _smallest(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each `span` neighbours."""
    p = 1
    while 2 * p <= span:
        values = np.minimum(values[:-p], values[p:])
        p *= 2
    return np.minimum(values[: len(values) - (span - p)], values[span - p :]) if span > p else values


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first window start in data, number of windows, anchor hash, segment hash) of every segment of the texts data[starts:ends]."""
    none = np.zeros(0, np.int64)
    live = np.flatnonzero(ends - starts >= width)
    if not len(live) or len(data) < width:
        return none, none, none, none, none
    known = {1: _BYTE[data]}
    h = _hashes(data, gram, known)
    order = (h >> np.uint64(20) << np.uint64(20)) | np.arange(len(h), dtype=np.uint64)  # a chunk has fewer than 2^20 bytes
    best = _smallest(order, width - gram + 1)
    window = _hashes(data, width, known)
    cut = np.zeros(len(best) + 1, bool)
    cut[1:-1] = best[1:] != best[:-1]
    first, last = starts[live], ends[live] - width + 1
    cut[first] = True
    cut[last] = True
    begin = np.flatnonzero(cut[:-1])
    end = np.append(begin[1:], len(best))
    text = np.searchsorted(first, begin, "right") - 1
    ok = (text >= 0) & (begin < last[np.maximum(text, 0)])
    begin, end, text = begin[ok], end[ok], text[ok]
    anchor = h[(best[begin] & np.uint64((1 << 20) - 1)).astype(np.int64)]
    whole = _join(_join(window[begin], window[end - 1]), (end - begin).astype(np.uint64) * _C)
    return live[text], begin, end - begin, anchor.view(np.int64), whole.view(np.int64)


def _chunks(ids: list[int], texts: list[bytes], width: int) -> Iterator[tuple]:
    """Texts put together up to a chunk's size; a longer text comes in pieces that share width-1 bytes, with the piece's offset."""
    held, size = [], 0
    for i, t in zip(ids, texts):
        if len(t) < width:
            continue
        for at in range(0, max(1, len(t) - width + 1), _CHUNK):
            piece = t[at : at + _CHUNK + width - 1]
            if held and size + len(piece) > 2 * _CHUNK:
                yield held
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield held


def _merged(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows sorted and joined where they touch."""
    if not len(doc):
        return doc, start, n
    o = np.lexsort((start, doc))
    doc, start, n = doc[o], start[o], n[o]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + n[:-1])]
    at = np.flatnonzero(new)
    return doc[at], start[at], np.add.reduceat(n, at)


class _Known:
    """Classes of segments that a task has met twice, each with the first place sent on; a later copy need not travel.

    At most `most` classes are remembered. A copy of a class that is not remembered travels, so the limit bears on cost alone.
    """

    def __init__(self, most: int = 1 << 16) -> None:
        self.most = most
        self.tag, self.doc, self.start = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.key, self.cls = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def later(self, key: np.ndarray, cls: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which of the segments come after a remembered one of their class."""
        if not len(self.tag) or not len(key):
            return np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.tag, _tag(key, cls)), len(self.tag) - 1)
        same = (self.key[at] == key) & (self.cls[at] == cls)
        return same & ((self.doc[at] < doc) | (self.doc[at] == doc) & (self.start[at] < start))

    def remember(self, key: np.ndarray, cls: np.ndarray, doc: np.ndarray, start: np.ndarray) -> None:
        room = self.most - len(self.tag)
        if room <= 0 or not len(key):
            return
        key, cls, doc, start = (x[:room] for x in (key, cls, doc, start))
        cols = [np.r_[old, new] for old, new in zip((self.tag, self.key, self.cls, self.doc, self.start), (_tag(key, cls), key, cls, doc, start))]
        order = np.lexsort((cols[4], cols[3], cols[0]))
        self.tag, self.key, self.cls, self.doc, self.start = (c[order] for c in cols)


def _tag(key: np.ndarray, cls: np.ndarray) -> np.ndarray:
    return _join(key.view(np.uint64), cls.view(np.uint64))


def _scan(width: int, gram: int):
    """Texts to rows key, cls, doc_id, pos. pos = start << 7 | windows; with 0 windows the row is a finding: cls windows from start on are repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for b in batches:
            rows = []
            for held in _chunks(b.column(0).to_pylist(), b.column(1).to_pylist(), width):
                sizes = np.array([len(p) for _, _, p in held])
                ends = np.cumsum(sizes)
                text, begin, n, key, cls = segments(np.frombuffer(b"".join(p for *_, p in held), np.uint8), ends - sizes, ends, width, gram)
                doc, off = np.array([i for i, *_ in held], np.int64), np.array([a for _, a, _ in held], np.int64)
                rows.append((key, cls, doc[text], begin - (ends - sizes)[text] + off[text], n))
            if not rows:
                continue
            key, cls, doc, start, n = (np.concatenate(x) for x in zip(*rows))
            # of equal segments only the first of the batch goes on, and none that comes after one the task has sent: copies merge before the shuffle
            o = np.lexsort((start, doc, cls, key))
            key, cls, doc, start, n = (x[o] for x in (key, cls, doc, start, n))
            again = np.r_[False, (key[1:] == key[:-1]) & (cls[1:] == cls[:-1])]
            late = again | known.later(key, cls, doc, start)
            several = np.r_[again[1:], False] & ~late
            known.remember(key[several], cls[several], doc[several], start[several])
            d, s, c = _merged(doc[late], start[late], n[late].astype(np.int64))
            key, cls, doc, start, n = (x[~late] for x in (key, cls, doc, start, n))
            spread = (d * 2654435761 + s * 40503) & 0x7FFFFFFFFFFFFFFF
            cols = (np.r_[key, spread], np.r_[cls, c], np.r_[doc, d], np.r_[start << 7 | n, s << 7])
            yield pa.record_batch([pa.array(x.astype(np.int64)) for x in cols], names=["key", "cls", "doc_id", "pos"])

    return run


def _settle(hot: int, every: bool = False):
    """Rows sorted by key, cls, doc_id, pos to findings and open segments: kind, doc_id, start, n, key.

    kind 0: n windows from start on are repeats. kind 1: first segment of its class, under an anchor with several classes or, with `every`, any.
    kind 2: the key of an anchor with more than `hot` classes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_cls = None
        seen, pending = 0, None  # classes of last_key so far; its first row while it is the only class
        for b in batches:
            key, cls, doc, pos = (b.column(i).to_numpy() for i in range(4))
            local = (pos & 127) == 0
            out = [(np.zeros(local.sum(), np.int32), doc[local], pos[local] >> 7, cls[local], key[local])]
            key, cls, doc, pos = key[~local], cls[~local], doc[~local], pos[~local]
            if len(key):
                new_key = np.r_[key[0] != last_key, key[1:] != key[:-1]]
                new_cls = new_key | np.r_[cls[0] != last_cls, cls[1:] != cls[:-1]]
                dup = ~new_cls
                out.append((np.zeros(dup.sum(), np.int32), doc[dup], pos[dup] >> 7, pos[dup] & 127, key[dup]))
                k, d, p, nk = key[new_cls], doc[new_cls], pos[new_cls], new_key[new_cls]
                if len(k):
                    group = np.cumsum(nk)  # 0: still last_key
                    at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                    count = np.diff(np.r_[at, len(k)])
                    carried = np.where(group[at] == 0, seen, 0)
                    total = count + carried
                    ordinal = np.arange(len(k)) - np.repeat(at - carried, count)
                    final = np.repeat((total >= 2) | every, count)
                    tail = np.repeat(np.arange(len(at)) == len(at) - 1, count)
                    if pending is not None and group[0] == 0 and not every:
                        out.append(tuple(np.array([x]) for x in (1, *pending)))
                        pending = None
                    elif pending is not None and nk[0]:
                        pending = None
                    out.append((np.ones(final.sum(), np.int32), d[final], p[final] >> 7, p[final] & 127, k[final]))
                    over = ordinal == hot
                    out.append((np.full(over.sum(), 2, np.int32), d[over], p[over] >> 7, p[over] & 127, k[over]))
                    seen = int(total[-1])
                    if seen == 1 and not final[tail][0]:
                        i = len(k) - 1
                        pending = (d[i], p[i] >> 7, p[i] & 127, k[i])
                last_key, last_cls = key[-1], cls[-1]
            cols = [np.concatenate(x) for x in zip(*out)]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["kind", "doc_id", "start", "n", "key"])

    return run


class Level(NamedTuple):
    """Bytes, and the window starts in them sorted by the suffix cut at the width; of equal windows one."""

    data: np.ndarray
    order: np.ndarray


class SuffixFamily:
    """Suffix arrays of geometrically growing size, largest first."""

    def __init__(self, width: int = WIDTH, levels: list[Level] | None = None) -> None:
        self.width, self.kind, self.levels = width, f"S{width}", sorted(levels or [], key=lambda x: -len(x.order))

    def _windows(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(data, self.width)[starts]

    def _sorted(self, rows: np.ndarray) -> np.ndarray:
        """Stable order of the windows; of two sorted runs one after the other it is their merge."""
        return np.argsort(np.ascontiguousarray(rows).view(self.kind).ravel(), kind="stable")

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of each pair of windows."""
        differ = a != b
        return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])

    def _scan(self, level: Level, rows: np.ndarray) -> np.ndarray:
        """Longest common prefix of each of the sorted windows with the level's windows that do not sort after it, by one merge scan.

        A window equal to one of the level stands right behind it in the merge, so a prefix of full width cannot be missed.
        """
        old = self._windows(level.data, level.order)
        order = self._sorted(np.concatenate([old, rows]))
        before = np.maximum.accumulate(np.where(order < len(old), order, -1))[order >= len(old)]
        out, some = np.zeros(len(rows), np.int64), before >= 0
        out[some] = self._common(old[before[some]], rows[some])
        return out

    def _merge(self, a: Level, b: Level) -> Level:
        order = self._sorted(np.concatenate([self._windows(a.data, a.order), self._windows(b.data, b.order)]))
        return Level(np.concatenate([a.data, b.data]), np.concatenate([a.order, b.order + len(a.data)])[order])

    def add(self, data: np.ndarray, starts: np.ndarray, insert: np.ndarray | None = None) -> np.ndarray:
        """Which of the windows at `starts`, in corpus order, equal an earlier one, of this batch or of a level; those for insertion become a level."""
        out = np.zeros(len(starts), bool)
        if not len(starts):
            return out
        rows = self._windows(data, starts)
        array = self._sorted(rows)  # the batch's suffix array; ties keep corpus order
        rows = rows[array]
        repeat = np.r_[False, self._common(rows[1:], rows[:-1]) >= self.width]
        heads = np.flatnonzero(~repeat)
        found = np.zeros(len(heads), bool)
        for level in self.levels:
            found |= self._scan(level, rows[heads]) >= self.width
        repeat[heads] = found
        out[array] = repeat
        kept = array[heads[~found]]
        if insert is not None:
            kept = kept[np.maximum.reduceat(insert[array], heads)[~found]] if len(kept) else kept
        if len(kept):
            new = Level(data, starts[kept])
            while self.levels and len(self.levels[-1].order) <= len(new.order):
                new = self._merge(self.levels.pop(), new)
            self.levels.append(new)
        return out


def _laid_out(segs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The segments' bytes, and of every window its start there, its segment and its place in the segment."""
    size = np.array([len(x) for x in segs], np.int64)
    n = size - width + 1
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    of = np.repeat(np.arange(len(segs)), n)
    return np.frombuffer(b"".join(segs), np.uint8), (np.cumsum(size) - size)[of] + inner, of, inner


def _search(width: int, batch_windows: int):
    """Segments in corpus order to findings doc_id, start, n; one family per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = SuffixFamily(width)

        def batch(doc: list, start: list, seg: list[bytes]) -> pa.RecordBatch:
            data, at, of, inner = _laid_out(seg, width)
            hit = family.add(data, at)
            d, s, c = _merged(np.array(doc, np.int64)[of[hit]], np.array(start, np.int64)[of[hit]] + inner[hit], np.ones(hit.sum(), np.int64))
            return pa.record_batch([pa.array(d), pa.array(s), pa.array(c)], names=["doc_id", "start", "n"])

        doc, start, seg, held = [], [], [], 0
        for b in batches:
            for d, s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                doc.append(d)
                start.append(s)
                seg.append(x)
                held += len(x) - width + 1
                if held >= batch_windows:
                    yield batch(doc, start, seg)
                    doc, start, seg, held = [], [], [], 0
        if seg:
            yield batch(doc, start, seg)

    return run


def _fetch(width: int, both: bool | None = None):
    """Text and its open segments to rows shard, doc_id, start, seg. A hot anchor's windows go one by one, each to a shard of its own content.

    With `both` given, rows also say whether their windows enter the shard and whether they were dealt one by one; if it is true, a hot anchor's
    segment also goes, without entering, to the anchor's shard.
    """
    names = ["shard", "doc_id", "start", "seg", "enters", "single"][: 4 if both is None else 6]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_())

    def rows(out: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x[k] for x in out], kinds[k]) for k in range(len(names))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for b in batches:
            for doc, text, need in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                t = text.as_py()
                for x in need:
                    if x["hot"]:
                        for i in range(x["start"], x["start"] + x["n"]):
                            w = t[i : i + width]
                            out.append((int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True), doc, i, w, True, True))
                    if not x["hot"] or both:
                        out.append((x["key"], doc, x["start"], t[x["start"] : x["start"] + x["n"] + width - 1], not x["hot"], False))
                    if len(out) > 50_000:
                        yield rows(out)
                        out = []
        yield rows(out)

    return run


def _strip(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, found in zip(b.column(1), b.column(2).to_pylist()):
                t, removed, spans, kept, at = text.as_py(), 0, 0, hashlib.sha256(), 0
                end = -1
                for start, n in sorted((x["start"], x["n"]) for x in found or ()):
                    if start > end:
                        kept.update(t[max(at, end) : start])
                        spans += 1
                        at, end = start, start
                    removed += max(0, start + n + width - 1 - end)
                    end = max(end, start + n + width - 1)
                kept.update(t[max(end, 0) :])
                out.append((len(t), removed, spans, kept.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.record_batch([b.column(0), *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], names=names)

    return run


def _ordinals(docs: DataFrame) -> DataFrame:
    """Unique numbers `ord` in order of doc_id (null first) and text, for tables that repeat doc_ids; rows alike in both get them as they come."""
    parts = shuffle_partitions(docs.sparkSession)
    rows = docs.withColumn("sha", F.sha2("text", 256))
    rows = written(rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "sha").withColumn("pid", F.spark_partition_id()), "suffix-sorted")
    counts = {r.pid: r.n for r in rows.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    rank = F.row_number().over(Window.partitionBy("pid").orderBy(F.col("doc_id").asc_nulls_first(), "sha"))
    offset = F.get(F.array(*(F.lit(x).cast("long") for x in offsets or [0])), F.col("pid"))
    return written(rows.select((offset + rank).alias("ord"), "doc_id", "text"), "suffix-ordinals")


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = 1_000, batch_windows: int = 1 << 17, shard_windows: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte covered by a width-byte string that also starts earlier: in a smaller doc_id, or before in the same document.
    Strings are judged on the input; n_spans counts the maximal removed runs. Null texts count as empty; texts under width bytes lose
    nothing; very long texts are read in pieces that share width-1 bytes. Rows that share a doc_id are separate documents in the order of
    their SHA-256; null doc_ids come first. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    return _numbered(docs, lambda rows: _spans(rows, width, gram, hot, batch_windows, shard_windows))


def _numbered(docs: DataFrame, spans) -> DataFrame:
    """spans() of rows doc_id, text; where doc_ids repeat or are null, of rows numbered in their order."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).count():
        return spans(docs)
    numbered = _ordinals(docs)
    names = numbered.select(F.col("ord"), F.col("doc_id").alias("own_id"))
    out = spans(numbered.select(F.col("ord").alias("doc_id"), "text"))
    return out.join(names, F.col("doc_id") == F.col("ord")).select(F.col("own_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _stripped(text: DataFrame, every: DataFrame, width: int) -> DataFrame:
    lists = every.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("found"))
    return text.join(lists, "doc_id", "left").select("doc_id", "text", "found").mapInArrow(_strip(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _settled(docs: DataFrame, width: int, gram: int, hot: int, every: bool) -> DataFrame:
    runs = docs.mapInArrow(_scan(width, gram), "key long, cls long, doc_id long, pos long")
    found = runs.repartition(shuffle_partitions(docs.sparkSession), "key").sortWithinPartitions("key", "cls", "doc_id", "pos")
    return written(found.mapInArrow(_settle(hot, every), "kind int, doc_id long, start long, n long, key long"), "suffix-found")


def _with_hot(open_: DataFrame, keys: DataFrame) -> DataFrame:
    """open_ with `hot`: whether the key is one of keys.hot_key."""
    if not keys.limit(1).count():
        return open_.withColumn("hot", F.lit(False))
    return open_.join(broadcast_within(keys, 100_000), F.col("key") == F.col("hot_key"), "left").select(*open_.columns, F.col("hot_key").isNotNull().alias("hot"))


def _needs(open_: DataFrame) -> DataFrame:
    return open_.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "key", "hot")).alias("need"))


def _spans(docs: DataFrame, width: int, gram: int, hot: int, batch_windows: int, shard_windows: int) -> DataFrame:
    parts = shuffle_partitions(docs.sparkSession)
    found = _settled(docs, width, gram, hot, every=False)
    open_ = found.where("kind = 1").select("doc_id", "start", "n", "key")
    windows = open_.agg(F.sum("n")).first()[0] or 0
    open_ = _with_hot(open_, found.where("kind = 2").select(F.col("key").alias("hot_key")).distinct())
    text = docs.where("doc_id is not null").repartition(parts, "doc_id")  # one shuffle for both joins: the filter, which drops nothing, makes their scans the same
    segs = text.join(_needs(open_), "doc_id").select("doc_id", "text", "need").mapInArrow(_fetch(width), "shard long, doc_id long, start long, seg binary")
    shards = max(parts, -(-windows // shard_windows))
    repeats = segs.repartition(shards, "shard").sortWithinPartitions("doc_id", "start").select("doc_id", "start", "seg").mapInArrow(_search(width, batch_windows), "doc_id long, start long, n long")
    return _stripped(text, found.where("kind = 0").select("doc_id", "start", "n").union(repeats), width)


_KEPT = "shard long, level string, data binary, starts binary"
_ADDED = "kind int, doc_id long, start long, n long, shard long, level string, data binary, starts binary"


class SuffixIndex:
    """Families of suffix arrays in a folder that outlives the run. Each added batch is compared with itself and with all batches before it.

    Folder: `levels-G`, the levels written by generation G; `live-G`, which levels of any generation each shard has; `hot-G`, anchors with more than
    `hot` kinds of surroundings in one batch. A generation counts once its `live-G`, which is written last, is complete, so a batch that breaks off
    leaves the index as it was. Levels that no shard has any more go with their generation's table.

    An anchor's windows live in the shard of its hash. From the batch on in which it is hot, new windows are dealt one by one, by their own
    content, to a second set of shards; they are then also looked up, without entering, where the older ones are.
    """

    def __init__(self, spark: SparkSession, folder: str, width: int = WIDTH, gram: int = GRAM, hot: int = 1_000, shards: int = 1_024) -> None:
        self.spark, self.folder, self.width, self.gram, self.hot, self.shards = spark, folder.rstrip("/"), width, gram, hot, shards

    def generation(self) -> int:
        done = [int(n.removeprefix("live-")) for n in path_names(self.spark, self.folder) if n.startswith("live-") and path_exists(self.spark, f"{self.folder}/{n}/_SUCCESS")]
        return max(done, default=0)

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def levels(self) -> DataFrame:
        """shard, level, data, starts of every live level."""
        now = self.generation()
        if not now:
            return self.spark.createDataFrame([], _KEPT)
        live = self._table(f"live-{now}", "shard long, level string").withColumnRenamed("shard", "s")
        tables = [self._table(n, _KEPT) for n in path_names(self.spark, self.folder) if n.startswith("levels-") and int(n.removeprefix("levels-")) <= now]
        rows = tables[0]
        for t in tables[1:]:
            rows = rows.union(t)
        return rows.join(live, (F.col("s") == F.col("shard")) & (live["level"] == rows["level"]), "left_semi")

    def add_batch(self, docs: DataFrame) -> DataFrame:
        """Adds the documents; returns one row for each, as repeated_spans does. Documents of earlier batches come before all of this one.

        Repeated and null doc_ids are told apart within the batch, as there; across batches doc_ids are not compared. An empty batch adds nothing.
        """
        return _numbered(docs, self._add)

    def _add(self, docs: DataFrame) -> DataFrame:
        spark, now, parts, width = self.spark, self.generation() + 1, shuffle_partitions(self.spark), self.width
        for name in (f"levels-{now}", f"hot-{now}", f"live-{now}"):
            remove_path(spark, f"{self.folder}/{name}")  # what a batch that broke off left
        found = _settled(docs, width, self.gram, self.hot, every=True)
        hot = found.where("kind = 2").select(F.col("key").alias("hot_key"))
        if now > 1:
            hot = hot.union(self._table(f"hot-{now - 1}", "hot_key long"))
        hot.distinct().write.parquet(f"{self.folder}/hot-{now}")
        open_ = _with_hot(found.where("kind = 1").select("doc_id", "start", "n", "key"), self._table(f"hot-{now}", "hot_key long"))
        text = docs.where("doc_id is not null").repartition(parts, "doc_id")
        segs = text.join(_needs(open_), "doc_id").select("doc_id", "text", "need").mapInArrow(_fetch(width, both=now > 1), "shard long, doc_id long, start long, seg binary, enters boolean, single boolean")
        segs = segs.withColumn("shard", 2 * F.pmod(F.xxhash64("shard"), F.lit(self.shards)) + F.col("single").cast("long")).drop("single")
        added = segs.groupBy("shard").cogroup(self.levels().groupBy("shard")).applyInArrow(_add_to_shard(width, now), _ADDED)
        added = written(added, "suffix-added")
        added.where("kind = 1 and data is not null").select("shard", "level", "data", "starts").write.parquet(f"{self.folder}/levels-{now}")
        added.where("kind = 1").select("shard", "level").write.parquet(f"{self.folder}/live-{now}")
        self._forget(now)
        every = found.where("kind = 0").select("doc_id", "start", "n").union(added.where("kind = 0").select("doc_id", "start", "n"))
        return _stripped(text, every, width)

    def _forget(self, now: int) -> None:
        """Deletes the tables of generations none of whose levels is live; at most one short name per generation reaches the driver."""
        used = {r[0] for r in self._table(f"live-{now}", "shard long, level string").select(F.substring_index("level", "-", 1)).distinct().collect()}
        for name in path_names(self.spark, self.folder):
            kind, _, g = name.partition("-")
            if kind == "levels" and int(g) < now and g not in used or kind in ("live", "hot") and int(g) < now:
                remove_path(self.spark, f"{self.folder}/{name}")


def _add_to_shard(width: int, now: int):
    """A shard's new segments and its levels to findings (kind 0) and the shard's levels (kind 1; old ones without their bytes)."""

    def run(segs: pa.Table, kept: pa.Table) -> pa.Table:
        old = {name: Level(np.frombuffer(d, np.uint8), np.frombuffer(s, np.int64)) for name, d, s in zip(*(kept.column(c).to_pylist() for c in ("level", "data", "starts")))}
        names = {id(level.order): name for name, level in old.items()}
        family = SuffixFamily(width, list(old.values()))
        shard = (segs if segs.num_rows else kept).column("shard")[0].as_py()
        out = []
        if segs.num_rows:
            segs = segs.sort_by([("doc_id", "ascending"), ("start", "ascending")])
            doc, start = (np.asarray(segs.column(c).to_numpy(), np.int64) for c in ("doc_id", "start"))
            data, at, of, inner = _laid_out(segs.column("seg").to_pylist(), width)
            hit = family.add(data, at, np.array(segs.column("enters").to_pylist(), bool)[of])
            out = [(0, d, s, n, None, None, None, None) for d, s, n in zip(*(x.tolist() for x in _merged(doc[of[hit]], start[of[hit]] + inner[hit], np.ones(hit.sum(), np.int64))))]
        for i, level in enumerate(family.levels):
            name = names.get(id(level.order))
            out.append((1, None, None, None, shard, name or f"{now}-{shard}-{i}", None if name else level.data.tobytes(), None if name else level.order.astype(np.int64).tobytes()))
        kinds = (pa.int32(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["kind", "doc_id", "start", "n", "shard", "level", "data", "starts"])

    return run
