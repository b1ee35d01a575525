"""Toxicity: a logistic classifier over words and word stems, regularised by counterfactuals.

Every labelled text has counterfactuals. If it mentions identity terms, each is swapped for every other member of its group. If it mentions
none, a group is chosen by a hash of the text, and the text is completed by a mention of each of its members in turn; the first of these,
chosen by the same hash, also counts as an example with the text's label, at a small weight, as the neutral mention it is. The penalty is the
mean squared change of the probability under the swaps, so weight that a term gained by the company it keeps in the sample is given up.

Features are chosen by a test of their association with the label, at a level that allows for the number of features tested; the identity
terms' own features always take part. Only the chosen ones reach the driver.

The classifier is fitted on at most `max_train` labelled rows, taken in order of a hash of doc_id; every document is scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

# Identity terms by group, in English, German, French and Spanish.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("woman", "man"), ("women", "men"), ("female", "male"), ("girls", "boys"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("frau", "mann"), ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("femme", "homme"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)

#: A-Z to lower case, other ASCII but digits to blanks; bytes above 127 stay, so words of any script keep together.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))
_STEMS = (4, 5, 6)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _hash(feature: bytes) -> int:
    return xxhash.xxh64_intdigest(feature) - (1 << 63)


def word_features(word: bytes) -> list[int]:
    """Hashes of the word and of its stems; a stem is marked, so it differs from the word spelt the same."""
    return [_hash(word), *(_hash(b"*" + word[:k]) for k in _STEMS if len(word) > k)]


def features(words) -> set[int]:
    return {f for w in set(words) for f in word_features(w)}


class Counterfactuals:
    """The changes of a text's features under swaps of identity terms, for texts as lists of words."""

    def __init__(self, terms=IDENTITY_TERMS) -> None:
        self.groups = [[t.encode() for t in g] for g in terms if len(g) > 1]
        self.place = {t: (g, i) for g, members in enumerate(self.groups) for i, t in enumerate(members)}

    def features(self) -> set[int]:
        return features(self.place)

    def of(self, words: list[bytes]) -> tuple[set[int], list[set[int]]]:
        """The features of the text that the swaps are compared with, and those of each swapped text."""
        mentioned = {w for w in words if w in self.place}
        if mentioned:
            rest = features(w for w in words if w not in self.place)
            groups = {self.place[w][0] for w in mentioned}
            most = max(len(self.groups[g]) for g in groups)
            moved = lambda k: {self.groups[self.place[w][0]][(self.place[w][1] + k) % len(self.groups[self.place[w][0]])] for w in mentioned}
            return rest | features(mentioned), [rest | features(moved(k)) for k in range(1, most)]
        own = features(words)
        if not self.groups:
            return own, []
        h = xxhash.xxh64_intdigest(b" ".join(words))
        members = self.groups[h % len(self.groups)]
        first = h // len(self.groups) % len(members)
        variants = [own | features([members[(first + k) % len(members)]]) for k in range(len(members))]
        return variants[0], variants[1:]


@dataclass
class Model:
    bias: float = float(np.log(0.1 / 0.9))
    weights: dict[int, float] = field(default_factory=dict)

    def scorer(self, memory: int = 100_000):
        """Text to score. Of each word, what it adds is remembered, for up to `memory` words at a time."""
        known: dict[bytes, tuple] = {}
        weights, bias, nothing = self.weights, self.bias, ()

        def score(text: bytes | None) -> float:
            hits: set[int] = set()
            for w in set(words_of(text or b"")):
                got = known.get(w)
                if got is None:
                    if len(known) >= memory:
                        known.clear()
                    got = known[w] = tuple(f for f in word_features(w) if f in weights) or nothing
                if got:
                    hits.update(got)
            s = bias + sum(weights[f] for f in sorted(hits))
            return float(1 / (1 + np.exp(-np.clip(s, -40, 40))))

        return score


class Problem:
    """Examples and counterfactual pairs in index form, with the loss and its gradient.

    rows, labels, weights: the features present in each example, its label and its share of the log loss. pairs: (row, features lost,
    features gained) of a swapped text against example `row`. Loss: weighted log loss + l2 |w|^2 / 2 + penalty * mean (p - p')^2 over pairs.
    """

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, n_features: int, pairs: list[tuple[int, np.ndarray, np.ndarray]], penalty: float, l2: float) -> None:
        flat = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
        self.n, self.labels, self.share, self.n_features = len(rows), labels, weights / max(weights.sum(), 1e-12), n_features
        self.at, self.idx = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), flat(rows)
        self.base = np.array([p[0] for p in pairs], np.int64)
        self.p_at = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for _, a, b in pairs])
        self.p_idx = flat([np.r_[a, b] for _, a, b in pairs])
        self.p_sign = np.concatenate([np.zeros(0), *(np.r_[-np.ones(len(a)), np.ones(len(b))] for _, a, b in pairs)])
        self.penalty, self.l2 = penalty, l2

    def probabilities(self, b: float, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the examples and of the swapped texts."""
        s = b + np.bincount(self.at, w[self.idx], minlength=self.n)
        swapped = s[self.base] + np.bincount(self.p_at, self.p_sign * w[self.p_idx], minlength=len(self.base))
        return tuple(1 / (1 + np.exp(-np.clip(x, -40, 40))) for x in (s, swapped))

    def change(self, b: float, w: np.ndarray) -> float:
        """Mean absolute change of the probability under the swaps."""
        p, q = self.probabilities(b, w)
        return float(np.abs(q - p[self.base]).mean()) if len(self.base) else 0.0

    def loss(self, b: float, w: np.ndarray) -> float:
        p, q = self.probabilities(b, w)
        log = -(self.share * np.log(np.where(self.labels > 0, p, 1 - p))).sum()
        return float(log + self.l2 * (w @ w) / 2 + (self.penalty * ((q - p[self.base]) ** 2).mean() if len(self.base) else 0.0))

    def gradient(self, b: float, w: np.ndarray) -> tuple[float, np.ndarray]:
        p, q = self.probabilities(b, w)
        d = self.share * (p - self.labels)  # by the score of each example
        grad = self.l2 * w
        if len(self.base):
            gap = 2 * self.penalty * (q - p[self.base]) / len(self.base)
            up = gap * q * (1 - q)
            d = d + np.bincount(self.base, up - gap * (p * (1 - p))[self.base], minlength=self.n)
            grad = grad + np.bincount(self.p_idx, self.p_sign * up[self.p_at], minlength=self.n_features)
        return float(d.sum()), grad + np.bincount(self.idx, d[self.at], minlength=self.n_features)


def fit_logistic(problem: Problem, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights by Adam from the labels' log odds."""
    share = float(np.clip((problem.share * problem.labels).sum(), 1e-3, 1 - 1e-3))
    w, b = np.zeros(problem.n_features), float(np.log(share / (1 - share)))
    m, v = np.zeros(problem.n_features + 1), np.zeros(problem.n_features + 1)
    for t in range(1, steps + 1):
        by_b, by_w = problem.gradient(b, w)
        g = np.r_[by_w, by_b]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - float(step[-1])
    return b, w


def _list_column(lists: list[list[int]], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([x for one in lists for x in one], kind))


def training_problem(
    docs: DataFrame, labels: DataFrame, penalty: float = 1.0, max_train: int = 20_000, min_docs: int = 5, slot_weight: float = 0.1, l2: float = 1e-5, terms=IDENTITY_TERMS
) -> tuple[Problem | None, dict[int, int], float]:
    """The problem, the index of each feature in it, and the log odds for a model without features where the problem is None.

    labels holds training rows only (doc_id, toxic). Bounds: of the labelled doc_ids the max_train with the smallest hashes are taken, ties by
    doc_id; rows with null doc_id or label are left out; a doc_id labelled twice counts as toxic if it is once; rows that share a doc_id are
    examples each. Features that occur in fewer than min_docs examples are not tested; all that pass the test are used.
    """
    picked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)  # at most max_train pairs of numbers, so the broadcast is bounded
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(F.broadcast(picked), "doc_id")
    texts = written(texts.select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("y")), "toxicity-train", files=8)
    swaps = Counterfactuals(terms)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[int] = []
            toxic: list[int] = []
            for t, y in zip(b.column(0), b.column(1).to_pylist()):
                f = features(words_of(t.as_py()))
                found.extend(f)
                toxic.extend([y] * len(f))
                if len(found) > 1 << 16:
                    yield pa.record_batch([pa.array(found, pa.int64()), pa.array(toxic, pa.int32())], names=["f", "y"])
                    found, toxic = [], []
            yield pa.record_batch([pa.array(found, pa.int64()), pa.array(toxic, pa.int32())], names=["f", "y"])

    totals = {r.y: r.n for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n = totals.get(1, 0), sum(totals.values())
    if not n1 or n1 == n:
        return None, {}, float(np.log((n1 + 1) / (n - n1 + 9)))
    counts = texts.select("text", "y").mapInArrow(every, "f long, y int").groupBy("f").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("y").cast("long")).alias("p")).where(F.col("c") >= min_docs)
    counts = written(counts, "toxicity-counts", compact=True)
    expected = F.col("c") * (n1 / n)
    z = (F.col("p") - expected) / F.sqrt(expected * (1 - n1 / n) * (1 - F.col("c") / n) + 1e-9)
    level = float(np.sqrt(2 * np.log(max(counts.count(), 2))))
    chosen = [r.f for r in counts.where(F.abs(z) >= level).orderBy("f").collect()]  # about one by chance; never more than the bounded sample holds
    index = {f: i for i, f in enumerate([*chosen, *sorted(swaps.features() - set(chosen))])}

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = lambda fs: sorted(index[f] for f in fs if f in index)
        for b in batches:
            own, base, swapped = [], [], []
            for t in b.column(0):
                words = words_of(t.as_py())
                against, variants = swaps.of(words)
                own.append(pick(features(words)))
                base.append(pick(against))
                # each variant: features lost, -1, features gained, -1
                swapped.append([x for v in variants for x in (*pick(against - v), -1, *pick(v - against), -1)])
            yield pa.record_batch([b.column(1), *(_list_column(c, pa.int32()) for c in (own, base, swapped))], names=["y", "own", "base", "swapped"])

    rows = texts.orderBy("doc_id", F.xxhash64("text")).select("text", "y").mapInArrow(selected, "y int, own array<int>, base array<int>, swapped array<int>").collect()
    examples, y, weight, pairs = [], [], [], []
    for r in rows:
        examples.append(np.array(r.own, np.int64))
        y.append(r.y)
        weight.append(1.0)
        if r.base != r.own:
            examples.append(np.array(r.base, np.int64))
            y.append(r.y)
            weight.append(slot_weight)
        cuts = [-1, *(i for i, x in enumerate(r.swapped) if x < 0)]
        parts = [np.array(r.swapped[a + 1 : b], np.int64) for a, b in zip(cuts, cuts[1:])]
        pairs += [(len(examples) - 1, lost, gained) for lost, gained in zip(parts[::2], parts[1::2])]
    return Problem(examples, np.array(y, float), np.array(weight), len(index), pairs, penalty, l2), index, 0.0


def train(docs: DataFrame, labels: DataFrame, **kwargs) -> Model:
    """Fits on the labelled documents; see training_problem for parameters, bounds and ties. Without both classes the model is a constant."""
    problem, index, odds = training_problem(docs, labels, **kwargs)
    if problem is None:
        return Model(odds)
    bias, w = fit_logistic(problem)
    return Model(bias, {f: float(w[i]) for f, i in index.items()})


def score_documents(docs: DataFrame, model: Model, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns and score (0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights of features of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for b in batches:
            yield pa.record_batch([*(b.column(i) for i in range(len(keys))), pa.array([score(t.as_py()) for t in b.column(len(keys))], pa.float64())], names=[*keys, "score"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", score double"
    return docs.select(*keys, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(run, schema)


def held_out(doc_id) -> "F.Column":
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **kwargs) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Labels of held-out documents are not read.

    Null and empty texts score as texts without features; very long texts are scored whole. Repeated rows score alike; repeated labels of a
    document count as toxic if one is. Null doc_ids are scored and not held out. Without labels the score is a constant below the
    threshold. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    model = train(docs, labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id"))), **kwargs)
    scored = score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **kwargs) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, that score below the threshold. Only texts go to Python; nothing is shuffled.

    Null and empty texts score as texts without features. Repeated rows share their fate. Without labels every row stays. An empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id"))), **kwargs))

    @F.arrow_udf("boolean")
    def passes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = shared.value.scorer()
        for some in texts:
            yield pa.array([score(t.as_py()) < threshold for t in some], pa.bool_())

    return docs.where(passes(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
