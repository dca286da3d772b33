"""Quality rules: fixed rules on document statistics, then gradient-boosted trees over the same statistics.

The statistics of every text are taken in one pass over Arrow batches and staged. A bounded sample of labelled
rows trains the trees on the driver; their nodes are flattened into numpy arrays, which tasks score batchwise.

Nulls and odd input: a null text counts as the empty text (no words, base_failed). Repeated rows each get a row.
Labels that are null or belong to no document are left out of training; without labels of both kinds the trees
have no verdict and ``kept`` is the base rules' alone. Columns other than the id and the text pass unread.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import ASCII_SPACE, below, stage

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
PUNCTUATION = b".,;:!?"

#: The trees' features, and +1 where the score may only rise with the feature, -1 where it may only fall.
FEATURES = {
    "mean_word": 0, "symbol_rate": -1, "upper_rate": -1, "digit_rate": 0, "punctuation_rate": 0, "bang_rate": -1,
    "bar_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "distinct_rate": 0, "words_per_line": 0, "log_words": 0,
}
#: Labelled rows that training reads at most (expected number under hash sampling).
SAMPLE_ROWS = 20_000

BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCHEMA = f"{BASE}, features array<float>"


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The five base counts and the features of one text."""
    raw = text.encode("utf-8", "replace")
    found = raw.split()
    n = len(found)
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    chars = len(text) - without(ASCII_SPACE)
    symbols = without(SYMBOLS)
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated = 0
    windows = list(zip(found, found[1:], found[2:], strict=False))
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        upto = 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    w, c = max(n, 1), max(chars, 1)
    features = [
        chars / w, symbols / w, without(UPPER) / c, without(DIGITS) / c, without(PUNCTUATION) / w, without(b"!") / w,
        without(b"|") / w, dup / max(lines, 1), repeated / w, len(set(found)) / w, n / max(lines, 1), float(np.log1p(n)),
    ]
    return [n, chars, symbols, dup, repeated], features


def document_statistics(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base counts and the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [statistics(t or "") for t in part.column("text").to_pylist()]
                base = np.array([r[0] for r in rows], np.int64).reshape(-1, 5)
                columns = [pa.array(base[:, i]) for i in range(5)]
                features = pa.array([r[1] for r in rows], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, features], names=["doc_id", *names, "features"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


@dataclass
class Trees:
    """Complete binary trees of one depth: node i's children are 2i + 1 and 2i + 2; leaves hold values."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        depth = int(np.log2(self.leaf.shape[1]))
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Boosted trees under logistic loss. A split on a constrained feature whose children's values run against the
    constraint isn't taken, and the children's values are bounded by their middle, so that scores stay monotonic."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    margin = np.full(len(y), start)
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node, low, high = np.zeros(len(y), np.int64), {0: -np.inf}, {0: np.inf}
        for i in range(inner):
            here = node == i
            low[2 * i + 1] = low[2 * i + 2] = low[i]
            high[2 * i + 1] = high[2 * i + 2] = high[i]
            best = (1e-6, None)
            gi, hi = g[here], h[here]
            total_g, total_h = gi.sum(), hi.sum()
            for j, e in enumerate(edges):
                if not len(e) or not len(gi):
                    continue
                cg = np.cumsum(np.bincount(binned[here, j], gi, len(e) + 1))[:-1]
                ch = np.cumsum(np.bincount(binned[here, j], hi, len(e) + 1))[:-1]
                left, right = np.clip(-cg / (ch + ridge), low[i], high[i]), np.clip(-(total_g - cg) / (total_h - ch + ridge), low[i], high[i])
                gain = cg**2 / (ch + ridge) + (total_g - cg) ** 2 / (total_h - ch + ridge) - total_g**2 / (total_h + ridge)
                gain[(ch < 1) | (total_h - ch < 1) | (monotone[j] * (right - left) < 0)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k, left[k], right[k])
            if best[1] is not None:
                _, j, k, left, right = best
                feature[i], threshold[i] = j, edges[j][k]
                middle = (left + right) / 2
                if monotone[j] > 0:
                    high[2 * i + 1], low[2 * i + 2] = middle, middle
                elif monotone[j] < 0:
                    low[2 * i + 1], high[2 * i + 2] = middle, middle
            node[here] = 2 * i + 1 + (x[here, feature[i]] > threshold[i])
        place = node - inner
        sum_g, sum_h = np.bincount(place, g, leaves), np.bincount(place, h, leaves)
        bounds = np.array([(low[inner + k], high[inner + k]) for k in range(leaves)])
        value = np.where(sum_h > 0, np.clip(-sum_g / (sum_h + ridge), bounds[:, 0], bounds[:, 1]), 0.0) * rate
        margin += value[place]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), start)


@dataclass
class Model:
    trees: Trees
    cut: float


def train(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, false_drop: float = 0.002) -> Model | None:
    """Fits on at most about ``sample_rows`` labelled rows, picked by a hash of the id. A third of them is held
    back to set the cut: the highest, up to 0.5, that drops at most ``false_drop`` of the good rows held back."""
    labels = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).dropna()
    n = labels.count()
    pick = below(F.col("doc_id"), sample_rows / max(n, 1))
    rows = stats.filter(pick).join(labels.filter(pick), "doc_id").select("doc_id", "features", "quality").collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality, r.features))
    x, y = np.array([r.features for r in rows], np.float32), np.array([r.quality for r in rows], float)
    if len(rows) < 20 or not 0 < y.sum() < len(y):
        return None
    held = np.arange(len(y)) % 3 == 0
    trees = fit(x[~held], y[~held], list(FEATURES.values()))
    good = np.sort(trees.score(x[held & (y == 1)])) if (held & (y == 1)).any() else np.array([0.5])
    return Model(trees, float(min(0.5, good[int(false_drop * len(good))])))


def judge(stats: DataFrame, model: Model | None) -> DataFrame:
    """Adds base_failed, score (probability of good quality; null without a model) and kept."""
    plain = BASE.replace("doc_id long, ", "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            score = model.trees.score(x)
            fine = score >= model.cut
            names = [n for n in batch.schema.names if n != "features"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(score), pa.array(fine)], names=[*names, "score", "fine"])

    if model is None:
        scored = stats.drop("features").withColumns({"score": F.lit(None).cast("double"), "fine": F.lit(True)})
    else:
        scored = stats.mapInArrow(run, f"doc_id long, {plain}, score double, fine boolean")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("fine")).drop("fine")


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: the base counts, base_failed, score and kept."""
    stats = stage(document_statistics(docs), "quality-statistics")
    return judge(stats, train(stats, labels, sample_rows))
