"""Quality score by gradient-boosted trees over document statistics.

The statistics of a bounded labelled sample are put into quantile bins; each tree is grown level by level from sums of
gradients by node and bin, for the logistic loss. The trees are full binary trees of one depth, flattened into arrays of
split columns, thresholds and leaf values, so that a batch of documents walks down all trees with a few numpy steps.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fertility import base_counts
from .labelled import held_out, training_texts
from .scratch import sliced

LOW_DOCS, HIGH_DOCS = 1500, 2500
THRESHOLD = 0.3
STATISTICS = (
    "log_words", "chars_per_word", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "non_ascii", "distinct", "top_word", "words_per_line",
    "lines_ended", "single_chars", "capitalised", "word_entropy", "exclaimed", "commas", "longest_word", "short_lines", "bars", "shouted",
)
_UPPER, _DIGIT, _MARK = (bytes(range(65, 91)), b"0123456789", b".,;:!?\"'()-")
_CAPITAL = re.compile(rb"(?:^|[ \n])[A-Z]")


def statistics(text: bytes) -> list[float]:
    """The statistics of a whole text; all zero for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, chars, symbols, dup, repeat = base_counts(text, words)
    size = len(text)
    without = lambda cut: size - len(text.translate(None, cut))
    lines = [x for x in (line.strip() for line in text.split(b"\n")) if x]
    times = Counter(words)
    share = np.array(list(times.values()), float) / n
    return [
        float(np.log1p(n)),
        chars / n,
        symbols / size,
        dup / len(lines),
        repeat / n,
        without(_UPPER) / size,
        without(_DIGIT) / size,
        without(_MARK) / size,
        sum(1 for _ in re.finditer(rb"[\xC2-\xF4]", text)) / size,
        len(times) / n,
        float(share.max()),
        n / len(lines),
        sum(x[-1:] in b".!?" for x in lines) / len(lines),
        sum(len(w) == 1 for w in words) / n,
        len(_CAPITAL.findall(text)) / n,
        float(-(share * np.log2(share)).sum() / np.log2(n + 1)),
        text.count(b"!") / n,
        text.count(b",") / n,
        float(min(max(map(len, times)), 1000)),
        sum(len(x) < 20 for x in lines) / len(lines),
        text.count(b"|") / n,
        sum(c for w, c in times.items() if len(w) > 1 and w.isupper()) / n,
    ]


@dataclass
class Forest:
    """column, threshold: trees x inner nodes; leaf: trees x leaves. A row goes right at a node if its value is above the threshold."""

    start: float
    column: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.column) or not len(rows):
            return np.full(len(rows), 1 / (1 + np.exp(-self.start)))
        trees, inner = self.column.shape
        at = np.zeros((len(rows), trees), np.int64)
        tree = np.arange(trees)
        for _ in range(int(np.log2(inner + 1))):
            value = np.take_along_axis(rows, self.column[tree, at], axis=1)
            at = 2 * at + 1 + (value > self.threshold[tree, at])
        return 1 / (1 + np.exp(-np.clip(self.start + self.leaf[tree, at - inner].sum(axis=1), -60, 60)))


def grow(rows: np.ndarray, labels: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 1.0, least: float = 1.0) -> Forest:
    """Boosted trees for the logistic loss; without both labels the forest has no trees and a constant score."""
    mean = float(np.clip(labels.mean(), 1e-4, 1 - 1e-4)) if len(labels) else 0.5
    start = float(np.log(mean / (1 - mean)))
    inner, leaves, width = 2**depth - 1, 2**depth, rows.shape[1]
    if not len(labels) or labels.min() == labels.max():
        return Forest(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], rows[:, j], side="left") for j in range(width)], axis=1)
    score = np.full(len(rows), start)
    column, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, curve = labels - p, p * (1 - p)
        node = np.zeros(len(rows), np.int64)
        for level in range(depth):
            count, first = 2**level, 2**level - 1
            g, h = np.zeros((width, count, bins)), np.zeros((width, count, bins))
            for j in range(width):
                cell = (node - first) * bins + binned[:, j]
                g[j] = np.bincount(cell, grad, count * bins).reshape(count, bins)
                h[j] = np.bincount(cell, curve, count * bins).reshape(count, bins)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
            gain[(hl < least) | (ht - hl < least)] = 0
            for k in range(count):
                j, b = np.unravel_index(int(np.argmax(gain[:, k])), (width, bins))
                if gain[j, k, b] > 1e-9 and b < len(edges[j]):
                    column[t, first + k], threshold[t, first + k] = j, edges[j][b]
            value = np.take_along_axis(rows, column[t, node][:, None], axis=1)[:, 0]
            node = 2 * node + 1 + (value > threshold[t, node])
        at = node - inner
        leaf[t] = rate * np.bincount(at, grad, leaves) / (np.bincount(at, curve, leaves) + penalty)
        score += leaf[t, at]
    return Forest(start, column, threshold, leaf)


def fit(docs: DataFrame, labels: DataFrame, low_docs: int = LOW_DOCS, high_docs: int = HIGH_DOCS, **how) -> Forest:
    """Train on at most low_docs and high_docs labelled documents outside the held-out fold."""
    texts = training_texts(docs, labels, "quality", {0: low_docs, 1: high_docs})
    rows = np.array([statistics(t.encode()) for t, _ in texts]).reshape(-1, len(STATISTICS))
    return grow(rows, np.array([y for _, y in texts], float), **how)


def quality(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score.

    A null text counts as empty; a text without words has the score of all-zero statistics. A very long text is measured
    whole; a value equal to a threshold goes left. Repeated rows are scored each, null identifiers stay, extra columns are
    not read, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = np.array([statistics(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(rows), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def verdicts(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = quality(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
