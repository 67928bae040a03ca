"""Operator 10: quality rules and an isolation forest over their statistics.

The statistics of every text are counted exactly.  A forest of random splits over all
their ratios is grown on the good rows of a bounded sample of labelled rows; a text that
few splits separate from them is an anomaly.  Ratios are measured in units of their
spread among these rows, and the wider a ratio of a node the likelier it is cut, also
between the rows of the node and a text beyond them: one ratio far off is enough, and
what varies little costs nothing.  The threshold on the anomaly score is calibrated on
all labelled rows: it rejects as many low-quality rows as possible while it
loses at most ``GOOD_LOSS`` of the good ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepkit.functions.stats import exact_quantiles
from prepkit.llm import docstats as S

SAMPLE_ROWS = 20_000    #: labelled rows that the forest is grown on, at most
TREES = 100
TREE_ROWS = 256
GOOD_LOSS = 0.002
MIN_WORDS = 20
LEAST_SPREAD = 0.05     #: of a ratio, so that one that is the same in all good rows has a unit
SCORED_ROWS = 2048      #: scored at a time
_ENDS = (1, 99)         #: percentiles between which the spread is measured


def _expected_depth(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, np.float64)
    safe = np.maximum(n, 2)
    return np.where(n > 1, 2 * (np.log(safe - 1 + 1e-12) + np.euler_gamma) - 2 * (n - 1) / safe, 0.0)


@dataclass
class Forest:
    """Trees as flat arrays; node i has children left[i] and left[i] + 1, a leaf has left = -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    depth: np.ndarray      #: of a leaf, with the expected rest for the rows left in it
    low: np.ndarray        #: least value of each feature among the rows of a node
    high: np.ndarray
    unit: np.ndarray       #: of each feature
    roots: np.ndarray
    levels: int
    norm: float
    threshold: float = 1.0      #: for the rows it was grown on; quality_rules takes that of all rows

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in 0..1 of each row, 2 ** (- mean expected path / expected path of a sampled row)."""
        parts = [self._score(x[i:i + SCORED_ROWS] / self.unit) for i in range(0, len(x), SCORED_ROWS)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        span = (self.high - self.low).sum(1)
        for root in self.roots:
            node = np.full(len(x), root)
            together = np.ones(len(x))      # odds that no cut so far went between the row and the node's rows
            for level in range(self.levels):
                inner = self.left[node] >= 0
                beyond = (np.maximum(self.low[node] - x, 0) + np.maximum(x - self.high[node], 0)).sum(1)
                apart = np.where(inner, beyond / np.maximum(beyond + span[node], 1e-300), 0.0)
                total += together * apart * (level + 1)
                together *= 1 - apart
                right = x[rows, self.feature[node]] >= self.cut[node]
                node = np.where(inner, self.left[node] + right, node)
            total += together * self.depth[node]
        return 2.0 ** (-total / len(self.roots) / self.norm)


def grow(x: np.ndarray, seed: int = 7) -> Forest:
    """Isolation trees over samples of TREE_ROWS rows of x."""
    rng = np.random.default_rng(seed)
    ends = np.percentile(x, _ENDS, axis=0)
    unit = np.maximum(ends[1] - ends[0], LEAST_SPREAD)
    x = x / unit
    feature, cut, left, depth, roots, lows, highs = [], [], [], [], [], [], []
    size = min(TREE_ROWS, len(x))
    levels = max(1, int(np.ceil(np.log2(max(size, 2)))))
    for _ in range(TREES):
        rows = x[rng.choice(len(x), size, replace=False)]
        roots.append(len(left))
        todo = [(len(left), rows, 0)]
        for part in (feature, cut, left, depth, lows, highs):
            part.append(0)
        while todo:
            at, rows, level = todo.pop()
            low, high = rows.min(0), rows.max(0)
            lows[at], highs[at] = low, high
            wide = high - low
            if level >= levels or len(rows) < 2 or not wide.any():
                feature[at], cut[at], left[at] = 0, 0.0, -1
                depth[at] = level + float(_expected_depth(len(rows)))
                continue
            f = int(rng.choice(len(wide), p=wide / wide.sum()))
            # (low, high]: both sides get rows
            c = float(high[f] - rng.random() * wide[f])
            feature[at], cut[at], left[at], depth[at] = f, c, len(left), 0.0
            for side in (rows[rows[:, f] < c], rows[rows[:, f] >= c]):
                todo.append((len(left), side, level + 1))
                for part in (feature, cut, left, depth, lows, highs):
                    part.append(0)
    return Forest(np.array(feature), np.array(cut, float), np.array(left), np.array(depth, float),
                  np.array(lows, float), np.array(highs, float), unit,
                  np.array(roots), levels, max(float(_expected_depth(size)), 1e-9))


def calibrated(score: np.ndarray, good: np.ndarray) -> float:
    """Scores above it are anomalies: the least threshold that loses GOOD_LOSS of the good rows at most."""
    kept = np.sort(score[good])
    if not len(kept):
        return 1.0
    allowed = int(len(kept) * GOOD_LOSS)
    return float(kept[len(kept) - 1 - allowed])


def fit(columns: dict[str, np.ndarray], quality: np.ndarray) -> Forest | None:
    """The forest of a labelled sample; None without good rows (then only the base rules judge)."""
    x = S.ratios(columns)
    good = ~base_failed(columns) & (quality == 1)
    if not good.any():
        return None
    forest = grow(x[good])
    forest.threshold = calibrated(forest.score(x[good]), np.ones(int(good.sum()), bool))
    return forest


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


def quality_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """documents(doc_id, text), labels(doc_id, quality) -> one row per document.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words long,
    base_failed boolean, anomaly double (0..1, higher: odder), kept boolean.  A null or
    empty text has zeros and fails the base rules.  Without good labelled rows no text
    is an anomaly and ``anomaly`` is 0.  Null labels and null doc_ids teach nothing;
    repeated rows each give a row; other columns are ignored.
    """
    stats = S.doc_stats(docs).checkpoint()
    forest = fit(*S.labelled_sample(stats, labels, sample_rows))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {f: batch.column(f).to_numpy() for f in S.FIELDS}
            failed = base_failed(c)
            score = np.zeros(len(failed)) if forest is None or not len(failed) else forest.score(S.ratios(c))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(batch.column(f) for f in names), pa.array(failed), pa.array(score)],
                ["doc_id", *names, "base_failed", "anomaly"])

    scored = stats.select("doc_id", *[F.col(f) for f in S.FIELDS]).mapInArrow(
        judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
               "n_repeat_words long, base_failed boolean, anomaly double")
    if forest is None:
        return scored.withColumn("kept", ~F.col("base_failed"))
    scored = scored.checkpoint()
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= all_good_below(scored, labels)))


def all_good_below(scored: DataFrame, labels: DataFrame) -> float:
    """``calibrated`` over all good labelled rows that pass the base rules, not only a sample."""
    good = (scored.where("not base_failed").join(S.agreed_labels(labels).where("quality = 1"), "doc_id")
            .select(F.lit(0).alias("k"), F.col("anomaly").alias("v")))
    return exact_quantiles(good, [1 - GOOD_LOSS], discrete=True)[0][0]
