"""Operator 9: quality classifier, a generalised additive model with pairwise interactions.

Cyclic boosting: in every round each feature gets one shallow tree over its bins,
fitted to the current gradient; the trees of a feature add up to one lookup table.
Then the pairs of features that explain most of what is left get tables of their
own, grown the same way by trees of two cuts.  A score is a sum of table entries,
so scoring is a vectorised binning and a handful of additions.

The model is fitted on at most ``SAMPLE_ROWS`` labelled rows (a hash of doc_id
chooses them); every text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepkit.llm import docstats as S

SAMPLE_ROWS = 50_000   #: labelled rows that the model is fitted on, at most
BINS = 32
PAIR_BINS = 8
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 6
RATE = 0.1
LEAVES = 4
RIDGE = 5.0            #: pseudo rows of gradient 0 in every leaf
KEEP_AT = 0.3


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between different values at about equal numbers of rows; extremes get bins of their own."""
    q = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower")
    values = np.unique(x)
    spread = np.quantile(values, np.linspace(0, 1, bins // 2 + 1)[1:-1], method="lower")
    cuts = np.unique(np.concatenate([q, spread]))
    nxt = values[np.minimum(np.searchsorted(values, cuts, "right"), len(values) - 1)]
    return np.unique((cuts + nxt) / 2)


def _leaf(g: float, h: float) -> float:
    return g / (h + RIDGE * 0.25)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE * 0.25)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per bin of a tree of LEAVES leaves over ordered bins with gradient g and curvature h."""
    parts = [(0, len(g))]
    while len(parts) < LEAVES:
        best = (1e-9, None, None)
        for lo, hi in parts:
            if hi - lo < 2:
                continue
            gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
            gs, hs = g[lo:hi].sum(), h[lo:hi].sum()
            gain = _gain(gl, hl) + _gain(gs - gl, hs - hl) - _gain(gs, hs)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), (lo, hi), lo + k + 1)
        if best[1] is None:
            break
        lo, hi = best[1]
        parts.remove((lo, hi))
        parts += [(lo, best[2]), (best[2], hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on each axis of a grid."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, table = 0.0, np.zeros_like(g)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            quads = []
            for c in (cg, ch):
                a, row, col, all_ = c[i, j], c[i, -1], c[-1, j], c[-1, -1]
                quads.append(np.array([a, row - a, col - a, all_ - row - col + a]))
            gain = float(_gain(*quads).sum() - _gain(cg[-1, -1], ch[-1, -1]))
            if gain > best:
                v = quads[0] / (quads[1] + RIDGE * 0.25)
                table = np.empty_like(g)
                table[:i + 1, :j + 1], table[:i + 1, j + 1:] = v[0], v[1]
                table[i + 1:, :j + 1], table[i + 1:, j + 1:] = v[2], v[3]
                best = gain
    return best, table


@dataclass
class Gam:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, f], "right")]
        for (f, k), table in self.pairs.items():
            total += table[np.searchsorted(self.pair_edges[f], x[:, f], "right"),
                           np.searchsorted(self.pair_edges[k], x[:, k], "right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Without rows, or with one class only, a constant (0.5 without rows)."""
    n, features = x.shape
    rate = (y.sum() + 0.5) / (n + 1.0) if n else 0.5
    model = Gam(float(np.log(rate / (1 - rate))))
    if n == 0 or y.min() == y.max():
        return model
    model.edges = [_edges(x[:, f], BINS) for f in range(features)]
    model.pair_edges = [_edges(x[:, f], PAIR_BINS) for f in range(features)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    total = np.full(n, model.base)

    def slope():
        p = 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(features):
            g, h = slope()
            size = len(model.tables[f])
            step = RATE * _tree(np.bincount(bins[f], g, size), np.bincount(bins[f], h, size))
            step = np.clip(step, -1, 1)
            model.tables[f] += step
            total += step[bins[f]]
    small = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.pair_edges)]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def grid(f, k, v):
        return np.bincount(small[f] * sizes[k] + small[k], v, sizes[f] * sizes[k]).reshape(sizes[f], sizes[k])

    g, h = slope()
    ranked = sorted(((_cross(grid(f, k, g), grid(f, k, h))[0], f, k)
                     for f in range(features) for k in range(f + 1, features)), reverse=True)
    chosen = [(f, k) for gain, f, k in ranked[:PAIRS] if gain > 0]
    model.pairs = {p: np.zeros((sizes[p[0]], sizes[p[1]])) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for f, k in chosen:
            g, h = slope()
            step = np.clip(RATE * _cross(grid(f, k, g), grid(f, k, h))[1], -1, 1)
            model.pairs[f, k] += step
            total += step[small[f], small[k]]
    return model


#: rows whose label may be learned from
LEARN = "crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"


def _learned(stats: DataFrame, labels: DataFrame, sample_rows: int) -> Gam:
    columns, quality = S.labelled_sample(stats, labels, sample_rows, LEARN)
    return fit(S.ratios(columns), quality)


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """documents(doc_id, text), labels(doc_id, quality) -> doc_id, held_out, score, predicted.

    One row per document.  Labels are learned from rows whose crc32(doc_id as text) mod 5
    is not 0; the others (and null doc_ids) are held out.  Only the text is an input of the
    score, which is higher where label 1 is likelier; null and empty texts are scored as
    texts without words.  ``predicted`` is 1 from a score of 0.3.  Null or contradicting
    labels teach nothing; without labels every score is 0.5.
    """
    stats = S.doc_stats(docs).checkpoint()
    model = _learned(stats, labels, sample_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = S.ratios({f: batch.column(f).to_numpy() for f in S.FIELDS})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))],
                                             ["doc_id", "score"])

    return stats.mapInArrow(score, "doc_id long, score double").select(
        "doc_id", F.coalesce(~F.expr(LEARN), F.lit(True)).alias("held_out"), "score",
        (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))


def without_low_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents, with all their columns, that the classifier does not reject.

    The statistics of the labelled documents are gathered first; then every text is scored
    where it stands, so no text is shuffled."""
    asked = labels.select(F.col("doc_id").cast("long").alias("_asked")).where("_asked is not null").distinct()
    known = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    model = _learned(S.doc_stats(known).join(asked, F.col("doc_id") == F.col("_asked"), "left_semi").checkpoint(),
                     labels, sample_rows)
    names = docs.columns
    at = names.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = [model.score(S.ratios(c)) for c in S.batch_stats(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(scores) >= KEEP_AT))

    return docs.mapInArrow(judge, docs.schema)
