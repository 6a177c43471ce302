"""Quality by ordinal regression on graded ratings.

A cumulative-link model: one weight vector over hashed text features gives a score, and ordered
thresholds cut it into grades, P(grade >= k) = sigmoid(score - threshold_k).  The expected grade and
the tail probability of the grade asked for drive the selection.

Defined cases: null and empty texts are scored by their bias; null ratings are not trained on;
without ratings every tail probability is 1 (nothing is rejected); grades that no document of the
sample has keep an ordered threshold; copies score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole_text
from .hashed_text import BITS, CHOSEN, Design, Scorer, labelled_sample, minimize, sigmoid

L2 = 2e-4
KEEP_FROM = 1
KEEP_AT = 0.5


class Ordinal:
    """``weights`` (one per slot) and ordered ``thresholds`` (one per grade above 0)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def train(cls, x: Design, grade: np.ndarray, n_grades: int, l2: float = L2) -> "Ordinal":
        x = x.select([(grade >= g).astype(float) for g in range(1, n_grades)], CHOSEN)
        n, k, cuts = len(grade), x.slots.size, n_grades - 1
        if not n:
            return cls(np.zeros(1 << BITS), np.full(cuts, -40.0) + np.arange(cuts))

        def ordered(p):  # first threshold, then logarithms of the gaps
            return p[0] + np.concatenate([[0.0], np.cumsum(np.exp(p[1:]))])

        y = grade.astype(int)
        rows = np.arange(n)
        above = y[:, None] == np.arange(cuts) + 1  # the cut right below the grade
        below = y[:, None] == np.arange(cuts)

        def gradient(p):
            # P(grade = g) = tail_g - tail_{g+1}; its log changes by 1 - tail_g - tail_{g+1} with the score
            t = ordered(p[k:])
            tail = sigmoid(x.dot(p[:k])[:, None] - t)
            every = np.column_stack([np.ones(n), tail, np.zeros(n)])
            lo, hi = every[rows, y], every[rows, y + 1]
            slope = tail * (1 - tail) / np.maximum(lo - hi, 1e-9)[:, None]
            at_cut = np.where(above, slope, 0.0).mean(axis=0) - np.where(below, slope, 0.0).mean(axis=0)
            later = np.cumsum(at_cut[::-1])[::-1]
            g = np.concatenate([x.back((lo + hi - 1) / n), [later[0]], later[1:] * np.exp(p[k + 1 :])])
            g[:k] += l2 * p[:k]
            return g

        p = minimize(gradient, np.zeros(k + cuts))
        return cls(x.spread(p[:k]), ordered(p[k:]))

    def tails(self, spark, text: str = "text") -> Column:
        """array of P(grade >= 1), P(grade >= 2), ..."""
        shared = spark.sparkContext.broadcast((self.weights.astype(np.float32)[:, None], self.thresholds))

        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            weights, thresholds = shared.value
            scorer = Scorer(weights, shapes=True)
            for texts in batches:
                rows = np.array([scorer(t)[0] for t in texts.to_pylist()]).reshape(-1, 1)
                yield pa.array(sigmoid(rows - thresholds).tolist(), pa.list_(pa.float64()))

        score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(score, T.ArrayType(T.DoubleType()))(whole_text(text))


def train(docs: DataFrame, ratings: DataFrame, n_grades: int) -> Ordinal:
    """``ratings``: (doc_id, grade) with grades 0 .. n_grades - 1; fitted on the bounded sample."""
    x, y = labelled_sample(docs, ratings, ["grade"], shapes=True)
    return Ordinal.train(x, y[:, 0], n_grades)


def grade(docs: DataFrame, model: Ordinal, keep_from: int = KEEP_FROM, keep_at: float = KEEP_AT) -> DataFrame:
    """docs + ``expected_grade``, ``p_at_least_<k>``, ``kept`` (P(grade >= keep_from) >= keep_at)."""
    cuts = range(1, len(model.thresholds) + 1)
    made = {"expected_grade", "kept"} | {f"p_at_least_{k}" for k in cuts}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    out = docs.withColumn("__t", model.tails(docs.sparkSession))
    tails = [F.get("__t", F.lit(k - 1)) for k in cuts]
    out = out.withColumn("expected_grade", sum(tails[1:], tails[0]))
    for k, p in zip(cuts, tails):
        out = out.withColumn(f"p_at_least_{k}", p)
    return out.withColumn("kept", F.col(f"p_at_least_{keep_from}") >= keep_at).drop("__t")
