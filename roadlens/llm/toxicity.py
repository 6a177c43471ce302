"""Toxicity by a classifier chain.

The categories are predicted one after the other: the model of each category sees the text's
hashed features and the probabilities of the categories before it.  In training these
probabilities come from models that have not seen the document (out-of-fold), so later models
learn how far the earlier ones can be trusted.  Each model is linear (logistic, L2).

Defined cases: null and empty texts get the probabilities of the bias; rows with a null label are
not trained on; without labelled rows every probability is 0; a category with one class only is
constant; copies of one text score alike.
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

FOLDS = 3
L2 = 2e-4
THRESHOLD = 0.4


def _fit(x: Design, earlier: np.ndarray, y: np.ndarray, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the text's features and of the earlier categories."""
    n, k = max(len(y), 1), x.slots.size
    if not len(y) or y.min() == y.max():
        w = np.zeros(k)
        w[x.slots == 0] = 40.0 if len(y) and y[0] > 0.5 else -40.0  # slot 0 is the bias
        return w, np.zeros(earlier.shape[1])

    def gradient(p):
        r = (sigmoid(x.dot(p[:k]) + earlier @ p[k:]) - y) / n
        return np.concatenate([x.back(r), earlier.T @ r]) + l2 * p

    p = minimize(gradient, np.zeros(k + earlier.shape[1]))
    return p[:k], p[k:]


class Chain:
    def __init__(self, categories: list[str], weights: np.ndarray, links: list[np.ndarray]):
        self.categories, self.weights, self.links = categories, weights, links

    @classmethod
    def train(cls, x: Design, y: np.ndarray, categories: list[str], folds: int = FOLDS, l2: float = L2) -> "Chain":
        """``y``: one 0/1 column per category, in chain order."""
        n = len(y)
        fold = np.arange(n) % folds  # the sample comes in hash order
        earlier = np.zeros((n, 0))
        weights, links = np.zeros((1 << BITS, len(categories))), []
        for j in range(len(categories)):
            chosen = x.select([y[:, j]], CHOSEN)
            w, link = _fit(chosen, earlier, y[:, j], l2)
            weights[:, j] = chosen.spread(w)
            if not n:
                weights[0, j] = -40.0
            links.append(link)
            if j + 1 < len(categories):
                unseen = np.zeros(n)
                for f in range(folds):
                    out = fold == f
                    part = x.take(~out).select([y[~out, j]], CHOSEN)
                    wf, lf = _fit(part, earlier[~out], y[~out, j], l2)
                    unseen[out] = sigmoid(x.take(out).dot(part.spread(wf)[x.slots]) + earlier[out] @ lf)
                earlier = np.column_stack([earlier, unseen])
        return cls(categories, weights, links)

    def follow(self, scores: np.ndarray) -> np.ndarray:
        """Probabilities along the chain from the text's scores (documents x categories)."""
        p = np.zeros(scores.shape)
        for j, link in enumerate(self.links):
            p[:, j] = sigmoid(scores[:, j] + p[:, :j] @ link)
        return p

    def probabilities(self, spark, text: str = "text") -> Column:
        """struct of one double per category."""
        shared = spark.sparkContext.broadcast((self.weights.astype(np.float32), self.links))
        categories = self.categories

        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            weights, links = shared.value
            scorer, chain = Scorer(weights, shapes=False), Chain(categories, weights, links)
            for texts in batches:
                rows = np.array([scorer(t) for t in texts.to_pylist()]).reshape(len(texts), len(categories))
                p = chain.follow(rows)
                yield pa.StructArray.from_arrays([pa.array(p[:, j]) for j in range(len(categories))], names=categories)

        score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        schema = T.StructType([T.StructField(c, T.DoubleType()) for c in categories])
        return F.arrow_udf(score, schema)(whole_text(text))


def train(docs: DataFrame, labels: DataFrame, categories: list[str]) -> Chain:
    """Fit the chain on the bounded sample of labelled documents; ``labels`` has a 0/1 column per category."""
    x, y = labelled_sample(docs, labels, categories, shapes=False)
    return Chain.train(x, y, categories)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs + ``p_<category>`` for each, + ``toxic`` (the verdict of the last category, which sees all before it)."""
    made = {f"p_{c}" for c in chain.categories} | {"toxic"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    out = docs.withColumn("__p", chain.probabilities(docs.sparkSession))
    out = out.select("*", *[F.col(f"__p.{c}").alias(f"p_{c}") for c in chain.categories]).drop("__p")
    return out.withColumn("toxic", F.col(f"p_{chain.categories[-1]}") >= THRESHOLD)
