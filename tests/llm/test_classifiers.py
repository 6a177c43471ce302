"""The text classifiers: held-out accuracy, out-of-fold training, planted cases, odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.llm import hashed_text, quality_classifier, queries, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").join(labels.select("doc_id"), "doc_id", "left_semi")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    return docs, labels.filter(~fold), labels.filter(fold)


def test_toxicity_on_held_out_documents(spark, tables):
    docs, fit, held = tables
    kinds = [F.expr(f"CAST({c} AS INT)").alias(k) for k, c in queries.TOXIC_CATEGORIES.items()]
    chain = toxicity.train(docs, fit.select("doc_id", *kinds), list(queries.TOXIC_CATEGORIES))
    assert [len(x) for x in chain.links] == [0, 1, 2]
    rows = toxicity.score(docs.join(held.filter("toxic IS NOT NULL"), "doc_id"), chain).select("toxic", "p_any", "p_in_prose", "p_in_junk", "quality").collect()
    # score() replaces the label's column of the same name; ask again for the labels
    truth = {r.doc_id: r for r in held.collect()}
    scored = toxicity.score(docs.join(held.select("doc_id"), "doc_id"), chain).collect()
    hit = sum(r.toxic for r in scored if truth[r.doc_id].toxic)
    wrong = sum(r.toxic for r in scored if not truth[r.doc_id].toxic)
    toxic = sum(truth[r.doc_id].toxic for r in scored)
    assert len(rows) == len(scored)
    assert hit >= 0.85 * toxic and wrong <= 0.01 * (len(scored) - toxic)
    assert all(0 <= p <= 1 for r in rows for p in (r.p_any, r.p_in_prose, r.p_in_junk))


def test_toxicity_planted_and_odd_texts(spark, tables):
    docs, fit, _ = tables
    chain = toxicity.train(docs, fit.select("doc_id", F.col("toxic").alias("any")), ["any"])
    clean = "The and attion to them edble. Eriner thanea in the ountion of that ering and was on this."
    rows = [(0, None), (1, ""), (2, clean), (3, clean + " You idiot, worthless scum. " + clean), (4, clean * 500 + " trash clown moron pathetic loser idiot"), (4, clean * 500 + " trash clown moron pathetic loser idiot")]
    out = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string").withColumn("p_any", F.lit("mine")).withColumn("__x", F.lit(0)), chain)
    got = [(r.doc_id, r.toxic) for r in out.orderBy("doc_id").collect()]
    assert got == [(0, False), (1, False), (2, False), (3, True), (4, True), (4, True)]


def test_verdict_comes_through_the_chain(spark, tables):
    """With the links switched off the verdict's probability changes, and the chain finds no fewer toxic documents."""
    docs, fit, held = tables
    kinds = [F.expr(f"CAST({c} AS INT)").alias(k) for k, c in queries.TOXIC_CATEGORIES.items()]
    assert list(queries.TOXIC_CATEGORIES)[-1] == "any"
    chain = toxicity.train(docs, fit.select("doc_id", *kinds), list(queries.TOXIC_CATEGORIES))
    alone = toxicity.train(docs, fit.select("doc_id", kinds[-1]), ["any"])
    truth = {r.doc_id for r in held.filter("toxic = 1").collect()}
    rows = docs.join(held.select("doc_id"), "doc_id")
    found = [{r.doc_id: (r.toxic, r.p_any) for r in toxicity.score(rows, c).collect()} for c in (chain, alone)]
    recall = [sum(f[i][0] for i in truth if i in f) / max(1, sum(i in f for i in truth)) for f in found]
    print("held-out recall with links, without:", recall)
    assert recall[0] >= recall[1]
    off = toxicity.Chain(chain.categories, chain.weights, [0 * x for x in chain.links])
    scores = {r.doc_id: r.p_any for r in toxicity.score(rows, off).collect()}
    assert max(abs(scores[i] - found[0][i][1]) for i in scores) > 0.05


def test_chain_learns_from_unseen_probabilities():
    """Noise that a model can learn by heart must not look certain to the next model."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 60, 12)) for _ in range(300)]
    y = rng.integers(0, 2, 300).astype(float)
    x = hashed_text.Design([a.astype("<i4").tobytes() + v.astype("<f4").tobytes() for a, v in (hashed_text.features(t, False) for t in texts)])
    chain = toxicity.Chain.train(x, np.column_stack([y, y]), ["a", "b"])
    assert float(chain.links[1][0]) < 1  # learnt from seen rows it would be far above


def test_without_labels_and_constant_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, any int, grade int")
    assert [r.toxic for r in toxicity.score(docs, toxicity.train(docs, none.select("doc_id", "any"), ["any"])).collect()] == [False, False]
    assert all(r.kept for r in quality_classifier.grade(docs, quality_classifier.train(docs, none.select("doc_id", "grade"), 3)).collect())
    same = spark.createDataFrame([(1, 1), (2, 1), (2, None)], "doc_id long, any int")
    assert [r.toxic for r in toxicity.score(docs, toxicity.train(docs, same, ["any"])).collect()] == [True, True]
    assert toxicity.score(docs.limit(0), toxicity.train(docs, same, ["any"])).count() == 0


def test_quality_grades_on_held_out_documents(spark, tables):
    docs, fit, held = tables
    model = quality_classifier.train(docs, fit.select("doc_id", F.expr(queries.GRADE).alias("grade")), 3)
    assert (np.diff(model.thresholds) > 0).all()
    truth = {r.doc_id: r.grade for r in held.select("doc_id", F.expr(queries.GRADE).alias("grade")).collect()}
    got = quality_classifier.grade(docs.join(held.select("doc_id"), "doc_id"), model).collect()
    good = [r for r in got if truth[r.doc_id] > 0]
    junk = [r for r in got if truth[r.doc_id] == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in junk) >= 0.85 * len(junk)
    assert all(r.p_at_least_1 >= r.p_at_least_2 and r.expected_grade == pytest.approx(r.p_at_least_1 + r.p_at_least_2) for r in got)
    mean = [np.mean([r.expected_grade for r in got if truth[r.doc_id] == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_ordinal_gradient_is_that_of_the_likelihood(monkeypatch):
    """The step that training takes is checked against differences of the loss."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 20, 8)) for _ in range(80)]
    y = rng.integers(0, 4, 80).astype(float)
    x = hashed_text.Design([a.astype("<i4").tobytes() + v.astype("<f4").tobytes() for a, v in (hashed_text.features(t, True) for t in texts)])
    caught = []
    monkeypatch.setattr(quality_classifier, "minimize", lambda g, p: caught.append(g) or p)
    quality_classifier.Ordinal.train(x, y, 4, l2=0.0)
    chosen = x.select([(y >= g).astype(float) for g in range(1, 4)], hashed_text.CHOSEN)
    k = chosen.slots.size

    def loss(p):
        t = p[k] + np.concatenate([[0.0], np.cumsum(np.exp(p[k + 1 :]))])
        tail = np.column_stack([np.ones(80), hashed_text.sigmoid(chosen.dot(p[:k])[:, None] - t), np.zeros(80)])
        i = y.astype(int)
        return -np.log(tail[np.arange(80), i] - tail[np.arange(80), i + 1]).mean()

    p = rng.normal(0, 0.1, k + 3)
    g = caught[0](p)
    for at in [0, 1, k // 2, k, k + 1, k + 2]:
        e = np.zeros(k + 3)
        e[at] = 1e-5
        assert g[at] == pytest.approx((loss(p + e) - loss(p - e)) / 2e-5, abs=1e-6)


def test_scorer_agrees_with_the_features():
    rng = np.random.default_rng(3)
    w = rng.normal(size=(1 << hashed_text.BITS, 2))
    for text in ["", "one", "The the THE, the! ### 12 12", "école École réeuxment\nréeuxaux " * 9]:
        for shapes in (False, True):
            at, value = hashed_text.features(text, shapes)
            assert hashed_text.Scorer(w, shapes)(text) == pytest.approx(value @ w[at])
