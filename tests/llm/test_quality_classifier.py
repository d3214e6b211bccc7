import math

import numpy as np
import pytest

from skarn.llm import quality_classifier as q


def auc(score, label):
    score, label = np.asarray(score), np.asarray(label)
    above = (score[label == 1][:, None] > score[label == 0]).mean()
    return above + (score[label == 1][:, None] == score[label == 0]).mean() / 2


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = q.classify(docs, labels, 3000).join(labels, "doc_id").filter("held_out").collect()
    y = [r["quality"] for r in rows]
    assert len(rows) > 500 and auc([r["score"] for r in rows], y) > 0.98
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97


def test_labels_of_held_out_rows_change_nothing(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    spoiled = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) AS quality")
    one, two = (sorted(map(tuple, q.classify(docs, x).collect())) for x in (labels, spoiled))
    assert one == two


def test_non_negative_risk_separates_unlabelled_rows():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(1, 1, (4000, q.N_FEATURES)), rng.normal(-1, 1, (1500, q.N_FEATURES))
    model = q.fit(good[:2000], np.concatenate((good[2000:], bad[:1000])), 2 / 3)
    assert auc(np.concatenate((model.score(good), model.score(bad))), [1] * 4000 + [0] * 1500) > 0.99


def plain_risk(pos, unl, prior):
    """The non-negative risk, row by row."""
    loss = lambda g: math.log1p(math.exp(-g))
    mean = lambda xs: sum(xs) / len(xs)
    bracket = mean([loss(-g) for g in unl]) - prior * mean([loss(-g) for g in pos])
    return prior * mean([loss(g) for g in pos]) + max(0.0, bracket), bracket


@pytest.mark.parametrize("shift", [0.0, 4.0])
def test_risk_and_its_gradient_match_a_plain_sum(shift):
    rng = np.random.default_rng(5)
    pos, unl = rng.normal(shift, 1, 30), rng.normal(-shift, 1, 40)
    value, g_pos, g_unl = q.risk(pos, unl, 0.6)
    want, bracket = plain_risk(pos, unl, 0.6)
    assert abs(value - want) < 1e-9 and (bracket < 0) == (shift > 0)
    # below zero the step goes up the bracket: the gradient of minus the bracket
    goal = (lambda a, b: plain_risk(a, b, 0.6)[0]) if bracket >= 0 else (lambda a, b: -plain_risk(a, b, 0.6)[1])
    for x, g, other in ((pos, g_pos, lambda v: goal(v, unl)), (unl, g_unl, lambda v: goal(pos, v))):
        for i in (0, 7, 29):
            up, down = x.copy(), x.copy()
            up[i], down[i] = x[i] + 1e-5, x[i] - 1e-5
            assert abs((other(up) - other(down)) / 2e-5 - g[i]) < 1e-6


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.8])
def test_the_prior_of_a_known_mixture_is_found(prior):
    rng = np.random.default_rng(9)
    n = int(4000 * prior)
    unlabelled = np.concatenate((rng.normal(0.5, 1, (n, q.N_FEATURES)), rng.normal(-0.5, 1, (4000 - n, q.N_FEATURES))))
    assert abs(q.estimate_prior(rng.normal(0.5, 1, (3000, q.N_FEATURES)), unlabelled) - prior) < 0.06


def test_an_id_is_one_row_of_the_sample_however_often_it_is_there(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(q, "fit", lambda p, u, *a: seen.append((len(p), len(u))) or q.Model(*[np.zeros(q.N_FEATURES)] * 2, np.zeros((q.N_FEATURES, 1)), np.zeros(1), np.zeros(1), 0.0))
    monkeypatch.setattr(q, "estimate_prior", lambda p, u: 0.5)
    docs = spark.range(3000).selectExpr("if(id < 1000, 0, id) AS doc_id", "concat('text ', id) AS text")
    q.train(docs, spark.createDataFrame([(0, 1), (2000, 1), (2001, 0)], "doc_id long, quality int"), 500)
    assert seen[0][0] <= 2 and seen[0][1] <= 600


def test_odd_rows(spark, docs):
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (4, None), (5, 1), (6, 1)], "doc_id long, quality int")
    rows = q.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert q.classify(docs, labels.limit(0)).count() == docs.count()
    assert q.classify(docs.limit(0), labels).count() == 0
    assert np.isfinite(np.stack([q.features(t) for t in (None, "", " ", "a", "\n" * 1000, "é" * 100_000)])).all()
