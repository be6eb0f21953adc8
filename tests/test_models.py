import math

import numpy as np
import pytest

from topicloom.plans.plsa import PLSA, DensePLSA, m_step
from topicloom.plans.regularised import RegularisedModel, decorrelation, per_document_model, smoothing
from topicloom.plans.stopping import EarlyStopping, replay
from topicloom.streaming.online import OnlineTrainer


def bow_of(spark, n):
    return spark.createDataFrame([(int(d), int(w), int(n[d, w])) for d, w in zip(*np.nonzero(n), strict=True)], "doc_id long, word_id int, n int")


@pytest.fixture(scope="module")
def counts():
    n = np.random.default_rng(1).integers(0, 5, (12, 20))
    n[4] = 0
    return n


def plsa(n, phi):
    u = n @ phi.T
    theta = u / np.maximum(u.sum(1, keepdims=True), 1e-12)
    joint = theta[:, :, None] * phi[None]
    e = n[:, None, :] * joint / np.maximum(joint.sum(1, keepdims=True), 1e-12)
    n_td = e.sum(2)
    theta = n_td / np.maximum(n_td.sum(1, keepdims=True), 1e-12)
    return e.sum(0), theta, math.exp(-(n * np.log(np.maximum(theta @ phi, 1e-12))).sum() / n.sum())


def test_plsa_training_against_numpy(spark, counts):
    bow = bow_of(spark, counts)
    model = PLSA(3, 20, 7)
    phi = np.random.RandomState(7).rand(3, 20)
    phi /= phi.sum(1, keepdims=True)
    assert np.array_equal(model.get_phi(), phi)
    curve = []
    for _ in range(4):
        phi = m_step(plsa(counts, phi)[0])
        curve.append(plsa(counts, phi)[2])
    history = model.fit_full(bow.repartition(3), 4)
    assert history["val_perplexity"] is None and history["train_perplexity"] == pytest.approx(curve)
    assert np.allclose(model.phi, phi) and np.allclose(model.phi.sum(1), 1)
    assert model.score_perplexity(bow) == pytest.approx(curve[-1])
    theta = {r.doc_id: r.theta for r in model.transform(bow, spark.range(12).withColumnRenamed("id", "doc_id")).collect()}
    assert np.allclose([theta[d] for d in range(12)], plsa(counts, phi)[1]) and theta[4] == [0, 0, 0]
    assert PLSA(3, 20, 7).score_perplexity(bow.where("n < 0")) == math.inf
    assert PLSA(1, 20, 7).fit(bow, 1)["val_perplexity"] == []


def test_early_stopping_in_training(spark, counts):
    bow = bow_of(spark, counts)
    model = PLSA(3, 20, 7)
    history = model.fit(bow, 9, bow, patience=0)
    assert len(history["val_perplexity"]) == 1
    model = PLSA(3, 20, 7)
    history = model.fit(bow, 9, bow, patience=2, min_delta=1e9)
    assert len(history["val_perplexity"]) == 3 and model.score_perplexity(bow) == pytest.approx(history["val_perplexity"][0])
    assert len(PLSA(3, 20, 7).fit_full(bow, 9, tol=1e9)["train_perplexity"]) == 1


def test_stopping_rule():
    assert replay([10, 9, 8.9, 8.8, 7], 2, 0.5) == (3, 1, 9)
    assert replay([3, 2, 1], 2, 0.5) == (None, 2, 1)
    assert replay([5, 4], 0, 1.0) == (0, 0, 5)
    rule = EarlyStopping(1, 1.0)
    assert not rule.step(5, "a") and rule.step(4.5, "b") and rule.kept == "a"


def test_online_steps_depend_on_order(spark, counts):
    a, b = bow_of(spark, counts[:6]), bow_of(spark, np.vstack([np.zeros((6, 20), int), counts[6:]]))
    phi = PLSA(3, 20, 7).phi
    expected = m_step(plsa(counts[6:], m_step(plsa(counts[:6], phi)[0]))[0])
    model = PLSA(3, 20, 7)
    model.fit_online([a, b])
    assert np.allclose(model.phi, expected)


def regularised(n, phi, inner, tol, reg_theta, final, batch):
    d, t = len(n), len(phi)
    theta = np.full((d, t), 1 / t)
    used, active = theta.copy(), np.ones(d, bool)
    for _ in range(inner):
        joint = theta[:, :, None] * phi[None]
        total = joint.sum(1, keepdims=True)
        sums = (n[:, None, :] * joint / np.where(total == 0, 1, total)).sum(2)
        if reg_theta:
            sums = sums + theta * reg_theta(theta)
        total = sums.sum(1, keepdims=True)
        new = sums / np.where(total == 0, 1, total)
        gap = np.abs(new - theta).max(1)
        used[active] = theta[active]
        theta = np.where(active[:, None], new, theta)
        if batch:
            if gap.max() < tol:
                break
        else:
            active &= gap >= tol
    joint = (theta if final else used)[:, :, None] * phi[None]
    total = joint.sum(1, keepdims=True)
    return (n[:, None, :] * joint / np.where(total == 0, 1, total)).sum(0)


@pytest.mark.parametrize(("scope", "final"), [("document", True), ("document", False), ("batch", True)])
def test_regularised_model_against_numpy(spark, counts, scope, final):
    n = np.delete(counts, 4, axis=0)
    bow = bow_of(spark, n)
    reg_theta, reg_phi = smoothing(0.1), decorrelation(0.01)
    make = per_document_model if not final else RegularisedModel
    model = make(3, 20, reg_phi, reg_theta, 5, 1e-3, 15, **({"scope": scope} if final else {}))
    phi = model.get_phi()
    for _ in range(2):
        parts = [n[k : k + 4] for k in range(0, len(n), 4)] if scope == "batch" else [n]
        total = sum(regularised(x, phi, 15, 1e-3, reg_theta, final, scope == "batch") for x in parts)
        raw = total + phi * reg_phi(phi)
        s = raw.sum(0, keepdims=True)
        phi = raw / np.where(s == 0, 1, s)
    model.fit(bow, 2, batch_size=4)
    assert np.allclose(model.phi, phi) and np.allclose(model.phi.sum(0), 1)
    assert np.allclose([sum(r.theta) for r in model.transform(bow).collect()], 1)


def test_regularised_norms_and_shapes(spark, counts):
    bow = bow_of(spark, counts)
    assert np.allclose(RegularisedModel(3, 20, random_state=5, phi_norm="word_axis").fit(bow, 1).phi.sum(1), 1)
    with pytest.raises(ValueError):
        RegularisedModel(3, 19, random_state=5).fit(bow, 1)
    with pytest.raises(ValueError):
        RegularisedModel(3, 20, random_state=5).get_top_words(["a"])


def test_dense_plsa(spark, counts):
    bow = bow_of(spark, counts)
    model = DensePLSA(2, max_iter=3, random_state=0).fit(bow, 20)
    ll = model.log_likelihoods
    assert len(ll) == 3 and ll == sorted(ll) and np.allclose(model.phi.sum(1), 1)
    assert np.allclose([sum(r.theta) for r in model.transform(bow).collect()], 1)


def test_stream_of_documents(spark, tmp_path):
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "token string, word_id int")
    for k, text in enumerate(("a b b", "c a")):
        spark.createDataFrame([(k, text)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    trainer = OnlineTrainer(PLSA(2, 3, 1), vocab, str(tmp_path / "state"))
    query = trainer.writer(stream, str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert (tmp_path / "state" / "phi-1" / "phi.npy").exists() and np.allclose(trainer.model.phi.sum(1), 1)
    before = trainer.model.phi.copy()
    trainer.step(spark.createDataFrame([(9, "a a a")], "doc_id long, text string"), 1)
    assert np.array_equal(trainer.model.phi, before)
