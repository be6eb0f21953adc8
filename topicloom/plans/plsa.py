"""Probabilistic latent semantic analysis: full, online and dense trainers."""

from __future__ import annotations

import functools
import logging
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.operators.bow import packed
from topicloom.plans import kernels
from topicloom.plans.stopping import EarlyStopping
from topicloom.session import cut, discard

log = logging.getLogger(__name__)


def phi_frame(spark, phi: np.ndarray) -> DataFrame:
    """(topic, word_id, p) of a driver matrix."""
    from topicloom.operators.em import long_form

    wide = {"word_id": pa.array(np.arange(phi.shape[1]), pa.int32())} | {f"p{k}": pa.array(np.ascontiguousarray(x)) for k, x in enumerate(phi)}
    return long_form(spark.createDataFrame(pa.table(wide)), "word_id", "p", len(phi))


def held(bow: DataFrame) -> DataFrame:
    """Packed documents for many passes: packed ones are read where they are, others are packed once and cached."""
    return packed(bow) if "word_ids" in bow.columns else packed(bow).persist()


def theta_frame(packed_: DataFrame, task) -> DataFrame:
    return packed_.mapInArrow(task, f"doc_id {packed_.schema['doc_id'].dataType.simpleString()}, theta array<double>")


def best_words(phi: np.ndarray, vocab: list[str], top_n: int = 10) -> list[list[str]]:
    if len(vocab) != phi.shape[1]:
        raise ValueError("the vocabulary's size is not the model's")
    return [[vocab[i] for i in np.argsort(row, kind="stable")[::-1][:top_n]] for row in phi]


def m_step(n_tw: np.ndarray, floor: str = "counts") -> np.ndarray:
    if floor == "counts":
        n_tw = np.maximum(n_tw, kernels.EPS)
        return n_tw / n_tw.sum(1, keepdims=True)
    return n_tw / np.maximum(n_tw.sum(1, keepdims=True), kernels.EPS)


class PLSA:
    """pLSA whose theta starts from the projection of the counts in each iteration.

    ``bow`` arguments are (doc_id, word_id, n). ``theta_mode``: 'expected' or 'projection'; ``m_step_floor``: 'counts' or
    'denominator' (see ``operators.em``). One job an iteration: the score under phi is taken in the pass that also collects the
    next expected counts.
    """

    def __init__(self, n_topics: int, vocab_size: int, random_state: int | None = None, phi: np.ndarray | None = None, theta_mode: str = "expected", m_step_floor: str = "counts") -> None:
        self.n_topics, self.vocab_size, self.theta_mode, self.m_step_floor = n_topics, vocab_size, theta_mode, m_step_floor
        if phi is None:
            phi = np.random.RandomState(random_state).rand(n_topics, vocab_size)
            phi = phi / phi.sum(1, keepdims=True)
        self.phi = np.array(phi, float)

    def get_phi(self) -> np.ndarray:
        return self.phi.copy()

    def get_top_words(self, vocab: list[str], top_n: int = 10) -> list[list[str]]:
        return best_words(self.phi, vocab, top_n)

    def _pass(self, packed_: DataFrame, counts_too: bool = True) -> tuple[np.ndarray, float, int]:
        sent = packed_.sparkSession.sparkContext.broadcast(self.phi)
        try:
            task = kernels.pass_task(sent, functools.partial(kernels.plsa, theta_mode=self.theta_mode), counts_too)
            return kernels.summed((kernels.gathered(packed_) if counts_too else packed_).mapInArrow(task, kernels.schema(self.n_topics)), self.n_topics, self.vocab_size if counts_too else 0)
        finally:
            sent.destroy()

    @staticmethod
    def _value(ll: float, n: int) -> float:
        return math.exp(-ll / n) if n else math.inf

    def score_perplexity(self, bow: DataFrame) -> float:
        _, ll, n = self._pass(packed(bow), False)
        return self._value(ll, n)

    def fit(self, train: DataFrame, n_epochs: int = 10, val: DataFrame | None = None, patience: int | None = None, min_delta: float = 1.0, tol: float | None = None) -> dict[str, list[float] | None]:
        """Batch EM over the whole corpus; the history has the perplexities after each M-step.

        With ``val`` and ``patience``, the best phi is restored when patience runs out (not when epochs do). With ``tol``,
        training also ends when phi moves by less (Frobenius).
        """
        train_ = held(train)
        val_ = held(val) if val is not None else None
        history: dict[str, list[float] | None] = {"train_perplexity": [], "val_perplexity": []}
        rule = EarlyStopping(patience, min_delta) if val is not None and patience is not None else None
        try:
            n_tw, _, _ = self._pass(train_) if n_epochs else (None, 0, 0)
            for epoch in range(n_epochs):
                before, self.phi = self.phi, m_step(n_tw, self.m_step_floor)
                n_tw, ll, n = self._pass(train_, counts_too=epoch + 1 < n_epochs)
                history["train_perplexity"].append(self._value(ll, n))
                if val_ is not None:
                    _, vll, vn = self._pass(val_, False)
                    history["val_perplexity"].append(self._value(vll, vn))
                    if rule is not None and rule.step(history["val_perplexity"][-1], self.phi.copy()):
                        if rule.kept is not None:
                            self.phi = rule.kept
                        break
                if epoch % 10 == 0:
                    log.info("epoch %d: perplexity %.4f", epoch, history["train_perplexity"][-1])
                if tol is not None and np.linalg.norm(self.phi - before) < tol:
                    break
        finally:
            train_.unpersist()
            if val_ is not None:
                val_.unpersist()
        return history

    def fit_full(self, train: DataFrame, n_epochs: int = 10, val: DataFrame | None = None, patience: int | None = None, min_delta: float = 1.0, tol: float = 1e-6) -> dict[str, list[float] | None]:
        """``fit`` with the convergence test; the validation history is None without validation documents."""
        history = self.fit(train, n_epochs, val, patience, min_delta, tol)
        return history if val is not None else history | {"val_perplexity": None}

    def fit_batch(self, bow: DataFrame) -> None:
        """One EM step on a batch replaces phi: the order of batches matters."""
        n_tw, _, _ = self._pass(packed(bow))
        self.phi = m_step(n_tw, self.m_step_floor)

    def fit_online(self, batches: Iterable[DataFrame], n_epochs: int = 1) -> None:
        for _ in range(n_epochs):
            for bow in batches:
                self.fit_batch(bow)

    def transform(self, bow: DataFrame, docs: DataFrame | None = None) -> DataFrame:
        """(doc_id, theta); documents of ``docs`` without words get zeros."""
        sent, mode = bow.sparkSession.sparkContext.broadcast(self.phi), self.theta_mode
        theta = theta_frame(packed(bow), kernels.theta_task(sent, functools.partial(kernels.plsa, theta_mode=mode)))
        return _with_empty(theta, docs, self.n_topics)


def _with_empty(theta: DataFrame, docs: DataFrame | None, topics: int) -> DataFrame:
    if docs is None:
        return theta
    return docs.select("doc_id").join(theta, "doc_id", "left").withColumn("theta", F.coalesce("theta", F.array(*[F.lit(0.0)] * topics)))


class DensePLSA:
    """pLSA whose theta is kept between iterations; both matrices are updated from the same responsibilities.

    theta travels with the packed documents, from one written table to the next, so that no iteration shuffles cells. A start given as
    a column is computed where the documents are. The likelihood is taken in the pass that also collects the next expected counts.
    """

    def __init__(self, n_topics: int, max_iter: int = 100, tol: float = 1e-4, smooth: float = 1e-8, random_state: int | None = None, phi: np.ndarray | None = None, theta: DataFrame | Column | None = None) -> None:
        self.n_topics, self.max_iter, self.tol, self.eps, self.phi = n_topics, max_iter, tol, smooth, phi
        self.random = np.random.default_rng(random_state)
        self.theta = theta  # to start from: (doc_id, t0 .. t{T-1}), or an array by doc_id; random if there is none
        self.log_likelihoods: list[float] = []

    def fit(self, bow: DataFrame, vocab_size: int) -> DensePLSA:
        spark, topics, eps = bow.sparkSession, self.n_topics, self.eps
        if self.phi is None:
            self.phi = self.random.dirichlet(np.ones(vocab_size), size=topics)
        seed = int(self.random.integers(1 << 31))
        theta = self.theta if self.theta is not None else row_shares(_seeded_theta(topics, seed))
        rows = held(bow)
        docs = rows.select("doc_id", "word_ids", "counts")
        if isinstance(theta, DataFrame):
            start = theta.select("doc_id", F.array(*(f"t{k}" for k in range(topics))).alias("theta"))
            state = cut(docs.join(start, "doc_id"), "dense")
        else:
            state = docs.select("doc_id", "word_ids", "counts", theta.alias("theta"))
        before = -math.inf
        sent = spark.sparkContext.broadcast(self.phi)
        n_tw, _ = self._pass(state, sent, vocab_size, scored=False) if self.max_iter else (None, 0.0)
        for k in range(self.max_iter):
            method = functools.partial(kernels.dense, eps=eps)
            old, state = state, cut(state.mapInArrow(kernels.theta_task(sent, method, keep=True), state.schema), "dense")
            if hasattr(old, "written_to"):
                discard(old)
            if k == 0:
                rows.unpersist()
            sent.destroy()
            self.phi = n_tw / (n_tw.sum(1, keepdims=True) + eps)
            sent = spark.sparkContext.broadcast(self.phi)
            n_tw, ll = self._pass(state, sent, vocab_size, counts_too=k + 1 < self.max_iter)
            self.log_likelihoods.append(ll)
            if abs(ll - before) < self.tol:
                break
            before = ll
        sent.destroy()
        self.theta = state.select("doc_id", *(F.col("theta")[k].alias(f"t{k}") for k in range(topics)))
        return self

    def _pass(self, state: DataFrame, sent, vocab_size: int, counts_too: bool = True, scored: bool = True) -> tuple[np.ndarray, float]:
        """(expected counts, log-likelihood) under phi and the theta that comes with the documents."""
        method = functools.partial(kernels.dense_cells, eps=self.eps) if counts_too else _as_kept
        task = kernels.pass_task(sent, method, counts_too, -self.eps if scored else None)
        rows = (kernels.gathered(state) if counts_too else state).mapInArrow(task, kernels.schema(self.n_topics))
        return kernels.summed(rows, self.n_topics, vocab_size if counts_too else 0)[:2]

    def transform(self, bow: DataFrame, max_iter: int = 20) -> DataFrame:
        """(doc_id, theta) with phi fixed."""
        sent = bow.sparkSession.sparkContext.broadcast(self.phi)
        method = functools.partial(kernels.fixed_updates, updates=max_iter, more=self.eps, eps=self.eps)
        return theta_frame(packed(bow), kernels.theta_task(sent, method))


def _as_kept(phi, ends, words, counts, batch):
    """No cells, and the theta that comes with the documents."""
    return None, kernels.kept_theta(batch, len(phi))


def row_shares(values: list[Column]) -> Column:
    """An array of the values divided by their total."""
    total = functools.reduce(lambda a, b: a + b, values)
    return F.array(*(x / F.greatest(total, F.lit(kernels.EPS)) for x in values))


def _seeded_theta(topics: int, seed: int) -> list[Column]:
    """Positive random values by document: the same for the same seed, however the documents are dealt."""
    return [-F.ln((F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit(k)), F.lit(1_000_003)) + 1) / 1_000_004.0) for k in range(topics)]
