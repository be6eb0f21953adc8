"""Additively regularised topic models: EM with an inner loop for theta and gradients of regularisers."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators.bow import check_shape, packed
from topicloom.plans import kernels
from topicloom.plans.plsa import best_words, held, theta_frame

Gradient = Callable[[np.ndarray], np.ndarray]


def smoothing(strength: float) -> Gradient:
    """Gradient that adds ``strength`` to each count (negative: takes it away)."""
    return lambda x: strength / np.maximum(x, kernels.EPS)


def decorrelation(strength: float) -> Gradient:
    """Gradient that pushes topics apart: each entry of phi (T, V) is lowered by the other topics' entries."""
    return lambda phi: -strength * (phi.sum(0, keepdims=True) - phi)


def _task(sent, options: dict, by_batch: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phi = sent.value
        sums = kernels.WordSums(len(phi))
        for batch in _whole(batches) if by_batch else batches:
            for part in [batch] if by_batch else kernels.slices(batch):
                ends, words, counts = kernels.documents(part)
                yield from sums.add(words, kernels.inner_theta(phi, ends, words, counts, **options)[0])
        yield from sums.out()

    return run


def _inner(phi, ends, words, counts, batch, options):
    return kernels.inner_theta(phi, ends, words, counts, **options)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by batch_id, regrouped so that each batch comes as one."""
    held, now = [], None
    for batch in batches:
        ids = batch.column("batch_id").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                if held and ids[a] != now:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                now = ids[a]
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class RegularisedModel:
    """Full EM with regularisers.

    ``reg_phi``: (T, V) -> gradient, on the driver; ``reg_theta``: (documents, T) -> gradient, shipped to the tasks. ``phi_norm``:
    'topic_axis' divides each word's entries by their sum over topics, 'word_axis' each topic's by its sum over words.
    ``scope``: theta converges by 'document', or for a whole 'batch' (then ``fit`` needs ``batch_size``). ``nwt_theta``: 'final' or
    'pre_update' (see ``kernels.inner_theta``).
    """

    def __init__(
        self, n_topics: int, vocab_size: int, reg_phi: Gradient | None = None, reg_theta: Gradient | None = None, random_state: int | None = None, theta_convergence_tol: float = 1e-4,
        max_inner_iter: int = 20, phi: np.ndarray | None = None, phi_norm: str = "topic_axis", scope: str = "document", nwt_theta: str = "final",
    ) -> None:
        self.n_topics, self.vocab_size, self.reg_phi, self.phi_norm = n_topics, vocab_size, reg_phi, phi_norm
        self.options = {"max_inner": max_inner_iter, "tol": theta_convergence_tol, "reg_theta": reg_theta, "nwt_theta": nwt_theta, "scope": scope}
        if phi is None:
            phi = 1 / vocab_size + np.random.RandomState(random_state).rand(n_topics, vocab_size)
            phi = phi / phi.sum(1, keepdims=True)
        self.phi = np.array(phi, float)

    def get_phi(self) -> np.ndarray:
        return self.phi.copy()

    def get_top_words(self, vocab: list[str], top_n: int = 10) -> list[list[str]]:
        return best_words(self.phi, vocab, top_n)

    def update_phi(self, n_tw: np.ndarray) -> np.ndarray:
        raw = n_tw + self.phi * self.reg_phi(self.phi) if self.reg_phi is not None else n_tw
        total = raw.sum(0 if self.phi_norm == "topic_axis" else 1, keepdims=True)
        return raw / np.where(total == 0, 1.0, total)

    def fit(self, bow: DataFrame, n_iter: int = 10, batch_size: int | None = None) -> RegularisedModel:
        """``bow`` is (doc_id, word_id, n); with ``scope='batch'``, documents are batched by id."""
        check_shape(bow, self.vocab_size)
        by_batch = self.options["scope"] == "batch"
        rows = held(bow)
        if by_batch:
            if not batch_size or batch_size <= 0:
                raise ValueError("batch_size must be positive")
            rows = rows.withColumn("batch_id", F.floor(F.col("doc_id") / batch_size).cast("long")).repartition("batch_id").sortWithinPartitions("batch_id", "doc_id").persist()
        for _ in range(n_iter):
            sent = bow.sparkSession.sparkContext.broadcast(self.phi)
            n_tw, _, _ = kernels.summed(kernels.gathered(rows).mapInArrow(_task(sent, self.options, by_batch), kernels.schema(self.n_topics)), self.n_topics, self.vocab_size)
            sent.destroy()
            self.phi = self.update_phi(n_tw)
        rows.unpersist()
        return self

    def transform(self, bow: DataFrame) -> DataFrame:
        """(doc_id, theta) by the inner loop."""
        sent, options = bow.sparkSession.sparkContext.broadcast(self.phi), self.options | {"scope": "document"}
        return theta_frame(packed(bow), kernels.theta_task(sent, functools.partial(_inner, options=options)))


def per_document_model(n_topics: int, vocab_size: int, reg_phi: Gradient | None = None, reg_theta: Gradient | None = None, random_state: int | None = None, theta_convergence_tol: float = 1e-4, max_inner_iter: int = 50, **options) -> RegularisedModel:
    """The variant whose counts come from the last inner update's responsibilities."""
    return RegularisedModel(n_topics, vocab_size, reg_phi, reg_theta, random_state, theta_convergence_tol, max_inner_iter, nwt_theta="pre_update", scope="document", **options)
