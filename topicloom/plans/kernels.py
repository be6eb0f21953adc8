"""EM kernels on Arrow batches of packed documents, and the sums over all of them.

Documents are taken a slice at a time. A task hands on rows of the words that its documents have, never a whole matrix,
and holds a bounded number of them; rows are added up by a shuffle, so the driver receives one matrix, whatever the
number of tasks. A method is a function (phi, ends, words, counts, batch) -> (expected counts of the cells, theta).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-12
#: Cells of a slice of documents.
CELLS = 1 << 18
#: Bytes of word rows that a task holds, with the copies that merging them takes.
HELD = 96 << 20
#: Bytes that merging takes at most, for each byte of the rows.
MERGING = 3
#: Tasks of a pass that sums by word: so many a core, and at least so many.
TASKS_A_CORE, LEAST_TASKS = 2, 24

Array = np.ndarray


def slices(batch: pa.RecordBatch, lists: str = "word_ids", limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch in slices of rows whose lists have at most ``limit`` entries together; one row at least."""
    ends, a = batch.column(lists).offsets.to_numpy().astype(np.int64), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + (limit or CELLS), "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def documents(batch: pa.RecordBatch) -> tuple[Array, Array, Array]:
    """(first cell of each document and the end, word ids, counts)."""
    words, counts = batch.column("word_ids"), batch.column("counts")
    ends = words.offsets.to_numpy().astype(np.int64)
    return ends - ends[0], words.flatten().to_numpy(), counts.flatten().to_numpy().astype(float)


def sums_by_document(x: Array, ends: Array) -> Array:
    """(…, documents) sums of (…, cells); documents without cells get 0."""
    if x.shape[-1] == 0:
        return np.zeros((*x.shape[:-1], len(ends) - 1))
    out = np.add.reduceat(x, np.minimum(ends[:-1], x.shape[-1] - 1), axis=-1)
    out[..., ends[1:] == ends[:-1]] = 0
    return out


def sums_by_word(x: Array, words: Array, vocab_size: int) -> Array:
    out = np.empty((len(x), vocab_size))
    for k, row in enumerate(x):
        out[k] = np.bincount(words, row, vocab_size)
    return out


def plsa_documents(phi: Array, ends: Array, words: Array, counts: Array, theta_mode: str = "expected") -> tuple[Array, Array]:
    """(expected counts of the cells (T, cells), theta (T, documents))."""
    sizes = np.diff(ends)
    p = phi[:, words]
    u = sums_by_document(counts * p, ends)
    theta = u / np.maximum(u.sum(0), EPS)
    joint = p * np.repeat(theta, sizes, axis=1)
    cells = counts * joint / np.maximum(joint.sum(0), EPS)
    if theta_mode == "expected":
        n_td = sums_by_document(cells, ends)
        theta = n_td / np.maximum(n_td.sum(0), EPS)
    return cells, theta


def log_likelihood(phi: Array, theta: Array, ends: Array, words: Array, counts: Array, least: float = EPS) -> tuple[float, int]:
    p = (phi[:, words] * np.repeat(theta, np.diff(ends), axis=1)).sum(0)
    return float((counts * np.log(np.maximum(p, least) if least >= 0 else p - least)).sum()), int(counts.sum())


def inner_theta(
    phi: Array, ends: Array, words: Array, counts: Array, max_inner: int, tol: float, reg_theta: Callable[[Array], Array] | None, nwt_theta: str, scope: str
) -> tuple[Array, Array]:
    """(expected counts of the cells, theta (T, documents)) of a regularised model.

    ``scope``: theta converges by 'document' or for the whole 'batch'. ``nwt_theta``: counts are taken with the 'final'
    theta, or with the one before its last update ('pre_update'). ``reg_theta`` sees (documents, T).
    """
    topics, sizes = len(phi), np.diff(ends)
    p = phi[:, words]
    theta = np.full((topics, len(sizes)), 1 / topics)
    used = theta.copy()
    active = np.ones(len(sizes), bool)

    def cells_of(theta_: Array) -> Array:
        joint = p * np.repeat(theta_, sizes, axis=1)
        total = joint.sum(0)
        return counts * joint / np.where(total == 0, 1.0, total)

    for _ in range(max_inner):
        sums = sums_by_document(cells_of(theta), ends)
        if reg_theta is not None:
            sums = sums + theta * reg_theta(theta.T).T
        total = sums.sum(0)
        new = sums / np.where(total == 0, 1.0, total)
        gap = np.abs(new - theta).max(0, initial=0)
        used[:, active] = theta[:, active]
        theta = np.where(active, new, theta)
        if scope == "batch":
            if gap.max(initial=0) < tol:
                break
        else:
            active = active & (gap >= tol)
            if not active.any():
                break
    return cells_of(theta if nwt_theta == "final" else used), theta


def plsa(phi: Array, ends: Array, words: Array, counts: Array, batch, theta_mode: str = "expected") -> tuple[Array, Array]:
    return plsa_documents(phi, ends, words, counts, theta_mode)


def plsa_counts(phi: Array, ends: Array, words: Array, counts: Array, batch) -> tuple[Array, Array]:
    """The same cells, and n_td in place of theta."""
    cells, _ = plsa_documents(phi, ends, words, counts, "projection")
    return cells, sums_by_document(cells, ends)


def _shares(p: Array, theta: Array, ends: Array, counts: Array, eps: float) -> Array:
    """Expected counts; the denominator is increased by ``eps``, or where that is 0, replaced by 1 where 0."""
    joint = p * np.repeat(theta, np.diff(ends), axis=1)
    total = joint.sum(0)
    return counts * joint / (total + eps if eps else np.where(total == 0, 1.0, total))


def fixed_updates(phi: Array, ends: Array, words: Array, counts: Array, batch, updates: int, more: float = 0.0, eps: float = 0.0) -> tuple[Array, Array]:
    """theta after so many updates from the uniform start, ``more`` added to each expected count; ``eps``: see ``_shares``."""
    p, theta = phi[:, words], np.full((len(phi), len(ends) - 1), 1 / len(phi))
    for _ in range(updates):
        sums = sums_by_document(_shares(p, theta, ends, counts, eps), ends) + more
        total = sums.sum(0)
        theta = sums / np.where(total == 0, 1.0, total)
    return _shares(p, theta, ends, counts, eps), theta


def offline(phi: Array, ends: Array, words: Array, counts: Array, batch, alpha: float) -> tuple[Array, Array]:
    """theta from counts times phi plus ``alpha``; the cells are counts times theta."""
    u = sums_by_document(counts * phi[:, words], ends) + alpha
    total = u.sum(0)
    theta = u / np.where(total == 0, 1.0, total)
    return counts * np.repeat(theta, np.diff(ends), axis=1), theta


def kept_theta(batch: pa.RecordBatch, topics: int) -> Array:
    return batch.column("theta").flatten().to_numpy().reshape(-1, topics).T


def dense(phi: Array, ends: Array, words: Array, counts: Array, batch, eps: float) -> tuple[Array, Array]:
    """Cells from the theta that comes with the documents, and the theta after it."""
    cells = _shares(phi[:, words], kept_theta(batch, len(phi)), ends, counts, eps)
    sums = sums_by_document(cells, ends)
    return cells, sums / (sums.sum(0) + eps)


def dense_cells(phi: Array, ends: Array, words: Array, counts: Array, batch, eps: float) -> tuple[Array, Array]:
    """The same cells, and the theta they come from."""
    theta = kept_theta(batch, len(phi))
    return _shares(phi[:, words], theta, ends, counts, eps), theta


class WordSums:
    """Sums by word as rows (word_id, p0 ..); rows go out when too many are held, and a shuffle adds them up."""

    def __init__(self, topics: int) -> None:
        self.topics, self.limit, self.parts, self.rows = topics, max(1, HELD // (MERGING * 8 * (topics + 1))), [], 0

    def _merge(self) -> None:
        words, values = np.concatenate([w for w, _ in self.parts]), np.concatenate([x for _, x in self.parts], axis=1)
        self.parts = []
        each, at = np.unique(words, return_inverse=True)
        self.parts, self.rows = [(each, sums_by_word(values, at, len(each)))], len(each)

    def add(self, words: Array, cells: Array) -> Iterator[pa.RecordBatch]:
        each, at = np.unique(words, return_inverse=True)
        self.parts.append((each, sums_by_word(cells, at, len(each))))
        self.rows += len(each)
        if self.rows > self.limit:
            self._merge()
            if self.rows > self.limit // 2:
                yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            self._merge()
            ((words, values),) = self.parts
            self.parts, self.rows = [], 0
            for a in range(0, len(words), 1 << 16):
                yield word_rows(words[a : a + (1 << 16)], values[:, a : a + (1 << 16)])


def word_rows(words: Array, values: Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), *(pa.array(np.ascontiguousarray(x)) for x in values)], names=["word_id", *(f"p{k}" for k in range(len(values)))])


def score_rows(ll: float, n: int, topics: int) -> pa.RecordBatch:
    """The likelihood and the number of words, as rows of the words -1 and -2."""
    values = np.zeros((topics, 2))
    values[0] = ll, n
    return word_rows(np.array([-1, -2]), values)


def schema(topics: int) -> str:
    return "word_id int, " + ", ".join(f"p{k} double" for k in range(topics))


def known(phi: Array, ends: Array, words: Array, counts: Array) -> tuple[Array, Array, Array]:
    """The cells whose word has a column in phi (others are nan)."""
    kept = words < phi.shape[1]
    kept[kept] = ~np.isnan(phi[0, words[kept]])
    return np.concatenate(([0], np.cumsum(kept)))[ends], words[kept], counts[kept]


def pass_task(sent, method, counts_too: bool, least: float | None = EPS, all_words: bool = True):
    """Word rows of a task's documents (``counts_too``), and score rows unless ``least`` is None.

    ``least``: probabilities are floored there; a negative one is added instead, as -``least``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phi = sent.value
        sums, ll, n = WordSums(len(phi)), 0.0, 0
        for batch in batches:
            for part in slices(batch):
                d = documents(part) if all_words else known(phi, *documents(part))
                cells, theta = method(phi, *d, part)
                if counts_too:
                    yield from sums.add(d[1], cells)
                if least is not None:
                    x, k = log_likelihood(phi, theta, *d, least)
                    ll, n = ll + x, n + k
        yield from sums.out()
        if least is not None:
            yield score_rows(ll, n, len(phi))

    return run


def theta_task(sent, method, keep: bool = False, all_words: bool = True):
    """(doc_id, theta) of documents, or with ``keep`` their words and counts too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phi = sent.value
        for batch in batches:
            for part in slices(batch):
                d = documents(part) if all_words else known(phi, *documents(part))
                theta = method(phi, *d, part)[1]
                held = [(x, part.column(x)) for x in (("doc_id", "word_ids", "counts") if keep else ("doc_id",))]
                offsets = pa.array(np.arange(theta.shape[1] + 1) * len(phi), pa.int32())
                held.append(("theta", pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(theta.T).ravel()))))
                yield pa.RecordBatch.from_arrays([x for _, x in held], names=[k for k, _ in held])

    return run


def gathered(rows: DataFrame) -> DataFrame:
    """``rows`` in a number of tasks that the cores bound, not the input: each task hands on a row for each word it meets,
    so that more tasks would shuffle the same words more often."""
    return rows.coalesce(max(LEAST_TASKS, TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism))


def added(rows: DataFrame, topics: int) -> DataFrame:
    return rows.groupBy("word_id").agg(*(F.sum(f"p{k}").alias(f"p{k}") for k in range(topics)))


def added_for(vocab: DataFrame, rows: DataFrame, topics: int) -> DataFrame:
    """Sums by word of the vocabulary's words, whether they have rows or not."""
    asked = vocab.select("word_id", *(F.lit(0.0).alias(f"p{k}") for k in range(topics)), F.lit(True).alias("asked"))
    both = rows.withColumn("asked", F.lit(False)).unionByName(asked)
    sums = both.groupBy("word_id").agg(*(F.sum(f"p{k}").alias(f"p{k}") for k in range(topics)), F.max("asked").alias("asked"))
    return sums.where("asked").drop("asked")


def summed(rows: DataFrame, topics: int, vocab_size: int) -> tuple[Array, float, int]:
    """(n_tw, log-likelihood, words) over all tasks."""
    got = added(rows, topics).toArrow()
    ids, total, score = got["word_id"].to_numpy(), np.zeros((topics, vocab_size)), {-1: 0.0, -2: 0.0}
    real = ids >= 0
    for k in range(topics):
        values = got[f"p{k}"].to_numpy()
        if k == 0:
            score |= dict(zip(ids[~real].tolist(), values[~real].tolist(), strict=True))
        total[k, ids[real]] = values[real]
    return total, score[-1], int(score[-2])
