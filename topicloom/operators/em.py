"""EM steps as DataFrame queries.

Matrices over words are wide: phi(word_id, p0 .. p{T-1}); matrices over documents too: theta(doc_id, t0 .. t{T-1}). Nothing
fans out by topics. ``bow`` is (doc_id, word_id, n) or packed documents (doc_id, word_ids, counts).

Steps send phi to the workers as a matrix and pass over the packed documents: no cell is shuffled, only each task's sums by
word. Where that matrix would exceed ``MATRIX_BYTES``, phi stays a table: a step is then a join on the word, one aggregation
by document and one by word. ``joined`` frames hold a row for each non-zero cell with the word's phi.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.operators.bow import long_bow, packed, small
from topicloom.plans import kernels
from topicloom.session import cut

EPS = 1e-12
#: Bytes up to which phi goes to each Python worker as a matrix.
MATRIX_BYTES = 512 << 20


def columns(prefix: str, topics: int) -> list[str]:
    return [f"{prefix}{k}" for k in range(topics)]


def _sum(terms: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a + b, terms)


def floor_at(x: Column, least: float = EPS) -> Column:
    return F.greatest(x, F.lit(least))


def nonzero(x: Column) -> Column:
    return F.when(x == 0, F.lit(1.0)).otherwise(x)


def long_form(wide: DataFrame, key: str, prefix: str, topics: int, value: str = "p") -> DataFrame:
    """(topic, key, value)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("topic"), F.col(f"{prefix}{k}").alias(value)) for k in range(topics))))
    return wide.select(key, pairs.alias("x")).select("x.topic", key, f"x.{value}")


def normalised_by_word(wide: DataFrame, topics: int) -> DataFrame:
    """phi with each topic's column divided by its total."""
    names = columns("p", topics)
    totals = wide.agg(*(F.sum(c).alias(f"s_{c}") for c in names))
    return wide.crossJoin(F.broadcast(totals)).select("word_id", *((F.col(c) / nonzero(F.col(f"s_{c}"))).alias(c) for c in names))  # one row


def arithmetic_phi(vocab: DataFrame, topics: int) -> DataFrame:
    """A start that any engine can compute: 1 + (w (2t + 3) + 5t) mod 11, each topic divided by its total."""
    w = F.col("word_id").cast("long")
    raw = vocab.select("word_id", *((1 + (w * (2 * t + 3) + 5 * t) % 11).cast("double").alias(f"p{t}") for t in range(topics)))
    return normalised_by_word(raw, topics)


def with_phi(bow: DataFrame, phi: DataFrame) -> DataFrame:
    return (long_bow(bow) if "word_ids" in bow.columns else bow).join(small(phi), "word_id")


class Matrix:
    """phi on the workers, and the passes over documents with it."""

    def __init__(self, phi: DataFrame, topics: int) -> None:
        got = phi.select("word_id", *columns("p", topics)).toArrow()
        ids = got["word_id"].to_numpy()
        phi_ = np.full((topics, int(ids.max(initial=-1)) + 1), np.nan)
        for k in range(topics):
            phi_[k, ids] = got[f"p{k}"].to_numpy()
        self.topics, self.all_words = topics, False
        self.sent = phi.sparkSession.sparkContext.broadcast(phi_)

    def counts(self, bow: DataFrame, method, vocab: DataFrame | None = None) -> DataFrame:
        """n_tw, wide; with ``vocab``, of its words, zeros where they have no counts: they join the tasks' rows in the same sums."""
        task = kernels.pass_task(self.sent, method, True, None, self.all_words)
        rows = kernels.gathered(packed(bow)).mapInArrow(task, kernels.schema(self.topics))
        return kernels.added(rows, self.topics) if vocab is None else kernels.added_for(vocab, rows, self.topics)

    def theta(self, bow: DataFrame, method, empty_too: bool = False) -> DataFrame:
        rows = bow if empty_too else packed(bow)
        kind = rows.schema["doc_id"].dataType.simpleString()
        each = rows.mapInArrow(kernels.theta_task(self.sent, method, False, self.all_words), f"doc_id {kind}, theta array<double>")
        return each.select("doc_id", *(F.col("theta")[k].alias(f"t{k}") for k in range(self.topics)))

    def likelihood(self, bow: DataFrame, method) -> DataFrame:
        """One row: ll, n."""
        task = kernels.pass_task(self.sent, method, False, EPS, self.all_words)
        rows = packed(bow).mapInArrow(task, kernels.schema(self.topics))
        of = lambda word: F.sum(F.when(F.col("word_id") == word, F.col("p0")))
        return rows.agg(of(-1).alias("ll"), of(-2).cast("long").alias("n"))


def matrix(phi: DataFrame, topics: int) -> Matrix | None:
    """phi as a matrix, or None where it is too large for one."""
    rows = MATRIX_BYTES // (8 * topics)
    return Matrix(phi, topics) if phi.limit(rows + 1).count() <= rows else None


def projection(joined: DataFrame, topics: int) -> DataFrame:
    """theta0: each document's counts times phi, divided by their total."""
    sums = joined.groupBy("doc_id").agg(*(F.sum(F.col("n") * F.col(f"p{k}")).alias(f"u{k}") for k in range(topics)))
    total = floor_at(_sum([F.col(f"u{k}") for k in range(topics)]))
    return sums.select("doc_id", *((F.col(f"u{k}") / total).alias(f"t{k}") for k in range(topics)))


def responsibilities(joined: DataFrame, theta: DataFrame, topics: int, guard: str = "floor", eps: float = EPS) -> DataFrame:
    """(doc_id, word_id, e0 ..): expected counts of each cell by topic.

    ``guard``: the denominator is floored at ``eps`` ('floor'), replaced by 1 where 0 ('nonzero'), or increased by ``eps`` ('add').
    """
    cells = joined.join(theta, "doc_id")
    parts = [F.col(f"p{k}") * F.col(f"t{k}") for k in range(topics)]
    total = _sum(parts)
    below = {"floor": floor_at(total, eps), "nonzero": nonzero(total), "add": total + eps}[guard]
    return cells.withColumn("__d", below).select("doc_id", "word_id", *((F.col("n") * x / F.col("__d")).alias(f"e{k}") for k, x in enumerate(parts)))


def by_word(cells: DataFrame, topics: int) -> DataFrame:
    """n_tw, wide: (word_id, p0 ..)."""
    return cells.groupBy("word_id").agg(*(F.sum(f"e{k}").alias(f"p{k}") for k in range(topics)))


def by_document(cells: DataFrame, topics: int) -> DataFrame:
    """n_td, wide: (doc_id, t0 ..)."""
    return cells.groupBy("doc_id").agg(*(F.sum(f"e{k}").alias(f"t{k}") for k in range(topics)))


def e_step(bow: DataFrame, phi: DataFrame, topics: int) -> DataFrame:
    """Cells' expected counts of the pLSA step, which starts from the projection each time."""
    joined = with_phi(bow, phi)
    return responsibilities(joined, projection(joined, topics), topics)


def m_step(n_tw: DataFrame, vocab: DataFrame, topics: int, floor: str = "counts") -> DataFrame:
    """phi from expected counts; ``floor``: counts are floored before dividing ('counts') or only their total ('denominator')."""
    return phi_of(vocab.select("word_id").join(n_tw, "word_id", "left"), topics, floor)


def phi_of(full: DataFrame, topics: int, floor: str = "counts") -> DataFrame:
    """``m_step`` of counts that have a row for each word of the vocabulary."""
    names = columns("p", topics)
    raw = full.select("word_id", *((floor_at(F.coalesce(c, F.lit(0.0))) if floor == "counts" else F.coalesce(c, F.lit(0.0))).alias(c) for c in names))
    totals = raw.agg(*(F.sum(c).alias(f"s_{c}") for c in names))
    return raw.crossJoin(F.broadcast(totals)).select("word_id", *((F.col(c) / floor_at(F.col(f"s_{c}"))).alias(c) for c in names))  # one row


def plsa_step(bow: DataFrame, phi: DataFrame, vocab: DataFrame, topics: int, floor: str = "counts") -> DataFrame:
    # Written, since the M-step reads the counts twice.
    m = matrix(phi, topics)
    if m is not None:
        return phi_of(cut(m.counts(bow, kernels.plsa, vocab), "counts"), topics, floor)
    return m_step(cut(by_word(e_step(bow, phi, topics), topics), "counts"), vocab, topics, floor)


def expected_by_word(bow: DataFrame, phi: DataFrame, topics: int) -> DataFrame:
    """n_tw of the pLSA step, wide."""
    m = matrix(phi, topics)
    return m.counts(bow, kernels.plsa) if m is not None else by_word(e_step(bow, phi, topics), topics)


def expected_by_document(bow: DataFrame, phi: DataFrame, topics: int) -> DataFrame:
    """n_td of the pLSA step, wide."""
    m = matrix(phi, topics)
    return m.theta(bow, kernels.plsa_counts) if m is not None else by_document(e_step(bow, phi, topics), topics)


def row_normalised(theta: DataFrame, topics: int, guard: str = "floor") -> DataFrame:
    total = _sum([F.col(f"t{k}") for k in range(topics)])
    below = floor_at(total) if guard == "floor" else nonzero(total)
    return theta.withColumn("__d", below).select("doc_id", *((F.col(f"t{k}") / F.col("__d")).alias(f"t{k}") for k in range(topics)))


def transform(bow: DataFrame, phi: DataFrame, topics: int, mode: str = "expected", docs: DataFrame | None = None) -> DataFrame:
    """theta, wide: from expected counts ('expected') or the projection; documents of ``docs`` without words get zeros.

    Where ``docs`` is ``bow`` itself (packed), its rows without words are passed over too, and nothing is joined.
    """
    m = matrix(phi, topics)
    if m is not None and docs is bow and "word_ids" in bow.columns:
        theta = m.theta(bow, functools.partial(kernels.plsa, theta_mode=mode), True)
        # A null id has zeros, as it would not be found by a join.
        return theta.select("doc_id", *(F.when(F.col("doc_id").isNotNull(), F.col(c)).otherwise(0.0).alias(c) for c in columns("t", topics)))
    if m is not None:
        theta = m.theta(bow, functools.partial(kernels.plsa, theta_mode=mode))
    else:
        joined = with_phi(bow, phi)
        theta = projection(joined, topics)
        if mode == "expected":
            theta = row_normalised(by_document(responsibilities(joined, theta, topics), topics), topics)
    if docs is not None:
        theta = docs.select("doc_id").join(theta, "doc_id", "left").na.fill(0.0, columns("t", topics))
    return theta


def log_likelihood(bow: DataFrame, phi: DataFrame, theta: DataFrame, topics: int) -> DataFrame:
    """One row: ll, n."""
    p = _sum([F.col(f"p{k}") * F.col(f"t{k}") for k in range(topics)])
    cells = with_phi(bow, phi).join(theta, "doc_id")
    return cells.agg(F.sum(F.col("n") * F.ln(floor_at(p))).alias("ll"), F.sum(F.col("n").cast("long")).alias("n"))


def perplexity(bow: DataFrame, phi: DataFrame, topics: int, mode: str = "expected") -> DataFrame:
    """One row: perplexity; infinite without words."""
    m = matrix(phi, topics)
    if m is not None:
        row = m.likelihood(bow, functools.partial(kernels.plsa, theta_mode=mode))
    else:
        row = log_likelihood(bow, phi, transform(bow, phi, topics, mode), topics)
    return row.select(F.when(F.coalesce("n", F.lit(0)) == 0, F.lit(float("inf"))).otherwise(F.exp(-F.col("ll") / F.when(F.col("n") != 0, F.col("n")))).alias("perplexity"))


def frobenius(a: DataFrame, b: DataFrame, topics: int) -> DataFrame:
    """One row: the root of the summed squared differences."""
    other = b.select("word_id", *(F.col(f"p{k}").alias(f"q{k}") for k in range(topics)))
    return a.join(other, "word_id").agg(F.sqrt(F.sum(_sum([F.pow(F.col(f"p{k}") - F.col(f"q{k}"), F.lit(2)) for k in range(topics)]))).alias("diff"))


# Regularised models.


def uniform_theta(bow: DataFrame, topics: int) -> DataFrame:
    return (packed(bow) if "word_ids" in bow.columns else bow).select("doc_id").distinct().select("doc_id", *(F.lit(1.0 / topics).alias(f"t{k}") for k in range(topics)))


def regularised_theta(bow: DataFrame, phi: DataFrame, topics: int, inner: int, smoothing: float = 0.0) -> DataFrame:
    """theta after a fixed number of inner updates from the uniform start.

    ``smoothing`` a: the gradient a / theta, so that a is added to each expected count.
    """
    m = matrix(phi, topics)
    if m is not None:
        return m.theta(bow, functools.partial(kernels.fixed_updates, updates=inner, more=smoothing))
    joined = with_phi(bow, phi)
    theta = uniform_theta(bow, topics)
    for _ in range(inner):
        counts = by_document(responsibilities(joined, theta, topics, "nonzero"), topics)
        if smoothing:
            counts = counts.select("doc_id", *((F.col(f"t{k}") + smoothing).alias(f"t{k}") for k in range(topics)))
        theta = row_normalised(counts, topics, "nonzero")
    return theta


def regularised_counts(bow: DataFrame, phi: DataFrame, topics: int, inner: int, smoothing: float = 0.0) -> DataFrame:
    """n_tw under ``regularised_theta``."""
    m = matrix(phi, topics)
    if m is not None:
        return m.counts(bow, functools.partial(kernels.fixed_updates, updates=inner, more=smoothing))
    return by_word(responsibilities(with_phi(bow, phi), regularised_theta(bow, phi, topics, inner, smoothing), topics, "nonzero"), topics)


def regularised_phi(n_tw: DataFrame, vocab: DataFrame, topics: int, norm: str = "topic_axis") -> DataFrame:
    """phi with each word's row summing to 1 ('topic_axis') or each topic's column ('word_axis')."""
    names = columns("p", topics)
    full = vocab.select("word_id").join(n_tw, "word_id", "left").na.fill(0.0, names)
    if norm == "word_axis":
        return normalised_by_word(full, topics)
    total = nonzero(_sum([F.col(c) for c in names]))
    return full.withColumn("__d", total).select("word_id", *((F.col(c) / F.col("__d")).alias(c) for c in names))


def positive_simplex(wide: DataFrame, topics: int, eps: float = EPS) -> DataFrame:
    """Negative entries go, each word's row is divided by its total if that exceeds ``eps``, else is 0."""
    parts = [F.greatest(F.col(f"p{k}"), F.lit(0.0)) for k in range(topics)]
    return wide.withColumn("__d", _sum(parts)).select("word_id", *(F.when(F.col("__d") > eps, x / F.col("__d")).otherwise(0.0).alias(f"p{k}") for k, x in enumerate(parts)))


def _offline_counts(bow: DataFrame, phi: DataFrame, topics: int, alpha: float) -> DataFrame:
    m = matrix(phi, topics)
    if m is not None:
        return m.counts(bow, functools.partial(kernels.offline, alpha=alpha))
    joined = with_phi(bow, phi)
    sums = joined.groupBy("doc_id").agg(*(F.sum(F.col("n") * F.col(f"p{k}")).alias(f"t{k}") for k in range(topics)))
    theta = row_normalised(sums.select("doc_id", *((F.col(f"t{k}") + alpha).alias(f"t{k}") for k in range(topics))), topics, "nonzero")
    return joined.select("doc_id", "word_id", "n").join(theta, "doc_id").groupBy("word_id").agg(*(F.sum(F.col("n") * F.col(f"t{k}")).alias(f"p{k}") for k in range(topics)))


def offline_step(bow: DataFrame, phi: DataFrame, vocab: DataFrame, topics: int, alpha: float = 0.0, beta: float = 0.0, sparsity: float = 0.0) -> DataFrame:
    """The simplified offline step: theta from counts times phi plus alpha, counts times theta plus beta, less a share of each topic's mean."""
    counts = cut(_offline_counts(bow, phi, topics, alpha), "counts")
    names = columns("p", topics)
    raw = vocab.select("word_id").join(counts, "word_id", "left").select("word_id", *((F.coalesce(c, F.lit(0.0)) + beta).alias(c) for c in names))
    if sparsity > 0:
        means = raw.agg(*(F.avg(c).alias(f"m_{c}") for c in names))
        raw = raw.crossJoin(F.broadcast(means)).select("word_id", *((F.col(c) - sparsity * F.col(f"m_{c}")).alias(c) for c in names))  # one row
    return normalised_by_word(raw.select("word_id", *(floor_at(F.col(c)).alias(c) for c in names)), topics)


def fold_in(bow: DataFrame, phi: DataFrame, topics: int, updates: int = 20, eps: float = 1e-8) -> DataFrame:
    """theta of new documents with phi fixed; ``eps`` is added to the counts before dividing."""
    m = matrix(phi, topics)
    if m is not None:
        return m.theta(bow, functools.partial(kernels.fixed_updates, updates=updates, more=eps, eps=eps))
    joined = with_phi(bow, phi)
    theta = uniform_theta(bow, topics)
    for _ in range(updates):
        counts = by_document(responsibilities(joined, theta, topics, "add", eps), topics).select("doc_id", *((F.col(f"t{k}") + eps).alias(f"t{k}") for k in range(topics)))
        total = _sum([F.col(f"t{k}") for k in range(topics)])
        theta = counts.withColumn("__d", total).select("doc_id", *((F.col(f"t{k}") / F.col("__d")).alias(f"t{k}") for k in range(topics)))
    return theta
