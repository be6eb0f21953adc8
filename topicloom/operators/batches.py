"""Batches and splits of documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_batch(docs: DataFrame, batch_size: int = 32, position_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``batch_id``; positions count from 0, the last batch may be smaller."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    return docs.withColumn("batch_id", F.floor(F.col(position_col) / F.lit(batch_size)).cast("long"))


def shuffled(docs: DataFrame, seed: int, epoch: int = 0, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with a dense ``position`` in an order that (seed, epoch) determines."""
    from topicloom.sources.corpus import numbered_by

    keyed = docs.withColumnRenamed(id_col, "__id").withColumn("__k", F.xxhash64("__id", F.lit(seed), F.lit(epoch)))
    return numbered_by(keyed, "__k", "__id").withColumnRenamed("doc_id", "position").withColumnRenamed("__id", id_col).drop("__k")


class BatchLoader:
    """Iterates over batches as DataFrames; with ``shuffle``, each epoch has its own order."""

    def __init__(self, docs: DataFrame, batch_size: int = 32, shuffle: bool = False, seed: int | None = None, id_col: str = "doc_id") -> None:
        if batch_size <= 0:
            raise ValueError("batch_size must be positive")
        self.docs, self.batch_size, self.shuffle, self.seed, self.id_col, self.epoch = docs, batch_size, shuffle, seed or 0, id_col, 0
        self.n = docs.count()

    def __len__(self) -> int:
        return math.ceil(self.n / self.batch_size)

    def __iter__(self) -> Iterator[DataFrame]:
        from topicloom.sources.corpus import numbered_by

        if self.shuffle:
            placed = shuffled(self.docs, self.seed, self.epoch, self.id_col)
        else:
            placed = numbered_by(self.docs.withColumn("__id", F.col(self.id_col)).drop(self.id_col), "__id").withColumnRenamed("doc_id", "position").withColumnRenamed("__id", self.id_col)
        self.epoch += 1
        batched = with_batch(placed, self.batch_size, "position").persist()
        for k in range(len(self)):
            yield batched.where(F.col("batch_id") == k).drop("position", "batch_id")
        batched.unpersist()


def split_mod(docs: DataFrame, modulus: int = 10, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``is_val``: ids divisible by ``modulus``."""
    return docs.withColumn("is_val", F.pmod(F.col(id_col), F.lit(modulus)) == 0)


def train_val_split(docs: DataFrame, val_share: float = 0.1, seed: int = 42, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Disjoint, exhaustive parts by a hash of the id."""
    val = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(10_000)) < int(round(val_share * 10_000))
    return docs.where(~val), docs.where(val)


def of_ids(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return rows.join(ids.select(id_col), id_col, "left_semi")
