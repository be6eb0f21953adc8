"""Token ids and the bag of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import Step, tokens_simple
from topicloom.operators.vocab import tokenised
from topicloom.plans.kernels import slices
from topicloom.session import cut

#: Bytes up to which a table is broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 64 << 20


def row_bytes(df: DataFrame) -> int:
    """Bytes of a row in memory: 16 a column, and 48 more for strings (tokens) and the like."""
    return sum(16 if f.dataType.typeName() in ("integer", "long", "double", "float", "boolean", "short", "byte") else 64 for f in df.schema.fields)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint behind a check of rows times their width: a phi of many topics has wide rows."""
    rows = limit // row_bytes(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Tokens that are looked up at a time.
TOKENS = 1 << 19


def _table(vocab: DataFrame) -> tuple:
    """(hashes ascending, their word ids, their tokens, most tokens with one hash) of a vocabulary."""
    got = vocab.where(F.col("token").isNotNull()).select(F.xxhash64("token").alias("h"), F.col("word_id").cast("int").alias("word_id"), "token").toArrow()
    order = np.argsort(got["h"].to_numpy(), kind="stable")
    keys = got["h"].to_numpy()[order]
    tokens = pa.chunked_array(got["token"].chunks, got["token"].type).cast(pa.large_string()).combine_chunks().take(pa.array(order))
    tokens = tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens
    run = int(np.unique(keys, return_counts=True)[1].max(initial=0))
    return keys, got["word_id"].to_numpy()[order].astype(np.int32), tokens, run


def _looked_up(table: tuple, tokens: pa.Array, hashes: np.ndarray) -> np.ndarray:
    """Word ids of tokens, -1 for unknown ones. A hash only says where to look: the tokens themselves are compared."""
    keys, ids, words, run = table
    out = np.full(len(hashes), -1, np.int32)
    at = np.searchsorted(keys, hashes)
    for k in range(run):
        i = at + k
        ok = np.flatnonzero(i < len(keys))
        ok = ok[keys[i[ok]] == hashes[ok]]
        same = pc.equal(words.take(pa.array(i[ok])), tokens.take(pa.array(ok)).cast(pa.large_string()))
        ok = ok[same.to_numpy(zero_copy_only=False)]
        out[ok] = ids[i[ok]]
    return out


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, pa.int32()))


def _lookup_task(sent, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "tokens", TOKENS):
                tokens, sizes = part.column("tokens"), np.diff(part.column("tokens").offsets.to_numpy())
                ids = _looked_up(sent.value, tokens.flatten(), part.column("hashes").flatten().to_numpy())
                rows, known = np.repeat(np.arange(len(sizes)), sizes), ids >= 0
                rows, ids = rows[known], ids[known]
                if not counted:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(ids, np.bincount(rows, minlength=len(sizes)))], names=["doc_id", "word_ids"])
                    continue
                cells, n = np.unique((rows.astype(np.int64) << 32) | ids, return_counts=True)
                each = np.bincount(cells >> 32, minlength=len(sizes))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), _lists(cells & 0xFFFFFFFF, each), _lists(n, each)], names=["doc_id", "n_tokens", "word_ids", "counts"])

    return run


def _by_lookup(tokenised_: DataFrame, vocab: DataFrame, counted: bool) -> DataFrame:
    """Each document's tokens looked up where the document is: no token is shuffled, each worker holds the vocabulary's hashes, ids and tokens."""
    rows = tokenised_.select("doc_id", "tokens", F.transform("tokens", lambda x: F.xxhash64(x)).alias("hashes"))
    sent = tokenised_.sparkSession.sparkContext.broadcast(_table(vocab))
    kind = tokenised_.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_lookup_task(sent, counted), f"doc_id {kind}, " + ("n_tokens long, word_ids array<int>, counts array<int>" if counted else "word_ids array<int>"))


def encoded(tokenised_: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, word_ids): ids in text order with repetitions, unknown tokens dropped; each document has a row."""
    return _by_lookup(tokenised_, vocab, False)


def counted(tokenised_: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, word_ids, counts): one row a row of ``tokenised_``, word ids ascending, without a shuffle."""
    return _by_lookup(tokenised_, vocab, True)


def merged(counted_: DataFrame) -> DataFrame:
    """``counted_`` with one row a document, where rows share an id; only those rows are shuffled."""
    twice = counted_.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1).select("doc_id").persist()
    if not twice.limit(1).count():
        twice.unpersist()
        return counted_
    some = counted_.join(twice, "doc_id", "left_semi")
    tokens = some.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"))
    cells = packed(long_bow(some).groupBy("doc_id", "word_id").agg(F.sum("n").cast("int").alias("n")))
    empty = F.array().cast("array<int>")
    both = tokens.join(cells, "doc_id", "left").select("doc_id", "n_tokens", F.coalesce("word_ids", empty).alias("word_ids"), F.coalesce("counts", empty).alias("counts"))
    return cut(counted_.join(twice, "doc_id", "left_anti").unionByName(both), "merged")


def long_bow(packed_: DataFrame) -> DataFrame:
    """(doc_id, word_id, n) of packed documents."""
    each = packed_.select("doc_id", F.explode(F.arrays_zip("word_ids", "counts")).alias("x"))
    return each.select("doc_id", F.col("x.word_ids").alias("word_id"), F.col("x.counts").alias("n"))


def encoded_at(docs: DataFrame, vocab: DataFrame, ids: list[int], tokenizer: Step = tokens_simple) -> DataFrame:
    """(doc_id, word_ids) of some documents of (doc_id, text): the ids are pushed to the scan, and only these texts are split."""
    return encoded(tokenised(docs.where(F.col("doc_id").isin(ids)), tokenizer), vocab)


def bag_of_words(tokenised_: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, word_id, n)."""
    return long_bow(merged(counted(tokenised_, vocab)))


def bag_of_ids(encoded_: DataFrame, vocab_size: int | None = None) -> DataFrame:
    """(doc_id, word_id, n) of id lists; ids outside 0..V-1 are dropped."""
    each = encoded_.select("doc_id", F.explode("word_ids").alias("word_id"))
    if vocab_size is not None:
        each = each.where((F.col("word_id") >= 0) & (F.col("word_id") < vocab_size))
    return each.groupBy("doc_id", "word_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


def packed(bow: DataFrame) -> DataFrame:
    """(doc_id, word_ids, counts): one row a document with words, ids ascending. Packed documents are taken as they are."""
    if "word_ids" in bow.columns:
        return bow.where(F.size("word_ids") > 0)
    pairs = bow.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("word_id", "n"))).alias("p"))
    return pairs.select("doc_id", F.col("p.word_id").alias("word_ids"), F.col("p.n").alias("counts"))


def check_shape(bow: DataFrame, vocab_size: int) -> None:
    top = bow.agg(F.max(F.array_max("word_ids") if "word_ids" in bow.columns else "word_id")).first()[0]
    if top is not None and top >= vocab_size:
        raise ValueError(f"word id {top} does not fit a vocabulary of {vocab_size}")


def corpus_stats(tokenised_: DataFrame, vocab: DataFrame, bow: DataFrame) -> DataFrame:
    """One row: documents, non-empty ones, tokens, vocabulary, non-zero cells, kept tokens."""
    docs = tokenised_.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.when(F.size("tokens") > 0, 1).otherwise(0)).alias("n_nonempty"), F.sum(F.size("tokens").cast("long")).alias("n_tokens"))
    return docs.crossJoin(vocab.agg(F.count(F.lit(1)).alias("vocab_size"))).crossJoin(bow.agg(F.count(F.lit(1)).alias("nnz"), F.sum("n").alias("kept_tokens")))  # three single rows


def empty_documents(tokenised_: DataFrame, bow: DataFrame) -> DataFrame:
    """(doc_id): documents without a known token."""
    return tokenised_.select("doc_id").join(bow.select("doc_id").distinct(), "doc_id", "left_anti")


def unknown_rate(tokenised_: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_unknown)."""
    return unknown_of(counted(tokenised_, vocab))


def unknown_of(counted_: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_unknown) of ``counted`` rows."""
    return counted_.select("doc_id", "n_tokens", (F.col("n_tokens") - kept_tokens()).alias("n_unknown"))


def kept_tokens() -> Column:
    """The sum of a packed document's counts."""
    return F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
