"""Frequencies and the frequency-bounded vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.text import Step, tokens_simple
from topicloom.session import cut


def tokenised(docs: DataFrame, tokenizer: Step = tokens_simple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens): one row a document, empty arrays included."""
    return docs.select(F.col(id_col).alias("doc_id"), tokenizer(F.col(text_col)).alias("tokens"))


def occurrences(tokenised_: DataFrame) -> DataFrame:
    """(doc_id, token): one row an occurrence."""
    return tokenised_.select("doc_id", F.explode("tokens").alias("token"))


def term_frequency(tokenised_: DataFrame) -> DataFrame:
    """(token, cf): occurrences in the collection."""
    return occurrences(tokenised_).groupBy("token").agg(F.count(F.lit(1)).alias("cf"))


def document_frequency(tokenised_: DataFrame) -> DataFrame:
    """(token, df): documents with the token; repetitions go before the shuffle."""
    return tokenised_.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def bounds(n_docs: int, min_df: int = 1, max_df: float = 0.95, exempt: bool = True) -> tuple[int, int | None]:
    """Least and largest frequency; documents without text count. With ``exempt``, max_df >= 1 means no upper bound."""
    return min_df, None if exempt and max_df >= 1.0 else int(max_df * n_docs)


def build_vocabulary(tokenised_: DataFrame, min_df: int = 1, max_df: float = 0.95, freq_mode: str = "collection", n_docs: int | None = None, exempt: bool = True) -> DataFrame:
    """(word_id, token, frequency): tokens within the bounds, numbered from 0 in code point order.

    ``freq_mode``: 'collection' bounds the number of occurrences, 'document' the number of documents.
    The numbering sorts by a range exchange; only counts of its partitions meet in one place.
    """
    from topicloom.sources.corpus import numbered_by

    low, high = bounds(tokenised_.count() if n_docs is None else n_docs, min_df, max_df, exempt)
    counted = term_frequency(tokenised_) if freq_mode == "collection" else document_frequency(tokenised_).withColumnRenamed("df", "cf")
    kept = counted.where(F.col("cf") >= low) if high is None else counted.where(F.col("cf").between(low, high))
    # Written, since the range exchange samples its rows first: the texts are split once.
    return numbered_by(cut(kept, "counted"), "token").select(F.col("doc_id").cast("int").alias("word_id"), "token", F.col("cf").alias("frequency"))


def ranked(counted: DataFrame) -> DataFrame:
    """The same numbering by one window, for vocabularies that one task sorts."""
    return counted.withColumn("word_id", (F.row_number().over(Window.orderBy("token")) - 1).cast("int"))
