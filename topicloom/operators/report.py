"""Top words of topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.operators.bow import small

#: Shares into which a topic's words are dealt.
SHARES = 64


def top_words(phi: DataFrame, top_n: int = 10, vocab: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(topic, rank, word_id, p[, token]): by falling p, equal ones by falling word id; ranks count from 1.

    ``digits`` rounds p before ranking. Words that the vocabulary lacks are named <unk_id>.
    """
    p = F.col("p") if digits is None else F.round("p", digits)
    order = (F.desc("p"), F.desc("word_id"))
    # The best of each share of a topic's words first, so that no task sorts a whole topic.
    first = F.row_number().over(Window.partitionBy("topic", "share").orderBy(*order))
    few = phi.withColumn("p", p).withColumn("share", F.pmod(F.xxhash64("word_id"), F.lit(SHARES))).withColumn("first", first).where(F.col("first") <= top_n)
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(*order))
    best = few.withColumn("rank", rank).where(F.col("rank") <= top_n).select("topic", "rank", "word_id", "p")
    if vocab is None:
        return best
    named = best.join(small(vocab.select("word_id", "token")), "word_id", "left")
    return named.withColumn("token", F.coalesce("token", F.concat(F.lit("<unk_"), F.col("word_id").cast("string"), F.lit(">")))).select("topic", "rank", "word_id", "token", "p")
