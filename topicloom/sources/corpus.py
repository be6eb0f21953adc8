"""Corpora in folders: CSV to Parquet, document numbers, vocabularies and histories as JSON."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.session import cut

log = logging.getLogger(__name__)


def _listed(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Paths of the folder's files with this suffix, sorted; any file system that Spark can read."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(folder)
    return sorted(x.getPath().toString() for x in fs.listStatus(path) if x.getPath().getName().endswith(suffix))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def csv_folder_to_parquet(spark: SparkSession, csv_folder: str, parquet_folder: str, text_column: str = "Description", overwrite: bool = False) -> list[str]:
    """One Parquet table of the same stem for each CSV file; present ones stay unless ``overwrite``. Returns the written paths.

    Header row, inferred types, the text column as string; quoted fields may hold line breaks.
    """
    files = _listed(spark, csv_folder, ".csv")
    if not files:
        raise ValueError(f"no CSV files in {csv_folder}")
    done = []
    for file in files:
        target = f"{parquet_folder.rstrip('/')}/{Path(file).stem}.parquet"
        if _exists(spark, target):
            if not overwrite:
                continue
            log.info("overwriting %s", target)
        rows = spark.read.csv(file, header=True, inferSchema=True, multiLine=True, quote='"', escape='"')
        if text_column in rows.columns:
            rows = rows.withColumn(text_column, F.col(text_column).cast("string"))
        rows.write.mode("overwrite").parquet(target)
        done.append(target)
    return done


def read_corpus(spark: SparkSession, folder: str, text_column: str = "Description") -> DataFrame:
    """(doc_id, text) of all Parquet tables of a folder; documents are numbered by path and row, from 0."""
    if not _listed(spark, folder, ".parquet"):
        raise ValueError(f"no Parquet files in {folder}")
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)
    rows = rows.select(F.col(text_column).cast("string").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return numbered(rows, "file", "row").select("doc_id", "text")


def numbered(rows: DataFrame, group_col: str, order_col: str) -> DataFrame:
    """``rows`` with ``doc_id``: dense numbers from 0 by (group, order), nulls of other columns included.

    Rows are counted for each group, and only the groups' counts meet in one window; ``order_col`` counts from 0
    without gaps within a group, as row numbers of a file do.
    """
    sizes = rows.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(group_col, (F.sum("n").over(Window.orderBy(group_col)) - F.col("n")).alias("__before"))
    return rows.join(F.broadcast(before), group_col).withColumn("doc_id", (F.col("__before") + F.col(order_col)).cast("long")).drop("__before")


def numbered_by(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``doc_id``: dense numbers from 0 by any sortable columns.

    A range exchange sorts; each partition's rows are counted and the counts' running sum is added.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    # Written, not cached: what a lost executor held would be dealt anew, with other numbers.
    dealt = cut(dealt.withColumn("__i", F.col("__i") - F.shiftleft(F.col("__p").cast("long"), 33)), "dealt")
    sizes = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    return dealt.join(F.broadcast(before), "__p").withColumn("doc_id", F.col("__before") + F.col("__i")).drop("__p", "__i", "__before")


def synthetic_corpus(spark: SparkSession, documents: int = 500, mean_length: int = 80, vocabulary: int = 1000, seed: int = 0) -> DataFrame:
    """(doc_id, word_ids): lengths near a Poisson law (a sum of uniforms), ids uniform; the same for the same seed."""
    rows = spark.range(documents).withColumnRenamed("id", "doc_id")
    u = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit(k)), F.lit(1_000_003)) / 1_000_003.0
    normal = sum((u(-k) for k in range(1, 13)), F.lit(0.0)) - 6.0
    length = F.greatest(F.lit(1), F.round(mean_length + normal * mean_length**0.5)).cast("int")
    ids = F.transform(F.sequence(F.lit(1), length), lambda i: F.pmod(F.xxhash64("doc_id", F.lit(seed), i), F.lit(vocabulary)).cast("int"))
    return rows.select("doc_id", ids.alias("word_ids"))


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    """A JSON object token -> id in id order; the vocabulary is bounded by its frequency limits."""
    rows = vocab.select("token", "word_id").orderBy("word_id").toLocalIterator()
    with open(path, "w", encoding="utf-8") as f:
        json.dump({x["token"]: x["word_id"] for x in rows}, f, ensure_ascii=False)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        return spark.createDataFrame([(t, int(i)) for t, i in json.load(f).items()], "token string, word_id int")


def save_history(history: dict[str, list[float] | None], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(history, f, indent=2)


def history_frame(spark: SparkSession, history: dict[str, list[float] | None]) -> DataFrame:
    train, val = history["train_perplexity"], history.get("val_perplexity") or []
    rows = [(i, float(x), float(val[i]) if i < len(val) else None) for i, x in enumerate(train)]
    return spark.createDataFrame(rows, "iteration int, train_perplexity double, val_perplexity double")
