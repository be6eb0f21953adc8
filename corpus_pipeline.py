"""Training-corpus pipeline: quality, boilerplate lines, near duplicates, personal data, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written as
Parquet and read again. All but the last return the columns of ``documents``.

Defined results: null texts stay null (as empty ones they have no lines, links or personal data, and give one piece); very long texts are
handled whole; null and repeated ids are rows of their own, and of rows that are equal or near one stays, whatever its id;
ties go to the least id; an empty table, and one without labels (all documents stay then), gives an empty or whole result; other
columns of ``docs`` are dropped, whatever their names. What a stage writes on its way is deleted once its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import line_dedup, ngram_join, packing, pii, quality
from topicloom.llm._common import delete, scratch, written
from topicloom.llm.queries import held_out, tokenizer_file
from topicloom.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _as_documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    model = quality.fit(docs, labels)
    return quality.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than ``line_dedup.RATIO`` of a source's pages go."""
    ship(spark)
    return _as_documents(line_dedup.drop_boilerplate(docs.select(*COLUMNS), "source", "text"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links (five-word shingles, Jaccard 0.8 or more) connect, the one with the least id stays."""
    ship(spark)
    return ngram_join.keep_one_of_each(docs.select(*COLUMNS))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _as_documents(pii.redact(docs.select(*COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    ship(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, kept = docs, []
        with scratch(spark, kept):
            kept.append(docs := written(stage(spark, before, sf_dir), name))
        if before is not docs and hasattr(before, "written_to"):
            delete(spark, [before.written_to])
    return STAGES[-1][1](spark, docs, sf_dir)
