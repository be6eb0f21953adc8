"""Online pLSA on Structured Streaming: each micro-batch replaces phi by its own M-step.

The vocabulary is frozen. phi is the whole state: it is written under the batch's number after each step, in any file system that
Spark can write, so a batch that comes again after a failure starts from the state before it, on any driver. States before
that one are deleted.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from topicloom.functions.text import Step, tokens_simple
from topicloom.operators.bow import bag_of_words
from topicloom.operators.vocab import tokenised
from topicloom.plans.plsa import PLSA


class OnlineTrainer:
    def __init__(self, model: PLSA, vocab: DataFrame, state_folder: str, tokenizer: Step = tokens_simple) -> None:
        self.model, self.vocab, self.folder, self.tokenizer = model, vocab, state_folder.rstrip("/"), tokenizer

    def _state(self, spark: SparkSession, batch_id: int):
        """The state's path and its file system."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/phi-{batch_id}")
        return path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    def step(self, docs: DataFrame, batch_id: int) -> None:
        spark = docs.sparkSession
        done, fs = self._state(spark, batch_id)
        if fs.exists(done):
            return
        before, _ = self._state(spark, batch_id - 1)
        if fs.exists(before):
            data = spark.read.format("binaryFile").load(f"{before}/*.npy").select("content").first()[0]
            self.model.phi = np.load(io.BytesIO(bytes(data)))
        bow = bag_of_words(tokenised(docs, self.tokenizer), self.vocab)
        if bow.limit(1).count():
            self.model.fit_batch(bow)
        data = io.BytesIO()
        np.save(data, self.model.phi)
        partial = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/part-{batch_id}")
        fs.delete(partial, True)
        fs.mkdirs(partial)
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(partial, "phi.npy"))
        out.write(bytearray(data.getvalue()))
        out.close()
        fs.rename(partial, done)
        fs.delete(self._state(spark, batch_id - 2)[0], True)

    def writer(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        """Start with ``.start()``; ``stream`` has doc_id and text."""
        return stream.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint)
