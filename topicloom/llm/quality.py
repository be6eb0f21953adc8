"""Quality classifier by compression: dictionaries of good and of bad text.

Two zstandard dictionaries are built from good and bad labelled texts. A text is compressed with either, in
blocks, so that a long text keeps using the dictionary rather than its own past. The first feature is the difference of the
two sizes over their sum, the others are either size over the text's length; a logistic curve fitted on labelled texts that no
dictionary has seen turns them into a probability.

Scale: fitting takes a bounded sample of labelled rows (``SAMPLE`` a class, the smallest by a hash of the id). Their whole texts are cut
into blocks, of which the ``BLOCKS`` smallest of each class by a hash of id and place train its dictionary: a block's chance
does not depend on its place or its text's length. Scoring is one pass over whole texts without a shuffle. What the driver
holds is bounded by these parameters.

Defined results: a null text counts as empty and an empty text gets the score of its features (sizes of
nothing); labels other than 0 and 1, labels of ids that no row has, and ids with both labels are ignored; with labels of one
class only, or none, each score is that class's share (0.5 without labels); repeated rows are scored each; an empty table gives an empty
table; other columns pass through, except score and predicted, which give way to the results.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm._common import text_slices, written

#: Labelled rows and blocks of each class for fitting, bytes of a block and a dictionary, compression level.
SAMPLE, BLOCKS, BLOCK_BYTES, DICT_BYTES, LEVEL = 3000, 8000, 2048, 64 << 10, 3
#: Parts in ten of the sample that go to the dictionaries; the others calibrate.
DICT_TENTHS = 6


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries (good, bad) and the calibration: weights on (1, standardised features)."""

    good: bytes
    bad: bytes
    raw: bool
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    prior: float = 0.5


@functools.lru_cache(4)
def _compressors(good: bytes, bad: bytes, raw: bool):
    import zstandard as zstd

    out = []
    for content in (good, bad):
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if content:
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT if raw else zstd.DICT_TYPE_AUTO)
            d.precompute_compress(level=LEVEL)
            options["dict_data"] = d
        out.append(zstd.ZstdCompressor(**options))
    return out


def features(text: bytes, model: QualityModel) -> tuple[float, float, float]:
    """Normalised compressed-size difference, and either size a byte; blocks are compressed on their own."""
    good, bad = _compressors(model.good, model.bad, model.raw)
    a = b = 0
    for at in range(0, max(1, len(text)), BLOCK_BYTES):
        block = text[at : at + BLOCK_BYTES]
        a += len(good.compress(block))
        b += len(bad.compress(block))
    return (b - a) / (a + b), a / (len(text) + 1), b / (len(text) + 1)


def _dictionaries(good: list[bytes], bad: list[bytes]) -> tuple[bytes, bytes, bool]:
    """Trained dictionaries; with too few samples to train on, the samples themselves."""
    import zstandard as zstd

    try:
        return (*(zstd.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, x)) // 4)), x, level=LEVEL).as_bytes() for x in (good, bad)), False)
    except zstd.ZstdError:
        return b"".join(good), b"".join(bad), True


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Weights by damped Newton steps; both classes must be there."""
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, -z * (2 * y - 1)).sum() + ridge * (v[1:] ** 2).sum() / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        damp = np.r_[0, np.full(len(w) - 1, ridge)]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(damp + 1e-9), x.T @ (y - p) - damp * w)
        t = 1.0
        while t > 1e-6 and loss(w + t * step) > loss(w):
            t /= 2
        w = w + t * step
        if np.abs(t * step).max() < 1e-9:
            break
    return w


def _features(texts: pa.Array, model: QualityModel) -> np.ndarray:
    return np.array([features((x.as_py() or "").encode("utf-8"), model) for x in texts], float).reshape(-1, 3)


def _features_of(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows = pa.FixedSizeListArray.from_arrays(pa.array(_features(part.column("text"), model).ravel()), 3).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("order"), part.column("label"), rows], names=["order", "label", "features"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text"):
            for order, label, text in zip(part.column("order").to_pylist(), part.column("label").to_pylist(), part.column("text"), strict=True):
                data = (text.as_py() or "").encode("utf-8")
                blocks = [data[at : at + BLOCK_BYTES] for at in range(0, len(data), BLOCK_BYTES)]
                n = len(blocks)
                yield pa.RecordBatch.from_arrays([pa.array([order] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([label] * n, pa.int32()), pa.array(blocks, pa.binary())], names=["order", "place", "label", "block"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Fit on at most ``sample`` labelled rows of each class; ``labels`` has ids and 0/1 labels, training rows only."""
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    own = own.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("id", "label")
    own = own.withColumn("order", F.xxhash64(F.lit(7), "id"))
    bounded = own.where("label = 1").orderBy("order", "id").limit(sample).unionByName(own.where("label = 0").orderBy("order", "id").limit(sample))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(bounded), F.col("doc") == F.col("id")).select("order", "label", "text")  # at most 2 * sample ids
    rows = written(rows, "labelled")
    counts = {x["label"]: x["count"] for x in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return QualityModel(b"", b"", True, prior=float(next(iter(counts), 0.5)))
    tenth = F.pmod("order", F.lit(10)) < DICT_TENTHS
    each = rows.where(tenth).mapInArrow(_blocks, "order long, place int, label int, block binary").withColumn("by", F.xxhash64(F.lit(11), "order", "place"))
    blocks = {}
    for label in (0, 1):
        got = each.where(F.col("label") == label).orderBy("by", "order", "place").limit(BLOCKS).select("block").collect()
        blocks[label] = [bytes(x["block"]) for x in got]  # at most BLOCKS * BLOCK_BYTES bytes
    model = QualityModel(*_dictionaries(blocks[1], blocks[0]))
    seen = rows.mapInArrow(_features_of(model), "order long, label int, features array<double>")
    unseen = seen.where(~tenth).orderBy("order").limit(2 * sample).toPandas()
    if unseen["label"].nunique() < 2:  # too few rows to keep some apart
        unseen = seen.orderBy("order").limit(2 * sample).toPandas()
    x, y = np.array(unseen["features"].tolist()), unseen["label"].to_numpy(float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w = _logistic(np.c_[np.ones(len(x)), (x - mean) / scale], y)
    return QualityModel(model.good, model.bad, model.raw, tuple(mean), tuple(scale), tuple(w), float(y.mean()))


def _score(sent, text_col: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in text_slices(batch, text_col):
                columns = {n: part.column(n) for n in keep}
                if model.weights:
                    x = (_features(part.column(text_col), model) - model.mean) / model.scale
                    z = np.c_[np.ones(len(x)), x] @ np.array(model.weights)
                    scores = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                else:
                    scores = np.full(part.num_rows, model.prior)
                columns["score"] = pa.array(scores, pa.float64())
                columns["predicted"] = pa.array((scores >= 0.5).astype(np.int32), pa.int32())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def score(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from 0.5 on)."""
    keep = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES
    schema = T.StructType([*keep, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(_score(sent, text_col, [f.name for f in keep]), schema)
