"""Maximum inner product search by score-aware anisotropic quantisation, four-bit table scans and exact reranking.

Vectors are cut into subspaces of ``SUB`` dimensions with 16 centres each, so a code is four bits. Codes and
centres minimise a loss that weighs the part of the residual parallel to the vector more than the
orthogonal part, since the parallel part is what moves large inner products. A query's products with all
centres are tables of small integers; two codes share a byte, so a scan adds one table entry a byte. The best
``RERANK`` of each block by table score are scored exactly, in double precision, on the original vectors.

Scale: centres are fitted on a bounded sample (``SAMPLE`` rows, the smallest by a hash of the id); each row is
coded once and written in blocks of about ``BLOCK`` rows. Queries go to the tasks in waves of at most ``WAVE_BYTES`` of vectors, so
that neither rows nor queries are shuffled or copied to each other's blocks; a task keeps the best ``k`` of all its blocks for each
query of the wave, and hands on these alone. Each block has candidates of its own: a larger table means more candidates, not
fewer. Every query is scanned against every code, so time grows with their product.

Defined results: vectors that are null, all zero, or hold null or non-finite components take no part; vectors meet those of
their own size only; ties go to the smaller id; repeated rows are candidates of their own, a query
leaves out only its own row, and repeated query rows have an answer each; rows with null ids are candidates after all
others and never queries; with fewer candidates than ``k``, all are returned; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm._common import shared_folder, written

#: Dimensions of a subspace, rows for fitting, rounds of fitting and of coding.
SUB, SAMPLE, FIT_ROUNDS, CODE_ROUNDS = 2, 20_000, 8, 3
#: Cosine from which products matter: sets the weight of the parallel part.
THRESHOLD = 0.2
#: Rows of a block, queries of a block, rows of a block that are scored exactly for a query.
BLOCK, QUERY_BLOCK, RERANK = 4096, 256, 256
#: Bytes of query vectors that tasks get at once.
WAVE_BYTES = 32 << 20
#: Standard deviations of the table scores' error within which a row still is scored exactly.
DEVIATIONS = 3.0


def _padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % (2 * SUB))))


def _weights(x: np.ndarray) -> np.ndarray:
    """Extra weight of the parallel residual, for each vector, by its squared length."""
    d = x.shape[1]
    ratio = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    return (ratio - 1) / np.maximum((x**2).sum(1), 1e-30)


def assign(x: np.ndarray, centres: np.ndarray, rounds: int = CODE_ROUNDS) -> np.ndarray:
    """Codes (rows, subspaces) by coordinate descent on the anisotropic loss."""
    m = centres.shape[0]
    parts = _padded(x).reshape(len(x), m, SUB)
    weight = _weights(x)
    inner = np.einsum("nms,mks->nmk", parts, centres)
    own = (parts**2).sum(2)
    plain = own[:, :, None] - 2 * inner + (centres**2).sum(2)[None]
    codes = plain.argmin(2)
    rows = np.arange(len(x))
    for _ in range(rounds):
        gap = (own - np.take_along_axis(inner, codes[:, :, None], 2)[:, :, 0]).sum(1)  # <residual, x>
        for j in range(m):
            rest = gap - (own[:, j] - inner[rows, j, codes[:, j]])
            each = rest[:, None] + own[:, j, None] - inner[:, j]
            codes[:, j] = (plain[:, j] + weight[:, None] * each**2).argmin(1)
            gap = each[rows, codes[:, j]]
    return codes.astype(np.uint8)


def fit(x: np.ndarray, rounds: int = FIT_ROUNDS, seed: int = 1) -> np.ndarray:
    """Centres (subspaces, 16, SUB) by alternating between codes and a linear system for each centre."""
    x = np.unique(x, axis=0)  # copies would draw the centres to themselves
    rng = np.random.default_rng(seed)
    parts = _padded(x).reshape(len(x), -1, SUB)
    m = parts.shape[1]
    centres = np.stack([parts[rng.choice(len(x), 16, replace=len(x) < 16), j] for j in range(m)])
    weight = _weights(x)
    own = (parts**2).sum(2)
    for _ in range(rounds):
        codes = assign(x, centres, 1)
        chosen = centres[np.arange(m)[None], codes]
        gap = (own - (parts * chosen).sum(2)).sum(1)
        for j in range(m):
            p = parts[:, j]
            target = gap + (p * chosen[:, j]).sum(1)  # what <centre, p> should be for a parallel residual of 0
            outer = weight[:, None, None] * p[:, :, None] * p[:, None] + np.eye(SUB)
            right = (weight * target)[:, None] * p + p
            for k in range(16):
                if (own_rows := codes[:, j] == k).any():
                    centres[j, k] = np.linalg.solve(outer[own_rows].sum(0), right[own_rows].sum(0))
            new = centres[j][codes[:, j]]
            gap = gap + (p * chosen[:, j]).sum(1) - (p * new).sum(1)
            chosen[:, j] = new
    return centres


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    return codes[:, 0::2] | (codes[:, 1::2] << 4)


def tables(queries: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of a code, 256, queries): sums of two 8-bit table entries; and for each query their unit and their zero."""
    m = centres.shape[0]
    parts = _padded(queries).reshape(len(queries), m, SUB)
    inner = np.einsum("qms,mks->mkq", parts, centres)
    least = inner.min(1, keepdims=True)
    inner -= least
    unit = np.maximum(inner.max((0, 1)), 1e-30) / 255
    small = np.rint(inner / unit).astype(np.uint16)
    low, high = small[0::2], small[1::2]
    return (high[:, :, None, :] + low[:, None, :, :]).reshape(m // 2, 256, -1), unit, least.sum((0, 1))


def scan(code_bytes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Table scores (rows, queries)."""
    most = 2 * 255 * code_bytes.shape[1]
    out = table[0][code_bytes[:, 0]].astype(np.uint16 if most < 1 << 16 else np.uint32)
    for j in range(1, code_bytes.shape[1]):
        out += table[j][code_bytes[:, j]]
    return out


def best(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` largest; of equal ones the first."""
    if len(scores) <= most:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - most)[len(scores) - most]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: most - len(above)]])


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _pack(size: int, sent):
    """One row a group of at most ``size`` rows: ids, row numbers, vectors, and codes if there are centres."""

    def out(rows: pa.Table) -> pa.RecordBatch:
        key = np.lexsort((rows["rid"].to_numpy(), rows["id"].to_numpy()))
        rows = rows.take(pa.array(key))
        x = np.array(rows["v"].combine_chunks().flatten()).reshape(len(rows), -1)
        codes = packed(assign(x, sent.value)).tobytes() if sent is not None else b""
        return pa.RecordBatch.from_arrays(
            [pa.array([rows["block"][0].as_py()], pa.int64()), *(pa.array([y.tobytes()], pa.binary()) for y in (rows["id"].to_numpy(), rows["rid"].to_numpy(), x)), pa.array([codes], pa.binary())],
            names=["block", "ids", "rids", "vectors", "codes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            numbers, at = batch.column("block").to_numpy(), 0
            while at < batch.num_rows:
                if held and (n == size or held[0]["block"][0].as_py() != numbers[at]):
                    yield out(pa.Table.from_batches(held))
                    held, n = [], 0
                same = int(np.searchsorted(numbers, numbers[at], "right")) - at  # rows come by block
                held.append(batch.slice(at, min(same, size - n)))
                n, at = n + held[-1].num_rows, at + held[-1].num_rows
        if held:
            yield out(pa.Table.from_batches(held))

    return run


_PACKED = "block long, ids binary, rids binary, vectors binary, codes binary"


def _nearest(x: np.ndarray, ids: np.ndarray, rids: np.ndarray, codes: np.ndarray, q: np.ndarray, q_rids: np.ndarray, centres: np.ndarray, k: int, rerank: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and scores of its ``k`` best rows of one block, whose rows are sorted by id."""
    # Equal vectors are scanned once, so that copies do not crowd others out.
    _, first, class_of, copies = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1])))[:, 0], return_index=True, return_inverse=True, return_counts=True)
    members = np.argsort(class_of, kind="stable")
    starts, copies = np.cumsum(copies) - copies, np.minimum(copies, k + 1)
    table, unit, zero = tables(q, centres)
    scores = scan(codes[first], table).T.copy()
    for i in range(len(q)):
        some = best(scores[i], max(rerank, k + 1))
        if len(some) < len(first):
            # Where scores are crowded, all rows that the error seen so far could lift among the best.
            exact, guess = x[first[some]] @ q[i], scores[i] * unit[i] + zero[i]
            error = exact - guess[some]
            least = np.partition(exact, len(exact) - k - 1)[len(exact) - k - 1]
            some = np.union1d(some, np.flatnonzero(guess + DEVIATIONS * np.sqrt((error**2).mean()) >= least))
        each = copies[some]
        at = members[np.repeat(starts[some] - np.cumsum(each) + each, each) + np.arange(each.sum())]
        at = at[rids[at] != q_rids[i]]
        exact = x[at] @ q[i]
        top = np.lexsort((rids[at], ids[at], -exact))[:k]
        yield at[top], exact[top]


_FOUND = "q_rid long, query_id long, vec_id long, rid long, score double"


def _search(sent, wave, k: int, rerank: int):
    """The ``k`` best of a task's blocks for each query of the wave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        asked = [(np.frombuffer(i, np.int64), np.frombuffer(r, np.int64), np.frombuffer(v, np.float64).reshape(len(i) // 8, -1)) for i, r, v in wave.value]
        held: list[list] = [[(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))] * len(ids) for ids, _, _ in asked]
        for batch in batches:
            for row in range(batch.num_rows):
                ids, rids, x, codes = (np.frombuffer(batch.column(n)[row].as_py(), t) for n, t in (("ids", np.int64), ("rids", np.int64), ("vectors", np.float64), ("codes", np.uint8)))
                x, codes = x.reshape(len(ids), -1), codes.reshape(len(ids), -1)
                for (_, q_rids, q), own in zip(asked, held, strict=True):
                    for i, (at, score) in enumerate(_nearest(x, ids, rids, codes, q, q_rids, centres, k, rerank)):
                        both = [np.concatenate(z) for z in zip(own[i], (ids[at], rids[at], score), strict=True)]
                        top = np.lexsort((both[1], both[0], -both[2]))[:k]
                        own[i] = tuple(z[top] for z in both)
        for (ids, q_rids, _), own in zip(asked, held, strict=True):
            sizes = [len(z[0]) for z in own]
            columns = [np.repeat(q_rids, sizes), np.repeat(ids, sizes), *(np.concatenate(z) for z in zip(*own, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(z) for z in columns], names=["q_rid", "query_id", "vec_id", "rid", "score"])

    return run


def _searched(rows: DataFrame, size: int, n: int, path: str, k: int, rerank: int, sample: int) -> None:
    """Append the answers among the ``n`` rows whose vectors have this size to the table at ``path``."""
    spark = rows.sparkSession
    rows = rows.where(F.size("v") == size)
    some = rows.orderBy(F.xxhash64("id", "rid"), "rid").limit(sample).select("v").toPandas()  # at most `sample` rows
    sent = spark.sparkContext.broadcast(fit(np.array(some["v"].tolist())))  # 16 centres a subspace
    blocks = max(1, -(-n // BLOCK))
    by_block = rows.select(F.pmod(F.xxhash64("id", "rid"), F.lit(blocks)).alias("block"), "id", "rid", "v").repartitionByRange(blocks, "block").sortWithinPartitions("block")
    data = written(by_block.mapInArrow(_pack(2 * BLOCK, sent), _PACKED), "blocks").select("ids", "rids", "vectors", "codes")
    queries = rows.where("q")
    waves = -(-queries.count() * size * 8 // WAVE_BYTES)
    asked = queries.select(F.pmod(F.xxhash64(F.lit(1), "id", "rid"), F.lit(max(1, waves))).alias("block"), "id", "rid", "v").repartitionByRange(max(1, waves), "block").sortWithinPartitions("block")
    asked = written(asked.mapInArrow(_pack(QUERY_BLOCK, None), _PACKED), "queries")
    for wave in range(waves):
        got = [(bytes(r.ids), bytes(r.rids), bytes(r.vectors)) for r in asked.where(F.col("block") == wave).select("ids", "rids", "vectors").collect()]  # about WAVE_BYTES
        part = spark.sparkContext.broadcast(got)
        found = data.mapInArrow(_search(sent, part, k, rerank), _FOUND)
        rank = F.row_number().over(Window.partitionBy("q_rid").orderBy(F.desc("score"), "vec_id", "rid"))
        found.withColumn("rank", rank).where(F.col("rank") <= k).write.mode("append").parquet(path)
        part.unpersist()


def search(vectors: DataFrame, queries_where: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` rows with the largest inner products for each row of ``vectors`` with ``queries_where``.

    Returns query_id, rank (from 1), vec_id, score.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries_where, F.lit(False)).alias("q"), F.monotonically_increasing_id().alias("rid"))
    rows = written(rows.where(usable(F.col("v"))), "vectors")
    # A null id sorts after all others; it comes back as null.
    last = (1 << 63) - 1
    rows = rows.withColumn("q", F.col("q") & F.col("id").isNotNull()).withColumn("id", F.coalesce("id", F.lit(last)))
    schema = f"{_FOUND}, rank int"
    path = f"{shared_folder(spark)}/nearest-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("q").alias("asked")).where("asked and n > 1").orderBy("d")
    for size in sizes.collect():  # one search for each size of vectors
        _searched(rows, size["d"], size["n"], path, k, rerank, sample)
    found = spark.read.schema(schema).parquet(path)
    return found.select("query_id", "rank", F.when(F.col("vec_id") != last, F.col("vec_id")).alias("vec_id"), "score")
