import numpy as np
from pyspark.sql import functions as F

from topicloom.llm import ann


def nearest(ids, x, queries, k):
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        s = x @ x[i]
        others = np.arange(len(ids)) != i
        by = np.lexsort((ids[others], -s[others]))[:k]
        out[q] = list(zip(ids[others][by].tolist(), s[others][by].tolist(), strict=True))
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[1000:1600] = x[7]  # copies
    x[1600:1900] = x[8] + rng.normal(size=(300, 16)) * 0.01
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in ann.search(docs, F.col("vec_id") % 100 == 0, 20, rerank=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = nearest(np.arange(3000), x.astype(float), range(0, 3000, 100), 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    for q, found in got.items():
        assert np.allclose([s for _, s in found], [x[a].astype(float) @ x[q].astype(float) for a, _ in found], rtol=1e-12)
        assert found == sorted(found, key=lambda y: (-y[1], y[0]))


def test_rows_that_take_no_part(spark):
    bad = [None, [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], []]
    rows = [(i, v) for i, v in enumerate(bad)] + [(20, [1.0, 2.0]), (21, [1.0, 0.5]), (21, [1.0, 0.5]), (None, [3.0, 3.0]), (40, [2.0, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("v", F.lit("x"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(docs, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, None, 9.0), (20, 2, 40, 4.0), (20, 3, 21, 2.0), (20, 4, 21, 2.0), (40, 1, None, 9.0), (40, 2, 20, 4.0), (40, 3, 21, 2.5), (40, 4, 21, 2.5)]
    assert ann.search(docs.limit(0), F.lit(True)).count() == 0
    assert ann.search(docs.where("vec_id = 20"), F.lit(True)).count() == 0


def test_repeated_queries_sizes_and_waves(spark, monkeypatch):
    """Each row is a query or candidate of its own, among vectors of its size, however many waves there are."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4 if i % 5 else 7).tolist()) for i in range(200)]
    rows += [rows[0], rows[0], rows[20], rows[21], (40, rows[60][1])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = []
    for at, (q, x) in enumerate(rows):
        if q % 20 == 0:
            own = sorted((-float(np.dot(x, y)), i) for k, (i, y) in enumerate(rows) if k != at and len(x) == len(y))[:20]
            want += [(q, rank, i, round(-s, 9)) for rank, (s, i) in enumerate(own, 1)]
    for size in (1 << 20, 300):
        monkeypatch.setattr(ann, "WAVE_BYTES", size)
        got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.search(docs, F.col("vec_id") % 20 == 0, 20).collect()]
        assert sorted(got) == sorted(want)


def test_codes_are_four_bits_and_scans_follow_products():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 10))
    centres = ann.fit(x)
    codes = ann.assign(x, centres)
    assert codes.max() < 16 and ann.packed(codes).shape == (500, codes.shape[1] // 2)
    table, unit, zero = ann.tables(x[:3], centres)
    guess = ann.scan(ann.packed(codes), table) * unit + zero
    assert np.corrcoef(guess[:, 0], x @ x[0])[0, 1] > 0.9
    parallel = lambda c: np.mean(((x - ann_decoded(c, centres)[:, :10]) * x).sum(1) ** 2 / (x**2).sum(1))
    assert parallel(codes) <= parallel(ann.assign(x, centres, 0))


def ann_decoded(codes, centres):
    return centres[np.arange(centres.shape[0])[None], codes].reshape(len(codes), -1)


def test_sums_of_many_subspaces_do_not_wrap():
    table = np.full((200, 256, 1), 510, np.uint16)
    assert ann.scan(np.zeros((3, 200), np.uint8), table).tolist() == [[102_000]] * 3
