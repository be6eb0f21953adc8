import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import batches, bow, em, report, vocab
from topicloom.sources import corpus


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(0, "b a a a a a a a a a"), (1, "c b"), (2, None), (3, ""), (4, "zz")], "doc_id long, text string")


def words(v):
    return [(r.word_id, r.token, r.frequency) for r in v.orderBy("word_id").collect()]


def test_frequency_bounds(spark, docs):
    tok = vocab.tokenised(docs)
    assert words(vocab.build_vocabulary(tok, 1, 0.5)) == [(0, "b", 2), (1, "c", 1), (2, "zz", 1)]  # int(0.5 * 5) = 2, nulls count
    assert words(vocab.build_vocabulary(tok, 2, 1.0)) == [(0, "a", 9), (1, "b", 2)]  # no upper bound
    assert words(vocab.build_vocabulary(tok, 2, 1.0, exempt=False)) == [(0, "b", 2)]
    assert words(vocab.build_vocabulary(tok, 2, 1.0, "document")) == [(0, "b", 2)]
    assert words(vocab.build_vocabulary(tok, 5, 0.2)) == []


def test_encoding_and_bag_of_words(spark, docs):
    tok = vocab.tokenised(docs)
    v = vocab.build_vocabulary(tok, 2, 1.0)
    assert {r.doc_id: r.word_ids for r in bow.encoded(tok, v).collect()} == {0: [1] + [0] * 9, 1: [1], 2: [], 3: [], 4: []}
    cells = {(r.doc_id, r.word_id, r.n) for r in bow.bag_of_words(tok, v).collect()}
    assert cells == {(0, 0, 9), (0, 1, 1), (1, 1, 1)}
    assert {(r.doc_id, r.word_id, r.n) for r in bow.bag_of_ids(bow.encoded(tok, v), 1).collect()} == {(0, 0, 9)}
    assert {r.doc_id for r in bow.empty_documents(tok, bow.bag_of_words(tok, v)).collect()} == {2, 3, 4}
    assert {(r.doc_id, r.n_tokens, r.n_unknown) for r in bow.unknown_rate(tok, v).collect()} == {(0, 10, 0), (1, 2, 1), (2, 0, 0), (3, 0, 0), (4, 1, 1)}
    with pytest.raises(ValueError):
        bow.check_shape(bow.bag_of_words(tok, v), 1)
    ids = spark.createDataFrame([(0, [-1, 0, 1, 2, 1])], "doc_id long, word_ids array<int>")
    assert {(r.word_id, r.n) for r in bow.bag_of_ids(ids, 2).collect()} == {(0, 1), (1, 2)}


def test_batches_and_splits(spark):
    rows = spark.range(10).withColumnRenamed("id", "doc_id")
    with pytest.raises(ValueError):
        batches.BatchLoader(rows, 0)
    loader = batches.BatchLoader(rows, 4)
    assert len(loader) == 3 and [sorted(r.doc_id for r in b.collect()) for b in loader] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    mixed = batches.BatchLoader(rows, 4, True, 1)
    first, second = ([sorted(r.doc_id for r in b.collect()) for b in mixed] for _ in range(2))
    assert first != second and sorted(sum(first, [])) == sorted(sum(second, [])) == list(range(10))
    train, val = batches.train_val_split(spark.range(1000).withColumnRenamed("id", "doc_id"), 0.1)
    assert train.count() + val.count() == 1000 and 60 < val.count() < 140 and not train.join(val, "doc_id").count()


def numpy_step(n, phi):
    """The E and M step of pLSA and theta and perplexity under phi, straight from the formulas."""
    u = n @ phi.T
    theta = u / np.maximum(u.sum(1, keepdims=True), 1e-12)
    joint = theta[:, :, None] * phi[None]
    e = n[:, None, :] * joint / np.maximum(joint.sum(1, keepdims=True), 1e-12)
    n_tw, n_td = e.sum(0), e.sum(2)
    final = n_td / np.maximum(n_td.sum(1, keepdims=True), 1e-12)
    ll = (n * np.log(np.maximum(final @ phi, 1e-12))).sum()
    new = np.maximum(n_tw, 1e-12)
    return new / new.sum(1, keepdims=True), final, math.exp(-ll / n.sum())


def test_em_operators_against_numpy(spark):
    rng = np.random.default_rng(3)
    n = rng.integers(0, 4, (6, 9))
    n[2] = 0
    cells = spark.createDataFrame([(int(d), int(w), int(n[d, w])) for d, w in zip(*np.nonzero(n), strict=True)], "doc_id long, word_id int, n int")
    v = spark.createDataFrame([(i, f"w{i}") for i in range(9)], "word_id int, token string")
    phi = em.arithmetic_phi(v, 3)
    dense = np.array([[1 + (w * (2 * t + 3) + 5 * t) % 11 for w in range(9)] for t in range(3)], float)
    dense /= dense.sum(1, keepdims=True)
    new, theta, perplexity = numpy_step(n, dense)
    got = np.zeros((3, 9))
    for r in em.plsa_step(cells, phi, v, 3).collect():
        got[:, r.word_id] = [r.p0, r.p1, r.p2]
    assert np.allclose(got, new) and np.allclose(got.sum(1), 1)
    docs = spark.range(6).withColumnRenamed("id", "doc_id")
    rows = {r.doc_id: [r.t0, r.t1, r.t2] for r in em.transform(cells, phi, 3, docs=docs).collect()}
    assert np.allclose([rows[d] for d in range(6)], theta) and rows[2] == [0, 0, 0]
    assert em.perplexity(cells, phi, 3).first()[0] == pytest.approx(perplexity)
    assert em.perplexity(cells.where("n < 0"), phi, 3).first()[0] == math.inf
    assert em.by_word(em.e_step(cells, phi, 3), 3).agg(F.sum(F.col("p0") + F.col("p1") + F.col("p2"))).first()[0] == pytest.approx(n.sum())


def test_worked_tensor_example(spark):
    """Three words, two topics, four documents with unnormalised matrices 0, 1, 2 ..; values to six places."""
    phi = spark.createDataFrame([(w, 2.0 * w, 2.0 * w + 1) for w in range(3)], "word_id int, p0 double, p1 double")
    theta = spark.createDataFrame([(d, float(d), float(d + 4)) for d in range(4)], "doc_id long, t0 double, t1 double")
    cells = spark.createDataFrame([(d, w, 3 * d + w) for d in range(4) for w in range(3)], "doc_id long, word_id int, n int")
    e = em.responsibilities(cells.join(phi, "word_id"), theta, 2)
    n_wt = {r.word_id: (round(r.p0, 6), round(r.p1, 6)) for r in em.by_word(e, 2).collect()}
    assert n_wt == {0: (0, 18), 1: (3.965538, 18.034462), 2: (5.182376, 20.817624)}
    n_td = {r.doc_id: (round(r.t0, 6), round(r.t1, 6)) for r in em.by_document(e, 2).collect()}
    assert n_td == {0: (0, 3), 1: (1.160243, 10.839757), 2: (2.956938, 18.043062), 3: (5.030733, 24.969267)}
    new = {r.word_id: (round(r.p0, 6), round(r.p1, 6)) for r in em.normalised_by_word(em.by_word(e, 2), 2).collect()}
    assert new == {0: (0, 0.316611), 1: (0.433491, 0.317217), 2: (0.566509, 0.366172)}


def test_top_words_break_ties_and_name_unknown_words(spark):
    phi = spark.createDataFrame([(0, 0, 0.25), (0, 1, 0.25), (0, 2, 0.5), (1, 0, 1.0)], "topic int, word_id int, p double")
    v = spark.createDataFrame([(0, "a"), (2, "c")], "word_id int, token string")
    got = [(r.topic, r["rank"], r.token) for r in report.top_words(phi, 9, v).orderBy("topic", "rank").collect()]
    assert got == [(0, 1, "c"), (0, 2, "<unk_1>"), (0, 3, "a"), (1, 1, "a")]


def test_positive_simplex(spark):
    wide = spark.createDataFrame([(0, -1.0, 2.0), (1, -1.0, 0.0)], "word_id int, p0 double, p1 double")
    assert {(r.word_id, r.p0, r.p1) for r in em.positive_simplex(wide, 2).collect()} == {(0, 0.0, 1.0), (1, 0.0, 0.0)}


def test_numbering(spark):
    rows = spark.createDataFrame([("b", 0), ("a", 1), ("a", 0)], "file string, row long")
    assert {(r.file, r.row): r.doc_id for r in corpus.numbered(rows, "file", "row").collect()} == {("a", 0): 0, ("a", 1): 1, ("b", 0): 2}
    many = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert all(r.k == r.doc_id for r in corpus.numbered_by(many, "k").collect())
