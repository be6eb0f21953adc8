import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicloom.operators import bow, em, vocab
from topicloom.plans import kernels
from topicloom.plans.plsa import PLSA, DensePLSA, row_shares
from topicloom.plans.regularised import RegularisedModel
from topicloom.session import cut


@pytest.fixture(scope="module")
def tok(spark):
    """60 documents over 24 words; some are empty, one word is too rare for the vocabulary."""
    r = np.random.default_rng(3)
    texts = [" ".join(f"w{w}" for w in r.integers(0, 24, r.integers(0, 40))) for _ in range(60)]
    texts[7], texts[8], texts[9] = "", None, "rare w1 w1"
    return vocab.tokenised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).persist()


@pytest.fixture(scope="module")
def words(tok):
    return vocab.build_vocabulary(tok, 2, 1.0).persist()


@pytest.fixture(scope="module")
def packed(tok, words):
    return bow.packed(bow.counted(tok, words)).persist()


def exchanges(df):
    """Shuffles of a plan, what is cached left out."""
    return str(df._jdf.queryExecution().executedPlan()).split("InMemoryRelation")[0].count("Exchange")


def rows(df, digits=9):
    return sorted(tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.collect())


def steps(b, phi, v):
    return {
        "plsa": em.plsa_step(b, phi, v, 3),
        "denominator": em.plsa_step(b, phi, v, 3, "denominator"),
        "n_td": em.expected_by_document(b, phi, 3),
        "expected": em.transform(b, phi, 3),
        "projection": em.transform(b, phi, 3, "projection"),
        "perplexity": em.perplexity(b, phi, 3),
        "theta": em.regularised_theta(b, phi, 3, 2, 0.1),
        "counts": em.regularised_counts(b, phi, 3, 2),
        "offline": em.offline_step(b, phi, v, 3, 0.1, 0.01, 0.1),
        "fold": em.fold_in(b, phi, 3, 3),
    }


@pytest.mark.parametrize("lacking", [False, True])
def test_steps_by_matrix_equal_steps_by_joins(packed, words, monkeypatch, lacking):
    """Slices and held rows of a few cells; packed and long rows; a phi without some words."""
    phi = em.arithmetic_phi(words, 3).where(F.col("word_id") % 5 != 2 if lacking else F.lit(True)).persist()
    by_matrix = {k: rows(x) for k, x in steps(packed, phi, words).items()}
    by_long = {k: rows(x) for k, x in steps(bow.long_bow(packed), phi, words).items()}
    monkeypatch.setattr(em, "MATRIX_BYTES", 0)
    by_joins = {k: rows(x) for k, x in steps(packed, phi, words).items()}
    assert by_matrix == by_long == by_joins


def test_documents_are_passed_over_without_a_shuffle_of_cells(packed, words):
    phi = em.arithmetic_phi(words, 3).persist()
    for df in (em.transform(packed, phi, 3), em.fold_in(packed, phi, 3, 3), em.regularised_theta(packed, phi, 3, 2)):
        assert exchanges(df) == 0
    assert exchanges(em.expected_by_word(packed, phi, 3)) == 1  # the tasks' sums by word


def test_an_m_step_joins_nothing(packed, words):
    """The vocabulary's words are added up with the tasks' rows; before, a join shuffled the counts a second time."""
    phi = em.arithmetic_phi(words, 3).persist()
    more = words.select((F.col("word_id") + 1000).alias("word_id")).limit(2)
    listed = words.select("word_id").where("word_id > 2").unionByName(more).persist()
    for floor in ("counts", "denominator"):
        got = em.plsa_step(packed, phi, listed, 3, floor)
        plan = str(got._jdf.queryExecution().executedPlan())
        assert "JoinExec" not in plan and "HashJoin" not in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        want = em.m_step(em.expected_by_word(packed, phi, 3), listed, 3, floor)
        assert rows(got) == rows(want) and got.count() == listed.count()


def test_documents_without_words_are_passed_over_without_a_join(tok, words, monkeypatch):
    """Before, theta was joined to the documents; a null id has zeros either way."""
    docs = bow.counted(tok, words).withColumn("doc_id", F.when(F.col("doc_id") != 11, F.col("doc_id"))).persist()
    phi = em.arithmetic_phi(words, 3).persist()
    for mode in ("expected", "projection"):
        got = em.transform(docs, phi, 3, mode, docs)
        assert "Join" not in str(got._jdf.queryExecution().executedPlan())
        by_id = {r.doc_id: tuple(r)[1:] for r in got.collect()}
        assert len(by_id) == 60 and by_id[7] == by_id[8] == by_id[None] == (0, 0, 0) and sum(by_id[9]) == pytest.approx(1)
        joined = rows(em.transform(bow.packed(docs), phi, 3, mode, docs).na.fill(-1, ["doc_id"]))
        assert rows(got.na.fill(-1, ["doc_id"])) == joined
        with monkeypatch.context() as m:
            m.setattr(em, "MATRIX_BYTES", 0)
            assert rows(em.transform(docs, phi, 3, mode, docs).na.fill(-1, ["doc_id"])) == joined


def test_a_task_hands_on_rows_of_its_own_words_and_holds_few(monkeypatch):
    monkeypatch.setattr(kernels, "CELLS", 7)
    monkeypatch.setattr(kernels, "HELD", 8 * 3 * 5)
    phi = np.full((2, 1000), 0.001)
    lists = [[1, 5, 9], [], [2, 5], [900], [5, 6, 7, 8, 9, 10, 11, 12, 13]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(lists, pa.list_(pa.int32())), pa.array([[1] * len(x) for x in lists], pa.list_(pa.int32()))], names=["doc_id", "word_ids", "counts"])
    sent = type("Sent", (), {"value": phi})
    out = list(kernels.pass_task(sent, kernels.plsa, True)(iter([batch.slice(0, 3), batch.slice(3)])))
    total = np.zeros(1000)
    for x in out[:-1]:
        assert x.num_rows <= 5 + 9  # what may be held, and a slice
        np.add.at(total, x["word_id"].to_numpy(), x["p0"].to_numpy() + x["p1"].to_numpy())
    want = np.bincount([w for x in lists for w in x], minlength=1000)
    assert np.allclose(total, want) and sum(x.num_rows for x in out[:-1]) <= 15
    assert out[-1]["word_id"].to_pylist() == [-1, -2] and out[-1]["p0"][1].as_py() == 15
    theta = pa.Table.from_batches(kernels.theta_task(sent, kernels.plsa)(iter([batch])))
    assert theta["doc_id"].to_pylist() == list(range(5)) and theta["theta"].to_pylist()[1] == [0, 0]


def test_merging_the_held_rows_stays_within_the_bound(monkeypatch):
    """Half of the rows are of words that no other slice has; before, merging took several times the bound."""
    monkeypatch.setattr(kernels, "HELD", 24 << 20)
    sums, cells, total, peak = kernels.WordSums(5), np.ones((5, 20_000)), 0, 0
    tracemalloc.start()
    try:
        for k in range(60):
            words = np.concatenate((np.arange(10_000), np.arange(10_000) + 10_000 * (k + 1))).astype(np.int32)
            total += sum(x["p4"].to_numpy().sum() for x in sums.add(words, cells))
        total += sum(x["p4"].to_numpy().sum() for x in sums.out())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total == 60 * 20_000 and peak < kernels.HELD


def test_trainers_take_packed_documents(packed, words):
    n, long = words.count(), bow.long_bow(packed)
    for make in (lambda b: PLSA(3, n, 5).fit(b, 3, b.where("doc_id < 20"), 2), lambda b: list(RegularisedModel(3, n, random_state=5).fit(b, 2).phi.ravel())):
        a, b = make(packed), make(long)
        assert all(np.allclose(a[k], b[k]) for k in a) if isinstance(a, dict) else np.allclose(a, b)
    with pytest.raises(ValueError):
        RegularisedModel(3, n - 1, random_state=5).fit(packed, 1)


def test_dense_training_against_numpy(packed, words):
    v = words.count()
    n = np.zeros((60, v))
    for r in packed.collect():
        n[r.doc_id, r.word_ids] = r.counts
    raw = [[1 + d * (t + 2) % 7 for t in range(2)] for d in range(60)]
    theta, phi = np.array(raw, float), np.random.default_rng(1).dirichlet(np.ones(v), 2)
    theta /= theta.sum(1, keepdims=True)
    model = DensePLSA(2, 2, 0.0, phi=phi, theta=row_shares([(1 + F.col("doc_id") * (t + 2) % 7).cast("double") for t in range(2)])).fit(packed, v)
    for _ in range(2):
        joint = theta[:, :, None] * phi[None]
        e = n[:, None] * joint / (joint.sum(1, keepdims=True) + 1e-8)
        phi, theta = e.sum(0) / (e.sum(0).sum(1, keepdims=True) + 1e-8), e.sum(2) / (e.sum(2).sum(1, keepdims=True) + 1e-8)
    assert np.allclose(model.phi, phi) and len(model.log_likelihoods) == 2
    got = {r.doc_id: (r.t0, r.t1) for r in model.theta.collect()}
    assert all(np.allclose(got[d], theta[d]) for d in got) and len(got) == packed.count()
    assert model.log_likelihoods[-1] == pytest.approx((n * np.log(theta @ phi + 1e-8)).sum())


def test_tokens_are_looked_up_where_they_are(tok, words):
    """No token is shuffled; equal hashes are told apart by the tokens."""
    for df in (bow.unknown_rate(tok, words), bow.encoded(tok, words), bow.counted(tok, words)):
        assert exchanges(df) == 0
    table = (np.array([4, 4, 4, 9]), np.array([0, 1, 2, 3], np.int32), pa.array(["a", "b", "c", "d"], pa.large_string()), 3)
    assert bow._looked_up(table, pa.array(["c", "x", "d", "a", "y", "b"]), np.array([4, 4, 9, 4, 10, 4])).tolist() == [2, -1, 3, 0, -1, 1]
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int32), pa.array([], pa.large_string()), 0)
    assert bow._looked_up(nothing, pa.array(["a"]), np.array([4])).tolist() == [-1]


def test_rows_that_share_an_id_are_one_document(spark):
    tok = vocab.tokenised(spark.createDataFrame([(1, "a b"), (1, "a zz"), (2, "b"), (3, None), (3, "")], "doc_id long, text string"))
    v = spark.createDataFrame([("a", 0), ("b", 1)], "token string, word_id int")
    got = {r.doc_id: (r.n_tokens, r.word_ids, r.counts) for r in bow.merged(bow.counted(tok, v)).collect()}
    assert got == {1: (4, [0, 1], [2, 1]), 2: (1, [1], [1]), 3: (0, [], [])}
    assert rows(bow.bag_of_words(tok, v)) == [(1, 0, 2), (1, 1, 1), (2, 1, 1)]
    assert bow.bag_of_words(tok, v.limit(0)).count() == 0


def test_tasks_that_sum_by_word_do_not_grow_with_the_input(packed, words, monkeypatch):
    """The words' rows that are shuffled: at most a vocabulary a task."""
    phi, split = em.arithmetic_phi(words, 3).persist(), packed.repartition(40).persist()
    split.count()
    monkeypatch.setattr(kernels, "LEAST_TASKS", 3)
    monkeypatch.setattr(kernels, "TASKS_A_CORE", 0)
    handed, v = [], words.count()
    with monkeypatch.context() as m:
        m.setattr(kernels, "added", lambda x, topics: handed.append(x.count()) or x)
        em.expected_by_word(split, phi, 3)
    with monkeypatch.context() as m:
        m.setattr(kernels, "summed", lambda x, topics, size: handed.append(x.where("word_id >= 0").count()) or (np.ones((topics, size)), 0.0, 1))
        PLSA(3, v, 5).fit_batch(split)
        RegularisedModel(3, v, random_state=5).fit(split, 1)
    assert len(handed) == 3 and max(handed) <= 3 * v
    assert rows(em.expected_by_word(split, phi, 3)) == rows(em.expected_by_word(packed, phi, 3))


def test_dense_training_writes_one_table_an_iteration(packed, words, monkeypatch):
    """A start given as a column is not written first, and two passes an iteration do."""
    from topicloom.plans import plsa

    written, passed = [], []
    cut, summed = plsa.cut, kernels.summed
    monkeypatch.setattr(plsa, "cut", lambda df, name: written.append(name) or cut(df, name))
    monkeypatch.setattr(kernels, "summed", lambda *x: passed.append(x[2]) or summed(*x))
    v = words.count()
    phi = np.random.default_rng(1).dirichlet(np.ones(v), 2)
    DensePLSA(2, 2, 0.0, phi=phi, theta=row_shares([F.lit(1.0), F.lit(2.0)])).fit(packed, v)
    assert len(written) == 2 and passed == [v, v, 0]


def test_written_documents_take_few_bytes_a_cell_with_a_large_vocabulary(spark):
    """As many bytes for ids below 4 million as for small ones; before, more than four a cell."""
    from pathlib import Path

    ids = [np.sort(np.random.default_rng(d).choice(4_000_000, 300, replace=False)).tolist() for d in range(2000)]
    batch = pa.table({"doc_id": list(range(2000)), "word_ids": pa.array(ids, pa.list_(pa.int32())), "counts": pa.array([[1] * 300] * 2000, pa.list_(pa.int32()))})
    docs = spark.createDataFrame(batch).coalesce(1)
    got = cut(docs, "packed")
    size = sum(f.stat().st_size for f in Path(got.written_to.removeprefix("file://")).glob("*.parquet"))
    assert size < 2.5 * 600_000
    assert {r.doc_id: r.word_ids for r in got.collect()} == dict(enumerate(ids))
