import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    rows, labels = [], []
    for i in range(240):
        junk = i % 4 == 3
        text = prose(int(rng.integers(30, 150)))
        if junk:
            text = " ".join(w.upper() + "!!" for w in text.split())
        else:
            text = f"{text}\nall rights reserved\n{prose(20)} mail{i}@host.example.com {prose(5)}"
        rows.append((i, text))
        labels.append((i, int(not junk), 0))
    rows += [(500, rows[0][1]), (501, rows[1][1] + " end"), (502, None), (503, "")]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, corpus):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, corpus).cache()
        assert docs.columns == pipeline.COLUMNS
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not any(i % 4 == 3 for i in kept["quality"] if i < 240) and sum(i % 4 != 3 and i < 240 for i in kept["quality"]) > 170
    assert kept["lines"].keys() == kept["quality"].keys() and not any("reserved" in (t or "") for t in kept["lines"].values())
    assert not {500, 501} & kept["near_duplicates"].keys() and {0, 1} <= kept["near_duplicates"].keys()
    assert kept["personal_data"].keys() == kept["near_duplicates"].keys() and "<EMAIL>" in kept["personal_data"][0] and not any("@" in (t or "") for t in kept["personal_data"].values())
    pieces = pipeline.run(spark, corpus).collect()
    assert {r.doc_id for r in pieces} == kept["personal_data"].keys()


def test_stages_on_odd_rows(spark, odd, none, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns and empty tables, for each stage on its own."""
    import corpus_pipeline as pipeline

    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = odd.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    empty = none.withColumn("lang", F.lit("en")).withColumn("n_chars", F.lit(0).cast("long"))
    # Near duplicates: one of 1, 2 and the null id, one of 6, 7 and the longer 9, the four without words, 8 and the other 9.
    left = {"quality": 12, "lines": 12, "near_duplicates": 8, "personal_data": 12}
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, rows, str(tmp_path))
        assert got.columns == pipeline.COLUMNS and got.count() == left[name], name
        assert stage(spark, empty, str(tmp_path)).count() == 0
    stage = pipeline.STAGES[-1][1]
    pieces = stage(spark, rows, str(tmp_path)).groupBy("doc_id", "piece", "start").count().collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in rows.collect()} and stage(spark, empty, str(tmp_path)).count() == 0


def test_repeated_rows_and_ids_keep_one_of_each(spark):
    import corpus_pipeline as pipeline

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text + " x"), (3, "other words that are near nothing else"), (None, text), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in pipeline.near_duplicates_stage(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, text), (3, rows[3][1]), (None, None), (None, None)], key=str)


def test_every_query_gives_the_contract_columns(spark, corpus):
    """Each registered query on the fixture, digests against what plain Python makes of the same texts."""
    import tiktoken
    from test_dedup import repeats
    from test_llm_text import plain_spans

    import public_tokenizers
    from topicloom.llm import byte_bpe, queries

    assert {f"op{n}_" for n in range(1, 11)} == {name[: name.index("_") + 1] for name in queries.queries()}
    assert set(queries.oracle_sql()) <= set(queries.queries())
    sha = lambda x: hashlib.sha256(x).hexdigest()
    run = lambda name: queries.queries()[name](spark, corpus).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()}
    scored = run("op1_quality")
    assert {(r.doc_id, r.held_out) for r in scored} == {(i, zlib.crc32(str(i).encode()) % 3 == 1) for i in texts}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in run("op3_byte_bpe"):
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(texts[r.doc_id].encode()))
    want = dict(zip(texts, repeats(list(texts.values())), strict=True))
    for r in run("op5_suffix_dedup"):
        spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(texts[r.doc_id].encode()), sum(b - a for a, b in spans), len(spans), sha(kept))
    for r in run("op8_pii"):
        plain = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == sha(plain.encode()) and set(filter(None, plain.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [plain.count(k + ":") for k in ("email", "ip", "card", "phone")]
    assert {r.doc_id for r in run("op6_packing")} == {r.doc_id for r in run("op7_ngram_join")} == {r.doc_id for r in run("op9_line_dedup")} == {r.doc_id for r in run("op10_exact_dedup")} == set(texts)
