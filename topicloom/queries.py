"""One query for each operator, over whole tables, and the same in SQL where SQL can express it.

EM queries use five topics, the arithmetic start and the vocabulary of tokens that occur 5 to int(0.95 D) times. Doubles are
rounded, since sums depend on the order of addition.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import text as X
from topicloom.operators import batches, bow, em, report, vocab
from topicloom.plans.plsa import PLSA, DensePLSA, phi_frame, row_shares
from topicloom.plans.regularised import RegularisedModel, decorrelation, smoothing
from topicloom.session import cut, shared_folder
from topicloom.sources import corpus

T, MIN_DF, MAX_DF = 5, 5, 0.95
TABLES: dict[tuple[str, str], dict[str, DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def base(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tokens, vocabulary, packed documents and bag of words of ``documents``, used by all EM queries.

    The documents are packed where they are and written once; the bag of words is that table's long form.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in TABLES:
        tok = vocab.tokenised(documents(spark, sf_dir))
        v = cut(vocab.build_vocabulary(tok, MIN_DF, MAX_DF), "vocab").persist()
        rows = cut(bow.counted(tok, v), "packed")
        docs = bow.merged(rows)
        TABLES[key] = {"tok": tok, "vocab": v, "rows": rows, "docs": docs, "packed": bow.packed(docs), "bow": bow.long_bow(docs)}
    return TABLES[key]


def start(x: dict[str, DataFrame]) -> DataFrame:
    if "phi0" not in x:
        x["phi0"] = cut(em.arithmetic_phi(x["vocab"], T), "phi").persist()
    return x["phi0"]


def after_one(x: dict[str, DataFrame]) -> DataFrame:
    if "phi1" not in x:
        x["phi1"] = cut(em.plsa_step(x["packed"], start(x), x["vocab"], T), "phi").persist()
    return x["phi1"]


def after_two(x: dict[str, DataFrame]) -> DataFrame:
    if "phi2" not in x:
        x["phi2"] = cut(em.plsa_step(x["packed"], after_one(x), x["vocab"], T), "phi").persist()
    return x["phi2"]


def long_phi(phi: DataFrame, digits: int = 9) -> DataFrame:
    return em.long_form(phi, "word_id", "p", T).withColumn("p", F.round("p", digits))


def long_theta(theta: DataFrame, digits: int = 6) -> DataFrame:
    return em.long_form(theta, "doc_id", "t", T, "p").withColumn("p", F.round("p", digits))


def _tokens(tokenizer: X.Step) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vocab.tokenised(documents(spark, sf_dir), tokenizer)
        return rows.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))

    return run


CLEAN = X.preprocessor(use_lemmatization=False)
CYRILLIC_TAIL = " Ёж_И Волк12 ЁЛКА, мир!"


def cyrillic_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(CYRILLIC_TAIL)))
    return vocab.tokenised(rows, X.cyrillic_tokenizer({"мир"})).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.split_mod(documents(spark, sf_dir)).select("doc_id", F.col("is_val").cast("int").alias("is_val"))


def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.numbered_by(documents(spark, sf_dir).withColumnRenamed("doc_id", "id"), "id")
    return batches.with_batch(rows, 128).select(F.col("id").alias("doc_id"), "batch_id")


def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = base(spark, sf_dir)
    rows = batches.with_batch(x["packed"], 128).select("batch_id", F.size("word_ids").alias("cells"), bow.kept_tokens().alias("n"))
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("docs"), F.sum("cells").alias("nnz"), F.sum("n").alias("kept_tokens"))


def doc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.numbered_by(documents(spark, sf_dir).withColumnRenamed("doc_id", "id"), "id").select("doc_id", "id")


def encode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = base(spark, sf_dir)
    return bow.encoded(x["tok"], x["vocab"]).select("doc_id", F.array_join(F.col("word_ids").cast("array<string>"), ",").alias("word_ids"))


def bow_range_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = base(spark, sf_dir)
    return bow.bag_of_ids(x["bow"].select("doc_id", F.array(F.col("word_id") - 10, F.col("word_id") - 10).alias("word_ids")), 1000)


def theta_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = base(spark, sf_dir)
    return long_theta(em.regularised_theta(x["packed"], start(x), T, 2, 0.1))


def _fullem(spark: SparkSession, sf_dir: str, norm: str | None) -> DataFrame:
    x = base(spark, sf_dir)
    counts = em.regularised_counts(x["packed"], start(x), T, 2)
    counts = counts if norm is None else cut(counts, "counts")
    return long_phi(counts, 6) if norm is None else long_phi(em.regularised_phi(counts, x["vocab"], T, norm), 8)


def _dense_start() -> Column:
    return row_shares([(1 + (F.col("doc_id") * (t + 2) + 3 * t) % 7).cast("double") for t in range(T)])


def dense_plsa_2iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = base(spark, sf_dir)
    phi = _matrix(x)
    return long_theta(DensePLSA(T, max_iter=2, tol=0.0, phi=phi, theta=_dense_start()).fit(x["packed"], phi.shape[1]).theta)


#: (patience, min_delta) of the replayed early stopping.
REPLAYS = ((5, 10.0), (5, 5.0), (5, 1.0), (3, 10.0), (3, 1.0), (1, 1.0), (0, 1.0))


def early_stopping_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up falling curve of 100 values with small bumps, through the rule as a fold over the array."""
    curve = F.expr("transform(sequence(0, 99), i -> 6000D + 90000D / (i + 10) + (i * 37) % 11 * 3)")
    rows = spark.createDataFrame([(p, d) for p, d in REPLAYS], "patience int, min_delta double").withColumn("curve", curve)
    fold = F.expr("""aggregate(transform(curve, (v, i) -> struct(v, i)), named_struct('best', double('Infinity'), 'at', -1, 'waited', 0, 'stop', -1),
        (a, x) -> if(a.stop >= 0, a, if(x.v < a.best - min_delta,
            named_struct('best', x.v, 'at', x.i, 'waited', 0, 'stop', if(0 >= patience, x.i, -1)),
            named_struct('best', a.best, 'at', a.at, 'waited', a.waited + 1, 'stop', if(a.waited + 1 >= patience, x.i, -1)))))""")
    return rows.withColumn("f", fold).select("patience", "min_delta", F.col("f.stop").alias("stops_at"), F.col("f.at").alias("best_at"), F.round("f.best", 6).alias("best"))


def _matrix(x: dict[str, DataFrame]) -> np.ndarray:
    n = x["vocab"].count()
    w, t = np.arange(n)[None], np.arange(T)[:, None]
    raw = (1 + (w * (2 * t + 3) + 5 * t) % 11).astype(float)
    return raw / raw.sum(1, keepdims=True)


def plsa_fit_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = base(spark, sf_dir)
    phi = _matrix(x)
    val = F.pmod("doc_id", F.lit(10)) == 0
    model = PLSA(T, phi.shape[1], phi=phi)
    history = corpus.history_frame(spark, model.fit_full(x["packed"].where(~val), 5, x["packed"].where(val), patience=2))
    return history.select("iteration", *(F.round(c, 3).alias(c) for c in ("train_perplexity", "val_perplexity")))


def fullem_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = base(spark, sf_dir)
    phi = _matrix(x)
    model = RegularisedModel(T, phi.shape[1], phi=phi).fit(x["packed"], 2)
    return report.top_words(phi_frame(spark, model.phi), 10, x["vocab"], 6)


#: Strengths of the regularisers in ``regularised_fit``.
SMOOTH, APART = 0.1, 0.5


def regularised_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """phi after one iteration with both Python hooks: theta smoothed in two inner steps, topics of phi pushed apart."""
    x = base(spark, sf_dir)
    phi = _matrix(x)
    model = RegularisedModel(T, phi.shape[1], decorrelation(APART), smoothing(SMOOTH), max_inner_iter=2, theta_convergence_tol=0.0, phi=phi, phi_norm="word_axis").fit(x["packed"], 1)
    return phi_frame(spark, model.phi).withColumn("p", F.round("p", 8))


def dense_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two iterations of the dense trainer from arithmetic starts, then five steps of its transform."""
    x = base(spark, sf_dir)
    model = DensePLSA(T, max_iter=2, phi=_matrix(x), theta=_dense_start()).fit(x["packed"], x["vocab"].count())
    each = model.transform(x["packed"], 5).select("doc_id", F.posexplode("theta").alias("topic", "p"))
    return each.select("topic", "doc_id", F.round("p", 6).alias("p"))


def online_fit_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = base(spark, sf_dir)
    phi = _matrix(x)
    model = PLSA(T, phi.shape[1], phi=phi)
    model.fit_online([x["packed"].where(F.pmod("doc_id", F.lit(2)) == k) for k in range(2)])
    return report.top_words(phi_frame(spark, model.phi), 10, x["vocab"], 6)


#: A small lemma table; unknown tokens stay.
LEMMAS = {"est": "être", "of": "o", "reing": "re", "the": "th", "thing": "thin"}


def _analysed(text: str) -> list[tuple[str, str]]:
    """Stands in for a language model: the lemma of a word is its first five characters."""
    return [(w, w[:5]) for w in text.split()]


def _lemma(word: str) -> str:
    return LEMMAS.get(word, word)


def tokens_by_lemma_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts after a lemma table was joined to the distinct tokens."""
    lemmas = spark.createDataFrame(list(LEMMAS.items()), "token string, lemma string")
    tokens = vocab.tokenised(documents(spark, sf_dir), X.tokens_lower).select("doc_id", F.explode("tokens").alias("token"))
    return X.lemmatized(tokens, lemmas).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def seeded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is in the seeded training and validation parts together: once."""
    parts = batches.train_val_split(documents(spark, sf_dir), 0.2, 7)
    return parts[0].unionByName(parts[1]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))


def shuffle_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positions of a seeded shuffle, joined back to documents by their ids: each is there once."""
    docs = documents(spark, sf_dir)
    placed = batches.of_ids(batches.shuffled(docs.select("doc_id"), 3, 1), docs)
    return placed.groupBy("position").agg(F.count(F.lit(1)).alias("times"))


def oov_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``documents``; rows that share an id have their sums."""
    x = base(spark, sf_dir)
    found = bow.unknown_of(x["docs"])
    return found if x["docs"] is x["rows"] else x["rows"].select("doc_id").join(found, "doc_id")


def encode_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bow.encoded_at(documents(spark, sf_dir), base(spark, sf_dir)["vocab"], [3, 17])
    return rows.select("doc_id", F.array_join(F.col("word_ids").cast("array<string>"), ",").alias("word_ids"))


def vocabulary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary through its JSON file and back."""
    with tempfile.TemporaryDirectory() as folder:
        corpus.save_vocabulary(base(spark, sf_dir)["vocab"], f"{folder}/vocab.json")
        return corpus.load_vocabulary(spark, f"{folder}/vocab.json")


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents to a CSV folder, to a Parquet folder, and back with document numbers."""
    root = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    # Files are named by partition, so a range exchange keeps the documents' order over all of them.
    rows = documents(spark, sf_dir).repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("doc_id", F.col("text").alias("Description"))
    rows.write.csv(f"{root}/csv", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    corpus.csv_folder_to_parquet(spark, f"{root}/csv", f"{root}/parquet")
    return corpus.read_corpus(spark, f"{root}/parquet").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))


def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = base(spark, sf_dir)
    joined = x["packed"].select("doc_id", bow.kept_tokens().alias("n")).join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("quality", "toxic").agg(F.countDistinct("doc_id").alias("docs"), F.sum("n").alias("kept_tokens"))


def bow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id"), F.col("event_type").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def vocab_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    return vocab.build_vocabulary(vocab.tokenised(rows, X.tokens_lower), 1, 1.0)


def tokens_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.tokens_lower(F.col("text")).alias("tokens"))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.size("tokens").cast("long")).alias("n_tokens"))


def _with_base(f: Callable[[dict[str, DataFrame]], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(base(spark, sf_dir))


def _tok(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(vocab.tokenised(documents(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    score = lambda x, phi, mode="expected": em.perplexity(x["packed"], phi, T, mode).select(F.round("perplexity", 4).alias("perplexity"))
    ntd = lambda x: em.expected_by_document(x["packed"], start(x), T)
    return {
        "tokens_simple": _tokens(X.tokens_simple),
        "tokens_lower": _tokens(X.tokens_lower),
        "tokens_clean": _tokens(lambda t: X.tokens_simple(CLEAN(t))),
        "tokens_min_len": _tokens(X.make_tokenizer(CLEAN, 3)),
        "stopwords_removed": _tokens(lambda t: X.without(X.tokens_lower(t), X.STOPWORDS_LONG)),
        "cyrillic_clean": cyrillic_clean,
        "term_frequency": _tok(vocab.term_frequency),
        "document_frequency": _tok(vocab.document_frequency),
        "vocab_ids": _with_base(lambda x: x["vocab"]),
        "vocab_min_max": _tok(lambda t: vocab.build_vocabulary(t, 3, 0.5, "document")),
        "doc_index": doc_index,
        "encode_ids": encode_ids,
        "bow_long": _with_base(lambda x: x["bow"]),
        "bow_range_mask": bow_range_mask,
        "corpus_stats": _with_base(lambda x: bow.corpus_stats(x["tok"], x["vocab"], x["bow"])),
        "oov_rate": oov_rate,
        "empty_docs": _with_base(lambda x: x["rows"].select("doc_id").join(x["packed"].select("doc_id"), "doc_id", "left_anti")),
        "train_val_split": train_val_split,
        "batch_assign": batch_assign,
        "batch_stats": batch_stats,
        "phi_init": _with_base(lambda x: long_phi(start(x))),
        "theta_projection": _with_base(lambda x: long_theta(em.transform(x["packed"], start(x), T, "projection"))),
        "e_step_ntw": _with_base(lambda x: long_phi(em.expected_by_word(x["packed"], start(x), T), 6)),
        "e_step_ntd": _with_base(lambda x: long_theta(ntd(x))),
        "m_step": _with_base(lambda x: long_phi(after_one(x))),
        "m_step_denominator": _with_base(lambda x: long_phi(em.plsa_step(x["packed"], start(x), x["vocab"], T, "denominator"))),
        "phi_frobenius": _with_base(lambda x: em.frobenius(start(x), after_one(x), T).select(F.round("diff", 9).alias("diff"))),
        "plsa_1iter_perplexity": _with_base(lambda x: score(x, after_one(x))),
        "plsa_2iter_perplexity": _with_base(lambda x: score(x, after_two(x))),
        "plsa_transform": _with_base(lambda x: long_theta(em.transform(x["docs"], after_one(x), T, docs=x["rows"]))),
        "plsa_old_transform": _with_base(lambda x: long_theta(em.transform(x["docs"], after_one(x), T, "projection", x["rows"]))),
        "top_words": _with_base(lambda x: report.top_words(em.long_form(after_one(x), "word_id", "p", T), 10, x["vocab"], 8)),
        "legacy_offline_step": _with_base(lambda x: long_phi(em.offline_step(x["packed"], start(x), x["vocab"], T, 0.1, 0.01, 0.1))),
        "positive_simplex": _with_base(lambda x: long_phi(em.positive_simplex(start(x).select("word_id", *((F.col(c) - 1e-4).alias(c) for c in em.columns("p", T))), T), 6)),
        "fullem_inner2": lambda spark, sf_dir: _fullem(spark, sf_dir, None),
        "fullem_phi_topic_axis": lambda spark, sf_dir: _fullem(spark, sf_dir, "topic_axis"),
        "fullem_phi_word_axis": lambda spark, sf_dir: _fullem(spark, sf_dir, "word_axis"),
        "theta_smoothing": theta_smoothing,
        "dense_plsa_2iter": dense_plsa_2iter,
        "fold_in_3": _with_base(lambda x: long_theta(em.fold_in(x["packed"], start(x), T, 3))),
        "early_stopping_replay": early_stopping_replay,
        "plsa_fit_full": plsa_fit_full,
        "fullem_fit": fullem_fit,
        "dense_fit": dense_fit,
        "online_fit_batch": online_fit_batch,
        "regularised_fit": regularised_fit,
        "tokens_lemma": _tokens(X.make_tokenizer(X.preprocessor(True, X.STOPWORDS, LEMMAS))),
        "tokens_lemma_callable": _tokens(lambda t: X.tokens_simple(X.preprocessor(True, None, _lemma)(t))),
        "tokens_model": _tokens(X.model_tokenizer(_analysed, ("the", "of"))),
        "tokens_by_lemma_join": tokens_by_lemma_join,
        "seeded_split": seeded_split,
        "shuffle_positions": shuffle_positions,
        "encode_point": encode_point,
        "vocabulary_file": vocabulary_file,
        "label_join": label_join,
        "csv_roundtrip": csv_roundtrip,
        "bow_events": bow_events,
        "vocab_parts": vocab_parts,
        "tokens_conversations": tokens_conversations,
    }


# SQL


def _split(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[{X.WS}]+'), lambda x: x <> '')"


_TEXT = "coalesce(text, '')"
_CLEAN = rf"regexp_replace(lower({_TEXT}), '[^\p{{L}}\p{{N}}_{X.WS}]', ' ', 'g')"


def _tokens_sql(tokens: str) -> str:
    return f"with t as (select doc_id, {tokens} as tokens from documents) select doc_id, len(tokens)::bigint as n_tokens, array_to_string(tokens, ' ') as tokens from t"


_BASE = f"""
tok as (select doc_id, unnest({_split(_TEXT)}) as token from documents),
nd as (select count(*) as n from documents),
cf as (select token, count(*) as frequency from tok group by token),
vocab as (select (row_number() over (order by token) - 1)::int as word_id, token, frequency from cf, nd where frequency between {MIN_DF} and cast(floor({MAX_DF}::double * n) as bigint)),
bow as materialized (select doc_id, word_id, count(*)::int as n from tok join vocab using (token) group by doc_id, word_id)"""

_PHI0 = f"""
raw0 as (select word_id, topic::int as topic, (1 + (word_id::bigint * (2 * topic + 3) + 5 * topic) % 11)::double as v from vocab, range({T}) as r(topic)),
phi0 as materialized (select topic, word_id, v / sum(v) over (partition by topic) as p from raw0)"""


def _theta_sql(k: int) -> str:
    return f"""
u{k} as (select doc_id, topic, sum(n * p) as u from bow join phi{k} using (word_id) group by doc_id, topic),
th{k} as materialized (select doc_id, topic, u / greatest(sum(u) over (partition by doc_id), 1e-12) as t from u{k})"""


def _cells_sql(name: str, phi: str, theta: str, guard: str) -> str:
    total = "sum(p * t) over (partition by doc_id, word_id)"
    below = {"floor": f"greatest({total}, 1e-12)", "nonzero": f"case when {total} = 0 then 1 else {total} end", "add": f"({total} + 1e-8)"}[guard]
    return f"""
{name} as materialized (select doc_id, word_id, topic, n * p * t / {below} as e from (select b.doc_id, b.word_id, b.n, f.topic, f.p, h.t from bow b join {phi} f on b.word_id = f.word_id join {theta} h on h.doc_id = b.doc_id and h.topic = f.topic))"""


def _step_sql(k: int, floor: str = "counts") -> str:
    s = "greatest(s, 1e-12)" if floor == "counts" else "s"
    total = f"sum({s}) over (partition by topic)" if floor == "counts" else "greatest(sum(s) over (partition by topic), 1e-12)"
    return f"""{_theta_sql(k)},{_cells_sql(f"c{k}", f"phi{k}", f"th{k}", "floor")},
ntw{k} as (select topic, word_id, sum(e) as s from c{k} group by topic, word_id),
grid{k} as (select r.topic::int as topic, word_id, coalesce(s, 0) as s from vocab cross join range({T}) as r(topic) left join ntw{k} using (topic, word_id)),
phi{k + 1} as materialized (select topic, word_id, {s} / {total} as p from grid{k})"""


def _score_sql(k: int, cells: str, tag: str) -> str:
    """sc_{tag}{k}: the perplexity (column v) of the bag of words ``cells`` under phi{k}."""
    x = f"_{tag}{k}"
    return f"""
su{x} as (select doc_id, topic, sum(n * p) as u from {cells} join phi{k} using (word_id) group by doc_id, topic),
st{x} as materialized (select doc_id, topic, u / greatest(sum(u) over (partition by doc_id), 1e-12) as t from su{x}),{_cells_sql(f"se{x}", f"phi{k}", f"st{x}", "floor").replace("from bow b", f"from {cells} b")},
sn{x} as (select doc_id, topic, sum(e) as s from se{x} group by doc_id, topic),
sx{x} as materialized (select doc_id, topic, s / greatest(sum(s) over (partition by doc_id), 1e-12) as t from sn{x}),
sl{x} as (select b.doc_id, b.word_id, any_value(b.n) as n, sum(f.p * h.t) as q from {cells} b join phi{k} f on b.word_id = f.word_id join sx{x} h on h.doc_id = b.doc_id and h.topic = f.topic group by b.doc_id, b.word_id),
sc{x} as materialized (select exp(-sum(n * ln(greatest(q, 1e-12))) / sum(n)) as v from sl{x})"""


def _part_sql(where: str, name: str = "bow") -> str:
    """``_BASE`` with the bag of words of some documents as ``name``."""
    return f"{_BASE.replace('bow as materialized (', 'abow as materialized (')},\n{name} as materialized (select * from abow where {where})"


def _inner_until_sql(k: int, j: int, tol: float) -> str:
    """Inner step j of iteration k: documents whose theta moved by less than ``tol`` stay as they were left."""
    a, b = f"r{k}_{j}", f"r{k}_{j + 1}"
    return f"""{_cells_sql(f"c{a}", f"q{k}", a, "nonzero")},
s{a} as (select doc_id, topic, sum(e) as s from c{a} group by doc_id, topic),
n{a} as (select doc_id, topic, s / case when sum(s) over (partition by doc_id) = 0 then 1 else sum(s) over (partition by doc_id) end as t from s{a}),
{b} as materialized (select o.doc_id, o.topic, case when o.going then n.t else o.t end as t, o.going and max(abs(n.t - o.t)) over (partition by o.doc_id) >= {tol!r}::double as going from {a} o join n{a} n using (doc_id, topic))"""


def _fullem_sql(iterations: int, inner: int, tol: float) -> str:
    parts = ["\nq0 as (select topic, word_id, p from phi0)"]
    for k in range(iterations):
        parts.append(f"\nr{k}_0 as materialized (select doc_id, topic::int as topic, 1.0::double / {T} as t, true as going from (select distinct doc_id from bow), range({T}) as r(topic))")
        parts += [_inner_until_sql(k, j, tol) for j in range(inner)]
        parts.append(_cells_sql(f"f{k}", f"q{k}", f"r{k}_{inner}", "nonzero"))
        parts.append(f"\nw{k} as (select topic, word_id, sum(e) as s from f{k} group by topic, word_id)")
        parts.append(f"\ng{k} as (select r.topic::int as topic, word_id, coalesce(s, 0) as s from vocab cross join range({T}) as r(topic) left join w{k} using (topic, word_id))")
        parts.append(f"\nq{k + 1} as materialized (select topic, word_id, s / case when sum(s) over (partition by word_id) = 0 then 1 else sum(s) over (partition by word_id) end as p from g{k})")
    return f"{_BASE},{_PHI0}," + ",".join(parts)


def _top_sql(phi: str, digits: int) -> str:
    return f"""r as (select topic, word_id, round(p, {digits}) as p from {phi}), k as (select *, row_number() over (partition by topic order by p desc, word_id desc)::int as rank from r)
select topic, rank, word_id, token, p from k join vocab using (word_id) where rank <= 10"""


def _expected_sql(k: int) -> str:
    return f"""{_theta_sql(k)},{_cells_sql(f"c{k}", f"phi{k}", f"th{k}", "floor")},
ntd{k} as (select doc_id, topic, sum(e) as s from c{k} group by doc_id, topic),
tt{k} as materialized (select doc_id, topic, s / greatest(sum(s) over (partition by doc_id), 1e-12) as t from ntd{k})"""


def _perplexity_sql(k: int) -> str:
    return f"""{_expected_sql(k)},
lik as (select b.doc_id, b.word_id, any_value(b.n) as n, sum(f.p * h.t) as q from bow b join phi{k} f on b.word_id = f.word_id join tt{k} h on h.doc_id = b.doc_id and h.topic = f.topic group by b.doc_id, b.word_id)
select round(exp(-sum(n * ln(greatest(q, 1e-12))) / sum(n)), 4) as perplexity from lik"""


def _inner_sql(k: int, smoothing: float = 0.0) -> str:
    """ith{k+1} from ith{k}."""
    return f"""{_cells_sql(f"ic{k}", "phi0", f"ith{k}", "nonzero")},
is{k} as (select doc_id, topic, sum(e) + {smoothing!r}::double as s from ic{k} group by doc_id, topic),
ith{k + 1} as materialized (select doc_id, topic, s / case when sum(s) over (partition by doc_id) = 0 then 1 else sum(s) over (partition by doc_id) end as t from is{k})"""


_UNIFORM = f"""
ith0 as materialized (select doc_id, topic::int as topic, 1.0::double / {T} as t from (select distinct doc_id from bow), range({T}) as r(topic))"""
_INNER2 = f"{_BASE},{_PHI0},{_UNIFORM},{_inner_sql(0)},{_inner_sql(1)},{_cells_sql('fc', 'phi0', 'ith2', 'nonzero')},\nfn as (select topic, word_id, sum(e) as s from fc group by topic, word_id)"
_FULL = f"{_INNER2},\nfg as (select r.topic::int as topic, word_id, coalesce(s, 0) as s from vocab cross join range({T}) as r(topic) left join fn using (topic, word_id))"


def _dense_sql(k: int) -> str:
    return f"""{_cells_sql(f"dc{k}", "phi0" if k == 0 else f"dphi{k}", f"dth{k}", "add")},
dp{k} as (select topic, word_id, sum(e) as s from dc{k} group by topic, word_id),
dphi{k + 1} as materialized (select topic, word_id, s / (sum(s) over (partition by topic) + 1e-8) as p from dp{k}),
dt{k} as (select doc_id, topic, sum(e) as s from dc{k} group by doc_id, topic),
dth{k + 1} as materialized (select doc_id, topic, s / (sum(s) over (partition by doc_id) + 1e-8) as t from dt{k})"""


def _fold_sql(k: int, phi: str = "phi0") -> str:
    return f"""{_cells_sql(f"gc{k}", phi, f"ith{k}", "add")},
gs{k} as (select doc_id, topic, sum(e) + 1e-8 as s from gc{k} group by doc_id, topic),
ith{k + 1} as materialized (select doc_id, topic, s / sum(s) over (partition by doc_id) as t from gs{k})"""


def _theta_out(source: str, all_docs: bool = False) -> str:
    if all_docs:
        return f"select r.topic::int as topic, d.doc_id, round(coalesce(t, 0), 6) as p from documents d cross join range({T}) as r(topic) left join {source} s on s.doc_id = d.doc_id and s.topic = r.topic"
    return f"select topic, doc_id, round(t, 6) as p from {source}"


def _phi_out(source: str, digits: int = 9, value: str = "p") -> str:
    return f"select topic, word_id, round({value}, {digits}) as p from {source}"


def oracle_sql() -> dict[str, str]:
    em1 = f"with {_BASE},{_PHI0},{_step_sql(0)}"
    stop = ", ".join(f"'{w}'" for w in X.STOPWORDS_LONG)
    cyrillic = f"regexp_replace(lower({_TEXT} || '{CYRILLIC_TAIL}'), '[^а-яё{X.WS}]', ' ', 'g')"
    lemma = "case x " + " ".join(f"when '{a}' then '{b}'" for a, b in LEMMAS.items()) + " else x end"
    short = ", ".join(f"'{w}'" for w in X.STOPWORDS)
    kept = f"list_transform(list_filter({_split(_CLEAN)}, lambda x: x not in ({short})), lambda x: {lemma})"
    model = f"list_filter({_split(_TEXT)}, lambda x: regexp_full_match(x, '\\p{{L}}+') and length(x) >= 2)"
    letters = f"list_filter(list_transform({model}, lambda x: lower(left(x, 5))), lambda x: x not in ('the', 'of'))"
    train = f"with {_part_sql('doc_id % 10 <> 0')},\nvbow as materialized (select * from abow where doc_id % 10 = 0),{_PHI0},"
    train += ",".join([*(_step_sql(k) for k in range(5)), *(_score_sql(k, cells, tag) for k in range(1, 6) for cells, tag in (("bow", "t"), ("vbow", "v")))])
    history = " union all ".join(f"select {k} as iteration, round(t.v, 3) as train_perplexity, round(v.v, 3) as val_perplexity from sc_t{k + 1} t, sc_v{k + 1} v" for k in range(5))
    half = lambda k: _step_sql(k).replace("from bow", f"from bow{k}")
    halves = f"{_part_sql('doc_id % 2 = 0', 'bow0')},\nbow1 as materialized (select * from abow where doc_id % 2 = 1)"
    point = "where doc_id in (3, 17)"
    replays = ", ".join(f"({p}, {d!r}::double)" for p, d in REPLAYS)
    return {
        "tokens_simple": _tokens_sql(_split(_TEXT)),
        "tokens_lower": _tokens_sql(_split(f"lower({_TEXT})")),
        "tokens_clean": _tokens_sql(_split(_CLEAN)),
        "tokens_min_len": _tokens_sql(f"list_filter({_split(_CLEAN)}, lambda x: length(x) >= 3 and not regexp_full_match(x, '[{X.DIGITS}]+'))"),
        "stopwords_removed": _tokens_sql(f"list_filter({_split(f'lower({_TEXT})')}, lambda x: x not in ({stop}))"),
        "cyrillic_clean": f"select doc_id, array_to_string(list_filter({_split(cyrillic)}, lambda x: length(x) >= 2 and x <> 'мир'), ' ') as tokens from documents",
        "term_frequency": f"with {_BASE} select token, frequency as cf from cf",
        "document_frequency": f"with {_BASE} select token, count(distinct doc_id) as df from tok group by token",
        "vocab_ids": f"with {_BASE} select word_id, token, frequency from vocab",
        "vocab_min_max": f"with {_BASE}, df as (select token, count(distinct doc_id) as frequency from tok group by token) "
        "select (row_number() over (order by token) - 1)::int as word_id, token, frequency from df, nd where frequency between 3 and cast(floor(0.5::double * n) as bigint)",
        "doc_index": "select row_number() over (order by doc_id) - 1 as doc_id, doc_id as id from documents",
        "encode_ids": f"with {_BASE}, pos as (select doc_id, generate_subscripts(l, 1) as i, unnest(l) as token from (select doc_id, {_split(_TEXT)} as l from documents)), "
        "ids as (select doc_id, string_agg(word_id::varchar, ',' order by i) as word_ids from pos join vocab using (token) group by doc_id) "
        "select doc_id, coalesce(word_ids, '') as word_ids from documents left join ids using (doc_id)",
        "bow_long": f"with {_BASE} select doc_id, word_id, n from bow",
        "bow_range_mask": f"with {_BASE} select doc_id, (word_id - 10)::int as word_id, 2::int as n from bow where word_id - 10 >= 0 and word_id - 10 < 1000",
        "corpus_stats": f"with {_BASE} select (select count(*) from documents) as n_docs, (select count(distinct doc_id) from tok) as n_nonempty, (select count(*) from tok) as n_tokens, "
        "(select count(*) from vocab) as vocab_size, (select count(*) from bow) as nnz, (select sum(n)::bigint from bow) as kept_tokens",
        "oov_rate": f"with {_BASE}, k as (select doc_id, count(*) as n_tokens, count(*) filter (where v.token is null) as n_unknown from tok left join vocab v using (token) group by doc_id) "
        "select doc_id, coalesce(n_tokens, 0) as n_tokens, coalesce(n_unknown, 0) as n_unknown from documents left join k using (doc_id)",
        "empty_docs": f"with {_BASE} select doc_id from documents where doc_id not in (select doc_id from bow)",
        "train_val_split": "select doc_id, (doc_id % 10 = 0)::int as is_val from documents",
        "batch_assign": "select doc_id, ((row_number() over (order by doc_id) - 1) // 128)::bigint as batch_id from documents",
        "batch_stats": f"with {_BASE} select (doc_id // 128)::bigint as batch_id, count(distinct doc_id) as docs, count(*) as nnz, sum(n)::bigint as kept_tokens from bow group by 1",
        "phi_init": f"with {_BASE},{_PHI0} {_phi_out('phi0')}",
        "theta_projection": f"with {_BASE},{_PHI0},{_theta_sql(0)} {_theta_out('th0')}",
        "e_step_ntw": f"{em1} {_phi_out('ntw0', 6, 's')}",
        "e_step_ntd": f"with {_BASE},{_PHI0},{_expected_sql(0)} select topic, doc_id, round(s, 6) as p from ntd0",
        "m_step": f"{em1} {_phi_out('phi1')}",
        "m_step_denominator": f"with {_BASE},{_PHI0},{_step_sql(0, 'denominator')} {_phi_out('phi1')}",
        "phi_frobenius": f"{em1} select round(sqrt(sum(pow(a.p - b.p, 2))), 9) as diff from phi0 a join phi1 b using (topic, word_id)",
        "plsa_1iter_perplexity": f"{em1},{_perplexity_sql(1)}",
        "plsa_2iter_perplexity": f"{em1},{_step_sql(1)},{_perplexity_sql(2)}",
        "plsa_transform": f"{em1},{_expected_sql(1)} {_theta_out('tt1', True)}",
        "plsa_old_transform": f"{em1},{_theta_sql(1)} {_theta_out('th1', True)}",
        "top_words": f"{em1}, r as (select topic, word_id, round(p, 8) as p from phi1), k as (select *, row_number() over (partition by topic order by p desc, word_id desc)::int as rank from r) "
        "select topic, rank, word_id, token, p from k join vocab using (word_id) where rank <= 10",
        "legacy_offline_step": f"with {_BASE},{_PHI0}, u as (select doc_id, topic, sum(n * p) + 0.1::double as u from bow join phi0 using (word_id) group by doc_id, topic), "
        "t as materialized (select doc_id, topic, u / sum(u) over (partition by doc_id) as t from u), c as (select topic, word_id, sum(n * t) as s from bow join t using (doc_id) group by topic, word_id), "
        f"g as (select r.topic::int as topic, word_id, coalesce(s, 0) + 0.01::double as s from vocab cross join range({T}) as r(topic) left join c using (topic, word_id)), "
        "m as (select topic, word_id, greatest(s - 0.1::double * avg(s) over (partition by topic), 1e-12) as s from g) "
        "select topic, word_id, round(s / sum(s) over (partition by topic), 9) as p from m",
        "positive_simplex": f"with {_BASE},{_PHI0}, x as (select topic, word_id, greatest(p - 0.0001::double, 0) as v from phi0) "
        "select topic, word_id, round(case when sum(v) over (partition by word_id) > 1e-12 then v / sum(v) over (partition by word_id) else 0 end, 6) as p from x",
        "fullem_inner2": f"with {_INNER2} {_phi_out('fn', 6, 's')}",
        "fullem_phi_topic_axis": f"with {_FULL} select topic, word_id, round(s / case when sum(s) over (partition by word_id) = 0 then 1 else sum(s) over (partition by word_id) end, 8) as p from fg",
        "fullem_phi_word_axis": f"with {_FULL} select topic, word_id, round(s / sum(s) over (partition by topic), 8) as p from fg",
        "theta_smoothing": f"with {_BASE},{_PHI0},{_UNIFORM},{_inner_sql(0, 0.1)},{_inner_sql(1, 0.1)} {_theta_out('ith2')}",
        "dense_plsa_2iter": f"with {_BASE},{_PHI0},\ndr as (select doc_id, topic::int as topic, (1 + (doc_id * (topic + 2) + 3 * topic) % 7)::double as v from (select distinct doc_id from bow), range({T}) as r(topic)),\n"
        f"dth0 as materialized (select doc_id, topic, v / sum(v) over (partition by doc_id) as t from dr),{_dense_sql(0)},{_dense_sql(1)} {_theta_out('dth2')}",
        "fold_in_3": f"with {_BASE},{_PHI0},{_UNIFORM},{_fold_sql(0)},{_fold_sql(1)},{_fold_sql(2)} {_theta_out('ith3')}",
        "early_stopping_replay": f"""with recursive rules(patience, min_delta) as (values {replays}),
curve as (select i::int as i, 6000 + 90000.0::double / (i + 10) + (i * 37) % 11 * 3 as v from range(100) as r(i)),
run as (select patience, min_delta, -1 as i, 'inf'::double as best, -1 as best_at, 0 as waited, -1 as stops_at from rules
  union all
  select r.patience, r.min_delta, c.i, case when c.v < r.best - r.min_delta then c.v else r.best end, case when c.v < r.best - r.min_delta then c.i else r.best_at end,
    case when c.v < r.best - r.min_delta then 0 else r.waited + 1 end, case when (case when c.v < r.best - r.min_delta then 0 else r.waited + 1 end) >= r.patience then c.i else -1 end
  from run r join curve c on c.i = r.i + 1 where r.stops_at < 0)
select patience::int as patience, min_delta, stops_at::int as stops_at, best_at::int as best_at, round(best, 6) as best from run
qualify row_number() over (partition by patience, min_delta order by i desc) = 1""",
        # Validation does not rise twice in five iterations, so the early stop takes no row away.
        "plsa_fit_full": f"{train} {history}",
        "online_fit_batch": f"with {halves},{_PHI0},{half(0)},{half(1)}, {_top_sql('phi2', 6)}",
        "fullem_fit": f"with {_fullem_sql(2, 20, 1e-4)}, {_top_sql('q2', 6)}",
        "dense_fit": f"with {_BASE},{_PHI0},\ndr as (select doc_id, topic::int as topic, (1 + (doc_id * (topic + 2) + 3 * topic) % 7)::double as v from (select distinct doc_id from bow), range({T}) as r(topic)),\n"
        f"dth0 as materialized (select doc_id, topic, v / sum(v) over (partition by doc_id) as t from dr),{_dense_sql(0)},{_dense_sql(1)},{_UNIFORM},{','.join(_fold_sql(k, 'dphi2') for k in range(5))} {_theta_out('ith5')}",
        "regularised_fit": f"with {_BASE},{_PHI0},{_UNIFORM},{_inner_sql(0, SMOOTH)},{_inner_sql(1, SMOOTH)},{_cells_sql('fc', 'phi0', 'ith2', 'nonzero')},\nfn as (select topic, word_id, sum(e) as s from fc group by topic, word_id),\n"
        f"x as (select f.topic, f.word_id, coalesce(s, 0) - {APART!r}::double * p * (sum(p) over (partition by f.word_id) - p) as v from phi0 f left join fn using (topic, word_id)) "
        "select topic, word_id, round(v / case when sum(v) over (partition by topic) = 0 then 1 else sum(v) over (partition by topic) end, 8) as p from x",
        "tokens_lemma": _tokens_sql(f"list_filter({kept}, lambda x: length(x) >= 2 and not regexp_full_match(x, '[{X.DIGITS}]+'))"),
        "tokens_lemma_callable": _tokens_sql(f"list_transform({_split(_CLEAN)}, lambda x: {lemma})"),
        "tokens_model": _tokens_sql(letters),
        "tokens_by_lemma_join": f"with t as (select unnest({_split(f'lower({_TEXT})')}) as x from documents) select {lemma} as token, count(*) as n from t group by 1",
        "seeded_split": "select doc_id, 1::bigint as times from documents",
        "shuffle_positions": "select row_number() over (order by doc_id) - 1 as position, 1::bigint as times from documents",
        "encode_point": f"with {_BASE}, pos as (select doc_id, generate_subscripts(l, 1) as i, unnest(l) as token from (select doc_id, {_split(_TEXT)} as l from documents {point})), "
        "ids as (select doc_id, string_agg(word_id::varchar, ',' order by i) as word_ids from pos join vocab using (token) group by doc_id) "
        f"select doc_id, coalesce(word_ids, '') as word_ids from documents left join ids using (doc_id) {point}",
        "vocabulary_file": f"with {_BASE} select token, word_id from vocab",
        "label_join": f"with {_BASE} select quality, toxic, count(distinct doc_id) as docs, sum(n)::bigint as kept_tokens from bow join labels using (doc_id) group by quality, toxic",
        "csv_roundtrip": "select row_number() over (order by doc_id) - 1 as doc_id, md5(coalesce(text, '')) as digest from documents",
        "bow_events": "select user_id as doc_id, event_type as word, count(*) as n from events group by all",
        "vocab_parts": f"with t as (select unnest({_split("lower(coalesce(p_name, ''))")}) as token from part), c as (select token, count(*) as frequency from t group by token) "
        "select (row_number() over (order by token) - 1)::int as word_id, token, frequency from c",
        "tokens_conversations": f"select conv_id, count(*) as turns, sum(len({_split(f'lower({_TEXT})')}))::bigint as n_tokens from conversations group by conv_id",
    }
