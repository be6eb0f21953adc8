"""The operators' queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import ann, byte_bpe, exact_dedup, html_text, line_dedup, ngram_join, packing, pii, quality, suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing may be learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels").where(~held_out()))
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = byte_bpe.encode(docs, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    return done.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, numerator=85, denominator=100)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(pii.digest_string(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.digest_string(F.col("spans")).alias("spans"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup.drop_boilerplate(docs)
    return out.select("doc_id", "lines_total", "lines_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_html_text": op2_html_text,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_ann": op4_ann,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_packing": op6_packing,
        "op7_ngram_join": op7_ngram_join,
        "op8_pii": op8_pii,
        "op9_line_dedup": op9_line_dedup,
        "op10_exact_dedup": op10_exact_dedup,
    }


_OP9 = r"""
with pages as (select row_number() over () as rid, doc_id, source, string_split(coalesce(text, ''), chr(10)) as lines, text is null as missing from documents),
totals as (select source, count(*) as host_pages from pages group by source),
counted as (
  select source, line, count(*) as pages
  from (select distinct rid, source, line from (select rid, source, unnest(lines) as line from pages)) where regexp_matches(line, '[^\x20\x09-\x0D]') group by source, line),
boiler as (
  select c.source, list(c.line) as dropped from counted c join totals t on c.source is not distinct from t.source
  where c.pages > 1 and c.pages > 0.075::double * t.host_pages group by c.source),
kept as (
  select p.doc_id, p.lines, case when b.dropped is null then p.lines else list_filter(p.lines, lambda x: not list_contains(b.dropped, x)) end as kept
  from pages p left join boiler b on p.source is not distinct from b.source)
select doc_id, len(lines)::bigint as lines_total, (len(lines) - len(kept))::bigint as lines_dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) as kept_sha256 from kept
"""

_OP10 = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from n
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_line_dedup": _OP9, "op10_exact_dedup": _OP10}
