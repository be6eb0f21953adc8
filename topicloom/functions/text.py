"""Text functions as Column expressions; Python callables run as Arrow UDFs.

A tokenizer is a function Column -> Column (array of string); a preprocessing step is a function Column -> Column
(string). Null texts have no tokens.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Step = Callable[[Column], Column]

#: Unicode white space as code point ranges, for use inside brackets.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Decimal digits, and superscript, subscript, Ethiopic, circled and other ones with a digit value.
DIGITS = r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{1369}-\x{1371}\x{19da}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
#: Short and long list of English stop words.
STOPWORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")
STOPWORDS_LONG = (*STOPWORDS, "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def tokens_simple(text: Column) -> Column:
    """Maximal runs without white space; case is kept."""
    return F.filter(F.split(text_or_empty(text), f"[{WS}]+"), lambda x: x != "")


def tokens_lower(text: Column) -> Column:
    return tokens_simple(F.lower(text_or_empty(text)))


def lowercase(text: Column) -> Column:
    return F.lower(text)


def remove_punctuation(text: Column) -> Column:
    """Each character that is no letter, number, underscore or white space becomes a space."""
    return F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}_{WS}]", " ")


def remove_extra_spaces(text: Column) -> Column:
    return F.array_join(tokens_simple(text), " ")


def without(tokens: Column, stopwords: Iterable[str]) -> Column:
    """``tokens`` that are no stop words; order and repetitions stay."""
    words = sorted(set(stopwords))
    return F.filter(tokens, lambda x: ~x.isin(words)) if words else tokens


def stopwords_remover(stopwords: Iterable[str]) -> Step:
    return lambda text: F.array_join(without(tokens_simple(text), stopwords), " ")


_LEMMAS: dict[int, tuple[Callable[[str], str], Callable[[str], str]]] = {}


def _cached(lemma: Callable[[str], str]) -> Callable[[str], str]:
    """``lemma`` with a cache that lives as long as the worker has this function."""
    if (known := _LEMMAS.get(id(lemma))) is None or known[0] is not lemma:
        known = _LEMMAS[id(lemma)] = (lemma, functools.lru_cache(200_000)(lemma))
    return known[1]


def lemmatizer(lemma: Callable[[str], str] | dict[str, str]) -> Step:
    """A step that maps each token: by a table (unknown tokens stay), or by a Python callable in an Arrow UDF."""
    if isinstance(lemma, dict):

        def by_table(text: Column) -> Column:
            if not lemma:
                return F.array_join(tokens_simple(text), " ")
            table = F.create_map(*(F.lit(x) for pair in sorted(lemma.items()) for x in pair))
            return F.array_join(F.transform(tokens_simple(text), lambda x: F.coalesce(F.try_element_at(table, x), x)), " ")

        return by_table

    @F.pandas_udf(T.StringType())
    def each(texts: pd.Series) -> pd.Series:
        known = _cached(lemma)
        return texts.map(lambda t: " ".join(map(known, t.split())) if t is not None else None)

    return lambda text: each(text)


def lemmatized(tokens: DataFrame, lemmas: DataFrame, token_col: str = "token") -> DataFrame:
    """Rows (…, token) with tokens replaced by a lemma table (token, lemma), by join: each distinct token is looked up, not each text."""
    table = lemmas.select(F.col("token").alias("__t"), F.col("lemma").alias("__l"))
    return tokens.join(table, F.col(token_col) == F.col("__t"), "left").withColumn(token_col, F.coalesce("__l", token_col)).drop("__t", "__l")


class TextPreprocessor:
    """Steps applied from the left."""

    def __init__(self, steps: Iterable[Step]) -> None:
        self.steps = list(steps)

    def __call__(self, text: Column) -> Column:
        return functools.reduce(lambda x, step: step(x), self.steps, text_or_empty(text))


def preprocessor(use_lemmatization: bool = True, stopwords: Iterable[str] | None = None, lemma: Callable[[str], str] | dict[str, str] | None = None) -> TextPreprocessor:
    """Lower case, no punctuation, single spaces, then stop words and lemmas as asked for."""
    steps: list[Step] = [lowercase, remove_punctuation, remove_extra_spaces]
    if stopwords:
        steps.append(stopwords_remover(stopwords))
    if use_lemmatization and lemma is not None:
        steps.append(lemmatizer(lemma))
    return TextPreprocessor(steps)


def long_enough(tokens: Column, min_token_length: int = 2) -> Column:
    """Tokens of at least that many characters that are not all digits."""
    return F.filter(tokens, lambda x: (F.char_length(x) >= min_token_length) & ~F.rlike(x, F.lit(f"^[{DIGITS}]+$")))


def make_tokenizer(preprocess: Step, min_token_length: int = 2) -> Step:
    return lambda text: long_enough(tokens_simple(preprocess(text_or_empty(text))), min_token_length)


def cyrillic_text(text: Column) -> Column:
    """Lower case, Russian letters only, single spaces."""
    return remove_extra_spaces(F.regexp_replace(F.lower(text_or_empty(text)), f"[^а-яё{WS}]", " "))


def cyrillic_tokenizer(stopwords: Iterable[str] | None = None, min_token_length: int = 2, lemma: dict[str, str] | Callable[[str], str] | None = None) -> Step:
    """Russian tokens: length and script are tested on the surface form, stop words on the lemma."""

    def tokenize(text: Column) -> Column:
        tokens = F.filter(tokens_simple(cyrillic_text(text)), lambda x: (F.char_length(x) >= min_token_length) & F.rlike(x, F.lit("^[а-яё]+$")))
        if lemma is not None:
            tokens = tokens_simple(lemmatizer(lemma)(F.array_join(tokens, " ")))
        return without(tokens, stopwords or ())

    return tokenize


def token_lists(texts: pa.Array, one: Callable[[str | None], Iterable[str]]) -> pa.Array:
    """``one`` of each text; a few texts' tokens are Python objects at a time, whatever the size of the batch."""
    kind, few = pa.list_(pa.string()), 16
    parts = [pa.array([list(one(t.as_py())) for t in texts.slice(a, few)], kind) for a in range(0, len(texts), few)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def model_tokenizer(analyse: Callable[[str], Iterable[tuple[str, str]]], stopwords: Iterable[str] | None = None, min_token_length: int = 2) -> Step:
    """Tokens of a language model: ``analyse`` gives (surface, lemma) pairs; runs in an Arrow UDF.

    Surfaces must be alphabetic and long enough; lemmas are lower-cased and must be no stop words.
    """
    stop = frozenset(stopwords or ())

    def one(text: str | None) -> list[str]:
        pairs = analyse(text) if text else ()
        lemmas = (lemma.lower() for surface, lemma in pairs if surface.isalpha() and len(surface) >= min_token_length)
        return [x for x in lemmas if x not in stop]

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def tokenize(texts: pa.Array) -> pa.Array:
        return token_lists(texts, one)

    return lambda text: tokenize(text)


def python_tokenizer(tokenize: Callable[[str], list[str]]) -> Step:
    """Any Python tokenizer, as an Arrow UDF."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(texts: pa.Array) -> pa.Array:
        return token_lists(texts, lambda t: tokenize(t) if t is not None else [])

    return lambda text: run(text)
