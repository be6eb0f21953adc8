import pyarrow as pa
from pyspark.sql import functions as F

from topicloom.functions import text as X


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()[0]


def test_simple_tokens_follow_unicode_white_space(spark):
    assert one(spark, X.tokens_simple, "a b c　d\x1ce  F\n") == ["a", "b", "c", "d", "e", "F"]
    assert one(spark, X.tokens_simple, None) == one(spark, X.tokens_simple, "   ") == []


def test_cleaning_steps(spark):
    assert one(spark, X.remove_punctuation, "foo_bar naïve ½ co-op!") == "foo_bar naïve ½ co op "
    assert one(spark, X.remove_extra_spaces, "  a \t b\n") == "a b"
    assert one(spark, X.lowercase, "ΟΔΟΣ A") == "οδος a"
    assert one(spark, X.preprocessor(False, {"the"}), "The CAT, the dog: the end") == "cat dog end"
    assert one(spark, X.preprocessor(False), None) == ""


def test_stop_words_keep_order_and_repetitions(spark):
    assert one(spark, X.stopwords_remover({"the"}), "the cat the dog the cat cat") == "cat dog cat cat"


def test_tokenizer_drops_short_tokens_and_digits(spark):
    f = X.make_tokenizer(X.TextPreprocessor([X.lowercase]))
    assert one(spark, f, "A bb 123 12a ²³ x1") == ["bb", "12a", "x1"]
    assert one(spark, f, None) == []


def test_lemmas_by_table_callable_and_join(spark):
    assert one(spark, X.lemmatizer({"cats": "cat"}), "cats dogs cats") == "cat dogs cat"
    assert one(spark, X.lemmatizer({}), "cats  dogs") == "cats dogs"
    assert one(spark, X.lemmatizer(lambda t: t.rstrip("s")), "cats dogs") == "cat dog"
    rows = spark.createDataFrame([(1, "cats"), (2, "x")], "doc_id long, token string")
    table = spark.createDataFrame([("cats", "cat")], "token string, lemma string")
    assert {(r.doc_id, r.token) for r in X.lemmatized(rows, table).collect()} == {(1, "cat"), (2, "x")}


def test_cyrillic(spark):
    f = X.cyrillic_tokenizer({"мир"}, lemma={"ёлки": "ёлка"})
    assert one(spark, f, "Ёлки и Мир, abc 12 ВОЛК_волк!") == ["ёлка", "волк", "волк"]
    assert one(spark, f, None) == []


def test_model_and_python_tokenizers(spark):
    f = X.model_tokenizer(lambda t: [(w, w.rstrip("s").upper()) for w in t.split()], {"dog"})
    assert one(spark, f, "Cats dogs a1 x") == ["cat"]
    assert one(spark, X.python_tokenizer(str.split), "a b") == ["a", "b"]
    assert one(spark, X.python_tokenizer(str.split), None) == []


def test_stop_word_lists():
    assert len(X.STOPWORDS) == 14 and len(X.STOPWORDS_LONG) == 34


def test_python_tokens_of_few_texts_live_at_a_time():
    """A batch's tokens are not all Python objects at once."""
    alive = most = 0

    class Token(str):
        def __del__(self):
            nonlocal alive
            alive -= 1

    def one(text):
        nonlocal alive, most
        alive += 3
        most = max(most, alive)
        return [Token(f"{text}{k}") for k in range(3)]

    got = X.token_lists(pa.array([str(k) for k in range(1000)]), one)
    assert got.to_pylist()[999] == ["9990", "9991", "9992"] and len(got) == 1000 and most <= 100
    assert X.token_lists(pa.array([], pa.string()), one).to_pylist() == []
