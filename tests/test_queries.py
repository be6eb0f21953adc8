import subprocess
import sys
from pathlib import Path

import pytest

from topicloom import queries as library

DATA = "/root/testdata/sf0.001"
SOME = ["tokens_clean", "tokens_min_len", "cyrillic_clean", "vocab_ids", "encode_ids", "bow_long", "corpus_stats", "m_step", "plsa_1iter_perplexity", "top_words", "fullem_phi_topic_axis", "fold_in_3", "early_stopping_replay", "csv_roundtrip"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    return v.item() if hasattr(v, "item") else v


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the generated tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    got = library.queries()[name](spark, DATA).toPandas()
    want = duck.execute(library.oracle_sql()[name]).df()[list(got.columns)]
    rows = lambda df: sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False))
    assert rows(got) == rows(want)


def test_each_sql_has_its_query():
    assert set(library.oracle_sql()) <= set(library.queries())


def test_the_rest_works_without_the_optional_part():
    import __spark_entry__ as entry

    assert set(library.queries()) <= set(entry.queries())


def test_queries_are_listed_without_a_session():
    """The driver may ask for names and SQL before it has a session."""
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    root = str(Path(__file__).resolve().parents[1])
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=120).returncode == 0
