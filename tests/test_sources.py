import json

import pytest

from topicloom import cli
from topicloom.sources import corpus


def test_csv_folder_to_parquet_and_back(spark, tmp_path):
    csv, out = tmp_path / "csv", tmp_path / "parquet"
    with pytest.raises(FileNotFoundError):
        corpus.csv_folder_to_parquet(spark, str(csv), str(out))
    csv.mkdir()
    with pytest.raises(ValueError):
        corpus.csv_folder_to_parquet(spark, str(csv), str(out))
    (csv / "b.csv").write_text('n,Description\n1,"two\nlines, ""quoted"""\n2,\n', encoding="utf-8")
    (csv / "a.csv").write_text("n,Description\n3,12\n", encoding="utf-8")
    assert len(corpus.csv_folder_to_parquet(spark, str(csv), str(out))) == 2
    assert corpus.csv_folder_to_parquet(spark, str(csv), str(out)) == []
    assert len(corpus.csv_folder_to_parquet(spark, str(csv), str(out), overwrite=True)) == 2
    rows = corpus.read_corpus(spark, str(out)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in rows] == [(0, "12"), (1, 'two\nlines, "quoted"'), (2, None)]
    with pytest.raises(ValueError):
        corpus.read_corpus(spark, str(csv))


def test_vocabulary_and_history_files(spark, tmp_path):
    vocab = spark.createDataFrame([(1, "b"), (0, "a")], "word_id int, token string")
    corpus.save_vocabulary(vocab, str(tmp_path / "v.json"))
    assert json.loads((tmp_path / "v.json").read_text()) == {"a": 0, "b": 1}
    assert corpus.load_vocabulary(spark, str(tmp_path / "v.json")).count() == 2
    corpus.save_history({"train_perplexity": [2.0, 1.0], "val_perplexity": None}, str(tmp_path / "h.json"))
    rows = corpus.history_frame(spark, json.loads((tmp_path / "h.json").read_text())).collect()
    assert [(r.iteration, r.train_perplexity, r.val_perplexity) for r in rows] == [(0, 2.0, None), (1, 1.0, None)]


def test_synthetic_corpus(spark):
    a, b = ([(r.doc_id, r.word_ids) for r in corpus.synthetic_corpus(spark, 50, 80, 100, 3).collect()] for _ in range(2))
    assert a == b and 70 < sum(len(x) for _, x in a) / 50 < 90 and all(0 <= i < 100 for _, x in a for i in x)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text("Description\n" + "\n".join(f"w{i % 3} w{i % 5} common" for i in range(30)) + "\n")
    history = cli.main(["train", "--csv_dir", str(tmp_path / "csv"), "--parquet_dir", str(tmp_path / "p"), "--n_topics", "2", "--max_iter", "2", "--min_df", "1", "--val_split", "0.2", "--vocab_out", str(tmp_path / "v.json"), "--out_dir", str(tmp_path)])
    assert len(history["train_perplexity"]) == 2 and len(history["val_perplexity"]) == 2
    assert (tmp_path / "training_history_seed_42.json").exists() and "topic 1:" in capsys.readouterr().out
