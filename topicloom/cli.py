"""Command line: prepare a corpus, train a model.

``python -m topicloom.cli prepare --csv_dir D --parquet_dir P --vocab_out V.json``
``python -m topicloom.cli train --csv_dir D --parquet_dir P --n_topics 20 ...``
"""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from topicloom.functions.text import preprocessor, tokens_simple
from topicloom.operators.batches import train_val_split
from topicloom.operators.bow import bag_of_words
from topicloom.operators.vocab import build_vocabulary, tokenised
from topicloom.plans.plsa import PLSA
from topicloom.session import local_session, ship
from topicloom.sources import corpus


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("prepare", "train"):
        p = commands.add_parser(name)
        p.add_argument("--csv_dir", required=True)
        p.add_argument("--parquet_dir", required=True)
        p.add_argument("--text_column", default="Description")
        p.add_argument("--min_df", type=int, default=5)
        p.add_argument("--max_df", type=float, default=0.95)
        p.add_argument("--overwrite", action="store_true")
        p.add_argument("--clean", action="store_true", help="lower case and no punctuation before tokenising")
        p.add_argument("--vocab_out", default="vocab.json")
        if name == "train":
            p.add_argument("--n_topics", type=int, default=20)
            p.add_argument("--max_iter", type=int, default=100)
            p.add_argument("--batch_size", type=int, default=1000, help="documents that a task reads at once; results do not depend on it")
            p.add_argument("--seed", type=int, default=42)
            p.add_argument("--val_split", type=float, default=0.0)
            p.add_argument("--patience", type=int)
            p.add_argument("--min_delta", type=float, default=1.0)
            p.add_argument("--top_n", type=int, default=10)
            p.add_argument("--out_dir", default=".")
    return top


def main(args: list[str] | None = None) -> dict | None:
    a = parser().parse_args(args)
    logging.basicConfig(level=logging.INFO)
    spark = local_session()
    ship(spark)
    corpus.csv_folder_to_parquet(spark, a.csv_dir, a.parquet_dir, a.text_column, a.overwrite)
    docs = corpus.read_corpus(spark, a.parquet_dir, a.text_column)
    clean = preprocessor(use_lemmatization=False)
    tok = tokenised(docs, (lambda t: tokens_simple(clean(t))) if a.clean else tokens_simple).persist()
    vocab = build_vocabulary(tok, a.min_df, a.max_df).persist()
    corpus.save_vocabulary(vocab, a.vocab_out)
    if a.command == "prepare":
        return None
    bow = bag_of_words(tok, vocab).persist()
    train, val = train_val_split(bow, a.val_split, a.seed) if a.val_split > 0 else (bow, None)
    words = [x["token"] for x in vocab.orderBy("word_id").toLocalIterator()]
    if a.batch_size <= 0:
        raise ValueError("batch_size must be positive")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(a.batch_size))
    model = PLSA(a.n_topics, len(words), a.seed)
    history = model.fit_full(train, a.max_iter, val, a.patience, a.min_delta)
    for k, best in enumerate(model.get_top_words(words, a.top_n)):
        print(f"topic {k}: {' '.join(best)}")
    print(f"perplexity of all documents: {model.score_perplexity(bow):.4f}")
    corpus.save_history(history, str(Path(a.out_dir) / f"training_history_seed_{a.seed}.json"))
    return history


if __name__ == "__main__":
    main()
