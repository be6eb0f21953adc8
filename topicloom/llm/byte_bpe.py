"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are split before they reach the library's regular expression, at boundaries that no match of ``SPLITTABLE`` can cross:
between a character that is not white space and white space after it. Each alternative of that pattern takes white
space only at its start or takes nothing else, and no alternative looks behind, so the pieces' matches are exactly the whole
text's. A long run of white space, on which the library's expression would exhaust its stack, is one match, but for its
last character if more text follows; it is encoded as such without the expression. With any other pattern texts go to the library
whole. Decoding returns the raw bytes.

Scale: one pass over the texts, no shuffle; the rank file (under 1 MB) goes along with the tasks, so that
executors need no such file; a task holds a few MB of text at a time, besides the longest single text.

Defined results: a null text counts as empty (no ids); special tokens are ordinary text; repeated rows are
encoded each; an empty table gives an empty table; other columns pass through, except the output names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from topicloom.llm._common import text_slices

#: Characters after which a long text is split at the next safe boundary; white space in one match that goes past the expression.
SPLIT_CHARS, RUN_CHARS = 1 << 16, 1 << 12
#: The pattern whose texts may be split, and the white space of the library's expressions (\s).
SPLITTABLE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BOUNDARY = re.compile(rf"[^{WHITE}](?=[{WHITE}])")
_ENCODERS: dict[tuple[int, str], object] = {}


def safe_pieces(text: str, size: int = SPLIT_CHARS, run: int = RUN_CHARS) -> Iterator[tuple[str, bool]]:
    """``text`` in pieces of about ``size`` characters, cut only where no match can cross, and whether a piece is one match."""
    start = 0
    for found in re.finditer(rf"[{WHITE}]{{{max(2, run)},}}+", text):
        yield from ((x, False) for x in _cut(text, start, found.start(), size))
        start = found.end() - (found.end() < len(text))
        yield text[found.start() : start], True
    yield from ((x, False) for x in _cut(text, start, len(text), size))


def _cut(text: str, start: int, stop: int, size: int) -> Iterator[str]:
    while stop - start > size and (found := _BOUNDARY.search(text, start + size - 1, stop)):
        yield text[start : found.end()]
        start = found.end()
    if start < stop:
        yield text[start:stop]


def read_ranks(path: str) -> dict[bytes, int]:
    ranks = {}
    for line in Path(path).read_bytes().splitlines():
        if line:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


def encoder(ranks: dict[bytes, int], pattern: str):
    """A tiktoken encoding without special tokens."""
    import tiktoken

    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(enc, text: str, size: int = SPLIT_CHARS, run: int = RUN_CHARS) -> np.ndarray:
    if len(text) <= size or enc._pat_str != SPLITTABLE:
        return np.array(enc.encode_ordinary(text), np.int32)
    parts = [enc._encode_single_piece(x) if one else enc.encode_ordinary(x) for x, one in safe_pieces(text, size, run)]
    return np.concatenate([np.array(x, np.int32) for x in parts])


def _encoder_of(key: tuple[int, str], ranks: dict[bytes, int]):
    if key not in _ENCODERS:
        _ENCODERS[key] = encoder(ranks, key[1])
    return _ENCODERS[key]


def _round_trip(key: tuple[int, str], sent, text_col: str, size: int, decode: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder_of(key, sent.value)
        for batch in batches:
            for part in text_slices(batch, text_col):
                ids = [encode_text(enc, x or "", size) for x in part.column(text_col).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                columns = {n: part.column(n) for n in part.schema.names if n not in ("ids", "decoded")}
                columns["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                if decode:
                    columns["decoded"] = pa.array([enc.decode_bytes(x.tolist()) for x in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", decode: bool = False, split_chars: int = SPLIT_CHARS) -> DataFrame:
    """``docs`` with ``ids`` (array of int), and ``decoded`` (the ids' raw bytes, decoded again) if asked for."""
    ranks = read_ranks(rank_file)
    key = (hash(frozenset(ranks.items())), pattern)
    fields = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")] + [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if decode:
        fields.append(T.StructField("decoded", T.BinaryType()))
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # 50,000 entries, whatever the corpus
    return docs.mapInArrow(_round_trip(key, sent, text_col, split_chars, decode), T.StructType(fields))


def _decode(key: tuple[int, str], sent, ids_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder_of(key, sent.value)
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names if n != "decoded"}
            columns["decoded"] = pa.array([enc.decode_bytes(x or []) for x in batch.column(ids_col).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def decode(encoded: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the raw bytes of its ids; null ids give no bytes."""
    ranks = read_ranks(rank_file)
    fields = [f for f in encoded.schema.fields if f.name != "decoded"] + [T.StructField("decoded", T.BinaryType())]
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)
    return encoded.mapInArrow(_decode((hash(frozenset(ranks.items())), pattern), sent, ids_col), T.StructType(fields))
