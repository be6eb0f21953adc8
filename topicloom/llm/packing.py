"""Packing by patterns: non-negative least squares over few-document length patterns.

Texts become ids, longer ones are cut into full sequences and a rest. A pattern is a set of at most
``DEPTH`` lengths that together fill a sequence exactly. How often each pattern should repeat is fitted to the
histogram of lengths by non-negative least squares; the counts are rounded, never beyond the pieces there
are, and what is left goes best fit, longest first, into the fullest sequence with room. All this happens on
the histogram, at most 2048 numbers for any corpus; pieces then find their places by their rank among the
pieces of their length.

Scale: texts are read once, the pieces (lengths and checksums, no text) are written; ranks are counted by
(length, salt), so that a length that a third of all pieces share spreads over all partitions. The plan
sent to the tasks is bounded by the number of patterns, not by the corpus.

Defined results: a null text counts as empty and gives one piece, the end id alone; repeated rows are packed
each; null ids stay null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm._common import broadcast_if_small, text_slices, width, written

#: Tokens of a sequence, documents of a pattern, steps of the least-squares fit.
SEQUENCE, DEPTH, STEPS = 2048, 3, 120
#: Words that a task remembers (two generations of this many).
MEMO = 250_000


class _Memo(dict):
    """Encoded strings by string; the older generation goes when the younger is full."""

    def __init__(self, encode: Callable[[str], bytes], size: int = MEMO) -> None:
        super().__init__()
        self.encode, self.size, self.old = encode, size, {}

    def __missing__(self, key: str) -> bytes:
        if (value := self.old.get(key)) is None:
            value = self.encode(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _byte_symbols() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from 256 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    others = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(others)}


#: The steps before the merges that this encoder takes word by word, as tokenizer files name them.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """The ids of whole texts by a tokenizer that never looks across a space.

    Its steps must be ``NORMALIZERS``, a split into ``PIECES`` and byte symbols; other files are refused. A text's ids then are its
    words' ids in order, and each distinct word needs the tokenizers library once.
    """

    def __init__(self, path_or_json: str, is_json: bool = False) -> None:
        import regex
        from tokenizers import Tokenizer

        if not is_json:
            with open(path_or_json, encoding="utf-8") as f:
                path_or_json = f.read()
        made = json.loads(path_or_json)
        split, symbols = ((made["pre_tokenizer"] or {}).get("pretokenizers") or [{}, {}])[:2]
        if (made["normalizer"] or {}).get("normalizers") != NORMALIZERS or split.get("pattern") != {"Regex": PIECES} or symbols.get("type") != "ByteLevel" or made["model"]["type"] != "BPE":
            raise ValueError("a tokenizer with other normalizers or another split than this encoder's")
        self.tokenizer = Tokenizer.from_str(path_or_json)
        self.tokenize = self.tokenizer.model.tokenize
        self.symbols = _byte_symbols()
        self.split = regex.compile(PIECES).findall
        self.pieces = _Memo(self._piece, MEMO // 2)
        self.words = _Memo(self._word)

    def _piece(self, piece: str) -> bytes:
        symbols = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(self.symbols)
        return array("I", [x.id for x in self.tokenize(symbols)]).tobytes()

    def _word(self, word: str) -> bytes:
        # Printable Latin-1 is its own normal form but for case; the rest goes through the whole tokenizer.
        if word and (word.isascii() or max(word) <= "\xff"):
            if word.isalpha():
                return self._piece(word.lower())
            if word.isprintable() and "<|" not in word:
                return b"".join(map(self.pieces.__getitem__, self.split(word.lower())))
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        ids = b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
        return ids if sys.byteorder == "little" else np.frombuffer(ids, ">u4").astype("<u4").tobytes()


_ENCODERS: dict[int, WordEncoder] = {}


def _cut(sent, id_col: str, text_col: str, end_id: int, sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if (key := hash(sent.value)) not in _ENCODERS:
            _ENCODERS[key] = WordEncoder(sent.value, is_json=True)
        encoder, end = _ENCODERS[key], np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in text_slices(batch, text_col):
                rows: list[list] = [[], [], [], [], []]
                for doc, text in zip(part.column(id_col).to_pylist(), part.column(text_col).to_pylist(), strict=True):
                    ids = memoryview(encoder.encode(text or "") + end)
                    for k, at in enumerate(range(0, len(ids), 4 * sequence)):
                        piece = ids[at : at + 4 * sequence]
                        for column, x in zip(rows, (doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                            column.append(x)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def tokenised_pieces(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut at ``sequence`` tokens."""
    with open(tokenizer_file, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary: 2 MB, whatever the corpus
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_cut(sent, "doc_id", "text", end_id, sequence), "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(lengths: np.ndarray, sequence: int = SEQUENCE, depth: int = DEPTH) -> np.ndarray:
    """All multisets of at most ``depth`` (1 to 3) of ``lengths`` that sum to ``sequence``: rows padded with 0, longest first."""
    there = np.zeros(sequence + 1, bool)
    there[lengths[(lengths > 0) & (lengths <= sequence)]] = True
    out = [np.array([[sequence, 0, 0]])] if there[sequence] else []
    own = np.flatnonzero(there[:sequence])
    if depth >= 2:
        two = own[(own >= sequence - own) & there[sequence - own]]
        out.append(np.stack([two, sequence - two, 0 * two], 1))
    if depth >= 3:
        for a in own:
            b = own[(own <= a) & (2 * own >= sequence - a) & (own < sequence - a)]
            b = b[there[sequence - a - b]]
            out.append(np.stack([np.full(len(b), a), b, sequence - a - b], 1))
    return np.concatenate(out) if out else np.empty((0, 3), int)


def fit_counts(patterns_: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths near the histogram, in least squares.

    Accelerated projected gradient; rows are scaled by length, so that tokens count rather than pieces.
    """
    size, n = len(histogram), len(patterns_)
    if not n:
        return np.zeros(0)
    weight = np.sqrt(np.arange(size) / size)
    flat = patterns_.ravel()

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, patterns_.shape[1]), size) * weight

    def backward(r: np.ndarray) -> np.ndarray:
        return (r * weight)[patterns_].sum(1)

    v = np.ones(n)
    for _ in range(20):
        v = backward(forward(v))
        v /= (norm := np.linalg.norm(v)) or 1.0
    step, target = 1 / (1.05 * norm), histogram * weight
    x = z = np.zeros(n)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, z - step * backward(forward(z) - target))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: np.ndarray, depth: int = DEPTH, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with their repeat counts that hold each piece of the histogram (index: length) exactly once."""
    sequence = len(histogram) - 1
    left, out = histogram.astype(np.int64).copy(), []
    if left[sequence]:
        out.append(((sequence,), int(left[sequence])))
        left[sequence] = 0
    found = patterns(np.flatnonzero(left), sequence, depth)
    counts = fit_counts(found, left.astype(float), steps)
    for k in np.argsort(-counts, kind="stable"):
        if (want := int(round(counts[k]))) < 1:
            break
        pattern = tuple(int(x) for x in found[k] if x)
        need = defaultdict(int)
        for x in pattern:
            need[x] += 1
        repeat = min([want, *(int(left[x]) // m for x, m in need.items())])
        if repeat > 0:
            out.append((pattern, repeat))
            for x, m in need.items():
                left[x] -= repeat * m
    return out + best_fit(left)


def best_fit(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: sequences of one content move together."""
    sequence = len(histogram) - 1
    room: dict[int, list[list]] = defaultdict(list)
    for x in range(sequence, 0, -1):
        count = int(histogram[x])
        while count:
            best = next((r for r in range(x, sequence) if room.get(r)), None)
            if best is None:
                per = sequence // x
                for each, bins in ((per, count // per), (count % per, 1 if count % per else 0)):
                    if bins:
                        room[sequence - each * x].append([(x,) * each, bins])
                break
            content, bins = room[best].pop()
            used = min(bins, count)
            if bins > used:
                room[best].append([content, bins - used])
            room[best - x].append([(*content, x), used])
            count -= used
    return [(tuple(c), n) for groups in room.values() for c, n in groups]


def places(plan_: list[tuple[tuple[int, ...], int]], sequence: int = SEQUENCE) -> list[np.ndarray]:
    """For each length: rows (first rank, first sequence, offset), by rank."""
    taken, rows, base = np.zeros(sequence + 1, np.int64), [[] for _ in range(sequence + 1)], 0
    for pattern, repeat in plan_:
        offset = 0
        for x in pattern:
            rows[x].append((taken[x], base, offset))
            taken[x] += repeat
            offset += x
        base += repeat
    return [np.array(r, np.int64).reshape(-1, 3) for r in rows]


def _place(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sent.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = np.zeros((len(length), 3), np.int64)
            for x in np.unique(length):
                own = length == x
                row[own] = at[x][np.searchsorted(at[x][:, 0], rank[own], "right") - 1]
            keep = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(row[:, 1] + rank - row[:, 0]), pa.array(row[:, 2])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, sequence: int = SEQUENCE, depth: int = DEPTH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = written(tokenised_pieces(docs, tokenizer_file, id_col, text_col, end_id, sequence), "pieces")
    salts = width(spark)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(sequence + 1, np.int64)
    for x, n in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `sequence` rows
        histogram[x] = n
    sent = spark.sparkContext.broadcast(places(plan(histogram, depth), sequence))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    before = broadcast_if_small(counts.select("length", "salt", before.alias("before")), 24, 8 << 20)
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, F.col("rank").cast("long").alias("rank")).mapInArrow(_place(sent), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
