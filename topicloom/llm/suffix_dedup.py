"""Removal of repeated passages by suffix arrays: external induced sorting of shards.

Each byte covered by a string of ``WINDOW`` bytes that also starts elsewhere is removed, in one document or two.

Shards. Windows are grouped by their least hash of ``GRAM`` adjacent bytes: equal windows have equal least hashes, and that gram
at the same place. Neighbouring windows with the same least gram travel as one string; it is halved into the windows with
at least ``CONTEXT`` bytes before the gram and those with more than that after it, so that all windows of a half hold the gram
with the ``CONTEXT`` bytes before or after it. Halves are dealt to shards by a hash of these bytes, which equal windows
share. Before any text moves, halves are counted by that key, only to leave out those that no other string can meet; a
string that holds its least gram twice keeps all strings of its hash whole, in one shard.

Sorting. A shard joins its strings and sorts all their suffixes by external induced sorting (``induced_sort``): queues of
(character, place, common prefix) on disk, recursion on the names of LMS substrings. Adjacent suffixes with a common
prefix of WINDOW bytes are repeated windows. Documents that equal another as a whole, and strings that equal another (by
a digest of 16 bytes), are repeats all over: they are read once, and their strings are sorted only where others share
their bytes around the gram. Strings, their heads, the text and all orders lie on disk beyond a few MB, so memory is
bounded by the queues' limit, not by the shard; the disk of a task holds some hundred bytes a byte of it.

Scale: texts are read four times, and shuffled once, to meet the places whose strings the shards need, and once more
to meet their spans, unless the written table of spans is small (checked). Before that about 60 bytes for each 90
bytes of text are shuffled. Joins on counts take keys with a large share of all rows by broadcast; there are at most four times as
many of these as partitions. A shard is one task: strings that share a passage of ``GRAM + CONTEXT`` bytes and differ around it are
sorted together, on disk.

Defined results: a null text counts as empty; equal documents are whole repeats of each other (if they have
WINDOW bytes); repeated rows are equal documents; shorter texts stay; null ids stay null; an empty table
gives an empty table; cuts are by bytes, so the kept bytes need not be valid UTF-8; other columns pass through, except
``spans`` and ``kept``, which give way to the results.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm._common import join_hot, text_slices, width, written
from topicloom.llm.induced_sort import array, eight_bytes, pieces, sort_bytes

#: Bytes of a repeated string, of a hashed gram; windows of a string at most; bytes of a shard; items of a sorter in memory; names
#: that are sorted in memory (a longer string of names is sorted recursively).
WINDOW, GRAM, MOST, SHARD_BYTES, QUEUED, BASE = 200, 16, 4096, 4 << 20, 1_000_000, 2_000_000
#: Bytes before or after the gram that each half of a string shares.
CONTEXT = (WINDOW - GRAM) // 2
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def text_key(text: Column) -> Column:
    """16 bytes of the text's SHA-256."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    words = eight_bytes(data)
    h = (words[: len(data) - GRAM + 1] * _A) ^ (words[8 : len(data) - GRAM + 9] * _B)
    h ^= h >> np.uint64(29)
    h *= _A
    h ^= h >> np.uint64(32)
    return h


def _sliding(x: np.ndarray, size: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of each run of ``size``."""
    have = 1
    while have * 2 <= size:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (size - have)], x[size - have :]) if size > have else x


def strings_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, hash, whether the gram is there twice, number of windows with at least ``CONTEXT``
    bytes before the gram, hash of the bytes that these share, hash of those that the others share) of the strings of
    documents that lie one after the other in ``data``; ``ends`` are the documents' ends."""
    none = np.empty(0, np.int64)
    nothing = none, none, none.astype(np.uint64), none.astype(bool), none, none.astype(np.int32), none.astype(np.int32)
    if len(data) < WINDOW:
        return nothing
    grams, per = _gram_hashes(data), WINDOW - GRAM + 1
    low = _sliding(grams, per, np.minimum)
    valid = np.ones(len(low), bool)
    starts = np.r_[0, ends[:-1]]
    for lo, hi in zip(np.maximum(starts, ends - WINDOW + 1).tolist(), ends.tolist(), strict=True):
        valid[lo:hi] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return nothing
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (low[at[1:]] != low[at[:-1]])]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(at)])
    pieces = -(-size // MOST)
    begin = np.repeat(at[first], pieces) + MOST * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    count = np.minimum(MOST, np.repeat(at[first] + size, pieces) - begin)
    # A gram is the least of some window if it equals the largest of the least hashes of all windows around it.
    around = np.r_[np.zeros(per - 1, np.uint64), low, np.zeros(per - 1, np.uint64)]
    hits = np.flatnonzero(grams == _sliding(around, per, np.maximum))
    h = low[begin]
    lo, hi = np.searchsorted(hits, begin), np.searchsorted(hits, begin + count + per - 1)
    each = hi - lo
    owner = np.repeat(np.arange(len(begin)), each)
    hit = hits[np.repeat(lo - np.cumsum(each) + each, each) + np.arange(each.sum())]
    own = grams[hit] == h[owner]
    twice = np.bincount(owner, own, len(begin)) > 1
    gram = np.bincount(owner, hit * own, len(begin)).astype(np.int64)  # its place, where it is there once
    gram[twice] = begin[twice]
    left = np.clip(gram - begin - CONTEXT + 1, 0, count)
    del grams, low, around, hits, hit, own, owner
    before, after = _contexts(data, np.maximum(gram - CONTEXT, 0), np.minimum(gram, len(data) - GRAM - CONTEXT))
    return begin, count, h, twice, left, np.where(left > 0, before, 0), np.where(left < count, after, 0)


def _contexts(data: np.ndarray, *places: np.ndarray) -> Iterator[np.ndarray]:
    """32-bit hashes of the ``GRAM + CONTEXT`` bytes from each place on; equal bytes have equal hashes."""
    total, back = np.full(len(data) + 1, _A), np.full(len(data) + 1, np.uint64(pow(int(_A), -1, 1 << 64)))
    total[0] = back[0] = 1
    np.cumprod(total, out=total)
    np.cumprod(back, out=back)
    total[:-1] *= data
    np.cumsum(total, out=total)
    for at in places:
        first = np.where(at > 0, total[at - 1], np.uint64(0))
        h = (total[at + GRAM + CONTEXT - 1] - first) * back[at]
        h ^= h >> np.uint64(29)
        yield ((h * _B) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its rows' ends in them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


_PLACES = "h long, g binary, key binary, start int, n int, twice boolean, left int, before int, after int"
_PLACE_NAMES = [x.split(" ")[0] for x in _PLACES.split(", ")]


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of each text, once a task for equal texts."""
    seen: set[bytes] = set()
    for batch in batches:
        for part in text_slices(batch, "text", 1 << 20):
            keys = part.column("key").to_pylist()
            fresh = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
            if not fresh:
                continue
            if len(fresh) < part.num_rows:
                part, keys = part.take(pa.array(fresh)), [keys[i] for i in fresh]
            data, ends = _buffers(part.column("text"))
            begin, count, h, twice, *rest = strings_of(data, ends)
            doc = np.searchsorted(ends, begin, "right")
            view = memoryview(np.ascontiguousarray(data))
            g = [hashlib.blake2b(view[b : b + c + WINDOW - 1], digest_size=16).digest() for b, c in zip(begin.tolist(), count.tolist(), strict=True)]
            start = begin - np.r_[0, ends][doc]
            key = pa.array(keys, pa.binary()).take(pa.array(doc))
            numbers = [pa.array(x.astype(np.int32)) for x in (start, count)]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g, pa.binary()), key, *numbers, pa.array(twice), *(pa.array(x.astype(np.int32)) for x in rest)], names=_PLACE_NAMES)


_SEVERAL = _PLACES + ", whole boolean, first boolean, many boolean"


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, twice first, g, key, start): each once, of hashes with several rows or twice in one.

    ``whole``: a string of the hash holds the gram twice; ``first`` marks the first row of a (h, g), ``many`` that it has others.
    """
    before: dict | None = None  # the last row so far
    waiting: pa.Table | None = None  # the last different row, until the next one is known
    met = False  # whether its hash was there before it

    def raw(column: pa.Array) -> np.ndarray:
        data, ends = _buffers(column)
        return np.ascontiguousarray(data).view(np.dtype((np.void, 16)))

    def out(rows: pa.Table, keep: np.ndarray, many: np.ndarray) -> list[pa.RecordBatch]:
        return rows.append_column("many", pa.array(many)).filter(pa.array(keep)).combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        h, start, twice = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "start", "twice"))
        g, key = raw(batch.column("g")), raw(batch.column("key"))
        same_h = np.r_[before is not None and before["h"] == h[0], h[1:] == h[:-1]]
        same_g = same_h & np.r_[before is not None and before["g"] == g[0].tobytes(), g[1:] == g[:-1]]
        again = same_g & np.r_[before is not None and before["key"] == key[0].tobytes() and before["start"] == start[0], (key[1:] == key[:-1]) & (start[1:] == start[:-1])]
        head = np.maximum.accumulate(np.where(same_h, 0, np.arange(len(h))))
        whole = twice[head]
        if same_h[0]:
            whole[: len(h) if same_h.all() else int(np.argmin(same_h))] = before["whole"]
        before = {"h": h[-1], "g": g[-1].tobytes(), "key": key[-1].tobytes(), "start": start[-1], "whole": bool(whole[-1])}
        rows = pa.Table.from_batches([batch.select(_PLACE_NAMES)]).append_column("whole", pa.array(whole)).append_column("first", pa.array(~same_g))
        rows = rows.filter(pa.array(~again))
        if waiting is not None:
            rows = pa.concat_tables([waiting, rows])
        if not rows.num_rows:
            continue
        h = rows["h"].to_numpy()
        equal = h[1:] == h[:-1]
        keep = np.r_[met, equal] | np.r_[equal, False] | rows["twice"].to_numpy()
        many = np.r_[rows["first"].to_numpy()[:-1] & ~rows["first"].to_numpy()[1:], False]
        last = rows.num_rows - 1
        yield from out(rows.slice(0, last), keep[:last], many[:last])
        waiting, met = rows.slice(last), bool(equal[-1]) if last else met
    if waiting is not None:
        yield from out(waiting, np.array([met]) | waiting["twice"].to_numpy(), np.array([False]))


_FOUND = "h long, g binary, at int, n int"
_STRINGS = "k long, d binary, h long, g binary, at int, many boolean, s binary"


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings that the shards need, cut out of their texts, with a digest."""
    seen: set[bytes] = set()
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.binary())
    names = [x.split(" ")[0] for x in _STRINGS.split(", ")]
    for batch in batches:
        for part in text_slices(batch, "text", 1 << 20):
            rows: list[list] = [[] for _ in names]
            for text, key, wanted in zip(part.column("text"), part.column("key").to_pylist(), part.column("wanted").to_pylist(), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                data = (text.as_py() or "").encode("utf-8")
                for w in wanted:
                    s = data[w["start"] + w["lo"] : w["start"] + w["hi"] + WINDOW - 1]
                    for column, x in zip(rows, (w["k"], hashlib.blake2b(s, digest_size=16).digest(), w["h"], w["g"], w["lo"], w["many"], s), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=names)


class Pile:
    """Bytes that are added one after the other, beyond ``limit`` in a file."""

    def __init__(self, folder: str, limit: int) -> None:
        self.folder, self.limit, self.held, self.file, self.size = folder, limit, bytearray(), None, 0

    def add(self, data: bytes) -> None:
        self.held += data
        self.size += len(data)
        if len(self.held) > self.limit:
            self._write()

    def _write(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=self.folder)  # noqa: SIM115
        self.file.write(self.held)
        self.file.flush()
        self.held = bytearray()

    def array(self, dtype) -> np.ndarray:
        if self.file is None:
            return np.frombuffer(self.held, dtype)
        self._write()
        return np.asarray(np.memmap(self.file, dtype, "r"))


def repeated_windows(text: np.ndarray, folder: str, queued: int = QUEUED) -> np.ndarray:
    """Which windows of the strings in ``text``, with 0xFE between, are there in another place too."""
    found = array(len(text) + 2, bool, folder, queued)
    before = np.empty(0, np.int64)  # the place of the last suffix so far
    for places, prefixes in sort_bytes(text, folder, queued, BASE, WINDOW):
        long = np.flatnonzero(prefixes >= WINDOW)
        found[places[long]] = True
        found[np.r_[before if len(before) else places[:1], places[:-1]][long]] = True
        before = places[-1:].copy()
    return found


_HEAD = np.dtype([("h", "<i8"), ("g", "V16"), ("at", "<i4"), ("size", "<i4"), ("many", "?")])


class Shard:
    """Strings with their heads: hash, digest, place of the first window, bytes in the text (0: those of the head before),
    whether several places hold the string (all its windows are repeated then, and others may match it)."""

    def __init__(self) -> None:
        self.folder = tempfile.TemporaryDirectory()
        self.text, self.heads = (Pile(self.folder.name, 2 * SHARD_BYTES) for _ in range(2))
        self.last, self.copies = None, 0

    def add(self, d: bytes, h: int, g: bytes, at: int, many: bool, s: bytes) -> None:
        """One string; equal ones (of one ``d``) come one after the other, and are in the text at most twice."""
        self.last, self.copies = d, self.copies + 1 if d == self.last else 1
        if self.copies <= 2:
            self.text.add(s + b"\xfe")
        self.heads.add(struct.pack("<q16sii?", h, g, at, len(s) + 1 if self.copies <= 2 else 0, many))

    def runs(self, queued: int = QUEUED) -> Iterator[pa.RecordBatch]:
        """Repeated runs of windows of strings that one place holds: (h, g, at, n)."""
        with self.folder as folder:
            found = repeated_windows(self.text.array(np.uint8)[:-1], folder, queued)
            heads, end = self.heads.array(_HEAD), 0
            edges: list[tuple[int, int]] = []
            for part in pieces(len(heads), 10_000):
                rows: list[list] = [[], [], [], []]
                for h, g, at, size, many in heads[part].tolist():
                    if size:
                        end += size
                        there = np.flatnonzero(np.diff(np.r_[False, found[end - size : end - WINDOW], False])).tolist()
                        edges = list(zip(there[::2], there[1::2], strict=True))
                    for a, b in () if many else edges:
                        for column, x in zip(rows, (h, g, at + a, b - a), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, (pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["h", "g", "at", "n"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated runs of windows of the strings, which come by (k, d, h, g, at); a shard ends with a key."""
    shard, last = None, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("k", "d", "h", "g", "at", "many", "s")), strict=True):
            if last == row[:5]:
                continue
            if shard is not None and shard.text.size >= SHARD_BYTES and last[0] != row[0]:
                yield from shard.runs()
                shard = None
            shard, last = shard or Shard(), row[:5]
            shard.add(*row[1:])
    if shard is not None:
        yield from shard.runs()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The maximal runs of each row's spans, which are sorted by start."""
    for batch in batches:
        spans = batch.column("s")
        owner = np.repeat(np.arange(batch.num_rows), np.diff(spans.offsets.to_numpy()))
        flat = spans.flatten()
        if not len(flat):
            continue
        start, end = (flat.field(c).to_numpy().astype(np.int64) for c in ("start", "end"))
        shift = owner * (int(end.max()) + 1)  # so that no run reaches the next row
        reach = np.maximum.accumulate(end + shift)
        new = np.r_[True, start[1:] + shift[1:] > reach[:-1]]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(start)] - 1
        counts = np.bincount(owner[first], minlength=batch.num_rows)
        runs = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (start[first], (reach - shift)[last])], ["start", "end"])
        out = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), runs)
        yield pa.RecordBatch.from_arrays([batch.column("key"), out], names=["key", "spans"])


def _wanted(strings: DataFrame) -> DataFrame:
    """(h, g, key, start, lo, hi, k, many): the halves of strings that others may share, by the windows lo to hi."""
    half = lambda side, context, lo, hi: F.struct(F.lit(side).alias("side"), context.alias("context"), lo.alias("lo"), hi.alias("hi"))
    none, whole = F.lit(0), F.array(half(0, F.lit(0), F.lit(0), F.col("n")))
    halves = F.filter(F.array(half(1, F.col("before"), none, F.col("left")), half(2, F.col("after"), F.col("left"), F.col("n"))), lambda x: x["lo"] < x["hi"])
    halves = strings.select("h", "g", "key", "start", "many", F.explode(F.when(F.col("whole"), whole).otherwise(halves)).alias("x")).select("h", "g", "key", "start", "many", "x.*")
    counts = written(halves.groupBy("h", "side", "context").agg(F.count(F.lit(1)).alias("strings")).where("strings > 1 and side > 0"), "contexts")
    shared = join_hot(halves.where("side > 0"), counts.drop("strings"), ["h", "side", "context"], 24)
    return halves.where("side = 0").unionByName(shared).withColumn("k", F.xxhash64("h", "side", "context")).drop("side", "context")


def repeated_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, spans): for each text with repeats, by its ``text_key``, the maximal removed runs (start, end) of bytes."""
    spark = docs.sparkSession
    texts = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).where(F.octet_length("text") >= WINDOW)
    copies = texts.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max(F.octet_length("text")).alias("b")).where("c > 1").selectExpr("key", "0 as start", "b as end")

    places = texts.mapInArrow(_places, _PLACES).repartition(width(spark), "h").sortWithinPartitions("h", F.desc("twice"), "g", "key", "start")
    several = written(places.mapInArrow(_several, _SEVERAL), "places")
    wanted = _wanted(several.where("first")).groupBy("key").agg(F.collect_list(F.struct("h", "g", "k", "many", "start", "lo", "hi")).alias("wanted"))
    wanted = written(wanted, "wanted")
    strings = texts.join(wanted, "key").select("key", "text", "wanted").mapInArrow(_strings, _STRINGS)
    runs = strings.repartition(width(spark), "k").sortWithinPartitions("k", "d", "h", "g", "at").mapInArrow(_shards, _FOUND)
    runs = written(runs, "runs")

    span = lambda start, n: (start.alias("start"), (start + n + (WINDOW - 1)).alias("end"))
    repeated = several.where("many or not first").select("key", *span(F.col("start"), F.col("n")))
    found = several.where("first and not many").select("h", "g", "key", "start").join(runs.withColumnRenamed("n", "m"), ["h", "g"])  # one place a string
    found = found.select("key", *span(F.col("start") + F.col("at"), F.col("m"))).unionByName(repeated)
    spans = found.unionByName(copies).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))
    return written(spans.mapInArrow(_merged, "key binary, spans array<struct<start:int,end:int>>"), "spans")


def remove_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans`` (removed runs of bytes) and ``kept`` (the remaining bytes)."""
    spans = repeated_spans(docs, text_col)
    bytes_ = spans.agg(F.coalesce(F.sum(F.size("spans") * 24 + 48), F.lit(0))).first()[0]
    spans = spans.select(F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    spans = F.broadcast(spans) if bytes_ <= 32 << 20 else spans
    out = docs.join(spans, text_key(docs[text_col]) == F.col("__key"), "left")
    raw = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    # What lies between the spans, joined as bytes: a cast between binary and string checks and changes nothing.
    edges = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), F.col("__spans"))
    after = F.concat(F.col("__spans"), F.array(F.struct(F.length(raw).alias("start"), F.length(raw).alias("end"))))
    gaps = F.zip_with(edges, after, lambda a, b: F.substring(raw, a["end"] + 1, b["start"] - a["end"]).cast("string"))
    kept = F.when(F.col("__spans").isNull(), raw).otherwise(F.array_join(gaps, "").cast("binary"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return out.withColumn("kept", kept).withColumn("spans", F.coalesce("__spans", none)).drop("__key", "__spans")
