"""Jaccard self-join on word n-grams with set-relation skipping, and its connected components.

A text's set holds the hashes of its distinct word n-grams. Equal sets are one class from the start. A
global order puts frequent n-grams last; two sets that reach the threshold then share an n-gram in their
prefixes (as many n-grams as a partner may miss, and one).

Index-level skipping: the index lists of prefix n-grams are sorted by set size and walked in blocks; a block
whose sizes or positions leave no room for the needed overlap is skipped, and lists with the same members
are one list. Before any set is fetched, parity bitmaps bound each pair's overlap from above: bits in which they
differ are hashes that only one of the sets holds.

Answer-level skipping: a set is first compared with its nearest partners by that bound. If one of them is
similar enough, the set takes over that partner's computed answers: both are one class, and pairs inside a
class are never compared again. Only what differs - partners in other classes that the bound does not rule
out - is compared, in rounds, until none is left. So a group of near copies costs about its number of members, not
of pairs, and no link between classes is lost: each pair left out is linked already or cannot be similar.

Scale: prefix entries (one less the threshold, of the n-grams) are shuffled once; texts are read three times; whole sets
are made only for members of surviving lists. The table of frequent n-grams that goes to the tasks has at
most (mean set size) / FREQUENT entries. Lists of frequent n-grams are dealt over pairs of salts, of about
``CELL`` members each; any list that still has more than twice as many is cut by size into cells of ``CELL`` members, and each pair
of cells whose sizes are in reach is a list of its own, so that no task compares the pairs of a long list alone.

Defined results: null or blank texts have an empty set (size 0) and link with nothing; texts with fewer words
than n have one n-gram, the whole sequence; rows with null ids take part, and a component's id is its least
id that is not null; repeated rows are equal sets; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm._common import broadcast_if_small, delete, fresh, text_slices, width, written
from topicloom.llm.components import components

#: Words of an n-gram, and the threshold as a ratio of whole numbers.
WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Share of documents from which an n-gram counts as frequent; members of a list cell; bits of the bitmap of a set of that
#: size at most (larger sets have 2, 4, 8 ... times as many).
FREQUENT, CELL, BITS = 1 / 2000, 4096, 4096
#: N-grams counted at once in a task.
COUNTED = 2_000_000
#: Pairs in which a class is compared with others of a list in the first round; each later round takes GROWTH times as many.
NEAREST, GROWTH = 1, 8

_M1, _M2, _K = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def ngrams(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams: A-Z lower-cased, words between ASCII white space."""
    import xxhash

    parts = (text or "").encode("utf-8").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    w = np.array(list(map(xxhash.xxh3_64_intdigest, parts)), np.uint64)
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * _K + w[k : len(w) - n + 1 + k]
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
        h ^= h >> np.uint64(31)
    return np.unique(h)


def _frequent_in_task(words: int):
    """(h, c): n-grams that many of the task's documents hold."""

    def flush(sets: list[np.ndarray], documents: int) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(sets), return_counts=True)
        many = c >= max(4, int(documents * FREQUENT / 2))
        return pa.RecordBatch.from_arrays([pa.array(h[many].view(np.int64)), pa.array(c[many].astype(np.int64))], names=["h", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, n = [], 0
        for text in itertools.chain.from_iterable(b.column("text") for b in batches):
            sets.append(ngrams(text.as_py(), words))
            n += len(sets[-1])
            if n >= COUNTED:
                yield flush(sets, len(sets))
                sets, n = [], 0
        if sets:
            yield flush(sets, len(sets))

    return run


def _prefix(tokens: np.ndarray, frequent: np.ndarray, order: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first n - ceil(t n) + 1 tokens: rare ones by hash, then frequent ones, the most frequent last."""
    n = len(tokens)
    size = n - (num * n + den - 1) // den + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        hot = frequent[at] == tokens
        if hot.any():
            own = tokens[hot][np.argsort(order[at[hot]], kind="stable")]
            tokens = np.concatenate([tokens[~hot], own])
    return tokens[:size]


def _level(n):
    """Doublings of ``BITS`` for sets of this size."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / BITS))).astype(np.int64)


def _bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the tokens by their hash modulo the number of bits, so that a larger bitmap folds to half by xor."""
    bits = BITS << int(_level(len(tokens)))
    at = (tokens % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _summaries(sent, words: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, order = sent.value[:2]
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = [ngrams(x.as_py(), words) for x in part.column("text")]
                prefixes = [_prefix(s, frequent, order, num, den).view(np.int64) if len(s) else np.empty(0, np.int64) for s in sets]
                ends = np.cumsum([0, *map(len, prefixes)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("rid"), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([_bitmap(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes))),
                    ],
                    names=["rid", "doc_id", "n", "digest", "bitmap", "prefix"],
                )

    return run


def _entries(sent):
    """(key, rep, n, pos): an entry for each prefix token; lists of frequent tokens are dealt over pairs of salts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, _, counts = sent.value
        cells = -(-counts // CELL)
        for batch in batches:
            prefix = batch.column("prefix")
            sizes = np.diff(prefix.offsets.to_numpy())
            key = prefix.flatten().to_numpy().copy()
            rep, n = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("rep", "n"))
            pos = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            if (cells > 1).any() and len(key):
                at = np.minimum(np.searchsorted(frequent, key.view(np.uint64)), len(frequent) - 1)
                split = np.where(frequent[at] == key.view(np.uint64), cells[at], 1)
                if (wide := split > 1).any():
                    times = split[wide]
                    own = np.repeat((rep[wide].view(np.uint64) * _K >> np.uint64(33)).astype(np.int64) % times, times)
                    other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    low, high = np.minimum(own, other), np.maximum(own, other)
                    dealt = np.repeat(key[wide], times).view(np.uint64) * _M1 + (low * (1 << 20) + high + 1).astype(np.uint64) * _M2
                    key = np.concatenate([key[~wide], dealt.view(np.int64)])
                    rep, n, pos = (np.concatenate([x[~wide], np.repeat(x[wide], times)]) for x in (rep, n, pos))
            for i in range(0, len(key), 200_000):
                cut = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[cut]), pa.array(rep[cut]), pa.array(n[cut].astype(np.int32)), pa.array(pos[cut].astype(np.int32))], names=["key", "rep", "n", "pos"])

    return run


def _needed(a, b, num: int, den: int):
    """Least overlap of sets of these sizes that reaches the threshold."""
    return -(-num * (a + b) // (num + den))


def _walk(n: np.ndarray, pos: np.ndarray, num: int, den: int, block: int = 64) -> np.ndarray:
    """Which entries of one list, sorted by size, have a partner that sizes and positions allow; whole blocks are skipped."""
    m = len(n)
    alive = np.zeros(m, bool)
    rest = n - pos
    for i in range(0, m, block):
        a = slice(i, i + block)
        if rest[a].max() < num * n[i] / den:
            continue
        for j in range(i, m, block):
            b = slice(j, j + block)
            if num * n[j] > den * n[a][-1]:  # this and all later blocks are too large
                break
            if rest[b].max() < num * n[j] / den or (alive[a].all() and alive[b].all()):
                continue
            fits = np.minimum.outer(rest[a], rest[b]) >= _needed(n[a][:, None], n[b][None, :], num, den)
            if i == j:
                np.fill_diagonal(fits, False)
            alive[a] |= fits.any(1)
            alive[b] |= fits.any(0)
    return alive


def _cells(found: np.ndarray, n: np.ndarray, num: int, den: int) -> Iterator[np.ndarray]:
    """The members of a list, and of a long one each pair of its cells whose sizes are in reach; members come by size."""
    if len(found) <= 2 * CELL:
        yield np.sort(found)
        return
    for i in range(0, len(found), CELL):
        own = found[i : i + CELL]
        # The cell's own pairs come with the next cell's, if that is in reach.
        later = [j for j in range(i + CELL, len(found), CELL) if num * n[j] <= den * n[i + len(own) - 1]]
        for j in later:
            yield np.sort(np.concatenate([own, found[j : j + CELL]]))
        if not later:
            yield np.sort(own)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[pa.RecordBatch]]:
    """Runs of equal ``key`` in sorted rows."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, stop in itertools.pairwise(cuts):
            if held and keys[start] != now:
                yield held
                held = []
            now = keys[start]
            held.append(batch.slice(start, stop - start))
    if held:
        yield held


def _lists(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[np.ndarray] = []
        total, seen = 0, set()

        def out() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, members)])
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(members)))], names=["members"])

        def lists() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            held: list[tuple[np.ndarray, ...]] = []
            now = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                key, rep, n, pos = (batch.column(c).to_numpy() for c in ("key", "rep", "n", "pos"))
                cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
                starts, stops = np.r_[0, cuts], np.r_[cuts, len(key)]
                edge = np.zeros(len(starts), bool)
                edge[[0, -1]] = True
                for i in np.flatnonzero((stops - starts > 1) | edge):  # most lists have one entry
                    s, e = starts[i], stops[i]
                    if held and key[s] != now:
                        yield tuple(map(np.concatenate, zip(*held, strict=True)))
                        held = []
                    if edge[i]:
                        now = key[s]
                        held.append((rep[s:e], n[s:e], pos[s:e]))
                    else:
                        yield rep[s:e], n[s:e], pos[s:e]
            if held:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))

        for rep, n, pos in lists():
            if len(rep) < 2:
                continue
            if len(rep) == 2:
                small, large = (0, 1) if n[0] <= n[1] else (1, 0)
                if num * n[large] > den * n[small] or min(n[0] - pos[0], n[1] - pos[1]) < _needed(int(n[0]), int(n[1]), num, den):
                    continue
                found = rep
            else:
                alive = _walk(n.astype(np.int64), pos.astype(np.int64), num, den)
                found, n = rep[alive], n[alive]
            for cell in _cells(found, n.astype(np.int64), num, den):
                if len(cell) < 2 or (code := cell.tobytes() if len(cell) < 64 else hashlib.blake2b(cell, digest_size=16).digest()) in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(code)
                members.append(cell)
                total += len(cell)
                if total >= 200_000:
                    yield out()
                    members, total = [], 0
        if members:
            yield out()

    return run


def _near(n: np.ndarray, bitmaps: list[bytes], num: int, den: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each set x of a list sorted by size: x, the first partner's index, and for it and all later ones in reach
    of x's size, the bits in which they differ and whether those leave enough overlap."""
    level = _level(n)
    last = np.searchsorted(num * n, den * n, "right")
    for own in np.unique(level).tolist():
        # Sizes in reach are at most one level above; their bitmaps are folded to this one.
        start, stop = np.searchsorted(level, [own, own + 1])
        to = int(last[stop - 1])
        words = (BITS << own) // 64
        rows = np.empty((to - start, words), np.uint64)
        for i in range(start, to):
            row = np.frombuffer(bitmaps[i], np.uint64)
            rows[i - start] = row if len(row) == words else np.bitwise_xor.reduce(row.reshape(-1, words), 0)
        for x in range(start, stop):
            if (end := int(last[x])) > x + 1:
                gap = np.bitwise_count(rows[x + 1 - start : end - start] ^ rows[x - start]).sum(1, dtype=np.int64)
                yield x, x + 1, gap, (n[x] + n[x + 1 : end] - gap) // 2 >= _needed(n[x], n[x + 1 : end], num, den)


def _list_of(group: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, list[bytes], list[pa.RecordBatch], np.ndarray]:
    rep, n = (np.concatenate([b.column(c).to_numpy() for b in group]) for c in ("rep", "n"))
    bitmaps = [x for b in group for x in b.column("bitmap").to_pylist()]
    by = np.lexsort((rep, n))
    return rep[by], n[by].astype(np.int64), [bitmaps[i] for i in by], group, by


def _pruned(num: int, den: int):
    """The rows of lists whose members have a partner that the bitmaps allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "list"):
            rep, n, bitmap, group, by = _list_of(group)
            alive = np.zeros(len(n), bool)
            for x, first, _, fits in _near(n, bitmap, num, den):
                if fits.any():
                    alive[x] = True
                    alive[first : first + len(fits)] |= fits
            if alive.any():
                table = pa.Table.from_batches(group).take(pa.array(by[alive]))
                yield from table.combine_chunks().to_batches()

    return run


def _pairs(nearest: int, num: int, den: int):
    """(a, b, more): for each class of a list its nearest pairs with other classes; more: the list holds further ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_out, b_out, more_out = [], [], []
        for group in _groups(batches, "list"):
            rep, n, bitmap, group, by = _list_of(group)
            label = np.concatenate([b.column("label").to_numpy() for b in group])[by]
            if (label == label[0]).all():
                continue
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for x, first, gap, fits in _near(n, bitmap, num, den):
                at = np.flatnonzero(fits & (label[first : first + len(fits)] != label[x]))
                if len(at):
                    found.append((np.full(len(at), x), first + at, gap[at]))
            if not found:
                continue
            a, b, gap = (np.concatenate(z) for z in zip(*found, strict=True))
            keep = np.zeros(len(a), bool)
            for x in (label[a], label[b]):  # a pair stays if it is among the nearest of either of its classes
                order = np.lexsort((np.minimum(rep[a], rep[b]), gap, x))
                starts = np.flatnonzero(np.r_[True, x[order][1:] != x[order][:-1]])
                rank = np.arange(len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)]))
                keep[order[rank < nearest]] = True
            low, high = np.minimum(rep[a], rep[b])[keep], np.maximum(rep[a], rep[b])[keep]
            a_out.append(low)
            b_out.append(high)
            more_out.append(np.full(len(low), not keep.all()))
            if sum(map(len, a_out)) >= 100_000 or len(a_out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a_out, b_out, more_out)], names=["a", "b", "more"])
                a_out, b_out, more_out = [], [], []
        if a_out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a_out, b_out, more_out)], names=["a", "b", "more"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = [ngrams(x.as_py(), words) for x in part.column("text")]
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))],
                    names=["digest", "tokens"],
                )

    return run


def _frequent(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequent n-grams (sorted), their places by rising count, their counts; counts are lower bounds."""
    documents = texts.count()
    counted = texts.mapInArrow(_frequent_in_task(words), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    hot = counted.where(F.col("c") >= max(8, int(documents * FREQUENT))).toPandas()  # at most mean set size / FREQUENT rows
    h, c = hot["h"].to_numpy(np.int64).view(np.uint64), hot["c"].to_numpy(np.int64)
    by = np.argsort(h)
    h, c = h[by], c[by]
    order = np.empty(len(h), np.int64)
    order[np.lexsort((h, c))] = np.arange(len(h))
    return h, order, c


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the least id that links reach)."""
    return _components(docs, id_col, text_col, words, numerator, denominator).drop("rid", "root")


def _components(docs: DataFrame, id_col: str, text_col: str, words: int, numerator: int, denominator: int, rid: Column | None = None) -> DataFrame:
    """``similar_components`` with the row's number and its component's (null for rows without n-grams)."""
    spark = docs.sparkSession
    num, den = numerator, denominator
    rid = F.monotonically_increasing_id() if rid is None else rid
    numbered = docs.select(rid.alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sent = spark.sparkContext.broadcast(_frequent(rows.select("text"), words))
    own = written(numbered.mapInArrow(_summaries(sent, words, num, den), "rid long, doc_id long, n long, digest binary, bitmap binary, prefix array<long>"), "sets")
    classes = own.where("n > 0").groupBy("digest").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.first("prefix").alias("prefix"))
    classes, heavy = written(classes, "classes"), own
    own = written(own.select("rid", "doc_id", "n", "digest"), "rows")
    delete(spark, [heavy.written_to])

    entries = classes.select("rep", "n", "prefix").mapInArrow(_entries(sent), "key long, rep long, n int, pos int")
    lists = entries.repartition(width(spark), "key").sortWithinPartitions("key", "n").mapInArrow(_lists(num, den), "members array<long>")
    lists = written(lists.distinct().select(F.monotonically_increasing_id().alias("list"), "members"), "lists")
    members = lists.select("list", F.explode("members").alias("rep")).join(classes.select("rep", "n", "bitmap"), "rep")
    by_list = members.repartition(width(spark), "list").sortWithinPartitions("list")
    members = written(by_list.mapInArrow(_pruned(num, den), by_list.schema), "members")

    needed = written(members.select("rep").distinct().join(classes.select("rep", "digest", "least"), "rep"), "needed")
    ids = broadcast_if_small(needed.select(F.col("least").alias("__id")).distinct(), 16, 8 << 20)
    texts = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("text")
    sets = texts.mapInArrow(_sets(words), "digest binary, tokens array<long>").join(needed.select("rep", "digest"), "digest").dropDuplicates(["rep"])
    sets = written(sets.select("rep", "tokens"), "tokens")

    links, stars, nearest = None, None, NEAREST
    while True:
        labelled = members.withColumn("label", F.col("rep")) if stars is None else members.join(stars.select(F.col("a").alias("rep"), F.col("b").alias("to")), "rep", "left").withColumn("label", F.coalesce("to", "rep")).drop("to")
        dealt = labelled.repartition(width(spark), "list").sortWithinPartitions("list")
        pairs = written(dealt.mapInArrow(_pairs(nearest, num, den), "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more")), "pairs")
        first, second = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("rep").alias("b"), F.col("tokens").alias("tb"))
        both = F.size(F.array_intersect("ta", "tb"))
        checked = pairs.select("a", "b").join(first, "a").join(second, "b")
        good = written(checked.where(den * both >= num * (F.size("ta") + F.size("tb") - both)).select("a", "b"), "links")
        links = good if links is None else links.unionByName(good)
        stars = components(links)
        if not pairs.where("more").limit(1).count():
            break
        nearest *= GROWTH

    roots = classes.select("digest", "rep", "least").join(stars.select(F.col("a").alias("rep"), F.col("b").alias("to")), "rep", "left").withColumn("root", F.coalesce("to", "rep"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component"))
    named = roots.join(ids, "root").select(F.col("digest").alias("__d"), "component", "root")
    out = own.select("rid", "doc_id", "n", "digest").join(named, F.when(F.col("n") > 0, F.col("digest")) == F.col("__d"), "left")
    return out.select("rid", "root", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of the rows of each component the first by id (null ids last), and all rows without n-grams.

    Only where ids are repeated does the choice need row numbers, and a numbered copy of ``docs`` that holds them.
    """
    name = fresh(docs.columns, "row")
    if not docs.groupBy(id_col).count().where("count > 1").limit(1).count():
        kept = similar_components(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name))
        return docs.join(kept, docs[id_col].eqNullSafe(F.col(name)), "left_semi")
    numbered = written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    found = written(_components(numbered, id_col, text_col, WORDS, NUMERATOR, DENOMINATOR, F.col(name)).select("rid", "root", "doc_id", "n_shingles"), "components")
    first = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("f")).select(F.col("f.rid").alias(name))
    kept = first.unionByName(found.where("n_shingles = 0").select(F.col("rid").alias(name)))
    return numbered.join(kept, name, "left_semi").select(*docs.columns)
