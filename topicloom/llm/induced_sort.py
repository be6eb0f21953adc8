"""External suffix sorting by induced sorting, with common-prefix values.

The suffixes of a byte string are sorted from its LMS suffixes (a smaller character follows a larger one before
them): these are named by their substrings, sorted by recursion on the string of names, and then induce the
L-type suffixes in ascending and the S-type suffixes in descending order. Tuples (character, place, common
prefix with the one before) wait in priority queues that are kept on disk beyond a number of items: the order of arrival
is the order within a character, so a queue is a set of files by ranges of characters, each taken once. The common prefix
of two induced neighbours is one more than the least common prefix between their sources, which the queues'
producer follows with a running minimum for each character.

Everything is handled in pieces of about the queues' limit with array operations. Arrays in proportion to the text (text,
types, names, orders, and all that is kept for each character of a string of names) are memory-mapped files beyond ``HELD`` times that
limit; the recursion ends in a sort in memory once a string of names is short enough. Names have 31 bits.
"""

from __future__ import annotations

import os
import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

_ITEM = np.dtype([("c", "<i4"), ("p", "<i8"), ("l", "<i2")])
#: Arrays of at most this many times the queues' limit stay in memory.
HELD = 8


def array(n: int, dtype, folder: str, limit: int) -> np.ndarray:
    """``n`` zeros, beyond the limit in a file that is gone with the array."""
    if n <= HELD * limit:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile(dir=folder) as f:
        f.truncate(n * np.dtype(dtype).itemsize)
        return np.asarray(np.memmap(f, dtype, "r+", shape=(n,)))


def pieces(n: int, size: int) -> Iterator[slice]:
    for at in range(0, n, size):
        yield slice(at, min(n, at + size))


def _stable(x: np.ndarray) -> np.ndarray:
    """Stable order of non-negative integers; small ones are radix-sorted."""
    return np.argsort(x.astype(np.uint16) if not len(x) or x.max() < 1 << 16 else x, kind="stable")


class BucketQueue:
    """Items by character, first in first out; all but the range of characters in use may lie on disk.

    A character with more items than a range may have is a range of its own, read from and added to its file in pieces.
    """

    def __init__(self, counts: np.ndarray, limit: int, folder: str) -> None:
        share = max(1, limit // 8)
        self.limit, self.folder, self.held, self.now = limit, folder, 0, -1
        os.makedirs(folder, exist_ok=True)
        ranges, total = array(len(counts), np.int32, folder, limit), 0
        self.long: set[int] = set()
        r = 0
        for part in pieces(len(counts), limit):
            for c, count in enumerate(counts[part].tolist(), part.start):
                if total and total + count > share:
                    r, total = r + 1, 0
                ranges[c] = r
                total += count
                if count > share:
                    self.long.add(r)
        self.range_of = ranges
        self.pending: dict[int, list[np.ndarray]] = defaultdict(list)
        self.live: dict[int, list[np.ndarray]] = defaultdict(list)
        self.spilled: set[int] = set()
        self.file, self.read = None, 0  # of the long range in use, and what of it has been taken
        self.tail: list[np.ndarray] = []  # its items after the file's
        self.tailed = 0

    def push(self, chars: np.ndarray, places: np.ndarray, prefixes: np.ndarray) -> None:
        """Items in order of arrival; equal characters keep it."""
        items = np.empty(len(chars), _ITEM)
        items["c"], items["p"], items["l"] = chars, places, prefixes
        r = self.range_of[chars]
        if (here := r == self.now).any():
            own = items[here]
            if self.now in self.long:
                self._add(own)
            else:
                own = own[_stable(own["c"])]
                cuts = np.flatnonzero(np.diff(own["c"])) + 1
                for part in np.split(own, cuts):
                    self.live[int(part["c"][0])].append(part)
        if not here.all():
            rest, rr = items[~here], r[~here]
            order = _stable(rr)
            rest, rr = rest[order], rr[order]
            for part, k in zip(np.split(rest, np.flatnonzero(np.diff(rr)) + 1), rr[np.r_[0, np.flatnonzero(np.diff(rr)) + 1]], strict=True):
                self.pending[int(k)].append(part)
            self.held += len(rest)
            if self.held > self.limit:
                self._spill()

    def _spill(self) -> None:
        for r, parts in self.pending.items():
            with open(f"{self.folder}/{r}", "ab") as f:
                for part in parts:
                    f.write(part.tobytes())
            self.spilled.add(r)
        self.pending.clear()
        self.held = 0

    def _add(self, items: np.ndarray) -> None:
        self.tail.append(items)
        self.tailed += len(items)
        if self.tailed > self.limit:
            if self.file is None:
                self.file = tempfile.TemporaryFile(dir=self.folder)  # noqa: SIM115
            self.file.seek(0, os.SEEK_END)
            for part in self.tail:
                self.file.write(part.tobytes())
            self.tail, self.tailed = [], 0

    def _enter(self, r: int) -> None:
        parts = []
        self.close()
        if r in self.long:
            if r in self.spilled:
                self.file = open(f"{self.folder}/{r}", "rb+")  # noqa: SIM115
                os.unlink(f"{self.folder}/{r}")
                self.spilled.discard(r)
            waiting = self.pending.pop(r, [])
            self.held -= sum(map(len, waiting))
            self.now = r
            self.live.clear()
            for part in waiting:
                self._add(part)
            return
        if r in self.spilled:
            parts.append(np.fromfile(f"{self.folder}/{r}", _ITEM))
            os.unlink(f"{self.folder}/{r}")
            self.spilled.discard(r)
        waiting = self.pending.pop(r, [])
        self.held -= sum(map(len, waiting))
        self.now = r
        self.live.clear()
        if parts := parts + waiting:
            items = np.concatenate(parts)
            items = items[_stable(items["c"])]
            for part in np.split(items, np.flatnonzero(np.diff(items["c"])) + 1):
                self.live[int(part["c"][0])].append(part)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.file, self.read, self.tail, self.tailed = None, 0, [], 0

    def take(self, c: int) -> np.ndarray | None:
        """The next waiting items of ``c`` (those that arrive later are for later calls), or None."""
        if self.range_of[c] != self.now:
            self._enter(int(self.range_of[c]))
        if self.now in self.long:
            if self.file is not None:
                self.file.seek(self.read)
                if raw := self.file.read(self.limit * _ITEM.itemsize):
                    self.read += len(raw)
                    return np.frombuffer(raw, _ITEM)
            parts, self.tail, self.tailed = self.tail, [], 0
            return np.concatenate(parts) if parts else None
        parts = self.live.pop(c, None)
        return None if not parts else np.concatenate(parts) if len(parts) > 1 else parts[0]


class _Minima:
    """Least common prefix since the last push to each character, along one sequence of sources."""

    def __init__(self, alphabet: int, cap: int) -> None:
        self.since, self.cap = np.full(alphabet, -1, np.int64), cap  # -1: nothing pushed yet

    def of(self, prefixes: np.ndarray, at: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Common prefixes of items pushed by the sources ``at`` of a run with these prefixes to their predecessors."""
        n = len(prefixes)
        out = np.empty(len(at), np.int64)
        if len(at):
            order = _stable(chars)
            a, c = at[order], chars[order]
            first = np.r_[True, c[1:] != c[:-1]]
            from_ = np.where(first, 0, np.r_[0, a[:-1] + 1])
            low = self._range(prefixes, from_, a)
            seen = self.since[c]
            low = np.where(first, np.where(seen < 0, -1, np.minimum(low, seen)), low)
            out[order] = np.minimum(low + 1, self.cap)
        least = int(prefixes.min()) if n else self.cap
        self.since = np.where(self.since < 0, -1, np.minimum(self.since, least))
        if len(at):
            last = np.r_[c[1:] != c[:-1], True]
            ends = a[last]
            tail = np.r_[np.minimum.accumulate(prefixes[::-1])[::-1], self.cap]
            self.since[c[last]] = np.minimum(tail[ends + 1], self.cap)
        return out

    @staticmethod
    def _range(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of x[first..last], by tables of powers of two."""
        size = last - first + 1
        level = np.int64(np.frexp(size)[1] - 1)
        out = np.empty(len(first), np.int64)
        table, k = x, 0
        while True:
            if (own := level == k).any():
                out[own] = np.minimum(table[first[own]], table[last[own] - (1 << k) + 1])
            k += 1
            if k > level.max(initial=0):
                return out
            table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])


def eight_bytes(padded: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as numbers."""
    return np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))


def capped_prefixes(words: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes, at most ``cap``, of the different suffixes at a and b; ``words`` from ``eight_bytes``."""
    out = np.full(len(a), cap, np.int64)
    going = np.arange(len(a))
    for k in range(0, cap, 8):
        x = words[a[going] + k] ^ words[b[going] + k]
        differ = x != 0
        lowest = x[differ] & (~x[differ] + np.uint64(1))
        out[going[differ]] = np.minimum(cap, k + np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) // 8)
        going = going[~differ]
        if not len(going):
            break
    return out


def _types(text: np.ndarray, out: np.ndarray, size: int) -> None:
    """True for S-type places: the suffix is smaller than the next one; the last (the sentinel) is S."""
    n, after = len(text), True
    for stop in range(n, 0, -size):
        start = max(0, stop - size)
        x = text[start : stop + 1]
        less, decided = x[:-1] < x[1:], x[:-1] != x[1:]
        if stop == n:
            less, decided = np.r_[less, True], np.r_[decided, True]
        m = stop - start
        at = np.where(decided, np.arange(m), m)
        at = np.minimum.accumulate(at[::-1])[::-1]
        out[start:stop] = np.r_[less, after][at]
        after = bool(out[start])


class Sorter:
    """Sorts suffixes within a budget of queued items; ``base`` is the length that is sorted in memory."""

    def __init__(self, folder: str, limit: int = 1_000_000, base: int = 2_000_000, cap: int = 200) -> None:
        self.folder, self.limit, self.base, self.cap, self.level = folder, limit, base, cap, 0
        self.words = None  # of the text whose common prefixes are carried

    def _array(self, n: int, dtype) -> np.ndarray:
        return array(n, dtype, self.folder, self.limit)

    def _counts(self, text: np.ndarray, alphabet: int, places: np.ndarray | None = None) -> np.ndarray:
        """How often each character is there, in all of the text or at the places."""
        out = self._array(alphabet, np.int64)
        for part in pieces(len(text if places is None else places), self.limit):
            x = text[part] if places is None else text[places[part]]
            if alphabet <= self.limit:
                out += np.bincount(x, minlength=alphabet)
            else:
                c, k = np.unique(x, return_counts=True)
                out[c] += k
        return out

    def _starts(self, counts: np.ndarray) -> np.ndarray:
        """Where each character's share begins, and the end of the last."""
        out = self._array(len(counts) + 1, np.int64)
        np.cumsum(counts, out=out[1:])
        return out

    def _by_character(self, text: np.ndarray, alphabet: int, places: np.ndarray) -> np.ndarray:
        """The places by their characters, in order within each."""
        out = self._array(len(places), np.int64)
        to = self._starts(self._counts(text, alphabet, places))
        for part in pieces(len(places), self.limit):
            c = text[places[part]]
            order = _stable(c)
            c = c[order]
            first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            size = np.diff(np.r_[first, len(c)])
            out[to[c] + np.arange(len(c)) - np.repeat(first, size)] = places[part][order]
            to[c[first]] += size
        return out

    def _lms(self, is_s: np.ndarray) -> np.ndarray:
        some = lambda part: np.flatnonzero(is_s[part.start + 1 : part.stop + 1] & ~is_s[part]) + part.start + 1
        out = self._array(sum(len(some(part)) for part in pieces(len(is_s) - 1, self.limit)), np.int64)
        at = 0
        for part in pieces(len(is_s) - 1, self.limit):
            x = some(part)
            out[at : at + len(x)] = x
            at += len(x)
        return out

    def _induce(self, text: np.ndarray, counts: np.ndarray, seeds: np.ndarray, prefixes: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes in ascending order with their common prefixes (0 where none are carried), a piece at a time.

        ``seeds`` are the LMS places by character, sorted as far as is known.
        """
        n = len(text)
        carry = prefixes is not None
        name = f"{self.folder}/{self.level}"
        first_seed = self._starts(self._counts(text, len(counts), seeds))
        files = {"L": open(f"{name}.L", "wb+"), "S": open(f"{name}.S", "wb+")}  # noqa: SIM115
        spans = {k: (self._array(len(counts), np.int64), self._array(len(counts), np.int64)) for k in "LS"}

        def chars(down: bool = False) -> Iterator[int]:
            parts = list(range(0, len(counts), self.limit))
            for at in reversed(parts) if down else parts:
                some = np.flatnonzero(counts[at : at + self.limit]) + at
                yield from (some[::-1] if down else some).tolist()

        def set_span(kind: str, c: int, start: int) -> None:
            spans[kind][0][c], spans[kind][1][c] = start, files[kind].tell()

        def span(kind: str, c: int) -> tuple[int, int]:
            return int(spans[kind][0][c]), int(spans[kind][1][c])

        def run(queue: BucketQueue, minima: _Minima | None, places: np.ndarray, before: np.ndarray, keep) -> None:
            """Induce from sources in order; ``before`` are their common prefixes to the source before."""
            at = np.flatnonzero(places > 0)
            j = places[at] - 1
            t = text[j].astype(np.int64)
            ok = keep(t)
            at, j, t = at[ok], j[ok], t[ok]
            low = minima.of(before, at, t) if minima else np.zeros(len(at), np.int64)
            if len(at):
                queue.push(t, j, low)

        def boundary(a: int, b: int) -> int:
            return int(capped_prefixes(self.words, np.array([a]), np.array([b]), self.cap)[0]) if carry else 0

        queue = BucketQueue(counts, self.limit, f"{name}.queue")
        minima = _Minima(len(counts), self.cap) if carry else None
        for c in chars():
            start, last = files["L"].tell(), -1
            while (items := queue.take(c)) is not None:
                items.tofile(files["L"])
                run(queue, minima, items["p"], items["l"].astype(np.int64), lambda t, c=c: t >= c)
                last = int(items["p"][-1])
            set_span("L", c, start)
            begin = int(first_seed[c])
            own = seeds[begin : int(first_seed[c + 1])]
            for at in range(0, len(own), self.limit):
                part = own[at : at + self.limit]
                before = prefixes[begin + at : begin + at + len(part)].astype(np.int64) if carry else np.zeros(len(part), np.int64)
                if carry and at == 0:
                    before[0] = boundary(last, int(part[0])) if last >= 0 else 0
                run(queue, minima, part, before, lambda t: t >= 0)

        queue.close()
        queue = BucketQueue(counts[::-1], self.limit, f"{name}.queue")  # descending: characters count from the other end
        top = len(counts) - 1
        minima = _Minima(len(counts), self.cap) if carry else None
        flip = lambda t: top - t

        class Flipped:
            @staticmethod
            def push(t, j, low):
                queue.push(flip(t), j, low)

        queue.push(np.array([flip(int(text[n - 1]))]), np.array([n - 1]), np.array([0]))
        for c in chars(down=True):
            start, last = files["S"].tell(), -1
            while (items := queue.take(top - c)) is not None:
                items.tofile(files["S"])
                run(Flipped, minima, items["p"], items["l"].astype(np.int64), lambda t, c=c: t <= c)
                last = int(items["p"][-1])
            set_span("S", c, start)
            lo, hi = span("L", c)
            after = 0  # of the item last seen, to its predecessor in ascending order
            for stop in range(hi, lo, -self.limit * _ITEM.itemsize):
                begin = max(lo, stop - self.limit * _ITEM.itemsize)
                files["L"].seek(begin)
                items = np.frombuffer(files["L"].read(stop - begin), _ITEM)[::-1]
                before = np.r_[0, items["l"][:-1]].astype(np.int64)
                before[0] = after if stop != hi else boundary(int(items["p"][0]), last) if last >= 0 else 0
                after = int(items["l"][-1])
                run(Flipped, minima, items["p"], before, lambda t, c=c: t < c)

        queue.close()
        for c in chars():
            last = -1
            lo, hi = span("L", c)
            for begin in range(lo, hi, self.limit * _ITEM.itemsize):
                files["L"].seek(begin)
                items = np.frombuffer(files["L"].read(min(hi, begin + self.limit * _ITEM.itemsize) - begin), _ITEM)
                yield items["p"], items["l"]
                last = int(items["p"][-1])
            lo, hi = span("S", c)
            for stop in range(hi, lo, -self.limit * _ITEM.itemsize):
                # In descending order an item's common prefix is to the one after it.
                begin = max(lo, stop - self.limit * _ITEM.itemsize)
                files["S"].seek(begin)
                items = np.frombuffer(files["S"].read(min(hi, stop + _ITEM.itemsize) - begin), _ITEM)
                extra = stop < hi
                places = items["p"][: len(items) - extra][::-1]
                low = items["l"][::-1]
                low = low[:-1] if extra else np.r_[np.int16(boundary(last, int(places[0])) if last >= 0 else 0), low[:-1]]
                yield places, low
        for kind, f in files.items():
            f.close()
            os.unlink(f"{name}.{kind}")

    def order(self, text: np.ndarray, prefixes: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, common prefixes with the suffix before) of all suffixes in order, a piece at a time.

        ``text`` ends with its only 0; for ``prefixes``, ``words`` must be set.
        """
        counts = self._counts(text, int(text.max()) + 1)
        is_s = self._array(len(text), bool)
        _types(text, is_s, self.limit)
        lms = self._lms(is_s)
        seeds = self._by_character(text, len(counts), lms)
        if len(lms) > 1:
            named, at = self._array(len(lms), np.int64), 0
            for places, _ in self._induce(text, counts, seeds, None):
                x = places[is_s[places] & ~is_s[places - 1]]  # place 0 is none: the last is S
                named[at : at + len(x)] = x
                at += len(x)
            length = self._array(len(text), np.int32)
            for part in pieces(len(lms), self.limit):
                ends = np.r_[lms[part.start + 1 : part.stop + 1], len(text) - 1][: part.stop - part.start]
                length[lms[part]] = ends - lms[part] + 1
            lms_rank = self._array(len(text), np.int32 if len(text) < 1 << 31 else np.int64)
            lms_rank[named[:1]] = last = 1
            for part in pieces(len(named) - 1, self.limit):
                after = named[part.start + 1 : part.stop + 1]
                names = last + np.cumsum(~self._same(text, named[part], after, length))
                lms_rank[after] = names
                last = int(names[-1])
            del length
            if last == len(lms):
                seeds = named
            else:
                reduced = self._array(len(lms), np.int64)
                for part in pieces(len(lms), self.limit):
                    reduced[part] = lms_rank[lms[part]]
                del lms_rank
                ranks = self._ranks(reduced)
                for part in pieces(len(lms), self.limit):
                    seeds[part] = lms[ranks[part]]
        low = None
        if prefixes:
            low = self._array(len(seeds), np.int16)
            for part in pieces(len(seeds) - 1, self.limit):
                a, b = seeds[part], seeds[part.start + 1 : part.stop + 1]
                at = np.flatnonzero(text[a] == text[b])
                low[part.start + 1 + at] = capped_prefixes(self.words, a[at], b[at], self.cap)
        yield from self._induce(text, counts, seeds, low)

    @staticmethod
    def _same(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the LMS substrings at a and b are equal."""
        out = length[a] == length[b]
        going = np.flatnonzero(out)
        k = 0
        while len(going):
            equal = text[a[going] + k] == text[b[going] + k]
            out[going[~equal]] = False
            k += 1
            going = going[equal & (length[a[going]] > k)]
        return out

    def _ranks(self, names: np.ndarray) -> np.ndarray:
        """The suffix order of a string of names, whose last is its only least."""
        if len(names) <= self.base:
            rank, k = names, 1
            while True:
                second = np.r_[rank[k:], np.zeros(min(k, len(rank)), np.int64)]
                key = rank * (rank.max() + 1) + second
                order = np.argsort(key)  # equal keys get one rank
                rank = np.empty(len(key), np.int64)
                rank[order] = np.cumsum(np.r_[True, key[order][1:] != key[order][:-1]])
                k *= 2
                if rank.max() == len(rank) or k >= len(rank):
                    return order
        inner = Sorter(self.folder, self.limit, self.base, self.cap)
        inner.level = self.level + 1
        np.subtract(names, names.min(), out=names)
        out, at = self._array(len(names), np.int64), 0
        for places, _ in inner.order(names, prefixes=False):
            out[at : at + len(places)] = places
            at += len(places)
        return out


def sort_bytes(text: bytes | np.ndarray, folder: str, limit: int = 1_000_000, base: int = 2_000_000, cap: int = 200) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, common prefixes up to ``cap``) of the suffixes of ``text``, in order, a piece at a time.

    ``text`` must not hold bytes over 0xFE; the empty suffix comes first.
    """
    raw = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    held = array(len(raw) + 9, np.uint8, folder, limit)
    for part in pieces(len(raw), limit):
        held[part] = raw[part] + 1
    sorter = Sorter(folder, limit, base, cap)
    sorter.words = eight_bytes(held)
    yield from sorter.order(held[: len(raw) + 1])
