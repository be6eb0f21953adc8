import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import exact_dedup, induced_sort, line_dedup, ngram_join, suffix_dedup
from topicloom.llm.components import components


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# Exact duplicates.


def exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), t in zip(rows, norm, strict=True):
        groups[t].append(i)
    least = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return Counter((i, least[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm, strict=True))


@pytest.mark.parametrize("block", [7, 4096])
def test_exact_duplicates(spark, odd, block):
    got = exact_dedup.exact_duplicates(odd, block_bytes=block).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == exact(rows)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_blocks_of_equal_prefixes_and_lengths(spark):
    texts = ["ab" * 40, "ab" * 40 + "c", "ab" * 39 + "cb", "b" + "ab" * 39 + "a", "ab" * 40, "ab" * 20, "ab" * 60] * 3
    got = exact_dedup.exact_duplicates(frame(spark, texts).repartition(5), block_bytes=8)
    assert {(r.doc_id, r.keep_id) for r in got.collect()} == {(i, texts.index(t)) for i, t in enumerate(texts)}


def test_no_documents(spark, none):
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert line_dedup.drop_boilerplate(none).count() == 0
    assert ngram_join.similar_components(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_kept_rows_have_all_columns(spark, odd):
    kept = exact_dedup.drop_exact_duplicates(odd.where("doc_id in (1, 2, 6, 7)"))
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 6]


def test_one_of_repeated_rows_is_kept(spark):
    rows = [(1, "a b"), (1, "a  b"), (1, "c"), (None, "a b"), (None, "d"), (None, "d"), (2, "c"), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(5)).repartition(3)
    got = exact_dedup.drop_exact_duplicates(docs)
    assert got.columns == docs.columns and sorted(str((r.doc_id, " ".join((r.text or "").split()))) for r in got.collect()) == ["(1, 'a b')", "(1, 'c')", "(3, '')", "(None, 'd')"]


def test_groups_too_many_to_broadcast_and_hot_ones(spark, monkeypatch):
    texts = [f"t{i % 40}" for i in range(80)] + ["hot"] * 200 + ["alone"]
    real = exact_dedup.join_hot
    monkeypatch.setattr(exact_dedup, "join_hot", lambda *x: real(*x, limit_bytes=40))
    got = exact_dedup.exact_duplicates(frame(spark, texts)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == exact(list(enumerate(texts)))
    assert sum(r.kept for r in got) == 42


# Lines.


def test_boilerplate_lines(spark):
    rows = [(i, "s" if i < 20 else "t", f"own {i}\n\nfooter\nfooter\n{'rare' if i < 2 else 'x' + str(i)}") for i in range(30)] + [(30, None, "footer\na"), (31, "s", None), (32, "s", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs, ratio=0.1).collect()}
    assert got[3].text == "own 3\n\nx3" and (got[3].lines_total, got[3].lines_dropped) == (5, 2)
    assert got[0].text == "own 0\n\nrare" and got[30].text == "footer\na" and got[31].text is None and got[32].text == ""
    found = {(r.host, r.line, r.pages, r.host_pages) for r in line_dedup.boilerplate_lines(docs, ratio=0.1).collect()}
    assert found == {("s", "footer", 20, 22), ("t", "footer", 10, 10)}


def test_lines_on_one_page_and_lines_of_white_space_stay(spark):
    rows = [(0, "a", "only page\nonly line"), (1, "b", "x1\n\t\nboth"), (2, "b", "x2\n\t\nboth"), (3, "b", "x3\n \x0b"), (3, "b", "x3\n \x0b")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs = docs.withColumn("lines_total", F.lit(7)).withColumn("host", F.lit("h")).withColumn("Boilerplate", F.lit("b")).withColumn("kept", F.lit("k"))
    got = line_dedup.drop_boilerplate(docs)
    assert got.columns == ["doc_id", "source", "text", "host", "Boilerplate", "kept", "lines_total", "lines_dropped"]
    assert sorted((r.doc_id, r.text, r.lines_total, r.lines_dropped, r.kept) for r in got.collect()) == [
        (0, "only page\nonly line", 2, 0, "k"), (1, "x1\n\t", 3, 1, "k"), (2, "x2\n\t", 3, 1, "k"), (3, " \x0b", 2, 1, "k"), (3, " \x0b", 2, 1, "k"),
    ]


def test_lines_of_odd_rows(spark, odd):
    got = line_dedup.drop_boilerplate(odd, ratio=0.1)
    assert got.count() == odd.count() and set(odd.columns) < set(got.columns)


# N-gram join.


def links(rows, words, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if k and den * k >= num * (len(a) + len(sets[j]) - k):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return Counter((d, len(sets[i]), min(least[root(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("threshold", [(85, 100, 4), (80, 100, 5), (1, 2, 2)])
def test_similar_components(spark, threshold, monkeypatch):
    num, den, words = threshold
    rng = random.Random(2)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 30, 120]))]
        for _ in range(rng.choice([1, 2, 25])):
            own = list(base)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(400)}"
            texts.append(" ".join(own))
    texts += [None, "", " \n", "One two", "one TWO", "one two three", texts[0]]
    docs = frame(spark, texts).repartition(3)
    expected = links(list(enumerate(texts)), words, num, den)
    got = ngram_join.similar_components(docs, words=words, numerator=num, denominator=den)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == expected
    monkeypatch.setattr(ngram_join, "CELL", 4)
    got = ngram_join.similar_components(docs, words=words, numerator=num, denominator=den)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == expected


def test_large_bitmaps_fold():
    rng = np.random.default_rng(0)
    a, b = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (4000, 4600))
    n = np.array([len(a), len(b)])
    assert ngram_join._level(n).tolist() == [0, 1]
    found = list(ngram_join._near(n, [ngram_join._bitmap(a), ngram_join._bitmap(b)], 80, 100))
    assert len(found) == 1 and 0 < found[0][2][0] <= len(a) + len(b)
    both = np.unique(np.concatenate([a, b[:300]]))
    (_, _, gap, fits), *_ = ngram_join._near(np.array([len(a), len(both)]), [ngram_join._bitmap(a), ngram_join._bitmap(both)], 80, 100)
    assert gap[0] <= 300 and fits[0]


def test_odd_rows(spark, odd):
    got = ngram_join.similar_components(odd)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == links([(r.doc_id, r.text) for r in odd.collect()], 5, 80, 100)


def test_one_of_each_stays(spark):
    docs = frame(spark, ["a b c d e f", "a b c d e f", "", "", "z"])
    assert sorted(r.doc_id for r in ngram_join.keep_one_of_each(docs).collect()) == [0, 2, 3, 4]


@pytest.mark.parametrize("per_task", [3, 1000])
def test_components(spark, per_task):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 130)]
    up = list(range(140))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.a: r.b for r in components(spark.createDataFrame(edges, "a long, b long"), per_task).collect()}
    assert got == {x: root(x) for x in range(140) if root(x) != x}


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other, third = long.replace("w", "v"), long.replace("w", "u")
    rows = [(1, long), (1, long), (1, long + " end"), (1, other), (2, long), (None, other), (None, third), (None, third), (3, ""), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.text.split(" end")[0]) for r in ngram_join.keep_one_of_each(docs).collect())
    assert got == Counter([(1, long), (1, other), (None, third), (3, ""), (3, "")])


# Suffix arrays.


def test_induced_sorting(tmp_path):
    rng = random.Random(1)
    for case in range(120):
        t = bytes(rng.choice(b"abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.randrange(70)))
        if case % 10 == 0:
            t = (t + b"aaaaaab") * 4
        cap = rng.choice([5, 200])
        pieces = [(p.copy(), x.copy()) for p, x in induced_sort.sort_bytes(t, str(tmp_path), rng.choice([4, 50, 10**6]), rng.choice([2, 10**6]), cap)]
        order, prefixes = (np.concatenate(x).tolist() for x in zip(*pieces, strict=True))
        assert order == sorted(range(len(t) + 1), key=lambda i, t=t: t[i:])
        for k in range(1, len(order)):
            a, b = t[order[k - 1] :], t[order[k] :]
            assert prefixes[k] == min(cap, next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))))
    assert not [x for x in tmp_path.rglob("*") if x.is_file() and x.name != "text"]


def test_a_sort_takes_memory_by_its_limit_not_by_its_text(tmp_path):
    rng = np.random.default_rng(2)
    text = rng.choice(np.frombuffer(b"ab", np.uint8), 300_000)
    text[200_000:200_500] = text[1000:1500]
    text[[999, 1500]], text[[199_999, 200_500]] = ord("a"), ord("b")
    tracemalloc.start()
    try:
        total, repeated = 0, []
        for places, prefixes in induced_sort.sort_bytes(text, str(tmp_path), 10_000, 30_000):
            total += int(places.sum())
            repeated += places[prefixes >= 200].tolist()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total == 300_000 * 300_001 // 2 and len(repeated) == 301
    assert {p - 199_000 if p >= 200_000 else p for p in repeated} == set(range(1000, 1301))
    assert peak < 8 << 20


def test_one_key_with_more_strings_than_a_shard_goes_to_disk(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 10_000)
    monkeypatch.setattr(suffix_dedup, "BASE", 500)
    rng = random.Random(4)
    shared = bytes(rng.choice(b"abcdef") for _ in range(210))
    strings = sorted(bytes(rng.choice(b"abcdef") for _ in range(90)) + shared + bytes([65 + i % 7]) for i in range(300))
    strings[5] = strings[4]
    shard = suffix_dedup.Shard()
    for i, x in enumerate(strings):
        shard.add(x[:40], 7, i.to_bytes(16, "big"), 3, i == 0, x)
    assert shard.text.file is not None and len(shard.text.held) <= 20_000 and shard.text.size > 8 * suffix_dedup.SHARD_BYTES
    got = sorted((int.from_bytes(g, "big"), a, n) for b in shard.runs(2000) for g, a, n in zip(*(b.column(c).to_pylist() for c in ("g", "at", "n")), strict=True))
    expected, count = [], Counter(x[k : k + 200] for x in strings for k in range(len(x) - 199))
    for i, x in enumerate(strings):
        flags = np.array([count[x[k : k + 200]] > 1 and i > 0 for k in range(len(x) - 199)])
        edges = np.flatnonzero(np.diff(np.r_[False, flags, False])).tolist()
        expected += [(i, 3 + a, b - a) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    assert got == expected


def repeats(texts, window=200):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[p : p + window] for b in data for p in range(len(b) - window + 1))
    out = []
    for b in data:
        covered = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if count[b[p : p + window]] > 1:
                covered[p : p + window] = True
        edges = np.flatnonzero(np.diff(np.r_[False, covered, False]))
        out.append(([tuple(x) for x in edges.reshape(-1, 2).tolist()], bytes(np.frombuffer(b, np.uint8)[~covered])))
    return out


def test_repeated_passages(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(k) for k in (30, 45, 80, 300)]
    texts = [prose(rng.randrange(60)) + rng.choice(passages) + prose(rng.randrange(60)) + rng.choice(passages) for _ in range(40)]
    texts += ["ab" * 300, "x" * 6000, "y" * 199, "y" * 200, None, "", texts[0], texts[0], "é" * 150, passages[3][:250], passages[3][17:260], "\x00" * 300, "(=" * 120 + prose(10)]
    expected = repeats(texts)
    docs = frame(spark, texts).repartition(5)
    for small in (False, True):
        if small:
            monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 500)
            monkeypatch.setattr(suffix_dedup, "MOST", 64)
            monkeypatch.setattr(suffix_dedup, "BASE", 50)
        got = {r.doc_id: ([tuple(x) for x in r.spans], bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}
        assert got == dict(enumerate(expected))


def test_repeats_of_odd_rows(spark, odd):
    got = suffix_dedup.remove_repeats(odd.where("length(text) < 1000 or text is null"))
    assert got.count() == odd.where("length(text) < 1000 or text is null").count() and got.where(F.size("spans") > 0).count() == 0
    done = suffix_dedup.remove_repeats(odd.where("doc_id in (6, 7)")).select(F.octet_length("kept").alias("n"), F.size("spans").alias("k")).collect()
    assert [(r.n, r.k) for r in done] == [(0, 1), (0, 1)]
