import json
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import byte_bpe, html_text, packing, pii, quality

tokenizers_there = pytest.importorskip("public_tokenizers")
RANKS, PATTERN = tokenizers_there.path("byte_bpe_50k.tiktoken"), tokenizers_there.PATTERN
WORDS = tokenizers_there.path("word_bpe_49k.json")
SOME = ["It's a test, isn't it?  \n\n x", "naïve ½ 12a 日本語 𝄞 " * 50, "a" * 3000, " " * 500 + "b", "<|endoftext|> x", "", "tab\t\tnbsp  x\r\n", "ab  \n cd " * 900]


def test_byte_bpe_equals_the_library():
    assert byte_bpe.SPLITTABLE == PATTERN
    enc = byte_bpe.encoder(byte_bpe.read_ranks(RANKS), PATTERN)
    white = "".join(c for c in map(chr, range(0x3001)) if c.isspace())  # with 0x1C to 0x1F, which are none to the library
    for text in [*SOME, white * 3 + "x" + white, f"a{white[:3]}!{white[::-1]}1", "x" + "\n " * 40 + "y", "\x1c \x1c  \u2003\u2003\u2003z"]:
        for run in (2, 3, 9, 1 << 12):
            assert "".join(x for x, _ in byte_bpe.safe_pieces(text, 7, run)) == text
            for size in (1, 7, 100, 1 << 16):
                assert byte_bpe.encode_text(enc, text, size, run).tolist() == enc.encode_ordinary(text)


@pytest.mark.parametrize("run", [" ", "\n", " \n\t\u3000"])
def test_byte_bpe_of_millions_of_white_space(run):
    enc = byte_bpe.encoder(byte_bpe.read_ranks(RANKS), PATTERN)
    many = (run * 2_000_000)[:2_000_000]
    one = enc._encode_single_piece
    assert byte_bpe.encode_text(enc, many).tolist() == one(many)
    assert byte_bpe.encode_text(enc, f"a b{many}c").tolist() == enc.encode_ordinary("a b") + one(many[:-1]) + enc.encode_ordinary(many[-1] + "c")


def test_byte_bpe_of_other_patterns_is_the_library_alone():
    pattern = r" ?[^\s]+[\r\n]*|\s+"  # ends a match on a line feed
    enc = byte_bpe.encoder(byte_bpe.read_ranks(RANKS), pattern)
    text = "ab!\ncd " * 50
    assert byte_bpe.encode_text(enc, text, 5).tolist() == enc.encode_ordinary(text)


def test_byte_bpe_round_trip(spark, odd, none):
    done = byte_bpe.encode(odd, RANKS, PATTERN, decode=True)
    assert done.columns == [*odd.columns, "ids", "decoded"]
    rows = done.collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in rows) and [len(r.ids) for r in rows if r.text is None] == [0]
    again = byte_bpe.decode(byte_bpe.encode(odd, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in again) == sorted(bytes(r.decoded) for r in rows)
    assert byte_bpe.encode(none, RANKS, PATTERN).count() == 0


def test_word_ids_equal_the_library():
    enc = packing.WordEncoder(WORDS)
    for text in [*SOME, "ΟΔΟΣ İx Á co-op 'll", "ªº µß²³ Ÿ ÿ\x1c\x85", "x<|startoftext|>y <| z"]:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_ids_of_latin_words_equal_the_library():
    enc = packing.WordEncoder(WORDS)
    for c in map(chr, range(0x21, 0x180)):
        for text in (c, f"{c}a", f"A{c}b{c.upper()}", f"{c}{c}1 {c}"):
            assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_tokenizers_with_other_steps_are_refused():
    made = json.loads(Path(WORDS).read_text(encoding="utf-8"))
    made["normalizer"]["normalizers"] = made["normalizer"]["normalizers"][:2]
    with pytest.raises(ValueError, match="other normalizers"):
        packing.WordEncoder(json.dumps(made), is_json=True)


def test_memo_keeps_two_generations():
    calls = []
    memo = packing._Memo(lambda x: calls.append(x) or x.encode(), 2)
    assert [memo[x] for x in "abacab"] == [x.encode() for x in "abacab"] and len(memo) <= 2 and calls == ["a", "b", "c"]


def test_packing_plan_uses_each_piece_once():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 2049, 5000), rng.integers(1, 60, 900), np.full(700, 1500), np.full(301, 1024), np.empty(0, int)):
        histogram = np.bincount(lengths, minlength=2049)
        plan = packing.plan(histogram, steps=40)
        used = np.zeros(2049, int)
        for pattern, n in plan:
            assert sum(pattern) <= 2048 and n > 0
            np.add.at(used, list(pattern), n)
        assert (used == histogram).all()
        assert sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(histogram)) * 1.01 + 1


def test_packing(spark, odd, none):
    rows = packing.pack(odd, WORDS, sequence=512).collect()
    enc = packing.WordEncoder(WORDS)
    expected = []
    for r in odd.collect():
        ids = np.r_[np.frombuffer(enc.encode(r.text or ""), "<u4"), np.array([0], "<u4")].astype("<u4")
        expected += [(str(r.doc_id), k, at, len(ids[at : at + 512]), zlib.crc32(ids[at : at + 512].tobytes())) for k, at in enumerate(range(0, len(ids), 512))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert sequences.setdefault(r.sequence_id, 0) == r.offset
        sequences[r.sequence_id] += r.length
    assert max(sequences.values()) <= 512 and len(sequences) <= sum(r.length for r in rows) / 512 * 1.1 + 1
    assert packing.pack(none, WORDS).count() == 0


def test_quality(spark, odd, none):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = rng.choice(vocabulary, rng.integers(20, 200))
        good = int(i % 3 != 0)
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!$$" for w in words)))
        labels.append((i, good))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(docs, marks.where("doc_id % 2 = 0"))
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score(docs, model).collect()}
    held = [i for i, _ in labels if i % 2]
    assert np.mean([got[i][1] == labels[i][1] for i in held]) > 0.97
    assert all(0 <= s <= 1 and p == int(s >= 0.5) for s, p in got.values())
    again = quality.fit(docs.repartition(7), marks.where("doc_id % 2 = 0").unionByName(marks.where("doc_id in (2, 4)")))
    assert (again.good, again.bad) == (model.good, model.bad) and np.allclose(again.weights, model.weights)
    both = marks.where("doc_id % 2 = 0").unionByName(marks.where("doc_id in (2, 4)").withColumn("quality", 1 - F.col("quality")))
    assert quality.fit(docs, both) == quality.fit(docs, marks.where("doc_id % 2 = 0 and doc_id not in (2, 4)"))
    scored = quality.score(odd, model)
    assert scored.columns == [*[c for c in odd.columns if c != "score"], "score", "predicted"] and scored.where("score is null").count() == 0
    assert quality.score(none, model).count() == 0
    assert [r.score for r in quality.score(docs.limit(2), quality.fit(docs, marks.where("quality = 1"))).collect()] == [1.0, 1.0]
    assert quality.fit(none, marks).prior == 0.5 and quality.fit(docs, marks.where("quality > 1")).prior == 0.5
    few = quality.fit(docs, marks.where("doc_id < 6"))
    assert quality.score(docs, few).where("score is null").count() == 0


PAGE = """<html><head><title>T</title><style>.x,#y{display:none} p{margin:0}</style></head><body>
<p>One<p>Two <b>bold</b> x<div class="a x">no</div><div id=y>no</div><div style="display: none">no</div>
<ul><li>a<li>b<ul><li>c</ul><li>d</ul><ol start=3><li>q<li>r</ol>
<table><caption>Cap</caption><tr><th>Name<th>N<tr><td>alpha<td>1<tr><td>b<td>日本</table>tail<br>line
<pre>a  b
  c</pre><blockquote>q1<p>q2</blockquote><dl><dt>t<dd>d</dl>&lt;ok&gt; &copy;<script>var t="</p>";</script><!-- c --><span hidden>h</span><h1>H</h1>end <a href="x>y">link</a>"""
TEXT = """One

Two bold x

- a
- b
  - c
- d

3. q
4. r

Cap
Name   N
alpha  1
b      日本

tail
line

a  b
  c

> q1
>
> q2

t
    d

<ok> ©

H

end link"""


def test_html_layout():
    assert html_text.page_text(PAGE) == TEXT


@pytest.mark.parametrize("page", ["<div>" * 30000 + "x", "<p a='b" * 300, "<table><tr><td>" * 400 + "x", "</div></p>" * 300 + "x<li>", "x<!-- open", "<script>x", "a < b <3 & c", "<", ""])
def test_broken_html_is_rendered(page):
    assert isinstance(html_text.page_text(page), str)


def test_html_table(spark, odd, none):
    got = html_text.extract_text(odd.withColumn("html", F.col("text")))
    assert got.columns == [*[c for c in odd.columns if c != "text"], "html", "text"] and got.where("html is null and text <> ''").count() == 0
    assert html_text.extract_text(none.withColumn("html", F.col("text"))).count() == 0


def plain_spans(text):
    """The base spans by the contract's own expressions, one match after the other."""
    digits = lambda m: re.sub("[^0-9]", "", m)

    def luhn(d):
        twice = [int(x) * (1 + k % 2) for k, x in enumerate(reversed(d))]
        return sum(x - 9 * (x > 9) for x in twice) % 10 == 0

    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), k, m.end()) for k, (pattern, fine) in enumerate(kinds) for m in re.finditer(pattern, text) if fine(m[0])]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_equal_the_plain_expressions(spark, monkeypatch):
    rng = random.Random(8)
    pool = [*"0123456789" * 2, *"..--++@@  ()_%aZé\n𝄞", "4111111111111111", "4111 1111 1111 1111", "10.0.255.1", "+49 30 1234567", "a.b@c-d.ef"]
    texts = ["".join(rng.choices(pool, k=rng.randrange(120))) for _ in range(1500)]
    texts += ["x@y.zz 8.8.8.8, " * 700, "+1 415 555 1212;" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", pii.digest_string(pii.base_spans(F.col("text"))).alias("s"))
    want = [plain_spans(t) for t in texts]
    assert sum(map(bool, want)) > 500 and {r.doc_id: r.s for r in docs.collect()} == dict(enumerate(want))
    monkeypatch.setattr(pii, "PIECE", 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", pii.digest_string(pii.base_spans(F.col("text"))).alias("s"))
    assert {r.doc_id: r.s for r in docs.collect()} == dict(enumerate(want))


def test_confirmed_keys_and_what_else_their_contexts_hold(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("etaoinshr", k=rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [f'{prose(20)} token = "{rng.randrange(1 << 150):038x}" {prose(9)}' for _ in range(30)]
    texts += [f"{prose(9)} token = '12ab34' {prose(3)}", f"{prose(9)} {rng.randrange(1 << 150):038x} {prose(3)}", f"{prose(5)} 2024-11-26 123456", "token = 1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert all('token = "<ID>"' in clean[i] for i in range(30)) and "token = '<ID>'" in clean[30] and [clean[i] for i in (31, 32, 33)] == texts[31:]


def test_redaction_of_overlapping_spans(spark, monkeypatch):
    text = "x 1.2.3.4@a.bc 5.6.7.8 " * 9 + "+1 415 555.1.2.3.4 end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for piece in (256, 2):
        monkeypatch.setattr(pii, "PIECE", piece)
        assert [r.text for r in pii.redact(docs).collect()] == ["x <EMAIL> <IP> " * 9 + "<PHONE> end"]


def test_base_spans(spark, odd, none):
    rows = [
        (0, "a@b.c_d@e.f x@y..z a@b.c.d@e.f.g", "email:0:5,email:5:11,email:19:26"),
        (1, "1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.2.003 1.2.3", "ip:0:7,ip:8:15,ip:26:41"),
        (2, "4111 1111 1111 1111 5 4111-1111-1111-1111", ""),
        (3, "4111 1111 1111 1111, 4111-1111-1111-1112 " + "4" * 30000, "card:0:19"),
        (4, "+1 (415) 555-1212-- +1+2 +1234567890123456", "phone:0:17"),
        (5, "é𝄞 a@b.cd ü +49 30 123456 𝄞 8.8.8.8", "email:3:9,phone:12:25,ip:28:35"),
        (6, None, ""), (7, "", ""), (8, "a" * 50000 + "@" + "x" * 50000, ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = pii.extract(docs, keep=["doc_id"]).select("doc_id", pii.digest_string(F.col("base")).alias("s"), pii.digest_string(F.col("spans")).alias("all"))
    found = {r.doc_id: r.s for r in got.collect()}
    for i, text, want in rows:
        assert found[i] == want == plain_spans(text or ""), (i, text)
    assert pii.extract(odd).count() == odd.count() and pii.extract(none).count() == 0


def test_contexts_discover_identifiers(spark):
    texts = [f"Kontakt: user{i}@mail.example.com und mehr {i}" for i in range(12)] + [f"Kontakt: KD-77{i}19 und mehr" for i in range(3)] + ["order 123456 came", "see KD-77119 there", "the order 998877"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.extract(docs).select("doc_id", pii.digest_string(F.col("spans")).alias("s")).collect()}
    assert got[12] == "id:9:17" and got[0] == "email:9:31" and got[15] == "" and got[16] == "id:4:12" and got[17] == ""
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == "Kontakt: <EMAIL> und mehr 0" and clean[12] == "Kontakt: <ID> und mehr" and clean[15] == "order 123456 came"


def test_nothing_is_read_from_tokenizer_json_but_its_pattern():
    splits = json.loads(Path(WORDS).read_text(encoding="utf-8"))["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    assert splits == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@pytest.mark.parametrize(
    ("sheet", "shown"),
    [
        ("@media print{.a{display:none}}", True),
        ("@media (max-width:600px){p{margin:0}.a{display:none}}", True),
        ("@supports (display:grid){.a{display:none}}", True),
        ("@media print{.b{color:red}} .a{display:none}", False),
        ("@import url('x;{.css'); .a{display:none}", False),
        ("@media screen{.a{display:none}}", False),
        ("@media print, screen{.b{margin:0}.a{display:none}}", False),
        ("/* .x{ */ .b , .a { color:red; display : none }", False),
        (".b::before{content:'}{'} .a{display:none", False),
        ("div.a, .c .a, p + p, [class=a], p:first-child{display:none}", True),
        ("p.a{display:none}", False),
        ("p.b, p.a{display:none}", False),
        (".a{color:red}", True),
    ],
)
def test_style_sheets_hide_on_screens_only(sheet, shown):
    assert html_text.page_text(f"<style>{sheet}</style><p>x<p class=a>secret") == ("x\n\nsecret" if shown else "x")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<style>.m > p, .m em{display:none}</style><div class=m><p>a<section><p>b <em>c</em></section></div><p>d", "b\n\nd"),
        ("<style>#x .n{display:none}</style><div id=x><b>a <i class='k n'>b</i></b></div><i class=n>c</i>", "a\nc"),
        ("<style>.a{display:none} .a.b{display:block}</style><p class=a>x<p class='b a'>y", "y"),
        ("<style>.a.b{display:block} .a{display:none}</style><p class='b a'>y", "y"),
        ("<style>.a{display:none!important} #b{display:block}</style><p class=a id=b>x<p>y", "y"),
        ("<style>.a{display:none}</style><p class=a style='display:block'>x<p style='display:none'>y", "x"),
        ("<style>.h{visibility:hidden} .v{visibility:visible}</style><div class=h>a <b class=v>b</b> c <p>d<ul><li>e<li class=v>f</ul></div>g", "b\n\n- f\n\ng"),
        ("<style>.s{display:block}</style><p hidden>a<p hidden class=s>b", "b"),
        ("<p>Pick <select><option>one<option selected>two</select> <svg><title>no</title><text>drawn</text></svg> <math><mi>x</mi></math>", "Pick\none\ntwo\ndrawn x"),
        ("<div style='visibility: hidden'>a<span style='visibility:inherit'>b</span><span style='visibility:VISIBLE'>c</span></div>", "c"),
        ("<table><tr><td colspan=3>a<td>b<tr><td>1<td>2<td>3<td>4</table>", "a        b\n1  2  3  4"),
    ],
)
def test_visibility(page, text):
    assert html_text.page_text(page) == text


def test_long_attributes_and_selector_lists_are_read_whole():
    value = "v" * 100_000 + "<b>SECRET</b>"
    for quote in "\"'":
        assert html_text.page_text(f"<p data-x={quote}{value}{quote}>text") == "text"
    names = [f"c{i}" for i in range(600)]
    page = f"<style>{','.join('.' + x for x in names)}{{display:none}}</style><p>x" + "".join(f"<p class={x}>hidden" for x in names)
    assert html_text.page_text(page) == "x"


def test_unclosed_quotes_take_time_in_proportion():
    assert html_text.page_text("<a x=\"" * 100_000 + "'") == ""
