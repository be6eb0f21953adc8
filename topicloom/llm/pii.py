"""Personal data by patterns and bootstrapped contextual extraction, with DataFrame functions only.

Base entities (e-mail and IP addresses, card and phone numbers) come from regular expressions. They are seeds, together with
tokens of a key's shape (``KEY``), which no expression reports by itself: the words around a seed - one before, two before, one
after - are lexical patterns. A pattern's confidence is the share of all its places in the corpus that hold a known identifier,
so that common words carry none. Spark scores the graph of patterns and instances in rounds: patterns from their instances,
then instances (number-bearing tokens) from their patterns (noisy or), and contexts of accepted instances are patterns of the
next round. Tokens that reach the threshold become spans of kind ``id``; a token of a key's shape does only if its contexts are confirmed.

Scale: texts are read twice, for the entities with their contexts and for the counts of context words; no text
is shuffled. Positions come from the lengths of matches and of the gaps between them. The expressions have no nested
choices and match possessively, so a long run of digits or letters takes linear time; the matches of a text are put in place in
pieces of ``PIECE``. Patterns, instances and words are aggregated before each join; the rounds run on written tables, until
neither the accepted instances nor their scores change.

Defined results: a null text counts as empty; rows with null ids and repeated rows are searched each; an empty
table gives an empty table; columns of the input may have any names. Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm._common import broadcast_if_small, written

#: Kinds in the order of the result; ``id`` is what the bootstrapping adds.
KINDS = ("email", "ip", "card", "phone", "id")
#: The kinds' patterns, as leftmost matches that need no retry. A start inside a run of the same
#: characters can only follow a match (\G); card numbers are whole runs of 12 to 19 digits.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Tokens that may be identifiers (6 to 128 letters, digits, _ and - with four digits or more), and those of a key's shape.
CANDIDATE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+(?:[0-9][A-Za-z_-]*+){4})[A-Za-z0-9_-]{6,128}+(?![A-Za-z0-9_-])"
KEY = r"^(?=(?:[^0-9]*+[0-9]){6})(?=(?:[^A-Za-z]*+[A-Za-z]){6}).{20,}"
WHITE = r"[\x20\x09-\x0D]+"
#: Distinct instances that a pattern needs, confidence of a pattern, score of an instance, rounds.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_SCORE, ROUNDS = 3, 0.5, 0.8, 3
#: Characters in which a context word is looked for; matches that are put in place at once.
WINDOW, PIECE = 80, 256

_SPAN = "array<struct<start:int,k:int,end:int,m:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, join, zero: int) -> Column:
    """For each value of an array of integers, all values before it joined (``join`` is associative), from ``zero`` on.

    A fold copies the array that it builds, so the array is folded in pieces, and the pieces' totals once more.
    """

    def fold(x: Column) -> Column:
        step = lambda acc, v: F.struct(join(acc["all"], v).alias("all"), F.concat(acc["out"], F.array(acc["all"])).alias("out"))
        return F.aggregate(x, F.struct(F.lit(zero).alias("all"), F.array().cast("array<int>").alias("out")), step)

    def whole(x: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / PIECE).cast("int"))
        return _let(F.transform(at, lambda k: fold(F.slice(x, k * PIECE + 1, F.lit(PIECE)))), placed)

    def placed(parts: Column) -> Column:
        starts = fold(F.transform(parts, lambda p: p["all"]))["out"]
        return F.flatten(F.zip_with(parts, starts, lambda p, start: F.transform(p["out"], lambda v: join(start, v))))

    return _let(values, lambda x: F.when(F.size(x) == 0, F.array().cast("array<int>")).when(F.size(x) <= PIECE, fold(x)["out"]).otherwise(whole(x)))


def _spans(text: Column, pattern: str, kind: str, guard: Column) -> Column:
    """Array of (start, k, end, m) of all leftmost matches."""
    gaps = lambda found: F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    both = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.zip_with(found, gaps(found), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"), F.length(m).alias("l"))))

    def placed(x: Column) -> Column:
        before = _before(F.transform(x, lambda y: y["g"] + y["l"]), lambda a, b: a + b, 0)
        return F.zip_with(x, before, lambda y, at: F.struct((at + y["g"]).alias("start"), F.lit(KINDS.index(kind)).alias("k"), (at + y["g"] + y["l"]).alias("end"), y["m"].alias("m")))

    return F.when(guard, _let(both, placed)).otherwise(F.array().cast(_SPAN))


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        x = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return acc + F.when(i % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """The base entities of a non-null text, sorted by start and kind."""
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    email = _spans(text, EMAIL, "email", F.contains(text, F.lit("@")))
    ip = F.filter(_spans(text, IP, "ip", F.rlike(text, F.lit(r"[0-9]\.[0-9]+\.[0-9]"))), lambda s: F.rlike(s["m"], F.lit(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")))
    card = F.filter(_spans(text, CARD, "card", F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}"))), lambda s: _luhn(digits(s["m"])))
    phone = F.filter(_spans(text, PHONE, "phone", F.contains(text, F.lit("+"))), lambda s: F.length(digits(s["m"])).between(9, 15))
    return F.array_sort(F.concat(email, ip, card, phone))


def _with_context(text: Column, spans: Column) -> Column:
    """Spans with the lower-cased word before, the two words before and the word after (null: none within reach).

    Quotes and brackets next to the span belong to no word.
    """

    def add(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - WINDOW, F.lit(0)) + 1, F.least(s["start"], F.lit(WINDOW)))
        after = F.substring(text, s["end"] + 1, F.lit(WINDOW))
        left = F.regexp_extract(before, r"(?:^|[\x20\x09-\x0D])([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+[\"'(\[{<]*$", 1)
        two = F.regexp_extract(before, r"(?:^|[\x20\x09-\x0D])([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]+[\"'(\[{<]*$", 1)
        right = F.regexp_extract(after, r"^[\"')\]}>]*[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)(?:[\x20\x09-\x0D]|$)", 1)
        word = lambda w: F.when(w != "", F.lower(w))
        context = (word(left).alias("left"), word(F.regexp_replace(two, WHITE, " ")).alias("two"), word(right).alias("right"))
        return F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), s["m"].alias("m"), *context)

    return F.transform(spans, add)


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__rid``, ``__base`` (spans with contexts) and ``__candidates`` (tokens that overlap no base span)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.withColumn("__rid", F.monotonically_increasing_id()).withColumn("__base", base_spans(text))
    tokens = _spans(text, CANDIDATE, "id", F.rlike(text, F.lit("[0-9]")))
    free = F.filter(tokens, lambda c: ~F.exists(F.col("__base"), lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    return found.withColumn("__candidates", _with_context(text, free)).withColumn("__base", _with_context(text, F.col("__base")))


def _occurrences(found: DataFrame, column: str, seed: Column) -> DataFrame:
    """(instance, side, word, seed): the contexts of the spans; seed 1: a base entity, 2: of a key's shape, 0: neither."""
    spans = found.select(F.explode(column).alias("s"))
    sides = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(f"s.{side}").alias("word")) for side in ("left", "two", "right"))))
    return spans.select(F.col("s.m").alias("instance"), sides.alias("c"), seed.alias("seed")).where("c.word is not null").select("instance", "c.side", "c.word", "seed")


def _word_counts(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(side, word, total): the places in all texts of the ``wanted`` (side, word).

    Where all of them fit a broadcast, other words are dropped as they are read; else words are counted in each task first.
    """
    words = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), WHITE)
    each = docs.select(F.explode(_let(words, lambda w: F.zip_with(w, F.concat(F.array(F.lit(None).cast("string")), w), lambda a, b: F.struct(a.alias("word"), b.alias("before"))))).alias("x")).select("x.*")
    each = each.where("word <> ''")
    pair = F.split("word", " ")
    two = written(wanted.where("side = 'two'").select(pair[1].alias("word"), pair[0].alias("before"), F.lit(True).alias("wanted")), "pairs")
    ends = written(wanted.where("side <> 'two'").select("word").unionByName(two.select("word")).distinct(), "ends")
    count = lambda df: df.groupBy("word", "before").agg(F.count(F.lit(1)).alias("n"))
    most = (16 << 20) // 64
    if ends.limit(most + 1).count() <= most and two.limit(most + 1).count() <= most:
        own = each.join(F.broadcast(ends), "word", "left_semi").join(F.broadcast(two), ["word", "before"], "left")
        counted = count(own.select("word", F.when(F.col("wanted"), F.col("before")).alias("before")))
    else:
        counted = count(each).join(ends, "word", "left_semi")
    counted = written(counted, "counts")
    single = counted.groupBy("word").agg(F.sum("n").alias("total"))
    pairs = counted.where("before <> ''").select(F.concat_ws(" ", "before", "word").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("total"))
    sides = lambda df, names: df.select(F.explode(F.array(*map(F.lit, names))).alias("side"), "word", "total")
    return wanted.join(sides(single, ["left", "right"]).unionByName(sides(pairs, ["two"])), ["side", "word"])


def discover(docs: DataFrame, found: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(instance, score): identifiers that no base pattern finds, from the contexts of those that they do find."""
    shape = F.when(F.rlike("s.m", F.lit(KEY)), 2).otherwise(0)
    edges = _occurrences(found, "__base", F.lit(1)).unionByName(_occurrences(found, "__candidates", shape))
    edges = edges.groupBy("side", "word", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"))
    # A pattern needs that many distinct instances, whatever their scores will be.
    broad = edges.groupBy("side", "word").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= MIN_SUPPORT).select("side", "word")
    edges = written(edges.join(broad, ["side", "word"]), "edges")
    wanted = written(edges.select("side", "word").distinct(), "words")
    totals = written(_word_counts(docs, text_col, wanted), "totals")
    edges = written(edges.join(totals, ["side", "word"]), "counted")
    seeds = written(edges.where("seed > 0").groupBy("instance").agg(F.lit(1.0).alias("score"), F.min("seed").alias("seed")), "seeds")
    base, known, last = seeds.where("seed = 1").select("instance"), seeds.select("instance", "score"), None
    for _ in range(rounds):
        scored = edges.join(known, "instance", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        patterns = scored.groupBy("side", "word").agg(
            F.sum(F.col("score") * F.col("n")).alias("hits"), F.sum(F.when(F.col("score") > 0, 1).otherwise(0)).alias("support"), F.max("total").alias("total"), F.sum("n").alias("seen")
        )
        confidence = F.col("hits") / F.greatest("total", "seen")
        patterns = patterns.where(F.col("support") >= MIN_SUPPORT).select("side", "word", confidence.alias("confidence")).where(F.col("confidence") >= MIN_CONFIDENCE)
        instances = edges.where("seed <> 1").join(patterns, ["side", "word"]).groupBy("instance").agg((1 - F.exp(F.sum(F.ln(1 - F.least("confidence", F.lit(0.999)))))).alias("score"))
        accepted = written(instances.where(F.col("score") >= MIN_SCORE).join(base, "instance", "left_anti").select("instance", "score"), "accepted")
        now = tuple(accepted.agg(F.count(F.lit(1)), F.sum(F.xxhash64("instance", F.round("score", 9)).cast("decimal(38,0)"))).first())
        if now in ((0, None), last):
            break
        # What was accepted is known from here on; so are the other keys, until their contexts tell more.
        known = seeds.select("instance", "score").join(accepted, "instance", "left_anti").unionByName(accepted)
        last = now
    return accepted


def _extracted(docs: DataFrame, text_col: str, keep: list[str], rounds: int) -> DataFrame:
    """The ``keep`` columns with ``__base`` and ``__spans``."""
    found = written(entities(docs, text_col).select("__rid", *keep, "__base", "__candidates"), "entities")
    accepted = discover(docs, found, text_col, rounds)
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), s["m"].alias("m")))
    more = found.select("__rid", F.explode(plain(F.col("__candidates"))).alias("s")).join(broadcast_if_small(accepted, 96, 8 << 20), F.col("s.m") == F.col("instance"))
    more = more.groupBy("__rid").agg(F.collect_list("s").alias("__more"))
    out = found.join(more, "__rid", "left").withColumn("__base", plain(F.col("__base")))
    return out.select(*keep, "__base", F.array_sort(F.concat("__base", F.coalesce("__more", F.array().cast(_SPAN)))).alias("__spans"))


def extract(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all, if None) with ``base`` and ``spans``: arrays of (start, k, end, m), sorted.

    ``spans`` holds the base spans and the discovered ones; k is the place in ``KINDS``. Columns of ``docs`` with these
    two names give way.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "spans")]
    return _extracted(docs, text_col, keep, rounds).select(*keep, F.col("__base").alias("base"), F.col("__spans").alias("spans"))


def digest_string(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["k"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with each span (overlapping ones as one) replaced by its kind in angle brackets, as <EMAIL>."""
    found = _extracted(docs, text_col, docs.columns, rounds)
    text, names = F.col(text_col), F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def cleaned(spans: Column) -> Column:
        """The text with each group of overlapping spans as the name of the first."""
        reached = lambda s, at: F.when(s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), names[s["k"]])).otherwise("")
        parts = F.zip_with(spans, _before(F.transform(spans, lambda s: s["end"]), F.greatest, 0), reached)
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))

    clean = F.when(F.size("__spans") > 0, _let(F.col("__spans"), cleaned)).otherwise(text)
    return found.withColumn(text_col, clean).select(*docs.columns)
