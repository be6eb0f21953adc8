"""Exact deduplication by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. All blocks of the corpus are sorted and numbered
by content, so that a block's integer name says exactly which bytes it holds. Adjacent names are paired,
the pairs are sorted and numbered in the same way, and so on, until each document has one name. Names are
ranks of contents, not digests: two documents have the same identity (level, name) only if they are equal.

Scale: a naming pass is one range exchange on (hash, row) - a block that a third of all rows hold spreads
over many partitions - and a sort that spills. A name that goes on over a partition's border is joined to
the one before by comparing the borders' contents, one row a partition. The number of passes is the
logarithm of the longest document's number of blocks, and each pass halves its input. Groups of several rows meet their rows by
broadcast where they are few (checked) or hold a large share of all rows, else by a shuffle; rows without copies need no group.

Defined results: a null text counts as empty; rows with a null ``doc_id`` are kept as rows (they stay only
if their whole group has null ids); repeated rows are rows of their own, and one row of a group stays;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm._common import fresh, join_hot, levels, width, written

#: Bytes of a block. Sorting moves whole blocks, so they also are the largest sort key.
BLOCK_BYTES = 4096
#: White space as in the contract: space, and 0x09 to 0x0D.
WHITE = r"[\x20\x09-\x0D]+"


class _Collision(RuntimeError):
    """Different blocks of one hash lie on a partition's border; the pass is made again with another seed."""


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, kb): a local rank for each, and a last row that tells the borders."""
    part = TaskContext.get().partitionId()
    rank, first, last, last_h, n = -1, None, None, None, 0
    first_h, first_many, last_many = None, False, False
    for batch in batches:
        if not batch.num_rows:
            continue
        kb, h, size = batch.column("kb"), batch.column("h").to_numpy(), batch.num_rows
        new = np.r_[n == 0 or kb[0].as_py() != last, pc.not_equal(kb.slice(1), kb.slice(0, size - 1)).to_numpy(zero_copy_only=False)].astype(bool)
        if n == 0:
            first, first_h = kb[0].as_py(), int(h[0])
        # Another content of the same hash: the borders must not fall among such rows.
        many = new & np.r_[n > 0 and h[0] == last_h, h[1:] == h[:-1]]
        first_many |= bool((many & (h == first_h)).any())
        if new.any():
            last_many = bool(many[np.flatnonzero(new)[-1]])
        ranks = rank + np.cumsum(new)
        rank, n, last, last_h = int(ranks[-1]), n + size, kb[size - 1].as_py(), int(h[-1])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("rid"), batch.column("idx"), batch.column("nb"), batch.column("doc_id"), batch.column("digest"),
                pa.array([part] * size, pa.int32()), pa.array(ranks, pa.int64()),
                pa.nulls(size, pa.binary()), pa.nulls(size, pa.binary()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.bool_()),
            ],
            names=_NUMBERED_NAMES,
        )
    if n:
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()),
                pa.array([part], pa.int32()), pa.array([rank + 1], pa.int64()),
                pa.array([first], pa.binary()), pa.array([last], pa.binary()), pa.array([first_h], pa.int64()), pa.array([last_h], pa.int64()),
                pa.array([first_many or last_many], pa.bool_()),
            ],
            names=_NUMBERED_NAMES,
        )


_NUMBERED = "rid long, idx long, nb long, doc_id long, digest string, part int, rank long, first binary, last binary, first_h long, last_h long, many boolean"
_NUMBERED_NAMES = [x.split(" ")[0] for x in _NUMBERED.split(", ")]


def _named_once(blocks: DataFrame, level: int, seed: int) -> DataFrame:
    spark = blocks.sparkSession
    hashed = blocks.withColumn("h", F.xxhash64(F.lit(seed), "kb"))
    dealt = hashed.repartitionByRange(width(spark), "h", "rid").sortWithinPartitions("h", "kb")
    rows = written(dealt.select("rid", "idx", "nb", "doc_id", "digest", "h", "kb").mapInArrow(_number, _NUMBERED), f"names{level}")
    borders = rows.where("first is not null").select("part", F.col("rank").alias("n"), "first", "last", "first_h", "last_h", "many")
    # One row a partition: the window over them is as small as the number of partitions.
    borders = borders.selectExpr(
        "part", "n", "many", "lag(last_h) over (order by part) = first_h as on_border", "coalesce(lag(last) over (order by part) = first, false) as goes_on",
        "lag(many) over (order by part) as many_before",
    )
    borders = borders.selectExpr(
        "part as p", "(many or many_before) and on_border as unsure",
        "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) - sum(cast(goes_on as long)) over (order by part) as before",
    )
    if borders.where("unsure").limit(1).count():
        raise _Collision
    named = rows.where("first is null").join(F.broadcast(borders.select("p", "before")), F.col("part") == F.col("p"))
    return named.select("rid", "idx", "nb", "doc_id", "digest", (F.col("before") + F.col("rank") + 1).alias("name"))


def name_blocks(blocks: DataFrame, level: int = 0) -> DataFrame:
    """Give each row of ``blocks`` the integer name of its content ``kb`` (1 and on, equal for equal contents)."""
    for seed in range(42, 50):
        try:
            return _named_once(blocks, level, seed)
        except _Collision:
            continue
    raise RuntimeError("no seed keeps different blocks of one hash off the partitions' borders")


def document_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, rid: Column | None = None) -> DataFrame:
    """(rid, doc_id, digest, level, name): rows whose normalised texts are equal, and no others, share (level, name)."""
    rid = F.monotonically_increasing_id() if rid is None else rid
    rows = docs.select(rid.alias("rid"), F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("t"))
    rows = rows.select("rid", "doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("digest"), F.col("t").cast("binary").alias("b"))
    rows = rows.withColumn("nb", F.greatest(F.lit(1), F.ceil(F.length("b") / block_bytes)).cast("long"))
    blocks = rows.select("rid", "doc_id", "digest", "nb", F.posexplode(F.expr(f"transform(sequence(0L, nb - 1), i -> substring(b, cast(i * {block_bytes} + 1 as int), {block_bytes}))")).alias("idx", "kb"))
    # What only the last step needs travels with the first block.
    head = F.col("idx") == 0
    blocks = blocks.select("rid", F.col("idx").cast("long").alias("idx"), "nb", F.when(head, F.col("doc_id")).alias("doc_id"), F.when(head, F.col("digest")).alias("digest"), "kb")
    names = name_blocks(blocks)
    longest = names.agg(F.max("nb")).first()[0] or 1
    done = names.where("nb = 1").selectExpr("rid", "doc_id", "digest", "0 as level", "name")
    key = "unhex(concat(lpad(hex({a}), 16, '0'), lpad(hex({b}), 16, '0')))"
    for level in range(1, levels(longest) + 1):
        pairs = names.where("nb > 1").groupBy("rid", F.expr("idx div 2").alias("idx")).agg(
            F.max("nb").alias("nb"), F.max("doc_id").alias("doc_id"), F.max("digest").alias("digest"),
            F.expr("max(if(idx % 2 = 0, name, null))").alias("a"), F.expr("coalesce(max(if(idx % 2 = 1, name, null)), 0)").alias("b"),
        )
        pairs = pairs.select("rid", "idx", F.expr("(nb + 1) div 2").alias("nb"), "doc_id", "digest", F.expr(key.format(a="a", b="b")).alias("kb"))
        names = name_blocks(pairs, level)
        done = done.unionByName(names.where("nb = 1").selectExpr("rid", "doc_id", "digest", f"{level} as level", "name"))
    return done


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of each group of equal texts the row with the smallest id stays (ties: one of the repeated rows).
    """
    return _duplicates(document_identities(docs, id_col, text_col, block_bytes)).drop("rid")


def _duplicates(identities: DataFrame) -> DataFrame:
    rows = written(identities, "identities")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("f")
    groups = rows.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), first).where("group_size > 1")
    groups = written(groups.select("level", "name", "group_size", F.col("f.doc_id").alias("keep_id"), F.col("f.rid").alias("keep_rid")), "groups")
    joined = join_hot(rows, groups, ["level", "name"], 40, "left")
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id")
    kept = (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept")
    return joined.select("rid", "doc_id", keep_id, F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), kept, F.col("digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only where ids are repeated or null does the choice need row numbers, and a numbered copy of ``docs`` that holds them.
    """
    name = fresh(docs.columns, "row")
    if not docs.groupBy(id_col).count().where("count > 1").limit(1).count():
        kept = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(name))
        return docs.join(kept, docs[id_col].eqNullSafe(F.col(name)), "left_semi")
    numbered = written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    found = _duplicates(document_identities(numbered, id_col, text_col, BLOCK_BYTES, F.col(name)))
    return numbered.join(found.where("kept").select(F.col("rid").alias(name)), name, "left_semi").select(*docs.columns)
