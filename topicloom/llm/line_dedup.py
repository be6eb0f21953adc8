"""Site-relative line deduplication.

Pages are grouped by host; the number of a host's pages that contain a line, divided by the host's number
of pages, is the line's frequency there. Lines over the boilerplate ratio are dropped from that host's
pages. A line counts once a page however often the page repeats it; a line on one page of a host repeats nothing and stays, and
blank lines (white space only, as in 0x20 and 0x09 to 0x0D) are never boilerplate.

Scale: no text crosses the network to be counted - (host, hash of the line) is counted with map-side
combination, and exact lines are counted again only for hashes over the ratio, so that no decision rests
on a hash. A host has at most (its mean lines a page) / ratio boilerplate lines, whatever its size, so one
row a host holds them; the pages join it by host, by broadcast where the written table is small, else by a
join whose hot hosts adaptive execution splits.

Defined results: a null text is empty and has no lines; a null host is a host of its own; repeated rows are
pages of their own; an empty table gives an empty table; lines of any length are compared as a whole; columns besides the named ones
pass through, whatever their names, except lines_total and lines_dropped, which give way to the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm._common import broadcast_if_small, fresh, written

#: Share of a host's pages over which a line is boilerplate.
RATIO = 0.075


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _lines_of_page(text: Column) -> Column:
    return F.filter(F.array_distinct(_lines(text)), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))


def boilerplate_lines(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """(host, line, pages, host_pages): the lines on several pages of a host with pages > ratio * host_pages."""
    src = pages.select(F.col(host_col).alias("host"), F.col(text_col).alias("t"))
    totals = written(src.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")), "hosts").select(F.col("host").alias("th"), "host_pages")
    totals = broadcast_if_small(totals, 64)
    least = F.col("pages") > F.lit(float(ratio)) * F.col("host_pages")
    lines = src.select("host", F.explode(_lines_of_page(F.col("t"))).alias("line")).withColumn("h", F.xxhash64("line"))
    counted = lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("pages")).where("pages > 1")
    hashes = counted.join(totals, F.col("host").eqNullSafe(F.col("th"))).where(least).select("host", "h", "host_pages")
    hashes = written(hashes, "hashes").select(F.col("host").alias("ch"), F.col("h").alias("chh"), "host_pages")
    hashes = broadcast_if_small(hashes, 64)
    exact = lines.join(hashes, F.col("host").eqNullSafe(F.col("ch")) & (F.col("h") == F.col("chh")))
    exact = exact.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"), F.max("host_pages").alias("host_pages"))
    return exact.where((F.col("pages") > 1) & least)


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """``pages`` with the boilerplate lines of each host dropped from ``text_col``, and lines_total, lines_dropped."""
    found = written(boilerplate_lines(pages, host_col, text_col, ratio), "boilerplate")
    columns = [c for c in pages.columns if c not in ("lines_total", "lines_dropped")]
    host, gone, kept = (fresh(pages.columns, x) for x in ("host", "boilerplate", "kept"))
    by_host = found.groupBy(F.col("host").alias(host)).agg(F.collect_set("line").alias(gone))
    total = found.agg(F.coalesce(F.sum(F.octet_length("line") + 16), F.lit(0))).first()[0]
    by_host = F.broadcast(by_host) if total <= 32 << 20 else by_host
    joined = pages.select(*columns).join(by_host, pages[host_col].eqNullSafe(F.col(host)), "left")
    lines = _lines(F.col(text_col))
    clean = F.when(F.col(gone).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col(gone), x)))
    out = joined.withColumn(kept, clean)
    text = F.when(F.col(text_col).isNotNull(), F.array_join(kept, "\n")).alias(text_col)
    counts = (F.size(lines).cast("long").alias("lines_total"), (F.size(lines) - F.size(kept)).cast("long").alias("lines_dropped"))
    return out.select(*(text if c == text_col else F.col(c) for c in columns), *counts)
