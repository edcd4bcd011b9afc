"""Removal of a site's boilerplate lines by their frequency on the site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A line goes if it is on more than MAX_RATIO of its host's pages, and on MIN_PAGES of them at least:
#: on a host of one page every line is on all pages.
MAX_RATIO, MIN_PAGES = 0.5, 3
# Elements without text of their own, and elements that begin or end a line.
DROPPED = r"(?is)<(script|style)[^>]*>.*?</(script|style)>"
COMMENT = r"(?s)<!--.*?-->"
BLOCK = r"(?i)</?(p|div|br|li|ul|ol|tr|td|th|h[1-6]|article|section|header|footer|nav|body|html|head|title|table|meta)( [^>]*)?/?>"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"


def lines_of(html: Column) -> Column:
    """The text lines of a page, without blank ones."""
    text = F.regexp_replace(F.regexp_replace(html, DROPPED, "\n"), COMMENT, "")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), TAG, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "^[ \t\r]+|[ \t\r]+$", "")), lambda x: x != "")


def drop_boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, salts: int = 64) -> DataFrame:
    """page_id, host, n_lines, n_dropped, text (kept lines joined by line feeds) for each row of pages.

    Pages that contain a line are counted by host and line, summed in each task before the shuffle. A page
    has so many lines, so at most 1/max_ratio times the mean number of lines per page can be boilerplate on
    a host: each host's list of them is short, and meets the host's pages dealt over salts.

    A null html has no lines and an empty text; a null url, or one without a host, counts to the host ''; rows
    that repeat count as pages of their own; a line of any length counts whole; no rows give no rows;
    other columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    split = pages.select("page_id", host.alias("host"), lines_of(F.coalesce("html", F.lit(""))).alias("lines"))
    # a page counts once for each of its lines, and once for itself under the line that no page has
    each = split.select("host", F.explode(F.concat(F.array_distinct(F.transform("lines", lambda x: F.sha2(x, 256))), F.array(F.lit("")))).alias("line"))
    counted = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    counted = written(counted.where((F.col("line") == "") | (F.col("n") >= min_pages)), "lines")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    pages_of = counted.where("line = ''").select("host", F.col("n").alias("pages"), every)
    dealt = counted.where("line <> ''").withColumn("salt", F.pmod(F.xxhash64("line"), F.lit(salts)).cast("int"))
    boiler = dealt.join(pages_of, ["host", "salt"]).where(F.col("n") > F.lit(max_ratio) * F.col("pages"))
    boiler = boiler.groupBy("host").agg(F.collect_list("line").alias("drop"))
    boiler = boiler.select("host", "drop", every)
    salted = split.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    kept = salted.join(boiler, ["host", "salt"], "left").withColumn("kept", F.expr("filter(lines, x -> drop is null or not array_contains(drop, sha2(x, 256)))"))
    return kept.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
