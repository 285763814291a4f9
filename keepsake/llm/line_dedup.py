"""Line dedup by site-relative frequency.

A page's text is its html without scripts, styles and tags, one line per block.
Per host, the pages that contain a line are divided by the host's pages; a line
whose share exceeds ``RATIO`` is boilerplate there and is dropped from the host's
pages.  Hosts with fewer than ``MIN_PAGES`` pages keep all lines.

Counts are taken over digests of the lines, once per page, and reduced inside each
task before they are exchanged, so a line on every page of a host that holds a
third of the table travels once per task.  The shares of a host's lines add up to
its mean number of lines per page, so a host has at most that number divided by
``RATIO`` boilerplate lines: they fit in one array per host, and one join by host
brings it to the pages.  The table of arrays is written first; Spark broadcasts it
below its own limit, else it shuffles and splits the hot host.

Defined results: null html has no lines; lines are compared after trimming blanks,
blank lines are removed, repeats within a page count once and go or stay together;
pages whose url has no host keep all lines; repeated rows count as pages each; an
empty table gives no rows; further columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import materialise, text_or_empty
from keepsake.llm.url_filter import host_and_path

RATIO = 0.3
MIN_PAGES = 5
#: Tags that begin or end a line.
BLOCKS = r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|tr|table|br|hr|nav|header|footer|section|article|title|body|head|html|pre)\b[^<>]*>"


def page_lines(html: Column) -> Column:
    """The text lines of a page, in order, without blank ones."""
    text = text_or_empty(html)
    for tag in ("script", "style"):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, BLOCKS, "\n"), r"<[^<>]*>", "")
    trimmed = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]++|[\x20\x09-\x0D]++$", ""))
    return F.array_remove(trimmed, "")


def _key(line: Column) -> Column:
    return F.unhex(F.sha2(line, 256))


def boilerplate(lined: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """From rows (host, lines) one row per host: host, host_pages and the keys of its boilerplate lines; written once."""
    sited = lined.filter("host <> ''")
    totals = materialise(sited.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")))
    keys = sited.select("host", F.explode(F.array_distinct("lines")).alias("line")).select("host", _key(F.col("line")).alias("key"))
    counts = keys.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    often = counts.join(totals, "host").filter(
        (F.col("host_pages") >= min_pages) & (F.col("n") > ratio * F.col("host_pages")))
    return materialise(totals.join(often.groupBy("host").agg(F.collect_list("key").alias("drop")), "host", "left"))


def drop_boilerplate(pages: DataFrame, url_col: str = "url", html_col: str = "html", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with a struct column ``cleaned``: host, host_pages, n_lines, n_dropped, text (the lines that stay)."""
    names = [c for c in pages.columns if c != "cleaned"]
    host, _ = host_and_path(F.col(f"`{url_col}`"))
    html = F.col(f"`{html_col}`")
    table = boilerplate(pages.select(host.alias("host"), page_lines(html).alias("lines")), ratio, min_pages)
    row = F.struct([F.col(f"`{c}`") for c in names]).alias("row")
    lined = pages.select(row, host.alias("host"), page_lines(html).alias("lines"))
    b = table.select(F.col("host").alias("b_host"), "host_pages", "drop")
    joined = lined.join(b, F.col("host") == F.col("b_host"), "left")
    stays = F.filter("lines", lambda x: ~F.array_contains(F.col("drop"), _key(x)))
    kept = joined.withColumn("kept", F.when(F.col("drop").isNull(), F.col("lines")).otherwise(stays))
    cleaned = F.struct("host", F.coalesce("host_pages", F.lit(0).cast("long")).alias("host_pages"),
                       F.size("lines").cast("long").alias("n_lines"),
                       (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
                       F.array_join("kept", "\n").alias("text")).alias("cleaned")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in names], cleaned)
