"""Lines that repeat over the pages of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm import common

#: Share of a host's pages from which on a line is boilerplate; pages that a host and a line need for that.
RATIO, LEAST_PAGES = 0.3, 3
#: Pages of a host that share one row of its boilerplate lines in the join.
SALT_PAGES = 2000
#: Largest list of salted hosts, in bytes of their names, that is broadcast; a longer one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, '' without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def lines_of(html: Column) -> Column:
    """Visible lines: scripts, styles and comments go, block tags break lines, other tags vanish, blanks are squeezed."""
    text = F.coalesce(html, F.lit(""))
    text = F.regexp_replace(text, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?is)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|td|table|nav|article|section|header|footer|title|head|body|html|a)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "")
    text = F.regexp_replace(text, r"[ \t\x0B\f\r]+", " ")
    return F.filter(F.transform(F.split(text, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Per page page_id, host, n_lines, n_dropped and the text that stays.

    A line is boilerplate if at least ``least_pages`` pages of the host and at least ``ratio`` of them hold it. A page
    counts once per line, however often it repeats it. Lines are compared as they are, not by hash. A host has at most
    (lines per page) / ratio such lines, whatever its number of pages, so they travel as one array per host. A host
    of more than SALT_PAGES pages has one copy for every SALT_PAGES of them, and its pages are dealt over the copies, so a
    host with most pages spreads over tasks and the others keep their single row.

    A null url has host '' like any without one; null or empty html has no lines; repeated rows are pages of their own;
    a null page_id is carried; other columns are ignored.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines")
    )
    rows = common.stored(rows.withColumn("salt", F.monotonically_increasing_id()), "page-lines")
    totals = common.stored(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "host-pages")
    held = rows.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    common_lines = held.where(F.col("n") >= least_pages).join(totals, "host").where(F.col("n") >= F.col("pages") * F.lit(ratio))
    arrays = common_lines.groupBy("host").agg(F.collect_set("line").alias("drop"), F.first("pages").alias("pages"))
    salts = F.ceil(F.col("pages") / SALT_PAGES).cast("long")
    arrays = arrays.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    arrays = common.stored(arrays.select("host", "salt", "drop"), "host-lines")
    large = totals.where(F.col("pages") > SALT_PAGES).select("host", salts.alias("salts"))
    names = large.agg(F.sum(F.octet_length("host") + 64)).first()[0] or 0
    salted = rows.join(F.broadcast(large) if names <= BROADCAST_BYTES else large, "host", "left")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("salt"), F.coalesce("salts", F.lit(1)))).drop("salts")
    joined = salted.join(arrays, ["host", "salt"], "left")
    stays = F.filter("lines", lambda line: ~F.array_contains(F.coalesce("drop", F.array().cast("array<string>")), line))
    return joined.withColumn("stays", stays).select(
        "page_id", "host", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("stays")).cast("long").alias("n_dropped"), F.array_join("stays", "\n").alias("text"),
    )
