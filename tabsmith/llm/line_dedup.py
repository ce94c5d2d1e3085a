"""Line deduplication by site-relative frequency, with DataFrame functions only.

Pages are grouped by host. For each line of a host: the pages that contain it
divided by the host's pages. A line beyond ``ratio``, in at least ``min_pages``
pages, is boilerplate and goes from every page of that host, also from one that has nothing else.

Pages count by families: the three smallest digests of a page's distinct
lines name its family, so equal pages, and near copies that differ in a few lines, are one page
and make no boilerplate of their own, while pages that share a template differ in
their own lines. (Three digests of near copies differ now and then; those count as more pages.)

Lines travel as 128-bit digests, counted before they are shuffled. A host has
at most (lines of a page on average) / ``ratio`` boilerplate lines, so a list
for each host is small whatever the host's size. The lists are written to the
shared folder; Spark joins them by broadcast if the file is below its size
threshold, else by a sort-merge join whose hot hosts AQE splits.

Cases: a null text stays null and has no lines; white-space lines are never
boilerplate and never counted; a page without other lines counts as a page of the one empty family;
pages without a host form one group; repeated
rows stay; an empty table gives an empty table; all other columns are kept,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import stored

RATIO, MIN_PAGES = 0.1, 3
#: Line digests that name a family of near-equal pages.
FAMILY = 3


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line digest, pages, host_pages) of the lines to drop."""
    solid = F.filter(F.split(F.col(f"`{text}`"), "\n", -1), lambda x: F.trim(_plain(x)) != "")
    rows = pages.where(F.col(f"`{text}`").isNotNull()).select(
        F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"), F.col(f"`{host}`").isNull().alias("no_host"),
        F.array_sort(F.array_distinct(F.transform(solid, lambda x: F.unhex(F.md5(x))))).alias("lines"))
    rows = rows.withColumn("page", F.array_join(F.transform(F.slice("lines", 1, FAMILY), F.hex), ""))
    totals = rows.select("host", "no_host", "page").distinct().groupBy("host", "no_host").agg(F.count("*").alias("host_pages"))
    lines = rows.select("host", "no_host", F.unhex(F.md5("page")).alias("page"), F.explode("lines").alias("line"))
    counts = lines.distinct().groupBy("host", "no_host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    return counts.join(totals, ["host", "no_host"]).where(F.col("pages") > ratio * F.col("host_pages"))


def _plain(column):
    """ASCII white space as blanks, so that trim removes it."""
    return F.translate(column, "\t\x0b\x0c\r", "    ")


def deduplicated(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
                 min_pages: int = MIN_PAGES) -> DataFrame:
    """All rows and columns, boilerplate lines taken out of ``text``."""
    return counted(pages, host, text, ratio, min_pages).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(pages.columns)])


def counted(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
            min_pages: int = MIN_PAGES) -> DataFrame:
    """The columns as c0, c1, ... with the new text, and n_lines, n_dropped
    (lines that are not white space)."""
    found = boilerplate(pages, host, text, ratio, min_pages).groupBy("host", "no_host") \
        .agg(F.collect_set("line").alias("drop")).withColumnsRenamed({"host": "__host", "no_host": "__no_host"})
    found = stored(found, "boilerplate")
    names = [f"c{k}" for k in range(len(pages.columns))]
    own = {c: n for n, c in zip(names, pages.columns)}
    rows = pages.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, pages.columns)])
    key = F.coalesce(F.col(own[host]).cast("string"), F.lit(""))
    joined = rows.join(found, (key == F.col("__host")) & (F.col(own[host]).isNull() == F.col("__no_host")), "left")
    # one pass over the lines: keep or drop, and what is counted
    joined = joined.withColumn("__lines", F.split(own[text], "\n", -1))
    solid = lambda x: F.trim(_plain(x)) != ""
    joined = joined.withColumn("__kept", F.when(F.col("drop").isNull(), F.col("__lines")).otherwise(
        F.filter("__lines", lambda x: ~(solid(x) & F.array_contains("drop", F.unhex(F.md5(x)))))))
    n_lines = F.size(F.filter(F.coalesce("__lines", F.array().cast("array<string>")), solid))
    n_kept = F.size(F.filter(F.coalesce("__kept", F.array().cast("array<string>")), solid))
    joined = joined.withColumn("n_lines", n_lines.cast("long")).withColumn("__left", n_kept.cast("long"))
    whole = F.col("__left") == F.col("n_lines")
    new = F.when(whole, F.col(own[text])).otherwise(F.array_join("__kept", "\n"))
    return joined.select(*[(new if n == own[text] else F.col(n)).alias(n) for n in names], "n_lines",
                         F.when(whole, F.lit(0).cast("long")).otherwise(F.col("n_lines") - F.col("__left")).alias("n_dropped"))
