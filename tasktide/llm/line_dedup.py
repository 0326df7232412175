"""Boilerplate lines by site-relative frequency.

A line is boilerplate on a host when the pages of that host that contain it are more than `ratio` of the host's pages
and at least `least`: on hosts of a few pages every line is on more than a tenth of them, and two pages that share a line
may as well be a text and its quotation, so a third has to bear it out. Such lines are removed from every page of the host; all other lines stay in place.

Lines are counted by host and a 128-bit hash with map-side sums, so no text is shuffled and a host with most of the
pages is spread by its lines. A host has at most (its mean number of lines) / ratio boilerplate lines, so their hashes
are one short array for each host; the table of these arrays is written first, and its known size decides whether Spark
broadcasts it or joins by host, where adaptive execution splits a large host.

With `once`, rows of a host with equal text are one page, in a line's pages and in the host's: copies of a text are no
evidence that its lines are boilerplate. Only hashes of texts and lines are shuffled for that. Without it, as in the SQL,
a text that makes up more than `ratio` of a host's pages, at least `least` times, loses all its lines in every copy.

Defined results: a null text stays null and has no lines; empty lines are never boilerplate; a null host is a host of
its own; a line that a page repeats counts once for the page; repeated rows are pages of their own unless `once` is set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Workspace


def _name(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, least: int = 3, once: bool = False) -> DataFrame:
    """host and lines: the hashes of its boilerplate lines. Hosts without any are left out."""
    of_page = F.array_distinct(F.transform(F.filter(F.split(text, "\n", -1), lambda x: x != ""), _name))
    rows = docs.select(F.col(host).alias("host"), _name(F.col(text)).alias("page"), of_page.alias("of_page"))
    rows = rows.dropDuplicates(["host", "page"]) if once else rows
    pages = rows.groupBy("host").agg(F.count("*").alias("pages"))
    lines = rows.select("host", F.explode("of_page").alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least).withColumnRenamed("host", "of")
    often = counts.join(pages, F.col("of").eqNullSafe(F.col("host"))).filter(F.col("n") > F.lit(ratio) * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, least: int = 3, counts: tuple[str, str] = ("n_lines", "n_dropped"), once: bool = False
) -> DataFrame:
    """docs with boilerplate lines removed from text, and the numbers of lines and of dropped lines, so named."""
    work = Workspace(docs.sparkSession, "line-dedup")
    bad = work.keep(boilerplate(docs, host, text, ratio, least, once), "lines").select(F.col("host").alias("__host"), F.col("lines").alias("__bad"))
    joined = docs.join(bad, F.col(host).eqNullSafe(F.col("__host")), "left")
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda x: ~F.array_contains("__bad", _name(x)))
    joined = joined.withColumn("__kept", F.when(F.col("__bad").isNotNull(), kept))
    out = joined.withColumns(
        {
            counts[0]: F.coalesce(F.size(lines), F.lit(0)).cast("long"),
            counts[1]: F.coalesce(F.size(lines) - F.size("__kept"), F.lit(0)).cast("long"),
            text: F.when(F.col("__bad").isNull(), F.col(text)).otherwise(F.array_join("__kept", "\n")),
        }
    )
    return out.drop("__host", "__bad", "__kept")


def sql(documents: str = "documents", ratio: float = 0.1, least: int = 3) -> str:
    """The same for DuckDB: doc_id, text, n_lines and n_dropped of each document, hosts being sources."""
    return f"""
WITH rows AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM {documents}),
pages AS (SELECT source, count(*) AS pages FROM rows GROUP BY source),
seen AS (SELECT source, unnest(list_distinct(lines)) AS line FROM rows),
counts AS (SELECT source, line, count(*) AS n FROM seen WHERE line <> '' GROUP BY source, line),
often AS (SELECT c.source, list(c.line) AS bad FROM counts c JOIN pages p ON c.source IS NOT DISTINCT FROM p.source
          WHERE n >= {least} AND n > CAST({ratio} AS DOUBLE) * pages GROUP BY c.source),
cleaned AS (SELECT doc_id, text, lines, bad, list_filter(lines, lambda x: NOT list_contains(bad, x)) AS kept
            FROM rows r LEFT JOIN often o ON r.source IS NOT DISTINCT FROM o.source)
SELECT doc_id, CASE WHEN bad IS NULL THEN text ELSE array_to_string(kept, chr(10)) END AS text,
       coalesce(len(lines), 0) AS n_lines, CASE WHEN bad IS NULL THEN 0 ELSE coalesce(len(lines) - len(kept), 0) END AS n_dropped
FROM cleaned"""
