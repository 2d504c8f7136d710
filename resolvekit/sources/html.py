"""Tables and links of raw HTML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.exprs import html_text


def extract_html_table(pages: DataFrame, required: list[str]) -> DataFrame:
    """(page_id, row, cells map<header, text>) of the first table of pages(page_id, html) whose header has all required columns; a page without one gives a row with `error`."""
    all_ = lambda c, tag: F.regexp_extract_all(c, F.lit(f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    tables = pages.select("page_id", F.posexplode_outer(all_(F.col("html"), "table")).alias("t", "table"))
    rows = tables.select("page_id", "t", F.posexplode_outer(all_(F.col("table"), "tr")).alias("row", "tr"))
    cells = rows.select("page_id", "t", "row", F.transform(F.regexp_extract_all("tr", F.lit("(?is)<t[hd]\\b[^>]*>(.*?)</t[hd]>"), F.lit(1)),
        lambda c: html_text(c)).alias("cells"))
    wanted = F.array(*map(F.lit, required))
    heads = cells.where((F.col("row") == 0) & (F.size(F.array_except(wanted, F.col("cells"))) == 0))
    first = heads.withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy("t"))).where("_n = 1").select("page_id", "t", F.col("cells").alias("head"))
    body = cells.where("row > 0").join(first, ["page_id", "t"])
    short = F.least(F.size("head"), F.size("cells"))
    found = body.where(short > 0).select("page_id", F.col("row").cast("long").alias("row"),
        F.map_from_arrays(F.slice("head", F.lit(1), short), F.slice("cells", F.lit(1), short)).alias("cells"), F.lit(None).cast("string").alias("error"))
    missing = pages.select("page_id").distinct().join(first.select("page_id"), "page_id", "left_anti").select("page_id",
        F.lit(None).cast("long").alias("row"), F.lit(None).cast("map<string,string>").alias("cells"), F.lit("no_table_with_required_headers").alias("error"))
    return found.unionByName(missing)


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, position, href, label) of all links with a quoted address, in order."""
    hits = F.regexp_extract_all("html", F.lit('(?is)<a\\b[^>]*href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    out = pages.select("page_id", F.posexplode(hits).alias("position", "a"))
    return out.select("page_id", F.col("position").cast("long").alias("position"), F.regexp_extract("a", '(?is)href="([^"]*)"', 1).alias("href"),
        html_text("a").alias("label"))
