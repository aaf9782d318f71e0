"""Layout regions of scanned pages: tables that run on over a page break are put together, dropped kinds of regions go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of regions that are not content.
DROPPED = ["header", "footer", "number", "footnote", "footer_image", "header_image", "watermark"]
ROW, CELL = r"(?is)<tr[^>]*>.*?</tr>", r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"


def header_signature(html: Column) -> Column:
    """The cells of the first row without tags, joined by |, in single blanks, 160 characters; without a row the first 120 characters."""
    row = F.regexp_extract(html, r"(?is)<tr[^>]*>(.*?)</tr>", 1)
    cells = F.transform(F.regexp_extract_all(row, F.lit(CELL), F.lit(1)), lambda c: F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"^\s+|\s+$", ""))
    found = F.substring(F.regexp_replace(F.array_join(cells, "|"), r"\s+", " "), 1, 160)
    return F.when(F.coalesce(html, F.lit("")) == "", "").when(html.rlike(r"(?is)<tr[^>]*>.*?</tr>"), found).otherwise(F.substring(html, 1, 120))


def joined_tables(before: Column, after: Column) -> Column:
    """The rows of the second table but its first, put before the end of the first table."""
    rows = F.regexp_extract_all(after, F.lit(ROW), F.lit(0))
    body = F.array_join(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), "")
    head, end = F.regexp_extract(before, r"(?s)^(.*)</table>.*$", 1), F.regexp_extract(before, r"(?s)^.*(</table>.*)$", 1)
    whole = F.when(end == "", F.concat(before, body)).otherwise(F.concat(head, body, end))
    return F.when(before == "", after).when((after == "") | (F.size(rows) <= 1), before).otherwise(whole)


def merged_tables(regions: DataFrame, table_label: str = "table", dropped: list[str] = DROPPED) -> DataFrame:
    """regions(doc, page, idx, label, html) with the table that ends a page and the one of the same header that begins the next page as one, on
    the former page (merged). A page's only region cannot do both, so of a row of such pages every second break is closed: breaks that
    share a region form a run, and those of even place in it hold. Dropped kinds go, but for documents of one page, which stay as they are.
    All is found in one order of the regions: what stands before a page's first region is the last one of the page before;
    a page number that is missing is an empty page."""
    rows = regions.withColumn("html", F.regexp_replace(F.coalesce("html", F.lit("")), r"^\s+|\s+$", ""))
    by_place = Window.partitionBy("doc").orderBy("page", "idx")
    so_far = by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    rows = rows.withColumn("_signature", F.when(F.col("label") == table_label, header_signature(F.col("html"))))
    at = F.struct("page")
    rows = rows.withColumns({"_first": ~flag(F.lag(at).over(by_place) == at), "_last": ~flag(F.lead(at).over(by_place) == at)})
    follows = (F.lag("_signature").over(by_place) == F.col("_signature")) & (F.lag("page").over(by_place) + 1 == F.col("page"))
    rows = rows.withColumn("_open", F.col("_first") & flag(follows))
    # a break belongs to the run of the one before it if both share the only region of the page between them
    rows = rows.withColumn("_starts", F.col("_open") & ~flag(F.lag(F.col("_open") & F.col("_last")).over(by_place)))
    rows = rows.withColumns({"_breaks": F.sum(F.col("_open").cast("int")).over(so_far), "_pages": F.sum(F.col("_first").cast("int")).over(by_place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    in_run = F.col("_breaks") - F.max(F.when(F.col("_starts"), F.col("_breaks"))).over(so_far)
    rows = rows.withColumn("_closed", F.col("_open") & (in_run % 2 == 0))
    rows = rows.withColumn("_more", F.when(F.col("_last"), F.lead(F.when(F.col("_closed"), F.col("html"))).over(by_place)))
    rows = rows.where("doc is not null and page is not null")
    takes = F.col("_last") & F.col("_more").isNotNull() & ~F.col("_closed")
    rows = rows.where(~F.col("_closed")).withColumn("merged", takes)
    rows = rows.withColumn("html", F.when(takes, joined_tables(F.col("html"), F.col("_more"))).otherwise(F.col("html")))
    return rows.where((F.col("_pages") == 1) | ~F.col("label").isin(dropped)).select(*regions.columns, "merged")
