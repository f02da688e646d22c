"""Removal of boilerplate lines by their frequency within a site.

For each site the share of its pages that hold a line is the number of pages
with the line over the site's page total; lines above a percentage (and on a few
pages at least) are boilerplate and go from that site's pages only. Everything is DataFrame functions: pages
are never taken apart and put together again. Only (site, line hash) counts
are shuffled, pre-aggregated; since a page adds one to each of its lines, a
site has at most (its mean number of lines a page * 100 / percent) boilerplate lines,
so they travel as one array per site.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, small


@dataclass(frozen=True)
class Params:
    """Boilerplate is held by over ``percent`` of a site's pages, and by
    ``min_holding`` pages at least: on a site of any size, a line of one or two pages stays."""

    percent: int = 10
    min_holding: int = 3


#: Markup that isn't text; tags that end a line; any other tag.
HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BREAK = r"(?i)</?(p|br|li|ul|ol|h[1-6]|div|nav|article|section|header|footer|table|tr|title|head|body|html)(\s[^>]*)?/?>"
TAG = r"<[^>]*>"
SPACE = " \t\n\x0b\x0c\r"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty where there is none, null for null."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def html_text(html: Column) -> Column:
    """Text of an HTML page, block elements on lines of their own (entities stay)."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    return F.regexp_replace(F.regexp_replace(shown, BREAK, "\n"), TAG, "")


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def drop_site_lines(pages: DataFrame, site: str, text: str, p: Params = Params()) -> DataFrame:
    """``pages`` (same columns) with ``text`` less its boilerplate lines, and
    n_lines, n_dropped (long; lines that aren't blank).

    Lines are what newlines separate and compare without the white space
    around them; blank lines never count and stay. A text that loses nothing
    is unchanged. Null text stays null (0 lines); null is a site of its own;
    each row is a page, repeated rows too; columns named n_lines or
    n_dropped are replaced; an empty table gives no rows.
    """
    names = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names if c != text]).alias("_row"), F.col(f"`{site}`").alias("_of"), F.col(f"`{text}`").alias("_text"))
    # a hash for each line, null for blank ones
    rows = rows.withColumn("_lines", F.split(F.coalesce(F.col("_text"), F.lit("")), "\n", -1))
    rows = rows.withColumn("_hash", F.transform(F.transform("_lines", trimmed), lambda x: F.when(x != "", F.xxhash64(x))))
    keyed = rows.select(F.col("_of").alias("_site"), F.array_compact("_hash").alias("_h"))
    total = keyed.groupBy("_site").agg(F.count("*").alias("_pages"))
    held = (keyed.select("_site", F.explode(F.array_distinct("_h")).alias("_h"))
            .groupBy("_site", "_h").agg(F.count("*").alias("_n")))
    often = materialize(
            held.join(total.withColumnRenamed("_site", "_s"), F.col("_site").eqNullSafe(F.col("_s")))
             .filter((F.col("_n") >= p.min_holding) & (100 * F.col("_n") > p.percent * F.col("_pages")))
             .groupBy("_site").agg(F.collect_list("_h").alias("_drop")), "boilerplate")
    often = small(often, F.size("_drop"))
    out = rows.join(often, F.col("_of").eqNullSafe(F.col("_site")), "left")
    goes = F.transform("_hash", lambda h: F.coalesce(F.array_contains("_drop", h), F.lit(False)))
    out = out.withColumn("_goes", F.when(F.col("_drop").isNotNull(), goes))
    out = out.withColumns({"n_lines": F.size(F.array_compact("_hash")).cast("long"),
                           "n_dropped": F.coalesce(F.size(F.filter("_goes", lambda g: g)), F.lit(0)).cast("long")})
    kept = F.array_join(F.filter("_lines", lambda x, i: ~F.get("_goes", i)), "\n")
    body = F.when(F.col("n_dropped") > 0, kept).otherwise(F.col("_text"))
    return out.select(*[body.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in names], "n_lines", "n_dropped")


def clean_pages(pages: DataFrame, p: Params = Params(), url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` without the HTML, with host, text (of the HTML, non-blank
    lines, trimmed, less the host's boilerplate lines), n_lines, n_dropped.
    The text is taken from the HTML once and written, since it is read twice."""
    body = F.array_join(F.filter(F.transform(F.split(html_text(F.col(html)), "\n", -1), trimmed), lambda x: x != ""), "\n")
    named = pages.drop("host", "text").withColumns({"host": host_of(F.col(url)), "text": body}).drop(html)
    return drop_site_lines(materialize(named, "pages"), "host", "text", p)
