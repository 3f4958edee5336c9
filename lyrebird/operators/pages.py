"""Pages of HTML: regions, attributes, images and clean lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.functions.text import html_text, trimmed
from lyrebird.runtime import checkpoint


def region(html: Column, start: str, ends: tuple[str, ...], pattern: bool = False) -> Column:
    """What stands between the start marker and the nearest end marker after it, or the text's end.

    Null if there is no start marker. The start is a text or, with ``pattern``, a regular expression; its first
    place counts.
    """
    if pattern:
        there = F.rlike(html, F.lit(start))
        rest = F.regexp_extract(html, rf"(?s)^.*?(?:{start})(.*)$", 1)
    else:
        at = F.locate(start, html)
        there, rest = at > 0, F.substr(html, at + len(start))
    # a marker that isn't there counts as standing at the end
    near = F.least(*[F.coalesce(F.nullif(F.locate(e, rest), F.lit(0)), F.length(rest) + 1) for e in ends], F.length(rest) + 1)
    return F.when(there, F.substr(rest, F.lit(1), near - 1))


def attributes(html: Column, name: str) -> Column:
    """The distinct values of an attribute, in the order of their first places."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(rf'{name}="([^"]*)"'), F.lit(1)))


def first_image(html: Column) -> Column:
    """(src, alt) of the first image tag; null without one, and so is an attribute that it lacks.

    Values may stand in double quotes, single quotes or none. For the first image of a block give its ``region``.
    """
    tag = F.regexp_extract(html, r"""(?is)<img\b(?:[^>"']|"[^"]*"|'[^']*')*>""", 0)

    def value(name: str) -> Column:
        given = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
        return F.when(F.rlike(tag, F.lit(given)), F.concat(*[F.regexp_extract(tag, given, g) for g in (1, 2, 3)]))

    return F.when(tag != "", F.struct(value("src").alias("src"), value("alt").alias("alt")))


def clean_lines(text: Column) -> Column:
    """Lines without white space at either end; runs of blank lines become one; none before or after all."""
    lines = F.transform(F.split(text, "\n"), lambda l: trimmed(l))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def extract_pages(pages: DataFrame, start: str, ends: tuple[str, ...], attribute: str, id_col: str = "page_id", html_col: str = "html", entities: bool = True, placeholder: str | None = None, pattern: bool = False) -> DataFrame:
    """(id, status, body, palette): the region's clean text, and the attribute's values over the page.

    A page has no text, and a null body, without a region and where the region's text, freed of tags, has the
    placeholder anywhere in it. With ``pattern`` the start is a regular expression.
    """
    text = html_text(region(F.col(html_col), start, ends, pattern), entities)
    body = clean_lines(F.when(~F.contains(text, F.lit(placeholder)), text) if placeholder else text)
    out = pages.select(F.col(id_col), body.alias("body"), attributes(F.col(html_col), attribute).alias("palette"))
    return out.withColumn("status", F.when(F.coalesce(F.col("body"), F.lit("")) == "", "no_lyrics").otherwise("ok"))


def numbered_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line, blank), one row for each line."""
    lines = df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    return lines.withColumn("blank", trimmed(F.col("line")) == "")


def sitemap_urls(files: DataFrame, root: str, host: str, levels: int = 16) -> DataFrame:
    """(loc): the distinct page locations on a host that the sitemap file ``root`` leads to.

    files: url, value (a file's text). An index leads to the files that it names, and these may be indexes
    again; each file is read once, so indexes may name one another. One join for each level.
    """
    from lyrebird.functions.text import same_host

    spark = files.sparkSession
    loc = F.explode(F.regexp_extract_all("value", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("loc")
    front = seen = spark.createDataFrame([(root,)], "url string")
    pages = spark.createDataFrame([], "loc string")
    for _ in range(levels):
        there = files.join(front, "url", "left_semi").select(F.rlike("value", F.lit(r"<sitemapindex[\s>]")).alias("index"), loc)
        pages = pages.union(there.where(~F.col("index")).select("loc"))
        front = checkpoint(there.where("index").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti"))
        if front.isEmpty():
            return pages.where(same_host(F.col("loc"), host)).distinct()
        seen = seen.union(front)
    raise ValueError(f"indexes are nested over {levels} deep")
