"""Feeds, lists and pages as DataFrames, with declared schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.pages import main_parts
from ..functions.text import absolute, declared_image, escape_html, feed_date, google_source, html_image, html_text, html_title, styled_images, to_ascii, unwrapped


def source_list(spark: SparkSession, path: str, title: str | None = None, other_options: bool = False) -> DataFrame:
    """The sources of a CSV with a header, or that of one title.  Any other option selects none."""
    rows = spark.read.csv(path, header=True, schema=schemas.SOURCE, enforceSchema=True)
    if title is not None:
        return rows.where(F.col("title") == title)
    return rows.where(F.lit(False)) if other_options else rows


RSS = "title string, link string, pubDate string, updated string"
ATOM = "title string, link array<struct<_href:string,_rel:string>>, published string, updated string"


def items(spark: SparkSession, path: str) -> DataFrame:
    """(feed, title, link, published, updated) of the items of RSS files and the entries of Atom files.

    ``feed`` is the file's name without its ending.  Of an entry's links the
    first that is the alternate one, or has no kind, is taken.
    """
    feed = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("feed")
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    rss = read("item", RSS).select(feed, "title", "link", F.col("pubDate").alias("published"), "updated")
    page = F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    return rss.union(read("entry", ATOM).select(feed, "title", page.alias("link"), "published", "updated"))


def entries(items: DataFrame, sources: DataFrame, as_of) -> DataFrame:
    """Items with url, ASCII title, date and true source, each with the source whose id names its feed; items of other feeds drop out."""
    named = sources.select(F.col("source_id").cast("string").alias("feed"), F.col("title").alias("source_title"), "source_id", "relevance")
    joined = items.where("link is not null").join(named, "feed")
    title, name = google_source(F.trim(to_ascii(escape_html(F.col("title")))), F.col("source_title"))
    return joined.select(
        F.col("link").alias("url"), title.alias("title"), feed_date(F.coalesce("published", "updated"), F.lit(as_of)).alias("pubdate"),
        name.alias("source"), "source_id", F.col("relevance").alias("source_relevance"),
    )


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of a list with an entry on each line; blanks are dropped."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def word_list(spark: SparkSession, path: str, most: int = 100_000) -> list[str]:
    """A short list on the driver, empty without the file; a longer one is refused."""
    try:
        rows = lines(spark, path).limit(most + 1).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    if len(rows) > most:
        raise ValueError(f"{path} has over {most} lines; join it as a table")
    return [r["value"] for r in rows]


#: Stop words that the driver takes.
MOST_STOPS = 1_000_000


def stop_list(spark: SparkSession, path: str) -> set[str]:
    """Stop words: lines are only cut at their end and blank ones count; none without the file; a list of over MOST_STOPS is refused."""
    try:
        rows = spark.read.text(path).select(F.regexp_replace("value", r"\s+$", "").alias("w")).distinct().limit(MOST_STOPS + 1).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()
    if len(rows) > MOST_STOPS:
        raise ValueError(f"{path} has over {MOST_STOPS} stop words; join it as a table")
    return {r["w"] for r in rows}


def whole_text(spark: SparkSession, path: str) -> str:
    """A small file as one text; empty if it cannot be read."""
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException:
        return ""
    return row["value"] if row else ""


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text) of raw pages."""
    return pages.select("page_id", "url", html_title(F.col("html")).alias("title"), html_text(F.col("html")).alias("text"))


def extracted(pages: DataFrame) -> DataFrame:
    """(url, text, image_url, n_lines) of raw (url, html) pages, as the crawl takes them.

    The main text has a line for each block; the image is the declared one, else
    the first of the main part, else of the page.  The lines are those of an extractor's file, which ends with the image and one more.
    """
    parts = pages.select("url", main_parts(F.col("html")).alias("main"), declared_image(F.col("html")).alias("declared"), html_image(F.col("html")).alias("first"))
    return parts.select("url", F.array_join("main.lines", "\n").alias("text"), F.coalesce("declared", F.nullif("main.image", F.lit("")), "first").alias("image_url"), (F.size("main.lines") + 2).alias("n_lines"))


NODE = "Title string, Source string, Topics string, Publication_date string, Body string, Original_link string, Link string, Representative_image string"


def weekly(spark: SparkSession, path: str, site: str) -> DataFrame:
    """The week's articles from the site's XML: topics and link made absolute, the body unwrapped, the image styled."""
    rows = spark.read.format("xml").option("rowTag", "node").schema(NODE).load(path)
    return rows.select(
        F.col("Title").alias("title"), F.col("Source").alias("source"), absolute(F.col("Topics"), "topic", site).alias("topics"), F.try_to_date(F.left("Publication_date", F.lit(10)), "yyyy-MM-dd").alias("pubdate"),
        unwrapped(F.col("Body")).alias("summary"), F.col("Original_link").alias("url"), absolute(F.col("Link"), "news", site).alias("link"), styled_images(F.col("Representative_image")).alias("image"),
    )
