"""Command line: crawl, prepare, email, train, train_experiment, help, over a data folder.

The folder holds ``articles``, ``categories``, ``crawled`` and ``extracted`` as
Parquet, the feed of each source as ``feeds/<source id>.xml``, lists under
``lists``, ``sources.csv`` and ``config.ini``.
"""

from __future__ import annotations

import argparse
import datetime as dt
import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import config, schemas
from .checkpoints import checkpointed
from .operators import classify, relational
from .plans import prepare as plans
from .sources import feeds, sinks


def read(spark: SparkSession, data: str, name: str, schema: StructType | str | None = None) -> DataFrame:
    """A table of the folder; one with a schema is empty where it isn't there yet.  One that a run left half replaced is put back first."""
    try:
        return spark.read.parquet(sinks.recovered(spark, f"{data}/{name}"))
    except Exception as e:
        if schema and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def settings(spark: SparkSession, data: str, as_of: dt.date) -> config.Settings:
    words = lambda name: tuple(feeds.word_list(spark, f"{data}/lists/{name}"))
    stops = tuple(sorted(feeds.stop_list(spark, f"{data}/lists/stoplist")))
    return config.load(f"{data}/config.ini", as_of=as_of, whitelist=words("whitelist"), blacklist_urls=words("blacklist_urls"), blacklist_words=words("blacklist_words"), stopwords=stops)


def crawl(spark: SparkSession, data: str, as_of: dt.date, source: str | None) -> None:
    """New entries of the feeds, with the extracted pages, are appended as articles; urls are recorded."""
    known = settings(spark, data, as_of)
    crawled = read(spark, data, "crawled", "url string")
    found = feeds.entries(feeds.items(spark, f"{data}/feeds"), feeds.source_list(spark, f"{data}/sources.csv", source), as_of)
    first = Window.partitionBy("url").orderBy("source_id", "title", "pubdate")
    once = found.withColumn("k_", F.row_number().over(first)).where("k_ = 1").drop("k_")
    new, seen = (checkpointed(x) for x in plans.crawl(once, read(spark, data, "extracted"), crawled, known))
    sinks.append_articles(new.withColumn("urlid", F.xxhash64("url")).withColumns({"processed": F.lit(False), "published": F.lit(False)}), f"{data}/articles")
    seen.write.mode("append").parquet(f"{data}/crawled")


#: Topics with a model of their own.
MOST_TOPICS = 1000


def listed(rows: DataFrame, column: str) -> list[str]:
    """The values of a column on the driver; more than MOST_TOPICS are refused."""
    found = rows.select(column).limit(MOST_TOPICS + 1).collect()
    if len(found) > MOST_TOPICS:
        raise ValueError(f"over {MOST_TOPICS} topics")
    return [r[column] for r in found]


def models_of(spark: SparkSession, data: str) -> dict[str, PipelineModel]:
    folder = f"{data}/models"
    names = listed(read(spark, data, "topics", "topic string"), "topic")
    return {name: PipelineModel.load(os.path.join(folder, name)) for name in names}


def prepare(spark: SparkSession, data: str, as_of: dt.date) -> None:
    """Judge unprocessed articles, export them all as XML, replace their categories and mark them as processed."""
    articles = relational.with_categories(read(spark, data, "articles", schemas.ARTICLE).drop("categories"), read(spark, data, "categories", schemas.CATEGORY))
    out = plans.prepare(articles, settings(spark, data, as_of), models_of(spark, data))
    out.write.mode("overwrite").parquet(f"{data}/prepared")
    done = spark.read.parquet(f"{data}/prepared")
    sinks.export_xml(done, f"{data}/export")
    sinks.replace_table(relational.replace_by_key(read(spark, data, "categories", schemas.CATEGORY), done.select("urlid", F.explode("categories").alias("category"))), f"{data}/categories")
    sinks.replace_table(relational.mark(read(spark, data, "articles"), done, "processed"), f"{data}/articles")


def train(spark: SparkSession, data: str) -> None:
    labels = read(spark, data, "training_labels")
    topics = listed(labels.select("category").distinct(), "category")
    for topic, model in classify.train(read(spark, data, "training"), labels, topics).items():
        model.write().overwrite().save(f"{data}/models/{topic}")
    spark.createDataFrame([(t,) for t in topics], "topic string").write.mode("overwrite").parquet(f"{data}/topics")


def train_experiment(spark: SparkSession, data: str) -> None:
    labels, rows = read(spark, data, "training_labels"), classify.worded(read(spark, data, "training"))
    out = []
    for k, topic in enumerate(sorted(listed(labels.select("category").distinct(), "category"))):
        yes = labels.where(F.col("category") == topic).select("urlid").distinct().withColumn("label", F.lit(1.0))
        out += [(name, k, correct) for name, correct in classify.bake_off(rows.join(yes, "urlid", "left").fillna({"label": 0.0}))]
    sinks.scores_csv(spark.createDataFrame(out, schemas.EXPERIMENT), f"{data}/experiment")


def email(spark: SparkSession, data: str, as_of: dt.date, site: str, action: str = "") -> str:
    """The week's e-mail; a page to review and send it is written to ``email.html``."""
    subject, body = sinks.email_form(feeds.weekly(spark, f"{data}/weekly", site), as_of)
    sinks.save_text(spark, f"{data}/email.html", sinks.review_page(subject, body, action))
    return f"{subject}\n\n{body}"


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="skein")
    p.add_argument("command", choices=["crawl", "prepare", "email", "train", "train_experiment", "help"])
    p.add_argument("--data", default=".")
    p.add_argument("--as-of", type=dt.date.fromisoformat, default=None)
    p.add_argument("--source")
    p.add_argument("--site", default="")
    p.add_argument("--action", default="")
    args = p.parse_args(argv)
    if args.command == "help":
        return p.print_help()
    spark, day = SparkSession.builder.appName("skein").getOrCreate(), args.as_of or dt.date.today()
    if args.command == "crawl":
        crawl(spark, args.data, day, args.source)
    elif args.command == "prepare":
        prepare(spark, args.data, day)
    elif args.command == "train":
        train(spark, args.data)
    elif args.command == "train_experiment":
        train_experiment(spark, args.data)
    else:
        print(email(spark, args.data, day, args.site, args.action))
    return None


if __name__ == "__main__":
    main()
