"""RSS and Atom payloads to articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmood.functions.dates import parse_date
from newsmood.functions.text import clean_text, first_filled, or_empty
from newsmood.functions.urls import source_name
from newsmood.operators.textjobs import frequent_keywords
from newsmood.schema import ARTICLE

_TEXT = T.StringType()


def _texts(*names: str, **others: T.DataType) -> T.StructType:
    fields = dict.fromkeys(names, _TEXT) | others
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Items as they are read: plain RSS with its usual namespaces, and Atom entries.
ITEM = _texts(
    "title", "link", "content", "content:encoded", "description", "summary", "pubDate", "updated", "dc:date",
    "author", "dc:creator", "id", "guid", author_detail=_texts("name"), category=T.ArrayType(_TEXT),
)
ENTRY = _texts(
    "title", "content", "summary", "published", "updated", "id",
    link=T.ArrayType(_texts("_href", "_rel")), author=T.ArrayType(_texts("name")), category=T.ArrayType(_texts("_term")),
)
FEED = T.StructType(
    [
        T.StructField("channel", T.StructType([T.StructField("item", T.ArrayType(ITEM))])),
        T.StructField("item", T.ArrayType(ITEM)),
        T.StructField("entry", T.ArrayType(ENTRY)),
    ]
)


def _item(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def _of_rss(i: Column) -> Column:
    """One shape for all items: namespaced elements take the place of plain ones."""
    return _item(
        title=i["title"],
        link=i["link"],
        content=first_filled(i["content:encoded"], i["content"]),
        description=i["description"],
        summary=i["summary"],
        pubDate=i["pubDate"],
        updated=first_filled(i["updated"], i["dc:date"]),
        author=first_filled(i["author"], i["dc:creator"], i["author_detail"]["name"]),
        category=i["category"],
        id=i["id"],
        guid=i["guid"],
    )


def _of_atom(e: Column) -> Column:
    pages = F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    link = F.coalesce(F.get(pages, F.lit(0)), F.get(e["link"], F.lit(0)))
    none = F.lit(None).cast("string")
    return _item(
        title=e["title"],
        link=link["_href"],
        content=e["content"],
        description=none,
        summary=e["summary"],
        pubDate=e["published"],
        updated=e["updated"],
        author=F.get(e["author"], F.lit(0))["name"],
        category=F.transform(e["category"], lambda x: x["_term"]),
        id=e["id"],
        guid=none,
    )


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed RSS files, one row each, split across tasks by item."""
    rows = spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path)
    raw = F.struct(*[F.col(f"`{f.name}`") for f in ITEM])
    return rows.select(_of_rss(raw).alias("_item")).select("_item.*", F.lit("").alias("feed_url"))


def feed_items(payload: Column) -> Column:
    """Items of a whole RSS, RDF or Atom document in feed order; NULL if it is none of them."""
    feed = F.from_xml(payload, FEED)
    rss = F.transform(F.coalesce(feed["channel"]["item"], feed["item"]), _of_rss)
    return F.coalesce(rss, F.transform(feed["entry"], _of_atom), F.when(feed["channel"].isNotNull() | payload.rlike("<feed[ >]"), F.array()))


def explode_feeds(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Items of a column of whole feed documents, in feed order (``item_pos``)."""
    keep = [c for c in payloads.columns if c != payload]
    items = F.posexplode(feed_items(F.col(payload))).alias("item_pos", "_item")
    return payloads.select(*keep, items).select(*keep, "item_pos", "_item.*")


def items_to_articles(items: DataFrame, as_of: Column, *keep: str) -> DataFrame:
    """Feed items to ARTICLE rows; items without title or link are dropped.

    Content is the first filled of content, description, summary. Tags give the
    category (first) and the lower-cased keywords; without tags the five most
    frequent words of the content stand in.
    """
    c = F.col
    title = clean_text(c("title"))
    content = clean_text(first_filled(c("content"), c("description"), c("summary")))
    tags = F.filter(F.coalesce(c("category"), F.array().cast("array<string>")), lambda t: t != "")
    writer = first_filled(c("author"))
    tag_words = F.array_distinct(F.transform(tags, F.lower))
    return (
        items.where((title != "") & (or_empty(c("link")) != ""))
        .select(
            title.alias("title"),
            content.alias("content"),
            c("link").alias("url"),
            source_name(c("feed_url"), "rss").alias("source"),
            F.coalesce(
                parse_date(c("pubDate")), parse_date(c("updated")), as_of
            ).alias("published_date"),
            as_of.alias("scraped_date"),
            F.when(writer.isNotNull(), clean_text(writer)).alias("author"),
            clean_text(first_filled(c("summary"), c("description"))).alias("summary"),
            tag_words.alias("keywords"),
            F.get(c("category"), F.lit(0)).alias("category"),
            F.lit("rss").alias("source_type"),
            F.lit(None).cast(ARTICLE["sentiment"].dataType).alias("sentiment"),
            F.create_map(
                F.lit("rss_url"), c("feed_url"),
                F.lit("entry_id"), or_empty(c("id")),
                F.lit("guid"), or_empty(c("guid")),
            ).alias("metadata"),
            *keep,
        )
        .withColumn(
            "keywords",
            F.when(F.size("keywords") > 0, c("keywords")).otherwise(
                frequent_keywords(c("content"), 5)
            ),
        )
    )
