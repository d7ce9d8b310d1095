"""Article tables to and from JSON, CSV and Parquet files."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from newsmood.functions.dates import iso_text, parse_iso
from newsmood.functions.text import or_empty, reading_minutes, word_count
from newsmood.operators.stats import report_summary
from newsmood.schema import ARTICLE, LABELS, SOURCE_TYPES
from newsmood.sources.records import records

FORMAT_VERSION = "1.0"

# Columns of the CSV export, in order.
CSV_COLUMNS = (
    "title", "url", "source", "published_date", "scraped_date", "author", "summary", "content",
    "keywords", "category", "source_type", "sentiment_label", "sentiment_confidence",
)

# Dates stay text in the JSON form, so a bad one fails its record and not the file.
_JSON_FIELDS = """
    title string, content string, url string, source string, published_date string,
    scraped_date string, author string, summary string, keywords array<string>, category string,
    source_type string, metadata map<string,string>,
    sentiment struct<label: string, confidence: double, scores: map<string,double>, model_used: string>
"""


def csv_projection(df: DataFrame) -> DataFrame:
    """The 13 export columns as text: keywords joined, NULL as ''."""
    s = F.col("sentiment")
    cols = {
        **{c: or_empty(F.col(c)) for c in ("title", "url", "source", "author", "summary", "content")},
        "published_date": iso_text(F.col("published_date")),
        "scraped_date": or_empty(iso_text(F.col("scraped_date"))),
        "keywords": F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), ", "),
        "category": or_empty(F.col("category")),
        "source_type": F.col("source_type"),
        "sentiment_label": or_empty(s["label"]),
        "sentiment_confidence": or_empty(s["confidence"].cast("string")),
    }
    return df.select(*[cols[c].alias(c) for c in CSV_COLUMNS])


def report_projection(df: DataFrame) -> DataFrame:
    """The 15 columns of the spreadsheet report, typed."""
    n_words = word_count(F.col("content"))
    return df.select(
        F.col("title").alias("Title"),
        F.col("url").alias("URL"),
        F.col("source").alias("Source"),
        F.col("published_date").alias("Published Date"),
        F.col("scraped_date").alias("Scraped Date"),
        or_empty(F.col("author")).alias("Author"),
        or_empty(F.col("summary")).alias("Summary"),
        F.col("content").alias("Content"),
        F.array_join("keywords", ", ").alias("Keywords"),
        or_empty(F.col("category")).alias("Category"),
        F.col("source_type").alias("Source Type"),
        or_empty(F.col("sentiment.label")).alias("Sentiment Label"),
        F.col("sentiment.confidence").alias("Sentiment Confidence"),
        n_words.alias("Word Count"),
        reading_minutes(n_words).alias("Reading Time (min)"),
    )


def article_json(df: DataFrame) -> Column:
    """One JSON record per article, in the shape ``articles_from_json`` reads."""
    fields = [
        iso_text(F.col(f.name)).alias(f.name) if f.name.endswith("_date") else F.col(f.name)
        for f in ARTICLE.fields
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _typed(record: Column, as_of: Column) -> dict[str, Column]:
    """Columns of a parsed JSON record; absent values and bad dates get their defaults."""
    no_metadata = F.create_map().cast("map<string,string>")
    cols = {f.name: record[f.name] for f in ARTICLE.fields}
    return cols | {
        "published_date": F.coalesce(parse_iso(record["published_date"]), as_of),
        "scraped_date": F.coalesce(parse_iso(record["scraped_date"]), as_of),
        "keywords": F.coalesce(record["keywords"], F.array().cast("array<string>")),
        "source_type": F.coalesce(record["source_type"], F.lit("website")),
        "metadata": F.coalesce(record["metadata"], no_metadata),
    }


def _problem(record: Column) -> Column:
    """What keeps a parsed JSON record from being an article; NULL for a usable one."""
    need = ("title", "content", "url", "source", "published_date")
    missing = F.coalesce(*[F.when(record[c].isNull(), F.lit(f"no {c}")) for c in need])
    empty = F.lit(True)
    for c in (*need, "scraped_date", "author", "summary", "category", "source_type"):
        empty = empty & record[c].isNull()
    kind = F.coalesce(record["source_type"], F.lit("website")).isin(*SOURCE_TYPES)
    mood = record["sentiment"].isNull() | F.coalesce(record["sentiment"]["label"].isin(*LABELS), F.lit(False))
    return (
        F.when(record.isNull() | empty, "not an article")
        .when(missing.isNotNull(), missing)
        .when(~kind, "unknown source type")
        .when(~mood, "unknown sentiment label")
    )


def _usable(record: Column) -> Column:
    """Required fields are there and the closed domains hold."""
    return _problem(record).isNull()


def articles_from_json(df: DataFrame, as_of: Column, *keep: str, column: str = "json") -> DataFrame:
    """ARTICLE rows of a JSON text column; unusable records are skipped."""
    # Unpacking a one-element array parses each record once; a plain struct column
    # would be parsed again for the test and for every field.
    record = F.array(F.from_json(F.col(column), _JSON_FIELDS))
    rows = df.select(*keep, F.explode(F.filter(record, _usable)).alias("r"))
    return rows.select(*keep, *[v.alias(k) for k, v in _typed(F.col("r"), as_of).items()])


def _written(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Write rows and return their number, observed by the tasks that write them."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


def write_articles(df: DataFrame, path: str, fmt: str = "json") -> int:
    """Write a folder of part files; returns the number of articles.

    JSON is one record per line, with ``_manifest`` beside the data holding the
    export time, the total and the format version; ``report`` writes the report's
    articles and summary tables. The total is observed while writing: nothing is read again,
    but the report's rows for its summary.
    """
    fmt = fmt.lower()
    spark = df.sparkSession
    if fmt == "json":
        n = _written(df.select(article_json(df).alias("value")), lambda rows: rows.write.mode("overwrite").text(f"{path}/articles"))
        info = spark.range(1).select(
            F.current_timestamp().alias("timestamp"),
            F.lit(n).alias("total_articles"),
            F.lit(FORMAT_VERSION).alias("format_version"),
        )
        info.write.mode("overwrite").json(f"{path}/_manifest")
    elif fmt == "csv":
        options = {"header": "true", "escape": '"', "quoteAll": "true", "emptyValue": "", "lineSep": "\n"}
        n = _written(csv_projection(df), lambda rows: rows.write.mode("overwrite").options(**options).csv(path))
    elif fmt == "parquet":
        n = _written(df, lambda rows: rows.write.mode("overwrite").parquet(path))
    elif fmt == "report":
        report = report_projection(df)
        names = [c.lower().replace(" (min)", "").replace(" ", "_") for c in report.columns]
        n = _written(report.toDF(*names), lambda rows: rows.write.mode("overwrite").parquet(f"{path}/articles"))
        # The summary sheet comes from the written rows, so scores are not computed again.
        rows = spark.read.parquet(f"{path}/articles").withColumn(
            "sentiment_label", F.nullif("sentiment_label", F.lit(""))
        )
        report_summary(rows).coalesce(1).write.mode("overwrite").parquet(f"{path}/summary")
    else:
        raise ValueError(f"Unsupported export format: {fmt}")
    return n


def read_json(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """Articles of line-per-record JSON: one pass over the lines, nothing to look for."""
    lines = spark.read.text(path).withColumnRenamed("value", "json")
    return articles_from_json(lines, as_of)


def _csv_article(c: Column, as_of: Column) -> dict[str, Column]:
    """Columns of a parsed CSV record."""
    keywords = F.filter(F.transform(F.split(or_empty(c["keywords"]), ","), lambda k: F.trim(k)), lambda k: k != "")
    sentiment = F.struct(
        c["sentiment_label"].alias("label"),
        c["sentiment_confidence"].try_cast("double").alias("confidence"),
        F.create_map().cast("map<string,double>").alias("scores"),
        F.lit("").alias("model_used"),
    )
    return {
        **{x: c[x] for x in ("title", "content", "url", "source")},
        "published_date": F.coalesce(parse_iso(c["published_date"]), as_of),
        "scraped_date": F.coalesce(parse_iso(c["scraped_date"]), as_of),
        **{x: F.nullif(c[x], F.lit("")) for x in ("author", "summary")},
        "keywords": keywords,
        "category": F.nullif(c["category"], F.lit("")),
        "source_type": F.coalesce(F.nullif(c["source_type"], F.lit("")), F.lit("website")),
        "sentiment": F.when(c["sentiment_label"].isin(*LABELS), sentiment),
        "metadata": F.create_map().cast("map<string,string>"),
    }


def import_records(spark: SparkSession, path: str, as_of: Column, fmt: str) -> DataFrame:
    """Every record of JSON (any layout) or CSV files with what came of it.

    ``file, start, nth`` say where it begins, ``record`` is its text; then either ``article`` is set
    or ``problem`` says why there is none. ``accepted`` and ``rejected`` take it apart; write it
    first to have both at the cost of one import.
    """
    found = records(spark, path, fmt)
    if fmt == "json":
        parsed = found.withColumn("parsed", F.from_json("record", _JSON_FIELDS))
        problem, columns = _problem(F.col("parsed")), _typed(F.col("parsed"), as_of)
    else:
        options = {"escape": '"', "emptyValue": "", "nullValue": "\u0000", "lineSep": "\u0001", "columnNameOfCorruptRecord": "_bad"}
        fields = ", ".join(f"{c} string" for c in (*CSV_COLUMNS, "_bad"))
        header = (F.col("start") == 0) & (F.col("nth") == 0)
        parsed = found.where(~header).withColumn("parsed", F.from_csv("record", fields, {**options, "multiLine": "true"}))
        record = F.col("parsed")
        missing = F.coalesce(*[F.when(record[c].isNull(), F.lit(f"no {c}")) for c in ("title", "url")])
        problem = F.when(record["_bad"].isNotNull(), "wrong number of fields").otherwise(missing)
        columns = _csv_article(record, as_of)
    article = F.struct(*[columns[f.name].alias(f.name) for f in ARTICLE.fields])
    judged = parsed.withColumn("problem", problem)
    return judged.select("file", "start", "nth", "record", "problem", F.when(F.col("problem").isNull(), article).alias("article"))


def accepted(imported: DataFrame) -> DataFrame:
    """Articles of imported records."""
    return imported.where("problem IS NULL").select("article.*")


def rejected(imported: DataFrame) -> DataFrame:
    """The quarantine: records that are no articles, where they stand and why."""
    return imported.where("problem IS NOT NULL").select("file", "start", "nth", "record", "problem")


def read_csv(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """Articles of CSV files with a header; quoted line breaks are allowed, and files split."""
    return accepted(import_records(spark, path, as_of, "csv"))


def read_articles(spark: SparkSession, path: str, as_of: Column, fmt: str | None = None) -> DataFrame:
    """Import by format, taken from the file suffix when not given.

    ``json`` is any layout, told by content: an object with a list of ``articles``, a list, or a
    record a line. Unusable records are left out; ``import_records`` keeps them aside.
    """
    fmt = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if fmt in ("jsonl", "ndjson"):
        return read_json(spark, path, as_of)
    if fmt in ("json", "csv"):
        return accepted(import_records(spark, path, as_of, fmt))
    if fmt == "parquet":
        return spark.read.schema(ARTICLE).parquet(path)
    raise ValueError(f"Unsupported file format: {fmt}")


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The export manifest: a single small record."""
    row = spark.read.json(f"{path}/_manifest").first()
    return json.loads(json.dumps(row.asDict(), default=str))
