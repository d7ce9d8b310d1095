"""Articles by a table of keywords of any size, as literal substrings, ignoring case.

Texts and keywords are taken as runs of characters that are either all blank or none. A keyword of
one run lies inside a run of the text; in a longer one the first run ends a run of the text, the
last one begins one, and those between are whole. So an index over the distinct runs of all texts
(the vocabulary) finds both. It lists the pieces of each run up to ``GRAM`` characters; a keyword is
anchored by its rarest piece of the largest size it has, counted by the places of the runs that hold
it. Anchors meet the index by equality, hot pieces dealt out by salt. What is left are few (run,
keyword) pairs: a keyword of one run is then decided, a longer one is looked up once in each text
that holds its run.

A keyword with two words or more between its first and last run has them whole and next to each
other in the text. Such keywords meet the texts by pairs of neighbouring words instead, each by its
rarest pair, and are looked up in the texts that hold it; where all keywords are of this kind there
is no vocabulary. No step depends on the number of keywords, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmood.functions.text import NOT_WS, WS, let, or_empty
from newsmood.session import work_path

GRAM = 4
SALTS = 16
COPY_SALTS = 32
_RUN = f"{WS}+|{NOT_WS}+"


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))


def _pieces(run: Column, size: Column | int) -> Column:
    """Distinct pieces of a run of exactly this size; none of a shorter run."""
    places = F.when(F.length(run) >= size, F.sequence(F.lit(1), F.length(run) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substr(run, i, F.lit(size) if isinstance(size, int) else size)))


def _links(words: Column) -> Column:
    """Hashes of the distinct pairs of neighbouring words; none of fewer than two words."""
    pairs = F.transform(F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 1)), lambda w, i: F.xxhash64(w, F.get(words, i + 1)))
    return F.array_distinct(pairs)


def _inner_words(runs: Column) -> Column:
    """The words between the first and the last run."""
    return F.filter(F.slice(runs, 2, F.greatest(F.lit(0), F.size(runs) - 2)), lambda r: r.rlike(f"^{NOT_WS}"))


def _article_text() -> Column:
    return F.lower(F.concat(or_empty(F.col("title")), F.lit(" "), or_empty(F.col("content"))))


def _article_key() -> Column:
    """128 bits that copies of an article share."""
    row = [or_empty(F.col(c)) for c in ("url", "title", "content")]
    return F.struct(F.xxhash64(*row).alias("a"), F.xxhash64(F.lit("second"), *row).alias("b"))


def _pieces_of(terms: DataFrame) -> DataFrame:
    """``_kw, _words, _gram``: each keyword with its pieces of the largest size it has."""
    split = terms.withColumn("_words", _runs(F.col("_kw")))
    longest = F.array_max(F.transform("_words", lambda r: F.length(r)))
    grams = F.array_distinct(F.flatten(F.transform("_words", lambda r: _pieces(r, F.least(F.lit(GRAM), F.col("_size"))))))
    return split.withColumn("_size", longest).select("_kw", "_words", F.explode(grams).alias("_gram"))


def _anchors(pieces: DataFrame, index: DataFrame) -> DataFrame:
    """``_kw, _words, _gram``: each keyword with its rarest piece."""
    mass = index.groupBy("_gram").agg(F.sum("_n").alias("_mass"))
    # A piece that no text holds rules its keyword out, so it is the rarest there is.
    counted = pieces.join(mass, "_gram", "left").select("_kw", "_words", F.struct(F.coalesce("_mass", F.lit(0)).alias("mass"), "_gram").alias("_least"))
    best = counted.groupBy("_kw").agg(F.min("_least").alias("_least"), F.first("_words").alias("_words"))
    return best.where("_least.mass > 0").select("_kw", "_words", F.col("_least._gram").alias("_gram"))


def _run_fits() -> Column:
    """Whether the run of a text may hold the anchored part of the keyword."""
    n, run, gram = F.size("_words"), F.col("_run"), F.col("_gram")
    place = lambda r, i: F.when(i == 0, F.endswith(run, r)).when(i == n - 1, F.startswith(run, r)).otherwise(run == r)
    return F.when(n == 1, F.contains(run, F.col("_kw"))).otherwise(
        F.exists(F.transform("_words", lambda r, i: F.contains(r, gram) & place(r, i)), lambda x: x)
    )


def _by_links(keyed: DataFrame, terms: DataFrame) -> DataFrame:
    """``_row, _kw``: texts that hold the rarest pair of neighbouring words of a keyword."""
    spark = keyed.sparkSession
    pieces = terms.select("_kw", F.explode("_links").alias("_link"))
    words = F.regexp_extract_all(_article_text(), F.lit(f"{NOT_WS}+"), F.lit(0))
    held = keyed.select("_row", F.explode(let(words, _links)).alias("_link"))
    path = work_path(spark, "keyword-links")
    held.join(pieces.select("_link").distinct(), "_link", "left_semi").write.parquet(path)
    held = spark.read.parquet(path)
    mass = held.groupBy("_link").agg(F.count(F.lit(1)).alias("_mass"))
    # A pair that no text holds rules its keyword out, so it is the rarest there is.
    counted = pieces.join(mass, "_link", "left").groupBy("_kw").agg(F.min(F.struct(F.coalesce("_mass", F.lit(0)).alias("mass"), "_link")).alias("_least"))
    anchors = counted.where("_least.mass > 0").select("_kw", F.col("_least._link").alias("_link"))
    salt = F.pmod(F.col("_row.a"), F.lit(SALTS)).cast("int").alias("_salt")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    path = work_path(spark, "keyword-candidates")
    held.select("*", salt).join(anchors.select("*", every), ["_link", "_salt"]).select("_row", "_kw").distinct().write.parquet(path)
    return spark.read.parquet(path)


def _by_runs(keyed: DataFrame, terms: DataFrame) -> DataFrame:
    """``_row, _kw``: texts that hold a run which may hold the anchored part of a keyword; with a null
    keyword those that hold a whole one."""
    spark = keyed.sparkSession
    runs = keyed.select("_row", F.explode(F.array_distinct(_runs(_article_text()))).alias("_run"))
    path = work_path(spark, "keyword-vocabulary")
    runs.groupBy("_run").agg(F.count(F.lit(1)).alias("_n")).write.parquet(path)
    vocabulary = spark.read.parquet(path)
    index = vocabulary.select("_run", "_n", F.explode(F.flatten(F.array(*[_pieces(F.col("_run"), k) for k in range(1, GRAM + 1)]))).alias("_gram"))
    pieces = _pieces_of(terms)
    # Of the index only the pieces of keywords are of use.
    index = index.join(pieces.select("_gram").distinct(), "_gram", "left_semi")
    path = work_path(spark, "keyword-index")
    index.write.parquet(path)
    index = spark.read.parquet(path)
    anchors = _anchors(pieces, index)

    salt = F.pmod(F.xxhash64("_run"), F.lit(SALTS)).cast("int").alias("_salt")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    held = index.select("_run", "_gram", salt).join(anchors.select("*", every), ["_gram", "_salt"]).where(_run_fits())
    # A run that holds a whole keyword settles its texts; others are asked about the rest.
    open_kw = F.when(F.size("_words") > 1, F.col("_kw")).alias("_kw")
    asked = held.select("_run", open_kw).distinct()
    path = work_path(spark, "keyword-candidates")
    runs.join(asked, "_run").select("_row", "_kw").distinct().write.parquet(path)
    return spark.read.parquet(path)


def keyword_semi_join(df: DataFrame, keywords: DataFrame, column: str = "keyword") -> DataFrame:
    """Articles that contain any keyword of a table (case ignored); empty and null ones match none."""
    spark = df.sparkSession
    terms = keywords.select(F.lower(F.col(column)).alias("_kw")).where("_kw <> ''").distinct()
    terms = terms.select("_kw", let(_inner_words(_runs(F.col("_kw"))), _links).alias("_links"))
    path = work_path(spark, "keyword-terms")
    terms.write.parquet(path)
    terms = spark.read.schema(terms.schema).parquet(path)
    keyed = df.withColumn("_row", _article_key())
    long, short = terms.where(F.size("_links") > 0), terms.where(F.size("_links") == 0).select("_kw")
    maybe = _by_links(keyed, long)
    if not short.isEmpty():
        maybe = maybe.unionByName(_by_runs(keyed, short))
    settled = maybe.where("_kw IS NULL").select("_row").distinct()
    rest = maybe.where("_kw IS NOT NULL").join(settled, "_row", "left_anti")
    wanted = rest.select("_row").distinct()
    texts = keyed.select("_row", _article_text().alias("_text")).join(wanted, "_row", "left_semi").dropDuplicates(["_row"])
    checked = rest.join(texts, "_row").where("contains(_text, _kw)").select("_row")
    found = settled.unionByName(checked).distinct()
    # Copies of one article may be many: they are spread by salt, the hits repeated per salt.
    salt = (F.spark_partition_id() % COPY_SALTS).cast("int").alias("_salt")
    every = F.explode(F.sequence(F.lit(0), F.lit(COPY_SALTS - 1))).alias("_salt")
    return keyed.select("*", salt).join(found.select("_row", every), ["_row", "_salt"], "left_semi").drop("_row", "_salt")
