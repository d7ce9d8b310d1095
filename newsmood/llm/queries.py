"""Registered queries of the operators in this package, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmood.functions.text import let
from newsmood.llm import chat as H
from newsmood.llm import decontaminate as D
from newsmood.llm import embeddings as E
from newsmood.llm import jaccard as J
from newsmood.llm import licenses as L
from newsmood.llm import mixing as M
from newsmood.llm import periodic as R
from newsmood.llm import phrases as N
from newsmood.llm import pii as P
from newsmood.llm import quality as C
from newsmood.llm import secrets as S
from newsmood.llm import tokens as K
from newsmood.llm import warc as W
from newsmood.llm.words import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(
        "spans", F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"] + F.lit(1)
    )
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def _joined(spans):
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _digest(spans):
    return F.sha2(_joined(spans).cast("binary"), 256)


def _kind_count(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _by_place(kinds: tuple[str, ...], *spans: str):
    """All spans by start, then kind in the given order."""
    ranked = F.transform(
        F.concat(*spans), lambda s: F.struct(s["start"], F.array_position(F.lit(list(kinds)), s["kind"]), s["end"], s["kind"])
    )
    return F.transform(F.array_sort(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[_kind_count("base", k) for k in P.KINDS],
        _digest("base").alias("base_sha256"),
        _joined(_by_place((*P.KINDS, "term"), "base", "terms")).alias("spans"),
    )


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[_kind_count("base", k) for k in S.KINDS],
        _digest("base").alias("base_sha256"),
        _joined(_by_place((*S.KINDS, "markov"), "base", "random")).alias("spans"),
    )


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    index = W.build_index(W.write_archives(pages))
    records = W.read_records(W.lookup(index, W.keys_of(pages)), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = M.draw(table(spark, sf_dir, "documents"), ["doc_id"])
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["n"])
    return drawn.select("doc.doc_id", "size", "source_size", "target", taken.alias("taken"))


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["first"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        "score",
    )


@query
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.join_components(table(spark, sf_dir, "documents"), k=4, threshold=Fraction(85, 100))


@query
def op9_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.token_counts(table(spark, sf_dir, "documents"), K.vocabulary())


@query
def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / F.lit(10))

    def tail(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        place = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " ")).otherwise("")

    text = F.when(h % 10 == 0, let(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), tail)).otherwise(F.col("text"))
    found = R.collapse(docs.select("doc_id", text.alias("text")), digest=True)
    order = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", F.get(order, F.lit(0))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("(1000 * -best.l) div best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


@query
def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], rows.schema)
    return H.digests(written(H.format_chats(rows.unionByName(more)), "chats", compression="zstd"))


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.collocations(table(spark, sf_dir, "documents"))
