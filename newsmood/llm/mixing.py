"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's documents are put in a random order (by a seeded hash of the row) and their words
form one stream. A source gives its target: the stream is read from its start, a second time if
the target is larger than the source, and cut into blocks of equal word count; the blocks needed
are the source's quota. The quotas of all sources start at the root of a binary tree over the
output shards. Each node deals its blocks to its halves without replacement: a block goes left
with probability (left places still open) / (blocks still to deal), which draws the sources' shares
from the multivariate hypergeometric distribution and keeps every quota exact. A leaf then takes
the next blocks of each source, so no block is drawn twice, and its rows are shuffled locally. A
document belongs whole to the block in which it begins; only the end of a quota cuts one, by the
words that are left, its white space kept.

Everything is DataFrame and SQL expressions. Places in the streams are worked out on rows without
texts, by running sums within small hash buckets on top of running sums over buckets. As the order
is that of a hash, where a source's shards begin and its quota ends are borders of the hash: ``mix``
finds each document's shards by them where it reads it, and shuffles a text once, into its shard.
Single tasks see one row per source, or the tree's block counts (``MAX_BLOCKS`` at most in all, as
the block size grows with the corpus).

A null text has size 0 and a null source is a source of its own, last in order; documents of
size 0 are never drawn; equal rows are drawn each for itself, but those at the end of a quota, of
which ``mix`` takes about as many as it has room for; ties in the random order go by id and size;
an empty table gives no rows. A column named ``mix_shard`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmood.llm.words import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 17
MAX_BLOCKS = 1 << 16
MIN_BLOCK_WORDS = 2048
SHARD_WORDS = 20_000_000
BUCKET_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text, 0 if null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``rank, target`` beside the columns of ``sizes`` (source, n_rows, source_size).

    Weights repeat over the sources in order. A target is the smaller of ``most`` times the
    source and its weight times one level, which resharing the excess by weight ends at.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.orderBy("_full", "rank")
    before, rest = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = sizes.withColumn("rank", F.row_number().over(order)).withColumns(
        {
            "_weight": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")),
            "_most": F.col("source_size") * F.lit(float(most)),
            "_total": total * F.lit(float(share)),
        }
    )
    ranked = ranked.withColumn("_full", F.col("_most") / F.col("_weight"))  # the level at which it is full
    leveled = ranked.withColumn(
        "_level", (F.col("_total") - F.coalesce(F.sum("_most").over(before), F.lit(0.0))) / F.sum("_weight").over(rest)
    )
    level = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "rank", "_level"))).over(
        Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )["_level"]
    return leveled.withColumn("target", F.coalesce(F.least("_most", F.col("_weight") * level), F.col("_most"))).drop(
        "_weight", "_most", "_total", "_full", "_level"
    )


def _uniform(*parts) -> Column:
    """A repeatable number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def split(quotas: DataFrame, levels: int, seed: int = SEED) -> DataFrame:
    """``shard, rank, q`` from ``rank, q``: the tree, one level after the other."""
    nodes = quotas.select(F.lit(0).cast("long").alias("shard"), "rank", F.col("q").cast("long").alias("q"))

    def dealt(state, item, depth):
        """The blocks of one source of a node, one by one."""
        first = F.struct(state["blocks"].alias("blocks"), state["places"].alias("places"), F.lit(0).cast("long").alias("left"))

        def one(s, i):
            hit = (_uniform(F.lit(seed), F.lit(depth), F.col("shard"), item["rank"], i) * s["blocks"] < s["places"]).cast("long")
            return F.struct((s["blocks"] - 1).alias("blocks"), (s["places"] - hit).alias("places"), (s["left"] + hit).alias("left"))

        done = F.aggregate(F.slice(F.sequence(F.lit(0).cast("long"), item["q"]), F.lit(2), item["q"].cast("int")), first, one)
        # Struct fields are read through a one-element array, so that the fold runs once.
        return F.element_at(
            F.transform(
                F.array(done),
                lambda d: F.struct(
                    d["blocks"].alias("blocks"),
                    d["places"].alias("places"),
                    F.concat(state["out"], F.array(F.struct(item["rank"].alias("rank"), d["left"].alias("l"), (item["q"] - d["left"]).alias("r")))).alias("out"),
                ),
            ),
            1,
        )

    def level(depth):
        return lambda s, x: dealt(s, x, depth)

    for depth in range(levels):
        items = nodes.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("rank", "q"))).alias("items"), F.sum("q").alias("n"))
        start = F.struct(
            F.col("n").alias("blocks"),
            F.floor((F.col("n") + 1) / 2).cast("long").alias("places"),
            F.lit([]).cast("array<struct<rank:int,l:long,r:long>>").alias("out"),
        )
        halves = items.select("shard", F.explode(F.aggregate("items", start, level(depth), lambda s: s["out"])).alias("x"))
        nodes = halves.select(
            F.explode(
                F.array(
                    F.struct((F.col("shard") * 2).alias("shard"), F.col("x.rank").alias("rank"), F.col("x.l").alias("q")),
                    F.struct((F.col("shard") * 2 + 1).alias("shard"), F.col("x.rank").alias("rank"), F.col("x.r").alias("q")),
                )
            ).alias("y")
        ).select("y.*")
    return nodes


def _order(docs: DataFrame, doc_id: str, text: str, seed: int) -> Column:
    """A row's place in the random order of its source: a hash, then id and size."""
    return F.struct(
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), docs[doc_id], docs[text]), 1).alias("hash"),
        docs[doc_id].cast("string").alias("id"),
        size_of(docs[text]).alias("size"),
    )


def _streams(docs: DataFrame, text: str, source: str, weights, share, most, seed: int, shard_words: int, max_blocks: int) -> DataFrame:
    """One row per source: ``source, source_size, target, rank``, the ``words`` of its quota, its
    hash ``buckets``, and ``shards``: the words at which each shard's part of the quota begins."""
    sizes = docs.select(docs[source].alias("source"), size_of(docs[text]).alias("size"))
    sizes = sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    sources = targets(sizes, weights, share, most).withColumns(
        {"words": F.round("target").cast("long"), "buckets": F.ceil(F.col("n_rows") / BUCKET_ROWS).cast("long")}
    )
    sources = written(sources, "mix-sources")
    total = sources.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    block = max(MIN_BLOCK_WORDS, -(-total // max_blocks))
    levels = max(0, (max(1, -(-total // shard_words)) - 1).bit_length())
    shards = split(sources.select("rank", F.ceil(F.col("words") / block).alias("q")), levels, seed)
    until = F.sum("q").over(Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    parts = shards.withColumn("until", until).where("q > 0").groupBy("rank")
    begin = F.struct(((F.col("until") - F.col("q")) * block).alias("begin"), "shard")
    return written(sources.join(parts.agg(F.sort_array(F.collect_list(begin)).alias("shards")), "rank", "left"), "mix-streams")


def _placed(rows: DataFrame, streams: DataFrame, most: float) -> DataFrame:
    """``rows`` (order, source and others) with their source's columns and ``copies``: for each time
    a document is taken its copy, where it begins, the words taken, and its shard. ``nth`` of
    ``alike`` counts equal rows."""
    # A bucket is a range of hashes, so buckets and the rows in them stand in one order.
    bucket = F.floor(F.col("order.hash") / F.lit(float(1 << 63)) * F.col("buckets"))
    of = rows.join(streams.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).withColumn("bucket", bucket)
    sums = of.groupBy("rank", "bucket").agg(F.sum("order.size").alias("_n"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("rank").alias("_rank"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    sums = written(sums, "mix-buckets")
    within = Window.partitionBy("rank", "bucket").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_base") + F.coalesce(F.sum("order.size").over(within), F.lit(0))
    same = Window.partitionBy("rank", "bucket", "order")
    placed = of.join(sums, (F.col("rank") == F.col("_rank")) & (F.col("bucket") == F.col("_bucket"))).withColumn("at", at)
    placed = placed.withColumns({"alike": F.count("*").over(same), "nth": (F.col("at") - F.min("at").over(same)) / F.col("order.size") + 1})

    def taken(copy: int) -> Column:
        begin = F.col("at") + copy * F.col("source_size")
        shard = F.try_element_at(F.filter("shards", lambda s: s["begin"] <= begin), F.lit(-1))["shard"]
        n = F.least(F.col("order.size"), F.col("words") - begin)
        return F.when(n > 0, F.struct(F.lit(copy).alias("copy"), begin.alias("begin"), n.alias("n"), shard.alias("shard")))

    copies = F.array_compact(F.array(*[taken(k) for k in range(max(1, -int(-most // 1)))]))
    return placed.withColumn("copies", copies).drop("_rank", "_bucket", "_base", "_source", "bucket", "at")


def draw(
    docs: DataFrame,
    keep: list[str],
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = SEED,
    shard_words: int = SHARD_WORDS,
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """The plan of the mix, a row per document: ``doc`` (a struct of the kept columns), ``size,
    source_size, target`` and ``copies`` (copy, begin, n, shard), empty if it is not drawn."""
    streams = _streams(docs, text, source, weights, share, most, seed, shard_words, max_blocks)
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("doc"), docs[source].alias("source"), _order(docs, doc_id, text, seed).alias("order"))
    return _placed(rows, streams, most).select("doc", F.col("order.size").alias("size"), "source_size", "target", "copies")


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = SEED,
    shard_words: int = SHARD_WORDS,
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """The mixed corpus: the documents' columns, the text cut where a quota ends, and ``shard``
    (``mix_shard``), each shard's rows together and in random order."""
    streams = _streams(docs, text, source, weights, share, most, seed, shard_words, max_blocks)
    rows = docs.select(docs[source].alias("source"), _order(docs, doc_id, text, seed).alias("order"))
    placed = _placed(rows, streams, most).select("rank", "order", "nth", "alike", F.explode("copies").alias("c"))
    # Borders of the order: where the shards of a copy begin, and its last document with its words.
    first = placed.groupBy("rank", "c.copy", "c.shard").agg(F.min("order").alias("order"), F.max(F.struct("order", "nth", "c.n", "alike")).alias("last"))
    border = F.struct("copy", "order", "shard")
    ends = first.groupBy("rank", "copy").agg(F.sort_array(F.collect_list(border)).alias("borders"), F.max("last").alias("last"))
    passes = F.sort_array(F.collect_list(F.struct("copy", "borders", "last")))
    borders = written(ends.groupBy("rank").agg(passes.alias("passes")).join(streams.select("rank", "source"), "rank").select("source", "rank", "passes"), "mix-borders")

    own = [c for c in docs.columns if c != "mix_shard"]
    whole = docs.select(F.struct(*[docs[c] for c in own]).alias("doc"), docs[source].alias("_source"), _order(docs, doc_id, text, seed).alias("order"), F.monotonically_increasing_id().alias("row"))
    known = whole.join(borders, F.col("_source").eqNullSafe(F.col("source")))

    def taken(p: Column) -> Column:
        last = p["last"]
        alone = last["alike"] == 1
        n = F.when((F.col("order") == last["order"]) & alone, last["n"]).otherwise(F.col("order.size"))
        # Of equal rows at a quota's end as large a share is taken as the quota has room for.
        lucky = (F.col("order") < last["order"]) | alone | (_uniform(F.lit(seed), "row", p["copy"]) * last["alike"] < last["nth"])
        shard = F.try_element_at(F.filter(p["borders"], lambda b: b["order"] <= F.col("order")), F.lit(-1))["shard"]
        return F.when((F.col("order") <= last["order"]) & lucky & (F.col("order.size") > 0), F.struct(p["copy"].alias("copy"), n.alias("n"), shard.alias("shard")))

    drawn = known.select("doc", "order", "row", "rank", F.explode(F.array_compact(F.transform("passes", taken))).alias("c"))
    # Words with the white space before them, so that a cut text keeps its own.
    parts = F.regexp_extract_all(F.col("doc")[text], F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.when(F.col("c.n") == F.col("order.size"), F.col("doc")[text]).otherwise(F.array_join(F.slice(parts, 1, F.col("c.n").cast("int")), ""))
    place = F.xxhash64(F.lit(seed + 1), "rank", "order.hash", "order.id", "c.copy")
    out = drawn.select("doc", cut.alias("text"), F.col("c.shard").alias("shard"), place.alias("place"))
    dealt = out.repartition("shard", F.pmod("place", F.lit(16))).sortWithinPartitions("shard", "place")
    return dealt.select(*[F.col("text").alias(c) if c == text else F.col("doc")[c].alias(c) for c in own], F.col("shard").alias("mix_shard"))
