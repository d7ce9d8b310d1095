"""Connected components of an edge table by alternating stars, and bit tables of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood.llm.words import written


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of every node of the edges ``a, b``.

    Every round links each node's larger neighbours, then its smaller ones, to the smallest
    neighbour, until the edges are stars around the smallest nodes; rounds grow with the
    logarithm of the path lengths. Minima are partial aggregates, so a node with very many
    neighbours is no hot key, and each round's edges are a written table. No round is run to
    see that the one before was the last, and none reads a part of its plan twice for a union:
    what the driver holds for plans and their exchanges does not depend on the rows.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars"
    )
    while not are_stars(now):
        # u > v in every edge: a node's smallest neighbour is its least v, or it has larger ones only.
        least = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
        large = now.join(least, now["v"] == least["node"], "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array("v", "u")).alias("u")
        now = written(large.join(least, "u").select(ends, F.col("m").alias("v")).where("u <> v").distinct(), "stars")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def are_stars(edges: DataFrame) -> bool:
    """Whether each larger end ``u`` has one edge and is no smaller end ``v`` of another."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("large")), F.struct(F.col("v").alias("node"), F.lit(0).alias("large"))))
    nodes = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.large").alias("n"), F.min("e.large").alias("small"))
    return not nodes.agg(F.bool_or((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("small") == 0)))).first()[0]


BITS = 26


def bit_table(values: DataFrame, column: str, bits: int = BITS) -> np.ndarray | None:
    """A table of 2^bits bits with those set that longs of the column end in, packed; None if
    there are no values. At most 2^bits / 8 bytes reach the driver, however many values there are."""
    place = F.pmod(column, F.lit(1 << bits)) + 1  # buckets and bits count from 1
    rows = (
        values.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        .toArrow()  # the driver's JVM passes bytes on: neither rows nor pickled copies of the bits
    )
    if not rows.num_rows:
        return None
    packed = np.zeros((1 << bits) // 8, np.uint8)
    for bucket, held in zip(rows.column("bucket").to_pylist(), rows.column("bits"), strict=True):
        a = (bucket - 1) * 4096
        packed[a : a + 4096] = np.frombuffer(held.as_buffer(), np.uint8)
    return packed


def bit_set(packed: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each 64-bit value, whether its bit is set."""
    at = values.astype(np.uint64) & np.uint64(8 * len(packed) - 1)
    return (packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
