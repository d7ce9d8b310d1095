"""Embedding near-duplicates by collision counting on sorted one-dimensional projections.

Unit vectors whose cosine reaches the threshold are r = sqrt(2 - 2 cosine) apart at most. On the
axes of a random rotation the squares of their differences add up to r * r at most, so on no more
than ``d / WINDOW ** 2`` of the d axes do they differ by more than ``WINDOW * r / sqrt(d)``. A window
of that width around the query holds the other one on all other axes: a count below that is proof
that a pair does not link, and no link is lost by counting.

1. Equal vectors are one class with a count; classes are what follows works on.
2. The classes are split in hashed blocks, and pairs of blocks are dealt to tasks: few blocks, so
   that a vector is sent to few tasks, but enough to keep the cores busy and ``HELD`` bytes in a block.
3. In a pair of blocks the members of one are sorted along each axis; the window of every member of
   the other is read from that order, in 256 parts of equal size rounded outwards, and collisions
   are counted for each pair. Pairs with the count that links imply are verified in double precision.

Every two vectors are counted, as exact links need where no axis separates them: the work grows with
the square of the number of vectors, memory does not. With ``recall`` below 1 cells bound what a
vector is compared with: in each of ``tables`` tables, ``depth`` projections with random offsets are
cut in cells of ``CELL`` times r, see ``plan``; pairs in no common cell, at most 1 - recall of those
at the least cosine, are then left out. Each pair counts in the first table that brings it together.

Tasks send, for each vector, a count and the smallest member of all that links join it with in a pair
of blocks, never pairs. Both ends of a link are in one of these stars, so the components of the stars
are those of the links. Every vector is indexed.

A null or zero vector and one with null or non-finite components link with nothing. Vectors of
different lengths never link: each length is a part of its own. Rows with a null id count as partners but
have a null component. Equal rows each have a row; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmood.llm.components import components
from newsmood.llm.words import pick, written

COSINE = 0.9
RECALL = 1.0
CELL = 4.0
CROWD = 30
WINDOW = 2.0
BLOCK = 1 << 16  # rows of a block at most, on average
HELD = 1 << 25  # bytes of a block's vectors at most, on average
SMALL = 1024  # rows below which no block is split to keep cores busy
TASKS = 4096
TILE = (32, 4096)  # pairs counted at once
SEED = 23


def _normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def same_cell(c: float) -> float:
    """Chance that two points share a cell of width c times the distance's deviation."""
    return 1 - 2 * _normal_cdf(-c) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def plan(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """(depth, tables): projections in a cell, and tables. One cell holds all if no pair may be lost."""
    if recall >= 1:
        return 0, 1
    r = math.sqrt(2 - 2 * cosine)
    near, far = same_cell(CELL), same_cell(CELL * r / math.sqrt(2))
    depth = max(1, math.ceil(math.log(max(n / CROWD, 1)) / -math.log(far)))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - near**depth)) if near**depth < recall else 1
    return depth, tables


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Times a power of two that neither overflows nor vanishes when squared; cosines stay the same."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = _scaled(vectors)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def _by_length(lengths: np.ndarray):
    """Each length with its places."""
    for dim in np.unique(lengths).tolist():
        yield dim, np.flatnonzero(lengths == dim)


def _cells(rows: DataFrame, depth: int, tables: int, r: float, seed: int) -> DataFrame:
    """The rows (class, vector, ..) with ``dim`` and ``keys``: a 32-bit key of the vector's cell in
    each table."""
    schema = T.StructType([*rows.schema, *T.StructType.fromDDL("dim int, keys array<int>").fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            lengths = np.asarray(batch.column(1).value_lengths())
            for dim, at in _by_length(lengths):
                part = batch.take(pa.array(at))
                rng = np.random.default_rng((seed, dim))
                to, shift = rng.standard_normal((dim, tables * depth)), rng.uniform(0, 1, tables * depth)
                factors = rng.integers(1, 1 << 63, (tables, depth), dtype=np.uint64) | np.uint64(1)
                place = np.floor(_unit(_matrix(part.column(1), dim)) @ to / (CELL * r) + shift).astype(np.int64).astype(np.uint64)
                mixed = (place.reshape(part.num_rows, tables, depth) * factors).sum(axis=2, dtype=np.uint64)
                keys = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * tables)
                lists = pa.ListArray.from_arrays(ends, pa.array(keys.ravel())).cast(arrow.field(len(arrow) - 1).type)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, dim, np.int32)), lists], schema=arrow)

    return rows.mapInArrow(run, schema)


def _collisions(p: np.ndarray, q: np.ndarray, width: float, least: int):
    """Places (u, v) of members of p and q with ``least`` or more common windows, tile by tile.

    Along each axis q's members are sorted; its order is read in up to 256 parts of equal size, and a
    query's window is the stretch of parts that it touches."""
    dim = p.shape[1]
    ranked = np.sort(q, axis=0)
    starts = ranked[np.unique(np.linspace(0, len(q) - 1, min(len(q), 256)).astype(np.int64))]
    part, begin, span = np.empty((dim, len(q)), np.uint8), np.empty((len(p), dim), np.uint8), np.empty((len(p), dim), np.uint8)
    for j in range(dim):
        at = lambda x: np.maximum(np.searchsorted(starts[:, j], x, "right") - 1, 0)  # noqa: B023, E731
        part[j] = at(q[:, j])
        begin[:, j] = low = at(p[:, j] - width)
        span[:, j] = at(p[:, j] + width) - low
    count = np.uint8 if dim < 256 else np.uint32
    for u in range(0, len(p), TILE[0]):
        lo, size = begin[u : u + TILE[0]], span[u : u + TILE[0]]
        for v in range(0, len(q), TILE[1]):
            parts = part[:, v : v + TILE[1]]
            away = np.empty((len(lo), parts.shape[1]), np.uint8)
            inside = away.view(bool)
            counts = np.zeros(away.shape, count)
            for j in range(dim):
                np.subtract(parts[j], lo[:, j, None], out=away)  # wraps around below the window
                np.less_equal(away, size[:, j, None], out=inside)
                np.add(counts, away, out=counts)
            a, b = np.nonzero(counts >= least)
            if len(a):
                yield u + a, v + b


def _ends(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The smallest place that each place is joined with so far; the ways there are halved."""
    while not np.array_equal(up := parent[at], at):
        parent[at] = parent[up]
        at = up
    return at


def _join(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the ends of links (u, v) in a forest where no parent is larger than its child."""
    while len(u):
        u, v = _ends(parent, u), _ends(parent, v)
        apart = u != v
        u, v = np.maximum(u, v)[apart], np.minimum(u, v)[apart]
        np.minimum.at(parent, u, v)


def near_duplicates(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    cosine: float = COSINE,
    recall: float = RECALL,
    seed: int = SEED,
    block: int = BLOCK,
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    rows = pick(vectors, vec_id, embedding)
    key = rows.columns[0]
    rows = rows.select(rows[0].alias("id"), rows[1].cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    name = F.when(usable, F.xxhash64("vector"))
    named = written(rows.select("id", name.alias("class"), "vector"), "vectors")
    classes = named.where("class IS NOT NULL").groupBy("class").agg(F.first("vector").alias("vector"), F.count("*").alias("copies"))
    classes = written(classes, "vector-classes")
    n = classes.count()
    depth, tables = plan(n, cosine, recall)
    r = math.sqrt(2 - 2 * cosine)

    keyed = written(_cells(classes.select("class", "vector", "copies"), depth, tables, r, seed), "vector-cells")
    spots = keyed.select("class", "dim", F.posexplode("keys").alias("table", "cell"))
    crowds = spots.groupBy("dim", "table", "cell").agg(F.count("*").alias("rows")).where("rows > 1")
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    busy = F.least(F.lit(math.ceil(math.sqrt(6 * cores))), F.ceil(F.col("rows") / SMALL))  # about 3 pairs of blocks a core
    blocks = F.greatest(F.ceil(F.col("rows") / block), F.ceil(F.col("rows") * F.col("dim") * 8 / HELD), busy)
    crowds = written(crowds.select("dim", "table", "cell", blocks.cast("int").alias("blocks")), "vector-crowds")
    pairs = crowds.agg(F.sum(F.expr("blocks * (blocks + 1L) / 2"))).first()[0] or 1
    mine = F.pmod(F.xxhash64("class"), "blocks").cast("int")
    deal = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda k: F.struct(F.least(k, F.col("mine")).alias("i"), F.greatest(k, F.col("mine")).alias("j")),
        )
    )
    few = F.broadcast(crowds) if not depth else crowds  # a row for each length
    dealt = spots.join(few, ["dim", "table", "cell"]).withColumn("mine", mine).withColumn("p", deal)
    dealt = dealt.select("class", "dim", "table", "cell", "p.i", "p.j", (F.col("mine") == F.col("p.i")).alias("left"), (F.col("mine") == F.col("p.j")).alias("right"))
    keys = ("dim", "table", "cell", "i", "j")
    task = F.expr(f"cast(pmod(xxhash64(dim, table, cell) % {TASKS}L + j * (j + 1L) div 2 + i, {int(min(pairs, TASKS))}L) AS int)")
    dealt = dealt.join(keyed.drop("dim"), "class").repartitionById(int(min(pairs, TASKS)), task).sortWithinPartitions(*keys, "class")
    names = ["class", *keys, "left", "right", "vector", "copies", "keys"]

    def links_of(table: pa.Table):
        """Counts of the members of complete pairs of blocks, and the smallest class that links join each with."""
        lengths = table.column("dim").to_numpy()
        for dim, at in _by_length(lengths):
            part = table.slice(int(at[0]), len(at))  # pairs of blocks are sorted by length first
            same = np.ones(len(part), bool)
            same[0] = False
            for k in keys:
                column = part.column(k).to_numpy()
                same[1:] &= column[1:] == column[:-1]
            begin = np.flatnonzero(~same)
            axes = np.linalg.qr(np.random.default_rng((seed + 1, dim)).standard_normal((dim, dim)))[0]
            for lo, rows in zip(begin.tolist(), np.diff(np.append(begin, len(part))).tolist(), strict=True):
                yield links_in(part.slice(lo, rows), dim, axes)

    def links_in(table: pa.Table, dim: int, axes: np.ndarray):
        get = lambda k: table.column(k).to_numpy()
        x = _scaled(_matrix(table.column("vector").combine_chunks(), dim))
        size = np.sqrt(np.einsum("ij,ij->i", x, x))
        p = (x / size[:, None]) @ axes
        seen = np.asarray(table.column("keys").combine_chunks().flatten()).reshape(len(x), tables)
        t, left, right, copies, name = get("table")[0], np.flatnonzero(get("left")), np.flatnonzero(get("right")), get("copies"), get("class")
        within = len(left) == len(right) == len(x)
        links, parent = np.zeros(len(x), np.int64), np.arange(len(x))  # members are sorted by class
        width, count = WINDOW * r / math.sqrt(dim) + 1e-9, dim - math.floor(dim / WINDOW**2)
        for u, v in _collisions(p[left], p[right], width, count):
            u, v = left[u], right[v]
            if within:  # each pair once
                u, v = u[u < v], v[u < v]
            linked = np.empty(len(u), bool)
            for lo in range(0, len(u), 65536):
                a, b = u[lo : lo + 65536], v[lo : lo + 65536]
                linked[lo : lo + 65536] = np.einsum("ij,ij->i", x[a], x[b]) >= cosine * size[a] * size[b]
            u, v = u[linked], v[linked]
            if tables > 1:  # in the first table that brings it together
                first = np.argmax(seen[u] == seen[v], axis=1) == t
                u, v = u[first], v[first]
            np.add.at(links, u, copies[v])
            np.add.at(links, v, copies[u])
            _join(parent, u, v)
        hit = np.flatnonzero(links)
        least = name[_ends(parent, hit)]
        return pa.RecordBatch.from_arrays([pa.array(name[hit]), pa.array(links[hit]), pa.array(least)], names=["class", "links", "least"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            if len(table) < 4096:
                continue
            last = [table.column(k)[len(table) - 1].as_py() for k in keys]
            same = np.ones(len(table), bool)
            for k, value in zip(keys, last, strict=True):
                same &= table.column(k).to_numpy() == value
            cut = len(table) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield from links_of(table.slice(0, cut).combine_chunks())
                held = table.slice(cut).to_batches()
        if held:
            yield from links_of(pa.Table.from_batches(held).combine_chunks())

    found = written(dealt.select(*names).mapInArrow(run, "class long, links long, least long"), "vector-links")
    counts = found.groupBy(F.col("class").alias("c")).agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("class").alias("a"), F.col("least").alias("b")))
    sized = classes.select(F.col("class").alias("k"), "copies")
    out = (
        named.select("id", "class")
        .join(sized, F.col("class") == F.col("k"), "left")
        .join(counts, F.col("class") == F.col("c"), "left")
        .join(linked, F.col("class") == F.col("node"), "left")
        .select("id", F.coalesce("component", "class").alias("set"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"))
    )
    out = written(out, "vectors-named")
    least = out.where("set IS NOT NULL AND id IS NOT NULL").groupBy(F.col("set").alias("s")).agg(F.min("id").alias("component_id"))
    component = F.when(F.col("id").isNotNull(), F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.join(least, out["set"] == least["s"], "left").select(
        F.col("id").alias(key), "n_links", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )
