"""Periodic runs of words, and texts with the repetitions cut, by tiles of every period octave.

A run is a stretch of words with smallest period q, at least ``max(12, 2 * q)`` long, that neither
neighbour extends. Periods are handled by octaves. For each octave a document is exploded into
overlapping tiles as wide as the octave asks for; a tile has boundaries a quarter of the largest
period apart. Every run holds a boundary c with its words c.. equal to those one period on, so a
tile finds each period's repetition around its boundaries from two Z-functions: of the words from
the boundary on, and of those before it read backwards. Tiles are solved independently, wherever
Spark deals them. Their fragments are shuffled by (document, period) and stitched: two that share
a whole period are one stretch. What is periodic with a part of the period already is left to that
part's octave.

A tile leaves its document only if a block of words at one of its boundaries comes again within
the octave's distance, which no run can lack, and if no smaller period covers it whole, where all
that it could find are multiples of that period. So ordinary prose sends nothing. Every document
has a row id in one written table; texts travel only with documents that have tiles.

Words are ``[^\\x20\\x09-\\x0D]+``, told apart by case and compared by 64-bit hashes. Nulls and
empty texts have no words, no runs and an empty collapsed text. Repeated rows are rows of their
own. Columns named like those this module adds are replaced; an empty table gives no rows. A text
of any length costs its words times the octaves below its length; its tiles are solved apart.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmood.llm.words import AS_IS, SPACED, Words, mixed, row_of, slices, words_of, written

LEAST = 12  # words of a run
FIRST = 8  # the lowest octave has all periods below this, each further one doubles
CORE = 2048  # words between the first and last boundary of a tile, or 16 times the least period
PIECE = 1 << 20  # comparisons at once

_U = np.uint64


class Octave:
    """Periods ``lo <= q < hi``, boundaries ``step`` apart, blocks compared at a boundary, and the
    words of a tile beyond its boundaries."""

    def __init__(self, nth: int):
        self.nth = nth
        self.lo, self.hi = (1, FIRST) if nth == 0 else (FIRST << (nth - 1), FIRST << nth)
        # The words of a run that come again one period on number max(q, 12 - q) at least: 6 in the
        # lowest octave, lo elsewhere. Either holds a whole block that begins at a boundary.
        self.step, self.block = (4, 3) if nth == 0 else (self.lo // 2, self.lo // 2)
        self.reach = max(self.hi, LEAST)
        self.core = max(CORE, 16 * self.lo)

    def fits(self, n: np.ndarray) -> np.ndarray:
        return n >= max(LEAST, 2 * self.lo)


def octaves(longest: int):
    nth = 0
    while Octave(nth).fits(np.int64(longest)):
        yield Octave(nth)
        nth += 1


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * _U(0xA0761D6478BD642F) + right)


def _alone(start: int, n: int, salt: int) -> np.ndarray:
    """Values that equal no other."""
    return mixed(np.arange(start, start + n, dtype=np.uint64) + _U(salt << 40))


class Blocks:
    """Hashes of the blocks of words that begin at each place, for one octave after the other."""

    def __init__(self, x: np.ndarray):
        self.x, self.size, self.pairs = x, 1, x

    def _longer(self, blocks: np.ndarray, by: int, more: np.ndarray) -> np.ndarray:
        """Blocks followed by ``more`` from ``by`` places on; those cut by the end are unique."""
        n = max(len(blocks) - by, 0)
        return np.concatenate([_joined(blocks[:n], more[by : by + n]), _alone(0, len(blocks) - n, by + 7)])

    def of(self, octave: Octave) -> np.ndarray:
        if octave.block == 3:
            return self._longer(self._longer(self.x, 1, self.x), 2, self.x)
        while self.size < octave.block:
            self.pairs = self._longer(self.pairs, self.size, self.pairs)
            self.size *= 2
        return self.pairs


def matches(blocks: np.ndarray, at: np.ndarray, octave: Octave) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries of ``at`` and periods of the octave with equal blocks a period apart."""
    width = octave.hi - octave.lo
    padded = np.concatenate([blocks, _alone(0, octave.hi + 1, 1 << 20)])
    views = sliding_window_view(padded, width)
    places, periods = [], []
    step = max(1, PIECE // width)
    for a in range(0, len(at), step):
        c = at[a : a + step]
        row, q = np.nonzero(views[c + octave.lo] == blocks[c][:, None])
        places.append(c[row])
        periods.append(q + octave.lo)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *periods])


def z_function(s: list) -> list[int]:
    """For each place, how far the list goes on there as it begins."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


@cache
def _shorter(q: int) -> tuple[int, ...]:
    """q divided by each of its prime factors."""
    out, rest, f = [], q, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            out.append(q // f)
            while rest % f == 0:
                rest //= f
        f += 1
    return tuple(out)


def joined_spans(q: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of the same period that share a whole period, made one."""
    order = np.lexsort((start, q))
    q, start, end = q[order], start[order], end[order]
    out: list[list[int]] = []
    for p, a, b in zip(q.tolist(), start.tolist(), end.tolist(), strict=True):
        if out and out[-1][0] == p and a + p <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([p, a, b])
    return tuple(np.array([s[i] for s in out], np.int64) for i in range(3))


def solve(x: np.ndarray, nth: int, first: int, last: int) -> tuple[np.ndarray, ...]:
    """Smallest period, start and end of the repetitions in a tile around its boundaries
    first..last."""
    octave = Octave(nth)
    at = np.arange(first, last + 1, octave.step)
    places, periods = matches(Blocks(mixed(x)).of(octave), at, octave)
    found: tuple[list, list, list] = ([], [], [])
    words = x.tolist()
    edges = [*np.flatnonzero(np.diff(places, prepend=-1)).tolist(), len(places)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        c = int(places[lo])
        ahead = z_function(words[c : c + octave.hi + octave.reach])
        before = words[max(0, c - octave.reach) : c][::-1]
        top = min(c + octave.hi, len(words))
        behind = z_function([*before, -1, *words[max(0, c - octave.reach) : top][::-1]])
        for q in periods[lo:hi].tolist():
            if c + q > len(words):
                continue
            more = ahead[q] if q < len(ahead) else 0
            less = min(behind[len(before) + 1 + top - c - q], len(before))
            # One period of a stretch tells whether a part of it is a period already.
            if less + more >= max(q, LEAST - q) and not any(ahead[p] >= q - p for p in _shorter(q)):
                found[0].append(q)
                found[1].append(c - less)
                found[2].append(c + q + more)
    return joined_spans(*(np.array(f, np.int64) for f in found))


def _covered(starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether one of the spans holds a..b."""
    if not len(starts):
        return np.zeros(len(a), bool)
    order = np.argsort(starts, kind="stable")
    far = np.maximum.accumulate(ends[order])
    i = np.searchsorted(starts[order], a, "right") - 1
    return (i >= 0) & (far[i] >= b)


def tiles_of(w: Words) -> list[list[dict]]:
    """For each text the tiles that may hold part of a run: octave, place of the tile's first word,
    first and last boundary in the tile, and its words as numbers."""
    n = np.diff(w.first)
    rows = len(n)
    out: list[list[dict]] = [[] for _ in range(rows)]
    # Texts stand in one array, each followed by a word that equals no other.
    x = np.empty(len(w.hash) + rows, np.uint64)
    begin = w.first[:-1] + np.arange(rows)
    x[np.arange(len(w.hash)) + row_of(w.first)] = w.hash
    x[begin + n] = _alone(0, rows, 3)
    blocks = Blocks(x)
    starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for octave in octaves(int(n.max(initial=0))):
        row = np.flatnonzero(octave.fits(n))
        count = -(-n[row] // octave.step)
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        of = np.repeat(row, count)
        c, q = matches(blocks.of(octave), begin[of] + nth * octave.step, octave)
        r = np.searchsorted(begin, c, "right") - 1
        own = c + q + octave.block <= begin[r] + n[r]  # not a block of the next text
        c, q, r = c[own], q[own], r[own]
        if not len(c):
            continue
        local = c - begin[r]
        tile = local // octave.core
        edge = np.flatnonzero((np.diff(r, prepend=-1) != 0) | (np.diff(tile, prepend=-1) != 0))
        first = local[edge]
        last = local[np.append(edge[1:], len(c)) - 1]
        r = r[edge]
        a = np.maximum(first - octave.reach, 0)
        b = np.minimum(last + octave.hi + octave.reach, n[r])
        whole = _covered(starts, ends, begin[r] + a, begin[r] + b)
        for i in np.flatnonzero(~whole).tolist():
            _, ids = np.unique(x[begin[r[i]] + a[i] : begin[r[i]] + b[i]], return_inverse=True)
            out[r[i]].append(
                {
                    "octave": octave.nth,
                    "start": int(a[i]),
                    "first": int(first[i] - a[i]),
                    "last": int(last[i] - a[i]),
                    "words": ids.astype(np.int32).tobytes(),
                }
            )
        # Neighbouring boundaries with the same period: the words around them have it.
        order = np.lexsort((c, q))
        c, q = c[order], q[order]
        edge = np.flatnonzero((np.diff(q, prepend=-1) != 0) | (np.diff(c, prepend=-1) != octave.step))
        end = c[np.append(edge[1:], len(c)) - 1] + octave.block + q[edge]
        keep = end - c[edge] >= 2 * np.maximum(q[edge], LEAST)
        starts, ends = np.concatenate([starts, c[edge][keep]]), np.concatenate([ends, end[keep]])
    return out


def _kept(w: Words, r: int, runs: list[dict]) -> bytes:
    """The words of text r outside all repetitions, joined by blanks."""
    a, b = int(w.first[r]), int(w.first[r + 1])
    if b == a:
        return b""
    depth = np.zeros(b - a + 1, np.int64)
    for s in runs:
        depth[s["start"] + s["period"]] += 1
        depth[s["start"] + s["length"]] -= 1
    keep = np.flatnonzero(np.cumsum(depth[:-1]) == 0) + a
    size = w.end[keep] - w.start[keep] + 1
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size) + np.repeat(w.start[keep], size)
    out = w.data[np.minimum(place, len(w.data) - 1)]
    out[begin + size - 1] = 32
    return out[:-1].tobytes()


TILES = "array<struct<octave: int, start: long, first: long, last: long, words: binary>>"
RUNS = "array<struct<start: long, length: long, period: long>>"
ADDED = ("n_words", "runs", "collapsed", "collapsed_sha256")


def _scanned(docs: DataFrame, text: str, digest: bool) -> DataFrame:
    """Each row with its id, other columns and tiles; texts only where they are needed again."""
    other = [c for c in docs.columns if c != text and c not in ADDED]
    doc = F.struct(*[docs[c] for c in other]) if other else F.struct(F.lit(None).cast("int").alias("_none"))
    rows = docs.select(docs[text].cast("string").alias("text"), doc.alias("doc")).select("text", "doc", F.monotonically_increasing_id().alias("row"))
    schema = T.StructType([*rows.schema, *T.StructType.fromDDL(f"n_words long, short boolean, sha string, tiles {TILES}")])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, "text"):
                w = words_of(part.column(0), SPACED, AS_IS)
                tiles = tiles_of(w)
                plain = [not t for t in tiles]
                sha = [hashlib.sha256(_kept(w, r, [])).hexdigest() if p and digest else None for r, p in enumerate(plain)]
                texts = part.column(0)
                if digest:
                    texts = texts.take(pa.array([None if p else r for r, p in enumerate(plain)], pa.int64()))
                columns = [texts, part.column(1), part.column(2), pa.array(np.diff(w.first)), pa.array(plain), pa.array(sha, pa.string())]
                columns.append(pa.array(tiles, arrow.field(6).type))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return written(rows.mapInArrow(run, schema), "periodic")


def fragments(scanned: DataFrame) -> DataFrame:
    """``row, period, start, end`` of the repetitions that the tiles hold, tile by tile."""

    def run(batches):
        for batch in batches:
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                q, a, b = solve(np.frombuffer(t["words"], np.int32).astype(np.int64), t["octave"], t["first"], t["last"])
                if len(q):
                    names = ["row", "period", "start", "end"]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), row)), pa.array(q), pa.array(a + t["start"]), pa.array(b + t["start"])], names=names)

    tiles = scanned.where("size(tiles) > 0").select("row", F.explode("tiles").alias("tile"))
    # A tile is small and takes long: their number of partitions is not to be lowered by size.
    tasks = int(scanned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(tasks, "row", "tile.octave", "tile.start").mapInArrow(run, "row long, period long, start long, end long")


def stitched(parts: DataFrame) -> DataFrame:
    """``row, start, length, period`` of the runs behind fragments."""
    of = W.partitionBy("row", "period").orderBy("start", "end")
    before = F.max("end").over(of.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(F.col("start") + F.col("period") <= before, 0).otherwise(1)
    spans = (
        parts.withColumn("new", new)
        .withColumn("nth", F.sum("new").over(of))
        .groupBy("row", "period", "nth")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    length = F.col("end") - F.col("start")
    return spans.where(length >= F.greatest(F.lit(LEAST), 2 * F.col("period"))).select("row", "start", length.alias("length"), "period")


def collapse(docs: DataFrame, text: str = "text", digest: bool = False) -> DataFrame:
    """The rows with ``n_words``, ``runs`` (start, length, period; by start, then period) and
    ``collapsed``: the words that no run repeats, joined by blanks.

    With ``digest`` the texts do not come out: ``collapsed_sha256`` stands for the collapsed one.
    """
    scanned = _scanned(docs, text, digest)
    found = stitched(fragments(scanned)).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    tiled = scanned.where("NOT short").join(found, "row", "left")
    columns = ["text", "doc", "n_words", "sha", "runs"]
    rows = scanned.where("short").withColumn("runs", F.lit(None).cast(RUNS)) if digest else scanned.where("short").withColumn("runs", F.array().cast(RUNS))
    schema = T.StructType([*tiled.select(*columns).schema, T.StructField("collapsed", T.StringType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, "text"):
                w = words_of(part.column(0), SPACED, AS_IS)
                left = [_kept(w, r, runs or []) for r, runs in enumerate(part.column(4).to_pylist())]
                columns = list(part.columns)
                if digest:
                    columns[3] = pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())
                    left = [None] * len(left)
                else:
                    left = [x.decode("utf-8", "replace") for x in left]
                yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(columns, arrow, strict=False)], pa.array(left, pa.string())], schema=arrow)

    cut = tiled.select(*columns).mapInArrow(run, schema)
    if digest:
        plain = rows.select(*columns, F.lit(None).cast("string").alias("collapsed"))
    else:
        plain = rows.select(*columns).mapInArrow(run, schema)
    every = cut.unionByName(plain)
    other = [c for c in docs.columns if c != text and c not in ADDED]
    runs = F.coalesce("runs", F.array().cast(RUNS)).alias("runs")
    tail = [F.col("sha").alias("collapsed_sha256")] if digest else [F.col("text").alias(text), "collapsed"]
    return every.select(*[F.col("doc")[c].alias(c) for c in other], "n_words", runs, *tail)
