"""Quality scores: ridge regression on random Fourier features, calibrated by isotonic regression.

Each text becomes a row of statistics of its words, lines and bytes; no label, language, source
or id is among them. Standardised over all rows, they are mapped to cosines of random
projections, whose inner products approximate a Gaussian kernel. Ridge weights follow from the
normal equations, which are sums over labelled rows: tasks add up their part for each fold, and
the parts are added in a tree, so the driver receives one matrix a fold. Every fold is scored by the model
of the others, and isotonic regression of the labels on those scores (pooled in ``BINS`` bins)
turns scores into shares of good documents. Labels are used all; nothing is sampled.

Nulls and empty texts have statistics of zero and a score like any text; equal texts have equal
scores; documents without usable labels score 0.5; an empty table gives no rows. A label counts
as good if at least half of the labels of its id are 1; null labels and ids are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmood.llm.words import SPACED, Words, broadcast, pick, slices, words_of, written

FEATURES = 384
WIDTH = 4.0
RIDGE = 1e-3
FOLDS = 4
BINS = 2000
SEED = 11
THRESHOLD = 0.7

_BYTE = np.arange(256)
_LINE = _BYTE != 10


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


_UPPER = _class((65, 90))
_DIGIT = _class((48, 57))
_STOP = _class((46, 46), (63, 63))
_SHOUT = _class((33, 33))
_COMMA = _class((44, 44))
#: ASCII that is neither a letter, a digit, white space nor ordinary punctuation.
_SYMBOL = _class((35, 38), (42, 43), (47, 47), (60, 62), (64, 64), (91, 96), (123, 126))
_WIDE = _BYTE >= 128

NAMES = (
    "log_words", "log_lines", "word_bytes", "distinct_words", "top_word", "repeats", "distinct_pairs",
    "distinct_lines", "upper", "digits", "stops", "shouts", "commas", "symbols", "symbol_words", "wide", "short_words", "long_words",
)


def _per_row(offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(places, offsets)).astype(float)


def _variety(first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the most frequent one, for each text."""
    rows = len(first) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    order = np.lexsort((hashes, row))
    r, h = row[order], hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(h)))
    distinct = np.bincount(r[begin], minlength=rows).astype(float)
    top = np.zeros(rows)
    np.maximum.at(top, r[begin], size)
    return distinct, top


def statistics_of(column: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for each text."""
    w: Words = words_of(column, SPACED)
    lines = words_of(column, _LINE)
    rows = len(w.first) - 1
    n = np.diff(w.first).astype(float)
    n1 = np.maximum(n, 1)
    size = np.maximum(np.diff(w.offsets).astype(float), 1)
    length = (w.end - w.start).astype(float)
    row = np.repeat(np.arange(rows), np.diff(w.first))
    distinct, top = _variety(w.first, w.hash)
    pair = w.hash.copy()
    if len(pair):
        pair[:-1] = pair[:-1] * np.uint64(3) + w.hash[1:]
        pair[w.first[1:][n > 0] - 1] = 0
    pairs, _ = _variety(w.first, pair)
    same = np.zeros(len(w.hash))
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])
    n_lines = np.diff(lines.first).astype(float)
    distinct_lines, _ = _variety(lines.first, lines.hash)
    share = lambda member: _per_row(w.offsets, np.flatnonzero(member[w.data])) / size
    weigh = lambda x: np.bincount(row, x, rows) / n1
    symbol = np.append(0, np.cumsum(_SYMBOL[w.data]))
    return np.column_stack(
        [
            np.log1p(n), np.log1p(n_lines), weigh(length), distinct / n1, top / n1, weigh(same), pairs / n1,
            distinct_lines / np.maximum(n_lines, 1), share(_UPPER), share(_DIGIT), share(_STOP), share(_SHOUT), share(_COMMA),
            share(_SYMBOL), weigh((symbol[w.end] > symbol[w.start]).astype(float)), share(_WIDE),
            weigh((length <= 3).astype(float)), weigh((length >= 12).astype(float)),
        ]
    )


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``stats`` (array of double, in the order of ``NAMES``). Narrow."""
    rows = pick(docs, doc_id, text)
    schema = T.StructType([rows.schema[0], T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, batch.schema.field(1).name):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(arrow.field(0).type), _lists(statistics_of(part.column(1)), arrow.field(1).type)],
                    schema=arrow,
                )

    return rows.mapInArrow(run, schema)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
    return pa.ListArray.from_arrays(at, pa.array(x.ravel())).cast(kind)


class Features:
    """Standardised statistics as random Fourier features and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, n: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.to = rng.standard_normal((len(mean), n)) / width
        self.shift = rng.uniform(0, 2 * np.pi, n)

    def of(self, lists: pa.Array) -> np.ndarray:
        x = np.asarray(lists.flatten(), float).reshape(len(lists), len(self.mean))
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.sqrt(2 / len(self.shift)) * np.cos(z @ self.to + self.shift), np.ones(len(x))])


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and values of the blocks, for sorted x."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, weight, strict=True):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top, strict=True)]
    b = np.array(blocks).reshape(-1, 3)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


class Model:
    def __init__(self, features: Features, weights: np.ndarray, centres: np.ndarray, values: np.ndarray):
        self.features, self.weights, self.centres, self.values = features, weights, centres, values

    def score(self, lists: pa.Array) -> np.ndarray:
        if not len(self.centres):
            return np.full(len(lists), 0.5)
        return np.clip(np.interp(self.features.of(lists) @ self.weights, self.centres, self.values), 0, 1)


def _summed(rows: DataFrame, shared, d: int, folds: int) -> np.ndarray:
    """Normal equations by fold: Z'Z and Z'y side by side, added up in a tree."""

    def part(batches):
        features, total = shared(), np.zeros((folds, d, d + 1))
        for batch in batches:
            z = features.of(batch.column("stats"))
            y = np.asarray(batch.column("good"), float)
            fold = np.asarray(batch.column("fold"))
            for k in np.unique(fold):
                zk = z[fold == k]
                total[k, :, :d] += zk.T @ zk
                total[k, :, d] += zk.T @ y[fold == k]
        yield from _out(total)

    def add(batches):
        total = np.zeros((folds, d, d + 1))
        for batch in batches:
            for x in batch.column("sums"):
                total += np.frombuffer(x.as_buffer(), float).reshape(total.shape)
        yield from _out(total)

    def _out(total):
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    n = rows.rdd.getNumPartitions()
    sums = rows.mapInArrow(part, "sums binary")
    while n > 1:
        n = -(-n // 8)
        sums = sums.repartition(n).mapInArrow(add, "sums binary")
    found = [np.frombuffer(r.sums, float).reshape(folds, d, d + 1) for r in sums.collect()]  # one row
    return np.sum(found, axis=0) if found else np.zeros((folds, d, d + 1))


def _solve(sums: np.ndarray, ridge: float) -> np.ndarray:
    a, b = sums[:, :-1], sums[:, -1]
    n = a[-1, -1]  # rows: the constant's square
    return np.linalg.solve(a + (ridge * max(n, 1)) * np.eye(len(a)) / 10, b)


def fit(stats: DataFrame, labels: DataFrame, n: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, folds: int = FOLDS, seed: int = SEED) -> Model:
    """A model from ``stats`` (id, stats) and ``labels`` (id, good 0/1), joined by id."""
    spark = stats.sparkSession
    key = stats.columns[0]
    cells = [F.col("stats")[i] for i in range(len(NAMES))]
    moments = stats.agg(*[F.avg(x) for x in cells], *[F.stddev_pop(x) for x in cells]).first()
    moments = np.array([x or 0.0 for x in moments])
    scale = moments[len(NAMES) :]
    features = Features(moments[: len(NAMES)], np.where(scale > 1e-9, scale, 1.0), n, width, seed)
    shared = broadcast(spark, features)
    truth = (
        labels.select(labels.columns[0], F.col(labels.columns[1]).cast("double").alias("good"))
        .dropna()
        .groupBy(F.col(labels.columns[0]).alias("_id"))
        .agg((F.avg("good") >= 0.5).cast("int").alias("good"))
    )
    rows = stats.join(truth, stats[key] == truth["_id"]).select(
        "stats", "good", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int").alias("fold")
    )
    rows = written(rows, "quality-train")
    sums = _summed(rows, shared, n + 1, folds)
    total = sums.sum(axis=0)
    weights = _solve(total, ridge)
    if total[-1, -2] < 1:
        return Model(features, weights, np.zeros(0), np.zeros(0))
    others = broadcast(spark, np.stack([_solve(total - sums[k], ridge) for k in range(folds)]))

    def out_of_fold(batches):
        model, weights = shared(), others()
        for batch in batches:
            z = model.of(batch.column("stats"))
            raw = np.einsum("ij,ij->i", z, weights[np.asarray(batch.column("fold"))])
            bins = np.clip(np.floor((raw + 1) / 3 * BINS), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(raw), batch.column("good").cast(pa.int32())], names=["bin", "raw", "good"])

    bins = (
        rows.mapInArrow(out_of_fold, "bin int, raw double, good int")
        .groupBy("bin")
        .agg(F.avg("raw").alias("raw"), F.avg("good").alias("good"), F.count("*").alias("n"))
        .orderBy("bin")
        .collect()  # BINS rows at most
    )
    x, y, w = (np.array([r[k] for r in bins], float) for k in ("raw", "good", "n"))
    return Model(features, weights, *isotonic(x, y, w))


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of rows of statistics."""
    shared = broadcast(stats.sparkSession, model)
    schema = T.StructType([stats.schema[0], T.StructField("score", T.DoubleType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, model = to_arrow_schema(schema), shared()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(arrow.field(0).type), pa.array(model.score(batch.column(1)))], schema=arrow
            )

    return stats.mapInArrow(run, schema)


def held_out(doc_id: str) -> Column:
    """Rows whose labels no model learns from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_labels(labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    return pick(labels, doc_id, label).where(~held_out(doc_id))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: ``doc_id, held_out, score, predicted``."""
    stats = written(statistics(docs, doc_id, text), "quality")
    model = fit(stats, training_labels(labels, doc_id, label))
    return scored(stats, model).select(
        doc_id, held_out(doc_id).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold. One narrow pass at the end."""
    stats = written(statistics(docs, doc_id, text), "quality")
    shared = broadcast(docs.sparkSession, fit(stats, training_labels(labels, doc_id, label)))
    schema, name = docs.schema, text

    def run(batches):
        model = shared()
        for batch in batches:
            for part in slices(batch, name):
                x = statistics_of(part.column(name))
                keep = model.score(_lists(x, pa.list_(pa.float64()))) >= threshold
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
