"""Words of whole texts as numpy arrays, read straight from Arrow buffers.

A text is UTF-8, so every byte of a character beyond ASCII is 0x80 or more and the two word
classes used here can be decided byte by byte. Nothing is decoded and no Python object is made
for a word. Texts are handled in slices of a few megabytes; a longer text is a slice of its own
and is hashed in segments cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from newsmood.session import work_path

SLICE = 3 << 20
SEGMENT = 1 << 20

_BYTE = np.arange(256)
#: A-Z in lower case, every other byte as it is.
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
#: Every byte as it is.
AS_IS = _BYTE.astype(np.uint8)
_SPACE = (_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D))
#: Bytes of words set apart by white space.
SPACED = ~_SPACE
#: Bytes of words of letters, digits and everything beyond ASCII (after lower-casing).
ALNUM = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)

_U = np.uint64
_PRIME = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


with np.errstate(over="ignore"):
    _TABLE = mixed((np.arange(256, dtype=np.uint64) + _U(1)) * _U(_PRIME))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, 0xD6E8FEB86659FD93, np.uint64)) if n else np.zeros(0, np.uint64)


@dataclass
class Words:
    """Words of consecutive texts. ``first[r]:first[r + 1]`` are those of text ``r``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def text(self, a: int, b: int) -> bytes:
        """Words a..b-1 in lower case, joined by blanks."""
        return b" ".join(LOWER[self.data[self.start[i] : self.end[i]]].tobytes() for i in range(a, b))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold ``most`` bytes together, or one row."""
    if not batch.num_rows:
        return
    _, at = raw(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _bounds(data: np.ndarray, edges: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of word bytes; no run crosses an edge."""
    m = is_word[data]
    before = np.empty_like(m)
    before[:1] = False
    before[1:] = m[:-1]
    inner = edges[edges < len(data)]
    before[inner] = False
    after = np.empty_like(m)
    after[-1:] = False
    after[:-1] = m[1:]
    inner = edges[(edges > 0) & (edges <= len(data))]
    after[inner - 1] = False
    return np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each word, in lower case or as another table folds its bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    begin = np.cumsum(size) - size
    pos = np.arange(int(size.sum())) - np.repeat(begin, size)
    vals = _TABLE[fold[data[pos + np.repeat(start, size)]]]
    vals *= _powers(int(size.max()))[pos]
    return mixed(np.add.reduceat(vals, begin) + size.astype(np.uint64))


def words_of(column: pa.Array, is_word: np.ndarray, fold: np.ndarray = LOWER) -> Words:
    """Words, their places and hashes, of all texts of a column."""
    data, offsets = raw(column)
    starts, ends, hashes = [], [], []
    lo = 0
    while lo < len(data):
        hi = min(lo + SEGMENT, len(data))
        while hi < len(data):  # on to the next byte between words
            gap = np.flatnonzero(~is_word[data[hi : hi + 4096]])
            hi = hi + int(gap[0]) if len(gap) else min(hi + 4096, len(data))
            if len(gap):
                break
        part = data[lo:hi]
        edges = offsets[(offsets >= lo) & (offsets <= hi)] - lo
        s, e = _bounds(part, edges, is_word)
        hashes.append(_hashed(part, s, e, fold))
        starts.append(s + lo)
        ends.append(e + lo)
        lo = hi
    none = np.zeros(0, np.int64)
    start = np.concatenate([none, *starts])
    return Words(
        data,
        offsets,
        start,
        np.concatenate([none, *ends]),
        np.concatenate([np.zeros(0, np.uint64), *hashes]),
        np.searchsorted(start, offsets, "left"),
    )


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 words begin none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _U(0xA0761D6478BD642F)
        out += hashes[j : j + n]
    return mixed(out + _U(k))


def row_of(first: np.ndarray) -> np.ndarray:
    """Row number of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of runs of ``least`` or more member bytes within a text."""
    s, e = _bounds(data, offsets, member)
    keep = e - s >= least
    return s[keep], e[keep]


def rows_with(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> np.ndarray:
    """For each text, whether it holds a member byte."""
    at = np.searchsorted(np.flatnonzero(member[data]), offsets)
    return np.diff(at) > 0


def written(df: DataFrame, name: str, held: list | None = None, **options: str) -> DataFrame:
    """The rows as a table in the shared folder, read back: cuts lineage and fixes row ids.
    A list ``held`` gets the table's path, for the caller to free it."""
    path = work_path(df.sparkSession, name)
    if held is not None:
        held.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(spark: SparkSession, held: list) -> None:
    """Delete written tables that no plan reads any more."""
    for path in held:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    held.clear()


def pick(docs: DataFrame, *columns: str) -> DataFrame:
    """Only these columns of a table that may hold others."""
    return docs.select(*[docs[c] for c in columns])


def broadcast(spark: SparkSession, value, held: list | None = None):
    """A function that gives a broadcast object of this package's own classes inside a task.

    The broadcast holds the classes' code with the object, so executors need not import it.
    A list ``held`` gets the broadcast itself, for the caller to free it.
    """
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    if held is not None:
        held.append(shared)

    def get():
        import pickle

        return pickle.loads(shared.value)

    return get
