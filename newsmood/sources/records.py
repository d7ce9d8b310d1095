"""Records of text files that no line ends: JSON documents of any layout, CSV with quoted breaks.

A file is read as lines, in as many byte ranges as Spark splits it into. What a range means depends
on what came before it: how deep its first line lies in the JSON document, or whether it lies
inside a quoted CSV field. A first pass sums up how each range changes that state, which needs no
knowledge of the state itself; running sums over the ranges of a file then give the state each one
begins in. The second pass cuts every range at true record borders, in as many tasks. Only the
pieces at the borders of ranges, two a range, are shuffled and put together.

JSON strings hold no raw line breaks, so a line never begins inside one. A file whose document is a
list has its elements as records; objects with an ``articles`` list have the elements of that list;
any other object is a record itself. Where most lines are objects by themselves every line is a record,
so a broken line spoils no other. A file of one single line is one task, as Spark does not split lines.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsmood.session import work_path

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[][{}]')
_KEY = re.compile(r"\s*:")
LIST_KEY = '"articles"'


class Change:
    """What a byte range does to the state, told relative to its unknown start."""

    def __init__(self):
        self.gain = 0
        self.opened: dict[int, bool] = {}  # by depth, whether the last to open there is a list of articles
        self.listed: set[int] = set()  # depths at which such a list opens
        self.first = ""
        self.lines = self.alone = 0  # lines that are not blank; those that are an object by themselves


class JsonState:
    """The depth of nesting, and which values are records: elements of lists of articles (level 2)
    while ``inside`` one, elements of a top-level list (1), top-level values (0), or lines (-1)."""

    @staticmethod
    def change(lines: Iterator[str]) -> Change:
        c, pending = Change(), False
        for line in lines:
            text = line.strip()
            if not text:
                continue
            before, c.lines, c.first = c.gain, c.lines + 1, c.first or text[0]
            for m in _TOKEN.finditer(line):
                t = m[0]
                if t in "{[":
                    listed = pending and t == "["
                    c.opened[c.gain] = listed
                    if listed:
                        c.listed.add(c.gain)
                    c.gain += 1
                elif t in "}]":
                    c.gain -= 1
                pending = t == LIST_KEY and _KEY.match(line, m.end()) is not None
            c.alone += text[0] == "{" and text[-1] == "}" and c.gain == before
        return c

    def __init__(self, depth: int = 0, level: int = -1, inside: bool = False):
        self.depth, self.level, self.inside, self.pending = depth, level, inside, False

    def open(self) -> bool:
        return self.depth > self.level >= 0 and (self.level < 2 or self.inside)

    def cut(self, line: str) -> Iterator[tuple[str, bool]]:
        """Pieces of the records in a line; a piece comes with whether it ends its record."""
        if self.level < 0:
            if line.strip():
                yield line.strip(), True
            return
        start = 0 if self.open() else None
        for m in _TOKEN.finditer(line):
            t = m[0]
            if t in "{[":
                if self.depth == 1:
                    self.inside = self.pending and t == "["
                if self.depth == self.level and t == "{" and (self.level < 2 or self.inside):
                    start = m.start()
                self.depth += 1
            elif t in "}]":
                self.depth -= 1
                if self.depth == self.level and start is not None:
                    yield line[start : m.end()], True
                    start = None
            self.pending = t == LIST_KEY and _KEY.match(line, m.end()) is not None
        if start is not None:
            yield line[start:] + "\n", False


class CsvState:
    """Parity of quotes: whether a line begins inside a quoted field."""

    @staticmethod
    def change(lines: Iterator[str]) -> Change:
        c = Change()
        c.gain = sum(line.count('"') for line in lines) & 1
        return c

    def __init__(self, depth: int = 0, level: int = -1, inside: bool = False):
        self.depth = depth & 1

    def open(self) -> bool:
        return bool(self.depth)

    def cut(self, line: str) -> Iterator[tuple[str, bool]]:
        more = self.open()
        self.depth ^= line.count('"') & 1
        if self.open():
            yield line + "\n", False
        elif more or line.strip("\r"):
            yield line.removesuffix("\r"), True


_STATES = {"json": JsonState, "csv": CsvState}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, start`` (of the byte range) and ``value``, in file order within a range."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _ranges(batches) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """Lines of each byte range in turn."""

    def rows():
        for batch in batches:
            yield from zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True)

    stream = rows()
    ahead = next(stream, None)

    def lines(key):
        nonlocal ahead
        while ahead is not None and ahead[:2] == key:
            yield ahead[2]
            ahead = next(stream, None)

    while ahead is not None:
        key = ahead[:2]
        of = lines(key)
        yield key, of
        for _ in of:  # what the caller left
            pass


def _begin(lines: DataFrame, kind: str) -> dict[tuple[str, int], tuple[int, int, bool]]:
    """State at the start of each byte range that is not simply lines.

    The ranges are those that Spark's own plan of the scan lists on the driver.
    """
    state = _STATES[kind]
    schema = "file string, start long, gain long, opened map<long,boolean>, listed array<long>, first string, lines long, alone long"

    def run(batches):
        types = [pa.string(), pa.int64(), pa.int64(), pa.map_(pa.int64(), pa.bool_()), pa.list_(pa.int64()), pa.string(), pa.int64(), pa.int64()]
        for (file, start), of in _ranges(batches):
            c = state.change(of)
            row = [file, start, c.gain, list(c.opened.items()), sorted(c.listed), c.first, c.lines, c.alone]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=_names(schema))

    by = W.partitionBy("file").orderBy("start")
    earlier, every = by.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("file")
    depth = F.coalesce(F.sum("gain").over(earlier), F.lit(0))
    placed = lines.mapInArrow(run, schema).withColumn("depth", depth)
    last = F.try_element_at("opened", F.lit(1) - F.col("depth"))
    first = F.first(F.nullif("first", F.lit("")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    level = (
        F.when(F.max(F.exists("listed", lambda d: d + F.col("depth") == 1)).over(every), 2)
        .when(first == "[", 1)
        .when(2 * F.sum("alone").over(every) > F.sum("lines").over(every), -1)
        .otherwise(0)
    )
    inside = F.coalesce(F.last(last, ignorenulls=True).over(earlier), F.lit(False))
    rows = placed.select("file", "start", "depth", level.alias("level"), inside.alias("inside"))
    rows = rows.where("level >= 0") if kind == "json" else rows.where("depth % 2 = 1")
    return {(r.file, r.start): (r.depth, r.level, r.inside) for r in rows.toLocalIterator()}


def _names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


def records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``file, start, nth, record``: raw records of JSON or CSV files in file order.

    A CSV file's header is its first record (``start`` and ``nth`` 0). ``nth`` counts records that
    begin in a byte range; blank lines between records are none.
    """
    if kind not in _STATES:
        raise ValueError(f"unknown kind of records: {kind}")
    lines = _lines(spark, path)
    state, begin = _STATES[kind], spark.sparkContext.broadcast(_begin(lines, kind))

    def run(batches):
        names = ["file", "start", "nth", "record", "whole"]
        for (file, start), of in _ranges(batches):
            now = state(*begin.value.get((file, start), ()))
            # The end of a record that began in an earlier range has nth -1.
            nth = -1 if now.open() else 0
            held: list[str] = []
            out: list[list] = [[], [], [], [], []]

            def put(text, whole):
                for column, v in zip(out, (file, start, nth, text, whole), strict=True):  # noqa: B023
                    column.append(v)

            for line in of:
                for text, ends in now.cut(line):
                    held.append(text)
                    if ends:
                        put("".join(held), nth >= 0)
                        held, nth = [], nth + 1
                if len(out[0]) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)
                    out = [[], [], [], [], []]
            if held:
                put("".join(held), False)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)

    # Written, as the pieces are read twice: the scan of the lines is not done again.
    path = work_path(spark, "record-pieces")
    pieces = lines.mapInArrow(run, "file string, start long, nth long, record string, whole boolean")
    pieces.write.partitionBy("whole").parquet(path)
    pieces = spark.read.schema(pieces.schema).parquet(path)
    # A record that leaves its range goes on with the pieces that begin the next ones.
    broken = pieces.where("NOT whole")
    by = W.partitionBy("file").orderBy("start", "nth")
    owner = F.sum(F.when(F.col("nth") >= 0, 1).otherwise(0)).over(by)
    joined = (
        broken.withColumn("owner", owner)
        .groupBy("file", "owner")
        .agg(F.min(F.struct("start", "nth")).alias("at"), F.sort_array(F.collect_list(F.struct("start", "nth", "record"))).alias("parts"))
        .select("file", "at.start", "at.nth", F.array_join(F.transform("parts", lambda p: p["record"]), "").alias("record"))
    )
    return pieces.where("whole").drop("whole").unionByName(joined)


# Executors get the code of the tasks with the tasks and need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
