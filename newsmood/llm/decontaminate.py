"""Benchmark decontamination: a broadcast hash set of test n-grams scanned over token windows.

Words are lower-cased (A-Z) runs of letters, digits and characters beyond ASCII. A window is
``n`` consecutive words of a benchmark item; an item of fewer words is one window. The windows'
hashes go to every task, a bit table in front of them; each hit is verified word by word, so the
hash decides nothing. The scan is narrow: no row is shuffled, whatever is common among the texts.

The broadcast is bounded: a block of the benchmark holds ``block_words`` words at most (or one
item). A larger benchmark takes several passes, one block each, whose hits are merged per row.

Nulls and empty texts have no words and no hits; repeated rows are scanned each for itself; an
item with a null id marks words but is not listed; an empty benchmark leaves all rows clean.
Other columns of the inputs are not read (``contamination``) or passed on (``decontaminate``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmood.llm.words import ALNUM, Words, broadcast, grams, pick, raw, row_of, slices, words_of, written

N = 10
BLOCK_WORDS = 2_000_000

HITS = "n_words long, spans array<struct<first_word:long,last_word:long>>, items array<string>"


class Windows:
    """Windows of a block of items: sorted hashes by window length, and the words to verify with."""

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        self.ids = [i for i, _ in items]
        self.words = words_of(pa.array([t for _, t in items], pa.large_string()), ALNUM)
        self.item = row_of(self.words.first)
        found: dict[int, list[np.ndarray]] = {}
        for a, b in zip(self.words.first[:-1], self.words.first[1:], strict=True):
            if b > a:
                k = min(n, int(b - a))
                found.setdefault(k, []).append(np.arange(a, b - k + 1))
        self.by_length = {}
        for k, at in found.items():
            at = np.concatenate(at)
            hashes = grams(self.words.hash, k)[at]
            order = np.argsort(hashes, kind="stable")
            bits = max(10, min(26, int(len(at) * 16).bit_length()))
            table = np.zeros(1 << bits, bool)
            table[hashes >> np.uint64(64 - bits)] = True
            self.by_length[k] = (hashes[order], at[order], table, np.uint64(64 - bits))

    def hits(self, w: Words) -> Iterator[tuple[int, int, int]]:
        """(first word, window length, item) of each verified occurrence in the texts."""
        row = row_of(w.first)
        for k, (hashes, at, table, shift) in self.by_length.items():
            g = grams(w.hash, k)
            maybe = np.flatnonzero(table[g >> shift])
            maybe = maybe[row[maybe] == row[maybe + k - 1]] if len(maybe) else maybe
            lo = np.searchsorted(hashes, g[maybe], "left")
            hi = np.searchsorted(hashes, g[maybe], "right")
            for p, a, b in zip(maybe[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                text = w.text(p, p + k)
                for q in at[a:b].tolist():
                    if self.words.text(q, q + k) == text:
                        yield p, k, int(self.item[q])


def _merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Unions of word ranges that overlap or touch, ends included."""
    out: list[list[int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _found(w: Words, windows: Windows) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
    """Per text with hits: merged word ranges counted from its first word, and item ids."""
    ranges: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    for p, k, item in windows.hits(w):
        r = int(np.searchsorted(w.first, p, "right")) - 1
        base = int(w.first[r])
        ranges.setdefault(r, []).append((p - base, p - base + k - 1))
        known = items.setdefault(r, set())
        if windows.ids[item] is not None:
            known.add(windows.ids[item])
    return {r: _merged(x) for r, x in ranges.items()}, items


def _blocks(
    benchmark: DataFrame, item_id: str, text: str, block_words: int
) -> tuple[int, Iterator[list[tuple[str | None, str]]]]:
    """Benchmark items in blocks of bounded size: how many, and one after the other. Only one
    block's share is collected at a time."""
    rows = benchmark.select(
        benchmark[item_id].cast("string").alias("item"), F.coalesce(benchmark[text], F.lit("")).alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (2 * block_words)))  # a word and the gap after it take two bytes at least
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return n, ([(r.item, r.text) for r in rows.where(part == k).toLocalIterator()] for k in range(n))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = N,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document row: ``doc_id, n_words, spans`` (hit word ranges, ends included) and
    ``items`` (ids of items with occurring windows, sorted)."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id, text)
    schema = T.StructType([rows.schema[0], *T.StructType.fromDDL(HITS)])
    count, blocks = _blocks(benchmark, item_id, item_text, block_words) if block_words else (1, iter([[]]))
    if count > 1:
        rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
        schema = T.StructType([*schema, T.StructField("_row", T.LongType())])

    def scan(shared):
        arrow = _arrow(schema)

        def run(batches):
            windows = shared()
            for batch in batches:
                for part in slices(batch, text):
                    w = words_of(part.column(text), ALNUM)
                    ranges, items = _found(w, windows)
                    of = range(part.num_rows)
                    columns = [
                        part.column(0),
                        pa.array(np.diff(w.first), pa.int64()),
                        pa.array([[{"first_word": a, "last_word": b} for a, b in ranges.get(r, ())] for r in of], arrow.field(2).type),
                        pa.array([sorted(items.get(r, ())) for r in of], arrow.field(3).type),
                        *part.columns[2:],
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                    )

        return run

    if count == 1:
        return rows.mapInArrow(scan(broadcast(spark, Windows(next(blocks), n))), schema)
    out = None
    for items in blocks:  # a block's hits are written and its broadcast goes before the next one comes
        held: list = []
        found = rows.mapInArrow(scan(broadcast(spark, Windows(items, n), held)), schema)
        found = written(found if out is None else found.where(F.size("spans") > 0), "decontaminate-hits")
        held.pop().unpersist()
        out = found if out is None else out.unionByName(found)
    whole = out.groupBy("_row").agg(
        F.first(doc_id).alias(doc_id),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return whole.select(doc_id, "n_words", _union_of("spans").alias("spans"), "items")


def _union_of(spans: str):
    """Sorted ranges merged where they overlap or touch."""
    empty = F.lit([]).cast("array<struct<first_word:long,last_word:long>>")

    def add(done, x):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (x["first_word"] <= F.get(done, F.size(done) - 1)["last_word"] + 1)
        longer = F.struct(last["first_word"], F.greatest(last["last_word"], x["last_word"]).alias("last_word"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(
            F.concat(done, F.array(x))
        )

    return F.aggregate(F.col(spans), empty, add)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = N,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    action: str = "spans",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents, all columns kept, without what a benchmark window covers.

    ``action="spans"`` cuts each hit range out of the text and drops a document only if no word
    is left of a text that had hits; ``action="documents"`` drops every document with a hit.
    Texts without hits, nulls included, come back as they were. Hits of all blocks of a larger
    benchmark are found in the whole text and united before it is cut.
    """
    if action not in ("spans", "documents"):
        raise ValueError(f"unknown action {action!r}")
    schema = docs.schema
    at = schema.fieldNames().index(text)

    def run(batches, shared=None):
        """Ranges are found with the windows or, without them, read from a last column."""
        arrow = _arrow(schema)
        windows = shared() if shared else None
        for batch in batches:
            for part in slices(batch, text):
                w = words_of(part.column(at), ALNUM)
                if windows:
                    ranges, _ = _found(w, windows)
                else:
                    known = part.column(part.num_columns - 1).to_pylist()
                    ranges = {r: [(x["first_word"], x["last_word"]) for x in spans] for r, spans in enumerate(known) if spans}
                    part = pa.RecordBatch.from_arrays(part.columns[:-1], names=schema.fieldNames())
                if ranges:
                    part = _cut(part, w, ranges)
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(part.columns, arrow, strict=True)], schema=arrow
                )

    def _cut(part, w, ranges):
        data, offsets = raw(part.column(at))
        texts = part.column(at).to_pylist()
        keep = np.ones(part.num_rows, bool)
        for r, spans in ranges.items():
            base = int(w.first[r])
            if action == "documents" or sum(b - a + 1 for a, b in spans) == w.first[r + 1] - base:
                keep[r] = False
                continue
            kept, pos = [], int(offsets[r])
            for a, b in spans:
                kept.append(data[pos : w.start[base + a]].tobytes())
                pos = int(w.end[base + b])
            kept.append(data[pos : offsets[r + 1]].tobytes())
            texts[r] = b"".join(kept).decode()
        part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
        return part.filter(pa.array(keep))

    count, blocks = _blocks(benchmark, item_id, item_text, block_words)
    if count == 1:
        shared = broadcast(docs.sparkSession, Windows(next(blocks), n))
        return docs.mapInArrow(lambda batches: run(batches, shared), schema)
    rows = docs.select(F.monotonically_increasing_id().alias("_key"), F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    rows = written(rows, "decontaminate-docs")
    texts = rows.select("_key", F.col("_doc")[text].alias("text"))
    hits = contamination(texts, benchmark, n, "_key", "text", item_id, item_text, block_words).where(F.size("spans") > 0)
    hits = written(hits.select(F.col("_key").alias("_hit"), "spans"), "decontaminate-cuts")
    marked = rows.join(hits, rows["_key"] == hits["_hit"], "left")
    marked = marked.select(*[F.col("_doc")[c].alias(c) for c in docs.columns], hits["spans"].alias("_hit_ranges"))
    return marked.mapInArrow(run, schema)
