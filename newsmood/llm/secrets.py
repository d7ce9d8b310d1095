"""Secrets: fixed patterns, and random-looking strings by two character Markov models.

Labelled samples come from the corpus: the values that the fixed patterns find are random
strings, the other runs of identifier characters are ordinary identifiers. Two first-order
models (one symbol given the one before it, with a start symbol; transitions count on top of
``BACK_OFF`` drawn from the symbols' own shares, those with add-``SMOOTH`` smoothing) are counted from all documents in one scan: tasks send sums over a fixed alphabet. Without any
sample a model is uniform. A second scan scores every run of ``least`` or more identifier
characters that no fixed pattern covers by the log-likelihood ratio of the models; runs of
``nats`` or more in all (odds of e to that power) are secrets, too. Narrow but for the sums.

Nulls and empty texts have no spans; equal rows have equal spans; an empty table gives no rows.
Positions are code points, end exclusive. Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmood.llm.words import pick, raw, rows_with, runs, slices

LEAST = 16
NATS = 10.0
SMOOTH = 0.5
BACK_OFF = 8.0

# Kinds in their order and the patterns of the contract.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = ("passw", "secret", "token", "api")
# End of the fixed values.

_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SYMBOL = np.full(256, -1, np.int64)
_SYMBOL[np.frombuffer(_ALPHABET, np.uint8)] = np.arange(len(_ALPHABET))
_MEMBER = _SYMBOL >= 0
_MARKS = np.zeros(256, bool)
_MARKS[[58, 61]] = True  # : and =
_HEXES = np.zeros(256, bool)
_HEXES[[*range(48, 58), *range(97, 103)]] = True
K = len(_ALPHABET)
START = K

SPAN = "struct<kind:string,start:long,end:long>"


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) of the fixed patterns, by start, then kind."""
    found = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(x in low for x in _NAMES):
            found += [("assign", *m.span(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span(), m.start()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span(), m.start()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _maybe(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows in which a fixed pattern can match: with : or =, or a long run of capitals or hex."""
    capital = np.zeros(256, bool)
    capital[[*range(48, 58), *range(65, 91)]] = True
    out = rows_with(data, offsets, _MARKS)
    for member, least in ((capital, 20), (_HEXES, 24)):
        s, _ = runs(data, offsets, member, least)
        out[np.searchsorted(offsets, s, "right") - 1] = True
    return out


def _found(part: pa.RecordBatch, at: int):
    """Base spans of the rows that have any, and the byte ranges of their values' cover."""
    column = part.column(at)
    data, offsets = raw(column)
    spans: dict[int, list] = {}
    values, cover = [], []
    for r in np.flatnonzero(_maybe(data, offsets)).tolist():
        text = column[r].as_py() or ""
        hits = base_spans(text)
        if hits:
            spans[r] = hits
            lead = (data[offsets[r] : offsets[r + 1]] & 0xC0) != 0x80
            byte_at = np.append(np.flatnonzero(lead), len(lead)) + offsets[r]
            for _, a, b, v in hits:
                cover.append((byte_at[a], byte_at[b]))
                values.append((byte_at[v], byte_at[b]))
    return data, offsets, spans, np.array(values, np.int64).reshape(-1, 2), np.array(cover, np.int64).reshape(-1, 2)


def _free(s: np.ndarray, e: np.ndarray, cover: np.ndarray) -> np.ndarray:
    """Ranges that touch none of the covering ones."""
    if not len(cover):
        return np.ones(len(s), bool)
    cover = cover[np.argsort(cover[:, 0])]
    reach = np.maximum.accumulate(cover[:, 1])
    before = np.searchsorted(cover[:, 0], e, "left") - 1  # the last that begins before the end
    return (before < 0) | (reach[np.maximum(before, 0)] <= s)


def _steps(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transitions (from * K + to) of the runs, and where each run's begin."""
    size = e - s
    begin = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(begin, size) + np.repeat(s, size)
    to = _SYMBOL[data[at]]
    before = np.empty_like(to)
    before[1:] = to[:-1]
    before[begin] = START
    ok = (to >= 0) & (before >= 0)
    return np.where(ok, before * K + to, -1), begin


def train(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Transition counts of random strings (0) and ordinary identifiers (1)."""

    def count(batches):
        total = np.zeros((2, (K + 1) * K), np.int64)
        for batch in batches:
            for part in slices(batch, batch.schema.field(0).name):
                data, offsets, _, values, cover = _found(part, 0)
                s, e = runs(data, offsets, _MEMBER, 4)
                free = _free(s, e, cover)
                for k, (a, b) in enumerate(((values[:, 0], values[:, 1]), (s[free], e[free]))):
                    if len(a):
                        step, _ = _steps(data, a, b)
                        total[k] += np.bincount(step[step >= 0], minlength=total.shape[1])
        model, step = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(model), pa.array(step), pa.array(total[model, step])], names=["model", "step", "n"]
        )

    rows = (
        pick(docs, text).mapInArrow(count, "model long, step long, n long").groupBy("model", "step").agg(F.sum("n").alias("n"))
    ).collect()  # at most one row for each pair of symbols and model
    total = np.zeros((2, (K + 1) * K), np.int64)
    for r in rows:
        total[r.model, r.step] = r.n
    return total


def ratios(counts: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each transition: random string over ordinary identifier."""
    c = counts.reshape(2, K + 1, K).astype(float)
    alone = c.sum(axis=1, keepdims=True) + SMOOTH
    alone /= alone.sum(axis=2, keepdims=True)
    logs = np.log((c + BACK_OFF * alone) / (c.sum(axis=2, keepdims=True) + BACK_OFF))
    return (logs[0] - logs[1]).reshape(-1)


def find_secrets(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least: int = LEAST,
    nats: float = NATS,
    counts: np.ndarray | None = None,
) -> DataFrame:
    """One row per document row: ``doc_id, base, random`` spans and ``score``, the highest
    log-likelihood ratio of a run in the text (null without runs). ``counts`` from ``train`` may be given."""
    ratio = ratios(train(docs, text) if counts is None else counts)
    rows = pick(docs, doc_id, text)
    schema = T.StructType([rows.schema[0], *T.StructType.fromDDL(f"base array<{SPAN}>, random array<{SPAN}>, score double")])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, batch.schema.field(1).name):
                data, offsets, spans, _, cover = _found(part, 1)
                s, e = runs(data, offsets, _MEMBER, least)
                free = _free(s, e, cover)
                s, e = s[free], e[free]
                more: dict[int, list] = {}
                best: list = [None] * part.num_rows
                if len(s):
                    step, begin = _steps(data, s, e)
                    total = np.add.reduceat(ratio[step], begin)
                    row = np.searchsorted(offsets, s, "right") - 1
                    # Code points before each byte, counted once: places within a text are differences.
                    points = np.concatenate([np.zeros(1, np.int32), np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
                    place = points[s] - points[offsets[row]]
                    for i in range(len(s)):
                        r, score = int(row[i]), float(total[i])
                        best[r] = score if best[r] is None else max(best[r], score)
                        if score >= nats:
                            a = int(place[i])
                            more.setdefault(r, []).append({"kind": "markov", "start": a, "end": a + int(e[i] - s[i])})
                base = [[{"kind": k, "start": a, "end": b} for k, a, b, _ in spans.get(r, ())] for r in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(arrow.field(0).type),
                        pa.array(base, arrow.field(1).type),
                        pa.array([more.get(r, []) for r in range(part.num_rows)], arrow.field(2).type),
                        pa.array(best, pa.float64()),
                    ],
                    schema=arrow,
                )

    return rows.mapInArrow(run, schema)
