"""Personal data: fixed patterns, and terms that reveal what the patterns protect.

A pattern match is a protected entity (kind and value). Terms are the words up to ``window``
places before or after it. How much a term gives away is estimated from the whole corpus by
co-occurrence with three concepts c that the entity stands for: the entity itself, its group (an
e-mail's domain, an address's network, the leading digits of a card or phone) and its kind. The
share is PMI(c; t) / IC(c), with

    PMI = log(N * n_ct / (n_c * n_t))        IC = log(N / n_c)

counted in contexts. The contexts of a concept are its different surroundings (n_c; n_ct with the
term) and the texts without it; those of a term (n_t) its surroundings of the concept and the
texts that have it elsewhere alone. So copies of a text are one context, and the share is 1 for a
term seen only with the concept, also if the entity occurs once. Terms with a share of
``threshold`` or more for any of the three are disclosing, if the term (not the entity) has
``support`` contexts: different surroundings of any entity and texts with it away from all. A term
of fewer contexts is not judged. ``sanitize`` generalises or removes disclosing terms wherever
they stand in a document with the entity.

Text counts of terms come from a second scan that only counts terms of a bit table of fixed size,
filled with the candidates; a third scan places the disclosing pairs of another one. What a table
lets through besides them falls out in a join. No scan shuffles texts.

Nulls and empty texts have no spans; rows are told apart by id and text hash, and rows equal in
both have equal spans; an empty table gives no rows. Positions are code points, end exclusive.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmood.llm.components import bit_set, bit_table
from newsmood.llm.words import ALNUM, pick, raw, rows_with, slices, words_of, written

WINDOW = 8
SUPPORT = 3
THRESHOLD = 0.8
TABLE_BITS = 26

# Kinds in their order and the patterns of the contract.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# End of the fixed values.

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MARKS = np.zeros(256, bool)
_MARKS[[64, *range(48, 58)]] = True

SPAN = "struct<kind:string,start:long,end:long>"


def _emails(text: str):
    """Leftmost matches: each @ takes the run of local characters before it, then a domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            yield start, free
        at = text.find("@", free)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _part_fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind."""
    found = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(_part_fits(x) for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= x <= "9" for x in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _key(data: bytes) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _value(kind: str, text: str) -> bytes:
    """One spelling of an entity: lower case, or digits alone."""
    value = text.lower() if kind in ("email", "ip") else re.sub(r"[^0-9]", "", text)
    return f"{kind}:{value}".encode()


def _group(kind: str, value: bytes) -> bytes:
    """What an entity shares with others of its kind: domain, network or leading digits."""
    name = value[len(kind) + 1 :]
    part = {"email": name.partition(b"@")[2], "ip": name.rpartition(b".")[0]}.get(kind, name[:6])
    return f"{kind} group:".encode() + part


def _surroundings(text: str, spans: list[tuple[str, int, int]], window: int):
    """Words with code point places, which of them are no part of an entity, and for each entity
    its value and the numbers of its terms. None if there are no words."""
    w = words_of(pa.array([text]), ALNUM)
    if not len(w.start):
        return None
    nth = np.cumsum((w.data & 0xC0) != 0x80)  # code points up to and with each byte
    start, end = nth[w.start] - 1, nth[w.end - 1]
    taken = np.zeros(len(start), bool)
    for _, a, b in spans:
        taken |= (start < b) & (end > a)
    near = []
    for kind, a, b in spans:
        lo, hi = int(np.searchsorted(end, a, "right")), int(np.searchsorted(start, b, "left"))
        at = np.array([*range(max(0, lo - window), lo), *range(hi, min(len(start), hi + window))], np.int64)
        near.append((kind, _value(kind, text[a:b]), at[~taken[at]]))
    return w.hash, start, end, ~taken, near


def _concepts(text: str, spans: list[tuple[str, int, int]], window: int) -> list[dict]:
    """The concepts of each entity, a key of its whole surrounding, and its terms."""
    found = _surroundings(text, spans, window)
    if found is None:
        return []
    words, _, _, _, near = found
    return [
        {
            "entity": _key(value),
            "group": _key(_group(kind, value)),
            "kind": _key(f"{kind} kind".encode()),
            "around": _key(words[at].tobytes()),
            "terms": np.unique(words[at]).view(np.int64).tolist(),
        }
        for kind, value, at in near
    ]


FOUND = (
    f"text_key long, base array<{SPAN}>, "
    "near array<struct<entity:long,group:long,kind:long,around:long,terms:array<long>>>"
)


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, text_key, base`` spans and ``near``, the surroundings, of each row. Narrow."""
    rows = pick(docs, doc_id, text).withColumn("text_key", F.xxhash64(text))
    key_name, text_name = rows.columns[0], text
    schema = T.StructType([rows.schema[0], *T.StructType.fromDDL(FOUND)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, text_name):
                column = part.column(1)
                maybe = rows_with(*raw(column), _MARKS)
                base: list = [[] for _ in range(part.num_rows)]
                near: list = [[] for _ in range(part.num_rows)]
                for r in np.flatnonzero(maybe).tolist():
                    full = column[r].as_py() or ""
                    spans = base_spans(full)
                    if spans:
                        base[r] = [{"kind": k, "start": a, "end": b} for k, a, b in spans]
                        near[r] = _concepts(full, spans, window)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(arrow.field(0).type),
                        part.column(2).cast(pa.int64()),
                        pa.array(base, arrow.field(2).type),
                        pa.array(near, arrow.field(3).type),
                    ],
                    schema=arrow,
                )

    return rows.select(key_name, text_name, "text_key").mapInArrow(run, schema)


def _texts_with(docs: DataFrame, found: DataFrame, text: str, terms: DataFrame) -> DataFrame | None:
    """``term, texts``: different texts with each term. None if there are no terms.

    Texts that may have copies give each of their terms with the text's key, others counts."""
    packed = bit_table(terms, "term", TABLE_BITS)
    if packed is None:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(packed)
    copied = bit_table(found.groupBy("text_key").count().where("count > 1"), "text_key", TABLE_BITS)
    copied = docs.sparkSession.sparkContext.broadcast(np.zeros(1, np.uint8) if copied is None else copied)

    def count(batches):
        for batch in batches:
            for part in slices(batch, batch.schema.field(0).name):
                w = words_of(part.column(0), ALNUM)
                row = np.repeat(np.arange(part.num_rows), np.diff(w.first))
                hit = bit_set(shared.value, w.hash)
                term, nth = np.unique(w.hash[hit], return_inverse=True)
                nth, row = np.divmod(np.unique(nth * part.num_rows + row[hit]), part.num_rows)
                key = part.column(1).to_numpy(zero_copy_only=False)
                again = bit_set(copied.value, key)[row]
                n = np.bincount(nth[~again], minlength=len(term))
                once = n > 0
                term = term.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([term[once], term[nth[again]]])),
                        pa.concat_arrays([pa.nulls(int(once.sum()), pa.int64()), pa.array(key[row[again]], pa.int64())]),
                        pa.array(np.concatenate([n[once], np.ones(int(again.sum()), np.int64)])),
                    ],
                    names=["term", "key", "n"],
                )

    counted = pick(docs, text).withColumn("_key", F.xxhash64(text)).mapInArrow(count, "term long, key long, n long")
    counted = counted.groupBy("term", "key").agg(F.sum("n").alias("n"))
    return counted.groupBy("term").agg(F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(1)).alias("texts"))


def disclosing(
    docs: DataFrame, found: DataFrame, text: str = "text", support: int = SUPPORT, threshold: float = THRESHOLD
) -> DataFrame | None:
    """``entity, term, share`` of disclosing pairs, or None if no entity has a term beside it.
    The share is the largest of those of the entity, its group and its kind."""
    near = found.where(F.size("near") > 0).select("text_key", F.explode("near").alias("n"))
    near = written(near.select("text_key", "n.*").distinct(), "pii-near")
    terms = near.select("text_key", "around", F.explode("terms").alias("term"))
    counts = _texts_with(docs, found, text, terms.select("term").distinct())
    if counts is None:
        return None
    contexts = (F.count_distinct("around"), F.count_distinct("text_key"))
    beside = terms.groupBy("term").agg(contexts[0].alias("a"), contexts[1].alias("t"))
    counts = counts.join(beside, "term").where(F.col("texts") - F.col("t") + F.col("a") >= support)
    counts = written(counts.select("term", "texts"), "pii-terms-counted")
    concept = F.explode(F.array_distinct(F.array("entity", "group", "kind"))).alias("concept")
    named = near.select(concept, "text_key", "around", "terms")
    concepts = named.groupBy("concept").agg(contexts[0].alias("n_c"), contexts[1].alias("texts_c"))
    pairs = named.select("concept", "text_key", "around", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("concept", "term").agg(contexts[0].alias("n_ct"), contexts[1].alias("texts_ct"))
    pairs = written(pairs, "pii-pairs")
    total = F.lit(float(found.select("text_key").distinct().count())) - F.col("texts_c") + F.col("n_c")
    n_t = F.col("texts") - F.col("texts_ct") + F.col("n_ct")
    share = F.log(total * F.col("n_ct") / (F.col("n_c") * n_t)) / F.greatest(F.log(total / F.col("n_c")), F.lit(1e-9))
    telling = (
        pairs.join(counts, "term")
        .join(concepts, "concept")
        .select("concept", "term", share.alias("share"))
        .where(F.col("share") >= threshold)
    )
    of = near.select(concept, "entity", F.explode("terms").alias("term")).distinct()
    return of.join(written(telling, "pii-telling"), ["concept", "term"]).groupBy("entity", "term").agg(F.max("share").alias("share"))


def _placed(docs: DataFrame, doc_id: str, text: str, telling: DataFrame, window: int) -> DataFrame | None:
    """``_id, _key, terms``: the spans of disclosing terms of rows that have any, all over the
    text. None if no pair is disclosing."""
    packed = bit_table(telling.select(F.col("entity").bitwiseXOR(F.col("term")).alias("pair")), "pair", TABLE_BITS)
    if packed is None:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(packed)
    rows = pick(docs, doc_id, text).withColumn("text_key", F.xxhash64(text))
    schema = T.StructType(
        [
            T.StructField("_id", rows.schema[0].dataType),
            *T.StructType.fromDDL(f"_key long, term long, entities array<long>, spans array<{SPAN}>"),
        ]
    )
    rows = rows.select(rows[0].alias("_id"), F.col(text).alias("text"), F.col("text_key").alias("_key"))

    def of_text(full: str):
        """term, entities, spans of what may be a disclosing pair"""
        spans = base_spans(full)
        found = _surroundings(full, spans, window) if spans else None
        if found is None:
            return
        words, start, end, free, near = found
        entities: dict[int, set[int]] = {}
        for _, value, at in near:
            entity = _key(value)
            pairs = words[at] ^ np.int64(entity).astype(np.uint64)
            for term in words[at][bit_set(shared.value, pairs)].tolist():
                entities.setdefault(term, set()).add(entity)
        for term, of in entities.items():
            at = np.flatnonzero((words == np.uint64(term)) & free)
            places = [{"kind": "term", "start": a, "end": b} for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            yield int(np.uint64(term).astype(np.int64)), sorted(of), places

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, "text"):
                column = part.column(1)
                nth, out = [], []
                for r in np.flatnonzero(rows_with(*raw(column), _MARKS)).tolist():
                    new = list(of_text(column[r].as_py() or ""))
                    nth += [r] * len(new)
                    out += new
                at = pa.array(nth, pa.int64())
                values = [[x[k] for x in out] for k in range(3)]
                columns = [part.column(0).take(at), part.column(2).take(at), *map(pa.array, values, [f.type for f in list(arrow)[2:]])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    maybe = written(rows.mapInArrow(run, schema), "pii-placed")
    sure = maybe.select("_id", "_key", "term", F.explode("entities").alias("entity")).join(telling.select("entity", "term"), ["entity", "term"])
    sure = sure.select(F.col("_id").alias("i"), F.col("_key").alias("k"), F.col("term").alias("t")).distinct()
    same = maybe["_id"].eqNullSafe(sure["i"]) & (maybe["_key"] == sure["k"]) & (maybe["term"] == sure["t"])
    terms = maybe.join(sure, same, "left_semi").select("_id", "_key", F.explode("spans").alias("s"))
    return terms.groupBy("_id", "_key").agg(F.array_sort(F.collect_set("s")).alias("terms"))


def find_pii(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    support: int = SUPPORT,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document row: ``doc_id, text_key, base`` and ``terms`` (disclosing) spans."""
    found = written(extract(docs, doc_id, text, window), "pii")
    empty = F.lit([]).cast(f"array<{SPAN}>")
    telling = disclosing(docs, found, text, support, threshold)
    terms = None if telling is None else _placed(docs, doc_id, text, written(telling, "pii-disclosing"), window)
    key = found.columns[0]
    if terms is None:
        return found.select(key, "text_key", "base", empty.alias("terms"))
    terms = written(terms, "pii-terms")
    joined = found.join(terms, found[key].eqNullSafe(terms["_id"]) & found["text_key"].eqNullSafe(terms["_key"]), "left")
    return joined.select(key, "text_key", "base", F.coalesce("terms", empty).alias("terms"))


def _general(word: str) -> str:
    """A class in place of a term."""
    if any(x.isdigit() for x in word):
        return "[NUMBER]"
    return "[NAME]" if word[:1].isupper() else "[WORD]"


def _clean(text: str, terms: list, action: str) -> str:
    spans = [(a, b, f"[{k.upper()}]") for k, a, b in base_spans(text)]
    spans += [(x["start"], x["end"], _general(text[x["start"] : x["end"]]) if action == "generalize" else "") for x in terms]
    out, pos = [], 0
    for a, b, mark in sorted(spans):
        if a >= pos:
            out += [text[pos:a], mark]
        pos = max(pos, b)
    return "".join([*out, text[pos:]])


def sanitize(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    action: str = "generalize",
    window: int = WINDOW,
    support: int = SUPPORT,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """All rows and columns; entities become ``[EMAIL]`` and so on, disclosing terms a class of
    word (``generalize``) or nothing (``remove``). Texts without either stay as they were."""
    if action not in ("generalize", "remove"):
        raise ValueError(f"unknown action {action!r}")
    found = find_pii(docs, doc_id, text, window, support, threshold)
    key = found.columns[0]
    terms = written(
        found.where(F.size("terms") > 0).select(F.col(key).alias("_pii_id"), F.col("text_key").alias("_pii_key"), F.col("terms").alias("_pii_terms")).distinct(),
        "pii-marks",
    )
    schema, names = docs.schema, docs.columns
    at = names.index(text)
    # Columns go by place from here on, so that none of the table clashes with those added.
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    same = flat[f"c{names.index(doc_id)}"].eqNullSafe(terms["_pii_id"]) & (F.xxhash64(flat[f"c{at}"]) == terms["_pii_key"])
    marked = flat.join(terms, same, "left").drop("_pii_id", "_pii_key")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, batch.schema.field(at).name):
                column, extra = part.column(at), part.column(part.num_columns - 1)
                maybe = rows_with(*raw(column), _MARKS)
                columns = list(part.columns[:-1])
                if maybe.any():
                    texts = column.to_pylist()
                    for r in np.flatnonzero(maybe).tolist():
                        texts[r] = _clean(texts[r], extra[r].as_py() or [], action)
                    columns[at] = pa.array(texts, arrow.field(at).type)
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                )

    return marked.mapInArrow(run, schema)
