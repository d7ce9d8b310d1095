"""Collocations: the best-scoring phrases of each language, by best-first branch and bound.

A phrase grows from its first word. Cutting it behind that word shows that no phrase beginning with
a word seen f times scores above ``1000 * n / f``: the rest is seen at least as often as the whole.
So the frontier is the words by frequency, rarest first. The first round expands the rarest words
that hold a share of each language's text. From then on only words whose bound reaches the
language's last surviving score, ties included, can matter: the next round expands those, and what
is left is settled.

Texts are read to count words, to write down the stretches of frequent words as 64-bit hashes of
(language, word), and at the end to spell the phrases that come out; all else works on stretches. Within a round phrases grow by length
(2, 3, then 4 and 5 words). A phrase is counted only where its first word is in the frontier and its
shorter parts are frequent, as far as they were counted. What is frequent is known to a task from a
bit table of bounded size, so a few others are counted too and leave by their count. Counts are
added up in the task first, and shuffled as (hash, count); the last pass counts the few that are
left by their words, so collisions of their hashes do not last. That pass also notes whether all
places of a phrase have the same neighbour to the left or right: then the longer phrase is as
frequent, and the phrase is dropped. Parts that begin outside the frontier are looked up at the end
by one more pass over just those; until then their last word stands for them, which takes no score
too high.

Texts are lower-cased (A-Z) and cut at ``. , ; : ! ?`` and line breaks; words lie between blanks and
tabs. A null language is ``und``, a null text empty. Repeated rows count each time. An empty table
gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsmood.llm.components import bit_set, bit_table
from newsmood.llm.words import LOWER, broadcast, mixed, slices, words_of, written
from newsmood.operators.articles import top_n_per_group

LEAST = 100  # places of a phrase
LONGEST = 5  # words of a phrase
TOP = 2000
SHARE = 1 / 8  # of a language's frequent words' places, expanded first
HELD = 1 << 20  # hashes a task holds before it sends their sums
PIECE = 1 << 18  # words at once
MOST_BITS = 30

_BYTE = np.arange(256)
BREAKS = np.isin(_BYTE, [*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D])
PHRASE = ~BREAKS & (_BYTE != 0x20) & (_BYTE != 0x09)

_U = np.uint64


def _hash(value: bytes) -> int:
    return int.from_bytes(hashlib.sha256(value).digest()[:8], "little")


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64))


@dataclass
class Marked:
    """Words of some texts, told apart by language."""

    words: object  # newsmood.llm.words.Words
    langs: list[str]
    lang: np.ndarray  # of each word, as a place in langs
    one: np.ndarray  # hash of (language, word)


def marked(part: pa.RecordBatch) -> Marked:
    """The words of a batch (lang, text)."""
    w = words_of(part.column(1), PHRASE)
    lang = part.column(0).dictionary_encode()
    names = lang.dictionary.to_pylist()
    seeds = np.array([_hash(x.encode()) for x in names], _U)
    code = np.repeat(lang.indices.to_numpy(), np.diff(w.first))
    return Marked(w, names, code, mixed(w.hash ^ seeds[code]) if len(code) else w.hash)


def _heads(keys: np.ndarray) -> np.ndarray:
    """Places at which sorted keys change."""
    return np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ _U(1)) != 0) if len(keys) else np.zeros(0, np.int64)


class Counts:
    """Sums by key of what a task has met; ``take`` gives them, sorted by key, and begins anew."""

    def __init__(self):
        self.raw, self.n_raw, self.sums, self.n_sums = [], 0, [], 0

    def add(self, keys: np.ndarray) -> None:
        self.raw.append(keys)
        self.n_raw += len(keys)
        if self.n_raw > HELD // 2:
            self._pack()

    def _pack(self) -> None:
        flat = np.sort(np.concatenate([np.zeros(0, _U), *self.raw]))
        at = _heads(flat)
        self.sums.append((flat[at], np.diff(np.append(at, len(flat)))))
        self.n_sums += len(at)
        self.raw, self.n_raw = [], 0

    def full(self) -> bool:
        return self.n_sums > HELD

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._pack()
        keys, n = (np.concatenate(x) for x in zip(*self.sums, strict=True))
        self.sums, self.n_sums = [], 0
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], _heads(keys[order])
        return keys[at], np.add.reduceat(n[order], at) if len(at) else n


def _texts_of(w, at: np.ndarray) -> pa.Array:
    """The words at these places in lower case."""
    size = w.end[at] - w.start[at]
    ends = np.cumsum(size)
    place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(w.start[at], size)
    offsets = np.concatenate([np.zeros(1, np.int32), ends.astype(np.int32)])
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(LOWER[w.data[place]]))


def word_counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``lang, gram, n`` of the words seen ``least`` times, and ``lang, n`` of all words."""

    def run(batches):
        tallies: dict[str, Counts] = {}
        total: dict[str, int] = {}

        def rows(lang: str):
            keys, n = tallies[lang].take()
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), _signed(keys), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            for part in slices(batch, batch.schema.field(1).name):
                m = marked(part)
                for code, lang in enumerate(m.langs):
                    keys = m.one[m.lang == code]
                    total[lang] = total.get(lang, 0) + len(keys)
                    tallies.setdefault(lang, Counts()).add(keys)
                if sum(t.n_raw + t.n_sums for t in tallies.values()) > HELD:
                    for lang in tallies:
                        yield rows(lang)
                    tallies.clear()
        for lang in tallies:
            yield rows(lang)
        columns = [pa.array(list(total), pa.string()), pa.nulls(len(total), pa.int64()), pa.array(list(total.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])

    counts = docs.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    known = written(counts.where((F.col("n") >= least) | F.col("gram").isNull()), "phrase-words")
    return known.where("gram IS NOT NULL"), known.where("gram IS NULL AND n > 0").select("lang", "n")


def bits_of(grams: DataFrame) -> np.ndarray | None:
    """A bit table with 64 bits for each gram, within bounds."""
    n = grams.count()
    return bit_table(grams, "gram", min(MOST_BITS, max(16, math.ceil(math.log2(64 * n + 1))))) if n else None


def _in(table: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    return np.zeros(len(keys), bool) if table is None else bit_set(table, keys)


def stretches(docs: DataFrame, words) -> DataFrame:
    """``words``: per text the hashes of its words that may be frequent and have such a neighbour in
    their piece; 0 stands where others or a break lie between."""
    held: list = []
    get = broadcast(docs.sparkSession, words, held)

    def run(batches):
        frequent = get()
        for batch in batches:
            for part in slices(batch, batch.schema.field(1).name):
                m = marked(part)
                w = m.words
                row = np.repeat(np.arange(part.num_rows), np.diff(w.first))
                piece = np.cumsum(BREAKS[w.data], dtype=np.int32)[w.start]
                keep = np.flatnonzero(_in(frequent, m.one))
                near = (np.diff(keep) == 1) & (np.diff(row[keep]) == 0) & (np.diff(piece[keep]) == 0)
                keep = keep[np.append(near, False) | np.insert(near, 0, False)] if len(keep) else keep
                apart = (np.diff(keep) != 1) | (np.diff(row[keep]) != 0) | (np.diff(piece[keep]) != 0)
                gap = np.insert(apart, 0, False).astype(np.int64) if len(keep) else np.zeros(0, np.int64)
                place = np.arange(len(keep)) + np.cumsum(gap)
                out = np.zeros(int(place[-1]) + 1 if len(keep) else 0, np.int64)
                out[place] = m.one[keep].view(np.int64)
                # The gap before a text's first word belongs to the text before.
                ends = np.searchsorted(row[keep], np.arange(part.num_rows + 1))
                offsets = np.append(place, len(out))[ends].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))
                yield pa.RecordBatch.from_arrays([lists], names=["words"]).filter(pa.array(np.diff(offsets) > 0))

    out = written(docs.mapInArrow(run, "words array<long>"), "phrase-stretches")
    held[0].destroy()
    return out


def spelling(docs: DataFrame, wanted) -> DataFrame:
    """``gram, word`` of the words in a bit table."""
    held: list = []
    get = broadcast(docs.sparkSession, wanted, held)

    def run(batches):
        table, known = get(), np.zeros(0, _U)
        for batch in batches:
            for part in slices(batch, batch.schema.field(1).name):
                m = marked(part)
                at = np.flatnonzero(_in(table, m.one))
                keys, first = np.unique(m.one[at], return_index=True)
                new = ~np.isin(keys, known, assume_unique=True)
                if new.any():
                    known = np.union1d(known, keys[new])
                    at = at[first[new]]
                    yield pa.RecordBatch.from_arrays([_signed(m.one[at]), _texts_of(m.words, at)], names=["gram", "word"])

    out = written(docs.mapInArrow(run, "gram long, word string").distinct(), "phrase-spelling")
    held[0].destroy()
    return out


def _longer(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one word more."""
    return mixed(phrase * _U(0xA0761D6478BD642F) + word)


@dataclass
class Stretches:
    """Words in a row, and how many of the stretch there are from each one on (0: a gap)."""

    one: np.ndarray
    left: np.ndarray

    def grams(self, longest: int) -> list[np.ndarray]:
        """Hashes of the 1, 2, .. words from each word on; beyond the stretch they mean nothing."""
        out = [self.one]
        for m in range(1, longest):
            after = np.zeros(len(self.one), _U)
            after[: max(len(self.one) - m, 0)] = self.one[m:]
            out.append(_longer(out[-1], after))
        return out


def _read(batch: pa.RecordBatch) -> Iterator[Stretches]:
    """The rows of a batch, some ``PIECE`` words or one row at a time."""
    lists = batch.column(0)
    size = np.asarray(lists.value_lengths())
    ends = np.cumsum(size)
    row = 0
    while row < len(size):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] - size[row] + PIECE, "right")))
        flat = np.asarray(lists.slice(row, stop - row).flatten())
        if len(flat):
            first = np.zeros(len(flat), bool)
            first[np.cumsum(size[row:stop]) - size[row:stop]] = True
            cut = np.append(np.flatnonzero((flat == 0) | first), len(flat))
            # Up to the next gap or text.
            place = np.arange(len(flat))
            left = cut[np.searchsorted(cut, place, "right")] - place
            left[flat == 0] = 0
            yield Stretches(flat.view(_U), left)
        row = stop


def grown(rows: DataFrame, sizes: tuple[int, ...], base: int, frontier, shorter, least: int) -> DataFrame:
    """``gram, n`` of the phrases of these sizes, ``least`` times seen, that begin in the frontier
    and whose parts of ``base`` words may all be frequent. The last two are bit tables."""
    held: list = []
    get = broadcast(rows.sparkSession, (frontier, shorter), held)

    def run(batches):
        first, short = get()
        tally = Counts()

        def sums():
            keys, n = tally.take()
            return pa.RecordBatch.from_arrays([_signed(keys), pa.array(n)], names=["gram", "n"])

        for m in (m for batch in batches for m in _read(batch)):
            grams, own = m.grams(max(sizes)), _in(first, m.one)
            if base > 1:
                known = _in(short, grams[base - 1])
                may = known | ~own
                own &= known
            for k in sizes:
                at = np.flatnonzero(own & (m.left >= k))
                if base > 1:
                    for j in range(1, k - base + 1):
                        at = at[may[at + j]]
                tally.add(grams[k - 1][at])
            if tally.full():
                yield sums()
        yield sums()

    counts = rows.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    out = written(counts, "phrase-grams")
    held[0].destroy()
    return out


def phrases(rows: DataFrame, wanted, least: int, longest: int = LONGEST) -> DataFrame:
    """Phrases by their words, of those in a bit table: ``gram, words, size, a``, whether a longer
    phrase is as frequent (``inside``), and the hashes of the parts that cuts leave."""
    held: list = []
    get = broadcast(rows.sparkSession, wanted, held)

    def run(batches):
        table = get()
        parts, size = {k: [] for k in range(2, longest + 1)}, 0

        def one(k: int, columns) -> tuple[np.ndarray, ...]:
            """Sums by phrase; a neighbour is 0 unless it is always the same."""
            keys, n, before, after, words = columns
            order = np.argsort(keys, kind="stable")
            at = _heads(keys[order])
            same = lambda x: np.where(np.minimum.reduceat(x[order], at) == np.maximum.reduceat(x[order], at), x[order[at]], 0)
            return keys[order[at]], np.add.reduceat(n[order], at), same(before), same(after), words(order[at])

        def sums():
            for k, held_ in parts.items():
                if not held_:
                    continue
                keys, n, before, after, words = (np.concatenate(x) for x in zip(*held_, strict=True))
                _, n, before, after, words = one(k, (keys, n, before, after, lambda at: words[at]))  # noqa: B023
                lists = pa.FixedSizeListArray.from_arrays(pa.array(words.ravel().view(np.int64)), k).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([lists, pa.array(n), pa.array(before), pa.array(after)], names=["words", "a", "before", "after"])
                held_.clear()

        for m in (m for batch in batches for m in _read(batch)):
            grams, n = m.grams(longest), len(m.one)
            signed = m.one.view(np.int64)
            for k, held_ in parts.items():
                at = np.flatnonzero(m.left >= k)
                at = at[_in(table, grams[k - 1][at])]
                if not len(at):
                    continue
                # Neighbours: the word before or behind in the stretch, 0 for none.
                lead = np.where((at > 0) & (m.left[at - 1] == m.left[at] + 1), signed[at - 1], 0)
                follow = np.where(m.left[at] > k, signed[np.minimum(at + k, n - 1)], 0)
                words = lambda x: m.one[at[x][:, None] + np.arange(k)]  # noqa: B023, E731
                held_.append(one(k, (grams[k - 1][at], np.ones(len(at), np.int64), lead, follow, words)))
                size += len(held_[-1][0])
            if size > HELD // 2:
                yield from sums()
                size = 0
        yield from sums()

    same = lambda c: (F.min(c) == F.max(c)) & (F.min(c) != 0)
    counts = (
        rows.mapInArrow(run, "words array<long>, a long, before long, after long")
        .groupBy("words")
        .agg(F.sum("a").alias("a"), (same("before") | same("after")).alias("inside"))
        .where(F.col("a") >= least)
    )
    schema = "gram long, words array<long>, size int, a long, inside boolean, firsts array<long>, rests array<long>"

    def parted(batches):
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            size = np.asarray(batch.column(0).value_lengths())
            for k in np.unique(size).tolist():
                part = batch.filter(pa.array(size == k))
                words = np.asarray(part.column(0).flatten()).view(_U).reshape(-1, k)
                # Column j of level i: the phrase of i + 1 words from word j on.
                levels = [words]
                for i in range(1, k):
                    levels.append(_longer(levels[-1][:, :-1], words[:, i:]))
                firsts = np.stack([levels[c - 1][:, 0] for c in range(1, k)], axis=1)
                rests = np.stack([levels[k - c - 1][:, c] for c in range(1, k)], axis=1)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().view(np.int64)), k - 1).cast(pa.list_(pa.int64())) for x in (firsts, rests)]
                inside = part.column(2) if k < LONGEST else pa.array(np.zeros(len(words), bool))
                columns = [_signed(levels[-1][:, 0].copy()), part.column(0), pa.array(np.full(len(words), k, np.int32)), part.column(1), inside, *lists]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = written(counts.mapInArrow(parted, schema), "phrase-texts")
    held[0].destroy()
    return out


def scored(found: DataFrame, counts: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """``gram, words, lang, a, l, r, n, score`` by the lowest-scoring cut, the smallest of equal ones.

    A rest that was not counted is taken to be as frequent as its last word, so that the score is no
    higher than the true one.
    """
    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = found.select("gram", "words", "a", "firsts", "rests", k).select(
        "gram", "words", "a", "k", F.expr("firsts[k - 1]").alias("first"), F.expr("rests[k - 1]").alias("rest")
    )
    left = counts.select(F.col("gram").alias("first"), F.col("a").alias("l"))
    right = counts.select(F.col("gram").alias("rest"), F.col("a").alias("r"))
    lang = words.select(F.col("gram").alias("last"), "lang", F.col("n").alias("most")).join(totals, "lang")
    rows = cuts.join(left, "first").join(right, "rest", "left").withColumn("last", F.element_at("words", -1)).join(lang, "last")
    rows = rows.withColumn("r", F.coalesce("r", "most"))
    # Both products stay below 38 digits.
    score = F.expr("CAST(1000 * a AS decimal(19,0)) * CAST(n AS decimal(18,0)) DIV (CAST(l AS decimal(18,0)) * CAST(r AS decimal(18,0)))")
    cut = F.struct(score.alias("score"), "k", "l", "r").alias("cut")
    best = rows.select("gram", "words", "lang", "a", "n", cut).groupBy("gram", "words", "lang", "a", "n").agg(F.min("cut").alias("cut"))
    return best.select("gram", "words", "lang", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score"))


def spelled(found: DataFrame, words: DataFrame) -> DataFrame:
    """The rows with their ``phrase``."""
    texts = (
        found.select("gram", F.posexplode("words").alias("at", "one"))
        .join(words.select(F.col("gram").alias("one"), "word"), "one")
        .groupBy("gram")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    )
    return found.join(texts, "gram")


def _first_frontier(words: DataFrame, share: float) -> DataFrame:
    """``lang, most``: the rarest words up to ``most`` places hold the share of the language's
    frequent words, or are the first class of them. Classes are quarter powers of two of a count."""
    size = F.floor(4 * F.log2("n"))
    classes = words.groupBy("lang", size.alias("size")).agg(F.sum("n").alias("mass"), F.max("n").alias("most"))
    up = W.partitionBy("lang").orderBy("size")
    every = W.partitionBy("lang")
    part = classes.select("lang", "most", F.row_number().over(up).alias("nth"), F.sum("mass").over(up).alias("sum"), F.sum("mass").over(every).alias("all"))
    return part.where((F.col("sum") <= share * F.col("all")) | (F.col("nth") == 1)).groupBy("lang").agg(F.max("most").alias("most"))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, share: float = SHARE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases."""
    texts = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].cast("string").alias("text"))
    frequent, totals = word_counts(texts, least)
    rows, words = stretches(texts, bits_of(frequent)), frequent
    edge = written(_first_frontier(words, share), "phrase-frontier")
    frontier = words.join(edge, "lang").where("n <= most")
    counts, found = words.select("gram", F.col("n").alias("a")), None
    for last in (False, True):
        first = bits_of(frontier.select("gram"))
        if first is None:
            break
        two = grown(rows, (2,), 1, first, None, least)
        three = grown(rows, (3,), 2, first, bits_of(two), least)
        more = grown(rows, (4, 5), 3, first, bits_of(three), least)
        grams = two.unionByName(three).unionByName(more)
        if found is not None:  # a bit table may let a word of the first round pass again
            grams = grams.join(found.select("gram"), "gram", "left_anti")
        now = phrases(rows, bits_of(grams), least).join(grams.select("gram"), "gram", "left_semi")
        found = now if found is None else found.unionByName(now)
        counts = counts.unionByName(now.select("gram", "a"))
        if last:
            break
        # What is left of the frontier can matter where its bound reaches the last score so far.
        # Rests that begin outside the frontier are not counted yet; no score is taken too high.
        best = top_n_per_group(scored(found.where("NOT inside"), counts, words, totals), ["lang"], [F.desc("score")], top)
        settled = best.groupBy("lang").agg(F.when(F.count("*") >= top, F.min("score")).otherwise(0).alias("score"))
        bound = F.expr("1000 * total DIV n")
        frontier = (
            words.join(edge, "lang")
            .where("n > most")
            .join(totals.withColumnRenamed("n", "total"), "lang")
            .join(settled, "lang", "left")
            .where(bound >= F.coalesce("score", F.lit(0)))
        )
        frontier = written(frontier, "phrase-frontier")
    if found is None:
        return texts.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    alive = found.where("NOT inside")
    rests = alive.select(F.explode("rests").alias("gram")).distinct()
    missing = bits_of(written(rests.join(counts, "gram", "left_anti"), "phrase-rests"))
    if missing is not None:
        other = phrases(rows, missing, least, LONGEST - 1).select("gram", "a").join(counts, "gram", "left_anti")
        counts = counts.unionByName(other)
    # Phrases decide among equal scores and counts only; those that may come out are spelled.
    every = written(scored(alive, counts, words, totals), "phrase-scores")
    tied = top_n_per_group(every, ["lang"], [F.desc("score"), F.desc("a")], top).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("least"))
    some = every.join(tied, "lang").where(F.struct("score", "a") >= F.col("least")).drop("least")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = written(some, "phrase-best")
    needed = some.select(F.explode("words").alias("gram")).distinct()
    best = top_n_per_group(spelled(some, spelling(texts, bits_of(needed))), ["lang"], order, top)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")
    return best.select("lang", rank.alias("rank"), "phrase", "a", "l", "r", "n", "score")
