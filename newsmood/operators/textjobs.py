"""Keywords, summaries, entities and readability.

Each job works inside the row with array functions. A document is the unit of
work and its size is bounded, so there is nothing to shuffle: no exploded token
table is built, and a source or a set of copies that makes up a third of the
input costs the tasks that read it nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmood.functions.text import (
    EMAIL_PATTERN,
    URL_PATTERN,
    NOT_WS,
    WS,
    let,
    or_empty,
    sentences,
)

# Stop words, important words and entity patterns that results depend on.
BASIC_STOP_WORDS = (
    "the a an and or but in on at to for of with by is are was were be been have has had do does "
    "did will would could should may might must can this that these those i you he she it we they "
    "me him her us them my your his its our their"
).split()
NEWS_STOP_WORDS = (
    BASIC_STOP_WORDS
    + (
        "said says also one two three first second new old good bad big small more most many"
    ).split()
)
IMPORTANT_WORDS = (
    "said announced reported according confirmed new first major significant important "
    "million billion percent year today"
).split()
ORG_SUFFIX = "Inc|Corp|LLC|Ltd|Company|Group|Association|Foundation|Institute"
LOCATION_SUFFIX = "City|State|Country|County|Province|Street|Avenue|Boulevard|Road"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
ENTITY_KINDS = ("organizations", "locations", "money", "dates", "emails", "urls")

_WORD = r"\p{L}\p{N}_"


def _whole(letters: str) -> str:
    """Words made of ``letters`` only, three or more; possessive, so no retries inside a word."""
    return f"(?<![{_WORD}])[{letters}]{{3,}}+(?![{_WORD}])"


def _ranked_words(tokens: Column, k: int, score) -> Column:
    """The ``k`` best distinct tokens as ``struct(neg_score, pos, word, n)``, ties by first position.

    ``score(n, total)`` maps a word's count and the token total to a score. Tokens hold no blanks:
    sorted and joined, equal ones are a run that a pattern finds whole. Only of the words that may be
    among the best is the position looked up; of those that tie for the last place, the first ones.
    """

    def counted(t: Column) -> Column:
        found = F.regexp_extract_all(F.array_join(F.sort_array(t), " "), F.lit(r"([^ ]++)(?: \1(?![^ ]))*+"), F.lit(0))

        def entry(run: Column) -> Column:
            word = F.substring_index(run, " ", 1)
            n = ((F.length(run) + 1) / (F.length(word) + 1)).cast("int")
            return F.struct(word.alias("word"), n.alias("n"), (-score(n, F.size(t))).alias("neg_score"))

        return F.transform(found, entry)

    def best(t: Column, c: Column) -> Column:
        last = F.get(F.sort_array(F.transform(c, lambda x: x["neg_score"])), F.lit(k - 1))

        def among(x: Column) -> Column:
            tied = F.transform(F.filter(c, lambda y: y["neg_score"] == x), lambda y: y["word"])
            first = F.slice(F.array_intersect(t, tied), 1, k)  # by first position
            return let(first, lambda f: F.filter(c, lambda y: (y["neg_score"] < x) | ((y["neg_score"] == x) & F.array_contains(f, y["word"]))))

        return F.when(F.size(c) <= k, c).otherwise(let(last, among))

    def placed(t: Column, c: Column) -> Column:
        at = lambda x: (F.array_position(t, x["word"]) - 1).cast("int").alias("pos")
        return F.slice(F.sort_array(F.transform(c, lambda x: F.struct(x["neg_score"].alias("neg_score"), at(x), x["word"].alias("word"), x["n"].alias("n")))), 1, k)

    return let(tokens, lambda t: let(let(counted(t), lambda c: best(t, c)), lambda c: placed(t, c)))


def basic_tokens(c: Column) -> Column:
    """ASCII words of three or more letters, lower-cased, stop words removed."""
    return F.filter(_find(F.lower(or_empty(c)), _whole("a-z")), lambda w: ~w.isin(BASIC_STOP_WORDS))


def news_tokens(c: Column) -> Column:
    """Alphabetic words of three or more characters, lower-cased, stop words removed."""
    return F.filter(_find(F.lower(or_empty(c)), _whole(r"\p{L}")), lambda w: ~w.isin(NEWS_STOP_WORDS))


def frequent_words(c: Column, k: int = 10) -> Column:
    """Array of ``struct(neg_score, pos, word, n)``: the ``k`` most frequent words."""
    return _ranked_words(basic_tokens(c), k, lambda n, total: n)


def frequent_keywords(c: Column, k: int = 10) -> Column:
    return F.transform(frequent_words(c, k), lambda x: x["word"])


def weighted_words(c: Column, k: int = 10) -> Column:
    """The ``k`` best words by ``(n / total) * ln(total / n)`` within the document."""
    return _ranked_words(
        news_tokens(c), k, lambda n, total: (n / total) * F.log(total / n)
    )


def weighted_keywords(c: Column, k: int = 10) -> Column:
    return F.transform(weighted_words(c, k), lambda x: x["word"])


def keyword_rows(df: DataFrame, ranked: Column, keys: tuple[str, ...] = ("seq",)) -> DataFrame:
    """One row per keyword: ``keys, rank, word, n, score``."""
    return df.select(*keys, F.posexplode(ranked).alias("i", "k")).select(
        *keys,
        (F.col("i") + 1).alias("rank"),
        F.col("k.word").alias("word"),
        F.col("k.n").alias("n"),
        (-F.col("k.neg_score")).alias("score"),
    )


def summarize(c: Column, k: int = 3) -> Column:
    """The ``k`` best sentences in text order, joined; shorter texts come back unchanged.

    A sentence whose text equals a chosen one is taken as well, in order, until
    ``k`` are collected.
    """

    def score(s: Column, low: Column, i: Column, n: Column) -> Column:
        total = (n - i) * F.lit(0.1)
        for word in IMPORTANT_WORDS:
            # Occurrences without overlap, from the length lost by deleting them.
            lost = F.length(low) - F.length(F.replace(low, F.lit(word), F.lit("")))
            total = total + (lost / len(word)) * F.lit(0.5)
        n_words = F.regexp_count(s, F.lit(f"{NOT_WS}+"))
        return total + F.when(n_words.between(10, 30), 1.0).otherwise(0.0)

    def pick(all_s: Column) -> Column:
        ranked = F.sort_array(
            F.transform(
                all_s,
                lambda s, i: F.struct(
                    let(F.lower(s), lambda low: -score(s, low, i, F.size(all_s))).alias("o"),
                    i.alias("i"),
                    s.alias("s"),
                ),
            )
        )
        top = F.transform(F.slice(ranked, 1, k), lambda x: x["s"])
        chosen = let(top, lambda t: F.slice(F.filter(all_s, lambda s: F.array_contains(t, s)), 1, k))
        return F.concat(F.array_join(chosen, ". "), F.lit("."))

    text = or_empty(c)
    return let(
        sentences(text), lambda s: F.when(F.size(s) <= k, text).otherwise(pick(s))
    )


def _find(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def _named(c: Column, suffixes: str, inside: str) -> Column:
    """Capitalised runs that end in one of the suffixes.

    A match lies within one run of ``inside`` characters and blanks. The text is
    cut at every other character, which stays on both sides as context for the
    word borders, and only pieces that hold a suffix are searched: over the whole
    text each capital letter would scan to the end of its run and back.
    """
    run = f"{inside}{WS[1:-1]}"
    pieces = F.split(F.regexp_replace(c, f"[^{run}]", "$0\x01$0"), "\x01")
    pattern = rf"(?U)\b[A-Z][{run}]+(?:{suffixes})\b"
    hits = F.transform(
        F.filter(pieces, lambda p: p.rlike(suffixes)), lambda p: _find(p, pattern)
    )
    return F.when(c.rlike(suffixes), F.flatten(hits)).otherwise(F.array().cast("array<string>"))


def entities(c: Column, kinds: tuple[str, ...] = ENTITY_KINDS) -> Column:
    """Map of entity kind to sorted distinct hits."""
    text = or_empty(c)
    ws = WS
    found = {
        "organizations": lambda: _named(text, ORG_SUFFIX, "a-zA-Z&."),
        "locations": lambda: _named(text, LOCATION_SUFFIX, "a-zA-Z"),
        "money": lambda: _find(
            text,
            rf"(?iU)\$[0-9,]+(?:\.[0-9]{{2}})?|\b[0-9,]+{ws}*(?:dollars?|USD|cents?)\b",
        ),
        "dates": lambda: F.concat(
            _find(text, r"(?U)\b\d{1,2}/\d{1,2}/\d{4}\b"),
            _find(text, r"(?U)\b\d{4}-\d{1,2}-\d{1,2}\b"),
            _find(text, rf"(?iU)\b(?:{MONTHS})[a-z]*{ws}+\d{{1,2}},?{ws}+\d{{4}}\b"),
        ),
        "emails": lambda: F.when(F.contains(text, F.lit("@")), _find(text, EMAIL_PATTERN)).otherwise(
            F.array().cast("array<string>")
        ),
        "urls": lambda: _find(text, URL_PATTERN),
    }
    unknown = set(kinds) - set(found)
    if unknown:
        raise ValueError(f"unknown entity kinds: {sorted(unknown)}")
    items = [
        x for kind in kinds for x in (F.lit(kind), F.sort_array(F.array_distinct(found[kind]())))
    ]
    return F.create_map(*items)


def entity_rows(
    df: DataFrame, text: str = "content", keys: tuple[str, ...] = ("seq",), kinds: tuple[str, ...] = ENTITY_KINDS
) -> DataFrame:
    """One row per distinct hit: ``keys, kind, entity``."""
    by_kind = df.select(*keys, F.explode(entities(F.col(text), kinds)).alias("kind", "hits"))
    return by_kind.select(*keys, "kind", F.explode("hits").alias("entity"))


def readability(c: Column) -> Column:
    """Counts, averages, clamped reading-ease score and band of a text.

    ``error`` is set and the measures are NULL when there is no sentence end or no word.
    """

    text = or_empty(c)
    # Letters and blanks only: words keep their borders, so one pass per text counts
    # vowel groups, and a second one the words that have letters but no vowel.
    letters = F.regexp_replace(text, f"[^a-zA-Z{WS[1:-1]}]+", "")
    counts = let(
        letters,
        lambda x: F.struct(
            F.regexp_count(text, F.lit("[.!?]+")).alias("sentences"),
            F.regexp_count(text, F.lit(f"{NOT_WS}+")).alias("words"),
            (
                F.regexp_count(x, F.lit("[aeiouyAEIOUY]+"))
                + F.regexp_count(x, F.lit(r"(?i)\b[b-df-hj-np-tv-xz]+\b"))
            ).alias("syllables"),
        ),
    )

    def measures(x: Column) -> Column:
        n, syl = x["words"], x["syllables"]
        usable = (x["sentences"] > 0) & (n > 0)
        per_sentence = F.try_divide(n, x["sentences"])
        per_word = F.try_divide(syl, n)
        raw = F.lit(206.835) - F.lit(1.015) * per_sentence - F.lit(84.6) * per_word
        return F.struct(
            x["sentences"].alias("sentences"),
            n.alias("words"),
            syl.alias("syllables"),
            F.when(usable, per_sentence).alias("avg_sentence_length"),
            F.when(usable, per_word).alias("avg_syllables_per_word"),
            F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))).alias("flesch_score"),
            F.when(~usable, "Insufficient text for analysis").alias("error"),
        )

    return let(
        let(counts, measures),
        lambda m: F.struct(
            *[m[f].alias(f) for f in (
                "sentences", "words", "syllables", "avg_sentence_length",
                "avg_syllables_per_word", "flesch_score",
            )],
            reading_band(m["flesch_score"]).alias("reading_level"),
            m["error"].alias("error"),
        ),
    )


# Reading-ease bands by lower bound.
READING_BANDS = (
    (90, "Very Easy"),
    (80, "Easy"),
    (70, "Fairly Easy"),
    (60, "Standard"),
    (50, "Fairly Difficult"),
    (30, "Difficult"),
)


def reading_band(score: Column) -> Column:
    case = F.when(score.isNull(), F.lit(None).cast("string"))
    for floor, name in READING_BANDS:
        case = case.when(score >= floor, name)
    return case.otherwise("Very Difficult")


def chunk_bounds(size: int, overlap: int) -> int:
    if size <= overlap:
        raise ValueError("chunk size must exceed the overlap")
    return size - overlap


def chunks(tokens: Column, max_length: int = 512, overlap: int | None = 50, skip_tail: bool = False) -> Column:
    """Array of chunk texts.

    With an overlap, windows of ``max_length - 2`` words every ``max_length - 2 -
    overlap`` words; with ``overlap=None``, windows of 70 % of ``max_length``
    side by side. The last window may repeat only the overlap; ``skip_tail``
    drops it then.
    """
    size = int(max_length * 0.7) if overlap is None else max_length - 2
    step = chunk_bounds(size, overlap or 0)

    def cut(t: Column) -> Column:
        last = F.size(t) - 1 - ((overlap or 0) if skip_tail else 0)
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), last), F.lit(step))
        windows = F.transform(starts, lambda i: F.array_join(F.slice(t, i + 1, size), " "))
        return F.when(F.size(t) == 0, F.array().cast("array<string>")).otherwise(windows)

    return let(tokens, cut)
