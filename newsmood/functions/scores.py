"""Score, label and confidence expressions.

Rule scores are summed as scaled integers and divided once at the end, so the
result does not depend on the order rows or tokens are visited in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsmood.functions.lexicon import Lexicon, lookup
from newsmood.functions.text import let
from newsmood.schema import LABELS

# Decision thresholds and confidence steps.
COMPOUND_CUT = 0.05
POLARITY_CUT = 0.1

# Degree-word weight at distance 1, 2, 3 and the capitals weight, in 1e-5 valence units;
# negation and "but" factors as exact fractions (published rule-lexicon method).
BOOST_STEPS = (29300, 27835, 26370)
CAPS_STEP = 73300
NEGATION_PERCENT = -74
BUT_TENTHS = (5, 15)
EXCLAIM_STEP = 29_200_000
EXCLAIM_MAX = 4
QUESTION_STEP = 18_000_000
QUESTION_MAX = 96_000_000
UNIT = 100_000_000  # one valence point
NORM_ALPHA = 15.0

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def threshold_label(score: Column, positive: float, negative: float, inclusive: bool = False) -> Column:
    hi = score >= positive if inclusive else score > positive
    lo = score <= negative if inclusive else score < negative
    return F.when(hi, "positive").when(lo, "negative").otherwise("neutral")


def compound_label(compound: Column) -> Column:
    return threshold_label(compound, COMPOUND_CUT, -COMPOUND_CUT, inclusive=True)


def normalize_label(score: Column, positive: float = 0.1, negative: float = -0.1) -> Column:
    return threshold_label(score, positive, negative)


def lexicon_confidence(compound: Column, pos: Column, neg: Column, neu: Column) -> Column:
    c = F.abs(compound)
    top = F.greatest(pos, neg, neu)
    base = F.when(c >= 0.5, 0.8).when(c >= 0.1, 0.6).otherwise(0.4)
    bonus = F.when(top >= 0.7, 0.2).when(top >= 0.5, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), base + bonus)


def polarity_confidence(polarity: Column, subjectivity: Column) -> Column:
    p = F.abs(polarity)
    base = F.least(F.lit(1.0), p + subjectivity * 0.5)
    return F.when(p >= 0.5, F.least(F.lit(1.0), base + 0.2)).otherwise(base)


def subjectivity_band(subjectivity: Column) -> Column:
    return (
        F.when(subjectivity >= 0.8, "Very subjective (opinion-based)")
        .when(subjectivity >= 0.6, "Mostly subjective")
        .when(subjectivity >= 0.4, "Somewhat subjective")
        .when(subjectivity >= 0.2, "Mostly objective")
        .otherwise("Very objective (fact-based)")
    )


def margin_confidence(scores: Column) -> Column:
    """Best minus second-best value of a score map, within 0..1; 0 for an empty map."""
    ranked = F.sort_array(F.map_values(scores), asc=False)
    margin = F.get(ranked, F.lit(0)) - F.coalesce(F.get(ranked, F.lit(1)), F.lit(0.0))
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), margin)), F.lit(0.0))


def is_valid_score(label: Column, confidence: Column, scores: Column) -> Column:
    return F.coalesce(
        label.isin(*LABELS) & confidence.between(0.0, 1.0) & scores.isNotNull(), F.lit(False)
    )


def map_model_label(label: Column) -> Column:
    """A model's own label to one of the three labels; unknown names are neutral."""
    name = F.lower(label)
    # Label synonyms of common models.
    return F.coalesce(
        F.when(name.isin("positive", "pos", "label_2", "2"), "positive")
        .when(name.isin("negative", "neg", "label_0", "0"), "negative")
        .when(name.isin("neutral", "label_1", "1"), "neutral")
        .when(name.contains("pos") | name.contains("good"), "positive")
        .when(name.contains("neg") | name.contains("bad"), "negative"),
        F.lit("neutral"),
    )


def bare_words(text: Column) -> Column:
    """Lower-case words of a collapsed text, punctuation trimmed from both ends."""
    return F.transform(F.split(F.lower(text), " "), lambda w: F.trim(w, F.lit(PUNCTUATION)))


def listed_words(text: Column, lexicon: Lexicon) -> Column:
    """``struct(low, at)``: the bare words of a collapsed text, and the places of those that the valence
    or polarity list has, for methods that look at the same text."""
    terms = list({**lexicon.valence, **lexicon.polarity})
    places = lambda low: F.array_compact(F.transform(low, lambda w, i: F.when(w.isin(terms), i)))
    nothing = F.array().cast("array<int>")

    def build(low: Column) -> Column:
        # Most texts hold no listed word at all; they are done after one look at each word.
        at = F.when(F.exists(low, lambda w: w.isin(terms)), places(low)).otherwise(nothing)
        return F.struct(low.alias("low"), at.alias("at"))

    return let(bare_words(text), build)


def _is_shout(w: Column) -> Column:
    return (F.upper(w) == w) & (F.lower(w) != w)


def _valence(text: Column, low: Column, lexicon: Lexicon, at: Column | None = None) -> Column:
    """Signed scores, in 1/``UNIT`` points, of the words that are in the lexicon; ``at`` are places
    that hold all of them, if known.

    Only those words are looked at closely: their three predecessors supply
    degree words and negation, and a "but" halves what precedes it and raises
    what follows.
    """
    terms = list(lexicon.valence)
    # Most texts hold no listed word at all; they are done after one look at each word.
    hits = F.when(
        F.exists(low, lambda w: w.isin(terms)),
        F.array_compact(F.transform(low, lambda w, i: F.when(w.isin(terms), i))),
    )
    if at is not None:
        own = F.filter(at, lambda i: F.get(low, i).isin(terms))
        hits = F.when(F.size(at) > 0, own)
    cased = F.split(text, " ")
    # Shouting only says something when the rest of the text does not shout.
    mixed = F.exists(cased, lambda w: ~_is_shout(w))
    but = F.array_position(low, F.lit("but")) - 1
    context = F.struct(cased.alias("cased"), mixed.alias("mixed"), but.alias("but"))

    def score(i: Column, ctx: Column) -> Column:
        base = lookup(F.get(low, i), lexicon.valence, F.lit(0)).cast("long") * 10_000
        sign = F.signum(base).cast("long")
        shout = F.when(_is_shout(F.get(ctx["cased"], i)) & ctx["mixed"], CAPS_STEP).otherwise(0)
        out = base + sign * shout
        negated = F.lit(False)
        for back, step in enumerate(BOOST_STEPS, start=1):
            before = F.get(low, i - back)
            out = out + sign * F.coalesce(lookup(before, lexicon.boost, F.lit(0)), F.lit(0)) * step
            negated = negated | F.coalesce(before.isin(list(lexicon.negation)), F.lit(False))
        out = out * F.when(negated, NEGATION_PERCENT).otherwise(100)
        return out * F.when(ctx["but"] < 0, 10).when(i < ctx["but"], BUT_TENTHS[0]).when(
            i > ctx["but"], BUT_TENTHS[1]
        ).otherwise(10)

    nothing = F.array().cast("array<bigint>")
    return let(
        hits,
        lambda h: F.when(h.isNull(), nothing).otherwise(
            let(context, lambda ctx: F.transform(h, lambda i: score(i, ctx)))
        ),
    )


def _valence_of_hits(text: Column, hits: Column) -> Column:
    """``_valence`` from the listed words of a text, found beforehand: ``hits`` has the place of each
    and what the lists say of it, by place. What stands up to three words before a word is among the
    three hits before it."""
    cased = F.split(text, " ")
    low = F.split(F.lower(text), " ")
    mixed = F.exists(cased, lambda w: ~_is_shout(w))
    but = F.array_position(F.transform(low, lambda w: F.trim(w, F.lit(PUNCTUATION))), F.lit("but")) - 1
    context = F.struct(cased.alias("cased"), mixed.alias("mixed"), but.alias("but"))

    def score(h: Column, k: Column, ctx: Column) -> Column:
        i = h["pos"]
        base = h["valence"] * 10_000
        sign = F.signum(base).cast("long")
        out = base + sign * F.when(_is_shout(F.get(ctx["cased"], i)) & ctx["mixed"], CAPS_STEP).otherwise(0)
        negated = F.lit(False)
        for back in range(1, len(BOOST_STEPS) + 1):
            before = F.get(hits, k - back)
            apart = i - before["pos"]
            step = F.lit(0)
            for distance, weight in enumerate(BOOST_STEPS, start=1):
                step = F.when(apart == distance, weight).otherwise(step)
            out = out + sign * F.coalesce(before["delta"] * step, F.lit(0))
            negated = negated | F.coalesce(before["negation"] & (apart <= len(BOOST_STEPS)), F.lit(False))
        out = out * F.when(negated, NEGATION_PERCENT).otherwise(100)
        return out * F.when(ctx["but"] < 0, 10).when(i < ctx["but"], BUT_TENTHS[0]).when(i > ctx["but"], BUT_TENTHS[1]).otherwise(10)

    return let(context, lambda ctx: F.array_compact(F.transform(hits, lambda h, k: F.when(h["valence"].isNotNull(), score(h, k, ctx)))))


def rule_scores(text: Column, lexicon: Lexicon | None = None, hits: Column | None = None, words: Column | None = None) -> Column:
    """``struct(compound, pos, neg, neu)`` of a whitespace-collapsed text, by a lexicon of constants
    or by the listed words found in it (see ``_valence_of_hits``). ``words`` are the text's
    ``listed_words``, if known."""
    zero = F.lit(0).cast("long")

    def emphasis(t: Column) -> Column:
        bangs = F.least(F.lit(EXCLAIM_MAX), _occurrences(t, "!")) * EXCLAIM_STEP
        asks = _occurrences(t, "?")
        asked = F.when(asks <= 1, 0).when(asks <= 3, asks * QUESTION_STEP).otherwise(QUESTION_MAX)
        return (bangs + asked).cast("long")

    def sums(t: Column, low: Column) -> Column:
        return let(
            _valence(t, low, lexicon, None if words is None else words["at"]) if hits is None else _valence_of_hits(t, hits),
            lambda v: F.struct(
                F.aggregate(v, zero, lambda a, x: a + F.greatest(x, zero)).alias("pos"),
                F.aggregate(v, zero, lambda a, x: a + F.least(x, zero)).alias("neg"),
                F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("n_pos"),
                F.size(F.filter(v, lambda x: x < 0)).cast("long").alias("n_neg"),
                F.size(low).cast("long").alias("n_word"),
                emphasis(t).alias("emphasis"),
            ),
        )

    if words is not None:
        return let(sums(text, words["low"]), _ratios)
    return let(
        text,
        lambda t: let(bare_words(t), lambda low: let(sums(t, low), _ratios)),
    )


def _occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _ratios(s: Column) -> Column:
    emphasis = s["emphasis"]
    total = s["pos"] + s["neg"]
    total = total + F.signum(total).cast("long") * emphasis
    points = total / float(UNIT)
    # Each scored word also counts one point, as each neutral word does.
    swing = s["pos"] + s["neg"]
    pos = s["pos"] + s["n_pos"] * UNIT + F.when(swing > 0, emphasis).otherwise(0)
    neg = -s["neg"] + s["n_neg"] * UNIT + F.when(swing < 0, emphasis).otherwise(0)
    neu = (s["n_word"] - s["n_pos"] - s["n_neg"]) * UNIT
    mass = (pos + neg + neu).cast("double")
    share = lambda part: F.coalesce(F.try_divide(part.cast("double"), mass), F.lit(0.0))
    return F.struct(
        (points / F.sqrt(points * points + NORM_ALPHA)).alias("compound"),
        share(pos).alias("pos"),
        share(neg).alias("neg"),
        share(neu).alias("neu"),
    )


def polarity_scores(text: Column, lexicon: Lexicon | None = None, hits: Column | None = None, words: Column | None = None) -> Column:
    """``struct(polarity, subjectivity)``: means over the words in the list, 0 without any. ``words``
    are the text's ``listed_words``, if known."""
    zero = F.lit(0).cast("long")

    def mean(found: Column, value: Callable[[Column], Column]) -> Column:
        total = F.aggregate(found, zero, lambda a, w: a + value(w))
        return F.coalesce(F.try_divide(total.cast("double"), F.size(found) * F.lit(100.0)), F.lit(0.0))

    def means(found: Column, polarity: Callable[[Column], Column], subjectivity: Callable[[Column], Column]) -> Column:
        return let(found, lambda x: F.struct(mean(x, polarity).alias("polarity"), mean(x, subjectivity).alias("subjectivity")))

    if hits is not None:
        listed = F.filter(hits, lambda h: h["polarity"].isNotNull())
        return means(listed, lambda h: h["polarity"], lambda h: F.coalesce(h["subjectivity"], zero))
    p = lexicon.polarity
    polarity = {t: v[0] for t, v in p.items()}
    subjectivity = {t: v[1] for t, v in p.items()}
    some = bare_words(text) if words is None else F.transform(words["at"], lambda i: F.get(words["low"], i))
    listed = F.filter(some, lambda w: w.isin(list(p)))
    return means(listed, lambda w: lookup(w, polarity, F.lit(0)), lambda w: lookup(w, subjectivity, F.lit(0)))
