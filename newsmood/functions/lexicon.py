"""Word lists behind the rule scorers.

The lists here are a small seed written for this package. A ``Lexicon`` becomes constants of a
plan; lists that are tables, of any size, are joined: see ``term_table``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seed valences in tenths, from -40 (worst) to 40 (best).
SEED_VALENCE: dict[int, str] = {
    34: "best amazing wonderful excellent outstanding superb",
    31: "great love loved loves fantastic brilliant awesome perfect",
    27: "happy delighted joy joyful beautiful triumph win wins winning won winner",
    23: "success successful celebrate celebrated hope hopeful proud praise praised peace",
    19: "good nice fine better benefit benefits safe strong improve improved improvement growth",
    15: "breakthrough progress gain gains support supports helpful helped help effective agree agreed",
    11: "interesting fair useful easy calm ready clear thanks thank welcome",
    -11: "doubt doubtful slow weak concern concerns concerned delay delayed difficult no",
    -15: "problem problems risk risks lose loss losses warn warned warning decline declined fall",
    -19: "bad worse sad angry fear fears afraid fail failed fails failure poor wrong crisis",
    -23: "idiot stupid loser clown trash ugly pain painful hurt damage victim victims attack attacks",
    -27: "worst terrible awful horrible pathetic worthless moron scum disaster corrupt fraud",
    -31: "hate hated hates disgusting evil war killed kill dead death murder terror terrorist",
}

# Seed polarity and subjectivity in hundredths.
SEED_POLARITY: dict[tuple[int, int], str] = {
    (100, 30): "best excellent perfect wonderful",
    (100, 75): "awesome outstanding superb",
    (80, 75): "great brilliant amazing happy joyful",
    (60, 60): "good nice love loved win winner beautiful",
    (45, 50): "success successful proud hope hopeful safe strong",
    (25, 35): "better fine fair useful clear interesting progress new",
    (-25, 35): "weak slow difficult doubtful no",
    (-45, 55): "sad angry poor wrong afraid loser clown",
    (-70, 70): "bad worse stupid idiot moron ugly trash painful",
    (-90, 85): "hate evil pathetic worthless corrupt scum",
    (-100, 100): "worst terrible awful horrible disgusting",
}

# Degree words raise (+1) or lower (-1) the valence of the word they precede.
SEED_BOOST: dict[int, str] = {
    1: "very really extremely absolutely completely highly totally incredibly deeply most so too",
    -1: "slightly somewhat barely hardly partly almost little kinda sorta marginally",
}

SEED_NEGATION = (
    "not never none nobody nothing nowhere neither nor cannot without isn't aren't wasn't "
    "weren't don't doesn't didn't won't wouldn't shouldn't couldn't can't hasn't haven't hadn't"
)

def _expand(groups: dict) -> dict:
    return {term: key for key, terms in groups.items() for term in terms.split()}


@dataclass(frozen=True)
class Lexicon:
    """Term lists as plain dictionaries."""

    valence: dict[str, int] = field(default_factory=lambda: _expand(SEED_VALENCE))
    polarity: dict[str, tuple[int, int]] = field(default_factory=lambda: _expand(SEED_POLARITY))
    boost: dict[str, int] = field(default_factory=lambda: _expand(SEED_BOOST))
    negation: frozenset[str] = frozenset(SEED_NEGATION.split())


#: What a table of terms says of each: valence in tenths, polarity and subjectivity in hundredths,
#: the step of a degree word, whether it negates. NULL where a list does not have the term.
TERM_FIELDS = {"valence": "long", "polarity": "long", "subjectivity": "long", "delta": "long", "negation": "boolean"}


def term_table(
    valence: DataFrame | None = None,
    polarity: DataFrame | None = None,
    boost: DataFrame | None = None,
    negation: DataFrame | None = None,
) -> DataFrame:
    """``(term, valence)``, ``(term, polarity, subjectivity)``, ``(term, delta)`` and ``(term)`` tables
    of any size as one table of terms, for ``sentiment.analyze_by_terms``.

    A term that a list has twice counts with its largest value; empty and NULL terms are left out.
    """
    lists = [(valence, ("valence",)), (polarity, ("polarity", "subjectivity")), (boost, ("delta",))]
    parts = [t.select("term", *[F.col(f).cast(TERM_FIELDS[f]) for f in fields]) for t, fields in lists if t is not None]
    if negation is not None:
        parts.append(negation.select("term", F.lit(True).alias("negation")))
    if not parts:
        raise ValueError("no list of terms is given")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    # A polarity and its subjectivity stay together.
    best = {f: F.max(f) for f in TERM_FIELDS if f in rows.columns and f != "subjectivity"}
    if "subjectivity" in rows.columns:
        both = F.when(F.col("polarity").isNotNull(), F.struct("polarity", "subjectivity"))
        best |= {"polarity": F.max(both)["polarity"], "subjectivity": F.max(both)["subjectivity"]}
    found = rows.where("term <> ''").groupBy("term").agg(*[v.alias(k) for k, v in best.items()])
    return found.select("term", *[(F.col(f) if f in rows.columns else F.lit(None)).cast(t).alias(f) for f, t in TERM_FIELDS.items()])


def by_value(mapping: dict) -> dict:
    """Invert ``term -> value`` to ``value -> [terms]``."""
    out: dict = {}
    for term, value in mapping.items():
        out.setdefault(value, []).append(term)
    return out


def lookup(term: Column, mapping: dict, default: Column) -> Column:
    """Value of ``term`` in a constant map.

    One ``IN`` per distinct value: Spark turns long ``IN`` lists into hash sets,
    whereas indexing a map literal scans it.
    """
    case = None
    for value, terms in sorted(by_value(mapping).items()):
        case = (F if case is None else case).when(term.isin(terms), F.lit(value))
    return default if case is None else case.otherwise(default)
