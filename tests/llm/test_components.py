"""Connected components against a plain search, and the tables that the rounds write."""

import random

import pytest

from newsmood.llm import components as C


def brute(edges):
    top = {}

    def root(i):
        while top.setdefault(i, i) != i:
            i = top[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    return {i: root(i) for i in top}


def found(spark, edges):
    rows = C.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.component for r in rows}


@pytest.fixture
def tables(monkeypatch):
    """The names of the tables written."""
    names = []
    monkeypatch.setattr(C, "written", lambda df, name, *a, f=C.written: names.append(name) or f(df, name, *a))
    return names


STARS = [(1, i) for i in range(2, 40)] + [(-5, 100), (100, -5), (-5, 101), (-5, 101)]


def test_stars_need_no_round(spark, tables):
    assert found(spark, STARS) == brute(STARS)
    assert tables == ["stars"]


def test_no_round_after_the_last(spark, tables):
    edges = [(9, i) for i in (1, 2, 5, 30, 31)]  # a star around a node that is not its smallest
    assert found(spark, edges) == brute(edges)
    assert tables == ["stars"] * 2


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [(3, 3), (None, 4), (4, None)],
        [(i, i + 1) for i in range(60)],
        [(i % 7 * 100 - i, i * 37 % 61) for i in range(80)],
        [(-(2**63), 2**63 - 1), (0, 2**63 - 1), (0, 5), (7, 6)],
        [(a, b) for a in range(8) for b in range(8)] + [(20, 10), (10, 20), (10, 30)],
        [tuple(random.Random(4).sample(range(150), 2)) for _ in range(3)] + [(random.Random(i).randrange(150), random.Random(-i - 1).randrange(150)) for i in range(110)],
    ],
)
def test_components(spark, edges):
    assert found(spark, edges) == brute(edges)
