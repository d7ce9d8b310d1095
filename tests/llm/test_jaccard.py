"""The join against all pairs, trees against their bound, and families of copies."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsmood.llm import jaccard as J
from newsmood.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, k, t):
    """(id, size, smallest reachable id) of each row."""
    sets = [shingles(x, k) for _, x in docs]
    comp = list(range(len(docs)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    live = [i for i, (d, _) in enumerate(docs) if d is not None and sets[i]]
    for n, i in enumerate(live):
        for j in live[:n]:
            both = len(sets[i] & sets[j])
            if both * t.denominator >= t.numerator * len(sets[i] | sets[j]):
                comp[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i in live:
        least[root(i)] = min(least.get(root(i), docs[i][0]), docs[i][0])
    return sorted((str(d), len(sets[i]), str(least[root(i)] if i in set(live) else d)) for i, (d, _) in enumerate(docs))


def corpus(seed, n=120):
    """Families of edited copies, chains of edits, a passage in a third of all texts, short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    docs = []
    while len(docs) < n:
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120, 300]))]
        for _ in range(rng.choice([1, 1, 3, 12])):
            docs.append((len(docs) * 7 % 1009, " ".join(words) + (" " + passage if len(docs) % 3 == 0 else "")))
            words = list(words)  # the next one is an edit of this one
            for _ in range(rng.choice([0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    return docs + [(2000, None), (2001, ""), (2002, "  \n"), (None, docs[0][1]), (docs[3][0], docs[3][1]), (docs[4][0], "Other Words")]


def rows(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


@pytest.mark.parametrize(("seed", "k", "t", "block", "hot"), [(1, 4, Fraction(85, 100), 8, 5), (2, 5, Fraction(4, 5), J.BLOCK, J.HOT_DOCUMENTS)])
def test_components_equal_all_pairs(spark, documents, seed, k, t, block, hot):
    docs = corpus(seed)
    got = J.join_components(documents(docs), k=k, threshold=t, block=block, hot_documents=hot)
    assert rows(got) == brute(docs, k, t)


@pytest.mark.parametrize(("whole", "rounds"), [(1 << 20, 1), (0, 2)])
def test_second_tree_round_only_for_cells_not_done(spark, documents, monkeypatch, whole, rounds):
    docs = [r for r in corpus(5, 60) if r[0] is not None]
    calls, trees = [], J.tree_pairs
    monkeypatch.setattr(J, "tree_pairs", lambda *a, **k: calls.append(1) or trees(*a, **k))
    monkeypatch.setattr(J, "WHOLE", whole, raising=False)
    assert rows(J.join_components(documents(docs), k=4, threshold=Fraction(85, 100))) == brute(docs, 4, Fraction(85, 100))
    assert len(calls) == rounds


def test_one_of_each_component_stays(spark, documents):
    docs = corpus(3, 60)
    kept = J.keep_one(documents(docs))
    assert kept.columns == documents(docs).columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    comp = {}
    for (d, x), (_, n, c) in zip(sorted(docs, key=lambda r: (str(r[0]), len(shingles(r[1], 5)), str(r[1]))), brute_rows(docs), strict=True):
        comp.setdefault(c if n and d is not None else ("alone", d, x), []).append((d, x))
    assert len(got) == len(comp)
    ids = sorted(str(d) for d, _ in got)
    assert ids == sorted(str(min((d for d, _ in v), key=lambda d: (d is None, d or 0))) for v in comp.values())


def brute_rows(docs):
    """Rows of brute() with components told apart even where ids repeat."""
    t = Fraction(4, 5)
    order = sorted(docs, key=lambda r: (str(r[0]), len(shingles(r[1], 5)), str(r[1])))
    sets = [shingles(x, 5) for _, x in order]
    comp = list(range(len(order)))
    changed = True
    while changed:
        changed = False
        for i in range(len(order)):
            for j in range(i):
                if order[i][0] is None or order[j][0] is None or not sets[i] or not sets[j] or comp[i] == comp[j]:
                    continue
                if len(sets[i] & sets[j]) * t.denominator >= t.numerator * len(sets[i] | sets[j]):
                    a, b = min(comp[i], comp[j]), max(comp[i], comp[j])
                    comp = [a if c == b else c for c in comp]
                    changed = True
    return [(d, len(s), c) for (d, _), s, c in zip(order, sets, comp, strict=True)]


def test_empty_table(spark, documents):
    assert J.join_components(documents([])).collect() == []
    assert J.keep_one(documents([])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([Fraction(4, 5), Fraction(1, 2), Fraction(85, 100)]))
def test_trees_lose_no_pair(seed, t):
    rng = np.random.default_rng(seed)
    sets, comp = [], []
    for i in range(90):
        if sets and rng.random() < 0.6:
            base = sets[rng.integers(len(sets))]
            s = np.unique(np.concatenate([base[rng.random(len(base)) > 0.05], rng.integers(0, 1 << 63, rng.integers(0, 4)).astype(np.uint64) * np.uint64(2)]))
        else:
            s = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 80)).astype(np.uint64) * np.uint64(2))
        sets.append(s)
        comp.append(int(rng.integers(0, 60)))
    maps = [J.bitmap_of(s) for s in sets]
    make = lambda at: J.Tree(
        np.stack([maps[i] for i in at]), np.array([len(sets[i]) for i in at]), np.array([comp[i] for i in at])
    )
    linked = {
        (i, j)
        for j in range(90)
        for i in range(j)
        if comp[i] != comp[j] and len(np.intersect1d(sets[i], sets[j])) * t.denominator >= t.numerator * len(np.union1d(sets[i], sets[j]))
    }
    tree = make(range(90))
    pairs = [(int(a), int(b)) for u, v in J.traverse(tree, tree, t) for a, b in zip(u, v, strict=True)]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    assert linked <= set(pairs)
    left, right = list(range(50)), list(range(50, 90))
    cross = {(int(a), int(b) + 50) for u, v in J.traverse(make(left), make(right), t) for a, b in zip(u, v, strict=True)}
    assert {(i, j) for i, j in linked if i < 50 <= j} <= cross


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(-5, -4), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 140)} | {-5: -5, -4: -5}


def test_folded_bitmaps_are_those_of_the_lower_level():
    rng = np.random.default_rng(5)
    small, large = (np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (J.LEVEL_SIZE, 3 * J.LEVEL_SIZE))
    assert [J.level_of(n) for n in (1, J.LEVEL_SIZE, J.LEVEL_SIZE + 1, 4 * J.LEVEL_SIZE, 4 * J.LEVEL_SIZE + 1, 16 * J.LEVEL_SIZE)] == [0, 0, 1, 1, 2, 2]
    wide = J.bitmap_of(np.union1d(small, large))[None]
    assert not (J.bitmap_of(small) & ~J.folded(wide, 0)[0]).any()


def test_work_tables_are_freed(spark, tmp_path, monkeypatch):
    from newsmood.llm import words as W

    monkeypatch.setattr(W, "work_path", lambda spark, name: f"{tmp_path}/{name}-{random.random()}")
    rng = random.Random(3)
    base = [[rng.choice("abcdefgh") for _ in range(40)] for _ in range(4)]
    texts = [" ".join([*b[:i], "x", *b[i + 1 :]]) for b in base for i in range(0, 40, 8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in J.keep_one(docs, k=3, threshold=Fraction(7, 10)).collect())
    want = brute([(i, t) for i, t in enumerate(texts)], 3, Fraction(7, 10))
    assert kept == sorted({int(c) for *_, c in want})
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert not left & {"jaccard-classes", "jaccard-posts", "jaccard-groups", "jaccard-members", "jaccard-signatures", "jaccard-pairs", "jaccard-links"}
