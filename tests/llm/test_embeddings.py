"""Near-duplicate vectors against all pairs, and the plan's chances."""

import numpy as np
import pytest

from newsmood.llm import embeddings as E


def brute(rows, cosine=0.9):
    """Only vectors of the same length are compared; shorter ones are filled up to compare them all at once."""
    size = np.array([len(v) if ok(v) else 0 for _, v in rows])
    x = np.array([[*v, *[0.0] * (16 - len(v))] if ok(v) else [0.0] * 16 for _, v in rows], float)
    n = np.linalg.norm(x, axis=1)
    x[n > 0] /= n[n > 0, None]
    link = (x @ x.T >= cosine) & ~np.eye(len(x), dtype=bool) & (size[:, None] == size)
    comp = np.arange(len(x))
    while True:
        new = np.array([min(comp[i], *comp[link[i]]) if link[i].any() else comp[i] for i in range(len(x))])
        if (new == comp).all():
            break
        comp = new
    least = {}
    for (i, _), c in zip(rows, comp, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted((str(i), int(link[k].sum()), str(None if i is None else least[comp[k]])) for k, (i, _) in enumerate(rows))


def ok(v):
    return v is not None and all(a is not None and np.isfinite(a) for a in v)


def vectors(seed, n=300):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        base = rng.standard_normal(16)
        for _ in range(rng.choice([1, 1, 2, 8, 60])):
            v = base + rng.choice([0.0, 0.02, 0.04]) * rng.standard_normal(16)
            out.append((len(out) * 7 % 1009, [float(np.float32(a)) for a in v]))
    return out


ODD = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] + [1.0] * 15), (5004, [None] + [1.0] * 15), (5005, [1.0, 2.0]), (5006, [float("inf")] * 16)]


@pytest.mark.parametrize("block", [E.BLOCK, 16])
def test_links_and_components_equal_all_pairs(spark, block):
    rows = vectors(4)
    rows += [*ODD, (None, rows[0][1]), rows[5], rows[5], (6000, [2 * a for a in rows[9][1]])]
    # Vectors of other lengths, some of them prefixes of the long ones, and pairs among them.
    rows += [(7000 + i, v[: 2 + i % 3]) for i, (_, v) in enumerate(rows[:60])] + [(7100, [1.0, 2.0]), (7101, [1.0, 2.0]), (7102, [-1.0, 2.0]), (7103, [3.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, links int, class string")
    got = E.near_duplicates(df, block=block).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine of just 0.9, the hardest that count."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.901 * a + np.sqrt(1 - 0.901**2) * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [r.n_links for r in E.near_duplicates(df).collect()]
    assert set(found) <= {0, 1} and np.mean(found) >= 0.9


def test_empty_table(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_cell_chances_by_simulation():
    rng = np.random.default_rng(1)
    at, move = rng.uniform(0, 1, 200_000), rng.standard_normal(200_000)
    for c in (1.0, 4.0):
        assert abs(np.mean(np.floor(at) == np.floor(at + move / c)) - E.same_cell(c)) < 0.01


def test_no_link_is_lost(spark):
    """Pairs at and near the threshold, chains of them, and lengths that overflow or vanish when squared."""
    rng = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v)
    rows = []
    for i in range(500):
        a = unit(rng.standard_normal(16))
        b = rng.standard_normal(16)
        b = unit(b - (a @ b) * a)
        c = (0.9001, 0.903, 0.91, 0.8999)[i % 4]
        scale = (1.0, 1e200, 1e-200, 1e-30)[i // 4 % 4]
        rows += [(2 * i, (a * scale).tolist()), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = E.near_duplicates(df, block=300).collect()
    plain = [(i, unit(np.array(v) / np.abs(v).max()).tolist()) for i, v in rows]
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute(plain)


@pytest.mark.parametrize("block", [E.BLOCK, 16])
def test_components_follow_every_link(spark, block):
    """Chains and thin clusters: a link between two vectors that both link with smaller ones counts as well."""
    rng = np.random.default_rng(3)
    arc = np.radians(20 * np.arange(12))
    rows = [(i, [*v, *[0.0] * 14]) for i, v in enumerate(np.column_stack([np.cos(arc), np.sin(arc)]).tolist())]
    rows += [(100 + i, v) for i, v in enumerate(rng.standard_normal((60, 3)).tolist())]
    rows += [(200 + i, v) for i, v in enumerate(rng.standard_normal((150, 4)).tolist())]
    order = rng.permutation(len(rows)).tolist()  # ids are not in the order of the chains
    rows = [(1000 + k, rows[at][1]) for k, at in enumerate(order)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = E.near_duplicates(df, block=block).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute(rows)
    chain = {1000 + k for k, at in enumerate(order) if at < 12}
    assert {r.component_id for r in got if r.vec_id in chain} == {min(chain)}


def test_joined_places_by_steps():
    """Links that come in any portions, with repeats, join the same places as a search over all of them."""
    rng = np.random.default_rng(6)
    for n, m in ((1, 0), (2, 1), (50, 30), (400, 300), (400, 2000)):
        u, v = rng.integers(0, n, (2, m))
        parent = np.arange(n)
        for lo in range(0, m, 7):
            E._join(parent, u[lo : lo + 7], v[lo : lo + 7])
        whole = np.arange(n)
        E._join(whole, u, v)
        least = np.arange(n)
        for _ in range(n):
            for a, b in zip(u.tolist(), v.tolist(), strict=True):
                least[a] = least[b] = min(least[a], least[b])
            if (least[u] == least[v]).all():
                break
        assert (E._ends(parent, np.arange(n)) == least).all() and (E._ends(whole, np.arange(n)) == least).all()


def test_cells_lose_few_links(spark):
    rows = vectors(5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sum(r.n_links for r in E.near_duplicates(df, recall=0.97).collect())
    wanted = sum(n for _, n, _ in brute(rows))
    assert 0.9 * wanted <= found <= wanted
