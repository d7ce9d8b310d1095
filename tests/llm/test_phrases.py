"""Collocations against all phrases counted one by one."""

import random
import re
from collections import Counter

import pytest

from newsmood.llm import phrases as P

SCHEMA = "lang string, text string, gram int, n string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\v\f\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) >= 2 and a >= least}
        gone = {
            p[i : i + m] for p, a in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 100 * found[p[i : i + m]]
        }
        best = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def some(seed, docs=150):
    rng = random.Random(seed)
    common = ["the", "Of", "and", "été", "a'b", "x"]
    rare = [f"r{i}" for i in range(40)]
    lines = [" ".join(rng.choice(common + rare) for _ in range(rng.randint(2, 7))) for _ in range(12)] + ["a a a a a a a", "new york city hall", "the the"]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(rng.randint(0, 12)):
            parts.append(rng.choice(lines) if rng.random() < 0.6 else " ".join(rng.choice(common) for _ in range(rng.randint(1, 9))))
        text = "".join(p + rng.choice([". ", ", ", "\n", " ", "\t", "\r\n"]) for p in parts)
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), text))
    return rows + [("en", None), (None, ""), ("fr", " .,"), ("en", rows[0][1]), ("en", rows[0][1])]


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "clash") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("top", "share"), [(2000, 1 / 8), (15, 0.4), (3, 0.0)])
def test_equals_brute_force(spark, top, share):
    rows = some(top)
    got = P.collocations(table(spark, rows), least=8, top=top, share=share)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, 8, top)
    assert len(want) > 6 and sorted(map(tuple, got.collect())) == want


def test_a_task_sends_its_sums_in_pieces(spark, monkeypatch):
    rows = some(9, 60)
    monkeypatch.setattr(P, "HELD", 64)
    monkeypatch.setattr(P, "MOST_BITS", 16)
    got = P.collocations(table(spark, rows).coalesce(1), least=5, top=40)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 40)


def test_no_phrases(spark):
    assert P.collocations(table(spark, some(1)).where("false")).collect() == []
    assert P.collocations(table(spark, [("en", "just a few words"), ("en", None)])).collect() == []
    once = table(spark, [("en", ". ".join(["alone"] * 200))])
    assert P.collocations(once).collect() == []


def test_frontier_stops_at_the_last_score(spark):
    """Words too frequent for any of their phrases to matter are never expanded."""
    rows = [("en", f"p{i} q{i}. " * 8) for i in range(30)] + [("en", "of the. " * 400 + "the. of. " * 2000)]
    got = [tuple(r) for r in P.collocations(table(spark, rows), least=8, top=20, share=0.01).collect()]
    assert sorted(got) == brute(rows, 8, 20)
