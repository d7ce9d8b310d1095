"""Secrets against the plain patterns, and the models on strings held out from them."""

import math
import random
import re
import string
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from newsmood.llm import secrets

PLAIN = [
    ("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def brute(text):
    out = [(k, m.start(), m.end()) for k, p, ok in PLAIN for m in re.finditer(p, text) if ok(m)]
    return sorted(out, key=lambda x: (x[1], [k for k, *_ in PLAIN].index(x[0])))


PIECES = ["token", "PassWord", "api_key", "apikey", "secret", " ", "=", ":", '"', "AKIA", "ABCD0123", "0123456789ab", "é", "ſecret", "x.y=", "\n"]


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_base_spans_equal_the_plain_patterns(parts):
    text = "".join(parts)
    assert [x[:3] for x in secrets.base_spans(text)] == brute(text)


def words(rng, n):
    syllables = ["the", "an", "tion", "er", "ing", "re", "on", "ha", "st", "ou"]
    return ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 8))) for _ in range(n)]


def randoms(rng, n, size=32):
    return ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(size)) for _ in range(n)]


def corpus(rng, n=200):
    rows = []
    for i in range(n):
        text = " ".join(words(rng, 60))
        if i % 4 == 0:
            text += f' token = "{randoms(rng, 1)[0]}"'
        rows.append((i, text))
    return rows


def test_random_strings_are_told_from_long_words(spark, documents):
    rng = random.Random(3)
    counts = secrets.train(documents(corpus(rng)))
    held = [(i, f"é see {w} here") for i, w in enumerate(randoms(rng, 100))]
    held += [(i + 100, w) for i, w in enumerate([w for w in words(rng, 2000) if len(w) >= 16][:100])]
    got = {r.doc_id: r for r in secrets.find_secrets(documents(held), counts=counts).collect()}
    assert sum(bool(got[i].random) for i in range(100)) >= 98
    assert sum(bool(got[i].random) for i in range(100, 200)) <= 1
    assert [(s.kind, s.start, s.end) for s in got[0].random] == [("markov", 6, 38)]


def test_cases_and_clashing_columns(spark, documents):
    key = "AKIA" + "A1" * 8
    rows = [(1, None), (2, ""), (3, f"see {key}."), (3, f"see {key}."), (None, "é passwd: abc123"), (5, "ab " * 200_000 + "0" * 30)]
    got = secrets.find_secrets(documents(rows)).collect()
    by = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in got}
    assert len(got) == 6
    assert by == {1: [], 2: [], 3: [("access", 4, 24)], None: [("assign", 2, 16)], 5: [("hex", 600_000, 600_030)]}
    assert secrets.find_secrets(documents([])).collect() == []


def test_counts_leave_out_covered_text(spark, documents):
    counts = secrets.train(documents([(1, "token=abcabc"), (2, "hello")]))
    assert counts[0].sum() == 6 and counts[1].sum() == 5


def test_scores_equal_ratios_added_one_by_one(spark, documents):
    """Counts and log-likelihood ratios restated from the text."""
    rng = random.Random(6)
    docs = corpus(rng, 40)
    alphabet = secrets._ALPHABET.decode()
    runs = lambda text, least: [m for m in re.finditer(f"[{re.escape(alphabet)}]{{{least},}}", text)]
    moves = lambda s: [(a, b) for a, b in zip([None, *s], s, strict=False) if b in alphabet and (a is None or a in alphabet)]
    counts = [{}, {}]
    for _, text in docs:
        spans = secrets.base_spans(text)
        for _, _, b, v in spans:
            for t in moves(text[v:b]):
                counts[0][t] = counts[0].get(t, 0) + 1
        for m in runs(text, 4):
            if all(m.end() <= a or b <= m.start() for _, a, b, _ in spans):
                for t in moves(m[0]):
                    counts[1][t] = counts[1].get(t, 0) + 1

    def logs(model, s):
        c = counts[model]
        total = sum(c.values()) + secrets.SMOOTH * len(alphabet)
        out = 0.0
        for a, b in moves(s):
            alone = (sum(n for (_, y), n in c.items() if y == b) + secrets.SMOOTH) / total
            after = sum(n for (x, _), n in c.items() if x == a)
            out += math.log((c.get((a, b), 0) + secrets.BACK_OFF * alone) / (after + secrets.BACK_OFF))
        return out

    table = documents(docs)
    got = {r.doc_id: r.score for r in secrets.find_secrets(table, least=8).collect()}
    for i, text in docs:
        spans = secrets.base_spans(text)
        free = [m[0] for m in runs(text, 8) if all(m.end() <= a or b <= m.start() for _, a, b, _ in spans)]
        want = max((logs(0, s) - logs(1, s) for s in free), default=None)
        assert (got[i] is None) == (want is None) and (want is None or abs(got[i] - want) < 1e-6)


def test_a_long_text_of_many_spans_takes_linear_time(spark):
    rng = random.Random(8)
    strings = randoms(rng, 80_000)
    text = "é ".join(strings)
    counts = secrets.train(spark.createDataFrame(corpus(rng), "doc_id long, text string"))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.perf_counter()
    (row,) = secrets.find_secrets(df, counts=counts).collect()
    assert time.perf_counter() - start < 20
    assert len(row.random) > 78_000 and all(s.end - s.start == 32 and s.start % 34 == 0 for s in row.random)
