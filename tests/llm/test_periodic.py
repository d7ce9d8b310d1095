"""Periodic runs against every period of every place compared one by one."""

import hashlib
import random
import zlib

from newsmood.llm import periodic as P
from newsmood.llm.queries import QUERIES

BLANKS = " \t\n\v\f\r"


def words(text):
    out, word = [], ""
    for ch in (text or "") + " ":
        if ch in BLANKS:
            if word:
                out.append(word)
            word = ""
        else:
            word += ch
    return out


def brute(w):
    """(start, length, period) of all runs."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some(rng):
    k, n = rng.choice([1, 2, 3, 8, 1000]), rng.choice([0, 5, 11, 12, 13, 30, 100, 300])
    w = [rng.choice(["a", "A", "é", "."]) + str(rng.randint(0, k)) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n > 3 else 0):
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
        for i in range(a, min(n, a + rng.randint(1, n))):
            w[i] = w[a + (i - a) % p]
    return w


def cases():
    rng = random.Random(4)
    texts = ["  \t".join(some(rng)) for _ in range(60)]
    texts += [None, "", " \n ", "a " * 12, "a " * 11, "a\vA " * 40, " ".join(["a", "b", "c", "d", "e", "f"] * 2)]
    texts += [" ".join(f"w{i % 700}" for i in range(1500)), " ".join(f"w{i * i % 9001}" for i in range(900)) + " x" * 600 + " y z" * 200]
    texts += [texts[5], texts[5]]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "b " * 30)]


def test_runs_and_collapsed_texts_equal_brute_force(spark, documents):
    docs = cases()
    got = P.collapse(documents(docs)).collect()
    seen = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.text or "") for r in got)
    want = []
    for i, t in docs:
        w = words(t)
        runs = brute(w)
        want.append((str(i), len(w), runs, collapsed(w, runs), t or ""))
    assert seen == sorted(want)
    assert {r.spans for r in got} == {1} and {r.lang for r in got} == {"en"}  # other columns pass


def test_digests_stand_for_texts(spark, documents):
    docs = cases()
    got = {(r.doc_id, r.collapsed) for r in P.collapse(documents(docs)).collect()}
    short = P.collapse(documents(docs), digest=True)
    assert "text" not in short.columns and "collapsed" not in short.columns
    assert sorted((str(r.doc_id), r.collapsed_sha256) for r in short.collect()) == sorted(
        (str(i), hashlib.sha256(c.encode()).hexdigest()) for (i, _), c in zip(docs, [collapsed(words(t), brute(words(t))) for _, t in docs])
    )
    assert len(got) == len(set((i, t) for i, t in docs))


def test_empty_table(spark, documents):
    assert P.collapse(documents([(1, "a")]).where("false")).collect() == []


def test_one_long_text_of_many_tiles(spark):
    unit = [f"u{i}" for i in range(5000)]
    w = [f"n{i}" for i in range(777)] + (unit * 5)[:22_222] + [f"m{i}" for i in range(100)] + ["x", "y"] * 9000
    df = spark.createDataFrame([(" ".join(w),)], "text string")
    row = P.collapse(df).first()
    assert [tuple(r) for r in row.runs] == [(777, 22_222, 5000), (777 + 22_222 + 100, 18_000, 2)]
    assert len(words(row.collapsed)) == 777 + 5000 + 100 + 2


def test_query_equals_brute_force(spark, sf_dir):
    got = {r.doc_id: r for r in QUERIES["op13_periodic"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    n_runs = 0
    for doc in docs:
        w = words(doc.text)
        h = zlib.crc32(str(doc.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue  # the brute force is quadratic
        runs = brute(w)
        n_runs += len(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = (
            len(runs),
            *(best[:3] if best else (None,) * 3),
            1000 * best[1] // best[2] if best else None,
            sha("".join(f"{a},{b},{q}\n" for a, b, q in runs)),
            sha(collapsed(w, runs)),
        )
        r = got[doc.doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want, doc.doc_id
    assert n_runs > 5
