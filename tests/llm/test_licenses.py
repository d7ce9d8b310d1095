"""License scans against phrase positions by hand, and edited license texts."""

import random
import re

from newsmood.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def places(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), sorted((label, i, i + len(p.split()) - 1) for label, p in L.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def got(df):
    return sorted((str(r.doc_id), r.n_words, str(sorted((s.label, s.first, s.last) for s in r.spans if s.base))) for r in df.collect())


def test_phrases_equal_brute_force(spark, documents):
    rng = random.Random(6)
    pieces = ["under the MIT license", "under the mit", "license", "CC BY-NC", "cc by nc", "Apache License, Version 2.0", "version", "été", "\n", "by"]
    docs = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    docs += [(200, None), (201, ""), (None, "CC BY-NC 4.0"), (5, docs[5][1]), (202, "w " * 100_000 + "under the mit license")]
    expected = sorted((str(i), places(t)[0], str(places(t)[1])) for i, t in docs)
    assert got(L.scan(documents(docs))) == expected
    assert L.scan(documents([])).collect() == []


def labels(spark, documents, text):
    row = L.scan(documents([(1, text)])).first()
    return sorted({s.label for s in row.spans}), row.score


def test_edited_license_texts_are_found_on_neighbouring_diagonals(spark, documents):
    text = dict(enumerate(t for _, t in L.TEXTS))[0].split()
    whole = " ".join(text)
    assert labels(spark, documents, f"x y {whole}. z") == (["mit"], 1.0)
    added = " ".join([*text[:9], "really", *text[9:]])  # the diagonal moves by one
    found, score = labels(spark, documents, added)
    assert found == ["mit"] and 0.8 <= score < 1
    assert labels(spark, documents, " ".join(text[:8]))[0] == []
    rng = random.Random(1)
    assert labels(spark, documents, " ".join(rng.sample(text, len(text))))[0] == []


def test_scattered_pieces_do_not_add_up(spark, documents):
    text = dict(enumerate(t for _, t in L.TEXTS))[0].split()
    far = " ".join(" ".join(text[i : i + 4]) + " filler" * 30 for i in range(0, len(text), 4))
    assert labels(spark, documents, far)[0] == []


def test_the_plan_has_no_python(spark, documents):
    plan = L.scan(documents([(1, "cc by nc")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
