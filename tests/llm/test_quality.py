"""The quality classifier: held-out accuracy, calibration, and cases."""

import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from newsmood.llm import quality


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(1, 9))) for _ in range(800)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 300))]
        good = i % 3 != 0
        if not good:
            kind = i % 9
            words = [w + "!!" for w in map(str.upper, words)] if kind == 0 else [words[0]] * 80 if kind == 3 else [w + "%%%" for w in words]
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_rows_are_judged_right(spark, documents):
    docs, labels = corpus()
    got = quality.classify(documents(docs), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len(held) > 50
    assert np.mean([r.predicted == dict(labels)[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_held_out_labels_are_never_read(spark, documents):
    docs, labels = corpus(200)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in labels]
    scores = [
        {r.doc_id: r.score for r in quality.classify(documents(docs), spark.createDataFrame(x, "doc_id long, quality int")).collect()}
        for x in (labels, turned)
    ]
    assert all(abs(scores[0][i] - scores[1][i]) < 1e-6 for i in scores[0])


def test_cases_and_clashing_columns(spark, documents):
    docs, labels = corpus(90)
    docs += [(900, None), (901, ""), (None, "some text"), (3, docs[3][1]), (902, "word " * 100_000)]
    labels += [(None, 1), (7, None), (3, 1), (3, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.classify(documents(docs), known).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (900, 901)}) == 1
    kept = quality.keep_good(documents(docs), known)
    assert kept.columns == documents(docs).columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if r.predicted)
    assert quality.classify(documents([]), known).collect() == []
    none = known.where("doc_id < 0")
    assert {r.score for r in quality.classify(documents(docs), none).collect()} == {0.5}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(1, 5)), min_size=1, max_size=20))
def test_isotonic_values_rise_and_keep_the_mean(rows):
    y, w = (np.array(v, float) for v in zip(*rows, strict=True))
    x = np.arange(len(y), dtype=float)
    centres, values = quality.isotonic(x, y, w)
    assert (np.diff(values) > 0).all() and (np.diff(centres) > 0).all()
    # The best rising fit is the largest mean over starts of the smallest mean over ends.
    mean = lambda i, j: (y[i : j + 1] * w[i : j + 1]).sum() / w[i : j + 1].sum()
    best = [max(min(mean(i, j) for j in range(k, len(y))) for i in range(k + 1)) for k in range(len(y))]
    assert np.allclose(sorted(set(np.round(best, 9))), np.round(values, 9))
