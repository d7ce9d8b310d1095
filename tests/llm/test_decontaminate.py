"""Decontamination against windows compared one by one."""

import random
import re

import pytest

from newsmood.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, n):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        x = words(t)
        k = min(n, len(x))
        windows = {tuple(x[a : a + k]) for a in range(len(x) - k + 1)} if x else set()
        for a in range(len(w) - k + 1):
            if tuple(w[a : a + k]) in windows:
                hit |= set(range(a, a + k))
                if i is not None:
                    ids.add(str(i))
    return len(w), sorted(hit), sorted(ids)


def cases():
    rng = random.Random(2)
    vocabulary = ["the", "Of", "été", "a1", "b", "c-d"]
    pick = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, pick(rng.randint(1, 9))) for i in range(12)] + [(50, None), (51, ""), (None, "rare words only here today"), (3, pick(6)), (60, "the of")]
    docs = [(i, pick(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (None, "x rare words only here today y"), (5, "the OF"), (5, "the OF")]
    docs.append((102, pick(30_000) + " " + items[0][1]))
    return docs, items


def check(got, docs, items, n):
    expected = sorted((str(i), *map(str, brute(t, items, n))) for i, t in docs)
    seen = [
        (str(r.doc_id), str(r.n_words), str([x for s in r.spans for x in range(s.first_word, s.last_word + 1)]), str(list(r.items)))
        for r in got
    ]
    assert sorted(seen) == expected


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 8])
def test_spans_and_items_equal_brute_force(spark, documents, block_words):
    docs, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    check(D.contamination(documents(docs), benchmark, n=4, block_words=block_words).collect(), docs, items, 4)


def test_cut_spans_and_dropped_documents(spark, documents):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before, {item}! After"), (2, "clean text"), (3, item.upper()), (4, None), (5, ""), (6, "one two three four five six seven eight nine")]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    table = documents(docs)
    got = {r.doc_id: r for r in D.decontaminate(table, benchmark).collect()}
    assert {i: r.text for i, r in got.items()} == {1: "Before, ! After", 2: "clean text", 4: None, 5: "", 6: docs[5][1]}
    assert got[1].spans == 1 and got[1].n_words == "clash"  # other columns pass
    dropped = D.decontaminate(table, benchmark, action="documents").collect()
    assert sorted(r.doc_id for r in dropped) == [2, 4, 5, 6]
    with pytest.raises(ValueError):
        D.decontaminate(table, benchmark, action="nothing")


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 8])
@pytest.mark.parametrize("action", ["spans", "documents"])
def test_cuts_of_many_blocks_equal_brute_force(spark, documents, block_words, action):
    docs, items = cases()
    overlapping = [f"w{i} w{i + 1} w{i + 2} w{i + 3}" for i in range(0, 40, 2)]  # each shares two words with the next
    items = items + [(200 + i, t) for i, t in enumerate(overlapping)]
    docs = docs + [(300, "Before; " + ", ".join(f"W{i}" for i in range(42)) + "! after"), (301, "p w0 w1 w2 w3 q w2 w3 w4")]
    docs += [(302, "w20 w21 w0 w1 w2 w3 w22 w23")]  # what a cut brings together is no window
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = []
    for i, t in docs:
        n, hit, _ = brute(t, items, 4)
        if hit and (action == "documents" or len(hit) == n):
            continue
        at = [m.span() for m in WORD.finditer((t or "").translate(LOWER))]
        for a in sorted(hit, reverse=True):  # a word, and what follows it up to the next hit word
            t = t[: at[a][0]] + t[at[a + 1][0] if a + 1 in hit else at[a][1] :]
        expected.append((str(i), t))
    got = D.decontaminate(documents(docs), benchmark, n=4, action=action, block_words=block_words)
    assert got.columns == documents(docs).columns
    got = got.collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((i, str(t)) for i, t in expected)
    assert all(r.n_words == "clash" and r.spans == 1 and r._row == 7 for r in got)


def test_a_block_is_scanned_before_the_next_is_fetched(spark, documents, monkeypatch):
    docs = documents([(1, "x rare words only here today y the end"), (2, "nothing")])
    benchmark = spark.createDataFrame([(i, f"rare words only here today w{i}") for i in range(4)], "item_id long, text string")
    seen, windows, written = [], D.Windows, D.written
    monkeypatch.setattr(D, "Windows", lambda items, n: (seen.append("block"), windows(items, n))[1])
    monkeypatch.setattr(D, "written", lambda df, name: (written(df, name), seen.append("written"))[0])
    got = D.contamination(docs, benchmark, n=4, block_words=40)
    assert seen[0] == "written" and seen[1:] == ["block", "written"] * (len(seen) // 2) and len(seen) > 3
    assert {r.doc_id: (r.n_words, list(r["items"]), len(r.spans)) for r in got.collect()} == {1: (9, ["0", "1", "2", "3"], 1), 2: (1, [], 0)}


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(documents([]), none).collect() == []
    assert [r.spans for r in D.contamination(documents([(1, "a b")]), none).collect()] == [[]]
    assert D.decontaminate(documents([(1, "a b")]), none).count() == 1
