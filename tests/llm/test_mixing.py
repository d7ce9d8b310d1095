"""Mixing: targets, whole words, disjoint blocks, the tree's distribution."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsmood.llm import mixing as M


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus():
    docs, n = [], 0
    for k, source in enumerate(["a", "b", "c", "é", None]):
        for i in range(30 * (k + 1) if k != 1 else 4):
            docs.append((n, " ".join(f"d{n}w{j}" for j in range(1 + (i * 37) % 90)), source))
            n += 1
    return docs + [(9000, None, "a"), (9001, "", "b"), (None, "null id", "c"), (3, docs[3][1], "a"), (3, docs[3][1], "a"), (9002, "long " * 60_000, "c")]


def waterfill(sizes, weights=(3, 1, 2), share=1.5):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if w[s] * level > 2 * sizes[s]]
        if not over:
            return out | {s: w[s] * level for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.discard(s)


def sized(docs):
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(words(t))
    return sizes


def test_targets_and_takes(spark, documents):
    docs = corpus()
    rows = M.draw(documents(docs), ["doc_id", "source"]).withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["n"])).collect()
    assert sorted((str(r.doc.doc_id), r.size) for r in rows) == sorted((str(i), len(words(t))) for i, t, _ in docs)
    target, taken = waterfill(sized(docs)), Counter()
    for r in rows:
        assert abs(r.target - target[r.doc.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.doc.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_the_mix_holds_the_words_it_draws(spark, documents):
    docs = corpus()
    table = documents(docs)
    out = M.mix(table, shard_words=20_000)
    assert out.columns == [*table.columns, "mix_shard"]
    rows = out.collect()
    target, have, source = waterfill(sized(docs)), Counter(), {}
    for i, t, s in docs:
        for w in words(t):
            have[w] += 1
            source[w] = s
    taken, drawn = Counter(), Counter()
    for r in rows:
        for w in words(r.text):
            taken[w] += 1
            drawn[r.source] += 1
    assert all(n <= 2 * have[w] for w, n in taken.items())
    assert all(abs(drawn[s] - target[s]) <= 1 for s in target)
    full = {s for s in target if target[s] >= sized(docs)[s]}
    assert all(taken[w] >= have[w] for w in have if source[w] in full)  # whole passes come first
    shards = Counter()
    for r in rows:
        shards[r.mix_shard] += len(words(r.text))
    # Documents stay whole: a shard may have the end of the longest beyond its blocks.
    assert len(shards) > 2 and max(shards.values()) - min(shards.values()) <= 3 * M.MIN_BLOCK_WORDS + 2 * 60_000
    texts = {(str(i), t) for i, t, _ in docs}
    cut = [r for r in rows if (str(r.doc_id), r.text) not in texts]
    assert len(cut) <= len(target) and all(any(str(r.doc_id) == i and t.startswith(r.text) for i, t in texts if t) for r in cut)
    copies = Counter((str(r.doc_id), r.source, r.text) for r in rows)
    assert copies[("3", "a", docs[3][1])] in (3, 4, 5, 6)  # equal rows, each drawn for itself
    again = [r for r in M.mix(table.repartition(3), shard_words=20_000).collect() if r.doc_id != 3]
    rows = [r for r in rows if r.doc_id != 3]
    key = lambda r: (str(r.doc_id), r.text, str(r.source), r.mix_shard)
    assert sorted(map(key, again)) == sorted(map(key, rows))


def test_empty_tables(spark, documents):
    assert M.mix(documents([])).collect() == []
    assert M.mix(documents([(1, None), (2, "")])).collect() == []


def test_the_tree_keeps_quotas_and_draws_hypergeometrically(spark):
    quotas = spark.createDataFrame([(1, 40), (2, 20), (3, 0), (4, 4)], "rank int, q long")
    counts = Counter()
    for seed in range(40):
        rows = M.split(quotas, 1, seed).collect()
        whole = Counter()
        for r in rows:
            whole[r["rank"]] += r.q
        assert dict(whole) == {1: 40, 2: 20, 3: 0, 4: 4}
        left = {r["rank"]: r.q for r in rows if r.shard == 0}
        assert sum(left.values()) == 32
        counts[left[1]] += 1
    mean = sum(k * n for k, n in counts.items()) / 40
    spread = sum((k - mean) ** 2 * n for k, n in counts.items()) / 40
    # 32 of 64 places, 40 of them of source 1: mean 20, variance 32 * 5/8 * 3/8 * 32/63 = 3.8.
    assert abs(mean - 20) < 1.2 and 1.5 < spread < 8


@pytest.mark.parametrize("levels", [0, 3])
def test_leaves_are_even(spark, levels):
    rows = M.split(spark.createDataFrame([(1, 50), (2, 31)], "rank int, q long"), levels).groupBy("shard").agg(F.sum("q").alias("q")).collect()
    assert len(rows) == 2**levels and max(r.q for r in rows) - min(r.q for r in rows) <= 1


def test_the_plan_has_no_python(spark, documents):
    plan = M.mix(documents(corpus()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_mix_can_be_mixed_again_and_keeps_white_space(spark, documents):
    docs = [(i, f" a{i}\n\n  b{i}\t c{i} " * (1 + i % 5), "ab"[i % 2]) for i in range(200)]
    table = documents(docs).withColumns({"_order": F.lit(1), "shard": F.lit("x"), "order": F.lit("y"), "rank": F.lit(0)})
    once = M.mix(table)
    twice = M.mix(once.withColumn("mix_shard", F.lit("old")))
    assert once.columns == twice.columns == [*table.columns, "mix_shard"]
    texts = {t for _, t, _ in docs}
    assert sum(r.text not in texts for r in once.collect()) <= 2
    assert all(any(t.startswith(r.text) for t in texts) for r in twice.collect())
    assert {r["shard"] for r in once.select("shard").collect()} == {"x"} and {r["rank"] for r in once.select("rank").collect()} == {0}


def test_draw_and_mix_agree(spark, documents):
    docs = [d for d in corpus() if d[0] != 3]  # of equal rows at a border the plan and the mix may take others
    table = documents(docs)
    planned = Counter()
    for r in M.draw(table, ["doc_id"], shard_words=20_000).collect():
        for c in r.copies:
            planned[str(r.doc.doc_id), c.shard, c.n] += 1
    mixed = Counter((str(r.doc_id), r.mix_shard, len(words(r.text))) for r in M.mix(table, shard_words=20_000).collect())
    assert mixed == planned
