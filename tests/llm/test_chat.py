"""Formatted conversations against turns put together one by one, and their round trip."""

import hashlib
import random

import pytest

from newsmood.llm import chat as H

TEMPLATE = H.Template()
PIECES = [*TEMPLATE.markers(), "\\", "\\\\", "<", "[", "<\\/s>", "[\\\\INST]", "/s>", "<<", "SYS>>", "é", "日本", "🙂", " ", "\n", "a"]
SCHEMA = "conv_id long, turn long, role string, text string, part string, edge int"


def noise(rng, most=12):
    return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, most)))


def test_escapes_hide_markers_and_come_off():
    rng = random.Random(1)
    for _ in range(3000):
        text = noise(rng)
        hidden = TEMPLATE.escape(text)
        assert not any(m in hidden for m in TEMPLATE.markers())
        assert TEMPLATE.unescape(hidden) == text


def by_hand(rows):
    """{conversation: (turns, formatted text, loss texts)}"""
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, (r[3] or "").encode())
    for c, _, role, text in sorted(rows, key=key):
        turns, whole, loss = out.setdefault(c, ([], [], []))
        turns.append((role or "", text or ""))
        before, after = TEMPLATE.around(role or "")
        whole.append(before.decode() + TEMPLATE.escape(text or "") + after.decode())
        if role == "assistant":
            loss.append(text or "")
    return {c: (t, "".join(w), loss) for c, (t, w, loss) in out.items()}


def cases():
    rng = random.Random(3)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", "[ROLE]</s>", None]), noise(rng)))
    rows += [(50, 0, "user", None), (50, 1, "assistant", None), (51, None, "assistant", "x"), (51, 2, "assistant", "x"), (51, 2, "assistant", "x")]
    rows += [(None, 1, "user", "lost"), (None, 0, "assistant", "first"), (52, 0, "assistant", ""), (53, 0, "assistant", "é<s>" * 20_000)]
    rows += [(54, i, "user" if i % 2 else "assistant", f"{i} " + noise(rng)) for i in range(900)]  # a hot conversation
    rng.shuffle(rows)
    return rows


@pytest.fixture(params=["true", "false"])
def few_tasks(spark, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield request.param == "true"
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_texts_masks_and_digests(spark, few_tasks):
    rows, part_bytes = cases(), H.PART if few_tasks else 300
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    formatted = H.format_chats(df, part_bytes=part_bytes)
    assert formatted.columns == ["conv_id", "part", "edge", "n_turns", "text", "loss"]
    parts = {}
    for r in sorted(formatted.collect(), key=lambda r: r.part):
        parts.setdefault(r.conv_id, []).append(r)
    want = by_hand(rows)
    assert parts.keys() == want.keys()
    for c, (turns, text, loss) in want.items():
        assert "".join(r.text for r in parts[c]) == text
        assert sum(r.n_turns for r in parts[c]) == len(turns)
        assert [TEMPLATE.unescape(r.text[s.start : s.end]) for r in parts[c] for s in r.loss] == loss
        back = [(role, TEMPLATE.unescape(r.text[a:b])) for r in parts[c] for role, a, b in H.turns_of(r.text, TEMPLATE)]
        assert back == turns
        assert len(parts[c]) == 1 or all(r.edge for r in parts[c])
    assert few_tasks or len(parts[54]) > 1  # a conversation shared by tasks
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: tuple(r)[1:] for r in H.digests(formatted).collect()}
    assert got == {
        c: (len(t), sha("".join(f"{a}\n{b}\n" for a, b in t)), len("".join(loss)), sha("".join(loss)), len(w)) for c, (t, w, loss) in want.items()
    }


def test_empty_table_and_other_template(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert H.format_chats(none).collect() == [] and H.digests(H.format_chats(none)).collect() == []
    plain = H.Template(roles={"q": ("{Q}", "{/Q}"), "a": ("{A}", "{/A}")}, other=("{R}", "{/R}", "{/T}"), loss=("a",))
    df = spark.createDataFrame([(1, 0, "q", "{Q}", "", 0), (1, 1, "a", "x{\\/A}", "", 0), (1, 2, "z", "y", "", 0)], SCHEMA)
    rows = H.format_chats(df, plain).collect()
    assert "".join(r.text for r in sorted(rows, key=lambda r: r.part)) == "{Q}{\\Q}{/Q}{A}x{\\\\/A}{/A}{R}z{/R}y{/T}"
    row = H.digests(H.format_chats(df, plain), plain).first()
    assert (row.n_turns, row.loss_chars) == (3, 6) and row.loss_sha256 == hashlib.sha256(b"x{\\/A}").hexdigest()
