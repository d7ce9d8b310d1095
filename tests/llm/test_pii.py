"""Personal data against the plain patterns, and terms against counts by hand."""

import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from newsmood.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    odd, even = d[-1::-2], d[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")))
                or (kind == "card" and 14 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 10 <= len(digits) <= 15)
            ):
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], list(PLAIN).index(x[0])))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a@.-+ ()1204859é%\n", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a.b@c.de", "x@@y.z", "10.0.0.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (375) 555-4393", "é", " ", "-", "5", "999.1.1.1"]), max_size=12))
def test_base_spans_of_joined_pieces(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == brute(text)


def test_cases_and_clashing_columns(spark, documents):
    rows = [(1, None), (2, ""), (3, "write a.b@c.de now"), (3, "write a.b@c.de now"), (None, "+1 (375) 555-4393 é"), (5, "x" * 300_000 + " 10.0.0.1")]
    got = pii.find_pii(documents(rows)).collect()
    assert len(got) == 6
    by = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in got}
    assert by == {1: [], 2: [], 3: [("email", 6, 14)], None: [("phone", 0, 17)], 5: [("ip", 300_001, 300_009)]}
    assert pii.find_pii(documents([])).collect() == []
    assert pii.sanitize(documents([])).collect() == []


def corpus():
    rng = random.Random(5)
    fill = ["the", "of", "and", "in", "to", "was", "on"]
    rows = []
    for i in range(60):
        words = [rng.choice(fill) for _ in range(30)]
        if i % 10 == 0:  # six surroundings of one address, always beside the same rare word
            words[10:10] = ["Marlowe", "boss@firm.example.com"]
        rows.append((i, " ".join(words)))
    return rows


def test_revealing_terms_are_found_and_cleaned(spark, documents):
    docs = documents(corpus())
    found = pii.find_pii(docs)
    for r in found.collect():
        text = dict(corpus())[r.doc_id]
        assert [text[s.start : s.end] for s in r.terms] == (["Marlowe"] if r.doc_id % 10 == 0 else [])
    telling = pii.disclosing(docs, pii.extract(docs)).collect()
    assert len(telling) == 1 and math.isclose(telling[0].share, math.log(60 * 6 / (6 * 6)) / math.log(60 / 6))
    clean = {r.doc_id: r for r in pii.sanitize(docs).collect()}
    assert "[NAME] [EMAIL]" in clean[0].text and "Marlowe" not in clean[0].text
    assert clean[1].text == dict(corpus())[1] and clean[1].n_words == "clash"
    assert "Marlowe" not in pii.sanitize(docs, action="remove").where("doc_id = 0").first().text


def test_copies_do_not_make_words_revealing(spark, documents):
    text = "a lone Marlowe boss@firm.example.com text with nothing else in it"
    docs = documents([(i, text) for i in range(9)] + [(i, "other words") for i in range(9, 30)])
    assert all(not r.terms for r in pii.find_pii(docs).collect())


def test_terms_of_entities_seen_once(spark, documents):
    rng = random.Random(7)
    fill = lambda n: [rng.choice(["the", "of", "and", "in", "to", "was", "on"]) for _ in range(n)]
    rows = [(i, " ".join(fill(30))) for i in range(300)]
    for k in range(4):  # four addresses of one domain, each once, always beside the same word
        rows.append((300 + k, " ".join([*fill(10), "Vantreuil", f"person{k}@firm.example.com", *fill(20), "vantreuil", *fill(3)])))
    for k in range(3):  # a word of three texts, once beside an address that occurs once
        rows.append((400 + k, " ".join([*fill(12), "Marlowe", *(["solo@other.example.org"] if k == 0 else []), *fill(12)])))
    rows += [(410, rows[-1][1])] * 3  # copies are one text
    docs = documents(rows)
    found = {r.doc_id: [dict(rows)[r.doc_id][s.start : s.end] for s in r.terms] for r in pii.find_pii(docs).collect()}
    assert {i: t for i, t in found.items() if t} == {**{300 + k: ["Vantreuil", "vantreuil"] for k in range(4)}, 400: ["Marlowe"]}
    shares = {r.share for r in pii.disclosing(docs, pii.extract(docs)).collect()}
    n = 307  # different texts
    assert any(math.isclose(s, math.log(n / 3) / math.log(n)) for s in shares) and any(math.isclose(s, 1) for s in shares)
    clean = pii.sanitize(docs).where("doc_id = 300").first().text
    assert "antreuil" not in clean and "[NAME] [EMAIL]" in clean and "[WORD]" in clean
    assert not any(r.terms for r in pii.find_pii(docs, support=5).collect())
