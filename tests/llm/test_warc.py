"""Archives: exact round trip, revisits, and index look-ups against a scan."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsmood.llm import warc as W

SCHEMA = "page_id long, url string, html string, key string, digest string, size long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", -1) for r in rows], SCHEMA)


def sample():
    big, other = "<p>é " * 400, "<b>" * 500
    rows = [(i, f"http://www.Host{i % 3}.example.org:80/A/{i}?q=1#f", f"<p>page {i}</p>") for i in range(40)]
    rows += [(50 + i, "https://hot.example.org/", big) for i in range(5)] + [(60, "https://x.example.org/a b\r\nX: 1", other), (61, None, None)]
    return [*rows, (62, "", ""), (None, "https://n.example.org/", big), (54, "https://hot.example.org/", big), (70, "http://s.example.org", "x" * 3_000_000)]


def expected(rows):
    last = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            last[h] = max(last.get(h, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        refers = last[h] if h in last and i is not None and i < last[h] else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def seen(records):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records), key=str)


@pytest.mark.parametrize(("file_bytes", "block_lines"), [(W.FILE_BYTES, W.BLOCK_LINES), (2000, 3)])
def test_round_trip_through_the_index(spark, file_bytes, block_lines):
    table = pages(spark, sample())
    captures = W.write_archives(table, file_bytes=file_bytes)
    index = W.build_index(captures, block_lines=block_lines)
    places = W.lookup(index, W.keys_of(table))
    records = W.read_records(places).collect()
    assert seen(records) == expected(sample())
    text = {(i, h or "") for i, _, h in sample()}
    assert all((r.page_id, bytes(r.payload).decode()) in text for r in records if r.record_type == "response")
    assert W.read_records(captures.select("file", "offset", "length"), payloads=False).count() == len(sample())


def test_lookup_of_single_and_absent_keys(spark):
    table = pages(spark, sample())
    captures = W.write_archives(table)
    index = W.build_index(captures, block_lines=2)
    wanted = [W.capture_key(W.url_key("http://host1.example.org/a/1?q=1"), 1), "zz)/ 1", "", None]
    got = W.lookup(index, spark.createDataFrame([(k,) for k in wanted], "key string")).collect()
    assert [r.key for r in got] == wanted[:1]
    assert [r.page_id for r in W.read_records(W.lookup(index, spark.createDataFrame([(wanted[0],)], "key string"))).collect()] == [1]


def test_empty_table(spark):
    table = pages(spark, [])
    index = W.build_index(W.write_archives(table))
    assert W.read_records(W.lookup(index, W.keys_of(table))).collect() == []


def test_url_keys():
    assert W.url_key("https://www.Example.co.uk:443/A/b?Q=1#x") == "uk,co,example)/a/b?q=1"
    assert W.url_key("http://example.org:8080") == "org,example:8080)/"
    assert W.url_key(None) == W.url_key("") == ""


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80), st.text(max_size=20), st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)))
def test_one_record_reads_back(payload, url, page_id):
    digest = hashlib.sha1(payload).hexdigest()
    r = W.parse(W.record(page_id, url, payload, digest, len(payload), None))
    assert (r["page_id"], r["payload"], r["payload_digest"], r["record_type"]) == (page_id, payload, digest, "response")
    r = W.parse(W.record(page_id, url, payload, digest, len(payload), 7))
    assert (r["payload"], r["payload_bytes"], r["refers_to"]) == (None, len(payload), 7)


def test_damaged_records_raise():
    good = W.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), 3, None)
    for bad in (good.replace(b"abc", b"abd"), good[:-1], b"x" + good):
        with pytest.raises(ValueError):
            W.parse(bad)
