"""Counts against the unigram encoder of the installed library."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from newsmood.llm import tokens


def encoder(pieces):
    scores = [("<unk>", min((s for _, s in pieces), default=0.0)), *pieces]
    t = Tokenizer(models.Unigram(scores, unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokens.MARK, prepend_scheme="always", split=True)
    return t


TIES = [(p, -1.0 * len(p)) for p in ("a", "b", "ab", "ba", "aba", tokens.MARK, tokens.MARK + "a", tokens.MARK + "ab", "abab")] + [("c", -0.5), ("cc", -1.0)]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="abcxé \n▁", max_size=24))
def test_ties_and_unknowns_as_the_library(text):
    assert tokens.Counter(TIES).of(text)[0] == len(encoder(TIES).encode(text).ids)


@pytest.fixture(scope="module")
def real():
    pieces = tokens.vocabulary()
    return pieces, encoder(pieces)


def test_documents_as_the_library(spark, sf_dir, real):
    pieces, library = real
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, pieces).collect()}
    assert got == {i: len(library.encode(t).ids) for i, t in texts.items()}


def test_cases_and_clashing_columns(spark, documents, real):
    pieces, library = real
    rows = [(1, None), (2, ""), (3, " two  words "), (3, " two  words "), (None, "日本 é"), (5, "x" * 50_000 + " end")]
    got = tokens.token_counts(documents(rows), pieces).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(library.encode(t or "").ids)) for i, t in rows)
    assert tokens.token_counts(documents([]), pieces).collect() == []
