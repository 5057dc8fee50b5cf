import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import tokenize as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def encoder():
    return T.PrefixEncoder.from_rank_file(open(T.VOCABULARY, "rb").read())


@pytest.fixture(scope="module")
def oracle():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(T.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=T.PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


CASES = ["", " ", "Hello world", "  two  spaces\n\n tab\t", "don't we'll I'd", "naïve café ß 日本語 🎮👍🏽", "<|endoftext|> is text", "x" * 3000, "ab" * 700 + "!", "12345678901234567890", "\u0000​‮", "ПРИВЕТ мир"]


@pytest.mark.parametrize("text", CASES)
def test_equals_library(encoder, oracle, text):
    assert encoder.encode(text) == oracle(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_equals_library_on_any_text(encoder, oracle, text):
    assert encoder.encode(text) == oracle(text)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=40), st.binary(max_size=20))
def test_append_is_exact(encoder, head, tail):
    table = encoder.extend(head, [])
    assert encoder.extend(head + tail, list(table)) == encoder.extend(head + tail, [])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdeth rnig", min_size=5, max_size=400), st.text(alphabet="xyzea", max_size=6), st.data())
def test_edit_is_exact(encoder, text, new, data):
    old = text.encode()
    start = data.draw(st.integers(0, len(old)))
    stop = data.draw(st.integers(start, len(old)))
    after, table = encoder.edit(old, encoder.extend(old, []), start, stop, new.encode())
    assert after == old[:start] + new.encode() + old[stop:]
    assert table == encoder.extend(after, [])


def test_round_trip(encoder):
    text = " ".join(CASES)
    assert b"".join(encoder.bytes_of[i] for i in encoder.encode(text)).decode() == text


def test_corpus(spark, encoder):
    rows = [(i, t, "extra") for i, t in enumerate([*CASES, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in T.encode_corpus(df).collect()}
    assert got == {i: encoder.encode(t) for i, t, _ in rows}
    assert got[len(CASES)] == [] and got[0] == []
    counts = {r.doc_id: r.n_tokens for r in T.encode_corpus(df, counts_only=True).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert T.encode_corpus(df.limit(0)).count() == 0
