import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.bpe import Encoder, PrefixTable, TextTable, encode_documents, load_ranks

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = load_ranks(PATH)
ENCODER = Encoder(RANKS, P.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdehilnorst  '.,\n\t0123éß漢🎉-=_", max_size=200))
def test_encodes_like_the_library(text):
    ids = ENCODER.encode(text)
    assert ids == THEIRS.encode_ordinary(text) and ENCODER.decode(ids) == text.encode()


def test_edits_and_appends():
    rnd = random.Random(1)
    for _ in range(60):
        data = bytes(rnd.choice(b"abcdehilnorst ") for _ in range(rnd.randint(0, 400)))
        table = PrefixTable(ENCODER.vocabulary, data)
        a, b = sorted((rnd.randint(0, len(data)), rnd.randint(0, len(data))))
        new = bytes(rnd.choice(b"aethin") for _ in range(4))
        computed = table.replace(a, b, new)
        whole = PrefixTable(ENCODER.vocabulary, data[:a] + new + data[b:])
        assert table.last == whole.last and table.tokens() == whole.tokens() and computed <= len(whole.data)
        cut = rnd.randint(0, len(whole.data))
        assert whole.tokens(cut) == PrefixTable(ENCODER.vocabulary, whole.data[:cut]).tokens()


def test_edit_of_a_long_text_is_local():
    data = b"the quick brown fox jumps over the lazy dog and " * 200
    table = PrefixTable(ENCODER.vocabulary, data)
    assert table.replace(10, 12, b"xy") < len(data) // 4


def test_appended_text():
    table, text = TextTable(ENCODER), ""
    for more in ("It", "'", "s a te", "st  ", " of", "\n\n", "x", " 12", "3 !!", "?"):
        table.append(more)
        text += more
        assert table.tokens() == ENCODER.encode(text)


def test_long_run():
    text = "=" * 30_000 + " x" * 3000
    assert ENCODER.encode(text) == THEIRS.encode_ordinary(text)


def test_edge_rows(spark, docs):
    df = docs([(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "x"), (4, "a" * 200_000)])
    out = {(r.doc_id, len(r.ids)): bytes(r.decoded) for r in encode_documents(df, PATH, P.PATTERN).collect()}
    assert out[(1, 0)] == b"" and out[(2, 0)] == b"" and out[(3, 2)] == b"hello world" and (None, 1) in out and len(out) == 5
    assert encode_documents(df.limit(0), PATH, P.PATTERN).count() == 0
    assert encode_documents(df, PATH, P.PATTERN).count() == 6


@pytest.mark.parametrize("bad", [b""])
def test_empty_table_has_no_tokens(bad):
    assert PrefixTable(ENCODER.vocabulary, bad).tokens() == []


def test_vocabularies_that_cannot_encode():
    with pytest.raises(ValueError, match="no token for byte"):
        PrefixTable(Encoder({b"a": 0}, P.PATTERN).vocabulary, b"ab")
    unreachable = Encoder({b"a": 0, b"b": 1, b"c": 2, b"abc": 3}, P.PATTERN)
    with pytest.raises(ValueError, match="reached by merges"):
        PrefixTable(unreachable.vocabulary, b"abcabc")


def test_idle_workers_forget(monkeypatch):
    import time

    from millrace.llm import bpe

    monkeypatch.setattr(bpe, "IDLE_SECONDS", 0.2)
    encoder = bpe.shared_encoder(PATH, P.PATTERN)
    text = "some words to be kept"
    with bpe._in_use():
        ids = encoder.encode(text)
        time.sleep(0.4)
        assert encoder._known
        with bpe._in_use():
            pass
        time.sleep(0.4)
        assert encoder._known  # another task is still at work
    time.sleep(0.5)
    assert not encoder._known and encoder.encode(text) == ids == THEIRS.encode_ordinary(text)
