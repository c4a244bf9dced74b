from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ranklane.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def test_against_the_library(docs, no_docs, library, fixture_rows):
    got = {r.doc_id: r for r in bpe.encode(docs, PATH).collect()}
    for key, text, *_ in fixture_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = got[key] if key is not None else None
        if r is None:
            continue
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(no_docs, PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.sampled_from(["<|endoftext|>", "  ", "\n\n", "'re", "'S", "don't", "aaaaaaaa", "日本", "½", "\x1c", "\u0085"])), max_size=8))
def test_any_text(library, parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    t = bpe.tokenizer(PATH)
    ((ids, joined),) = t.encode_batch([text])
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert joined == ",".join(map(str, ids))
    assert t.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_memory_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5000)
    monkeypatch.setattr(bpe, "STEPS", 40)
    t = bpe.TrieBPE(PATH)
    for i in range(20):
        for text, (ids, _) in zip([f"word{i} other{i * j}" for j in range(9)], t.encode_batch([f"word{i} other{i * j}" for j in range(9)]), strict=True):
            assert ids == library.encode(text, add_special_tokens=False).ids
    assert len(t.known) < 120 and len(t.apart) < 80
    t.forget()
    assert not t.known and len(t.states) == 1


def test_a_long_word_is_not_kept(library):
    t = bpe.TrieBPE(PATH)
    text = "abcdefghij" * 3000 + " end " + "あいう" * 2000 + "abcdefghik" * 3
    ((ids, _),) = t.encode_batch([text])
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert max(map(len, t.known)) <= bpe.LONG_WORD
