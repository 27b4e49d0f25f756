import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tidelog.llm.bpe import BoundaryBpe, encode_documents, load_spec  # noqa: E402
from tidelog.llm.queries import tokenizer_path  # noqa: E402

CODEC = BoundaryBpe(load_spec(tokenizer_path()))
LIBRARY = Tokenizer.from_file(tokenizer_path())


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = CODEC.encode(text)
    return got == want and CODEC.decode(got) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    assert same(text)


def test_special_cases():
    for text in ("", " ", "ΑΣ Σ", "a<|endoftext|>b <|startoftext|>", "\x1c\x85 x​z", "İI", "don't 123 'LL", "x" * 5000, "éé", "\U0001e6c0 Ꟛ", "<|endoftext", "🙂👍🏽"):
        assert same(text), text


def test_cuts_are_where_no_token_goes():
    symbols = CODEC._units("the</w>")
    assert CODEC.cuts(symbols) == [tuple(symbols)]
    rare = ["Ġ", "ł"] * 3
    assert "".join("".join(f) for f in CODEC.cuts(rare)) == "".join(rare)
    assert all(CODEC.merge(tuple(rare)) == tuple(i for f in CODEC.cuts(rare) for i in CODEC.merge(f)) for _ in range(1))


def test_long_fragments():
    import random

    rng = random.Random(4)
    for n in (65, 300, 3000):
        for alphabet in ("a", "ab", "the in", "abcdefghijklmnopqrstuvwxyz"):
            word = "".join(rng.choice(alphabet.replace(" ", "")) for _ in range(n))
            assert same(word)
    assert len(CODEC.encode("ab" * 200_000)) > 1000  # in well under quadratic time


def test_documents(spark, documents, odd_documents):
    for df in (documents, odd_documents):
        texts = {(r["doc_id"], r["n_chars"]): r["text"] or "" for r in df.collect()}
        out = encode_documents(df.select("doc_id", "n_chars", "text"), tokenizer_path()).collect()
        assert len(out) == df.count()
        for r in out:
            e = LIBRARY.encode(texts[r["doc_id"], r["n_chars"]], add_special_tokens=False).ids
            assert r["token_ids"] == e and r["n_tokens"] == len(e)
            assert r["ids_sha256"] == hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(e, skip_special_tokens=False).encode()).hexdigest()
    assert encode_documents(odd_documents.limit(0), tokenizer_path()).count() == 0
    clash = encode_documents(odd_documents, tokenizer_path(), full=False)
    assert dict(clash.dtypes)["n_tokens"] == "bigint" and clash.columns.count("n_tokens") == 1
