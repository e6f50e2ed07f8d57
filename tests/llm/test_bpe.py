import hashlib

import duckdb
import pytest
import public_tokenizers
from helpers import documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenframe.llm import bpe
from lumenframe.llm.bpe import Codec, tokenised

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as f:
    CODEC = Codec(f.read())

ODD = ["", " ", "a<|endoftext|>b  <|endoftext|> \n\n x", "<|endoftext|>", "  hello   world\t\n", "🎉日本語 can't we'll 12345 !!!??", "a" * 400, " " * 50, " x　y", "aaaaabbbbbabababab" * 9, "\x00\x01ÿ", "the " * 50, "1234567890" * 9, " a\u0085b\x1cc\x1fd", "½²Ⅷ٣", "'s's 'S", "é ́", "\r\n\r\n x"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODEC.encode(text) == want and CODEC.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" aenrst'.\n", max_size=60), st.lists(st.sampled_from(["the", " the", "ing", "é", "  ", "<|endoftext|>", "<|", "1", "\n"]), max_size=12).map("".join)))
def test_any_text(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODEC.encode(text) == want and CODEC.decode(want) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=20), max_size=20))
def test_words_by_trie_equal_merging(words):
    assert CODEC.encode_words(list(set(words))) == {w: tuple(CODEC.merged(w)) for w in words}


@pytest.mark.parametrize("keep", [400_000, 50])
def test_operator_equals_the_library(spark, monkeypatch, keep):
    monkeypatch.setattr(bpe, "KEEP_WORDS", keep)
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' order by doc_id limit 80").fetchall()] + ODD + [None, "a", "a"]
    rows = {r.doc_id: r for r in tokenised(documents(spark, texts), PATH).collect()}
    for i, t in enumerate(texts):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids) and rows[i].decoded == (t or "")
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_table(spark):
    assert tokenised(empty(spark), PATH).collect() == []
