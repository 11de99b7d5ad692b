import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from panelforge.llm import bpe as bpe_module
from panelforge.llm.bpe import WordBpe, encode_texts
from panelforge.llm.q_bpe import token_digests
from panelforge.llm.tokens import TokenCounter, count_tokens, frequent_pre_tokens
from panelforge.llm.vocabulary import BYTE_BPE, WORD_BPE, default_path, vocabulary_json

from .cases import TEXTS, documents, empty

ALPHABET = "abcΣß'sT 1 2<|>endoftext \n\té́՘İ　\x1c\x85"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    out = ["".join(rnd.choice(ALPHABET) for _ in range(40)) for _ in range(300)]
    out += ["".join(chr(rnd.choice(points)) for _ in range(30)) for _ in range(300)]
    return [*out, *[t or "" for t in TEXTS], "<|startoftext|>x<|endoftext|><|endoftext|>", "<|endoftext|", "<|ENDOFTEXT|>"]


def test_bpe_equals_the_library(texts):
    vocabulary = vocabulary_json(default_path(WORD_BPE))
    bpe, library = WordBpe(vocabulary, cache_words=50), Tokenizer.from_str(vocabulary)
    for t in texts:
        n, ids, tokens = bpe.encode(t)
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and n == len(want)
        assert bpe.decode(ids) == tokens == library.decode(want, skip_special_tokens=False)


def test_token_counter_equals_the_library(texts):
    vocabulary = vocabulary_json(default_path(BYTE_BPE))
    library = Tokenizer.from_str(vocabulary)
    count = TokenCounter(vocabulary, {" the": 1}, cache_entries=50)
    assert [count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts_of_a_frame(spark):
    docs = documents(spark)
    library = Tokenizer.from_str(vocabulary_json(default_path(BYTE_BPE)))
    want = sorted((repr(r["doc_id"]), len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = count_tokens(docs, frequent=4).collect()
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert count_tokens(empty(docs)).count() == 0
    assert frequent_pre_tokens(docs.select("text"), 1).first()["piece"] == " word"


def test_encoded_frame(spark):
    docs = documents(spark)
    library = Tokenizer.from_str(vocabulary_json(default_path(WORD_BPE)))
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((repr(r["doc_id"]), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = [(repr(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in token_digests(docs).collect()]
    assert sorted(got) == sorted(want)
    assert encode_texts(empty(docs)).count() == 0


def test_long_words_equal_the_library_and_short_ones():
    path = default_path(WORD_BPE)
    bpe, library = WordBpe(vocabulary_json(path)), Tokenizer.from_file(path)
    rng = np.random.default_rng(6)
    letters = "".join(rng.choice(list("etaoinshrdlu"), 200_000))
    chinese = "".join(chr(c) for c in rng.integers(0x4E00, 0x9FA5, 20_000))
    for text in (letters, chinese, "a" * 5_000, "日本語のテキスト" * 300, "x" * 129, "y" * 128):
        n, ids, _ = bpe.encode(text)
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids and n == len(ids) // 4
    for word in ("tokenization", "antidisestablishmentarianism", "ßtraße", "ааааа", "mississippi"):
        parts = [bpe.alphabet[b] for b in word.encode()]
        parts[-1] += bpe.suffix
        assert bpe._long(parts) == bpe.parts(word)
    assert all(len(w) <= bpe_module.SHORT for w in bpe.cache)
