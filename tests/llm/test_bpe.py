"""Encoding against the published library and against plain merges; exact round trips."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from conftest_llm import odd_texts, table

from songframe.llm import bpe


@pytest.fixture(scope="module")
def own():
    path, pattern = bpe.production()
    with open(path, "rb") as file:
        made = bpe.coder(file.read(), pattern)
    return made, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=made.ranks, special_tokens={})


def random_texts():
    rng = random.Random(3)
    odd = "abcdeéßñ日本　\xa0\x1c\x1d\x85 \n\t\r 12½²'sStT'll.!$😀​ǅªↀ１"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += ["".join(rng.choice("abin the") for _ in range(2000)) for _ in range(20)]
    return texts + ["a" * 20_000, " " * 1000, "ab" * 5000, "<|endoftext|>"]


def test_ids_equal_the_library(own):
    made, library = own
    for text in random_texts() + odd_texts():
        want = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        assert made.encode(text) == want, text
        assert made.decode(want) == (text or "").encode()


def test_compatibility_is_what_merges_give(own):
    made, _ = own
    rng, tokens = random.Random(8), list(made.ranks)
    for _ in range(3000):
        pair = rng.choice(tokens), rng.choice(tokens)
        assert made.compatible[pair] == (bpe.merges(pair[0] + pair[1], made.ranks)[0] == list(pair))


def test_small_vocabulary_with_a_token_that_merges_never_make():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"ab": 257, b"abc": 300, b"bcd": 301}
    small = bpe.Coder(ranks, r"\S+|\s+")
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
        if text.encode() not in ranks:
            assert small.piece(text.encode()) == [ranks[t] for t in bpe.merges(text.encode(), ranks)[0]]


def test_memo_forgets_only_what_it_can_make_again():
    memo = bpe.Memo(lambda x: x + 1, 4)
    assert [memo[i % 7] for i in range(50)] == [i % 7 + 1 for i in range(50)]
    assert len(memo) <= 4 and len(memo.older) <= 4


def test_query_and_clashing_names(spark, odd_docs, tmp_path, own):
    _, library = own
    rows = {r.doc_id: r for r in bpe.query(spark, table(spark, tmp_path, "documents", odd_docs)).collect()}
    for doc_id, text in enumerate(odd_texts()):
        ids = library.encode_ordinary(text or "")
        assert rows[doc_id].n_tokens == len(ids)
        assert rows[doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    clash = odd_docs.withColumnRenamed("lang", "made").withColumnRenamed("source", "ids")
    assert bpe.encode(clash, *bpe.production()).columns == ["doc_id", "text", "made", "n_chars", "ids"]
    assert bpe.encode(odd_docs.limit(0), *bpe.production()).count() == 0
