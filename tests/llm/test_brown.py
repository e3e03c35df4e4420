"""Counts and the word model against plain Python; the class model on held-out text."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import table, words

from songframe.llm import brown


def plain(rows):
    tokens = [words(text, lower=True) + [None] for _, text in rows]
    out = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    seen = Counter(t for held, ts in zip(out, tokens, strict=True) if not held for t in ts)
    n, v = sum(seen.values()), len(seen)
    return [
        (i, held, len(ts), sum(seen[t] > 0 for t in ts), n, sum(math.log10((seen[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts))
        for (i, _), held, ts in zip(rows, out, tokens, strict=True)
    ]


def same(got, rows):
    got, want = sorted(tuple(r)[:6] for r in got), sorted(plain(rows))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)


def test_query_on_odd_texts(spark, odd_docs, tmp_path):
    twice = odd_docs.union(odd_docs.where("doc_id in (3, 12)")).withColumnRenamed("lang", "word")
    rows = [(r.doc_id, r.text) for r in twice.collect()]
    got = brown.query(spark, table(spark, tmp_path, "documents", twice)).collect()
    same(got, rows)
    assert all(r.score < 0 and r.perplexity > 1 for r in got)


def test_no_rows_and_no_training(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(30) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    same(brown.score(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert brown.score(docs.limit(0)).count() == 0


def test_class_model_sums_to_one_and_beats_the_word_model(spark):
    """Two kinds of words in turn, several of each: classes learn the turn, single words can't."""
    rng = random.Random(6)
    nouns, verbs = [f"n{i}" for i in range(12)], [f"v{i}" for i in range(12)]
    texts = [" ".join(x for _ in range(30) for x in (rng.choice(nouns), rng.choice(verbs))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [r for r in brown.score(docs).collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    assert gain > 0.2, gain


def test_join_keys_come_from_the_rows():
    """A task that runs again, or over other batches, gives every token the same key."""
    rng = np.random.default_rng(2)
    counts = [3, 1, 7, 1]
    hashes = rng.integers(0, 1 << 64, sum(counts), dtype=np.uint64)
    hashes[-1] = hashes[3]
    row = pa.StructArray.from_arrays([pa.array([4, None, 9, 5])], ["doc_id"])
    texts = np.repeat(np.arange(4), counts)
    lone, keys = brown._spread(row, hashes, texts, np.arange(12))
    again, some = brown._spread(row.slice(2), hashes[4:], texts[4:] - 2, np.array([1, 7]))
    assert again.tolist() == lone[2:].tolist() and some.tolist() == keys[[5, 11]].tolist()
    assert len(set(keys.tolist())) == 12 and len(set(lone.tolist())) == 4 and (keys >= 0).all()


def test_every_word_gets_a_class(spark, monkeypatch):
    """Many words of one use each: no single one is frequent, yet their classes show, listed or joined."""
    rng = random.Random(7)
    nouns, verbs = [f"n{i}" for i in range(1500)], [f"v{i}" for i in range(1500)]
    texts = [" ".join(x for _ in range(50) for x in (rng.choice(nouns), rng.choice(verbs))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for listed in (brown.LISTED, 1500, 0):
        monkeypatch.setattr(brown, "LISTED", listed)
        got = brown.score(docs, classes=4).collect()
        same(got, list(enumerate(texts)))
        rows = [r for r in got if r.held_out]
        gain = sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
        assert gain > 0.2, (listed, gain)


def test_table_of_class_pairs_equals_a_plain_count(spark, monkeypatch):
    """What the rounds follow up in packed rows and joins is what all neighbours of the texts give."""
    rng = random.Random(8)
    texts = [" ".join(f"w{min(int(rng.paretovariate(0.7)), 60)}" for _ in range(rng.randrange(9))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    train = [t.split() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    seen = {}

    def noted(name, run):
        def call(*args):
            state, table = run(*args)
            seen[name] = args, (state, table.copy())  # scoring changes the table
            return state, table

        return call

    for name in ("exchange", "exchange_unlisted"):
        monkeypatch.setattr(brown, name, noted(name, getattr(brown, name)))
    monkeypatch.setattr(brown, "MOST_PARTS", 2)
    monkeypatch.setattr(brown, "LISTED", 12)
    monkeypatch.setattr(brown, "BLOCK", 16)
    brown.score(docs, classes=3).collect()
    (args, (own, first)), (_, (rare, table)) = seen["exchange"], seen["exchange_unlisted"]
    listed, known = args[1].value, {r.word: r.k for r in rare.collect()}
    end = len(listed.hashes)

    def classes(word, of_rare):
        data = np.frombuffer(word.encode(), np.uint8)
        code = int(listed.codes(brown.word_hashes(data, np.array([0]), np.array([len(data)])))[0])
        return int(own[code]) if code >= 0 else of_rare(code)

    for got, of_rare in ((first, lambda code: brown.RARE), (table, known.__getitem__)):
        want = np.zeros_like(got)
        for text in train:
            k = [brown.BORDER, *[classes(w, of_rare) for w in text], brown.BORDER]
            np.add.at(want, (k[:-1], k[1:]), 1)
        if got is first:  # unlisted words among themselves and next to ends come later
            for a, b in ((0, 0), (0, 1), (1, 0)):
                want[a, b] = got[a, b]
        assert (got == want).all()
    assert known and 0 < end <= 12
