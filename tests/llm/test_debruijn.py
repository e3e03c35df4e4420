"""Substring dedup against a plain table of all windows."""

from __future__ import annotations

import hashlib
import random

import pytest
from conftest_llm import odd_texts, table, words

from songframe.llm import debruijn


def plain(rows, window):
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text in rows:
        w = words(text)
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc:
                keep[i : i + window] = [False] * window
        out.append((doc, len(w), len(w) - sum(keep), " ".join(x for x, k in zip(w, keep, strict=True) if k)))
    return sorted(out)


def pasted(rng, shared, n):
    """Texts pasted from own words and pieces of shared passages, whole, cut or edited."""
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 5)):
            passage = rng.choice(shared)
            a = rng.randint(0, 30)
            piece = passage[a : a + rng.randint(5, len(passage))]
            if rng.random() < 0.3:
                piece = piece.copy()
                piece[rng.randrange(len(piece))] = f"e{rng.randint(0, 99999)}"
            parts += piece if rng.random() < 0.7 else [f"o{rng.randint(0, 99999)}" for _ in range(rng.randint(1, 60))]
        texts.append(" ".join(parts))
    return texts


@pytest.mark.parametrize(("window", "k"), [(50, 20), (12, 5)])
def test_against_all_windows(spark, window, k):
    rng = random.Random(window)
    shared = [[f"s{i}w{rng.randint(0, 500)}" for _ in range(rng.randint(40, 260))] for i in range(8)]
    shared.append(["same"] * 90)
    shared.append(["ab", "ba"] * 60)
    texts = pasted(rng, shared, 120) + [" ".join(shared[0])] * 5 + odd_texts()
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[9]), (200, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in debruijn.dedup(docs, window, k).collect())
    assert got == plain(rows, window)


def test_query_and_no_rows(spark, odd_docs, tmp_path):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = [(d, n, m, hashlib.sha256(k.encode()).hexdigest()) for d, n, m, k in plain(rows, 50)]
    clash = odd_docs.withColumnRenamed("lang", "v").withColumnRenamed("source", "th")
    got = debruijn.query(spark, table(spark, tmp_path, "documents", clash)).collect()
    assert sorted(tuple(r) for r in got) == want
    assert debruijn.dedup(odd_docs.limit(0)).count() == 0
