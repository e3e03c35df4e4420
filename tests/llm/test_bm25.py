"""Retrieval against BM25 computed for every passage and part, and leaks against planted ones."""

from __future__ import annotations

import random

import numpy as np
from conftest_llm import table

from songframe.llm import bm25


def plain_scores(index, hashes):
    """(part, best score) over all passages of one text, by definition."""
    counts = len(hashes)
    starts = [i * bm25.PART for i in range(max(1, -(-counts // bm25.PART) - 1))] if counts else []
    best = {}
    for start in starts:
        held = set(hashes[start : start + 2 * bm25.PART].tolist())
        for part in range(index.parts):
            at = range(index.begin[part], index.begin[part + 1])
            score = sum(index.weight[i] for i in at if int(index.terms[index.term[i]]) in held)
            if score >= index.threshold - 1e-9:
                best[part] = max(score, best.get(part, 0))
    return best


def made(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "."]) for _ in range(n))


def corpus():
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(40)] + [f"r{i}" for i in range(600)]
    items = [(i, made(rng, rng.randint(6, 180), vocabulary)) for i in range(30)] + [(50, None), (51, ""), (52, "... !!"), (53, "Yes"), (0, "twice w1 w2 r3 r4 r5. Same id r6 r7 r8")]
    docs = []
    for i in range(40):
        text = made(rng, rng.choice([0, 3, 60, 200, 700]), vocabulary)
        if i % 3 == 0:
            text += " " + items[i % 30][1].upper().replace(",", "") + " " + made(rng, 40, vocabulary)
        docs.append((i, text))
    return items, [*docs, (90, None), (91, "  \n")]


def test_every_passage_and_part():
    items, docs = corpus()
    index = bm25.Index(items, 0.3)
    for _, text in docs:
        hashes, owner = bm25.terms(*bm25._bytes(text or ""))
        word, passage, many = bm25.passages(owner, 1)
        _, part, score = index.retrieve(index.find(hashes)[word], passage, int(many.sum()))
        got = {}
        for p, s in zip(part.tolist(), score.tolist(), strict=True):
            got[p] = max(s, got.get(p, 0))
        want = plain_scores(index, hashes)
        assert got.keys() == want.keys()
        assert np.allclose([got[k] for k in want], [want[k] for k in want])


def test_planted_items_are_found_and_others_are_not(spark, tmp_path):
    items, docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    folder = table(spark, tmp_path, "documents", frame)
    table(spark, tmp_path, "benchmark", spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: r for r in bm25.query(spark, folder).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        planted = doc_id % 3 == 0 and doc_id < 40
        assert got[doc_id].leaked == planted, (doc_id, got[doc_id])
        if planted:
            assert doc_id % 30 in got[doc_id]["items"]
        if not (text or "").strip():
            assert got[doc_id].n_passages == 0


def test_shards_clashing_names_and_no_rows(spark, monkeypatch):
    items, docs = corpus()
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, items string, n int")
    tests = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(bm25, "SHARD_CHARS", 4000)
    kept = bm25.clean(frame, tests)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs if not (i % 3 == 0 and i < 40)}
    assert bm25.clean(frame.limit(0), tests).count() == 0
    assert bm25.clean(frame, tests.limit(0)).count() == len(docs)


def test_items_with_changed_words_or_one_side_only(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(3000)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    items = [(i, sentence(rng.randint(16, 30)) + " " + sentence(rng.choice([2, 4, 5, 16]))) for i in range(20)]
    docs, want = [], {}
    for i, text in items:
        question, answer = bm25.question_and_answer(text)
        versions = [(question, True), (answer, len(answer.split()) >= 13), (sentence(40), False), (" ".join(text.split()[:9]), False)]
        for changes in (1, 2):
            words = text.split()
            for at in rng.sample(range(len(words)), changes):
                words[at] = "changed"
            versions += [(" ".join(words), True)]
        words = text.split()
        versions += [(" ".join(words[:7] + words[8:12] + ["put", "in"] + words[12:]), True)]
        for version, leaked in versions:
            want[len(docs)] = leaked
            docs.append((len(docs), f"{sentence(50)} {version} {sentence(60)}"))
    got = bm25.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: r.leaks.leaked for r in got} == want
