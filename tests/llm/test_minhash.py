"""Near-duplicate groups against all pairs compared in plain Python."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import odd_texts, table, words

from songframe.llm import minhash
from songframe.llm.batches import encoded
from songframe.llm.minhash import Banding


def sets(texts, n):
    out = []
    for text in texts:
        w = words(text, lower=True)
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


def plain(ids, texts, banding):
    found, parent = sets(texts, banding.words), list(range(len(ids)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            both = len(found[i] & found[j])
            if both and 100 * both >= banding.percent * len(found[i] | found[j]):
                parent[top(i)] = top(j)
    least = {}
    for i, one in enumerate(ids):
        least[top(i)] = min(one, least.get(top(i), one))
    return [(one, len(found[i]), least[top(i)], least[top(i)] == one) for i, one in enumerate(ids)]


def near_copies():
    rng = random.Random(4)
    texts = []
    for base in range(6):
        body = [f"b{base}w{rng.randint(0, 400)}" for _ in range(120)]
        texts.append(" ".join(body))
        for _ in range(14):  # a chain: copies of copies drift apart from the first
            body = [w if rng.random() > 0.012 else f"x{rng.randint(0, 9999)}" for w in body]
            texts.append(" ".join(body))
        texts += [texts[-1], texts[-1].upper(), "  ".join(body)]
    return texts


@pytest.mark.parametrize("banding", [minhash.PRODUCTION, Banding()])
def test_against_all_pairs(spark, banding):
    texts = near_copies() + odd_texts()
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    rows = [(i * 3, texts[at], "x") for i, at in enumerate(order)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted(tuple(r) for r in minhash.components(docs, banding).collect())
    assert got == sorted(plain([r[0] for r in rows], [r[1] for r in rows], banding))


def test_rounds_before_all_pairs(spark, monkeypatch):
    """A large loose group: most pairs are candidates, only neighbours in a chain are links."""
    monkeypatch.setattr(minhash, "FEW_PAIRS", 0)
    rng = random.Random(9)
    body, texts = [f"w{i}" for i in range(60)], []
    for _ in range(25):
        body = body.copy()
        body[rng.randrange(60)] = f"y{rng.randint(0, 10**6)}"
        texts.append(" ".join(body))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    banding = Banding(words=3, percent=85, halves=9, width=1)
    got = sorted(tuple(r) for r in minhash.components(docs, banding).collect())
    assert got == plain(list(range(25)), texts, banding)


def test_a_round_without_pairs_ends(spark, monkeypatch):
    """Texts that share keys but differ too much in length to be compared with any head."""
    monkeypatch.setattr(minhash, "FEW_PAIRS", 0)
    monkeypatch.setattr(minhash, "PAIRS_A_ROW", 0)
    body = [f"w{i}" for i in range(100)]
    texts = [" ".join(body), " ".join(body[:50]), " ".join(body[:99])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for some in (docs, docs.limit(2)):
        got = sorted(tuple(r) for r in minhash.components(some, Banding(words=3, percent=85, halves=9, width=1)).collect())
        n = some.count()
        assert got == plain(list(range(n)), texts[:n], Banding(words=3, percent=85, halves=9, width=1))


def test_links_through_a_document_without_an_id(spark):
    body = [f"w{i}" for i in range(100)]
    swapped = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(body))
    rows = [(1, swapped(20)), (None, swapped()), (2, swapped(60)), (9, "quite another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    banding = Banding(words=3, percent=90, halves=9, width=1)
    alike = lambda a, b: len(a & b) / len(a | b)
    sets = [{tuple(t.split()[i : i + 3]) for i in range(98)} for _, t in rows[:3]]
    assert alike(sets[0], sets[1]) >= 0.9 and alike(sets[1], sets[2]) >= 0.9 > alike(sets[0], sets[2])
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.components(docs, banding).collect()}
    assert got == {(1, 1, True), (None, 1, False), (2, 1, False), (9, 9, True)}


def test_query_repeated_rows_and_no_rows(spark, odd_docs, tmp_path):
    twice = odd_docs.union(odd_docs.where("doc_id < 5"))
    got = minhash.query(spark, table(spark, tmp_path, "documents", twice)).collect()
    assert len(got) == twice.count()
    for row in got:
        if not row.n_shingles:
            assert row.kept and row.component_id == row.doc_id
    assert minhash.components(odd_docs.limit(0), Banding()).count() == 0
    assert minhash.keep_one(odd_docs).columns == odd_docs.columns


def test_parity_maps_bound_the_difference():
    rng = random.Random(6)
    base = [f"w{i}" for i in range(1500)]
    texts = [" ".join(base[:n]) for n in (1, 5, 400, 514, 515, 1026, 1500)]
    texts += [" ".join("x" if rng.random() < 0.1 else w for w in t.split()) for t in texts] + ["", None]
    data, offsets = encoded(pa.array(texts))
    keys, owner = minhash.shingles(data, offsets, 3)
    counts = np.bincount(owner, minlength=len(texts))
    maps = minhash._parities(keys, counts).to_pylist()
    assert [64 * len(m) for m in maps[:7]] == [1024, 1024, 1024, 1024, 2048, 2048, 4096] and maps[-1] == maps[-2] == []
    found = [set(keys[owner == i]) for i in range(len(texts))]
    for a, x in zip(found, maps, strict=True):
        for b, y in zip(found, maps, strict=True):
            if len(x) == len(y):
                assert sum((p ^ q).bit_count() if p ^ q >= 0 else ((p ^ q) + (1 << 64)).bit_count() for p, q in zip(x, y, strict=True)) <= len(a ^ b)


def test_a_loose_group_gives_out_few_pairs(spark, monkeypatch):
    """Alike but not similar enough: the groups hold all pairs, the join gives out the links and little more."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(f"y{rng.randint(0, 10**9)}" if i in at else w for i, w in enumerate(base)) for at in (rng.sample(range(200), 8) for _ in range(150))]
    texts += [texts[3] + " z", texts[7] + " z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept, seen = minhash.Workspace.keep, {}

    def counting(self, df, name):
        out = kept(self, df, name)
        if name == "pairs":
            seen["last"] = out.count()
        return out

    monkeypatch.setattr(minhash.Workspace, "keep", counting)
    got = sorted(tuple(r) for r in minhash.components(docs, minhash.PRODUCTION).collect())
    assert got == plain(list(range(152)), texts, minhash.PRODUCTION)
    assert seen["last"] < 20 < 152 * 151 / 2


def test_small_groups_are_finished_in_one_round(spark, monkeypatch):
    """Rounds for a large group don't carry along groups of two texts that share keys but are no link."""
    monkeypatch.setattr(minhash, "FEW_PAIRS", 0)
    monkeypatch.setattr(minhash, "PAIRS_A_ROW", 1)
    rng = random.Random(9)
    body, texts = [f"w{i}" for i in range(60)], []
    for _ in range(40):
        body = body.copy()
        body[rng.randrange(60)] = f"y{rng.randint(0, 10**6)}"
        texts.append(" ".join(body))
    for i in range(8):
        own = [f"z{i}x{j}" for j in range(200)]
        texts += [" ".join(own), " ".join("x" if j % 20 == 0 else w for j, w in enumerate(own))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept, seen = minhash.Workspace.keep, []

    def counting(self, df, name):
        out = kept(self, df, name)
        if name == "live":
            seen.append(out.where("n > 100").count())
        return out

    monkeypatch.setattr(minhash.Workspace, "keep", counting)
    banding = Banding(words=3, percent=85, halves=9, width=1)
    got = sorted(tuple(r) for r in minhash.components(docs, banding).collect())
    assert got == plain(list(range(len(texts))), texts, banding)
    assert seen[0] > 0 and len(seen) > 1 and not any(seen[1:])


@pytest.mark.parametrize("listed", [True, False])
def test_texts_that_are_not_compared_are_not_shuffled(spark, monkeypatch, listed):
    """Only the texts of nodes that share a key leave the tasks that read them, also where Spark would not broadcast their ids."""
    texts = near_copies()[:20] + [f"alone{i} " * 3 + f"and{i} only{i}" for i in range(30)]
    ids = [None, 0, *range(5, 3 + len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    if not listed:
        monkeypatch.setattr(minhash, "LISTED_IDS", 0)
    kept, plans = minhash.Workspace.keep, {}

    def watching(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return kept(self, df, name)

    monkeypatch.setattr(minhash.Workspace, "keep", watching)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [tuple(r) for r in minhash.components(docs, minhash.PRODUCTION).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = plain([1 << 40 if i is None else i for i in ids], texts, minhash.PRODUCTION)
    assert sorted(got, key=str) == sorted(((None if i == 1 << 40 else i, n, least, kept) for i, n, least, kept in want), key=str)
    assert ("BroadcastHashJoin [coalesce(doc_id" in plans["texts"]) == listed


def test_keys_are_shuffled_once(spark, monkeypatch):
    kept, plans = minhash.Workspace.keep, {}

    def watching(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return kept(self, df, name)

    monkeypatch.setattr(minhash.Workspace, "keep", watching)
    texts = near_copies()[:20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash.components(docs, minhash.PRODUCTION).collect())
    assert got == plain(list(range(20)), texts, minhash.PRODUCTION)
    assert plans["shared"].count("Exchange") == 1
