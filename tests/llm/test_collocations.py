"""Collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import odd_texts, table

from songframe.llm import collocations as co
from songframe.llm.storage import Workspace


def plain(rows, least=10, top=2000, absorb=50):
    """(lang, text) rows to all columns, counting every phrase."""
    count = defaultdict(Counter)
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                count[lang or "und"].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in count.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        longer = Counter()
        for p, a in f.items():
            if len(p) == 3 and a >= least:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], a)
        ranked = []
        for p, a in f.items():
            if len(p) < 2 or a < least or (longer[p] and 100 * longer[p] >= absorb * a):
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def sample(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "日本", "The", "OF"]
    rows = []
    for _ in range(n):
        words = [rng.choice(vocabulary[: rng.choice((4, 20, 44))]) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice(["en", "fr", None, "und"]), "".join(w + rng.choice((" ", " ", "\t", ", ", ".\n")) for w in words)))
    return rows


@pytest.mark.parametrize(("least", "bucket", "top"), [(10, None, 2000), (3, 500, 15), (10, 60, None)])
def test_against_plain_counts(spark, monkeypatch, least, bucket, top):
    monkeypatch.setattr(co, "SMALL", 16)
    rows = sample(least) + [("fr", t) for t in odd_texts()] + [("en", "the same line of text " * 3000)] * 2
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = sorted(tuple(r) for r in co.collocations(docs, least, top, bucket=bucket).collect())
    assert got == plain(rows, least, top or 10**9)


def test_equal_partitions_are_counts(monkeypatch):
    monkeypatch.setattr(co, "SMALL", 8)
    rng = np.random.default_rng(3)
    keys = [rng.integers(1, 9, 4000).astype(np.uint64), rng.integers(0, 12, 4000).astype(np.uint64), rng.integers(0, 30, 4000).astype(np.uint64)]
    keys[2][keys[1] == 0] = 0
    weights = rng.integers(1, 4, 4000)
    for lead in (1, 2, 3):
        want = Counter()
        for *w, c in zip(*keys, weights, strict=True):
            for depth in range(lead, 4):
                if all(w[:depth]):
                    want[depth, *map(int, w[:depth])] += int(c)
        got = {(d, *(int(keys[i][at]) for i in range(d))): c for d, at, c in co.equal_partitions(keys, weights, 20, lead)}
        if lead == 1:
            assert got == {p: c for p, c in want.items() if c >= 20}
        else:
            assert got == {p: c for p, c in want.items() if c >= 20 and len(p) > lead}


def test_new_values_after_a_collision(spark):
    docs = spark.createDataFrame([("en", "ab ba " * 20), ("fr", "ab")], "lang string, text string")
    words, values = co.vocabulary(docs, Workspace(spark), lambda seed: co._values(seed) if seed else np.zeros(256, np.uint64))
    assert sorted((r.lang, r.word, r.n) for r in words.collect()) == [("en", "ab", 20), ("en", "ba", 20), ("fr", "ab", 1)]
    assert (values == co._values(1)).all()


def test_query_no_rows_and_clashing_names(spark, tmp_path):
    rows = sample(9, 150)
    docs = spark.createDataFrame([(i, t, g, i, i, "x") for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, h long, w1 long, word string")
    got = sorted(tuple(r) for r in co.query(spark, table(spark, tmp_path, "documents", docs)).collect())
    assert got == plain(rows)
    assert co.collocations(docs.limit(0)).count() == 0
    assert co.collocations(docs.select("lang", (docs.text.isNull()).cast("string").alias("none"), docs.text.substr(1, 0).alias("text"))).count() == 0
