"""The prefix trie against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from conftest_llm import table

from songframe.llm import tries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    """All nodes of (conv_id, turn, role, text) rows."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}"), role, text))
    turns = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    members = defaultdict(list)
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h] + mine[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append((c, d == len(whole)))
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    inner = {p[:-1] for p in members if p}
    for p, m in members.items():
        if p:
            children[p[:-1]] += 1
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in inner
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = sha(",".join(str(c) for c in sorted(c for c, end in m if end)))
        parent = min(c for c, _ in members[p[:-1]]) if p else None
        out.append((min(c for c, _ in m), len(p), parent, len(m), children[p], leaves[p], saved[p], ends))
    return sorted(out, key=str)


def sample(seed, convs=150, words=4, length=14):
    """Conversations of few words, so that many share a beginning."""
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        stem = [("user", f"t{rng.randint(0, words)}é") for _ in range(rng.randint(0, length))]
        if rng.random() < 0.3:
            stem = [("system", "always the same")] * rng.randint(1, 12)
        rows += [(c, i, r, t) for i, (r, t) in enumerate(stem)]
    return rows


def check(spark, rows, shard_turns=None, names="conv_id long, turn long, role string, text string"):
    df = spark.createDataFrame(rows, names).repartition(4)
    got = sorted((tuple(r) for r in tries.prefix_trie(df, shard_turns).collect()), key=str)
    assert got == plain([r[:4] for r in rows])


@pytest.mark.parametrize("shard_turns", [None, 300, 7])
def test_any_number_of_shards(spark, shard_turns):
    rows = sample(1) + [(c, i, "user", "copy") for c in range(400, 460) for i in range(4)] + [(500, i, "user", "long") for i in range(300)]
    check(spark, rows, shard_turns)


def test_odd_rows(spark):
    rows = [
        (5, None, "a", "x"), (5, 0, None, None), (5, 0, "a", "b"), (5, 0, "a", "b"), (6, 3, "user", ""), (7, 1, "us", "erx"), (7, 2, "use", "rx"),
        (-3, 1, "a", "x"), (-5, 1, "a", "y"), (None, 1, "a", "x"), (10, None, None, None), (11, 1, "a", "x" * 100_000), (2**40, 1, "a", "x"),
    ]
    check(spark, [(*r, "k", 1, 2) for r in rows], None, "conv_id long, turn long, role string, text string, key string, h int, shard int")
    check(spark, [(7, 0, "u", "x")])
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert tries.prefix_trie(empty).count() == 0


def test_long_lists_of_members(spark, monkeypatch):
    monkeypatch.setattr(tries, "SPAN", 16)
    check(spark, [(c, 0, "user", "same") for c in range(0, 1000, 5)] + [(c, 9, "user", "same") for c in range(1000, 1300, 5)], 3)


def test_findclose():
    rng = random.Random(2)
    for n in (1, 2, 31, 32, 33, 500, 3000):
        bits, depth = [], 0
        for _ in range(n):
            up = depth == 0 or rng.random() < (0.9 if n == 500 else 0.5)
            bits.append(up)
            depth += 1 if up else -1
        bits = [True, *bits, *[False] * (depth + 1)]
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        at = np.flatnonzero(bits)
        assert tries.Parentheses(np.array(bits)).findclose(at).tolist() == [want[i] for i in at]


def test_query_and_sql(spark, tmp_path):
    rows = sample(4, 60)
    folder = table(spark, tmp_path, "conversations", spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted((tuple(r) for r in tries.query(spark, folder).collect()), key=str)
    assert got == plain(rows)
    sql = tries.ORACLE.replace("from conversations", f"from '{folder}/conversations.parquet/*.parquet'")
    assert sorted(duckdb.sql(sql).fetchall(), key=str) == got
