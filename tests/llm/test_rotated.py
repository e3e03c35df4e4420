"""Nearest neighbours against all inner products."""

from __future__ import annotations

import duckdb
import numpy as np
from conftest_llm import table

from songframe.llm import rotated


def plain(rows, every, nearest):
    """query_id, rank, vec_id, score by brute force; rows of (id, list)."""
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, e in {(i, tuple(v)) for i, v in good if i is not None and i % every == 0}:
        e = np.array(e)
        scored = []
        for i, v in good:
            if i != q and len(v) == len(e):
                score = 0.0
                for a, b in zip(e, v, strict=True):
                    score += a * b
                scored.append((-score, i is None, i or 0, i))
        out += [(q, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:nearest], 1)]
    return sorted(out)


def clustered(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((6, dims))
    return (middle[rng.integers(0, 6, n)] + 0.7 * rng.standard_normal((n, dims))).astype(np.float32)


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(rotated, "BLOCK_ROWS", 300)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(clustered(2500, 48))]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = [tuple(r) for r in rotated.neighbours(docs, 50, 20).collect()]
    want = plain(rows, 50, 20)
    score = {(q, v): s for q, _, v, s in plain(rows, 50, 2500)}
    assert all(score[q, v] == s for q, _, v, s in got)
    assert len(got) == len(want)
    found, there = {(q, v) for q, _, v, _ in got}, {(q, v) for q, _, v, _ in want}
    assert len(found & there) / len(there) >= 0.98


def test_bounds_hold_and_prune():
    vectors = clustered(3000, 64).astype(float)
    centre = vectors.mean(0)
    codes, length, along, cosine = rotated.encode(vectors, centre)
    assert codes.shape == (3000, 8) and (0.6 < cosine).all()
    signs = np.unpackbits(codes, axis=1).astype(float) * 2 - 1
    queries = vectors[:40]
    estimate = (queries - centre) @ rotated.rotation(64) @ signs.T * (length / (cosine * 8)) + along + (queries @ centre)[:, None]
    bound = 3 * np.linalg.norm(queries - centre, axis=1)[:, None] * length * np.sqrt(1 - cosine**2) / cosine / np.sqrt(63)
    off = np.abs(estimate - queries @ vectors.T)
    off[np.arange(40), np.arange(40)] = 0
    assert (off <= bound).mean() > 0.99
    error = (estimate - queries @ vectors.T)[off > 0]
    assert abs(error.mean()) < 0.05 * error.std()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(clustered(60, 5, 2))]
    rows += [(100, None), (120, []), (140, [0.0] * 5), (160, [1.0, None, 0.0, 0.0, 0.0]), (180, [nan, 1.0, 1.0, 1.0, 1.0]), (200, [inf, 1.0, 1.0, 1.0, 1.0])]
    rows += [(220, [1.0, 2.0]), (221, [0.5, 0.5]), (240, [3.0])]
    rows += [(None, [2.0, 2.0, 2.0, 2.0, 2.0]), rows[7], rows[0], (61, rows[3][1]), (62, rows[3][1])]
    docs = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, block int, role int, dims int")
    got = sorted(tuple(r) for r in rotated.neighbours(docs, 20, 20).collect())
    assert got == plain(rows, 20, 20)
    few = sorted(tuple(r) for r in rotated.neighbours(docs.where("vec_id between 0 and 9"), 5, 20).collect())
    assert few == plain([r for r in rows if r[0] is not None and r[0] < 10], 5, 20)
    assert rotated.neighbours(docs.limit(0), 20).count() == 0
    assert rotated.neighbours(docs.where("vec_id = 140"), 20).count() == 0


def test_query_and_sql(spark, tmp_path):
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(clustered(200, 16, 3))]
    folder = table(spark, tmp_path, "embeddings", spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = sorted(tuple(r) for r in rotated.query(spark, folder).collect())
    assert got == plain([r[:2] for r in rows], 20, 20)
    sql = rotated.ORACLE.replace("from embeddings", f"from '{folder}/embeddings.parquet/*.parquet'")
    assert sorted(duckdb.sql(sql).fetchall()) == got
