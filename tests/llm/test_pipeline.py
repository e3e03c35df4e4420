"""The pipeline's stages in turn against plain Python."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import tiktoken
from conftest_llm import table
from test_lines import edited
from test_lines import plain as plain_lines
from test_minhash import plain as plain_groups

from songframe.llm import bm25, bpe, lines, quality
from songframe.llm.minhash import Banding


def corpus():
    rng = random.Random(21)
    def prose(n):
        return "\n".join(" ".join(f"w{rng.randint(0, 3000)}" for _ in range(12)) for _ in range(n))

    boilerplate, item = prose(1), " ".join(f"q{i}" for i in range(30)) + ". The answer is a1 a2 a3."
    texts = [prose(7) for _ in range(20)]
    texts += [texts[0], texts[1] + "\n" + prose(1), None, "", "short text", "spam " * 80, "### $$$ " * 40]
    texts += [boilerplate + "\n" + prose(6) for _ in range(4)] + [edited(rng, boilerplate, 2) + "\n" + prose(6)]
    texts += [prose(4) + "\n" + item + "\n" + prose(2)]
    # near copies with every line too far from the first's for the line stage
    body = [[f"z{rng.randint(0, 3000)}" for _ in range(60)] for _ in range(8)]
    texts.append("\n".join(" ".join(x) for x in body))
    texts.append("\n".join(" ".join(x) + " other" for x in body))
    return list(enumerate(texts)), [(7, item)]


def test_run(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    folder = table(spark, tmp_path, "documents", docs)
    table(spark, tmp_path, "benchmark", spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}

    good = {r.doc_id for r in quality.query(spark, folder).collect() if r.kept}
    left = [(i, t) for i, t in rows if i in good]
    left = [(i, t) for i, _, _, _, t in plain_lines(left, lines.EDITS, lines.LEAST_CHARS)]
    groups = plain_groups([i for i, _ in left], [t for _, t in left], Banding())
    kept = {g[0] for g in groups if g[3]}
    assert len(kept) < len(left)
    leaky = {i for i, t in left if "q0 q1 q2 q3" in t}
    assert leaky & kept
    want = {i: t for i, t in left if i in kept - leaky}
    assert {i: r.text for i, r in got.items()} == want

    path, pattern = bpe.production()
    with open(path, "rb") as file:
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(file.read()), special_tokens={})
    for r in got.values():
        ids = library.encode_ordinary(r.text)
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes() and r.n_tokens == len(ids) and r.round_trip
        assert r.n_chars == len(r.text)


def test_stages_keep_the_columns(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows[:3]], "doc_id long, text string, lang string, source string, n_chars long")
    table(spark, tmp_path, "benchmark", spark.createDataFrame(items, "item_id long, text string"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "tokens"]
    assert bm25.PART > 0
