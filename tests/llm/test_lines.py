"""Line dedup against plain Python, and the banded distance against a full table."""

from __future__ import annotations

import random
import re

from conftest_llm import odd_texts, words

from songframe.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain(rows, edits, least):
    first = {}
    for doc, text in sorted(rows):
        for no, line in enumerate((text or "").split("\n")):
            if words(line):
                first.setdefault(line, (doc, no))
    near = {
        b for b in first for a in first
        if a != b and first[a] < first[b] and min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits
    }
    out = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        gone = [bool(words(x)) and (x in near or first[x] != (doc, no)) for no, x in enumerate(parts)]
        kept = "\n".join(x for x, g in zip(parts, gone, strict=True) if not g)
        out.append((doc, sum(bool(words(x)) for x in parts), sum(gone), sum(x in near for x in parts), kept if text is not None else None))
    return sorted(out)


def edited(rng, line, n):
    line = list(line)
    for _ in range(n):
        at, kind = rng.randrange(len(line) + 1), rng.random()
        if kind < 0.4 and at < len(line):
            line[at] = rng.choice("abé日")
        elif kind < 0.7:
            line.insert(at, rng.choice("abé日"))
        elif at < len(line):
            del line[at]
    return "".join(line)


def test_distance(spark):
    rng = random.Random(1)
    pairs = [("", ""), ("", "ab"), ("a", ""), ("abc", "abd"), ("x", "xx"), ("é" * 30, "é" * 32)]
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 40)))
        pairs.append((a, edited(rng, a, rng.randint(0, 5))))
    for edits in (1, 2, 3):
        df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").coalesce(2)
        got = {r.i for r in lines.within(df, edits).collect()}
        assert got == {i for i, (a, b) in enumerate(pairs) if distance(a, b) <= edits}


def test_against_all_pairs_of_lines(spark):
    rng = random.Random(2)
    bases = ["".join(rng.choice("abcdefgé ") for _ in range(rng.randint(12, 45))) for _ in range(25)]
    texts = [
        "\n".join(edited(rng, rng.choice(bases), rng.choice([0, 0, 1, 1, 2, 3])) for _ in range(rng.randint(1, 6))) for _ in range(50)
    ]
    texts += [t for t in odd_texts() if len(t or "") < 2000]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, no int, lines string").repartition(3)
    got = sorted((r.doc_id, r.lines.n, r.lines.removed, r.lines.near, r.text) for r in lines.dedup(docs).collect())
    assert got == plain(rows, lines.EDITS, lines.LEAST_CHARS)
    kept = lines.without_repeats(docs)
    assert kept.columns == docs.columns and kept.where("lines = 'x'").count() == len(rows)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_no_rows_and_rows_twice(spark):
    docs = spark.createDataFrame([(1, "a line that is long enough\nb"), (1, "a line that is long enough\nb"), (None, "b")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in lines.without_repeats(docs).collect())
    assert got == [("1", "a line that is long enough\nb")] * 2 + [("None", "")]
    assert lines.dedup(docs.limit(0)).count() == 0


def test_groups_of_near_lines_give_out_few_pairs(spark, monkeypatch):
    """A tight group is settled by its first line; in a loose one hardly a pair is given out; both as by all pairs."""
    rng = random.Random(8)
    body = "".join(rng.choice("abcdefgh ") for _ in range(90))
    tight = [body + f" {i:02d}" for i in range(80)]
    loose = [body[:40] + "".join(rng.choice("qrstuvwxyz0123456789") for _ in range(6)) + body[40:] for _ in range(80)]
    rows = list(enumerate([*loose, *tight, loose[5] + "q", body.upper()]))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept, sizes = lines.Workspace.keep, []

    def counting(self, df, name):
        out = kept(self, df, name)
        if name == "pairs":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(lines.Workspace, "keep", counting)
    got = sorted((r.doc_id, r.lines.n, r.lines.removed, r.lines.near, r.text) for r in lines.dedup(docs).collect())
    assert got == plain(rows, lines.EDITS, lines.LEAST_CHARS)
    assert sum(x[3] for x in got) > 75
    assert sizes[0] <= 12 * len(rows) and sizes[1] < 200


def test_keys_of_segments_and_their_code(spark):
    """Keys hash the pieces that plain slicing gives, and their code is small enough to be compiled."""
    texts = ["a line of plain words", "eine Zeile mit Größe und ß", "x" * 22, "日本語の行がここにあります、二十字以上"]
    rows = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "h long, line string, n int")
    got = lines.segment_keys(rows, 2)
    pieces = []
    for h, t in enumerate(texts):
        for less in range(3):
            sizes = [(len(t) - less) // 3 + (i >= 3 - (len(t) - less) % 3) for i in range(3)]
            for i in range(3):
                for shift in range(max(-i, less - (2 - i)), min(i, less + (2 - i)) + 1):
                    start = max(sum(sizes[:i]) + shift, 0)
                    pieces.append((h, len(t) - less, i + 1, t[start : start + sizes[i]], not less and not shift))
    want = spark.createDataFrame(pieces, "h long, n int, i int, piece string, own boolean")
    want = want.selectExpr("h", "xxhash64(n, i, cast(piece as binary)) as key", "own")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    code = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "codegen")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000
