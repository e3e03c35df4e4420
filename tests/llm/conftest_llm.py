"""Helpers for the tests of the training-text operators."""

from __future__ import annotations

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return WORD.findall(text)


def odd_texts():
    """Null, empty and blank texts, ties, repeats, other scripts, odd spaces, one long text."""
    rng = random.Random(5)
    vocabulary = ["the", "Of", "cat", "é", "ÉTÉ", "dog x", "1,2", "$$$", "日本", "a"] + [f"w{i}" for i in range(30)]
    texts = [None, "", "   \n\t", "one", "two words", "the the the the", "\n\n a \n a\n a", "x " * 60, "😀 " * 5, "A\x0bB\x0cC\rD"]
    for n in (5, 60, 300):
        texts += [" ".join(rng.choice(vocabulary) for _ in range(n)) for _ in range(6)]
    texts += ["\n".join(" ".join(rng.choice(vocabulary) for _ in range(4)) for _ in range(20)) for _ in range(4)]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(20_000))]
    return texts + texts[10:14]


@pytest.fixture
def odd_docs(spark):
    rows = [(i, text, "en", "s", len(text or "")) for i, text in enumerate(odd_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def table(spark, tmp_path, name, df):
    path = str(tmp_path / f"{name}.parquet")
    df.write.parquet(path)
    return str(tmp_path)
