"""Quality rules against a plain Python count."""

from __future__ import annotations

from collections import Counter

from conftest_llm import odd_texts, table, words

from songframe.llm import quality


def plain(text):
    text = text or ""
    found = words(text)
    grams = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + j for i, g in enumerate(grams) if g in often for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return {
        "n_words": len(found),
        "word_chars": sum(map(len, found)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_alpha_words": sum(any(c > "\x7f" or c.isalpha() for c in w) for w in found),
    }


def test_query_on_odd_texts(spark, odd_docs, tmp_path):
    rows = {r.doc_id: r for r in quality.query(spark, table(spark, tmp_path, "documents", odd_docs)).collect()}
    assert len(rows) == odd_docs.count()
    for doc_id, text in enumerate(odd_texts()):
        want, got = plain(text), rows[doc_id]
        assert {k: got[k] for k in want} == want, (doc_id, text)
        assert got.base_failed == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (got.base_failed and got.kept)


def test_clashing_names_and_no_rows(spark, odd_docs):
    clash = odd_docs.withColumnRenamed("source", "n_words").withColumnRenamed("lang", "quality")
    out = quality.ledger(clash)
    assert out.columns == ["doc_id", "text", "n_words", "n_chars", "quality"]
    assert out.where("n_words = 's'").count() == odd_docs.count()
    assert quality.ledger(odd_docs.limit(0)).count() == 0
    assert quality.keep_good(clash).columns == clash.columns


def test_ablation_counts_sole_rejections(spark, odd_docs):
    entries = quality.ledger(odd_docs)
    failed = [r.quality.failed for r in entries.collect()]
    for row in quality.ablation(entries).collect():
        assert row.n_failed == sum(bool(f & row.bit) for f in failed)
        assert row.n_only == sum(f == row.bit for f in failed)
        assert row.n_documents == len(failed)
    assert {r.rule for r in quality.ablation(entries, "base").collect()} == {"few_words", "repeated_windows"}
