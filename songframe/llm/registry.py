"""The operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from songframe.llm import bm25, bpe, brown, collocations, debruijn, lines, minhash, quality, rotated, suffixes, tries, urls, warc

QUERIES = {
    "op1_minhash": minhash.query,
    "op2_byte_bpe": bpe.query,
    "op3_line_dedup": lines.query,
    "op4_url_filters": urls.query,
    "op5_suffix_dedup": suffixes.query,
    "op6_bm25_leaks": bm25.query,
    "op7_quality_rules": quality.query,
    "op8_debruijn": debruijn.query,
    "op9_brown_lm": brown.query,
    "op10_warc": warc.query,
    "op11_collocations": collocations.query,
    "op12_rotated_codes": rotated.query,
    "op13_prefix_trie": tries.query,
}

ORACLES = {
    "op3_line_dedup": lines.ORACLE,
    "op4_url_filters": urls.ORACLE,
    "op7_quality_rules": quality.ORACLE,
    "op10_warc": warc.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_rotated_codes": rotated.ORACLE,
    "op13_prefix_trie": tries.ORACLE,
}
