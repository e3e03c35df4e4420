"""Quality rules as a bitmask ledger.

Every rule is evaluated once. The ledger keeps, per document, the measurements and one bit for each
rule it fails. A policy is a named mask over those bits, so changing or comparing policies reads the
ledger only, and ablations are bitwise aggregates over it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from songframe.llm.batches import SPACE, VALUES, mix, piece_hash, pieces, prefix_hash, windows, word_hashes, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_alpha_words")

#: Bit by bit: name and when a document fails. Bits are never reused; a changed rule gets a new one.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("many_words", "n_words > 1000000"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("symbols", "4 * n_symbols > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("few_letters", "10 * n_alpha_words < 4 * n_words"),
)
BIT = {name: 1 << at for at, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Versioned policies: the mask of the rules that reject.
POLICIES = {
    "base": BASE,
    "v1": sum(BIT.values()),
    "v2": sum(BIT.values()) & ~BIT["many_words"],
}
#: A long text is no bad one: ``many_words`` is kept for the ledger and ablations only.
PRODUCTION = "v2"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[offsets])


def _again(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How many items before each one, in key order, have its key and owner: 0 for the first."""
    both = mix(keys + mix(owner.astype(np.uint64)))
    order = np.argsort(both, kind="stable")
    same = np.zeros(len(both), bool)
    same[1:] = both[order][1:] == both[order][:-1]
    twin = same.copy()
    twin[:-1] |= same[1:]
    out = np.empty(len(both), np.int8)
    out[order] = same.astype(np.int8) + twin  # 0 alone, 1 first of several, 2 later of several
    return out


def measured(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of some whole texts, one array entry a text."""
    rows = len(offsets) - 1
    starts, ends, owner = words(data, offsets)
    out = {"n_words": np.bincount(owner, minlength=rows)}
    inside = ~SPACE[data]
    out["word_chars"] = _per_text(inside & ((data & 0xC0) != 0x80), offsets)
    out["n_symbols"] = _per_text(_SYMBOL[data], offsets)

    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LETTER[data], out=letters[1:])
    out["n_alpha_words"] = np.bincount(owner[letters[ends] > letters[starts]], minlength=rows)

    at, keys = windows(word_hashes(data, starts, ends, VALUES), owner, 3)
    repeated = at[_again(keys, owner[at]) > 0]
    covered = np.zeros(len(starts), bool)
    for step in range(3):
        covered[repeated + step] = True
    out["n_repeat_words"] = np.bincount(owner[covered], minlength=rows)

    breaks = np.flatnonzero(data == 0x0A)
    begin = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    texts = np.searchsorted(offsets, breaks, side="right") - 1
    line_owner = np.sort(np.concatenate((np.arange(rows), texts)))
    finish = np.sort(np.concatenate((breaks, offsets[1:])))
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=filled[1:])
    worded = filled[finish] > filled[begin]
    begin, finish, line_owner = begin[worded], finish[worded], line_owner[worded]
    keys = mix(piece_hash(prefix_hash(data), begin, finish) + (finish - begin).astype(np.uint64))
    out["n_lines"] = np.bincount(line_owner, minlength=rows)
    out["n_dup_lines"] = np.bincount(line_owner[_again(keys, line_owner) == 2], minlength=rows)
    return out


def _measure(text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measured(data, offsets) for _, _, data, offsets in pieces(batch.column(text))]
            columns = [
                pa.array(np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64())
                for name in MEASURES
            ]
            rows = pa.StructArray.from_arrays(columns, list(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], [*batch.schema.names, "_measures"])

    return run


def failed_bits(measure) -> Column:
    """The bits of the rules that a document fails, from the measurements ``measure(name)``."""
    bits = F.lit(0).cast("long")
    for name, when in RULES:
        for column in sorted(MEASURES, key=len, reverse=True):
            when = when.replace(column, measure(column))
        bits = bits.bitwiseOR(F.when(F.expr(when), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` with one struct column ``into``: the measurements and the long ``failed``.

    A null or empty text has no words and fails ``few_words``. Every row gets its own entry,
    repeated ids included. A column named ``into`` is replaced; other columns pass through as they
    are, whatever their names. No rows give no rows. Texts are measured whole, one at a time where
    they are long, and no shuffle is needed.
    """
    docs = docs.drop(into)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    struct = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
    schema = T.StructType([*plain.schema.fields, T.StructField("_measures", struct)])
    out = plain.mapInArrow(_measure(names.index(text)), schema)
    entry = F.struct(*[F.col(f"_measures.{m}") for m in MEASURES], failed_bits(lambda m: f"_measures.{m}").alias("failed"))
    return out.withColumn("_measures", entry).toDF(*names, into)


def passes(policy: str = PRODUCTION, entry: str = "quality") -> Column:
    """Whether a ledger entry passes a policy."""
    return F.col(f"{entry}.failed").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def keep_good(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The documents that pass a policy, with their own columns only."""
    at = "_songframe_quality"
    return ledger(docs, into=at).where(passes(policy, at)).drop(at)


def ablation(entries: DataFrame, policy: str = PRODUCTION, entry: str = "quality") -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that it alone rejects.

    Documents are counted by their failure bits first, so what is shuffled is at most one row per
    task and set of bits.
    """
    mask = POLICIES[policy]
    sets = entries.groupBy(F.col(f"{entry}.failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items() if bit & mask]
    return (
        sets.select("bits", "n", F.explode(F.array(*rules)).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only"),
            F.sum("n").alias("n_documents"),
        )
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op7: measurements, failure bits and the verdict of the production policy per document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    entries = ledger(docs).drop("text")
    base = F.col("quality.failed").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return entries.select(
        "doc_id", "quality.*", base.alias("base_failed"), (~base & passes()).alias("kept")
    )


_BITS = " | ".join(f"(CASE WHEN {when} THEN {BIT[name]} ELSE 0 END)" for name, when in RULES)
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum([length(w) FOR w IN ws]), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(lines.n_lines, 0) AS n_lines, coalesce(lines.n_dup, 0) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words,
         CAST(len([w FOR w IN ws IF regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]')]) AS BIGINT) AS n_alpha_words
  FROM d LEFT JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
f AS (SELECT *, CAST({_BITS} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_alpha_words, failed,
       (failed & {BASE}) <> 0 AS base_failed, (failed & {POLICIES[PRODUCTION]}) = 0 AS kept
FROM f
"""
