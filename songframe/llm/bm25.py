"""Benchmark decontamination by BM25 over an inverted index of the test items.

Test items are cut into parts of at most ``PART`` words. A part's BM25 weights are divided by their
sum, so a score is the weighted share of the part's terms that a passage has. Every passage of every
document is a query: windows of ``2 * PART`` words at steps of ``PART``, so that any ``PART`` words lie
whole in one. All parts that score ``threshold`` or more are retrieved.

Terms are split as in WAND. What a part's frequent terms can add at most is known beforehand, so only
rare terms are looked up; postings lie in blocks of parts with the largest weight of each block, and
the parts of a block are scored only where rare terms' block maxima and the frequent terms' bound
reach the threshold together. A question or answer long enough to count alone is also indexed as parts of
its own. A retrieved item is verified by the share of its words that the document holds, in runs or along
one place of the document where words may be changed, left out or put in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.llm.batches import LOWERED, mix, piece_hash, pieces, prefix_hash, windows, words

PART, BLOCK = 64, 8
K1, B = 1.2, 0.75
RUN = 5
#: Words that must agree at a place of the document for the words around it to be compared one by one,
#: and by how many words these may have moved against each other.
ANCHOR, SHIFT = 3, 2
#: Words from which a question or an answer alone makes a leak.
LONG = 13
#: Terms in at most this share of the parts count as rare; the bound of the others is exact anyway.
RARE = 0.03
#: Characters of test items in one index; larger sets of items take several, one after the other.
SHARD_CHARS = 1 << 25

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_VALUES = LOWERED.copy()
_VALUES[_PUNCTUATION] = 0


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased and without ASCII punctuation, and the text of each."""
    starts, ends, owner = words(data, offsets)
    letters = np.flatnonzero(~_PUNCTUATION[data])
    at = np.searchsorted(letters, starts)
    first = letters[np.minimum(at, len(letters) - 1)] if len(letters) else ends
    some = (at < len(letters)) & (first < ends) if len(letters) else np.zeros(len(starts), bool)
    return mix(piece_hash(prefix_hash(data, _VALUES), first[some], ends[some])), owner[some]


def _bytes(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    return windows(hashes, np.zeros(len(hashes), np.int64), n)[1]


@dataclass
class Item:
    item_id: int
    question: np.ndarray
    answer: np.ndarray


class _Text:
    """A document's words, and where its runs are."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.of = hashes, {}

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n not in self.of:
            found = _runs(self.hashes, n)
            order = np.argsort(found, kind="stable")
            self.of[n] = found[order], order
        return self.of[n]

    def holds(self, side: np.ndarray) -> np.ndarray:
        """Which words of ``side`` lie in a run of ``RUN`` words found anywhere (of all words, if fewer),
        or agree along the one place where most do."""
        covered = np.zeros(len(side), bool)
        if not len(side) or not len(self.hashes):
            return covered
        size = min(RUN, len(side))
        held, own = self.runs(size)[0], _runs(side, size)
        for at in np.flatnonzero(np.searchsorted(held, own, side="right") > np.searchsorted(held, own)):
            covered[at : at + size] = True
        if covered.all() or len(side) < ANCHOR:
            return covered
        (held, place), own = self.runs(ANCHOR), _runs(side, ANCHOR)
        first = np.searchsorted(held, own)
        count = np.searchsorted(held, own, side="right") - first
        entry = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        starts = np.unique(place[entry] - np.repeat(np.arange(len(own)), count))
        most, best = 0, covered
        step = max(1, (1 << 20) // len(side))
        for i in range(0, len(starts), step):
            at = starts[i : i + step, None] + np.arange(len(side))[None, :]
            same = np.zeros(at.shape, bool)
            for shift in range(-SHIFT, SHIFT + 1):
                to = at + shift
                same |= (self.hashes[np.clip(to, 0, len(self.hashes) - 1)] == side) & (to >= 0) & (to < len(self.hashes))
            n = same.sum(1)
            if n.max() > most:
                most, best = n.max(), same[n.argmax()]
        return covered | best


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer; of a single sentence, the last third of its words."""
    found = [x for x in re.split(r"(?<=[.!?])\s+|\n+", text) if re.search(r"\w", x)]
    if len(found) > 1:
        return " ".join(found[:-1]), found[-1]
    one = text.split()
    cut = max(1, len(one) - max(1, len(one) // 3)) if len(one) > 1 else len(one)
    return " ".join(one[:cut]), " ".join(one[cut:])


class Index:
    """Postings, block maxima and bounds of a set of test items (item_id, text)."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float):
        self.items, parts, owner, alone = [], [], [], []
        for item_id, text in rows:
            hashes = terms(*_bytes(text or ""))[0]
            if not len(hashes):
                continue
            sides = [terms(*_bytes(x))[0] for x in question_and_answer(text)]
            self.items.append(Item(item_id, *sides))
            for text_hashes in (hashes, *(x for x in sides if LONG <= len(x) < len(hashes))):
                for part in np.array_split(text_hashes, -(-len(text_hashes) // PART)):
                    parts.append(np.unique(part, return_counts=True))
                    owner.append(len(self.items) - 1)
                    alone.append(text_hashes is not hashes)
        self.threshold, self.owner, self.parts = threshold, np.array(owner, np.int64), len(parts)
        term = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
        tf = np.concatenate([p[1] for p in parts]).astype(float) if parts else np.zeros(0)
        part = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts]) if parts else np.zeros(0, np.int64)
        length = np.bincount(part, weights=tf, minlength=len(parts))
        self.terms, self.term = np.unique(term, return_inverse=True)
        # statistics are those of the whole items' parts
        whole = ~np.array(alone, bool)
        df = np.bincount(self.term[whole[part]], minlength=len(self.terms))
        idf = np.log1p((whole.sum() - df + 0.5) / (df + 0.5))
        weight = idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[part] / max(1.0, length[whole].mean() if len(length) else 1.0)))
        self.weight, self.part = weight / np.bincount(part, weights=weight, minlength=len(parts))[part], part
        # by part, for scoring
        self.begin = np.searchsorted(part, np.arange(len(parts) + 1))
        frequent = df[self.term] > max(1, RARE * whole.sum())
        rest = np.bincount(part[frequent], weights=self.weight[frequent], minlength=len(parts))
        self.blocks = -(-len(parts) // BLOCK)
        self.bound = np.maximum.reduceat(rest, np.arange(0, len(parts), BLOCK)) if len(parts) else rest
        # rare terms' postings by block, each with the largest weight there
        key = self.term[~frequent] * max(1, self.blocks) + part[~frequent] // BLOCK
        keys, at = np.unique(key, return_inverse=True)
        largest = np.zeros(len(keys))
        np.maximum.at(largest, at, self.weight[~frequent])
        self.block_of, self.block_max = keys % max(1, self.blocks), largest
        rare_term = keys // max(1, self.blocks)
        self.postings = np.searchsorted(rare_term, np.arange(len(self.terms) + 1))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for words that no item has."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def retrieve(self, found: np.ndarray, passage: np.ndarray, passages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage, part and score of all that reach the threshold; one entry of ``found`` per word and passage."""
        known = found >= 0
        pair = np.unique(passage[known] * max(1, len(self.terms)) + found[known])  # a term counts once a passage
        of, term = pair // max(1, len(self.terms)), pair % max(1, len(self.terms))
        first, count = self.postings[term], self.postings[term + 1] - self.postings[term]
        at = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if len(count) else first
        place = np.repeat(of, count) * max(1, self.blocks) + self.block_of[at]
        places, back = np.unique(place, return_inverse=True)
        reach = np.bincount(back, weights=self.block_max[at], minlength=len(places)) + self.bound[places % max(1, self.blocks)] if len(places) else np.zeros(0)
        good = places[reach >= self.threshold - 1e-9]
        # blocks whose frequent terms alone could reach it
        alone = np.flatnonzero(self.bound >= self.threshold - 1e-9)
        if len(alone):
            good = np.unique(np.concatenate((good, (np.arange(passages)[:, None] * self.blocks + alone[None, :]).ravel())))
        of, block = good // max(1, self.blocks), good % max(1, self.blocks)
        of = np.repeat(of, BLOCK)
        part = (block[:, None] * BLOCK + np.arange(BLOCK)[None, :]).ravel()
        of, part = of[part < self.parts], part[part < self.parts]
        count = self.begin[part + 1] - self.begin[part]
        posting = np.repeat(self.begin[part] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if len(count) else count
        asked = np.repeat(of, count) * max(1, len(self.terms)) + self.term[posting]
        place = np.minimum(np.searchsorted(pair, asked), max(0, len(pair) - 1))
        held = pair[place] == asked if len(pair) else np.zeros(len(asked), bool)
        score = np.bincount(np.repeat(np.arange(len(part)), count), weights=self.weight[posting] * held, minlength=len(part))
        good = score >= self.threshold - 1e-9
        return of[good], part[good], score[good]


def passages(owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers and passages, a row for each word of each passage; and how many passages texts have."""
    counts = np.bincount(owner, minlength=rows)
    many = np.where(counts > 0, np.maximum(1, -(-counts // PART) - 1), 0)
    base = np.concatenate(([0], np.cumsum(many)[:-1]))
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    local = np.arange(len(owner)) - first[owner]
    ahead = local // PART
    word = np.arange(len(owner))
    here, before = ahead < many[owner], ahead > 0
    return np.concatenate((word[here], word[before])), np.concatenate(((base[owner] + ahead)[here], (base[owner] + ahead - 1)[before])), many


def _searched(sent, overlap: float):
    """(row.., text) to n_passages and the verified items of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = sent.value
        for batch in batches:
            n_passages, hits = [], []
            for first, last, data, offsets in pieces(batch.column(batch.num_columns - 1)):
                hashes, owner = terms(data, offsets)
                found = index.find(hashes)
                word, passage, many = passages(owner, last - first)
                ends = np.cumsum(many)
                of, part, score = index.retrieve(found[word], passage, int(ends[-1]))
                text = np.searchsorted(ends, of, side="right")
                best: dict[tuple[int, int], float] = {}
                for t, i, s in zip(text.tolist(), index.owner[part].tolist(), score.tolist(), strict=True):
                    best[t, i] = max(s, best.get((t, i), 0.0))
                rows = [[] for _ in range(last - first)]
                begin = np.searchsorted(owner, np.arange(last - first + 1))
                held: _Text | None = None
                for (t, i), s in sorted(best.items()):
                    if held is None or t != at:
                        held, at = _Text(hashes[begin[t] : begin[t + 1]]), t
                    item = index.items[i]
                    words_of = [held.holds(x) for x in (item.question, item.answer)]
                    share = [float(x.mean()) if len(x) else 1.0 for x in words_of]
                    every = np.concatenate(words_of)
                    leaked = bool(every.mean() >= overlap) if len(every) else True
                    leaked = leaked or any(len(x) >= LONG and y >= overlap for x, y in zip(words_of, share, strict=True))
                    rows[t].append({"item_id": item.item_id, "score": s, "question": share[0], "answer": share[1], "leaked": leaked})
                n_passages += many.tolist()
                hits += rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_passages, pa.int64()), pa.array(hits, _HITS)], [*batch.schema.names, "n_passages", "hits"]
            )

    return run


_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64()), ("leaked", pa.bool_())]))


def search(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.8, text: str = "text", into: str = "leaks") -> DataFrame:
    """``docs`` with the struct ``into``: n_passages, items and leaked.

    ``items`` holds what was retrieved in any passage: item_id, the best score, the shares of the
    question's and of the answer's words that the document holds, and whether it is leaked: if the share
    of all its words, or that of a side of ``LONG`` words or more, is at least ``overlap``. ``leaked``
    tells whether some item is. Items are (item_id, text); null, empty and wordless ones
    are never found, repeated ones are found each. A null or empty text has no passage. Texts are read
    whole. A column named ``into`` is replaced, others pass through; no rows give none. Each index is
    of at most about ``SHARD_CHARS`` characters, with statistics of its own.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    docs = docs.drop(into)
    names = docs.columns
    at = names.index(text)
    cells = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = cells.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-int(chars) // SHARD_CHARS))
    out = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("items", F.expr("cast(array() as array<struct<item_id:long,score:double,question:double,answer:double,leaked:boolean>>)")).withColumn("n", F.lit(0).cast("long"))
    for shard in range(shards):
        rows = cells.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard).orderBy("item_id", "text").collect()
        sent = spark.sparkContext.broadcast(Index([tuple(r) for r in rows], threshold))
        asked = out.withColumn("asked", F.col(f"c{at}"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema) + ", n_passages long, hits array<struct<item_id:long,score:double,question:double,answer:double,leaked:boolean>>"
        out = asked.mapInArrow(_searched(sent, overlap), schema)
        out = out.withColumns({"items": F.concat("items", "hits"), "n": F.col("n_passages")}).drop("asked", "hits", "n_passages")
    leaked = F.exists("items", lambda x: x.leaked)
    result = F.struct(F.col("n").alias("n_passages"), F.col("items"), leaked.alias("leaked"))
    return out.withColumn("result", result).drop("items", "n").toDF(*names, into)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no test item, with their own columns only."""
    return search(docs, items, into="_songframe_leaks").where("not _songframe_leaks.leaked").drop("_songframe_leaks")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op6: the test items found in every document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    out = search(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    return out.select(
        "doc_id", "leaks.n_passages", F.size("leaks.items").cast("long").alias("n_retrieved"), "leaks.leaked",
        F.transform(F.filter("leaks.items", lambda x: x.leaked), lambda x: x.item_id).alias("items"),
        F.array_max(F.transform("leaks.items", lambda x: x.score)).alias("best_score"),
    )
