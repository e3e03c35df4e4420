"""Near-duplicate documents by MinHash with tensored banding.

Two documents are linked when their sets of word shingles have a Jaccard similarity of at least
``percent`` / 100. Two collections of ``halves`` short tuples of minimum hashes are made per document,
and table key (i, j) joins tuple i of the first with tuple j of the second. ``halves**2`` tables so
need ``2 * halves * width`` minimum hashes instead of ``2 * halves**2 * width``. What shares a key is a
candidate; every link is confirmed on the full sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from songframe.llm.batches import mix, pieces, signed, windows, word_hashes, words
from songframe.llm.components import relabel
from songframe.llm.storage import Workspace

_U = np.uint64

#: Pairs per row of all groups up to which all that are left are compared at once; within one group four times as many.
PAIRS_A_ROW = 2
#: So many pairs are few anyway, and not worth a round.
FEW_PAIRS = 1 << 12
#: Up to so many ids of texts to compare go to the tasks that read the texts; with more of them all texts are shuffled.
LISTED_IDS = 1 << 22
#: Bits of the parity maps of sets of up to 512 shingles; they double whenever the size does.
PARITY_BITS = 1 << 10


@dataclass(frozen=True)
class Banding:
    """``words`` in a shingle, least similarity in ``percent``, tuples per collection, hashes per tuple.

    A pair of similarity s meets in some table with probability ``(1 - (1 - s**width)**halves)**2``:
    0.9996 at 0.85 with 9 tuples of 3, 0.9994 at 0.8 with 8 tuples of 2.
    """

    words: int = 5
    percent: int = 80
    halves: int = 8
    width: int = 2


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and the text each belongs to, grouped by text.

    A text of fewer than ``n`` words has its whole sequence as the only shingle, one without words none.
    """
    starts, ends, owner = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    at, keys = windows(hashes, owner, n)
    texts = owner[at]
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    extra_keys, extra_texts = [], []
    for size in range(1, n):
        few = np.flatnonzero(counts == size)
        if len(few):
            own = np.isin(owner, few)
            inner_at, inner = windows(hashes[own], owner[own], size)
            extra_keys.append(mix(inner + _U(size)))
            extra_texts.append(owner[own][inner_at])
    if extra_keys:
        keys, texts = np.concatenate([keys, *extra_keys]), np.concatenate([texts, *extra_texts])
    order = np.lexsort((keys, texts))
    keys, texts = keys[order], texts[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])
    return keys[fresh], texts[fresh]


def _constants(n: int) -> np.ndarray:
    return np.random.default_rng(2024).integers(1, 1 << 64, n, dtype=np.uint64) | _U(1)


def _nodes(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text a hash of its whole set; the texts that have one, and where their shingles begin."""
    some = np.flatnonzero(counts)
    begin = np.concatenate(([0], np.cumsum(counts[some])[:-1])).astype(np.int64)
    node = np.zeros(len(counts), np.uint64)
    if len(some):
        node[some] = mix(np.add.reduceat(mix(keys + _U(0x51ED270B)), begin) + counts[some].astype(np.uint64))
    return node, some, begin


def _parities(keys: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Per text a bit map in 64-bit words: whether an odd number of its shingles falls on the bit.

    Two maps of one length differ in at most as many bits as there are shingles in only one of the sets.
    """
    doubled = np.ceil(np.log2(np.maximum(counts, 1) / (PARITY_BITS / 2))).clip(0).astype(np.int64)
    size = np.where(counts > 0, PARITY_BITS << doubled, 0)
    begin = np.concatenate(([0], np.cumsum(size)))
    falls = mix(keys ^ _U(0x7A5C93E1)) % np.repeat(size, counts).astype(np.uint64)
    odd = np.zeros(begin[-1], np.uint8)
    np.bitwise_xor.at(odd, np.repeat(begin[:-1], counts) + falls.astype(np.int64), 1)
    return pa.ListArray.from_arrays(pa.array((begin // 64).astype(np.int32)), pa.array(np.packbits(odd).view(np.int64)))


def _signatures(banding: Banding):
    """Arrow batches (doc_id, text) to (doc_id, n, node, halves, parity)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        constants = _constants(2 * banding.halves * banding.width)
        for batch in batches:
            for first, last, data, offsets in pieces(batch.column(1)):
                keys, texts = shingles(data, offsets, banding.words)
                counts = np.bincount(texts, minlength=last - first)
                node, some, begin = _nodes(keys, counts)
                half = np.zeros((last - first, 2 * banding.halves), np.uint64)
                for i in range(2 * banding.halves if len(some) else 0):
                    made = np.full(len(some), i + 1, np.uint64)
                    for j in range(banding.width):
                        made = mix(made + np.minimum.reduceat(mix(keys ^ constants[i * banding.width + j]), begin))
                    half[some, i] = made
                halves = pa.FixedSizeListArray.from_arrays(pa.array(signed(half.ravel())), 2 * banding.halves)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(counts, pa.int64()),
                        pa.array(signed(node), mask=counts == 0),
                        halves.cast(pa.list_(pa.int64())),
                        _parities(keys, counts),
                    ],
                    ["doc_id", "n", "node", "halves", "parity"],
                )

    return run


def _texts(n: int):
    """Arrow batches (text) to (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in pieces(batch.column(0)):
                keys, texts = shingles(data, offsets, n)
                node, _, _ = _nodes(keys, np.bincount(texts, minlength=last - first))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(node)), batch.column(0).slice(first, last - first)], ["node", "text"]
                )

    return run


def _confirmed(banding: Banding):
    """Arrow batches (a, b, text of a, text of b) to the pairs (a, b) similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                sides = []
                for column in (2, 3):
                    data, offsets = next((d, o) for _, _, d, o in pieces(part.column(column), 1 << 62))
                    keys, texts = shingles(data, offsets, banding.words)
                    sides.append((mix(keys ^ mix(texts.astype(np.uint64))), np.bincount(texts, minlength=part.num_rows), texts))
                (ka, na, ta), (kb, nb, _) = sides
                _, at, _ = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                both = np.bincount(ta[at], minlength=part.num_rows)
                good = 100 * both >= banding.percent * (na + nb - both)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(good))

    return run


def _bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def components(docs: DataFrame, banding: Banding, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links, the document's own included, and
    ``kept`` tells whether it is the document's own. Texts with equal sets, exact copies among them,
    form one node from the start, so groups of copies cost as much as one document. A null or empty
    text, or one without words, has no shingles and is linked with nothing. Rows with the same id
    stay separate rows; nulls among ids count as larger than any id. Other columns don't matter.
    No rows give none.
    """
    spark = docs.sparkSession
    _bounded_batches(spark)
    space = Workspace(spark)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = space.keep(
        source.mapInArrow(_signatures(banding), "doc_id long, n long, node long, halves array<long>, parity array<long>"), "signatures"
    )
    nodes = space.keep(
        rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.first(x).alias(x) for x in ("n", "halves", "parity")]),
        "nodes",
    )
    h = banding.halves
    keys = F.flatten(
        F.transform(F.slice("halves", 1, h), lambda x: F.transform(F.slice("halves", h + 1, h), lambda y: F.xxhash64(x, y)))
    )
    tables = nodes.select("node", "n", F.posexplode(keys).alias("no", "key"))
    # counted where the rows lie, so that they are shuffled once and need not be joined
    shared = tables.withColumn("c", F.count("*").over(Window.partitionBy("key"))).where("c > 1")
    live = space.keep(shared.select("key", "node", "n", "no"), "shared")
    labels = space.keep(live.select("node").distinct().withColumn("comp", F.col("node")), "labels")
    known = F.coalesce("doc_id", F.lit(0))  # a few texts too many do no harm
    wanted = space.keep(labels.select("node").join(nodes, "node").select(known.alias("wanted_id")).distinct(), "wanted")
    listed = F.broadcast(wanted) if wanted.count() <= LISTED_IDS else wanted
    texts = (
        source.join(listed, known == F.col("wanted_id"), "left_semi").select("text").mapInArrow(_texts(banding.words), "node long, text string")
        .join(labels.select("node"), "node", "left_semi").dropDuplicates(["node"])
    )
    texts = space.keep(texts, "texts")
    sets = space.keep(nodes.join(labels.select("node"), "node").select("node", "halves", "parity"), "sets")
    labels = _linked(live, labels, texts, sets, banding, space)
    least = labels.join(nodes.select("node", "doc_id"), "node").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    found = space.keep(labels.join(least, "comp").select("node", "component_id"), "found")
    own = nodes.select("node", F.col("doc_id").alias("own")).join(found, "node", "left")
    own = own.select("node", F.coalesce("component_id", "own").alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "node").join(own, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _met_here(banding: Banding) -> str:
    """Whether table ``no`` is the first in which the nodes with halves ha and hb meet."""
    h = banding.halves
    first = lambda at: f"array_position(zip_with(slice(ha, {at}, {h}), slice(hb, {at}, {h}), (x, y) -> x = y), true) - 1"
    return f"no = {h} * ({first(1)}) + {first(h + 1)}"


def _within_parity(banding: Banding) -> str:
    """Whether the parity maps pa and pb leave it open that the sets of n and nb shingles are similar enough.

    Sets of similarity s have (n + nb) * (1 - s) / (1 + s) shingles in only one of them at most, and
    their maps differ in no more bits, so no link is lost. Maps of different lengths leave it open.
    """
    differ = "aggregate(zip_with(pa, pb, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    return f"size(pa) <> size(pb) or {differ} * {100 + banding.percent} <= (n + nb) * {100 - banding.percent}"


def _linked(live: DataFrame, labels: DataFrame, texts: DataFrame, sets: DataFrame, banding: Banding, space: Workspace) -> DataFrame:
    """Labels after all links between nodes that share a key.

    In each round a group of nodes that share a key is finished if the pairs of different components in it
    are in proportion to its rows: they are held against each other in the join of the group. What that
    gives out is each pair once, and only where the parity maps of its sets don't rule it out; in a group of
    texts that are alike but not similar enough that is next to none. Each other group names one head, the
    member that met most nodes in all its groups at the start; in a group of edited copies that is what they
    are copies of. Each node is compared with the head it shares most keys with, where the two are still
    apart. Finished groups and those that have become one component take no part in later rounds. After a
    round whose heads linked next to nothing all groups left are finished. No pair that could join two
    components stays uncompared: it is given out by the group of the first key it shares.
    """
    tested: DataFrame | None = None
    barren = False
    start = live.count()
    met = live.groupBy("key").agg(F.count("*").alias("c"))
    met = space.keep(live.join(met, "key").groupBy("node").agg(F.sum("c").alias("met")), "met")
    while True:
        marks = labels.join(met, "node").withColumn("old", F.lit(None).cast("boolean"))
        if tested is not None:
            marks = marks.drop("old").join(tested.select(F.col("a").alias("node")).distinct().withColumn("old", F.lit(True)), "node", "left")
        live = space.keep(live.select("key", "no", "node", "n").join(marks, "node"), "marked")
        parts = live.groupBy("key", "comp").agg(F.count("*").alias("own"))
        groups = parts.groupBy("key").agg(F.sum("own").alias("c"), F.sum(F.col("own") * F.col("own")).alias("inner"), F.count("*").alias("parts"))
        groups = groups.where("parts > 1").withColumn("apart", F.expr("(c * c - inner) / 2"))
        groups = space.keep(groups.select("key", "apart", F.expr(f"{str(barren).lower()} or apart <= {4 * PAIRS_A_ROW} * c").alias("ends")), "groups")
        size, apart = groups.where("not ends").agg(F.count("*"), F.coalesce(F.sum("apart"), F.lit(0.0))).first()
        if not size and groups.isEmpty():
            return labels
        last = apart <= max(FEW_PAIRS, PAIRS_A_ROW * start)  # so few are finished with the others
        groups = groups.select("key", F.lit(True).alias("ends")) if last else groups.select("key", "ends")
        live = space.keep(live.join(groups, "key"), "live")

        full = space.keep(live.where("ends").drop("ends").join(sets, "node"), "full")
        one = full.select("key", "no", F.col("node").alias("a"), "n", "comp", F.col("halves").alias("ha"), F.col("parity").alias("pa"))
        other = full.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("halves").alias("hb"), F.col("parity").alias("pb"))
        alike = F.expr(f"100 * least(n, nb) >= {banding.percent} * greatest(n, nb)")
        pairs = one.join(other, "key").where("a < b and comp <> cb").where(alike).where(_met_here(banding)).where(_within_parity(banding)).select("a", "b", F.lit(False).alias("by_head"))
        if tested is not None:
            pairs = _untested(pairs, tested)
        if not last:
            live = live.where("not ends").drop("ends")
            best = F.max(F.struct("met", F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca")))
            heads = live.where("old is null").groupBy("key").agg(best.alias("h")).select("key", "h.a", "h.na", "h.ca")
            near = live.join(heads, "key").where("comp <> ca").select("a", F.col("node").alias("b"), F.col("na").alias("n"), F.col("n").alias("nb")).where(alike)
            near = near.groupBy("a", "b").agg(F.count("*").alias("c"))
            near = near if tested is None else _untested(near, tested)
            near = near.groupBy("b").agg(F.max(F.struct("c", "a")).alias("m"))  # a node's most promising head of this round
            pairs = pairs.union(near.select("m.a", "b", F.lit(True)))
        pairs = space.keep(pairs, "pairs")
        both = pairs.select("a", "b").distinct().join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        both = both.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        links = space.keep(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(banding), "a long, b long"), "links")
        labels = relabel(labels, links, space)
        if last:
            return labels
        tested = pairs.select("a", "b") if tested is None else tested.union(pairs.select("a", "b"))
        tried = pairs.where("by_head")
        barren = 20 * links.join(tried, ["a", "b"], "left_semi").count() <= tried.count()  # also after a round without pairs


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    """The ``pairs`` that were not compared before, either way round."""
    back = tested.select(F.col("a").alias("b"), F.col("b").alias("a"))
    return pairs.join(tested.union(back.select("a", "b")).distinct(), ["a", "b"], "left_anti").select(*pairs.columns)


#: op1: three words, similarity 0.85.
PRODUCTION = Banding(words=3, percent=85, halves=9, width=3)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op1: component of near-duplicates of every document."""
    return components(spark.read.parquet(f"{folder}/documents.parquet"), PRODUCTION)


def keep_one(docs: DataFrame, banding: Banding | None = None) -> DataFrame:
    """The document with the smallest id of each group, with its own columns.

    Rows that share an id are one document and stay or go together; so do all rows without an id.
    """
    kept = components(docs, banding or Banding()).where("kept").select("doc_id").distinct()
    return docs.join(kept.withColumnRenamed("doc_id", "_songframe_id"), F.expr("doc_id <=> _songframe_id"), "left_semi")
