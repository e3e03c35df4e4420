"""Substring dedup on a compacted de Bruijn graph of word k-mers.

Each window of ``window`` words chooses its k-mers of least hash as vertices, by content alone, so
copies choose alike. An edge is what lies between two neighbouring vertices of a document. A vertex at
which every occurrence in the corpus comes by one edge and leaves by one edge does not branch; Spark
joins double pointers along such edges until each path has one name. Every document on a path holds
its whole text, so one comparison of the path's words, taken at the source coordinates, settles all
windows inside. Windows that reach over a path's end, or whose least k-mer is at a branch, are
compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.llm.batches import SECOND, VALUES, mix, piece_hash, pieces, powers, signed, sliding_min, word_hashes, words
from songframe.llm.storage import Workspace

#: Words in a k-mer; a window of 50 words holds 31 of them, so about every 16th becomes a vertex.
K = 20
WINDOW = 50
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _prefix(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes) + 1)[0][: len(hashes)], out=out[1:], dtype=np.uint64)
    return out


class _Text:
    """Words of some texts, their k-mers and which windows and vertices they have."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, k: int, window: int):
        self.rows = len(offsets) - 1
        self.starts, self.ends, self.owner = words(data, offsets)
        self.data = data
        self.counts = np.bincount(self.owner, minlength=self.rows)
        self.first = np.concatenate(([0], np.cumsum(self.counts)[:-1])).astype(np.int64)
        self.hashes = word_hashes(data, self.starts, self.ends, VALUES)
        self.prefix = _prefix(self.hashes)
        n = len(self.owner)
        self.windows = np.zeros(0, np.int64)
        self.least = np.zeros(0, np.uint64)
        self.kmers = np.zeros(0, np.uint64)
        if n >= window:
            at = np.arange(n - k + 1)
            self.kmers = mix(piece_hash(self.prefix, at, at + k))
            least = sliding_min(self.kmers, window - k + 1)
            self.windows = np.flatnonzero(self.owner[: n - window + 1] == self.owner[window - 1 :])
            self.least = least[self.windows]

    def vertices(self, k: int, window: int) -> np.ndarray:
        """Word positions of the chosen k-mers."""
        span = window - k + 1
        if not len(self.windows):
            return np.zeros(0, np.int64)
        # minima are compared upside down, with the largest value where no window starts
        upside = np.full(len(self.kmers) + span - 1, _LAST)
        upside[self.windows + span - 1] = ~self.least
        best = sliding_min(upside, span)
        return np.flatnonzero((best != _LAST) & (self.kmers == ~best))


def _vertices(k: int, window: int):
    """(doc, text hash, text) to one row per vertex: position, its neighbours' positions, edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in pieces(batch.column(2)):
                text = _Text(data, offsets, k, window)
                at = text.vertices(k, window)
                own = text.owner[at]
                local = at - text.first[own]
                joined = own[1:] == own[:-1] if len(at) else np.zeros(0, bool)
                edges = np.zeros(len(at) + 1, np.uint64)  # edge i comes into vertex i
                if len(at):
                    edges[1:-1] = np.where(joined, mix(piece_hash(text.prefix, at[:-1], at[1:] + k)) | np.uint64(1), 0)
                before, after = np.full(len(at), -1), np.full(len(at), -1)
                if len(at):
                    before[1:] = np.where(joined, local[:-1], -1)
                    after[:-1] = np.where(joined, local[1:], -1)
                rows = pa.array(first + own)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows), batch.column(1).take(rows), pa.array(signed(text.kmers[at]) if len(at) else [], pa.int64()),
                        pa.array(local, pa.int32()), pa.array(before, pa.int32()), pa.array(after, pa.int32()),
                        pa.array(signed(edges[:-1]), pa.int64()), pa.array(signed(edges[1:]), pa.int64()),
                    ],
                    ["doc", "th", "v", "q", "before", "after", "e_in", "e_out"],
                )

    return run


def _open(k: int, window: int):
    """(doc, th, text, vertices) to what has to be compared: path spans (u set) and single windows."""
    span = window - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(3)
            for first, last, data, offsets in pieces(batch.column(2)):
                text = _Text(data, offsets, k, window)
                second = _prefix(word_hashes(data, text.starts, text.ends, SECOND))
                part = listed.slice(first, last - first)
                held = part.flatten()
                field = lambda name: held.field(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                own = np.repeat(np.arange(last - first), part.value_lengths().to_numpy(zero_copy_only=False))
                q, v, inner = field("q") + text.first[own], field("v").view(np.uint64), field("inner")
                # windows whose least k-mer occurs in several documents
                wanted = np.isin(mix(text.least ^ mix(text.owner[text.windows].astype(np.uint64))), mix(v ^ mix(own.astype(np.uint64))))
                # runs of inner vertices: the path reaches from the vertex before to the one after
                q, own, unitig = q[inner], own[inner], field("u")[inner]
                before, after = field("before")[inner] + text.first[own], field("after")[inner] + text.first[own]
                fresh = np.ones(len(q), bool)
                fresh[1:] = (before[1:] != q[:-1]) | (own[1:] != own[:-1])
                run_of = np.cumsum(fresh) - 1
                heads = np.flatnonzero(fresh)
                tails = np.append(heads[1:], len(q)) - 1 if len(q) else heads
                start, stop = before[heads], after[tails] + k
                # a window is settled if its own least k-mer is such a vertex and the path holds it all
                least = np.zeros(len(text.owner) + 1, np.uint64)
                held_window = np.zeros(len(text.owner) + 1, bool)
                least[text.windows], held_window[text.windows] = text.least, True
                places = (q[:, None] - np.arange(span)[None, :]).ravel()
                vertex = np.repeat(np.arange(len(q)), span)
                fits = (places >= start[run_of[vertex]]) & (places + window <= stop[run_of[vertex]])
                places, vertex = places[fits], vertex[fits]
                fits = held_window[places] & (least[places] == text.kmers[q[vertex]] if len(places) else False)
                places, vertex = places[fits], vertex[fits]
                settled = np.zeros(len(text.owner) + 1, bool)
                settled[places] = True
                alone = text.windows[wanted & ~settled[text.windows]]
                begin, end = np.full(len(heads), 1 << 62), np.full(len(heads), -1)
                np.minimum.at(begin, run_of[vertex], places)
                np.maximum.at(end, run_of[vertex], places + window)
                good = end > 0
                begin, end, run_owner, run_name = begin[good], end[good], own[heads][good], unitig[heads][good]
                starts = np.concatenate((begin, alone)).astype(np.int64)
                ends = np.concatenate((end, alone + window)).astype(np.int64)
                texts = np.concatenate((run_owner, text.owner[alone])).astype(np.int64)
                names = np.concatenate((run_name, np.zeros(len(alone), np.int64))).astype(np.int64)
                rows = pa.array(first + texts)
                local = text.first[texts] if len(texts) else texts
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows), batch.column(1).take(rows), pa.array(names),
                        pa.array(signed(mix(piece_hash(text.prefix, starts, ends)))), pa.array(signed(mix(piece_hash(second, starts, ends)))),
                        pa.array(starts - local, pa.int32()), pa.array(ends - local, pa.int32()),
                    ],
                    ["doc", "th", "u", "h1", "h2", "start", "end"],
                )

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row columns.., text, spans) to the words left, joined by one space."""
    for batch in batches:
        made = []
        for first, last, data, offsets in pieces(batch.column(1)):
            starts, ends, owner = words(data, offsets)
            counts = np.bincount(owner, minlength=last - first)
            base = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
            part = batch.column(2).slice(first, last - first).fill_null([])
            held = part.flatten()
            own = np.repeat(np.arange(last - first), part.value_lengths().to_numpy(zero_copy_only=False))
            change = np.zeros(len(owner) + 1, np.int64)
            np.add.at(change, held.field("start").to_numpy(zero_copy_only=False) + base[own], 1)
            np.add.at(change, held.field("end").to_numpy(zero_copy_only=False) + base[own], -1)
            keep = np.cumsum(change)[:-1] == 0
            removed = np.bincount(owner[~keep], minlength=last - first)
            # a word is followed by a space unless it is the last one kept of its text
            at, texts = np.flatnonzero(keep), owner[keep]
            lengths = ends[at] - starts[at]
            final = np.ones(len(at), bool)
            final[:-1] = texts[1:] != texts[:-1]
            width = lengths + ~final
            to = np.concatenate(([0], np.cumsum(width)))
            out = np.full(to[-1], 0x20, np.uint8)
            source = np.repeat(starts[at] - to[:-1], lengths) if len(at) else np.zeros(0, np.int64)
            mask = np.ones(to[-1], bool)
            mask[(to[1:] - 1)[~final]] = False
            where = np.flatnonzero(mask)
            out[where] = data[where + source]
            cuts = np.concatenate(([0], np.cumsum(np.bincount(texts, weights=width, minlength=last - first)))).astype(np.int32)
            texts_out = pa.StringArray.from_buffers(last - first, pa.py_buffer(cuts), pa.py_buffer(out.tobytes()))
            made.append(
                pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), texts_out],
                    ["doc", "n_words", "n_removed", "kept"],
                )
            )
        yield from made


def compacted(vertices: DataFrame, space: Workspace) -> DataFrame:
    """Vertices that occur in several documents: v, inner, u (the path's name where inner)."""
    several = vertices.groupBy("v").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("v")
    shared = vertices.join(several, "v")
    shared = space.keep(shared, "shared")
    edge = lambda name: [F.min(name).alias(f"{name}_a"), F.max(name).alias(f"{name}_b")]
    nodes = shared.groupBy("v").agg(*edge("e_in"), *edge("e_out"))
    inner = (F.col("e_in_a") == F.col("e_in_b")) & (F.col("e_out_a") == F.col("e_out_b")) & (F.col("e_in_a") != 0) & (F.col("e_out_a") != 0)
    nodes = space.keep(nodes.select("v", inner.alias("inner"), F.col("e_in_a").alias("e_in"), F.col("e_out_a").alias("e_out")), "nodes")
    # back[e] is an edge further back on e's path; each round doubles the way
    back = space.keep(nodes.where("inner").select(F.col("e_out").alias("e"), F.col("e_in").alias("to")), "back")
    while True:
        step = back.select(F.col("e").alias("to"), F.col("to").alias("further"))
        back = space.keep(back.join(step, "to", "left").select("e", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "back")
        if not back.where("moved").limit(1).count():
            break
        back = back.select("e", "to")
    heads = back.select(F.col("e").alias("e_in"), F.col("to").alias("head"))
    named = nodes.join(heads, "e_in", "left").select("v", "inner", F.when(F.col("inner"), F.coalesce("head", "e_in")).alias("u"))
    return shared.join(named, "v").select("doc", "th", "v", "q", "before", "after", "inner", F.coalesce("u", F.lit(0).cast("long")).alias("u"))


def repeated(source: DataFrame, space: Workspace, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc, th, start, end: word spans made of windows that also start in a document with a smaller id.

    ``source`` has doc, th and text; th tells rows of one id with different texts apart.
    """
    vertices = source.mapInArrow(_vertices(k, window), "doc long, th long, v long, q int, before int, after int, e_in long, e_out long")
    graph = compacted(vertices, space)
    entry = F.struct("q", "before", "after", "v", "inner", "u")
    lists = graph.groupBy("doc", "th").agg(F.array_distinct(F.sort_array(F.collect_list(entry))).alias("vertices"))
    ready = source.join(lists, ["doc", "th"]).select("doc", "th", "text", "vertices")
    spans = space.keep(ready.mapInArrow(_open(k, window), "doc long, th long, u long, h1 long, h2 long, start int, end int"), "spans")
    firsts = spans.groupBy("u", "h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    return spans.join(firsts.select("u", "h1", "h2", "least"), ["u", "h1", "h2"]).where("least < doc").select("doc", "th", "start", "end")


def dedup(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words of each document that no earlier one repeats.

    Every word is removed that is covered by a run of ``window`` words which also starts in a document
    with a smaller doc_id. Runs are judged on the input. ``kept`` has the words left, joined by one
    space. Null and blank texts have no words and an empty ``kept``. Rows that share an id don't
    remove each other; a null id counts as the largest. Other columns are ignored, no rows give none.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    space = Workspace(spark)
    largest = F.lit((1 << 63) - 1)
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), largest).alias("doc"), F.xxhash64("text").alias("th"), "text")
    found = repeated(source, space, k, window)
    lists = space.keep(found.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "removed")
    out = source.join(lists, ["doc", "th"], "left").select("doc", "text", "spans")
    out = out.mapInArrow(_kept, "doc long, n_words long, n_removed long, kept string")
    return out.select(F.nullif("doc", largest).alias("doc_id"), "n_words", "n_removed", "kept")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op8: how many words of every document stay, and a digest of them."""
    out = dedup(spark.read.parquet(f"{folder}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
