"""Language-model scores from word classes learned by exchange clustering.

Words are counted over all training documents. Every one of them gets a class by the exchange
algorithm: in rounds over all words, each moves to the class that raises the likelihood of the class
bigrams most, until few move. A token's probability is that of its class after the class before, times
that of the word in its class, both smoothed; words that training never saw have a class of their own.

Words are known by 64-bit hashes. What is sent to every task is bounded: the ``LISTED`` most frequent
words with their counts and classes, and the table of class pairs. These words are exchanged first, and
see all others as one class. Then every other word is exchanged, with counts and classes in a table that
is joined. The number of classes grows with the cube root of the number of words, so the class table
stays smaller than the vocabulary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.llm.batches import mix, pieces, signed, word_hashes, words
from songframe.llm.storage import Workspace

#: At most so many words, the most frequent ones, are sent to every task; the others are joined.
LISTED = 1 << 19
#: Least number of classes; more from the cube of it on.
CLASSES = 48
#: Listed words are split in this many parts, others in one, and a round moves the words of one; in more, once moves made
#: side by side lower the likelihood. The rounds end where ``MOST_PARTS`` still lower it.
PARTS, MOST_PARTS = 2, 64
#: A round is quiet if fewer than this share of its words move, or the likelihood grows by less than
#: this share of what it grew in all rounds. The rounds end when each part in turn was quiet.
FEW = 0.01
#: A task brings its table up to date after moves of words with this share of all tokens.
STALE = 1 / 1_000
#: Neighbours of listed words in a packed row.
BLOCK = 1 << 18
#: Counts up to which differences of c * log c are tabled.
SMALL = 32
#: Tokens that smoothing adds to each class transition's count.
ADDED = 0.1

END = np.uint64(0x5EED0FE4D0C5)  # the hash that stands for the end of a text
RARE, BORDER = 0, 1  # classes of words that training never saw, and of a text's end


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text followed by its end, and the texts they belong to."""
    starts, ends, owner = words(data, offsets)
    rows = len(offsets) - 1
    texts = np.concatenate((owner, np.arange(rows)))
    order = np.argsort(texts, kind="stable")
    return np.concatenate((word_hashes(data, starts, ends), np.full(rows, END)))[order], texts[order]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (word, c), summed over some megabytes at a time."""
    held, size = [], 0

    def flush():
        values, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(n, pa.int64())], ["word", "c"])

    for batch in batches:
        for _, _, data, offsets in pieces(batch.column(0)):
            held.append(_tokens(data, offsets)[0])
            size += len(held[-1])
            if size > 1 << 21:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


class _Listed:
    """Codes of words: a listed word's rank, the number of listed words for a text's end, and for all
    other words a negative number made of the hash."""

    def __init__(self, hashes: np.ndarray, ranks: np.ndarray):
        self.hashes, self.ranks = hashes, ranks

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        other = signed(hashes | np.uint64(1 << 63))
        if len(self.hashes):
            each, where = np.unique(hashes, return_inverse=True)  # in order, so that the search stays near
            at = np.minimum(np.searchsorted(self.hashes, each), len(self.hashes) - 1)
            found = np.where(self.hashes[at] == each, self.ranks[at], -1)[where]
            other = np.where(found >= 0, found, other)
        return np.where(hashes == END, len(self.hashes), other)


def _summed(keys: list[np.ndarray], c: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows of two key columns put together, their counts added."""
    with np.errstate(over="ignore"):
        order = np.argsort(mix(keys[0].view(np.uint64)) + keys[1].astype(np.int64).view(np.uint64), kind="stable")
    keys, c = [k[order] for k in keys], c[order]
    fresh = np.ones(len(c), bool)
    fresh[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
    at = np.flatnonzero(fresh)
    return [k[at] for k in keys], np.add.reduceat(c, at) if len(c) else c


def _before(codes: np.ndarray, end: int) -> np.ndarray:
    """The code before each token; an end stands before the next text."""
    return np.concatenate(([end], codes[:-1]))


def _pairs(sent):
    """Texts to counts (a, b, c) of neighbours' codes, ends among them, where one or both are unlisted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed: _Listed = sent.value
        held, size = [], 0

        def flush():
            codes = np.concatenate(held)
            before = _before(codes, len(listed.hashes))
            rest = np.flatnonzero((codes < 0) | (before < 0))
            keys, c = _summed([before[rest], codes[rest]], np.ones(len(rest), np.int64))
            return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(c)], ["a", "b", "c"])

        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                held.append(listed.codes(_tokens(data, offsets)[0]))
                size += len(held[-1])
                if size > 1 << 21:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).fill_null(0).to_numpy(zero_copy_only=False)


def _packed(*arrays: np.ndarray) -> list[bytes]:
    return [x.astype(np.int32).tobytes() for x in arrays]


def _unpacked(batch: pa.RecordBatch, *names: str) -> Iterator[list[np.ndarray]]:
    columns = [batch.column(batch.schema.get_field_index(x)) for x in names]
    for row in range(batch.num_rows):
        yield [np.frombuffer(x[row].as_buffer(), np.int32) for x in columns]


def _added(keys: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys put together in order, their counts added."""
    order = np.argsort(keys)
    keys, c = keys[order], c[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(c, at) if len(c) else c


def _dealt(sent, buckets: int):
    """Texts to the neighbours of listed words, many in a row: (bucket, w, x, c), packed.

    ``x`` is the code of what follows ``w``, or that of what precedes it plus the number of codes. Behind
    the listed words' codes come those of a text's end and of all unlisted words together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed: _Listed = sent.value
        end = len(listed.hashes)
        span, held, size = end + 2, [], 0

        def flush():
            codes = np.concatenate(held)
            codes = np.where(codes < 0, end + 1, codes)
            before = _before(codes, end)
            follows, precedes = (before < end) | ((before == end) & (codes == end)), codes < end
            w = np.concatenate((before[follows], codes[precedes]))
            x = np.concatenate((codes[follows], before[precedes] + span))
            keys, c = _added(((mix(w.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64) * span + w) * (2 * span) + x, np.ones(len(w), np.int64))
            edges = np.searchsorted(keys, np.arange(buckets + 1) * (2 * span * span))
            some = np.flatnonzero(np.diff(edges))
            w, x = keys // (2 * span) % span, keys % (2 * span)
            rows = [[np.ascontiguousarray(y[edges[i] : edges[i + 1]], np.int32).tobytes() for i in some] for y in (w, x, c)]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(y, pa.binary()) for y in rows)], ["bucket", "w", "x", "c"])

        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                held.append(listed.codes(_tokens(data, offsets)[0]))
                size += len(held[-1])
                if size > 1 << 21:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _blocks(span: int):
    """Rows of ``_dealt`` to blocks (w, n, x, c), packed: words in order, each with all its ``n`` neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most = [], 0, 1 << 22
        for batch in batches:
            for w, x, c in _unpacked(batch, "w", "x", "c"):
                held.append((w.astype(np.int64) * (2 * span) + x, c.astype(np.int64)))
                size += len(w)
                if size > most:
                    held = [_added(*(np.concatenate(y) for y in zip(*held, strict=True)))]
                    size = len(held[0][0])
                    most = max(most, 2 * size)
        if not size:
            return
        keys, c = _added(*(np.concatenate(y) for y in zip(*held, strict=True)))
        w, x = keys // (2 * span), keys % (2 * span)
        begin = np.append(np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1]))), len(w))
        i = 0
        while i < len(begin) - 1:
            j = max(i + 1, int(np.searchsorted(begin, begin[i] + BLOCK, side="right")) - 1)
            part = slice(begin[i], begin[j])
            row = _packed(w[begin[i:j]], np.diff(begin[i : j + 1]), x[part], c[part])
            yield pa.RecordBatch.from_arrays([pa.array([y], pa.binary()) for y in row], ["w", "n", "x", "c"])
            i = j

    return run


def _cell_rows(total: np.ndarray, classes: int) -> list[pa.Array]:
    at = np.flatnonzero(total)
    return [pa.array(at // classes), pa.array(at % classes), pa.array(total[at].astype(np.int64))]


def _block_cells(sent, classes: int):
    """Blocks to counts of class pairs (first, then, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = sent.value, np.zeros(classes * classes)
        span = len(own)
        for batch in batches:
            for w, n, x, c in _unpacked(batch, "w", "n", "x", "c"):
                mine = np.repeat(own[w], n)
                # what precedes a word is met there, but for ends and unlisted words
                follows, precedes = np.flatnonzero(x < span), np.flatnonzero(x >= 2 * span - 2)
                total += np.bincount(mine[follows] * classes + own[x[follows]], weights=c[follows], minlength=len(total))
                total += np.bincount(own[x[precedes] - span] * classes + mine[precedes], weights=c[precedes], minlength=len(total))
        yield pa.RecordBatch.from_arrays(_cell_rows(total, classes), ["first", "then", "c"])

    return run


def _block_moves(sent, part: int, parts: int):
    """Blocks to the listed words of one part that move and their new classes (w, k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own = sent.value
        known, classes, end = _Table(table), len(table), len(own) - 2
        class_of = np.concatenate((own, own + classes))
        for batch in batches:
            for w, n, x, c in _unpacked(batch, "w", "n", "x", "c"):
                turn = (mix(w.astype(np.uint64)) >> np.uint64(32)) % np.uint64(parts) == part
                turn &= w < end
                of, w = np.repeat(turn, n), w[turn]
                if len(w):
                    keys = np.repeat(np.arange(len(w)), n[turn]) * (2 * classes) + class_of[x[of]]
                    keys, c = _added(keys, c[of].astype(np.int64))
                    chosen = known.moved(keys // (2 * classes), keys % (2 * classes), c, own[w])
                    goes = chosen >= 0
                    yield pa.RecordBatch.from_arrays([pa.array(w[goes], pa.int32()), pa.array(chosen[goes], pa.int32())], ["w", "k"])

    return run


def _sided(sent, classes: int):
    """Pairs (a, b, c) of an unlisted word and another to (w, at, c): ``w`` is the unlisted one, ``at`` the
    other's class, plus the number of classes where the other comes before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            a, b, c = (_numbers(batch, x) for x in ("a", "b", "c"))
            first = a < 0
            (w, at), c = _summed([np.where(first, a, b), np.where(first, own[np.maximum(b, 0)], own[np.maximum(a, 0)] + classes)], c)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(at, pa.int32()), pa.array(c)], ["w", "at", "c"])

    return run


def _xlogx(x):
    return x * np.log(np.maximum(x, 1.0))


class _Table:
    """Class pairs as one task knows them, with differences of c * log c for small counts."""

    def __init__(self, table: np.ndarray):
        self.table, self.total = table.copy(), table.sum()
        self.renew()

    def renew(self) -> None:
        self.sides = np.stack((np.ascontiguousarray(self.table.T), self.table))  # [side, neighbour's class, word's class]
        self.alone, self.changed = self.table.sum(1), 0.0
        n = np.arange(1, SMALL + 1)[None, :, None, None]
        self.before = _xlogx(self.sides)
        self.rise = (_xlogx(self.sides[:, None] + n) - self.before[:, None]).astype(np.float32)

    def moved(self, word: np.ndarray, at: np.ndarray, c: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The class each word moves to, or -1, from sorted entries (word, at, c); words are numbered from 0,
        ``own`` are their classes, and ``at`` those of what follows them and, plus the number of classes, precedes."""
        classes = len(self.table)
        begin = np.searchsorted(word, np.arange(len(own) + 1))
        tokens = np.bincount(word, weights=c * (at < classes), minlength=len(own)).cumsum()
        most = max(1, (1 << 22) // classes)  # entries at once
        i, chosen = 0, []
        while i < len(own):
            so_far = tokens[i - 1] if i else 0
            j = min(np.searchsorted(tokens, so_far + STALE * self.total, side="right"), np.searchsorted(begin, begin[i] + most) - 1)
            j = min(max(i + 1, int(j)), len(own))
            part = slice(begin[i], begin[j])
            chosen.append(self.best(at[part], c[part], begin[i:j] - begin[i], own[i:j].astype(np.int64)))
            i = j
        return np.concatenate(chosen)

    def best(self, at: np.ndarray, c: np.ndarray, begin: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The class each word of sorted (word, at, c) moves to; entries of a word from ``begin`` on."""
        classes = len(self.table)
        side, k = at // classes, at % classes
        word = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(at))))
        tokens = np.bincount(word, weights=c * (side == 0), minlength=len(begin))
        rise = np.empty((len(at), classes), np.float32)
        small = np.flatnonzero(c <= SMALL)
        rise[small] = self.rise[side[small], c[small] - 1, k[small]]
        large = np.flatnonzero(c > SMALL)
        then = self.sides[side[large], k[large]] + c[large, None]
        rise[large] = then * np.log(then) - self.before[side[large], k[large]]
        gain = np.add.reduceat(rise, begin).astype(float) - 2 * (_xlogx(self.alone + tokens[:, None]) - _xlogx(self.alone))
        # where it is, the word is taken out first
        here = self.sides[side, k, own[word]]
        stay = np.bincount(word, weights=_xlogx(here) - _xlogx(np.maximum(here - c, 0)), minlength=len(begin))
        stay -= 2 * (_xlogx(self.alone[own]) - _xlogx(np.maximum(self.alone[own] - tokens, 0)))
        gain[np.arange(len(begin)), own] = stay
        gain[:, : BORDER + 1] = -np.inf
        chosen = gain.argmax(1)
        better = gain[np.arange(len(begin)), chosen] - stay
        chosen = np.where(better > 1e-6 * (1 + np.abs(stay)), chosen, own)  # rises are single floats
        # the moves, as this task's later words see them
        for s, rows in ((0, self.table), (1, self.table.T)):
            mine = np.flatnonzero((side == s) & (chosen != own)[word])
            np.add.at(rows, (own[word[mine]], k[mine]), -c[mine])
            np.add.at(rows, (chosen[word[mine]], k[mine]), c[mine])
        np.maximum(self.table, 0, out=self.table)
        self.changed += tokens[chosen != own].sum()
        if self.changed > STALE * self.total:
            self.renew()
        return np.where(chosen != own, chosen, -1)


def _moves(sent, part: int, parts: int):
    """(w, at, c) of unlisted words, sorted by w, to their classes (w, k, goes) after the words of one part
    moved, and to rows without a word for the counts of the class pairs (first, then, c) they make with
    listed ones. ``at`` has five ranges of classes: of what follows and precedes and is listed, the word's
    own, and of what follows and precedes and is unlisted, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Table(sent.value)
        classes = len(known.table)
        cells = np.zeros(classes * classes)

        def flush(w, at, c):
            nonlocal cells
            fresh = np.concatenate(([True], w[1:] != w[:-1]))
            word, names, side = fresh.cumsum() - 1, w[fresh], at // classes
            own = np.zeros(len(names), np.int64)
            own[word[side == 2]] = at[side == 2] % classes
            turn = (mix(names.view(np.uint64)) >> np.uint64(32)) % np.uint64(parts) == part
            to = own.copy()
            if turn.any():
                seen = np.flatnonzero(turn[word] & (side != 2))
                number = turn.cumsum() - 1
                keys, n = _added(number[word[seen]] * (2 * classes) + at[seen] % (3 * classes), c[seen])
                chosen = known.moved(keys // (2 * classes), keys % (2 * classes), n, own[turn])
                to[turn] = np.where(chosen >= 0, chosen, own[turn])
            for s, first, then in ((0, to[word], at), (1, at - classes, to[word])):
                rows = np.flatnonzero(side == s)
                cells += np.bincount(first[rows] * classes + then[rows], weights=c[rows], minlength=len(cells))
            none = pa.nulls(len(names), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(to, pa.int32()), pa.array(to != own), none, none, none], names_out)

        names_out = ["w", "k", "goes", "first", "then", "c"]
        held, size = [], 0
        for batch in batches:
            held.append([_numbers(batch, x).astype(np.int64) for x in ("w", "at", "c")])
            size += batch.num_rows
            if size > 1 << 19:
                w, at, c = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(w, w[-1]))  # the last word may go on
                if cut:
                    yield flush(w[:cut], at[:cut], c[:cut])
                held, size = [[w[cut:], at[cut:], c[cut:]]], len(w) - cut
        if size:
            yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))
        found = _cell_rows(cells, classes)
        n = len(found[0])
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), *found], names_out)

    return run


def _likelihood(table: np.ndarray) -> float:
    return float(_xlogx(table).sum() - _xlogx(table.sum(1)).sum() - _xlogx(table.sum(0)).sum())


def _table(cells: DataFrame, size: int) -> np.ndarray:
    """Counts (first, then, c) of class pairs as a square array."""
    found = cells.groupBy("first", "then").agg(F.sum("c").alias("c")).toArrow()
    table = np.zeros((size, size))
    table[found["first"].to_numpy(), found["then"].to_numpy()] = found["c"].to_numpy()
    return table


def _settled(state, table: np.ndarray, distinct: int, move, parts: int):
    """State and table after rounds of ``move(state, table, part, parts)``, which gives both and the number of moves.

    A task follows up its own moves only, so the likelihood is computed anew after each round; a round that
    lowered it is taken back, and smaller parts are moved from then on.
    """
    first = last = _likelihood(table)
    turn = quiet = 0
    while quiet < parts and distinct > 1:
        new_state, new_table, n = move(state, table, turn % parts, parts)
        reached = _likelihood(new_table)
        if reached < last:
            parts, turn, quiet = parts * 2, 0, 0
            if parts > MOST_PARTS:
                break
            continue
        grown, (state, table, last) = reached - last, (new_state, new_table, reached)
        still = n < FEW * distinct / parts or grown < FEW * (last - first)
        turn, quiet = turn + 1, quiet + 1 if still else 0
    return state, table


def exchange(texts: DataFrame, sent, listed: int, tokens: int, space: Workspace, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the listed words, the end and, as ``RARE``, all unlisted words together, and their class pairs.

    The neighbours of each listed word are gathered once, packed by the million, so a round is one pass over
    them and sends only the moves to the driver. Words start in classes by code and move to where the sum
    of c * log c over class pairs, less those of the classes alone, grows most.
    """
    spark, sc = texts.sparkSession, texts.sparkSession.sparkContext
    size, span = classes + 2, listed + 2
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens >> 21)
    dealt = texts.mapInArrow(_dealt(sent, 4 * tasks), "bucket int, w binary, x binary, c binary")
    blocks = dealt.repartition(tasks, "bucket").mapInArrow(_blocks(span), "w binary, n binary, x binary, c binary")
    blocks = space.keep(blocks, "neighbours")

    def count(own):
        return _table(blocks.mapInArrow(_block_cells(sc.broadcast(own), size), "first long, then long, c long"), size)

    def move(own, table, part, parts):
        moved = blocks.mapInArrow(_block_moves(sc.broadcast((table, own)), part, parts), "w int, k int").toArrow()
        own = own.copy()
        own[moved["w"].to_numpy()] = moved["k"].to_numpy()
        return own, count(own), moved.num_rows

    own = np.concatenate((np.arange(listed) % classes + 2, [BORDER, RARE]))
    return _settled(own, count(own), listed, move, PARTS)


def exchange_unlisted(pairs: DataFrame, own: np.ndarray, table: np.ndarray, unlisted: DataFrame, distinct: int, space: Workspace, classes: int) -> tuple[DataFrame, np.ndarray]:
    """Classes (word, k) of the words of ``unlisted(word)``, and the table of all class pairs.

    ``pairs(a, b, c)`` counts neighbours of which one or both are unlisted, ``own`` and ``table`` come from
    the exchange of the listed ones. Rounds are as there, but neighbours lie in a table, where those that
    are unlisted themselves are joined with their classes.
    """
    sc = pairs.sparkSession.sparkContext
    size = classes + 2
    listed_table = table.copy()
    listed_table[RARE] = listed_table[:, RARE] = 0
    fixed = space.keep(pairs.where("a >= 0 or b >= 0").mapInArrow(_sided(sc.broadcast(own), size), "w long, at int, c long"), "fixed")
    both = space.keep(pairs.where("a < 0 and b < 0"), "both")
    of = lambda known, x: known.select(F.col("word").alias(x), F.col("k").alias("k" + x))

    def move(known, table, part, parts):
        after = both.join(of(known, "b"), "b").select(F.col("a").alias("w"), (F.col("kb") + 3 * size).alias("at"), "c")
        ahead = both.join(of(known, "a"), "a").select(F.col("b").alias("w"), (F.col("ka") + 4 * size).alias("at"), "c")
        mine = known.select(F.col("word").alias("w"), (F.col("k") + 2 * size).alias("at"), F.lit(0).cast("long").alias("c"))
        near = fixed.union(after).union(ahead).union(mine).repartition("w").sortWithinPartitions("w")
        schema = "w long, k int, goes boolean, first long, then long, c long"
        moved = space.keep(near.mapInArrow(_moves(sc.broadcast(table), part, parts), schema), "moved")
        known = moved.where("w is not null").select(F.col("w").alias("word"), "k")
        cells = both.join(of(known, "a"), "a").join(of(known, "b"), "b").select(F.col("ka").cast("long").alias("first"), F.col("kb").cast("long").alias("then"), "c")
        cells = cells.union(moved.where("w is null").select("first", "then", "c"))
        return known, listed_table + _table(cells, size), moved.where("goes").count()

    start = unlisted.select("word", (F.pmod("word", F.lit(classes)) + 2).cast("int").alias("k"))
    known, table, _ = move(start, table, -1, 1)  # counts only
    return _settled(known, table, distinct, move, 1)


def _scored(model):
    """(row, text) to partial scores of what listed words alone decide, and other neighbours one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, log_count, own, steps, base_floor, class_floor = model.value
        end = len(log_count) - 1
        emit = np.where(own == BORDER, 0.0, log_count - class_floor[own])
        for batch in batches:
            for first, last, data, offsets in pieces(batch.column(1)):
                rows = last - first
                hashes, texts = _tokens(data, offsets)
                codes = listed.codes(hashes)
                before = _before(codes, end)
                found, whole = codes >= 0, (codes >= 0) & (before >= 0)
                at, ahead = np.maximum(codes, 0), np.maximum(before, 0)
                score = np.where(whole, steps[own[ahead], own[at]] + emit[at], 0.0)
                base = np.where(found, log_count[at] - base_floor, 0.0)
                rest = np.flatnonzero(~whole)
                known = found & ((codes != end) | (log_count[end] > 0))  # a training text's end counts 1 or more
                sums = lambda x: np.bincount(texts, weights=x, minlength=rows)  # noqa: B023, E731
                n_rest, lone, spread = len(rest), *_spread(batch.column(0).slice(first, rows), hashes, texts, rest)
                zeros, none = np.zeros(n_rest), np.zeros(n_rest, np.int64)
                row = np.concatenate((np.arange(rows), texts[rest])).astype(np.int64)
                # a code of zero or more is in no table, and spreads the rows
                known_a, known_b = before[rest] >= 0, codes[rest] >= 0
                a = np.where(known_a, spread, before[rest])
                b = np.where(known_b, spread, codes[rest])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(first + row)),
                        pa.array(np.concatenate((lone, a))),
                        pa.array(np.concatenate((lone, b))),
                        pa.array(np.concatenate((np.zeros(rows), np.where(known_a, own[ahead[rest]], RARE))).astype(np.int32)),
                        pa.array(np.concatenate((np.zeros(rows), np.where(known_b, own[at[rest]], RARE))).astype(np.int32)),
                        pa.array(np.concatenate((np.zeros(rows), np.where(known_b, emit[at[rest]], 0.0)))),
                        pa.array(np.concatenate((np.zeros(rows, np.int32), np.where(known_b, 1, 2))).astype(np.int32)),
                        pa.array(np.concatenate((np.bincount(texts, minlength=rows), none)), pa.int64()),
                        pa.array(np.concatenate((sums(known.astype(float)).astype(np.int64), none)), pa.int64()),
                        pa.array(np.concatenate((sums(base), zeros))),
                        pa.array(np.concatenate((sums(score), zeros))),
                    ],
                    ["row", "a", "b", "ka", "kb", "emit", "kind", "n", "known", "base", "score"],
                )

    return run


def _spread(row: pa.StructArray, hashes: np.ndarray, texts: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of rows, and of their tokens ``rest``, that deal them out evenly.

    They follow from id, words and place alone, so a task that runs again deals its rows out as before.
    """
    counts = np.bincount(texts, minlength=len(row))
    ids = mix(row.field("doc_id").cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64))
    ids = mix(ids ^ np.add.reduceat(hashes, np.cumsum(counts) - counts)) if len(hashes) else ids
    place = rest - (np.cumsum(counts) - counts)[texts[rest]]
    keys = mix(ids[texts[rest]] + place.astype(np.uint64))
    return signed(ids >> np.uint64(1)), signed(keys >> np.uint64(1))


def held_out(doc_id) -> F.Column:
    """Documents that training leaves out: crc32 of the id as text leaves 1 when divided by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def score(docs: DataFrame, classes: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Texts are taken whole with A-Z lower-cased, a null or empty one has its end as the only token.
    ``base_score`` is the word model's log10 probability with half a count added, ``score`` the class
    model's; ``perplexity`` is per token. Repeated rows are counted and scored each on its own, ids may
    repeat. With no training documents every token is unknown; no rows give none. Other columns don't
    matter.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    space = Workspace(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    training = source.where(~held_out(F.col("doc_id"))).select("text")
    counts = space.keep(training.mapInArrow(_counts, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    words_of = counts.where(F.col("word") != int(signed(np.array([END]))[0]))
    sizes = words_of.groupBy("c").agg(F.count("*").alias("words")).toPandas().sort_values("c", ascending=False)
    fits = sizes[sizes.words.cumsum() <= LISTED]
    least = int(fits.c.min()) if len(fits) else int(total) + 1
    often = words_of.where(F.col("c") >= least).toPandas().sort_values(["c", "word"], ascending=False)
    listed_words = often.word.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(listed_words)
    listed = _Listed(listed_words[order], order)
    code = (F.col("word").bitwiseOR(F.lit(-(1 << 63)))).alias("word")
    rare = None
    if len(fits) < len(sizes):
        rare = space.keep(words_of.where(F.col("c") < least).select(code, "c"), "unlisted")

    sc = spark.sparkContext
    classes = classes or max(CLASSES, round(distinct ** (1 / 3)))
    sent_listed = sc.broadcast(listed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    own, steps = exchange(training, sent_listed, len(listed_words), int(total), space, classes)
    if rare is not None:
        pairs = training.mapInArrow(_pairs(sent_listed), "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))
        pairs = space.keep(pairs, "pairs")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
        known, steps = exchange_unlisted(pairs, own, steps, rare.select("word"), int(distinct) - len(listed_words), space, classes)
        rare = space.keep(rare.join(known, "word"), "classed")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    own = own[:-1]

    members = np.bincount(own[:-1], minlength=classes + 2).astype(float)
    if rare is not None:
        more = rare.groupBy("k").agg(F.count("*").alias("n")).toPandas()
        members[more.k.to_numpy(np.int64)] += more.n.to_numpy(float)
    members[RARE] = 1  # all words never seen
    ends = steps[:, BORDER].sum()
    class_floor = np.log10(np.maximum(steps.sum(0) + 0.5 * members, 0.5))
    steps[RARE] = steps.sum(0)  # after a word never seen, classes come as often as anywhere
    log_steps = np.log10((steps + ADDED) / (steps.sum(1, keepdims=True) + ADDED * (classes + 2)))
    base_floor = math.log10(total + 0.5 * (distinct + 1))

    log_count = np.log10(np.append(often.c.to_numpy(float), ends) + 0.5)
    sent = sc.broadcast((listed, log_count, own, log_steps, base_floor, class_floor))
    # an id of its own for every row, stable because it depends on the row alone up to equal rows
    keyed = source.select(F.struct("doc_id", F.xxhash64("text").alias("th")).alias("row"), "text")
    parts = keyed.mapInArrow(
        _scored(sent),
        "row struct<doc_id:long,th:long>, a long, b long, ka int, kb int, emit double, kind int, n long, known long, base double, score double",
    )
    if rare is None:
        joined = parts.withColumn("c", F.lit(None).cast("long"))
    else:
        joined = parts.join(rare.select(F.col("word").alias("b"), "c", F.col("k").alias("jb")), "b", "left")
        joined = joined.join(rare.select(F.col("word").alias("a"), F.col("k").alias("ja")), "a", "left")
        joined = joined.withColumns({"ka": F.coalesce("ja", "ka"), "kb": F.coalesce("jb", "kb")})
    cells = np.indices(log_steps.shape)
    of_cell = pd.DataFrame({"ka": cells[0].ravel().astype(np.int32), "kb": cells[1].ravel().astype(np.int32), "step": log_steps.ravel(), "floor": class_floor[cells[1].ravel()]})
    joined = joined.join(F.broadcast(spark.createDataFrame(of_cell)), ["ka", "kb"])
    log_c = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    other = F.col("kind") == 2
    rows = joined.groupBy("row").agg(
        F.sum((F.col("kind") == 0).cast("long")).alias("copies"),
        F.sum("n").alias("n_tokens"),
        F.sum(F.col("known") + (other & F.col("c").isNotNull()).cast("long")).alias("n_known"),
        F.sum(F.col("base") + F.when(other, log_c - F.lit(base_floor)).otherwise(0.0)).alias("base_score"),
        F.sum(
            F.col("score") + F.when(F.col("kind") == 0, 0.0).otherwise(F.col("step") + F.when(other, log_c - F.col("floor")).otherwise(F.col("emit")))
        ).alias("score"),
    )
    each = lambda name: (F.col(name) / F.col("copies")).alias(name)
    rows = rows.select(
        F.col("row.doc_id").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
        each("n_tokens").cast("long").alias("n_tokens"), each("n_known").cast("long").alias("n_known"), each("base_score"), each("score"),
    )
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op9: word and class model scores of every document."""
    return score(spark.read.parquet(f"{folder}/documents.parquet"))
