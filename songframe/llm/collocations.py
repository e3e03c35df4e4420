"""Phrase collocations by a multikey three-way quicksort of suffix pointers.

A suffix is a word with the words after it in its piece, cut at the longest phrase. Tasks merge equal
suffixes of their texts into one with a weight, and deal them out by the hash of their leading word, so
that all suffixes of one leading word meet in one bucket. There a three-way quicksort on the first
word, then inside each equal partition on the second and third, leaves the suffixes of one phrase
together: the weight of an equal partition is the phrase's count, and a partition lighter than the least
count is abandoned with all that is in it. A leading word too frequent for one bucket is dealt out by
two words to count pairs, and by three to count triples; merged by task, neither has more rows of one
phrase than there are tasks' chunks.

Words are compared by 64-bit hashes; the table of all words shows whether two share one, in which case
everything starts anew with other hash values, so that counts are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.llm.batches import SECOND, mix, piece_hash, pieces, prefix_hash, signed
from songframe.llm.storage import Workspace

LONGEST, LEAST, TOP = 3, 10, 2000
#: Words of text whose equal suffixes a task merges before it deals them out.
CHUNK_WORDS = 1 << 19
#: Suffixes in a bucket, and the length from which a partition is split by a pivot and not sorted at once.
BUCKET, SMALL = 1 << 20, 1 << 12

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_U = np.uint64


def _values(seed: int) -> np.ndarray:
    values = np.random.default_rng(1000 + seed).integers(1, 1 << 64, 256, dtype=np.uint64)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


class _Chunk:
    """Words of many texts: hash, language, place, and how many words of the piece follow."""

    def __init__(self, values: np.ndarray, twice: bool):
        self.values, self.twice = values, twice
        self.langs: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]) -> None:
        size = len(data)
        gap = _GAP[data]
        edge = offsets[1:-1]
        before, after = np.ones(size, bool), np.ones(size, bool)
        before[1:], after[:-1] = gap[:-1], gap[1:]
        before[edge[edge < size]] = True
        after[edge[edge > 0] - 1] = True
        starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
        owner = np.searchsorted(offsets, starts, side="right") - 1
        piece = np.cumsum(_BREAK[data])[starts] if size else starts
        hashes = mix(piece_hash(prefix_hash(data, self.values), starts, ends) + (ends - starts).astype(np.uint64))
        codes = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int64)
        # another hash tells different words apart that share one
        second = piece_hash(prefix_hash(_LOWER[data], SECOND), starts, ends) if self.twice else np.zeros(0, np.uint64)
        joined = np.zeros(len(starts), bool)
        joined[:-1] = (owner[1:] == owner[:-1]) & (piece[1:] == piece[:-1])
        self.parts.append((np.maximum(hashes, _U(1)), codes[owner] if len(owner) else owner, joined, starts, ends - starts, second, data))
        self.n += len(starts)

    def arrays(self) -> tuple[np.ndarray, ...]:
        hashes, lang, joined, starts, lengths, second, data = zip(*self.parts, strict=True)
        self.parts.clear()
        base = np.concatenate(([0], np.cumsum([len(x) for x in data])))
        starts = np.concatenate([s + b for s, b in zip(starts, base, strict=False)])
        return (*(np.concatenate(x) for x in (hashes, lang, joined)), starts, *(np.concatenate(x) for x in (lengths, second, data)))


def _chunks(batches: Iterator[pa.RecordBatch], values: np.ndarray, twice: bool) -> Iterator[_Chunk]:
    """(lang, text) batches as chunks of about CHUNK_WORDS words."""
    chunk = _Chunk(values, twice)
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for first, last, data, offsets in pieces(batch.column(1)):
            chunk.add(data, offsets, langs[first:last])
            if chunk.n >= CHUNK_WORDS:
                yield chunk
                chunk = _Chunk(values, twice)
    if chunk.n:
        yield chunk


def _gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The pieces of ``data`` at ``starts`` as strings."""
    to = np.concatenate(([0], np.cumsum(lengths)))
    out = data[np.arange(to[-1]) + np.repeat(starts - to[:-1], lengths)]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(to.astype(np.int32)), pa.py_buffer(out.tobytes()))


def _vocabulary(values: np.ndarray):
    """(lang, text) to lang, h, word, n: the words of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, values, True):
            hashes, lang, _, starts, lengths, second, data = chunk.arrays()
            names = np.array(list(chunk.langs), object)
            order = np.lexsort((hashes, lang))
            if ((hashes[order[1:]] == hashes[order[:-1]]) & (second[order[1:]] != second[order[:-1]])).any():
                order = np.lexsort((second, hashes, lang))
            h, code, other = hashes[order], lang[order], second[order]
            heads = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (code[1:] != code[:-1]) | (other[1:] != other[:-1]))))
            counts = np.diff(np.append(heads, len(h)))
            at = order[heads]
            word = _gathered(_LOWER[data], starts[at], lengths[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[code[heads]], pa.string()), pa.array(signed(h[heads])), word, pa.array(counts, pa.int64())], ["lang", "h", "word", "n"]
            )

    return run


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One binary value per group of ``values``, the groups starting at ``cuts``."""
    offsets = (cuts * values.dtype.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _routed(values: np.ndarray, buckets: int, heavy: np.ndarray):
    """(lang, text) to suffixes: lang, kind (words that lead), bucket, and packed words and weights.

    Kind 1 holds whole suffixes of ordinary leading words, 2 and 3 the pairs and triples of heavy ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, values, False):
            hashes, lang, joined, *_ = chunk.arrays()
            known, w = np.unique(hashes, return_inverse=True)
            n, size = len(w), len(known) + 1
            second = np.zeros(n, np.int64)  # 0: the piece ends
            second[:-1] = np.where(joined[:-1], w[1:] + 1, 0)
            third = np.zeros(n, np.int64)
            third[:-1] = np.where(joined[:-1], second[1:], 0)
            salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in chunk.langs], np.uint64)
            is_heavy = np.isin(mix(known[:, None] ^ salt[None, :]), heavy)[w, lang] if len(heavy) else np.zeros(n, bool)
            table = np.concatenate((np.zeros(1, np.uint64), known))
            found = []
            for kind in (1, 2, 3):
                pick = np.flatnonzero((second > 0 if kind < 3 else third > 0) & (is_heavy == (kind > 1)))
                first, last = (lang[pick] * size + w[pick] + 1), (third[pick] if kind != 2 else np.zeros(len(pick), np.int64))
                pair, back = np.unique(first * size + second[pick], return_inverse=True)
                whole, counts = np.unique(back * size + last, return_counts=True)
                pair, c = pair[whole // size], whole % size
                a, b = pair // size % size, pair % size
                code = pair // size // size
                key = mix(table[a] ^ salt[code])
                if kind > 1:
                    key = mix(key ^ table[b])
                if kind > 2:
                    key = mix(key ^ table[c])
                found.append((np.full(len(a), kind), code, (key % _U(buckets)).astype(np.int64), a, b, c, counts))
            kind, code, bucket, a, b, c, counts = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(a):
                continue
            order = np.lexsort((code, kind, bucket))  # stable, so groups stay sorted by words
            kind, code, bucket, a, b, c, counts = (x[order] for x in (kind, code, bucket, a, b, c, counts))
            group = np.concatenate(([0], np.cumsum((kind[1:] != kind[:-1]) | (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1]))))
            cuts = np.append(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), len(group))
            # each group numbers its own words, so most fit in two bytes
            triple = np.concatenate((a, b, c))
            own, place = np.unique(np.tile(group, 3) * size + triple, return_inverse=True)
            own_cuts = np.searchsorted(own // size, np.arange(group[-1] + 2))
            place = place - np.tile(own_cuts[group], 3)
            place = place.astype(np.uint16 if place.max() < 1 << 16 else np.uint32)
            heads, names = cuts[:-1], np.array(list(chunk.langs), object)
            columns = [
                pa.array(names[code[heads]], pa.string()), pa.array(kind[heads], pa.int32()), pa.array(bucket[heads], pa.int32()),
                pa.array(np.full(len(heads), place.dtype.itemsize), pa.int32()), _packed(table[own % size], own_cuts),
                *(_packed(x, cuts) for x in np.split(place, 3)), _packed(counts.astype(np.uint32), cuts),
            ]
            out = pa.RecordBatch.from_arrays(columns, ["lang", "kind", "bucket", "width", "words", "a", "b", "c", "weights"])
            for at in range(0, len(out), 256):
                yield out.slice(at, 256)

    return run


_ROUTED = "lang string, kind int, bucket int, width int, words binary, a binary, b binary, c binary, weights binary"


def equal_partitions(keys: np.ndarray, weights: np.ndarray, least: int, lead: int = 1) -> Iterator[tuple[int, int, int]]:
    """(depth, pointer to one suffix, weight) of the equal partitions that weigh ``least`` or more.

    ``keys[d]`` are the words at depth d, 0 after the end. Partitions lie deeper than ``lead - 1``; nothing
    is abandoned before, as lighter leading words are not all here. Long partitions are split around a
    pivot into less, equal and greater; what is short is finished by one sort per depth.
    """
    depth_of = len(keys)
    short: list[list[np.ndarray]] = [[] for _ in range(depth_of)]
    stack = [(np.arange(len(weights)), 0)]
    while stack:
        at, depth = stack.pop()
        if not len(at) or (depth >= lead - 1 and weights[at].sum() < least):
            continue
        if len(at) <= SMALL:
            short[depth].append(at)
            continue
        key = keys[depth][at]
        pivot = np.sort(key[:: max(1, len(key) // 9)])[4]
        equal = at[key == pivot]
        stack += [(at[key < pivot], depth), (at[key > pivot], depth)]
        if not pivot:
            continue
        if depth >= lead - 1:
            weight = int(weights[equal].sum())
            if weight < least:
                continue
            yield depth + 1, int(equal[0]), weight
        if depth + 1 < depth_of:
            stack.append((equal, depth + 1))
    at, part = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for depth in range(depth_of):
        fresh = short[depth]
        at = np.concatenate((at, *fresh))
        part = np.concatenate((part, np.repeat(np.arange(len(fresh)) + (part[-1] + 1 if len(part) else 0), [len(x) for x in fresh])))
        key = keys[depth][at]
        alive = key > 0
        at, part, key = at[alive], part[alive], key[alive]
        if not len(at):
            continue
        order = np.lexsort((key, part))
        at, part, key = at[order], part[order], key[order]
        heads = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
        part = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(at))))
        if depth >= lead - 1:
            weight = np.add.reduceat(weights[at], heads)
            yield from ((depth + 1, int(at[heads[i]]), int(weight[i])) for i in np.flatnonzero(weight >= least))
            alive = weight[part] >= least
            at, part = at[alive], part[alive]


def _counted(least: int):
    """Rows of ``_routed``, all of a bucket in one partition, to frequent phrases: lang, w1, w2, w3, a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                words = np.frombuffer(row["words"], np.uint64)
                width = np.uint16 if row["width"] == 2 else np.uint32
                suffix = [words[np.frombuffer(row[x], width)] for x in "abc"]
                held.setdefault((row["lang"], row["kind"]), []).append((*suffix, np.frombuffer(row["weights"], np.uint32)))
        for (lang, kind), parts in held.items():
            *keys, weights = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            rows = [
                (*(int(keys[d][at]) if d < depth else 0 for d in range(LONGEST)), weight)
                for depth, at, weight in equal_partitions(keys, weights.astype(np.int64), least, kind)
                if depth > 1
            ]
            if not rows:
                continue
            found = np.array([r[:LONGEST] for r in rows], np.uint64)
            columns = [pa.array([lang] * len(rows), pa.string()), *(pa.array(signed(np.ascontiguousarray(found[:, d]))) for d in range(LONGEST))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r[-1] for r in rows], pa.int64())], ["lang", "w1", "w2", "w3", "a"])

    return run


def _lang_salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def vocabulary(source: DataFrame, space: Workspace, values: Callable[[int], np.ndarray] = _values) -> tuple[DataFrame, np.ndarray]:
    """lang, h, word, n of all words, and hash values of bytes under which no two words share a hash."""
    seed = 0
    while True:
        rows = source.mapInArrow(_vocabulary(values(seed)), "lang string, h long, word string, n long")
        found = space.keep(rows.groupBy("lang", "h", "word").agg(F.sum("n").alias("n")), "words")
        if not found.groupBy("lang", "h").count().where("count > 1").limit(1).count():
            return found, values(seed)
        seed += 1


def phrases(docs: DataFrame, least: int = LEAST, bucket: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of 2 and 3 words as hashes (lang, w1, w2, w3 or 0, a), and the table of words."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    space = Workspace(spark)
    bucket = bucket or BUCKET
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words, values = vocabulary(source, space)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // bucket))
    # at most 4 * buckets words reach a quarter of a bucket
    often = words.where(F.col("n") * 4 >= bucket).select("lang", "h").collect()
    heavy = mix(np.array([(r.h & (1 << 64) - 1) ^ _lang_salt(r.lang) for r in often], np.uint64))
    routed = source.mapInArrow(_routed(values, buckets, heavy), _ROUTED).repartitionById(buckets, F.col("bucket"))
    found = routed.mapInArrow(_counted(least), "lang string, w1 long, w2 long, w3 long, a long")
    return space.keep(found, "phrases"), words


def collocations(docs: DataFrame, least: int = LEAST, top: int | None = TOP, absorb: int = 50, bucket: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the strongest phrases of 2 to 3 words of each language.

    A-Z is lower-cased, texts are split at ``[.,;:!?`` and line ends ``]`` and then at blanks and tabs. A
    candidate occurs ``a >= least`` times; of its cuts the one with the least floor(10**6 * a * a / (l * r))
    counts, the first on a tie. A candidate inside a longer one that occurs at least ``absorb`` percent as
    often is dropped. Order: score, then a, both falling, then the phrase in byte order; ``top`` None gives
    all. Null texts are empty, a null language is ``und``, repeated rows count each, other columns are
    ignored, and texts without words or no rows give no rows.
    """
    found, words = phrases(docs, least, bucket)
    word = lambda k: words.select("lang", F.col("h").alias(f"w{k}"), F.col("word").alias(f"word{k}"), F.col("n").alias(f"n{k}"))
    pairs, triples = found.where("w3 = 0").drop("w3"), found.where("w3 <> 0")
    inside = triples.select("lang", "w1", "w2", "a").union(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    inside = inside.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    kept = pairs.join(inside, ["lang", "w1", "w2"], "left").where(F.expr(f"longer is null or 100 * longer < {absorb} * a"))
    named = lambda df: df.join(word(1), ["lang", "w1"]).join(word(2), ["lang", "w2"])
    cut = lambda left, right: f"cast(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0))) as bigint)"
    two = named(kept).select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("n1").alias("l"), F.col("n2").alias("r"), F.expr(cut("n1", "n2")).alias("score"))
    heads = pairs.select("lang", "w1", "w2", F.col("a").alias("head"))
    tails = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("tail"))
    three = named(triples).join(word(3), ["lang", "w3"]).join(heads, ["lang", "w1", "w2"]).join(tails, ["lang", "w2", "w3"])
    three = three.withColumn("s1", F.expr(cut("n1", "tail"))).withColumn("s2", F.expr(cut("head", "n3")))
    early = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a",
        F.when(early, F.col("n1")).otherwise(F.col("head")).alias("l"), F.when(early, F.col("tail")).otherwise(F.col("n3")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    out = two.union(three)
    out = out.selectExpr("*", "row_number() over (partition by lang order by score desc, a desc, phrase) as rank")
    if top is not None:
        out = out.where(F.col("rank") <= top)
    return out.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op11: the first 2000 collocations of each language."""
    return collocations(spark.read.parquet(f"{folder}/documents.parquet"))


ORACLE = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), worded as (
  select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces
), one as (select lang, w as word, count(*) as n from (select lang, unnest(w) as w from worded) group by all),
sizes as (select lang, cast(sum(n) as bigint) as n from one group by lang),
grams as (
  select lang, unnest(list_transform(range(1, len(w)), lambda i: w[i:i+1])) as g from worded where len(w) > 1
  union all
  select lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i+2])) as g from worded where len(w) > 2
), counted as (select lang, g, count(*) as a from grams group by all),
candidates as (select * from counted where a >= 10),
absorbed as (
  select lang, g, max(a) as longer from (
    select lang, g[1:2] as g, a from candidates where len(g) = 3
    union all select lang, g[2:3] as g, a from candidates where len(g) = 3) group by all
), cuts as (
  select c.lang, c.g, c.a, 1 as k, x.n as l, case when len(c.g) = 2 then y.n else p.a end as r
  from candidates c join one x on x.lang = c.lang and x.word = c.g[1]
  left join one y on y.lang = c.lang and y.word = c.g[2] left join counted p on p.lang = c.lang and p.g = c.g[2:3]
  union all
  select c.lang, c.g, c.a, 2, p.a, y.n from candidates c join counted p on p.lang = c.lang and p.g = c.g[1:2]
  join one y on y.lang = c.lang and y.word = c.g[3] where len(c.g) = 3
), scored as (
  select lang, g, a, l, r, cast(1000000::hugeint * a * a // (l::hugeint * r) as bigint) as score,
    row_number() over (partition by lang, g order by cast(1000000::hugeint * a * a // (l::hugeint * r) as bigint), k) as first
  from cuts
), ranked as (
  select s.lang, row_number() over (partition by s.lang order by score desc, a desc, array_to_string(s.g, ' ')) as rank,
    array_to_string(s.g, ' ') as phrase, a, l, r, score
  from scored s left join absorbed b on b.lang = s.lang and b.g = s.g
  where first = 1 and not (longer is not null and 100 * longer >= 50 * a)
)
select lang, rank, phrase, a, l, r, n, score from ranked join sizes using (lang) where rank <= 2000
"""
