"""Byte-level BPE encoding and decoding with a public rank file.

Bytes are read as Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds the
longest token at every position in one pass. Encoding goes left to right with the longest match and
steps back to shorter ones when two neighbours are not compatible, that is, when merging their bytes
would not give just these two. Compatibility is memoised, and a position that proved to be a dead end
is never entered again, so the work is linear in the text and the result equals that of the merges.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of each of the two generations of a memo; memory stays bounded on any input.
MEMO_ENTRIES = 1 << 17
#: Rows in an Arrow batch; texts, ids and decoded bytes of one batch are held at once.
BATCH_ROWS = 500

# The characters with Unicode's White_Space property.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# White space splits like this in every pattern of this family, whatever the rest does with what lies between.
_COARSE = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


class Memo(dict):
    """Remembers ``make(key)``. When full, the older half of what was used goes."""

    def __init__(self, make: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.entries, self.older = make, entries, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to ids, from the lines of a rank file."""
    lines = (line.split() for line in content.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in lines}


NEVER = 1 << 62


def merges(piece: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], list[tuple[bytes, int]], list[tuple[bytes, int]]]:
    """Byte pair merges as defined: the pair of lowest rank first, leftmost on ties.

    Returns the parts that are left, and the parts that stood at the left and at the right edge
    meanwhile, each with the rank of the merge that took it up.
    """
    parts = [piece[i : i + 1] for i in range(len(piece))]
    left, right = [], []
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == NEVER:
            break
        if at == 0:
            left.append((parts[0], rank))
        if at == len(parts) - 2:
            right.append((parts[-1], rank))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts, [*left, (parts[0], NEVER)], [*right, (parts[-1], NEVER)]


class Coder:
    """Encodes and decodes texts with one vocabulary and splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.edges = Memo(self._edges)
        self.compatible = Memo(self._compatible)
        self.shorter = Memo(self._shorter)
        self.pieces = Memo(self.piece)
        self.coarse = Memo(self._chunk, 2 * MEMO_ENTRIES)

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for token in self.ranks:
            made.add_word(token.decode("latin-1"), token)
        made.make_automaton()
        return made

    def _edges(self, token: bytes):
        """How a token's edges grow, or nothing for one that merges never make."""
        parts, left, right = merges(token, self.ranks)
        return (left, right) if len(parts) == 1 else ()

    def _compatible(self, pair: tuple[bytes, bytes]) -> bool:
        """Whether merging the two tokens' bytes gives the two again.

        A merge across the border comes first if its rank is below those of the next merges at the
        two edges that face each other; a tie goes to the one further left. Ranks rise as tokens
        grow, so the edges are followed in the order of their ranks.
        """
        first, second = self.edges[pair[0]], self.edges[pair[1]]
        if not first or not second:
            return False
        ends, starts, get = first[1], second[0], self.ranks.get
        i = j = 0
        while True:
            (end, grows_left), (start, grows_right) = ends[i], starts[j]
            across = get(end + start, NEVER)
            if across < grows_left and across <= grows_right and across != NEVER:
                return False
            if grows_left == grows_right == NEVER:
                return True
            if grows_left <= grows_right:
                i += 1
            else:
                j += 1

    def _shorter(self, token: bytes) -> bytes:
        """The longest token that is a proper prefix of ``token``, or nothing."""
        return next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), b"")

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        size = len(piece)
        longest = [b""] * (size + 1)
        for end, token in self.automaton.iter(piece.decode("latin-1")):  # at a start, later ends are longer
            longest[end + 1 - len(token)] = token
        dead = bytearray(size + 1)
        compatible, shorter, chosen = self.compatible, self.shorter, []
        at, token = 0, longest[0]
        while at < size:
            while token:
                end = at + len(token)
                if not dead[end] and (compatible[chosen[-1], token] if chosen else self.edges[token]):
                    break
                token = shorter[token]
            if token:
                chosen.append(token)
                at, token = end, longest[end]
            elif chosen:
                dead[at] = 1
                token = chosen.pop()
                at -= len(token)
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
        return [ranks[token] for token in chosen]

    def _chunk(self, text: str) -> bytes:
        pieces = self.pieces
        ids = array("I", [i for match in self.pattern.findall(text) for i in pieces[match.encode()]])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.coarse.__getitem__, _COARSE.findall(text or "")))

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


_coders: dict[tuple, Coder] = {}


def coder(content: bytes, pattern: str) -> Coder:
    """One coder per Python worker, kept for its later tasks."""
    key = (hash(content), len(content), pattern)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(read_ranks(content), pattern)
    return _coders[key]


def _mapped(spark: SparkSession, docs: DataFrame, column: str, into: str, vocabulary: str, pattern: str, what: str) -> DataFrame:
    with open(vocabulary, "rb") as file:  # bounded: one vocabulary, sent to each executor once
        content = spark.sparkContext.broadcast(file.read())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    docs = docs.drop(into)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(content.value, pattern)
        convert = own.encode if what == "encode" else own.decode
        for batch in batches:
            made = pa.array((convert(x.as_py()) for x in batch.column(at)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "made"])

    schema = T.StructType([*plain.schema.fields, T.StructField("made", T.BinaryType())])
    return plain.mapInArrow(run, schema).toDF(*names, into)


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with ``into``: the ids of the whole text, packed as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Special tokens are never made. A column named ``into`` is
    replaced, others pass through; repeated rows are encoded alike, no rows give none. Texts of any
    length are encoded whole. There is no shuffle, so a lost task repeats its own rows only.
    """
    return _mapped(docs.sparkSession, docs, text, into, vocabulary, pattern, "encode")


def decode(coded: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``coded`` with ``into``: the bytes that packed ``ids`` stand for; null ids give no bytes."""
    return _mapped(coded.sparkSession, coded, ids, into, vocabulary, pattern, "decode")


def production() -> tuple[str, str]:
    """Rank file and pattern of the production queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op2: ids of every document, decoded again, as counts and digests."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    coded = encode(docs, *production()).drop("text")
    return decode(coded, *production()).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
