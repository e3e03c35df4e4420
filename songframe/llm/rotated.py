"""Nearest neighbours by largest inner product, over randomly rotated one-bit codes.

The index keeps for each vector the signs of its rotated difference from a centre, packed to one bit a
component, and three scalars: the difference's length, its inner product with the centre, and the cosine
between it and its code. With a query's rotated difference they give an unbiased estimate of the inner
product and a bound of its error that holds with high probability. A search deals the index out in blocks
and sends every query to every block, twice: at first the largest estimates give each query a floor, then
all rows whose bound reaches the floor are ranked on the original vectors. A window merges the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.llm.storage import Workspace

NEAREST = 20
#: Half widths of the error bound in its standard deviations.
WIDTH = 2.5
#: Bytes of original components in a block, and rows from which a table is cut further to occupy all tasks.
BLOCK_BYTES, BLOCK_ROWS = 32 << 20, 4096
#: Queries compared with a block at once; estimates held are this many times the block's rows.
QUERIES = 128
SEED = 20


@lru_cache(maxsize=4)
def rotation(size: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _stacked(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _runs(batch: pa.RecordBatch, *columns: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with equal values in ``columns``."""
    keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
    heads = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(0)))) if batch.num_rows else []
    for first, last in zip(heads, [*heads[1:], batch.num_rows], strict=True):
        yield batch.slice(first, last - first)


def encode(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, length of the difference, its product with the centre, cosine with the code."""
    apart = vectors - centre
    length = np.linalg.norm(apart, axis=1)
    turned = apart.astype(np.float32) @ rotation(vectors.shape[1])
    bits = turned >= 0
    reach = np.abs(turned).sum(1) / np.sqrt(vectors.shape[1])
    cosine = np.divide(reach, length, out=np.ones(len(length)), where=length > 0)
    return np.packbits(bits, axis=1), length, apart @ centre, np.clip(cosine, 1e-6, 1)


def _encoded(dims: int, centre: np.ndarray):
    """(vec_id, vector, dims) to the index; vectors of other lengths than the centre's take zero for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _runs(batch, "dims"):
                size = part.column("dims")[0].as_py()
                codes, length, along, cosine = encode(_stacked(part.column("vector"), size), centre if size == dims else np.zeros(size))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
                columns = [*part.columns, packed, *(pa.array(x.astype(np.float64)) for x in (length, along, cosine))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vector", "dims", "code", "length", "along", "cosine"])

    return run


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """vec_id, vector, dims, in double precision; without null, zero and non-finite vectors."""
    vector = F.col(column).cast("array<double>")
    out = vectors.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector")).withColumn("dims", F.size("vector"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return out.where(F.col("vector").isNotNull() & whole & F.exists("vector", lambda x: x != 0))


def centre_of(rows: DataFrame) -> tuple[int, np.ndarray]:
    """The most common length and the mean of all vectors that have it; sums are taken in the tasks."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _stacked(batch.column(0), batch.column(1)[0].as_py()) if batch.num_rows else None
            if vectors is not None:
                yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(vectors.shape[1]), pa.int32()), "s": vectors.sum(0), "c": pa.array([len(vectors)] * vectors.shape[1], pa.int64())})

    first = rows.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    if first is None:
        return 0, np.zeros(0)
    found = rows.where(F.col("dims") == first.dims).select("vector", "dims").mapInArrow(sums, "at int, s double, c long")
    means = {r.at: r.m for r in found.groupBy("at").agg((F.sum("s") / F.sum("c")).alias("m")).collect()}
    return first.dims, np.array([means[i] for i in range(first.dims)])


def build(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """The index (vec_id, vector, dims, code, length, along, cosine) of all usable rows, and its centre."""
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    rows = usable(vectors, id_column, column)
    dims, centre = centre_of(rows)
    schema = "vec_id long, vector array<double>, dims int, code binary, length double, along double, cosine double"
    return rows.mapInArrow(_encoded(dims, centre), schema), centre


def exactly(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first component to the last."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


class Block:
    """Index rows of one length, compared with queries."""

    def __init__(self, table: pa.Table, dims: int, centre: np.ndarray):
        self.ids = table.column("vec_id").combine_chunks()
        self.id_values = self.ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.id_known = self.ids.is_valid().to_numpy(zero_copy_only=False)
        self.vectors = _stacked(table.column("vector").combine_chunks(), dims)
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(self.ids), -1)
        self.signs = np.unpackbits(codes, axis=1, count=dims).astype(np.float32) * np.float32(2) - np.float32(1)
        length, along, cosine = (table.column(c).to_numpy() for c in ("length", "along", "cosine"))
        self.along = along.astype(np.float32)
        self.scale = (length / (cosine * np.sqrt(dims))).astype(np.float32)
        self.spread = (length * np.sqrt(np.maximum(1 - cosine * cosine, 0)) / cosine / np.sqrt(max(dims - 1, 1))).astype(np.float32)
        self.dims, self.centre = dims, centre

    def estimates(self, ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products, the queries' own rows at minus infinity, and the queries' distances."""
        apart = queries - self.centre
        out = (apart.astype(np.float32) @ rotation(self.dims)) @ self.signs.T
        out *= self.scale
        out += self.along
        out += (queries @ self.centre).astype(np.float32)[:, None]
        out[self.id_known & (self.id_values == ids[:, None])] = -np.inf
        return out, np.linalg.norm(apart, axis=1).astype(np.float32)

    def promising(self, ids: np.ndarray, queries: np.ndarray, nearest: int) -> list[np.ndarray]:
        """Rows with the largest estimates of each query."""
        estimate, _ = self.estimates(ids, queries)
        n = estimate.shape[1]
        best = np.argpartition(estimate, n - nearest, axis=1)[:, n - nearest :] if n > nearest else np.tile(np.arange(n), (len(queries), 1))
        return [row[e[row] > -np.inf] for row, e in zip(best, estimate, strict=True)]

    def possible(self, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, width: float) -> list[np.ndarray]:
        """Rows of each query whose error bound reaches its floor."""
        estimate, apart = self.estimates(ids, queries)
        own = estimate == -np.inf
        # floors are exact scores, estimates single precision
        estimate += (np.float32(width) * apart)[:, None] * self.spread + np.float32(1e-6) * (1 + np.abs(estimate))
        return [np.flatnonzero(x) for x in (estimate >= floors[:, None]) & ~own]

    def ranked(self, queries: np.ndarray, rows: list[np.ndarray], nearest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, row and score of the nearest of each query's ``rows``, on the original vectors."""
        kept = []
        for query, row in zip(queries, rows, strict=True):
            if len(row) > nearest:
                rough = self.vectors[row] @ query
                floor = np.partition(rough, len(row) - nearest)[len(row) - nearest]
                row = row[rough >= floor - 1e-9 * (1 + abs(floor))]  # what rounding could order otherwise stays in
            kept.append(row)
        q, row = np.repeat(np.arange(len(queries)), [len(x) for x in kept]), np.concatenate([np.zeros(0, np.int64), *kept])
        score = exactly(queries[q], self.vectors[row])
        order = np.lexsort((self.id_values[row], ~self.id_known[row], -score, q))
        q, row, score = q[order], row[order], score[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < nearest
        return q[top], row[top], score[top]


def _searched(dims: int, centre: np.ndarray, nearest: int, width: float | None):
    """Index rows and queries of whole blocks, index rows first, to the nearest rows of each query and block.

    Without ``width`` the rows with the largest estimates are ranked, with it all that can reach the floor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, blocks = None, [], {}
        for batch in batches:
            for part in _runs(batch, "block", "role"):
                if part.column("block")[0].as_py() != block:
                    block, held, blocks = part.column("block")[0].as_py(), [], {}
                if part.column("role")[0].as_py() == 0:
                    held.append(part)
                    continue
                if held:
                    table, held = pa.Table.from_batches(held), []
                    sizes = table.column("dims").to_numpy()
                    for size in np.unique(sizes):
                        rows = table.filter(pa.array(sizes == size))
                        blocks[int(size)] = Block(rows, int(size), centre if size == dims else np.zeros(size))
                yield from answers(part, blocks)

    def answers(part: pa.RecordBatch, blocks: dict[int, Block]) -> Iterator[pa.RecordBatch]:
        sizes = part.column("dims").to_numpy()
        for size in np.unique(sizes):
            if int(size) not in blocks:
                continue
            rows, block = part.filter(pa.array(sizes == size)), blocks[int(size)]
            for at in range(0, rows.num_rows, QUERIES):
                some = rows.slice(at, QUERIES)
                ids, queries = some.column("vec_id").to_numpy(), _stacked(some.column("vector"), int(size))
                if width is None:
                    found = block.promising(ids, queries, nearest)
                else:
                    found = block.possible(ids, queries, some.column("floor").to_numpy(), width)
                q, row, score = block.ranked(queries, found, nearest)
                reach = score >= some.column("floor").to_numpy()[q]
                q, row, score = q[reach], row[reach], score[reach]
                yield pa.RecordBatch.from_arrays(
                    [some.column("vec_id").take(pa.array(q)), some.column("print").take(pa.array(q)), block.ids.take(pa.array(row)), pa.array(score)],
                    ["query_id", "print", "vec_id", "score"],
                )

    return run


def search(index: DataFrame, queries: DataFrame, centre: np.ndarray, nearest: int = NEAREST, width: float = WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` the nearest rows of ``index``.

    ``queries`` has vec_id, vector and dims. Rows of the index with the query's id are its own and no
    candidates; only vectors of its length are. Equal scores go to the smaller vec_id, a null one last.
    A query that is repeated whole is answered once; repeated index rows are candidates each.

    A first pass over all blocks ranks what has the largest estimates. The last of the nearest found so is
    a floor under the true ones, for all blocks; a second pass ranks every row whose bound reaches it.
    """
    spark = index.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    space = Workspace(spark)
    index = space.keep(index, "index")
    rows, components = index.agg(F.count("*"), F.coalesce(F.sum("dims"), F.lit(0))).first()
    blocks = max(1, -(-components * 8 // BLOCK_BYTES), min(-(-rows // BLOCK_ROWS), 2 * spark.sparkContext.defaultParallelism))
    none = lambda kind: F.lit(None).cast(kind)
    codes = index.select(
        "vec_id", "vector", "dims", "code", "length", "along", "cosine", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int").alias("block"),
        F.lit(0).alias("role"), F.lit(0).cast("long").alias("print"), F.lit(0.0).alias("floor"),
    )
    asked = queries.select("vec_id", "vector", "dims", F.xxhash64("vector").alias("print")).dropDuplicates(["vec_id", "print"])

    def scan(queries: DataFrame, width: float | None, each: int) -> DataFrame:
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        sent = queries.select("vec_id", "vector", "dims", none("binary").alias("code"), *(none("double").alias(c) for c in ("length", "along", "cosine")), everywhere, F.lit(1).alias("role"), "print", "floor")
        dealt = codes.unionByName(sent).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "role")
        found = dealt.mapInArrow(_searched(len(centre), centre, each, width), "query_id long, print long, vec_id long, score double")
        found = found.selectExpr("*", "row_number() over (partition by query_id, print order by score desc, vec_id nulls last) as rank")
        return found.where(F.col("rank") <= nearest)

    # any ``nearest`` exact scores give a floor, so no block has to list as many
    some = min(nearest, max(2, -(-2 * nearest // blocks)))
    first = scan(asked.withColumn("floor", F.lit(float("-inf"))), None, some).groupBy(F.col("query_id").alias("vec_id"), "print")
    floors = first.agg(F.when(F.count("*") >= nearest, F.min("score")).alias("floor"))
    asked = asked.join(space.keep(floors, "floors"), ["vec_id", "print"], "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    return scan(asked, width, nearest).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int, nearest: int = NEAREST, width: float = WIDTH, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The nearest rows of each row whose id is divisible by ``every``, among all other rows.

    Null, zero and non-finite vectors take no part, nor does a null component's vector; a row without an
    id is a candidate only. With fewer candidates all are returned; no usable rows give none. Other
    columns are ignored, whatever their names.
    """
    index, centre = build(vectors, id_column, column)
    queries = usable(vectors, id_column, column).where(F.col("vec_id") % every == 0)
    return search(index, queries, centre, nearest, width)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op12: the 20 nearest of each twentieth embedding."""
    return neighbours(spark.read.parquet(f"{folder}/embeddings.parquet"), 20)


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored as (
  select q.vec_id as query_id, o.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * o.e[i]), lambda a, b: a + b) as score
  from v q join v o on o.vec_id <> q.vec_id and len(o.e) = len(q.e) where q.vec_id % 20 = 0
), ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""
