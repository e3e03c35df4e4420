"""Prefix trie of conversations, as balanced parentheses in shards.

A conversation is the string of its turns' digests. Equal conversations count once with a weight, and
the distinct ones are dealt out in ranges of their order, so that a shard's trie is a walk down and up: what
a conversation has past its predecessor's common prefix opens nodes, what the predecessor had closes them.
On that string of parentheses blocks keep the least and greatest excess; ``findclose`` climbs over them to
where a node's subtree ends. The rank of "()" pairs counts leaves, and cumulative arrays over opened nodes
give members and savings of any subtree as a difference of two entries.

Only nodes on the paths of a shard's first and last conversation can lie in other shards too. These
spines are merged by node: counts add up, and what several copies counted each on their own is put
right for the node and, along each spine, for all nodes above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from songframe.llm.storage import Workspace

#: Hexadecimal digits that stand for a turn.
DIGITS = 32
#: Turns of distinct conversations in a shard.
SHARD_TURNS = 1 << 19
#: Parentheses in a block.
BLOCK = 64
#: Ids of members that lie in one row; lists of more are hashed from several rows in order.
SPAN = 1 << 14
EMPTY = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """A balanced string of parentheses (True opens) with least and greatest excess per block."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1))
        size = -(-max(len(bits), 1) // BLOCK) * BLOCK
        held = np.zeros(size, np.int64)
        held[: len(bits)] = self.excess
        rows = held.reshape(-1, BLOCK)
        self.rows = rows
        # levels[0] are blocks; each further level has the extremes of two entries below
        self.levels = [(rows.min(1), rows.max(1))]
        while len(self.levels[-1][0]) > 1:
            low, high = self.levels[-1]
            if len(low) % 2:
                low, high = np.append(low, low[-1]), np.append(high, high[-1])
            self.levels.append((low.reshape(-1, 2).min(1), high.reshape(-1, 2).max(1)))
        #: opened nodes and leaf pairs in bits[:i]
        self.opens = np.concatenate(([0], np.cumsum(bits)))
        pair = np.zeros(len(bits), np.int64)
        pair[:-1] = bits[:-1] & ~bits[1:]
        self.leaves = np.concatenate(([0], np.cumsum(pair)))

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The position that closes each open one: the next whose excess is one less."""
        target = self.excess[at] - 1
        out = np.full(len(at), -1)
        block = at // BLOCK
        for first in range(0, len(at), 4096):  # inside the own block
            some = slice(first, first + 4096)
            hit = (self.rows[block[some]] == target[some, None]) & (np.arange(BLOCK) > (at[some] % BLOCK)[:, None])
            out[some] = np.where(hit.any(1), block[some] * BLOCK + hit.argmax(1), -1)
        open_ = np.flatnonzero(out < 0)
        # up: to the first entry to the right whose range of excess holds the target
        entry, level, found = block[open_] + 1, np.zeros(len(open_), np.int64), np.zeros(len(open_), bool)
        for k, (low, high) in enumerate(self.levels):
            mine = np.flatnonzero(~found)
            e = np.minimum(entry[mine], len(low) - 1)
            hit = (entry[mine] < len(low)) & (low[e] <= target[open_[mine]]) & (high[e] >= target[open_[mine]])
            level[mine[hit]], found[mine[hit]] = k, True
            rest = mine[~hit]
            step = np.flatnonzero(entry[rest] % 2 == 0)  # its sibling comes before the parent's right neighbour
            sibling = entry[rest[step]] + 1
            inside = sibling < len(low)
            s = np.minimum(sibling, len(low) - 1)
            hit = inside & (low[s] <= target[open_[rest[step]]]) & (high[s] >= target[open_[rest[step]]])
            entry[rest[step[hit]]], level[rest[step[hit]]], found[rest[step[hit]]] = sibling[hit], k, True
            rest = rest[~found[rest]]
            entry[rest] = entry[rest] // 2 + 1
        # down again: to the left part where it holds the target
        for k in range(len(self.levels) - 1, 0, -1):
            low, high = self.levels[k - 1]
            mine = np.flatnonzero(level == k)
            left = entry[mine] * 2
            want = target[open_[mine]]
            entry[mine] = np.where((low[left] <= want) & (high[left] >= want), left, left + 1)
            level[mine] = k - 1
        for first in range(0, len(open_), 4096):
            some = slice(first, first + 4096)
            hit = self.rows[entry[some]] == target[open_[some], None]
            out[open_[some]] = entry[some] * BLOCK + hit.argmax(1)
        return out


def range_minima(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Minimum of values[start:stop] for each pair, one power of two of lengths after the other."""
    out = np.empty(len(start), values.dtype)
    power = np.frexp((stop - start).astype(float))[1] - 1
    table = values
    for k in range(int(power.max(initial=0)) + 1):
        mine = np.flatnonzero(power == k)
        out[mine] = np.minimum(table[start[mine]], table[stop[mine] - (1 << k)])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


_NODE = "shard int, node string, first boolean, last boolean, conv_id long, depth int, up string, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, leaf long, bytes long"


class Shard:
    """The trie of distinct conversations in ascending order of their keys."""

    def __init__(self, keys: list[str], sizes: list[np.ndarray]):
        lengths = np.array([len(k) // DIGITS for k in keys])
        common = np.zeros(len(keys), np.int64)
        for i in range(1, len(keys)):
            common[i] = _shared(keys[i - 1], keys[i])
        fresh = lengths - common
        fresh[0] += 1  # the root
        #: of each node: its conversation, depth, and bytes of its last text
        self.conv = np.repeat(np.arange(len(keys)), fresh)
        first = np.concatenate(([0], np.cumsum(fresh)[:-1]))
        self.depth = np.arange(fresh.sum()) - np.repeat(first, fresh) + np.repeat(common + 1, fresh)
        self.depth[: fresh[0]] -= 1
        flat = np.concatenate([np.zeros(0, np.int64), *sizes])
        base = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        at = base[self.conv] + self.depth - 1
        self.bytes = np.where(self.depth > 0, flat[np.maximum(at, 0)] if len(flat) else 0, 0)
        # up from the predecessor's end to the common prefix, down to the own end; at last up to above the root
        ups = np.append(lengths[:-1] - common[1:], lengths[-1] + 1)
        runs = np.stack((fresh, ups), 1).ravel()
        self.tree = Parentheses(np.repeat(np.tile([True, False], len(keys)), runs))
        self.ends = np.cumsum(fresh) - 1  # a distinct conversation always opens the node it ends at
        self.lengths, self.keys = lengths, keys

    def parents(self) -> np.ndarray:
        """The node above each: the last one before it that is one less deep; -1 for the root."""
        n = len(self.depth)
        order = np.argsort(self.depth, kind="stable")
        mark = self.depth[order] * n + order
        return np.where(self.depth > 0, order[np.searchsorted(mark, (self.depth - 1) * n + np.arange(n)) - 1], -1)

    def rows(self, shard: int, weights: np.ndarray, least: np.ndarray, ends: list[str]) -> pa.RecordBatch:
        tree, n = self.tree, len(self.depth)
        at = np.flatnonzero(tree.bits)
        stop = tree.opens[tree.findclose(at)]  # nodes opened before the subtree ends
        members = np.zeros(n, np.int64)
        members[self.ends] = weights
        smallest = np.full(n, np.iinfo(np.int64).max)
        smallest[self.ends] = least
        begin = np.arange(n)
        total = np.concatenate(([0], np.cumsum(members)))
        n_convs = total[stop] - total[begin]
        saved = np.concatenate(([0], np.cumsum((n_convs - 1) * self.bytes)))
        conv_id = range_minima(smallest, begin, stop)
        parent = self.parents()
        children = np.bincount(parent[1:], minlength=n)
        leaves = tree.leaves[tree.findclose(at)] - tree.leaves[at]
        # the spines: nodes of the first conversation's path and of the last one's
        first = np.zeros(n, bool)
        first[: self.lengths[0] + 1] = True
        last = np.zeros(n, bool)
        last[stop == n] = True
        names = np.full(n, None, object)
        for spine, key in ((first, self.keys[0]), (last, self.keys[-1])):
            state = hashlib.sha256()
            for d, node in enumerate(np.flatnonzero(spine)):
                if d:
                    state.update(key[(d - 1) * DIGITS : d * DIGITS].encode())
                names[node] = state.hexdigest()
        sha = np.full(n, EMPTY, object)
        sha[self.ends] = ends
        up = np.where(parent >= 0, names[parent], None)
        columns = [
            pa.array(np.full(n, shard), pa.int32()), pa.array(names, pa.string()), pa.array(first), pa.array(last), pa.array(conv_id), pa.array(self.depth, pa.int32()),
            pa.array(up, pa.string()), pa.array(conv_id[parent], mask=parent < 0), pa.array(n_convs), pa.array(children), pa.array(leaves),
            pa.array(saved[stop] - saved[begin]), pa.array(sha, pa.string()), pa.array((children == 0).astype(np.int64)), pa.array(self.bytes),
        ]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _NODE.split(", ")])


def _shared(a: str, b: str) -> int:
    """Turns that two keys have in common at their start."""
    low, high = 0, min(len(a), len(b)) // DIGITS
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * DIGITS : mid * DIGITS] == b[low * DIGITS : mid * DIGITS]:
            low = mid
        else:
            high = mid - 1
    return low


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct conversations of one shard in order (key, sizes, convs, least, ends, shard) to its nodes."""
    keys, sizes, weights, least, ends, shard = [], [], [], [], [], 0
    for batch in batches:
        keys += batch.column(0).to_pylist()
        sizes += [np.asarray(x.values, dtype=np.int64) for x in batch.column(1)]
        weights += batch.column(2).to_pylist()
        least += batch.column(3).to_pylist()
        ends += batch.column(4).to_pylist()
        shard = batch.column(5)[0].as_py() if batch.num_rows else shard
    if keys:
        out = Shard(keys, sizes).rows(shard, np.array(weights), np.array(least), ends)
        for at in range(0, out.num_rows, 4096):
            yield out.slice(at, 4096)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, joined ids) in order of name and ids to the digest of all ids of a name."""
    name, state = None, None
    for batch in batches:
        done = []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != name:
                if state is not None:
                    done.append((name, state.hexdigest()))
                name, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_pydict({"name": [x[0] for x in done], "ends_sha256": [x[1] for x in done]})
    if state is not None:
        yield pa.RecordBatch.from_pydict({"name": [name], "ends_sha256": [state.hexdigest()]})


def strings(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the turns of each conversation in order, as structs of digest and bytes.

    Null turns come first, a null role or text is empty, equal turns are ordered by digest.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).substr(1, DIGITS)
    # of struct fields null is the least, so null turns are first
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).alias("bytes")).alias("t"))
    out = rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return out.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(turns: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """Each conversation after its head, of at most ``most`` turns, gave way to that of its group's first one."""
    head = F.col("conv_id") - F.col("conv_id") % group
    heads = turns.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    joined = turns.withColumn("head_id", head).withColumn("h", h).join(heads, "head_id", "left")
    taken = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return joined.select("conv_id", F.concat(taken, own).alias("turns"))


def trie(conversations: DataFrame, shard_turns: int | None = None) -> DataFrame:
    """One row per node of the prefix trie of conversations (conv_id, turns of digest and bytes).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the
    subtree, members less one times bytes of the last text) and ends_sha256 (of the members that end here).
    Turns are told apart by 128-bit digests. A shard holds about ``shard_turns`` turns of distinct
    conversations; texts are not in it. A conversation's digests lie in one row.
    """
    spark = conversations.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    space = Workspace(spark)
    keyed = conversations.select("conv_id", F.array_join(F.col("turns.digest"), "").alias("key"), F.col("turns.bytes").alias("sizes"))
    keyed = space.keep(keyed.withColumn("name", F.sha2("key", 256)), "strings")
    part = F.floor(F.col("conv_id") / F.lit(SPAN))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    lists = keyed.groupBy("name", part.alias("part")).agg(ids.alias("ids"))
    lists = lists.repartition("name").sortWithinPartitions("name", "part").select("name", "ids").mapInArrow(_digests, "name string, ends_sha256 string")
    distinct = keyed.groupBy("name", "key", "sizes").agg(F.count("*").alias("convs"), F.min("conv_id").alias("least")).join(lists, "name")
    distinct = space.keep(distinct.drop("name"), "distinct")
    turns = distinct.agg(F.coalesce(F.sum(F.size("sizes") + 1), F.lit(0))).first()[0]
    shards = max(1, -(-turns // (shard_turns or SHARD_TURNS)))
    ordered = distinct.select("key", "sizes", "convs", "least", "ends_sha256").repartitionByRange(shards, "key").sortWithinPartitions("key")
    nodes = space.keep(ordered.withColumn("shard", F.spark_partition_id()).mapInArrow(_sharded, _NODE), "nodes")
    spines = space.keep(merged(nodes.where("node is not null")), "spines")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = spines.select(F.col("node").alias("up"), F.col("conv_id").alias("up_conv_id"))
    inner = nodes.where("node is null").join(above, "up", "left").withColumn("parent_conv_id", F.coalesce("up_conv_id", "parent_conv_id"))
    return inner.select(*columns).unionByName(spines.join(above, "up", "left").withColumn("parent_conv_id", F.col("up_conv_id")).select(*columns))


def merged(copies: DataFrame) -> DataFrame:
    """Spine nodes of all shards, one row each: node, up, conv_id, depth and the node's columns."""
    ends = F.max(F.when(F.col("ends_sha256") != EMPTY, F.col("ends_sha256")))
    total = copies.groupBy("node").agg(
        F.first("up", True).alias("up"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.coalesce(ends, F.lit(EMPTY)).alias("ends_sha256"),
        F.sum("leaf").alias("leaf"), F.min("leaf").alias("true_leaf"), F.count("*").alias("copies"), F.first("bytes").alias("bytes"), F.min("shard").alias("shard"),
    )
    # children in several shards were counted in each
    twice = total.where("copies > 1").groupBy(F.col("up").alias("node")).agg(F.sum(F.col("copies") - 1).alias("twice"))
    # each node's own correction is laid on one spine, and every node above it on that spine has it too
    sides = copies.select("node", "shard", "depth", F.explode(F.array_compact(F.array(F.when(F.col("first"), F.lit("first")), F.when(F.col("last"), F.lit("last"))))).alias("side"))
    home = sides.groupBy("node").agg(F.min(F.struct("shard", "side")).alias("home"))
    own = total.select("node", (F.col("true_leaf") - F.col("leaf")).alias("own_leaf"), ((F.col("copies") - 1) * F.col("bytes")).alias("own_saved"))
    laid = sides.join(home, "node").join(own, "node").withColumn("here", F.col("home") == F.struct("shard", "side"))
    below = Window.partitionBy("shard", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    reach = laid.select("node", *(F.sum(F.when(F.col("here"), F.col(c)).otherwise(0)).over(below).alias(c) for c in ("own_leaf", "own_saved")))
    reach = reach.groupBy("node").agg(F.sum("own_leaf").alias("more_leaves"), F.sum("own_saved").alias("more_saved"))
    out = total.join(twice, "node", "left").join(reach, "node", "left")
    return out.select(
        "node", "up", "conv_id", "depth", "n_convs", (F.col("n_children") - F.coalesce("twice", F.lit(0))).alias("n_children"),
        (F.col("n_leaves") + F.col("more_leaves")).alias("n_leaves"), (F.col("saved_tokens") + F.col("more_saved")).alias("saved_tokens"), "ends_sha256",
    )


def prefix_trie(conversations: DataFrame, shard_turns: int | None = None) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text).

    Conversation c begins with the first ``crc32(c) % 9`` turns of conversation ``c - c % 5`` (fewer if it has
    fewer, none if it is absent; % as in SQL), then come its own turns after as many. Null turns are first, null roles
    and texts are empty, equal turns are ordered by digest and repeated rows are turns of their own. Rows
    without conv_id belong to no conversation. Other columns are ignored; no rows give no nodes.
    """
    return trie(rebuilt(strings(conversations)), shard_turns)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op13: all nodes of the prefix trie."""
    out = prefix_trie(spark.read.parquet(f"{folder}/conversations.parquet"))
    return out.withColumn("depth", F.col("depth").cast("long"))


ORACLE = """
with recursive turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i,
    coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), convs as (
  select distinct conv_id, conv_id - conv_id % 5 as head,
    xor(list_reduce([4294967295::ubigint] || list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::ubigint), lambda acc, b:
      list_reduce([xor(acc, b)] || list_value(0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint), lambda c, z:
        case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end)), 4294967295::ubigint) % 9 as h from turns
), parts as (
  select c.conv_id, t.role, t.text, 0 as own, i from convs c join turns t on t.conv_id = c.head and t.i <= c.h
  union all select c.conv_id, t.role, t.text, 1, i from convs c join turns t on t.conv_id = c.conv_id and t.i > c.h
), strings as (
  select c.conv_id, coalesce(list({'r': role, 't': text} order by own, i) filter (p.conv_id is not null), []) as s
  from convs c left join parts p using (conv_id) group by c.conv_id
), steps as (
  select conv_id, s, 0 as d, sha256('') as id, null::varchar as up from strings
  union all
  select conv_id, s, d + 1, sha256(id || length(s[d + 1].r)::varchar || ':' || s[d + 1].r || s[d + 1].t), id from steps where d < len(s)
), nodes as (
  select id, any_value(up) as up, min(conv_id) as conv_id, any_value(d) as depth, count(*) as n_convs, any_value(case when d > 0 then strlen(s[d].t) else 0 end) as bytes,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len(s) = d), '')) as ends_sha256, bool_and(len(s) = d) as leaf from steps group by id
), paths as (
  select id, id as above from nodes union all select p.id, n.up from paths p join nodes n on n.id = p.above where n.up is not null
), subtrees as (
  select above as id, count(*) filter (n.leaf) as n_leaves, cast(sum((n_convs - 1) * bytes) as bigint) as saved_tokens from paths join nodes n using (id) group by above
), children as (select up as id, count(*) as n_children from nodes where up is not null group by up)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens, n.ends_sha256
from nodes n left join nodes p on p.id = n.up left join children c on c.id = n.id join subtrees s on s.id = n.id
"""
