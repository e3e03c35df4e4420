"""Line dedup by a segment-partition edit join, all of it in column expressions and joins.

A line of length l is cut into ``edits + 1`` segments; a line within ``edits`` of it holds one of them
unchanged, near its place. Each line is indexed by its segments, and probes the indexes of its own and
of the slightly smaller lengths with its substrings at the places that can match. Candidates are
verified by a banded edit distance whose rows are bits of one long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from songframe.llm.storage import Workspace

EDITS = 2
#: Characters from which a line is compared with others by edits; shorter ones only as a whole.
LEAST_CHARS = 20
#: Copies of a line above which only its first occurrence is indexed; others are merely dropped earlier.
HOT_COPIES = 1000

#: The characters that are counted; all others only enter the length.
_COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789 "

_BLANK = "[^ \\t\\n\\x0B\\f\\r]"


def _key(less: int, i: int, shift: int, edits: int) -> str:
    """Hash of a piece of ``line`` as segment ``i`` (from 1) of a line that is ``less`` shorter, ``shift`` from its
    place there; later segments take the rest. In lines of one-byte characters it is cut out of the bytes,
    which needs no walk from the line's start."""
    n = edits + 1  # a remainder is below n, so the first segments need fewer terms
    start = f"{i - 1} * b{less} + {1 + shift}" if i > 1 else f"{1 + shift}"
    start += f" + greatest(r{less} - {n - i + 1}, 0)" if i > 2 else ""
    start = f"greatest({start}, 1)" if shift < 0 else start
    size = f"b{less} + if(r{less} > {n - i}, 1, 0)" if i > 1 else f"b{less}"
    return f"xxhash64(m{less}, {i}, if(narrow, substring(bytes, {start}, {size}), cast(substring(line, {start}, {size}) as binary)))"


def segment_keys(rows: DataFrame, edits: int) -> DataFrame:
    """``h``, ``key`` and ``own`` of rows with h, line and its length n: a line's own segments, and its other
    substrings that can be a segment of a line up to ``edits`` shorter.

    Lengths are divided once, ahead of the keys: the code of all keys has to stay below 8,000 bytes, or
    else the virtual machine does not compile it.
    """
    own, other = [], []
    for less in range(edits + 1):
        for i in range(1, edits + 2):
            low, high = max(-(i - 1), less - (edits + 1 - i)), min(i - 1, less + (edits + 1 - i))
            for shift in range(low, high + 1):
                (other if less or shift else own).append(_key(less, i, shift, edits))
    known = {"bytes": "cast(line as binary)", "narrow": "octet_length(line) = n"}
    for less in range(edits + 1):
        known |= {f"m{less}": f"n - {less}", f"b{less}": f"cast((n - {less}) div {edits + 1} as int)", f"r{less}": f"(n - {less}) % {edits + 1}"}
    keys = F.array(*map(F.expr, own + other))
    return _fixed(rows, **known).select("h", F.posexplode(keys).alias("at", "key")).select("h", "key", (F.col("at") <= edits).alias("own"))


def _common(a: str, b: str, most: str) -> str:
    """Length of the common prefix of two columns, at most ``most``: doubling steps, then halving ones."""
    step = "cast(shiftleft(1L, k) as int)"
    ask = f"p + {step} <= {most} and substring({a}, p + 1, {step}) = substring({b}, p + 1, {step})"
    return f"aggregate(sequence(24, 0, -1), 0, (p, k) -> if({ask}, p + {step}, p))"


def _fixed(rows: DataFrame, **columns: str) -> DataFrame:
    """``rows`` with columns that are computed once: the optimiser moves no expression over a generator,
    where it would put plain columns into each place that uses them, lambdas included."""
    return rows.select("*", F.inline(F.array(F.struct(*[F.expr(value).alias(name) for name, value in columns.items()]))))


def within(pairs: DataFrame, edits: int) -> DataFrame:
    """The rows of ``pairs`` whose strings a and b are at most ``edits`` apart, characters as units.

    Common ends are cut off. Then column j of the table of distances holds, in 2 * edits + 1 bits
    around the diagonal, where it grows and where it falls from row to row (vp, vn); the distance is
    followed along the lowest diagonal of the band, and along the last row once that is reached.
    """
    k, width = edits, 2 * edits + 1
    mask = (1 << width) - 1
    pad = "x" * k  # the same at both ends changes no distance, and makes the band fit
    rows = pairs.where(f"abs(char_length(a) - char_length(b)) <= {k}")
    rows = _fixed(rows, _q="least(char_length(a), char_length(b))")
    rows = _fixed(rows, _p=_common("a", "b", "_q"))
    rows = _fixed(rows, _ra="reverse(substring(a, _p + 1))", _rb="reverse(substring(b, _p + 1))")
    rows = _fixed(rows, _s=_common("_ra", "_rb", "(_q - _p)"))
    rows = _fixed(rows, _x=f"concat(substring(_ra, _s + 1), '{pad}')", _y=f"concat(substring(_rb, _s + 1), '{pad}')")
    rows = _fixed(rows, _m="char_length(_x)", _n="char_length(_y)")
    row = lambda t: f"(j + {t - k})"
    hit = " | ".join(
        f"if({row(t)} between 1 and _m and substring(_x, {row(t)}, 1) = substring(_y, j, 1), {1 << t}L, 0L)" for t in range(width)
    )
    # one step: pm -> d0 -> hp, hn -> the next vp, vn and the distance
    d0 = f"((((pm & s.vp) + s.vp) ^ s.vp) | pm | s.vn) & {mask}L"
    hp, hn = f"(s.vn | ~(d0 | s.vp)) & {mask}L", "d0 & s.vp"
    low = f"if(j <= _m - {k}, if(d0 & {1 << (2 * k)}L = 0, 1, 0), bit_get_or(hp) - bit_get_or(hn))"
    at = f"cast(_m - j + {k} as int)"
    low = low.replace("bit_get_or(hp)", f"cast(shiftright(hp, {at}) & 1L as int)").replace("bit_get_or(hn)", f"cast(shiftright(hn, {at}) & 1L as int)")

    def let(name: str, value: str, body: str) -> str:
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    state = f"named_struct('vp', (hn | ~(shiftright(d0, 1) | hp)) & {mask}L, 'vn', shiftright(d0, 1) & hp, 'd', s.d + {low})"
    body = let("pm", hit, let("d0", d0, let("hp", hp, let("hn", hn, state))))
    start = f"named_struct('vp', {((1 << (k + 1)) - 1) << k}L, 'vn', 0L, 'd', {k})"
    step = f"if(s.d > {2 * k} + _n - _m, s, {body})"
    distance = f"aggregate(sequence(1, _n), {start}, (s, j) -> {step}, s -> s.d)"
    rows = _fixed(rows, _d=distance).where(f"_d <= {k}")
    return rows.drop("_q", "_p", "_ra", "_rb", "_s", "_x", "_y", "_m", "_n", "_d")


def _counts(line: str) -> Column:
    """How often each letter, digit and the blank occur in a line, as an array."""
    low = F.lower(line)
    return F.array(*[F.char_length(low) - F.char_length(F.replace(low, F.lit(c))) for c in _COUNTED])


def _counts_apart(x: str, y: str, edits: int) -> str:
    """Whether two arrays of counts leave it open that their lines are at most ``edits`` apart: an edit
    takes one from a count and adds one to another, so no pair within the distance is lost."""
    return " + ".join(f"abs({x}[{i}] - {y}[{i}])" for i in range(len(_COUNTED))) + f" <= {2 * edits}"


def _near(index: DataFrame, probes: DataFrame, texts: DataFrame, edits: int, space: Workspace) -> DataFrame:
    """h and g of the lines that have an earlier line at most ``edits`` apart.

    ``index(key, h)`` and ``probes(key, h)`` meet in keys. First each line is held against the earliest line
    that its keys index, and the earliest that probes them. In a group of lines that are all near each
    other that settles nearly all of them. The rest are held against all earlier lines of their keys in the
    join, which gives out only pairs that their counts of characters leave open.
    """
    known = texts.select("h", "g", "first", "n")
    sides = [space.keep(side.join(known, "h"), "side") for side in (index, probes)]

    def verified(pairs: list[DataFrame]) -> DataFrame:
        distinct = space.keep(pairs[0].union(pairs[1]).where(f"abs(n - m_n) <= {edits}").select("h", "g", "m_h", "m_g").distinct(), "pairs")
        early = texts.select("h", "g", F.col("line").alias("a"))
        late = texts.select(F.col("h").alias("m_h"), F.col("g").alias("m_g"), F.col("line").alias("b"))
        links = within(distinct.join(early, ["h", "g"]).join(late, ["m_h", "m_g"]), edits)
        return space.keep(links.select(F.col("m_h").alias("h"), F.col("m_g").alias("g")).distinct(), "near")

    later = lambda side: side.toDF(*["key" if x == "key" else f"m_{x}" for x in side.columns])
    met = []
    for own, other in (sides, sides[::-1]):
        heads = other.groupBy("key").agg(F.min(F.struct("first", "h", "g", "n")).alias("head")).select("key", "head.*")
        met.append(later(own).join(heads, "key").where("first < m_first"))
    settled = verified(met)
    met, counts = [], space.keep(texts.select("h", "g", _counts("line").alias("counts")), "counts")
    for own, other in (sides, sides[::-1]):
        own = space.keep(own.join(settled, ["h", "g"], "left_anti"), "rest").join(counts, ["h", "g"])
        other = other.join(own.select("key").distinct(), "key", "left_semi").join(counts, ["h", "g"])
        met.append(later(own).join(other, "key").where("first < m_first").where(_counts_apart("counts", "m_counts", edits)))
    return settled.union(verified(met))


def _bucketed(docs: DataFrame, space: Workspace) -> DataFrame:
    """``docs`` in a table of buckets by row key, so that no later join moves the texts again."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"songframe_lines_{uuid.uuid4().hex}"
    spread = docs.repartition(n, "_doc", "_th")
    spread.write.bucketBy(n, "_doc", "_th").option("path", space.folder("documents")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def dedup(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and the struct ``lines``: n, removed, near.

    A line is what stands between line feeds. A line with a word is removed where an equal line occurs
    earlier, by doc_id and then place, and where its first occurrence comes after that of another line
    at most ``edits`` apart (lines of ``least`` characters and more). Lines without a word stay. Every
    comparison is made on the input. ``n`` counts lines with a word, ``removed`` those taken out,
    ``near`` those of them whose line goes because of another line. A null text stays null and an empty
    one empty, with counts of 0; a null id comes last. Rows that share id and text are one document,
    and are all treated alike. A column ``lines`` is replaced, other columns pass through. No rows give
    none.
    """
    spark = docs.sparkSession
    space = Workspace(spark)
    docs = docs.drop("lines")
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    body = f"c{names.index(text)}"
    own = own.withColumns({"_doc": F.coalesce(F.col(f"c{names.index(doc_id)}").cast("long"), F.lit((1 << 63) - 1)), "_th": F.xxhash64(body)})
    table = _bucketed(own, space)

    # distinct by row key: rows that share id and text count once, since first places don't tell them apart
    lines = table.select("_doc", "_th", F.posexplode(F.split(body, "\n")).alias("no", "line")).where(F.col("line").rlike(_BLANK))
    lines = lines.withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(1), "line"), "n": F.char_length("line")})
    place = F.struct("_doc", "_th", "no")
    found = space.keep(lines.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n")), "found")

    # a table of its own, whose size Spark sees before it plans the join, so that the lines' texts need not move
    hot = space.keep(found.where(F.col("copies") > HOT_COPIES).select(F.col("h").alias("hh"), F.col("g").alias("hg"), "first").coalesce(8), "hot")
    long = lines.where(F.col("n") >= least).join(hot, F.expr("h = hh and g = hg"), "left").where(F.col("first").isNull() | (F.col("first") == place))
    # a window sees all rows of a key, so every line is cut up and dealt out once
    keyed = segment_keys(long.select("h", "n", "line"), edits)
    of_key = Window.partitionBy("key")
    indexed = F.when(F.col("own"), F.col("h"))
    ends = {"low": F.min(indexed), "high": F.max(indexed), "least": F.min("h"), "most": F.max("h")}
    met = keyed.select("key", "h", "own", *[x.over(of_key).alias(name) for name, x in ends.items()])
    # keys in which different lines meet, one of them indexed; the others end here
    met = met.where("low is not null and least <> most").select("key", "h", "own", F.expr("low <> h or high <> h").alias("probes")).distinct()
    met = space.keep(met, "met")
    index, probes = (met.where(side).select("key", "h").distinct() for side in ("own", "probes"))

    wanted = index.select("h").union(probes.select("h")).distinct()
    wanted = found.join(wanted, "h").select("h", "g", "n", "first.*")
    texts = table.join(wanted, ["_doc", "_th"]).select("h", "g", "n", F.struct("_doc", "_th", "no").alias("first"), F.element_at(F.split(body, "\n"), F.col("no") + 1).alias("line"))
    texts = space.keep(texts.dropDuplicates(["h", "g"]), "texts")
    near = _near(index, probes, texts, edits, space).withColumn("near", F.lit(True))

    gone = found.join(near, ["h", "g"], "left").where("copies > 1 or near").select("h", "g", "first", F.coalesce("near", F.lit(False)).alias("near"))
    places = lines.select("h", "g", "_doc", "_th", "no").join(gone, ["h", "g"]).where(F.col("near") | (F.col("first") != place))
    removed = places.distinct().groupBy("_doc", "_th").agg(F.collect_list("no").alias("gone"), F.sum(F.col("near").cast("long")).alias("near"))
    out = table.join(removed, ["_doc", "_th"], "left")
    pieces = F.split(body, "\n")
    stays = F.array_join(F.filter(pieces, lambda x, i: ~F.array_contains("gone", i)), "\n")
    counts = F.struct(
        F.coalesce(F.size(F.filter(pieces, lambda x: x.rlike(_BLANK))).cast("long"), F.lit(0)).alias("n"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("removed"),
        F.coalesce("near", F.lit(0)).cast("long").alias("near"),
    )
    counts = F.when(F.col(body).isNull(), F.struct(*[F.lit(0).cast("long").alias(x) for x in ("n", "removed", "near")])).otherwise(counts)
    out = out.withColumns({"lines": counts, body: F.when(F.col("gone").isNull(), F.col(body)).otherwise(stays)})
    return out.select(*[f"c{i}" for i in range(len(names))], "lines").toDF(*names, "lines")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated lines taken out, with their own columns only."""
    spare = "lines" in docs.columns
    out = dedup(docs.withColumnRenamed("lines", "_songframe_lines") if spare else docs).drop("lines")
    return out.withColumnRenamed("_songframe_lines", "lines") if spare else out


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op3: lines of every document, those taken out, and a digest of the text left."""
    out = dedup(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("lines.n").alias("n_lines"), F.col("lines.removed").alias("n_removed"), F.col("lines.near").alias("n_near"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


ORACLE = rf"""
WITH l AS (
  SELECT doc_id, i AS no, parts[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
w AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT line, min((doc_id, no)) AS first, count(*) AS c, length(line) AS n FROM w GROUP BY line),
near AS (
  SELECT DISTINCT b.line FROM f a JOIN f b ON b.n BETWEEN a.n - {EDITS} AND a.n + {EDITS}
  WHERE a.n >= {LEAST_CHARS} AND b.n >= {LEAST_CHARS} AND a.line <> b.line AND a.first < b.first
    AND abs(strlen(a.line) - strlen(b.line)) <= {4 * EDITS}
    AND levenshtein(a.line, b.line) <= {EDITS}),
m AS (
  SELECT w.doc_id, w.no, near.line IS NOT NULL AS is_near, near.line IS NOT NULL OR (w.doc_id, w.no) <> f.first AS gone
  FROM w JOIN f USING (line) LEFT JOIN near USING (line))
SELECT d.doc_id, coalesce(x.n, 0) AS n_lines, coalesce(x.removed, 0) AS n_removed, coalesce(x.near, 0) AS n_near,
       sha256(coalesce(x.kept, d.text, '')) AS text_sha256
FROM documents d LEFT JOIN (
  SELECT l.doc_id, count(m.no) AS n, count(*) FILTER (gone) AS removed, count(*) FILTER (is_near) AS near,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.no) FILTER (NOT coalesce(gone, FALSE)), '') AS kept
  FROM l LEFT JOIN m ON l.doc_id = m.doc_id AND l.no = m.no GROUP BY l.doc_id) x USING (doc_id)
"""
