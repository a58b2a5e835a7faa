"""Line dedup by a segment-partition edit join (DataFrame functions only).

Of ``max_edits + 1`` disjoint segments of a line one at least is left whole by ``max_edits`` edits. The
segments of a line have one size, set by a bucket of its length; the first half of them is placed from
the line's start, the rest from its end. A line is filed under (bucket, segment number, segment) and
probes, in its own bucket and in the one below if a partner may be in it, the substrings at the starts
that the number of edits on either side of a segment allows. Placing from both ends makes the starts
the same for all partner lengths of a bucket. Equal lines are one line throughout.

Keys carry one hash of the line. Lines that share a key meet in one equi-join, whose condition
holds parities of characters and of pairs of characters against what so many edits can change, and
verifies the pairs that pass, so it puts out links only. That takes a banded bit-parallel edit distance:
a column of the band is two words of bits, the vertical steps up and down, and a text character takes
a dozen word operations (``aggregate`` over bigint).

The earliest line, by (doc_id, line number), of each linked pair stays; the later one goes with its
distance. Lines of fewer than ``min_chars`` code points (``CHARS_PER_EDIT`` for each edit) are too short for an edit to be
noise: they go only where they are equal. Defined results: blank lines are no lines, so null, empty and blank
texts have none; a text or line of any length is taken whole; rows without doc_id rank last; equal ranks
(repeated rows) are one occurrence, and of links of one rank the smaller distance counts; an empty
table gives an empty result; columns of any name pass through ``remove_duplicates``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, drop, numbered, scratch, table

MAX_EDITS = 3
#: An edit takes so many code points of a line at least: with three, lines of 24 or more take part.
CHARS_PER_EDIT = 8
#: Up to this many 64-bit hashes are broadcast; more go through a shuffled join.
BROADCAST_ROWS = 1_000_000
#: Key expressions that are compiled together.
KEYS_AT_ONCE = 16


#: The lowest bits of h1 are free for a mark: filed or not, and the number of the segment.
MARK_BITS, MOST_EDITS = 4, 7
_MARK = (1 << MARK_BITS) - 1


def _h1(line: Column) -> Column:
    return F.xxhash64(line).bitwiseAND(F.lit(~_MARK).cast("long"))


def lines_of(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """doc_id, line_no, line (outer white space off), h1 and h2: the line's hashes."""
    space = F.lit(SPACE_CHARS)
    each = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "raw"))
    trimmed = each.select("doc_id", "line_no", F.btrim("raw", space).alias("line")).where(F.char_length("line") >= min_chars)
    return trimmed.withColumns({"h1": _h1(F.col("line")), "h2": F.xxhash64(F.lit(1), "line")})


def _keys(max_edits: int) -> list[tuple[Column, int, bool]]:
    """(key, segment, filed): keys a line is filed under, and keys of segments of other lines that its
    substrings could be (null where there is none). Plain expressions without lambdas, so that they are compiled."""
    n, parts = F.char_length("line"), max_edits + 1
    width, left = 2 * parts, (parts + 1) // 2
    own, out = F.floor(n / width).cast("int"), []
    below = F.when(F.floor((n - max_edits) / width) < own, own - 1)
    for bucket, same in ((own, True), (below, False)):
        size = bucket * 2
        for i in range(parts):
            shifts = range(-min(i, max_edits - i), (i if i < left else max_edits - i) + 1)
            for shift in shifts:
                start = size * i + shift if i < left else n - size * (parts - i) - shift
                key = F.xxhash64(bucket, F.lit(i), F.col("line").substr(start + 1, size))
                filed = same and shift == 0
                able = bucket.isNotNull() & (bucket >= 0) & (start >= 0) & (start + size <= n)
                out.append((key if filed else F.when(able, key), i, filed))
    return out


def _points(line: str) -> str:
    return f"transform(split({line}, ''), c -> ascii(c))"


#: Parities of how often characters, and pairs of adjacent ones, occur, by 64 classes of either.
_SINGLES = "aggregate(_p, 0L, (m, c) -> m ^ shiftleft(1L, c & 63))"
_DOUBLES = "aggregate(transform(_p, (c, i) -> (coalesce(get(_p, i - 1), 0) * 31 + c) & 63), 0L, (m, c) -> m ^ shiftleft(1L, c))"


def _distance(a: str, b: str, most: int) -> str:
    """Edit distance of two array<int> columns whose sizes differ by at most ``most`` and are not below
    it; exact up to ``most``, larger than that beyond.

    Bit t of a word belongs to row j - most + t of column j: the band of rows that can matter.
    """
    band, bottom = (1 << (2 * most + 1)) - 1, 2 * most
    same = " + ".join(f"if(get({a}, j - {most + 1} + {t}) = get({b}, j - 1), {1 << t}L, 0L)" for t in range(2 * most + 1))
    columns = f"transform(sequence(1, size({b})), j -> struct({same} AS x, j AS j))"
    diagonal = f"((((c.x & s.vp) + s.vp) ^ s.vp) | c.x | s.vn) & {band}L"
    up = f"((s.vn | ~(d | s.vp)) & {band}L)"
    row = f"size({a}) - c.j + {most}"
    # down the lower edge of the band to the last row, then along that row
    step = f"if(row >= {bottom}, 1L - (shiftright(d, {bottom}) & 1L), (shiftright({up}, row) & 1L) - (shiftright(d & s.vp, row) & 1L))".replace("row", f"({row})")
    state = f"named_struct('vp', ((d & s.vp) | ~(shiftright(d, 1) | {up})) & {band}L, 'vn', shiftright(d, 1) & {up}, 'dist', s.dist + {step})"
    first = f"named_struct('vp', {band ^ ((1 << most) - 1)}L, 'vn', 0L, 'dist', {most}L)"
    return f"aggregate({columns}, {first}, (s, c) -> element_at(transform(array({diagonal}), d -> {state}), 1)).dist"


def edit_distance(a: str, b: str, most: int) -> Column:
    return F.expr(_distance(a, b, most)).cast("int")


def near_lines(docs: DataFrame, *, max_edits: int = MAX_EDITS, min_chars: int | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs of different lines within ``max_edits``: (a1, a2) and (b1, b2) hashes, distance."""
    if not 1 <= max_edits <= MOST_EDITS:
        raise ValueError(f"max_edits must lie within 1 and {MOST_EDITS}")
    spark = docs.sparkSession
    # equal lines collapse before they get keys, so that keys are shuffled once
    lines = lines_of(docs, max(max_edits, CHARS_PER_EDIT * max_edits if min_chars is None else min_chars)).groupBy("h1", "h2").agg(F.first("line").alias("line"))
    lines = scratch(spark, lines, "lines")
    drop(spark)
    keys = _keys(max_edits)
    parts = []
    for at in range(0, len(keys), KEYS_AT_ONCE):
        some = keys[at : at + KEYS_AT_ONCE]
        flat = lines.select("h1", *[key.alias(f"k{i}") for i, (key, _, _) in enumerate(some)])
        rows = ", ".join(f"k{i}, h1 | {2 * segment + filed}L" for i, (_, segment, filed) in enumerate(some))
        parts.append(flat.selectExpr(f"stack({len(some)}, {rows}) AS (key, marked)"))
    keyed = reduce(DataFrame.unionAll, parts).where("key IS NOT NULL")
    w = Window.partitionBy("key")
    line, mark = F.col("marked").bitwiseAND(F.lit(~_MARK).cast("long")), F.col("marked").bitwiseAND(F.lit(_MARK).cast("long")).cast("int")
    filed = mark % 2 == 1
    # a key needs a filed line and another one
    met = keyed.select("key", line.alias("h1"), filed.alias("filed"), F.floor(mark / 2).cast("int").alias("segment"), F.min(line).over(w).alias("lo"), F.max(line).over(w).alias("hi"), F.max(filed).over(w).alias("any"))
    met = scratch(spark, met.where("lo <> hi AND any").select("key", "h1", "filed", "segment"), "line-keys")
    del keyed, parts
    drop(spark)
    wanted = scratch(spark, met.select("h1").distinct(), "lines-wanted")
    small = wanted.count() <= broadcast_rows
    marked = lines.join(F.broadcast(wanted) if small else wanted, "h1").withColumn("_p", F.expr(_points("line")))
    texts = scratch(spark, marked.select("h1", "h2", "line", F.size("_p").alias("n"), F.expr(_SINGLES).alias("singles"), F.expr(_DOUBLES).alias("doubles"), F.array(*[key for key, _, own in keys if own]).alias("own")), "lines-met")
    drop(spark, lines, wanted)
    rows = met.join(texts, "h1")
    a = rows.where("filed").select("key", F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("n").alias("an"), F.col("singles").alias("as"), F.col("doubles").alias("ad"), F.col("own").alias("ak"), "segment", F.col("line").alias("a_line"))
    b = rows.select("key", F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("n").alias("bn"), F.col("singles").alias("bs"), F.col("doubles").alias("bd"), F.col("own").alias("bk"), F.col("filed").alias("b_filed"), F.col("line").alias("b_line"))
    # two filed lines of one key meet once
    once = ~F.col("b_filed") | (F.struct("a1", "a2") < F.struct("b1", "b2"))
    able = (F.abs(F.col("an") - F.col("bn")) <= max_edits) & (F.bit_count(F.col("as").bitwiseXOR(F.col("bs"))) <= 2 * max_edits) & (F.bit_count(F.col("ad").bitwiseXOR(F.col("bd"))) <= 4 * max_edits)
    # a pair that has an earlier segment in common, in place, has been put out there
    earlier = F.lit(False)
    for i in range(max_edits):
        earlier |= (F.col("segment") > i) & (F.get("ak", F.lit(i)) == F.get("bk", F.lit(i)))
    # last, as it costs most: code points are made once a pair
    near = F.expr(f"element_at(transform(array(named_struct('a', {_points('a_line')}, 'b', {_points('b_line')})), p -> {_distance('p.a', 'p.b', max_edits)}), 1)") <= max_edits
    pairs = a.join(b, (a["key"] == b["key"]) & once & able & ~earlier & ((F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2"))) & near)
    low = F.struct("a1", "a2") < F.struct("b1", "b2")
    ends = [F.when(low, F.col(f"a{i}")).otherwise(F.col(f"b{i}")).alias(f"a{i}") for i in (1, 2)] + [F.when(low, F.col(f"b{i}")).otherwise(F.col(f"a{i}")).alias(f"b{i}") for i in (1, 2)]
    pairs = scratch(spark, pairs.select(*ends).distinct(), "line-pairs")
    for side in "ab":
        own = texts.select(F.col("h1").alias(f"{side}1"), F.col("h2").alias(f"{side}2"), F.col("line").alias(f"{side}_line"))
        pairs = pairs.join(own, [f"{side}1", f"{side}2"])
    near = pairs.select("a1", "a2", "b1", "b2", F.expr(_points("a_line")).alias("a"), F.expr(_points("b_line")).alias("b"))
    near = near.select("a1", "a2", "b1", "b2", F.inline(F.array(F.struct(edit_distance("a", "b", max_edits).alias("distance")))))
    return scratch(spark, near.where(F.col("distance") <= max_edits), "line-links")


#: Ranks are doc_id * 2**32 + line number; rows without doc_id come after all others.
_LINES, _LAST_ID = "4294967296BD", "9223372036854775808BD"


def _named(rank: Column) -> tuple[Column, Column]:
    """doc_id and line number of a rank."""
    id_ = F.floor(rank / F.expr(_LINES))
    return F.when(id_ < F.expr(_LAST_ID), id_.cast("long")), (rank - id_ * F.expr(_LINES)).cast("int")


def _occurrences(docs: DataFrame, max_edits: int, min_chars: int | None) -> DataFrame:
    """What ``duplicates`` returns, and h1, the hash of the line that goes."""
    spark = docs.sparkSession
    rank = F.expr(f"CAST(coalesce(CAST(doc_id AS decimal(20,0)), {_LAST_ID}) * {_LINES} + line_no AS decimal(38,0))")
    every = scratch(spark, lines_of(docs).select(rank.alias("rank"), "h1", "h2"), "line-ranks")
    first = every.groupBy("h1", "h2").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    links = near_lines(docs, max_edits=max_edits, min_chars=min_chars)
    linked = scratch(spark, links.select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).unionAll(links.select("b1", "b2")).distinct(), "lines-linked")
    first = scratch(spark, first.join(linked.withColumn("_l", F.lit(True)), ["h1", "h2"], "left").where("first < last OR _l").drop("_l"), "line-first")
    a = first.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("first").alias("fa"))
    b = first.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("first").alias("fb"))
    ends = links.join(a, ["a1", "a2"]).join(b, ["b1", "b2"])
    later = F.when(F.col("fa") < F.col("fb"), F.struct(F.col("b1").alias("h1"), F.col("b2").alias("h2"), F.col("fa").alias("to"))).otherwise(F.struct(F.col("a1").alias("h1"), F.col("a2").alias("h2"), F.col("fb").alias("to")))
    near = ends.select(later.alias("x"), "distance").groupBy("x.h1", "x.h2").agg(F.min(F.struct("x.to", "distance")).alias("near"))
    # lines that go at all, repeated ones and later ones of a link, against all lines: the larger side's hot partitions can be split
    going = scratch(spark, first.join(near, ["h1", "h2"], "left").where("first < last OR near IS NOT NULL").select("h1", "h2", "first", "near"), "lines-going")
    found = every.join(going, ["h1", "h2"]).where("rank <> first OR near IS NOT NULL")
    id_, line_no = _named(F.col("rank"))
    to_id, to_line = _named(F.coalesce("near.to", "first"))
    return found.select(id_.alias("doc_id"), line_no.alias("line_no"), to_id.alias("first_doc_id"), to_line.alias("first_line_no"), F.coalesce("near.distance", F.lit(0)).alias("distance"), "h1")


def duplicates(docs: DataFrame, *, max_edits: int = MAX_EDITS, min_chars: int | None = None) -> DataFrame:
    """Occurrences to remove: doc_id, line_no, first_doc_id, first_line_no, distance.

    ``first`` is the earliest line equal or linked to this one that ranks before it.
    """
    return _occurrences(docs, max_edits, min_chars).drop("h1")


def remove_duplicates(docs: DataFrame, *, max_edits: int = MAX_EDITS, min_chars: int | None = None) -> DataFrame:
    """The documents without the lines that ``duplicates`` finds; other lines keep their white space.

    Lines are told by their hash too, so rows of one doc_id with different texts lose their own lines only.
    """
    rows, names = numbered(docs)
    id_, text = names["doc_id"], names["text"]
    found = _occurrences(docs.select("doc_id", "text"), max_edits, min_chars).select("doc_id", F.struct("line_no", "h1").alias("at"))
    gone = found.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_set("at").alias("_gone"))
    joined = rows.join(gone, F.col(id_).eqNullSafe(F.col("_d")), "left").withColumn("_n", F.col(text))

    def stays(line: Column, i: Column) -> Column:
        return ~F.array_contains("_gone", F.struct(i.alias("line_no"), _h1(F.btrim(line, F.lit(SPACE_CHARS))).alias("h1")))

    kept = F.array_join(F.filter(F.split("_n", "\n", -1), stays), "\n")
    whole = joined.withColumn(text, F.when(F.col("_gone").isNull(), F.col("_n")).otherwise(kept))
    return whole.select(*[F.col(f"c{i}") for i in range(len(docs.columns))]).toDF(*docs.columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
