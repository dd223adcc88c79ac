"""Fuzzy line dedup, with DataFrame operations alone.

Lines are normalised: lower case, and every run of other characters than letters and digits one
space. Each line gets a 64-bit SimHash of its distinct words, worked out in the row, cut into seven
blocks. Two SimHashes that differ in five bits at most agree in two blocks at least (pigeonhole);
of those that differ in more most do. Lines are joined on every pair of blocks; those with BITS
different bits at most are verified by edit similarity, and of each connected group of similar
lines the first occurrence stays.

A joined key does not emit all pairs of its lines. First each line is compared with the smallest
one of its keys of neighbouring blocks only; then keys whose lines all belong to one group are
settled, and in the others only lines of different groups are compared. Pairs within a group
cannot change the groups. The keys are joined in three turns, so that a third of them is shuffled
at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.columns import let
from souk.llm.components import components
from souk.llm.store import stored, written

BITS = 10
BLOCKS = tuple((9 * i, 9 if i < 6 else 10) for i in range(7))  # first bit, number of bits
WIDTHS = ((8, 127), (16, 32767), (32, 2**31 - 1))  # bits of a counter, words it can count
FEW = 100_000  # rows of a table that may be sent to every task; larger ones are shuffled
WANTED = 1_000_000  # the same for rows of a single number
PIECE, ANCHOR, LARGE = 64, 12, 256  # characters from one sought cut of a line to the next, compared at it, and of a stretch whose edits are counted


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"(?: [^\p{L}\p{N}]|[^\p{L}\p{N} ])[^\p{L}\p{N}]*", " "))  # but for single spaces


def _small(df: DataFrame, most: int = FEW) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _lines(own: DataFrame) -> DataFrame:
    """key, same, at, line, h1, h2 of every line that has a letter or digit."""
    rows = own.select("key", "same", F.posexplode(F.transform(F.split("text", "\n"), normalised)).alias("at", "line"))  # normalised once: no filter moves below
    return rows.where("line <> ''").withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), F.col("line"))})


def simhash(line: Column) -> Column:
    """A bit is 1 if it is set in the hashes of over half of the line's distinct words."""

    def voted(words: Column) -> Column:
        n, out = F.size(words), F.lit(None).cast("bigint")
        for width, most in reversed(WIDTHS):
            out = F.when(n <= most, _majority(words, width)).otherwise(out)
        return out

    return let(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), voted)


def _majority(words: Column, width: int) -> Column:
    """Counts of all 64 bits, 64 / width of them in each number; a count over half reaches its counter's top bit.

    What lifts it there is added less 2^63, whose bit is turned afterwards, so that no sum overflows.
    """
    ones = sum(1 << k for k in range(0, 64, width))
    top = ones << (width - 1)
    lane = lambda w, j: F.shiftrightunsigned(w, j).bitwiseAND(F.lit(ones))
    zero = F.struct(*[F.lit(0).cast("bigint").alias(f"c{j}") for j in range(width)])
    add = lambda x, w: F.struct(*[(x[f"c{j}"] + lane(w, j)).alias(f"c{j}") for j in range(width)])
    sign = F.lit(-(1 << 63))
    drop = F.lit((1 << 63) - 1) - ((1 << (width - 1)) - 1 - F.floor(F.size(words) / 2)) * F.lit(ones)

    def decided(x: Column) -> Column:
        sim = F.lit(0).cast("bigint")
        for j in range(width):
            high = (x[f"c{j}"] - drop - 1).bitwiseXOR(sign).bitwiseAND(F.lit(top - (1 << 64)))
            sim = sim.bitwiseOR(F.shiftleft(F.shiftrightunsigned(high, width - 1), j))
        return sim

    return F.aggregate(words, zero, add, decided)


def _ring(sim: Column, apart: int) -> Column:
    """The seven keys of two blocks that lie so far apart in a circle."""
    part = lambda b: F.shiftrightunsigned(sim, b[0]).bitwiseAND(F.lit((1 << b[1]) - 1))
    pairs = [(BLOCKS[i], BLOCKS[(i + apart) % 7]) for i in range(7)]
    return F.array(*[F.shiftleft(F.shiftleft(part(a), 10).bitwiseOR(part(b)), 3).bitwiseOR(F.lit(i)).cast("int") for i, (a, b) in enumerate(pairs)])


def _similar(a: Column, b: Column) -> Column:
    """Edits are a fifth of the longer line's characters at most. Most similar lines show it by _enough(); for the rest they are counted."""
    most = F.floor(F.greatest(F.length(a), F.length(b)) / 5).cast("int")
    pair = F.struct(a.alias("a"), b.alias("b"), most.alias("most"))
    edited = lambda p: F.when(_enough(p.a, p.b, p.most) <= p.most, True).otherwise(F.call_function("levenshtein", p.a, p.b, p.most) >= 0)
    return (F.abs(F.length(a) - F.length(b)) <= most) & let(pair, edited)


def _enough(a: Column, b: Column, most: Column) -> Column:
    """A number of edits that make b of a, though not always the least: work grows with the length, not with its square.

    Both lines are cut wherever the ANCHOR characters at every PIECE-th place of a come again in b, not far from where they are
    expected after the cut before, and the edits of the stretches between are added. A stretch of more than LARGE
    characters counts as replaced whole. Beyond `most` no more cuts are sought.
    """

    def edits(x: Column, y: Column) -> Column:
        size = lambda p: F.greatest(F.length(p.x), F.length(p.y))
        return let(F.struct(x.alias("x"), y.alias("y")), lambda p: F.when(p.x == p.y, 0).when(size(p) > LARGE, size(p)).otherwise(F.levenshtein(p.x, p.y)))

    def step(s: Column, at: Column) -> Column:
        anchor, ahead = F.substring(a, at, F.lit(ANCHOR)), at - s.at
        found = F.when(F.substring(b, s.to + ahead, F.lit(ANCHOR)) == anchor, s.to + ahead).otherwise(F.call_function("locate", anchor, b, s.to + F.greatest(F.lit(1), F.floor(ahead / 2).cast("int"))))
        cut = lambda to: F.struct(at.alias("at"), to.alias("to"), (s.n + edits(F.substring(a, s.at, ahead), F.substring(b, s.to, to - s.to))).alias("n"))
        return F.when(s.n > most, s).otherwise(let(found, lambda to: F.when((to == 0) | (to > s.to + 2 * ahead), s).otherwise(cut(to))))

    start = F.struct(F.lit(1).alias("at"), F.lit(1).alias("to"), F.lit(0).alias("n"))
    rest = lambda s: s.n + edits(F.substring(a, s.at, F.length(a)), F.substring(b, s.to, F.length(b)))
    places = F.when(F.length(a) > PIECE, F.sequence(F.lit(PIECE + 1), F.length(a), F.lit(PIECE))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, rest)


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lines are similar."""
    pairs = stored(pairs.distinct())
    wanted = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    texts = stored(lines.select("node", "line").join(_small(wanted, WANTED), "node"))
    both = pairs.join(texts.toDF("a", "line_a"), "a").join(texts.toDF("b", "line_b"), "b")
    return stored(both.where(_similar(F.col("line_a"), F.col("line_b"))).select("a", "b"))


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= BITS


def _alike(a: str, b: str) -> Column:
    """Few bits differ, and so few characters more that the lines can be similar."""
    return _near(F.col(f"sim{a}"), F.col(f"sim{b}")) & (F.abs(F.col(f"size{a}") - F.col(f"size{b}")) * 5 <= F.greatest(f"size{a}", f"size{b}"))


def line_groups(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct lines (node, h1, h2), and of those in a group of several the group's smallest node.

    lines: node (a number of the row), h1, h2, sim, size, line. A distinct line is named by the smallest of its rows.
    """
    nodes = lines.groupBy("h1", "h2").agg(F.min("node").alias("node"), F.max("sim").alias("sim"), F.max("size").alias("size"))
    nodes = written(nodes, "nodes")
    block = Window.partitionBy("block")
    sofar = block.orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = nodes.select("node", "sim", "size", F.explode(_ring(F.col("sim"), 1)).alias("block"))
    met = met.withColumns({"b": F.first("node").over(sofar), "sim_b": F.first("sim").over(sofar), "size_b": F.first("size").over(sofar)})
    linked = _verified(met.where((F.col("node") > F.col("b")) & _alike("", "_b")).select(F.col("node").alias("a"), "b"), lines)

    label = stored(components(linked))
    rooted = written(nodes.select("node", "sim", "size").join(label, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    turns = []
    for apart in (1, 2, 3):
        keyed = rooted.withColumn("block", F.explode(_ring(F.col("sim"), apart)))
        mixed = keyed.withColumns({"low": F.min("root").over(block), "high": F.max("root").over(block)}).where("low < high").drop("low", "high")
        other = mixed.toDF("b", "sim_b", "size_b", "root_b", "block")
        across = mixed.join(other, "block").where((F.col("root") < F.col("root_b")) & _alike("", "_b"))
        turns.append(stored(across.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()))
    more = turns[0].union(turns[1]).union(turns[2])
    if more.take(1):
        label = stored(components(linked.unionByName(_verified(more, lines))))
    return nodes.select("node", "h1", "h2"), label


def lines_written(own: DataFrame) -> DataFrame:
    """key, same, at, h1, h2, sim, size, node, line of every line with a letter or digit, as a table; node numbers its rows."""
    found = _lines(own).withColumns({"sim": simhash(F.col("line")), "size": F.length("line"), "node": F.monotonically_increasing_id()})
    return written(found, "lines")


def without_similar_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_lines, n_removed, kept (the lines left, joined by line ends).

    Of each connected group of similar lines the occurrence with the smallest key, then text hash,
    then place stays. Similar are lines with an edit similarity of 0.8 or more whose SimHashes differ
    in BITS bits at most and agree in two blocks; the README states how many that finds. Lines without letters and digits always stay. A null text is one
    empty line. Null keys come after all others. Of repeated rows one counts as the first, the
    others lose all lines that could repeat. Other columns are not read.
    """
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("same", F.xxhash64("text"))
    found = lines_written(own)
    nodes, label = line_groups(found)
    places = found.select("key", "same", "at", "h1", "h2").distinct()
    named = nodes.select("node", F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    into = label.where("node <> root").join(nodes, "node").select("h1", "h2", F.col("root").alias("node")).join(named, "node").drop("node")
    places = places.join(_small(stored(into)), ["h1", "h2"], "left").select("key", "same", "at", F.coalesce("g1", "h1").alias("g1"), F.coalesce("g2", "h2").alias("g2"))
    place = F.struct(F.col("key").isNull().alias("last"), "key", "same", "at")
    firsts = places.groupBy("g1", "g2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = places.join(_small(stored(firsts)), ["g1", "g2"]).where(place != F.col("first"))
    gone = later.groupBy(F.col("key").alias("_key"), F.col("same").alias("_same")).agg(F.sort_array(F.collect_list("at")).alias("gone"))
    rows = own.groupBy("key", "same").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").toDF("_key", "_same", "rows")
    notes = gone.withColumn("rows", F.lit(None).cast("bigint")).unionByName(rows.withColumn("gone", F.lit(None).cast("array<int>")))
    notes = notes.groupBy("_key", "_same").agg(F.max("gone").alias("gone"), F.max("rows").alias("rows"))
    mine = F.col("key").eqNullSafe(F.col("_key")) & (F.col("same") == F.col("_same"))
    marked = own.join(_small(stored(notes)), mine, "left").drop("_key", "_same")
    once = marked.where("rows is null").drop("rows").withColumn("copy", F.lit(1))
    again = marked.where("rows is not null").dropDuplicates(["key", "same"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("rows")
    lines = let(F.split("text", "\n"), lambda x: F.struct(F.size(x).cast("bigint").alias("n"), _left(x, F.coalesce("gone", F.array().cast("array<int>"))).alias("kept")))
    bare = let(F.split("text", "\n"), lambda x: F.struct(F.size(x).cast("bigint").alias("n"), F.filter(x, lambda y: normalised(y) == "").alias("kept")))
    out = once.unionByName(again).select("key", F.when(F.col("copy") == 1, lines).otherwise(bare).alias("of"))
    return out.select(F.col("key").alias(key), F.col("of.n").alias("n_lines"), (F.col("of.n") - F.size("of.kept")).alias("n_removed"), F.array_join("of.kept", "\n").alias("kept"))


def _left(lines: Column, gone: Column) -> Column:
    """The lines without those at the sorted places: all stretches between two of them."""
    ends = F.concat(gone, F.array(F.size(lines)))
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(gone, i - 1))
    return F.flatten(F.transform(ends, lambda x, i: F.slice(lines, before(i) + 2, x - before(i) - 1)))
