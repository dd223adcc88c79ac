"""N-gram Jaccard join by MinHash banding.

Texts with the same set of word n-grams form one class from the start, so copies cost nothing more.
One text of each class is signed with MinHash values in bands; bands and rows are chosen for the
wanted recall at the threshold. Classes that share a band are candidates: each band value links its
members to its smallest one, and the connected parts of these links hold all candidate pairs.
Every part is verified on the full n-gram sets. A part too large for one task is cut into blocks,
and each pair of blocks is a task of its own; pairs are counted there and never written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from souk.llm.columns import renamed, restored
from souk.llm.components import components
from souk.llm.rawtext import ALNUM, LOWER, Spans, chunks, mixed, room, runs_of, words
from souk.llm.store import stored

BLOCK = 512  # texts in a block; a task holds two
GROUP = 2_000  # texts of small parts verified together
NGRAMS = 1_000_000  # n-grams in a block or a group, but for single texts with more


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """The fewest bands of so many rows that find a pair at the threshold with that chance."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def _shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts in order of text and hash, and the n+1 offsets of the texts.
    A text of fewer words, but not none, is one n-gram."""
    starts, ends, bounds = words(data, offsets, ALNUM)
    hashes = Spans(data, fold=LOWER)(starts, ends)
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    found, of = [], []
    runs = runs_of(hashes, size)
    whole = np.flatnonzero(room(bounds, len(hashes))[: len(runs)] >= size)
    found.append(runs[whole])
    of.append(owner[whole])
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            found.append(runs_of(hashes, k)[bounds[short]])
            of.append(short)
    found, of = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    found, of = found[new], of[new]
    return found, np.searchsorted(of, np.arange(len(n) + 1))


def _digests(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit numbers for each set."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ np.uint64(seed)), dtype=np.uint64)]) for seed in (0x51ED270B, 0xA5A5F00D5EED)]
    return [mixed(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums]


def _sign(size: int, bands: int, rows: int, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20)
        factors = rng.integers(1, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        shifts = rng.integers(0, 2**63, bands * rows, np.uint64)
        weights = rng.integers(1, 2**63, rows, np.uint64) * np.uint64(2) + np.uint64(1)
        for batch, data, offsets in chunks(batches, "text"):
            hashes, bounds = _shingles(data, offsets, size)
            full = np.flatnonzero(np.diff(bounds))
            one, two = _digests(hashes, bounds)
            signed = np.zeros((batch.num_rows, bands), np.uint64)
            for band in range(bands if len(full) else 0):
                value = np.full(len(full), band, np.uint64)
                for row in range(rows):
                    j = band * rows + row
                    value += np.minimum.reduceat(hashes * factors[j] + shifts[j], bounds[full]) * weights[row]
                signed[full, band] = mixed(value)
            flat = pa.array(signed.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands), flat)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("same"), pa.array(one), pa.array(two), pa.array(np.diff(bounds).astype(np.int64)), lists], schema=schema)

    return run


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, p: int, q: int, wide: int = 1 << 13) -> np.ndarray:
    """Whether the sets at `left` and `right` overlap by p/q of their union or more, for every pair."""
    sizes = np.array([len(s) for s in sets])
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.flatnonzero(np.bincount(ids, minlength=len(values)) > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    column = place[ids]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)))
    for at in range(0, len(shared), wide):
        a, b = np.searchsorted(column, (at, at + wide))
        grid = np.zeros((len(sets), min(wide, len(shared) - at)), np.float32)
        grid[owner[a:b], column[a:b] - at] = 1
        both += grid[left] @ grid[right].T
    return np.rint(both).astype(np.int64) * (p + q) >= p * (sizes[left][:, None] + sizes[right])


def _verify(size: int, p: int, q: int):
    def run(table: pa.Table) -> pa.Table:
        data = table.combine_chunks().to_batches()
        rows = {"node": [], "links": [], "peer": []}
        nodes, sets, part, weight, side = [], [], [], [], []
        seen = set()
        for batch, raw, offsets in chunks(data, "text"):
            hashes, bounds = _shingles(raw, offsets, size)
            one, two = _digests(hashes, bounds)
            for i, (node, of, w, s, d1, d2) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("node", "part", "copies", "side", "d1", "d2")), strict=True)):
                if node not in seen and (d1, d2) == (one[i], two[i]):
                    seen.add(node)
                    nodes.append(node), sets.append(hashes[bounds[i] : bounds[i + 1]]), part.append(of), weight.append(w), side.append(s)
        lo, hi = (table.column(c)[0].as_py() for c in ("lo", "hi"))
        nodes, part, weight, side = map(np.array, (nodes, part, weight, side))
        for of in np.unique(part):
            own = np.flatnonzero(part == of)
            cross = lo != hi
            left, right = (np.flatnonzero(side[own] == lo), np.flatnonzero(side[own] == hi)) if cross else (np.arange(len(own)),) * 2
            if len(own) < 2 or not len(left) or not len(right):
                continue
            linked = _links([sets[i] for i in own], left, right, p, q)
            if not cross:
                np.fill_diagonal(linked, False)
            a, b = own[left], own[right]
            links = np.zeros(len(nodes), np.int64)
            links[a] += linked @ weight[b]
            if cross:
                links[b] += linked.T @ weight[a]
            grown = np.zeros((len(own), len(own)), bool)
            grown[np.ix_(left, right)] = linked
            grown |= grown.T
            free = grown.any(axis=1)
            peer = {}
            while free.any():  # a spanning tree of each connected part
                front = np.array([np.argmax(free)])
                free[front] = False
                while len(front):
                    reach = grown[front] & free
                    new = np.flatnonzero(reach.any(axis=0))
                    peer.update(zip(new.tolist(), front[reach[:, new].argmax(axis=0)].tolist(), strict=True))
                    free[new] = False
                    front = new
            for i in np.flatnonzero(grown.any(axis=1)):
                rows["node"].append(int(nodes[own[i]])), rows["links"].append(int(links[own[i]]))
                rows["peer"].append(int(nodes[own[peer[i]]]) if i in peer else None)
        return pa.table(rows, pa.schema([("node", pa.int64()), ("links", pa.int64()), ("peer", pa.int64())]))

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.9999, rows: int = 5, block: int = BLOCK) -> DataFrame:
    """One row per document: key, class_id, n_links, same (a hash of the text), group
    (a number for the group; null without words).

    Two documents are linked if the sets of their n-grams of `size` words (runs of letters and
    digits, A-Z lower-cased) overlap by `threshold` or more; n_links counts the others a document is
    linked to, copies included. class_id is the smallest key of the group that links connect.
    Texts without words, null ones too, are linked to nothing and are groups of their own. Repeated
    rows are linked copies. A null key sorts after all others; a group with no other has a null id.
    Other columns are not read.
    """
    spark, bands = docs.sparkSession, bands_for(threshold, recall, rows)
    ratio = Fraction(threshold).limit_denominator(1000)
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("same", F.xxhash64("text"))
    schema = f"key {docs.schema[key].dataType.simpleString()}, same bigint, d1 bigint, d2 bigint, n bigint, bands array<bigint>"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    signed = stored(own.mapInArrow(_sign(size, bands, rows, arrow), schema))

    first = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "same")).alias("first")
    classes = signed.where("n > 0").groupBy("d1", "d2").agg(first, F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("n").alias("n"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    banded = classes.select("node", F.posexplode("bands").alias("band", "value"))
    hubs = banded.groupBy("band", "value").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").drop("top")
    edges = banded.join(hubs, ["band", "value"]).where("node > hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    parts = stored(components(edges).withColumnRenamed("root", "part"))

    sizes = parts.join(classes.select("node", "n"), "node").groupBy("part")
    sizes = stored(sizes.agg(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / NGRAMS).alias("size"), F.count(F.lit(1)).alias("texts"), F.sum("n").alias("ngrams")))
    total = sizes.where("size <= 1").agg(F.sum("texts").alias("texts"), F.sum("ngrams").alias("ngrams")).first()
    few = max(1, -(-(total.texts or 0) // GROUP), -(-(total.ngrams or 0) // NGRAMS))
    wanted = classes.join(parts, "node").join(sizes, "part").select("node", "part", "size", "copies", "d1", "d2", F.col("first.key").alias("_key"), F.col("first.same").alias("_same"))
    texts = own.join(wanted, F.col("key").eqNullSafe(F.col("_key")) & (F.col("same") == F.col("_same")))
    blocks = F.ceil("size").cast("int")
    side = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    texts = texts.withColumn("blocks", blocks).withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("part"), F.lit(few))).otherwise(-1 - F.col("part"))
    texts = texts.select("node", "part", "copies", "d1", "d2", "text", "side", group.alias("group"), F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    found = stored(texts.groupBy("group", "lo", "hi").applyInArrow(_verify(size, ratio.numerator, ratio.denominator), "node bigint, links bigint, peer bigint"))

    joined = components(found.where("peer is not null").select(F.col("node").alias("a"), F.col("peer").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    ids = classes.select("node", "d1", "d2", "copies", F.col("first.key").alias("key")).join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = ids.groupBy("root").agg(F.min("key").alias("class_id"))
    ids = ids.drop("key").join(names, "root").join(links, "node", "left").select("d1", "d2", "class_id", F.col("root").alias("group"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    wordless = signed.where("n = 0").select("key", F.col("key").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), "same", F.lit(None).cast("bigint").alias("group"))
    rest = signed.where("n > 0").select("key", "same", "d1", "d2").join(ids, ["d1", "d2"]).select("key", "class_id", "n_links", "same", "group")
    return rest.unionByName(wordless).withColumnRenamed("key", key)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All columns of one document of each group: of those with the smallest key, the one with the
    smallest hash of its text. Of repeated rows one stays.

    Documents without words, null and empty texts too, are linked to nothing and all stay, repeated ones as
    often as they occur. Null keys come after all others; a group of null keys alone keeps one of them. An
    empty table gives no rows. Columns of any name are handed on unchanged.
    """
    mine, names = renamed(docs)
    key, text = names[key], names[text]
    found = near_duplicates(mine, key, text, **options).withColumnRenamed(key, "key")
    rows = found.groupBy("group", "key", "same").agg(F.count(F.lit(1)).alias("rows"))
    of = F.min(F.struct(F.col("key").isNull(), "key", "same", "rows")).alias("of")
    best = rows.where("group is not null").groupBy("group").agg(of).select("of.key", "of.same", "of.rows")
    keep = stored(best.unionByName(rows.where("group is null").select("key", "same", F.lit(1).cast("bigint").alias("rows"))))
    mine = mine.withColumn("hash", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    kept = mine.join(keep, F.col(key).eqNullSafe(F.col("key")) & (F.col("hash") == F.col("same")))
    once = kept.where("rows > 1").dropDuplicates(["key", "hash"])
    return restored(kept.where("rows = 1").unionByName(once), names)
