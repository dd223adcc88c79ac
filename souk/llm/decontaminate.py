"""Benchmark decontamination: a prefix-filtered join of benchmark windows with all documents.

Every run of `width` words of an item is a window; a shorter item is one window. The shingles of
a window are ordered by how rare they are in the documents. As a match needs all of a window, its
prefix is its rarest shingle alone: only places where a document has that shingle become
candidates. The place must leave room for the whole window inside the document (length and
position bounds), and the words are then compared one by one.

The benchmark goes to the tasks in blocks of at most `block` windows, so what is sent never grows
with the benchmark or the documents; each block is one counting and one matching pass. Documents
are never shuffled while one block holds the benchmark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from souk.llm.columns import renamed, restored
from souk.llm.rawtext import ALNUM, LOWER, Lookup, Spans, chunks, room, runs_of, strings, words
from souk.llm.store import stored

BLOCK = 200_000


@dataclass
class _Block:
    """Windows as word hashes, one row each; `sizes` words count, the rest is 0."""

    items: list[str]
    words: list[bytes]
    sizes: np.ndarray
    hashes: np.ndarray

    def shingles(self, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Window, place in it, words and hash of each of its shingles."""
        out = []
        for size in np.unique(self.sizes).tolist():
            width = min(size, longest)
            of = np.flatnonzero(self.sizes == size)
            for at in range(size - width + 1):
                rows = self.hashes[of, at : at + width]
                out.append((of, np.full(len(of), at), np.full(len(of), width), runs_of(rows.reshape(-1), width)[::width]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _tokens(data: np.ndarray, offsets: np.ndarray):
    starts, ends, bounds = words(data, offsets, ALNUM)
    return starts, ends, bounds, Spans(data, fold=LOWER)(starts, ends)


def _windows(item: str, text: str, width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, text):
            starts, ends, bounds, _ = _tokens(data, offsets)
            each = strings(LOWER[data], starts, ends)
            names = batch.column(item).to_pylist()
            out = {"item": [], "window": []}
            for k, name in enumerate(names):
                own = each[bounds[k] : bounds[k + 1]]
                for at in range(max(1, len(own) - width + 1) if own else 0):
                    out["item"].append("null" if name is None else name)
                    out["window"].append(b" ".join(own[at : at + width]))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("item", pa.string()), ("window", pa.binary())]))

    return run


def _block(rows: pa.Table, width: int) -> _Block:
    items, texts = rows.column("item").to_pylist(), [bytes(x) for x in rows.column("window").to_pylist()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    _, _, bounds, hashes = _tokens(data, offsets)
    sizes = np.diff(bounds)
    table = np.zeros((len(texts), width), np.uint64)
    for j in range(width):
        has = sizes > j
        table[has, j] = hashes[bounds[:-1][has] + j]
    return _Block(items, texts, sizes, table)


def _count(text: str, by_width: dict[int, np.ndarray]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = {w: Lookup(v) for w, v in by_width.items()}
        seen = {w: np.zeros(len(v), np.int64) for w, v in by_width.items()}
        for _, data, offsets in chunks(batches, text):
            _, _, bounds, hashes = _tokens(data, offsets)
            left = room(bounds, len(hashes))
            for w, known in look.items():
                at, which = known(runs_of(hashes, w))
                np.add.at(seen[w], which[left[at] >= w], 1)
        for w, n in seen.items():
            has = np.flatnonzero(n)
            if len(has):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), w, np.int32)), pa.array(by_width[w][has].view(np.int64)), pa.array(n[has])], ["width", "hash", "n"])

    return run


def _match(key: str, text: str, block: _Block, prefixes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], schema: pa.Schema):
    """prefixes: by words, the sorted hashes, where each one's entries begin, and their windows and places."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = {w: Lookup(p[0]) for w, p in prefixes.items()}
        for batch, data, offsets in chunks(batches, text):
            starts, ends, bounds, hashes = _tokens(data, offsets)
            left, texts = room(bounds, len(hashes)), len(offsets) - 1
            owner = np.repeat(np.arange(texts), np.diff(bounds))
            hits = []
            for w, known in look.items():
                at, which = known(runs_of(hashes, w))
                _, begin, window, place = prefixes[w]
                many = begin[which + 1] - begin[which]
                entry = np.repeat(begin[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                first, win = np.repeat(at, many) - place[entry], window[entry]
                ok = first >= 0
                first, win = first[ok], win[ok]
                ok = (owner[first] == np.repeat(owner[at], many)[ok]) & (left[first] >= block.sizes[win])
                first, win = first[ok], win[ok]
                for j in range(block.hashes.shape[1]):
                    has = block.sizes[win] > j
                    ok = ~has
                    ok[has] = hashes[first[has] + j] == block.hashes[win[has], j]
                    first, win = first[ok], win[ok]
                hits.append((first, win))
            first, win = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64),) * 2
            low, spans, items = LOWER[data] if len(first) else data, [[] for _ in range(texts)], [set() for _ in range(texts)]
            for a, k in zip(first.tolist(), win.tolist(), strict=True):
                size = int(block.sizes[k])
                if b" ".join(strings(low, starts[a : a + size], ends[a : a + size])) == block.words[k]:
                    d = int(owner[a])
                    spans[d] += [a - int(bounds[d]), size]
                    items[d].add(block.items[k])
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("_same"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], schema=schema)

    return run


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit, names, spans_of, sizes = [], [], batch.column("spans").to_pylist(), batch.column("n_words").to_pylist()
        for spans, size, items in zip(spans_of, sizes, batch.column("items").to_pylist(), strict=True):
            edge = np.zeros(size + 1, np.int64)
            np.add.at(edge, spans[::2], 1)
            np.add.at(edge, np.add(spans[::2], spans[1::2]).astype(np.int64), -1)
            hit.append(int((np.cumsum(edge) > 0).sum()) if spans else 0)
            names.append(hashlib.sha256(",".join(sorted(set(items))).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(names), batch.column("items"), batch.column("spans"), batch.column("_same")], ["key", "n_words", "n_hit", "items_sha256", "items", "spans", "same"])


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10, shingle: int = 5, block: int = BLOCK) -> DataFrame:
    """One row per document: key, n_words, n_hit (words inside an occurring window), n_items,
    items_sha256 (names sorted as strings, comma-joined), contaminated, items, spans (first word and
    words of each hit, in turn), same (a hash of the text).

    Null and empty texts have no words and no hits. A null item id is named "null"; an item without
    words is no window. Repeated rows each get their own result row; a null key is kept. An empty
    benchmark hits nothing. Other columns of both tables are not read.
    """
    kind = docs.schema[key].dataType
    whole = _matched(docs, benchmark, key, text, item, item_text, width, shingle, block)
    out = whole.mapInArrow(_digest, f"key {kind.simpleString()}, n_words bigint, n_hit bigint, items_sha256 string, items array<string>, spans array<bigint>, same bigint")
    return out.select(F.col("key").alias(key), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "items", "spans", "same")


def _matched(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10, shingle: int = 5, block: int = BLOCK) -> DataFrame:
    """key, _same, n_words, spans and items of benchmark_hits(), by one Python step."""
    kind = docs.schema[key].dataType
    own = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).withColumn("_same", F.xxhash64(F.coalesce("text", F.lit(""))))
    windows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).mapInArrow(_windows("item", "text", width), "item string, window binary").distinct()
    windows = stored(windows)
    blocks = max(1, -(-windows.count() // block))
    parts = []
    for k in range(blocks):
        rows = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("item", "window"), F.lit(blocks)) == k)
        parts.append(_one_block(own, _block(rows.toArrow(), width), shingle, kind))
    if blocks == 1:
        whole = parts[0]
    else:  # each block has one row per document row; equal rows are told apart by their number only
        whole = parts[0]
        for more in parts[1:]:
            whole = whole.unionByName(more)
        whole = whole.groupBy("key", "_same").agg(F.count(F.lit(1)).alias("rows"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        whole = whole.withColumn("row", F.explode(F.sequence(F.lit(1), (F.col("rows") / blocks).cast("int")))).select("key", "_same", "n_words", "spans", "items")
    return whole


def without_benchmark(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All columns of the documents that no benchmark window occurs in, repeated rows as often as they occur.

    Null and empty texts stay, null keys are keys like any other, an empty benchmark keeps all, an empty
    table gives no rows. Columns of any name are handed on unchanged.
    """
    own, names = renamed(docs)
    key, text = names[key], names[text]
    # Without the digests of benchmark_hits(): a second Python step would keep a second worker for each core from here on.
    hit = _matched(own, benchmark, key, text, **options).where(F.size("spans") > 0).select(F.col("key").alias("hit_key"), F.col("_same").alias("hit_same")).distinct()
    hit = stored(hit)
    few = F.broadcast(hit) if hit.count() <= BLOCK else hit
    own = own.withColumn("hash", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    out = own.join(few, F.col(key).eqNullSafe(F.col("hit_key")) & (F.col("hash") == F.col("hit_same")), "left_anti")
    return restored(out, names)


def _one_block(own: DataFrame, block: _Block, shingle: int, kind) -> DataFrame:
    by_width: dict[int, np.ndarray] = {}
    prefixes = {}
    if len(block.sizes):
        window, place, width, hashes = block.shingles(shingle)
        by_width = {int(w): np.unique(hashes[width == w]) for w in np.unique(width)}
        counts = own.mapInArrow(_count("text", by_width), "width int, hash bigint, n bigint").groupBy("width", "hash").agg(F.sum("n").alias("n")).toArrow()
        seen = dict(zip(zip(counts["width"].to_pylist(), counts["hash"].to_pylist(), strict=True), counts["n"].to_pylist(), strict=True))
        often = np.array([seen.get(x, 0) for x in zip(width.tolist(), hashes.view(np.int64).tolist(), strict=True)], np.int64)
        order = np.lexsort((place, hashes, often, window))
        rarest = order[np.concatenate([[True], np.diff(window[order]) != 0])]
        rarest = rarest[often[rarest] > 0]  # a shingle that no document has: nor has one the window
        for w in np.unique(width[rarest]).tolist():
            of = rarest[width[rarest] == w]
            of = of[np.argsort(hashes[of], kind="stable")]
            values, first = np.unique(hashes[of], return_index=True)
            prefixes[w] = (values, np.append(first, len(of)), window[of], place[of])
    schema = f"key {kind.simpleString()}, _same bigint, n_words bigint, spans array<bigint>, items array<string>"
    arrow = to_arrow_schema(own.sparkSession.createDataFrame([], schema).schema)
    return own.mapInArrow(_match("key", "text", block, prefixes, arrow), schema)
