"""Substring dedup by fixed-block anchors.

A window is `width` words in a row. Any window holds a whole block of `block` words that starts at a
multiple of `block` words from the start of its document, as width >= 2 * block - 1. These blocks are
the index, and every rolling run of `block` words is a probe. Index and probes meet in buckets of
their hash, packed as arrays; a place whose hash also has a block in an earlier document (or, for a
block, a probe in a later one) is a hit. Around the hits of a document all windows are compared on
longer hashes, and those that an earlier document has too are merged to maximal repeats.

Before the exchange each task finds the windows that its own documents share: all but the earliest
document's are repeats already and are not sent on. So a passage that many documents share is sent
once for each few megabytes of text, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.rawtext import NOT_SPACE, Spans, chunks, room, runs_of, words
from souk.llm.spread import PACK, PACK_DDL, merged, packed
from souk.llm.store import stored

CHUNK = 4_000_000  # bytes of text that a task takes at once
BUCKET = 16_000_000  # bytes of text for each bucket
LAST = np.iinfo(np.int64).max  # stands for a null key
_TWO = np.dtype([("one", np.uint64), ("two", np.uint32)])  # of a window: two independent hashes

_PACK = pa.schema([("bucket", pa.int32()), ("local", pa.bool_()), *((c, pa.binary()) for c in ("keys", "sames", "counts", "hashes", "at", "to"))])
_PACK_DDL = "bucket int, local boolean, keys binary, sames binary, counts binary, hashes binary, at binary, to binary"


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    keys = pc.fill_null(batch.column("key").cast(pa.int64()), int(LAST)).to_numpy(zero_copy_only=False)
    return keys, batch.column("same").to_numpy(zero_copy_only=False)


def _gaps(at: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending words of each document as steps of one byte each; longer steps follow as numbers."""
    steps = np.diff(at, prepend=0)
    steps[np.cumsum(counts) - counts] = at[np.cumsum(counts) - counts]
    return np.minimum(steps, 255).astype(np.uint8).tobytes() + steps[steps >= 255].astype(np.uint32).tobytes()


def _ungapped(raw: bytes, counts: np.ndarray) -> np.ndarray:
    n = int(counts.sum())
    steps = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    steps[steps == 255] = np.frombuffer(raw, np.uint32, -1, n)
    whole, first = np.cumsum(steps), np.cumsum(counts) - counts
    return whole - np.repeat(whole[first] - steps[first], counts)


def _packed(bucket: int, local: bool, keys, sames, owner: np.ndarray, hashes, at, to=None) -> dict:
    """One row of arrays for many places; owner: the document of each, ascending, as are its places."""
    docs, counts = np.unique(owner, return_counts=True)
    short = lambda x: b"" if x is None else x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32).tobytes()
    return {"bucket": bucket, "local": local, "keys": keys[docs].tobytes(), "sames": sames[docs].tobytes() if sames is not None else b"", "counts": counts.astype(np.uint32).tobytes(), "hashes": b"" if hashes is None else hashes.tobytes(), "at": _gaps(at, counts), "to": short(to)}


def _unpacked(row: dict, kind) -> tuple[np.ndarray, ...]:
    keys, sames, counts = (np.frombuffer(row[c], k) for c, k in (("keys", np.int64), ("sames", np.int64), ("counts", np.uint32)))
    n = int(counts.sum())
    long = lambda raw: np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype(np.int64)
    return keys, sames, counts, np.frombuffer(row["hashes"], kind), _ungapped(row["at"], counts.astype(np.int64)), long(row["to"]) if row["to"] else None


def _deal(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in order of their bucket, and where each bucket begins."""
    bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _probes(width: int, block: int, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch, sort_keys=[("key", "ascending")], null_placement="at_end"))
            for part, data, offsets in chunks([batch], "text", CHUNK):
                starts, ends, bounds = words(data, offsets, NOT_SPACE)
                hashes = Spans(data)(starts, ends)
                n, (keys, sames) = len(hashes), _ids(part)
                left, owner = room(bounds, n), np.repeat(np.arange(len(keys)), np.diff(bounds))
                first = bounds[:-1][owner]
                whole = np.flatnonzero(left >= width)
                if not len(whole):
                    continue
                windows = runs_of(hashes, width)[whole]
                order, head = _grouped(data, starts, ends, whole, windows, width)  # places are in order of their keys
                earliest = keys[owner[whole[order[head]]]][np.cumsum(head) - 1]
                repeat = np.zeros(n, bool)
                repeat[whole[order]] = keys[owner[whole[order]]] > earliest
                sent = np.zeros(n, bool)
                sent[whole] = ~repeat[whole]
                out = []
                if repeat.any():
                    at, to = _runs(repeat, owner, width)
                    out.append(_packed(turn % buckets, True, keys, sames, owner[at], None, at - first[at], to - first[at]))
                    turn += 1
                near = np.zeros(n + 1, np.int32)  # runs of block words inside a window that is sent
                np.add.at(near, np.flatnonzero(sent), 1)
                np.add.at(near, np.flatnonzero(sent) + (width - block + 1), -1)
                places = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                probe = runs_of(hashes, block)[places]
                order, begin = _deal(probe, buckets)
                for k in np.flatnonzero(np.diff(begin)).tolist():
                    own = order[begin[k] : begin[k + 1]]
                    at = places[own]
                    out.append(_packed(k, False, keys, None, owner[at], probe[own].astype(np.uint32), at - first[at]))
                yield pa.RecordBatch.from_pylist(out, _PACK)

    return run


def _grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: np.ndarray, windows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal windows stand together, and whether each is the first of its kind; equal hashes are checked by bytes."""
    while True:
        order = np.argsort(windows, kind="stable")
        head = np.ones(len(order), bool)
        head[1:] = windows[order][1:] != windows[order][:-1]
        first = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
        other = order[_differ(data, starts, ends, places[order], first, width)]
        if not len(other):
            return order, head
        windows = windows.copy()
        windows[other] = windows[other] * np.uint64(3) + np.uint64(1)  # the same for equal windows


def _differ(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: np.ndarray, head: np.ndarray, width: int) -> np.ndarray:
    """Whether the window at each place has other bytes in its words than that at place `head` of the list."""
    many = np.flatnonzero(head != np.arange(len(places)))
    out = np.zeros(len(places), bool)
    for j in range(width):
        a, b = places[many] + j, places[head[many]] + j
        sizes = ends[a] - starts[a]
        same = sizes == ends[b] - starts[b]
        out[many[~same]] = True
        many, a, b, sizes = many[same], a[same], b[same], sizes[same]
        grow = np.cumsum(sizes) - sizes
        inner = np.arange(sizes.sum()) - np.repeat(grow, sizes)
        wrong = data[np.repeat(starts[a], sizes) + inner] != data[np.repeat(starts[b], sizes) + inner]
        out[many[np.unique(np.repeat(np.arange(len(many)), sizes)[wrong])]] = True
    return out


def _runs(marked: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of each stretch that neighbouring marked windows of one document cover."""
    at = np.flatnonzero(marked)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] > at[:-1] + width) | (owner[at[1:]] != owner[at[:-1]])
    begin = np.flatnonzero(new)
    return at[begin], at[np.append(begin[1:], len(at)) - 1] + width


def _gathered(rows: list[dict], kind):
    """Documents of all rows, and for each place its document, hash and word."""
    parts = [_unpacked(r, kind) for r in rows]
    keys = np.concatenate([p[0] for p in parts])
    sames = np.concatenate([p[1] for p in parts])
    owner = np.repeat(np.arange(len(keys)), np.concatenate([p[2] for p in parts]))
    return keys, sames, owner, np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])


def _hits(block: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        rows, out = table.to_pylist(), []
        for r in rows:
            if r["local"]:
                keys, sames, counts, _, at, to = _unpacked(r, np.uint32)
                out += packed(shards, "span", keys, sames, np.repeat(np.arange(len(keys)), counts), at, to)
        rows = [r for r in rows if not r["local"]]
        if rows:
            keys, _, owner, hashes, at = _gathered(rows, np.uint32)
            key = keys[owner]
            index = np.flatnonzero(at % block == 0)
            known, which = np.unique(hashes[index], return_inverse=True)
            low, high = np.full(len(known), LAST), np.full(len(known), np.iinfo(np.int64).min)
            np.minimum.at(low, which, key[index])
            place = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            met = np.flatnonzero(known[place] == hashes) if len(known) else np.zeros(0, np.int64)
            place = place[met]
            np.maximum.at(high, place, key[met])
            hit = (low[place] < key[met]) | ((at[met] % block == 0) & (high[place] > key[met]))
            met = met[hit]
            docs, whose = np.unique(key[met], return_inverse=True)
            out += packed(shards, "hit", docs, None, whose, at[met])
        return pa.Table.from_pylist(out, PACK)

    return run


def _candidates(width: int, block: int, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches, "text", CHUNK):
            starts, ends, bounds = words(data, offsets, NOT_SPACE)
            hashes = Spans(data)(starts, ends)
            n, (keys, sames) = len(hashes), _ids(part)
            left, owner = room(bounds, n), np.repeat(np.arange(len(keys)), np.diff(bounds))
            column = part.column("hits")
            hits = column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()].astype(np.int64)
            many = np.diff(column.offsets.to_numpy())
            of = np.repeat(np.arange(len(keys)), many)
            near = np.zeros(n + 1, np.int32)  # windows that hold the run of words at a hit
            ok = hits < np.diff(bounds)[of]
            begin = np.maximum(hits[ok] - (width - block), 0) + bounds[of[ok]]
            np.add.at(near, begin, 1)
            np.add.at(near, hits[ok] + bounds[of[ok]] + 1, -1)
            places = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (left >= width))
            if not len(places):
                continue
            windows = runs_of(hashes, width, 1)[places]
            check = (runs_of(Spans(data, 1)(starts, ends), width, 2)[places] >> np.uint64(32)).astype(np.uint32)
            order, cut = _deal(windows, buckets)
            out, first = [], bounds[:-1][owner]
            for k in np.flatnonzero(np.diff(cut)).tolist():
                own = order[cut[k] : cut[k + 1]]
                at = places[own]
                both = np.empty(len(own), _TWO)
                both["one"], both["two"] = windows[own], check[own]
                out.append(_packed(k, False, keys, sames, owner[at], both, at - first[at]))
            yield pa.RecordBatch.from_pylist(out, _PACK)

    return run


def _repeats(width: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        keys, sames, owner, hashes, at = _gathered(table.to_pylist(), _TWO)
        one, two = np.ascontiguousarray(hashes["one"]), np.ascontiguousarray(hashes["two"])
        order = np.lexsort((two, one))
        head = np.ones(len(order), bool)
        head[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        earliest = np.minimum.reduceat(keys[owner[order]], np.flatnonzero(head))[np.cumsum(head) - 1]
        later = order[keys[owner[order]] > earliest]
        return pa.Table.from_pylist(packed(shards, "span", keys, sames, owner[later], at[later], at[later] + width), PACK)

    return run


def _cut(width: int, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches, "text", CHUNK):
            starts, ends, bounds = words(data, offsets, NOT_SPACE)
            n, texts = len(starts), part.num_rows
            cover = np.zeros(n + 1, np.int32)
            for a, b in (("at", "to"),):
                for column, sign in ((a, 1), (b, -1)):
                    c = part.column(column)
                    many = np.diff(c.offsets.to_numpy()) if texts else np.zeros(0, int)
                    values = c.values.to_numpy()[c.offsets[0].as_py() : c.offsets[-1].as_py()].astype(np.int64)
                    np.add.at(cover, values + np.repeat(bounds[:-1], many), sign)
            gone = np.cumsum(cover[:-1]) > 0
            kept = np.flatnonzero(~gone)
            owner = np.repeat(np.arange(texts), np.diff(bounds))
            edge = np.zeros(len(data) + 1, np.int8)
            edge[starts[kept]] = 1
            edge[ends[kept]] -= 1
            stay = np.cumsum(edge[:-1], dtype=np.int8) > 0
            joint = kept[:-1][owner[kept[1:]] == owner[kept[:-1]]]  # one space after each kept word but the last
            stay[ends[joint]] = True
            bytes_ = data.copy()
            bytes_[ends[joint]] = 0x20
            sizes = np.concatenate([[0], np.cumsum(stay)])[offsets]
            text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), texts, [None, pa.py_buffer(sizes.astype(np.int64).tobytes()), pa.py_buffer(bytes_[stay].tobytes())])
            removed = np.bincount(owner[gone], minlength=texts)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(removed.astype(np.int64)), text.cast(pa.large_string()).cast(pa.string())], schema=schema)

    return run


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 13, block: int | None = None) -> DataFrame:
    """One row per document: key, n_words, n_removed, kept (the words left, joined by one space).

    Words are runs without white space. A word goes if a window that covers it also starts in a
    document with a smaller key; windows are those of the input. Keys are whole numbers; a null key
    comes after all others. Rows with equal keys do not remove each other's words. Null and empty
    texts have no words. Other columns are not read. Windows of different tasks are equal if 96 bits
    of two independent hashes are, those of one task if their bytes are.
    """
    block = block or (width + 1) // 2
    if width < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    own = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("same", F.xxhash64("text"))
    total = own.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET))

    found = stored(merged(own.mapInArrow(_probes(width, block, buckets), _PACK_DDL).groupBy("bucket").applyInArrow(_hits(block, buckets), PACK_DDL)))
    # stored apart: by then Spark can delete the probes' shuffle files, before texts are shuffled
    hits = stored(found.where("kind = 'hit'").select(F.col("key").alias("_key"), F.col("at").alias("hits")))
    rank = F.coalesce(F.col("key"), F.lit(int(LAST)))
    near = own.join(hits, rank == F.col("_key")).drop("_key")
    later = merged(near.mapInArrow(_candidates(width, block, buckets), _PACK_DDL).groupBy("bucket").applyInArrow(_repeats(width, buckets), PACK_DDL))
    spans = later.unionByName(found.where("kind = 'span'"))
    spans = stored(spans.groupBy(F.col("key").alias("_key"), F.col("same").alias("_same")).agg(F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("to")).alias("to")))

    none = F.array().cast("array<bigint>")
    cut = own.join(spans, (rank == F.col("_key")) & (F.col("same") == F.col("_same")), "left")
    cut = cut.select("key", "text", F.coalesce("at", none).alias("at"), F.coalesce("to", none).alias("to"))
    schema = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
    return cut.mapInArrow(_cut(width, schema), "key bigint, n_words bigint, n_removed bigint, kept string").withColumnRenamed("key", key)
