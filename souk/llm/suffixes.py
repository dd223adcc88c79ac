"""Suffix-array dedup: bytes of strings of `length` bytes that occur more than once.

Only places that can repeat are sorted. Every window of `length` bytes is told by its smallest hash
of GRAM bytes; neighbouring windows with the same smallest hash are a segment. Equal windows have
equal smallest hashes, so only segments whose hash occurs twice or more are sent on, and those of one
hash meet in one task.

There the suffixes at all windows are sorted in two stages. Suffixes smaller than their successors
are sorted directly, to a depth of `length` bytes. The others are induced: buckets of first bytes are
scanned in order, and the predecessor of each suffix, if larger than it, takes the next place in the
bucket of its own first byte. Then neighbours in the order are compared; a common prefix of `length`
bytes makes both repeats.

A hash in more than `limit` places would make a group too large for a task. The windows of such
hashes are counted by 128 bits of their own instead, summed by task before they are sent. Stretches
that a task finds equal among its own texts are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.rawtext import Spans, chunks, grams
from souk.llm.spread import PACK, PACK_DDL, merged, packed
from souk.llm.store import stored

GRAM = 32
CHUNK = 1_000_000  # bytes of text that a task takes at once
BUCKET = 16_000_000  # bytes of text for each bucket
FEW = 100_000  # hot hashes that may be sent to every task; more are shuffled
LIMIT = 2_000  # places of a hash whose segments meet in one task
SORTED = 100_000  # windows sorted together, or one group


# -- the suffix order of some places ------------------------------------------


def suffix_order(text: np.ndarray, first: np.ndarray, last: np.ndarray, depth: int) -> np.ndarray:
    """Places first[i]..last[i] (disjoint ranges) in the order of their suffixes, right to `depth` bytes.

    text needs `depth` bytes after the last place of all.
    """
    n = len(text)
    # a suffix is smaller than the next if its first byte differing from the next byte is smaller
    change = np.flatnonzero(text[1:] != text[:-1])
    ends = np.append(change, n - 1)
    sizes = np.diff(np.concatenate([[-1], ends]))
    rises = np.append(text[change] < text[change + 1], False)
    small = np.repeat(rises, sizes)
    # whole runs of larger suffixes are needed, up to the smaller one that they are induced from
    upward = np.append(np.flatnonzero(small), n)
    last = np.minimum(upward[np.searchsorted(upward, last)], n - 1)
    wanted = np.zeros(n + 1, np.int32)
    np.add.at(wanted, first, 1)
    np.add.at(wanted, last + 1, -1)
    wanted = np.cumsum(wanted[:-1]) > 0
    direct = np.flatnonzero(wanted & small)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(rows).view(f"S{depth}").ravel(), kind="stable")]
    del rows
    begins = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger = wanted & ~small
    if wanted[-1]:  # larger than the empty suffix, the smallest of all
        induced[text[-1]].append(np.array([n - 1]))
    done = []

    def before(places: np.ndarray) -> np.ndarray:
        places = places[places > 0] - 1
        return places[larger[places]]

    for c in range(256):
        fresh = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        own = [fresh]
        while len(fresh):  # runs of the byte c
            fresh = before(fresh)
            fresh = fresh[text[fresh] == c]
            own.append(fresh)
        own.append(direct[begins[c] : begins[c + 1]])
        bucket = np.concatenate(own)
        done.append(bucket)
        onward = before(bucket)
        onward = onward[text[onward] > c]
        if len(onward):
            heads = text[onward]
            onward = onward[np.argsort(heads, kind="stable")]
            cuts = np.searchsorted(np.sort(heads), np.arange(257))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                induced[b].append(onward[cuts[b] : cuts[b + 1]])
    return np.concatenate(done)


def common_prefixes(text: np.ndarray, places: np.ndarray, depth: int, step: int = 20_000) -> np.ndarray:
    """Bytes, `depth` at most, that each place's suffix shares with the next in the list."""
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(depth, np.uint8)]), depth)
    out = np.zeros(max(len(places) - 1, 0), np.int64)
    for a in range(0, len(out), step):
        b = min(a + step, len(out))
        rows = view[places[a : b + 1]]
        other = rows[1:] != rows[:-1]
        out[a:b] = np.where(other.any(axis=1), other.argmax(axis=1), depth)
    return out


def repeated(text: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """The places in the ranges whose next `length` bytes are those of another place, ascending."""
    order = suffix_order(text, first, last, length)
    own = np.zeros(len(text) + 1, np.int32)
    np.add.at(own, first, 1)
    np.add.at(own, last + 1, -1)
    order = order[(np.cumsum(own[:-1]) > 0)[order]]
    same = common_prefixes(text, order, length) >= length
    found = np.zeros(len(order), bool)
    found[1:] |= same
    found[:-1] |= same
    return np.sort(order[found])


# -- segments ------------------------------------------------------------------


def _slide(x: np.ndarray, width: int, smaller: bool) -> np.ndarray:
    """The smallest (or largest) of every `width` neighbours."""
    pick, fill = (np.minimum, np.iinfo(np.uint64).max) if smaller else (np.maximum, 0)
    n = len(x)
    grid = np.concatenate([x, np.full(-n % width, fill, np.uint64)]).reshape(-1, width)
    ahead = pick.accumulate(grid, axis=1).ravel()
    behind = np.ascontiguousarray(pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
    return pick(behind[: n - width + 1], ahead[width - 1 : n])


def _least(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and of each window that lies within a text the smallest (else 0)."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    hashes = grams(data, GRAM) | np.uint64(1)
    least = _slide(hashes, length - GRAM + 1, True)
    end = np.repeat(offsets[1:], np.diff(offsets))
    least[np.arange(len(least)) + length > end[: len(least)]] = 0
    return hashes, least


_PACK = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), *((c, pa.binary()) for c in ("keys", "sames", "counts", "values", "n", "at", "to", "bytes"))])
_PACK_DDL = "bucket int, kind string, keys binary, sames binary, counts binary, values binary, n binary, at binary, to binary, bytes binary"
class _Docs:
    """Keys (with nulls) and text hashes of a batch."""

    def __init__(self, batch: pa.RecordBatch):
        self.keys = batch.column("key").cast(pa.int64())
        self.sames = batch.column("same").to_numpy(zero_copy_only=False)

    def pack(self, bucket: int, kind: str, owner: np.ndarray, **arrays) -> dict:
        """One row of arrays with a value for each place; owner: the document of each."""
        order = np.argsort(owner, kind="stable")
        docs, counts = np.unique(owner, return_counts=True)
        keys = pc.fill_null(self.keys, NULL).to_numpy(zero_copy_only=False)
        row = dict.fromkeys(("values", "n", "at", "to", "bytes"), b"")
        row |= {"bucket": bucket, "kind": kind, "keys": keys[docs].tobytes(), "sames": self.sames[docs].tobytes(), "counts": counts.astype(np.uint32).tobytes()}
        return row | {k: v[order].tobytes() for k, v in arrays.items()}


NULL = -(2**63)  # stands for a null key


def _deal(values: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    bucket = (values >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    return [(k, order[cut[k] : cut[k + 1]]) for k in np.flatnonzero(np.diff(cut)).tolist()]


def _tallied(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place of each value, how often it occurs, and for all places whether theirs occurs again."""
    _, one, back, n = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
    return one, n.astype(np.uint32), n[back] > 1


def _same_bytes(data: np.ndarray, first: np.ndarray, end: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _tallied(), for stretches of bytes: those of one hash are compared byte by byte with the first of it."""
    values = Spans(data, 1)(first, end) if hashes is None else hashes
    raw = data.data
    while True:
        _, one, back, n = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
        twins = np.flatnonzero((n[back] > 1) & (one[back] != np.arange(len(values))))
        a, b, c, d = (x.tolist() for x in (first[twins], end[twins], first[one[back[twins]]], end[one[back[twins]]]))
        other = [t for t, i, j, k, m in zip(twins.tolist(), a, b, c, d, strict=True) if raw[i:j] != raw[k:m]]
        if not other:
            return one, n.astype(np.uint32), n[back] > 1
        values = values.copy()
        values[other] = values[other] * np.uint64(3) + np.uint64(1)  # the same for equal bytes


def _anchors(length: int, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, width = 0, length - GRAM + 1
        for part, data, offsets in chunks(batches, "text", CHUNK):
            hashes, least = _least(data, offsets, length)
            if not least.any():
                continue
            edge = np.zeros(width - 1, np.uint64)
            most = _slide(np.concatenate([edge, least, edge]), width, False)
            places = np.flatnonzero((hashes == most) & (most > 0))
            values, owner = hashes[places], np.searchsorted(offsets, places, "right") - 1
            docs = _Docs(part)
            one, n, again = _tallied(values)
            out = []
            if again.any():
                out.append(docs.pack(turn % buckets, "local", owner[again], at=values[again]))
                turn += 1
            for k, of in _deal(values[one], buckets):
                out.append(docs.pack(k, "probe", owner[one[of]], values=values[one[of]], n=n[of]))
            yield pa.RecordBatch.from_pylist(out, _PACK)

    return run


def _rows(rows: list[dict]):
    """Documents of all rows, and of each place its document, value, count and at."""
    get = lambda c, kind: np.concatenate([np.frombuffer(r[c], kind) for r in rows])
    owner = np.repeat(np.arange(len(get("keys", np.int64))), get("counts", np.uint32))
    return get("keys", np.int64), get("sames", np.int64), owner, get("values", np.uint64), get("n", np.uint32), get("at", np.int64)


def _twice(rows: list[dict], limit: int | None = None):
    """Of the probes whose value (and second hash, if they have one) occurs again: keys, text hashes, and for
    each the document, value and place; and the values in more than `limit` places."""
    keys, sames, owner, values, n, at = _rows(rows)
    check = np.concatenate([np.frombuffer(r["to"], np.uint64) for r in rows])
    back = np.unique(np.stack([values, check], axis=1), axis=0, return_inverse=True)[1].ravel() if len(check) else np.unique(values, return_inverse=True)[1]
    total = np.bincount(back, n)[back]
    ask = np.flatnonzero((total > 1) & (n == 1))
    hot = np.unique(values[total > limit]) if limit is not None else values[:0]
    return keys, sames, owner[ask], values[ask], at[ask] if len(at) else at, hot


def _met(limit: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        rows, out = table.to_pylist(), []
        for r in rows:
            if r["kind"] == "local":
                keys, sames, owner, _, _, at = _rows([r])
                out += packed(shards, "value", keys, sames, owner, at)
        probes = [r for r in rows if r["kind"] == "probe"]
        if probes:
            keys, sames, owner, values, _, hot = _twice(probes, limit)
            out += packed(shards, "value", keys, sames, owner, values.view(np.int64))
            out += packed(shards, "hot", hot.view(np.int64), None, np.arange(len(hot)), np.zeros(len(hot), np.int64))
        return pa.Table.from_pylist(out, PACK)

    return run


def _segments(length: int, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for part, data, offsets in chunks(batches, "text", CHUNK):
            _, least = _least(data, offsets, length)
            docs, out = _Docs(part), []
            local: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # document, from, to
            if not len(least):
                continue
            owner_of = np.searchsorted(offsets, np.arange(len(least)), "right") - 1
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (owner_of[1:] != owner_of[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(least)) - 1
            first, last = first[least[first] > 0], last[least[first] > 0]
            values, owner = least[first], owner_of[first]
            cold, hot = (_among(values, owner, part.column(c)) for c in ("cold", "hot"))

            at = np.flatnonzero(cold)
            one, n, again = _same_bytes(data, first[at], last[at] + length)
            if again.any():
                twin = at[again]
                local.append((owner[twin], first[twin], last[twin] + length))
            for k, of in _deal(values[at[one]], buckets):
                pick = at[one[of]]
                pick, known = pick[np.argsort(owner[pick], kind="stable")], n[of][np.argsort(owner[pick], kind="stable")]
                row = docs.pack(k, "segment", owner[pick], values=values[pick], n=known, at=first[pick] - offsets[owner[pick]], to=last[pick] - offsets[owner[pick]])
                raw = [data[a : b + length].tobytes() for a, b in zip(first[pick].tolist(), last[pick].tolist(), strict=True)]
                out.append(row | {"bytes": b"".join(raw)})

            at = np.flatnonzero(hot)
            if len(at):
                places = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[at].tolist(), last[at].tolist(), strict=True)])
                whose = owner_of[places]
                windows, check = (Spans(data, seed)(places, places + length) for seed in (1, 2))
                one, n, again = _same_bytes(data, places, places + length, windows)
                local.append((whose[again], places[again], places[again] + length))
                for k, of in _deal(windows[one], buckets):
                    pick = one[of]
                    out.append(docs.pack(k, "window", whose[pick], values=windows[pick], n=n[of], at=places[pick] - offsets[whose[pick]], to=check[pick]))
            if local:
                whose, a, b = (np.concatenate(x) for x in zip(*local, strict=True))
                out.append(docs.pack(turn % buckets, "local", whose, at=a - offsets[whose], to=b - offsets[whose]))
                turn += 1
            yield pa.RecordBatch.from_pylist(out, _PACK)

    return run


def _among(values: np.ndarray, owner: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Whether each value is in its document's list."""
    if not len(values) or not len(lists):
        return np.zeros(len(values), bool)
    starts, ends = lists.offsets.to_numpy()[:-1], lists.offsets.to_numpy()[1:]
    known = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)[starts[0] : ends[-1]]
    whose = np.repeat(np.arange(len(lists)), ends - starts)
    pair = lambda v, o: v ^ (o.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.isin(pair(values, owner), pair(known, whose))


def _verdict(length: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        kinds = {k: [r for r in rows if r["kind"] == k] for k in ("local", "window", "segment")}
        out = []
        for r in kinds["local"]:
            keys, sames, owner, _, _, at = _rows([r])
            out += packed(shards, "span", keys, sames, owner, at, np.frombuffer(r["to"], np.int64))
        if kinds["window"]:
            keys, sames, owner, _, at, _ = _twice(kinds["window"])
            out += packed(shards, "span", keys, sames, owner, at, at + length)
        if kinds["segment"]:
            keys, sames, owner, values, n, at = _rows(kinds["segment"])
            to = np.concatenate([np.frombuffer(r["to"], np.int64) for r in kinds["segment"]])
            text = np.concatenate([np.frombuffer(r["bytes"], np.uint8) for r in kinds["segment"]])
            sizes = to - at + length
            begin = np.cumsum(sizes) - sizes
            order = np.argsort(values, kind="stable")
            group = np.cumsum(np.concatenate([[0], values[order][1:] != values[order][:-1]]))
            weight = np.cumsum(to[order] - at[order] + 1)
            ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(order))
            whose, first, last, a = [], [], [], 0
            while a < len(order):
                limit = (weight[a - 1] if a else 0) + SORTED
                fits = ends[(ends > a) & (weight[ends - 1] <= limit)]
                b = int(fits[-1]) if len(fits) else int(ends[np.searchsorted(ends, a, "right")])
                own = order[a:b]
                a = b
                if len(own) == 1 and to[own[0]] - at[own[0]] < 1:
                    continue
                local = np.concatenate([text[begin[i] : begin[i] + sizes[i]] for i in own.tolist()])
                base = np.cumsum(sizes[own]) - sizes[own]
                found = repeated(local, base, base + to[own] - at[own], length)
                if not len(found):
                    continue
                seg = np.searchsorted(base, found, "right") - 1
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1] + 1) | (seg[1:] != seg[:-1])
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(found)) - 1
                seg = seg[head]
                whose.append(owner[own[seg]])
                first.append(found[head] - base[seg] + at[own[seg]])
                last.append(found[tail] - base[seg] + at[own[seg]] + length)
            if whose:
                out += packed(shards, "span", keys, sames, *(np.concatenate(x) for x in (whose, first, last)))
        return pa.Table.from_pylist(out, PACK)

    return run


def _cut(schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches, "text", CHUNK):
            n, cover = part.num_rows, np.zeros(len(data) + 1, np.int32)
            for name, sign in (("at", 1), ("to", -1)):
                column = part.column(name)
                values = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
                np.add.at(cover, values + np.repeat(offsets[:-1], np.diff(column.offsets.to_numpy())), sign)
            gone = np.cumsum(cover[:-1]) > 0
            left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
            before = np.zeros(len(gone), bool)
            before[1:] = gone[:-1]
            before[offsets[:-1][offsets[:-1] < len(gone)]] = False
            begins = np.concatenate([[0], np.cumsum(gone & ~before)])[offsets]
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(left.astype(np.int64).tobytes()), pa.py_buffer(data[~gone].tobytes())])
            sizes = np.diff(offsets)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sizes.astype(np.int64)), pa.array(sizes - np.diff(left)).cast(pa.int64()), pa.array(np.diff(begins).astype(np.int64)), kept.cast(pa.binary())], schema=schema)

    return run


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, limit: int = LIMIT) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary).

    Texts count as UTF-8 bytes, null as empty. A byte goes if a string of `length` bytes that covers
    it also starts anywhere else, in the same text or another; strings are those of the input and
    never cross texts. Repeated rows repeat each other. Keys are whole numbers; a null key is kept.
    Other columns are not read. length must exceed GRAM bytes.
    """
    own = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("same", F.xxhash64("text"))
    total = own.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET))
    none = F.array().cast("array<bigint>")

    met = stored(merged(own.mapInArrow(_anchors(length, buckets), _PACK_DDL).groupBy("bucket").applyInArrow(_met(limit, buckets), PACK_DDL)))
    hot = met.where("kind = 'hot'").select(F.col("key").alias("value"), F.lit(True).alias("hot"))
    asked = met.where("kind = 'value'").select("key", "same", F.explode("at").alias("value"))
    asked = asked.join(F.broadcast(hot) if hot.limit(FEW + 1).count() <= FEW else hot, "value", "left")
    lists = [F.collect_set(F.when(c, F.col("value"))).alias(name) for name, c in (("cold", F.col("hot").isNull()), ("hot", F.col("hot").isNotNull()))]
    asked = asked.groupBy(F.col("key").alias("_key"), F.col("same").alias("_same")).agg(*lists)
    mine = (F.coalesce("key", F.lit(NULL)) == F.col("_key")) & (F.col("same") == F.col("_same"))
    near = own.join(asked, mine).drop("_key", "_same")
    spans = near.mapInArrow(_segments(length, buckets), _PACK_DDL).groupBy("bucket").applyInArrow(_verdict(length, buckets), PACK_DDL)
    spans = stored(merged(spans).select(F.col("key").alias("_key"), F.col("same").alias("_same"), "at", "to"))
    cut = own.join(spans, mine, "left").select("key", "text", F.coalesce("at", none).alias("at"), F.coalesce("to", none).alias("to"))
    schema = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    return cut.mapInArrow(_cut(schema), "key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary").withColumnRenamed("key", key)
