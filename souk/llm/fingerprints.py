"""SimHash fingerprints of word shingles, computed for whole Arrow batches at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from souk.llm.rawtext import LOWER, NOT_SPACE, chunks, words

# Fixed values of the XXH64 hash function.
P1, P2, P3, P4, P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of every span of the bytes. Spans are put in order of length, so that each step of the
    hash runs over a leading part of them."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, size = starts[order], size[order]
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    four = np.ndarray(len(raw) - 3, "<u4", raw, strides=(1,))
    longer = lambda n: int(np.searchsorted(-size, -n, "right"))  # noqa: E731  how many have n bytes or more
    out = np.full(len(size), np.uint64(seed) + P5, np.uint64)
    wide = longer(32)
    if wide:
        start = [(seed + int(P1) + int(P2)) % 2**64, (seed + int(P2)) % 2**64, seed, (seed - int(P1)) % 2**64]
        lanes = [np.full(wide, s, np.uint64) for s in start]
        for stripe in range(int(size[0]) // 32):
            n = longer(32 * (stripe + 1))
            for j, lane in enumerate(lanes):
                lane[:n] = _turn(lane[:n] + eight[at[:n] + (32 * stripe + 8 * j)] * P2, 31) * P1
        mixed = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
        for lane in lanes:
            mixed = (mixed ^ (_turn(lane * P2, 31) * P1)) * P1 + P4
        out[:wide] = mixed
    out += size.astype(np.uint64)
    at = at + (size & ~31)
    left = size & 31
    for n in range(3):
        some = np.flatnonzero(left >= 8 * (n + 1))
        out[some] = _turn(out[some] ^ (_turn(eight[at[some] + 8 * n] * P2, 31) * P1), 27) * P1 + P4
    at, left = at + (left & ~7), left & 7
    some = np.flatnonzero(left & 4)
    out[some] = _turn(out[some] ^ (four[at[some]].astype(np.uint64) * P1), 23) * P2 + P3
    at, left = at + (left & 4), left & 3
    for n in range(3):
        some = np.flatnonzero(left > n)
        out[some] = _turn(out[some] ^ (raw[at[some] + n].astype(np.uint64) * P5), 11) * P1
    out = (out ^ (out >> np.uint64(33))) * P2
    out = (out ^ (out >> np.uint64(29))) * P3
    back = np.empty_like(out)
    back[order] = out ^ (out >> np.uint64(32))
    return back


def _shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, repeats included, and their number in each text. Words are joined by one
    space; a text of fewer words than a shingle, but not none, is one shingle."""
    starts, ends, bounds = words(data, offsets, NOT_SPACE)
    n = np.diff(bounds)
    inside = NOT_SPACE[data]
    kept = inside.copy()
    kept[ends[ends < len(data)]] = True  # a separator after each word, or the first byte of the next text
    place = np.concatenate([[0], np.cumsum(kept)])
    joined = np.where(inside, LOWER[data], np.uint8(0x20))[kept]
    full = np.flatnonzero(np.repeat(bounds[1:], n) - np.arange(len(starts)) >= width)
    short = np.flatnonzero((n > 0) & (n < width))
    first, last = np.concatenate([full, bounds[short]]), np.concatenate([full + width - 1, bounds[short + 1] - 1])
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    return xxh64(joined, place[starts[first]], place[ends[last] - 1] + 1), np.where(n >= width, n - width + 1, np.minimum(n, 1))


def majority(hashes: np.ndarray, counts: np.ndarray, most: int = 255) -> np.ndarray:
    """For each run of `counts` hashes, the bits set in over half of them; an empty run gives 0.
    Eight counters share a number, so runs are summed in pieces of at most 255 hashes."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    pieces = -(-counts[full] // most)
    first = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
    inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = np.repeat(first, pieces) + inner * most
    groups = np.cumsum(pieces) - pieces
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(0x0101010101010101), cuts)
        lanes = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), groups, axis=0)
        over = (2 * lanes > counts[full][:, None]).astype(np.uint64)
        for lane in range(8):
            out[full] |= over[:, lane] << np.uint64(8 * lane + bit)
    return out


def fingerprints(width: int, schema: pa.Schema):
    """Adds the fingerprint of column text; the other column, key, is handed on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "text"):
            hashes, counts = _shingles(data, offsets, width)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(majority(hashes, counts).view(np.int64))], schema=schema)

    return run
