"""Texts of an Arrow batch as bytes: words, their hashes and runs, without a loop over words."""

from __future__ import annotations

import ctypes
import hashlib
import sys
import types
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2_000_000  # bytes of text handled at once; one text may exceed it
_ODD = 0x9E3779B97F4A7C15


def kept(name: Any, make: Callable[[], Any]) -> Any:
    """What make() gives, made once in each Python process: tables and caches that tasks share."""
    box = sys.modules.setdefault("_souk_kept", types.ModuleType("_souk_kept")).__dict__
    if name not in box:
        box[name] = make()
    return box[name]


def kept_one(name: Any, make: Callable[[], Any]) -> Any:
    """As kept(), for large caches: a Python process holds one of them, for the task that asks for it
    before it reads its texts, and drops it when a task reads texts that has not asked."""
    box = kept("one", dict)
    if name not in box:
        box.clear()
        box[name] = make()
    kept("asked", set).add(name)
    return box[name]


def begin() -> None:
    """A task calls it before it reads: drops large caches that it has not asked for."""
    asked = kept("asked", set)
    if not asked and kept("one", dict):
        kept("one", dict).clear()
        give_back()
    asked.clear()


def give_back() -> None:
    """Returns memory that was freed to the system; workers live on between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def _classes(word: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(word)] = True
    return table


#: Bytes that belong to a word. UTF-8 continuation bytes always do, so bytes and code points agree.
NOT_SPACE = ~_classes([0x20, *range(0x09, 0x0E)])
ALNUM = _classes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the n+1 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    else:
        column = column.cast(pa.large_binary())
    column = pc.fill_null(column, b"")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if where else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about `limit` bytes of text, their bytes, and offsets from 0."""
    begin()
    for batch in batches:
        data, offsets = texts(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
        give_back()


def text_lists(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches with about `limit` bytes of text, and their texts."""
    begin()
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, "right")))
            part = batch.slice(at, to - at)
            yield part, part.column(column).to_pylist()
            at = to
        give_back()


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the n+1 offsets of the texts in words."""
    inside = table[data]
    before = np.empty(len(inside) + 1, bool)
    before[0] = False
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(len(inside) + 1, bool)
    after[:-1] = inside
    after[-1] = False
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all its bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# Odd factors and the seeds of the two hashes; any would do.
_FACTORS = tuple(map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
PART = 1 << 16  # hashes made at once
LONG = 1_024  # bytes from which a span is hashed on its own


class Spans:
    """64-bit hashes of any spans of one byte string, equal for equal bytes.

    Eight bytes at a time are multiplied, turned and mixed into the state, so that unlike with a
    polynomial no pattern of bytes is known to cancel out; different seeds are independent.
    """

    def __init__(self, data: np.ndarray, seed: int = 0, fold: np.ndarray | None = None):
        if fold is not None:
            data = fold[data]
        self.seed = seed
        self.size = len(data)
        self.raw = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eight = np.ndarray(self.size + 1, "<u8", self.raw, strides=(1,))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(starts) > PART:  # so that what is worked on stays in the processor's cache
            return np.concatenate([self(starts[i : i + PART], ends[i : i + PART]) for i in range(0, len(starts), PART)])
        size = ends - starts
        state = mixed(size.astype(np.uint64) + np.uint64((2 * self.seed + 1) * _ODD % 2**64))
        long = np.flatnonzero(size > LONG)
        left = np.where(size > LONG, 0, size)
        at, n, some = starts, left, slice(None)
        step = 0
        while len(n) and (step == 0 or n.max() > 8 * step):
            if step:
                keep = np.flatnonzero(n > 8 * step)
                some = keep if step == 1 else some[keep]
                at, n = at[keep], n[keep]
            state[some] = _stirred(state[some], self.eight[np.minimum(at + 8 * step, self.size)] & _MASKS[np.minimum(n - 8 * step, 8)])
            step += 1
        for i in long.tolist():
            value = hashlib.blake2b(self.raw[starts[i] : ends[i]], digest_size=8, salt=self.seed.to_bytes(8, "little")).digest()
            state[i] ^= np.uint64(int.from_bytes(value, "little"))
        return mixed(state)


def _stirred(state: np.ndarray, value: np.ndarray) -> np.ndarray:
    value = value * _FACTORS[1]
    value = ((value << np.uint64(31)) | (value >> np.uint64(33))) * _FACTORS[0]
    state = state ^ value
    return ((state << np.uint64(27)) | (state >> np.uint64(37))) * _FACTORS[0] + _FACTORS[2]


def grams(data: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of the `width` bytes (8, 16, 32 ...) from each place on: halves are mixed and put together."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    if len(data) > PART + width:
        return np.concatenate([grams(data[i : i + PART + width - 1], width, seed) for i in range(0, len(data) - width + 1, PART)])
    raw = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))
    out = _stirred(np.full(len(raw), (2 * seed + 1) * _ODD % 2**64, np.uint64), raw)
    half = 8
    while half < width:
        out ^= out >> np.uint64(32)
        out = _stirred(out[:-half] * _FACTORS[1] + _FACTORS[3], out[half:])
        half *= 2
    return mixed(out)


def runs_of(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every `width` consecutive word hashes; entry i covers words i to i + width - 1."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = np.random.default_rng(77 + seed).integers(1, 2**63, width, np.uint64) * np.uint64(2) + np.uint64(1)
    out = hashes[:n] * factors[0]
    for j in range(1, width):
        out += hashes[j : j + n] * factors[j]
    return mixed(out)


def room(bounds: np.ndarray, n: int) -> np.ndarray:
    """For each of n words, the number of words from it to the end of its text."""
    return np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Lookup:
    """Places of hashes in a sorted list; a small table turns most others away first."""

    def __init__(self, values: np.ndarray, bits: int = 20):
        self.values, self.shift = values, np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[values >> self.shift] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the known hashes, and their places in the list."""
        found = np.flatnonzero(self.maybe[hashes >> self.shift])
        at = np.searchsorted(self.values, hashes[found])
        at[at == len(self.values)] = 0
        same = self.values[at] == hashes[found] if len(self.values) else np.zeros(0, bool)
        return found[same], at[same]
