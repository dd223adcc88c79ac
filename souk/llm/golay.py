"""Golay-code fuzzy hashing: close bit strings meet under a common key.

The binary Golay code is perfect: each string of 23 bits is within three bits of exactly one of 4,096
code words, whose number is its index. A string and all strings one bit away decode to few code words
(one, or six), so two strings that differ in one bit share an index if one of them asks for its
neighbours' indices too. One bit changes the parity, so only strings of even parity need to ask.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

GENERATOR = 0xAE3  # fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
BITS, CHECK = 23, 11
PARTS = (22, 21, 21)  # bits of the three parts of a fingerprint, the lowest first


def _remainder(value: int) -> int:
    for bit in range(BITS - 1, CHECK - 1, -1):
        if value >> bit & 1:
            value ^= GENERATOR << (bit - CHECK)
    return value


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The remainders of each byte at each of three places, and for each remainder its error of three bits at most."""
    bits = [_remainder(1 << b) for b in range(BITS)]
    places = np.zeros((3, 256), np.int64)
    for place in range(3):
        for value in range(256):
            for b in range(8):
                if value >> b & 1 and 8 * place + b < BITS:
                    places[place, value] ^= bits[8 * place + b]
    errors = np.full(1 << CHECK, -1, np.int64)
    for weight in range(4):
        for some in combinations(range(BITS), weight):
            at = 0
            for b in some:
                at ^= bits[b]
            errors[at] = sum(1 << b for b in some)
    return places, errors


_PLACES, _ERRORS = _tables()


def index(strings: np.ndarray) -> np.ndarray:
    """The number of the code word nearest to each string of 23 bits."""
    strings = strings.astype(np.int64)
    rest = _PLACES[0][strings & 255] ^ _PLACES[1][strings >> 8 & 255] ^ _PLACES[2][strings >> 16]
    return (strings ^ _ERRORS[rest]) >> CHECK


def indices(strings: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and index pairs, in order of row: strings of `bits` bits that differ in one bit at most have one in common."""
    own = index(strings)
    asks = np.flatnonzero(np.bitwise_count(strings) % 2 == 0)
    near = index(strings[asks][:, None] ^ np.array([0, *(1 << b for b in range(bits))], strings.dtype)[None, :])
    near.sort(axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    rows = np.concatenate([np.setdiff1d(np.arange(len(strings)), asks), asks[np.nonzero(new)[0]]])
    found = np.concatenate([np.delete(own, asks), near[new]])
    order = np.argsort(rows, kind="stable")
    return rows[order], found[order]


def _times(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of indices of the same row, as one number of 12 more bits."""
    rows, found = left
    counts = np.bincount(right[0], minlength=n)
    first = np.cumsum(counts) - counts
    many = counts[rows]
    inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(rows, many), np.repeat(found, many) << 12 | right[1][np.repeat(first[rows], many) + inner]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key pairs: any two 64-bit fingerprints that differ in three bits at most share a key.

    Three errors over three parts leave one part whole and another with one error at most, or put one
    error into each part. So a key is a whole part and an index of another, or an index of each part.
    """
    n = len(prints)
    parts, at = [], 0
    for bits in PARTS:
        parts.append((prints >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64))
        at += bits
    found = [indices(part, bits) for part, bits in zip(parts, PARTS, strict=True)]
    kinds = [(a, b) for a in range(3) for b in range(3) if a != b]
    rows = [found[b][0] for _, b in kinds]
    out = [kind << 36 | parts[a][found[b][0]] << 12 | found[b][1] for kind, (a, b) in enumerate(kinds)]
    every = _times(_times(found[0], found[1], n), found[2], n)
    return np.concatenate([*rows, every[0]]), np.concatenate([*out, len(kinds) << 36 | every[1]])
