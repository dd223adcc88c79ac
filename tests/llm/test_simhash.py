"""Fingerprints against the hash library, Golay keys and links against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from souk.llm import golay, queries, simhash
from souk.llm.fingerprints import majority, xxh64
from tests.llm import cases


def fingerprint(text, width=3):
    w = cases.words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(rows):
    """rows of (key, text): key, fingerprint, smallest key reached."""
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    return [(k, f"{p:016x}", min((x for x in least[find(i)] if x is not None), default=None)) for i, ((k, _), p) in enumerate(zip(rows, prints, strict=True))]


def test_hash_of_any_length():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 3_000).astype(np.uint8)
    starts = rng.integers(0, 2_500, 2_000)
    ends = starts + rng.integers(0, 400, 2_000)
    ends[:200] = starts[:200]
    assert xxh64(data, starts, ends).tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(starts, ends, strict=True)]


def test_majority_of_many():
    rng = np.random.default_rng(2)
    counts = np.array([0, 1, 2, 255, 256, 5_000, 0])
    hashes = rng.integers(0, 2**63, counts.sum(), np.uint64)
    hashes[-5_000:] |= np.uint64(1 << 40)
    at, want = 0, []
    for n in counts:
        part = [int(x) for x in hashes[at : at + n]]
        want.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in part) > n))
        at += n
    assert majority(hashes, counts).tolist() == want


def test_golay_code_is_perfect():
    assert (golay._ERRORS >= 0).all() and len(set(golay._ERRORS.tolist())) == 2**11
    assert (np.bincount(golay.index(np.arange(2**23)), minlength=2**12) == 2**11).all()
    word = np.array([m << 11 ^ golay._remainder(m << 11) for m in range(2**12)])
    assert (golay.index(word) == np.arange(2**12)).all() and (golay.index(word ^ 0b1010001) == np.arange(2**12)).all()


@pytest.mark.parametrize("errors", [0, 1, 2, 3])
def test_close_prints_share_a_key(errors):
    rnd = random.Random(errors)
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), errors):
            b ^= 1 << bit
        rows, keys = golay.keys(np.array([a, b], np.uint64))
        assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())


@pytest.mark.parametrize("large", [4_096, 5])
def test_forest_connects_what_pairs_do(large, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", large)
    rnd = random.Random(3)
    seeds = [rnd.getrandbits(64) for _ in range(12)]
    prints = sorted({s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))) for s in seeds for _ in range(40)})

    def parts(pairs):
        root = {p: p for p in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for p in prints:
            groups.setdefault(find(p), set()).add(p)
        return sorted(map(sorted, groups.values()))

    found = simhash.forest(np.array(prints, np.uint64))
    pairs = [(int(x), int(y)) for a, b in found for x, y in zip(a, b, strict=True)]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    assert parts(pairs) == parts([(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3])


def test_near_duplicates(spark):
    rnd = random.Random(8)
    rows = [r[:2] for r in cases.sample(6)] + [(None, "..."), (None, None), (7, " \t"), (8, "One two"), (9, "one TWO"), (10, "one")]
    base = [rnd.choice("abcdefgh") + str(rnd.randint(0, 99)) for _ in range(400)]
    for i in range(60):  # a group of near copies
        some = list(base)
        for _ in range(rnd.randint(0, 6)):
            some[rnd.randrange(len(some))] = "x" + str(rnd.randint(0, 9))
        rows.append((1_000 + i, "\n".join(some)))
    docs = cases.clash(spark.createDataFrame([(*r, None, None, None) for r in rows], cases.DOCS).repartition(5), "fp", "root", "first", "component_id")
    found = simhash.near_duplicates(docs).select("doc_id", simhash.hexed(), "component_id")
    assert cases.ordered(found.collect()) == cases.ordered(classes(rows))
    assert simhash.near_duplicates(docs.where("false")).collect() == []


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    found = queries.op12_simhash_near_dedup(spark, small)
    assert found.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert cases.ordered(found.collect()) == cases.ordered(classes(rows))
