"""Hashes of bytes: equal for equal bytes only, also where polynomial hashes cancel out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from souk.llm import decontaminate, neardup, rawtext, substrings, suffixes
from tests.llm import cases


def alternating(n):
    """The Thue-Morse string of n letters and its complement, whose difference most polynomials map to 0."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("size", [512, 1024, 2048, 4096])
def test_patterns_do_not_cancel(size):
    data = np.frombuffer("".join(alternating(size)).encode(), np.uint8)
    for seed in (0, 1, 2):
        one, two = rawtext.Spans(data, seed)(np.array([0, size]), np.array([size, 2 * size]))
        assert one != two
    hashes = rawtext.grams(data, 256)
    assert hashes[0] != hashes[size]


@pytest.mark.parametrize("part", [1 << 16, 7])
def test_spans_and_grams(monkeypatch, part):
    monkeypatch.setattr(rawtext, "PART", part)
    rng = np.random.default_rng(5)
    data = rng.integers(0, 3, 4_000).astype(np.uint8)
    starts = rng.integers(0, 3_900, 3_000)
    ends = np.minimum(starts + rng.choice([0, 1, 2, 7, 8, 9, 16, 17, 40, 1_500], 3_000), 4_000)
    raw = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    hashes = rawtext.Spans(data)(starts, ends).tolist()
    assert len(set(raw)) == len(set(hashes)) == len(set(zip(raw, hashes, strict=True)))
    assert set(hashes).isdisjoint(rawtext.Spans(data, 1)(starts, ends).tolist())
    found = rawtext.grams(data, 16).tolist()
    same = [data[i : i + 16].tobytes() for i in range(len(data) - 15)]
    assert len(found) == len(same) and len(set(same)) == len(set(found)) == len(set(zip(same, found, strict=True)))


@pytest.mark.parametrize("size", [512, 1024, 4096])
def test_operators_tell_patterns_apart(spark, size):
    a, b = alternating(size)
    common = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(1, " ".join([*common, a])), (2, " ".join([*common, b]))], "doc_id long, text string")
    assert [r.n_removed for r in substrings.without_repeats(docs).collect()] == [0, 0]
    want = cases.kept_bytes([tuple(r) for r in docs.collect()], 400)
    assert cases.ordered((*r[:4], bytes(r[4])) for r in suffixes.without_repeats(docs).collect()) == want
    words = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert [r.n_links for r in neardup.near_duplicates(words).collect()] == [0, 0]
    bench = words.where("doc_id = 1").withColumnRenamed("doc_id", "item_id")
    assert {r.doc_id: r.contaminated for r in decontaminate.benchmark_hits(words, bench).collect()} == {1: True, 2: False}


def test_equal_hashes_are_checked_by_bytes(spark, monkeypatch):
    """With a hash that is the same for everything, results of one task are still right."""
    rows = [(i, " ".join(f"w{(i * 7 + j) % 31}" for j in range(20))) for i in range(6)] + [(9, " ".join(f"w{j}" for j in range(20)))]
    data, offsets = rawtext.texts(__import__("pyarrow").array([t for _, t in rows]))
    starts, ends, bounds = rawtext.words(data, offsets, rawtext.NOT_SPACE)
    whole = np.flatnonzero(rawtext.room(bounds, len(starts)) >= 13)
    order, head = substrings._grouped(data, starts, ends, whole, np.zeros(len(whole), np.uint64), 13)
    raw = data.tobytes()
    window = [tuple(raw[starts[p + j] : ends[p + j]] for j in range(13)) for p in whole]
    assert head.sum() == len(set(window))
    groups = np.cumsum(head)
    assert len({(groups[k], window[i]) for k, i in enumerate(order)}) == len(set(window))
    first = np.array([0, 5, 10, 0, 7])
    one, n, again = suffixes._same_bytes(data, first, first + 30, np.zeros(5, np.uint64))
    assert len(one) == 4 and again.tolist() == [True, False, False, True, False]
