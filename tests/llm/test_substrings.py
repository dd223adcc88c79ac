import numpy as np
import pytest

from souk.llm import substrings, suffixes
from tests.llm import cases


@pytest.mark.parametrize(("bucket", "chunk"), [(16_000_000, 4_000_000), (5_000, 900)])
def test_words_against_brute_force(spark, monkeypatch, bucket, chunk):
    for name, value in (("BUCKET", bucket), ("CHUNK", chunk)):
        monkeypatch.setattr(substrings, name, value)
    rows = cases.sample()
    df = cases.clash(spark.createDataFrame(rows, cases.DOCS).repartition(5), "n_words", "kept", "hits", "at", "to")
    found = substrings.without_repeats(df).collect()
    assert cases.ordered(found) == cases.kept_words([r[:2] for r in rows], 13)


@pytest.mark.parametrize(("bucket", "chunk", "few", "limit"), [(16_000_000, 4_000_000, 2_000_000, 2000), (9_000, 700, 0, 2000), (50_000, 2_000, 2_000_000, 3), (16_000_000, 100_000, 0, 1)])
def test_bytes_against_brute_force(spark, monkeypatch, bucket, chunk, few, limit):
    for name, value in (("BUCKET", bucket), ("CHUNK", chunk), ("FEW", few)):
        monkeypatch.setattr(suffixes, name, value)
    rows = [r[:2] for r in cases.sample(3, 80, 2_000)] + [(900, "ab" * 200), (901, "x" * 150), (902, "x" * 60)]
    df = cases.clash(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "n_bytes", "kept", "at", "to", "cold", "hot")
    found = [(*r[:4], bytes(r[4])) for r in suffixes.without_repeats(df, length=60, limit=limit).collect()]
    assert cases.ordered(found) == cases.kept_bytes(rows, 60)


def test_empty_tables(spark):
    none = spark.createDataFrame([], cases.DOCS)
    assert substrings.without_repeats(none).collect() == []
    assert suffixes.without_repeats(none).collect() == []


def test_suffix_order_and_repeats():
    rnd = np.random.default_rng(4)
    for trial in range(200):
        n, depth = int(rnd.integers(30, 200)), int(rnd.integers(3, 12))
        text = rnd.integers(0, [2, 3, 26, 256][trial % 4], n).astype(np.uint8)
        if trial % 3 == 0:
            text = np.tile(text[: int(rnd.integers(1, 9))], 300)[:n].copy()
        a, b, c, d = sorted(rnd.choice(n - depth, 4, replace=False).tolist())
        first, last = np.array([a, c]), np.array([b, d])
        raw, own = text.tobytes(), {*range(a, b + 1), *range(c, d + 1)}
        order = [i for i in suffixes.suffix_order(text, first, last, depth).tolist() if i in own]
        assert sorted(order) == sorted(own)
        keys = [raw[i : i + depth] for i in order]
        assert keys == sorted(keys)
        again = [i for i in sorted(own) if sum(raw[j : j + depth] == raw[i : i + depth] for j in own) > 1]
        assert suffixes.repeated(text, first, last, depth).tolist() == again
        shared = suffixes.common_prefixes(text, np.array(order), depth).tolist()
        for k, (i, j) in enumerate(zip(order, order[1:])):
            same = next((x for x in range(depth) if raw[i + x] != raw[j + x]), depth)
            assert shared[k] == same
