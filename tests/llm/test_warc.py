import random

import pytest

from souk.llm import warc
from souk.llm.store import fresh
from tests.llm import cases

NASTY = ["WARC/1.", "WARC/1.1\r\n", "\r\n\r\n", "\r\n", "\n", "Content-Length: 5\r\n", "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "é", "x" * 50, "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"]


@pytest.mark.parametrize("split", ["128m", "3k"])
@pytest.mark.parametrize("few", [100_000, 0])
def test_round_trip(spark, monkeypatch, split, few):
    monkeypatch.setattr(warc, "FEW", few)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    rnd, rows = random.Random(5), []
    for i in range(200):
        html = None if i % 50 == 0 else "".join(rnd.choice(NASTY) for _ in range(rnd.randint(0, 12)))
        rows.append((i if i % 60 else None, None if i % 7 == 0 else f"http://a/WARC/1.1\r\n{i}", html))
    rows += [(1000 + i, "u", "same" * 60) for i in range(20)] + [(1003, "u", "same" * 60)] * 2 + [(1000, "v", "same" * 60)]
    rows += [(2000, "u", "s" * 99), (2001, "u", "s" * 99), (2002, "u", "s" * 100), (2003, "u", "s" * 100), (None, "u", "s" * 100)]
    try:
        path = fresh(spark, "warc")
        warc.write_warc(cases.clash(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(3), "record_type", "digest", "payload", "uri", "first"), path)
        found = warc.read_warc(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first: dict = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    want = []
    for i, _, html in rows:
        raw, to = (html or "").encode(), first.get(html or "")
        again = to is not None and i != to and sum(r[2] == html for r in rows) > 1
        want.append(("" if i is None else str(i), "revisit" if again else "response", str(to) if again else None, cases.sha(raw), len(raw), b"" if again else raw))
    assert cases.ordered((r.record_id, r.record_type, r.refers_to or None, r.digest, r.length, bytes(r.payload)) for r in found) == cases.ordered(want)


def test_empty(spark):
    path = fresh(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).collect() == []


def test_broken_chain(spark, tmp_path):
    """What stands after a wrong length is left out; a record cut off by the end too."""
    good = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{}>\r\nContent-Length: {}\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((good.format(1, 3) + good.format(2, 4) + good.format(3, 3)).encode())
    (tmp_path / "b.warc").write_bytes((good.format(4, 3) + good.format(5, 300)).encode())
    (tmp_path / "c.warc").write_bytes(("junk" + good.format(6, 3)).encode())
    found = sorted(r.record_id for r in warc.read_warc(spark, str(tmp_path)).collect())
    assert found == ["1", "4"] or found == ["1", "2", "4"]


@pytest.mark.parametrize("split", ["128m", "64k"])
@pytest.mark.parametrize("tail", ["", "x\r\n", "x\r\n\r\n"])
def test_record_starts_around_a_buffer_edge(spark, tmp_path, split, tail):
    """Records after an empty payload or one that ends in line ends, with the start at each offset around the reader's 64 KB."""

    def record(i, body):
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"

    want, before = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    rest = "".join(record(i, tail) for i in range(2, 10))
    for edge in range(-12, 24):
        bare = len(record(0, "a" * 50_000) + record(1, tail)) - 50_000
        raw = record(0, "a" * ((1 << 16) + edge - bare)) + record(1, tail) + rest
        assert raw.index("WARC/1.", (1 << 16) + edge) == (1 << 16) + edge
        (tmp_path / f"{edge + 12}.warc").write_bytes(raw.encode())
        want += [(str(i), (1 << 16) + edge - bare if i == 0 else len(tail)) for i in range(10)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = [(r.record_id, len(r.payload)) for r in warc.read_warc(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(found) == sorted(want)
