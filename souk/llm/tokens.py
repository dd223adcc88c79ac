"""Token ids of all documents as ORC files in ascending key order, and their reader.

ORC stores the integers run-length encoded in stripes, with a row index and a Bloom filter on the
key. A reader takes stripes in parallel and skips those that cannot hold a wanted key.

The files' columns are part (the file's place in the order), the key, at (ids before the document
in its part), n_tokens and ids. Parts are ranges of the sorted keys, so ids of all earlier parts,
one number each, give a document's place in the whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from souk.llm.rawtext import Spans, begin, chunks, give_back, kept_one
from souk.llm.store import slices

CACHE = 500_000  # pieces whose ids a worker remembers; a full memory is emptied
BATCH = 250_000  # bytes of text encoded at once; its arrays take many times that
# Characters up to U+024F, whose classes are certain.
_LETTERS, _DIGITS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_PLAIN = 0x250
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_APOSTROPHE, _BLANK = 0x27, 0x20


def _kinds() -> np.ndarray:
    out = np.full(_PLAIN, _OTHER, np.uint8)
    for kind, some in ((_SPACE, _SPACES), (_LETTER, _LETTERS), (_DIGIT, _DIGITS)):
        match = re.compile(f"[{some}]").match
        out[[c for c in range(_PLAIN) if match(chr(c))]] = kind
    return out


_KINDS = _kinds()


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each piece by the byte-level splitting rule, and the n+1 offsets of the texts in pieces.

    A piece is a run of letters, digits or other characters with one blank before it, if there is one; a
    contraction such as 's; or the white space before the last character of its run, or all of it at
    the end of a text. Where white space begins after a character up to U+024F the rule always cuts,
    whatever stands around; between two such places with a character beyond U+024F all is left as one
    piece, for the library to cut.
    """
    n = len(data)
    odd = None
    high = np.flatnonzero(data >= 0xC0)
    chars, code = None, data
    if len(high):
        lead = data[high].astype(np.int32)
        value = (lead & 0x1F) << 6 | data[np.minimum(high + 1, n - 1)] & 0x3F
        code = data.astype(np.int32)
        code[high] = np.where((lead >= 0xE0) | (value >= _PLAIN), -1, value)
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        code = code[chars]
        odd = np.flatnonzero(code < 0)
        code[odd] = 0x41
        offsets = np.searchsorted(chars, offsets)
    m = len(code)
    kind = _KINDS[code]
    edge = np.zeros(m + 1, bool)  # the first character of a text, and behind the last
    edge[offsets] = True
    change = np.empty(m, bool)
    if m:
        change[0] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= edge[:-1]
    blank = np.zeros(m, bool)  # whether the character before, of the same text, is a blank
    blank[1:] = (code[:-1] == _BLANK) & ~edge[1:m]
    space = kind == _SPACE
    start = change & (space | ~blank)
    last = np.zeros(m, bool)  # white space before a character of the same text that is none
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:m]
    start |= last
    quote = np.flatnonzero((code == _APOSTROPHE) & start)
    if len(quote):  # contractions start a piece; what follows them another
        room = np.append(offsets, m)[np.searchsorted(offsets, quote, "right")] - quote
        at = lambda k: code[np.minimum(quote + k, m - 1)]
        one, two = at(1), at(2)
        is_in = lambda x, some: np.isin(x, [ord(c) for c in some])
        short = (room > 1) & is_in(one, "stmd")
        long = (room > 2) & ((is_in(one, "rv") & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for some, size in ((short, 2), (long, 3)):
            of = quote[some]
            start[of + 1] = False
            more = of + size
            start[more[more < m]] = True
    if odd is not None and len(odd):
        cut = change & space
        cut[odd[odd + 1 < m] + 1] = False  # what such a character is, is not known here
        cut |= edge[:-1]
        stretch = np.cumsum(cut)
        has = np.zeros(int(stretch[-1]) + 1, bool)
        has[stretch[odd]] = True
        start = np.where(has[stretch], cut, start)
    begin = np.flatnonzero(start)
    bounds = np.searchsorted(begin, offsets)
    return (begin if chars is None else chars[begin]), bounds


class Memory:
    """Ids of pieces by the hash of a piece: open addressing over arrays, found for many at once."""

    BITS = 20

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.mask, self.shift = np.int64((1 << self.BITS) - 1), np.uint64(64 - self.BITS)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.at = np.zeros(int(self.mask) + 1, np.int32)
        self.counts = np.zeros(int(self.mask) + 1, np.int32)
        self.ids, self.used, self.size = np.zeros(1 << 16, np.int32), 0, 0

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """For each hash (not 0) its slot, or the free one where it would go."""
        slot = (hashes >> self.shift).astype(np.int64)
        wrong = np.flatnonzero((self.keys[slot] != hashes) & (self.keys[slot] != 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            there = self.keys[slot[wrong]]
            wrong = wrong[(there != hashes[wrong]) & (there != 0)]
        return slot

    def grow(self) -> None:
        """Twice as many slots, for one batch with more different pieces than are remembered."""
        full = np.flatnonzero(self.keys)
        keys, at, counts = self.keys[full], self.at[full], self.counts[full]
        self.mask, self.shift = self.mask * 2 + 1, self.shift - np.uint64(1)
        self.keys, self.at, self.counts = (np.zeros(int(self.mask) + 1, x.dtype) for x in (keys, at, counts))
        self._place(keys, at, counts)

    def add(self, hashes: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> None:
        """New, different hashes, the ids of all one after another, and the number of each."""
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(2 * (self.used + len(flat)), np.int32)])
        self.ids[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(counts) - counts
        self.used, self.size = self.used + len(flat), self.size + len(hashes)
        self._place(hashes, at, counts)

    def _place(self, hashes: np.ndarray, at: np.ndarray, counts: np.ndarray) -> None:
        left = np.arange(len(hashes))
        while len(left):
            slot = self.slots(hashes[left])
            slot, first = np.unique(slot, return_index=True)
            own = left[first]
            self.keys[slot], self.at[slot], self.counts[slot] = hashes[own], at[own], counts[own]
            left = np.delete(left, first)


class Encoder:
    """Ids of texts by the tokenizers library. The byte-level rule splits a text into pieces that are encoded
    apart, so a piece seen before takes its ids from memory. The library gets a text whole if it has a
    special token, and every text if the model has another rule or a normaliser."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model)
        parts = json.loads(model)
        rule = parts.get("pre_tokenizer") or {}
        bare = {"type": "ByteLevel", "add_prefix_space": False}
        self.known_rule = parts.get("normalizer") is None and rule.get("use_regex", True) and {k: rule.get(k) for k in bare} == bare
        self.known_rule &= parts.get("truncation") is None and parts.get("padding") is None
        words = self.model.get_vocab()
        self.lengths = np.zeros(max(words.values(), default=0) + 1, np.int64)  # bytes of each token
        for token, i in words.items():
            self.lengths[i] = len(token)
        self.special = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        self.memory = Memory()

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of each text's."""
        texts = len(offsets) - 1
        raw = data.tobytes()
        whole = np.full(texts, not self.known_rule)
        if self.known_rule:
            begin, bounds = pieces(data, offsets)
            for token in self.special:
                at = raw.find(token) if token else -1
                while at >= 0:
                    whole[np.searchsorted(offsets, at, "right") - 1] = True
                    at = raw.find(token, at + 1)
        else:
            begin, bounds = np.zeros(0, np.int64), np.zeros(texts + 1, np.int64)
        own = np.repeat(~whole, np.diff(bounds))
        end = np.append(begin[1:], len(data))[own]
        begin, owner = begin[own], np.repeat(np.arange(texts), np.diff(bounds))[own]
        slot = self._known(raw, data, begin, end)
        many = self.memory.counts[slot].astype(np.int64)
        counts = np.bincount(owner, many, texts).astype(np.int64)
        rest = {int(i): ids for i, ids in zip(np.flatnonzero(whole), self._library([raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace") for i in np.flatnonzero(whole)]), strict=True)}
        for i, ids in rest.items():
            counts[i] = len(ids)
        first = np.cumsum(many) - many
        flat = self.memory.ids[np.repeat(self.memory.at[slot] - first, many) + np.arange(many.sum())]
        if rest:
            out, place = np.zeros(counts.sum(), np.int32), np.cumsum(counts) - counts
            out[np.repeat(~whole, counts)] = flat
            for i, ids in rest.items():
                out[place[i] : place[i] + len(ids)] = ids
            flat = out
        return flat, counts

    def _known(self, raw: bytes, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The memory's slots of pieces; new ones are encoded first."""
        hashes = Spans(data)(begin, end) | np.uint64(1)
        if self.memory.size > CACHE:
            self.memory.clear()
        slot = self.memory.slots(hashes)
        new = np.flatnonzero(self.memory.keys[slot] == 0)
        if not len(new):
            return slot
        values, one = np.unique(hashes[new], return_index=True)
        while 2 * (self.memory.size + len(values)) > len(self.memory.keys):
            self.memory.grow()
        some = new[one]
        order, ids, counts = self._encoded([raw[a:b] for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True)])
        self.memory.add(values[order], ids, counts)
        return self.memory.slots(hashes)

    def _encoded(self, new: list[bytes], together: int = 1_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the pieces, their ids in that order one after another, and the number of each.

        Pieces of a blank and letters are given to the library many at once, as a text that the rule cuts
        into just these pieces; how many bytes each token stands for tells whose it is.
        """
        texts = [x.decode("utf-8", "replace") for x in new]
        plain = np.array([x[0] == " " and x[1:].isalpha() and max(x) < chr(_PLAIN) for x in texts], bool)
        joint, alone = np.flatnonzero(plain), np.flatnonzero(~plain)
        sizes = np.array([len(x) for x in new], np.int64)
        ids, counts = [], []
        for a in range(0, len(joint), together):
            of = joint[a : a + together]
            own = np.array(self._library(["".join([texts[i] for i in of.tolist()])])[0], np.int32)
            last = np.searchsorted(np.cumsum(self.lengths[own]), np.cumsum(sizes[of]))
            ids.append(own)
            counts.append(np.diff(last, prepend=-1))
        each = self._library([texts[i] for i in alone.tolist()])
        ids.append(np.array([i for x in each for i in x], np.int32))
        counts.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate([joint, alone]), np.concatenate(ids), np.concatenate(counts)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]


def _encode(model: str, end: int, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_one(("encoder", zlib.crc32(model.encode())), lambda: Encoder(model))
        at = 0
        for rows, data, offsets in chunks(batches, "text", BATCH):
            ids, n = encoder(data, offsets)
            bounds = np.concatenate([[0], np.cumsum(n + 1)])
            with_end = np.full(bounds[-1], end, np.int32)
            with_end[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            n, flat = n + 1, pa.array(with_end)
            yield pa.RecordBatch.from_arrays([rows.column("part"), rows.column("key"), pa.array(at + bounds[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat)], names=["part", "key", "at", "n_tokens", "ids"]).cast(schema)
            at += int(bounds[-1])

    return run


def write_tokens(docs: DataFrame, path: str, model: str, key: str = "doc_id", text: str = "text", end: int = 0, stripe_mb: int = 16) -> None:
    """Encodes every whole text, adds `end`, and writes the files. model: the tokenizer's JSON text.

    Null counts as empty, so each row has one id at least. Null keys come first; equal keys keep
    their own rows, by hash of the text. No rows: one file without rows. Other columns are left out.
    """
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    own = own.repartitionByRange(slices(docs.sparkSession), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    kind = docs.schema[key].dataType.simpleString()
    schema = f"part int, key {kind}, at bigint, n_tokens bigint, ids array<int>"
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    rows = own.mapInArrow(_encode(model, end, arrow), schema).withColumnRenamed("key", key)
    rows.write.option("orc.bloom.filter.columns", key).option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.stripe.size", str(stripe_mb << 20)).option("orc.row.index.stride", "10000").option("compression", "zstd").orc(path)


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """The documents of the files that meet `where`, with start: ids of all documents before each.

    A condition on the key reaches the files, whose Bloom filters and indexes skip stripes.
    """
    files = spark.read.orc(path)
    ends = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = ends.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    wanted = files if where is None else files.where(where)
    return wanted.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("at")).drop("part", "at", "before")


def _checked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, start, n_tokens and ids_crc32 of rows with key, start and ids; ids are not copied."""
    begin()  # the tasks before have left an encoder
    for batch in batches:
        ids = batch.column("ids")
        at = ids.offsets.to_numpy()
        raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        out = pa.RecordBatch.from_arrays([batch.column("key"), batch.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])
        del batch, ids, raw
        give_back()
        yield out


def checksums(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers), from the ids read."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), "start", "ids").mapInArrow(_checked, f"key {kind}, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("key", key)
