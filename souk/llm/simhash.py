"""SimHash near-duplicates by Golay-code fuzzy hashing.

Documents of the same fingerprint are one node from the start, so copies cost nothing more. Every
distinct fingerprint gets the keys of golay.keys; those that share a key are compared where they
meet, in the task that got the key, and only verified links leave it: for a key with many
fingerprints the links of a spanning forest, never all its pairs. Connected components over the
links then name each fingerprint, and a join that splits hot fingerprints names the documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from souk.llm import golay
from souk.llm.components import components
from souk.llm.fingerprints import fingerprints
from souk.llm.store import written
from souk.operators.joins import split_join

NEAR = 3  # bits in which linked fingerprints differ at most
SMALL = 8  # fingerprints of a key whose links are all written
LARGE = 4_096  # fingerprints of a key that are compared without being cut by their bits first
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(prints), 4_096):
            some = prints[at : at + 4_096]
            rows, keys = golay.keys(some.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(some[rows])], ["key", "fp"])


def forest(prints: np.ndarray, near: int = NEAR) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what all links between these distinct fingerprints connect.

    Many are first cut by four shares of the bits in which they differ at all: of two that are linked
    one share is equal. Else each found one is compared with those that are not found yet.
    """
    varying = int(np.bitwise_or.reduce(prints ^ prints[0]))
    bits = [b for b in range(64) if varying >> b & 1]
    out = []
    if len(prints) > LARGE and len(bits) > near:
        for share in range(near + 1):
            mask = np.uint64(sum(1 << b for b in bits[share :: near + 1]))
            order = np.argsort(prints & mask, kind="stable")
            cuts = np.flatnonzero(np.diff(prints[order] & mask)) + 1
            for group in np.split(order, cuts):
                if len(group) > 1:
                    out += forest(prints[group], near)
        return out
    left = prints
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            close = np.bitwise_count(front[:64, None] ^ left[None, :]) <= near
            hit = close.any(axis=0)
            out.append((front[close[:, hit].argmax(axis=0)], left[hit]))
            front, left = np.concatenate([front[64:], left[hit]]), left[~hit]
    return out


def _linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the fingerprints of each key; rows come in order of key."""
    rest = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def links(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(keys)))
        few = np.repeat(sizes <= SMALL, sizes)
        found = []
        for step in range(1, min(SMALL, int(sizes.max(initial=0)))):
            near = (keys[step:] == keys[:-step]) & few[step:] & (np.bitwise_count(prints[step:] ^ prints[:-step]) <= NEAR)
            found.append((prints[:-step][near], prints[step:][near]))
        for k in np.flatnonzero(sizes > SMALL):
            found += forest(prints[starts[k] : starts[k] + sizes[k]])
        if found and any(len(a) for a, _ in found):
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_EDGES)

    pieces: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        keys, prints = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
        if last or (pieces and pieces[0][0][0] != keys[0]):
            ready = [*pieces, (keys[:last], prints[:last])]
            yield from links(*(np.concatenate(x) if n == 0 else np.concatenate(x).view(np.uint64) for n, x in enumerate(zip(*ready, strict=True))))
            pieces = []
        pieces.append((keys[last:], prints[last:]))
    if pieces:
        keys, prints = (np.concatenate(x) for x in zip(*pieces, strict=True))
        yield from links(keys, prints.view(np.uint64))


def links(prints: DataFrame) -> DataFrame:
    """a, b: links between the distinct fingerprints in column fp that connect whatever three bits or fewer connect."""
    keyed = prints.select("fp").mapInArrow(_keyed, "key bigint, fp bigint")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_linked, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row per document: key, fp (the fingerprint as a long) and component_id, the smallest key
    that links reach, its own included.

    A fingerprint has the bits that are set in over half of the XXH64 hashes of the text's shingles of
    `width` words (A-Z lower-cased, words split at white space, repeats counted); a text of fewer
    words is one shingle; without words, null too, the fingerprint is zero, which links like any
    other. Texts of any length are read whole. Repeated rows are rows of their own. A null key is
    never the smallest; where a component has no other, component_id is null. An empty table gives no
    rows. Other columns are not read.
    """
    name = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], f"key {name}, fp bigint").schema)
    prints = written(own.mapInArrow(fingerprints(width, arrow), f"key {name}, fp bigint"), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("key").alias("first")), "nodes")
    joined = components(links(nodes)).withColumnRenamed("node", "fp")
    linked = written(nodes.join(joined, "fp"), "linked")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = split_join(linked.select("fp", "root"), smallest, "root", "fp").select("fp", "component_id")
    labels = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return split_join(prints, labels, "fp", "key").select(F.col("key").alias(key), "fp", "component_id")


def hexed(fp: str = "fp"):
    """A fingerprint as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
