"""Findings about many documents, packed as arrays and brought together by document.

Tasks that work on buckets of hashes find something in a few places of many documents each. Sent as
a row for each document and bucket these would be far more rows than documents; so each task packs
them by a hash of the key into shards, and one task a shard merges them to one row per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from souk.llm.rawtext import mixed

PACK = pa.schema([("shard", pa.int32()), ("kind", pa.string()), *((c, pa.binary()) for c in ("keys", "sames", "counts", "at", "to"))])
PACK_DDL = "shard int, kind string, keys binary, sames binary, counts binary, at binary, to binary"
_MERGED = pa.schema([("key", pa.int64()), ("same", pa.int64()), ("kind", pa.string()), ("at", pa.list_(pa.int64())), ("to", pa.list_(pa.int64()))])


def packed(shards: int, kind: str, keys: np.ndarray, sames: np.ndarray | None, owner: np.ndarray, at: np.ndarray, to: np.ndarray | None = None) -> list[dict]:
    """A row for each shard; owner: for each place its document, an index to keys and sames (none: 0)."""
    docs, back, counts = np.unique(owner, return_inverse=True, return_counts=True)
    order = np.argsort(back, kind="stable")
    shard = (mixed(keys[docs].view(np.uint64)) % np.uint64(shards)).astype(np.int64)
    out = []
    for k in np.unique(shard).tolist():
        mine = np.flatnonzero(shard == k)
        places = order[np.repeat(shard, counts) == k]
        row = {"shard": k, "kind": kind, "keys": keys[docs[mine]].tobytes(), "sames": (np.zeros(len(mine), np.int64) if sames is None else sames[docs[mine]]).tobytes(), "counts": counts[mine].astype(np.uint32).tobytes()}
        out.append(row | {"at": at[places].astype(np.int64).tobytes(), "to": b"" if to is None else to[places].astype(np.int64).tobytes()})
    return out


def _merge(table: pa.Table) -> pa.Table:
    out, rows = [], table.to_pylist()
    for kind in sorted({r["kind"] for r in rows}):
        own = [r for r in rows if r["kind"] == kind]
        get = lambda c, t, own=own: np.concatenate([np.frombuffer(r[c], t) for r in own])
        docs = np.stack([get("keys", np.int64), get("sames", np.int64)], axis=1)
        docs, back = np.unique(docs, axis=0, return_inverse=True)
        owner = np.repeat(back.ravel(), get("counts", np.uint32))
        at, to = get("at", np.int64), get("to", np.int64)
        if len(to):
            owner, at, to = _joined(owner, at, to)
        else:
            order = np.argsort(owner, kind="stable")
            owner, at = owner[order], at[order]
        bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(docs)))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) if len(x) else pa.nulls(len(docs), pa.list_(pa.int64())) for x in (at, to)]
        out.append(pa.RecordBatch.from_arrays([pa.array(docs[:, 0]), pa.array(docs[:, 1]), pa.array([kind] * len(docs), pa.string()), *lists], schema=_MERGED))
    return pa.Table.from_batches(out, _MERGED)


def _joined(owner: np.ndarray, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches at..to of each document, those that touch joined, in order."""
    order = np.lexsort((at, owner))
    owner, at, to = owner[order], at[order], to[order]
    wide = int(to.max()) + 1
    reach = np.maximum.accumulate(owner * wide + to)  # the end so far, within the document
    new = np.ones(len(at), bool)
    new[1:] = owner[1:] * wide + at[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return owner[first], at[first], reach[np.append(first[1:], len(at)) - 1] - owner[first] * wide


def merged(rows: DataFrame) -> DataFrame:
    """key, same, kind, at, to (lists), one row for each document and kind.

    Stretches from at to `to` are joined where they touch; to is null where none was given.
    """
    return rows.groupBy("shard").applyInArrow(_merge, "key bigint, same bigint, kind string, at array<bigint>, to array<bigint>")
