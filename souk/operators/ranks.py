"""Global row numbers and NTILE without a single-partition sort.

A window without PARTITION BY moves every row to one task.  Here the narrow
(order columns, key) frame is range-partitioned and sorted once; a row's
global number is its position in its partition plus the size of all earlier
partitions.  The sorted frame is written to the shared store, so partition
borders and positions stay fixed however often tasks are retried.

Orders must be total: always end ``order`` with a unique key column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.sources.store import Store

_POSITION_BITS = 33  # fixed value: layout of monotonically_increasing_id


@dataclass(frozen=True)
class Asc:
    """Ascending, nulls last (null counts as the largest value)."""

    name: str
    descending = False


@dataclass(frozen=True)
class Desc:
    """Descending, nulls first."""

    name: str
    descending = True


def _sort_column(spec) -> Column:
    col = F.col(spec.name)
    return col.desc_nulls_first() if spec.descending else col.asc_nulls_last()


def _slices(df: DataFrame, wanted: int | None) -> int:
    return wanted or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sorted_slices(
    df: DataFrame, order, store: Store, name: str, slices: int | None = None
) -> DataFrame:
    """``df`` in global order, cut into slices: adds ``_slice`` and ``_pos``.

    Rows of one hot key fall into several slices, since the cut may be at any
    tuple of the order columns.
    """
    slices = _slices(df, slices)
    by = [_sort_column(s) for s in order]
    place = F.monotonically_increasing_id()
    placed = (
        df.repartitionByRange(slices, *by)
        .sortWithinPartitions(*by)
        .withColumn("_place", place)
        .withColumn("_slice", F.shiftright("_place", _POSITION_BITS).cast("int"))
        .withColumn("_pos", F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("_place")
    )
    return store.replace(f"_ranked/{name}", placed)


def _offsets(placed: DataFrame) -> DataFrame:
    """Rows before each slice; one row per slice, so it is tiny and bounded."""
    sizes = placed.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def global_row_number(
    df: DataFrame, order, store: Store, name: str, out: str = "row_number", slices: int | None = None
) -> DataFrame:
    """``df`` plus its 1-based row number under ``order``."""
    placed = sorted_slices(df, order, store, name, slices)
    numbered = placed.join(F.broadcast(_offsets(placed)), "_slice")
    return numbered.select(*df.columns, (F.col("_before") + F.col("_pos") + 1).alias(out))


def group_row_number(
    df: DataFrame, by: list[str], order, store: Store, name: str, out: str = "row_number", slices: int | None = None
) -> DataFrame:
    """``df`` plus its 1-based row number within its group, for groups of any size.

    A window by group puts a hot group into one task.  Here a group may lie in
    several slices of the global order; only its first number is looked up, by
    (group, slice), so no task gets more than a slice's rows of it.  Rows with
    a null in ``by`` belong to no group and are left out.
    """
    known = df.dropna(subset=by)
    placed = sorted_slices(known, [*[Asc(c) for c in by], *order], store, name, slices)
    numbered = placed.join(F.broadcast(_offsets(placed)), "_slice")
    numbered = numbered.withColumn("_n", F.col("_before") + F.col("_pos") + 1)
    pieces = numbered.groupBy(*by, "_slice").agg(F.min("_n").alias("_least"))
    firsts = pieces.groupBy(*by).agg(F.min("_least").alias("_first"))
    starts = pieces.join(firsts, by).select(*by, "_slice", "_first")
    rows = numbered.join(starts, [*by, "_slice"])
    return rows.select(*df.columns, (F.col("_n") - F.col("_first") + 1).alias(out))


def ntile_columns(
    df: DataFrame,
    buckets: int,
    measures: dict,
    key: str,
    store: Store,
    name: str,
    slices: int | None = None,
) -> dict[str, Column]:
    """NTILE(``buckets``) expressions for rows of ``df``, one per measure.

    ``measures`` maps an output name to the ``Asc`` or ``Desc`` numeric column
    it ranks; ties are ordered by the unique ``key``.  All measures share one
    sorted pass: their rows are laid one after the other, (measure, value,
    key).  Only the last row of each bucket matters: at most ``buckets - 1``
    tuples per measure are looked up and become literals, so scoring ``df``
    afterwards is a plain projection without a join back.  Values are compared
    as doubles (whole numbers below 2^53 stay exact).
    """
    specs = list(measures.values())
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("_m"), _hole(s).alias("_hole"), _signed(s).alias("_v"))
            for i, s in enumerate(specs)
        ]
    )
    long = df.select(key, F.explode(cells).alias("cell")).select("cell.*", key)
    order = [Asc(c) for c in ("_m", "_hole", "_v", key)]
    placed = sorted_slices(long, order, store, name, slices)
    total = placed.count() // len(specs)
    lasts = _bucket_ends(total, buckets)
    wanted = [m * total + n for m in range(len(specs)) for n in lasts]
    number = F.col("_before") + F.col("_pos") + 1
    numbered = placed.join(F.broadcast(_offsets(placed)), "_slice").withColumn("_rn", number)
    # At most buckets - 1 rows per measure reach the driver.
    edges = {r["_rn"]: r for r in numbered.filter(F.col("_rn").isin(wanted)).collect()}
    return {
        out: _tile(spec, key, [edges[m * total + n] for n in lasts])
        for m, (out, spec) in enumerate(measures.items())
    }


def _hole(spec) -> Column:
    """0/1 so that nulls sort last when ascending and first when descending."""
    known = F.col(spec.name).isNotNull()
    return (known if spec.descending else ~known).cast("int")


def _signed(spec) -> Column:
    value = F.coalesce(F.col(spec.name).cast("double"), F.lit(0.0))
    return F.lit(0.0) - value if spec.descending else value


def _bucket_ends(total: int, buckets: int) -> list[int]:
    """Row numbers of the last rows of all buckets but the last non-empty one."""
    small, bigger = divmod(total, buckets)
    ends, end = [], 0
    for bucket in range(buckets):
        end += small + (1 if bucket < bigger else 0)
        ends.append(end)
    return sorted({n for n in ends if 0 < n < total})


def _tile(spec, key: str, edges) -> Column:
    tile = F.lit(1)
    for edge in edges:
        hole, value = _hole(spec), _signed(spec)
        later_key = (value == edge["_v"]) & (F.col(key) > F.lit(edge[key]))
        later = (hole == edge["_hole"]) & ((value > edge["_v"]) | later_key)
        tile = tile + F.when((hole > edge["_hole"]) | later, 1).otherwise(0)
    return tile
