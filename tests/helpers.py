"""Small frames from dicts, and comparison of results."""

import datetime as dt

from pyspark.sql import types as T

_KINDS = {
    int: T.LongType(),
    float: T.DoubleType(),
    str: T.StringType(),
    bool: T.BooleanType(),
    dt.date: T.DateType(),
    dt.datetime: T.TimestampNTZType(),
}


def typed(spark, schema, rows):
    """Frame with ``schema``; missing columns are null."""
    return spark.createDataFrame([tuple(r.get(n) for n in schema.fieldNames()) for r in rows], schema)


def frame(spark, rows, **kinds):
    """Frame from dicts; the type of a column is that of its first known value."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    fields = []
    for n in names:
        known = next((r[n] for r in rows if r.get(n) is not None), None)
        fields.append(T.StructField(n, kinds.get(n) or _KINDS[type(known)]))
    return typed(spark, T.StructType(fields), rows)


def by(df, key):
    return {r[key]: r for r in df.collect()}


def as_set(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def plan_text(df):
    return df._jdf.queryExecution().toString()
