"""Rule ladders: ordered label tables turned into one CASE expression.

A ladder is data: ``[(label, [(column, op, value), ...]), ...]`` plus a
default.  Conditions of a row are ANDed, the first matching row wins, and two
rows with the same label are an OR.  A null never matches, so it falls through
to the later rows.  Keeping the tables as data lets the thresholds be read and
tested in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = {
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "in": lambda c, v: c.isin(*v),
    "is": lambda c, v: c == F.lit(v),
    "known": lambda c, v: c.isNotNull() if v else c.isNull(),
}


def condition(col_name: str, op: str, value, env: dict[str, Column]) -> Column:
    left = env.get(col_name, F.col(col_name))
    right = env.get(value[1:], F.col(value[1:])) if _is_ref(value) else value
    return _OPS[op](left, right)


def _is_ref(value) -> bool:
    return isinstance(value, str) and value.startswith("@")


def ladder(rules, default, env: dict[str, Column] | None = None) -> Column:
    """CASE expression for ``rules``.

    ``env`` maps names used in the rules to expressions; other names are
    columns.  A value or default that starts with ``@`` names a column.
    """
    env = env or {}
    branches: Column | None = None
    for label, conditions in rules:
        test = reduce(
            lambda a, b: a & b, [condition(c, op, v, env) for c, op, v in conditions]
        )
        result = _label(label, env)
        branches = F.when(test, result) if branches is None else branches.when(test, result)
    return branches.otherwise(_label(default, env))


def _label(label, env) -> Column:
    if _is_ref(label):
        return env.get(label[1:], F.col(label[1:]))
    return F.lit(label)


def choose(value: Column, options: dict, default=None) -> Column:
    """CASE value WHEN key THEN option ... ELSE default."""
    out: Column | None = None
    for key, option in options.items():
        test = value == F.lit(key)
        out = F.when(test, F.lit(option)) if out is None else out.when(test, F.lit(option))
    return out.otherwise(F.lit(default))
