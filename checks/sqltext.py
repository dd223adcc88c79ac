"""Small builders for the comparison SQL."""

from __future__ import annotations

import re

from pyspark.sql import types as T

SQL_TYPES = {
    T.LongType: "BIGINT",
    T.IntegerType: "BIGINT",
    T.DoubleType: "DOUBLE",
    T.StringType: "VARCHAR",
    T.DateType: "DATE",
    T.BooleanType: "BOOLEAN",
    T.TimestampNTZType: "TIMESTAMP",
}


def mapped_select(mapped, source: str) -> str:
    types = {f.name: SQL_TYPES[type(f.dataType)] for f in mapped.schema.fields}
    cols = ", ".join(f"CAST({e} AS {types[n]}) AS {n}" for n, e in mapped.columns.items())
    return f"SELECT {cols} FROM {source}"


def R(x: str, n: int) -> str:
    """Round half away from zero on the shortest decimal form of a double."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,20)), {n}) AS DOUBLE)"


def E(x: str) -> str:
    """Exact sum of amounts with up to eight decimals."""
    amount = f"CAST(CAST(CAST(({x}) AS DOUBLE) AS VARCHAR) AS DECIMAL(28,8))"
    return f"CAST(CAST(sum({amount}) AS VARCHAR) AS DOUBLE)"


def A(x: str) -> str:
    return f"({E(x)} / nullif(count({x}), 0))"


def P(part: str, whole: str, n: int = 2) -> str:
    return R(f"(CAST({part} AS DOUBLE) * 100 / nullif({whole}, 0))", n)


def N(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def SUM(x: str) -> str:
    return f"CAST(sum({x}) AS BIGINT)"


def low(a: str, x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN least({a}, {x}) END)"


def high(a: str, x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest({a}, {x}) END)"


def cols(spec: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in spec.items())


_SQL_OPS = {">", ">=", "<", "<=", "=", "!="}


def _value(v, names) -> str:
    if isinstance(v, str):
        return names.get(v[1:], v[1:]) if v.startswith("@") else "'" + v + "'"
    return str(v)


def case(rules, default, names: dict[str, str] | None = None) -> str:
    """CASE text of a rule table (see souk.functions.ladders)."""
    names = names or {}
    arms = []
    for label, conditions in rules:
        tests = []
        for column, op, value in conditions:
            col = names.get(column, column)
            if op in _SQL_OPS:
                tests.append(f"{col} {op} {_value(value, names)}")
            elif op == "is":
                tests.append(f"{col} IS {'TRUE' if value else 'FALSE'}")
            else:
                raise ValueError(op)
        arms.append(f"WHEN {' AND '.join(tests)} THEN {_value(label, names)}")
    return f"CASE {' '.join(arms)} ELSE {_value(default, names)} END"


def mode(source: str, key: str, column: str, out: str, nulls: bool = False) -> str:
    """Most frequent value per key, smallest on ties, as a SELECT."""
    where = "" if nulls else f" WHERE {column} IS NOT NULL"
    return (
        f"SELECT {key}, {column} AS {out} FROM (SELECT {key}, {column}, row_number() OVER "
        f"(PARTITION BY {key} ORDER BY count(*) DESC, {column} ASC NULLS LAST) AS place "
        f"FROM {source}{where} GROUP BY {key}, {column}) WHERE place = 1"
    )


def day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def moment(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def texted(source: str, days=(), moments=(), drop=()) -> str:
    """All columns of ``source`` with dates and times as text."""
    repl = [f"{day(c)} AS {c}" for c in days] + [f"{moment(c)} AS {c}" for c in moments]
    star = "*"
    if drop:
        star += f" EXCLUDE ({', '.join(drop)})"
    if repl:
        star += f" REPLACE ({', '.join(repl)})"
    return f"SELECT {star} FROM {source}"


_NAME = re.compile(r"\bm_\w+\b")


def compose(ctes: dict[str, str], query: str) -> str:
    """Prefix ``query`` with the named parts it needs, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in ctes and name not in order:
                visit(ctes[name])
                if name not in order:
                    order.append(name)

    visit(query)
    if not order:
        return query
    return "WITH " + ", ".join(f"{n} AS ({ctes[n]})" for n in order) + " " + query
