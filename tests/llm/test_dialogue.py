"""Repair against a search over all edits, row by row."""

import random
import zlib

import pytest

from souk.llm import dialogue, queries
from tests.llm import cases

SCHEMA = "conv_id long, turn long, role string, text string"


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 0:
            continue
        if harm == 1:
            text = ""
        if harm == 2:
            text = "".join(c for c in text if c not in ".!?")
        if harm == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if harm == 3 else 1)
    return out


def repaired(rows):
    """rows of one conversation, in order: the result's columns after conv_id."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        said = "".join(c for c in text if c not in " \t\n\x0b\x0c\r")
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", [])}  # by initials of the roles so far (only what matters of them)

    def short(roles):  # start, s, u or a
        return roles[-1:]

    def grown(states):
        for _ in range(3):
            for state, (cost, audit, lines) in list(states.items()):
                role = "assistant" if state == "u" else "user"
                put(states, role[0], (cost + 2, audit + "I", [*lines, f"{role}:"]))
        return states

    def put(states, state, value):
        if state not in states or value[:2] < states[state][:2]:
            states[state] = value

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for state, (cost, audit, lines) in grown(best).items():
            put(new, state, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if role[:1] in {"": "su", "s": "u", "u": "a", "a": "u"}[state] and role:
                put(new, role[0], (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            for name in ("user", "assistant"):
                if name[0] in {"": "u", "s": "u", "u": "a", "a": "u"}[state]:
                    put(new, name[0], (cost + 2 + more, audit + "R", [*lines, f"{name}:{text}"]))
        best = new
    cost, audit, lines = min((v for s, v in grown(best).items() if s in ("", "a")), key=lambda v: v[:2])
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, cases.sha("\n".join(lines)))


def wanted(rows, harm=True):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], [])
    for r in harmed(rows) if harm else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]:
        convs[r[0]].append(r)
    digest = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), bytes.fromhex(cases.sha(r[3])))
    return [(c, *repaired(sorted(own, key=digest))) for c, own in convs.items()]


def some_rows(seed, n=60):
    rnd = random.Random(seed)
    texts = ["Yes.", "Yes", "no!", "No", "", " \n", "what?", "a b", None, "long " * 2_000, "x.\t", "é."]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rnd.choice([1, 1, 2, 3, 5, 8, 13])):
            role = rnd.choice(["system", "user", "user", "assistant", "assistant", None, "", "tool", "ua", "sys"])
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 3, None]), role, rnd.choice(texts)))
    rows += rows[5:25]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "size"), [(1, 1 << 16), (2, 4), (3, 1)])
def test_repair(spark, seed, size, monkeypatch):
    monkeypatch.setattr(dialogue, "SLICE", size)
    rows = some_rows(seed)
    table = cases.clash(spark.createDataFrame(rows, SCHEMA).repartition(5), "conv", "copies", "digest", "at", "part", "moves", "kind")
    assert cases.ordered(dialogue.repair(dialogue.damaged(table), "copies").collect()) == cases.ordered(wanted(rows))
    assert cases.ordered(dialogue.repair(table).collect()) == cases.ordered(wanted(rows, harm=False))


def test_none_and_dropped(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert dialogue.repair(dialogue.damaged(none), "copies").collect() == []
    gone = next(t for t in range(1_000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    found = dialogue.repair(dialogue.damaged(spark.createDataFrame([(7, gone, "user", "x")], SCHEMA)), "copies").collect()
    assert [tuple(r) for r in found] == [(7, 0, 0, 0, 0, 0, 0, "", cases.sha(""))]


def test_least_arcs_compares_what_follows():
    import numpy as np

    # 0 -D-> 1 or (as another letter's arc) -I-> 2; the least string decides, not the first found arc
    arcs = np.full((4, 6), -1)
    arcs[1, 0], arcs[2, 0] = 1, 2
    arcs[0, 1], arcs[3, 2], arcs[3, 3] = 3, 4, 5
    assert dialogue.least_arcs(arcs).tolist() == [2, 1, 4, 4, 0, 0]


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op11_conversation_repair(spark, small)
    assert [t for _, t in found.dtypes] == ["bigint"] * 7 + ["string"] * 2
    assert cases.ordered(found.collect()) == cases.ordered(wanted(rows))
