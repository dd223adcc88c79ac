"""Repair of conversations: the cheapest edits that give a legal order of roles, the least audit among them.

Rows are put in order once, in narrow form, and cut into slices of 65,536; a slice is a task's work, and a
conversation may fill any number of slices.

1. Cost DP. A node is a place between two rows and a state of the roles written so far. Each slice gives,
   for each conversation in it, the least costs from each state before its rows to each state after; chained
   from the end, these give the costs that every slice needs to know of what follows it.
2. Path ranking by prefix doubling. In each slice all nodes get their optimal arcs. Nodes are ranked by the
   first letter of their least audit, then by two letters, four, eight: the rank of twice the length is the
   rank of the pair (own rank, rank of the node that the doubled pointer leads to). The arc with the least
   letter and then the least ranked end is the node's move.
3. The rows stream once more, with their texts, through the moves: letters, costs and the hash of the
   repaired conversation, without holding more than one row.

Two arcs of a node never share a letter, so ranks beyond a slice's end cannot decide a move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.store import written

SLICE = 1 << 16  # rows that a task holds at once, in narrow form
LETTERS = "DIKR"
START, SYSTEM, USER, ASSISTANT = range(4)  # what was written last
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1  # costs; CUT: of a truncated row that stays
ENDS = (0, 2 * INSERT, INSERT, 0)  # cost to end in each state: a user's or a system's turn is answered first
TURN = (USER, USER, ASSISTANT, USER)  # whose turn is next
NONE = 1 << 60
_KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_LEGAL = {"su", "ua", "au"}


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows as the repair is tested on. By crc32 of `conv_id:turn` modulo 20, 0 drops a
    row (copies 0), 1 empties its text, 2 removes its .!?, 3 repeats it, 4 sets its role to user. Nulls count as one space."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    harm = F.crc32(name) % 20
    return rows.select(
        "conv_id",
        "turn",
        F.when(harm == 4, "user").otherwise(role).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def _before(kind: str, gone: bool, cut: bool, copies: int, after: list[int]) -> list[int]:
    """Costs from each state before a row, given those after it."""
    more = DELETE * (copies - 1)
    out = [DELETE + c for c in after]
    if not gone:
        for state in range(4):
            stay = CUT * cut + min(REROLE + after[TURN[state]], after[_KEPT[kind, state]] if (kind, state) in _KEPT else NONE)
            out[state] = min(out[state], stay)
    out = [c + more for c in out]
    for _ in range(3):  # inserts before the row, one after another
        out = [min(c, INSERT + out[TURN[s]]) for s, c in enumerate(out)]
    return out


def _blocks(table: pa.Table) -> list[tuple[object, list[tuple]]]:
    """Conversations of a slice and their rows (at, kind, gone, cut, copies), in order."""
    cols = {c: table.column(c).to_pylist() for c in ("at", "conv", "kind", "gone", "cut", "copies")}
    out: list[tuple[object, list[tuple]]] = []
    for i in sorted(range(len(table)), key=cols["at"].__getitem__):
        if not out or out[-1][0] != cols["conv"][i]:
            out.append((cols["conv"][i], []))
        out[-1][1].append(tuple(cols[c][i] for c in ("at", "kind", "gone", "cut", "copies")))
    return out


def _spans(kind: pa.DataType):
    """For each conversation of a slice the costs through it, from each state (4) to each state (4)."""

    def run(table: pa.Table) -> pa.Table:
        blocks = _blocks(table)
        spans = []
        for _, rows in blocks:
            ends = []
            for end in range(4):
                cost = [0 if s == end else NONE for s in range(4)]
                for _, *row in reversed(rows):
                    cost = _before(*row, cost)
                ends.append(cost)
            spans.append([min(ends[e][s], NONE) for s in range(4) for e in range(4)])
        part = table.column("part")[0].as_py()
        schema = pa.schema([("conv", kind), ("part", pa.int64()), ("span", pa.list_(pa.int64()))])
        return pa.Table.from_pydict({"conv": [c for c, _ in blocks], "part": [part] * len(blocks), "span": spans}, schema)

    return run


def _exits(kind: pa.DataType):
    """Costs after each slice of a conversation, from its last slice back; rows come in order."""
    schema = pa.schema([("conv", kind), ("part", pa.int64()), ("ends", pa.list_(pa.int64()))])

    def back(conv: object, parts: list[tuple[int, list[int]]]) -> Iterator[tuple]:
        ends = list(ENDS)
        for part, span in reversed(parts):
            yield conv, part, ends
            ends = [min(NONE, *(span[4 * s + e] + ends[e] for e in range(4))) for s in range(4)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, parts = None, []
        for batch in batches:
            out = []
            for c, part, span in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if c != conv and parts:
                    out += back(conv, parts)
                    parts = []
                conv = c
                parts.append((part, span))
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(schema.names)}, schema)
        out = list(back(conv, parts))
        yield pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(schema.names)}, schema)

    return run


def least_arcs(arcs: np.ndarray) -> np.ndarray:
    """For each node the letter (1 to 4, 0: no arc) with which the least string of letters begins.

    arcs: for each letter and node, the node that this arc leads to, -1 where there is none. Strings end
    where a node has no arc; an end sorts before all letters.
    """
    nodes = np.arange(arcs.shape[1])
    has = arcs >= 0
    letter = np.where(has.any(axis=0), has.argmax(axis=0) + 1, 0)
    pointer = np.where(letter > 0, arcs[np.maximum(letter - 1, 0), nodes], nodes)
    rank = letter.astype(np.int64)
    while (pointer[pointer] != pointer).any():  # the pointers lead on by 1, 2, 4, 8 ... letters
        rank = np.unique(rank * (len(nodes) + 5) + rank[pointer], return_inverse=True)[1].ravel()
        pointer = pointer[pointer]
    order = np.where(has, np.arange(1, 5)[:, None] * (len(nodes) + 5) + rank[np.maximum(arcs, 0)], np.iinfo(np.int64).max)
    return np.where(letter > 0, order.argmin(axis=0) + 1, 0)


def _moves(left: pa.Table, right: pa.Table) -> pa.Table:
    """at, moves: for each row and state before it, how many inserts come first and then which letter, four bits for each state."""
    ends = dict(zip(right.column("conv").to_pylist(), right.column("ends").to_pylist(), strict=True))
    blocks = _blocks(left)
    places: list[tuple] = []  # row of each place, None behind the last one of a conversation
    costs: list[list[int]] = []
    for conv, rows in blocks:
        cost = [list(ends[conv])]
        for _, *row in reversed(rows):
            cost.append(_before(*row, cost[-1]))
        costs += reversed(cost)
        places += [*rows, None]
    cost = np.array(costs, np.int64).reshape(-1, 4)
    n = len(cost)
    inner = np.array([p is not None for p in places], bool)
    kind, gone, cut, copies = (np.array([p[i] if p else z for p in places]) for i, z in ((1, ""), (2, True), (3, False), (4, 1)))
    after = np.vstack([cost[1:], np.full((1, 4), NONE)])
    following = (np.arange(n) + 1)[:, None] * 4
    arcs = np.full((4, n, 4), -1, np.int64)
    more = DELETE * (copies - 1)
    for s in range(4):
        at = np.arange(n) * 4
        arcs[0, :, s] = np.where(inner & (cost[:, s] == more + DELETE + after[:, s]), following[:, 0] + s, -1)
        arcs[1, :, s] = np.where(inner & (cost[:, s] == INSERT + cost[:, TURN[s]]), at + TURN[s], -1)
        arcs[3, :, s] = np.where(inner & ~gone & (cost[:, s] == more + CUT * cut + REROLE + after[:, TURN[s]]), following[:, 0] + TURN[s], -1)
        for (k, before), to in _KEPT.items():
            if before == s:
                arcs[2, :, s] = np.where(inner & ~gone & (kind == k) & (cost[:, s] == more + CUT * cut + after[:, to]), following[:, 0] + to, arcs[2, :, s])
    letter = least_arcs(arcs.reshape(4, -1)).reshape(n, 4)
    moves = np.zeros(n, np.int64)
    for s in range(4):
        state, inserts = np.full(n, s), np.zeros(n, np.int64)
        for _ in range(3):
            more_ = letter[np.arange(n), state] == 2
            inserts += more_
            state = np.where(more_, np.array(TURN)[state], state)
        moves |= (inserts << 2 | (letter[np.arange(n), state] - 1) * inner) << 4 * s
    return pa.table({"at": pa.array([p[0] for p in places if p], pa.int64()), "moves": pa.array(moves[inner], pa.int64())})


class _Conversation:
    """What the rows of one conversation, read in order, come to."""

    def __init__(self, conv: object):
        self.conv, self.state, self.last, self.turns = conv, START, None, []
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.hash, self.begun = hashlib.sha256(), False

    def write(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
        self.begun = True

    def insert(self, count: int) -> None:
        for _ in range(count):
            self.state = TURN[self.state]
            self.write("user" if self.state == USER else "assistant", "")
        self.audit.append("I" * count)
        self.cost += INSERT * count

    def row(self, turn: int | None, role: str, copies: int, blank: bool, first: bool, cut: bool, moves: int) -> str | None:
        """The role under which the row's text is to be written next, if it stays."""
        if turn is not None:
            self.distinct += not self.turns or self.turns[1] != turn
            self.turns = [self.turns[0] if self.turns else turn, turn]
        kind = role[:1]
        self.illegal += copies - 1 + (self.last is not None and self.last + kind not in _LEGAL)
        self.last = kind
        fresh = first and not blank
        self.blank += copies * blank
        self.duplicate += copies * (not blank) - fresh
        self.truncated += cut and fresh
        move = moves >> 4 * self.state & 15
        self.insert(move >> 2)
        letter = LETTERS[move & 3]
        self.audit.append(letter + "D" * (copies - 1))
        self.cost += DELETE * (copies - 1) + (DELETE if letter == "D" else CUT * (cut and fresh) + REROLE * (letter == "R"))
        if letter == "D":
            return None
        if letter == "R":
            self.state = TURN[self.state]
            return "user" if self.state == USER else "assistant"
        self.state = _KEPT[kind, self.state]
        return role

    def result(self) -> tuple:
        self.insert({SYSTEM: 2, USER: 1}.get(self.state, 0))
        gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _repaired(kind: pa.DataType):
    """Rows come by conversation in order; a row's facts, then its texts."""
    schema = pa.schema([("conv", kind), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    names = ("conv", "turn", "role", "text", "copies", "blank", "first", "cut", "moves")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, waits = None, None
        for batch in batches:
            out = []
            for conv, turn, role, text, copies, blank, first, cut, moves in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if own is None or own.conv != conv:
                    if own:
                        out.append(own.result())
                    own, waits = _Conversation(conv), None
                if text is not None:
                    if waits is not None:
                        own.write(waits, text)
                    waits = None
                elif copies:
                    waits = own.row(turn, role, copies, blank, first, cut, moves)
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(schema.names)}, schema)
        if own:
            yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(schema.names, own.result(), strict=True)}, schema)

    return run


def _said(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def repair(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows: conv_id, turn (a whole number), role, text; `copies` names a column that says how often a row
    stands in its place (0: it only makes its conversation known). Rows of a conversation are taken by turn,
    nulls first, rows of the same turn by role and then by the hash of their text; repeated rows are
    duplicates of the first. Null roles and texts count as one space; a null conv_id is a conversation too.
    A conversation without rows has zeros, an empty audit and the hash of the empty text; an empty table gives
    no rows. Texts of any length are read whole, one at a time. Other columns are not read.

    The hash of a conversation is serial by nature: one task streams through its texts and its audit.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind_of = rows.schema["conv_id"].dataType
    arrow, ddl = to_arrow_type(kind_of), kind_of.simpleString()
    own = rows.select(
        F.col("conv_id").alias("conv"),
        F.col("turn").cast("bigint").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
        (F.col(f"`{copies}`").cast("bigint") if copies else F.lit(1).cast("bigint")).alias("copies"),
    )
    own = own.withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = ["conv", F.asc_nulls_first("turn"), "role", "digest"]
    said = _said(F.col("text"))
    facts = own.withColumn("blank", said == "").withColumn("cut", ~said.rlike("[.!?]$") & (said != ""))
    facts = facts.groupBy("conv", "turn", "role", "digest", "blank", "cut").agg(F.sum("copies").alias("copies"))
    facts = facts.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    facts = written(facts, "facts")
    firsts = facts.where("copies > 0").groupBy("conv", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    facts = written(facts.join(firsts, "at", "left").withColumn("first", F.coalesce("first", F.lit(False))), "flagged")

    narrow = facts.where("copies > 0").select(
        F.floor(F.col("at") / SLICE).alias("part"), "at", "conv", F.substring("role", 1, 1).alias("kind"),
        (F.col("blank") | ~F.col("first")).alias("gone"), "cut", "copies",
    )
    spans = narrow.groupBy("part").applyInArrow(_spans(arrow), f"conv {ddl}, part bigint, span array<bigint>")
    ends = spans.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(_exits(arrow), f"conv {ddl}, part bigint, ends array<bigint>")
    moves = narrow.groupBy("part").cogroup(ends.groupBy("part")).applyInArrow(_moves, "at bigint, moves bigint")

    none = lambda t: F.lit(None).cast(t)
    plans = facts.join(moves, "at", "left").withColumn("text", none("string"))
    texts = own.where("copies > 0").withColumns({c: none("boolean") for c in ("blank", "first", "cut")} | {"moves": none("bigint")})
    columns = ["conv", "turn", "role", "digest", "text", "copies", "blank", "first", "cut", "moves"]
    both = plans.select(*columns).unionByName(texts.select(*columns)).repartition("conv").sortWithinPartitions(*keys, F.col("text").isNotNull())
    out = both.drop("digest").mapInArrow(_repaired(arrow), f"conv {ddl}, {', '.join(f'{c} bigint' for c in _COUNTS)}, audit string, repaired_sha256 string")
    return out.withColumnRenamed("conv", "conv_id")
