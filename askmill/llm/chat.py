"""Repair of conversations' roles at the least cost, and their rendering.

A legal conversation may open with one system turn; then user and assistant take turns, the user first. A
turn can stay as it is, be merged into the one before (same role), or get another role; an empty turn can be
put before it. Dynamic programming over the automaton's states finds the cheapest way. What a run
of turns does to the costs is a matrix of (min, +), and matrices of blocks multiply, so a conversation
of any length is dealt over tasks: blocks make matrices, their products give the states between blocks, and each block then
finds its own turns' repairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.llm.common import cut, dealt, groups, running_total

ROLES = ("system", "user", "assistant")
#: States: nothing yet, and the role of the last turn given out.
START = 3
#: Costs: merging two turns of a role, another role, an empty turn put in.
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
#: Turns of a block.
BLOCK = 512
#: Which role may follow a state. A system turn opens a conversation, users answer system or assistant, or open.
FOLLOWS = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
# The markers of the rendered form.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _steps() -> dict[int, list[list[tuple[float, int, int, tuple[int, ...]]]]]:
    """For each role that a turn may have (3: none of the three) and each state: (cost, next state, role given, roles inserted before)."""
    out: dict[int, list] = {}
    for role in range(4):
        rows = []
        for state in range(4):
            found = []
            for given in range(3):
                cost = 0.0 if given == role else RELABEL
                if given in FOLLOWS[state]:
                    found.append((cost, given, given, ()))
                for between in range(3):
                    if between in FOLLOWS[state] and given in FOLLOWS[between]:
                        found.append((cost + INSERT, given, given, (between,)))
            if state != START:
                found.append((MERGE + (0.0 if state == role else RELABEL), state, -1, ()))
            rows.append(sorted(found))
        out[role] = rows
    return out


STEPS = _steps()
COST = np.full((4, 4, 4), np.inf)
for _role, _rows in STEPS.items():
    for _state, _found in enumerate(_rows):
        for _cost, _next, _given, _between in _found:
            COST[_role, _state, _next] = min(COST[_role, _state, _next], _cost)


def role_number(role: str | None) -> int:
    return ROLES.index(role.strip().lower()) if role and role.strip().lower() in ROLES else 3


def product(roles: list[int]) -> np.ndarray:
    """The cheapest cost from each state to each over these turns."""
    m = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
    for r in roles:
        m = (m[:, :, None] + COST[r][None, :, :]).min(1)
    return m


def repairs(roles: list[int], first: int, last: int) -> list[tuple[int, int, tuple[int, ...]]]:
    """The cheapest way from state ``first`` to ``last``: for each turn its action's (next state, role given or -1 for a merge, roles inserted before). Ties: the first in STEPS' order, seen from the end."""
    best = [np.where(np.arange(4) == first, 0.0, np.inf)]
    for r in roles:
        best.append((best[-1][:, None] + COST[r]).min(0))
    state, out = last, []
    for k in range(len(roles) - 1, -1, -1):
        found = [(best[k][s] + c, given < 0, between, s, given) for s in range(4) if best[k][s] < np.inf for c, nxt, given, between in STEPS[roles[k]][s] if nxt == state]
        _, _, between, s, given = min(found)
        out.append((state, given, between))
        state = s
    return out[::-1]


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per turn of the input: conv, turn, role (null if merged into the turn before), text, action (keep, relabel, merge), inserted (roles of empty turns put before), rendered.

    Turns are taken by their number, then role and text, so repeated numbers and rows keep an order; nulls come
    first. An unknown or null role must be relabelled. A conversation ends after a user's or an assistant's turn,
    or, of system turns alone, where it is. A null text counts as empty. A null conv is a conversation of its own. rendered is the piece of the
    conversation that the row adds: put together in order they are the whole, its last turn closed; no row holds a conversation. Markers
    in a text are written with a space in them there, so that no text can open or close a turn; the column text keeps them.
    Other columns are left out; an empty table gives an empty table.
    """
    rows = turns.select(F.col(conv).alias("c"), F.col(turn).cast("long").alias("n"), F.col(role).cast("string").alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = cut(_blocked(rows), "turns")
    kind = rows.schema["c"].dataType.simpleString()

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(groups(batches, ["c", "block"])):
            costs = [product([role_number(x) for x in t.column("r").to_pylist()]).ravel() for t in part]
            yield _batch(part, {"block": pa.array([t.column("block")[0].as_py() for t in part], pa.int64()), "costs": pa.array(costs, pa.list_(pa.float64()))})

    blocks = dealt(rows.select("c", "block", "at", "r"), "c", "block", order=("at",)).mapInArrow(matrices, f"c {kind}, block long, costs array<double>")

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["c"]):
            ms = [np.array(x).reshape(4, 4) for x in t.column("costs").to_pylist()]
            best = [np.where(np.arange(4) == START, 0.0, np.inf)]
            for m in ms:
                best.append((best[-1][:, None] + m).min(0))
            ends = [int(np.argmin(np.where(np.arange(4) == START, np.inf, best[-1])))]
            for k in range(len(ms) - 1, -1, -1):
                ends.append(int(np.argmin(best[k] + ms[k][:, ends[-1]])))
            ends = ends[::-1]
            closing = pa.array([False] * (len(ms) - 1) + [True])
            columns = [t.column("c").combine_chunks(), t.column("block").combine_chunks(), pa.array(ends[:-1], pa.int32()), pa.array(ends[1:], pa.int32()), pa.array([float(best[-1][:START].min())] * len(ms)), closing]
            yield pa.RecordBatch.from_arrays(columns, names=["c2", "block2", "first", "last", "total", "closing"])

    between = cut(dealt(blocks, "c", order=("block",)).mapInArrow(states, f"c2 {kind}, block2 long, first int, last int, total double, closing boolean"), "states")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(groups(batches, ["c", "block"])):
            given, action, inserted, closing = [], [], [], []
            for t in part:
                closing += [False] * (t.num_rows - 1) + [t.column("closing")[0].as_py()]
                had = [role_number(x) for x in t.column("r").to_pylist()]
                for (_, role, between), own in zip(repairs(had, t.column("first")[0].as_py(), t.column("last")[0].as_py()), had, strict=True):
                    given.append(None if role < 0 else ROLES[role])
                    action.append("merge" if role < 0 else "keep" if role == own else "relabel")
                    inserted.append([ROLES[x] for x in between])
            whole = pa.concat_tables(part).combine_chunks()
            kept = [whole.column(x).combine_chunks() for x in ("c", "n", "at", "t", "total")]
            made = [pa.array(given, pa.string()), pa.array(action, pa.string()), pa.array(inserted, pa.list_(pa.string())), pa.array(closing, pa.bool_())]
            yield pa.RecordBatch.from_arrays(kept + made, names=["c", "n", "at", "text", "cost", "role", "action", "inserted", "closing"])

    joined = rows.join(between, rows["c"].eqNullSafe(between["c2"]) & (rows["block"] == between["block2"])).select("c", "n", "at", "r", "t", "block", "first", "last", "total", "closing")
    out = dealt(joined, "c", "block", order=("at",)).mapInArrow(choose, f"c {kind}, n long, at long, text string, cost double, role string, action string, inserted array<string>, closing boolean")
    opening = lambda r: F.concat(F.lit(OPEN), r, F.lit("\n"))
    empty = F.array_join(F.transform("inserted", lambda r: F.concat(opening(r), F.lit(CLOSE + "\n"))), "")
    # A turn is closed by the row that opens the next one; merged texts stand under each other.
    text = F.col("text")
    for marker in (OPEN, CLOSE):
        text = F.replace(text, F.lit(marker), F.lit(marker.replace("|", "| ", 1)))
    rendered = F.when(F.col("action") == "merge", F.concat(F.lit("\n"), text)).otherwise(F.concat(F.when(F.col("at") > 0, CLOSE + "\n").otherwise(""), empty, opening(F.col("role")), text))
    rendered = F.concat(rendered, F.when(F.col("closing"), CLOSE + "\n").otherwise(""))
    return out.select(F.col("c").alias(conv), F.col("n").alias(turn), F.col("at").alias("position"), "role", "text", "action", "inserted", rendered.alias("rendered"), F.col("cost").alias("conversation_cost"))


def _parts(tables: Iterator[pa.Table], most: int = 4096) -> Iterator[list[pa.Table]]:
    """Blocks taken together up to so many rows, so that a short conversation isn't a batch of its own."""
    held: list[pa.Table] = []
    n = 0
    for t in tables:
        held.append(t)
        n += t.num_rows
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def _batch(part: list[pa.Table], columns: dict[str, pa.Array]) -> pa.RecordBatch:
    first = pa.concat_tables([t.select(["c"]).slice(0, 1) for t in part]).column("c").combine_chunks()
    return pa.RecordBatch.from_arrays([first, *columns.values()], names=["c", *columns])


def _blocked(rows: DataFrame) -> DataFrame:
    """Adds at, a turn's place in its conversation from 0, and block. Places are running totals over buckets of turn numbers, so a long conversation isn't sorted in one task."""
    marked = rows.withColumns({"one": F.lit(1).cast("long"), "bucket": F.floor(F.coalesce("n", F.lit(-1)) / BLOCK)})
    placed = running_total(marked, ["c"], ["n", "r", "t"], "one", "at", "bucket")
    return placed.withColumn("block", F.floor(F.col("at") / BLOCK)).select("c", "n", "r", "t", F.col("at").cast("long").alias("at"), F.col("block").cast("long").alias("block"))
