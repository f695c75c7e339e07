"""Chat turns in a legal order at least cost, rendered as training text.

A legal conversation is an optional system message, then user and assistant in turn,
and ends with the assistant. Every source turn either opens a message or joins the one
before it, under its own role or another, and empty messages may be put in between;
each of these has a price. Dynamic programming over the automaton's states finds the
cheapest repair of the whole conversation.

Turns are sorted once by conversation over the cluster, so a conversation of any length
is spread over many segments. What a segment does to the states is a small matrix of
least costs; matrices of a conversation multiply (with minimum for sum), so the driver,
which gets at most two of them per segment, finds the states at the cuts, and then
every segment is repaired on its own. The result has one row per turn with the piece of
text it adds; pieces joined in order are the conversation.

Defined cases: turns are ordered by turn, role and text, so ties and repeated rows have
a fixed order and count as turns of their own; a NULL conv_id is a conversation too; a
NULL text is empty; other roles than the three, and NULL, can become any of them; marks
of the format inside a text are broken up by a space.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.session import settle

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 40  # more than any repair costs
OPEN, CLOSE, MARK = "<|im_start|>", "<|im_end|>", "<|im_"


@dataclass(frozen=True)
class Costs:
    merge: int = 2
    insert: int = 3
    relabel: int = 5
    name: int = 1  # give a role to a turn that has none of the three


@dataclass(frozen=True)
class Step:
    """One way over a source turn: empty messages before it, then open (or join) a message of ``role``."""

    cost: int
    inserted: tuple[int, ...]
    joins: bool
    role: int


def _ways(state: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Empty messages that can be put in, none to two of them, and the state behind them."""
    yield (), state
    for first in NEXT[state]:
        yield (first,), first
        for second in NEXT[first]:
            yield (first, second), second


def steps(role: int, costs: Costs) -> list[list[Step | None]]:
    """Cheapest step from each state to each state for a turn of ``role`` (0: none of the three).

    Of equal costs the one with fewer insertions, then joining, comes first.
    """
    table: list[list[Step | None]] = [[None] * 4 for _ in range(4)]
    for state in range(4):
        options = []
        for inserted, behind in _ways(state):
            paid = costs.insert * len(inserted)
            turns = [(behind, True)] if behind != START and not inserted else []
            turns += [(target, False) for target in NEXT[behind]]
            for target, joins in turns:
                renamed = 0 if target == role else costs.name if role == 0 else costs.relabel
                options.append(Step(paid + renamed + costs.merge * joins, inserted, joins, target))
        for step in sorted(options, key=lambda s: (s.cost, len(s.inserted), not s.joins)):
            if table[state][step.role] is None:
                table[state][step.role] = step
    return table


def endings(costs: Costs) -> list[tuple[int, tuple[int, ...]]]:
    """Cost and empty messages needed to end after each state."""
    out = []
    for state in range(4):
        fits = [(costs.insert * len(i), i) for i, behind in _ways(state) if behind == ASSISTANT]
        out.append(min(fits, default=(FAR, ())))
    return out


def cost_matrix(roles: list[int], tables: list) -> np.ndarray:
    """Least cost from each state to each state over a run of turns."""
    total = np.where(np.eye(4, dtype=bool), 0, FAR)
    single = [np.array([[s.cost if s else FAR for s in row] for row in table]) for table in tables]
    for role in roles:
        total = np.minimum((total[:, :, None] + single[role][None, :, :]).min(axis=1), FAR)
    return total


def best_path(roles: list[int], tables: list, first: int, last: int | None, ends: list) -> list[Step]:
    """Cheapest steps from state ``first`` to ``last``, or to wherever the ending is cheapest."""
    costs, back = [0 if s == first else FAR for s in range(4)], []
    for role in roles:
        fresh, origin = [FAR] * 4, [0] * 4
        for a in range(4):
            if costs[a] < FAR:
                for b in range(4):
                    step = tables[role][a][b]
                    if step and costs[a] + step.cost < fresh[b]:
                        fresh[b], origin[b] = costs[a] + step.cost, a
        costs = fresh
        back.append(origin)
    state = last if last is not None else min(range(4), key=lambda s: (costs[s] + ends[s][0], s))
    path = []
    for role, origin in zip(reversed(roles), reversed(back)):
        path.append(tables[role][origin[state]][state])
        state = origin[state]
    return path[::-1]


def cut_states(matrices: list[np.ndarray], ends: list) -> list[tuple[int, int]]:
    """State before and after each segment of one conversation."""
    reached = [np.where(np.arange(4) == START, 0, FAR)]
    for m in matrices:
        reached.append(np.minimum((reached[-1][:, None] + m).min(axis=0), FAR))
    state = int(np.argmin(reached[-1] + np.array([e[0] for e in ends])))
    out = []
    for before, m in zip(reached[-2::-1], reversed(matrices)):
        came = int(np.argmin(before + m[:, state]))
        out.append((came, state))
        state = came
    return out[::-1]


def _codes(frame: pd.DataFrame) -> list[int]:
    known = {name: i for i, name in enumerate(ROLES) if name}
    return [known.get(str(r).strip().lower(), 0) if r is not None else 0 for r in frame["role"].tolist()]


def _pieces(frame: pd.DataFrame) -> list[tuple[object, int, int]]:
    """(conversation, first row, row after the last) of a sorted segment."""
    keys = frame["conv_key"].tolist()
    cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
    return [(keys[a], a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _empty(role: int) -> str:
    return f"{OPEN}{ROLES[role]}\n{CLOSE}\n"


def repair(turns: DataFrame, costs: Costs = Costs(), rows_per_segment: int = 20_000) -> DataFrame:
    """conv_id, turn, role, new_role, action, inserted_before, inserted_after, cost and rendered of every turn.

    action: keep, relabel, merge or merge+relabel. Sorted by (segment, row) the pieces
    in ``rendered`` are in the order of their conversations.
    """
    tables, ends = [steps(role, costs) for role in range(4)], endings(costs)
    source = turns.select("conv_id", "turn", "role", "text")
    n = source.count()
    width = max(1, math.ceil(n / rows_per_segment))
    order = ["conv_id", "turn", "role", "text"]
    dealt = source.repartitionByRange(width, *order).sortWithinPartitions(*order)
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    dealt = dealt.select("*", key.alias("conv_key"), F.spark_partition_id().alias("segment"), F.monotonically_increasing_id().alias("row"))
    dealt = settle(dealt, "turns")

    def matrices(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row", ignore_index=True)
        roles, runs = _codes(frame), _pieces(frame)
        edge = {runs[0], runs[-1]} if runs else set()
        out = [(int(frame["segment"].iloc[0]), k, a, cost_matrix(roles[a:b], tables).ravel().tolist()) for k, a, b in edge]
        return pd.DataFrame(out, columns=["segment", "conv_key", "at", "matrix"])

    light = dealt.select("segment", "row", "conv_key", "role")
    rows = light.groupBy("segment").applyInPandas(matrices, "segment int, conv_key string, at int, matrix array<long>").collect()
    parts: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["segment"], r["at"])):
        parts.setdefault(r["conv_key"], []).append((r["segment"], np.array(r["matrix"]).reshape(4, 4)))
    fixed = {}
    for conv, own in parts.items():
        if len(own) > 1:
            for i, ((segment, _), (a, b)) in enumerate(zip(own, cut_states([m for _, m in own], ends))):
                fixed[segment, conv] = (a, b, i == len(own) - 1)
    held = turns.sparkSession.sparkContext.broadcast(fixed)

    def mend(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row", ignore_index=True)
        roles, segment = _codes(frame), int(frame["segment"].iloc[0])
        out = []
        for conv, a, b in _pieces(frame):
            first, last, closes = held.value.get((segment, conv), (START, None, True))
            state = first
            for i, step in zip(range(a, b), best_path(roles[a:b], tables, first, last, ends)):
                action = "merge" if step.joins else "keep"
                if step.role != roles[i]:
                    action = "merge+relabel" if step.joins else "relabel"
                after = ends[step.role][1] if closes and i == b - 1 else ()
                text = (frame["text"].iloc[i] or "").replace(MARK, MARK[:2] + " " + MARK[2:])
                before = "".join(_empty(r) for r in step.inserted)
                if step.joins:
                    piece = "\n" + text
                else:
                    piece = (f"{CLOSE}\n" if state != START else "") + before + f"{OPEN}{ROLES[step.role]}\n" + text
                if closes and i == b - 1:
                    piece += f"{CLOSE}\n" + "".join(_empty(r) for r in after)
                names = [",".join(ROLES[r] for r in x) for x in (step.inserted, after)]
                out.append((ROLES[step.role], action, *names, step.cost + costs.insert * len(after), piece))
                state = step.role
        made = pd.DataFrame(out, columns=["new_role", "action", "inserted_before", "inserted_after", "cost", "rendered"], index=frame.index)
        return pd.concat([frame[["conv_id", "turn", "role"]], made, frame[["segment", "row"]]], axis=1)

    schema = T.StructType(
        [
            *[source.schema[c] for c in ("conv_id", "turn", "role")],
            *[T.StructField(c, T.StringType()) for c in ("new_role", "action", "inserted_before", "inserted_after")],
            T.StructField("cost", T.LongType()), T.StructField("rendered", T.StringType()),
            T.StructField("segment", T.IntegerType()), T.StructField("row", T.LongType()),
        ]
    )
    return dealt.groupBy("segment").applyInPandas(mend, schema)
