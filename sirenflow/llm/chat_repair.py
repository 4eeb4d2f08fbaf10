"""Minimum-cost role repair of conversations, and rendering.

Legal conversations: an optional system turn, then user and assistant turns in alternation, user first. A dynamic
program over this automaton picks, for each turn, the cheapest of: keep it, relabel it, merge it into the
turn before (same role), or insert empty turns first. The turns are range-sorted over the tasks by conversation and
turn, so that many short conversations share a task and a long one is spread over several. Steps are min-plus
matrices over four states: a task reduces the conversation at either of its edges to one matrix, the matrices of a
conversation are combined, and each task repairs its turns between known states.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sirenflow.llm.common import cut

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {START: {"system": SYSTEM, "user": USER}, SYSTEM: {"user": USER}, USER: {"assistant": ASSISTANT}, ASSISTANT: {"user": USER}}
HOLDS = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
COST = {"merge": 1, "insert": 2, "relabel": 3, "name": 1}  # name: a role that is null or unknown gets a legal one
#: Turns of a task: bounds what it holds in memory, however long a conversation is.
BLOCK_TURNS = 200_000
_HUGE = 1 << 40


@cache
def steps(role: str) -> tuple[tuple[int, int, int, str, str, tuple[str, ...]], ...]:
    """All (from, to, cost, action, role, inserted) for a turn of ``role``, cheapest first."""
    out = []
    for s in range(4):
        paths: list[tuple[int, tuple[str, ...]]] = [(s, ())]
        paths += [(t, (r,)) for r, t in LEGAL[s].items()]
        paths += [(t2, (r, r2)) for r, t in LEGAL[s].items() for r2, t2 in LEGAL[t].items()]
        for mid, put in paths:
            extra = COST["insert"] * len(put)
            for r, t in LEGAL[mid].items():
                if r == role:
                    out.append((s, t, extra, "keep", r, put))
                else:
                    out.append((s, t, extra + COST["relabel" if role in ROLES else "name"], "relabel", r, put))
        if s in HOLDS and (HOLDS[s] == role or role not in ROLES):
            out.append((s, s, COST["merge"] + (role not in ROLES), "merge", HOLDS[s], ()))
    return tuple(sorted(out, key=lambda x: (x[2], len(x[5]), x[3], x[4], x[0])))


@cache
def _step_matrix(role: str) -> np.ndarray:
    w = np.full((4, 4), _HUGE, np.int64)
    for s, t, c, *_ in steps(role):
        w[s, t] = min(w[s, t], c)
    return w


def matrix(roles: list[str]) -> np.ndarray:
    """Cheapest cost from each state to each state over a run of turns; neighbours are combined pairwise."""
    m = np.stack([_step_matrix(r) for r in roles]) if roles else np.where(np.eye(4, dtype=bool), 0, _HUGE)[None]
    while len(m) > 1:
        odd = m[len(m) - len(m) % 2 :]
        pair = (m[0 : len(m) - len(odd) : 2, :, :, None] + m[1 : len(m) : 2, None, :, :]).min(axis=2)
        m = np.concatenate((np.minimum(pair, _HUGE), odd))
    return m[0]


def closing(state: int) -> int:
    """Cost to end in a state: a lone system turn needs an empty user turn."""
    return COST["insert"] if state == SYSTEM else 0


def repair(roles: list[str], first: int = START, last: int | None = None) -> list[tuple[str, str, tuple[str, ...]]]:
    """(action, role, inserted before) per turn on a cheapest path from ``first`` to ``last`` (any legal end if None)."""
    cost, back = [_HUGE] * 4, []
    cost[first] = 0
    for r in roles:
        new, how = [_HUGE] * 4, [None] * 4
        for x in steps(r):
            c = cost[x[0]] + x[2]
            if c < new[x[1]]:
                new[x[1]], how[x[1]] = c, x
        cost = new
        back.append(how)
    at = last if last is not None else min(range(4), key=lambda s: (cost[s] + closing(s), s))
    out = []
    for how in reversed(back):
        x = how[at]
        out.append((x[3], x[4], x[5]))
        at = x[0]
    return out[::-1]


@lru_cache(4096)
def _repair_short(roles: tuple[str, ...]) -> list[tuple[str, str, tuple[str, ...]]]:
    return repair(list(roles))


def clean_role(c):
    """Lower-cased, trimmed role; anything that is no known role is 'unknown'."""
    r = F.lower(F.trim(c))
    return F.when(r.isin(*ROLES), r).otherwise("unknown")


def _runs(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[object, bool, bool, list[list]]]:
    """(conversation, whether it is the task's first, its last, its values by column) of each conversation of a sorted task."""
    held: list[list] = [[] for _ in columns]
    conv, first = None, True
    for pdf in batches:
        values = [pdf[c].tolist() for c in columns]
        keys = pdf["conv"].tolist()
        at = 0
        for key, run in groupby(keys):
            n = sum(1 for _ in run)
            if held[0] and key != conv:
                yield conv, first, False, held
                held, first = [[] for _ in columns], False
            conv = key
            for x, v in zip(held, values, strict=True):
                x.extend(v[at : at + n])
            at += n
    if held[0]:
        yield conv, first, True, held


def _edge_matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The matrix of the first and of the last conversation of a task: at most two rows."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    out = [(task, conv, first, last, matrix(roles).ravel().tolist()) for conv, first, last, (roles,) in _runs(batches, ["role"]) if first or last]
    yield pd.DataFrame(out, columns=["task", "conv", "first", "last", "m"]).astype({"task": "int32", "first": bool, "last": bool})


def _edge_states(edges: list) -> dict[tuple[int, str | None], tuple[int, int, bool]]:
    """(state before, state after, whether the conversation ends here) of the parts of conversations that lie in several tasks."""
    out = {}
    for conv, run in groupby(sorted(edges, key=lambda e: (e["conv"] is not None, e["conv"] or "", e["task"])), key=lambda e: e["conv"]):
        parts = list(run)
        if len(parts) < 2:
            continue
        ms = [np.asarray(e["m"], np.int64).reshape(4, 4) for e in parts]
        costs = [np.where(np.arange(4) == START, 0, _HUGE)]
        for m in ms:
            costs.append(np.minimum((costs[-1][:, None] + m).min(axis=0), _HUGE))
        ends = [min(range(4), key=lambda s: (costs[-1][s] + closing(s), s))]
        for m, c in zip(reversed(ms), reversed(costs[:-1]), strict=True):
            ends.append(int((c + m[:, ends[-1]]).argmin()))
        ends.reverse()
        for k, e in enumerate(parts):
            out[(e["task"], conv)] = (ends[k], ends[k + 1], k == len(parts) - 1)
    return out


def _renderer(edges: dict[tuple[int, str | None], tuple[int, int, bool]]):
    def piece(action: str, role: str, put: tuple[str, ...], text: str | None) -> str:
        return "".join(f"<|{p}|>\n\n" for p in put) + ("" if action == "merge" else f"<|{role}|>\n") + (text or "") + "\n"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        cols: list[list] = [[] for _ in range(7)]

        def table() -> pd.DataFrame:
            return pd.DataFrame(dict(zip(("conv", "turn", "action", "new_role", "inserted", "inserted_after", "rendered"), cols, strict=True)))

        for conv, first, last, (turns, roles, texts) in _runs(batches, ["turn", "role", "text"]):
            start, end, closes = edges.get((task, conv), (START, None, True)) if first or last else (START, None, True)
            got = _repair_short(tuple(roles)) if end is None and len(roles) <= 32 else repair(roles, start, end)
            pieces = [piece(*g, x) for g, x in zip(got, texts, strict=True)]
            after: list[tuple[str, ...]] = [()] * len(got)
            if closes and got[-1][1] == HOLDS[SYSTEM]:  # the conversation ends on its system turn
                after[-1] = (HOLDS[USER],)
                pieces[-1] += f"<|{HOLDS[USER]}|>\n\n"
            rows = ([conv] * len(got), turns, [g[0] for g in got], [g[1] for g in got], [list(g[2]) for g in got], [list(x) for x in after], pieces)
            for x, v in zip(cols, rows, strict=True):
                x.extend(v)
            if len(cols[0]) >= 10_000:
                yield table()
                for x in cols:
                    x.clear()
        if cols[0]:
            yield table()

    return run


def repair_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per turn: conv_id, turn, action (keep, merge, relabel), new_role, inserted (empty turns put before it),
    inserted_after (the empty user turn that a conversation of system turns only needs at its end), rendered.

    The ``rendered`` pieces of a conversation in turn order, joined, are its rendering. Turns of one number are
    ordered by role and text digest; null turns come first; a null conversation id is one conversation; null text is
    empty; null and unknown roles are given the cheapest legal role. The range sort has a row number as its last key, so
    that neither a hot conversation, a hot turn number nor equal rows end up in one task. The driver sees two
    rows a task at most. Ids and turns keep their types. Extra columns are not read.
    """
    t = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), clean_role(F.col(role)).alias("role"), F.col(text).alias("text"))
    order = ["conv", "turn", "role", "th", "row"]
    keyed = t.withColumns({"th": F.md5(F.coalesce("text", F.lit("")).cast("binary")), "row": F.monotonically_increasing_id()})
    tasks = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns.count() // block_turns))
    # checkpointed: both passes must see the same rows in the same tasks
    ids = [F.col(c).cast("string").alias(c) for c in ("conv", "turn")]
    t = cut(keyed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select(*ids, "role", "text"))
    edges = t.select("conv", "role").mapInPandas(_edge_matrices, "task int, conv string, first boolean, last boolean, m array<long>").collect()  # at most two rows a task
    done = t.mapInPandas(_renderer(_edge_states(edges)), "conv string, turn string, action string, new_role string, inserted array<string>, inserted_after array<string>, rendered string")
    return done.select(F.col("conv").cast(turns.schema[conv].dataType).alias("conv_id"), F.col("turn").cast(turns.schema[turn].dataType).alias("turn"), "action", "new_role", "inserted", "inserted_after", "rendered")
