"""Faults of conversations, and the cheapest edits that make their roles legal, by a Viterbi search over chunks in parallel.

Legal roles, by initials: an optional s, then u and a in turn, u first and a last, or nothing. A row may be kept, given
another role (user or assistant) or deleted, and empty rows may be inserted. Turns are range-sorted over the
tasks, so a task holds whole conversations and a chunk of the one at either of its edges. Backward cost vectors (one cost a
state of the automaton) settle which edits are cheapest; a chunk whose successor lies in another task starts from a
speculative vector. Fix-up passes rerun the chunks whose successor's vector turned out to differ by more than a constant,
until none does: then every stored vector is right up to a constant, which is all that tracing the edits needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenflow.llm.common import batches_of, cut, saved

START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a user or assistant row is put in; each state has one.
PUT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: State after a row of an initial is kept.
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
_NEVER = 1 << 40
#: A row's symbol: its initial (x: any other), a capital one if truncated, or - if it must go.
SYMBOLS = "suaxSUAX-"
#: Bytes of text that a task gets, about.
TASK_BYTES = 32 << 20
#: Rows of an Arrow batch, and characters of a piece of a repaired conversation that lies in several tasks.
BATCH_ROWS, PIECE = 2_000, 1 << 20


def _inserted(v: tuple[int, ...]) -> tuple[int, ...]:
    """Costs if rows may be inserted first; three lead round to the same state."""
    for _ in range(2):
        v = tuple(min(v[s], INSERT + v[PUT[s]]) for s in range(4))
    return v


END = _inserted((0, _NEVER, _NEVER, 0))


@lru_cache(1 << 16)
def _before(symbol: str, v: tuple[int, ...]) -> tuple[int, ...]:
    """Cost vector before a row from the one after it."""
    direct = []
    for s in range(4):
        c = DELETE + v[s]
        if symbol != "-":
            extra = TRUNCATED * symbol.isupper()
            c = min(c, REROLE + extra + v[PUT[s]])
            t = KEPT.get((symbol.lower(), s))
            if t is not None:
                c = min(c, extra + v[t])
        direct.append(c)
    return _inserted(tuple(direct))


def level(v: tuple[int, ...]) -> tuple[int, ...]:
    """The vector less its smallest cost: equal for vectors that differ by a constant."""
    low = min(v)
    return tuple(x - low for x in v)


def backward(symbols: str, after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Vectors before each row and after the last, each less its smallest cost."""
    out = [level(after)]
    for x in reversed(symbols):
        out.append(level(_before(x, out[-1])))
    return out[::-1]


def first_vector(symbols: str, after: tuple[int, ...]) -> tuple[int, ...]:
    v = level(after)
    for x in reversed(symbols):
        v = level(_before(x, v))
    return v


def trace(symbols: str, vectors: list[tuple[int, ...]], state: int, closes: bool) -> tuple[list[tuple[str, int]], int, int]:
    """([(edit, state after it)], cost, last state) of the cheapest edits, of which the ASCII-least, from a state.

    The edits D, I, K, R are tried in this order: the first that keeps to the cheapest costs is taken. ``closes``: the
    conversation ends after these rows.
    """
    out, cost = [], 0
    for k, x in enumerate(symbols):
        here, after = vectors[k], vectors[k + 1]
        # vectors are known up to a constant: the step that the row before and after it have in common
        shift = _shift(x, here, after)
        extra = TRUNCATED * x.isupper()
        while True:
            left = here[state] + shift
            if DELETE + after[state] == left:
                out.append(("D", state))
                cost += DELETE
                break
            if INSERT + here[PUT[state]] + shift == left:
                state = PUT[state]
                out.append(("I", state))
                cost += INSERT
                continue
            t = KEPT.get((x.lower(), state)) if x != "-" else None
            if t is not None and extra + after[t] == left:
                state = t
                out.append(("K", state))
                cost += extra
                break
            state = PUT[state]
            out.append(("R", state))
            cost += REROLE + extra
            break
    while closes and state not in (START, ASSISTANT):
        state = PUT[state]
        out.append(("I", state))
        cost += INSERT
    return out, cost, state


def _shift(symbol: str, here: tuple[int, ...], after: tuple[int, ...]) -> int:
    """The constant between a vector and the one that leads to it through a row."""
    return min(_before(symbol, after)) - min(here)


# ---------------------------------------------------------------- rows and their faults


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) after damage by crc32(``conv:turn``) % 20: 0 drops a row, 1 empties its text, 2 takes out
    ``.!?``, 3 repeats it, 4 makes it a user's. Nulls are one space in the crc, and as role and text."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)]
    t = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), (F.crc32(F.concat_ws(":", *name).cast("binary")) % 20).alias("kind"))
    hurt = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return t.where("kind != 0").select("conv", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), hurt.alias("text"), times.alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with g (key of the conversation), row (number) and fault: blank, duplicate, truncated or null.

    A row repeats an earlier one if it is not the first of its conversation, role and text; the firsts are found by a minimum,
    and told from the others by their row number, so that no group of equal rows meets in one task.
    """
    spark = rows.sparkSession
    keyed = rows.withColumns({"g": F.coalesce(F.concat(F.lit("v"), F.col("conv").cast("string")), F.lit("")), "row": F.monotonically_increasing_id()})
    keyed = saved(keyed)
    words = r"[^\x20\x09-\x0D]"
    slim = keyed.select("g", "turn", "row", F.md5(F.concat_ws("\0", F.octet_length("role").cast("string"), "role", "text").cast("binary")).alias("what"))
    firsts = slim.groupBy("g", "what").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn", "row")).alias("at")).select(F.col("at.row").alias("row"), F.lit(True).alias("first"))
    last = F.regexp_extract("text", rf"({words})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(words), "blank").when(F.col("first").isNull(), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return keyed.join(firsts, "row", "left").withColumn("fault", fault).drop("first")


def _symbol() -> Column:
    i = F.substring("role", 1, 1)
    s = F.when(i.isin("s", "u", "a"), i).otherwise("x")
    return F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(s)).otherwise(s)


# ---------------------------------------------------------------- chunks


def _chunks(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[str, bool, bool, list[list]]]:
    """(g, whether it is the task's first conversation, its last, values by column) of the conversations in a sorted task."""
    held: list[list] = [[] for _ in columns]
    g, first = "", True
    for pdf in batches:
        values = [pdf[c].tolist() for c in columns]
        at = 0
        for key, run in groupby(pdf["g"].tolist()):
            n = sum(1 for _ in run)
            if held[0] and key != g:
                yield g, first, False, held
                held, first = [[] for _ in columns], False
            g = key
            for x, v in zip(held, values, strict=True):
                x.extend(v[at : at + n])
            at += n
    if held[0]:
        yield g, first, True, held


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Symbols of the first and the last conversation of a task: at most two rows."""
    out = [(_task(), g, "".join(symbols)) for g, first, last, (symbols,) in _chunks(batches, ["symbol"]) if first or last]
    yield pd.DataFrame(out, columns=["task", "g", "symbols"]).astype({"task": "int32"})


def stitched(edges: DataFrame) -> tuple[dict[tuple[int, str], tuple[tuple[int, ...], int, bool, bool]], int]:
    """For each chunk of a conversation in several tasks: (vector after it, state before it, whether it opens, whether it
    closes the conversation), and the number of passes.

    Every chunk is run from its speculative vector first, that of a conversation's end. A fix-up pass reruns the chunks
    whose successor has a vector that differs from the one they started from by more than a constant. The driver holds
    a vector, and the states that tracing leads to, of at most two chunks a task; their rows stay with the tasks.
    """
    spark = edges.sparkSession
    names = edges.select("task", "g").collect()  # at most two rows a task
    by: dict[str, list[int]] = {}
    for r in sorted(names, key=lambda r: (r["g"], r["task"])):
        by.setdefault(r["g"], []).append(r["task"])
    chains = {g: tasks for g, tasks in by.items() if len(tasks) > 1}
    start = {(t, g): level(END) for g, tasks in chains.items() for t in tasks}
    front: dict[tuple[int, str], tuple[int, ...]] = {}
    todo, passes = dict(start), 0
    while todo:
        passes += 1
        held = spark.sparkContext.broadcast(todo)

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = [(t, g, list(first_vector(s, held.value[t, g]))) for t, g, s in zip(pdf["task"], pdf["g"], pdf["symbols"], strict=True) if (t, g) in held.value]
                yield pd.DataFrame(out, columns=["task", "g", "v"]).astype({"task": "int32"})

        front |= {(r["task"], r["g"]): tuple(r["v"]) for r in edges.mapInPandas(run, "task int, g string, v array<long>").collect()}
        todo = {}
        for g, tasks in chains.items():
            for t, after in zip(tasks, tasks[1:], strict=False):
                if start[t, g] != front[after, g]:
                    start[t, g] = todo[t, g] = front[after, g]
    held = spark.sparkContext.broadcast({k: (v, k[0] == chains[k[1]][-1]) for k, v in start.items()})

    def leads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, g, s in zip(pdf["task"], pdf["g"], pdf["symbols"], strict=True):
                if (t, g) in held.value:
                    v, closes = held.value[t, g]
                    vectors = backward(s, v)
                    out.append((t, g, [trace(s, vectors, x, closes)[2] for x in range(4)]))
            yield pd.DataFrame(out, columns=["task", "g", "to"]).astype({"task": "int32"})

    to = {(r["task"], r["g"]): r["to"] for r in edges.mapInPandas(leads, "task int, g string, to array<int>").collect()}
    out = {}
    for g, tasks in chains.items():
        state = START
        for t in tasks:
            out[t, g] = (start[t, g], state, t == tasks[0], t == tasks[-1])
            state = to[t, g][state]
    return out, passes


def _writer(known: dict[tuple[int, str], tuple[tuple[int, ...], int, bool, bool]]):
    """Repairs the chunks of a task: one row a chunk, and the text of a chunk of a conversation in several tasks in pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, out = _task(), []
        names = ["g", "task", "seq", "opens", "first", "last", "illegal", "cost", "audit", "sha", "piece"]

        def table() -> pd.DataFrame:
            pdf = pd.DataFrame(out, columns=names).astype({"task": "int32", "seq": "int32", "opens": bool})
            out.clear()
            return pdf

        for g, _, _, (symbols, roles, texts) in _chunks(batches, ["symbol", "role", "text"]):
            end, state, opens, closes = known.get((task, g), (END, START, True, True))
            edits, cost, _ = trace(symbols, backward(symbols, end), state, closes)
            initials = [r[:1] for r in roles]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
            k, parts = 0, []
            for e, s in edits:
                if e in "KR":
                    parts.append(f"{roles[k] if e == 'K' else ROLE[s]}:{texts[k]}")
                elif e == "I":
                    parts.append(f"{ROLE[s]}:")
                k += e != "I"
            whole = opens and closes
            sha = hashlib.sha256("\n".join(parts).encode("utf-8", "surrogatepass")).hexdigest() if whole else None
            row = (g, task, 0, opens, initials[0], initials[-1], illegal, cost, "".join(e for e, _ in edits), sha)
            if whole or not parts:
                out.append((*row, None))
            else:
                text = "\n".join(parts)
                for i in range(0, len(text), PIECE):
                    out.append((*row, text[i : i + PIECE]) if i == 0 else (g, task, i // PIECE, opens, None, None, 0, 0, None, None, text[i : i + PIECE]))
            if len(out) >= BATCH_ROWS:
                yield table()
        if out:
            yield table()

    return run


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each conversation whose pieces come in order: the hash takes piece after piece, none is held."""
    g, h, task = None, None, None
    for pdf in batches:
        out = []
        for key, t, seq, piece in zip(pdf["g"], pdf["task"], pdf["seq"], pdf["piece"], strict=True):
            if key != g:
                if g is not None:
                    out.append((g, h.hexdigest()))
                g, h, task = key, hashlib.sha256(), None
            if task is not None and seq == 0:
                h.update(b"\n")
            task = t
            h.update(piece.encode("utf-8", "surrogatepass"))
        yield pd.DataFrame(out, columns=["g", "whole"])
    if g is not None:
        yield pd.DataFrame([(g, h.hexdigest())], columns=["g", "whole"])


def audit(rows: DataFrame, conversations: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row a conversation of ``conversations`` (column conv) from ``rows`` (conv, turn, role, text): conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are ordered by turn (null first); rows of one turn by role, text digest and place. Null role and text are
    one space. A role counts by its initial; an empty role has none and cannot stay. Repeated rows are duplicates;
    a null conversation is one conversation; conversations without rows have zeros, an empty audit and the hash of nothing;
    empty tables give no rows. A conversation of any length is spread over tasks, hot turns and equal rows too. What
    stays serial by its nature is the SHA-256 of a conversation that lies in several tasks: one task streams its pieces.
    """
    spark = rows.sparkSession
    kind = conversations.schema["conv"].dataType
    clean = rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    flagged = saved(faults(clean))
    size = flagged.agg(F.sum(F.octet_length("text") + F.octet_length("role") + 40)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // task_bytes))
    keys = ["g", F.col("turn").asc_nulls_first(), "role", "th", "row"]
    slim = flagged.select("g", "turn", "role", "text", "row", F.md5(F.col("text").cast("binary")).alias("th"), _symbol().alias("symbol"))
    with batches_of(spark, BATCH_ROWS):
        # checkpointed: all passes must see the same rows in the same tasks
        order = cut(slim.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).select("g", "role", "text", "symbol"))
        edges = saved(order.select("g", "symbol").mapInPandas(_edges, "task int, g string, symbols string"))
        known, _ = stitched(edges)
        done = saved(order.mapInPandas(_writer(known), "g string, task int, seq int, opens boolean, first string, last string, illegal long, cost long, audit string, sha string, piece string"))
        pieces = done.where("sha is null and piece is not null").select("g", "task", "seq", "piece")
        hashed = saved(pieces.repartition("g").sortWithinPartitions("g", "task", "seq").mapInPandas(_hashes, "g string, whole string"))
    turns = flagged.groupBy("g", "turn").agg(*[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    counts = turns.groupBy("g").agg(gaps.alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    # a conversation has as many chunks as tasks that hold it
    chunk = F.sort_array(F.collect_list(F.struct("task", "first", "last", "audit")))
    parts = done.where("seq = 0").groupBy("g").agg(F.sum("illegal").alias("inside"), F.sum("cost").alias("cost"), F.max("sha").alias("sha"), chunk.alias("c"))
    # pairs across the edges of tasks: the last initial of a chunk and the first of the next
    seam = F.expr("aggregate(sequence(1, size(c) - 1), 0L, (n, k) -> n + if(concat(c[k - 1].last, c[k].first) in ('su', 'ua', 'au'), 0L, 1L))")
    seams = F.when(F.size("c") > 1, seam).otherwise(F.lit(0))
    parts = parts.select("g", (F.col("inside") + seams).alias("illegal"), "cost", F.array_join(F.transform("c", lambda x: x["audit"]), "").alias("audit"), "sha")
    every = conversations.select("conv").distinct().withColumn("g", F.coalesce(F.concat(F.lit("v"), F.col("conv").cast("string")), F.lit("")))
    out = every.join(counts, "g", "left").join(parts, "g", "left").join(hashed, "g", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return out.select(F.col("conv").cast(kind).alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", "whole", F.lit(nothing)).alias("repaired_sha256"))
