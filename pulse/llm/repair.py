"""Operator 11: repair of conversation structure by depth-first branch and bound.

A repaired conversation is an optional system row and then user and assistant rows in turn, the last an assistant's (or
nothing at all).  Every row is kept (K, cost 0), given the role that fits (R, 2) or deleted (D, 3); rows with an empty
text may be inserted (I, 2) before any row and at the end.  Blank and repeated rows must be deleted; a truncated row that
stays costs 1 more.  ``repair`` searches the edits with an explicit stack: suffix lower bounds, the incumbent
(cost, audit) and a dominance table per node cut branches until the cheapest audit, ASCII-least among equals, is proved.

On Spark: equal rows are counted first; the rows are range-sorted by conversation and turn, with one marker row at the
first place of every (conversation, role, text), so a task that streams them knows which rows are repeated and a hot
conversation is spread over tasks.  A conversation of at most ``PART`` rows inside one task is repaired there.  Any other
is cut into parts; a part is searched for every pair of states at its ends, a merge of these small tables picks the
states, and the parts are then repaired on their own.  What meets in one task is by contract one value: the audit (a
letter a row) and the digest of one conversation, whose text passes a hash piece by piece.

Edge cases: a null conv_id is a conversation of its own; null role and text are one blank; rows of one turn stand in the order of
role and text digest; repeated rows of equal turn, role and text are duplicates; a role that is empty or starts with
neither s, u nor a can't be kept; a conversation without rows gives zeros, an empty audit and the hash of the empty text; an empty
table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.llm.common import saved

PART = 256               # rows of a part
PART_BYTES = 4 << 20     # and its bytes of text
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
OTHER, SYSTEM, USER, ASSISTANT = range(4)
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
GONE = 2                 # fault of rows that must be deleted; 1 is truncated
NOTHING = 0              # states: nothing written yet, or the last role written
FAR = 1 << 60


def _turn(state: int) -> int:
    """The state after a user or assistant row: in every state just one of them fits."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, initial: int) -> int:
    """The state after a row that keeps its role; -1 if the role doesn't fit."""
    if initial == SYSTEM:
        return SYSTEM if state == NOTHING else -1
    return initial if initial != OTHER and initial == _turn(state) else -1


def _bounds(rows: tuple, last: tuple) -> list[tuple]:
    """At least this much is still to pay, by row and state; ``last`` says what an end in each state costs at least."""
    def inserted(costs):
        for _ in range(2):
            costs = [min(costs[s], INSERT + costs[_turn(s)]) for s in range(4)]
        return tuple(costs)

    low = [last]
    for initial, fault in reversed(rows):
        after = low[-1]
        if fault == GONE:
            low.append(inserted([DELETE + c for c in after]))
            continue
        here = []
        for s in range(4):
            k = _kept(s, initial)
            here.append(min(DELETE + after[s], REROLE + fault + after[_turn(s)], FAR if k < 0 else fault + after[k]))
        low.append(inserted(here))
    return low[::-1]


def _children(rows, i, state, cost, audit):
    """The edits at a node in ASCII order of their letters: (next row, state, cost, audit)."""
    if i < len(rows):
        initial, fault = rows[i]
        yield i + 1, state, cost + DELETE, audit + "D"
        yield i, _turn(state), cost + INSERT, audit + "I"
        if fault != GONE:
            k = _kept(state, initial)
            if k >= 0:
                yield i + 1, k, cost + fault, audit + "K"
            yield i + 1, _turn(state), cost + REROLE + fault, audit + "R"


def repair(rows: tuple, start: int = NOTHING, goal: int | None = None) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of ``rows``, (initial, fault) each; ASCII-least among equals.

    From state ``start`` to state ``goal``; without a goal to the end of the conversation, where rows may be added.  None if
    the goal can't be reached.
    """
    n = len(rows)
    # bounds of a whole conversation let it end in any state; the search itself does not
    low = _bounds(rows, (0, 0, 0, 0) if goal is None else tuple(0 if s == goal else FAR for s in range(4)))
    if low[0][start] >= FAR:
        return None

    def edits(i, state, cost, audit):
        if i == n and goal is None and state in (SYSTEM, USER):
            return [(i, _turn(state), cost + INSERT, audit + "I")]
        return list(_children(rows, i, state, cost, audit))

    def ends(i, state):
        return i == n and (state in (NOTHING, ASSISTANT) if goal is None else state == goal)

    # first incumbent: always the edit of the least bound
    node = (0, start, 0, "")
    while not ends(*node[:2]) and (ways := edits(*node)):
        node = min(ways, key=lambda w: w[2] + low[w[0]][w[1]])
    incumbent = node[2:] if ends(*node[:2]) else (FAR, "")
    best: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        bound = cost + low[i][state]
        if bound > incumbent[0] or bound >= FAR or (bound == incumbent[0] and audit > incumbent[1][:len(audit)]):
            continue
        seen = best.get((i, state))
        if seen is not None and seen <= (cost, audit):
            continue
        best[i, state] = (cost, audit)
        if ends(i, state):
            incumbent = min(incumbent, (cost, audit))
            continue
        stack.extend(reversed(edits(i, state, cost, audit)))
    return None if incumbent[0] >= FAR else incumbent


_repair = lru_cache(1 << 15)(repair)


def apply_audit(rows: list[tuple[str, str]], audit: str, state: int = NOTHING) -> list[tuple[str, str]]:
    """The repaired (role, text) rows: the edits of ``audit`` done to ``rows``."""
    out, at = [], iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(at)
        if letter == "K":
            state = _kept(state, INITIAL[role[0]])
        elif letter in "IR":
            state = _turn(state)
            role = "assistant" if state == ASSISTANT else "user"
        if letter != "D":
            out.append((role, text))
    return out


# ---------------------------------------------------------------------------
# what a run of rows of one conversation says
# ---------------------------------------------------------------------------
class _Run:
    """Rows of one conversation in order: (role, text, turn, initial, fault), and counts over them."""

    def __init__(self, conv):
        self.conv, self.rows, self.bytes = conv, [], 0

    def add(self, role: str, text: str, turn, first: bool) -> None:
        trimmed = text.strip(SPACE)
        kind = "blank" if not trimmed else "duplicate" if not first else "truncated" if trimmed[-1] not in ENDS else ""
        fault = GONE if kind in ("blank", "duplicate") else TRUNCATED if kind else 0
        self.rows.append((role, text, turn, INITIAL.get(role[:1], OTHER), fault, kind))
        self.bytes += len(text)

    def codes(self) -> tuple:
        return tuple((r[3], r[4]) for r in self.rows)

    def facts(self) -> dict:
        rows, turns = self.rows, [r[2] for r in self.rows if r[2] is not None]
        legal = ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
        return {"blank": sum(r[5] == "blank" for r in rows), "duplicate": sum(r[5] == "duplicate" for r in rows),
                "truncated": sum(r[5] == "truncated" for r in rows),
                "illegal": sum((a[3], b[3]) not in legal for a, b in zip(rows, rows[1:])),
                "head": rows[0][3] if rows else -1, "tail": rows[-1][3] if rows else -1,
                "least": min(turns, default=None), "most": max(turns, default=None), "turns": len(set(turns))}


def _joined(a: dict, b: dict) -> dict:
    """The facts of two neighbouring runs of one conversation."""
    if a["head"] < 0 or b["head"] < 0:
        return b if a["head"] < 0 else a
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += (a["tail"], b["head"]) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
    out["turns"] -= a["most"] is not None and a["most"] == b["least"]
    return out | {"head": a["head"], "tail": b["tail"], "least": a["least"] if b["least"] is None or a["least"] is not None
                  else b["least"], "most": a["most"] if b["most"] is None else b["most"]}


def _gaps(f: dict) -> int:
    return 0 if f["least"] is None else f["most"] - f["least"] + 1 - f["turns"]


def _digest(pieces) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text in pieces).encode()).hexdigest()


FACTS = "blank long, duplicate long, truncated long, illegal long"
CELL = "struct<start:int,goal:int,cost:long,audit:string>"
_OUT = f"gaps long, {FACTS}, cost long, audit string, repaired_sha256 string"
_PART = (f"part long, cells array<{CELL}>, facts struct<blank:long,duplicate:long,truncated:long,illegal:long,head:int,"
         "tail:int,least:long,most:long,turns:long>, roles array<string>, texts array<string>")


def _schema(conv: T.StructField, ddl: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv.dataType), *T.StructType.fromDDL(ddl).fields])


def _to_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in schema.names}, schema=schema)


def _cells(codes: tuple) -> list[dict]:
    found = [(s, g, _repair(codes, s, g)) for s in range(4) for g in range(4)]
    return [{"start": s, "goal": g, "cost": f[0], "audit": f[1]} for s, g, f in found if f]


def _repaired(run: _Run) -> dict:
    cost, audit = _repair(run.codes())
    facts = run.facts()
    return {"conv_id": run.conv, "cost": cost, "audit": audit, "gaps": _gaps(facts),
            "repaired_sha256": _digest(apply_audit([r[:2] for r in run.rows], audit)),
            **{k: facts[k] for k in ("blank", "duplicate", "truncated", "illegal")}}


def _part(run: _Run, key: int) -> dict:
    return {"conv_id": run.conv, "part": key, "cells": _cells(run.codes()), "facts": run.facts(),
            "roles": [r[0] for r in run.rows], "texts": [r[1] for r in run.rows]}


def _stream(schema: pa.Schema):
    """Sorted rows -> repaired conversations, or the parts of those that a task may not see as a whole."""
    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 33, 0
        run, edge, marked, out = None, True, None, []

        def closed(whole: bool):
            nonlocal count
            if whole:
                return _repaired(run)
            count += 1
            return _part(run, base + count)

        for batch in batches:
            for conv, turn, role, text, digest, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if run is None or conv != run.conv:
                    if run is not None:
                        out.append(closed(not edge))
                        edge = False            # only the first and the last run may go on in another task
                    run, marked = _Run(conv), None
                if copies == 0:                 # a row that was dropped: the conversation exists
                    continue
                if copies is None:              # the first place of this role and text
                    marked = (turn, role, digest)
                    continue
                for k in range(copies):
                    if len(run.rows) >= PART or run.bytes >= PART_BYTES:
                        out.append(closed(False))
                        run, edge = _Run(conv), True
                    run.add(role, text, turn, k == 0 and marked == (turn, role, digest))
                if len(out) >= 512:
                    yield _to_batch(out, schema)
                    out = []
        if run is not None:
            out.append(closed(False))
        yield _to_batch(out, schema)

    return run_task


def _merge(schema: pa.Schema):
    """Parts in order -> the state each starts in and its edits, and the facts of the conversation at its last part."""
    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, parts, facts, labels = None, [], None, {}

        def closed():
            # the ways that end in a legal state, with the rows that are added there
            ends = [(cost + INSERT * len(more), audit + more, s) for s, (cost, audit) in labels.items()
                    for more in [{NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[s]]]
            cost, _, state = min(ends)
            more = {SYSTEM: "II", USER: "I"}.get(state, "")
            path = []
            for key, cells, back in reversed(parts):
                start = back[state]
                path.append((key, start, cells[start, state][1]))
                state = start
            rows = [{"part": key, "state": s, "edits": a} for key, s, a in reversed(path)]
            rows[-1] |= {"more": more, "cost": cost, "gaps": _gaps(facts),
                         **{k: facts[k] for k in ("blank", "duplicate", "truncated", "illegal")}}
            return rows

        for batch in batches:
            out = []
            for at, key, cells, own in zip(*(c.to_pylist() for c in batch.columns)):
                if not parts or at != conv:
                    if parts:
                        out.extend(closed())
                    conv, parts, facts, labels = at, [], None, {NOTHING: (0, "")}
                facts = own if facts is None else _joined(facts, own)
                cells = {(c["start"], c["goal"]): (c["cost"], c["audit"]) for c in cells}
                new, back = {}, {}
                for (s, g), (cost, audit) in cells.items():
                    if s in labels:
                        way = (labels[s][0] + cost, labels[s][1] + audit)
                        if g not in new or way < new[g]:
                            new[g], back[g] = way, s
                labels = new
                parts.append((key, cells, back))
            yield _to_batch(out, schema)
        if parts:
            yield _to_batch(closed(), schema)

    return run_task


def _digests(schema: pa.Schema):
    """Repaired parts in order -> one row a conversation; the digest takes the pieces one after the other."""
    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, audit, empty, fresh = None, None, [], True, True
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if fresh or row["conv_id"] != conv:
                    conv, digest, audit, empty, fresh = row["conv_id"], hashlib.sha256(), [], True, False
                if row["piece"] is not None:
                    digest.update(("" if empty else "\n").encode() + row["piece"].encode())
                    empty = False
                audit.append(row["edits"])
                if row["cost"] is not None:     # the last part
                    out.append({k: row[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
                               | {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()})
                    fresh = True
            yield _to_batch(out, schema)

    return run_task


def _pieces(schema: pa.Schema):
    """A part's rows and edits -> its repaired text, null if no row is left."""
    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                edits = row["edits"] + (row["more"] or "")
                left = apply_audit(list(zip(row["roles"], row["texts"])), edits, row["state"])
                out.append(row | {"edits": edits,
                                  "piece": "\n".join(f"{r}:{t}" for r, t in left) if left else None})
            yield _to_batch(out, schema)

    return run_task


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _map(df: DataFrame, make, schema: T.StructType) -> DataFrame:
    return df.mapInArrow(make(_arrow(schema)), schema)


def repair_conversations(rows: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text",
                         copies: Column | None = None) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``copies``: how often a row stands (1); 0 keeps nothing of it but the conversation's name.
    """
    blank = F.lit(" ")
    n = F.lit(1) if copies is None else copies
    own = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                      F.coalesce(F.col(role_col).cast("string"), blank).alias("role"),
                      F.coalesce(F.col(text_col).cast("string"), blank).alias("text"), n.cast("long").alias("copies"))
    here = F.col("copies") > 0
    own = own.select("conv_id", *[F.when(here, F.col(c)).alias(c) for c in ("turn", "role", "text")], "copies")
    counted = (own.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
               .withColumn("digest", F.unhex(F.md5("text"))))
    # the first turn; a null turn comes before all others
    firsts = (counted.where("copies > 0").groupBy("conv_id", "role", "digest")
              .agg(F.max(F.col("turn").isNull()).alias("unknown"), F.min("turn").alias("turn"))
              .select("conv_id", F.when(~F.col("unknown"), F.col("turn")).alias("turn"), "role",
                      F.lit(None).cast("string").alias("text"), "digest", F.lit(None).cast("long").alias("copies")))
    order = ["conv_id", "turn", "role", "digest"]
    both = counted.select(*firsts.columns).unionByName(firsts)
    sorted_rows = both.repartitionByRange(*order).sortWithinPartitions(*order, F.col("copies").asc_nulls_first())
    conv = own.schema["conv_id"]
    done = _schema(conv, f"{_OUT}, {_PART}")
    seen = saved(_map(sorted_rows, _stream, done), "conversations")
    whole = _schema(conv, _OUT)
    parts = seen.where("part is not null")
    in_order = parts.select("conv_id", "part", "cells", "facts").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    steps = T.StructType.fromDDL(f"part long, state int, edits string, more string, gaps long, {FACTS}, cost long")
    ways = _map(in_order, _merge, steps)
    repaired = parts.select("conv_id", "part", "roles", "texts").join(ways, "part")
    named = _schema(conv, f"part long, edits string, piece string, gaps long, {FACTS}, cost long")
    pieces = _map(repaired, _pieces, named).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return seen.where("part is null").select(*whole.names).unionByName(_map(pieces, _digests, whole))


def damaged(rows: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """``rows`` with the contract's damage and a new column ``copies``: crc32 of ``conv:turn`` modulo 20 says which.

    0 drops the row (copies 0), 1 empties its text, 2 removes its sentence ends, 3 repeats it (copies 2), 4 makes it a user's.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of(conv_col), F.lit(":"), text_of(turn_col))) % 20
    return rows.select(
        F.col(conv_col), F.col(turn_col),
        F.when(kind == 4, F.lit("user")).otherwise(text_of(role_col)).alias(role_col),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text_of(text_col), ENDS, ""))
        .otherwise(text_of(text_col)).alias(text_col),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))
