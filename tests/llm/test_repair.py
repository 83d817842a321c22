import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pulse.llm import repair as R
from pulse.llm.queries import op11_conversation_repair

LEGAL = re.compile(r"(s?(ua)+)?\Z")
SPACE = " \t\n\x0b\x0c\r"


def exhaustive(rows):
    """The best (cost, audit) among all edits with at most two inserts in a row; rows are (initial, fault)."""
    best = None

    def go(i, out, cost, audit, inserts):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows):
            if LEGAL.match(out) and (best is None or (cost, audit) < best):
                best = (cost, audit)
        else:
            initial, fault = rows[i]
            go(i + 1, out, cost + 3, audit + "D", 0)
            if fault != R.GONE:
                go(i + 1, out + "xsua"[initial], cost + fault, audit + "K", 0)
                for role in "ua":
                    go(i + 1, out + role, cost + 2 + fault, audit + "R", 0)
        if inserts < 2:
            for role in "ua":
                go(i, out + role, cost + 2, audit + "I", inserts + 1)

    go(0, "", 0, "", 0)
    return best


def step_by_step(rows):
    """The same by the cheapest way to each end of the text so far (nothing, s, u, a), row by row."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    def least(ways):
        best = {}
        for end, way in ways:
            best[end] = min(best.get(end, way), way)
        return best

    def inserted(ways):
        for _ in range(2):
            ways = least([*ways.items(), *((n, (c + 2, a + "I")) for e, (c, a) in ways.items() for n in follows[e] if n != "s")])
        return ways

    ways = {"": (0, "")}
    for initial, fault in rows:
        own, new = "xsua"[initial], []
        for end, (cost, audit) in inserted(ways).items():
            new.append((end, (cost + 3, audit + "D")))
            if fault != R.GONE:
                new += [(own, (cost + fault, audit + "K"))] if own in follows[end] else []
                new += [(n, (cost + 2 + fault, audit + "R")) for n in follows[end] if n != "s"]
        ways = least(new)
    ways = inserted(ways)
    return min(ways[e] for e in ("", "a") if e in ways)


def expected(rows):
    """The contract's row of a conversation: rows are (turn, role, text) after damage, in order."""
    seen, codes, said = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        trimmed = text.strip(SPACE)
        kind = "blank" if not trimmed else "duplicate" if (role, text) in seen else "truncated" if trimmed[-1] not in ".!?" else ""
        seen.add((role, text))
        if kind:
            said[kind] += 1
        codes.append((R.INITIAL.get(role[:1], R.OTHER), 2 if kind in ("blank", "duplicate") else 1 if kind else 0))
    cost, audit = step_by_step(codes)
    turns = [t for t, _, _ in rows if t is not None]
    out, at = [], iter(rows)
    for letter in audit:
        _, role, text = (None, "", "") if letter == "I" else next(at)
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if out and out[-1].startswith("u") else "user"
        out.append(f"{role}:{text}")
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **said,
            "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), "cost": cost,
            "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def random_rows(rng, n):
    return tuple((rng.choice([0, 1, 2, 2, 3, 3]), rng.choice([0, 0, 0, 1, 2])) for _ in range(n))


def test_search_is_optimal_and_ascii_least():
    rng = random.Random(1)
    for _ in range(600):
        rows = random_rows(rng, rng.randint(0, 4))
        assert R.repair(rows) == exhaustive(rows) == step_by_step(rows), rows
    for n in (9, 40, 300):
        for _ in range(10):
            rows = random_rows(rng, n)
            assert R.repair(rows) == step_by_step(rows)
    for same in ((R.SYSTEM, 0), (R.USER, 0), (R.ASSISTANT, 1), (R.OTHER, 0), (R.USER, R.GONE)):
        assert R.repair((same,) * 200) == step_by_step((same,) * 200)


def test_parts_joined_by_their_end_states_give_the_whole():
    rng = random.Random(2)
    for _ in range(100):
        rows = random_rows(rng, 12)
        ways = {0: (0, "")}
        for part in (rows[:5], rows[5:6], rows[6:]):
            new = {}
            for cell in R._cells(part):
                if cell["start"] in ways:
                    cost, audit = ways[cell["start"]]
                    way = (cost + cell["cost"], audit + cell["audit"])
                    new[cell["goal"]] = min(new.get(cell["goal"], way), way)
            ways = new
        ends = [ways[0]] if 0 in ways else []
        ends += [(ways[s][0] + 2 * n, ways[s][1] + "I" * n) for s, n in ((1, 2), (2, 1), (3, 0)) if s in ways]
        assert min(ends) == R.repair(rows)


SCHEMA = "conv_id long, turn long, role string, text string, digest string, copies string, part int"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 7) for r in rows], SCHEMA)


def _got(df):
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


def _by_conversation(rows):
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest())
    for r in sorted(((c, t, role if role is not None else " ", text if text is not None else " ") for c, t, role, text in rows), key=order):
        out.setdefault(r[0], []).append(r[1:])
    return out


def test_edge_cases_and_clashing_columns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Hello."), (1, 2, "assistant", "Hello."),
            (2, None, "user", "a."), (2, 5, "user", None), (2, 9, None, "b."), (None, 3, "assistant", "c"), (None, 3, "", "d."),
            (3, 1, "user", "  \t\n"), (4, 1, "user", "é…" * 20000), (4, 2, "assistant", "x" * 50000 + "!"), (5, 1, "tool", "z."),
            (6, 7, "assistant", "A."), (6, 7, "user", "U."), (6, 7, "user", "B.")]
    got = _got(R.repair_conversations(_frame(spark, rows)))
    want = {c: expected(r) for c, r in _by_conversation(rows).items()}
    assert got == want
    assert got[1]["duplicate"] == 1 and got[1]["audit"] == "KKKD" and got[3]["cost"] == 3 and got[3]["audit"] == "D"
    assert R.repair_conversations(_frame(spark, [])).collect() == []


@pytest.mark.parametrize("part", [4, 256])
def test_hot_conversation_in_parts(spark, monkeypatch, part):
    monkeypatch.setattr(R, "PART", part)
    rng = random.Random(3)
    rows = []
    for conv, n in ((1, 900), (2, 3), (None, 40), *((c, 5) for c in range(10, 60))):
        for i in range(n):
            text = rng.choice(["", "one.", "two", "three!", f"own {conv} {i}.", f"own {conv} {i}"])
            rows.append((conv, rng.choice([None, i, i, i]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), text))
    rows += [(7, 1, "user", "same.")] * 50       # repeated rows of one turn
    assert _got(R.repair_conversations(_frame(spark, rows).repartition(6))) == {
        c: expected(r) for c, r in _by_conversation(rows).items()}


def test_query_damages_by_the_contract(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["system", "user", "assistant", None]), rng.choice(["Yes. No!", "why?", "open", None, f"{c} {t}."]))
            for c in range(60) for t in range(rng.randint(1, 7))] + [(None, 2, "user", "q."), (70, None, "user", "r.")]
    _frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    damaged, all_ids = [], {r[0] for r in rows}
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(name.encode()) % 20, role or " ", text or " "
        if kind:
            row = (conv, turn, "user" if kind == 4 else role,
                   "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            damaged += [row] * (2 if kind == 3 else 1)
    by = _by_conversation(damaged)
    want = {c: expected(by.get(c, [])) for c in all_ids}
    assert _got(op11_conversation_repair(spark, str(tmp_path))) == want


def test_conversation_whose_rows_are_all_dropped(spark):
    df = _frame(spark, [(1, 1, "user", "a."), (2, 1, "user", "b.")])
    got = _got(R.repair_conversations(df, copies=F.when(F.col("conv_id") == 1, 0).otherwise(1)))
    assert got[1] == {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "",
                      "repaired_sha256": hashlib.sha256(b"").hexdigest()}
