"""Repair of conversations against a brute-force search over the grammar's states."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest import SF

from tidepanel.llm import turn_repair
from tidepanel.llm.queries import QUERIES, table

BLANK = "[^\x20\x09-\x0d]"


def said(value):
    return " " if value is None else str(value)


def cheapest(symbols):
    """Least (cost, audit) of (initial, must go, truncated) rows, over the states of the grammar."""
    ends = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "")}

    def inserts(best):
        for _ in range(2):
            for state, (cost, audit) in list(best.items()):
                for role in ends[state].replace("s", ""):
                    way = (cost + 2, audit + "I")
                    best[role] = min(best.get(role, way), way)
        return best

    best = inserts(best)
    for initial, gone, cut in symbols:
        after = {}
        for state, (cost, audit) in best.items():
            ways = [(state, 3, "D")]
            if not gone:
                ways += [(role, cut + (0 if role == initial else 2), "K" if role == initial else "R") for role in ends[state] if role == initial or role != "s"]
            for end, more, edit in ways:
                way = (cost + more, audit + edit)
                after[end] = min(after.get(end, way), way)
        best = inserts(after)
    return min(best[end] for end in ("", "a") if end in best)


def expected(rows):
    """The whole report of (conv_id, turn, role, text) rows."""
    left = {}
    for conv, turn, role, text in rows:
        kept = left.setdefault(conv, [])
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, kept in left.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults, symbols = set(), [], []
        for _, role, text in kept:
            marks = re.findall(BLANK, text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            symbols.append((role[:1] or "x", fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for t, _, _ in kept if t is not None}
        cost, audit = cheapest(symbols)
        length = len(audit) - audit.count("D")
        wanted = ["system"] * (length % 2) + ["user", "assistant"] * length
        repaired, at = [], 0
        for edit in audit:
            if edit == "I":
                repaired.append(wanted[len(repaired)] + ":")
                continue
            _, role, text = kept[at]
            at += 1
            if edit != "D":
                repaired.append((role if edit == "K" else wanted[len(repaired)]) + ":" + text)
        out.append(
            (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
             sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:])), cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
        )
    return out


def same(got, rows):
    key = repr
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(expected(rows), key=key)


def test_given_tables(spark):
    data = table(spark, SF, "conversations")
    same(QUERIES["op13_turn_repair"](spark, SF), [tuple(r) for r in data.select("conv_id", "turn", "role", "text").collect()])


def made(seed, n, lengths):
    rng = np.random.default_rng(seed)
    rows = []
    for conv in range(n):
        for turn in range(int(rng.integers(*lengths))):
            role = rng.choice(["user", "assistant", "system", "tool", ""], p=[0.4, 0.4, 0.08, 0.07, 0.05])
            rows.append((conv, int(turn * rng.choice([1, 1, 1, 2])), str(role), str(rng.choice(["Yes.", "no", "", " \t", f"so {turn}!", f"and {turn}  \n", "why?"]))))
    return rows


FORM = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("lengths", [(0, 9), (30, 160)])
def test_random_conversations(spark, lengths):
    rows = made(3, 60 if lengths[1] < 10 else 8, lengths)
    same(turn_repair.report(spark.createDataFrame(rows, FORM)), rows)


def test_one_conversation_over_many_tasks(spark):
    """A conversation that holds most rows is cut, and its pieces are put together."""
    rows = [(7, t, ("user", "assistant")[t % 2] if t % 11 else "tool", f"x {t % 40}{'.' if t % 7 else ''}") for t in range(1500)] + made(5, 30, (1, 6))[: 60]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = turn_repair.damaged(spark.createDataFrame(rows, FORM))
        assert turn_repair.audits(data).where("conv_id = 7").count() == 1
        same(turn_repair.report(spark.createDataFrame(rows, FORM)), rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(spark):
    long = "word " * 40_000
    rows = [(None, 0, "user", "Hi."), (None, None, "assistant", None), (1, None, None, "a."), (1, None, "user", "b."), (2, 5, "user", long), (2, 5, "user", long), (2, 9, "", "x."), (3, 1, "system", "Be."), (4, 2, "User", "")]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], FORM + ", copies string, piece int")
    same(turn_repair.report(frame), rows)
    assert turn_repair.report(frame.limit(0)).count() == 0


def test_everything_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    row = turn_repair.report(spark.createDataFrame([(1, turn, "user", "Hi.")], FORM)).first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_blocks_compose():
    rng = np.random.default_rng(1)
    for _ in range(60):
        symbols = "".join(rng.choice(list("suaxSUAX"), int(rng.integers(0, 9))))
        for cut in range(len(symbols) + 1):
            both = turn_repair.composed(turn_repair.block_table(symbols[:cut]), turn_repair.block_table(symbols[cut:]))
            assert both == turn_repair.block_table(symbols)
        assert turn_repair.accepted(turn_repair.block_table(symbols)) == turn_repair.whole(symbols) == cheapest([(c.lower(), False, c.isupper()) for c in symbols])
