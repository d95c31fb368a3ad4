"""Conversations brought back to ``system? (user assistant)+`` at the least cost.

Edits of a row: Keep costs 0, Rerole to user or assistant 2, Delete 3; Insert of an empty
user or assistant turn costs 2.  Blank and repeated rows must be deleted, truncated ones
that stay add 1.  A repair of a given length has one possible sequence of roles, so turns
are aligned to each feasible length of it by the Wagner-Fischer recurrence, inside the
Ukkonen band that the cheapest alignment found so far leaves; among equal costs the
ASCII-least audit (the edits' initials in order) wins.

A long conversation is cut into blocks.  Each is aligned from every state of the grammar
to every other, and such tables compose, so blocks and the pieces of a conversation that
lie in different tasks are put together without ever holding its rows.

Odd rows: NULLs of role and text count as one space, as in the damage.  A NULL conv_id is
a conversation like any other.  Rows of one turn follow each other by role, then by a hash
of their text; identical rows lie beside each other.  A role that is empty or begins with
another letter than s, u or a can't be kept.  Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import kept

#: Rows that are aligned at once; longer conversations are composed of blocks.
BLOCK = 24
#: Patterns of a block whose tables a task remembers.
REMEMBERED = 20_000

# Costs of edits, and the states of the grammar (nothing yet, after s, after u, after a).
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
START, HEAD, OPEN, CLOSED = range(4)
SEQUENCES = ("su", "ua", "au")
ROLES = {"s": "system", "u": "user", "a": "assistant"}
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

Best = tuple[int, str]
Table = dict[tuple[int, int], Best]


# -- alignment ------------------------------------------------------------------------------


def target(first: str, length: int) -> str:
    """The role initials of a repair of this length that begins with ``first``."""
    if first == "s":
        return ("s" + "ua" * length)[:length]
    return ("ua" * length if first == "u" else "au" * length)[:length]


def _step(symbol: str, wanted: str) -> int | None:
    """Cost of giving a row this role; upper-case symbols are truncated rows."""
    if symbol.lower() == wanted:
        return TRUNCATED * symbol.isupper()
    return None if wanted == "s" else REROLE + TRUNCATED * symbol.isupper()


def diagonal(symbols: str, wanted: str) -> int | None:
    """Cost of one-to-one roles with the surplus deleted or inserted at the end: a first incumbent."""
    if "s" in wanted[len(symbols) :]:
        return None
    steps = [_step(s, w) for s, w in zip(symbols, wanted)]
    if None in steps:
        return None
    return sum(steps) + max(0, len(symbols) - len(wanted)) * DELETE + max(0, len(wanted) - len(symbols)) * INSERT


def aligned(symbols: str, wanted: str, bound: int) -> Best | None:
    """Cheapest alignment to the roles ``wanted`` if it costs at most ``bound``, with its ASCII-least audit.

    A path that leaves the diagonal by d rows pays for the way out and back, so only cells
    with a drift between ``low`` and ``high`` can lie on one within the bound.
    """
    n, m = len(symbols), len(wanted)
    drift = m - n
    if max(INSERT * drift, -DELETE * drift) > bound:
        return None
    high = (bound + DELETE * drift) // (INSERT + DELETE)
    low = -((bound - INSERT * drift) // (INSERT + DELETE))
    far = bound + 1
    after: list[dict[int, int]] = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        here, below = after[i], after[i + 1] if i < n else {}
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            best = 0 if i == n and j == m else far
            if i < n:
                best = min(best, below.get(j, far) + DELETE)
                if j < m and (step := _step(symbols[i], wanted[j])) is not None:
                    best = min(best, below.get(j + 1, far) + step)
            if j < m and wanted[j] != "s":
                best = min(best, here.get(j + 1, far) + INSERT)
            if best <= bound:
                here[j] = best
    if 0 not in after[0]:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        left = after[i][j]
        if i < n and after[i + 1].get(j, far) + DELETE == left:
            audit.append("D")
            i += 1
        elif j < m and wanted[j] != "s" and after[i].get(j + 1, far) + INSERT == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if symbols[i].lower() == wanted[j] else "R")
            i, j = i + 1, j + 1
    return after[0][0], "".join(audit)


def over_lengths(symbols: str, first: str, least: int, step: int) -> Best | None:
    """The best alignment over the lengths ``least``, ``least + step``, ...; no longer one can pay once its surplus alone costs more."""
    n = len(symbols)
    if first == "s" and "s" not in symbols.lower():
        return None
    near = least + max(0, round((n - least) / step)) * step
    incumbent = DELETE * n + INSERT * least
    guess = diagonal(symbols, target(first, near))
    incumbent = incumbent if guess is None else min(incumbent, guess)
    best: Best | None = None

    def surplus(length: int) -> int:
        return max(INSERT * (length - n), DELETE * (n - length))

    shorter, longer = near, near + step
    while True:
        ways = [x for x in (shorter, longer) if x >= least and surplus(x) <= incumbent]
        if not ways:
            return best
        length = min(ways, key=surplus)
        if length == shorter:
            shorter -= step
        else:
            longer += step
        found = aligned(symbols, target(first, length), incumbent)
        if found is not None and (best is None or found < best):
            best, incumbent = found, found[0]


def _better(table: Table, key: tuple[int, int], found: Best | None) -> None:
    if found is not None and (key not in table or found < table[key]):
        table[key] = found


def block_table(symbols: str) -> Table:
    """Cheapest edits of a block from each state of the grammar to each other."""
    gone = (DELETE * len(symbols), "D" * len(symbols))
    table: Table = {(state, state): gone for state in (START, HEAD, OPEN, CLOSED)}
    to_open, to_closed = over_lengths(symbols, "u", 1, 2), over_lengths(symbols, "u", 2, 2)
    for state in (START, HEAD, CLOSED):
        _better(table, (state, OPEN), to_open)
        _better(table, (state, CLOSED), to_closed)
    _better(table, (OPEN, CLOSED), over_lengths(symbols, "a", 1, 2))
    _better(table, (OPEN, OPEN), over_lengths(symbols, "a", 2, 2))
    head = target("s", 1)
    if "s" in symbols.lower():
        _better(table, (START, HEAD), aligned(symbols, head, DELETE * len(symbols)))
        _better(table, (START, OPEN), over_lengths(symbols, "s", 2, 2))
        _better(table, (START, CLOSED), over_lengths(symbols, "s", 3, 2))
    return table


def composed(left: Table, right: Table) -> Table:
    """The table of two pieces that follow each other.

    Of two audits of one piece with equal cost and states neither begins with the other
    (the surplus would be inserts, which cost), so the least of each piece make the least whole.
    """
    out: Table = {}
    for (p, q), (cost, audit) in left.items():
        for (r, s), (more, rest) in right.items():
            if q == r:
                _better(out, (p, s), (cost + more, audit + rest))
    return out


def whole(symbols: str) -> Best:
    """Repair of a conversation of at most one block."""
    ways = [(DELETE * len(symbols), "D" * len(symbols)), over_lengths(symbols, "u", 2, 2), over_lengths(symbols, "s", 3, 2)]
    return min(way for way in ways if way is not None)


def with_deletions(audit: str, doomed: list[int]) -> str:
    """The audit with the rows that had to go, which follow the row before them at once.

    ``doomed[k]`` is how many of them follow the k-th aligned row (``doomed[0]``: come before the first).
    """
    out, k = ["D" * doomed[0]], 0
    for edit in audit:
        out.append(edit)
        if edit != "I":
            k += 1
            out.append("D" * doomed[k])
    return "".join(out)


class Piece:
    """The consecutive rows of one conversation that one task sees."""

    def __init__(self) -> None:
        self.table: Table | None = None
        self.symbols: list[str] = []
        self.doomed = [0]
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "n_turns": 0}
        self.first_role = self.last_role = ""
        self.first_turn = self.last_turn = None

    def add(self, turn, role: str, fault: str) -> None:
        if not self.first_role:
            self.first_role = role
        elif self.last_role + role not in SEQUENCES:
            self.counts["illegal"] += 1
        self.last_role = role
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            if turn != self.last_turn:
                self.counts["n_turns"] += 1
            self.last_turn = turn
        if fault:
            self.counts[fault] += 1
        if fault in ("blank", "duplicate"):
            self.doomed[-1] += 1
            return
        if len(self.symbols) == BLOCK:
            self._close()
        self.symbols.append(role.upper() if fault else role)
        self.doomed.append(0)

    def _close(self) -> None:
        # The rows that had to go belong to the block whose last row they follow.
        symbols = "".join(self.symbols)
        block = {key: (cost, with_deletions(audit, self.doomed)) for key, (cost, audit) in _remembered(symbols).items()}
        self.table = block if self.table is None else composed(self.table, block)
        self.symbols, self.doomed = [], [0]

    def result(self, alone: bool) -> tuple[int, str] | Table:
        """(cost, audit) of a whole conversation, or the table of a part; forced deletions are not in the cost."""
        if alone and self.table is None:
            cost, audit = _remembered_whole("".join(self.symbols))
            return cost, with_deletions(audit, self.doomed)
        self._close()
        return accepted(self.table) if alone else self.table


def accepted(table: Table) -> Best:
    """The best way to end empty or after an assistant's turn."""
    return min(table[key] for key in ((START, START), (START, CLOSED)) if key in table)


_tables: dict[str, Table] = {}
_wholes: dict[str, Best] = {}


def _remembered(symbols: str) -> Table:
    if symbols not in _tables:
        if len(_tables) >= REMEMBERED:
            _tables.clear()
        _tables[symbols] = block_table(symbols)
    return _tables[symbols]


def _remembered_whole(symbols: str) -> Best:
    if symbols not in _wholes:
        if len(_wholes) >= REMEMBERED:
            _wholes.clear()
        _wholes[symbols] = whole(symbols)
    return _wholes[symbols]


# -- rows -----------------------------------------------------------------------------------


def _spaced(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after the damage that crc32 of ``conv_id:turn`` chooses; NULLs count as one space there and in role and text."""
    key = F.concat(_spaced(F.col("conv_id")), F.lit(":"), _spaced(F.col("turn")))
    kind = F.crc32(key.cast("binary")) % 20
    rows = rows.select("conv_id", "turn", _spaced(F.col("role")).alias("role"), _spaced(F.col("text")).alias("text"), kind.alias("kind"))
    rows = rows.where("kind != 0").withColumns(
        {
            "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
            "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")),
            "copies": F.when(F.col("kind") == 3, 2).otherwise(1).cast("long"),
        }
    )
    return rows.select("conv_id", "turn", "role", "text", "copies")


def _narrow(rows: DataFrame) -> DataFrame:
    """What alignment needs of each distinct row: its fault, its role's initial, its number of copies."""
    initial = F.substring("role", 1, 1)
    trimmed = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(trimmed == "", "blank").when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    seen = ["conv_id", "role", "text_hash"]
    slim = rows.select(
        "conv_id", "turn", F.col("role"), F.md5("text").alias("text_hash"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        fault.alias("fault"), "copies",
    )
    slim = slim.groupBy("conv_id", "turn", "role", "text_hash", "initial", "fault").agg(F.sum("copies").alias("copies"))
    # Texts met in more than one turn, with their first turn (a NULL turn comes first).
    turns = slim.where("fault <> 'blank'").groupBy(*seen).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("turn").isNull()).alias("from_null"), F.min("turn").alias("from_turn"))
    turns = turns.where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in seen], "from_null", "from_turn")
    joined = slim.join(turns, F.expr(" and ".join(f"{c} <=> _{c}" for c in seen)), "left")
    is_first = F.when(F.col("from_null"), F.col("turn").isNull()).otherwise(F.col("turn").eqNullSafe(F.col("from_turn")))
    later = (F.col("fault") != "blank") & F.col("from_null").isNotNull() & ~is_first
    return joined.select("conv_id", "turn", "role", "text_hash", "initial", "fault", later.alias("later"), "copies")


_PART = (
    "conv_id {id}, piece long, whole boolean, first_turn {turn}, last_turn {turn}, n_turns long, blank long, duplicate long, truncated long, "
    "illegal long, first_role string, last_role string, cost long, audit string, entries array<int>, exits array<int>, costs array<long>, audits array<string>"
)
_NAMES = [field.split()[0] for field in _PART.format(id="x", turn="x").split(", ")]


def _row(conv_id, piece_no: int, piece: Piece, alone: bool) -> dict:
    result = piece.result(alone)
    row = {"conv_id": conv_id, "piece": piece_no, "whole": alone, "first_turn": piece.first_turn, "last_turn": piece.last_turn}
    row |= piece.counts | {"first_role": piece.first_role, "last_role": piece.last_role}
    forced = DELETE * (piece.counts["blank"] + piece.counts["duplicate"])
    if alone:
        return row | {"cost": result[0] + forced, "audit": result[1], "entries": None, "exits": None, "costs": None, "audits": None}
    keys = sorted(result)
    return row | {
        "cost": forced, "audit": None, "entries": [p for p, _ in keys], "exits": [q for _, q in keys],
        "costs": [result[k][0] for k in keys], "audits": [result[k][1] for k in keys],
    }


def _pieces(schema: pa.Schema):
    """Sorted rows to conversations; the first and last one of a task may go on in its neighbours."""

    def out(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{name: r[name] for name in _NAMES} for r in rows], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nothing = TaskContext.get().partitionId(), object()
        current, piece, first, ready = nothing, None, True, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "later", "copies")]
            for conv_id, turn, initial, fault, later, copies in zip(*columns):
                if current is nothing or conv_id != current:
                    if current is not nothing:
                        ready.append(_row(current, part, piece, not first))
                        first = False
                    current, piece = conv_id, Piece()
                for copy in range(copies):
                    piece.add(turn, initial, fault if fault == "blank" or not (later or copy) else "duplicate")
            if len(ready) >= 1000:
                yield out(ready)
                ready = []
        if current is not nothing:
            ready.append(_row(current, part, piece, False))
        if ready:
            yield out(ready)

    return run


def _joined_pieces(schema: pa.Schema):
    """One conversation out of its pieces in different tasks."""

    def run(pieces: pa.Table) -> pa.Table:
        rows = sorted(pieces.to_pylist(), key=lambda row: row["piece"])
        row = dict(rows[0], whole=True, entries=None, exits=None, costs=None, audits=None)
        table = None
        for later in rows:
            here = {(p, q): (c, a) for p, q, c, a in zip(later["entries"], later["exits"], later["costs"], later["audits"])}
            table = here if table is None else composed(table, here)
        for later in rows[1:]:
            for name in ("n_turns", "blank", "duplicate", "truncated", "illegal", "cost"):
                row[name] += later[name]
            row["illegal"] += row["last_role"] + later["first_role"] not in SEQUENCES
            row["last_role"] = later["last_role"]
            if later["first_turn"] is not None:
                row["n_turns"] -= later["first_turn"] == row["last_turn"]
                row["last_turn"] = later["last_turn"]
                if row["first_turn"] is None:
                    row["first_turn"] = later["first_turn"]
        cost, row["audit"] = accepted(table)
        row["cost"] += cost
        return pa.Table.from_pylist([{name: row[name] for name in _NAMES}], schema)

    return run


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text, copies): gaps, faults, illegal neighbours, the cheapest repair's cost and audit."""
    spark = rows.sparkSession
    slim = kept(_narrow(rows), "turns")
    types = dict(slim.dtypes)
    form = _PART.format(id=types["conv_id"], turn=types["turn"])
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text_hash"]
    ordered = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    # Arrow's form of the schema, with the types that the ids and turns really have.
    arrow = spark.createDataFrame([], form).toArrow().schema
    pieces = kept(ordered.mapInArrow(_pieces(arrow), form), "pieces")
    split = pieces.where("not whole").groupBy("conv_id").applyInArrow(_joined_pieces(arrow), form)
    found = pieces.where("whole").unionByName(split)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0)).cast("long")
    return found.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


_TURN = "conv_id {id}, position long, edit string, role string, text string"


def _applied(schema: pa.Schema):
    """Rows after their conversation's audit, in order: the repaired turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, count, wanted, conv_id = "", 0, 0, "", None
        ready: list[tuple] = []
        size = 0

        def give(edit: str, role: str, text: str) -> None:
            nonlocal count, size
            ready.append((conv_id, count, edit, role, text))
            count += 1
            size += len(text) + 50

        def inserts() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                give("I", ROLES[wanted[count]], "")
                at += 1

        def flushed() -> pa.RecordBatch:
            nonlocal ready, size
            batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*ready), schema)], schema=schema)
            ready, size = [], 0
            return batch

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "copies")]
            for conv, header, role, text, copies in zip(*columns):
                if header is not None:
                    conv_id, audit, at, count = conv, header, 0, 0
                    length = len(audit) - audit.count("D")
                    wanted = target("s" if length % 2 else "u", length)
                    inserts()
                    continue
                for _ in range(copies):
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        give(edit, role if edit == "K" else ROLES[wanted[count]], text)
                    inserts()
                if size > 1 << 22:
                    yield flushed()
        if ready:
            yield flushed()

    return run


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired turns (conv_id, position, edit, role, text): those kept, given another role, or inserted.

    The rows of a conversation come out of one task in order.  Each follows its audit in a
    sorted stream, so that no conversation is held as a whole.
    """
    schema = _TURN.format(id=dict(rows.dtypes)["conv_id"])
    order = ["conv_id", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "text_hash"]
    body = rows.select("conv_id", "turn", "role", F.md5("text").alias("text_hash"), F.lit(None).cast("string").alias("audit"), "text", "copies")
    head = found.select("conv_id", "audit")
    stream = body.unionByName(head, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(*order)
    arrow = rows.sparkSession.createDataFrame([], schema).toArrow().schema
    return stream.select("conv_id", "audit", "role", "text", "copies").mapInArrow(_applied(arrow), schema)


def digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's newline-joined ``role:text``, from turns in the order of ``repaired_turns``."""
    schema = f"conv_id {dict(turns.dtypes)['conv_id']}, repaired_sha256 string"
    arrow = turns.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, conv_id = None, None
        for batch in batches:
            ids, out = [], []
            for conv, position, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")]):
                if position == 0:
                    if digest is not None:
                        ids.append(conv_id)
                        out.append(digest.hexdigest())
                    digest, conv_id = hashlib.sha256(), conv
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, arrow[0].type), pa.array(out)], schema=arrow)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv_id], arrow[0].type), pa.array([digest.hexdigest()])], schema=arrow)

    return turns.mapInArrow(run, schema)


def report(conversations: DataFrame) -> DataFrame:
    """Damage, repair and digest of every conversation; one without rows after the damage has zeros, no audit and the empty text's digest."""
    rows = damaged(conversations)
    found = kept(audits(rows), "audits")
    digest = digests(repaired_turns(rows, found))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = conversations.groupBy("conv_id").agg(F.lit(1).alias("_one")).drop("_one")
    left = every.alias("c").join(found.alias("f"), F.expr("c.conv_id <=> f.conv_id"), "left").join(digest.alias("d"), F.expr("c.conv_id <=> d.conv_id"), "left")
    return left.select(
        "c.conv_id", *[F.coalesce(f"f.{c}", F.lit(0).cast("long")).alias(c) for c in names], F.coalesce("f.audit", F.lit("")).alias("audit"),
        F.coalesce("d.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
