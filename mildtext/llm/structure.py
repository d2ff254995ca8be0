"""Repair of conversations: the cheapest edits that make a well-formed sequence of turns.

The roles of a repaired conversation, by their initials, are ``(s?(ua)+)?``.  That is an automaton
of four states, and a row acts on it as one of nine symbols: it must go, or it is of one of four
roles and truncated or not.  What it costs from each state to finish the rows from some place on
is a vector of four numbers; less its minimum it is one of a few dozen *normalised* vectors.

1. For every normalised vector and every block of four symbols, the vector before the block and
   what the minimum grew by are worked out once (Four Russians): a conversation is read from its end,
   one look-up per block.
2. The edits are traced from the start.  A block is expanded backward from the vector behind it, so at
   every row the least letter among the cheapest edits is known to be one that can be finished.
3. On Spark, rows lie in order over all tasks and are packed into pieces.  A conversation that
   extends over several pieces gets, for each piece, what it costs from every state to every state: the
   vectors behind its pieces and the states before them follow from those few numbers.

So neither a very long conversation nor one of many equal rows comes together in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mildtext.session import materialize, shared

# States: nothing yet; after the system turn; a user turn is unanswered; all are answered.
START, SYSTEM, ASKED, ANSWERED = range(4)
# The state after a user or assistant turn, whichever may come.
NEXT = (ASKED, ASKED, ANSWERED, ASKED)
# Costs of the edits; letters are tried in this order, which is that of ASCII.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 3, 2, 0, 2, 1
# Roles by initial; the last stands for all others.
INITIALS = "sua"
GONE, SYMBOLS = 0, 9
NONE, BLANK, DUPLICATE, CUT = range(4)
BLOCK = 4
INFINITE = 1 << 20
Vector = tuple[int, int, int, int]
#: costs behind the last row, where turns may still be inserted
FINISHED: Vector = (0, 2 * INSERT, INSERT, 0)
SPACE = " \t\n\x0b\x0c\r"


def symbol(initial: str, fault: int) -> int:
    """What a row does: 0 if it must go, else its role and whether it is truncated."""
    if fault in (BLANK, DUPLICATE):
        return GONE
    return 1 + 2 * (INITIALS.find(initial) if initial else -1) % 8 + (fault == CUT)


def _kept(state: int, role: int) -> int | None:
    """The state after keeping a row of a role, or nothing where it may not stand."""
    if role == 0:
        return SYSTEM if state == START else None
    if role == 1:
        return ASKED if state != ASKED else None
    return ANSWERED if role == 2 and state == ASKED else None


def _before(after: Vector, code: int) -> Vector:
    """Costs before a row, from those behind it; turns may be inserted first."""
    costs = []
    role, cut = divmod(code - 1, 2)
    for state in range(4):
        best = after[state] + DELETE
        if code != GONE:
            kept = _kept(state, role)
            best = min(best, after[NEXT[state]] + REROLE + cut * TRUNCATED)
            if kept is not None:
                best = min(best, after[kept] + KEEP + cut * TRUNCATED)
        costs.append(min(best, INFINITE))
    for _ in range(3):
        costs = [min(costs[s], costs[NEXT[s]] + INSERT, INFINITE) for s in range(4)]
    return tuple(costs)


def _normal(costs: Vector) -> tuple[Vector, int]:
    least = min(costs)
    return tuple(c if c >= INFINITE else c - least for c in costs), least


#: costs to end a piece in one state
ENDS = tuple(tuple(0 if s == end else INFINITE for s in range(4)) for end in range(4))


class Tables:
    """All normalised vectors, and what each block of symbols makes of them."""

    def __init__(self) -> None:
        self.vectors: list[Vector] = [FINISHED, *ENDS]
        self.number = {v: n for n, v in enumerate(self.vectors)}
        rows = []
        for vector in self.vectors:  # grows on the way
            row = []
            for code in range(SYMBOLS):
                found, more = _normal(_before(vector, code))
                if found not in self.number:
                    self.number[found] = len(self.vectors)
                    self.vectors.append(found)
                row.append((self.number[found], more))
            rows.append(row)
        one = np.array(rows)
        #: by length, vector behind and code of a block: the vector before it, and the growth
        self.vector, self.growth = [None, one[:, :, 0]], [None, one[:, :, 1]]
        for _ in range(BLOCK - 1):
            # the rest of a block first, then the symbol before it, its most significant digit
            rest, grown = self.vector[-1], self.growth[-1]
            self.vector.append(one[rest, :, 0].transpose(0, 2, 1).reshape(len(one), -1))
            self.growth.append((grown[:, :, None] + one[rest, :, 1]).transpose(0, 2, 1).reshape(len(one), -1))


@cache
def tables() -> Tables:
    return Tables()


def _blocks(symbols: bytes) -> list[tuple[int, int]]:
    """(length, code) of blocks; the first may be short."""
    short = len(symbols) % BLOCK
    codes = []
    if short:
        codes.append((short, int("".join(map(str, symbols[:short])), SYMBOLS)))
    if len(symbols) > short:
        rest = np.frombuffer(symbols, np.uint8)[short:].reshape(-1, BLOCK)
        codes += [(BLOCK, c) for c in (rest @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)).tolist()]
    return codes


def costs(symbols: bytes, behind: Vector = FINISHED) -> Vector:
    """Costs from each state before the rows, by those behind them."""
    t = tables()
    first, total = _normal(behind)
    at = t.number[first]
    for length, code in reversed(_blocks(symbols)):
        total += int(t.growth[length][at, code])
        at = int(t.vector[length][at, code])
    return tuple(c if c >= INFINITE else c + total for c in t.vectors[at])


@lru_cache(1 << 16)
def _expanded(length: int, code: int, behind: int, state: int) -> tuple[tuple[str, ...], int]:
    """Letters at each row of a block (insertions, then its own), and the state behind."""
    codes = [code // SYMBOLS**k % SYMBOLS for k in range(length - 1, -1, -1)]
    known = [tables().vectors[behind]]
    for c in reversed(codes):
        known.append(_before(known[-1], c))
    known.reverse()
    out = []
    for k, c in enumerate(codes):
        here, after, letters = known[k], known[k + 1], ""
        role, cut = divmod(c - 1, 2)
        while not letters.endswith(("D", "K", "R")):
            kept = None if c == GONE else _kept(state, role)
            if here[state] == after[state] + DELETE:
                letters += "D"
            elif here[state] == here[NEXT[state]] + INSERT:
                letters, state = letters + "I", NEXT[state]
            elif kept is not None and here[state] == after[kept] + KEEP + cut * TRUNCATED:
                letters, state = letters + "K", kept
            else:
                letters, state = letters + "R", NEXT[state]
        out.append(letters)
    return tuple(out), state


def trace(symbols: bytes, behind: Vector = FINISHED, state: int = START) -> tuple[list[str], int]:
    """Letters of the cheapest edits at each row, ASCII-least, and the state behind the rows.

    Behind the last row of a conversation, :data:`REST` has the letters that are left.
    """
    t = tables()
    blocks = _blocks(symbols)
    at = t.number[_normal(behind)[0]]
    vectors = [at]
    for length, code in reversed(blocks):
        at = int(t.vector[length][at, code])
        vectors.append(at)
    out: list[str] = []
    for (length, code), vector in zip(blocks, reversed(vectors[:-1])):
        letters, state = _expanded(length, code, vector, state)
        out += letters
    return out, state


#: letters behind the last row, by state
REST = ("", "II", "I", "")


# --- on Spark

def _string(column: str | Column) -> Column:
    return F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit(" "))


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _described(turns: DataFrame) -> DataFrame:
    """Rows with ``key``, the same for equal rows, and ``said``, for equal role and text of a conversation."""
    rows = turns.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), _string("role").alias("role"), _string("text").alias("text")
    )
    colon, says = F.lit(":"), [F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")]
    end = F.rtrim("text", F.lit(SPACE))
    return rows.select(
        "*",
        _sha(_string("conv_id"), colon, _string("turn"), colon, *says).alias("key"),
        _sha(_string("conv_id"), colon, *says).alias("said"),
        F.when(end == "", BLANK).when(F.substring(end, -1, 1).isin(*".!?"), NONE).otherwise(CUT).alias("fault"),
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4_096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("key", pa.binary()), ("n", pa.int64()), ("fault", pa.int32())])
_PIECE = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("edge", pa.bool_()), ("symbols", pa.binary()), ("rows", pa.list_(_ROW))])
PIECE = "conv_id bigint, at bigint, edge boolean, symbols binary, rows array<struct<turn:bigint,role:string,key:binary,n:bigint,fault:int>>"


def _pieces(turns: DataFrame, most: int) -> DataFrame:
    """Distinct rows in order, up to ``most`` of one conversation together.

    ``at`` numbers the first row of a piece, ascending within a conversation; ``edge``: the
    conversation may have more pieces.
    """
    described = _described(turns)
    same = ["key", "conv_id", "turn", "role", "said", "fault"]
    rows = materialize(described.groupBy(*same).agg(F.count(F.lit(1)).alias("n")))
    # null turns come first, as they do in the order
    turn = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    again = rows.filter(F.col("fault") != BLANK).groupBy("said").agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("times"))
    again = shared(again.filter("times > 1").drop("times"))
    seen = (F.col("fault") != BLANK) & F.coalesce(turn > F.col("first"), F.lit(False))
    order = ["conv_id", "turn", "role", "key"]
    ready = (
        rows.join(again, "said", "left")
        .select(*order, "n", F.when(seen, DUPLICATE).otherwise(F.col("fault")).alias("fault"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at = TaskContext.get().partitionId() << 40
        held: tuple | None = None  # a piece waits until it is known whether it is the last
        first = True
        for conv, group in groupby(_rows(batches), lambda r: r[0]):
            symbols, rows, cut = bytearray(), [], False
            if held:
                yield held
            held = None
            for _, turn, role, key, n, fault in group:
                if len(rows) == most:
                    yield conv, at, True, bytes(symbols), rows
                    at, symbols, rows, cut = at + len(rows), bytearray(), [], True
                symbols.append(symbol(role[:1], fault))
                rows.append({"turn": turn, "role": role, "key": key, "n": n, "fault": fault})
            held = conv, at, first or cut, bytes(symbols), rows
            at, first = at + len(rows), False
        if held:
            yield held[0], held[1], True, *held[3:]

    return materialize(ready.mapInArrow(lambda batches: _batches(pack(batches), _PIECE, 256), PIECE))


_COSTS = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("costs", pa.list_(pa.int32()))])
_BEHIND = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("behind", pa.list_(pa.int32())), ("last", pa.bool_())])
_EXITS = pa.schema([*_BEHIND, pa.field("exits", pa.list_(pa.int32()))])
_CHAINED = pa.schema([("at", pa.int64()), ("behind", pa.list_(pa.int32())), ("last", pa.bool_()), ("state", pa.int32())])


def _chained(pieces: DataFrame) -> DataFrame:
    """For pieces of conversations that may have several: costs behind, and the state before."""
    edges = pieces.filter("edge").select("conv_id", "at", "symbols")

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, at, symbols in _rows(batches):
            yield conv, at, [c for end in ENDS for c in costs(symbols, end)]

    def backward(table: pa.Table) -> pa.Table:
        behind, out = FINISHED, []
        rows = sorted(table.to_pylist(), key=lambda r: r["at"], reverse=True)
        for n, row in enumerate(rows):
            out.append((row["conv_id"], row["at"], list(behind), n == 0))
            by_end = [row["costs"][4 * end : 4 * end + 4] for end in range(4)]
            behind = _normal(tuple(min(by_end[end][s] + behind[end] for end in range(4)) for s in range(4)))[0]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _BEHIND)], schema=_BEHIND)

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, at, symbols, behind, last in _rows(batches):
            yield conv, at, behind, last, [trace(symbols, tuple(behind), s)[1] for s in range(4)]

    def forward(table: pa.Table) -> pa.Table:
        state, out = START, []
        for row in sorted(table.to_pylist(), key=lambda r: r["at"]):
            out.append((row["at"], row["behind"], row["last"], state))
            state = row["exits"][state]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _CHAINED)], schema=_CHAINED)

    found = edges.mapInArrow(lambda batches: _batches(between(batches), _COSTS), "conv_id bigint, at bigint, costs array<int>")
    found = found.groupBy("conv_id").applyInArrow(lambda t: backward(t), "conv_id bigint, at bigint, behind array<int>, last boolean")
    met = edges.join(shared(found.drop("conv_id")), "at").select("conv_id", "at", "symbols", "behind", "last")
    exits = met.mapInArrow(
        lambda batches: _batches(through(batches), _EXITS), "conv_id bigint, at bigint, behind array<int>, last boolean, exits array<int>"
    )
    return exits.groupBy("conv_id").applyInArrow(lambda t: forward(t), "at bigint, behind array<int>, last boolean, state int")


_EDIT = pa.schema([
    ("conv_id", pa.int64()), ("place", pa.int64()), ("step", pa.int32()), ("edit", pa.string()), ("times", pa.int64()), ("fault", pa.int32()),
    ("turn", pa.int64()), ("role_before", pa.string()), ("role", pa.string()), ("key", pa.binary()),
])
EDIT = ("conv_id bigint, place bigint, step int, edit string, times bigint, fault int, turn bigint, role_before string, "
        "role string, key binary")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """A row per edit, out of pieces with what is behind and before them."""
    for conv, at, symbols, rows, behind, last, state in _rows(batches):
        whole = behind is None
        state = START if whole else state
        letters, _ = trace(symbols, FINISHED if whole else tuple(behind), state)
        for n, (said, row) in enumerate(zip(letters, rows)):
            turn, role, fault = row["turn"], row["role"], row["fault"]
            for step, letter in enumerate(said):
                if letter == "I":
                    state = NEXT[state]
                    yield conv, at + n, step, "I", 1, NONE, None, None, ("user" if state == ASKED else "assistant"), None
                elif letter == "D":
                    yield conv, at + n, step, "D", 1, fault, turn, role, None, None
                else:
                    state = NEXT[state] if letter == "R" else _kept(state, INITIALS.find(role[0]))
                    name = role if letter == "K" else "user" if state == ASKED else "assistant"
                    yield conv, at + n, step, letter, 1, fault, turn, role, name, row["key"]
            if row["n"] > 1:  # all copies but the first go, one behind the other
                yield conv, at + n, len(said), "D", row["n"] - 1, BLANK if fault == BLANK else DUPLICATE, turn, role, None, None
        if whole or last:
            for step, _ in enumerate(REST[state], len(letters[-1]) + 1):
                state = NEXT[state]
                yield conv, at + len(rows) - 1, step, "I", 1, NONE, None, None, ("user" if state == ASKED else "assistant"), None


def repair(turns: DataFrame, most: int = 65_536) -> DataFrame:
    """The cheapest edits that make conversations well-formed, a row per edit.

    ``conv_id``; ``place`` and ``step``, by which the edits of a conversation go; ``edit`` (K keep, R
    give another role, D delete, I insert) and ``times``; ``fault`` of the row (0 none, 1 blank, 2
    duplicate, 3 truncated); its ``turn`` and ``role_before`` (null for insertions); ``role`` and
    ``text`` of the repaired turn (null for deletions).

    Rows go by ``turn``, nulls first, then role, then a digest: repeated rows and ties have an order,
    and of ties in cost the ASCII-least letters are taken.  A null role or text is one space, rows of
    a null ``conv_id`` are one conversation.  An empty role begins with no letter and cannot be kept.
    Texts may be empty or of any length; other columns are ignored; an empty table gives no rows.

    At most ``most`` distinct rows of a conversation are in one piece.
    """
    pieces = _pieces(turns, most)
    chained = shared(_chained(pieces))
    ready = pieces.join(chained, "at", "left").select("conv_id", "at", "symbols", "rows", "behind", "last", "state")
    edits = ready.mapInArrow(lambda batches: _batches(_edited(batches), _EDIT), EDIT)
    # equal rows combine in their tasks, so there is one text per key on either side
    texts = _described(turns).select("key", "text").groupBy("key").agg(F.max("text").alias("text"))
    # edits without a text meet none, and are spread by a key of their own
    own = F.concat_ws(":", "place", "step").cast("binary")
    met = edits.withColumn("key", F.coalesce("key", own)).join(texts.hint("merge"), "key", "left")
    text = F.when(F.col("edit") == "I", F.lit("")).when(F.col("edit") != "D", F.col("text"))
    return met.select(*[f.name for f in _EDIT if f.name != "key"], text.alias("text"))


def digests(edits: DataFrame, conversations: DataFrame) -> DataFrame:
    """Per conversation, out of the rows of :func:`repair`: faults, cost, letters and a digest.

    ``conversations`` lists in ``conv_id`` those to report, also where no row is left.  A
    conversation streams out of a sort in the order of its edits; only its letters are held.
    """
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    schema = pa.schema(list(zip(names, kinds)))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, rows in groupby(_rows(batches), lambda r: r[0]):
            faults, cost, illegal, letters = [0] * 4, 0, 0, []
            turns, least, latest, before = 0, None, None, None
            said, written = hashlib.sha256(), False
            for _, place, _, edit, times, fault, turn, role_before, role, text in rows:
                if place < 0:
                    continue
                letters.append(edit * times)
                cost += times * {"D": DELETE, "I": INSERT, "K": KEEP, "R": REROLE}[edit]
                if edit != "I":
                    faults[fault] += times
                    cost += TRUNCATED if fault == CUT and edit != "D" else 0
                    initial = role_before[:1]
                    illegal += before is not None and before + initial not in ("su", "ua", "au")
                    illegal += (times - 1) * (initial + initial not in ("su", "ua", "au"))
                    before = initial
                    if turn is not None and turn != latest:
                        least = turn if least is None else least
                        turns, latest = turns + 1, turn
                if edit != "D":
                    said.update(f"{chr(10) * written}{role}:{text}".encode())
                    written = True
            gaps = 0 if least is None else latest - least + 1 - turns
            yield conv, gaps, *faults[BLANK:], illegal, cost, "".join(letters), said.hexdigest()

    listed = conversations.select(F.col("conv_id").cast("bigint")).distinct().withColumn("place", F.lit(-1).cast("bigint"))
    ordered = (
        edits.unionByName(listed, allowMissingColumns=True)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "place", "step")
    )
    ddl = ", ".join(f"{n} {'bigint' if k == pa.int64() else 'string'}" for n, k in zip(names, kinds))
    return ordered.mapInArrow(lambda batches: _batches(digest(batches), schema, 256), ddl)


def damage(turns: DataFrame) -> DataFrame:
    """Conversations with faults put in by the CRC-32 of ``conv_id:turn``, modulo 20.

    0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes its role
    ``user``.  Nulls count as one space; ``turn`` and ``conv_id`` themselves stay null.
    """
    kind = F.crc32(F.concat(_string("conv_id"), F.lit(":"), _string("turn")).cast("binary")) % 20
    text = _string("text")
    rows = turns.select("conv_id", "turn", _string("role").alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
