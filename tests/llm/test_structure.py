import hashlib
import random
import re
import zlib

import pytest

from mildtext.llm import structure
from mildtext.llm.queries import op11_conversation_repair

ALLOWED = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def cheapest(rows):
    """Least (cost, letters) of rows (initial, fault), by all edits forward from the start."""
    def inserted(best):
        for _ in range(4):
            for state, (cost, letters) in list(best.items()):
                for turn in "ua":
                    if turn in ALLOWED[state]:
                        to = ALLOWED[state][turn]
                        best[to] = min(best.get(to, (1 << 30, "")), (cost + 2, letters + "I"))
        return best

    best = inserted({0: (0, "")})
    for initial, fault in rows:
        new = {}

        def put(state, *found):
            new[state] = min(new.get(state, (1 << 30, "")), found)

        for state, (cost, letters) in best.items():
            put(state, cost + 3, letters + "D")
            if fault not in (1, 2):
                cut = fault == 3
                if initial in ALLOWED[state]:
                    put(ALLOWED[state][initial], cost + cut, letters + "K")
                for turn in "ua":
                    if turn in ALLOWED[state]:
                        put(ALLOWED[state][turn], cost + 2 + cut, letters + "R")
        best = inserted(new)
    return min(best[s] for s in (0, 3) if s in best)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def repaired(rows):
    """What the contract says of the rows of one conversation."""
    def key(r):
        said = f"{' ' if r[0] is None else r[0]}:{' ' if r[1] is None else r[1]}:{len(r[2])}:{r[2]}{r[3]}"
        return (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(said.encode()).digest())

    rows = sorted(rows, key=key)
    seen, faults = set(), []
    for _, _, role, text in rows:
        end = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append(1 if not end else 2 if (role, text) in seen else 0 if end[0] in ".!?" else 3)
        seen.add((role, text))
    cost, audit = cheapest([(r[2][:1], f) for r, f in zip(rows, faults)]) if rows else (0, "")
    turns = {r[1] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    state, said, left = 0, [], list(rows)
    for letter in audit:
        row = left.pop(0) if letter != "I" else None
        if letter == "D":
            continue
        initial = row[2][0] if letter == "K" else next(t for t in "ua" if t in ALLOWED[state])
        state = ALLOWED[state][initial]
        said.append(f"{row[2] if letter == 'K' else {'u': 'user', 'a': 'assistant'}[initial]}:{row[3] if row else ''}")
    digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
    return (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, digest)


def expected(rows, convs):
    return {c: repaired([r for r in rows if r[0] == c]) for c in convs}


def told(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


SAYS = ["fine.", "fine.", "well!", "why? ", "cut off", "cut\n", "", " \t", None, "x. y", "é…", "."]
ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]


def conversations(pick, n):
    rows = []
    for conv in [*range(n), None]:
        for turn in range(pick.randint(1, 12)):
            role = pick.choice(ROLES) if pick.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, pick.choice([turn, turn, turn, turn + 3, None]), role, pick.choice(SAYS)))
    return rows


DDL = "conv_id long, turn long, role string, text string"


def test_blocks_are_those_of_brute_force():
    pick = random.Random(1)
    for _ in range(3000):
        rows = [(pick.choice("ssuuuaaax") if pick.random() < 0.95 else "", pick.choice([0, 0, 0, 1, 2, 3])) for _ in range(pick.randint(0, 11))]
        symbols = bytes(structure.symbol(i, f) for i, f in rows)
        letters, state = structure.trace(symbols)
        assert (structure.costs(symbols)[0], "".join(letters) + structure.REST[state]) == cheapest(rows)


def test_costs_between_states_add_up():
    pick = random.Random(2)
    for _ in range(300):
        left, right = (bytes(pick.choices(range(structure.SYMBOLS), k=pick.randint(1, 9))) for _ in range(2))
        behind = structure.costs(right)
        by_end = [structure.costs(left, end) for end in structure.ENDS]
        joined = tuple(min(by_end[e][s] + behind[e] for e in range(4)) for s in range(4))
        assert joined == structure.costs(left + right)


@pytest.mark.parametrize("most", [65_536, 3, 1])
def test_same_as_brute_force(spark, most):
    rows = conversations(random.Random(most), 150)
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], DDL + ", place long, edit string").repartition(5)
    got = told(structure.digests(structure.repair(df, most), df))
    kept = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got == expected(kept, {r[0] for r in rows})


def test_long_conversation_and_copies(spark):
    pick = random.Random(5)
    rows = [(1, t, pick.choice(["user", "assistant"]), f"{t} says.") for t in range(900)]
    rows += [(1, 40, "user", "once more.")] * 600 + [(2, None, "system", " ")] * 300 + [(3, 0, "user", "long. " * 100_000)]
    df = spark.createDataFrame(rows, DDL).repartition(9)
    assert told(structure.digests(structure.repair(df, 50), df)) == expected(rows, {1, 2, 3})


def test_rows_of_repair(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "hi."), (1, 1, "tool", "so"), (1, 2, "user", "")], DDL)
    rows = structure.repair(df).orderBy("place", "step").collect()
    got = [(r.edit, r.times, r.fault, r.turn, r.role_before, r.role, r.text) for r in rows]
    assert got == [
        ("D", 1, 0, 0, "assistant", None, None), ("D", 1, 3, 1, "tool", None, None), ("D", 1, 1, 2, "user", None, None),
    ] or got == [
        ("I", 1, 0, None, None, "user", ""), ("K", 1, 0, 0, "assistant", "assistant", "hi."),
        ("D", 1, 3, 1, "tool", None, None), ("D", 1, 1, 2, "user", None, None),
    ]


def test_empty_table(spark):
    df = spark.createDataFrame([], DDL)
    assert structure.repair(df).collect() == [] and structure.digests(structure.repair(df), df).collect() == []


def test_query(spark, tmp_path):
    rows = conversations(random.Random(8), 400) + [(1000 + c, 5, "user", "alone.") for c in range(60)]
    spark.createDataFrame(rows, DDL).write.parquet(f"{tmp_path}/conversations.parquet")
    want = expected(damaged(rows), {r[0] for r in rows})
    assert told(op11_conversation_repair(spark, str(tmp_path))) == want
    # some conversations lost all rows
    assert any(w[-2:] == ("", hashlib.sha256(b"").hexdigest()) and c and c >= 1000 for c, w in want.items())
