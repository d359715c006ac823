from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import cache
from itertools import product

import pytest

from tallywright.llm import queries, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SF_DIR = "/root/testdata/sf0.01"
BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        yield conv, [(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        left = text.strip(BLANKS)
        out.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Cheapest edits from the end backwards, with whole strings: cost, initials."""

    @cache
    def best(at, state, inserted):
        ways = [(0, "")] if at == len(rows) and state in "0a" else []
        if inserted < 3:  # more in a row never pay
            new = {"0": "u", "s": "u", "a": "u", "u": "a"}[state]
            ways.append(plus(2, "I", best(at, new, inserted + 1)))
        if at < len(rows):
            role, fault = rows[at][1], found[at]
            ways.append(plus(3, "D", best(at + 1, state, 0)))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] + state in ("s0", "u0", "us", "ua", "au"):
                    ways.append(plus(more, "K", best(at + 1, role[0], 0)))
                ways.append(plus(2 + more, "R", best(at + 1, {"0": "u", "s": "u", "a": "u", "u": "a"}[state], 0)))
        return min(ways, default=(10**9, ""))

    def plus(cost, letter, rest):
        return rest[0] + cost, letter + rest[1]

    return best(0, "0", 0)


def replayed(rows, audit):
    at, state, out = 0, "0", []
    for letter in audit:
        new = {"0": "user", "s": "user", "a": "user", "u": "assistant"}[state]
        if letter == "I":
            out.append(new + ":")
        else:
            _, role, text = rows[at]
            at += 1
            if letter == "D":
                continue
            new = role if letter == "K" else new
            out.append(f"{new}:{text}")
        state = new[0]
    assert at == len(rows)
    assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in out))
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def expected(rows, damage=True):
    conversations = defaultdict(list)
    for conv, own in damaged(rows) if damage else ((r[0], [(r[1], *(" " if x is None else x for x in r[2:]))]) for r in rows):
        conversations[conv] += own
    out = []
    for conv, own in conversations.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        found = faults(own)
        cost, audit = cheapest(own, tuple(found))
        turns = {r[0] for r in own} - {None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *map(found.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, replayed(own, audit)))
    return sorted(map(repr, out))


def got(frame):
    return sorted(repr(tuple(row)) for row in frame.collect())


def some(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No?", "cut off", "  ", "", "Well!\n", None, "a b", "é…"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    return [
        (None if c == 3 else c, rng.choice([t, t, t, None, t + 2]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"t{rng.random()}.")
        for c in range(conversations)
        for t in range(rng.randint(1, longest))
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    rows = some(seed, 60, 12)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(repair.audits(repair.repair(frame))) == expected(rows, damage=False)
    hurt = repair.damage(frame)
    assert got(repair.audits(repair.repair(hurt, dropped=hurt["dropped"]))) == expected(rows)


def test_smallest_by_all_edits():
    """Every string of edits of up to five letters, for every short conversation."""
    roles = ["user", "assistant", "system", "tool"]
    for n in range(4):
        for chosen in product(roles, repeat=n):
            for cut in product([False, True], repeat=n):
                rows = [(t, role, f"x{t}" + ("" if c else ".")) for t, (role, c) in enumerate(zip(chosen, cut))]
                ways = []
                for length in range(n + 3):
                    for audit in product("DIKR", repeat=length):
                        if sum(letter != "I" for letter in audit) == n and (cost := priced(rows, cut, audit)) is not None:
                            ways.append((cost, "".join(audit)))
                work = repair.Repair()
                edits = [e for r in rows for e in work.feed(*r, False)] + list(work.close())
                assert (work.cost, "".join(letter for letter, *_ in edits)) == min(ways)


def priced(rows, cut, audit):
    """Cost of these edits, or None if the roles do not come out right either way of giving them."""
    total, at, states = 0, 0, {""}
    for letter in audit:
        if letter == "I":
            total += 2
            states = {s + x for s in states for x in "ua"}
            continue
        total += 3 if letter == "D" else 2 * (letter == "R") + cut[at]
        if letter == "K":
            states = {s + rows[at][1][0] for s in states}
        elif letter == "R":
            states = {s + x for s in states for x in "ua"}
        at += 1
    return total if any(re.fullmatch("(s?(ua)+)?", s) for s in states) else None


@pytest.mark.parametrize("hashing", [{}, {"base": 1, "modulus": 3}, {"base": 1, "modulus": 1}])
def test_long_conversations_settle_and_collisions_are_found(hashing):
    """Hashes that nearly always, or always, agree change nothing; few edits wait."""
    rng = random.Random(4)
    rows = [
        (t, rng.choice(["user", "assistant", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", f"{t}."]))
        for t in range(400)
    ]
    found = faults(rows)
    work = repair.Repair(settle_nodes=40, **hashing)
    edits, most = [], 0
    for row, fault in zip(rows, found):
        edits += work.feed(*row, fault == "duplicate")
        most = max(most, len(work.audits))
    edits += work.close()
    sys.setrecursionlimit(20_000)
    assert (work.cost, "".join(letter for letter, *_ in edits)) == cheapest(rows, tuple(found))
    assert most < 300
    assert [e[1:] for e in edits if e[0] == "D"] == [r[1:] for r, e in zip(rows, (e for e in edits if e[0] != "I")) if e[0] == "D"]


def test_repeated_rows_and_one_large_conversation(spark):
    rows = [(9, 0, "user", "Hello.")] * 400 + [(9, t, ["user", "assistant"][t % 2], f"n {t}.") for t in range(1, 400)]
    rows += [(c, t, "user", "Hello.") for c in range(20, 40) for t in range(3)]
    frame = spark.createDataFrame(rows, SCHEMA)
    by_id = {row["conv_id"]: row for row in repair.audits(repair.repair(frame)).collect()}
    assert len(by_id) == 21
    assert (by_id[9]["duplicate"], by_id[9]["gaps"], by_id[9]["audit"].count("D")) == (399, 0, 399)
    # The first greeting stays and is answered, after the repeats are gone: D comes before I.
    assert {(row["audit"], row["cost"]) for c, row in by_id.items() if c >= 20} == {("KDDI", 8)}


def test_empty_and_clashing_names(spark):
    assert repair.audits(repair.repair(spark.createDataFrame([], SCHEMA))).count() == 0
    frame = spark.createDataFrame(
        [(1, 0, "user", "Hi.", 1, True, "x", 5), (1, 1, "assistant", "Ho.", 2, True, "y", 5)],
        SCHEMA + ", hit int, repeated boolean, edit string, at int",
    )
    assert [row["audit"] for row in repair.audits(repair.repair(frame)).collect()] == ["KK"]
    assert repair.damage(frame).columns == ["conv_id", "turn", "role", "text", "dropped"]


def test_real_outputs(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Ho."), (1, 2, "user", "")]
    *edits, last = (tuple(r) for r in repair.repair(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [e[1:5] for e in edits] == [(0, "R", "user", "Hi."), (1, "K", "assistant", "Ho."), (2, "D", "user", "")]
    assert last[1:5] == (None,) * 4


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_audit_repair(spark, SF_DIR)) == expected(rows)
