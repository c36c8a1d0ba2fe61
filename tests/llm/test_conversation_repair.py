"""Repair of conversations, against an exhaustive search and a plain reading of the rules."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkward.llm import conversation_repair

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, place int, audit string"


def damage(rows):
    """(conv_id, turn, role, text) with faults, and all conv_ids."""
    out = []
    for conv, turn, role, text in rows:
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out += [(conv, turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return out


def faults(turns):
    seen, found = set(), []
    for _, role, text in turns:
        body = text.rstrip(SPACE)
        found.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return found


def exhaustive(turns):
    """The least (cost, audit) by taking paths in order of cost and audit, and the repaired turns. Nothing is bounded or dominated but whole equal nodes."""
    found = faults(turns)
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        initials = "".join(r[0] if r else " " for r, _ in roles)
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, roles
        if not re.fullmatch("s?(ua)*u?", initials):
            continue
        if (key := (i, initials[:1] == "s" and len(initials) == 1, len(initials) and initials[-1])) in done:
            continue
        done.add(key)
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, (*roles, (role, ""))))
        if i < len(turns):
            _, role, text = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles))
            if found[i] not in ("blank", "duplicate"):
                mend = 3 * (found[i] == "truncated")
                heapq.heappush(heap, (cost + mend, audit + "K", i + 1, (*roles, (role, text))))
                for other in ("user", "assistant"):
                    heapq.heappush(heap, (cost + mend + 3, audit + "R", i + 1, (*roles, (other, text))))
    raise AssertionError


def expected(rows):
    by_conv = defaultdict(list)
    for conv, *turn in damage(rows):
        by_conv[conv].append(tuple(turn))
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(by_conv[conv], key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        numbers = {t[0] for t in turns} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        found, initials = faults(turns), [t[1][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, roles = exhaustive(turns)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in roles).encode()).hexdigest()
        out[conv] = (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def report(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = conversation_repair.repair_report(conversation_repair.damaged(frame)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def made(seed, conversations):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "And then", "Why?", "", " \n", None, "Dots. inside", "é?", "end. \t", "\x85", "a "]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None, 0]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    return rows


def test_search_against_exhaustive():
    rng = random.Random(8)
    for _ in range(400):
        turns = [(i, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["", "x", "y.", f"{rng.random()}.", f"{rng.random()}"])) for i in range(rng.randrange(8))]
        codes = bytes(
            {"s": 0, "u": 1, "a": 2}.get(t[1][0], 3) | {"truncated": 4, None: 0}.get(f, 8) for t, f in zip(turns, faults(turns))
        )
        cost, audit, _ = exhaustive(turns)
        assert conversation_repair.cheapest_repair(codes) == (cost, audit)
        assert conversation_repair.suffix_bounds(codes)[0][0] <= cost


def test_search_with_loose_bounds(monkeypatch):
    """Without bounds the incumbent and the tables have to do it."""
    rng = random.Random(9)
    codes = [bytes(rng.choice([0, 1, 2, 3, 5, 6, 9]) for _ in range(rng.randrange(9))) for _ in range(150)]
    tight = [conversation_repair.cheapest_repair(c) for c in codes]
    monkeypatch.setattr(conversation_repair, "suffix_bounds", lambda t: [[0] * (len(t) + 1)] * 4)
    assert [conversation_repair.cheapest_repair(c) for c in codes] == tight


def test_long_conversation_takes_linear_time():
    rng = random.Random(10)
    codes = bytes(rng.choice([0, 1, 2, 3, 5, 6, 9]) for _ in range(60_000))
    cost, audit = conversation_repair.cheapest_repair(codes)
    assert cost == conversation_repair.suffix_bounds(codes)[0][0] and sum(c != "I" for c in audit) == len(codes)


@pytest.mark.parametrize("seed", [1, 2])
def test_report(spark, seed):
    rows = made(seed, 150)
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (None, None, None, None)]
    assert report(spark, rows) == expected(rows)


def test_empty_and_gone(spark):
    assert report(spark, []) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi.")]
    assert report(spark, rows) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "More?"), (1, 1, "user", "More?"), (1, 2, "tool", "Done."), (2, 0, "assistant", "")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = conversation_repair.repair_conversations(frame).orderBy("conv_id", "place").collect()
    by_conv = defaultdict(list)
    for r in got:
        by_conv[r.conv_id].append(r)
    for conv, turns in by_conv.items():
        own = [r[1:] for r in sorted(r for r in rows if r[0] == conv)]
        _, audit, roles = exhaustive(own)
        assert "".join(r.edit for r in turns) == audit and [(r.role, r.text) for r in turns if r.edit != "D"] == list(roles)


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert report(spark, rows) == expected(rows)
    assert conversation_repair.judge_conversations(table.limit(0)).count() == 0
    assert table.filter(F.col("conv_id").isNull()).count() == 0
