"""Cheapest repair of the structure of conversations, by depth-first branch and bound."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CRC32_TABLE_SQL, Rows, crc32_sql

#: What counts as space, and what ends a sentence.
SPACE, STOPS = " \t\n\x0b\x0c\r", ".!?"
#: Costs of edits. A truncated turn that stays costs MEND more; Keep costs nothing else.
INSERT, REROLE, DELETE, MEND = 3, 3, 4, 3
#: States of a repaired conversation by the initial of its last turn: none yet, s, u, a.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn of user or assistant that is inserted or gets its role by the repair, and those roles.
NEXT, ROLES = (USER, USER, ASSISTANT, USER), {USER: "user", ASSISTANT: "assistant"}
#: The state after a turn that is kept, by its initial and the state before; states that aren't there can't keep it.
KEPT = ({EMPTY: SYSTEM}, {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
INITIALS = {"s": 0, "u": 1, "a": 2}
#: A turn in one byte: initial, and these flags.
TRUNCATED, DOOMED = 4, 8
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
FAR = 1 << 40


def suffix_bounds(turns: bytes) -> list[array]:
    """For each state, the least that the turns from each place on can cost. Found backwards; it says nothing about ties."""
    n = len(turns)
    bounds = [array("q", bytes(8 * (n + 1))) for _ in range(4)]
    bounds[USER][n], bounds[SYSTEM][n] = INSERT, 2 * INSERT
    for i in range(n - 1, -1, -1):
        turn, here = turns[i], []
        mend = MEND if turn & TRUNCATED else 0
        for state in range(4):
            least = DELETE + bounds[state][i + 1]
            if not turn & DOOMED:
                least = min(least, REROLE + mend + bounds[NEXT[state]][i + 1])
                kept = KEPT[turn & 3].get(state)
                if kept is not None:
                    least = min(least, mend + bounds[kept][i + 1])
            here.append(least)
        user, assistant = min(here[USER], INSERT + here[ASSISTANT]), min(here[ASSISTANT], INSERT + here[USER])
        bounds[USER][i], bounds[ASSISTANT][i] = user, assistant
        bounds[EMPTY][i], bounds[SYSTEM][i] = min(here[EMPTY], INSERT + user), min(here[SYSTEM], INSERT + user)
    return bounds


class Step(NamedTuple):
    """The last edit of a path, and the path before."""

    before: Step | None
    letter: str
    depth: int


def spelled(path: Step | None) -> list[Step]:
    """The steps of a path in order."""
    steps = []
    while path:
        steps.append(path)
        path = path.before
    return steps[::-1]


def letters(path: Step | None) -> str:
    return "".join(s.letter for s in spelled(path))


def is_later(path: Step | None, incumbent: list[Step]) -> bool:
    """Whether audits that begin with this path come after the incumbent's. Looks back only to where the two part."""
    parted = None
    while path and (path.depth > len(incumbent) or incumbent[path.depth - 1] is not path):
        parted, path = path, path.before
    return parted is not None and (parted.depth > len(incumbent) or parted.letter > incumbent[parted.depth - 1].letter)


def cheapest_repair(turns: bytes) -> tuple[int, str]:
    """The least cost of a repair, and the ASCII-least audit of that cost.

    A node is a place in the conversation and the state of what is repaired so far. Branches wait on
    a stack, the one of the least bound and letter on top. A branch is cut if its cost with the
    suffix's bound can't beat the incumbent, or if a prefix that came to its node before is cheaper, or as
    cheap and less. (Of two prefixes of one node and cost neither begins with the other, since what
    follows would be insertions, which cost.) When the stack is empty, the incumbent is proved.
    """
    n, bounds = len(turns), suffix_bounds(turns)
    best, incumbent = FAR, []
    seen: dict[int, tuple[int, Step | None]] = {}
    stack: list[tuple[int, int, int, Step | None]] = [(0, EMPTY, 0, None)]
    while stack:
        i, state, cost, path = stack.pop()
        bound, node = cost + bounds[state][i], 4 * i + state
        if bound > best or bound == best and is_later(path, incumbent):
            continue
        if node in seen:
            least, way = seen[node]
            if least < cost or least == cost and letters(way) <= letters(path):
                continue
        seen[node] = cost, path
        if i == n and state in (EMPTY, ASSISTANT):
            best, incumbent = cost, spelled(path)
        branches = [(i, NEXT[state], cost + INSERT, "I")]
        if i < n:
            turn = turns[i]
            branches.append((i + 1, state, cost + DELETE, "D"))
            if not turn & DOOMED:
                mend = MEND if turn & TRUNCATED else 0
                kept = KEPT[turn & 3].get(state)
                if kept is not None:
                    branches.append((i + 1, kept, cost + mend, "K"))
                branches.append((i + 1, NEXT[state], cost + REROLE + mend, "R"))
        branches.sort(key=lambda b: (b[2] + bounds[b[1]][b[0]], b[3]), reverse=True)
        depth = path.depth + 1 if path else 1
        stack += [(j, s, c, Step(path, letter, depth)) for j, s, c, letter in branches if c + bounds[s][j] <= best]
    return best, "".join(s.letter for s in incumbent)


class Faults:
    """What one conversation's turns, given in order, have wrong, and their repair."""

    def __init__(self):
        self.counts, self.illegal, self.turns, self.last = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, bytearray(), None
        self.least = self.most = None
        self.distinct = 0

    def add(self, turn: int | None, initial: str, fault: str | None) -> None:
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if fault:
            self.counts[fault] += 1
        flags = TRUNCATED if fault == "truncated" else DOOMED if fault else 0
        self.turns.append(INITIALS.get(initial, 3) | flags)
        if turn is not None:
            self.distinct += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn

    def result(self) -> tuple:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.distinct
        return (gaps, *self.counts.values(), self.illegal, *cheapest_repair(bytes(self.turns)))


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation. The turns of a conversation follow one another; those that are gone only show that it was there."""
    out, at = None, None
    for batch in batches:
        schema = pa.schema([batch.schema.field("conv_id"), *((c.split()[0], pa.string() if "string" in c else pa.int64()) for c in RESULT.split(", "))])
        out = out or Rows(schema)
        for conv, turn, initial, fault, gone in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "initial", "fault", "gone")), strict=True):
            if at is None or conv != at[0]:
                if at:
                    out.add(at[0], *at[1].result(), size=len(at[1].turns))
                    if out.full:
                        yield out.take()
                at = conv, Faults()
            if not gone:
                at[1].add(turn, initial, fault)
    if at:
        out.add(at[0], *at[1].result())
        yield out.take()


def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each edit with its conversation's row before: (row of the conversation, place, edit, turn, role, text). A conversation without edits has one of nulls."""
    conversation, waiting, place, state = None, "", 0, EMPTY

    def inserted() -> Iterator[tuple]:
        nonlocal place, state
        while waiting[place : place + 1] == "I":
            state = NEXT[state]
            yield conversation, place, "I", None, ROLES[state], ""
            place += 1

    for batch in batches:
        for row in batch.to_pylist():
            if row["audit"] is not None:
                yield from inserted()
                conversation, waiting, place, state = row, row["audit"], 0, EMPTY
                if not waiting:
                    yield conversation, None, None, None, None, None
                continue
            yield from inserted()
            edit, role = waiting[place], row["role"]
            if edit == "R":
                state = NEXT[state]
                role = ROLES[state]
            elif edit == "K":
                state = KEPT[INITIALS[role[0]]][state]
            yield conversation, place, edit, row["turn"], role, row["text"]
            place += 1
    yield from inserted()


def with_faults(turns: DataFrame) -> DataFrame:
    """Turns without nulls in role and text, with the initial of the role and the first fault that counts, in order within partitions of whole conversations."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    first = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))
    dealt = turns.repartition("conv_id").withColumn("again", F.row_number().over(first) > 1)
    fault = F.when(trimmed == "", "blank").when(F.col("again"), "duplicate").when(~F.right(trimmed, F.lit(1)).isin(*STOPS), "truncated")
    return dealt.withColumns({"initial": F.substring("role", 1, 1), "fault": fault}).sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"
    )


def plain_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone, a mark of turns that are known to be lost; a null role or text is one space."""
    gone = F.coalesce("gone", F.lit(False)) if "gone" in turns.columns else F.lit(False)
    return turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone")
    )


def judge_conversations(turns: DataFrame) -> DataFrame:
    """A row for each conversation: its faults, and the cost and audit of its cheapest repair.

    turns has conv_id, turn, role and text; rows with gone (a boolean; the column may be missing) only
    keep their conversation in the result. Turns are taken by turn (null first), then role and text. The
    first fault of a turn counts: blank (no character but space), duplicate (role and text occurred
    before), truncated (its last character that isn't space doesn't end a sentence). gaps are the numbers
    missing between the least and the largest turn, illegal the neighbours whose initials aren't su, ua or au.

    Keep costs 0, Rerole (to user or assistant) 3, Delete 4 (the only edit for blank and duplicate turns), Insert (an
    empty turn of user or assistant) 3, and a truncated turn that stays 3 more. audit has the initials of the
    edits in order; the repaired roles begin with (s?(ua)+)?. Ties go to the ASCII-least audit.

    A null role or text is one space, null conv_ids are one conversation, repeated rows are duplicates, other columns
    are ignored, an empty table gives no rows, and a conversation whose turns are all gone zeros and an empty audit.

    One shuffle by conversation. A task holds some hundred bytes for each turn of one conversation, the bounds and
    branches, but no texts. The search takes time in proportion to the turns where bounds are tight, as they are here.
    """
    plain = plain_turns(turns)
    kind = plain.schema["conv_id"].dataType.simpleString()
    light = with_faults(plain).select("conv_id", F.col("turn").cast("long").alias("turn"), "initial", "fault", "gone")
    return light.mapInArrow(judged, f"conv_id {kind}, {RESULT}")


def streamed(turns: DataFrame) -> DataFrame:
    """Each conversation's judgement and then its turns, one after the other within a partition."""
    plain = plain_turns(turns)
    names = [c.split()[0] for c in RESULT.split(", ")]
    judgements = judge_conversations(turns).select("conv_id", *names, F.lit(None).cast("long").alias("turn"), *(F.lit(None).cast("string").alias(c) for c in ("role", "text")))
    rows = plain.filter("NOT gone").select(
        "conv_id", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in RESULT.split(", ")), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    return judgements.unionByName(rows).repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "text"
    )


def repair_conversations(turns: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (of the edit, from 0), edit (K, R, D or I), turn, role, text. Deleted turns are shown, as D.

    A conversation without any turn has one row of nulls. For the rest, see judge_conversations.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = None
        for batch in batches:
            first = batch.schema.field("conv_id")
            rows = Rows(pa.schema([first, ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
            rest = (b for part in ([batch], batches) for b in part)
            for conversation, *edit in edits(rest):
                rows.add(conversation["conv_id"], *edit, size=len(edit[-1] or ""))
                if rows.full:
                    yield rows.take()
        if rows:
            yield rows.take()

    return streamed(turns).mapInArrow(out, f"conv_id {kind}, place long, edit string, turn long, role string, text string")


def repair_report(turns: DataFrame) -> DataFrame:
    """judge_conversations with repaired_sha256, the digest of the repaired turns as role:text, joined by line breaks.

    The texts pass by in order, one at a time, and only the digest is held.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    names = [c.split()[0] for c in RESULT.split(", ")]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = now = digest = None
        for batch in batches:
            fields = [batch.schema.field("conv_id"), *((n, batch.schema.field(n).type) for n in names), ("repaired_sha256", pa.string())]
            rows = Rows(pa.schema(fields))
            for conversation, _, edit, _, role, text in edits(b for part in ([batch], batches) for b in part):
                if conversation is not now:
                    if now:
                        rows.add(now["conv_id"], *(now[n] for n in names), digest.hexdigest(), size=len(now["audit"]))
                        if rows.full:
                            yield rows.take()
                    now, digest, between = conversation, hashlib.sha256(), b""
                if edit and edit != "D":
                    digest.update(between + f"{role}:{text}".encode())
                    between = b"\n"
        if now:
            rows.add(now["conv_id"], *(now[n] for n in names), digest.hexdigest())
            yield rows.take()

    return streamed(turns).mapInArrow(out, f"conv_id {kind}, {RESULT}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with planted faults, by the crc32 of conv_id:turn modulo 20: 0 gone, 1 empty, 2 without stops, 3 twice, 4 of the role user. Nulls are one space."""
    lot = F.crc32(F.encode(F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn"))), "utf-8")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return turns.select(lot.alias("lot"), "conv_id", "turn", role.alias("role"), text.alias("text")).select(
        "conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("lot") <= 1, "").when(F.col("lot") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text")).alias("text"),
        (F.col("lot") == 0).alias("gone"), F.explode(F.when(F.col("lot") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


#: Moves of the repair in DuckDB's SQL: from a state, some insertions and an edit; what they cost and put before the turn. States: none, s, u, a.
MOVES_SQL = """(SELECT * FROM (VALUES ('', 0, '', ''), ('', 1, 'u', 'user:'), ('', 2, 'a', 'user:' || chr(10) || 'assistant:'), ('s', 0, 's', ''), ('s', 1, 'u', 'user:'),
  ('s', 2, 'a', 'user:' || chr(10) || 'assistant:'), ('u', 0, 'u', ''), ('u', 1, 'a', 'assistant:'), ('a', 0, 'a', ''), ('a', 1, 'u', 'user:')) AS t(state, k, now, put))"""
#: judge_conversations, repair_report and damaged over conversations, a turn at a time, keeping the best path to each state.
SQL = f"""
WITH RECURSIVE lots AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS lot FROM conversations, {CRC32_TABLE_SQL}),
hurt AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN lot = 3 THEN [1, 2] ELSE [1] END) AS copy FROM lots WHERE lot > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, left(role, 1) AS initial,
  rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body FROM hurt),
faulty AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
counts AS (SELECT conv_id, count(*) AS turns, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
paths AS (SELECT conv_id, 0::BIGINT AS i, '' AS state, 0 AS cost, '' AS audit, NULL::VARCHAR AS told FROM counts
  UNION ALL
  SELECT conv_id, i, state, cost, audit, told FROM (
    SELECT p.conv_id, f.i, edit.to_state AS state, p.cost + 3 * m.k + edit.price + CASE WHEN edit.letter <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost,
      p.audit || repeat('I', m.k) || edit.letter AS audit, concat_ws(chr(10), p.told, nullif(m.put, ''), CASE edit.letter WHEN 'K' THEN role || ':' || text
        WHEN 'R' THEN CASE edit.to_state WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text END) AS spoken,
      CASE WHEN p.told IS NULL AND m.put = '' AND edit.letter = 'D' THEN NULL ELSE spoken END AS told
    FROM paths p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN {MOVES_SQL} m ON m.state = p.state
    JOIN (VALUES ('', 'D', 4, ''), ('s', 'D', 4, 's'), ('u', 'D', 4, 'u'), ('a', 'D', 4, 'a'), ('', 'R', 3, 'u'), ('s', 'R', 3, 'u'), ('u', 'R', 3, 'a'), ('a', 'R', 3, 'u'),
      ('', 'K', 0, 's'), ('', 'K', 0, 'u'), ('s', 'K', 0, 'u'), ('a', 'K', 0, 'u'), ('u', 'K', 0, 'a')) AS edit(from_state, letter, price, to_state)
      ON edit.from_state = m.now AND (letter = 'D' OR coalesce(fault, '') NOT IN ('blank', 'duplicate')) AND (letter <> 'K' OR to_state = initial))
  QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
ends AS (SELECT p.conv_id, cost + 3 * k AS cost, audit || repeat('I', k) AS audit, concat_ws(chr(10), told, nullif(put, '')) AS told FROM paths p
  JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = turns JOIN {MOVES_SQL} m ON m.state = p.state
  WHERE m.now IN ('', 'a') QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY cost + 3 * k, audit || repeat('I', k)) = 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(told, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
"""
