"""Removal of byte strings that occur earlier, by a distributed merge sort of suffixes.

Sorting every suffix of a corpus would move it many times over. Suffixes are therefore sorted at
anchors only: of the k-grams in each window of min_bytes, the one with the least hash. Equal windows
have the same anchor at the same place, so whatever repeats meets at an anchor. Each anchor owns the
windows that have it, and with them a region of the text.

1. Anchors whose k-gram occurs once are out (hashes are counted; a chance match does no harm).
2. The suffixes that start at the other anchors, up to the end of their region and followed by its
   part before the anchor in reverse, are sorted as runs, exchanged and merged. Equal ones are equal
   regions: all windows of all but the earliest repeat.
3. Different regions with the same k-gram lie side by side in that order. Their windows are compared
   with each other where a range of the order holds all of them; where they go beyond a range, their
   windows are sorted and merged in the same way.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rows, carried, carried_sql, numbered, release_process, texts, written
from .string_merge import BLOCK, LoserTree, choose_splitters, common_prefix, cut_at, decode_block, encode_block

#: Length of the strings that are removed, and of the k-grams that anchors are chosen by.
MIN_BYTES, GRAM = 100, 24
#: Bytes looked at together, and anchors or strings that make a run.
SLICE, RUN_ANCHORS, RUN_KEYS = 1 << 19, 250_000, 60_000
#: A range of the order holds about so many strings. Of more ranges than so many, splitters aren't broadcast: the order is cut in two steps.
RANGE_KEYS, MOST_SPLITTERS = 40_000, 4_000
#: Blocks offer one of so many of their strings as splitters, of which so many are taken for each range.
SAMPLE_STEP, SAMPLE_OF_RANGE = 250, 16
#: Odd multipliers of the hashes.
B1, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
U64 = np.uint64


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram bytes from each place on, by doubling."""
    with np.errstate(over="ignore"):
        power, length, out, done, factor = U64(B1), 1, None, 0, None
        h = (x.astype(U64) + U64(1)) * U64(MIX)
        left = gram
        while True:
            if left & 1:
                part = h[done:]
                if out is None:
                    out, factor = part, power
                else:
                    n = min(len(out), len(part))
                    out, factor = out[:n] * power + part[:n], factor * power
                done += length
            left >>= 1
            if not left:
                break
            h = h[:-length] * power + h[length:]
            power, length = power * power, length * 2
        out = out[: len(x) - gram + 1]
        out = (out ^ (out >> U64(29))) * U64(MIX)
        return out ^ (out >> U64(32))


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours."""
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (width - span)], v[width - span :]) if width > span else v


def anchors(data: bytes, starts: np.ndarray, ends: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """The anchors of the texts data[starts:ends]: text, first and last window start, anchor (all within the text), hash."""
    x = np.frombuffer(data, np.uint8)
    n = np.maximum(0, ends - starts - size + 1)
    if not n.sum():
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, U64),)
    hashes = gram_hashes(x, gram)
    least = sliding_least(hashes & U64(0xFFFFFFFF00000000) | np.arange(len(hashes), dtype=U64), size - gram + 1)
    text = np.repeat(np.arange(len(starts)), n)
    window = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    at = (least[window] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    base = starts[text[new]]
    return text[new], window[new] - base, window[last] - base, at[new] - base, hashes[at[new]]


def find_anchors(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """All anchors of docs (rid, text): key, rid, place, known.

    Of anchors with the same k-gram that a task finds in one go, the first has the k-gram's hash as
    its key and the others keys of their own, all marked as known to repeat; so the rows of a key
    are as many as tasks at most, however often a k-gram occurs. place holds the first window start, the
    distance to the last one and that to the anchor.
    """
    schema = pa.schema([("key", pa.int64()), ("rid", pa.int64()), ("place", pa.int64()), ("known", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_process()
        found: list[tuple[np.ndarray, ...]] = []
        rids, parts, held = [], [], 0

        def look() -> None:
            nonlocal rids, parts, held
            ends = np.cumsum([len(p) for p in parts])
            starts = ends - [len(p) for p in parts]
            text, first, last, at, key = anchors(b"".join(p for p in parts), starts, ends, size, gram)
            if len(text):
                shift = np.asarray([s for _, s in rids])[text]
                found.append((
                    key.view(np.int64), np.asarray([r for r, _ in rids], np.int64)[text],
                    first + shift << 16 | last - first << 8 | at - first
                ))
            rids, parts, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal found
            if not found:
                return
            key, rid, place = (np.concatenate(c) for c in zip(*found, strict=True))
            found = []
            _, index, inverse, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            known = (times > 1)[inverse]
            others = known.copy()
            others[index] = False
            with np.errstate(over="ignore"):
                own = (rid.view(U64) * U64(MIX) + place.view(U64)) * U64(B1)
            key[others] = (own ^ (own >> U64(31))).view(np.int64)[others]
            for i in range(0, len(key), 50_000):
                j = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(c[j]) for c in (key, rid, place, known)], schema=schema)

        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                for shift in range(0, max(1, len(text) - size + 1), SLICE):
                    part = text[shift : shift + SLICE + size - 1] if len(text) > SLICE else text
                    rids.append((rid, shift))
                    parts.append(part)
                    held += len(part)
                    if held >= SLICE:
                        look()
                        if sum(len(f[0]) for f in found) >= RUN_ANCHORS:
                            yield from flush()
        if parts:
            look()
        yield from flush()

    return docs.select("rid", "text").mapInArrow(run, "key long, rid long, place long, known boolean")


#: The two kinds of rows that sorting and merging give: windows that repeat, from one start to another, and sorted strings.
PARTS = pa.schema([
    ("rid", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("run", pa.int64()), ("sample", pa.list_(pa.binary())),
    ("n", pa.int32()), ("keys", pa.binary()), ("rids", pa.binary()), ("places", pa.binary())
])
PARTS_SQL = "rid long, low long, high long, run long, sample array<binary>, n int, keys binary, rids binary, places binary"


class RunBuilder:
    """Collects strings with their places into sorted, front-coded runs; gives out what repeats within a run.

    A place is (rid, window start, windows after it). Of equal strings a run keeps the earliest.
    """

    def __init__(self, rows: Rows):
        self.rows, self.kept, self.repeats = rows, {}, []
        self.runs = 0

    def add(self, key: bytes, place: tuple[int, int, int]) -> None:
        other = self.kept.setdefault(key, place)
        if other is not place:
            if place < other:
                self.kept[key], place = place, other
            self.repeats.append(place)

    def flush(self) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId() << 24 | self.runs
        self.runs += 1
        keys = sorted(self.kept)
        for i in range(0, len(keys), BLOCK):
            block = keys[i : i + BLOCK]
            places = [self.kept[k] for k in block]
            add_block(self.rows, run, block, np.asarray([p[0] for p in places], "<i8"), np.asarray([p[1] << 8 | p[2] for p in places], "<i8"))
            if self.rows.full:
                yield self.rows.take()
        self.kept = {}
        add_joined(self.rows, self.repeats)
        self.repeats = []
        yield self.rows.take()


def add_block(rows: Rows, run: int, keys: list[bytes], rids: np.ndarray, places: np.ndarray) -> None:
    data = encode_block(keys)
    rows.add(
        None, None, None, run, keys[min(SAMPLE_STEP, len(keys)) // 2 :: SAMPLE_STEP], len(keys), data, rids.tobytes(), places.tobytes(),
        size=len(data) + 16 * len(keys)
    )


def region_runs(located: DataFrame, size: int) -> DataFrame:
    """Sorted runs of the regions of anchors. located has rid, text and places of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_process()
        builder = RunBuilder(Rows(PARTS))
        for batch in batches:
            for rid, text, places in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2), strict=True):
                for place in places.values.to_numpy().tolist():
                    first, more, to_anchor = place >> 16, place >> 8 & 255, place & 255
                    at = first + to_anchor
                    builder.add(text[at : first + more + size] + text[first:at][::-1] + bytes([to_anchor]), (rid, first, more))
                if len(builder.kept) >= RUN_KEYS or len(builder.repeats) >= RUN_KEYS:
                    yield from builder.flush()
        yield from builder.flush()

    return located.select("rid", "text", "places").mapInArrow(run, PARTS_SQL)


def window_runs(windows: DataFrame) -> DataFrame:
    """Sorted runs of windows (content, rid, low)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = RunBuilder(Rows(PARTS))
        for batch in batches:
            for content, rid, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                builder.add(content, (rid, low, 0))
            if len(builder.kept) >= RUN_KEYS or len(builder.repeats) >= RUN_KEYS:
                yield from builder.flush()
        yield from builder.flush()

    return windows.select("content", "rid", "low").mapInArrow(run, PARTS_SQL)


@dataclass(frozen=True)
class Ranges:
    """Where the order of strings is cut: at splitters, and within each range of these at those of a table (part, splitters), if there is one."""

    splitters: list[bytes]
    finer: DataFrame | None = None


def sampled(blocks: DataFrame, keys: int, most: int) -> DataFrame:
    """About most of the strings that blocks offer, or all if they are fewer, chosen by a hash: s.

    Strings are whole, under 200 bytes: very many may share all but their ends.
    """
    share = min(1.0, most * SAMPLE_STEP / max(1, keys))
    offered = blocks.select("run", F.explode("sample").alias("s"))
    return offered.filter(F.pmod(F.xxhash64("s", "run"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("s")


def ranges_of(blocks: DataFrame, least: int) -> Ranges:
    """Ranges for the strings of blocks. At most about MOST_SPLITTERS * SAMPLE_OF_RANGE strings come to the driver, however many there are."""
    keys = blocks.agg(F.sum("n")).first()[0] or 0
    ranges = max(least, keys // RANGE_KEYS + 1)
    n = min(ranges, MOST_SPLITTERS)
    splitters = choose_splitters([bytes(r.s) for r in sampled(blocks, keys, SAMPLE_OF_RANGE * n).collect()], n)
    if ranges <= n:
        return Ranges(splitters)
    each = -(-ranges // n)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = batch.column(0).to_pylist()
            parts = [bisect.bisect_right(splitters, s) for s in strings]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), batch.column(0)], names=["part", "s"])

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"part": [key[0].as_py()], "splitters": pa.array([choose_splitters(table["s"].to_pylist(), each)], pa.list_(pa.binary()))})

    placed = sampled(blocks, keys, SAMPLE_OF_RANGE * ranges).mapInArrow(place, "part long, s binary")
    return Ranges(splitters, placed.groupBy("part").applyInArrow(choose, "part long, splitters array<binary>"))


PIECES = pa.schema([
    ("part", pa.int64()), ("below", pa.binary()), ("above", pa.binary()), ("run", pa.int64()), ("first_key", pa.binary()),
    *(PARTS.field(n) for n in ("n", "keys", "rids", "places"))
])
PIECES_SQL = "part long, below binary, above binary, run long, first_key binary, n int, keys binary, rids binary, places binary"


def add_pieces(rows: Rows, block: dict, splitters: list[bytes], base: int, ends: tuple[bytes | None, bytes | None]) -> None:
    """Adds the parts that splitters cut a block into, numbered from base on. Each tells the splitters below and above it; ends are those of the whole."""
    keys, _ = decode_block(block["keys"])
    for part, i, j in cut_at(keys, splitters):
        below = splitters[part - 1] if part else ends[0]
        above = splitters[part] if part < len(splitters) else ends[1]
        data = encode_block(keys[i:j])
        rows.add(
            base + part, below, above, block["run"], keys[i], j - i, data, block["rids"][8 * i : 8 * j], block["places"][8 * i : 8 * j],
            size=len(data) + 16 * (j - i)
        )


def exchanged(blocks: DataFrame, ranges: Ranges) -> DataFrame:
    """The blocks, cut into ranges. With a table of finer splitters they are dealt by the coarser ranges first, and those of a range meet it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(PIECES)
        for batch in batches:
            for block in batch.to_pylist():
                add_pieces(rows, block, ranges.splitters, 0, (None, None))
                if rows.full:
                    yield rows.take()
        yield rows.take()

    if ranges.finer is None:
        return blocks.select("run", "n", "keys", "rids", "places").mapInArrow(run, PIECES_SQL)
    splitters = ranges.splitters
    cut = Ranges(splitters)
    pieces = exchanged(blocks, cut)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, part, finer = Rows(PIECES), None, []
        for batch in batches:
            for piece in batch.to_pylist():
                if piece["part"] != part:
                    part, finer = piece["part"], []
                if piece["splitters"] is not None:
                    finer = piece["splitters"]
                    continue
                add_pieces(rows, piece, finer, part << 32, (piece["below"], piece["above"]))
                if rows.full:
                    yield rows.take()
        yield rows.take()

    both = pieces.withColumn("splitters", F.lit(None).cast("array<binary>")).unionByName(ranges.finer, allowMissingColumns=True)
    dealt = both.repartition("part").sortWithinPartitions("part", F.col("splitters").isNull())
    return dealt.mapInArrow(again, PIECES_SQL)


def merged_groups(table: pa.Table) -> Iterator[tuple[bytes, int, list[tuple[int, int, int]]]]:
    """The different strings of a range in order, with the length of the prefix each shares with the one before, and their places, the earliest first."""
    runs: dict[int, list[dict]] = {}
    for segment in table.select(["run", "first_key", "keys", "rids", "places"]).to_pylist():
        runs.setdefault(segment["run"], []).append(segment)
    parts, where = [], []
    for run in sorted(runs):
        keys, shared, rids, places = [], [], [], []
        for segment in sorted(runs[run], key=lambda s: s["first_key"]):
            more, heads = decode_block(segment["keys"])
            if keys:
                heads[0] = common_prefix(keys[-1], more[0])
            keys += more
            shared += heads
            rids += np.frombuffer(segment["rids"], "<i8").tolist()
            places += np.frombuffer(segment["places"], "<i8").tolist()
        parts.append((keys, shared))
        where.append((rids, places))
    last, head, group = None, 0, []
    for key, shared, run, i in LoserTree(parts):
        rids, places = where[run]
        place = (rids[i], places[i] >> 8, places[i] & 255)
        if last is not None and shared == len(key) == len(last):
            group.append(place)
            continue
        if last is not None:
            group.sort()
            yield last, head, group
        last, head, group = key, shared, [place]
    if last is not None:
        group.sort()
        yield last, head, group


OUT = pa.schema([("rid", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("content", pa.binary())])
OUT_SQL = "rid long, low long, high long, content binary"


class Family:
    """Different regions around the same k-gram, in order of what follows it."""

    def __init__(self, size: int):
        self.size, self.members = size, []

    def add(self, key: bytes, shared: int, place: tuple[int, int, int]) -> None:
        self.members.append((key, shared, place))

    def windows(self, beyond: bool) -> Iterator[tuple[int, bytes, tuple[int, int]]]:
        """The windows that may occur in another member: distance to the anchor, content, and place.

        What follows the anchor in a window must occur in a neighbour of the order; beyond says that
        there may be neighbours that aren't here.
        """
        for i, (key, shared, (rid, first, more)) in enumerate(self.members):
            after = self.members[i + 1][1] if i + 1 < len(self.members) else self.size if beyond else 0
            common = max(after, self.size if beyond and not i else shared if i else 0)
            to_anchor = key[-1]
            split = len(key) - 1 - to_anchor
            left = key[split:-1][::-1]
            for d in range(max(to_anchor - more, self.size - common), to_anchor + 1):
                yield d, left[to_anchor - d :] + key[: self.size - d], (rid, first + to_anchor - d)

    def repeats(self) -> list[tuple[int, int]]:
        """The windows that an earlier member has too, as places."""
        if len(self.members) < 2:
            return []
        earliest: dict[tuple[int, bytes], tuple[int, int]] = {}
        seen = []
        for d, content, place in self.windows(False):
            best = earliest.setdefault((d, content), place)
            if place < best:
                earliest[d, content] = place
            seen.append(((d, content), place))
        return [place for at, place in seen if earliest[at] != place]


def merge_regions(blocks: DataFrame, ranges: Ranges, size: int, gram: int) -> DataFrame:
    """Merges the runs of regions: rid, low, high for windows that repeat; rid, low and content for windows still to be compared."""

    def merge(table: pa.Table) -> pa.Table:
        rows, out, repeats = Rows(OUT), [], []
        below, above = (table[c][0].as_py() for c in ("below", "above"))

        def close(family: Family, is_last: bool) -> None:
            first, last = family.members[0][0], family.members[-1][0]
            beyond = (below is not None and common_prefix(
                below, first
            ) >= gram) or (is_last and above is not None and common_prefix(last, above) >= gram)
            if beyond:
                for _, content, (rid, low) in family.windows(True):
                    rows.add(rid, low, None, content)
                    if len(rows.columns[0]) >= 20_000:
                        out.append(rows.take())
            else:
                repeats.extend((rid, low, 0) for rid, low in family.repeats())

        family = Family(size)
        for string, shared, places in merged_groups(table):
            repeats.extend(places[1:])
            if family.members and shared < gram:
                close(family, False)
                family = Family(size)
            family.add(string, shared if family.members else 0, places[0])
        if family.members:
            close(family, True)
        add_joined(rows, repeats)
        out.append(rows.take())
        return pa.Table.from_batches(out, OUT)

    return exchanged(blocks, ranges).groupBy("part").applyInArrow(merge, OUT_SQL)


def merge_windows(blocks: DataFrame, ranges: Ranges) -> DataFrame:
    """Merges the runs of windows: rid, low, high for those that repeat."""

    def merge(table: pa.Table) -> pa.Table:
        rows = Rows(OUT)
        add_joined(rows, [p for _, _, places in merged_groups(table) for p in places[1:]])
        return pa.Table.from_batches([rows.take()], OUT)

    return exchanged(blocks, ranges).groupBy("part").applyInArrow(merge, OUT_SQL)


def add_joined(rows: Rows, repeats: list[tuple[int, int, int]]) -> None:
    """Adds repeats as rows, neighbours as one."""
    repeats.sort()
    rid = low = high = None
    blank = [None] * (len(rows.schema) - 3)
    for r, first, more in repeats:
        if r == rid and first == high + 1:
            high = first + more
            continue
        if rid is not None:
            rows.add(rid, low, high, *blank)
        rid, low, high = r, first, first + more
    if rid is not None:
        rows.add(rid, low, high, *blank)


def repeated_windows(base: DataFrame, size: int = MIN_BYTES, gram: int = GRAM) -> DataFrame:
    """The windows of size bytes of base (rid, text) that start earlier too: rid, low, high (first and last start)."""
    least = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = find_anchors(base, size, gram)
    repeated = found.withColumn("times", F.count("*").over(Window.partitionBy("key"))).filter("known OR times > 1")
    places = repeated.groupBy(F.col("rid").alias("anchor_rid")).agg(F.sort_array(F.collect_list("place")).alias("places"))
    located = base.join(places, F.col("rid") == F.col("anchor_rid")).select("rid", "text", "places")
    parts = written(region_runs(located, size))
    blocks = parts.filter("n IS NOT NULL")
    merged = written(merge_regions(blocks, ranges_of(blocks, 2 * least), size, gram))
    windows = written(window_runs(merged.filter("content IS NOT NULL")))
    blocks = windows.filter("n IS NOT NULL")
    last = merge_windows(blocks, ranges_of(blocks, 2 * least))
    return parts.filter("rid IS NOT NULL").select(
        "rid", "low", "high"
    ).unionByName(merged.filter("content IS NULL").select("rid", "low", "high")).unionByName(windows.filter("rid IS NOT NULL").select("rid", "low", "high")).unionByName(last.select("rid", "low", "high"))


RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def remove_repeated(
    docs: DataFrame, size: int = MIN_BYTES, gram: int = GRAM, carry: tuple[str, ...] = (), whole_characters: bool = False
) -> DataFrame:
    """Removes from every text of docs (doc_id, text) the bytes covered by a string of size bytes that starts earlier too.

    Earlier means in a document of a smaller doc_id, or in the same one, before. Strings are judged
    on the input, and overlaps count. Returns doc_id, n_bytes, spans (the maximal removed runs of
    bytes, from start to end) and kept (the other bytes, joined; with whole_characters without what a
    cut leaves of a character).

    A null text counts as empty. Documents of the same or no doc_id are ordered by text, null ids
    before all others, and each keeps its row. Columns named in carry go along, others are ignored;
    an empty table gives no rows.
    """
    base = numbered(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carry
    ))
    removed = repeated_windows(
        base, size, gram
    ).groupBy(F.col("rid").alias("removed_rid")).agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("removed"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(schema)
        for batch in batches:
            done = 0
            for i, (doc_id, text, starts) in enumerate(zip(
                batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), strict=True
            )):
                spans: list[list[int]] = []
                for r in starts or ():
                    low, high = r["low"], r["high"] + size
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], high)
                    else:
                        spans.append([low, high])
                edges = [0, *(e for s in spans for e in s), len(text)]
                kept = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                if whole_characters and spans:
                    kept = kept.decode("utf-8", "ignore").encode("utf-8")
                rows.add(doc_id, len(text), [{"start": a, "end": b} for a, b in spans], kept, size=len(kept))
                if rows.full or i + 1 == batch.num_rows:
                    yield carried(rows.take(), batch, 3, done)
                    done = i + 1

    return base.join(
        removed, F.col("rid") == F.col("removed_rid"), "left"
    ).select("doc_id", "text", "removed", *carry).mapInArrow(run, RESULT + carried_sql(docs, carry))


def removal_digests(removed: DataFrame) -> DataFrame:
    """Numbers of removed bytes and runs, and a checksum of what is kept."""
    return removed.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256")
    )
