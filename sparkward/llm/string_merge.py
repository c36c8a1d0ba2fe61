"""Distributed merge sort of byte strings that is aware of common prefixes.

Tasks sort what they read into runs, kept in blocks that are front-coded: each string is stored as
the length of the prefix it shares with the one before and the rest. Blocks are cut at splitters,
exchanged by range, and the runs that meet in a range are merged by a loser tree whose comparisons
begin after the prefix that is known to be common.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np

#: Strings of a block.
BLOCK = 2000


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings of which known bytes are common."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7 >> 3)


def encode_block(keys: list[bytes]) -> bytes:
    """Sorted strings of under 65536 bytes, front-coded."""
    shared = [0]
    shared += [common_prefix(a, b) for a, b in zip(keys, keys[1:], strict=False)]
    heads = np.asarray([shared, [len(k) for k in keys]], "<u2")
    return np.asarray([len(keys)], "<u4").tobytes() + heads.tobytes() + b"".join([k[s:] for k, s in zip(keys, shared, strict=True)])


def decode_block(data: bytes) -> tuple[list[bytes], list[int]]:
    """The strings of a block, and the length of the prefix each shares with the one before."""
    n = int.from_bytes(data[:4], "little")
    shared, lengths = np.frombuffer(data, "<u2", 2 * n, 4).reshape(2, n).tolist()
    keys, last, at = [], b"", 4 + 4 * n
    for s, length in zip(shared, lengths, strict=True):
        last = last[:s] + data[at : at + length - s]
        at += length - s
        keys.append(last)
    return keys, shared


def cut_at(keys: list[bytes], splitters: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """Range, first and end index of the parts that splitters cut sorted strings into; a splitter's equals lie after it."""
    at = 0
    while at < len(keys):
        part = bisect.bisect_right(splitters, keys[at])
        end = bisect.bisect_left(keys, splitters[part], at) if part < len(splitters) else len(keys)
        yield part, at, end
        at = end


def choose_splitters(sample: list[bytes], ranges: int) -> list[bytes]:
    """At most ranges - 1 distinct splitters at equal distances in a sample."""
    sample = sorted(sample)
    return sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []


class LoserTree:
    """Merges sorted runs of strings.

    A run is a list of strings with the length of the prefix each shares with the one before. Of two
    contenders, the one that shares more with the last string given out is the smaller; only if both
    share equally much are they compared, from there on.
    """

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs, self.size = runs, 1
        while self.size < len(runs):
            self.size *= 2
        n = self.size
        self.place = [0] * n
        self.key = [r[0][0] if r[0] else b"" for r in runs] + [b""] * (n - len(runs))
        self.shared = [0 if r[0] else -1 for r in runs] + [-1] * (n - len(runs))  # -1: the run has ended
        self.loser = [0] * n
        self.winner = self.build(1)

    def build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        self.loser[node], winner = self.play(self.build(2 * node), self.build(2 * node + 1))[::-1]
        return winner

    def play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs. What the loser shares is then counted against the winner."""
        shared = self.shared
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        if shared[a] < 0:
            return a, b
        x, y = self.key[a], self.key[b]
        h = common_prefix(x, y, shared[a])
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            shared[b] = h
            return a, b
        shared[a] = h
        return b, a

    def __iter__(self) -> Iterator[tuple[bytes, int, int, int]]:
        """Each string in order, with the length of the prefix it shares with the one before, its run and place there."""
        runs, key, shared, place, loser, size, play = self.runs, self.key, self.shared, self.place, self.loser, self.size, self.play
        w = self.winner
        while shared[w] >= 0:
            yield key[w], shared[w], w, place[w]
            keys, heads = runs[w]
            place[w] += 1
            if place[w] < len(keys):
                key[w], shared[w] = keys[place[w]], heads[place[w]]
            else:
                shared[w] = -1
            node = w + size >> 1
            while node:
                other = loser[node]
                if shared[other] > shared[w]:
                    loser[node], w = w, other
                elif shared[other] == shared[w]:
                    w, loser[node] = play(w, other)
                node >>= 1
