"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, digest64, of_process, texts

#: Stands for a space within pieces.
MARK = "▁"
MARK_BYTES = MARK.encode()
#: Piece r of the merge order has a probability in proportion to 1 / (r + RANK_SHIFT).
RANK_SHIFT = 10.0
#: A byte piece scores so much less than the least likely piece.
BYTE_PENALTY = 10.0
#: Segments up to so many bytes are kept with their ids, about so many of them in a worker process.
SEGMENT_BYTES, SEGMENTS_KEPT = 48, 700_000
#: Segments of more bytes are decoded with compact arrays.
LONGEST = 1 << 16


class DoubleArrayTrie:
    """A trie of byte strings in two arrays: the child of node s by byte b is base[s] + b + 1 if check of that is s."""

    def __init__(self, words: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = {}
        for word, v in words.items():
            node = 0
            for b in word:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                node = children[node][b]
            value[node] = v
        self.base, self.check, self.value = [0], [0], [-1]
        self.grow(len(children) + 600)
        free = dense = 256  # so that any byte can have the first free place
        queue = [(0, 0)]
        for node, at in queue:
            self.value[at] = value.get(node, -1)
            if not (codes := sorted(children[node])):
                continue
            while self.check[free] >= 0:
                free += 1
            probe = first = free if len(codes) == 1 else max(free, dense)
            while any(self.check[probe - codes[0] + b] >= 0 for b in codes):
                probe += 1
                self.grow(probe + 600)
            if probe - first > 64:  # nodes with several children look further on from here
                dense = probe
            start = probe - codes[0] - 1
            self.base[at] = start
            for b in codes:
                self.check[start + b + 1] = at
                queue.append((children[node][b], start + b + 1))
            self.grow(probe + 600)

    def grow(self, size: int) -> None:
        """Makes the arrays at least so long."""
        if (more := size - len(self.check)) > 0:
            more += len(self.check) // 2
            self.base += [0] * more
            self.check += [-1] * more
            self.value += [-1] * more


def read_pieces(path: str) -> tuple[list[str], list[str]]:
    """The pieces of a SentencePiece model file and what each is: word, byte or control."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids], ["byte" if model.is_byte(i) else "control" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "word" for i in ids]


class UnigramCodec:
    """Text to piece ids and back, without loss.

    The public file gives merge ranks; a rank r becomes the log score of Zipf's law, -log(r +
    RANK_SHIFT), up to a constant for each piece. A character that no piece covers falls back to the
    pieces of its bytes. One space is put before the text and spaces become marks; a mark in the
    text itself falls back to bytes, so decoding gives exactly the text.
    """

    def __init__(self, pieces: list[str], kinds: list[str]):
        self.pieces, self.kinds = pieces, kinds
        words = [i for i, k in enumerate(kinds) if k == "word"]
        total = math.log(sum(1 / (r + RANK_SHIFT) for r in range(len(words))))
        self.score = {i: -math.log(r + RANK_SHIFT) - total for r, i in enumerate(words)}
        self.byte_ids = {int(pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == "byte"}
        self.byte_score = min(self.score.values(), default=0.0) - BYTE_PENALTY
        self.trie = DoubleArrayTrie({pieces[i].encode(): i for i in words})
        self.node_score = [None if v < 0 else self.score[v] for v in self.trie.value]
        self.length_of = {i: len(pieces[i].encode()) for i in words}
        self.longest = max((len(pieces[i].encode()) for i in words), default=0)
        self.text_of = [
            bytes([int(p[3:5], 16)]) if k == "byte" else p.encode().replace(MARK_BYTES, b" ") if k == "word" else b"" for p,
            k in zip(pieces, kinds, strict=True)
        ]
        self.known: dict[bytes, tuple[int, ...]] = {}

    def best(self, segment: bytes) -> tuple[int, ...]:
        """Ids of the best segmentation: the highest sum of scores, of equal ones the one whose last pieces are longest."""
        n, base, check, value, scores = len(segment), self.trie.base, self.trie.check, self.trie.value, self.node_score
        total, back, last = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        total[0] = 0.0
        for at in range(n):
            so_far = total[at]
            if so_far == -math.inf:
                continue
            first = segment[at]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            node, end, covered = 0, at, False
            for byte in segment[at : at + self.longest]:
                child = base[node] + byte + 1
                if check[child] != node:
                    break
                node = child
                end += 1
                score = scores[node]
                if score is not None:
                    if end == at + width:
                        covered = True
                    if so_far + score > total[end]:
                        total[end], back[end], last[end] = so_far + score, at, value[node]
            if not covered and so_far + width * self.byte_score > total[at + width]:
                total[at + width], back[at + width], last[at + width] = so_far + width * self.byte_score, at, -1
        out, at = [], n
        while at:
            start = back[at]
            if last[at] >= 0:
                out.append(last[at])
            else:
                out.extend(self.byte_ids[b] for b in reversed(segment[start:at]))
            at = start
        return tuple(reversed(out))

    def best_of_long(self, segment: bytes) -> array:
        """What best() gives, with scores of the last places only and 4 bytes for each byte of the segment: the last piece of its best way, from which follows where that starts."""
        n, base, check, value, scores = len(segment), self.trie.base, self.trie.check, self.trie.value, self.node_score
        ring, last = max(self.longest, 4) + 1, array("i", [-1]) * (n + 1)
        total = [-math.inf] * ring
        total[0] = 0.0
        for at in range(n):
            so_far, total[at % ring] = total[at % ring], -math.inf
            if so_far == -math.inf:
                continue
            first = segment[at]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            node, end, covered = 0, at, False
            for byte in segment[at : at + self.longest]:
                child = base[node] + byte + 1
                if check[child] != node:
                    break
                node = child
                end += 1
                score = scores[node]
                if score is not None:
                    if end == at + width:
                        covered = True
                    if so_far + score > total[end % ring]:
                        total[end % ring], last[end] = so_far + score, value[node]
            if not covered and so_far + width * self.byte_score > total[(at + width) % ring]:
                total[(at + width) % ring], last[at + width] = so_far + width * self.byte_score, -1
        out, at = array("i"), n
        while at:
            if last[at] >= 0:
                out.append(last[at])
                at -= self.length_of[last[at]]
            else:  # the bytes of one character
                while True:
                    at -= 1
                    out.append(self.byte_ids[segment[at]])
                    if segment[at] & 0xC0 != 0x80:
                        break
        out.reverse()
        return out

    def segment_ids(self, segment: bytes) -> Sequence[int]:
        """Ids of a segment, as known or by Viterbi."""
        if (ids := self.known.get(segment)) is not None:
            return ids
        if len(segment) <= SEGMENT_BYTES:
            if len(self.known) > SEGMENTS_KEPT:
                self.known.clear()
            ids = self.known[segment] = self.best(segment)
            return ids
        return self.best(segment) if len(segment) <= LONGEST else self.best_of_long(segment)

    def encode(self, text: bytes) -> list[int]:
        """Ids of a UTF-8 text. No piece has a mark after another character, so runs of spaces with what follows them are segments of their own."""
        out: list[int] = []
        for i, part in enumerate(text.split(MARK_BYTES)):
            if i:
                out.extend(self.byte_ids[b] for b in MARK_BYTES)
            marks = 0 if i else 1
            pieces = part.split(b" ")
            for k, word in enumerate(pieces):
                marks += k > 0
                if word or k == len(pieces) - 1:
                    if marks or word:
                        out.extend(self.segment_ids(MARK_BYTES * marks + word))
                    marks = 0
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The UTF-8 text of ids, without the space put before it."""
        return b"".join([self.text_of[i] for i in ids])[1:]


def fingerprint(pieces: list[str], kinds: list[str]) -> int:
    """What a worker process keeps a codec by."""
    return digest64("\0".join(pieces + kinds).encode())


def encode_texts(docs: DataFrame, pieces: list[str], kinds: list[str]) -> DataFrame:
    """Piece ids of every text of docs (doc_id, text): doc_id, ids.

    A null or empty text becomes the one piece of a single space. Repeated rows stay; other columns
    are ignored; an empty table gives no rows. No shuffle; the pieces, whose number the vocabulary
    bounds, travel with the function.
    """
    schema, name = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]), fingerprint(pieces, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, rows = of_process(("codec", name), lambda: UnigramCodec(pieces, kinds)), Rows(schema)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = codec.encode(text)
                rows.add(doc_id, np.asarray(ids, np.int32), size=4 * len(ids))
                if rows.full:
                    yield rows.take()
        yield rows.take()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, pieces: list[str], kinds: list[str]) -> DataFrame:
    """Texts of piece ids: doc_id, ids, decoded. Null ids give an empty text; bytes that are no UTF-8 are replaced."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    name = fingerprint(pieces, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, rows = of_process(("codec", name), lambda: UnigramCodec(pieces, kinds)), Rows(schema)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                array = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.zeros(0, np.int32)
                text = codec.decode(array.tolist())
                rows.add(doc_id, array, text.decode("utf-8", "replace"), size=5 * len(text))
                if rows.full:
                    yield rows.take()
        yield rows.take()

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip_digests(decoded: DataFrame, byte_ids: list[int]) -> DataFrame:
    """Number of pieces and of byte pieces, a hash of the ids, and a checksum of the decoded text."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.size(F.filter("ids", lambda i: i.between(min(byte_ids), max(byte_ids)))).cast("long").alias("n_byte_pieces"),
        F.xxhash64("ids").alias("ids_hash"), F.octet_length("decoded").cast("long").alias("n_bytes"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
