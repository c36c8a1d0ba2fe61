"""Packing of tokenized documents into training windows by the sum-of-squares rule."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, of_process, texts

WINDOW = 2048
#: Id that ends each document.
END_ID = 1
#: Words up to so many bytes are kept with their ids, about so many of them in a worker process.
WORD_BYTES, WORDS_KEPT = 48, 800_000

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64())
])


#: A word of Latin letters, then ASCII signs.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Byte-level vocabularies write bytes that have no sign of their own as the characters from 256 on.
BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


class WordTokenizer:
    """Ids of texts, by way of the ids of their words.

    Holds for tokenizers that drop white space and never look across it. Texts that hold a
    special token's string are tokenized whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def of(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of_word(self, word: bytes) -> bytes:
        """Ids of a word. Latin letters with ASCII signs after them go to the model at once, as the pretokenizer would cut them."""
        text = word.decode("utf-8")
        if not (m := PLAIN.fullmatch(text)):
            return self.of(text)
        return b"".join([self.of_part(part) for part in (m[1].lower(), m[2]) if part])

    def of_part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if not part.isascii():
                part = part.encode().decode("latin-1").translate(BYTE_SIGNS)
            ids = np.fromiter((t.id for t in self.tokenizer.model.tokenize(part)), "<u4").tobytes()
            if len(self.parts) <= WORDS_KEPT:
                self.parts[part] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a UTF-8 text."""
        if any(s in text for s in self.special):
            return self.of(text.decode("utf-8"))
        words, known = text.split(), self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > WORDS_KEPT:
            known.clear()
            self.parts.clear()
        own = {}
        for w in set(words):
            if w not in known:
                (known if len(w) <= WORD_BYTES else own)[w] = self.of_word(w)
        return b"".join([known[w] if w in known else own[w] for w in words])


class SumOfSquares:
    """Online packing of items into windows of a fixed size.

    levels[h] counts the open windows filled to h. An item goes where the sum of the squared counts
    becomes smallest, be that an open window or a new one; of equal choices to the fullest.
    """

    def __init__(self, size: int):
        self.size, self.levels, self.windows = size, np.zeros(size + 1, np.int64), [deque() for _ in range(size + 1)]
        self.n_open = 0

    def place(self, length: int, item) -> list | None:
        """Places an item of 0 < length < size; gives the window's items if that fills the window."""
        levels, size = self.levels, self.size
        best, cost = 0, levels[length] + 0.5  # half the change of the sum of squares
        room = size - length
        if self.n_open and room > 1:
            now = levels[1:room]
            change = np.where(now > 0, levels[1 + length : size] - now + 1, np.iinfo(np.int64).max)
            last = len(change) - 1 - int(change[::-1].argmin())
            if change[last] <= cost:
                best, cost = last + 1, change[last]
        if levels[room] > 0 and 0.5 - levels[room] <= cost:
            best = room
        window = []
        if best:
            levels[best] -= 1
            self.n_open -= 1
            window = self.windows[best].popleft()
        window.append(item)
        if best + length == size:
            return window
        levels[best + length] += 1
        self.n_open += 1
        self.windows[best + length].append(window)
        return None

    def rest(self) -> list[tuple[int, list]]:
        """Takes out all open windows with their fills, fullest first."""
        out = [(h, w) for h in range(self.size, 0, -1) for w in self.windows[h]]
        self.__init__(self.size)
        return out


def cut_at_powers(window: list, fill: int) -> Iterator[list]:
    """A partly filled window as windows filled to powers of two, the largest first; these need no padding."""
    items = deque(window)
    while fill:
        room = 1 << fill.bit_length() - 1
        fill -= room
        part = []
        while room:
            document, start, n = items.popleft()
            take = min(n, room)
            part.append((document, start, take))
            if take < n:
                items.appendleft((document, start + take, n - take))
            room -= take
        yield part


def fill_up(windows: list[tuple[int, list]], size: int) -> Iterator[list]:
    """Cuts the emptiest windows into the gaps of the fullest, and what stays partly filled at powers of two.

    Items are (document, first id, number of ids).
    """
    pending = deque(windows)
    while pending:
        fill, window = pending.popleft()
        while fill < size and pending:
            other_fill, other = pending.pop()
            while other and fill < size:
                document, start, n = other.pop()
                take = min(n, size - fill)
                window.append((document, start, take))
                if take < n:
                    other.append((document, start + take, n - take))
                fill, other_fill = fill + take, other_fill - take
            if other:
                pending.append((other_fill, other))
        if fill < size:
            yield from cut_at_powers(window, fill)
        else:
            yield window


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Tokenizes documents (doc_id, text) and packs them into windows.

    Returns one row for each piece: doc_id, start (ids of its document before it), length, ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id and offset in that window. Each id of
    each document lies in exactly one piece, and the pieces of a window leave no gap.

    Full windows are cut from the front of a long document; what is left is placed by the
    sum-of-squares rule. A task packs what it reads, with no shuffle. At its end the emptiest of the open
    windows are cut into the gaps of the others, and the one that stays partly filled is cut into
    shorter ones at powers of two, which aren't padded; so small tasks don't pad more than large ones.
    Open windows hold the ids of what the task has read, so its input bounds them.

    A null or empty text has only the end id. A null doc_id stays null. Rows that repeat are
    documents of their own. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer, rows = of_process(("words", tokenizer_path), lambda: WordTokenizer(tokenizer_path)), SumOfSquares(window), Rows(ARROW)
        base, made = TaskContext.get().partitionId() << 36, 0
        end = np.asarray([end_id], "<u4").tobytes()

        def emit(items: list) -> None:
            nonlocal made
            offset = 0
            for (doc_id, ids, skipped, total), start, n in items:
                part = ids[4 * (start - skipped) : 4 * (start - skipped + n)]
                rows.add(doc_id, start, n, part, total, base + made, offset, size=len(part))
                offset += n
            made += 1

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = tokenizer.ids(text) + end
                total = len(ids) // 4
                whole = total // window * window
                for start in range(0, whole, window):
                    emit([((doc_id, ids, 0, total), start, window)])
                if total > whole:
                    document = (doc_id, ids[4 * whole :], whole, total)
                    if full := packer.place(total - whole, (document, whole, total - whole)):
                        emit(full)
                if rows.full:
                    yield rows.take()
        for items in fill_up(packer.rest(), window):
            emit(items)
            if rows.full:
                yield rows.take()
        yield rows.take()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
