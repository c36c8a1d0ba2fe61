"""Document quality by line sequence labelling: a linear-chain CRF marks content and boilerplate."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, digest64, texts, written

#: Documents of fewer words fail, and those with more than this percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A document is kept when this share of its word bytes lies in content lines.
LEAST_CONTENT = 0.5
#: The model is fitted on at most so many labelled documents, those first by a hash of their ids, of at most so many bytes each.
FIT_DOCS, FIT_BYTES = 400, 200_000
#: For fitting, longer documents are cut into chains of so many lines.
CHAIN = 128
#: A line occurs elsewhere when it has so many different neighbours on one side, and these are half of its occurrences at least.
LEAST_CONTEXTS, CONTEXT_PERCENT = 5, 50
#: Lines that occur elsewhere are broadcast up to this number (8 bytes each); beyond it they are joined.
MOST_BROADCAST = 200_000

SYMBOLS, SPACES, UPPER = b"#*$%&|<>", b" \t\n\v\f\r", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CONTINUED = bytes(range(0x80, 0xC0))
LOWER = b"abcdefghijklmnopqrstuvwxyz"
#: Number of values of each feature of a line, in the order of line_code.
LEVELS = (4, 4, 4, 2, 2, 3, 2)


def level(value: float, bounds: tuple[float, ...]) -> int:
    return sum(value > b for b in bounds)


def line_code(line: bytes, repeated: bool, elsewhere: bool = False) -> int:
    """The features of a line, as one number.

    They are density of symbols, share of capitals, number of words, repetition within the text, end of
    a sentence, exclamations, and whether it occurs elsewhere in other surroundings.
    """
    size = len(line)
    words = len(line.split())
    symbols = size - len(line.translate(None, SYMBOLS))
    upper = size - len(line.translate(None, UPPER))
    lower = size - len(line.translate(None, LOWER))
    values = (
        level(symbols / size, (0.0, 0.02, 0.08)),
        level(upper / (upper + lower + 1), (0.12, 0.35, 0.7)),
        level(words, (2, 6, 20)),
        int(repeated),
        int(line.rstrip()[-1:] in (b".", b"?", b":", b";")),
        level(line.count(b"!") / words, (0.0, 0.3)),
        int(elsewhere),
    )
    code = 0
    for value, n in zip(values, LEVELS, strict=True):
        code = code * n + value
    return code


def lines_of(text: bytes, known: Collection[int] = ()) -> list[tuple[int, int, bool, bool]]:
    """Code, bytes outside white space, repetition and occurrence elsewhere of each line that has a word.

    known holds the keys of the lines that occur elsewhere (see repeated_lines).
    """
    seen, out = set(), []
    for line in text.split(b"\n"):
        size = len(line.translate(None, SPACES))
        if size:
            repeated, elsewhere = line in seen, bool(known) and line_key(line) in known
            seen.add(line)
            out.append((line_code(line, repeated, elsewhere), size, repeated, elsewhere))
    return out


def line_key(line: bytes) -> int:
    """A line's key, without white space at its ends."""
    return digest64(line.strip())


def repeated_lines(docs: DataFrame, least: int = LEAST_CONTEXTS, percent: int = CONTEXT_PERCENT) -> DataFrame:
    """Keys of the lines that occur elsewhere, over all texts of docs (text): line.

    A line's neighbours count by their longest word, which a small edit seldom changes. Copies and near
    copies of a text repeat a line among the same neighbours, so they don't make it boilerplate however
    many they are; a header or a licence note has other neighbours each time. Counts are partial in
    each task and spread by line and neighbour, so that a line in a third of all texts isn't one task's.
    """
    schema = pa.schema([("line", pa.int64()), ("before", pa.int64()), ("after", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, before, after = [], [], []

        def taken() -> pa.RecordBatch:
            nonlocal keys, before, after
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (keys, before, after)], schema=schema)
            keys, before, after = [], [], []
            return out

        for batch in batches:
            for text in texts(batch.column(0)):
                last = 0
                for line in text.split(b"\n"):
                    if words := line.split():
                        sign = zlib.crc32(max(words, key=len))
                        if last:
                            after.append(sign)
                        keys.append(line_key(line))
                        before.append(last)
                        last = sign or 1
                if last:
                    after.append(0)
                if len(keys) > 50_000:
                    yield taken()
        yield taken()

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "line long, before long, after long")
    sides = F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.col("before").alias("near")), F.struct(F.lit(1).alias("side"), F.col("after").alias("near"))
    ))
    met = found.select("line", sides).groupBy("line", "side", "near").agg(F.count("*").alias("n"))
    counts = met.groupBy("line").agg(
        F.sum(F.col("side")).alias("after"), F.sum(1 - F.col("side")).alias("before"),
        F.sum((1 - F.col("side")) * F.col("n")).alias("times")
    )
    most = F.greatest("before", "after")
    return written(counts.filter((most >= least) & (most * 100 >= F.col("times") * percent)).select("line"))


def with_known(docs: DataFrame, repeated: DataFrame | None, most_broadcast: int = MOST_BROADCAST) -> tuple[DataFrame, np.ndarray]:
    """docs with a column known_lines, and keys to broadcast: the lines of a text that occur elsewhere are in the one or the other.

    Up to most_broadcast keys of repeated are broadcast; else each text gets its own by a join on its hash.
    """
    nothing = F.lit(None).cast("array<bigint>").alias("known_lines")
    if repeated is None:
        return docs.select("*", nothing), np.zeros(0, np.int64)
    if repeated.count() <= most_broadcast:
        return docs.select("*", nothing), repeated.select("line").toArrow().column("line").to_numpy()
    schema = pa.schema([("text_key", pa.int64()), ("line", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(schema)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                for line in {line_key(x) for x in text.split(b"\n") if x.strip()}:
                    rows.add(key, line)
                if rows.full:
                    yield rows.take()
        yield rows.take()

    keyed = docs.select(F.xxhash64("text").alias("text_key"), F.col("text").cast("string")).mapInArrow(run, "text_key long, line long")
    own = keyed.distinct().join(repeated.select(F.col("line").alias("known")), F.col("line") == F.col("known"))
    own = own.groupBy("text_key").agg(F.collect_list("line").alias("known_lines"))
    return docs.join(own, F.xxhash64(docs["text"]) == F.col("text_key"), "left").select(*(docs[c] for c in docs.columns), "known_lines"), np.zeros(0, np.int64)


def indicators() -> np.ndarray:
    """A row of 0 and 1 for each code: which value each feature has."""
    codes = np.arange(int(np.prod(LEVELS)))
    columns, left = [], codes
    for n in reversed(LEVELS):
        columns.append(np.eye(n)[left % n])
        left = left // n
    return np.concatenate([np.ones((len(codes), 1)), *columns[::-1]], axis=1)


@dataclass(frozen=True)
class LineModel:
    """Scores of a linear-chain CRF with the labels 0 (boilerplate) and 1 (content).

    emission holds both labels' scores of each line code; transition and start hold those of pairs
    of labels and of the first label. As it stands, a model calls every line content.
    """

    emission: list[tuple[float, float]] = field(default_factory=lambda: [(0.0, 1.0)] * int(np.prod(LEVELS)))
    transition: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    start: tuple[float, float] = (0.0, 0.0)

    def decode(self, codes: list[int]) -> list[int]:
        """The most likely labels, by Viterbi's recursion; of equal ones content."""
        if not codes:
            return []
        (t00, t01), (t10, t11) = self.transition
        a, b = (s + e for s, e in zip(self.start, self.emission[codes[0]], strict=True))
        back = []
        for code in codes[1:]:
            e0, e1 = self.emission[code]
            from0, from1 = int(b + t10 >= a + t00), int(b + t11 >= a + t01)
            a, b = (b + t10 if from0 else a + t00) + e0, (b + t11 if from1 else a + t01) + e1
            back.append((from0, from1))
        label = int(b >= a)
        labels = [label]
        for pointers in reversed(back):
            label = pointers[label]
            labels.append(label)
        return labels[::-1]


class Chains:
    """Chains of line codes with the label of each line, padded to one length, and the likelihood of a CRF on them.

    Chains are weighted so that both labels count alike in all.
    """

    def __init__(self, chains: list[list[int]], labels: list[list[int]]):
        length = np.asarray([len(c) for c in chains])
        n, self.longest = len(chains), int(length.max())
        self.codes, self.y = np.zeros((n, self.longest), np.int64), np.zeros((n, self.longest), np.int64)
        for i, (c, y) in enumerate(zip(chains, labels, strict=True)):
            self.codes[i, : len(c)], self.y[i, : len(c)] = c, y
        self.real = np.arange(self.longest) < length[:, None]
        ones = int((self.y * self.real).sum())
        share = np.where(self.y == 1, 0.5 / max(1, ones), 0.5 / max(1, int(length.sum()) - ones)) * self.real
        self.weight = share.sum(1) / length
        self.features = indicators()

    def likelihood(self, W: np.ndarray, T: np.ndarray, S: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The weighted log-likelihood of the labels, and its slopes, from forward and backward sums."""
        x, codes, y, real, weight, longest = self.features, self.codes, self.y, self.real, self.weight, self.longest
        n, one = len(codes), np.eye(2)
        emission = (x @ W)[codes]
        forward, backward = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
        forward[0] = S + emission[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(forward[t - 1][:, :, None] + T, axis=1) + emission[:, t]
            forward[t] = np.where(real[:, t, None], step, forward[t - 1])
        total = np.logaddexp.reduce(forward[-1], axis=1)
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce((backward[t + 1] + emission[:, t + 1])[:, None, :] + T, axis=2)
            backward[t] = np.where(real[:, t + 1, None], step, 0)
        marginal = np.exp(forward + backward - total[None, :, None]).transpose(1, 0, 2) * real[:, :, None]
        gap = (one[y] * real[:, :, None] - marginal) * weight[:, None, None]
        by_code = np.stack([np.bincount(codes.ravel(), gap[:, :, k].ravel(), len(x)) for k in (0, 1)], axis=1)
        later = backward[1:] + emission.transpose(1, 0, 2)[1:]
        pair = np.exp(forward[:-1][:, :, :, None] + T + later[:, :, None, :] - total[None, :, None, None])
        truth = (one[y[:, :-1]][:, :, :, None] * one[y[:, 1:]][:, :, None, :]).transpose(1, 0, 2, 3)
        seen = (real[:, 1:] * weight[:, None]).T
        own = (np.take_along_axis(emission, y[:, :, None], 2)[:, :, 0] * real).sum(1) + S[y[:, 0]] + (T[y[:, :-1], y[:, 1:]] * real[:, 1:]).sum(1)
        return float((weight * (own - total)).sum()), [x.T @ by_code, (seen[:, :, None, None] * (truth - pair)).sum((0, 1)), gap[:, 0].sum(0)]


def fit(chains: list[list[int]], labels: list[list[int]], steps: int = 120, rate: float = 0.5, decay: float = 1e-3) -> LineModel:
    """Maximum likelihood, with a decay of weights, for chains of line codes and the label of each line.

    Gradient ascent with momentum. Gives the model that keeps everything if one of the labels is absent.
    """
    if len({y for chain in labels for y in chain}) < 2:
        return LineModel()
    data = Chains(chains, labels)
    values = [np.zeros((data.features.shape[1], 2)), np.zeros((2, 2)), np.zeros(2)]
    speed = [np.zeros_like(v) for v in values]
    for _ in range(steps):
        for value, v, slope in zip(values, speed, data.likelihood(*values)[1], strict=True):
            v *= 0.9
            v += rate * (slope - decay * value)
            value += v
    W, T, S = values
    return LineModel([tuple(map(float, e)) for e in data.features @ W], tuple(tuple(map(float, t)) for t in T), tuple(map(float, S)))


def fit_line_model(
    docs: DataFrame, labels: DataFrame, repeated: DataFrame | None = None, most_docs: int = FIT_DOCS, most_bytes: int = FIT_BYTES
) -> LineModel:
    """Fits the line model on a bounded sample of labelled documents.

    docs has doc_id and text, labels has doc_id and quality (1 or 0), repeated is what repeated_lines
    gives. The sample is the most_docs labelled ids first by a hash, without texts over most_bytes. A
    line of it is boilerplate if its document is bad or it occurs elsewhere, else content. Only line
    codes of the sample come to the driver.
    """
    chosen = labels.select(F.col("doc_id").alias("labelled_id"), "quality").filter("quality IN (0, 1) AND labelled_id IS NOT NULL").distinct()
    chosen = chosen.orderBy(F.xxhash64("labelled_id"), "labelled_id", "quality").limit(most_docs)
    sample = docs.select("doc_id", "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")
    ).filter(F.octet_length("text") <= most_bytes)
    sample, keys = with_known(sample.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), F.col("text").cast("string")), repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozenset(keys.tolist())
        for batch in batches:
            codes, content = [], []
            for quality, text, own in zip(batch.column(1).to_pylist(), texts(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                lines = lines_of(text, frozenset(own) if own else known)
                codes.append([c for c, *_ in lines])
                content.append([int(quality == 1 and not elsewhere) for *_, elsewhere in lines])
            numbers = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(codes, numbers), pa.array(content, numbers)], names=["doc_id", "codes", "content"]
            )

    rows = sample.mapInArrow(run, "doc_id long, codes array<int>, content array<int>").collect()
    rows = sorted((r for r in rows if r.codes), key=lambda r: (r.doc_id, r.codes, r.content))
    cuts = [(r, slice(i, i + CHAIN)) for r in rows for i in range(0, len(r.codes), CHAIN)]
    return fit([r.codes[c] for r, c in cuts], [r.content[c] for r, c in cuts])


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times, marked, end = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            marked += i + 3 - max(end, i)
            end = i + 3
    return marked


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, line_labels string, content_share double, kept boolean"
ARROW = pa.schema(
    [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("line_labels", pa.string()), ("content_share", pa.float64()), ("kept", pa.bool_())]
)


def judge(text: bytes, model: LineModel, least_content: float, known: Collection[int] = ()) -> tuple[int, int, int, int, int, bool, str, float, bool]:
    """The columns of judge_quality for one text, without doc_id."""
    words, lines = text.split(), lines_of(text, known)
    solid = text.translate(None, SPACES)
    chars = len(solid) if solid.isascii() else len(solid.translate(None, CONTINUED))
    repeats = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeats > MOST_REPEATED * len(words)
    labels = model.decode([c for c, *_ in lines])
    size = sum(s for _, s, *_ in lines)
    share = sum(s for (_, s, *_), k in zip(lines, labels, strict=True) if k) / size if size else 0.0
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    return len(words), chars, symbols, sum(
        r for _, _, r, _ in lines
    ), repeats, failed, "".join("BC"[k] for k in labels), share, not failed and share >= least_content


def judge_quality(
    docs: DataFrame, model: LineModel, repeated: DataFrame | None = None, least_content: float = LEAST_CONTENT,
    most_broadcast: int = MOST_BROADCAST
) -> DataFrame:
    """Base counts and the verdict on every text of docs (doc_id, text).

    repeated is what repeated_lines gives; without it no line counts as occurring elsewhere. Returns
    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    line_labels (C for content, B for boilerplate, one letter for each line with a word),
    content_share (of the bytes in words) and kept: whether the base rules hold and content_share
    is at least least_content.

    A null or empty text has no words and fails. Repeated rows stay, each judged alone. Other
    columns are ignored; an empty table gives no rows. Texts are shuffled only if repeated has more
    than most_broadcast rows.
    """
    source, keys = with_known(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), repeated, most_broadcast)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, known = Rows(ARROW), frozenset(keys.tolist())
        for batch in batches:
            for doc_id, text, own in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                rows.add(doc_id, *judge(text, model, least_content, frozenset(own) if own else known))
                if rows.full:
                    yield rows.take()
        yield rows.take()

    return source.mapInArrow(run, SCHEMA)


def keep_quality(
    docs: DataFrame, model: LineModel, repeated: DataFrame | None = None, least_content: float = LEAST_CONTENT,
    most_broadcast: int = MOST_BROADCAST
) -> DataFrame:
    """The rows of docs, with all their columns, that judge_quality keeps. docs has no column known_lines."""
    at = docs.columns.index("text")
    source, keys = with_known(docs, repeated, most_broadcast)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozenset(keys.tolist())
        for batch in batches:
            own_lines = batch.column(batch.num_columns - 1).to_pylist()
            kept = [
                judge(t, model, least_content, frozenset(own) if own else known)[-1] for t,
                own in zip(texts(batch.column(at)), own_lines, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(kept, pa.bool_()))

    return source.mapInArrow(run, docs.schema)
