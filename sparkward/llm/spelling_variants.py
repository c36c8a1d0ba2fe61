"""Spelling variants: pairs of words at one edit, from a vocabulary acceptor composed with a one-edit transducer and itself."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CRC32_TABLE_SQL, crc32_sql, discard, lower_ascii, written

#: What a word is made of, and which words count: so many code points and occurrences at least.
LETTERS, LEAST_LENGTH, LEAST_COUNT = "[A-Za-zÀ-ÿ]+", 6, 5
#: One run in so many loses a code point.
ONE_IN = 199
#: A state of the composed machine is handed to one task if so many words pass it at most; others are taken apart, down to this depth.
STATE_WORDS, DEPTH = 4096, 8
#: A word's form occurs so many times as often.
TIMES = 5
#: Doublings after which something must be wrong: forms that follow each other grow TIMES-fold.
ROUNDS = 8


# one state in a task


class Acceptor:
    """The minimal deterministic acceptor of some words. A state is a tuple of its letters, targets and whether words end there."""

    def __init__(self, words: Iterable[str]):
        """words come sorted and without repeats. States that accept the same rests are one state."""
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}

        def state(arcs: dict[str, int], final: bool) -> int:
            key = (final, *arcs.items())
            if key not in known:
                known[key] = len(self.arcs)
                self.arcs.append(arcs)
                self.final.append(final)
            return known[key]

        path: list[tuple[str, dict[str, int], bool]] = [("", {}, False)]  # the last word's letters and open states
        last = ""

        def close(length: int) -> None:
            while len(path) > length + 1:
                letter, arcs, final = path.pop()
                path[-1][1][letter] = state(arcs, final)

        for word in words:
            common = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                common += 1
            close(common)
            path += [(letter, {}, False) for letter in word[common:]]
            letter, arcs, _ = path[-1]
            path[-1] = letter, arcs, True
            last = word
        close(0)
        self.start = state(path[0][1], path[0][2])


def common_rests(machine: Acceptor, one: int, other: int, fruitless: set[tuple[int, int]]) -> Iterator[str]:
    """The words that both states accept: paths through pairs of states. Pairs that lead nowhere are remembered."""
    if (one, other) in fruitless:
        return
    stack: list[tuple[int, int, str, bool]] = [(one, other, "", False)]
    open_pairs: list[list] = []  # pairs on the way, and whether a word was found below
    while stack:
        a, b, rest, leaving = stack.pop()
        if leaving:
            pair, found = open_pairs.pop()
            if not found:
                fruitless.add(pair)
            elif open_pairs:
                open_pairs[-1][1] = True
            continue
        if (a, b) in fruitless:
            continue
        ends = machine.final[a] and machine.final[b]
        open_pairs.append([(a, b), ends])
        stack.append((a, b, rest, True))
        if ends:
            yield rest
        small, large = sorted((machine.arcs[a], machine.arcs[b]), key=len)
        stack += [(machine.arcs[a][c], machine.arcs[b][c], rest + c, False) for c in small if c in large]


def one_edit_pairs(machine: Acceptor, before: str = "") -> Iterator[tuple[str, str]]:
    """Accepted pairs of acceptor, one-edit transducer and acceptor, each pair once, the longer or greater word first.

    Up to the edit both sides are in the same state; there they take different arcs (a replacement) or
    one of them alone takes an arc (a deletion); after it they must accept the same rest. Of a run of
    equal letters the first counts as deleted. before is the letter in front of the start.
    """
    fruitless: set[tuple[int, int]] = set()
    stack = [(machine.start, "", before)]
    while stack:
        state, prefix, last = stack.pop()
        arcs = sorted(machine.arcs[state].items())
        for k, (letter, target) in enumerate(arcs):
            for less, other in arcs[:k]:
                for rest in common_rests(machine, target, other, fruitless):
                    yield prefix + letter + rest, prefix + less + rest
            if letter != last:
                for rest in common_rests(machine, target, state, fruitless):
                    yield prefix + letter + rest, prefix + rest
            stack.append((target, prefix + letter, letter))


def accepted_pairs(words: pa.Table) -> pa.Table:
    """The pairs of the words that share a state, which is a prefix."""
    state = words["state"][0].as_py()
    rests = sorted(w[len(state) :] for w in words["word"].to_pylist())
    pairs = [(state + a, state + b) for a, b in one_edit_pairs(Acceptor(rests), state[-1:])]
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.string()), "b": pa.array([p[1] for p in pairs], pa.string())})


# on Spark


def near_words(vocabulary: DataFrame) -> DataFrame:
    """Pairs (a, b) of words of which one insertion, deletion or replacement of a code point makes the other; each pair once.

    vocabulary has word, without nulls and repeats. The machine that accepts such pairs is the vocabulary's acceptor,
    composed with a one-edit transducer and the acceptor again. Its start and every state (a prefix) that more than
    STATE_WORDS words pass are taken apart on Spark: an edit there leaves equal rests behind equal prefixes, which meet
    by a shuffle. Two words that differ by a replacement have the same key, one that loses a letter the key of the word
    that it becomes; a key has no more words than there are letters, plus one. What remains are states of few words; each is a partition
    with a minimal acceptor of its own, in which pairs are enumerated. Below DEPTH letters prefixes that are still
    full, however many words have them, are taken apart at every place to come.
    """
    length = F.length("word")
    passed = vocabulary.select("word", F.explode(F.sequence(F.lit(1), F.least(length, F.lit(DEPTH)))).alias("depth")).select(
        "word", "depth", F.expr("left(word, depth)").alias("prefix")
    )
    full = passed.groupBy("prefix").count().filter(F.col("count") > STATE_WORDS).select("prefix")
    opened = passed.join(full, "prefix").groupBy("word").agg(F.max("depth").alias("opened"))
    # so many letters are taken apart: all of them below DEPTH
    cut = written(vocabulary.select("word").join(opened, "word", "left").select(
        "word", F.when(F.col("opened") >= DEPTH, length + 1).otherwise(F.coalesce("opened", F.lit(0)) + 1).alias("cut")
    ))
    at = F.col("at")
    places = cut.select("word", F.explode(F.expr("sequence(1, least(cut, length(word) + 1))")).alias("at"))
    letter, prefix = F.substring("word", at, F.lit(1)), F.expr("left(word, at - 1)")
    lost = places.filter(at <= length).select(
        prefix.alias("prefix"), F.expr("substring(word, at + 1)").alias("rest"), "word", letter.alias("letter"),
        ((at == 1) | (letter != F.substring("word", at - 1, F.lit(1)))).alias("first")
    )
    whole = places.select(prefix.alias("prefix"), F.expr("substring(word, at)").alias("rest"), "word", F.lit("").alias("letter"), F.lit(False).alias("first"))
    keyed = lost.unionByName(whole).groupBy("prefix", "rest").agg(F.array_sort(F.collect_list(F.struct("letter", "word", "first"))).alias("words")).filter(
        F.size("words") > 1
    )
    shorter = F.filter("words", lambda w: w["letter"] == "")
    longer = F.filter("words", lambda w: w["letter"] != "")
    replaced = F.flatten(F.transform(longer, lambda x: F.transform(
        F.filter(longer, lambda y: y["letter"] < x["letter"]), lambda y: F.struct(x["word"].alias("a"), y["word"].alias("b"))
    )))
    deleted = F.flatten(F.transform(shorter, lambda y: F.transform(F.filter(longer, lambda x: x["first"]), lambda x: F.struct(x["word"].alias("a"), y["word"].alias("b")))))
    apart = keyed.select(F.explode(F.concat(replaced, deleted)).alias("pair")).select("pair.a", "pair.b")
    inside = cut.filter(F.col("cut") <= length).select(F.expr("left(word, cut)").alias("state"), "word")
    return apart.unionByName(inside.groupBy("state").applyInArrow(accepted_pairs, "a string, b string"))


def grouped_variants(words: DataFrame) -> DataFrame:
    """words (word, n) with the forms that they are variants of: word, form, root, n, n_near, form_n.

    Near words differ by one inserted, deleted or replaced code point; n_near counts them. A word's form is its
    near word of the largest n (ties: the least in code-point order), if that n is TIMES as large at least, else null;
    form_n is its n. root follows forms to the last, and is the word itself where there is none.
    """
    words = written(words.select("word", "n"))
    pairs = written(near_words(words))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rated = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = rated.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("minus"), F.col("b").alias("near"))).alias("best"))
    is_form = F.col("form_n") >= TIMES * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.minus")).alias("form_n"))
    variants = written(found.withColumns({"form": F.when(is_form, F.col("form")), "form_n": F.when(is_form, F.col("form_n"))}))
    roots = written(variants.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    for _ in range(ROUNDS):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if roots.join(further, "root", "left_semi").isEmpty():
            out = variants.join(roots, "word", "left")
            return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        old, roots = roots, written(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        discard(old)
    raise RuntimeError(f"roots haven't settled after {ROUNDS} doublings")


def misspelled_words(docs: DataFrame) -> DataFrame:
    """The words of documents with their counts (word, n), after a fixed share of runs has lost a code point.

    A word is a maximal run of LETTERS, in which only A-Z become small. Where ONE_IN divides the crc32 of doc_id:run, h,
    the code point h modulo the run's length is deleted. Words of fewer than LEAST_LENGTH code points or LEAST_COUNT
    occurrences don't count. A null text has no words; a null doc_id counts as an empty one; other columns are ignored.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(LETTERS), F.lit(0))).alias("run")
    )
    # a run loses one letter at most, so shorter ones can't become words that count
    told = runs.filter(F.length("run") >= LEAST_LENGTH).withColumn("h", F.crc32(F.encode(F.concat("doc", F.lit(":"), "run"), "utf-8")))
    place = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.left("run", place), F.substring("run", place + 2, F.length("run")))
    words = told.select(F.when(F.col("h") % ONE_IN == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


#: The same over documents in DuckDB's SQL, by joins on words without a letter.
SQL = f"""
WITH runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
told AS (SELECT doc, run, count(*) AS times FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, times, {crc32_sql("(doc || ':' || run)")} AS h FROM told, {CRC32_TABLE_SQL}),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spelt GROUP BY word HAVING sum(times) >= 5 AND length(word) >= 6),
lost AS (SELECT word, p, left(word, p - 1) AS a, substr(word, p + 1) AS b FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM words)),
pairs AS (SELECT x.word AS w, y.word AS v FROM lost x JOIN lost y USING (p, a, b) WHERE x.word <> y.word
  UNION SELECT lost.word, words.word FROM lost JOIN words ON words.word = a || b UNION SELECT words.word, lost.word FROM lost JOIN words ON words.word = a || b),
rated AS (SELECT w, v, n, row_number() OVER (PARTITION BY w ORDER BY n DESC, v) AS place, count(*) OVER (PARTITION BY w) AS n_near FROM pairs JOIN words ON v = word),
formed AS (SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN rated.n >= 5 * words.n THEN v END AS form,
  CASE WHEN rated.n >= 5 * words.n THEN rated.n END AS form_n FROM words LEFT JOIN rated ON w = word AND place = 1),
chains AS (WITH RECURSIVE c AS (SELECT word, word AS root FROM formed UNION ALL SELECT c.word, f.form FROM c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL) SELECT * FROM c)
SELECT formed.word, formed.form, root, n, n_near, form_n FROM formed JOIN chains USING (word) WHERE root NOT IN (SELECT word FROM formed WHERE form IS NOT NULL)
"""
