"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from sparkward.llm import registry, spelling_variants

DOCS = "doc_id long, text string, word string, n int"


def near(a, b):
    """Whether a and b are at one edit, by the definition."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def counted(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def grouped(counts):
    neighbours = {w: [] for w in counts}
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    for w in counts:
        for k in (len(w), len(w) + 1):
            for v in by_length.get(k, []):
                if near(w, v) and (k > len(w) or w < v):
                    neighbours[w].append(v)
                    neighbours[v].append(w)
    form = {}
    for w, vs in neighbours.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(neighbours[w]), None if form[w] is None else counts[form[w]])
    return out


def result(frame):
    rows = frame.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def some_words(seed, n, letters="abéz", longest=9):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))) for _ in range(n)}


def brute_pairs(words):
    return {(max(a, b, key=lambda w: (len(w), w)), min(a, b, key=lambda w: (len(w), w))) for a in words for b in words if a < b and near(a, b)}


@pytest.mark.parametrize("seed", range(4))
def test_acceptor_and_pairs(seed):
    words = some_words(seed, 300) | {""}
    machine = spelling_variants.Acceptor(sorted(words))
    accepted, stack = set(), [(machine.start, "")]
    while stack:
        state, prefix = stack.pop()
        if machine.final[state]:
            accepted.add(prefix)
        stack += [(t, prefix + c) for c, t in machine.arcs[state].items()]
    assert accepted == words
    rests = {}
    for state in range(len(machine.arcs)):
        language, stack = [], [(state, "")]
        while stack:
            at, prefix = stack.pop()
            language += [prefix] * machine.final[at]
            stack += [(t, prefix + c) for c, t in machine.arcs[at].items()]
        assert rests.setdefault(tuple(sorted(language)), state) == state  # no two states accept the same
    pairs = list(spelling_variants.one_edit_pairs(machine))
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute_pairs(words)


@pytest.mark.parametrize(("state_words", "depth"), [(4096, 8), (20, 8), (3, 3), (0, 2)])
def test_pairs_however_states_are_cut(spark, monkeypatch, state_words, depth):
    monkeypatch.setattr(spelling_variants, "STATE_WORDS", state_words)
    monkeypatch.setattr(spelling_variants, "DEPTH", depth)
    words = some_words(11, 400) | {"aaaaaa", "aaaaaaa", "aaabaaa", "x" * 3000, "x" * 3001}
    pairs = spelling_variants.near_words(spark.createDataFrame([(w,) for w in sorted(words)], "word string").repartition(3)).collect()
    assert len(pairs) == len(set(pairs)) and {tuple(p) for p in pairs} == brute_pairs(words)


def test_variants_of_documents(spark):
    rng = random.Random(3)
    base = sorted(w for w in some_words(5, 60, "abcdeéÀ×Zq", 12) if len(w) >= 5)
    weights = [rng.random() ** 6 * 40 for _ in base]
    rows = [(i, " ".join(rng.choices(base, weights, k=80)) + f" {base[0]}-{base[1]}.{base[2]}1") for i in range(120)]
    rows += [(None, " ".join(base)), (500, None), (501, ""), (502, "\n 123 "), (7, " ".join(base * 60)), (7, " ".join(base * 60))]
    got = result(spelling_variants.grouped_variants(spelling_variants.misspelled_words(spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS))))
    assert got == grouped(counted(rows)) and len(got) > 30


def test_chains_of_forms(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "bbbbbb": 78125, "cccccc": 5, "ccccccd": 24}
    got = result(spelling_variants.grouped_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == grouped(counts) and got["aaaaaa"][1] == "bbbbbb" and got["cccccc"][:2] == (None, "cccccc")


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert spelling_variants.grouped_variants(spelling_variants.misspelled_words(docs)).count() == 0


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert result(registry.op13_spelling_variants(spark, "/root/testdata/sf0.001")) == grouped(counted(rows))
