"""Detection, masking and scoring of personal data in text, all in built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import PII_TYPES, SENSITIVE_KEYWORDS, SIMPLE_PATTERNS

#: What a text must contain for a pattern to be worth trying.
PREFILTERS = {
    "EMAIL": "@", "CREDIT_CARD": r"(?:[0-9][ -]*){13}", "ADDRESS": r"[0-9]{5}", "DATE_OF_BIRTH": r"[0-9]{2}",
    "PASSPORT_NUMBER": r"[0-9]{8}", "IP_ADDRESS": r"[0-9]\.[0-9]"
}
DIGITS = r"[0-9]{4}"
#: Elements of a part of a fold at least, and characters of a block of a text.
PART, BLOCK = 64, 512
ENTITY = "array<struct<entity_type:string,value:string,start:int,end:int,confidence:double>>"


def matches(text: Column, kind: str, pattern: str) -> Column:
    """All matches of a pattern; texts that can't have one are skipped."""
    return F.when(
        text.rlike(PREFILTERS.get(kind, DIGITS)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ).otherwise(F.array().cast("array<string>"))


def entities(text: Column) -> Column:
    """All matches of all types with their offsets: what lies between them gives where they start."""
    return F.concat(*(located(text, *kind) for kind in PII_TYPES))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, although lambdas in f use it for each element."""
    return F.transform(F.array(value), f)[0]


def folded(items: Column, carry: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], last: Callable[[Column], Column] | None = None) -> Column:
    """What a pass over items gives out: step takes the carry and an item and gives the next carry and an array of what is given out.

    A fold copies all it holds at every step, so one that appends to an array takes quadratic time. Here items are
    cut into parts of the root of their number: a fold over a part gives out a short array, and a fold over the parts has as few steps.
    kind is the type of what is given out, an array; last gives what is left in the carry.
    """
    empty = F.array().cast(kind)

    def advance(a: Column, item: Column) -> Column:
        after, given = step(a["carry"], item)
        return F.struct(after.alias("carry"), F.concat(a["out"], given).alias("out"))

    def over_part(a: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(a["carry"].alias("carry"), empty.alias("out")), advance)
        return let(inner, lambda r: F.struct(r["carry"].alias("carry"), F.concat(a["out"], r["out"]).alias("out")))

    def over_all(xs: Column) -> Column:
        size = F.greatest(F.lit(PART), F.ceil(F.sqrt(F.size(xs))).cast("int"))
        starts = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
        parts = let(size, lambda n: F.transform(starts, lambda i: F.slice(xs, i * n + 1, n)))
        end = (lambda a: F.concat(a["out"], last(a["carry"]))) if last else (lambda a: a["out"])
        return F.aggregate(parts, F.struct(carry.alias("carry"), empty.alias("out")), over_part, end)

    return let(items, over_all)


def located(text: Column, kind: str, label: str, pattern: str, confidence: float) -> Column:
    """The matches of one type with their offsets, in one pass over what lies between them and how long they are."""
    values, gaps = matches(text, kind, pattern), F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.filter(F.zip_with(gaps, values, lambda g, v: F.struct(g.alias("gap"), v.alias("value"))), lambda p: p["value"].isNotNull())

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        start = at + p["gap"]
        end = start + F.length(p["value"])
        one = F.struct(
            F.lit(label).alias("entity_type"), p["value"].alias("value"), start.alias("start"), end.alias("end"),
            F.lit(confidence).alias("confidence")
        )
        return end, F.array(one).cast(ENTITY)

    return F.when(F.size(values) > 0, folded(pairs, F.lit(0), ENTITY, step)).otherwise(F.array().cast(ENTITY))


def labelled(text: Column, kind: str, label: str, pattern: str) -> Column:
    """The matches of one type with its label."""
    return F.transform(matches(text, kind, pattern), lambda v: F.struct(F.lit(label).alias("entity_type"), v.alias("value")))


def sweep(found: Column) -> Column:
    """Resolves overlaps: from left to right, the more confident one stays, of equally confident ones the longer."""
    ordered = F.array_sort(
        found,
        lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(0)
    )
    length = lambda e: e["end"] - e["start"]
    none = F.array().cast(ENTITY)

    def step(kept: Column, e: Column) -> tuple[Column, Column]:
        """kept has the one entity that may yet give way, if any."""
        last, one = F.get(kept, F.lit(0)), F.array(e).cast(ENTITY)
        better = (e["confidence"] > last["confidence"]) | ((e["confidence"] == last["confidence"]) & (length(e) > length(last)))
        apart = e["start"] >= last["end"]
        return F.when((F.size(kept) == 0) | apart | better, one).otherwise(kept), F.when((F.size(kept) > 0) & apart, kept).otherwise(none)

    return folded(ordered, none, ENTITY, step, lambda kept: kept)


def plausible(found: Column) -> Column:
    """Without person names of two characters or less."""
    return F.filter(found, lambda e: ~((e["entity_type"] == "Person Name") & (F.length(e["value"]) <= 2)))


def mask(value: Column, kind: Column) -> Column:
    """The masked form of a value by its type."""
    n = F.length(value)
    user = F.substring_index(value, "@", 1)
    tail = F.when(n >= 4, F.concat(F.expr("''"), F.substring(value, F.lit(1), n - 4), F.lit("****"))).otherwise("****")
    email = F.when(
        value.contains("@") & (F.length(user) > 1),
        F.concat(F.substring(value, 1, 1), F.lit("***@"), F.substring(value, F.locate("@", value) + 1, n))
    ).otherwise("****@****.com")
    address = F.when(value.contains(","), F.concat(F.lit("****,"), F.substring(value, F.locate(",", value) + 1, n))).otherwise("****,")
    name = F.concat_ws(
        " ",
        F.transform(F.split(value, " "), lambda w: F.when(F.length(w) > 1, F.concat(F.substring(w, 1, 1), F.lit("***"))).otherwise("*"))
    )
    plain = F.when(n > 2, F.concat(F.substring(value, 1, 1), F.lit("****"), F.substring(value, n, F.lit(1)))).otherwise("****")
    return F.when(
        kind.contains("SSN") | kind.contains("Social Security") | kind.contains("Credit Card"), tail
    ).when(kind.contains("Email"), email).when(kind.contains("Phone"), tail).when(kind.contains("Address"), address).when(kind.contains("Name"), name).otherwise(plain)


def between(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from start to end of a text that is cut into blocks of BLOCK characters."""
    first, last = (F.floor(x / BLOCK).cast("int") for x in (start, end))
    block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    across = F.concat(
        F.substring(block(first), start - first * BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        F.substring(block(last), F.lit(1), end - last * BLOCK)
    )
    return F.when(first == last, F.substring(block(first), start - first * BLOCK + 1, end - start)).otherwise(across)


def redact(text: Column, swept: Column) -> Column:
    """The text with every span masked. The text is cut into blocks, since a substring is counted out from the beginning."""
    def parts(blocks: Column, spans: Column) -> Column:
        ends = F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0))
        return F.concat(
            F.flatten(F.transform(spans, lambda e, i: F.array(between(blocks, F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)), e["start"]), mask(e["value"], e["entity_type"])))),
            F.array(between(blocks, ends, F.length(text)))
        )

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(text.isNotNull(), F.array_join(let(blocks, lambda b: let(swept, lambda s: parts(b, s))), ""))


def short_mask(value: Column, kind: str) -> Column:
    """The masked form of the simple detector."""
    n = F.length(value)
    last = F.substring(value, n - 3, F.lit(4))
    other = F.when(
        n > 4, F.concat(F.substring(value, 1, 2), F.lit("***"), F.substring(value, n - 1, F.lit(2)))
    ).otherwise(F.concat(F.substring(value, 1, 1), F.lit("***")))
    if kind == "credit_card":
        return F.when(n > 8, F.concat(F.substring(value, 1, 4), F.lit("****"), last)).otherwise(other)
    if kind == "ssn":
        return F.when(n > 5, F.concat(F.lit("***-**-"), last)).otherwise(other)
    if kind == "email":
        return F.when(
            value.contains("@"),
            F.concat(F.substring(F.substring_index(value, "@", 1), 1, 3), F.lit("***@"), F.substring_index(value, "@", -1))
        ).otherwise(other)
    return other


def simple_count(text: Column) -> Column:
    """Number of matches of the simple detector."""
    hints = {"email": "@", "credit_card": r"(?:[0-9][ -]*){13}"}
    counts = [F.when(text.rlike(hints.get(kind, "[0-9]")), F.regexp_count(text, F.lit(pattern))).otherwise(0) for kind, pattern in SIMPLE_PATTERNS]
    return sum(counts[1:], counts[0])


def keyword_hits(text: Column, most: int = 10) -> Column:
    """The first sensitive keywords, in the order of their list, that a text has."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.slice(F.filter(F.array(*map(F.lit, SENSITIVE_KEYWORDS)), lambda k: low.contains(k)), 1, most)


#: Labels that entities of a text model may have.
KNOWN_LABELS = (*(label for _, label, *_ in PII_TYPES), "Person Name", "Organization", "Location", "Date")


def known_entities(found: Column, labels: tuple[str, ...] = KNOWN_LABELS) -> Column:
    """The entities of a text model whose label is known."""
    return F.filter(found, lambda e: e["entity_type"].isin(*labels))


def sensitivity_counts(text: Column, low: Column) -> tuple[Column, Column]:
    """Matched keywords and matches of a text; low is the text in lower case, which a projection before should make."""
    low = F.coalesce(low, F.lit(""))
    words = [low.contains(k).cast("int") for k in SENSITIVE_KEYWORDS]
    return sum(words[1:], words[0]), simple_count(F.coalesce(text, F.lit("")))


def sensitivity_score(n_chars: Column, n_keywords: Column, n_matches: Column) -> tuple[Column, Column]:
    """Score and confidence of the simple analyzer from a text's length and counts."""
    density = n_keywords / F.greatest(F.lit(1.0), F.least(F.lit(1000.0), n_chars / 100.0))
    score = F.when(n_chars == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.3 * density + 0.7 * F.least(F.lit(1.0), 0.2 * n_matches)))
    sure = 0.6 + 0.4 * score
    return score, F.when(n_chars == 0, 1.0).when(n_matches > 0, F.greatest(F.lit(0.9), sure)).otherwise(sure)


def sensitivity(text: Column) -> tuple[Column, Column, Column, Column]:
    """Matched keywords, matches, score and confidence of the simple analyzer, as one expression each."""
    clean = F.coalesce(text, F.lit(""))
    n_keywords, n_matches = sensitivity_counts(clean, F.lower(clean))
    return n_keywords, n_matches, *sensitivity_score(F.length(clean), n_keywords, n_matches)


def combined_score(score: Column, n: Column) -> Column:
    """A model's score, raised where matches speak for more."""
    return F.when((n > 0) & (score < 0.5), F.greatest(score, F.least(F.lit(0.95), 0.5 + n / 200.0))).otherwise(score)


def classify_chunks(scores: Column) -> tuple[Column, Column]:
    """Whether a document is sensitive by its chunks' scores, and how confidently: above 0.5 a chunk counts, above 0.4 the document."""
    high = F.filter(scores, lambda s: s > 0.5)
    top = F.coalesce(F.array_max(high), F.lit(0.0))
    return top > 0.4, F.when(top > 0.4, top).otherwise(F.coalesce(F.array_min(scores), F.lit(0.0)))


def token_windows(text: Column, size: int = 512, step: int = 256) -> Column:
    """Windows of words, one every step words; those at the end may lie in the one before."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.concat_ws(" ", F.slice(words, s + 1, F.lit(size))))


def char_windows(text: Column, size: int = 512, overlap: int = 256) -> Column:
    """Windows of characters that overlap."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))


def sentence_chunks(text: Column, size: int = 512) -> Column:
    """Sentences joined as long as their words are size - 2 at most; a longer sentence stands alone."""
    empty = F.array().cast("array<string>")

    def step(a: Column, s: Column) -> tuple[Column, Column]:
        """a has the sentences that are joined so far, and their words."""
        full = a["n"] + s["n"] > size - 2
        now = F.when(full | (a["now"] == ""), s["text"]).otherwise(F.concat_ws(" ", a["now"], s["text"]))
        return F.struct(now.alias("now"), F.when(full, s["n"]).otherwise(a["n"] + s["n"]).alias("n")), rest(a, full)

    def rest(a: Column, full: Column) -> Column:
        return F.when(full & (a["now"] != ""), F.array(a["now"])).otherwise(empty)

    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")
    counted = F.transform(sentences, lambda s: F.struct(s.alias("text"), F.regexp_count(s, F.lit(r"\S+")).alias("n")))
    nothing = F.struct(F.lit("").alias("now"), F.lit(0).alias("n"))
    return F.when(text.isNotNull(), folded(counted, nothing, "array<string>", step, lambda a: rest(a, F.lit(True))))


def truncated(text: Column, max_length: int = 512) -> Column:
    """The beginning that surely fits a model of so many tokens."""
    return F.substring(text, 1, int(min(max_length, 512) * 2.2 * 0.92))


def data_type(types: Column) -> Column:
    """Data type of a document by its entities' types; the first that fits."""
    has = lambda word: F.exists(types, lambda t: F.lower(t).contains(word))
    return F.when(F.size(types) == 0, "General").when(
        has("ssn") | has("social security"), "PII-SSN"
    ).when(has("credit card"), "PII-Financial").when(has("address"), "PII-Address").when(has("email"), "PII-Contact").otherwise("PII-General")


def type_counts(docs: DataFrame) -> DataFrame:
    """Matches, and documents with one, of each type over all texts: one aggregation of 28 sums, then a row for each type."""
    counted = docs.select(*(F.size(matches(F.col("text"), kind, pattern)).alias(kind) for kind, _, pattern, _ in PII_TYPES))
    sums = counted.agg(
        *(F.sum(kind).alias(kind) for kind, *_ in PII_TYPES), *(F.count_if(F.col(kind) > 0).alias(f"{kind}_docs") for kind, *_ in PII_TYPES)
    )
    rows = F.array(*(
        F.struct(F.lit(label).alias("entity_type"), F.coalesce(F.col(kind), F.lit(0)).cast("long").alias("n_matches"), F.col(f"{kind}_docs").alias("n_docs")) for kind,
        label, *_ in PII_TYPES
    ))
    return sums.select(F.inline(rows))
