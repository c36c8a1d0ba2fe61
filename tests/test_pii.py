import datetime
import re

from pyspark.sql import functions as F

from sparkward.functions import pii
from sparkward.functions.rules import PII_TYPES, SIMPLE_PATTERNS
from sparkward.operators import catalog, columns
from sparkward.plans import documents

TEXTS = [
    (1, "Mail jane.doe@example.com or 212-555-0199, card 4111111111111111, ip 10.1.2.3."),
    (2, "SSN 078-05-1120, passport B12345678, licence D1234567, born 02/29/1980."),
    (3, "Meet at 12 Main Street, Springfield, IL 62704 tomorrow."),
    (4, "Cards: 5500000000000004 340000000000009 6011000000000004."),
    (5, None), (6, ""), (7, "Nothing here."),
]


def swept(text):
    """The sweep as a loop."""
    found = []
    for _, label, pattern, confidence in PII_TYPES:
        found += [(m.start(), -confidence, k, label, m.group(), m.end()) for k, m in enumerate(re.finditer(pattern, text))]
    out = []
    for start, neg, _, label, value, end in sorted(found, key=lambda x: x[:2]):
        if not out or start >= out[-1][3]:
            out.append((label, value, start, end, -neg))
        elif -neg > out[-1][4] or (-neg == out[-1][4] and end - start > out[-1][3] - out[-1][2]):
            out[-1] = (label, value, start, end, -neg)
    return out


def test_entities_and_sweep(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    rows = df.select("doc_id", pii.sweep(pii.entities(F.col("text"))).alias("e")).collect()
    for r in rows:
        text = dict(TEXTS)[r.doc_id]
        if text is not None:
            got = [(e.entity_type, e.value, e.start, e.end, e.confidence) for e in r.e]
            assert [g[:1] + g[2:] for g in got] == [w[:1] + w[2:] for w in swept(text)]
            assert all(text[e.start : e.end] == e.value for e in r.e)


def test_masks(spark):
    cases = [
        ("4111111111111111", "Credit Card (Visa)", "411111111111****"), ("078-05-1120", "US Social Security Number", "078-05-****"),
        ("jane@x.org", "Email Address", "j***@x.org"), ("j@x.org", "Email Address", "****@****.com"),
        ("12 Main, Town", "Physical Address", "****, Town"), ("Jane D", "Person Name", "J*** *"), ("ab", "Other", "****"),
        ("abc", "Other", "a****c"), ("123", "Phone Number", "****")
    ]
    df = spark.createDataFrame(cases, "value string, kind string, expected string")
    assert df.filter(pii.mask(F.col("value"), F.col("kind")) != F.col("expected")).count() == 0
    short = spark.createDataFrame(
        [("4111111111111111",)], "v string"
    ).select(*(pii.short_mask(F.col("v"), k) for k in ("credit_card", "ssn", "phone"))).first()
    assert tuple(short) == ("4111****1111", "***-**-1111", "41***11")


def test_redacted_text_has_no_value(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    rows = df.select(
        "text", pii.sweep(pii.entities(F.col("text"))).alias("e"),
        pii.redact(F.col("text"), pii.sweep(pii.entities(F.col("text")))).alias("out")
    ).collect()
    for r in rows:
        if r.text:
            assert all(e.value not in r.out for e in r.e)
            assert bool(r.e) or r.out == r.text


def test_scores(spark):
    df = spark.createDataFrame([("",), ("my password and ssn 078-05-1120",), ("plain",)], "text string")
    rows = df.select(*(c.alias(n) for c, n in zip(pii.sensitivity(F.col("text")), ("k", "n", "s", "c"), strict=True))).collect()
    assert tuple(rows[0])[2:] == (0.0, 1.0) and rows[1].k == 2 and rows[1].n >= 1 and rows[1].c >= 0.9 and tuple(rows[2]) == (0, 0, 0.0, 0.6)
    scores = spark.createDataFrame([([0.2, 0.6],), ([0.3, 0.1],), ([],)], "s array<double>").select(*(
        c.alias(n) for c, n in zip(pii.classify_chunks(F.col("s")), "dc", strict=True)
    )).collect()
    assert [tuple(r) for r in scores] == [(True, 0.6), (False, 0.1), (False, 0.0)]


def test_chunks(spark):
    text = " ".join(str(i) for i in range(700))
    df = spark.createDataFrame([(text,), ("",)], "text string")
    a, b = df.select(pii.token_windows(F.col("text")).alias("w"), pii.char_windows(F.col("text"), 10, 4).alias("c")).collect()
    tokens = text.split()
    assert a.w == [" ".join(tokens[i : i + 512]) for i in range(0, 700, 256)] and a.c == [text[i : i + 10] for i in range(
        0, len(text), 6
    )] and (b.w, b.c) == ([], [])
    s = spark.createDataFrame([("One two. Three four five. Six.",)], "text string").select(pii.sentence_chunks(F.col("text"), 6).alias("s")).first().s
    assert s == ["One two.", "Three four five. Six."]


def test_catalog(spark):
    docs = spark.createDataFrame([(i, t, "s", len(t or "")) for i, t in TEXTS], "doc_id long, text string, source string, n_chars int")
    records = catalog.document_records(docs)
    by = {r.record_id: r for r in records.collect()}
    assert by[1].data_type == "PII-Financial" and by[5].pii_count == 0 and by[3].data_type in ("PII-Address", "PII-Financial", "PII-General")
    assert catalog.search(records, classification="SENSITIVE", limit=2).count() == 2
    nested = catalog.with_entities(records.drop("pii_count"), catalog.masked_entities(docs)).filter("record_id = 1").first()
    assert nested.pii_count == len(nested.entities) > 0
    assert catalog.statistics(records.limit(0)).count() == 0


def test_catalog_queries_look_for_all_types(spark, tmp_path):
    spark.createDataFrame(
        [(i, t, "s", len(t or "")) for i, t in TEXTS], "doc_id long, text string, source string, n_chars int"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    found = {i: [(label, v, c) for _, label, p, c in PII_TYPES for v in (m.group() for m in re.finditer(p, t or ""))] for i, t in TEXTS}
    counts = {i: len(v) for i, v in found.items()}
    assert {r.record_id: (r.pii_count, r.confidence_score) for r in documents.records(spark, str(tmp_path)).collect()} == {
        i: (len(v), max((c for *_, c in v), default=0.0)) for i, v in found.items()
    }
    risk = lambda n: "High" if n > 5 else "Medium" if n > 2 else "Low"
    assert {r.risk: (r.n_files, r.most) for r in documents.file_risk(spark, str(tmp_path)).collect()} == {k: (len(ns), max(ns)) for k in (
        "High", "Medium", "Low"
    ) if (ns := [n for n in counts.values() if risk(n) == k])}
    summary, stats = documents.scan_summary(spark, str(tmp_path)).first(), documents.catalog_stats(spark, str(tmp_path)).first()
    assert (summary.n_sensitive, summary.n_entities) == (4, sum(counts.values())) and stats.n_pii == 4
    assert {r.record_id: r.pii_count for r in documents.catalog_search(spark, str(tmp_path)).collect()} == {i: counts[i] for i in (1, 4)}
    masked = {(r.entity_type, r.value): r.masked for r in documents.pii_mask_values(spark, str(tmp_path)).collect()}
    assert set(masked) == {x[:2] for v in found.values() for x in v} and masked["US Social Security Number", "078-05-1120"] == "078-05-****"


def test_rollup_looks_for_all_patterns_in_all_columns(spark):
    cells = {
        "card": ["4111 1111 1111 1111", None, "x"], "mail": ["jane@example.com", "j@x.org", ""], "ssn": ["078-05-1120", "no", None], "host": ["10.1.2.3", None, None],
        "price": [27207.5, None, 2125550199.0], "at": [datetime.datetime(2020, 1, 2, 3, 4), None, None], "n": [62704, 1, None],
    }
    df = spark.createDataFrame(
        list(zip(*cells.values(), strict=True)), "card string, mail string, ssn string, host string, price double, at timestamp, n long"
    )
    rows = {r.column_name: r for r in columns.pii_rollup({"t": df}).collect()}
    found = {c: [{k: len(re.findall(p, str(v))) for k, p in SIMPLE_PATTERNS} for v in vs if v is not None] for c, vs in cells.items()}
    found[None] = [x for xs in found.values() for x in xs]
    assert set(rows) == set(found)
    for c, xs in found.items():
        assert rows[c].n_entities == sum(sum(x.values()) for x in xs) and rows[c].contains_sensitive == any(any(x.values()) for x in xs)
        assert all(rows[c][f"n_{k}"] == sum(x[k] > 0 for x in xs) for k, _ in SIMPLE_PATTERNS)
    assert rows["card"].n_credit_card == 1 and rows["mail"].n_email == 2 and rows["price"].n_phone == 1 and not rows["at"].contains_sensitive


def test_short_groups_of_digits(spark):
    texts = ["ref 123 456 789 012 345 end", "1-2-3 4 5 6 7 8 9 0 1 2 3", "12 34 56 78 90 12 x 34", "1 2 3 4 5 6 7 8 9 0 1 2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in df.select(
        "doc_id", pii.sweep(pii.entities(F.col("text"))).alias("e"),
        pii.redact(F.col("text"), pii.sweep(pii.entities(F.col("text")))).alias("out")
    ).collect()}
    for i, text in enumerate(texts):
        assert [(e.entity_type, e.start, e.end) for e in rows[i].e] == [(w[0], *w[2:4]) for w in swept(text)]
    assert rows[0].out == "ref 123 456 789 012**** end" and rows[1].e and rows[3].out == texts[3]
    counts = {r.entity_type: r.n_matches for r in pii.type_counts(df).collect()}
    assert counts == {label: sum(len(re.findall(p, t)) for t in texts) for _, label, p, _ in PII_TYPES}
