"""Queries over documents and column profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pii
from ..functions.rules import PII_TYPES, SENSITIVE_KEYWORDS, SIMPLE_PATTERNS
from ..operators import catalog, columns, models
from ..session import table, written


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pii_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.type_counts(table(spark, sf_dir, "documents"))


PII_TYPE_COUNTS = " UNION ALL ".join(
    f"SELECT {quoted(label)} AS entity_type, CAST(coalesce(sum(k), 0) AS BIGINT) AS n_matches, count(*) FILTER (k > 0) AS n_docs FROM (SELECT len(regexp_extract_all(text, {quoted(pattern)})) AS k FROM documents)" for _, label, pattern, _ in PII_TYPES
)


def pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", pii.plausible(pii.sweep(pii.entities(F.col("text")))).alias("e"))
    return found.select("doc_id", F.inline("e"))


def located_sql(kind: int, label: str, pattern: str, confidence: float) -> str:
    """Matches of one type with their offsets: what lies between them and how long they are tells where they start."""
    return f"""
SELECT doc_id, {kind} AS kind, {quoted(label)} AS entity_type, vals[i] AS value, {confidence}::DOUBLE AS confidence,
  CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(vals[1:i - 1], lambda v: length(v))), 0) AS INT) AS s
FROM (SELECT doc_id, vals, gaps, unnest(range(1, len(vals) + 1)) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, {quoted(pattern)}) AS vals, string_split_regex(text, {quoted(pattern)}) AS gaps
    FROM documents) WHERE len(vals) > 0)"""


FOUND = " UNION ALL ".join(located_sql(i, label, pattern, confidence) for i, (_, label, pattern, confidence) in enumerate(PII_TYPES))
#: The sweep over overlapping spans as a recursive query; swept has those that stay.
SWEPT = f"""
found AS ({FOUND}),
spans AS (SELECT *, s + length(value) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY s, confidence DESC, kind) AS n FROM found),
sweep AS (
  SELECT doc_id, n, 1 AS g, entity_type, value, s, e, confidence FROM spans WHERE n = 1
  UNION ALL
  SELECT x.doc_id, x.n, CASE WHEN x.s >= w.e THEN w.g + 1 ELSE w.g END, CASE WHEN takes THEN x.entity_type ELSE w.entity_type END, CASE
    WHEN takes THEN x.value ELSE w.value END,
    CASE WHEN takes THEN x.s ELSE w.s END, CASE WHEN takes THEN x.e ELSE w.e END, CASE WHEN takes THEN x.confidence ELSE w.confidence END
  FROM sweep w JOIN spans x ON x.doc_id = w.doc_id AND x.n = w.n + 1,
    LATERAL (SELECT x.s >= w.e OR x.confidence > w.confidence OR (x.confidence = w.confidence AND length(x.value) > length(w.value)) AS takes)),
swept AS (SELECT doc_id, g, arg_max(entity_type, n) AS entity_type, arg_max(value, n) AS value, arg_max(s, n) AS s, arg_max(e, n) AS e,
  arg_max(confidence, n) AS confidence FROM sweep GROUP BY doc_id, g)"""
PII_SPANS = f'WITH RECURSIVE {SWEPT} SELECT doc_id, entity_type, value, s AS start, CAST(e AS INT) AS "end", confidence FROM swept'


def pii_mask_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = F.concat(*(pii.labelled(F.col("text"), kind, label, pattern) for kind, label, pattern, _ in PII_TYPES))
    return docs.select(F.inline(found)).distinct().withColumn("masked", pii.mask(F.col("value"), F.col("entity_type")))


def mask_sql(kind: str, value: str) -> str:
    """The masked form of a value by its type."""
    has = lambda *words: " OR ".join(f"contains({kind}, '{w}')" for w in words)
    name = f"array_to_string(list_transform(string_split({value}, ' '), lambda w: CASE WHEN length(w) > 1 THEN substr(w, 1, 1) || '***' ELSE '*' END), ' ')"
    return f"""CASE
  WHEN {has("SSN", "Social Security", "Credit Card")} THEN CASE WHEN length({value}) >= 4 THEN substr({value}, 1, length({value}) - 4) || '****' ELSE '****' END
  WHEN {has("Email")} THEN CASE WHEN length(split_part({value}, '@', 1)) > 1 AND contains({value}, '@') THEN substr({value}, 1,
    1) || '***@' || substr({value}, instr({value}, '@') + 1) ELSE '****@****.com' END
  WHEN {has("Phone")} THEN CASE WHEN length({value}) >= 4 THEN substr({value}, 1, length({value}) - 4) || '****' ELSE '****' END
  WHEN {has("Address")} THEN CASE WHEN contains({value}, ',') THEN '****,' || substr({value}, instr({value}, ',') + 1) ELSE '****,' END
  WHEN {has("Name")} THEN {name}
  ELSE CASE WHEN length({value}) > 2 THEN substr({value}, 1, 1) || '****' || substr({value}, length({value})) ELSE '****' END END"""


PII_MASK_VALUES = (
    "WITH found AS ("
    + " UNION ".join(f"SELECT {quoted(label)} AS entity_type, unnest(regexp_extract_all(text, {quoted(pattern)})) AS value FROM documents" for _, label, pattern, _ in PII_TYPES)
    + f") SELECT entity_type, value, {mask_sql('entity_type', 'value')} AS masked FROM found"
)


def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", pii.redact(F.col("text"), pii.sweep(pii.entities(F.col("text")))).alias("text"))


PII_REDACT = f"""
WITH RECURSIVE {SWEPT},
pieces AS (SELECT doc_id, g, e, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY g), 0) AS before,
  {mask_sql('entity_type', 'value')} AS masked FROM swept),
parts AS (SELECT p.doc_id, string_agg(substr(text, before + 1, s - before) || masked, '' ORDER BY g) AS head, max(e) AS last FROM pieces p
  JOIN documents d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, CASE WHEN head IS NULL THEN text ELSE head || substr(text, last + 1) END AS text FROM documents d LEFT JOIN parts USING (doc_id)"""


EMAIL = r"\b([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Z|a-z]{2,})\b"


def pii_redact_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("row_id"), "text")
    turns = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("origin"), F.col("conv_id").alias("row_id"), "text")
    both = texts.unionByName(turns).filter(F.col("text").contains("@"))
    return both.select("origin", "row_id", F.md5(F.regexp_replace("text", EMAIL, "$1***@$2")).alias("text_md5"))


PII_REDACT_EMAIL = f"""
SELECT origin, row_id, md5(regexp_replace(text, '{EMAIL}', '\\1***@\\2', 'g')) AS text_md5
FROM (SELECT 'documents' AS origin, doc_id AS row_id, text FROM documents UNION ALL SELECT 'conversations', conv_id, text
  FROM conversations) WHERE contains(text, '@')"""


def doc_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are lowered once and counted once; scores come from the counts in projections of their own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lower("text").alias("low"))
    words, matches = pii.sensitivity_counts(F.col("text"), F.col("low"))
    counted = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars"), words.alias("n_keywords"), matches.alias("n_pii"))
    score, confidence = pii.sensitivity_score(F.col("chars"), F.col("n_keywords"), F.col("n_pii"))
    scored = counted.select("doc_id", "n_keywords", "n_pii", score.alias("raw"), confidence.alias("sure"))
    sensitive = (F.col("raw") > 0.1) | (F.col("n_pii") > 0)
    combined = F.round(pii.combined_score(F.col("raw"), F.col("n_pii")), 6)
    return scored.select(
        "doc_id", "n_keywords", "n_pii", F.round("raw", 6).alias("score"), F.round("sure", 6).alias("confidence"),
        F.when(sensitive, "SENSITIVE").otherwise("NON_SENSITIVE").alias("classification"), combined.alias("combined"),
    )


DOC_SENSITIVITY = f"""
WITH counted AS (SELECT doc_id, length(text) AS chars,
  {" + ".join(f"CAST(contains(lower(text), {quoted(k)}) AS INT)" for k in SENSITIVE_KEYWORDS)} AS n_keywords,
  {" + ".join(f"len(regexp_extract_all(text, {quoted(p)}))" for _, p in SIMPLE_PATTERNS)} AS n_pii FROM documents),
scored AS (SELECT *, CASE WHEN chars = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, 0.3::DOUBLE * (n_keywords / greatest(1.0::DOUBLE,
  least(1000.0::DOUBLE, chars / 100.0::DOUBLE))) + 0.7::DOUBLE * least(1.0::DOUBLE, 0.2::DOUBLE * n_pii)) END AS raw FROM counted)
SELECT doc_id, CAST(n_keywords AS INT) AS n_keywords, CAST(n_pii AS INT) AS n_pii, round(raw, 6) AS score,
  round(CASE WHEN chars = 0 THEN 1.0::DOUBLE WHEN n_pii > 0 THEN greatest(0.9::DOUBLE, 0.6::DOUBLE + 0.4::DOUBLE * raw)
    ELSE 0.6::DOUBLE + 0.4::DOUBLE * raw END, 6) AS confidence,
  CASE WHEN raw > 0.1 OR n_pii > 0 THEN 'SENSITIVE' ELSE 'NON_SENSITIVE' END AS classification,
  round(CASE WHEN n_pii > 0 AND raw < 0.5 THEN greatest(raw, least(0.95::DOUBLE, 0.5::DOUBLE + n_pii / 200.0::DOUBLE)) ELSE raw END,
    6) AS combined FROM scored"""


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pii.token_windows(F.col("text"))).alias("chunk_no", "chunk"))
    return chunks.select("doc_id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


DOC_CHUNKS = r"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(0, len(w), 256)) AS s FROM words)
SELECT doc_id, CAST(s // 256 AS INT) AS chunk_no, md5(array_to_string(list_slice(w, s + 1, s + 512), ' ')) AS chunk_md5 FROM spots"""


def char_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pii.char_windows(F.col("text"))).alias("chunk_no", "chunk"))
    return chunks.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


CHAR_CHUNKS = """
WITH spots AS (SELECT doc_id, text, unnest(range(0, length(text), 256)) AS s FROM documents)
SELECT doc_id, CAST(s // 256 AS INT) AS chunk_no, CAST(length(substr(text, s + 1, 512)) AS INT) AS n_chars, md5(substr(text, s + 1,
  512)) AS chunk_md5 FROM spots"""


def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pii.sentence_chunks(F.col("text"))).alias("chunk_no", "chunk"))


SENTENCE_CHUNKS = r"""
WITH RECURSIVE split AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
  lambda s: s <> '') AS ss FROM documents),
sentences AS (SELECT doc_id, ss[i] AS s, i, len(list_filter(regexp_split_to_array(ss[i], '\s+'), lambda w: w <> '')) AS k
  FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM split)),
packed AS (
  SELECT doc_id, i, 0 AS chunk_no, s AS chunk, k AS n FROM sentences WHERE i = 1
  UNION ALL
  SELECT x.doc_id, x.i, CASE WHEN p.n + x.k > 510 THEN p.chunk_no + 1 ELSE p.chunk_no END, CASE WHEN p.n + x.k > 510 THEN x.s
    ELSE p.chunk || ' ' || x.s END, CASE WHEN p.n + x.k > 510 THEN x.k ELSE p.n + x.k END
  FROM packed p JOIN sentences x ON x.doc_id = p.doc_id AND x.i = p.i + 1)
SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, arg_max(chunk, i) AS chunk FROM packed GROUP BY doc_id, chunk_no"""


KINDS = tuple(k for k, *_ in PII_TYPES)
TOTAL = " + ".join(KINDS)
#: Catalog records of documents, by all types.
CATALOG_SQL = (
    "WITH counted AS (SELECT doc_id, source, strlen(text) AS bytes, "
    + ", ".join(f"len(regexp_extract_all(text, {quoted(p)})) AS {k}" for k, _, p, _ in PII_TYPES)
    + f""" FROM documents),
records AS (SELECT doc_id AS record_id, 'unstructured' AS source_type, source AS source_location, bytes, {TOTAL} AS pii_count,
  CASE WHEN {TOTAL} = 0 THEN 'General' WHEN US_SSN > 0 THEN 'PII-SSN'
    WHEN CREDIT_CARD + VISA + MASTERCARD + AMEX + DISCOVER > 0 THEN 'PII-Financial' WHEN EMAIL + ADDRESS + IP_ADDRESS > 0 THEN 'PII-Address'
    ELSE 'PII-General' END AS data_type,
  CASE WHEN {TOTAL} > 0 THEN 'SENSITIVE' ELSE 'NON_SENSITIVE' END AS classification,
  greatest(0, {", ".join(f"CASE WHEN {k} > 0 THEN {c} ELSE 0 END" for k, _, _, c in PII_TYPES)})::DOUBLE AS confidence_score FROM counted)
"""
)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.document_records(table(spark, sf_dir, "documents"))


def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.statistics(records(spark, sf_dir))


CATALOG_STATS = CATALOG_SQL + "SELECT source_type, count(*) AS n_records, count(*) FILTER (starts_with(data_type, 'PII')) AS n_pii, count(*) FILTER (data_type = 'Financial') AS n_financial, count(*) FILTER (data_type = 'Health') AS n_health, count(*) FILTER (NOT starts_with(data_type, 'PII') AND data_type NOT IN ('Financial', 'Health')) AS n_other, round(avg(confidence_score), 4) AS avg_confidence FROM records GROUP BY source_type"


def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search(records(spark, sf_dir), data_type="PII-Financial", min_confidence=0.9, limit=100)


CATALOG_SEARCH = CATALOG_SQL + "SELECT record_id, source_type, source_location, data_type, classification, confidence_score, CAST(pii_count AS INT) AS pii_count FROM records WHERE data_type = 'PII-Financial' AND confidence_score >= 0.9 ORDER BY record_id LIMIT 100"


def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.scan_summary(table(spark, sf_dir, "documents"))


SCAN_SUMMARY = CATALOG_SQL + """SELECT source_location, count(*) AS n_files, count(*) FILTER (pii_count > 0) AS n_sensitive,
  CAST(sum(bytes) AS BIGINT) AS n_bytes, CAST(sum(pii_count) AS BIGINT) AS n_entities FROM records GROUP BY 1"""


def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of one minute, in which documents without a text failed."""
    found = catalog.document_records(table(spark, sf_dir, "documents"), carry=(F.octet_length("text").alias("bytes"),))
    return catalog.scan_totals(found.withColumn("error", F.when(F.col("bytes").isNull(), "no text")), F.lit(60.0))


SCAN_TOTALS = CATALOG_SQL + """, t AS (SELECT count(*) AS n_files, count(bytes) AS n_success, count(*) FILTER (bytes IS NULL) AS n_failed,
  count(*) FILTER (bytes IS NOT NULL AND pii_count > 0) AS n_sensitive, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS n_bytes, 60.0::DOUBLE AS seconds FROM records)
SELECT *, round(n_files / seconds, 6) AS files_per_second, round(n_bytes / 1048576.0::DOUBLE / seconds, 6) AS mb_per_second FROM t"""


def file_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.file_risk(records(spark, sf_dir))


FILE_RISK = CATALOG_SQL + "SELECT CASE WHEN pii_count > 5 THEN 'High' WHEN pii_count > 2 THEN 'Medium' ELSE 'Low' END AS risk, count(*) AS n_files, CAST(max(pii_count) AS INT) AS most FROM records GROUP BY 1"


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.profile(table(spark, sf_dir, "customer"))


def profile_sql(name: str, is_string: bool) -> str:
    s = "regexp_replace(v, '[-() ]', '', 'g')"
    flag = lambda cond: f"coalesce(bool_or({cond}), false)" if is_string else "false"
    return f"""SELECT '{name}' AS column_name, {str(any(k in name.lower() for k in columns.PROFILE_NAMES)).lower()} AS sensitive_name,
  round((count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END)) / count(*)::DOUBLE, 6) AS unique_ratio,
  round(count(*) FILTER (v IS NULL) / count(*)::DOUBLE, 6) AS null_ratio,
      {str(not is_string).lower()} AS is_numeric, {str(is_string).lower()} AS is_string,
        {"round(avg(length(coalesce(v, 'None'))), 6)" if is_string else "0.0::DOUBLE"} AS avg_length,
        {flag("contains(v, '@') AND contains(string_split(v, '@')[-1], '.')")} AS has_email,
        {flag(f"length({s}) >= 10 AND regexp_matches({s}, '^[0-9]+$')")} AS has_phone,
      {flag("length(replace(v, '-', '')) = 9 AND regexp_matches(replace(v, '-', ''), '^[0-9]+$')")} AS has_ssn,
        {flag(f"length({s}) >= 15 AND regexp_matches({s}, '^[0-9]+$')")} AS has_card,
        {flag("regexp_matches(lower(v), 'street|ave|road|dr')")} AS has_address FROM (SELECT CAST({name} AS VARCHAR) AS v FROM customer)"""


COLUMN_PROFILE = " UNION ALL ".join(
    profile_sql(n, s) for n,
    s in (("c_custkey", False), ("c_name", True), ("c_nationkey", False), ("c_acctbal", False), ("c_mktsegment", True))
)


def column_pii_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {name: table(spark, sf_dir, name) for name in TABLES}
    return columns.pii_rollup(frames)


#: The structured tables that are looked at, with their columns.
TABLES = {
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
}
NAMES = tuple(k for k, _ in SIMPLE_PATTERNS)


def cells_sql(name: str, names: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS file, '{c}' AS column_name, CAST({c} AS VARCHAR) AS v FROM {name}" for c in names)


CELLS = " UNION ALL ".join(cells_sql(name, names) for name, names in TABLES.items())
COLUMN_PII_ROLLUP = f"""
WITH cells AS ({CELLS}),
counted AS (SELECT file, column_name, {", ".join(f"coalesce(len(regexp_extract_all(v, {quoted(p)})), 0) AS {k}" for k, p in SIMPLE_PATTERNS)} FROM cells)
SELECT file, column_name, coalesce(bool_or({" + ".join(NAMES)} > 0), false) AS contains_sensitive,
  CAST(sum({" + ".join(NAMES)}) AS BIGINT) AS n_entities, {", ".join(f"count(*) FILTER ({k} > 0) AS n_{k}" for k in NAMES)},
  array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN max({k}) > 0 THEN '{k}' END" for k in NAMES)}], lambda x: x IS NOT NULL)), ',') AS types
FROM counted GROUP BY ROLLUP (file, column_name) HAVING file IS NOT NULL"""


def column_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog records of the columns of the structured tables, by the heuristic."""
    return reduce(DataFrame.unionByName, (catalog.column_records(columns.judged_columns(table(spark, sf_dir, name)), name) for name in TABLES))


HITS = r"(contains(v, '@') AND contains(v, '.')) OR length(regexp_replace(v, '[^0-9]', '', 'g')) IN (15, 16) OR regexp_matches(v, '^[0-9]{3}-?[0-9]{2}-?[0-9]{4}$')"
NAMED = " OR ".join(f"contains(lower(column_name), '{k}')" for k in columns.HEURISTIC_NAMES)
TYPED = " ".join(
    f"WHEN {' OR '.join(f'contains(lower(column_name), {quoted(w)})' for w in words)} THEN '{kind}'" for words, kind in columns.COLUMN_TYPES
)
COLUMN_RECORDS = f"""cells AS ({CELLS}),
judged AS (SELECT file, column_name, {NAMED} OR coalesce(bool_or({HITS}), false) AS hit FROM cells GROUP BY file, column_name),
column_records AS (SELECT file || '.' || column_name AS record_id, 'structured' AS source_type, file AS source_location, CASE
  WHEN NOT hit THEN 'General' {TYPED} ELSE 'General' END AS data_type,
  CASE WHEN hit THEN 'SENSITIVE' ELSE 'NON_SENSITIVE' END AS classification, CASE WHEN hit THEN 0.7
    ELSE 0.6 END::DOUBLE AS confidence_score, CAST(hit AS INT) AS pii_count FROM judged)"""


def catalog_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of structured and unstructured finds."""
    return catalog.catalog_of(records(spark, sf_dir), column_records(spark, sf_dir))


CATALOG_FIELDS = "source_type, source_location, data_type, classification, confidence_score, CAST(pii_count AS INT) AS pii_count"
CATALOG_UNION = f"{CATALOG_SQL}, {COLUMN_RECORDS} SELECT CAST(record_id AS VARCHAR) AS record_id, {CATALOG_FIELDS} FROM records UNION ALL SELECT record_id, {CATALOG_FIELDS} FROM column_records"


def table_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.table_result(column_records(spark, sf_dir))
    return found.withColumn("sensitive_columns", F.array_join("sensitive_columns", ","))


TABLE_RESULTS = f"""WITH {COLUMN_RECORDS} SELECT source_location, count(*) AS n_columns, count(*) FILTER (pii_count > 0) AS n_sensitive,
  coalesce(string_agg(split_part(record_id, '.', 2), ',' ORDER BY split_part(record_id, '.', 2)) FILTER (pii_count > 0),
    '') AS sensitive_columns FROM column_records GROUP BY 1"""


def column_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = columns.samples(table(spark, sf_dir, "customer"))
    return found.withColumn("sample_values", F.array_join("sample_values", "|"))


COLUMN_SAMPLES = f"""WITH cells AS ({cells_sql("customer", TABLES["customer"])})
SELECT column_name, array_to_string(list_slice(list_sort(list(DISTINCT v)), 1, 3), '|') AS sample_values FROM cells WHERE v IS NOT NULL GROUP BY 1"""


def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(pii.keyword_hits(F.col("text")), ",").alias("keywords")
    ).filter("keywords <> ''")


WORDS = ", ".join(map(quoted, SENSITIVE_KEYWORDS))
KEYWORD_HITS = f"""WITH k AS (SELECT doc_id, array_to_string(list_slice(list_filter([{WORDS}], lambda k: contains(lower(text), k)), 1, 10), ',') AS keywords
  FROM documents)
SELECT * FROM k WHERE keywords <> ''"""


def column_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier of columns by the features of their values, fitted on the columns of supplier, orders, part and lineitem, judges those of customer."""
    known = [table(spark, sf_dir, name) for name in ("supplier", "orders", "part", "lineitem")]
    profiles = reduce(DataFrame.unionByName, (columns.profile(df) for df in known))
    judged = reduce(DataFrame.unionByName, (columns.judged_columns(df) for df in known)).select(
        F.col("column_name").alias("c"), (F.col("classification") == "sensitive").cast("int").alias("label")
    )
    labelled = written(profiles.join(judged, F.col("column_name") == F.col("c")).drop("c", "sensitive_name"))
    model = models.fit_column_classifier(labelled)
    customer = table(spark, sf_dir, "customer")
    numbers = columns.profile(customer).select(
        "column_name", *(F.col(c).cast("double").alias(c) for c, kind in labelled.dtypes if c not in ("column_name", "label"))
    )
    scores = model.transform(numbers).select("column_name", vector_to_array("probability")[1].alias("score"))
    return columns.judged_columns(customer, scores)


QUERIES = {
    "pii_type_counts": (pii_type_counts, PII_TYPE_COUNTS), "pii_spans": (pii_spans, PII_SPANS), "pii_mask_values": (pii_mask_values, PII_MASK_VALUES), "pii_redact": (pii_redact, PII_REDACT), "pii_redact_email": (pii_redact_email, PII_REDACT_EMAIL),
    "doc_sensitivity": (doc_sensitivity, DOC_SENSITIVITY), "doc_chunks": (doc_chunks, DOC_CHUNKS), "char_chunks": (char_chunks, CHAR_CHUNKS), "sentence_chunks": (sentence_chunks, SENTENCE_CHUNKS),
    "catalog_stats": (catalog_stats, CATALOG_STATS), "catalog_search": (catalog_search, CATALOG_SEARCH), "scan_summary": (scan_summary, SCAN_SUMMARY), "file_risk": (file_risk, FILE_RISK), "column_profile": (column_profile, COLUMN_PROFILE), "column_pii_rollup": (column_pii_rollup, COLUMN_PII_ROLLUP),
    "scan_totals": (scan_totals, SCAN_TOTALS), "catalog_union": (catalog_union, CATALOG_UNION), "table_results": (table_results, TABLE_RESULTS), "column_samples": (column_samples, COLUMN_SAMPLES),
    "keyword_hits": (keyword_hits, KEYWORD_HITS), "column_classifier": (column_classifier, None),
}
