"""Queries over released tables, pseudonyms, audit chains and federated averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.protect import decrypt, encrypt, hmac_sha256, protected
from ..operators import anonymize, audit
from ..session import table

QIS = ("c_nationkey", "c_mktsegment")
SEGMENTS = (
    ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), ("GOODS", "GOODS", "HOME", "HOME", "GOODS"),
    ("ANY", "ANY", "ANY", "ANY", "ANY")
)
CONFIG = anonymize.Config(
    quasi_identifiers=QIS, sensitive=("band",), key="c_custkey", k=10, l=3, t=0.35, epsilon=2.0, rate=0.1, seed="7",
    hierarchies={"c_mktsegment": SEGMENTS}
)
KS = anonymize.Config(quasi_identifiers=QIS, sensitive=("c_acctbal",), key="c_custkey", k=10, t=0.5)
SALT, AES = b"an example of a salt", b"0123456789abcdef"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumn("band", F.concat(F.lit("b"), F.floor(F.col("c_acctbal") / 2000).cast("string")))


C = "c AS (SELECT *, 'b' || CAST(floor(c_acctbal / 2000) AS BIGINT) AS band FROM customer)"
K = "k AS (SELECT c.* FROM c JOIN (SELECT c_nationkey, c_mktsegment FROM c GROUP BY ALL HAVING count(*) >= 10) USING (c_nationkey, c_mktsegment))"
KEEP = "SELECT c_custkey, c_nationkey, c_mktsegment"
KEPT = ["c_custkey", *QIS]


def k_anonymity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize.k_anonymous(customers(spark, sf_dir), CONFIG).select(KEPT)


def l_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize.l_diverse(customers(spark, sf_dir), CONFIG).select(KEPT)


def diverse(source: str) -> str:
    return f"(SELECT c_nationkey, c_mktsegment FROM (SELECT c_nationkey, c_mktsegment, band, count(*) AS n FROM {source} GROUP BY ALL) GROUP BY c_nationkey, c_mktsegment HAVING count(band) >= 3 AND max(n) FILTER (band IS NOT NULL) <= sum(n) / 3.0::DOUBLE)"


L_DIVERSITY = f"WITH {C} {KEEP} FROM c JOIN {diverse('c')} USING (c_nationkey, c_mktsegment)"


def t_closeness_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = customers(spark, sf_dir)
    return anonymize.category_distances(df, CONFIG, "band").select(*QIS, F.round("distance", 6).alias("distance"))


def distance(source: str) -> str:
    return f"""(SELECT c_nationkey, c_mktsegment, sum(abs(coalesce(n, 0) / size::DOUBLE - p)) / 2 AS distance FROM (SELECT c_nationkey, c_mktsegment,
  count(*) AS size FROM {source} GROUP BY ALL) g
  CROSS JOIN (SELECT band, count(*) / (SELECT count(*) FROM {source})::DOUBLE AS p FROM {source} GROUP BY band) w LEFT
    JOIN (SELECT c_nationkey, c_mktsegment, band, count(*) AS n FROM {source} GROUP BY ALL) x USING (c_nationkey, c_mktsegment, band)
    GROUP BY ALL)"""


T_CLOSENESS_CAT = f"WITH {C} SELECT c_nationkey, c_mktsegment, round(distance, 6) AS distance FROM {distance('c')}"


def t_closeness_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize.ks_statistics(customers(spark, sf_dir), KS, "c_acctbal").select(*QIS, F.round("statistic", 6).alias("statistic"), "size")


T_CLOSENESS_KS = """WITH v AS (SELECT c_acctbal AS x, sum(count(*)) OVER (ORDER BY c_acctbal) / (SELECT count(*) FROM customer)::DOUBLE AS f FROM customer
  GROUP BY c_acctbal),
g AS (SELECT c_nationkey, c_mktsegment, count(*) AS size FROM customer GROUP BY ALL),
s AS (SELECT g.*, v.x, v.f, (sum(coalesce(n, 0)) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY v.x)) / size::DOUBLE AS h
  FROM g CROSS JOIN v LEFT JOIN (SELECT c_nationkey, c_mktsegment, c_acctbal AS x, count(*) AS n FROM customer
  GROUP BY ALL) USING (c_nationkey, c_mktsegment, x))
SELECT c_nationkey, c_mktsegment, round(max(abs(h - f)), 6) AS statistic, size FROM s GROUP BY c_nationkey, c_mktsegment, size"""


def generalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize.generalized(customers(spark, sf_dir), CONFIG).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


GENERAL = f"CASE {' '.join(f'WHEN c_mktsegment = {a!r} THEN {b!r}' for a, b in zip(*SEGMENTS[:2], strict=True))} ELSE c_mktsegment END"
GENERALIZE = f"SELECT {GENERAL} AS c_mktsegment, count(*) AS n FROM customer GROUP BY 1"


def suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize.suppressed(customers(spark, sf_dir), CONFIG).select(KEPT)


def hidden(name: str) -> str:
    return f"CASE WHEN row_number() OVER (ORDER BY md5(c_custkey || '|{name}|7')) <= floor(count(*) OVER () * 0.1::DOUBLE) THEN '*' ELSE CAST({name} AS VARCHAR) END AS {name}"


SUPPRESS = f"SELECT c_custkey, {hidden('c_nationkey')}, {hidden('c_mktsegment')} FROM customer"


def laplace_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = anonymize.noisy(customers(spark, sf_dir), CONFIG, ("c_acctbal",))
    return noisy.select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"))


NOISE = "greatest(1e-12::DOUBLE, least(1 - 1e-12::DOUBLE, ('0x' || substr(md5(c_custkey || ':c_acctbal:7'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE))"
LAPLACE = f"WITH u AS (SELECT c_custkey, c_acctbal, {NOISE} AS u, (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) / 2.0::DOUBLE AS b FROM customer) SELECT c_custkey, round(c_acctbal - b * sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5)), 4) AS c_acctbal FROM u"


def privacy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = customers(spark, sf_dir)
    return anonymize.metrics(df, anonymize.k_anonymous(df, CONFIG), CONFIG, "c_acctbal")


PRIVACY_METRICS = f"""WITH {C}, {K} SELECT (SELECT count(*) FROM c) AS n_before, count(*) AS n_after, round(count(*) / (SELECT count(*) FROM c)::DOUBLE,
  6) AS retention, 1.0::DOUBLE AS column_retention, (SELECT min(n) FROM (SELECT count(*) AS n FROM k GROUP BY c_nationkey,
  c_mktsegment)) AS min_group,
  (SELECT min(n) >= 10 FROM (SELECT count(*) AS n FROM k GROUP BY c_nationkey, c_mktsegment)) AS k_holds,
    round(var_samp(c_acctbal) / (SELECT var_samp(c_acctbal) FROM c), 6) AS variance_ratio FROM k"""


def anonymize_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize.release(customers(spark, sf_dir), CONFIG, ("generalization", "k", "l", "t")).select(KEPT)


ANONYMIZE_PIPELINE = f"""WITH c0 AS (SELECT c_custkey, c_nationkey, {GENERAL} AS c_mktsegment, 'b' || CAST(floor(c_acctbal / 2000) AS BIGINT) AS band FROM customer),
k AS (SELECT c0.* FROM c0 JOIN (SELECT c_nationkey, c_mktsegment FROM c0 GROUP BY ALL HAVING count(*) >= 10) USING (c_nationkey, c_mktsegment)),
l AS (SELECT k.* FROM k JOIN {diverse('k')} USING (c_nationkey, c_mktsegment)) {KEEP} FROM l JOIN {distance('l')} USING (c_nationkey,
  c_mktsegment) WHERE distance <= 0.35"""


def release_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six steps of a release in order."""
    out = anonymize.release(customers(spark, sf_dir), CONFIG, noise=("c_acctbal",))
    return out.select(*KEPT, F.round("c_acctbal", 4).alias("c_acctbal"))


RELEASE_ALL = f"""WITH {C}, s AS (SELECT c_custkey, {hidden('c_nationkey')}, {hidden('c_mktsegment')}, c_acctbal, band FROM c),
g AS (SELECT c_custkey, c_nationkey, {GENERAL} AS c_mktsegment, c_acctbal, band FROM s),
k AS (SELECT g.* FROM g JOIN (SELECT c_nationkey, c_mktsegment FROM g GROUP BY ALL HAVING count(*) >= 10) USING (c_nationkey, c_mktsegment)),
l AS (SELECT k.* FROM k JOIN {diverse('k')} USING (c_nationkey, c_mktsegment)),
t AS (SELECT l.* FROM l JOIN {distance('l')} USING (c_nationkey, c_mktsegment) WHERE distance <= 0.35),
u AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, {NOISE} AS u, (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) / 2.0::DOUBLE AS b FROM t)
SELECT c_custkey, c_nationkey, c_mktsegment, round(c_acctbal - b * sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5)), 4) AS c_acctbal FROM u"""
SETTINGS = ((3, 0.5), (5, 1.0), (10, 2.0), (15, 4.0))


def privacy_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize.sweep(customers(spark, sf_dir), CONFIG, SETTINGS, "c_acctbal")


PRIVACY_SWEEP = " UNION ALL ".join(
    f"""SELECT CAST({k} AS INT) AS k, {e}::DOUBLE AS epsilon, count(*) AS rows_kept, round(avg(abs(b * ln(1 - 2 * abs(u - 0.5)))), 4) AS mean_noise FROM
  (SELECT {NOISE} AS u, (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) / {e}::DOUBLE AS b FROM customer JOIN (SELECT c_nationkey,
    c_mktsegment FROM customer GROUP BY ALL HAVING count(*) >= {k}) USING (c_nationkey, c_mktsegment))"""
    for k, e in SETTINGS
)


def privacy_tradeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize.tradeoff(customers(spark, sf_dir), CONFIG, (3, 5, 10, 15))


PRIVACY_TRADEOFF = "WITH s AS (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) SELECT k, CAST(sum(CASE WHEN n >= k THEN n ELSE 0 END) AS BIGINT) AS rows_kept FROM s, (VALUES (3), (5), (10), (15)) v(k) GROUP BY k"


def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.pseudonyms(customers(spark, sf_dir), "c_name", SALT).select("c_custkey", "pseudonym")


def sql_hmac(value: str) -> str:
    pads = [bytes(b ^ x for b in SALT.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]
    return f"sha256(unhex('{pads[1]}') || unhex(sha256(unhex('{pads[0]}') || encode({value}))))"


PSEUDONYMS = f"SELECT c_custkey, {sql_hmac('c_name')} AS pseudonym FROM customer"


def pseudonym_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = audit.pseudonyms(customers(spark, sf_dir), "c_name", SALT)
    claimed = df.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 10 == 0, F.sha2("c_name", 256)).otherwise(F.col("pseudonym")).alias("claimed")
    )
    return df.join(claimed, F.col("c_custkey") == F.col("id")).select(
        "c_custkey", (F.col("claimed") == hmac_sha256(SALT, F.col("c_name"))).alias("valid")
    )


PSEUDONYM_VERIFY = f"""WITH p AS (SELECT c_custkey, {sql_hmac('c_name')} AS right_one, CASE WHEN c_custkey % 10 = 0 THEN sha256(c_name)
  ELSE {sql_hmac('c_name')} END AS claimed FROM customer)
SELECT c_custkey, claimed = right_one AS valid FROM p"""


def protected_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names at the four levels of protection; the encrypted one is read again."""
    at = lambda level: protected(F.col("c_name"), level, AES, SALT)
    hidden_names = customers(spark, sf_dir).select(
        "c_custkey", at("UNPROTECTED").alias("unprotected"), at("ENCRYPTED").alias("hidden"), at("PSEUDONYMIZED").alias("pseudonymized"),
        at("ANONYMIZED").alias("anonymized")
    )
    return hidden_names.select("c_custkey", "unprotected", decrypt(F.col("hidden"), AES).alias("read_again"), "pseudonymized", "anonymized")


PROTECTED_VALUES = f"SELECT c_custkey, c_name AS unprotected, c_name AS read_again, sha256('{SALT.decode()}' || c_name) AS pseudonymized, sha256(c_name) AS anonymized FROM customer"


def encrypt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden_names = customers(spark, sf_dir).select("c_custkey", encrypt(F.col("c_name"), AES).alias("hidden"))
    return hidden_names.select(
        "c_custkey", decrypt(F.col("hidden"), AES).alias("c_name"), decrypt(F.col("hidden"), AES[::-1]).isNull().alias("wrong_key_fails")
    )


def audit_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("log_id"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("entry_id"),
        F.lit("data_access").alias("entry_type"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"),
        F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("operation")
    )


def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.build_chain(audit_entries(spark, sf_dir), SALT).select("log_id", "seq", "row_hash")


ENTRIES = """e AS (SELECT user_id AS log_id, event_id AS seq,
  '{"entry_id":"' || event_id || '","entry_type":"data_access","operation":"' || event_type || '","timestamp":"' || epoch_us(ts) || '","user_id":"' || user_id || '"}' AS body,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"""
AUDIT_CHAIN = f"""WITH RECURSIVE {ENTRIES},
chain AS (SELECT log_id, seq, n, sha256(body || '|') AS row_hash FROM e WHERE n = 1 UNION ALL SELECT e.log_id, e.seq, e.n,
  sha256(e.body || '|' || c.row_hash) FROM chain c JOIN e ON e.log_id = c.log_id AND e.n = c.n + 1)
SELECT log_id, seq, row_hash FROM chain"""


def audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain in which every thousandth entry was changed after signing."""
    chain = audit.build_chain(audit_entries(spark, sf_dir), SALT)
    changed = chain.withColumn("body", F.when(F.col("seq") % 1000 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return audit.verify_chain(changed, SALT)


AUDIT_VERIFY = f"""WITH RECURSIVE {ENTRIES},
chain AS (SELECT log_id, seq, n, body, NULL::VARCHAR AS previous, sha256(body || '|') AS h FROM e WHERE n = 1 UNION ALL SELECT e.log_id,
  e.seq, e.n, e.body, c.h, sha256(e.body || '|' || c.h) FROM chain c JOIN e ON e.log_id = c.log_id AND e.n = c.n + 1),
changed AS (SELECT log_id, seq, n, previous, h, CASE WHEN seq % 1000 = 0 THEN body || '!' ELSE body END AS body FROM chain),
checked AS (SELECT *, sha256(body || '|' || coalesce(previous, '')) AS computed FROM changed),
c AS (SELECT *, lag(computed) OVER (PARTITION BY log_id ORDER BY seq) AS before FROM checked),
issues AS (SELECT log_id, seq, CASE WHEN n = 1 AND previous IS NOT NULL THEN 'first entry has a predecessor'
  WHEN n > 1 AND previous IS DISTINCT FROM before THEN 'hash mismatch' WHEN h <> computed THEN 'signature mismatch' END AS issue FROM c)
SELECT * FROM issues WHERE issue IS NOT NULL"""


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("client_id"), F.lit("coef_").alias("key"),
        F.posexplode(F.col("embedding").cast("array<double>")).alias("idx", "value"), (F.col("vec_id") % 50).alias("samples_count")
    )


def fedavg(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = table(spark, sf_dir, "embeddings").filter("label % 2 = 0").select(F.col("vec_id").alias("client_id"))
    return audit.federated_average(audit.accepted_updates(updates(spark, sf_dir), clients)).select(
        "key", "idx", F.round("value", 6).alias("value"), "n_clients"
    )


FEDAVG = """WITH u AS (SELECT vec_id, vec_id % 50 AS n, unnest(CAST(embedding AS DOUBLE[])) AS value, generate_subscripts(embedding, 1) - 1 AS idx
  FROM embeddings WHERE label % 2 = 0 AND vec_id % 50 > 0)
SELECT 'coef_' AS key, CAST(idx AS INT) AS idx, round(sum(value * n) / sum(n), 6) AS value, count(*) AS n_clients FROM u GROUP BY idx"""

def client_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings stand for rounds of training: their label for the client, their first two values for accuracy and loss."""
    e = table(spark, sf_dir, "embeddings")
    value = lambda i: F.col("embedding")[i].cast("double")
    history = e.select(
        F.col("label").alias("client_id"), F.col("vec_id").alias("round"), (F.col("vec_id") % 50).alias("samples_count"),
        (F.col("vec_id") % 7).cast("double").alias("seconds"), value(0).alias("accuracy"), value(1).alias("loss")
    )
    return audit.client_statistics(history).withColumns({c: F.round(c, 6) for c in ("mean_seconds", "last_accuracy", "last_loss")})


CLIENT_STATS = """SELECT label AS client_id, max(vec_id) AS last_round, count(*) AS n_rounds, CAST(sum(vec_id % 50) AS BIGINT) AS n_samples,
  CAST(sum(vec_id % 7) AS DOUBLE) AS total_seconds, round(avg(vec_id % 7), 6) AS mean_seconds,
  round(arg_max(CAST(embedding[1] AS DOUBLE), vec_id), 6) AS last_accuracy, round(arg_max(CAST(embedding[2] AS DOUBLE), vec_id),
    6) AS last_loss FROM embeddings GROUP BY label"""
CLIP, MULTIPLIER, ROUND_SEED = 0.1, 0.5, "fed"


def federated_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = table(spark, sf_dir, "embeddings").filter("label % 2 = 0").select(F.col("vec_id").alias("client_id"))
    model, history = audit.federated_round(updates(spark, sf_dir), clients, 1, CLIP, MULTIPLIER, ROUND_SEED)
    return model.join(F.broadcast(history.drop("n_clients", "digest")), "round").select(
        "round", "key", "idx", F.round("value", 6).alias("value"), "n_clients", "n_samples"
    )


def sql_uniform(key: str, seed: str) -> str:
    return f"greatest(1e-12::DOUBLE, least(1 - 1e-12::DOUBLE, ('0x' || substr(md5({key} || ':{seed}'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE))"


AT = "vec_id || ':coef_:' || idx"
FEDERATED_ROUND = f"""WITH u AS (SELECT vec_id, vec_id % 50 AS n, unnest(CAST(embedding AS DOUBLE[])) AS value, generate_subscripts(embedding, 1) - 1 AS idx
  FROM embeddings WHERE label % 2 = 0 AND vec_id % 50 > 0),
p AS (SELECT vec_id, n, idx, greatest(-{CLIP}::DOUBLE, least({CLIP}::DOUBLE,
  value)) + {MULTIPLIER * CLIP}::DOUBLE * sqrt(-2 * ln({sql_uniform(AT, ROUND_SEED + ':1u')})) * cos(2 * pi() * {sql_uniform(AT, ROUND_SEED + ':1v')}) AS value
  FROM u)
SELECT CAST(1 AS INT) AS round, 'coef_' AS key, CAST(idx AS INT) AS idx, round(sum(value * n) / sum(n), 6) AS value, count(*) AS n_clients,
  (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT DISTINCT vec_id, n FROM u)) AS n_samples FROM p GROUP BY idx"""

QUERIES = {
    "protected_values": (protected_values, PROTECTED_VALUES), "release_all": (release_all, RELEASE_ALL), "privacy_sweep": (privacy_sweep, PRIVACY_SWEEP), "client_stats": (client_stats, CLIENT_STATS), "federated_round": (federated_round, FEDERATED_ROUND),
    "k_anonymity": (k_anonymity, f"WITH {C}, {K} {KEEP} FROM k"), "l_diversity": (l_diversity, L_DIVERSITY), "t_closeness_cat": (t_closeness_cat, T_CLOSENESS_CAT), "t_closeness_ks": (t_closeness_ks, T_CLOSENESS_KS), "generalize": (generalize, GENERALIZE),
    "suppress": (suppress, SUPPRESS), "laplace_noise": (laplace_noise, LAPLACE), "privacy_metrics": (privacy_metrics, PRIVACY_METRICS), "anonymize_pipeline": (anonymize_pipeline, ANONYMIZE_PIPELINE), "privacy_tradeoff": (privacy_tradeoff, PRIVACY_TRADEOFF),
    "pseudonyms": (pseudonyms, PSEUDONYMS), "pseudonym_verify": (pseudonym_verify, PSEUDONYM_VERIFY), "encrypt_roundtrip": (encrypt_roundtrip, "SELECT c_custkey, c_name, true AS wrong_key_fails FROM customer"),
    "audit_chain": (audit_chain, AUDIT_CHAIN), "audit_verify": (audit_verify, AUDIT_VERIFY), "fedavg": (fedavg, FEDAVG),
}
