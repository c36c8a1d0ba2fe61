"""Screening against lists, remediation plans, and checks of roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import REMEDIATION_RULES, ROLE_PERMISSIONS

#: Lists and rules are broadcast up to so many rows.
MOST_BROADCAST = 100_000


def bounded(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df with a broadcast hint if it has few rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= most else df


def screen(logs: DataFrame, listed: DataFrame, user: str = "user", resource: str = "resource") -> DataFrame:
    """logs with ofac_match, bis_match and compliance_breach: whether user or resource is on a list, in any case.

    listed has name and source; the list is what source starts with. Null names match nothing.
    """
    names = listed.filter("name IS NOT NULL").select(
        F.lower("name").alias("listed_name"), F.col("source").startswith("OFAC").alias("ofac"),
        F.col("source").startswith("BIS").alias("bis")
    )
    names = bounded(names.groupBy("listed_name").agg(F.bool_or("ofac").alias("ofac"), F.bool_or("bis").alias("bis")))
    by_user, by_resource = (names.select(*(F.col(c).alias(f"{c}_{s}") for c in names.columns)) for s in ("u", "r"))
    joined = logs.join(by_user, F.lower(F.col(user)) == F.col("listed_name_u"), "left").join(
        by_resource, F.lower(F.col(resource)) == F.col("listed_name_r"), "left"
    )
    hit = lambda c: F.coalesce(F.col(f"{c}_u"), F.lit(False)) | F.coalesce(F.col(f"{c}_r"), F.lit(False))
    flagged = joined.withColumns({"ofac_match": hit("ofac"), "bis_match": hit("bis")})
    return flagged.withColumn(
        "compliance_breach", F.col("ofac_match") | F.col("bis_match")
    ).drop(*(f"{c}_{s}" for c in ("listed_name", "ofac", "bis") for s in "ur"))


def default_rules(df: DataFrame) -> DataFrame:
    """The default rules as a table: name, actions, conditions, severity, rule_pos."""
    rows = [
        (name, list(actions), {k: [v] for k, v in (("breach_type", kind), ("confidence", sure)) if v}, severity, i) for i,
        (name, kind, sure, actions, severity) in enumerate(REMEDIATION_RULES)
    ]
    return df.sparkSession.createDataFrame(
        rows, "name string, actions array<string>, conditions map<string,array<string>>, severity int, rule_pos int"
    )


def confidence_of(match_score: Column) -> Column:
    return F.when(match_score.isNull(), "medium").when(match_score > 0.9, "high").when(match_score > 0.7, "medium").otherwise("low")


def matching_rules(breaches: DataFrame, rules: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Pairs of a breach (breach_id, breach_type, confidence) and a rule whose conditions it meets.

    Up to most rules are broadcast. More are joined by the key and value of each condition, and a pair stays
    that meets as many conditions as the rule has; rules without conditions are broadcast, up to most.
    """
    facts = F.create_map(F.lit("breach_type"), F.col("breach_type"), F.lit("confidence"), F.col("confidence"))
    if rules.count() <= most:
        fits = F.forall(F.map_entries("conditions"), lambda c: F.coalesce(F.array_contains(c["value"], facts[c["key"]]), F.lit(False)))
        return breaches.join(F.broadcast(rules), fits)
    wanted = rules.select("rule_pos", F.explode("conditions").alias("key", "values")).select(
        "rule_pos", "key", F.explode(F.array_distinct("values")).alias("value")
    )
    known = breaches.select(F.col("breach_id").alias("of_breach"), F.explode(facts).alias("fact", "is"))
    met = known.join(
        wanted, (F.col("fact") == F.col("key")) & (F.col("is") == F.col("value"))
    ).groupBy("of_breach", "rule_pos").agg(F.count("*").alias("n_met"))
    by_condition = rules.filter(F.size("conditions") > 0).withColumn("n_conditions", F.size("conditions"))
    full = met.join(
        by_condition.select(F.col("rule_pos").alias("pos"), "n_conditions"),
        (F.col("rule_pos") == F.col("pos")) & (F.col("n_met") == F.col("n_conditions"))
    ).select("of_breach", "pos")
    pairs = breaches.join(
        full, F.col("breach_id") == F.col("of_breach")
    ).join(rules, F.col("pos") == F.col("rule_pos")).select(*breaches.columns, *rules.columns)
    always = rules.filter(F.size("conditions") == 0)
    if always.count() > most:
        raise ValueError(f"more than {most} rules without conditions")
    return pairs.unionByName(breaches.join(F.broadcast(always)).select(*breaches.columns, *rules.columns))


def rules_from(spark: SparkSession, path: str) -> DataFrame:
    """Rules from files in JSON: name, actions, conditions and severity; rule_pos by severity (highest first), then name. Missing conditions are none."""
    rules = spark.read.schema("name string, actions array<string>, conditions map<string,array<string>>, severity int").option(
        "multiLine", "true"
    ).json(path)
    none = F.from_json(F.lit("{}"), "map<string,array<string>>")
    pos = F.row_number().over(Window.orderBy(F.desc("severity"), "name")) - 1  # a configuration is small
    return rules.filter("name IS NOT NULL").select(
        "name", F.coalesce("actions", F.array().cast("array<string>")).alias("actions"), F.coalesce("conditions", none).alias("conditions"),
        F.coalesce("severity", F.lit(1)).alias("severity")
    ).withColumn("rule_pos", pos)


def breach_rows(found: DataFrame) -> DataFrame:
    """Breaches (event_id, user, resource, match_score and flags of screen) as rows for remediation: unknown values are 'unknown', confidence by the score."""
    text = lambda name: F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit("unknown")).alias(name)
    kind = F.when(F.col("ofac_match"), "ofac").when(F.col("bis_match"), "bis").otherwise("unknown")
    return found.select(
        F.col("event_id").alias("breach_id"), kind.alias("breach_type"), text("user"), text("resource"),
        confidence_of(F.col("match_score")).alias("confidence")
    )


def remediation_plan(breaches: DataFrame, rules: DataFrame) -> DataFrame:
    """What to do about each breach (breach_id, breach_type, confidence): breach_id, step, action, rule_name.

    A rule matches when each of its conditions names the breach's value; no conditions match all. Rules
    act by severity, then in their order; an action is planned once for a breach.
    """
    matched = matching_rules(breaches, rules)
    steps = matched.select(
        "breach_id", F.col("name").alias("rule_name"), "severity", "rule_pos", F.posexplode("actions").alias("action_pos", "action")
    )
    order = (F.desc("severity"), "rule_pos", "action_pos")
    first = steps.withColumn("n", F.row_number().over(Window.partitionBy("breach_id", "action").orderBy(*order))).filter("n = 1")
    return first.select("breach_id", F.row_number().over(Window.partitionBy("breach_id").orderBy(*order)).alias("step"), "action", "rule_name")


def severity_name(n: Column) -> Column:
    return F.when(n.isNull(), "Unknown").when(n >= 9, "Critical").when(n >= 7, "High").when(n >= 4, "Medium").otherwise("Low")


def offense_alerts(offenses: DataFrame) -> DataFrame:
    """Open offenses (id, description, status, severity, start_time) above severity 5 as alerts, and their tickets."""
    open_ones = offenses.filter((F.col("status") == "OPEN") & (F.col("severity") > 5))
    title = F.concat(F.lit("Offense "), F.col("id").cast("string"))
    return open_ones.select(
        F.col("id"), title.alias("title"), severity_name(F.col("severity")).alias("severity_name"),
        F.concat_ws("\n", F.concat(F.lit("Description: "), F.col("description")), F.concat(F.lit("Severity: "), F.col("severity").cast("string")), F.concat(F.lit("Status: "), F.col("status"))).alias("description"),
        F.concat(F.lit("Compliance Alert: "), title).alias("ticket_summary")
    )


def tickets(alerts: DataFrame, project: str, issue_type: str = "Task") -> DataFrame:
    """An outbox of tickets for the alerts of offenses: project, type of issue, summary, description, and priority by severity."""
    urgent = F.when(F.col("severity_name").isin("Critical", "High"), "High").when(F.col("severity_name") == "Medium", "Medium").otherwise("Low")
    return alerts.select(
        "id", F.lit(project).alias("project"), F.lit(issue_type).alias("issue_type"), F.col("ticket_summary").alias("summary"), "description",
        urgent.alias("priority"),
    )


def role_violations(access: DataFrame) -> DataFrame:
    """Accesses (role, permission) that the role doesn't allow; unknown roles allow nothing."""
    grants = access.sparkSession.createDataFrame([(r, p) for r, ps in ROLE_PERMISSIONS for p in ps], "granted_role string, granted string")
    return access.join(F.broadcast(grants), (F.col("role") == F.col("granted_role")) & (F.col("permission") == F.col("granted")), "left_anti")


def agreement(ai: Column, rule: Column) -> Column:
    """Shared actions over the longer list; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(ai, rule)), F.greatest(F.size(ai), F.size(rule))), F.lit(0.0))


def top_actions(scored: Column, most: int = 3) -> Column:
    """The names of the highest actions of action_scores, of equal ones by name."""
    order = F.array_sort(
        scored,
        lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["action"] < b["action"], -1).when(a["action"] > b["action"], 1).otherwise(0)
    )
    return F.transform(F.slice(order, 1, most), lambda x: x["action"])


def hybrid_actions(ai: Column, rule: Column, confidence: Column, least: float = 0.7) -> Column:
    return F.when(confidence >= least, ai).otherwise(rule)


def action_scores(ai: Column, rule: Column, severity: Column, impact: Column) -> Column:
    """Score of every proposed action: severity times impact weighs the model against the rules."""
    w = severity * impact
    return F.transform(
        F.array_union(ai, rule),
        lambda a: F.struct(a.alias("action"), (F.array_contains(ai, a).cast("double") * w + F.array_contains(rule, a).cast("double") * (1 - w)).alias("score"))
    )
