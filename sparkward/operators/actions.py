"""A registry of remediation actions: functions from breaches to rows of an outbox."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Action = Callable[[DataFrame], DataFrame]


class Actions:
    """Named actions; a plan's steps run those that are known."""

    def __init__(self) -> None:
        self.known: dict[str, Action] = {}

    def register(self, name: str, action: Action) -> None:
        self.known[name] = action

    def run(self, plan: DataFrame, breaches: DataFrame) -> dict[str, DataFrame]:
        """The outbox of each known action for the breaches whose plan has it (plan: breach_id, action); unknown actions are left out."""
        out = {}
        for name, action in self.known.items():
            chosen = plan.filter(F.col("action") == name).select(F.col("breach_id").alias("_id")).distinct()
            out[name] = action(breaches.join(chosen, F.col("breach_id") == F.col("_id"), "left_semi"))
        return out

    def status(self, plan: DataFrame) -> DataFrame:
        """The plan with what becomes of each step."""
        return plan.withColumn("state", F.when(F.col("action").isin(*self.known), "executed").otherwise("skipped"))


def counters(plan: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules, planned actions and breaches, as one row; with a column origin also actions by the model (ai) and by rules."""
    by = [F.count_if(F.col("origin") == o).alias(f"n_{o}_actions") for o in ("ai", "rule")] if "origin" in plan.columns else []
    return plan.agg(
        F.count("*").alias("n_actions"), F.count_distinct("breach_id").alias("n_breaches"), *by
    ).join(F.broadcast(rules.agg(F.count("*").alias("n_rules"))))
