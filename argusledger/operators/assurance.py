"""Policy thresholds to decisions, comparisons and regressions.  One row per run and metric throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
DECISION_RANK = {"PASS": 0, "PASS_WITH_CONDITIONS": 1, "NOT_READY_FOR_DEPLOYMENT": 2}
IDENTITY = ("task", "policy_id", "policy_version", "benchmark_version", "dataset_hash", "required_dimensions")
DIRECTIONS = ("higher_is_better", "lower_is_better")


def validate_policy(policy: DataFrame) -> DataFrame:
    """The policy's invalid rows, with ``problem``."""
    problem = F.when(~F.col("direction").isin(*DIRECTIONS), "unknown direction").when((F.col("unit") == "rate") & ~F.col("threshold").between(0, 1), "rate outside 0..1").when((F.col("unit") == "count") & (F.col("threshold") < 0), "negative count")
    return policy.withColumn("problem", problem).filter("problem is not null")


def metric_status(runs: DataFrame, policy: DataFrame, measured: DataFrame) -> DataFrame:
    """Each run's value of each policy metric with PASS, FAIL or NOT_EVALUATED.  The policy has a few rows."""
    each = runs.select("run_id").crossJoin(F.broadcast(policy)).join(measured, ["run_id", "metric"], "left")
    ok = F.when(F.col("direction") == "higher_is_better", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return each.withColumn("status", F.when(F.col("value").isNull(), "NOT_EVALUATED").when(ok, "PASS").otherwise("FAIL"))


def decide(status: DataFrame, gaps: int = 0) -> DataFrame:
    """Per run: counts and the decision.  ``gaps``: dimensions that nothing measures yet."""
    n = lambda cond: F.count_if(cond)
    fail, required = F.col("status") == "FAIL", F.coalesce("required", F.lit(True))
    out = status.groupBy("run_id").agg(n(F.col("status") != "NOT_EVALUATED").alias("evaluated"), n(fail & required).alias("required_failed"), n(fail & ~required).alias("optional_failed"), n(F.col("status") == "NOT_EVALUATED").alias("not_evaluated"))
    decision = F.when((F.col("evaluated") == 0) | (F.col("required_failed") > 0), "NOT_READY_FOR_DEPLOYMENT").when((F.col("optional_failed") > 0) | (F.col("not_evaluated") + gaps > 0), "PASS_WITH_CONDITIONS").otherwise("PASS")
    return out.withColumn("decision", decision)


def case_gate(decision: Column, case_present: Column, invalid_references: Column, broken_lineage: Column) -> Column:
    """An integrity failure of the case blocks, whatever the metrics say."""
    return F.when(case_present & ((invalid_references > 0) | (broken_lineage > 0)), "NOT_READY_FOR_DEPLOYMENT").otherwise(decision)


def decision_rank(decision: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in DECISION_RANK.items() for x in kv])[decision], F.lit(3))


def is_regression(baseline: Column, candidate: Column) -> Column:
    """Strictly worse than the baseline; an unknown decision is the worst."""
    return decision_rank(candidate) > decision_rank(baseline)


def overall_verdict(tests: Column, judge: Column) -> Column:
    """Of the exit codes of the tests and the judge; null: the judge was not run."""
    return F.when((tests == 0) & (judge.isNull() | (judge == 0)), "PASS").otherwise("FAIL")


def compare(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Full outer join of (metric, label, direction, unit, value, status): change, trend, newly failed, newly passed."""
    b, c = (df.select("metric", *[F.col(k).alias(f"{p}_{k}") for k in ("label", "direction", "unit", "value", "status")]) for df, p in ((baseline, "b"), (candidate, "c")))
    out = b.join(c, "metric", "full_outer").select("metric", F.coalesce("b_label", "c_label").alias("label"), F.coalesce("c_direction", "b_direction").alias("direction"), F.coalesce("c_unit", "b_unit").alias("unit"),
                                                   F.col("b_value").alias("baseline"), F.col("c_value").alias("candidate"), (F.col("c_value") - F.col("b_value")).alias("change"), "b_status", "c_status")
    up = F.col("change") > 0
    trend = F.when(F.col("change").isNull() | F.col("direction").isNull(), "unknown").when(F.abs("change") < 1e-9, "unchanged").when((F.col("direction") == "lower_is_better") == up, "worse").otherwise("better")
    newly = (F.col("c_status") == "FAIL") & ~F.col("b_status").eqNullSafe("FAIL")
    return out.select("metric", "label", "direction", "unit", "baseline", "candidate", "change", trend.alias("trend"), F.coalesce(newly, F.lit(False)).alias("newly_failed"), F.coalesce((F.col("b_status") == "FAIL") & (F.col("c_status") == "PASS"), F.lit(False)).alias("newly_passed"))


def compatibility(runs: DataFrame, reference: str) -> DataFrame:
    """(run_id, field, reference_value, value) where a run differs from the reference run; null is unknown, no mismatch."""
    long = lambda df: df.select("run_id", F.expr("stack({}, {}) as (field, value)".format(len(IDENTITY), ", ".join(f"'{k}', {k}" for k in IDENTITY))))
    first = long(runs.filter(F.col("run_id") == reference)).select("field", F.col("value").alias("reference_value"))
    return long(runs.filter(F.col("run_id") != reference)).join(F.broadcast(first), "field").filter("value <> reference_value").select("run_id", "field", "reference_value", "value")


def fingerprint(status: DataFrame) -> DataFrame:
    """(run_id, required_dimensions): required metrics, sorted, comma-joined."""
    return status.filter("required").groupBy("run_id").agg(F.array_join(F.sort_array(F.collect_set("metric")), ",").alias("required_dimensions"))


def exit_code(invalid: Column, agent: Column, tests: Column, judge: Column, decision: Column) -> Column:
    return F.when(invalid, 5).when(agent != 0, 1).when((tests != 0) | (judge != 0), 2).when(decision == "PASS_WITH_CONDITIONS", 3).when(decision == "NOT_READY_FOR_DEPLOYMENT", 4).otherwise(0)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
