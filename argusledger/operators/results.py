"""Whole documents of runs: results, and what the integrity of a run's case adds to its profile.

A document is one row of JSON text.  Lists that its format puts into it (failed tests, files, issues of its case) are gathered in
that row, so a run's own lists must fit into a task; the counts are aggregated before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argusledger.functions import normalise as N
from argusledger.operators import assurance, profiles

# The lists of a case's integrity by the kind of issue, and the two reasons that block a decision.
INVALID = {"dangling": "dangling_references", "missing_transaction": "missing_transaction_references", "incompatible": "incompatible_evidence_types"}
BROKEN = {"duplicate_evidence": "duplicate_evidence_ids"}
REASONS = {"invalid": ("case_evidence_integrity.invalid_source_evidence_reference", "Invalid source evidence reference"), "broken": ("case_evidence_integrity.broken_canonical_evidence_lineage", "Broken canonical evidence lineage")}


def _json(body: Column, nulls: bool = True) -> Column:
    return F.to_json(body, {"ignoreNullFields": "false" if nulls else "true"})


def case_integrity(cases: DataFrame, issues: DataFrame) -> DataFrame:
    """(run_id, invalid, broken, integrity): how many issues the case of each run has, and a profile's block on it as JSON text.

    ``cases`` has (run_id, canonical_case_hash), a row a run that has a case; ``issues`` (run_id, issue, record_type, record_id, ref) as
    :func:`merge.validate` finds them.  A case without issues has passed; issues of other runs and of no kind known here don't
    count; repeated issues count each.  Lists are sorted.
    """
    item = F.struct(F.col("record_type").alias("referencing_record_type"), F.col("record_id").alias("referencing_record_id"), F.col("ref").alias("evidence_id"))
    kinds = {**INVALID, **BROKEN}
    per = issues.filter(F.col("issue").isin(*kinds)).groupBy("run_id").agg(
        F.count_if(F.col("issue").isin(*INVALID)).alias("invalid"), F.count_if(F.col("issue").isin(*BROKEN)).alias("broken"),
        *[F.sort_array(F.collect_list(F.when(F.col("issue") == k, item))).alias(name) for k, name in kinds.items()])
    none = F.array().cast("array<struct<referencing_record_type:string,referencing_record_id:string,evidence_id:string>>")
    rows = cases.select("run_id", "canonical_case_hash").join(per, "run_id", "left").withColumns(
        {**{c: F.coalesce(c, F.lit(0)) for c in ("invalid", "broken")}, **{c: F.coalesce(c, none) for c in kinds.values()}})
    block = F.struct(
        F.lit(True).alias("present"), F.when(F.col("invalid") + F.col("broken") > 0, "failed").otherwise("passed").alias("status"), F.lit("case_manifest.json").alias("case_manifest_path"), "canonical_case_hash",
        F.struct(F.col("invalid").alias("count"), *INVALID.values()).alias("invalid_source_evidence_reference"),
        F.struct(F.col("broken").alias("count"), *BROKEN.values()).alias("broken_canonical_evidence_lineage"))
    return rows.select("run_id", "invalid", "broken", _json(block).alias("integrity"))


def blocking_reasons() -> Column:
    """A decision's reasons by the counts ``invalid`` and ``broken`` (null: the run has no case): none where both are 0."""
    one = lambda c: F.when(F.col(c) > 0, F.struct(F.lit(REASONS[c][0]).alias("metric"), F.lit(REASONS[c][1]).alias("label"), F.col(c).cast("double").alias("actual"), F.lit(0.0).alias("threshold"), F.lit("maximum").alias("rule"), F.lit("critical").alias("severity")))
    return F.array_compact(F.array(one("invalid"), one("broken")))


def _tests(results: DataFrame) -> DataFrame:
    failure = F.struct("test_name", "duration", "message", "stack_trace")
    failed = results.groupBy("run").agg(F.sort_array(F.collect_list(F.when(F.col("outcome") == "Failed", failure))).alias("failures"))
    return profiles.test_counts(results).join(failed, "run").withColumnRenamed("run", "run_id")


def _outputs(files: DataFrame) -> DataFrame:
    """(run_id, outputs): an object of a run's files as JSON text; of rows with one name the least stays, rows without a name don't count."""
    size = F.struct("size_bytes")
    # An entry has rows (CSV), a preview with its citations (Markdown), or its size only.
    entry = F.when(F.col("rows").isNotNull(), _json(F.struct("size_bytes", "rows"))).when(F.col("content_preview").isNotNull(), _json(F.struct("size_bytes", "content_preview", "citation_count"))).otherwise(_json(size))
    each = files.filter("name is not null").groupBy("run_id", "name").agg(F.min(entry).alias("entry"))
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("name", "entry"))), lambda x: F.concat(_quoted(x["name"]), F.lit(":"), x["entry"]))
    return each.groupBy("run_id").agg(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("outputs"))


def _quoted(text: Column) -> Column:
    """A JSON string: what an object of one key has before its end."""
    whole = F.to_json(F.struct(text.alias("k")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def result_documents(runs: DataFrame, tests: DataFrame, files: DataFrame, judges: DataFrame) -> DataFrame:
    """(run_id, value): the whole result of each run as JSON text.

    ``runs`` has a row a run: (run_id, started_at, completed_at, task, source, agent, model, max_steps, mode, workspace, agent_exit_code,
    tests_exit_code, judge_exit_code), the last null where the judge wasn't run.  ``tests`` are results of tests (``run`` and what
    :func:`documents.read_test_results` gives), ``files`` a run's outputs (``run_id`` and what :func:`documents.collect_outputs` gives),
    ``judges`` (run_id, judge) reports as JSON text, one a run; of several the least counts.  Each of the three may lack a run: its tests are then
    marked as without results, it has no files, or its judge's report is marked as missing.  A judge's text that is no JSON is marked
    so; a run whose judge wasn't run has none, whatever ``judges`` holds.  Any part may be empty; null fields stay null.
    """
    least = judges.groupBy("run_id").agg(F.min("judge").alias("judge"))
    rows = runs.join(_tests(tests), "run_id", "left").join(_outputs(files), "run_id", "left").join(least, "run_id", "left")
    code = F.col("tests_exit_code")
    verdict = F.when(code == 0, "PASS").otherwise("FAIL")
    own = [code.alias("exit_code"), verdict.alias("verdict")]
    counts = ["total", "passed", "failed", "skipped"]
    whole = lambda *more: _json(F.struct(*own, *counts, *more, "failures", F.lit(True).alias("trx_present")))
    xunit = F.when(F.col("total").isNull(), _json(F.struct(*own, F.lit(False).alias("trx_present")))).when(F.col("other") > 0, whole(F.col("other").alias("other_outcomes"))).otherwise(whole())
    ran = F.col("judge_exit_code").isNotNull()
    parsed = F.try_parse_json("judge")
    judge = (F.when(~ran, _json(F.struct(F.lit(False).alias("was_run"))))
             .when(F.col("judge").isNull(), _json(F.struct(F.lit(True).alias("was_run"), F.col("judge_exit_code").alias("exit_code"), F.lit(False).alias("report_present"))))
             .when(parsed.isNull(), _json(F.struct(F.lit("the report is not JSON").alias("parse_error")))).otherwise(F.to_json(parsed)))
    told = F.when(ran, F.try_variant_get(parsed, "$.verdict", "string"))
    seconds = F.bround((F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6, 2)
    variant = lambda text, name: F.parse_json(text).alias(name)
    body = F.struct(
        F.lit("1.0").alias("schema_version"), "run_id", N.iso_o(F.col("started_at")).alias("started_at_utc"), N.iso_o(F.col("completed_at")).alias("completed_at_utc"), seconds.alias("elapsed_seconds"), "task",
        F.struct("source", F.col("agent").alias("name"), "model", "max_steps", "mode").alias("agent"), "workspace", "agent_exit_code",
        variant(F.coalesce("outputs", F.lit("{}")), "agent_outputs"), variant(xunit, "xunit"), variant(judge, "judge"),
        assurance.overall_verdict(code, F.col("judge_exit_code")).alias("overall_verdict"),
        profiles.verdict_reason(verdict, F.col("passed"), F.col("total"), F.col("failed"), told, F.try_variant_get(parsed, "$.overall_percentage", "double")).alias("overall_reason"))
    return rows.select("run_id", _json(body).alias("value"))
