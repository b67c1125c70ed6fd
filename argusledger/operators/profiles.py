"""Run results and assurance profiles: building, hashing, checking, comparing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argusledger.operators import assurance

# The parts of a profile, and the allowed states.
TOP = ("schema_version", "disclaimer", "generated_at_utc", "status_summary", "agent", "benchmark", "scenario_pack", "operational_capabilities", "jurisdiction_profile", "policy", "metrics", "not_evaluated_dimensions", "deployment_decision", "provenance", "result_hash")
PARTS = {
    "status_summary": ("execution_status", "benchmark_verdict", "assurance_decision"),
    "deployment_decision": ("overall", "reason", "evaluated_metric_count", "total_defined_dimension_count", "reasons"),
    "policy": ("id", "name", "version", "path"),
    "provenance": ("run_id", "started_at_utc", "completed_at_utc", "benchmark_version", "policy_id", "policy_version"),
}
METRIC_KEYS = ("metric", "label", "value", "unit", "threshold", "direction", "required", "status")
REASON_KEYS = ("metric", "label", "actual", "threshold", "rule", "severity")
STATES = ("PASS", "FAIL", "NOT_EVALUATED")
COMPARED = ("task_performance_percentage", "eghr_rate", "evidence_traceability_precision", "evidence_traceability_recall", "evidence_traceability_f1", "fabricated_citation_count")
FINGERPRINTED = ("prompt.md", "instruction.md", "rubric.json", "evidence-annotations.json", "capabilities.json")


# --- checks ----------------------------------------------------------------------------------


def _is(x: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(x).startswith(kind), F.lit(False))


def _lacks(x: Column, key: str, empty: bool = False) -> Column:
    """Whether an object has no such key; ``empty``: or a null under it."""
    got = F.try_variant_get(x, f"$.{key}", "variant")
    return got.isNull() | F.is_variant_null(got) if empty else got.isNull()


def _flaws(*flaws: Column) -> Column:
    return F.array_compact(F.array(*flaws))


def _each(items: Column, name: str, keys: tuple[str, ...], states: tuple[str, ...] = ()) -> Column:
    """Flaws of an array's objects: missing keys, and a ``status`` that is none of ``states``."""

    def flaws(x, i):
        where = F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]: "))
        status = F.try_variant_get(x, "$.status", "string")
        odd = [F.when(status.isNotNull() & ~status.isin(*states), F.concat(where, F.lit("unknown status "), status))] if states else []
        return F.when(_is(x, "OBJECT"), _flaws(*[F.when(_lacks(x, k), F.concat(where, F.lit(f"no {k}"))) for k in keys], *odd)).otherwise(F.array(F.concat(where, F.lit("not an object"))))

    return F.coalesce(F.flatten(F.transform(F.try_variant_get(items, "$", "array<variant>"), flaws)), F.array().cast("array<string>"))


def violations(profile: Column) -> Column:
    """Everything that is wrong with a profile, a VARIANT; an empty array where nothing is.

    A key whose value is null is there, but for the top level's, the status' and the run's.
    """
    part = lambda k: F.try_variant_get(profile, f"$.{k}", "variant")
    is_array = lambda x: _is(x, "ARRAY")
    decision = part("deployment_decision")
    overall, reasons = F.try_variant_get(decision, "$.overall", "string"), F.try_variant_get(decision, "$.reasons", "variant")
    gaps = F.filter(F.try_variant_get(part("not_evaluated_dimensions"), "$", "array<variant>"), lambda x: _is(x, "OBJECT") | _is(x, "ARRAY"))
    wanted = []
    for name, names in PARTS.items():
        keys = _flaws(*[F.when(_lacks(part(name), k, empty=name == "status_summary"), f"{name}: no {k}") for k in names])
        wanted.append(F.when(_is(part(name), "OBJECT"), keys).otherwise(F.array(*[F.lit(f"{name}: not an object")] * (name != "status_summary")).cast("array<string>")))
    found = F.concat(
        _flaws(*[F.when(_lacks(profile, k, empty=True), f"no {k}") for k in TOP]), *wanted,
        _flaws(*[F.when(~is_array(part(k)), f"{k}: not an array") for k in ("metrics", "not_evaluated_dimensions", "operational_capabilities")],
               F.when(F.size(gaps) > 0, "not_evaluated_dimensions: not all are text"),
               F.when(overall.isNotNull() & ~overall.isin(*assurance.DECISION_RANK), F.concat(F.lit("deployment_decision: unknown decision "), overall)),
               F.when(~is_array(reasons), "deployment_decision: reasons are no array")),
        F.when(is_array(part("metrics")), _each(part("metrics"), "metrics", METRIC_KEYS, STATES)).otherwise(F.array().cast("array<string>")),
        F.when(is_array(reasons), _each(reasons, "reasons", REASON_KEYS)).otherwise(F.array().cast("array<string>")),
        _flaws(F.when(~F.coalesce(F.try_variant_get(profile, "$.result_hash", "string").startswith("sha256:"), F.lit(False)), "result_hash: not sha256:..."),
               F.when(~_is(part("provenance"), "OBJECT") | _lacks(part("provenance"), "run_id", empty=True), "provenance: no run to trace it to")))
    return F.when(_is(profile, "OBJECT"), found).otherwise(F.array(F.when(profile.isNull(), "not JSON").otherwise("not an object")))


def invalid_documents(documents: DataFrame, text: str, key: str) -> DataFrame:
    """(key, violations) of the JSON documents that are no valid profiles.

    Null texts, texts that are no JSON and objects with a repeated key are "not JSON"; repeated rows are judged alike.
    """
    parsed = documents.select(F.col(key), F.try_parse_json(text).alias("_profile"))
    return parsed.select(key, violations(F.col("_profile")).alias("violations")).filter(F.size("violations") > 0)


# --- building --------------------------------------------------------------------------------


def not_evaluated(status: DataFrame, gaps: list[str]) -> DataFrame:
    """(run_id, labels): labels of metrics without a value in the policy's order, then the declared gaps, each once."""
    at = F.col("place") if "place" in status.columns else F.col("metric")
    label = F.when(F.col("status") == "NOT_EVALUATED", F.struct(at.alias("at"), "label"))
    own = F.transform(F.sort_array(F.collect_list(label)), lambda x: x.label)
    return status.groupBy("run_id").agg(F.array_distinct(F.concat(own, F.array(*map(F.lit, gaps)).cast("array<string>"))).alias("labels"))


def profiles(runs: DataFrame, status: DataFrame, gaps: list[str], policy: dict[str, str], meta: dict[str, str], cases: DataFrame | None = None, restrictions: list[str] | None = None) -> DataFrame:
    """One profile a run, hash included: (run_id, agent, model, task, tests, judge, precision, recall) and the metrics' status.

    ``runs`` may also have ``report`` (a judge's JSON text: the summary of the evidence and the judge's own settings come from it), ``capabilities``
    (an array), ``max_steps``, ``mode``, ``agent_exit_code`` and any of the texts that ``meta`` else gives for all runs.  ``cases``
    (:func:`results.case_integrity`) blocks the decision of runs whose case has issues; a run without a row there has no case.
    """
    from argusledger.operators import results

    decided = assurance.decide(status, len(gaps))
    metric = F.struct("metric", "label", "value", "unit", "threshold", "direction", "required", "status")
    severity = F.when(F.col("required"), "critical").otherwise("warning")
    rule = F.when(F.col("direction") == "higher_is_better", "minimum").otherwise("maximum")
    reason = F.when(F.col("status") == "FAIL", F.struct("metric", "label", F.col("value").alias("actual"), "threshold", rule.alias("rule"), severity.alias("severity")))
    parts = status.groupBy("run_id").agg(F.sort_array(F.collect_list(metric)).alias("metrics"), F.sort_array(F.collect_list(reason)).alias("reasons"), F.count("*").alias("defined"))
    rows = runs.join(parts, "run_id").join(decided, "run_id").join(not_evaluated(status, gaps), "run_id")
    if cases is None:
        rows = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("invalid", "long"), ("broken", "long"), ("integrity", "string"))])
    else:
        rows = rows.join(cases.select("run_id", "invalid", "broken", "integrity"), "run_id", "left")
    blocks = results.blocking_reasons()
    overall = F.when(F.size(blocks) > 0, "NOT_READY_FOR_DEPLOYMENT").otherwise(F.col("decision"))
    why = F.when((F.size(blocks) > 0) & (F.col("decision") != "NOT_READY_FOR_DEPLOYMENT"), F.concat(F.lit("the case has unresolved issues ("), F.array_join(F.transform(blocks, lambda x: x.label), "; "), F.lit("), whatever the metrics say ("), reason_text(), F.lit(")"))).otherwise(reason_text())

    def text(k: str, kind: str = "string") -> Column:
        return (F.col(k) if k in runs.columns else F.lit(meta.get(k))).cast(kind).alias(k)

    report = F.try_parse_json("report") if "report" in runs.columns else F.lit(None).cast("variant")
    told = lambda k, kind="variant": F.try_variant_get(report, f"$.{k}", kind)
    if "report" in runs.columns:
        summary = F.struct(*[told(k).alias(k) for k in ("eghr", "evidence_traceability", "claims")])
    else:
        summary = F.struct(F.struct("precision", "recall").alias("evidence_traceability"))
    max_steps = F.col("max_steps") if "max_steps" in runs.columns else F.lit(12)
    mode = F.col("mode") if "mode" in runs.columns else F.lit("local")
    capabilities = F.col("capabilities") if "capabilities" in runs.columns else F.array()
    finished = F.when(F.coalesce(F.col("agent_exit_code") == 0, F.lit(False)), "completed").otherwise("failed") if "agent_exit_code" in runs.columns else F.lit("completed")
    number = lambda k: F.lit(meta.get(k)).cast("double").alias("temperature")
    provenance = F.struct(
        "run_id", *map(text, ("workspace", "started_at_utc", "completed_at_utc")), mode.alias("execution_mode"), text("benchmark_version"), text("git_commit_sha"), F.lit(policy.get("id")).alias("policy_id"), F.lit(policy.get("version")).alias("policy_version"),
        *map(text, ("policy_file_hash", "dataset_hash", "rubric_hash", "task_fingerprint")), run_hash(F.col("task"), F.col("model"), max_steps, mode, F.lit(policy.get("id")), F.lit(policy.get("version"))).alias("benchmark_config_hash"),
        F.coalesce(text("agent_version"), F.lit("unversioned")).alias("agent_version"), F.col("model").alias("model_identifier"), number("temperature"), text("random_seed", "long"), told("model", "string").alias("judge_model"),
        F.struct(told("pass_threshold_overall", "double").alias("pass_threshold_overall"), text("rubric_path"), number("judge_temperature")).alias("judge_config"),
        F.struct(F.version().alias("spark_version"), text("os")).alias("runtime"), text("reproducibility_note"))
    block = F.coalesce(F.parse_json("integrity"), F.parse_json(F.lit('{"present":false}')))
    out = rows.select(
        F.lit("0.2").alias("schema_version"), F.lit(meta.get("disclaimer", "research output, no certification")).alias("disclaimer"), text("generated_at_utc"),
        F.struct(finished.alias("execution_status"), assurance.overall_verdict(F.col("tests"), F.col("judge")).alias("benchmark_verdict"), overall.alias("assurance_decision")).alias("status_summary"),
        F.struct(F.col("agent").alias("name"), "model", max_steps.cast("long").alias("max_steps"), mode.alias("mode")).alias("agent"),
        text("benchmark"), F.col("task").alias("scenario_pack"), capabilities.cast("array<string>").alias("operational_capabilities"), text("jurisdiction_profile"),
        F.struct(*[F.lit(policy.get(k)).cast("string").alias(k) for k in PARTS["policy"]]).alias("policy"), "metrics", F.col("labels").alias("not_evaluated_dimensions"),
        F.struct(overall.alias("overall"), why.alias("reason"), F.col("evaluated").alias("evaluated_metric_count"), (F.col("defined") + len(gaps)).alias("total_defined_dimension_count"), F.concat("reasons", blocks).alias("reasons")).alias("deployment_decision"),
        (F.lit(None).cast("array<string>") if restrictions is None else F.array(*map(F.lit, restrictions)).cast("array<string>")).alias("deployment_restrictions"),
        summary.alias("evidence_summary"), block.alias("case_evidence_integrity"), provenance.alias("provenance"))
    return out.withColumn("result_hash", document_hash(F.struct(*out.columns)))


def reason_text() -> Column:
    return F.when(F.col("evaluated") == 0, "nothing was measured").when(F.col("required_failed") > 0, F.concat(F.col("required_failed").cast("string"), F.lit(" required metrics failed"))).when(F.col("decision") == "PASS", "all metrics passed").otherwise("optional metrics failed or gaps remain")


def document_hash(body: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256))


def test_counts(results: DataFrame) -> DataFrame:
    """Per run: counts of single results by outcome; what is neither passed, failed nor skipped is ``other``."""
    n = lambda what: F.count_if(F.col("outcome") == what)
    out = results.groupBy("run").agg(F.count("*").alias("total"), n("Passed").alias("passed"), n("Failed").alias("failed"), n("NotExecuted").alias("skipped"))
    return out.withColumn("other", F.col("total") - F.col("passed") - F.col("failed") - F.col("skipped"))


def verdict_reason(tests: Column, passed: Column, total: Column, failed: Column, judge: Column, percentage: Column) -> Column:
    """Why a run passed or failed, in one line; ``tests`` and ``judge`` are verdicts (null: not run)."""
    # Fixed wording.
    n = lambda x: F.coalesce(x.cast("string"), F.lit(""))  # noqa: E731  without results there are no counts
    own = F.when(tests == "PASS", F.concat(F.lit("xUnit PASS ("), n(passed), F.lit("/"), n(total), F.lit(")"))).when(tests.isNotNull(), F.concat(F.lit("xUnit FAIL ("), n(failed), F.lit(" assertion(s))")))
    other = F.when(judge.isNotNull(), F.format_string("judge %s at %.1f%%", judge, F.coalesce(percentage, F.lit(0.0)) * 100))
    return F.concat_ws("; ", own, other)


def capability_tags(document: Column) -> Column:
    """The tags of a task's JSON; none where it has none."""
    tags = F.from_json(F.get_json_object(document, "$.operational_capabilities"), "array<string>")
    return F.coalesce(F.filter(tags, lambda x: x.isNotNull()), F.array().cast("array<string>"))


# --- comparing -------------------------------------------------------------------------------


def identities(documents: DataFrame) -> DataFrame:
    """(run_id, and the fields of :data:`assurance.IDENTITY`) of profiles."""
    required = F.transform(F.filter("metrics", lambda m: F.coalesce(m.required, F.lit(True))), lambda m: m.metric)
    return documents.select(F.col("provenance.run_id").alias("run_id"), F.col("scenario_pack").alias("task"), F.col("policy.id").alias("policy_id"), F.col("policy.version").alias("policy_version"), F.col("provenance.benchmark_version").alias("benchmark_version"), F.col("provenance.dataset_hash").alias("dataset_hash"), F.array_join(F.array_sort(required), ",").alias("required_dimensions"))


def compare_rows(documents: DataFrame) -> DataFrame:
    """A row of text for each profile, as a person reads it."""
    value = lambda name: F.get(F.filter("metrics", lambda m: m.metric == name), F.lit(0))["value"]
    share = lambda x: F.when(x.isNull(), "n/a").otherwise(F.format_string("%.1f%%", x * 100))
    known = lambda c: F.coalesce(F.col(c), F.lit("?"))
    count = value("fabricated_citation_count")
    return documents.select(
        F.col("provenance.run_id").alias("run_id"), known("agent.name").alias("agent"), known("agent.model").alias("model"), known("scenario_pack").alias("task"), F.concat(known("policy.id"), F.lit(" v"), known("policy.version")).alias("policy"),
        share(value("task_performance_percentage")).alias("task_performance"), share(value("eghr_rate")).alias("eghr"), share(F.col("evidence_summary.evidence_traceability.precision")).alias("precision"), share(F.col("evidence_summary.evidence_traceability.recall")).alias("recall"),
        share(value("evidence_traceability_f1")).alias("trace_f1"), F.when(count.isNull(), "n/a").otherwise(F.format_string("%.0f", count)).alias("fabricated"), F.coalesce("status_summary.assurance_decision", F.lit("-")).alias("decision"))


def excluded_dimensions(documents: DataFrame, baseline: str | None = None) -> DataFrame:
    """(dimension): of all runs in a comparison, of the baseline's run in a regression check."""
    own = documents if baseline is None else documents.filter(F.col("provenance.run_id") == baseline)
    return own.select(F.explode("not_evaluated_dimensions").alias("dimension")).filter("dimension is not null").distinct()


def metric_rows(documents: DataFrame) -> DataFrame:
    """(run_id, metric, label, direction, unit, value, status) of profiles, for :func:`assurance.compare`."""
    rows = documents.select(F.col("provenance.run_id").alias("run_id"), F.explode("metrics").alias("m"))
    return rows.select("run_id", "m.metric", F.coalesce("m.label", "m.metric").alias("label"), F.coalesce("m.direction", F.lit("")).alias("direction"), F.coalesce("m.unit", F.lit("rate")).alias("unit"), "m.value", F.coalesce("m.status", F.lit("NOT_EVALUATED")).alias("status"))


def console_report(profile: dict) -> str:
    """A profile's sections for a console (MSC-12); one without rows is left out, missing values are dashes."""
    from argusledger.sources.sinks import table_text

    show = lambda x: "-" if x is None else f"{x:g}" if isinstance(x, float) else str(x)
    part = lambda k: profile.get(k) or {}
    sign = {"higher_is_better": ">=", "lower_is_better": "<="}
    state, decision = part("status_summary"), part("deployment_decision")
    sections = [
        ("run", ["field", "value"], [["agent", part("agent").get("name")], ["model", part("agent").get("model")], ["task", profile.get("scenario_pack")], ["verdict", state.get("benchmark_verdict")]]),
        ("metrics", ["metric", "value", "threshold", "unit", "status"], [[m.get("label"), m.get("value"), f"{sign.get(m.get('direction'), '')} {show(m.get('threshold'))}".strip(), m.get("unit"), m.get("status")] for m in profile.get("metrics") or []]),
        ("reasons", ["metric", "actual", "rule", "threshold", "severity"], [[r.get(k) for k in ("label", "actual", "rule", "threshold", "severity")] for r in decision.get("reasons") or []]),
        ("not evaluated", ["dimension"], [[x] for x in profile.get("not_evaluated_dimensions") or []]),
        ("decision", ["field", "value"], [["overall", decision.get("overall")], ["reason", decision.get("reason")], ["result hash", profile.get("result_hash")]]),
    ]
    return "\n\n".join(table_text(title, header, [list(map(show, r)) for r in rows]) for title, header, rows in sections if rows)


def comparison(spark: SparkSession, documents: DataFrame, generated_at: str) -> dict:
    """The machine-readable comparison of a few runs, the first of them the reference."""
    runs = documents.select("path", F.col("agent.name").alias("agent"), F.col("agent.model").alias("model"), F.col("scenario_pack").alias("task"), F.col("policy.id").alias("policy_id"), F.col("policy.version").alias("policy_version"), F.col("status_summary.assurance_decision").alias("assurance_decision"), F.col("provenance.run_id").alias("run_id")).collect()
    return {"generated_at_utc": generated_at, "compared_runs": [r.asDict() for r in runs], "comparable_dimensions": list(COMPARED), "excluded_dimensions": sorted(r.dimension for r in excluded_dimensions(documents).collect()), "warnings": warnings(documents, runs[0].run_id)}


def regression(spark: SparkSession, documents: DataFrame, baseline: str, candidate: str, generated_at: str) -> dict:
    """The machine-readable check of one run against another."""
    each = {r.run_id: r for r in documents.select(F.col("provenance.run_id").alias("run_id"), "path", F.coalesce("status_summary.assurance_decision", F.lit("-")).alias("decision")).filter(F.col("run_id").isin(baseline, candidate)).collect()}
    rows = metric_rows(documents)
    change = assurance.compare(rows.filter(F.col("run_id") == baseline), rows.filter(F.col("run_id") == candidate)).orderBy("metric").collect()
    worse = documents.sparkSession.range(1).select(assurance.is_regression(F.lit(each[baseline].decision), F.lit(each[candidate].decision)).alias("x")).first().x
    side = lambda k: {"path": each[k].path, "run_id": k, "assurance_decision": each[k].decision}
    both = documents.filter(F.col("provenance.run_id").isin(baseline, candidate))
    return {
        "generated_at_utc": generated_at, "baseline": side(baseline), "candidate": side(candidate),
        "metric_deltas": [{k: r[k] for k in ("metric", "label", "baseline", "candidate", "change", "trend")} for r in change],
        "newly_failed_thresholds": [r.label for r in change if r.newly_failed], "newly_passed_thresholds": [r.label for r in change if r.newly_passed],
        "excluded_dimensions": sorted(r.dimension for r in excluded_dimensions(documents, baseline).collect()),
        "decision_change": {"previous": each[baseline].decision, "current": each[candidate].decision, "regression_detected": worse}, "warnings": warnings(both, baseline),
    }


def warnings(documents: DataFrame, reference: str) -> list[str]:
    rows = assurance.compatibility(identities(documents), reference).orderBy("run_id", "field").collect()
    return [f"{r.run_id}: {r.field} is {r.value}, not {r.reference_value}" for r in rows]


# --- provenance ------------------------------------------------------------------------------


def files_hash(spark: SparkSession, paths: list[str]) -> str | None:
    """``sha256:...`` over the files' own hashes in the order of their names; None without any file.

    Files are hashed where they are read; a byte or a name that changes, changes the result.
    """
    from argusledger.sources.documents import exists

    there = [p for p in paths if exists(spark, p)]
    if not there:
        return None
    each = spark.read.format("binaryFile").load(there).select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.sha2("content", 256).alias("h"))
    body = each.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "h"))), lambda x: F.concat(x["name"], F.lit("="), x["h"])), "|").alias("x"))
    return body.filter("x <> ''").select(F.concat(F.lit("sha256:"), F.sha2("x", 256)).alias("h")).head()[0] if each.limit(1).count() else None


def task_fingerprint(spark: SparkSession, folder: str) -> str | None:
    """Of what defines a task: any change in it gives another."""
    return files_hash(spark, [f"{folder}/{n}" for n in FINGERPRINTED])


def run_hash(task: Column, model: Column, max_steps: Column, mode: Column, policy_id: Column, policy_version: Column) -> Column:
    """How a run was configured, as one value."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in (task, model, max_steps, mode, policy_id, policy_version)]), 256))


def resolve_task(names: list[str], wanted: str) -> str | None:
    """A task by its name, else the only one that starts with it (or with ``task-`` and it); None if none or several do."""
    if wanted in names:
        return wanted
    starts = tuple(p.lower() for p in (wanted, f"task-{wanted}"))
    found = sorted({n for n in names if n.lower().startswith(starts)})
    return found[0] if len(found) == 1 else None
