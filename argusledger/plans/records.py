"""Queries over records of runs and files: profiles' rules, rejected rows by number, digests of folders, archives, supporting transfers."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argusledger.operators import digests, evidence, merge, profiles, results, risk
from argusledger.plans.catalogue import _CLAIMS, _GAPPED, _ISSUES, _RUNS, GAPS, _case, _documents, _place, _scored, _status, active, query, run_results
from argusledger.sources import archive, documents, places, readers
from argusledger.sources import schema as S


def _broken() -> list[str]:
    """Texts of a sound profile (run ``RUN``) and of broken ones, one for each case of the SQL below."""
    good: dict = dict.fromkeys(profiles.TOP, "x")
    good |= {name: dict.fromkeys(keys, "PASS") for name, keys in profiles.PARTS.items()}
    good["deployment_decision"]["reasons"] = [dict.fromkeys(profiles.REASON_KEYS)]
    good["provenance"]["run_id"] = "RUN"
    good |= {"metrics": [dict.fromkeys(profiles.METRIC_KEYS) | {"status": "PASS"}], "not_evaluated_dimensions": ["a"], "operational_capabilities": [], "result_hash": "sha256:RUN"}
    changes = [{}, {"policy": {"id": "RUN", "name": None, "version": 1}}, {"metrics": None}, {"metrics": [{**good["metrics"][0], "status": "ODD"}, 5]}, {"deployment_decision": {**good["deployment_decision"], "overall": "MAYBE", "reasons": 1}}, {"provenance": {"run_id": None}, "result_hash": 7}]
    return [*[json.dumps({**good, **c}) for c in changes], '{"run_id": "RUN", "run_id": "RUN"}', '["RUN"]', '{"RUN"']


_RULES = """case doc_id % 9 when 0 then '' when 1 then 'policy: no path' when 2 then 'no metrics; metrics: not an array' when 3 then 'metrics[0]: unknown status ODD; metrics[1]: not an object'
when 4 then 'deployment_decision: unknown decision MAYBE; deployment_decision: reasons are no array'
when 5 then 'provenance: no started_at_utc; provenance: no completed_at_utc; provenance: no benchmark_version; provenance: no policy_id; provenance: no policy_version; result_hash: not sha256:...; provenance: no run to trace it to'
when 7 then 'not an object' else 'not JSON' end"""


@query(f"select doc_id, {_RULES} as violations from labels")
def profile_violations(V):
    """DOM-17: a profile for each label, sound or broken in one of eight ways."""
    V("runs")
    text = F.replace(F.get(F.array(*map(F.lit, _broken())), (F.col("doc_id") % 9).cast("int")), F.lit("RUN"), F.col("doc_id").cast("string"))
    parsed = active().table("labels").select("doc_id", F.try_parse_json(text).alias("profile"))
    return parsed.select("doc_id", F.array_join(profiles.violations(F.col("profile")), "; ").alias("violations"))


_REJECTS = "nr as (select transaction_id, row_number() over (order by transaction_id) as row_number, case when substr(transaction_id, 2)::bigint % 11 = 3 then 'invalid amount' when substr(transaction_id, 2)::bigint % 13 = 4 then 'invalid timestamp' end as problem from txn)"


@query("select row_number, transaction_id as record, problem, row_number = min(row_number) over () as is_first from nr where problem is not null", _REJECTS)
def numbered_rejects(V):
    """FLT-01: all orders in a CSV of many files; each bad row by its number in the files' order, the first as the strict reader names it."""
    spark, path = active(), _place("rejects")
    key = F.substring("transaction_id", 2, 20).cast("long")
    rows = V("txn").select(F.col("transaction_id").alias("txn_id"), "source_account", "destination_account", F.when(key % 11 == 3, "1x").otherwise(F.col("amount").cast("string")).alias("amount"), "currency",
                           F.when(key % 13 == 4, "soon").otherwise(F.col("ts").cast("string")).alias("timestamp"))
    rows.repartitionByRange("txn_id").sortWithinPartitions("txn_id").write.option("header", True).csv(path)
    mapped = readers.map_transactions(places.placed(spark.read.option("header", True).csv(path)), "csv", exact=True)
    try:
        readers.strict(mapped)
        first = None
    except S.NormalisationError as e:
        first = int(re.match(r"row (\d+):", str(e)).group(1))
    return readers.bad_rows(mapped).withColumn("is_first", F.col("row_number") == F.lit(first).cast("long"))


_DIGESTS = """l0 as (select o_custkey // 500 as part, row_number() over (partition by o_custkey // 500 order by o_orderkey) - 1 as number, concat(o_orderkey, ';', o_custkey, ';', o_orderstatus) as line from orders),
l1 as (select part, number // 4096 as number, sha256(string_agg(sha256(line), '' order by number)) as h, sum(length(line) + 1) as size from l0 group by part, number // 4096),
l2 as (select part, number // 4096 as number, sha256(string_agg(h, '' order by number)) as h, sum(size) as size from l1 group by part, number // 4096),
l3 as (select part, sha256(string_agg(h, '' order by number)) as h, sum(size) as size from l2 group by part)"""


@query(f"with {_DIGESTS} select part, cast(size as bigint) as length, sha256(concat(cast(size as bigint), ':', h)) as digest from l3")
def dataset_digests(V):
    """DOM-21, SCL-13: a file for 500 customers' orders; the digest of each, from its lines."""
    V("txn")
    path = _place("digests")
    lines = active().table("orders").select(F.floor(F.col("o_custkey") / 500).alias("part"), F.col("o_orderkey").alias("at"), F.concat_ws(";", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus").alias("value"))
    lines.repartition("part").sortWithinPartitions("part", "at").drop("at").write.partitionBy("part").text(path)
    return digests.file_digests(active(), path).select(F.regexp_extract("name", r"^part=(\d+)/", 1).cast("long").alias("part"), "length", "digest")


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false"}).alias("value"))


@query("select 'profile' as kind, run_id, 1 as copies, decision as verdict from dg union all select 'result', r.run_id, 1, case when required_failed = 0 and (n % 5 = 0 or q >= 0.8) then 'PASS' else 'FAIL' end from runs r join dc using (run_id)", _RUNS + _GAPPED)
def run_archives(V):
    """SNK-08, SNK-09: profiles and results of all runs, archived twice; the archives hold each once."""
    spark, path = active(), _place("archive")
    docs = _texts(_documents(V).drop("path"))
    results = _texts(run_results(V))
    for _ in range(2):
        archive.archive(docs, f"{path}/profiles", "$.provenance.run_id", lambda rows: profiles.invalid_documents(rows, "value", "value"))
        archive.archive(results, f"{path}/results", "$.run_id")
    found = None
    for kind, run, verdict in (("profile", "$.provenance.run_id", "$.status_summary.assurance_decision"), ("result", "$.run_id", "$.overall_verdict")):
        rows = archive.read_archive(spark, f"{path}/{kind}s").select(F.lit(kind).alias("kind"), F.get_json_object("value", run).alias("run_id"), F.get_json_object("value", verdict).alias("verdict"))
        rows = rows.groupBy("kind", "run_id").agg(F.count("*").cast("int").alias("copies"), F.min("verdict").alias("verdict"))
        found = rows if found is None else found.unionByName(rows)
    return found.select("kind", "run_id", "copies", "verdict")


_JUDGED = """ju as (select conv_id as report_id, sum(case when turn % 3 = 0 then 0 else 2 end) as score, 2 * count(*) as most from conversations group by 1),
rt as (select report_id, count(*) as n, count(*) filter (where scored <> 'supported') as bad from sc group by 1)"""


@query("select report_id, cast(score as bigint) as score, round_even(score / most, 4) as percentage, case when round_even(score / most, 4) >= 0.6 then 'PASS' else 'FAIL' end as verdict, round_even(bad / n, 4) as eghr_rate, n as claims from ju join rt using (report_id)", f"{_CLAIMS}, {_JUDGED}")
def judge_archive(V):
    """SNK-11, DOM-18: a judge's document for each conversation, archived, and read again."""
    rates = evidence.hallucination_rate(_scored(V))
    V("claims")
    scores = active().table("conversations").select(F.col("conv_id").alias("run_id"), F.when(F.col("turn") % 3 == 0, 0).otherwise(2).alias("score"), F.lit(2).alias("max"))
    totals = evidence.rubric_totals(scores, 0.6).withColumnRenamed("run_id", "report_id")
    path = _place("judged")
    made = documents.judge_documents(totals, rates, task="t", model="m")
    archive.archive(made.select(F.to_json(F.struct("report_id", F.try_parse_json("judge").alias("judge"))).alias("value")), path, "$.report_id")
    judge = F.get_json_object("value", "$.judge")
    m = documents.judge_metrics(judge)
    at = lambda k: F.get_json_object("value", k)
    return archive.read_archive(active(), path).select(at("$.report_id").cast("long").alias("report_id"), at("$.judge.overall_score").cast("long").alias("score"), m["task_performance_percentage"].alias("percentage"), at("$.judge.verdict").alias("verdict"), m["eghr_rate"].alias("eghr_rate"), at("$.judge.eghr.total_claims").cast("long").alias("claims"))


_RESULTS = """tr as (select concat('run', doc_id % 50) as run_id, count(*) as total, count(*) filter (where quality = 1 and toxic = 0) as passed, count(*) filter (where toxic = 1) as failed from labels where doc_id % 50 % 7 <> 0 group by 1),
fr as (select concat('run', doc_id % 50) as run_id, count(*) as files, cast(sum(case when doc_id % 2 = 0 then 2 end) as bigint) as citations from labels where doc_id % 50 % 11 <> 0 group by 1),
rr as (select r.*, t.total, t.passed, t.failed, f.files, f.citations, case when coalesce(failed, 0) = 0 then 'PASS' else 'FAIL' end as tests, case when n % 5 <> 0 then case when q >= 0.8 then 'PASS' else 'FAIL' end end as judge from runs r left join tr t using (run_id) left join fr f using (run_id))"""


@query("""select run_id, cast(n + 0.25 as double) as elapsed_seconds, tests, total, failed, failed as failures, coalesce(files, 0) as files, coalesce(citations, 0) as citations,
case when judge is null then 'not run' when n % 3 = 0 then 'no report' when n % 3 = 1 and n % 2 = 1 then 'not JSON' else judge end as judge,
case when tests = 'PASS' and (judge is null or judge = 'PASS') then 'PASS' else 'FAIL' end as overall_verdict,
case when tests = 'PASS' then concat('xUnit PASS (', passed, '/', total, ')') else concat('xUnit FAIL (', failed, ' assertion(s))') end
|| case when judge is not null and n % 3 <> 0 and not (n % 3 = 1 and n % 2 = 1) then printf('; judge %s at %.1f%%', judge, q * 100) else '' end as overall_reason from rr""", _RESULTS)
def whole_results(V):
    """SNK-08: a whole result for each run, archived, and read again part by part."""
    runs = V("runs")
    labels = active().table("labels").withColumn("run", F.concat(F.lit("run"), F.col("doc_id") % 50))
    tests = labels.filter("doc_id % 50 % 7 <> 0").select("run", F.col("doc_id").cast("string").alias("test_name"), F.when(F.col("toxic") == 1, "Failed").when(F.col("quality") == 1, "Passed").otherwise("NotExecuted").alias("outcome"),
                                                         F.lit("00:01").alias("duration"), F.lit("is toxic").alias("message"), F.lit(None).cast("string").alias("stack_trace"))
    text = F.col("doc_id") % 2 == 0
    files = labels.filter("doc_id % 50 % 11 <> 0").select(F.col("run").alias("run_id"), F.concat(F.lit('d"'), "doc_id", F.when(text, ".md").otherwise(".bin")).alias("name"), F.lit(9).alias("size_bytes"), F.lit(None).cast("array<map<string,string>>").alias("rows"),
                                                          F.when(text, "T1-001\nT1-002").alias("content_preview"), F.when(text, 2).alias("citation_count"))
    failed = tests.filter("outcome = 'Failed'").select(F.col("run").alias("run_id")).distinct().withColumn("tests_exit_code", F.lit(1))
    verdict, start = F.when(F.col("q") >= 0.8, "PASS").otherwise("FAIL"), F.lit("2026-01-05 00:00:00").cast("timestamp")
    rows = runs.join(failed, "run_id", "left").select(
        "run_id", start.alias("started_at"), F.timestamp_micros(F.unix_micros(start) + F.col("n") * 1_000_000 + 250_000).alias("completed_at"), F.lit("t").alias("task"), F.lit("in").alias("source"), F.lit("a").alias("agent"), F.lit(None).cast("string").alias("model"), F.lit(12).alias("max_steps"),
        F.lit("local").alias("mode"), F.lit("w").alias("workspace"), F.lit(0).alias("agent_exit_code"), F.coalesce("tests_exit_code", F.lit(0)).alias("tests_exit_code"), F.when(F.col("n") % 5 != 0, F.when(F.col("q") >= 0.8, 0).otherwise(1)).alias("judge_exit_code"))
    report = F.when((F.col("n") % 3 == 1) & (F.col("n") % 2 == 1), "{").otherwise(F.to_json(F.struct(verdict.alias("verdict"), F.col("q").alias("overall_percentage"))))
    judges = runs.filter("n % 3 <> 0").select("run_id", report.alias("judge"))
    path = _place("whole")
    archive.archive(results.result_documents(rows, tests, files, judges).select("value"), path, "$.run_id")
    doc = F.parse_json("value")
    at = lambda k, kind="string": F.try_variant_get(doc, f"$.{k}", kind)
    entries = F.map_values(F.try_variant_get(doc, "$.agent_outputs", "map<string,variant>"))
    judge = F.when(at("judge.was_run", "boolean") == F.lit(False), "not run").when(at("judge.report_present", "boolean") == F.lit(False), "no report").when(at("judge.parse_error").isNotNull(), "not JSON").otherwise(at("judge.verdict"))
    cited = F.aggregate(entries, F.lit(0).cast("long"), lambda n, e: n + F.coalesce(F.try_variant_get(e, "$.citation_count", "long"), F.lit(0)))
    return archive.read_archive(active(), path).select(
        at("run_id").alias("run_id"), at("elapsed_seconds", "double").alias("elapsed_seconds"), at("xunit.verdict").alias("tests"), at("xunit.total", "long").alias("total"), at("xunit.failed", "long").alias("failed"), F.size(at("xunit.failures", "array<variant>")).cast("long").alias("failures"),
        F.size(entries).cast("long").alias("files"), cited.alias("citations"), judge.alias("judge"), at("overall_verdict").alias("overall_verdict"), at("overall_reason").alias("overall_reason"))


_CASES = """, ir as (select concat('run', cast(substr(record_id, 2) as bigint) % 100) as run_id, count(*) as invalid from (select record_id from ri union all select record_id from refs where upper(ref) not in (select id from ids where type = 'transaction')) x group by 1),
cp as (select d.*, r.n, r.n % 3 <> 0 as has_case, case when r.n % 3 <> 0 then coalesce(invalid, 0) end as invalid from dg d join runs r using (run_id) left join ir using (run_id))"""


@query("""select run_id, case when invalid > 0 then 'NOT_READY_FOR_DEPLOYMENT' else decision end as decision, has_case as present, case when has_case then case when invalid > 0 then 'failed' else 'passed' end end as status, invalid,
cast((select count(*) from st where st.run_id = cp.run_id and st.status = 'FAIL') + case when invalid > 0 then 1 else 0 end as bigint) as reasons, case when has_case then invalid > 0 and decision <> 'NOT_READY_FOR_DEPLOYMENT' end as blocked_by_case, 'x/y' as restrictions,
'sha256:' || sha256(concat_ws('|', concat('task', n % 3), 'm1', '9', 'local', 'p1', '1')) as config_hash, cast(0.5 as double) as rate from cp""", _RUNS + _GAPPED + ", " + _ISSUES + _CASES)
def case_profiles(V):
    """SNK-09, DOM-12: whole profiles; issues of the merged case block the runs that they belong to."""
    runs = V("runs")
    run = F.concat(F.lit("run"), F.substring("record_id", 2, 20).cast("long") % 100)
    issues = merge.validate(active(), _case(V)).withColumn("run_id", run)
    cases = results.case_integrity(runs.filter("n % 3 <> 0").select("run_id", F.lit("sha256:0").alias("canonical_case_hash")), issues)
    report = F.lit('{"model":"j","pass_threshold_overall":0.8,"eghr":{"rate":0.5},"claims":[]}')
    rows = runs.select("run_id", F.lit("a").alias("agent"), F.lit("m1").alias("model"), F.concat(F.lit("task"), F.col("n") % 3).alias("task"), F.lit(0).alias("tests"), F.lit(None).cast("int").alias("judge"), F.lit(9).alias("max_steps"), F.lit("local").alias("mode"), report.alias("report"), F.lit(0).alias("agent_exit_code"))
    meta = {k: "x" for k in ("generated_at_utc", "benchmark", "jurisdiction_profile", "started_at_utc", "completed_at_utc", "benchmark_version")}
    made = profiles.profiles(rows, _status(V), list(GAPS), {"id": "p1", "name": "p", "version": "1", "path": "p.json"}, meta, cases, ["x", "y"])
    path = _place("whole")
    archive.archive(_texts(made), path, "$.provenance.run_id", lambda rows: profiles.invalid_documents(rows, "value", "value"))
    doc = F.parse_json("value")
    at = lambda k, kind="string": F.try_variant_get(doc, f"$.{k}", kind)
    case = "case_evidence_integrity"
    return archive.read_archive(active(), path).select(
        at("provenance.run_id").alias("run_id"), at("status_summary.assurance_decision").alias("decision"), at(f"{case}.present", "boolean").alias("present"), at(f"{case}.status").alias("status"), at(f"{case}.invalid_source_evidence_reference.count", "long").alias("invalid"),
        F.size(at("deployment_decision.reasons", "array<variant>")).cast("long").alias("reasons"), F.when(at(f"{case}.present", "boolean"), at("deployment_decision.reason").startswith("the case has")).alias("blocked_by_case"),
        F.array_join(at("deployment_restrictions", "array<string>"), "/").alias("restrictions"), at("provenance.benchmark_config_hash").alias("config_hash"), at("evidence_summary.eghr.rate", "double").alias("rate"))


_SUPPORT = "tx as (select src, dst, cast(amount as decimal(18,2)) as amount, sar, concat(src, '>', dst, '@', strftime(ts, '%Y-%m-%d %H:%M:%S')) as txn_id from transfers), sd as (select src as account_id, txn_id, amount as sent, cast(0 as decimal(18,2)) as got, sar from tx union all select dst, txn_id, 0, amount, sar from tx), ac as (select account_id, cast(sum(sent) as double) as sent, cast(sum(got) as double) as got, count(*) filter (where sent > 0) as n_out, count(*) filter (where got > 0) as n_in, bool_or(sar) as sar from sd group by 1), th as (select *, least(sent, got) / greatest(sent, got) as through from ac), kd as (select *, case when n_in >= 1 and n_out >= 1 and through >= 0.8 and sar then 'mule' when n_in >= 3 and n_out <= 1 then 'collector' when n_out >= 3 and n_in <= 1 then 'distributor' when sar then 'suspicious' else 'legitimate' end as kind from th)"


@query("select account_id, kind as classification, round_even(case kind when 'mule' then through when 'legitimate' then 0.5 else 0.7 end, 4) as confidence, txn_id from kd join (select distinct account_id, txn_id from sd) using (account_id)", _SUPPORT)
def mule_support(V):
    """TSK-07: a row for each account and supporting transfer."""
    rows = V("transfers").withColumn("txn_id", F.concat("src", F.lit(">"), "dst", F.lit("@"), F.col("ts").cast("string")))
    return risk.mule_support(rows)
