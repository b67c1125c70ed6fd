"""Control documents: cases, policies, profiles, gold sets, test results, reports' files.

A document of one run is read on the driver; tables of documents (one a row) stay on the executors.  All files are read
and written through Spark, so any store that it knows will do.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argusledger.functions import normalise as N
from argusledger.operators import assurance
from argusledger.sources import readers
from argusledger.sources import schema as S

# A bundle's header and the mark of a missing file.
HEADER, MISSING = "----- {label}:{name} -----", "[MISSING FILE]"
# Files that brief an agent and are not its output, and how a profile's parts are called.
BRIEFS = ("instruction.md", "prompt.md", "expected-behaviour.md", "tests.md", "judge_report.json", "bench_result.json")
PREVIEW, CUT_MARK = 4000, "\n...[truncated]"
METRIC = "struct<metric:string,label:string,value:double,unit:string,threshold:double,direction:string,required:boolean,status:string>"
REASON = "struct<metric:string,label:string,actual:double,threshold:double,rule:string,severity:string>"
PROFILE = (
    "schema_version string, disclaimer string, generated_at_utc string, status_summary struct<execution_status:string,benchmark_verdict:string,assurance_decision:string>,"
    " agent struct<name:string,model:string,max_steps:long,mode:string>, benchmark string, scenario_pack string, operational_capabilities array<string>, jurisdiction_profile string,"
    f" policy struct<id:string,name:string,version:string,path:string>, metrics array<{METRIC}>, not_evaluated_dimensions array<string>,"
    f" deployment_decision struct<overall:string,reason:string,evaluated_metric_count:long,total_defined_dimension_count:long,reasons:array<{REASON}>>,"
    " deployment_restrictions array<string>, evidence_summary struct<evidence_traceability:struct<precision:double,recall:double>>, case_evidence_integrity variant,"
    " provenance struct<run_id:string,workspace:string,started_at_utc:string,completed_at_utc:string,execution_mode:string,benchmark_version:string,git_commit_sha:string,policy_id:string,policy_version:string,policy_file_hash:string,dataset_hash:string,"
    "rubric_hash:string,task_fingerprint:string,benchmark_config_hash:string,model_identifier:string,judge_model:string>, result_hash string"
)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def read_text(spark: SparkSession, path: str) -> str:
    """A whole file, which must be small (a control document)."""
    if not exists(spark, path):
        raise S.SourceError(f"{path}: no such file")
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0].value if rows else ""


def read_object(spark: SparkSession, path: str) -> dict:
    try:
        out = json.loads(read_text(spark, path))
    except ValueError as e:
        raise S.InvalidConfiguration(f"{path}: not JSON: {e}") from e
    if not isinstance(out, dict):
        raise S.InvalidConfiguration(f"{path}: not an object")
    return out


# --- cases and policies ----------------------------------------------------------------------


@dataclass(frozen=True)
class CaseSource:
    source_type: str
    path: str | None = None
    role: str | None = None
    connection_profile: str | None = None
    query: str | None = None
    options: dict[str, str] = field(default_factory=dict)

    def arguments(self) -> dict:
        """What the source's adapter is called with.  A live source's connection is its profile's, from the environment; an option
        ``AuthTokenProfile`` names that of a token."""
        kind = self.source_type.lower()
        place = readers.Registry.CONNECTED.get(kind)
        if place is None:
            if not self.path:
                raise S.InvalidConfiguration(f"{self.source_type}: a path is needed")
            return {"path": self.path, **self.options}
        out = {place: _connection(self.source_type, self.connection_profile), "name": self.connection_profile, **self.options}
        token = out.pop("AuthTokenProfile", None)
        if token and token.strip():
            out["token"] = _connection(self.source_type, token)
        if self.query and self.query.strip():
            out["path" if kind == "rest" else "query"] = self.query
        return out


def _connection(kind: str, profile: str | None) -> str:
    if not profile or not profile.strip():
        raise S.InvalidConfiguration(f"{kind}: a connection_profile is needed")
    try:
        return N.connection(profile)
    except LookupError as e:
        raise S.InvalidConfiguration(str(e.args[0])) from None


@dataclass(frozen=True)
class CaseFile:
    case_id: str
    sources: list[CaseSource]

    def definitions(self) -> list[tuple[str, str, Callable[[], dict]]]:
        """For :func:`argusledger.operators.merge.load_case`, in the file's order; profiles are resolved as each source is loaded."""
        return [(s.role or s.path or s.connection_profile or s.source_type, s.source_type, s.arguments) for s in self.sources]


def parse_case(text: str, folder: str | None = None) -> CaseFile:
    """A case from JSON; relative paths count from ``folder``.  Nothing is made up: what is missing is an error."""
    try:
        doc = json.loads(text)
    except ValueError as e:
        raise S.InvalidConfiguration(f"the case is not JSON: {e}") from e
    problem = None
    if not isinstance(doc, dict):
        problem = "the case is not an object"
    elif not str(doc.get("case_id") or "").strip():
        problem = "the case has no case_id"
    elif not isinstance(doc.get("sources"), list) or not doc["sources"]:
        problem = "the case has no sources"
    if problem:
        raise S.InvalidConfiguration(problem)
    out = []
    for i, s in enumerate(doc["sources"]):
        if not isinstance(s, dict) or not str(s.get("source_type") or "").strip():
            raise S.InvalidConfiguration(f"source {i} has no source_type")
        path = s.get("path")
        if path and folder and not path.startswith("/") and "://" not in path:
            path = posixpath.join(folder, path)
        options = {k: "" if v is None else str(v) for k, v in (s.get("options") or {}).items()}
        out.append(CaseSource(s["source_type"], path, s.get("role"), s.get("connection_profile"), s.get("query"), options))
    return CaseFile(doc["case_id"], out)


def read_case(spark: SparkSession, path: str) -> CaseFile:
    return parse_case(read_text(spark, path), posixpath.dirname(path))


@dataclass(frozen=True)
class Policy:
    policy_id: str | None
    version: str | None
    thresholds: DataFrame
    gaps: list[str]


def read_policy(spark: SparkSession, path: str) -> Policy:
    """Thresholds (metric, label, direction, threshold, unit, required) as a table; an impossible one is an error."""
    doc = read_object(spark, path)
    try:
        rows = [(t["metric"], t["label"], t["direction"], float(t["threshold"]), t["unit"], bool(t.get("required", True))) for t in doc.get("thresholds") or []]
    except (KeyError, TypeError, ValueError) as e:
        raise S.InvalidConfiguration(f"{path}: a threshold lacks {e}") from e
    table = spark.createDataFrame(rows, "metric string, label string, direction string, threshold double, unit string, required boolean")
    bad = assurance.validate_policy(table).limit(1).collect()
    if bad:
        raise S.InvalidConfiguration(f"{path}: {bad[0].metric}: {bad[0].problem}")
    return Policy(doc.get("policy_id"), doc.get("policy_version"), table, [str(x) for x in doc.get("not_yet_implemented_dimensions") or []])


# --- evidence --------------------------------------------------------------------------------


def read_gold(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Gold ids (id); None, not an empty table, where there is no annotation: the metrics are then not evaluable."""
    if not path or not exists(spark, path):
        return None
    ids = read_object(spark, path).get("gold_evidence_txn_ids")
    if not isinstance(ids, list):
        return None
    return spark.createDataFrame([(str(x),) for x in ids], "id string").select(F.upper("id").alias("id")).distinct()


def grounding(spark: SparkSession, paths: list[str], column: str = "txn_id") -> DataFrame:
    """Distinct ids (upper case) of all files that exist; kinds that can't be read add none."""
    found = [readers.grounding_ids(spark, p, column) for p in paths if exists(spark, p)]
    return assurance.union([spark.createDataFrame([], "id string"), *found]).select(F.upper("id").alias("id")).distinct()


def bundle(spark: SparkSession, folder: str, names: list[str], label: str) -> str:
    """The named files under headers, with a mark where one is missing."""
    parts = []
    for name in names:
        path = posixpath.join(folder, name)
        parts += [HEADER.format(label=label, name=name), read_text(spark, path) if exists(spark, path) else MISSING]
    return "\n".join(parts) + "\n" if parts else ""


def parse_claims(column: str = "claims") -> Column:
    """Claims of a judge's JSON: null-safe, without support they are unsupported."""
    raw = F.from_json(column, "array<struct<text:string,cited_txn_ids:array<string>,support:string>>")
    clean = F.transform(F.filter(raw, lambda c: c.isNotNull()), lambda c: F.struct(
        F.coalesce(c.text, F.lit("")).alias("text"), F.coalesce(c.cited_txn_ids, F.array().cast("array<string>")).alias("cited_ids"), F.coalesce(c.support, F.lit("unsupported")).alias("support")))
    return F.coalesce(clean, F.array().cast("array<struct<text:string,cited_ids:array<string>,support:string>>"))


def judge_documents(totals: DataFrame, rates: DataFrame, traces: DataFrame | None = None, **meta: str) -> DataFrame:
    """(report_id, judge): a judge's report as JSON text for each row of ``totals`` (:func:`evidence.rubric_totals`, its run_id as report_id).

    ``rates`` (:func:`evidence.hallucination_rate`) and ``traces`` (report_id and the parts of the traceability) may lack a report: it has
    no claims, and a null part.  ``meta`` (task, model, judged_at_utc) is text at the top.  One row an id is expected on each side.
    """
    # Fixed field names.
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(n) for c, n in (("claims", "total_claims"), ("supported", "supported_count"), ("unsupported", "unsupported_count"), ("contradicted", "contradicted_count"))]
    eghr = F.struct((F.coalesce("claims", F.lit(0)) > 0).alias("claims_extracted"), *counts, F.coalesce("eghr_rate", F.lit(0.0)).alias("rate"))
    rows = totals.join(rates, "report_id", "left")
    trace = F.lit(None).cast("string")
    if traces is not None:
        rows = rows.join(traces.select("report_id", F.struct(*[c for c in traces.columns if c != "report_id"]).alias("trace")), "report_id", "left")
        trace = F.col("trace")
    body = F.struct(*[F.lit(v).alias(k) for k, v in meta.items()], F.col("total").alias("overall_score"), F.col("maximum").alias("overall_max"), F.col("percentage").alias("overall_percentage"), "verdict", eghr.alias("eghr"), trace.alias("evidence_traceability"))
    return rows.select("report_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("judge"))


def judge_metrics(judge: Column) -> dict[str, Column]:
    """The four metrics that a judge's report (JSON text) holds; null where it doesn't."""
    number = lambda path: F.get_json_object(judge, path).try_cast("double")
    return {
        "eghr_rate": number("$.eghr.rate"), "evidence_traceability_f1": number("$.evidence_traceability.f1"),
        "fabricated_citation_count": F.json_array_length(F.get_json_object(judge, "$.evidence_traceability.fabricated_citations")).cast("double"),
        "task_performance_percentage": number("$.overall_percentage"),
    }


# --- runs ------------------------------------------------------------------------------------


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Transfers (txn_id, src, dst, amount, ts, sar) of a plain CSV; a missing column or a bad value is an error."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    lost = [c for c in ("txn_id", "timestamp", "source_account", "destination_account", "amount", "sar_linked") if c not in rows.columns]
    if lost:
        raise S.SourceError(f"{path}: missing column {lost[0]}")
    out = rows.select("txn_id", F.col("source_account").alias("src"), F.col("destination_account").alias("dst"), F.col("amount").try_cast("double").alias("amount"), N.parse_timestamp(F.col("timestamp")).alias("ts"), (F.col("sar_linked").try_cast("int") != 0).alias("sar"))
    bad = out.filter("amount is null or ts is null or sar is null").limit(1).collect()
    if bad:
        raise S.SourceError(f"{path}: bad row {bad[0].txn_id!r}")
    return out


def read_test_results(spark: SparkSession, path: str) -> DataFrame:
    """(run, test_name, outcome, duration, message) of all test-result files of a path: one row a single result."""
    kind = "_testName string, _outcome string, _duration string, Output struct<ErrorInfo:struct<Message:string,StackTrace:string>>"
    rows = spark.read.format("xml").option("rowTag", "UnitTestResult").option("ignoreNamespace", True).schema(kind).load(path)
    run = F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.[^./]*)?$", 1)
    return rows.select(run.alias("run"), F.col("_testName").alias("test_name"), F.col("_outcome").alias("outcome"), F.col("_duration").alias("duration"), F.col("Output.ErrorInfo.Message").alias("message"), F.col("Output.ErrorInfo.StackTrace").alias("stack_trace"))


def collect_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size_bytes, rows, content_preview, citation_count) of an agent's files, its briefs left out.

    CSV cells stay text; a Markdown file gives its start and its citations.
    """
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.col("length").alias("size_bytes"), F.col("content").cast("string").alias("text"))
    files = files.filter(~F.lower("name").isin(*BRIEFS))
    kind = F.lower(F.regexp_extract("name", r"\.[^.]*$", 0))
    lines = F.filter(F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: N.ws_trim(x) != "")
    cells = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.map_from_entries(F.filter(F.arrays_zip(F.split(F.get(lines, F.lit(0)), ",").alias("k"), F.split(x, ",").alias("v")), lambda e: e.k.isNotNull() & e.v.isNotNull())))
    start = F.when(F.length("text") <= PREVIEW, F.col("text")).otherwise(F.concat(F.left("text", F.lit(PREVIEW)), F.lit(CUT_MARK)))
    return files.select("name", "size_bytes", F.when(kind == ".csv", cells).alias("rows"), F.when(kind == ".md", start).alias("content_preview"), F.when(kind == ".md", F.size(N.citations(F.col("text")))).alias("citation_count"))


def read_profiles(spark: SparkSession, paths: list[str], least: int = 2) -> DataFrame:
    """Profiles as a table: each path a JSON document, or (``.jsonl``, or a folder) one document a line."""
    if len(paths) < least and not any(p.endswith(".jsonl") for p in paths):
        raise S.InvalidConfiguration(f"{least} profiles are needed")
    lost = [p for p in paths if not exists(spark, p)]
    if lost:
        raise S.SourceError(f"{lost[0]}: no such file")
    kind = T.StructType.fromDDL(PROFILE).add("_bad", T.StringType())
    read = lambda p: spark.read.schema(kind).option("multiLine", not p.endswith(".jsonl")).option("columnNameOfCorruptRecord", "_bad").json(p).withColumn("path", F.lit(p))
    out = assurance.union([read(p) for p in paths])
    bad = out.filter("_bad is not null or provenance is null").select("path", "schema_version", "_bad").limit(1).collect()
    if bad:
        raise S.SourceError(f"{bad[0].path}: not a profile")
    return out.drop("_bad")


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document a line (``path`` ends in .jsonl), nulls kept: an archive of any number of runs."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_files(files: DataFrame, folder: str) -> None:
    """Small text files (name, text) under their names: for a folder that people or other programs read.

    Written by the driver, one after another: control documents are few; anything larger goes to a table.
    """
    spark = files.sparkSession
    for r in files.toLocalIterator():
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{r.name}")
        out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
        out.write(bytearray(r.text.encode()))
        out.close()
