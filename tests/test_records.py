"""Profiles' rules, numbers of bad rows, digests of folders, archives, supporting transfers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from argusledger.operators import assurance, digests, profiles, risk
from argusledger.plans import records
from argusledger.sources import archive, places, readers
from argusledger.sources import schema as S

HEAD = "txn_id,source_account,destination_account,amount,currency,timestamp"


def plain_violations(profile):
    out = [f"no {k}" for k in profiles.TOP if profile.get(k) is None]

    def keys(part, names, where, empty=False):
        return [f"{where}: no {k}" for k in names if k not in part or (empty and part[k] is None)]

    for name, names in profiles.PARTS.items():
        part = profile.get(name)
        if isinstance(part, dict):
            out += keys(part, names, name, empty=name == "status_summary")
        elif name != "status_summary":
            out.append(f"{name}: not an object")
    for name in ("metrics", "not_evaluated_dimensions", "operational_capabilities"):
        if not isinstance(profile.get(name), list):
            out.append(f"{name}: not an array")
    if any(isinstance(x, dict | list) for x in profile.get("not_evaluated_dimensions") or ()):
        out.append("not_evaluated_dimensions: not all are text")
    decision = profile.get("deployment_decision")
    decision = decision if isinstance(decision, dict) else {}
    if decision.get("overall") is not None and decision["overall"] not in assurance.DECISION_RANK:
        out.append(f"deployment_decision: unknown decision {decision['overall']}")
    if not isinstance(decision.get("reasons"), list):
        out.append("deployment_decision: reasons are no array")
    for name, items, names in (("metrics", profile.get("metrics"), profiles.METRIC_KEYS), ("reasons", decision.get("reasons"), profiles.REASON_KEYS)):
        for i, x in enumerate(items if isinstance(items, list) else []):
            if not isinstance(x, dict):
                out.append(f"{name}[{i}]: not an object")
                continue
            out += keys(x, names, f"{name}[{i}]")
            if name == "metrics" and x.get("status") is not None and x["status"] not in profiles.STATES:
                out.append(f"metrics[{i}]: unknown status {x['status']}")
    if not str(profile.get("result_hash") or "").startswith("sha256:"):
        out.append("result_hash: not sha256:...")
    if not isinstance(profile.get("provenance"), dict) or profile["provenance"].get("run_id") is None:
        out.append("provenance: no run to trace it to")
    return out


def test_violations_as_by_hand(spark):
    base, pick = json.loads(records._broken()[0]), random.Random(3)
    odd = [None, 1, "x", [], {}, [None], [{}], {"run_id": None}, [{"status": "ODD"}], {"overall": "MAYBE"}, {"overall": None, "reasons": [{"metric": 1}, 2]}, True]
    documents = [base]
    for _ in range(300):
        doc = dict(base)
        for k in pick.sample(sorted(doc), pick.randint(1, 3)):
            if pick.random() < 0.3:
                del doc[k]
            elif isinstance(doc[k], dict) and pick.random() < 0.5:
                doc[k] = {n: v for n, v in doc[k].items() if pick.random() < 0.7}
            else:
                doc[k] = pick.choice(odd)
        if not isinstance(doc.get("not_evaluated_dimensions", []), int | None):  # a number there, the plain version can't go through
            documents.append(doc)
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "k long, t string")
    got = {r.k: r.violations for r in profiles.invalid_documents(rows, "t", "k").collect()}
    want = {i: v for i, d in enumerate(documents) if (v := plain_violations(d))}
    assert got == want and len(want) > 200
    edges = spark.createDataFrame([(1, None), (2, ""), (3, "null"), (4, '{"a": 1, "a": 2}'), (5, json.dumps({**base, "disclaimer": "y" * 2_000_000})), (None, "x"), (None, "x")], "k long, t string")
    found = sorted((str(r.k), r.violations) for r in profiles.invalid_documents(edges, "t", "k").collect())
    assert found == [("1", ["not JSON"]), ("2", ["not JSON"]), ("3", ["not an object"]), ("4", ["not JSON"]), ("None", ["not JSON"]), ("None", ["not JSON"])]
    assert profiles.invalid_documents(edges.limit(0), "t", "k").count() == 0


@pytest.mark.parametrize("kind", ["csv", "jsonl", "parquet"])
def test_row_numbers_over_files_and_splits(spark, tmp_path, kind):
    n, bad, path = 5000, (1234, 4321), f"{tmp_path}/x.{kind}"
    rows = spark.range(n).select(F.format_string("T%06d", "id").alias("txn_id"), F.lit("A").alias("source_account"), F.lit("B").alias("destination_account"), F.when(F.col("id").isin(*bad), "x").otherwise("1").alias("amount"), F.lit("USD").alias("currency"), F.lit("2026-01-05").alias("timestamp"))
    out = rows.repartitionByRange(5, "txn_id").sortWithinPartitions("txn_id").write.option("header", True)
    getattr(out, {"jsonl": "json"}.get(kind, kind))(path)
    own = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        read = getattr(readers, {"jsonl": "read_json"}.get(kind, f"read_{kind}"))
        with pytest.raises(S.NormalisationError, match=r"^row 1235: invalid amount \(record 'T001234'\)"):
            read(spark, path)
        if kind == "csv":
            placed = places.placed(spark.read.option("header", True).csv(path))
            assert placed.rdd.getNumPartitions() > 5
            got = readers.bad_rows(readers.map_transactions(placed, "csv", exact=True))
            assert sorted((r.row_number, r.record) for r in got.collect()) == [(b + 1, f"T{b:06}") for b in bad]
            assert [r.txn_id for r in places.with_numbers(placed).orderBy("row_number").collect()] == [f"T{i:06}" for i in range(n)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_row_numbers_of_documents_and_of_nothing(spark, tmp_path):
    row = lambda i, a: {"txn_id": i, "source_account": "a", "destination_account": "b", "amount": a, "timestamp": "2026-01-01"}
    (tmp_path / "list.json").write_text(json.dumps([row("T1", 1), row("T2", "x"), row("T3", None)], indent=1))
    lines = ",\n".join(json.dumps(row(i, a)) for i, a in (("T1", 1), ("T2", 2), ("T3", "x")))
    (tmp_path / "lines.json").write_text(f"[\n{lines}\n]\n")
    for name, message in (("list", "row 2: invalid amount"), ("lines", "row 3: invalid amount")):
        with pytest.raises(S.NormalisationError, match=message):
            readers.read_json(spark, f"{tmp_path}/{name}.json")
    (tmp_path / "none.csv").write_text(f"{HEAD}\n")
    (tmp_path / "some.csv").write_text(f"{HEAD},_extra\n,,,,,,\nT1,A,B,1,USD,2026-01-05,{'long' * 50_000}\n")
    found = lambda name: [tuple(r) for r in readers.bad_rows(readers.map_transactions(places.placed(spark.read.option("header", True).csv(f"{tmp_path}/{name}.csv")), "csv", exact=True)).collect()]
    assert found("none") == [] and found("some") == [(1, None, "missing transaction_id")]
    assert readers.read_csv(spark, f"{tmp_path}/none.csv").collections["transactions"].columns == [c for c in readers.map_transactions(spark.createDataFrame([], "txn_id string"), "csv").columns if c != "problem"]


def test_digests_tell_every_change(spark, tmp_path):
    import hashlib

    sha = lambda x: hashlib.sha256(x).hexdigest()
    folder = tmp_path / "a folder+x"
    (folder / "in").mkdir(parents=True)
    contents = {"in/a b.txt": b"\xff\x00\r\n\n1", "plus+100%.bin": b"x" * 100_000, "lines": b"".join(b"%d\n" % i for i in range(9000))}
    for name, body in contents.items():
        (folder / name).write_bytes(body)

    def plain(body):
        level = [sha(x) for x in (body[:-1] if body.endswith(b"\n") else body).split(b"\n")]
        for _ in range(3):
            level = [sha("".join(level[i : i + 4096]).encode()) for i in range(0, len(level), 4096)]
        return sha(f"{len(body)}:{''.join(level)}".encode())

    got = {r.name: (r.length, r.digest) for r in digests.file_digests(spark, str(folder)).collect()}
    assert got == {n: (len(b), plain(b)) for n, b in contents.items()}
    first = digests.dataset_hash(spark, str(folder))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        assert digests.dataset_hash(spark, str(folder)) == first  # however the files are split
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    seen = {first}
    for change in (lambda: (folder / "lines").write_bytes(contents["lines"] + b"\n"), lambda: (folder / "lines").write_bytes(b"1" + contents["lines"][1:]), lambda: (folder / "lines").rename(folder / "line"), lambda: (folder / "line").unlink()):
        change()
        seen.add(digests.dataset_hash(spark, str(folder)))
    assert len(seen) == 5 and digests.dataset_hash(spark, f"{tmp_path}/none") is None
    one = digests.file_digests(spark, f"{folder}/in/a b.txt").collect()
    assert [(r.name, r.digest) for r in one] == [("a b.txt", plain(contents["in/a b.txt"]))]
    (tmp_path / "empty").mkdir()
    assert digests.dataset_hash(spark, f"{tmp_path}/empty") is None


def test_archives(spark, tmp_path):
    path = f"{tmp_path}/runs"
    table = lambda *texts: spark.createDataFrame([(x,) for x in texts], "`a.b` string")
    run = lambda i, x=1: json.dumps({"run_id": i, "x": x})
    read = lambda: sorted(json.loads(r.value)["run_id"] for r in archive.read_archive(spark, path).collect())
    assert read() == [] and archive.archive(table(), path, "$.run_id") == {"written": 0, "kept": 0}
    assert archive.archive(table(run("a"), run("a"), json.dumps({"run_id": "b"}, indent=2)), path, "$.run_id") == {"written": 2, "kept": 0}
    assert archive.archive(table(run("a"), run("c")), path, "$.run_id") == {"written": 1, "kept": 1} and read() == ["a", "b", "c"]
    for texts, message in (((run("d"), run("d", 2)), "two documents that differ"), ((run("a", 2), run("e")), "run a has two documents"), ((run("d"), "{}"), "no \\$.run_id"), ((run("d"), None), "no \\$.run_id")):
        with pytest.raises(S.SourceError, match=message):
            archive.archive(table(*texts), path, "$.run_id")
    flaws = lambda rows: profiles.invalid_documents(rows, "value", "value")
    good, broken = (json.loads(records._broken()[i].replace("RUN", f"r{i}")) for i in (0, 1))
    with pytest.raises(S.SourceError, match="run r1: policy: no path"):
        archive.archive(table(json.dumps(good), json.dumps({**broken})), f"{tmp_path}/p", "$.provenance.run_id", flaws)
    assert archive.read_archive(spark, f"{tmp_path}/p").count() == 0
    assert archive.archive(table(json.dumps(good)), f"{tmp_path}/p", "$.provenance.run_id", flaws)["written"] == 1
    assert read() == ["a", "b", "c"]


def test_support_of_a_hot_account(spark):
    rows = spark.range(6000).select(F.lit("hot").alias("src"), F.concat(F.lit("d"), F.col("id") % 50).alias("dst"), F.col("id").cast("string").alias("txn_id"), F.lit(1.0).alias("amount"), F.lit(False).alias("sar"))
    rows = rows.unionByName(rows.limit(1))  # a repeated row
    got = risk.mule_support(rows)
    assert got.count() == 12_000 and got.filter("account_id = 'hot'").select("classification").distinct().collect()[0][0] == "distributor"
    assert {r.account_id: r.classification for r in risk.mule_accounts(rows).collect()} == {r.account_id: r.classification for r in got.select("account_id", "classification").distinct().collect()}
    assert risk.mule_support(rows.limit(0)).count() == 0


def test_judge_documents(spark):
    from argusledger.operators import evidence
    from argusledger.sources import documents

    scores = spark.createDataFrame([("a", 1, 2), ("a", 2, 2), ("b", None, 2)], "run_id string, score int, max int")
    totals = evidence.rubric_totals(scores, 0.7).withColumnRenamed("run_id", "report_id")
    rates = spark.createDataFrame([("a", 4, 2, 1, 1, 0.5)], "report_id string, claims long, supported long, unsupported long, contradicted long, eghr_rate double")
    traces = spark.createDataFrame([("a", ["T1"], 0.25)], "report_id string, fabricated_citations array<string>, f1 double")
    made = documents.judge_documents(totals, rates, traces, task="t", model="m")
    got = {r.report_id: json.loads(r.judge) for r in made.collect()}
    assert (got["a"]["task"], got["a"]["overall_score"], got["a"]["verdict"], got["a"]["eghr"]["contradicted_count"], got["a"]["evidence_traceability"]) == ("t", 3, "PASS", 1, {"fabricated_citations": ["T1"], "f1": 0.25})
    assert got["b"]["eghr"] == {"claims_extracted": False, "total_claims": 0, "supported_count": 0, "unsupported_count": 0, "contradicted_count": 0, "rate": 0.0} and got["b"]["evidence_traceability"] is None
    m = documents.judge_metrics(F.col("judge"))
    read = made.filter("report_id = 'a'").select(*[c.alias(k) for k, c in m.items()]).first()
    assert read.asDict() == {"eghr_rate": 0.5, "evidence_traceability_f1": 0.25, "fabricated_citation_count": 1.0, "task_performance_percentage": 0.75}
    assert documents.judge_documents(totals.limit(0), rates).count() == 0


def test_result_documents(spark):
    from argusledger.operators import results

    runs = spark.sql("""select id as run_id, timestamp'2026-01-01 00:00:00' as started_at, timestamp'2026-01-01 00:00:02.125' as completed_at, 't' as task, 's' as source, 'a' as agent, null as model, 3 as max_steps, 'm' as mode, 'w' as workspace, 0 as agent_exit_code,
        case when id = 'a' then 1 else 0 end as tests_exit_code, case when id = 'c' then null else 0 end as judge_exit_code from values ('a'), ('b'), ('c'), ('d') as v(id)""")
    tests = spark.createDataFrame([("a", "t1", "Failed", "1", "m" * 100_000, None), ("a", "t1", "Failed", "1", "m" * 100_000, None), ("a", "t2", "Passed", None, None, None), ("b", "t", "Odd", None, None, None), ("other", "t", "Failed", None, None, None)], "run string, test_name string, outcome string, duration string, message string, stack_trace string")
    files = spark.createDataFrame([("a", 'q"\\é.md', 3, None, "", 0), ("a", "x.csv", 5, [{"k": "1"}], None, None), ("a", "x.csv", 5, [{"k": "1"}], None, None), ("a", "z.bin", None, None, None, None), ("a", None, 1, None, None, None), ("b", "e.csv", 0, [], None, None)],
                                  "run_id string, name string, size_bytes long, rows array<map<string,string>>, content_preview string, citation_count long")
    judges = spark.createDataFrame([("a", '{"verdict": "PASS", "overall_percentage": 0.875, "x": [null]}'), ("c", '{"verdict": "PASS"}'), ("d", "{")], "run_id string, judge string")
    made = results.result_documents(runs, tests, files, judges)
    got = {r.run_id: json.loads(r.value) for r in made.collect()}
    failure = {"test_name": "t1", "duration": "1", "message": "m" * 100_000, "stack_trace": None}
    assert got["a"]["xunit"] == {"exit_code": 1, "verdict": "FAIL", "total": 3, "passed": 1, "failed": 2, "skipped": 0, "failures": [failure, failure], "trx_present": True}
    assert got["a"]["agent_outputs"] == {'q"\\é.md': {"size_bytes": 3, "content_preview": "", "citation_count": 0}, "x.csv": {"size_bytes": 5, "rows": [{"k": "1"}]}, "z.bin": {"size_bytes": None}}
    assert (got["a"]["elapsed_seconds"], got["a"]["started_at_utc"][:19], got["a"]["agent"]["model"], got["a"]["overall_verdict"], got["a"]["overall_reason"]) == (2.12, "2026-01-01T00:00:00", None, "FAIL", "xUnit FAIL (2 assertion(s)); judge PASS at 87.5%")
    assert got["a"]["judge"] == {"verdict": "PASS", "overall_percentage": 0.875, "x": [None]}
    assert got["b"]["xunit"]["other_outcomes"] == 1 and got["b"]["agent_outputs"] == {"e.csv": {"size_bytes": 0, "rows": []}} and got["b"]["judge"] == {"was_run": True, "exit_code": 0, "report_present": False}
    assert got["c"]["judge"] == {"was_run": False} and got["c"]["xunit"] == {"exit_code": 0, "verdict": "PASS", "trx_present": False} and got["c"]["overall_reason"] == "xUnit PASS (/)" and got["c"]["agent_outputs"] == {}
    assert got["d"]["judge"] == {"parse_error": "the report is not JSON"} and got["d"]["overall_verdict"] == "PASS"
    assert results.result_documents(runs.limit(0), tests, files, judges).count() == 0
    bare = results.result_documents(runs, tests.limit(0), files.limit(0), judges.limit(0))
    assert {json.loads(r.value)["overall_verdict"] for r in bare.collect()} == {"PASS", "FAIL"}


def test_case_integrity(spark):
    from argusledger.operators import results

    cases = spark.createDataFrame([("a", "h1"), ("b", None), ("c", "h3")], "run_id string, canonical_case_hash string")
    rows = [("a", "dangling", "evidence", "E1", "X2"), ("a", "dangling", "evidence", "E1", "X1"), ("a", "missing_transaction", "sar", "S1", None), ("a", "duplicate_evidence", "evidence", "E9", "E9"), ("a", "duplicate_evidence", "evidence", "E9", "E9"), ("b", "duplicate_evidence", "evidence", "E9", "E9"), ("x", "dangling", "evidence", "E", "X"), ("c", "odd", None, None, None)]
    issues = spark.createDataFrame(rows, "run_id string, issue string, record_type string, record_id string, ref string")
    found = {r.run_id: r for r in results.case_integrity(cases, issues).collect()}
    assert {k: (r.invalid, r.broken) for k, r in found.items()} == {"a": (3, 2), "b": (0, 1), "c": (0, 0)}
    a, c = json.loads(found["a"].integrity), json.loads(found["c"].integrity)
    assert [x["evidence_id"] for x in a["invalid_source_evidence_reference"]["dangling_references"]] == ["X1", "X2"] and a["status"] == "failed" and a["canonical_case_hash"] == "h1"
    assert c == {"present": True, "status": "passed", "case_manifest_path": "case_manifest.json", "canonical_case_hash": "h3", "invalid_source_evidence_reference": {"count": 0, "dangling_references": [], "missing_transaction_references": [], "incompatible_evidence_types": []}, "broken_canonical_evidence_lineage": {"count": 0, "duplicate_evidence_ids": []}}
    assert results.case_integrity(cases.limit(0), issues).count() == 0
    # All metrics pass: without issues the decision stays, with them it doesn't; a run without a case has a block that says so.
    runs = spark.createDataFrame([(r, "ag", "m", "t", 0, None) for r in "abcd"], "run_id string, agent string, model string, task string, tests int, judge int").withColumns({"precision": F.lit(1.0), "recall": F.lit(1.0)})
    status = runs.select("run_id", F.lit("q").alias("metric"), F.lit("Q").alias("label"), F.lit(1.0).alias("value"), F.lit("rate").alias("unit"), F.lit(0.5).alias("threshold"), F.lit("higher_is_better").alias("direction"), F.lit(True).alias("required"), F.lit("PASS").alias("status"))
    make = lambda **more: {r.provenance.run_id: r for r in profiles.profiles(runs, status, [], {"id": "p"}, {"git_commit_sha": "g", "temperature": "0"}, **more).collect()}
    got = make(cases=results.case_integrity(cases, issues), restrictions=["only tests"])
    assert {k: r.deployment_decision.overall for k, r in got.items()} == {"a": "NOT_READY_FOR_DEPLOYMENT", "b": "NOT_READY_FOR_DEPLOYMENT", "c": "PASS", "d": "PASS"}
    assert [(r.label, r.actual, r.severity) for r in got["a"].deployment_decision.reasons] == [("Invalid source evidence reference", 3.0, "critical"), ("Broken canonical evidence lineage", 2.0, "critical")]
    assert got["a"].deployment_decision.reason.startswith("the case has unresolved issues (Invalid source evidence reference; Broken") and got["c"].deployment_decision.reason == "all metrics passed"
    assert json.loads(got["d"].case_evidence_integrity.toJson()) == {"present": False} and got["a"].deployment_restrictions == ["only tests"]
    p = got["a"].provenance
    assert (p.git_commit_sha, p.agent_version, p.model_identifier, p.temperature, p.random_seed, p.judge_model) == ("g", "unversioned", "m", 0.0, None, None)
    assert len({r.result_hash for r in got.values()}) == 4 and {r.status_summary.assurance_decision for r in make().values()} == {"PASS"}
