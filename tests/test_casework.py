import json

import pytest
from pyspark.sql import functions as F

from argusledger.functions import normalise as N
from argusledger.operators import assurance, evidence, graph, merge, risk
from argusledger.plans import catalogue, connectors, records  # noqa: F401
from argusledger.sources import readers, sinks
from argusledger.sources import schema as S
from argusledger.streaming.weekly import weekly_counts


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_parity(same, name):
    same(catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_rows(spark, name):
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


CSV = """transaction_id,source_account,destination_account,amount,currency,timestamp,channel,jurisdiction,sar_linked
T1,"A,1",B1,"1,500.25", usd ,2026-01-05T10:00:00Z,wire,GB,yes
T2,B1,C1,(20),,01/06/2026 11:30:00,,,0
"""


def txns(spark, tmp_path, text=CSV, name="a.csv"):
    (tmp_path / name).write_text(text)
    return readers.read_csv(spark, str(tmp_path / name))


def test_csv_rules(spark, tmp_path):
    got = {r.transaction_id: r for r in txns(spark, tmp_path).collections["transactions"].collect()}
    assert got["T1"].source_account == "A,1" and float(got["T1"].amount) == 1500.25 and got["T1"].currency == "USD" and got["T1"].sar_linked
    assert float(got["T2"].amount) == -20 and got["T2"].currency is None and got["T2"].timestamp.hour == 11 and not got["T2"].sar_linked
    assert got["T1"].source_lineage.source_type == "csv"


@pytest.mark.parametrize(("bad", "what"), [("T1,A,B,x,USD,2026-01-05,,,0", "invalid amount"), ("T1,A,B,1,US1,2026-01-05,,,0", "invalid currency"), (",A,B,1,USD,2026-01-05,,,0", "missing transaction_id"), ("T1,A,B,1,USD,soon,,,0", "invalid timestamp"), ("T1,A,B,1,USD,2026-01-05,,,0\nt1,A,B,1,USD,2026-01-05,,,0", "duplicate")])
def test_csv_errors(spark, tmp_path, bad, what):
    with pytest.raises(S.NormalisationError, match=what):
        txns(spark, tmp_path, CSV.split("\n")[0] + "\n" + bad + "\n")


def test_formats_agree(spark, tmp_path):
    base = txns(spark, tmp_path)
    flat = base.collections["transactions"]
    sinks.write_parquet(flat, str(tmp_path / "p"))
    sinks.write_csv(flat, str(tmp_path / "c"))
    rows = [{k: None if v is None else str(v) for k, v in r.asDict().items() if k != "source_lineage"} for r in flat.collect()]
    (tmp_path / "j.json").write_text(json.dumps({"rows": rows}))
    (tmp_path / "l.jsonl").write_text("\n".join(map(json.dumps, rows)))
    others = [readers.read_parquet(spark, str(tmp_path / "p")), readers.read_csv(spark, str(tmp_path / "c")), readers.read_json(spark, str(tmp_path / "j.json")), readers.read_json(spark, str(tmp_path / "l.jsonl")),
              readers.read_rest(spark, "http://x/", "/y", "tok", get=lambda u, h: json.dumps(rows) if (u, h["Authorization"]) == ("http://x/y", "Bearer tok") else "{}")]
    assert {merge.content_hash(spark, d) for d in others} == {merge.content_hash(spark, base)}


GRAPHML = """<graphml><graph><node id="n1"><data key="label">person</data><data key="name">Ann</data></node><node id="n2"/>
<edge source="n1" target="n2"><data key="type">owns</data><data key="evidence_ids">T1, T9 ,</data></edge></graph></graphml>"""


def test_graphml_merge_and_integrity(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPHML)
    g = readers.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {(r.entity_id, r.entity_type, r.display_name) for r in g.collections["entities"].collect()} == {("n1", "person", "Ann"), ("n2", "unknown", None)}
    edge = g.collections["relationships"].first()
    assert (edge.relationship_id, edge.relationship_type, edge.evidence_ids) == ("edge-1", "owns", ["T1", "T9"])
    a = txns(spark, tmp_path)
    b = txns(spark, tmp_path, CSV.replace("T2,B1", "T3,B1").replace("2026-01-05T10", "2026-01-05T11"), "b.csv")
    old = S.Dataset({}, "old", "v0")
    case = merge.merge(spark, [a, b, g, old])
    assert case.collections["transactions"].count() == 3
    assert {r.conflict_type for r in case.conflicts.collect()} == {"timestamp_mismatch", "schema_version_mismatch"}
    assert [(r.issue, r.ref) for r in merge.validate(spark, case).collect()] == [("dangling", "T9")]
    assert set(sinks.export_case(spark, case, str(tmp_path / "out"))) == {"transactions", "entities", "relationships"}
    (tmp_path / "bad.graphml").write_text(GRAPHML.replace('target="n2"', 'target="n3"'))
    with pytest.raises(S.NormalisationError, match="unknown node"):
        readers.read_graphml(spark, str(tmp_path / "bad.graphml"))
    got = merge.load_case(spark, [("a", "CSV", {"path": str(tmp_path / "a.csv")}), ("x", "csv", {"path": str(tmp_path / "none.csv")})], readers.default_registry())
    assert [n for n, _ in got.failures] == ["x"]


def test_property_graph(spark):
    a, b = {"id": 1, "labels": ["person"], "properties": {"id": "p1", "name": "x"}}, {"id": 2, "labels": [], "properties": {"display_name": "d"}}
    d = readers.read_property_graph(spark, client=lambda uri, q, part, parts: [(a, {"id": 7, "type": "KNOWS", "properties": {}}, b), (a, {"id": 7, "type": "OTHER", "properties": {}}, b)])
    assert d.collections["relationships"].first().relationship_type == "KNOWS" and d.collections["entities"].count() == 2


def test_hash_properties(spark, tmp_path):
    a = txns(spark, tmp_path)
    lines = CSV.strip().split("\n")
    b = txns(spark, tmp_path, "\n".join([lines[0], lines[2], lines[1]]) + "\n", "r.csv")
    c = txns(spark, tmp_path, CSV.replace("wire", "cash"), "c2.csv")
    assert merge.content_hash(spark, a) == merge.content_hash(spark, b) != merge.content_hash(spark, c)


def test_components_and_strong_ones(spark):
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), ("p", "q")]
    edges = spark.createDataFrame(e, "src string, dst string")
    weak = graph.connected_components(edges)
    far = graph.connected_components(edges, one_task_edges=-1)
    assert sorted(map(tuple, weak.collect())) == sorted(map(tuple, far.collect()))
    one, two = (sorted(map(tuple, risk.strong_components(edges, weak, n).collect())) for n in (10**6, 1))
    assert one == two and dict(one) == {"a": "a", "b": "a", "c": "a", "d": "d", "x": "x", "p": "p", "q": "q"}


def test_strong_ones_after_trimming(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 4}") for i in range(4)]
    tree = [(f"t{(i - 1) // 2:02d}", f"t{i:02d}") for i in range(1, 40)] + [("t30", "r0"), ("r2", "t99"), ("t99", "t99")]
    pair = [("r3", "u0"), ("u0", "u1"), ("u1", "u0"), ("u1", "v"), ("v", "w")]
    edges = spark.createDataFrame(ring + tree + pair, "src string, dst string")
    weak = graph.connected_components(edges)
    one, two = (sorted(map(tuple, risk.strong_components(edges, weak, n).collect())) for n in (10**6, 1))
    assert one == two and len(one) == 40 + 4 + 1 + 4
    assert {n: c for n, c in one if n != c} == {"r1": "r0", "r2": "r0", "r3": "r0", "u1": "u0"}
    assert risk.strong_by_colouring(edges.limit(0)).count() == 0


def test_long_cycles_in_few_rounds(spark, monkeypatch):
    """A cycle and a chain of 8,000 nodes, and random graphs against one task."""
    import random

    rounds, made = [], risk._contract
    monkeypatch.setattr(risk, "_contract", lambda *a, **k: (out := made(*a, **k), rounds.append(len(out[2])))[0])
    n = 8000
    ids = spark.range(n)
    edges = ids.select(F.concat(F.lit("c"), "id").alias("src"), F.concat(F.lit("c"), (F.col("id") + 1) % n).alias("dst")).unionByName(ids.select(F.concat(F.lit("p"), "id").alias("src"), F.concat(F.lit("p"), F.col("id") + 1).alias("dst"))).unionByName(spark.createDataFrame([("c5", "p0")], "src string, dst string"))
    got = risk.strong_by_colouring(edges, 1000).groupBy("scc").count().groupBy("count").agg(F.count("*").alias("n")).collect()
    assert {r["count"]: r.n for r in got} == {n: 1, 1: n + 1} and 1 < rounds[-1] <= 15
    rng = random.Random(3)
    for size, m in ((12, 14), (60, 75)):
        e = [(f"{rng.randrange(size):03d}", f"{rng.randrange(size):03d}") for _ in range(m)]
        some = spark.createDataFrame(e, "src string, dst string")
        want = sorted(map(tuple, some.withColumn("g", F.lit(True)).groupBy("g").applyInArrow(risk._strong, "node string, scc string").collect()))
        assert sorted(map(tuple, risk.strong_by_colouring(some).collect())) == want


def test_synthetic_ledger(spark):
    from argusledger.sources.synthetic import Pattern, ledger

    rows = ledger(spark)
    assert rows.count() == rows.select("txn_id").distinct().count() > 500 and sorted(rows.collect()) == sorted(ledger(spark).collect()) != sorted(ledger(spark, seed=2).collect())
    assert rows.filter("source_account = destination_account or amount <= 0").count() == 0
    loops = ledger(spark, (Pattern("loop", 7, (3, 5), 1000.0, laps=2, reported=1.0),))
    t = loops.select(F.col("source_account").alias("src"), F.col("destination_account").alias("dst"), "amount", F.col("timestamp").alias("ts"), (F.col("sar_linked") == 1).alias("sar"))
    clusters = risk.cluster_metrics(t).collect()
    assert [r.circular_flow for r in clusters] == [1.0] * 7 and all(3 <= r.account_count <= 5 for r in clusters) and loops.filter("sar_linked = 0").count() == 0
    funnel = ledger(spark, (Pattern("funnel", 1, (6, 6), 100.0),)).groupBy("destination_account").count().collect()
    assert sorted(r["count"] for r in funnel) == [1, 5]


def test_documents_of_many_parts(spark, tmp_path):
    """Fragments, in the order of their names, are one JSON document."""
    rows = spark.range(1000).select(F.concat(F.lit("E"), F.col("id") % 400).alias("entity_id"), F.lit(None).cast("string").alias("entity_type"), F.lit("x,\n]").alias("display_name")).repartition(7)
    whole = lambda p: json.loads("".join(f.read_text() for f in sorted((tmp_path / p).glob("part-*"))))
    sinks.write_collection(rows, "entity_id", str(tmp_path / "a"))
    got = whole("a.json")
    assert len(got) == 1000 and [r["entity_id"] for r in got] == sorted(r["entity_id"] for r in got) and got[0]["entity_type"] is None
    sinks.write_graph(spark, {"entities": rows, "relationships": rows.limit(0).withColumn("relationship_id", F.lit("r"))}, str(tmp_path / "g"))
    assert len(whole("g.json")["entities"]) == 1000 and whole("g.json")["relationships"] == []
    sinks.write_collection(rows.limit(0), "entity_id", str(tmp_path / "e"))
    assert whole("e.json") == []


def test_json_layouts(spark, tmp_path):
    put(tmp_path, bad__json={"other": []}, scalars__json={"rows": [1, 2]}, none__json={"rows": []})
    (tmp_path / "pretty.json").write_text('[\n {\n "txn_id": "T1", "amount": 1.50}\n, {"txn_id": "T2",\n "amount": 2}\n]\n')
    (tmp_path / "lines.json").write_text('[\n{"txn_id": "T1", "amount": 1234567890123456.25},\n{"txn_id": "T2"}\n]\n')
    for name in ("bad", "scalars"):
        with pytest.raises(S.SourceError):
            readers.read_json_rows(spark, f"{tmp_path}/{name}.json")
    assert readers.read_json_rows(spark, f"{tmp_path}/none.json").count() == 0
    assert all(readers.grounding_ids(spark, f"{tmp_path}/{name}.json").count() == 0 for name in ("bad", "scalars", "none"))
    assert [tuple(r) for r in readers.read_json_rows(spark, f"{tmp_path}/lines.json").select("txn_id", "amount").orderBy("txn_id").collect()] == [("T1", "1234567890123456.25"), ("T2", None)]
    assert readers.read_json_rows(spark, f"{tmp_path}/pretty.json").count() == 2


def test_connections():
    from argusledger.sources import live

    assert live.jdbc_address("postgresql", "jdbc:x") == ("jdbc:x", {})
    assert live.jdbc_address("postgresql", "Host=h;Port=5;Database=d;Username=u;Password=p") == ("jdbc:postgresql://h:5/d", {"user": "u", "password": "p"})
    assert live.jdbc_address("sqlserver", "Server=h,1433;Initial Catalog=d;User Id=u;Pwd=p") == ("jdbc:sqlserver://h:1433;databaseName=d", {"user": "u", "password": "p"})
    with pytest.raises(S.InvalidConfiguration):
        live.jdbc_address("postgresql", "nothing")


def test_graphml_elements():
    import io

    from argusledger.sources import live

    rows = lambda x: list(live.graphml_elements(io.BytesIO(x.encode())))
    many = "".join(f'<node id="n{i}"/>' for i in range(5000))
    assert len(rows(f"<g><graph>{many}</graph></g>")) == 5000 and rows("<g><graph/><graph><node id='x'/></graph></g>") == []
    assert rows('<a:g xmlns:a="u"><a:graph><a:node id="1"><a:data key="K">x<b>y</b></a:data><graph><node id="2"/></graph></a:node></a:graph></a:g>') == [("node", "1", None, None, {"k": "xy"})]
    for bad in ("<g><graph>", "<g/>", '<g><graph><node id="1"><data key="a"/><data key="A"/></node></graph></g>', ""):
        with pytest.raises(S.SourceError):
            rows(bad)


def test_console_report(spark):
    from argusledger.operators.profiles import console_report

    profile = {"agent": {"name": "a", "model": None}, "scenario_pack": "t", "status_summary": {"benchmark_verdict": "PASS", "assurance_decision": "PASS_WITH_CONDITIONS"}, "not_evaluated_dimensions": ["gap"],
               "metrics": [{"label": "Quality", "value": 0.5, "threshold": 0.75, "direction": "higher_is_better", "unit": "rate", "status": "FAIL"}, {"label": "Fakes", "value": None, "threshold": 0, "direction": "lower_is_better", "unit": "count", "status": "NOT_EVALUATED"}],
               "deployment_decision": {"overall": "PASS_WITH_CONDITIONS", "reason": "why", "reasons": [{"label": "Quality", "actual": 0.5, "threshold": 0.75, "rule": "minimum", "severity": "warning"}]}, "result_hash": "sha256:0"}
    text = console_report(profile)
    assert [x for x in text.split("\n") if x.startswith("==")] == ["== run ==", "== metrics ==", "== reasons ==", "== not evaluated ==", "== decision =="]
    assert "Quality | 0.5   | >= 0.75   | rate  | FAIL" in text and "Fakes   | -     | <= 0      | count | NOT_EVALUATED" in text
    assert [x for x in console_report({}).split("\n") if x.startswith("==")] == ["== run ==", "== decision =="]


def test_risk_all_equal_is_empty(spark):
    t = spark.createDataFrame([("a", "b", 1.0, "2026-01-01", False)], "src string, dst string, amount double, ts string, sar boolean").withColumn("ts", F.to_timestamp("ts"))
    assert risk.cluster_risk(t).count() == 0


def test_evidence_goldens(spark):
    r = spark.createDataFrame([("r", "see T1-001 and T1-001, T2-002, T9-001, T4-004"), ("s", None)], "report_id string, text string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = {x.report_id: x for x in evidence.traceability(r, ids("t1-001"), ids("T1-001", "T1-002")).collect()}
    assert (got["r"].cited_total, got["r"].cited_distinct, got["r"].fabricated, got["r"].precision, got["r"].recall, got["r"].f1) == (3, 2, 1, 1.0, 0.5, 0.6667)
    assert got["s"].precision is None and got["s"].recall == 0.0 and got["s"].f1 is None
    md = spark.createDataFrame([(1, "intro\n# A #\n- x\ntext\nmore\n")], "id int, text string")
    assert [(x.section, x.content) for x in evidence.markdown_sections(md, "id").orderBy("place").collect()] == [("(intro)", "intro"), ("A #", "x"), ("A #", "text more")]


def test_assurance_rules(spark):
    p = spark.createDataFrame([("a", "A", "higher_is_better", 0.5, "rate", True), ("b", "B", "sideways", 2.0, "rate", False)], "metric string, label string, direction string, threshold double, unit string, required boolean")
    assert [r.problem for r in assurance.validate_policy(p).collect()] == ["unknown direction"]
    runs = spark.createDataFrame([("r",)], "run_id string")
    at = spark.createDataFrame([("r", "a", 0.5)], "run_id string, metric string, value double")
    assert assurance.decide(assurance.metric_status(runs, p.limit(1), at)).first().decision == "PASS"
    assert assurance.decide(assurance.metric_status(runs, p.limit(1), at), gaps=1).first().decision == "PASS_WITH_CONDITIONS"
    assert assurance.decide(assurance.metric_status(runs, p.limit(1), at.limit(0))).first().decision == "NOT_READY_FOR_DEPLOYMENT"


def test_scalars(spark):
    r = spark.range(1).select(N.round4(F.lit(0.03125)).alias("r"), N.redact(F.lit("KEY=abc x"), ["KEY"]).alias("s"), N.comma_list(F.lit("a, ,b")).alias("c"), N.iso_o(F.lit("2026-01-02 03:04:05.5").cast("timestamp")).alias("t")).first()
    assert (r.r, r.s, r.c, r.t) == (0.0312, "KEY=***REDACTED*** x", ["a", "b"], "2026-01-02T03:04:05.5000000+00:00")
    assert N.connection_variable("bank-a.1") == "AML_CONN_BANK_A_1"


def test_stream(spark, tmp_path):
    rows = catalogue.view(spark, "/root/testdata/sf0.001", "weekly").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    q = weekly_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("weeks").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {r.start_date: r.transfer_count for r in spark.table("weeks").collect()}
    assert got == {r.start_date: r.transfer_count for r in risk.weekly_summary(rows).collect()}


def plain_transfers():
    """All of lineitem as (src, dst, cents, day, sar), in plain Python."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/lineitem.parquet").to_pylist()
    return [(f"A{r['l_suppkey']}-{r['l_partkey'] % 6}", f"A{r['l_suppkey']}-{r['l_orderkey'] % 6}", round(r["l_extendedprice"] * 100), r["l_shipdate"], r["l_returnflag"] == "R") for r in t]


def test_graph_is_all_of_lineitem(spark):
    rows = plain_transfers()
    run = lambda name: catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    want = {}
    for a, b, cents, _, _ in rows:
        n, total = want.get((a, b), (0, 0))
        want[a, b] = n + 1, total + cents
    assert {(r.src, r.dst): (r.n, round(float(r.weight) * 100)) for r in run("edge_weights").collect()} == want
    group = {x: x for e in want for x in e}
    for _ in group:
        for a, b in want:
            group[a] = group[b] = min(group[a], group[b])
    assert {r.node: r.component for r in run("wcc_components").collect()} == group
    m = run("cluster_metrics").collect()
    assert sum(r.transfers for r in m) == len(rows) and {r.component for r in m} == set(group.values())
    assert {r.account_id for r in run("mule_findings").collect()} == set(group)


def test_missing_gold_ids(spark):
    r = spark.createDataFrame([("r", "T1-001, T1-003, T9-001"), ("s", None), ("t", "t1-002 T1-002 T1-004 T1-005")], "report_id string, text string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    valid = ids("T1-001", "T1-002", "T1-004")
    got = {x.report_id: (x.grounded_ids, x.matched_ids, x.missing_ids, x.gold_total) for x in evidence.traceability(r, valid, ids("T1-003", "t1-001", "T1-002", "T1-001")).collect()}
    assert got == {"r": ("T1-001", "T1-001", "T1-002,T1-003", 3), "s": ("", "", "T1-001,T1-002,T1-003", 3), "t": ("T1-002,T1-004", "T1-002", "T1-001,T1-003", 3)}
    assert [x.missing_ids for x in evidence.traceability(r, valid, ids()).collect()] == [x.missing_ids for x in evidence.traceability(r, valid, None).collect()] == [""] * 3


def test_regression_and_verdict(spark):
    names = ["PASS", "PASS_WITH_CONDITIONS", "NOT_READY_FOR_DEPLOYMENT", "odd"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    got = pairs.select("a", "b", assurance.is_regression(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [names.index(r.b) > names.index(r.a) for r in got]
    codes = spark.createDataFrame([(0, None), (0, 0), (0, 1), (1, None), (1, 0)], "t int, j int")
    assert [r[0] for r in codes.select(assurance.overall_verdict(F.col("t"), F.col("j"))).collect()] == ["PASS", "PASS", "FAIL", "FAIL", "FAIL"]


def test_merge_has_all_orders(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    kept = catalogue.QUERIES["merge_kept"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.transaction_id for r in kept) == sorted(f"T{r.o_orderkey}" for r in orders.collect())
    found = catalogue.QUERIES["merge_conflicts"](spark, "/root/testdata/sf0.001").collect()
    assert {r.record_id for r in found} == {f"t{r.o_orderkey}" for r in orders.collect() if r.o_orderkey % 2 == 0 and any(r.o_orderkey % k == 0 for k in (5, 7, 11))}


def test_mule_golden(spark):
    rows = [("a", "m", 100.0, True), ("m", "b", 90.0, False), *[(f"s{i}", "c", 5.0, False) for i in range(3)], *[("d", f"t{i}", 5.0, False) for i in range(3)], ("x", "y", 1.0, False)]
    t = spark.createDataFrame([(a, b, v, s, f"{a}>{b}") for a, b, v, s in rows], "src string, dst string, amount double, sar boolean, txn_id string")
    got = {r.account_id: (r.classification, r.confidence, r.supporting_txn_ids) for r in risk.mule_findings(t).collect()}
    low = {k: ("legitimate", 0.5, i) for k, i in (("b", "m>b"), ("x", "x>y"), ("y", "x>y"), *((f"s{i}", f"s{i}>c") for i in range(3)), *((f"t{i}", f"d>t{i}") for i in range(3)))}
    assert got == {"a": ("suspicious", 0.7, "a>m"), "m": ("mule", 0.9, "a>m;m>b"), "c": ("collector", 0.7, "s0>c;s1>c;s2>c"), "d": ("distributor", 0.7, "d>t0;d>t1;d>t2"), **low}


def test_case_hashes_cover_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.collection: r.records for r in catalogue.QUERIES["case_hashes"](spark, sf).collect()}
    n = lambda t: spark.read.parquet(f"{sf}/{t}.parquet").count()
    assert got == {"transactions": n("orders"), "accounts": n("customer"), "customers": n("customer"), "entities": n("supplier"), "alerts": n("events"), "jurisdictions": n("nation")}


def put(folder, **files):
    for name, text in files.items():
        (folder / name.replace("__", ".").replace("_", "-")).write_text(text if isinstance(text, str) else json.dumps(text))


def test_case_and_policy_files(spark, tmp_path):
    from argusledger.sources import documents

    put(tmp_path, case__json={"case_id": "c", "sources": [{"source_type": "CSV", "path": "a.csv", "role": "bank"}, {"source_type": "postgresql", "connection_profile": "p", "query": "q", "options": {"x": None}}, {"source_type": "csv", "path": "none.csv"}]}, a__csv=CSV)
    case = documents.read_case(spark, f"{tmp_path}/case.json")
    assert case.case_id == "c" and [s.source_type for s in case.sources] == ["CSV", "postgresql", "csv"] and case.sources[0].path == f"{tmp_path}/a.csv" and case.sources[1].query == "q" and case.sources[1].options == {"x": ""}
    got = merge.load_case(spark, case.definitions(), readers.default_registry())
    assert got.collections["transactions"].count() == 2 and [n for n, _ in got.failures] == ["p", f"{tmp_path}/none.csv"] and got.source_manifest.first().adapter == "csv-adapter"
    for bad in ("[]", "{", '{"case_id": " ", "sources": [{}]}', '{"case_id": "c", "sources": []}', '{"case_id": "c", "sources": [{"path": "x"}]}'):
        with pytest.raises(S.InvalidConfiguration):
            documents.parse_case(bad)
    good = {"metric": "m", "label": "M", "direction": "lower_is_better", "threshold": 0.5, "unit": "rate"}
    put(tmp_path, good__json={"policy_id": "p", "thresholds": [good]}, bad__json={"thresholds": [{**good, "threshold": 2}]}, less__json={"thresholds": [{"metric": "m"}]})
    policy = documents.read_policy(spark, f"{tmp_path}/good.json")
    assert policy.thresholds.first().required and policy.gaps == [] and policy.policy_id == "p"
    for name in ("bad", "less", "none"):
        with pytest.raises(S.AdapterError):
            documents.read_policy(spark, f"{tmp_path}/{name}.json")


def test_evidence_files(spark, tmp_path):
    from argusledger.operators import profiles
    from argusledger.sources import documents

    put(tmp_path, g__json={"gold_evidence_txn_ids": ["t1-001", "T1-002"]}, e__json={}, prompt__md="p", rubric__json="{}")
    assert {r.id for r in documents.read_gold(spark, f"{tmp_path}/g.json").collect()} == {"T1-001", "T1-002"}
    assert documents.read_gold(spark, f"{tmp_path}/e.json") is None and documents.read_gold(spark, f"{tmp_path}/n.json") is None and documents.read_gold(spark, None) is None
    assert documents.bundle(spark, str(tmp_path), ["prompt.md", "no.md"], "in") == "----- in:prompt.md -----\np\n----- in:no.md -----\n[MISSING FILE]\n"
    one = profiles.task_fingerprint(spark, str(tmp_path))
    put(tmp_path, prompt__md="q")
    assert one != profiles.task_fingerprint(spark, str(tmp_path)) and profiles.files_hash(spark, [f"{tmp_path}/no.md"]) is None
    names = ["task-006-a", "task-007-b", "task-0071", "other"]
    assert [profiles.resolve_task(names, x) for x in ("other", "006", "task-007", "TASK-006", "x")] == ["other", "task-006-a", None, "task-006-a", None]
    claims = spark.createDataFrame([('[null, {"text": "a"}, {"cited_txn_ids": ["T1"], "support": "Supported"}]',), ("broken",), (None,)], "claims string")
    assert [[(c.text, c.cited_ids, c.support) for c in r[0]] for r in claims.select(documents.parse_claims()).collect()] == [[("a", [], "unsupported"), ("", ["T1"], "Supported")], [], []]


def test_profile_rules(spark, tmp_path):
    from argusledger.operators import profiles
    from argusledger.sources import documents

    docs = catalogue._documents(lambda v: catalogue.view(spark, "/root/testdata/sf0.001", v))
    path = f"{tmp_path}/p.jsonl"
    documents.write_documents(docs, path)
    good = json.loads(spark.read.text(path).first().value)

    def violations(document):
        found = profiles.invalid_documents(spark.createDataFrame([(1, json.dumps(document))], "k long, t string"), "t", "k").collect()
        return found[0].violations if found else []

    assert violations(good) == []
    change = lambda **k: violations({**good, **k})
    assert change(metrics=None) == ["no metrics", "metrics: not an array"]
    assert change(result_hash="md5:1") == ["result_hash: not sha256:..."]
    assert change(metrics=[{**good["metrics"][0], "status": "ODD", "value": None}]) == ["metrics[0]: unknown status ODD"]
    assert change(metrics=[1]) == ["metrics[0]: not an object"] and change(policy={"id": 1, "name": None, "version": 1}) == ["policy: no path"]
    assert change(deployment_decision={**good["deployment_decision"], "overall": "MAYBE", "reasons": 1}) == ["deployment_decision: unknown decision MAYBE", "deployment_decision: reasons are no array"]
    assert "provenance: no run to trace it to" in change(provenance={}) and change(not_evaluated_dimensions=[{}]) == ["not_evaluated_dimensions: not all are text"]
    bad = spark.createDataFrame([(1, "x"), (2, json.dumps(good)), (3, "[]"), (4, None)], "k long, t string")
    assert {r.k: r.violations for r in profiles.invalid_documents(bad, "t", "k").collect()} == {1: ["not JSON"], 3: ["not an object"], 4: ["not JSON"]}
    rows = docs.orderBy("provenance.run_id").withColumn("path", F.lit("x"))
    ids = [r.run_id for r in rows.select("provenance.run_id").limit(2).collect()]
    two = rows.filter(F.col("provenance.run_id").isin(*ids))
    one = profiles.comparison(spark, two, "now")
    assert [r["run_id"] for r in one["compared_runs"]] == ids and set(one["excluded_dimensions"]) >= {"gap a", "Quality"}
    check = profiles.regression(spark, two, *ids, "now")
    assert len(check["metric_deltas"]) == 3 and check["decision_change"]["regression_detected"] in (True, False) and check["baseline"]["run_id"] == ids[0]
    with pytest.raises(S.InvalidConfiguration):
        documents.read_profiles(spark, ["a.json"])
    with pytest.raises(S.SourceError):
        documents.read_profiles(spark, [path, f"{tmp_path}/none.json"])
    put(tmp_path, odd__json="{}")
    with pytest.raises(S.SourceError, match="not a profile"):
        documents.read_profiles(spark, [path, f"{tmp_path}/odd.json"])


def test_exports(spark, tmp_path):
    a = txns(spark, tmp_path)
    rows = a.collections["transactions"]
    sinks.write_csv(rows, f"{tmp_path}/plain", quoted=False)
    assert spark.read.text(f"{tmp_path}/plain").first().value.startswith("txn_id,source_account,") and spark.read.text(f"{tmp_path}/plain").filter("value like 'T1,A,1,B1,%'").count() == 1
    m = sinks.dataset_manifest(spark, a, f"{tmp_path}/a.csv", "2026-01-01")
    assert m["record_count"] == 2 and m["dataset_hash"].startswith("sha256:") and m["snapshot_limitation"] is None and m["source_name"] == "a.csv" and m["adapter"] == "csv-adapter"
    assert sinks.dataset_manifest(spark, S.Dataset({}, "live", source_type="rest"))["snapshot_limitation"]
    sinks.write_graph(spark, {"entities": spark.createDataFrame([("e", None)], "entity_id string, entity_type string")}, f"{tmp_path}/g")
    assert json.loads("".join(f.read_text() for f in sorted((tmp_path / "g.json").glob("part-*")))) == {"entities": [{"entity_id": "e", "entity_type": None}]}
    assert sinks.table_text("t", ["a", "bb"], [["x", "y"]]) == "== t ==\na | bb\n--+---\nx | y"
    plain = [{"txn_id": "T9", "data": [1], "source_account": "a", "destination_account": "b", "amount": "1", "timestamp": "2026-01-01"}]
    put(tmp_path, list__json=plain, wrap__json={"data": plain})
    for name in ("list", "wrap"):
        assert readers.read_json(spark, f"{tmp_path}/{name}.json").collections["transactions"].first().transaction_id == "T9"
    put(tmp_path, up__csv=CSV.replace("amount", "Amount", 1))
    with pytest.raises(S.NormalisationError, match="missing amount"):  # names of CSV columns are exact
        readers.read_csv(spark, f"{tmp_path}/up.csv")
    put(tmp_path, l__csv="txn_id,timestamp,source_account,destination_account,amount,sar_linked\na,2026-01-01,x,y,1.5,2\n", m__csv="txn_id\n1\n")
    from argusledger.sources import documents

    assert documents.read_ledger(spark, f"{tmp_path}/l.csv").first().sar is True
    with pytest.raises(S.SourceError, match="timestamp"):
        documents.read_ledger(spark, f"{tmp_path}/m.csv")


def test_numbers_over_partitions(spark):
    rows = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.col("id").alias("x")).repartition(7)
    want = {k: f"c{i + 1}" for i, k in enumerate(sorted(r.k for r in rows.collect()))}
    assert {r.k: r.cluster_id for r in risk.numbered(rows, "k", "c").collect()} == want
    assert {r.s for r in risk.with_min_max(rows, s="x").collect()} == {i / 999 for i in range(1000)}
