"""What failed over larger tables, other masters or other stores."""

import json
import os
import subprocess
import sys
import urllib.request

from argusledger.functions.normalise import connection_variable
from argusledger.operators import graph, merge
from argusledger.plans import catalogue, connectors
from argusledger.sources import documents, readers


def test_a_document_whose_first_part_is_small(spark, tmp_path):
    d = tmp_path / "d.json"
    d.mkdir()
    (d / "part-00000.txt").write_text("[\n")
    (d / "part-00001.txt").write_text("".join(f'{{"txn_id":"t{i}"}},\n' for i in range(500)))
    (d / "part-00002.txt").write_text('{"txn_id":"last"}\n]\n')
    rows = readers.read_json_rows(spark, str(d))
    assert rows.count() == 501 and {r.txn_id for r in rows.collect()} == {f"t{i}" for i in range(500)} | {"last"}


def test_pages_grow_in_number_and_are_served_in_pieces(spark, same, monkeypatch):
    made = []
    monkeypatch.setattr(connectors, "PAGE_ROWS", 10)
    monkeypatch.setattr(connectors, "CHUNK", 64)
    monkeypatch.setattr(connectors, "pages", lambda *a, f=connectors.pages: made.append(a[3]) or f(*a))
    same(catalogue.QUERIES["rest_roundtrip"], catalogue.SQL["rest_roundtrip"])
    assert made == [15]  # 150 customers


def test_a_page_of_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(connectors, "CHUNK", 7)
    (tmp_path / "part=3").mkdir()
    for i in range(3):
        (tmp_path / "part=3" / f"f{i}").write_text(f"{i}" * 20)
    with connectors.served(spark, str(tmp_path)) as base, urllib.request.urlopen(urllib.request.Request(f"{base}/3", headers={"Authorization": f"Bearer {connectors.TOKEN}"}), timeout=30) as r:
        assert r.read().decode() == "0" * 20 + "1" * 20 + "2" * 20


def test_databases_of_executors_in_jvms_of_their_own(tmp_path):
    code = f"""
import json
from pyspark.sql import SparkSession
import __spark_entry__
conf = {{"spark.master": "local-cluster[2,1,1024]", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": "file://{tmp_path}/shared", "spark.sql.shuffle.partitions": "4"}}
spark = SparkSession.builder.config(map=conf).getOrCreate()
got = __spark_entry__.queries()["jdbc_roundtrip"](spark, "/root/testdata/sf0.001")
case = __spark_entry__.queries()["case_file"](spark, "/root/testdata/sf0.001")
print("GOT", json.dumps([got.count(), got.select("transaction_id").distinct().count(), got.selectExpr("sum(cast(amount as decimal(18,2)))").first()[0].__str__(), {{r.source: r.n for r in case.collect()}}]))
"""
    env = os.environ | {"SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": os.getcwd() + os.pathsep + os.environ.get("PYTHONPATH", "")}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=240)
    assert "GOT" in done.stdout, done.stderr[-2000:]
    rows, ids, total, case = json.loads(done.stdout.split("GOT ")[1])
    import duckdb

    want = duckdb.sql("select count(*), cast(sum(cast(o_totalprice as decimal(18,2))) as varchar), count(*) filter (where o_orderkey % 2 = 0) from '/root/testdata/sf0.001/orders.parquet'").fetchall()[0]
    assert (rows, ids, total) == (want[0], want[0], want[1])
    assert case == {"csv-adapter": want[2], "postgresql-adapter": want[0] - want[2], "failed: none": 1, "failed: lost": 1}


def test_components_without_star_steps(spark, monkeypatch):
    ids = spark.range(0, 8000, 1, 16)
    edges = ids.selectExpr("concat('p', id) as src", "concat('p', id + 1) as dst").unionByName(ids.selectExpr("concat('q', id) as src", "concat('q', id) as dst"))
    monkeypatch.setattr(graph, "_star", None)
    got = {r.node: r.component for r in graph.connected_components(edges, one_task_edges=100).collect()}
    assert got == {**{f"p{i}": "p0" for i in range(8001)}, **{f"q{i}": f"q{i}" for i in range(8000)}}


def test_components_against_star_steps(spark):
    edges = spark.range(3000).selectExpr("xxhash64(id) % 4000 as src", "xxhash64(id, 1) % 4000 as dst")
    pairs = edges.selectExpr("greatest(src, dst) as u", "least(src, dst) as v")
    want = sorted(map(tuple, graph._by_stars(pairs, 60).collect()))
    for bound in (10**6, 50, -1):
        assert sorted(map(tuple, graph.connected_components(edges, one_task_edges=bound).collect())) == want


def test_sources_that_fail_while_they_are_read(spark, tmp_path, monkeypatch):
    """A database that gives up at a row and a broken file of several are sources that can't be read; the others are merged."""
    rows = spark.createDataFrame([(f"T{i}", float(i)) for i in range(8)], "transaction_id string, amount double").selectExpr("transaction_id", "'a' as source_account", "'b' as destination_account", "cast(amount as decimal(18,2)) as amount", "'USD' as currency", "timestamp'2026-01-05' as timestamp", "'c' as channel", "'d' as jurisdiction", "1 as sar_linked")
    monkeypatch.setenv(connection_variable("orders"), connectors.database(rows))
    rows.repartition(4).write.parquet(str(tmp_path / "broken"))
    last = sorted((tmp_path / "broken").glob("part-*.parquet"))[-1]
    last.write_bytes(last.read_bytes()[:4] + bytes(40) + last.read_bytes()[44:])
    for crc in (tmp_path / "broken").glob(".*.crc"):
        crc.unlink()
    query = "SELECT transaction_id, source_account, destination_account, 1 / (amount - 5) AS amount, currency, timestamp FROM transactions"
    sources = [{"source_type": "postgresql", "connection_profile": "orders", "role": "all", "options": {"key": "timestamp", "parts": "4"}},
               {"source_type": "postgresql", "connection_profile": "orders", "role": "row", "query": query}, {"source_type": "parquet", "path": "broken"}]
    case = merge.load_case(spark, documents.parse_case(json.dumps({"case_id": "c", "sources": sources}), str(tmp_path)).definitions(), readers.default_registry())
    assert case.collections["transactions"].count() == 8 and [n for n, _ in case.failures] == ["row", str(tmp_path / "broken")]
    assert "jdbc:" not in case.failures[0][1]
