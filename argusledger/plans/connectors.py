"""Queries over live sources: what is served or stored from the given tables is read again by the executors.

A database, an endpoint and a graph store are needed that executors reach; here stand-ins hold all rows of the tables: an embedded
database in shards in the shared folder (``argusledger.jdbc.url`` names another one), and a small server of the pages that Spark wrote,
whose address is the driver's own, so that executors must be on its machine.
"""

from __future__ import annotations

import json
import os
import re
import threading
import uuid
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argusledger.functions.normalise import connection_variable
from argusledger.functions.tables import cut
from argusledger.operators import merge
from argusledger.plans.catalogue import _canonical, _place, _round_trip, _told, active, query
from argusledger.sources import documents, readers, sinks
from argusledger.sources import schema as S

TOKEN = "a-token"
#: Bytes of a page that the server holds at once, and rows that a page has at most (about), so that pages grow in number, not in size.
CHUNK, PAGE_ROWS = 1 << 18, 20_000


@contextmanager
def served(spark: SparkSession, folder: str):
    """The address of a server of ``folder``'s pages (``/3``: what part=3 holds) for bearers of TOKEN; ``/broken`` fails."""
    hadoop = spark._jvm.org.apache.hadoop.fs

    def files(name: str) -> tuple:
        p = hadoop.Path(f"{folder}/part={name}")
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        return fs, sorted((x.getPath().toString(), x.getLen()) for x in fs.listStatus(p))

    def send(fs, name: str, out) -> None:
        stream = fs.open(hadoop.Path(name))
        while part := bytes(stream.readNBytes(CHUNK)):
            out.write(part)
        stream.close()

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            code, fs, found = 200, None, []
            if self.headers.get("Authorization") != f"Bearer {TOKEN}":
                code = 401
            elif self.path == "/broken":
                code = 500
            else:
                fs, found = files(self.path.strip("/"))
            self.send_response(code)
            self.send_header("Content-Length", str(sum(n for _, n in found)))
            self.end_headers()
            for name, _ in found:
                send(fs, name, self.wfile)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_port}"
    finally:
        server.shutdown()
        server.server_close()


def pages(rows: DataFrame, part: str, key: str, n: int, wrap: str | None = None) -> str:
    """Rows as JSON arrays, page ``part`` of ``n`` each, by ``key``; with ``wrap``, odd pages are objects that wrap the array."""
    path, spark = _place("pages"), rows.sparkSession
    own = [c for c in rows.columns if c != part]
    body = rows.select(F.col(part).cast("int").alias("part"), F.col(key).alias("k"), F.to_json(F.struct(*own)).alias("j"))
    last = body.groupBy("part").agg(F.max("k").alias("last"))  # one row a page
    line = F.when(F.col("k") == F.col("last"), F.col("j")).otherwise(F.concat("j", F.lit(",")))
    body = body.join(F.broadcast(last), "part").select("part", F.struct(F.lit(1).alias("a"), F.col("k").alias("k")).alias("at"), line.alias("value"))
    ends = spark.range(n).select(F.col("id").cast("int").alias("part"), F.explode(F.array(F.lit(0), F.lit(2))).alias("a"))
    odd = (F.col("part") % 2 == 1) & F.lit(wrap is not None)
    text = F.when(F.col("a") == 0, F.when(odd, f'{{"{wrap}":[').otherwise("[")).otherwise(F.when(odd, "]}").otherwise("]"))
    ends = ends.select("part", F.struct("a", F.lit(None).cast(rows.schema[key].dataType).alias("k")).alias("at"), text.alias("value"))
    sinks.write_parts(body.unionByName(ends), n, path)
    return path


#: Rows that a shard of the stand-in database has at most (about); one task makes it.
SHARD_ROWS = 1_000_000


def _shard(batches, root: str, columns: str):
    """The path of an archive in ``root`` that holds these rows as a Derby database, made by Derby's own tool, import and shutdown."""
    import glob
    import shutil
    import subprocess
    import tempfile
    import zipfile

    import pyspark
    from pyarrow import csv

    home = next(d for d in (os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)) if d and glob.glob(f"{d}/jars/derby*.jar"))
    java = shutil.which(f"{os.environ.get('JAVA_HOME', '')}/bin/java") or "java"
    name = f"{root}/{uuid.uuid4().hex}.jar"
    with tempfile.TemporaryDirectory() as d:
        d = os.path.realpath(d)
        with open(f"{d}/rows.csv", "wb") as f:
            for batch in batches:
                csv.write_csv(batch, f, csv.WriteOptions(include_header=False))
        with open(f"{d}/make.sql", "w") as f:
            f.write(f"connect 'jdbc:derby:{d}/shard;create=true';\ncreate table TRANSACTIONS ({columns});\n"
                    f"call SYSCS_UTIL.SYSCS_IMPORT_TABLE(null, 'TRANSACTIONS', '{d}/rows.csv', null, null, 'UTF-8', 0);\ndisconnect;\nconnect 'jdbc:derby:{d}/shard;shutdown=true';\n")
        own = [f"-Dderby.{x}" for x in ("storage.pageSize=4096", "system.durability=test", f"system.home={d}")]
        told = subprocess.run([java, "-Xmx192m", *own, "-cp", os.pathsep.join(glob.glob(f"{home}/jars/derby*.jar")), "org.apache.derby.tools.ij", f"{d}/make.sql"], capture_output=True, text=True).stdout
        wrong = [x for x in told.splitlines() if x.startswith("ERROR") and not x.startswith("ERROR 08006")]
        if wrong or "ERROR 08006" not in told:  # 08006: it was shut down
            raise S.SourceError(f"no database: {(wrong or [told])[0]}")
        os.makedirs(root, exist_ok=True)
        with zipfile.ZipFile(f"{name}.part", "w", zipfile.ZIP_STORED) as z:
            for folder, _, files in os.walk(f"{d}/shard"):
                for f in files:
                    if not f.endswith(".lck"):
                        z.write(f"{folder}/{f}", os.path.relpath(f"{folder}/{f}", d))
        os.rename(f"{name}.part", name)
    return name


def database(rows: DataFrame) -> str:
    """The URL of a database whose table TRANSACTIONS holds the rows.

    Without a database named by ``argusledger.jdbc.url`` its URLs, a shard a line: archives in the shared folder, each made by one task,
    that any number of executors read at a time.
    """
    spark = rows.sparkSession
    named = rows.toDF(*[c.upper() for c in rows.columns])
    url = spark.conf.get("argusledger.jdbc.url", None)
    if url:
        named.write.format("jdbc").option("url", url).option("dbtable", "TRANSACTIONS").mode("overwrite").save()
        return url
    root = _place("database")
    if not root.startswith(("file:", "/")):
        raise S.InvalidConfiguration("argusledger.jdbc.url must name a database, since the shared folder is no file system's")
    root = re.sub("^file:/*", "/", root)
    kinds = {"string": "varchar(32672)", "int": "integer", "bigint": "bigint", "double": "double", "timestamp": "timestamp"}
    fields = [(f.name, f.dataType.simpleString()) for f in named.schema.fields]
    columns = ", ".join(f'"{n}" {kinds.get(k, k)}' for n, k in fields)
    # The JDBC source takes a timestamp's clock for that of the JVM's zone.
    here = lambda c: F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(c, spark.conf.get("spark.sql.session.timeZone")), spark._jvm.java.util.TimeZone.getDefault().getID()), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    text = named.select(*[(here(n) if k == "timestamp" else F.col(n).cast("string") if k.startswith("decimal") else F.col(n)).alias(n) for n, k in fields])

    def load(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"path": [_shard(batches, root, columns)]})

    n = max(4, -(-rows.count() // SHARD_ROWS))
    paths = sorted(r.path for r in text.repartition(n).mapInArrow(load, "path string").collect())  # one row a shard
    return "\n".join(f"jdbc:derby:jar:({p})shard" for p in paths)


def _stored(V) -> DataFrame:
    rows = _canonical(V).drop("source_lineage")
    return rows.withColumn("sar_linked", F.when(F.col("sar_linked"), 1).otherwise(0)).withColumn("amount", F.col("amount").cast("decimal(18,2)"))


@query(_round_trip("postgresql"))
def jdbc_roundtrip(V):
    """SRC-05, SRC-06: all orders through a database, in eight ranges of a key over its shards, by the default query."""
    return _told(cut(readers.read_jdbc(active(), database(_stored(V)), parts=8).collections["transactions"]))


@query("select concat('C', c_custkey) as id, c_name as src, cast(c_acctbal as double) as amount, n_name as jurisdiction, 'rest' as kind from customer join nation on c_nationkey = n_nationkey union all select '/0', 'authentication failed: HTTP 401', null, null, 'error' union all select '/broken', 'HTTP status 500', null, null, 'error'")
def rest_roundtrip(V):
    """SRC-07, SRC-20: all customers from an endpoint, a page a partition; a wrong token and a failing page are errors."""
    V("txn")
    spark = active()
    rows = spark.table("customer").join(spark.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = max(8, -(-rows.count() // PAGE_ROWS))
    rows = rows.select((F.col("c_custkey") % n).alias("page"), F.concat(F.lit("C"), "c_custkey").alias("txn_id"), F.col("c_name").alias("from_account"), F.lit("bank").alias("to_account"), F.col("c_acctbal").cast("decimal(18,2)").alias("amount"), F.lit("2026-01-05T00:00:00Z").alias("timestamp"), F.col("n_name").alias("destination_country"))
    load, errors = readers.default_registry().resolve("REST"), []
    with served(spark, pages(rows, "page", "txn_id", n, "data")) as base:
        got = load(spark, base=base, paths=[f"/{i}" for i in range(n)], token=TOKEN).collections["transactions"]
        for path, token in (("/0", "wrong"), ("/broken", TOKEN)):
            try:
                load(spark, base=base, path=path, token=token)
            except S.SourceError as e:
                errors.append((path, str(e)))
    none = lambda kind: F.lit(None).cast(kind)
    failed = spark.createDataFrame(errors, "id string, src string").select("id", "src", none("double").alias("amount"), none("string").alias("jurisdiction"), F.lit("error").alias("kind"))
    return got.select(F.col("transaction_id").alias("id"), F.col("source_account").alias("src"), F.col("amount").cast("double").alias("amount"), "jurisdiction", F.col("source_lineage.source_type").alias("kind")).unionByName(failed)


def page_client(uri: str | None, query: str, part: int, parts: int):
    """A graph store's client over served pages: supplier to nation edges."""
    import urllib.request

    with urllib.request.urlopen(urllib.request.Request(f"{uri}/{part}", headers={"Authorization": f"Bearer {TOKEN}"}), timeout=30) as r:
        for x in json.loads(r.read()):
            yield ({"id": f"4:{x['s']}", "labels": ["Supplier"], "properties": {"id": f"s{x['s']}", "display_name": x["s_name"]}},
                   {"id": f"5:{x['s']}", "type": "BASED_IN", "properties": {"id": x["edge"], "evidence_ids": x["refs"]}},
                   {"id": f"n{x['n']}", "labels": [], "properties": {"name": x["n_name"]}})


_STORE = "st as (select s_suppkey % 4 as page, s_suppkey as s, s_name, case when s_suppkey % 2 = 0 then 'R' else 'r' end || cast(s_suppkey // 2 as varchar) as edge, n_nationkey as n, n_name || ' of ' || s_suppkey as n_name, 'T' || s_suppkey as ref from supplier join nation on s_nationkey = n_nationkey), fe as (select * from st qualify row_number() over (partition by upper(edge) order by page, s) = 1)"


@query(f"with {_STORE} select 'entity' as kind, 's' || s as id, 'Supplier' as type, s_name as a, null as b from st union all select 'entity', 'n' || n, 'unknown', arg_max(n_name, page * 1000000000 + s), null from st group by n union all select 'relationship', edge, 'BASED_IN', 's' || s || '>n' || n, ref from fe")
def graph_store(V):
    """SRC-08: all suppliers from a graph store, in four parts; a nation's last node wins, of edges that repeat (without case) the first."""
    V("ids")
    V("txn")
    spark = active()
    rows = spark.table("supplier").join(spark.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = F.col("s_suppkey")
    edge = F.concat(F.when(s % 2 == 0, "R").otherwise("r"), F.floor(s / 2).cast("string"))
    rows = rows.select((s % 4).alias("page"), s.alias("s"), "s_name", edge.alias("edge"), F.col("n_nationkey").alias("n"), F.concat("n_name", F.lit(" of "), s).alias("n_name"), F.concat(F.lit(" ,T"), s).alias("refs"))
    with served(spark, pages(rows, "page", "s", 4)) as uri:
        g = readers.default_registry().resolve("neo4j")(spark, uri=uri, client=page_client, parts=4).collections
    none = F.lit(None).cast("string")
    ents = g["entities"].select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), F.col("entity_type").alias("type"), F.col("display_name").alias("a"), none.alias("b"))
    return ents.unionByName(g["relationships"].select(F.lit("relationship").alias("kind"), F.col("relationship_id").alias("id"), F.col("relationship_type").alias("type"), F.concat("source_entity_id", F.lit(">"), "target_entity_id").alias("a"), F.array_join("evidence_ids", "/").alias("b")))


@query("select 'entity' as kind, 'S' || s_suppkey as id, 'last' as type, s_name as a from supplier union all select 'relationship', 'e' || s_suppkey, 'related_to', 's' || s_suppkey || '>S' || s_suppkey from supplier union all select 'error', 'e' || max(s_suppkey), null, 'edge ''e' || max(s_suppkey) || ''' names unknown node ''nowhere''' from supplier")
def graphml_document(V):
    """SRC-09, WIN-04, JON-14: nested graphs are left out, keys and ids have no case, of repeated nodes the last wins, unknown ends are errors."""
    V("ids")
    spark, path = active(), _place("graphs")
    s, lit = F.col("s_suppkey"), F.lit
    inner = lit('<graph><node id="deep"><data key="label">deep</data></node><edge id="deep" source="deep" target="none"/></graph>')
    node = F.concat(lit('<g:node id="s'), s, lit('"><data key="label">first</data>'), inner, lit('</g:node><node id="S'), s, lit('"><data key="LABEL">last</data><data key="Name">'), F.col("s_name"), lit("</data></node>"))
    edge = lambda end: F.concat(lit('<edge id="e'), s, lit('" source="s'), s, lit('" target="'), end, lit('"/>'))
    suppliers = spark.table("supplier")
    head, foot = '<graphml xmlns:g="u"><key id="k"/><graph>', '</graph><graph><node id="second"/></graph></graphml>'

    def written(rows: DataFrame, name: str) -> str:
        sinks.write_graphml(rows.select("value"), f"{path}/{name}", 4, head, foot)
        return f"{path}/{name}"

    g = readers.read_graphml(spark, written(suppliers.select(F.concat(node, edge(F.concat(lit("S"), s))).alias("value")), "good")).collections
    top = suppliers.agg(F.max("s_suppkey")).first()[0]
    try:
        readers.read_graphml(spark, written(suppliers.select(F.concat(node, F.when(s == top, edge(lit("nowhere"))).otherwise("")).alias("value")), "bad"))
        error = None
    except S.NormalisationError as e:
        error = str(e)
    ents = g["entities"].select(lit("entity").alias("kind"), F.col("entity_id").alias("id"), F.col("entity_type").alias("type"), F.col("display_name").alias("a"))
    rels = g["relationships"].select(lit("relationship").alias("kind"), F.col("relationship_id").alias("id"), F.col("relationship_type").alias("type"), F.concat("source_entity_id", lit(">"), "target_entity_id").alias("a"))
    return ents.unionByName(rels).unionByName(suppliers.agg(F.max("s_suppkey").alias("m")).select(lit("error").alias("kind"), F.concat(lit("e"), "m").alias("id"), lit(None).cast("string").alias("type"), lit(error).alias("a")))


@query("select 'E' || s_suppkey as id, s_name as a, null as b from supplier union all select 'R' || s_suppkey, 'E' || s_suppkey, 'T' || s_suppkey from supplier")
def graph_document(V):
    """SNK-04: entities and relationships in one JSON document, written by all executors, an object a line."""
    V("ids")
    t, path = active().table("supplier"), _place("graphs")
    s = F.col("s_suppkey")
    sinks.write_graph(active(), {"entities": t.select(F.concat(F.lit("E"), s).alias("entity_id"), F.lit("x").alias("entity_type"), F.col("s_name").alias("display_name")), "relationships": t.select(F.concat(F.lit("R"), s).alias("relationship_id"), F.concat(F.lit("E"), s).alias("source_entity_id"), F.concat(F.lit("T"), s).alias("target_entity_id"))}, path)
    lines = active().read.text(f"{path}.json").select(F.regexp_replace("value", ",$", "").alias("j")).filter(F.json_object_keys("j").isNotNull())
    one = lambda *names: F.coalesce(*[F.get_json_object("j", f"$.{n}") for n in names])
    return lines.select(one("entity_id", "relationship_id").alias("id"), one("display_name", "source_entity_id").alias("a"), one("target_entity_id").alias("b"))


@query("select 'csv-adapter' as source, count(*) as n from orders where o_orderkey % 2 = 0 union all select 'postgresql-adapter', count(*) from orders where o_orderkey % 2 <> 0 union all select 'failed: none', 1 union all select 'failed: lost', 1")
def case_file(V):
    """SRC-17, SRC-05, SRC-20, SRC-21: a case of a file with the even orders, a database with all, by its profile, a profile that is
    not set and a file that isn't there.  What both sources hold is merged, the first source's record is kept."""
    rows, path = _canonical(V), _place("case")
    sinks.write_csv(rows.filter(F.substring("transaction_id", 2, 40).cast("long") % 2 == 0), f"{path}/even")
    profile = f"orders {uuid.uuid4().hex}"
    os.environ[connection_variable(profile)] = database(_stored(V))
    sources = [{"source_type": "CSV", "path": "even", "role": "bank"}, {"source_type": "PostgreSQL", "connection_profile": profile, "options": {"key": "timestamp", "parts": "4"}},
               {"source_type": "rest", "connection_profile": "not set", "role": "none"}, {"source_type": "parquet", "path": "nothing", "role": "lost"}]
    sinks.write_text(active(), json.dumps({"case_id": "c", "sources": sources}), f"{path}/case.json")
    case = merge.load_case(active(), documents.read_case(active(), f"{path}/case.json").definitions(), readers.default_registry())
    out = case.collections["transactions"].groupBy(F.col("source_lineage.adapter").alias("source")).agg(F.count("*").alias("n"))
    return out.unionByName(active().createDataFrame([(f"failed: {n}", 1) for n, _ in case.failures], "source string, n long"))


@query("select 'm' || n_nationkey as metric, n_name as label, case when n_nationkey % 2 = 0 then 'lower_is_better' else 'higher_is_better' end as direction, cast(n_nationkey as double) / 100 as threshold, 'rate' as unit, n_regionkey <> 1 as required from nation")
def policy_rows(V):
    """SRC-18: a policy whose thresholds are rows of a table."""
    V("txn")
    k, path = F.col("n_nationkey"), f"{_place('policy')}/policy.json"
    rows = active().table("nation").select(F.concat(F.lit("m"), k).alias("metric"), F.col("n_name").alias("label"), F.when(k % 2 == 0, "lower_is_better").otherwise("higher_is_better").alias("direction"), (k.cast("double") / 100).alias("threshold"), F.lit("rate").alias("unit"), (F.col("n_regionkey") != 1).alias("required"))
    rows.agg(F.to_json(F.struct(F.lit("p").alias("policy_id"), F.collect_list(F.struct(*rows.columns)).alias("thresholds"))).alias("value")).write.text(path)
    return documents.read_policy(active(), path).thresholds
