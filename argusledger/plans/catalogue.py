"""Registered queries over the driver tables, with the SQL of each.  A view is one SQL text for both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from argusledger.functions import normalise as N
from argusledger.functions.tables import cut, shared_dir
from argusledger.operators import assurance, evidence, merge, profiles, risk
from argusledger.operators.graph import connected_components
from argusledger.sources import documents, readers, sinks
from argusledger.sources import schema as S

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations")

VIEWS = {
    "transfers": "select concat('A', l_suppkey, '-', l_partkey % 6) as src, concat('A', l_suppkey, '-', l_orderkey % 6) as dst, l_extendedprice as amount, l_shipdate as ts, l_returnflag = 'R' as sar from lineitem",
    "txn": "select concat('T', o_orderkey) as transaction_id, concat('C', o_custkey) as source_account, concat('M', o_custkey % 50) as destination_account, o_totalprice as amount, 'USD' as currency, o_orderdate as ts, o_orderpriority as channel, n_name as jurisdiction, o_orderstatus = 'F' as sar_linked from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey",
    "txn_multi": "select 0 as src, o_orderkey as rn, concat('T', o_orderkey) as id, o_totalprice as amount, 'USD' as currency, o_orderdate as ts from orders union all select 1, o_orderkey, concat('t', o_orderkey), case when o_orderkey % 5 = 0 then o_totalprice + 1 else o_totalprice end, case when o_orderkey % 7 = 0 then 'EUR' else 'USD' end, case when o_orderkey % 11 = 0 then o_orderdate + interval '1' day else o_orderdate end from orders where o_orderkey % 2 = 0",
    "weekly": "select concat('U', user_id, '-', event_type, '-', event_id % 4) as src, concat('U', user_id, '-sink-', event_id % 4) as dst, value as amount, ts, case when event_type = 'purchase' then 'AE' else 'GB' end as dest_country, event_type = 'error' as sar from events",
    "reports": "select doc_id as report_id, concat(coalesce(text, ''), ' T', 1 + doc_id % 4, '-', lpad(cast(doc_id % 1000 as varchar(9)), 3, '0'), ' T1-', lpad(cast(doc_id % 7 as varchar(9)), 3, '0'), ' T1-', lpad(cast(doc_id % 7 as varchar(9)), 3, '0')) as text from documents",
    "valid_ids": "select distinct concat('T', 1 + o_custkey % 3, '-', lpad(cast(o_custkey % 500 as varchar(9)), 3, '0')) as id from orders",
    "gold_ids": "select distinct concat('T1-', lpad(cast(n_nationkey % 13 as varchar(9)), 3, '0')) as id from nation",
    "claims": "select conv_id as report_id, turn as claim_id, case when turn % 4 = 0 then ' Supported ' when turn % 4 = 1 then 'contradicted' when turn % 4 = 2 then 'supported' else null end as support, concat('T', 1 + conv_id % 3, '-', lpad(cast(turn % 500 as varchar(9)), 3, '0')) as cited from conversations",
    "runs": "select concat('run', doc_id % 50) as run_id, avg(quality) as q, avg(toxic) as t, count(*) as n from labels group by concat('run', doc_id % 50)",
    "policy": "select * from (values ('quality_rate', 'Quality', 'higher_is_better', 0.85, 'rate', true), ('toxic_rate', 'Toxic', 'lower_is_better', 0.12, 'rate', true), ('row_count', 'Rows', 'higher_is_better', 8.0, 'count', false)) as p(metric, label, direction, threshold, unit, required)",
    "measured": "select run_id, 'quality_rate' as metric, cast(q as double) as value from runs union all select run_id, 'toxic_rate', cast(t as double) from runs where n % 5 <> 0 union all select run_id, 'row_count', cast(n as double) from runs",
    "refs": "select concat('R', s_suppkey) as record_id, case when s_suppkey % 4 = 0 then concat('T', s_suppkey * 37) when s_suppkey % 4 = 1 then concat('C', s_suppkey) when s_suppkey % 4 = 2 then concat('e', s_suppkey) else concat('X', s_suppkey) end as ref from supplier",
    "ids": "select upper(concat('t', o_orderkey)) as id, 'transaction' as type from orders union all select concat('C', c_custkey), 'customer' from customer union all select concat('E', s_suppkey), 'evidence' from supplier where s_suppkey % 3 = 0",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def needed(sql: str, own: str = "") -> list[str]:
    """Views that a text names, those they stand on first."""
    import re

    out: list[str] = []
    for name in VIEWS:
        if name != own and re.search(rf"\b{name}\b", sql):
            out += [x for x in [*needed(VIEWS[name], name), name] if x not in out]
    return out


def active() -> SparkSession:
    return SparkSession.active()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    import re

    for v in [*needed(VIEWS[name], name), name]:
        for t in TABLES:
            if re.search(rf"\b{t}\b", VIEWS[v]):
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        spark.sql(VIEWS[v]).createOrReplaceTempView(v)
    return spark.table(name)


def with_views(sql: str, recursive: bool = False, extra: str = "") -> str:
    parts = [f"{v} as ({VIEWS[v]})" for v in needed(extra + sql)]
    return ("with recursive " if recursive else "with ") + ",\n".join([*parts, *([extra] if extra else [])]) + "\n" + sql


def query(sql: str | None = None, extra: str = "", recursive: bool = False):
    """Registers a function (V: name -> view) as a query with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda v: view(spark, sf_dir, v))
        if sql:
            SQL[f.__name__] = with_views(sql, recursive, extra) if needed(extra + sql) else sql
        return f

    return add


REACH = """e as (select distinct src, dst from transfers),
und as (select src as a, dst as b from e union select dst, src from e),
w as (select distinct a as node, a as seen from und union select w.node, und.b from w join und on und.a = w.seen),
comp as (select node, min(seen) as component from w group by 1),
r as (select src as node, dst as seen from e union select r.node, e.dst from r join e on e.src = r.seen),
scc as (select n.node, least(n.node, coalesce(min(x.seen), n.node)) as scc from comp n left join (select a.node, a.seen from r a join r b on a.node = b.seen and a.seen = b.node) x on x.node = n.node group by n.node),
sz as (select scc, count(*) as size from scc group by 1),
circ as (select c.component, count(*) as edge_count, count(*) filter (where s.scc = d.scc and z.size >= 2 and e.src <> e.dst) as cycle_edges from e join comp c on c.node = e.src join scc s on s.node = e.src join scc d on d.node = e.dst join sz z on z.scc = s.scc group by 1),
acc as (select component, count(*) as account_count from comp group by 1),
m as (select component, account_count, total_value, cycle_edges / greatest(edge_count, 1) as circular_flow, sar_ratio, transfers, transfers / greatest(span / 3600.0, 0.01) as velocity
  from (select c.component, cast(sum(cast(amount as decimal(18,2))) as double) as total_value, avg(cast(sar as int)) as sar_ratio, count(*) as transfers, epoch(max(ts)) - epoch(min(ts)) as span from transfers t join comp c on c.node = t.src group by 1)
  join acc using (component) join circ using (component)),
k as (select concat('cluster_', row_number() over (order by component)) as cluster_id, * from m)"""


@query("select src, dst, cast(sum(cast(amount as decimal(18,2))) as decimal(28,2)) as weight, count(*) as n from transfers group by 1, 2")
def edge_weights(V):
    """AGG-01, GRF-01."""
    return risk.edge_weights(V("transfers"))


@query("select src as node from transfers union select dst from transfers")
def graph_nodes(V):
    """AGG-02."""
    return risk.graph_nodes(V("transfers"))


@query("select node, component, count(*) over (partition by component) as account_count from comp", REACH, True)
def wcc_components(V):
    """GRF-02, AGG-03."""
    weak = risk.weak_components(V("transfers").select("src", "dst").distinct())
    return weak.join(weak.groupBy("component").agg(F.count("*").alias("account_count")), "component").select("node", "component", "account_count")


@query("select node, scc, size from scc join sz using (scc)", REACH, True)
def scc_components(V):
    """GRF-03, AGG-04."""
    edges = V("transfers").select("src", "dst").distinct()
    strong = risk.strong_components(edges, risk.weak_components(edges))
    return strong.join(strong.groupBy("scc").agg(F.count("*").alias("size")), "scc").select("node", "scc", "size")


def _order_paths(V) -> DataFrame:
    """One weak component over all orders.  A customer's orders are a cycle; blocks of a hundred customers are chains of these cycles, the
    even ones closed to a cycle; each block leads to the next."""
    V("txn_multi")
    t = active().table("orders").select(F.concat(F.lit("T"), "o_orderkey").alias("node"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.expr("o_custkey div 100").alias("b"))
    own = Window.partitionBy("c").orderBy("k")
    inner = t.select(F.col("node").alias("src"), F.lead("node").over(own).alias("dst"))
    ends = t.groupBy("b", "c").agg(F.min_by("node", "k").alias("first"), F.max_by("node", "k").alias("last"))
    around = ends.select(F.col("last").alias("src"), F.col("first").alias("dst"))
    chain = ends.select(F.col("last").alias("src"), F.lead("first").over(Window.partitionBy("b").orderBy("c")).alias("dst"))
    block = ends.groupBy("b").agg(F.min_by("first", "c").alias("first"), F.max_by("last", "c").alias("last"))
    closed = block.filter("b % 2 = 0").select(F.col("last").alias("src"), F.col("first").alias("dst"))
    on = block.select("b", F.col("last").alias("src")).join(block.select((F.col("b") - 1).alias("b"), F.col("first").alias("dst")), "b").select("src", "dst")
    return inner.unionByName(around).unionByName(chain).unionByName(closed).unionByName(on).filter("dst is not null")


@query("select concat('T', o_orderkey) as node, min(concat('T', o_orderkey)) over (partition by case when o_custkey // 100 % 2 = 0 then -1 - o_custkey // 100 else o_custkey end) as scc, min(concat('T', o_orderkey)) over () as component from orders")
def order_components(V):
    """GRF-02, GRF-03 on one large component with strong ones that it crosses, by star steps and contraction over all executors."""
    edges = cut(_order_paths(V))
    weak = cut(connected_components(edges, one_task_edges=4000))
    return risk.strong_components(edges, weak, task_edges=4000).join(weak, "node").select("node", "scc", "component")


@query("select component, edge_count, cycle_edges, cycle_edges / greatest(edge_count, 1) as circular_flow from circ", REACH, True)
def circular_flow(V):
    """AGG-05, JON-05, JON-06."""
    edges = V("transfers").select("src", "dst").distinct()
    weak = risk.weak_components(edges)
    return risk.circular_flow(edges, weak, risk.strong_components(edges, weak))


@query("select cluster_id, component, account_count, total_value, circular_flow, round_even(sar_ratio, 6) as sar_ratio, transfers, round_even(velocity, 6) as velocity from k", REACH, True)
def cluster_metrics(V):
    """AGG-06, AGG-07, JON-07, WIN-01."""
    return risk.cluster_metrics(V("transfers")).withColumns({"sar_ratio": F.bround("sar_ratio", 6), "velocity": F.bround("velocity", 6)})


_MM = "case when min({0}) over () = max({0}) over () then 0.0 else ({0} - min({0}) over ()) / (max({0}) over () - min({0}) over ()) end"


@query(f"""select cluster_id, account_count, round_even(total_value, 4) as total_value, round_even(circular_flow, 4) as circular_flow, round_even(risk, 4) as risk_score
from (select *, {_MM.format('raw')} as risk from (select *, 0.35::double * {_MM.format('total_value')} + 0.25::double * circular_flow + 0.15::double * {_MM.format('account_count')} + 0.15::double * {_MM.format('velocity')} + 0.10::double * sar_ratio as raw from k)) where risk >= 0.65""", REACH, True)
def cluster_risk(V):
    """GRF-04, AGG-08, AGG-09, FLT-02, SCL-07, SCL-08, SRT-01: the flagship."""
    return risk.cluster_risk(V("transfers"))


@query("select transaction_id, source_account, destination_account, cast(cast(amount as decimal(18,2)) as double) as amount, 'USD' as currency, epoch(ts)::bigint as ts, channel, jurisdiction, sar_linked, 'csv' as source_type from txn")
def normalise_transactions(V):
    """PRJ-01..03, SCL-01..04: rows as untidy text, made canonical."""
    rows = V("txn").select(F.concat(F.lit("  "), "transaction_id", F.lit("\t")).alias("txn_id"), F.col("source_account").alias("from_account"), F.col("destination_account").alias("to_account"),
                           F.format_number("amount", 2).alias("amount"), F.lit(" usd ").alias("currency"), F.col("ts").cast("string").alias("timestamp"), "channel", F.col("jurisdiction").alias("destination_country"), F.when(F.col("sar_linked"), "yes").otherwise("no").alias("sar_linked"))
    out = readers.map_transactions(rows, "csv").filter("problem is null")
    return out.select("transaction_id", "source_account", "destination_account", F.col("amount").cast("double").alias("amount"), "currency", F.unix_timestamp("timestamp").alias("ts"), "channel", "jurisdiction", "sar_linked", F.col("source_lineage.source_type").alias("source_type"))


@query("select concat('T', o_orderkey) as transaction_id, case when o_orderkey % 5 = 0 then 'invalid amount' when o_orderkey % 7 = 0 then 'invalid timestamp' when o_orderkey % 11 = 0 then 'invalid currency' end as problem from orders where o_orderkey % 5 = 0 or o_orderkey % 7 = 0 or o_orderkey % 11 = 0")
def reject_invalid_rows(V):
    """FLT-01."""
    key = F.substring("transaction_id", 2, 20).cast("long")
    rows = V("txn").select("transaction_id", "source_account", "destination_account", F.when(key % 5 == 0, "12x").otherwise(F.col("amount").cast("string")).alias("amount"),
                           F.when(key % 7 == 0, "soon").otherwise(F.col("ts").cast("string")).alias("timestamp"), F.when(key % 11 == 0, "US1").otherwise("USD").alias("currency"))
    return readers.map_transactions(rows, "csv").filter("problem is not null").select("transaction_id", "problem")


@query("select concat('L', l_orderkey, '-', l_linenumber) as id, count(*) as n from lineitem group by 1 having count(*) > 1")
def duplicate_ids(V):
    """WIN-03."""
    V("transfers")
    return readers.duplicate_ids(active().table("lineitem").select(F.concat(F.lit("L"), "l_orderkey", F.lit("-"), "l_linenumber").alias("k")), "k")


_SEEN = "seen as (select *, row_number() over w as n, first_value(id) over w as id0, first_value(amount) over w as amount0, first_value(currency) over w as currency0, first_value(ts) over w as ts0 from txn_multi window w as (partition by upper(id) order by src, rn))"


def _multi(V):
    rows = V("txn_multi").select(F.col("src").alias("_src"), F.col("rn").alias("_row"), F.col("id").alias("transaction_id"), F.lit("A").alias("source_account"), F.lit("B").alias("destination_account"), F.col("amount").cast("decimal(38,10)").alias("amount"), "currency", F.col("ts").cast("timestamp").alias("timestamp"),
                                 F.lit(None).cast("string").alias("channel"), F.lit(None).cast("string").alias("jurisdiction"), F.lit(False).alias("sar_linked"), F.lit(None).cast(S.LINEAGE).alias("source_lineage"))
    return merge.merge_collection(rows, "transactions", ["_src", "_row"])


@query("select id as transaction_id, amount, currency, epoch(ts)::bigint as ts from seen where n = 1", _SEEN)
def merge_kept(V):
    """DOM-01, WIN-02, SET-01."""
    return _multi(V)[0].select("transaction_id", F.col("amount").cast("double").alias("amount"), "currency", F.unix_timestamp("timestamp").alias("ts"))


@query("select 'transaction' as record_type, id as record_id, case when ts <> ts0 then 'timestamp_mismatch' when currency <> currency0 then 'currency_mismatch' else 'conflicting_value' end as conflict_type from seen where n > 1 and (ts <> ts0 or currency <> currency0 or amount <> amount0)", _SEEN)
def merge_conflicts(V):
    """DOM-02, JON-01."""
    return _multi(V)[1].select("record_type", "record_id", "conflict_type")


@query("select concat('R', s_suppkey) as record_id, 'missing_reference' as conflict_type, side from (select s_suppkey, 'source' as side, s_suppkey as k from supplier union all select s_suppkey, 'target', s_suppkey + 40 from supplier) where k not in (select n_nationkey from nation) order by 1")
def missing_reference(V):
    """JON-02, SET-01."""
    V("refs")
    spark = active()
    sup = spark.table("supplier").select(F.concat(F.lit("R"), "s_suppkey").alias("relationship_id"), F.concat(F.lit("n"), "s_suppkey").alias("source_entity_id"), F.concat(F.lit("n"), F.col("s_suppkey") + 40).alias("target_entity_id"))
    V("txn")
    out = merge.missing_references(sup, spark.table("nation").select(F.concat(F.lit("N"), "n_nationkey").alias("entity_id")))
    return out.select("record_id", "conflict_type", F.regexp_extract("description", "unknown (\\w+) entity", 1).alias("side"))


def _indexed(V) -> dict[str, DataFrame]:
    """Collections whose ids are those of the view ``ids``."""
    V("ids")
    t = active().table
    return {"transactions": t("orders").select(F.concat(F.lit("t"), "o_orderkey").alias("transaction_id")), "customers": t("customer").select(F.concat(F.lit("C"), "c_custkey").alias("customer_id")),
            "evidence": t("supplier").filter("s_suppkey % 3 = 0").select(F.concat(F.lit("e"), "s_suppkey").alias("evidence_id"))}


@query("select id, string_agg(distinct type, '/' order by type) as types from ids group by id")
def record_type_index(V):
    """AGG-17."""
    return merge.record_type_index(active(), _indexed(V)).select("id", F.array_join("types", "/").alias("types"))


@query("select 'relationship' as record_type, record_id, ref, case when max(i.id) is null then 'dangling' else 'incompatible' end as issue from refs left join ids i on i.id = upper(ref) group by record_id, ref having count(*) filter (where type in ('evidence', 'transaction')) = 0")
def reference_issues(V):
    """JON-03, DOM-04."""
    index = merge.record_type_index(active(), _indexed(V))
    return merge.reference_issues(V("refs").select(F.lit("relationship").alias("record_type"), "record_id", "ref"), index)


@query("select record_id as sar_id, ref from refs where upper(ref) not in (select id from ids where type = 'transaction')")
def sar_missing_transactions(V):
    """JON-04."""
    index = merge.record_type_index(active(), _indexed(V))
    return merge.missing_transactions(V("refs").select(F.col("record_id").alias("sar_id"), F.array("ref").alias("transaction_ids")), index).select("sar_id", "ref")


@query("select 'jurisdictions' as collection, count(*) as records, (select sha256(string_agg(h, '' order by g)) from (select left(x, 3) as g, sha256(string_agg(x, '' order by x)) as h from (select sha256(concat('N', n_nationkey, '|', n_name, '|', case when n_nationkey % 2 = 0 then 'true' else 'false' end)) as x from nation) group by 1)) as hash from nation")
def content_hash(V):
    """SCL-12, SCL-13, SRT-02: one small collection; DOM-06 is case_hashes."""
    V("txn")
    rows = active().table("nation").select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 2 == 0).alias("high_risk"))
    return merge.collection_hash(rows, "jurisdictions")


#: Collections that the driver tables fill: SQL of their rows, fields as in the schema.
CASE = {
    "transactions": "select transaction_id, source_account, destination_account, cast(cast(amount as decimal(18,2)) as decimal(38,10)) as amount, currency, cast(ts as timestamp) as timestamp, channel, jurisdiction, sar_linked from txn",
    "accounts": "select concat('C', c_custkey) as account_id, c_name as owner, cast(null as varchar(9)) as institution, 'USD' as currency from customer",
    "customers": "select concat('C', c_custkey) as customer_id, c_name as name, c_mktsegment as risk_rating, n_name as jurisdiction from customer join nation on c_nationkey = n_nationkey",
    "entities": "select concat('E', s_suppkey) as entity_id, 'supplier' as entity_type, s_name as display_name from supplier",
    "alerts": "select concat('L', event_id) as alert_id, concat('U', user_id) as case_id, event_type as typology, cast(null as varchar(9)) as severity from events",
    "jurisdictions": "select concat('N', n_nationkey) as code, n_name as name, n_nationkey % 2 = 0 as high_risk from nation",
}
VIEWS |= {f"case_{k}": v for k, v in CASE.items()}


def _line(collection: str) -> str:
    fields = [x.split() for x in S.COLLECTIONS[collection][3].split(", ")]
    fields = [f"strftime({name}, '%Y-%m-%d %H:%M:%S')" if kind == "timestamp" else f"cast({name} as varchar)" for name, kind in fields]
    return "concat_ws('|', " + ", ".join(f"coalesce(regexp_replace({x}, '([\\\\|;,])', '\\\\\\1', 'g'), '')" for x in fields) + ")"


_HASHES = "hs as (" + " union all ".join(f"select '{k}' as collection, sha256({_line(k)}) as x from case_{k}" for k in CASE) + "), hg as (select collection, left(x, 3) as g, count(*) as n, sha256(string_agg(x, '' order by x)) as h from hs group by 1, 2)"


@query("select collection, cast(sum(n) as bigint) as records, sha256(string_agg(h, '' order by g)) as hash from hg group by 1", _HASHES)
def case_hashes(V):
    """DOM-06, AGG-10: records and hash of each collection of a case over all driver rows."""
    return assurance.union([merge.collection_hash(V(f"case_{k}"), k) for k in CASE])


@query("select 'transactions' as collection, count(*) as records from txn union all select 'customers', count(*) from customer")
def record_counts(V):
    """AGG-10."""
    return sinks.record_counts({"transactions": V("txn"), "customers": active().table("customer")})


_WEEK = "wk as (select *, cast(date_trunc('week', ts) as date) as start_date from weekly), acct as (select start_date, src as a from wk union all select start_date, dst from wk), fresh as (select start_date, count(*) as f from (select a, min(start_date) as start_date from acct group by 1) group by 1), uq as (select start_date, count(distinct a) as u from acct group by 1), sm as (select start_date, count(*) as n, cast(sum(cast(amount as decimal(18,2))) as double) as v, count(*) filter (where dest_country in ('AE','RU','CY','NG','TR')) as hr, count(*) filter (where sar) as sr from wk group by 1)"


@query(f"select concat('week_', row_number() over (order by start_date)) as week, start_date, cast(start_date + 6 as date) as end_date, n as transfer_count, u as unique_accounts, v as total_value, coalesce(f, 0) as new_accounts_count, hr as high_risk_dest_count, sr as sar_count, round_even({_MM.format('(cast(coalesce(f, 0) + hr + sr as double))')}, 4) as anomaly_score from sm join uq using (start_date) left join fresh using (start_date)", _WEEK)
def weekly_summary(V):
    """TSK-06, WIN-05, SCL-23, FLT-04, AGG-08."""
    return risk.weekly_summary(V("weekly"))


@query("select report_id, upper(unnest(regexp_extract_all(text, '\\bT[123]-\\d{3}\\b'))) as id, 1 as one from reports".join(["select report_id, id, count(*) as times from (", ") group by 1, 2"]))
def citation_counts(V):
    """SCL-09, AGG-12."""
    return evidence.cited(V("reports"))


_TRACE = "c as (select report_id, id, count(*) as times from (select report_id, upper(unnest(regexp_extract_all(text, '\\bT[123]-\\d{3}\\b'))) as id from reports) group by 1, 2), g as (select report_id, cast(sum(times) as bigint) as cited_total, count(*) as cited_distinct, count(*) filter (where id in (select id from valid_ids)) as grounded, count(*) filter (where id not in (select id from valid_ids)) as fabricated, count(*) filter (where id in (select id from valid_ids) and id in (select id from gold_ids)) as matched, string_agg(id, ',' order by id) filter (where id not in (select id from valid_ids)) as fabricated_ids from c group by 1), p as (select r.report_id, coalesce(cited_total, 0) as cited_total, coalesce(cited_distinct, 0) as cited_distinct, coalesce(grounded, 0) as grounded, coalesce(fabricated, 0) as fabricated, coalesce(matched, 0) as matched, coalesce(fabricated_ids, '') as fabricated_ids, (select count(*) from gold_ids) as gold_total from reports r left join g using (report_id)), q as (select *, case when grounded > 0 then round_even(matched / grounded, 4) end as precision, case when gold_total > 0 then round_even(matched / gold_total, 4) end as recall from p)"


@query("select *, case when precision + recall > 0 then round_even(2 * precision * recall / (precision + recall), 4) end as f1 from q", _TRACE)
def traceability(V):
    """DOM-07, JON-08, AGG-13; the lists are in gold_citations."""
    return evidence.traceability(V("reports"), V("valid_ids"), V("gold_ids")).drop("grounded_ids", "matched_ids", "missing_ids")


_LISTS = _TRACE + ", gr as (select report_id, id from c where id in (select id from valid_ids)), mg as (select r.report_id, g.id from reports r cross join gold_ids g where (r.report_id, g.id) not in (select report_id, id from gr)), li as (select report_id, string_agg(id, ',' order by id) as grounded_ids, string_agg(id, ',' order by id) filter (where id in (select id from gold_ids)) as matched_ids from gr group by 1), ml as (select report_id, string_agg(id, ',' order by id) as missing_ids from mg group by 1)"


@query("select report_id, coalesce(grounded_ids, '') as grounded_ids, coalesce(matched_ids, '') as matched_ids, coalesce(missing_ids, '') as missing_ids from reports left join li using (report_id) left join ml using (report_id)", _LISTS)
def gold_citations(V):
    """DOM-07, JON-09."""
    return evidence.traceability(V("reports"), V("valid_ids"), V("gold_ids")).select("report_id", "grounded_ids", "matched_ids", "missing_ids")


_CLAIMS = "sc as (select report_id, claim_id, case when cited not in (select id from valid_ids) then 'unsupported' when lower(trim(coalesce(support, 'unsupported'))) in ('supported', 'contradicted') then lower(trim(support)) else 'unsupported' end as scored from claims)"


def _scored(V):
    return evidence.score_claims(V("claims").withColumn("cited_ids", F.array("cited")), V("valid_ids"))


@query("select report_id, claim_id, scored from sc", _CLAIMS)
def claim_scoring(V):
    """DOM-08, JON-10."""
    return _scored(V)


@query("select report_id, count(*) as claims, count(*) filter (where scored = 'supported') as supported, count(*) filter (where scored = 'unsupported') as unsupported, count(*) filter (where scored = 'contradicted') as contradicted, round_even(count(*) filter (where scored <> 'supported') / count(*), 4) as eghr_rate from sc group by 1", _CLAIMS)
def eghr_rate(V):
    """AGG-11."""
    return evidence.hallucination_rate(_scored(V))


@query("select run_id, cast(sum(score) as bigint) as total, cast(sum(mx) as bigint) as maximum, round_even(sum(score) / sum(mx), 4) as percentage, case when round_even(sum(score) / sum(mx), 4) >= 0.8 then 'PASS' else 'FAIL' end as verdict from (select concat('run', doc_id % 50) as run_id, quality as score, 1 as mx from labels) group by 1")
def rubric_totals(V):
    """AGG-14."""
    V("runs")
    return evidence.rubric_totals(active().table("labels").select(F.concat(F.lit("run"), F.col("doc_id") % 50).alias("run_id"), F.col("quality").alias("score"), F.lit(1).alias("max")), 0.8)


_STATUS = "st as (select r.run_id, p.metric, label, direction, cast(threshold as double) as threshold, unit, required, value, case when value is null then 'NOT_EVALUATED' when direction = 'higher_is_better' and value >= threshold or direction = 'lower_is_better' and value <= threshold then 'PASS' else 'FAIL' end as status from runs r cross join policy p left join measured m on m.run_id = r.run_id and m.metric = p.metric)"


def _status(V):
    policy = V("policy").withColumn("threshold", F.col("threshold").cast("double"))
    return assurance.metric_status(V("runs"), policy, V("measured"))


@query("select run_id, metric, status from st", _STATUS)
def metric_status(V):
    """DOM-10, JON-11."""
    return _status(V).select("run_id", "metric", "status")


_DECIDE = ", dc as (select run_id, count(*) filter (where status <> 'NOT_EVALUATED') as evaluated, count(*) filter (where status = 'FAIL' and required) as required_failed, count(*) filter (where status = 'FAIL' and not required) as optional_failed, count(*) filter (where status = 'NOT_EVALUATED') as not_evaluated from st group by 1), de as (select *, case when evaluated = 0 or required_failed > 0 then 'NOT_READY_FOR_DEPLOYMENT' when optional_failed + not_evaluated > 0 then 'PASS_WITH_CONDITIONS' else 'PASS' end as decision from dc)"


@query("select * from de", _STATUS + _DECIDE)
def assurance_decision(V):
    """DOM-11."""
    return assurance.decide(_status(V))


@query("select run_id, case when evaluated % 2 = 0 and required_failed = 0 then 'NOT_READY_FOR_DEPLOYMENT' else decision end as decision, case when optional_failed > 1 then 5 when required_failed > 1 then 1 when evaluated % 2 = 0 and required_failed = 0 then 4 when decision = 'PASS_WITH_CONDITIONS' then 3 when decision = 'NOT_READY_FOR_DEPLOYMENT' then 4 else 0 end as exit_code from de", _STATUS + _DECIDE)
def exit_code(V):
    """DOM-12, DOM-19."""
    d = assurance.decide(_status(V))
    gated = assurance.case_gate(F.col("decision"), F.col("evaluated") % 2 == 0, F.when(F.col("required_failed") == 0, 1).otherwise(0), F.lit(0))
    zero = F.lit(0)
    return d.select("run_id", gated.alias("decision"), assurance.exit_code(F.col("optional_failed") > 1, F.when(F.col("required_failed") > 1, 1).otherwise(0), zero, zero, gated).alias("exit_code"))


@query("select de.run_id, b.decision as baseline_decision, de.decision, case de.decision when 'PASS' then 0 when 'PASS_WITH_CONDITIONS' then 1 else 2 end > case b.decision when 'PASS' then 0 when 'PASS_WITH_CONDITIONS' then 1 else 2 end as is_regression from de, de b where b.run_id = 'run1' and de.run_id <> 'run1'", _STATUS + _DECIDE)
def regressions(V):
    """DOM-13: each run's decision against that of run1."""
    d = assurance.decide(_status(V)).select("run_id", "decision")
    first = d.filter("run_id = 'run1'").select(F.col("decision").alias("baseline_decision"))  # one row
    return d.filter("run_id <> 'run1'").crossJoin(F.broadcast(first)).select("run_id", "baseline_decision", "decision", assurance.is_regression(F.col("baseline_decision"), F.col("decision")).alias("is_regression"))


@query("select run_id, case when required_failed > 1 then 'FAIL' when not_evaluated = 0 and optional_failed > 0 then 'FAIL' else 'PASS' end as overall_verdict from de", _STATUS + _DECIDE)
def overall_verdict(V):
    """DOM-22: required metrics stand for the tests, optional ones for the judge, who is not run where a value is missing."""
    d = assurance.decide(_status(V))
    tests, judge = F.when(F.col("required_failed") > 1, 1).otherwise(0), F.when(F.col("not_evaluated") == 0, F.col("optional_failed"))
    return d.select("run_id", assurance.overall_verdict(tests, judge).alias("overall_verdict"))


_PAIR = ", b as (select * from st where run_id = 'run1'), c as (select * from st where run_id = 'run2' and metric <> 'row_count')"


@query("select metric, coalesce(b.label, c.label) as label, b.value as baseline, c.value as candidate, c.value - b.value as change, case when c.value - b.value is null then 'unknown' when abs(c.value - b.value) < 1e-9 then 'unchanged' when (coalesce(c.direction, b.direction) = 'lower_is_better') = (c.value > b.value) then 'worse' else 'better' end as trend, coalesce(c.status = 'FAIL' and b.status is distinct from 'FAIL', false) as newly_failed, coalesce(b.status = 'FAIL' and c.status = 'PASS', false) as newly_passed from b full outer join c using (metric)", _STATUS + _PAIR)
def regress_deltas(V):
    """DOM-14, DOM-15, JON-12, MSC-02, SET-03."""
    st = _status(V)
    return assurance.compare(st.filter("run_id = 'run1'"), st.filter("run_id = 'run2' and metric <> 'row_count'")).drop("direction", "unit")


@query("select run_id, 'task' as field, 'task1' as reference_value, concat('task', n % 3) as value from runs where run_id <> 'run1' and concat('task', n % 3) <> 'task1' and (select n % 3 from runs where run_id = 'run1') >= 0")
def compat_warnings(V):
    """DOM-16, JON-13, AGG-16, MSC-05."""
    none = F.lit(None).cast("string")
    runs = V("runs").select("run_id", F.when(F.col("run_id") == "run1", "task1").otherwise(F.concat(F.lit("task"), F.col("n") % 3)).alias("task"), none.alias("policy_id"), F.lit("1.0").alias("policy_version"), none.alias("benchmark_version"), F.when(F.col("run_id") != "run1", "x").alias("dataset_hash"))
    marks = assurance.fingerprint(_status(V))
    return assurance.compatibility(runs.join(marks, "run_id", "left"), "run1")


_MULE = "tx as (select src, dst, cast(amount as decimal(18,2)) as amount, sar, concat(src, '>', dst, '@', strftime(ts, '%Y-%m-%d %H:%M:%S')) as txn_id from transfers), sd as (select src as account_id, txn_id, amount as sent, cast(0 as decimal(18,2)) as got, sar from tx union all select dst, txn_id, 0, amount, sar from tx), ac as (select account_id, cast(sum(sent) as double) as sent, cast(sum(got) as double) as got, count(*) filter (where sent > 0) as n_out, count(*) filter (where got > 0) as n_in, bool_or(sar) as sar, string_agg(distinct txn_id, ';' order by txn_id) as ids from sd group by 1), th as (select *, least(sent, got) / greatest(sent, got) as through from ac), kd as (select *, case when n_in >= 1 and n_out >= 1 and through >= 0.8 and sar then 'mule' when n_in >= 3 and n_out <= 1 then 'collector' when n_out >= 3 and n_in <= 1 then 'distributor' when sar then 'suspicious' else 'legitimate' end as kind from th)"


@query("select account_id, kind as classification, round_even(case kind when 'mule' then through when 'legitimate' then 0.5 else 0.7 end, 4) as confidence, ids as supporting_txn_ids from kd", _MULE)
def mule_findings(V):
    """TSK-07: our rules; the task fixes the output's schema only."""
    rows = V("transfers").withColumn("txn_id", F.concat("src", F.lit(">"), "dst", F.lit("@"), F.col("ts").cast("string")))
    return risk.mule_findings(rows)


@query()
def markdown_sections(V):
    """SCL-19."""
    V("reports")
    return evidence.markdown_sections(active().table("documents").select("doc_id", "text"), "doc_id")


@query("select sql, tbl, upper(trim(cur)) as code, case when length(trim(cur)) = 3 then false else true end as bad from (select concat('select * from t', n_nationkey, ' where 1=1') as sql, concat('t', n_nationkey) as tbl, concat(' ', left(lower(n_name), 3 + n_nationkey % 2), ' ') as cur from nation)")
def scalar_functions(V):
    """SCL-03, SCL-15."""
    V("txn")
    rows = active().table("nation").select(F.concat(F.lit("select * from t"), "n_nationkey", F.lit(" where 1=1")).alias("sql"), F.concat(F.lit(" "), F.left(F.lower("n_name"), 3 + F.col("n_nationkey") % 2), F.lit(" ")).alias("cur"))
    return rows.select("sql", N.table_of(F.col("sql")).alias("tbl"), N.parse_currency(F.col("cur")).alias("code"), N.bad_currency(F.col("cur")).alias("bad"))


# --- sources and sinks: what is written is read again -------------------------------------------


def _place(name: str) -> str:
    """A new folder in the shared one."""
    import uuid

    return f"{shared_dir(active())}/argus-{name}-{uuid.uuid4().hex}"


def _canonical(V) -> DataFrame:
    """All orders as canonical transactions."""
    rows = V("txn").select("transaction_id", "source_account", "destination_account", F.col("amount").cast("decimal(18,2)").cast("string").alias("amount"), "currency", F.col("ts").cast("string").alias("timestamp"), "channel", "jurisdiction", F.when(F.col("sar_linked"), "true").otherwise("false").alias("sar_linked"))
    return readers.map_transactions(rows, "table").drop("problem")


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("transaction_id", "source_account", "destination_account", F.col("amount").cast("double").alias("amount"), "currency", F.unix_timestamp("timestamp").alias("ts"), "channel", "jurisdiction", "sar_linked", F.col("source_lineage.source_type").alias("source_type"))


def _round_trip(kind: str) -> str:
    return f"select transaction_id, source_account, destination_account, cast(cast(amount as decimal(18,2)) as double) as amount, currency, epoch(ts)::bigint as ts, channel, jurisdiction, sar_linked, '{kind}' as source_type from txn"


@query(_round_trip("csv"))
def csv_roundtrip(V):
    """SRC-01, SNK-02, SCL-14."""
    rows, path = _canonical(V), _place("csv")
    sinks.write_csv(rows, path)
    return _told(readers.read_csv(active(), path).collections["transactions"])


@query(_round_trip("csv"))
def unquoted_roundtrip(V):
    """SNK-02 without quotes."""
    rows, path = _canonical(V), _place("plain")
    sinks.write_csv(rows, path, quoted=False)
    return _told(readers.read_csv(active(), path).collections["transactions"])


@query(_round_trip("json"))
def json_roundtrip(V):
    """SRC-02, SNK-03, PRJ-04."""
    rows, path = _canonical(V), _place("json")
    sinks.write_collection(rows.drop("source_lineage"), "transaction_id", path)
    return _told(readers.read_json(active(), f"{path}.json").collections["transactions"])


@query(_round_trip("json"))
def jsonl_roundtrip(V):
    """SRC-03."""
    rows, path = _canonical(V), f"{_place('lines')}.jsonl"
    sinks.write_jsonl(rows.drop("source_lineage"), "transaction_id", path)
    return _told(readers.read_json(active(), path).collections["transactions"])


@query(_round_trip("parquet"))
def parquet_roundtrip(V):
    """SRC-04, SNK-01, SCL-05."""
    rows, path = _canonical(V), _place("parquet")
    sinks.write_parquet(rows, path)
    return _told(readers.read_parquet(active(), path).collections["transactions"])


@query("select 'entity' as kind, concat('n', n_nationkey) as id, 'nation' as type, n_name as a, null as b, '' as refs from nation union all select 'entity', concat('s', s_suppkey), 'unknown', null, null, '' from supplier union all select 'relationship', concat('r', s_suppkey), case when s_suppkey % 2 = 0 then 'based_in' else 'related_to' end, concat('s', s_suppkey), concat('n', s_nationkey), concat('T', s_suppkey, '/T', s_suppkey + 1) from supplier")
def graphml_roundtrip(V):
    """SRC-09, SCL-10."""
    V("refs")
    V("txn")
    t, path = active().table, _place("graph")
    data = lambda k, v: F.concat(F.lit(f'<data key="{k}">'), v, F.lit("</data>"))
    node = t("nation").select(F.concat(F.lit('<node id="n'), "n_nationkey", F.lit('">'), data("label", F.lit("nation")), data("name", F.col("n_name")), F.lit("</node>")).alias("value")).unionByName(t("supplier").select(F.concat(F.lit('<node id="s'), "s_suppkey", F.lit('"></node>')).alias("value")))
    edge = t("supplier").select(F.concat(F.lit('<edge id="r'), "s_suppkey", F.lit('" source="s'), "s_suppkey", F.lit('" target="n'), "s_nationkey", F.lit('">'), F.when(F.col("s_suppkey") % 2 == 0, data("type", F.lit("based_in"))).otherwise(""), data("evidence_ids", F.concat(F.lit("T"), "s_suppkey", F.lit(", ,T"), F.col("s_suppkey") + 1)), F.lit("</edge>")).alias("value"))
    sinks.write_graphml(node.unionByName(edge), path)
    g = readers.read_graphml(active(), path).collections
    none = F.lit(None).cast("string")
    ents = g["entities"].select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), F.col("entity_type").alias("type"), F.col("display_name").alias("a"), none.alias("b"), F.lit("").alias("refs"))
    return ents.unionByName(g["relationships"].select(F.lit("relationship").alias("kind"), F.col("relationship_id").alias("id"), F.col("relationship_type").alias("type"), F.col("source_entity_id").alias("a"), F.col("target_entity_id").alias("b"), F.array_join("evidence_ids", "/").alias("refs")))


@query("select src, dst, txn_id, cast(cast(amount as decimal(18,2)) as double) as amount, epoch(ts)::bigint as ts, sar from (select source_account as src, destination_account as dst, transaction_id as txn_id, amount, ts, sar_linked as sar from txn)")
def ledger_roundtrip(V):
    """SRC-10."""
    path = _place("ledger")
    flag = F.when(F.col("sar_linked"), "1").otherwise("0")
    V("txn").select(F.col("transaction_id").alias("txn_id"), F.col("ts").cast("string").alias("timestamp"), "source_account", "destination_account", F.col("amount").cast("decimal(18,2)").alias("amount"), flag.alias("sar_linked")).write.option("header", True).csv(path)
    return documents.read_ledger(active(), path).select("src", "dst", "txn_id", "amount", F.unix_timestamp("ts").alias("ts"), "sar")


@query(f"""select cluster_id, account_count, regexp_replace(printf('%.4f', round_even(total_value, 4)), '\\.?0+$', '') as total_value, regexp_replace(printf('%.4f', round_even(circular_flow, 4)), '\\.?0+$', '') as circular_flow_score, regexp_replace(printf('%.4f', round_even(risk, 4)), '\\.?0+$', '') as risk_score
from (select *, {_MM.format('raw')} as risk from (select *, 0.35::double * {_MM.format('total_value')} + 0.25::double * circular_flow + 0.15::double * {_MM.format('account_count')} + 0.15::double * {_MM.format('velocity')} + 0.10::double * sar_ratio as raw from k)) where risk >= 0.65""", REACH, True)
def clusters_file(V):
    """SNK-07."""
    path = _place("clusters")
    sinks.write_clusters(risk.cluster_risk(V("transfers")), path)
    return active().read.option("header", True).schema("cluster_id string, account_count long, total_value string, circular_flow_score string, risk_score string").csv(path)


@query("select upper(id) as id from valid_ids union select upper(id) from gold_ids")
def grounding_files(V):
    """SRC-11, SRC-12, SRC-13: ids of a CSV and a JSON file; a file of another kind and a missing one add none."""
    path = _place("ground")
    V("valid_ids").select(F.concat(F.lit(" "), "id").alias("txn_id")).coalesce(1).write.option("header", True).csv(f"{path}/a.csv")
    sinks.write_text(active(), active().createDataFrame([("x",)], "x string").select(F.lit("")).first()[0], f"{path}/c.txt")
    rows = V("gold_ids").select(F.lower("id").alias("txn_id"))
    rows.agg(F.concat(F.lit('{"transfers":'), F.to_json(F.collect_list(F.struct("txn_id"))), F.lit("}")).alias("value")).write.text(f"{path}/b.json")
    return documents.grounding(active(), [f"{path}/{x}" for x in ("a.csv", "b.json", "c.txt", "none.json")])


@query("select upper(id) as id from gold_ids")
def gold_file(V):
    """SRC-14."""
    path = f"{_place('gold')}/gold.json"
    V("gold_ids").agg(F.to_json(F.struct(F.collect_list(F.lower("id")).alias("gold_evidence_txn_ids"))).alias("value")).write.text(path)
    return documents.read_gold(active(), path)


@query("select concat('run', doc_id % 50) as run, count(*) as total, count(*) filter (where quality = 1 and toxic = 0) as passed, count(*) filter (where toxic = 1) as failed, count(*) filter (where quality = 0 and toxic = 0) as skipped, 0 as other from labels where quality is not null and toxic is not null group by 1")
def test_outcomes(V):
    """SRC-16, AGG-15: all labels as single results in a file for each run."""
    V("runs")
    path = _place("trx")
    rows = active().table("labels").filter("quality is not null and toxic is not null").select(F.concat(F.lit("run"), F.col("doc_id") % 50).alias("run"), F.concat(F.lit('<UnitTestResult testName="t'), "doc_id", F.lit('" outcome="'), F.when(F.col("toxic") == 1, "Failed").when(F.col("quality") == 1, "Passed").otherwise("NotExecuted"), F.lit('"></UnitTestResult>')).alias("x"))
    whole = rows.groupBy("run").agg(F.concat(F.lit('<TestRun><ResultSummary outcome="Failed"/><Results>'), F.array_join(F.collect_list("x"), "\n"), F.lit("</Results></TestRun>")).alias("value"))
    whole.repartition("run").write.partitionBy("run").text(path)
    found = documents.read_test_results(active(), f"{path}/*").withColumn("run", F.regexp_extract(F.input_file_name(), "run=([^/]*)/", 1))
    return profiles.test_counts(found)


@query("select metric, label, direction, cast(threshold as double) as threshold, unit, required, 'p1' as policy_id, 'gap a/gap b' as gaps from policy")
def policy_file(V):
    """SRC-18."""
    path = f"{_place('policy')}/policy.json"
    rows = V("policy").withColumn("threshold", F.col("threshold").cast("double"))
    rows.agg(F.collect_list(F.struct(*rows.columns)).alias("thresholds")).select(F.to_json(F.struct(F.lit("p1").alias("policy_id"), F.lit("1").alias("policy_version"), "thresholds", F.array(F.lit("gap a"), F.lit("gap b")).alias("not_yet_implemented_dimensions"))).alias("value")).write.text(path)
    got = documents.read_policy(active(), path)
    return got.thresholds.withColumns({"policy_id": F.lit(got.policy_id), "gaps": F.lit("/".join(got.gaps))})


@query("select 'kept' as what, case when src = 0 then 'T' else 't' end as prefix, count(*) as n from txn_multi where src = 0 group by 1, 2 union all select 'schema_version_mismatch', 'later', 1")
def schema_gate(V):
    """FLT-03: a source of another schema version is left out whole."""
    rows = V("txn_multi").select("src", F.col("id").alias("transaction_id"), F.lit("A").alias("source_account"), F.lit("B").alias("destination_account"), F.col("amount").cast("decimal(38,10)").alias("amount"), "currency", F.col("ts").cast("timestamp").alias("timestamp"), F.lit(None).cast("string").alias("channel"), F.lit(None).cast("string").alias("jurisdiction"), F.lit(False).alias("sar_linked"), F.lit(None).cast(S.LINEAGE).alias("source_lineage"))
    part = lambda k: {"transactions": rows.filter(F.col("src") == k).drop("src")}
    case = merge.merge(active(), [S.Dataset(part(0), "first"), S.Dataset(part(1), "later", "v0")])
    kept = case.collections["transactions"].groupBy(F.left("transaction_id", F.lit(1)).alias("prefix")).agg(F.count("*").alias("n")).select(F.lit("kept").alias("what"), "prefix", "n")
    return kept.unionByName(case.conflicts.select(F.col("conflict_type").alias("what"), F.col("record_id").alias("prefix"), F.lit(1).cast("long").alias("n")))


def _case(V) -> S.Case:
    """Orders, customers, evidence, relationships and SARs of the driver tables, merged to one case."""
    own = {n: df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.struct_of(n).fields]) for n, df in _indexed(V).items()}
    refs = V("refs")
    own["relationships"] = refs.select(F.col("record_id").alias("relationship_id"), F.lit("a").alias("source_entity_id"), F.lit("a").alias("target_entity_id"), F.lit("x").alias("relationship_type"), F.array("ref").alias("evidence_ids"), F.lit(None).cast(S.LINEAGE).alias("source_lineage"))
    own["sars"] = refs.select(F.col("record_id").alias("sar_id"), F.lit(None).cast("string").alias("case_id"), F.array("ref").alias("transaction_ids"), F.lit(None).cast("string").alias("narrative"), F.lit(None).cast(S.LINEAGE).alias("source_lineage"))
    none = active().createDataFrame([], S.struct_of("entities")).select(*S.struct_of("entities").names)
    return merge.merge(active(), [S.Dataset({**own, "entities": none}, "tables")])


_ISSUES = "ri as (select record_id, ref, case when max(i.id) is null then 'dangling' else 'incompatible' end as issue from refs left join ids i on i.id = upper(ref) group by record_id, ref having count(*) filter (where type in ('evidence', 'transaction')) = 0), iss as (select issue, count(*) as n from ri group by 1 union all select 'missing_transaction', count(*) from refs where upper(ref) not in (select id from ids where type = 'transaction'))"


@query("select issue, n, 'NOT_READY_FOR_DEPLOYMENT' as decision from iss where n > 0", _ISSUES)
def integrity_summary(V):
    """DOM-04, DOM-12: the case's issues by kind, and what they make of a decision that would pass."""
    issues = merge.validate(active(), _case(V)).groupBy("issue").agg(F.count("*").alias("n"))
    return issues.withColumn("decision", assurance.case_gate(F.lit("PASS"), F.lit(True), F.col("n"), F.lit(0)))


_RUNS = _STATUS + _DECIDE
GAPS = ("gap a", "Quality")


def _documents(V) -> DataFrame:
    """A profile for each run, written and read again."""
    path = f"{_place('profiles')}.jsonl"
    runs = V("runs").select("run_id", F.concat(F.lit("agent-"), F.col("n") % 3).alias("agent"), F.when(F.col("n") % 2 == 0, "m1").alias("model"), F.concat(F.lit("task"), F.col("n") % 3).alias("task"), F.lit(0).alias("tests"), F.lit(None).cast("int").alias("judge"), F.col("q").alias("precision"), F.lit(None).cast("double").alias("recall"))
    meta = {k: "x" for k in ("generated_at_utc", "benchmark", "jurisdiction_profile", "started_at_utc", "completed_at_utc")}
    made = profiles.profiles(runs, _status(V), list(GAPS), {"id": "p1", "name": "p", "version": "1", "path": "p.json"}, {**meta, "benchmark_version": "1.0"})
    documents.write_documents(made, path)
    return documents.read_profiles(active(), [path])


_GAPPED = ", dg as (select run_id, case when evaluated = 0 or required_failed > 0 then 'NOT_READY_FOR_DEPLOYMENT' else 'PASS_WITH_CONDITIONS' end as decision from dc)"


@query("select r.run_id, concat('agent-', n % 3) as agent, case when n % 2 = 0 then 'm1' else '?' end as model, concat('task', n % 3) as task, 'p1 v1' as policy, 'n/a' as task_performance, 'n/a' as eghr, printf('%.1f%%', q * 100) as precision, 'n/a' as recall, 'n/a' as trace_f1, 'n/a' as fabricated, decision from runs r join dg using (run_id)", _RUNS + _GAPPED)
def compare_rows(V):
    """SRC-19, SNK-09, MSC-03."""
    return profiles.compare_rows(_documents(V))


@query("select 'all' as scope, label as dimension from st where status = 'NOT_EVALUATED' union select 'all', 'gap a' union select 'all', 'Quality' union select 'run1', label from st where run_id = 'run1' and status = 'NOT_EVALUATED' union select 'run1', x from (values ('gap a'), ('Quality')) as v(x) where exists (select 1 from runs where run_id = 'run1')", _RUNS)
def excluded_dimensions(V):
    """MSC-04, SET-02: over all runs, and of the baseline only."""
    docs = _documents(V)
    both = profiles.excluded_dimensions(docs).withColumn("scope", F.lit("all")).unionByName(profiles.excluded_dimensions(docs, "run1").withColumn("scope", F.lit("run1")))
    return both.select("scope", "dimension")


@query("select run_id, count(*) as metrics, count(*) filter (where status = 'FAIL') as reasons, true as sound from st group by 1", _RUNS)
def profile_documents(V):
    """SNK-09, DOM-17, DOM-21: each run's profile has its hash and breaks no rule."""
    docs = _documents(V)
    path = f"{_place('profiles')}.jsonl"
    documents.write_documents(docs, path)
    text = active().read.text(path).select(F.col("value"), F.get_json_object("value", "$.provenance.run_id").alias("run_id"))
    bad = profiles.invalid_documents(text, "value", "run_id")
    return docs.select(F.col("provenance.run_id").alias("run_id"), F.size("metrics").cast("long").alias("metrics"), F.size("deployment_decision.reasons").cast("long").alias("reasons"), F.col("result_hash").startswith("sha256:").alias("ok")).join(bad, "run_id", "left").select("run_id", "metrics", "reasons", (F.col("ok") & F.col("violations").isNull()).alias("sound"))


@query("select c.run_id, metric from st c left join (select metric, status from st where run_id = 'run1') b using (metric) where c.status = 'FAIL' and b.status is distinct from 'FAIL' and c.run_id <> 'run1'", _RUNS)
def newly_failed(V):
    """DOM-15: thresholds that a run fails and run1 doesn't, from the profiles; SNK-10's parts for all runs."""
    rows = profiles.metric_rows(_documents(V))
    first = rows.filter("run_id = 'run1'").select("metric", F.col("status").alias("b_status"))  # the policy's few rows
    return rows.filter("run_id <> 'run1' and status = 'FAIL'").join(first, "metric", "left").filter(~F.col("b_status").eqNullSafe("FAIL")).select("run_id", "metric")


@query("select r.run_id, case when required_failed = 0 then printf('xUnit PASS (%d/%d)', n, n) else printf('xUnit FAIL (%d assertion(s))', required_failed) end || case when n % 5 <> 0 then printf('; judge %s at %.1f%%', case when q >= 0.8 then 'PASS' else 'FAIL' end, q * 100) else '' end as overall_reason, case when required_failed = 0 and (n % 5 = 0 or q >= 0.8) then 'PASS' else 'FAIL' end as overall_verdict from runs r join dc using (run_id)", _RUNS)
def run_results(V):
    """SNK-08, MSC-06, MSC-07, DOM-22: a result document a run, archived, and read as one table."""
    rows = V("runs").join(assurance.decide(_status(V)), "run_id")
    tests = F.when(F.col("required_failed") == 0, "PASS").otherwise("FAIL")
    judge = F.when(F.col("n") % 5 != 0, F.when(F.col("q") >= 0.8, "PASS").otherwise("FAIL"))
    code = lambda x: F.when(x.isNotNull(), F.when(x == "PASS", 0).otherwise(1))
    path = f"{_place('results')}.jsonl"
    documents.write_documents(rows.select(F.lit("1.0").alias("schema_version"), "run_id", assurance.overall_verdict(code(tests), code(judge)).alias("overall_verdict"), profiles.verdict_reason(tests, F.col("n"), F.col("n"), F.col("required_failed"), judge, F.col("q")).alias("overall_reason")), path)
    return active().read.schema("run_id string, overall_verdict string, overall_reason string").json(path)


@query("select e.report_id, eghr_rate, cast(unsupported as double) as fabricated, cast(claims as bigint) as n_claims, 'PASS' as verdict from (select report_id, count(*) as claims, count(*) filter (where scored = 'unsupported') as unsupported, round_even(count(*) filter (where scored <> 'supported') / count(*), 4) as eghr_rate from sc group by 1) e", _CLAIMS)
def judge_reports(V):
    """SNK-11, DOM-18, MSC-01: claims as JSON, scored; a judge's document a report, and its metrics read from it."""
    claim = F.struct(F.lit("x").alias("text"), F.array("cited").alias("cited_txn_ids"), "support")
    raw = V("claims").select("report_id", "claim_id", F.to_json(F.array(claim)).alias("claims"))
    parsed = raw.select("report_id", "claim_id", F.explode(documents.parse_claims()).alias("c")).select("report_id", "claim_id", "c.support", "c.cited_ids")
    rate = evidence.hallucination_rate(evidence.score_claims(parsed, V("valid_ids")))
    judge = F.struct(F.lit("PASS").alias("verdict"), F.struct(F.col("claims").alias("total_claims"), F.col("eghr_rate").alias("rate")).alias("eghr"), F.struct(F.array_repeat(F.lit("T"), F.col("unsupported").cast("int")).alias("fabricated_citations")).alias("evidence_traceability"))
    path = f"{_place('judge')}.jsonl"
    documents.write_documents(rate.select("report_id", F.to_json(judge).alias("judge")), path)
    got = active().read.schema("report_id long, judge string").json(path)
    m = documents.judge_metrics(F.col("judge"))
    return got.select("report_id", m["eghr_rate"].alias("eghr_rate"), m["fabricated_citation_count"].alias("fabricated"), F.get_json_object("judge", "$.eghr.total_claims").cast("long").alias("n_claims"), F.get_json_object("judge", "$.verdict").alias("verdict"))


@query("select concat('n', n_nationkey, '.md') as name, cast(length(n_name) * 900 + 8 as bigint) as size_bytes, case when length(n_name) * 900 + 8 <= 4000 then repeat(n_name, 900) || ' T1-001 ' else left(repeat(n_name, 900), 4000) || chr(10) || '...[truncated]' end as preview, 1 as citation_count, null as cells from nation union all select concat('n', n_nationkey, '.csv'), cast(length(n_name) + length(cast(n_nationkey as varchar)) + 6 as bigint), null, null, concat('{\"a\":\"', n_name, '\",\"b\":\"', n_nationkey, '\"}') from nation")
def agent_outputs(V):
    """SRC-15, FLT-05, MSC-08, SCL-18: a folder of files; a brief is left out, cells stay text."""
    V("txn")
    path, t = _place("outputs"), active().table("nation")
    md = t.select(F.concat(F.lit("n"), "n_nationkey", F.lit(".md")).alias("name"), F.concat(F.repeat("n_name", F.lit(900)), F.lit(" T1-001 ")).alias("text"))
    csv = t.select(F.concat(F.lit("n"), "n_nationkey", F.lit(".csv")).alias("name"), F.concat(F.lit("a,b\n"), "n_name", F.lit(","), "n_nationkey", F.lit("\n")).alias("text"))
    brief = active().createDataFrame([("Prompt.md", "x")], "name string, text string")
    documents.write_files(md.unionByName(csv).unionByName(brief), path)
    got = documents.collect_outputs(active(), path)
    return got.select("name", "size_bytes", F.col("content_preview").alias("preview"), "citation_count", F.to_json(F.get("rows", F.lit(0))).alias("cells"))


@query("select n_nationkey as id, concat('{\"operational_capabilities\":[\"', n_name, '\"]}') as doc, case when n_nationkey % 2 = 0 then n_name else '' end as tags, concat(cast(n_nationkey as varchar), '.0%') as share, concat('+', n_nationkey, '.0 pp') as points, concat(left(repeat(n_name, 3), 9), '...') as short, concat('KEY=***REDACTED*** ', n_name) as hidden, concat(n_name, '=', n_nationkey) as pair, 'a/b' as listed, case when n_nationkey % 10 = 0 then concat(n_nationkey, '') else concat(n_nationkey, '.5') end as four from nation")
def scalar_formats(V):
    """SCL-10, SCL-11, SCL-17, SCL-20, SCL-21, MSC-09, and the number format of SNK-07."""
    V("txn")
    k, name = F.col("n_nationkey"), F.col("n_name")
    doc = F.concat(F.lit('{"operational_capabilities":["'), name, F.lit('"]}'))
    odd = F.when(k % 2 == 0, doc).otherwise(F.lit("{}"))
    four = F.when(k % 10 == 0, k.cast("double")).otherwise(k + 0.5)
    return active().table("nation").select(
        k.alias("id"), doc.alias("doc"), F.array_join(profiles.capability_tags(odd), "/").alias("tags"), N.percent(k / 100).alias("share"), N.points(k / 100).alias("points"), N.truncate(F.repeat(name, F.lit(3)), 12).alias("short"), N.redact(F.concat(F.lit("KEY=abc "), name), ["KEY"]).alias("hidden"),
        F.concat_ws("=", F.map_keys(N.key_values(F.concat(name, F.lit("="), k)))[0], F.map_values(N.key_values(F.concat(name, F.lit("="), k)))[0]).alias("pair"), F.array_join(N.comma_list(F.lit(" a, ,b")), "/").alias("listed"), N.up_to_four(four).alias("four"))


@query("select 'sha256:' || sha256(concat_ws('|', concat('task', n % 3), case when n % 2 = 0 then 'm1' else '' end, '12', 'local', 'p1', '1')) as config_hash, run_id from runs")
def config_hashes(V):
    """DOM-21: how each run was configured."""
    return V("runs").select(profiles.run_hash(F.concat(F.lit("task"), F.col("n") % 3), F.when(F.col("n") % 2 == 0, "m1"), F.lit(12), F.lit("local"), F.lit("p1"), F.lit("1")).alias("config_hash"), "run_id")
