"""Cluster risk over a transfer ledger, and weekly summaries of it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argusledger.functions.normalise import HIGH_RISK_DESTINATIONS, clamp01, round4
from argusledger.functions.tables import cut, drop_cut, partitions, skew_join, small
from argusledger.operators.assurance import union
from argusledger.operators.graph import connected_components

# Fixed values.
RISK_WEIGHTS = {"total_value": 0.35, "circular_flow": 0.25, "account_count": 0.15, "velocity": 0.15, "sar_ratio": 0.10}
RISK_THRESHOLD = 0.65
#: Edges of a weak component that one task settles; larger ones are coloured round by round over all executors.
TASK_EDGES = 500_000


def edge_weights(transfers: DataFrame) -> DataFrame:
    return transfers.groupBy("src", "dst").agg(F.sum(F.col("amount").cast("decimal(18,2)")).alias("weight"), F.count("*").alias("n"))


def graph_nodes(transfers: DataFrame) -> DataFrame:
    return transfers.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def weak_components(edges: DataFrame) -> DataFrame:
    return connected_components(edges)


def _strong(key, table):
    """Strong components of one weak component's edges: two depth-first passes without recursion."""
    src, dst = table.column("src").to_pylist(), table.column("dst").to_pylist()
    out, back = {}, {}
    for a, b in zip(src, dst, strict=True):
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
        out.setdefault(b, [])
        back.setdefault(a, [])
    order, seen = [], set()
    for root in sorted(out):
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(out[root]))]
        while stack:
            node, rest = stack[-1]
            step = next((x for x in rest if x not in seen), None)
            if step is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(step)
                stack.append((step, iter(out[step])))
    label: dict[str, str] = {}
    for root in reversed(order):
        if root in label:
            continue
        group, todo = [root], [root]
        label[root] = root
        while todo:
            for x in back[todo.pop()]:
                if x not in label:
                    label[x] = root
                    group.append(x)
                    todo.append(x)
        name = min(group)
        label.update(dict.fromkeys(group, name))
    return pa.table({"node": pa.array(list(label), pa.string()), "scc": pa.array(list(label.values()), pa.string())})


def _spread(edges: DataFrame, start: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(node, colour): the largest colour that reaches each node along the edges."""
    now = cut(start)
    for _ in range(rounds):
        came = edges.join(now, edges.src == now.node).select(F.col("dst").alias("node"), "colour")
        after = cut(now.unionByName(came).groupBy("node").agg(F.max("colour").alias("colour")))
        changed = after.alias("a").join(now.alias("b"), "node").filter("a.colour <> b.colour").limit(1).count()
        drop_cut(now)
        now = after
        if not changed:
            return now
    raise RuntimeError("no fixed point")


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return cut(edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))


def _trim(left: DataFrame, nodes: DataFrame, share: int = 16) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Edges and nodes that can lie on cycles, and tables (node, scc) of those that can't: a node that no other one's edge
    enters, or none leaves for another one, is a strong component of its own.  Rounds go on while each takes more than a
    ``share``-th of the nodes, so they are few."""
    alone = []
    while True:
        plain = left.filter("src <> dst")
        inner = cut(plain.select(F.col("src").alias("node")).intersect(plain.select(F.col("dst").alias("node"))))
        outer = cut(nodes.join(inner, "node", "left_anti"))
        before, gone = nodes.count(), outer.count()
        if gone:
            alone.append(outer.select("node", F.col("node").alias("scc")))
            kept = _within(left, inner)
            drop_cut(left)
            left = kept
        drop_cut(nodes)
        nodes = inner
        if gone * share <= before:
            return left, nodes, alone


def _contract(left: DataFrame, nodes: DataFrame, share: int = 8, enough: int = 0) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """A smaller graph with the same strong components, and what :func:`_expand` needs to undo each round.

    A node that a single other one's edges enter lies on a cycle only together with that one, so it goes into it with its edges.  In a round
    those go whose hash is smaller than that of such neighbours before and after them: none of them goes into another, and of a
    long chain or cycle about a third go.  Rounds end when fewer than a ``share``-th of the nodes go, or ``enough`` edges are left.
    """
    steps = []
    while left.count() > enough:
        before = nodes.count()
        plain = left.filter("src <> dst")
        entered = plain.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("pred")).filter("n = 1")
        only = cut(entered.select(F.col("dst").alias("node"), "pred", F.xxhash64("dst", F.lit(len(steps))).alias("h")))
        ahead = only.select(F.col("node").alias("pred"), F.col("h").alias("h1"))
        after = only.groupBy(F.col("pred").alias("node")).agg(F.min("h").alias("h2"))
        chosen = cut(only.join(ahead, "pred", "left").join(after, "node", "left").filter("(h1 is null or h < h1) and (h2 is null or h < h2)").select("node", "pred"))
        gone = chosen.count()
        drop_cut(only)
        if gone * share < before or not gone:
            drop_cut(chosen)
            break
        steps.append(cut(chosen.join(plain.select(F.col("src").alias("node"), F.col("dst").alias("to")), "node", "left")))
        moved = left.join(chosen.select(F.col("node").alias("dst")), "dst", "left_anti").join(chosen.withColumnRenamed("node", "src"), "src", "left")
        now, rest = cut(moved.select(F.coalesce("pred", "src").alias("src"), "dst").distinct()), cut(nodes.join(chosen, "node", "left_anti"))
        for table in (left, nodes, chosen):
            drop_cut(table)
        left, nodes = now, rest
    return left, nodes, steps


def _expand(labels: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """(node, scc) of all nodes: one that went into ``pred`` is of its component if any of its edges leads there, else alone."""
    for step in reversed(steps):
        to, pred = (labels.select(F.col("node").alias(c), F.col("scc").alias(f"{c}_scc")) for c in ("to", "pred"))
        inside = step.join(to, "to", "left").join(pred, "pred").groupBy("node").agg(F.max(F.coalesce(F.col("to_scc") == F.col("pred_scc"), F.lit(False))).alias("inside"), F.first("pred_scc").alias("scc"))
        now = cut(labels.unionByName(inside.select("node", F.when(F.col("inside"), F.col("scc")).otherwise(F.col("node")).alias("scc"))))
        drop_cut(labels)
        drop_cut(step)
        labels = now
    names = labels.groupBy("scc").agg(F.min("node").alias("name"))
    return labels.join(small(names), "scc").select("node", F.col("name").alias("scc"))


def strong_by_colouring(edges: DataFrame, task_edges: int = 0) -> DataFrame:
    """(node, scc) over all executors: chains and cycles are contracted; what lies on no cycle is trimmed; colours spread forward; what
    reaches back to a colour's root within it is one strong component; the rest goes on.  A rest of ``task_edges`` edges is one task's."""
    left = cut(edges.select("src", "dst").distinct())
    left, nodes, steps = _contract(left, cut(graph_nodes(left)), enough=task_edges)
    done = []
    while True:
        left, nodes, alone = _trim(left, nodes)
        done += alone
        if not nodes.limit(1).count():
            break
        if left.count() <= task_edges:
            done.append(left.withColumn("g", F.lit(True)).groupBy("g").applyInArrow(_strong, "node string, scc string"))
            break
        colour = _spread(left, nodes.select("node", F.col("node").alias("colour")))
        same = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").filter("c1 = c2")
        turned = cut(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        roots = colour.select("node", F.when(F.col("node") == F.col("colour"), F.lit(1)).otherwise(F.lit(0)).alias("colour"))
        reach = _spread(turned, roots)
        found = reach.filter("colour = 1").select("node").join(colour, "node").select("node", "colour")
        names = found.groupBy("colour").agg(F.min("node").alias("scc"))
        found = cut(found.join(names, "colour").select("node", "scc"))
        done.append(found)
        rest = cut(nodes.join(found, "node", "left_anti"))
        kept = _within(left, rest)
        for table in (colour, turned, reach, left, nodes):
            drop_cut(table)
        left, nodes = kept, rest
    found = union(done) if done else edges.sparkSession.createDataFrame([], "node string, scc string")
    return _expand(cut(found), steps) if steps else found


def strong_components(edges: DataFrame, weak: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, scc), scc the smallest member.  Weak components are independent: each of bounded size is one group; what is
    larger is coloured."""
    pairs = edges.select("src", "dst").distinct().join(weak.withColumnRenamed("node", "src"), "src")
    large = cut(pairs.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > task_edges).select("component"))
    fine = pairs.join(small(large), "component", "left_anti").groupBy("component").applyInArrow(_strong, "node string, scc string")
    if not large.limit(1).count():
        return fine
    return fine.unionByName(strong_by_colouring(pairs.join(small(large), "component", "left_semi"), task_edges))


def min_max(x: str) -> Column:
    """Over all rows, which are few (weeks); all equal: 0."""
    w = Window.partitionBy()
    return _scaled(x, F.min(x).over(w), F.max(x).over(w))


def _scaled(x: str, low: Column, high: Column) -> Column:
    return F.when(low == high, F.lit(0.0)).otherwise((F.col(x) - low) / (high - low))


def with_min_max(rows: DataFrame, **scaled: str) -> DataFrame:
    """``rows`` (a table) with each new column the min-max of another, over any number of rows: the bounds are one row."""
    bounds = rows.agg(*[f(c).alias(f"_{k}_{n}") for n, c in scaled.items() for k, f in (("low", F.min), ("high", F.max))])
    both = rows.crossJoin(F.broadcast(bounds))
    return both.withColumns({n: _scaled(c, F.col(f"_low_{n}"), F.col(f"_high_{n}")) for n, c in scaled.items()}).drop(*bounds.columns)


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with their place in ascending order of the unique ``key``, from 1, as text after ``name``; no task sees all rows."""
    spark = rows.sparkSession
    dealt = cut(rows.repartitionByRange(partitions(spark), key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r.p, r["count"]) for r in dealt.groupBy(part.alias("p")).count().collect())  # one row a partition
    before = spark.createDataFrame([(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)], "_p long, _before long")
    return dealt.join(small(before), part == F.col("_p")).withColumn("cluster_id", F.concat(F.lit(name), at + F.col("_before") + 1)).drop("_at", "_p", "_before")


def circular_flow(edges: DataFrame, weak: DataFrame, strong: DataFrame) -> DataFrame:
    """(component, edge_count, cycle_edges, circular_flow): distinct non-self edges inside a strong component of two or
    more over all distinct edges."""
    size = strong.groupBy("scc").agg(F.count("*").alias("size"))
    ends = strong.join(size, "scc")
    side = lambda k: ends.select(F.col("node").alias(k), F.col("scc").alias(f"{k}_scc"), F.col("size").alias(f"{k}_size"))
    pairs = edges.select("src", "dst").distinct().join(weak.withColumnRenamed("node", "src"), "src").join(side("src"), "src").join(side("dst"), "dst")
    inside = (F.col("src_scc") == F.col("dst_scc")) & (F.col("src_size") >= 2) & (F.col("src") != F.col("dst"))
    out = pairs.groupBy("component").agg(F.count("*").alias("edge_count"), F.count_if(inside).alias("cycle_edges"))
    return out.withColumn("circular_flow", F.col("cycle_edges") / F.greatest("edge_count", F.lit(1)))


def cluster_metrics(transfers: DataFrame) -> DataFrame:
    """One row per weak component: accounts, value, circular flow, SAR ratio, velocity, and its number by smallest member."""
    edges = cut(transfers.select("src", "dst").distinct())
    weak = cut(weak_components(edges))
    strong = cut(strong_components(edges, weak))
    rows = transfers.join(weak.withColumnRenamed("node", "src"), "src").groupBy("component").agg(
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total_value"), F.avg(F.col("sar").cast("int")).alias("sar_ratio"), F.count("*").alias("transfers"),
        (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("span"))
    velocity = F.col("transfers") / F.greatest(F.col("span") / 3600.0, F.lit(0.01))
    out = rows.join(weak.groupBy("component").agg(F.count("*").alias("account_count")), "component").join(circular_flow(edges, weak, strong), "component")
    return numbered(out.withColumn("velocity", velocity), "component", "cluster_").select("cluster_id", "component", "account_count", "total_value", "circular_flow", "sar_ratio", "transfers", "velocity")


def cluster_risk(transfers: DataFrame, threshold: float = RISK_THRESHOLD) -> DataFrame:
    """Clusters at or above the threshold (before rounding), by rounded risk."""
    m = cluster_metrics(transfers).withColumns({"circular": clamp01(F.col("circular_flow")), "sar": clamp01(F.col("sar_ratio"))})
    m = with_min_max(m, value_share="total_value", account_share="account_count", velocity_share="velocity")
    share = {"total_value": F.col("value_share"), "circular_flow": F.col("circular"), "account_count": F.col("account_share"), "velocity": F.col("velocity_share"), "sar_ratio": F.col("sar")}
    raw = sum((F.lit(w) * share[k] for k, w in RISK_WEIGHTS.items()), F.lit(0.0))
    m = with_min_max(cut(m.withColumn("raw", raw)), risk="raw").filter(F.col("risk") >= threshold)
    out = m.select("cluster_id", "account_count", round4(F.col("total_value")).alias("total_value"), round4(F.col("circular_flow")).alias("circular_flow"), round4(F.col("risk")).alias("risk_score"))
    return out.orderBy(F.desc("risk_score"), "cluster_id")


# --- weekly ----------------------------------------------------------------------------------


def weekly_summary(transfers: DataFrame) -> DataFrame:
    """Per ISO week of (src, dst, amount, ts, dest_country, sar): counts, value, first-seen accounts, anomaly score."""
    rows = transfers.withColumn("start_date", F.to_date(F.date_trunc("week", "ts")))
    seen = rows.select("start_date", F.explode(F.array("src", "dst")).alias("account")).filter("account is not null")
    accounts = seen.groupBy("start_date").agg(F.countDistinct("account").alias("unique_accounts"))
    fresh = seen.groupBy("account").agg(F.min("start_date").alias("start_date")).groupBy("start_date").agg(F.count("*").alias("new_accounts_count"))
    sums = rows.groupBy("start_date").agg(F.count("*").alias("transfer_count"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total_value"),
                                          F.count_if(F.col("dest_country").isin(*HIGH_RISK_DESTINATIONS)).alias("high_risk_dest_count"), F.count_if("sar").alias("sar_count"))
    out = sums.join(accounts, "start_date", "left").join(fresh, "start_date", "left").na.fill(0, ["unique_accounts", "new_accounts_count"])
    out = out.withColumn("raw", (F.col("new_accounts_count") + F.col("high_risk_dest_count") + F.col("sar_count")).cast("double"))
    week = F.concat(F.lit("week_"), F.row_number().over(Window.partitionBy().orderBy("start_date")))
    return out.select(week.alias("week"), "start_date", F.date_add("start_date", 6).alias("end_date"), "transfer_count", "unique_accounts", "total_value", "new_accounts_count", "high_risk_dest_count", "sar_count", round4(min_max("raw")).alias("anomaly_score"))


def _sides(transfers: DataFrame) -> DataFrame:
    """Each transfer as its sender's and as its receiver's row."""
    money, nothing = F.col("amount").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")
    return transfers.select(F.col("src").alias("account_id"), "txn_id", money.alias("sent"), nothing.alias("got"), "sar").unionByName(
        transfers.select(F.col("dst").alias("account_id"), "txn_id", nothing.alias("sent"), money.alias("got"), "sar"))


def _judged(accounts: DataFrame, *more: Column) -> DataFrame:
    """Classification and confidence by our rules; the task fixes the schema only."""
    through = F.least("sent", "got") / F.greatest("sent", "got")
    kind = F.when((F.col("n_in") >= 1) & (F.col("n_out") >= 1) & (through >= 0.8) & F.col("sar"), "mule").when((F.col("n_in") >= 3) & (F.col("n_out") <= 1), "collector").when((F.col("n_out") >= 3) & (F.col("n_in") <= 1), "distributor").when(F.col("sar"), "suspicious").otherwise("legitimate")
    sure = F.when(kind == "mule", through).when(kind == "legitimate", F.lit(0.5)).otherwise(F.lit(0.7))
    return accounts.select("account_id", kind.alias("classification"), round4(sure).alias("confidence"), *more)


def _sums() -> list[Column]:
    return [F.sum("sent").cast("double").alias("sent"), F.sum("got").cast("double").alias("got"), F.count_if(F.col("sent") > 0).alias("n_out"), F.count_if(F.col("got") > 0).alias("n_in"), F.max("sar").alias("sar")]


def mule_accounts(transfers: DataFrame) -> DataFrame:
    """Per account: classification and confidence.  Sums are made before the shuffle, so a hot account is a row a task."""
    return _judged(_sides(transfers).groupBy("account_id").agg(*_sums()))


def mule_support(transfers: DataFrame) -> DataFrame:
    """(account_id, classification, confidence, txn_id): a row for each account and supporting transfer, each once.

    Accounts with over a thousandth of the rows are joined by broadcast: no task gets all rows of one.
    """
    rows = _sides(transfers).select("account_id", "txn_id").distinct()
    found = cut(_judged(_sides(transfers).groupBy("account_id").agg(*_sums(), F.count("*").alias("n")), F.col("n")))
    return skew_join(rows, found, "account_id", "n").select("account_id", "classification", "confidence", "txn_id")


def mule_findings(transfers: DataFrame) -> DataFrame:
    """As :func:`mule_accounts`, with an account's supporting ids joined in its row: for accounts of a bounded number of transfers."""
    return _judged(_sides(transfers).groupBy("account_id").agg(*_sums(), F.sort_array(F.collect_set("txn_id")).alias("ids")), F.array_join("ids", ";").alias("supporting_txn_ids"))
