"""Exports and manifests.  Everything but a manifest's few lines is written by the executors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argusledger.functions.normalise import iso_o, up_to_four
from argusledger.functions.tables import cut, drop_cut, partitions
from argusledger.sources import schema as S
from argusledger.sources.readers import ADAPTER_VERSION

LISTS = ("accounts", "customers", "cases", "alerts", "evidence", "jurisdictions", "sars")


def write_parquet(transactions: DataFrame, path: str) -> None:
    transactions.drop("source_lineage").write.mode("overwrite").parquet(path)


def write_csv(transactions: DataFrame, path: str, quoted: bool = True) -> None:
    """Ordered by id; id column ``txn_id``; ISO timestamps; quoted where a field needs it, or (``quoted=False``) never."""
    rows = transactions.select(F.col("transaction_id").alias("txn_id"), "source_account", "destination_account", "amount", "currency", iso_o(F.col("timestamp")).alias("timestamp"), "channel", "jurisdiction", F.lower(F.col("sar_linked").cast("string")).alias("sar_linked"))
    if quoted:
        rows.orderBy("txn_id").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns])
        rows.orderBy("txn_id").select(line.alias(",".join(rows.columns))).write.mode("overwrite").option("header", True).option("quote", "").option("sep", "\u0001").csv(path)


def write_jsonl(df: DataFrame, key: str, path: str) -> None:
    df.orderBy(key).write.mode("overwrite").json(path)


def write_clusters(clusters: DataFrame, path: str) -> None:
    """By risk; numbers with at most four decimal places."""
    rows = clusters.orderBy(F.desc("risk_score"), "cluster_id").select("cluster_id", "account_count", *[up_to_four(F.col(c)).alias(n) for c, n in (("total_value", "total_value"), ("circular_flow", "circular_flow_score"), ("risk_score", "risk_score"))])
    rows.write.mode("overwrite").option("header", True).csv(path)


def export_case(spark: SparkSession, case: S.Case, root: str) -> list[str]:
    """Every collection that has rows, and the case manifest; returns what was written."""
    done = []
    for name, df in case.collections.items():
        if df.limit(1).count():
            if name == "transactions":
                write_csv(df, f"{root}/transactions.csv")
            elif name in LISTS:
                write_collection(df.drop("source_lineage"), S.COLLECTIONS[name][2], f"{root}/{name}")
            done.append(name)
    graph = {n: case.collections[n].drop("source_lineage") for n in ("entities", "relationships") if n in done}
    if graph:
        write_graph(spark, graph, f"{root}/relationships")
    write_text(spark, json.dumps(case_manifest(spark, case), indent=2, sort_keys=True), f"{root}/case_manifest.json")
    return done


def _write_document(sections: list[tuple[str, DataFrame, str, str]], path: str) -> None:
    """One JSON document of any size: sections (opening line, rows, key, closing line), an object a line, ordered by key.

    The rows are sorted over all executors; each writes its part of the lines, and the parts, in the order of their names, are the
    document.  They appear together when Spark commits the write.  Every row but a section's last ends in a comma.
    """
    made, parts = [], []
    for at, (before, df, key, after) in enumerate(sections):
        spark = df.sparkSession
        rows = cut(df.select(F.col(key).cast("string").alias("k"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"), F.monotonically_increasing_id().alias("u")))
        made.append(rows)
        last = rows.agg(F.max(F.struct("k", "j", "u")).alias("last"))  # one row
        line = F.when(F.struct("k", "j", "u") == F.col("last"), F.col("j")).otherwise(F.concat("j", F.lit(",")))
        parts.append(rows.crossJoin(F.broadcast(last)).select(F.lit(3 * at + 1).alias("at"), "k", "j", "u", line.alias("value")))
        parts.append(spark.createDataFrame([(3 * at, before), (3 * at + 2, after)], "at int, value string").select("at", F.lit(None).cast("string").alias("k"), F.lit(None).cast("string").alias("j"), F.lit(None).cast("long").alias("u"), "value"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    out.orderBy("at", "k", "j", "u").select("value").write.mode("overwrite").text(path)
    for rows in made:
        drop_cut(rows)


def write_collection(df: DataFrame, key: str, path: str) -> None:
    """``path``.json: one array ordered by ``key``, an object a line."""
    _write_document([("[", df, key, "]")], f"{path}.json")


def write_graph(spark: SparkSession, graph: dict[str, DataFrame], path: str) -> None:
    """``path``.json: an object with the arrays ``entities`` and ``relationships``, those that are given."""
    names = sorted(graph)
    head, foot = lambda i: "{" * (i == 0) + f'"{names[i]}":[', lambda i: "]" + ("}" if i == len(names) - 1 else ",")
    _write_document([(head(i), graph[n], S.COLLECTIONS[n][2], foot(i)) for i, n in enumerate(names)], f"{path}.json")


def write_parts(lines: DataFrame, n: int, path: str) -> None:
    """(part, at, value): a folder with a file for each part, its lines by ``at``."""
    lines.repartition(n, "part").sortWithinPartitions("part", "at").drop("at").write.mode("overwrite").partitionBy("part").text(path)


def write_graphml(elements: DataFrame, path: str, documents: int | None = None, head: str = "<graphml><graph>", foot: str = "</graph></graphml>") -> None:
    """Nodes and edges (``value``, as XML) dealt over GraphML documents of their own in the folder ``path``."""
    spark = elements.sparkSession
    n = documents or partitions(spark)
    body = elements.select(F.pmod(F.hash("value"), F.lit(n)).alias("part"), F.lit(1).alias("at"), "value")
    ends = spark.range(n).select(F.col("id").cast("int").alias("part"), F.explode(F.array(F.struct(F.lit(0).alias("at"), F.lit(head).alias("value")), F.struct(F.lit(2).alias("at"), F.lit(foot).alias("value")))).alias("x")).select("part", "x.*")
    write_parts(body.unionByName(ends), n, path)


def table_text(title: str, header: list[str], rows: list[list[str]]) -> str:
    """A table for a console; its cells are text."""
    wide = [max(len(r[i]) for r in [header, *rows]) for i in range(len(header))]
    line = lambda r: " | ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)).rstrip()
    return "\n".join([f"== {title} ==", line(header), "-+-".join("-" * w for w in wide), *map(line, rows)])


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def record_counts(collections: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.lit(n).alias("collection"), F.count("*").alias("records")) for n, df in collections.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dataset_manifest(spark: SparkSession, data: S.Dataset, path: str | None = None, at: str = "") -> dict:
    """What one source gave; ``path`` names the file or folder that its raw hash is of, a live source has none.  ``at``: ISO time."""
    from argusledger.operators.merge import content_hash
    from argusledger.operators.digests import dataset_hash

    raw = dataset_hash(spark, path) if path else None
    own = {r.collection: r.records for r in record_counts(data.collections).collect()} if data.collections else {}
    counts = {n: own.get(n, 0) for n in S.COLLECTIONS}
    return {
        "dataset_id": f"{data.source_type}-{at}", "source_type": data.source_type, "source_name": (path or data.name).rstrip("/").rsplit("/", 1)[-1], "adapter": f"{data.source_type}-adapter", "adapter_version": ADAPTER_VERSION,
        "schema_version": data.schema_version, "record_count": sum(counts.values()), "record_counts_by_type": counts, "snapshot_timestamp": at, "dataset_hash": raw, "normalisation_hash": content_hash(spark, data),
        "snapshot_limitation": None if raw else "a live source: what it held before normalisation was not kept, so only the canonical rows can be checked",
    }


def case_manifest(spark: SparkSession, case: S.Case) -> dict:
    from argusledger.operators.merge import content_hash, validate

    issues = {r.issue: r["count"] for r in validate(spark, case).groupBy("issue").count().collect()}
    return {"schema_version": case.schema_version, "case_hash": content_hash(spark, case), "counts": {r.collection: r.records for r in record_counts(case.collections).collect()}, "conflicts": case.conflicts.count(),
            "sources": [r.asDict() for r in case.source_manifest.orderBy("source_index").collect()], "failures": [list(x) for x in case.failures], "evidence_integrity": {"status": "failed" if issues else "passed", "issues": issues}}
