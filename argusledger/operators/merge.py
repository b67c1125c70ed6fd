"""Merging sources to one case, integrity of its evidence, and content hashes."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from argusledger.functions.normalise import escape_field
from argusledger.sources import schema as S

CONFLICT = "record_type string, record_id string, conflict_type string, description string"


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``_first``, the first-seen row of the same id (without case), and ``_n``, the place among them.

    One window, no join: a shuffle on the id.
    """
    w = Window.partitionBy(F.upper(key)).orderBy(*order)
    body = F.struct(*[c for c in rows.columns if c not in order])
    return rows.withColumn("_n", F.row_number().over(w)).withColumn("_first", F.first(body).over(w))


def conflict_type(collection: str, first: str = "_first") -> Column:
    """Null where the later record says the same as the first one."""
    fields = [c for c in S.struct_of(collection).names if c not in (S.COLLECTIONS[collection][2], "source_lineage")]
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{first}.{c}")) for c in fields])
    kind = F.when(same, F.lit(None))
    if collection == "transactions":
        for c, name in (("timestamp", "timestamp_mismatch"), ("currency", "currency_mismatch")):
            kind = kind.when(~F.col(c).eqNullSafe(F.col(f"{first}.{c}")), name)
    return kind.otherwise("conflicting_value")


def merge_collection(rows: DataFrame, collection: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Kept rows and conflicts of the rows of all sources; ``order`` are the columns of source and row order."""
    kind, _, key, _ = S.COLLECTIONS[collection]
    seen = first_seen(rows, key, order)
    kept = seen.filter("_n = 1").drop("_n", "_first", *order)
    later = seen.filter("_n > 1").withColumn("conflict_type", conflict_type(collection)).filter("conflict_type is not null")
    # The wording of conflicts, here and below.
    text = F.concat(F.lit(f"{kind} '"), F.col(f"_first.{key}"), F.lit("' differs across sources"))
    if collection == "transactions":
        for c, what, name in (("currency", "currencies", "currency_mismatch"), ("timestamp", "timestamps", "timestamp_mismatch")):
            pair = F.concat(F.lit("transaction '"), F.col(f"_first.{key}"), F.lit(f"' has conflicting {what} ("), F.coalesce(F.col(f"_first.{c}").cast("string"), F.lit("")), F.lit(" vs "), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(") across sources"))
            text = F.when(F.col("conflict_type") == name, pair).otherwise(text)
    return kept, later.select(F.lit(kind).alias("record_type"), F.col(key).alias("record_id"), "conflict_type", text.alias("description"))


def missing_references(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    ends = relationships.select("relationship_id", F.expr("stack(2, 'source', source_entity_id, 'target', target_entity_id) as (side, entity)"))
    known = entities.select(F.upper("entity_id").alias("_k")).distinct()
    lost = ends.join(known, F.upper("entity") == F.col("_k"), "left_anti")
    text = F.concat(F.lit("relationship '"), "relationship_id", F.lit("' references unknown "), "side", F.lit(" entity '"), "entity", F.lit("'"))
    return lost.select(F.lit("relationship").alias("record_type"), F.col("relationship_id").alias("record_id"), F.lit("missing_reference").alias("conflict_type"), text.alias("description"))


def merge(spark: SparkSession, sources: list[S.Dataset]) -> S.Case:
    """One case of all sources with the first one's schema version; the others are conflicts."""
    if not sources:
        raise ValueError("no source to merge")
    version = sources[0].schema_version
    usable = [d for d in sources if d.schema_version == version]
    conflicts = [spark.createDataFrame([("dataset", d.name, "schema_version_mismatch", f"source '{d.name}' has schema version '{d.schema_version}', not '{version}'") for d in sources if d.schema_version != version], CONFLICT)]
    merged = {}
    for name in S.COLLECTIONS:
        parts = [d.collections[name].withColumns({"_src": F.lit(i), "_row": F.monotonically_increasing_id()}) for i, d in enumerate(usable) if name in d.collections]
        if not parts:
            merged[name] = spark.createDataFrame([], S.struct_of(name))
            continue
        merged[name], found = merge_collection(reduce(DataFrame.unionByName, parts), name, ["_src", "_row"])
        conflicts.append(found)
    conflicts.append(missing_references(merged["relationships"], merged["entities"]))
    manifest = [(i, d.name, d.source_type, d.schema_version, d.schema_version == version, *_origin(d), content_hash(spark, d)) for i, d in enumerate(sources)]
    kind = "source_index int, name string, source_type string, schema_version string, used boolean, adapter string, adapter_version string, normalisation_hash string"
    return S.Case(merged, reduce(DataFrame.unionByName, conflicts), spark.createDataFrame(manifest, kind), version)


def _origin(data: S.Dataset) -> tuple[str | None, str | None]:
    """Adapter and version, by the lineage of a record of the first collection that has one."""
    for name in S.COLLECTIONS:
        rows = data.collections[name].select("source_lineage.adapter", "source_lineage.adapter_version").limit(1).collect() if name in data.collections else []
        if rows:
            return rows[0].adapter, rows[0].adapter_version
    return None, None


def load_case(spark: SparkSession, definitions: list[tuple[str, str, dict]], registry) -> S.Case:
    """Sources (name, adapter, options or a function that gives them); one that can't be read is recorded, the others are merged.

    Only faults of a source count as such: a wrong call of an adapter is raised.
    """
    good, failures = [], []
    for name, adapter, options in definitions:
        try:
            data = registry.resolve(adapter)(spark, **(options() if callable(options) else options))
            for df in data.collections.values():
                df.write.format("noop").mode("overwrite").save()  # read it now, so that a bad file fails here
            good.append(data)
        except (S.AdapterError, PySparkException, Py4JJavaError, OSError) as e:  # Py4JJavaError: a task failed
            failures.append((name, str(e).splitlines()[0]))
    if not good:
        raise S.SourceError(f"no source could be read: {failures}")
    case = merge(spark, good)
    return S.Case(case.collections, case.conflicts, case.source_manifest, case.schema_version, failures)


def record_type_index(spark: SparkSession, collections: dict[str, DataFrame]) -> DataFrame:
    """(id upper case, types): all collections but relationships."""
    parts = [collections[n].select(F.upper(S.COLLECTIONS[n][2]).alias("id"), F.lit(S.COLLECTIONS[n][0]).alias("type")) for n in S.COLLECTIONS if n != "relationships" and n in collections]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sort_array(F.collect_set("type")).alias("types"))


def reference_issues(references: DataFrame, index: DataFrame) -> DataFrame:
    """(record_type, record_id, ref) with ``issue``: dangling or incompatible; fine ones are left out."""
    hit = references.join(index, F.upper("ref") == F.col("id"), "left")
    issue = F.when(F.col("types").isNull(), "dangling").when(~F.arrays_overlap("types", F.array(F.lit("evidence"), F.lit("transaction"))), "incompatible")
    return hit.withColumn("issue", issue).filter("issue is not null").select("record_type", "record_id", "ref", "issue")


def missing_transactions(sars: DataFrame, index: DataFrame) -> DataFrame:
    """(sar_id, ref) of transactions that the case lacks."""
    known = index.filter(F.array_contains("types", "transaction")).select("id")
    return sars.select("sar_id", F.explode("transaction_ids").alias("ref")).join(known, F.upper("ref") == F.col("id"), "left_anti")


def validate(spark: SparkSession, case: S.Case) -> DataFrame:
    """All integrity issues: (issue, record_type, record_id, ref).  None: the case passes."""
    c, index = case.collections, record_type_index(spark, case.collections)
    refs = c["relationships"].select(F.lit("relationship").alias("record_type"), F.col("relationship_id").alias("record_id"), F.explode("evidence_ids").alias("ref")).unionByName(
        c["evidence"].select(F.lit("evidence").alias("record_type"), F.col("evidence_id").alias("record_id"), F.explode("related_record_ids").alias("ref")))
    out = ["issue", "record_type", "record_id", "ref"]
    sars = missing_transactions(c["sars"], index).select(F.lit("missing_transaction").alias("issue"), F.lit("sar").alias("record_type"), F.col("sar_id").alias("record_id"), "ref")
    twice = case.conflicts.filter("record_type = 'evidence'").select(F.lit("duplicate_evidence").alias("issue"), "record_type", "record_id", F.col("record_id").alias("ref"))
    return reference_issues(refs, index).select(*out).unionByName(sars).unionByName(twice)


def serialised(df: DataFrame, collection: str) -> DataFrame:
    """(key, line): one line a record, fields escaped, lists sorted."""
    _, _, key, _ = S.COLLECTIONS[collection]
    fields = [f for f in S.struct_of(collection).fields if f.name != "source_lineage"]
    value = lambda f: F.array_join(F.transform(F.sort_array(f.name), escape_field), ",") if f.dataType.typeName() == "array" else escape_field(F.col(f.name))
    return df.select(F.col(key).alias("key"), F.concat_ws("|", *[F.coalesce(value(f), F.lit("")) for f in fields]).alias("line"))


def collection_hash(df: DataFrame, collection: str) -> DataFrame:
    """(collection, records, hash): the hash of the ascending hashes of all lines.

    Lines become 64 hex digits first; these are grouped by their first three digits and hashed again, so that no
    group and no string holds a whole collection's text.
    """
    lines = serialised(df, collection).select(F.sha2("line", 256).alias("h"))
    groups = lines.groupBy(F.left("h", F.lit(3)).alias("g")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"), F.count("*").alias("n"))
    return groups.agg(F.lit(collection).alias("collection"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "h"))), lambda x: x.h), ""), 256).alias("hash"))


def content_hash(spark: SparkSession, data: S.Dataset | S.Case) -> str:
    """``sha256:…`` of schema version and collections; the same whatever the order of rows, and without conflicts."""
    parts = [collection_hash(df, n) for n, df in data.collections.items()]
    rows = {r.collection: r.hash for r in reduce(DataFrame.unionByName, parts).collect()} if parts else {}
    text = f"schema={data.schema_version};" + "".join(f"{S.COLLECTIONS[n][1]}={rows.get(n, '')}|" for n in S.COLLECTIONS)
    import hashlib

    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()
