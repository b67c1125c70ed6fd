"""Source adapters: CSV, JSON, JSON lines, Parquet, GraphML, JDBC, REST and property graphs to canonical collections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argusledger.functions import normalise as N
from argusledger.functions.tables import cut, small
from argusledger.sources import live
from argusledger.sources import schema as S
from argusledger.sources.live import WRAPPERS
from argusledger.sources.places import PLACE, placed, with_numbers

ADAPTER_VERSION = "1.0"
#: All names that a transaction's fields may have.
FIELDS = ("transaction_id", "txn_id", "source_account", "from_account", "destination_account", "to_account", "amount", "currency", "timestamp", "channel", "jurisdiction", "destination_country", "sar_linked")


def _named(df: DataFrame, exact: bool) -> dict[str, str]:
    return {c if exact else c.lower(): c for c in df.columns}


def _field(df: DataFrame, *names: str, exact: bool = False) -> Column:
    """The first non-blank of the columns that exist (names without case, unless ``exact``)."""
    have = _named(df, exact)
    own = [F.col(f"`{have[n]}`").cast("string") for n in names if n in have]
    return N.first_non_blank(*own) if own else F.lit(None).cast("string")


def _raw(df: DataFrame, *names: str, exact: bool = False) -> Column:
    """The first of the columns that exists, as it is: presence decides, not the value."""
    have = _named(df, exact)
    for n in names:
        if n in have:
            return F.col(f"`{have[n]}`").cast("string")
    return F.lit(None).cast("string")


def map_transactions(rows: DataFrame, source_type: str, source_name: str | None = None, table: str | None = None, exact: bool = False) -> DataFrame:
    """All-text rows to canonical transactions with ``problem`` (null: valid).  Aliases are tried in order.

    Each field is parsed once, to a struct; validity is judged on what was parsed.  A row's place in its files is kept.
    """
    place = [PLACE] if PLACE in rows.columns else []
    adapter = F.lit(source_type)
    raw = lambda *names: _raw(rows, *names, exact=exact)
    text = lambda *names: _field(rows, *names, exact=exact)
    parsed = rows.select(
        text("transaction_id", "txn_id").alias("ident"), text("source_account", "from_account").alias("src"), text("destination_account", "to_account").alias("dst"),
        N.blank_to_null(raw("amount")).alias("amount_text"), N.parse_amount(raw("amount")).alias("amount"), N.blank_to_null(raw("timestamp")).alias("ts_text"), N.parse_timestamp(raw("timestamp")).alias("ts"),
        N.parse_currency(raw("currency")).alias("currency"), raw("channel").alias("channel"), raw("jurisdiction", "destination_country").alias("jurisdiction"), N.parse_flag(raw("sar_linked")).alias("sar_linked"), *place)
    ident = F.col("ident")
    problem = (
        F.when(ident.isNull(), "missing transaction_id").when(F.col("src").isNull(), "missing source_account").when(F.col("dst").isNull(), "missing destination_account")
        .when(F.col("amount_text").isNull(), "missing amount").when(F.col("amount").isNull(), "invalid amount")
        .when(F.col("ts_text").isNull(), "missing timestamp").when(F.col("ts").isNull(), "invalid timestamp")
        .when(F.col("currency").isNotNull() & ~F.col("currency").rlike(N.CURRENCY), "invalid currency")
    )
    return parsed.select(
        ident.alias("transaction_id"), F.col("src").alias("source_account"), F.col("dst").alias("destination_account"), "amount", "currency", F.col("ts").alias("timestamp"), "channel", "jurisdiction", "sar_linked",
        F.struct(adapter.alias("source_type"), F.lit(source_name).cast("string").alias("source_name"), F.lit(table).cast("string").alias("table"),
                 ident.alias("source_record_id"), F.concat(adapter, F.lit("-adapter")).alias("adapter"), F.lit(ADAPTER_VERSION).alias("adapter_version")).alias("source_lineage"),
        problem.alias("problem"), *place,
    )


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids (upper case) that a source has more than once."""
    return df.groupBy(F.upper(key).alias("id")).agg(F.count("*").alias("n")).filter("n > 1")


def bad_rows(mapped: DataFrame, key: str = "transaction_id") -> DataFrame:
    """(row_number, record, problem) of all invalid rows; rows count from 1 over all files, in the order of their names.

    A row with several problems has its first; an empty or a valid table has none.  Two scans of the files, no sort of rows.
    """
    return with_numbers(mapped).filter("problem is not null").select("row_number", F.col(key).alias("record"), "problem")


def strict(mapped: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Raises on the first invalid row (by its number, where rows have a place in files), or a repeated id; else the canonical rows."""
    bad = mapped.filter(F.col("problem").isNotNull()).select("problem", key).limit(1).collect()
    if bad and PLACE in mapped.columns:
        first = bad_rows(mapped, key).orderBy("row_number").limit(1).collect()[0]
        raise S.NormalisationError(f"row {first.row_number}: {first.problem} (record {first.record!r})")
    if bad:
        raise S.NormalisationError(f"{bad[0].problem} (record {bad[0][key]!r})")
    twice = duplicate_ids(mapped, key).limit(1).collect()
    if twice:
        raise S.NormalisationError(f"duplicate {key}: {twice[0].id}")
    return mapped.drop("problem", PLACE)


def _transactions(rows: DataFrame, kind: str, name: str | None, table: str | None = None, exact: bool = False) -> S.Dataset:
    return S.Dataset({"transactions": strict(map_transactions(rows, kind, name, table, exact))}, name or kind, source_type=kind)


def read_csv(spark: SparkSession, path: str, name: str | None = None) -> S.Dataset:
    rows = spark.read.option("header", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    if not rows.columns:
        raise S.SourceError(f"{path}: no header")
    return _transactions(placed(rows), "csv", name or path, exact=True)


def from_records(records: DataFrame) -> DataFrame:
    """JSON objects (``record``) as rows of text: those of FIELDS that any record has."""
    keys = records.select(F.explode(F.json_object_keys("record")).alias("k")).filter(F.col("k").isin(*FIELDS)).distinct()
    have = {r.k for r in keys.collect()}
    own = [c for c in FIELDS if c in have] or ["transaction_id"]
    # A VARIANT keeps all digits of a number.
    place = [PLACE] if PLACE in records.columns else []
    return records.select(F.try_parse_json("record").alias("v"), *place).select(*[F.try_variant_get("v", f"$.{c}", "string").alias(c) for c in own], *place)


def _first_line(spark: SparkSession, path: str) -> str:
    """The first two characters, without blanks, of the first line that is not blank, of the files in the order of their names.

    Spark reads the largest split first, so its first row may be any line.
    """
    lines = placed(spark.read.text(path).filter(F.btrim("value", F.lit("\ufeff \t\r")) != "")).select(F.substring(F.btrim("value", F.lit("\ufeff \t\r")), 1, 2).alias("x"), PLACE)
    return lines.agg(F.min_by("x", PLACE)).first()[0] or ""


def _one_a_line(spark: SparkSession, path: str) -> DataFrame | None:
    """Records of a document with a bracket or one object a line (see :func:`argusledger.sinks.write_collection`); None for any other layout."""
    if _first_line(spark, path) != "[":
        return None
    lines = spark.read.text(path).filter("trim(value) not in ('', '[', ']')").withColumn("x", F.trim("value"))
    if lines.filter(~F.col("x").rlike(r"^\{.*\},?$")).limit(1).count():
        return None
    records = placed(lines).select(F.regexp_replace("x", ",$", "").alias("record"), PLACE)
    return None if records.filter(F.json_object_keys("record").isNull()).limit(1).count() else records


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an array, of an object's wrapper array, or of lines (by the suffix .jsonl)."""
    return _json_rows(spark, path).drop(PLACE)


def _json_rows(spark: SparkSession, path: str) -> DataFrame:
    """These rows with their places, but for an object's wrapper array, which is one task's anyway."""
    if path.endswith(".jsonl"):
        return placed(spark.read.option("primitivesAsString", True).option("mode", "FAILFAST").json(path))
    records = _one_a_line(spark, path)
    if records is not None:
        return from_records(records)
    rows = spark.read.option("multiLine", True).option("primitivesAsString", True).option("mode", "FAILFAST").json(path)
    return _unwrap(spark, path, rows, WRAPPERS)


def _unwrap(spark: SparkSession, path: str, rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A top-level array's rows as they are; of an object, those of its first wrapper.  An object without one is an error."""
    if _first_line(spark, path).startswith("["):
        return placed(rows)
    arrays = {f.name: f.dataType.elementType for f in rows.schema.fields if isinstance(f.dataType, T.ArrayType)}
    held = [w for w in keys if w in arrays]
    if not held:
        raise S.SourceError(f"{path}: neither an array nor an object that wraps one under {', '.join(keys)}")
    if not isinstance(arrays[held[0]], T.StructType):
        if rows.filter(F.size(held[0]) > 0).limit(1).count():
            raise S.SourceError(f"{path}: an array element is no object")
        return rows.limit(0).select(F.lit(None).cast("string").alias("transaction_id"))
    return rows.selectExpr(f"inline({held[0]})")


def read_json(spark: SparkSession, path: str, name: str | None = None) -> S.Dataset:
    return _transactions(_json_rows(spark, path), "json", name or path, exact=True)


def read_parquet(spark: SparkSession, path: str, name: str | None = None) -> S.Dataset:
    rows = spark.read.parquet(path)
    return _transactions(placed(rows).select(*[N.as_text(F.col(f"`{f.name}`"), f.dataType.typeName()).alias(f.name) for f in rows.schema.fields], PLACE), "parquet", name or path)


def read_jdbc(spark: SparkSession, url: str, query: str | None = None, kind: str = "postgresql", name: str | None = None, key: str | None = None, parts: int = 8, **options: str) -> S.Dataset:
    """PostgreSQL and SQL Server through Spark's JDBC source, in ``parts`` ranges of ``key`` (its driver jar comes with the cluster).

    ``url`` is a JDBC URL or a client's ``Key=Value;…``.  Errors never name the connection.  The rows are written to the shared folder
    once, so that the database is asked once, whatever is done with them, and what fails on the way fails here.
    """
    query = query if query and query.strip() else live.DEFAULT_QUERY
    address, own = live.jdbc_address(kind, url)
    try:
        rows = live.jdbc_rows(spark, address, query, key, int(parts), **{**own, **options})
        text = cut(rows.select([N.as_text(F.col(f"`{f.name}`"), f.dataType.typeName()).alias(f.name) for f in rows.schema.fields]))
    except S.AdapterError:
        raise
    except Exception as e:
        what = str(e).splitlines()[0]
        for secret in (address, url, *address.split("\n"), *own.values()):
            what = what.replace(secret, "***")
        raise S.SourceError(f"{kind} query failed for {name or 'the connection'}: {what}") from None
    words = query.split()
    table = next((b.rstrip(";") for a, b in zip(words, words[1:], strict=False) if a.upper() == "FROM"), None)
    return _transactions(text, kind, name or table, table)


def read_rest(spark: SparkSession, base: str, path: str | None = None, token: str | None = None, name: str | None = None, get: Callable[[str, dict], str] | None = None, paths: list[str] | None = None) -> S.Dataset:
    """One GET, or one for each of ``paths``, on executors; bodies are arrays or wrapper objects.  ``get(url, headers)`` may replace the HTTP client."""
    records = live.rest_records(spark, [N.combine_url(base, p) for p in paths or [path]], token, get)
    return _transactions(from_records(records), "rest", name or base, exact=True)


def _graph(entities: DataFrame, relationships: DataFrame, kind: str, name: str | None) -> S.Dataset:
    def lineage(key: str) -> Column:
        return F.struct(F.lit(kind).alias("source_type"), F.lit(name).cast("string").alias("source_name"), F.lit(None).cast("string").alias("table"),
                        F.col(key).alias("source_record_id"), F.lit(f"{kind}-adapter").alias("adapter"), F.lit(ADAPTER_VERSION).alias("adapter_version")).alias("source_lineage")

    return S.Dataset({"entities": entities.select("entity_id", "entity_type", "display_name", lineage("entity_id")),
                      "relationships": relationships.select("relationship_id", "source_entity_id", "target_entity_id", "relationship_type", "evidence_ids", lineage("relationship_id"))}, name or kind, source_type=kind)


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last by ``order``."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_r")).select(key, "_r.*").drop(order)


def read_graphml(spark: SparkSession, path: str, name: str | None = None) -> S.Dataset:
    """Nodes and edges of the first graph of a GraphML document, or of each of a folder; ids count without case.

    The last of repeated nodes wins.  A node without id, an edge without an end, an end that is no node and repeated edge ids raise.
    """
    rows = live.graphml_records(spark, path)
    value = lambda key: F.col("data")[key]
    odd = F.when((F.col("kind") == "node") & F.col("id").isNull(), "a node has no id").when((F.col("kind") == "edge") & F.col("source").isNull(), "an edge has no source").when((F.col("kind") == "edge") & F.col("target").isNull(), "an edge has no target")
    bad = rows.withColumn("odd", odd).filter("odd is not null").orderBy("file", "at").limit(1).collect()
    if bad:
        raise S.NormalisationError(f"{bad[0].odd} (element {bad[0].at})")
    at = F.struct("file", "at")
    nodes = last_wins(rows.filter("kind = 'node'").select(F.upper("id").alias("_key"), F.col("id").alias("entity_id"), F.coalesce(value("label"), F.lit("unknown")).alias("entity_type"), value("name").alias("display_name"), at.alias("_at")), "_key", "_at")
    # An edge without id is named by its place among the document's edges, after those of the documents before it.
    edges = rows.filter("kind = 'edge'")
    counts = edges.groupBy("file").agg(F.count("*").alias("n"))  # one row a document
    before = counts.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    edges = edges.join(small(before), "file").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("file").orderBy("at")))
    edges = edges.select(F.coalesce("id", F.concat(F.lit("edge-"), F.col("place").cast("string"))).alias("relationship_id"), F.col("source").alias("source_entity_id"), F.col("target").alias("target_entity_id"),
                         F.coalesce(value("type"), F.lit("related_to")).alias("relationship_type"), N.comma_list(F.coalesce(value("evidence_ids"), F.lit(""))).alias("evidence_ids"))
    ends = edges.select("relationship_id", F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id")).withColumn("_key", F.upper("entity_id"))
    lost = ends.join(nodes.select("_key"), "_key", "left_anti").orderBy("relationship_id").limit(1).collect()
    if lost:
        raise S.NormalisationError(f"edge {lost[0].relationship_id!r} names unknown node {lost[0].entity_id!r}")
    twice = duplicate_ids(edges, "relationship_id").limit(1).collect()
    if twice:
        raise S.NormalisationError(f"duplicate edge id: {twice[0].id}")
    return _graph(nodes, edges, "graphml", name or path)


def read_property_graph(spark: SparkSession, uri: str | None = None, query: str | None = None, client: Callable | None = None, parts: int = 1, name: str | None = None) -> S.Dataset:
    """A graph store's records, read on executors by ``client`` (see :func:`argusledger.sources.live.graph_records`); ids count without case.

    The last of repeated nodes wins and the first of repeated relationships, by part and place.
    """
    rows = live.graph_records(spark, client or live.neo4j_client, uri, query if query and query.strip() else live.GRAPH_QUERY, int(parts))
    place = lambda side: F.struct("part", "at", F.lit(side).alias("side")).alias("_at")
    ends = rows.select("a.*", place(0)).unionByName(rows.select("b.*", place(1)))
    nodes = last_wins(ends.select(F.upper("id").alias("_key"), F.col("id").alias("entity_id"), F.col("type").alias("entity_type"), F.col("name").alias("display_name"), "_at"), "_key", "_at")
    first = rows.groupBy(F.upper("r.id")).agg(F.min_by(F.struct("r", "a", "b"), F.struct("part", "at")).alias("x"))
    edges = first.select(F.col("x.r.id").alias("relationship_id"), F.col("x.a.id").alias("source_entity_id"), F.col("x.b.id").alias("target_entity_id"), F.col("x.r.type").alias("relationship_type"), F.col("x.r.evidence_ids").alias("evidence_ids"))
    return _graph(nodes, edges, "neo4j", name)


def grounding_ids(spark: SparkSession, path: str, column: str = "txn_id") -> DataFrame:
    """Distinct ids (``id``) of a CSV or JSON file; an unknown kind, a missing column or bad JSON gives none."""
    none = spark.createDataFrame([], "id string")
    if path.endswith(".csv"):
        rows = spark.read.option("header", True).csv(path)
    elif path.endswith(".json"):
        rows = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
        if "_corrupt_record" in rows.columns:
            return none
        try:
            rows = _unwrap(spark, path, rows, ("transactions", "rows", "data", "transfers", "records"))  # fixed values
        except S.SourceError:  # no rows in it
            return none
    else:
        return none
    if column not in rows.columns:
        return none
    return rows.select(N.blank_to_null(F.col(column)).alias("id")).filter("id is not null").distinct()


class Registry:
    """Adapters by name, without case; replaceable.  Those in ``CONNECTED`` take a connection, under the argument named there."""

    # Adapters of live sources.
    CONNECTED = {"postgresql": "url", "sqlserver": "url", "rest": "base", "neo4j": "uri"}

    def __init__(self):
        self._by_name: dict[str, Callable[..., S.Dataset]] = {}

    def register(self, name: str, load: Callable[..., S.Dataset]) -> None:
        self._by_name[name.lower()] = load

    def resolve(self, name: str) -> Callable[..., S.Dataset]:
        if name.lower() not in self._by_name:
            raise S.UnsupportedSource(f"{name!r}; known: {', '.join(sorted(self._by_name))}")
        return self._by_name[name.lower()]

    def listing(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, ADAPTER_VERSION) for k in sorted(self._by_name)], "adapter string, version string")


def default_registry() -> Registry:
    out = Registry()
    for name, load in (("csv", read_csv), ("json", read_json), ("jsonl", read_json), ("parquet", read_parquet), ("graphml", read_graphml), ("rest", read_rest), ("neo4j", read_property_graph)):
        out.register(name, load)
    out.register("postgresql", lambda spark, **o: read_jdbc(spark, kind="postgresql", **o))
    out.register("sqlserver", lambda spark, **o: read_jdbc(spark, kind="sqlserver", **o))
    return out
