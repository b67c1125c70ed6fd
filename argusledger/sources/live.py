"""Sources that executors read by themselves: databases in partitions, REST endpoints, graph stores and GraphML documents.

The last three are Python data sources: the driver lists partitions, executors fetch and parse them.  What a live source gave is
written to the shared folder once, so that it is asked once, whatever is done with its rows.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from argusledger.functions.tables import cut
from argusledger.sources import schema as S

# What databases are asked without a query of one's own, graph stores likewise, and keys of an object that may hold rows.
DEFAULT_QUERY = "SELECT transaction_id, source_account, destination_account, amount, currency, timestamp, channel, jurisdiction, sar_linked FROM transactions"
GRAPH_QUERY = "MATCH (a)-[r]->(b) RETURN a, r, b"
WRAPPERS = ("transactions", "rows", "data", "records")


# --- databases -------------------------------------------------------------------------------


def jdbc_address(kind: str, text: str) -> tuple[str, dict[str, str]]:
    """URL and options of a connection: a JDBC URL as it is, or ``Key=Value;…`` as database clients write it."""
    if text.startswith("jdbc:"):
        return text, {}
    own = {k.strip().lower().replace(" ", ""): v.strip() for k, _, v in (x.partition("=") for x in text.split(";") if x.strip())}
    first = lambda *names: next((own[n] for n in names if own.get(n)), "")
    host, base = first("host", "server", "datasource"), first("database", "initialcatalog")
    if not host:
        raise S.InvalidConfiguration("the connection names no host")
    user = {"user": first("username", "userid", "user", "uid"), "password": first("password", "pwd")}
    if kind == "sqlserver":
        url = f"jdbc:sqlserver://{host.replace(',', ':')};databaseName={base}"
    else:
        url = f"jdbc:{kind}://{host}{':' + own['port'] if own.get('port') else ''}/{base}"
    return url, {k: v for k, v in user.items() if v}


def jdbc_rows(spark: SparkSession, url: str, query: str, key: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """The query's rows in ``parts`` ranges of ``key``, one query of the database each.  A URL of several lines names shards, a line each,
    which share the parts.

    ``key`` is a column of numbers, dates or timestamps; without it the first such one of the result.  Its bounds are asked of
    the database; rows without it are in the first range.  A result without such a column is one partition.
    """
    shards = url.split("\n")
    if len(shards) > 1:
        return reduce(DataFrame.unionByName, [jdbc_rows(spark, u, query, key, -(-parts // len(shards)), **options) for u in shards])
    read = lambda table: spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    inner = f"({query.strip().rstrip(';')}) q"
    whole = read(inner).load()
    kinds = ("tinyint", "smallint", "int", "bigint", "decimal", "float", "double", "date", "timestamp")
    fit = [f.name for f in whole.schema.fields if f.dataType.simpleString().split("(")[0] in kinds and (key is None or f.name.lower() == key.lower())]
    if key and not fit:
        raise S.InvalidConfiguration(f"{key!r} is no column of numbers, dates or timestamps")
    if not fit or parts < 2:
        return whole
    low, high = whole.agg(F.min(fit[0]).cast("string"), F.max(fit[0]).cast("string")).first()
    if low is None or low == high:
        return whole
    if whole.schema[fit[0]].dataType.typeName() not in ("date", "timestamp"):  # bounds of numbers are whole ones
        low, high = (str(int(float(x))) for x in (low, high))
    return read(inner).option("partitionColumn", fit[0]).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()


# --- Python data sources ---------------------------------------------------------------------


def _ask(reader: Callable[[int], Iterable[tuple]], parts: int, schema: str, title: str) -> type[DataSource]:
    """A data source with ``parts`` partitions whose rows ``reader(part)`` gives."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(i) for i in range(parts)]

        def read(self, partition) -> Iterator[tuple]:
            yield from reader(partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return title

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    return Source


def fetched(spark: SparkSession, kind: str, reader: Callable[[int], Iterable[tuple]], parts: int, schema: str) -> DataFrame:
    """All rows of all partitions, written once.  A reader's SourceError or NormalisationError is raised here as such."""
    title = f"argus_{kind}_{uuid.uuid4().hex}"
    spark.dataSource.register(_ask(reader, parts, schema, title))
    try:
        return cut(spark.read.format(title).load())
    except Exception as e:
        told = re.search(r"(SourceError|NormalisationError): (.*)", str(e))
        if told is None:
            raise
        raise getattr(S, told[1])(told[2]) from None


def http_get(url: str, headers: dict[str, str]) -> str:
    import urllib.request

    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=30) as r:  # noqa: S310
        return r.read().decode()


def rest_records(spark: SparkSession, urls: list[str], token: str | None = None, get: Callable[[str, dict], str] | None = None) -> DataFrame:
    """(part, at, record): the JSON objects that each URL's body holds in an array, or an object's wrapper array; a GET a partition."""
    headers, get = {"Authorization": f"Bearer {token}"} if token else {}, get or http_get

    def read(part: int):
        import urllib.error

        try:
            body = json.loads(get(urls[part], headers))
        except urllib.error.HTTPError as e:
            raise S.SourceError(f"authentication failed: HTTP {e.code}" if e.code in (401, 403) else f"HTTP status {e.code}") from None
        except (OSError, ValueError) as e:
            raise S.SourceError(str(e)) from None
        if isinstance(body, dict):
            body = next((body[w] for w in WRAPPERS if isinstance(body.get(w), list)), None)
        if not isinstance(body, list):
            raise S.SourceError("the body is no array, nor an object that wraps one")
        for at, r in enumerate(body):
            if not isinstance(r, dict):
                raise S.SourceError("an array element is no object")
            yield part, at, json.dumps(r)

    return fetched(spark, "rest", read, len(urls), "part int, at bigint, record string")


def graph_records(spark: SparkSession, client: Callable[[str | None, str, int, int], Iterable[tuple[dict, dict, dict]]], uri: str | None = None, query: str = GRAPH_QUERY, parts: int = 1) -> DataFrame:
    """(part, at, a, r, b) of a graph store.  ``client(uri, query, part, parts)`` gives one part's records: nodes ``{id, labels, properties}``
    and relationships ``{id, type, properties}``; it runs on executors."""
    ident = lambda x: str(x["properties"].get("id") or x["id"])

    def node(x):
        p = x["properties"]
        return ident(x), (x.get("labels") or ["unknown"])[0], p.get("name", p.get("display_name"))

    def read(part: int):
        for at, (a, r, b) in enumerate(client(uri, query, part, parts)):
            ids = r["properties"].get("evidence_ids") or []
            ids = [v.strip() for v in ids.split(",") if v.strip()] if isinstance(ids, str) else [str(v) for v in ids]
            yield part, at, node(a), (ident(r), r.get("type") or "related_to", ids), node(b)

    one = "struct<id:string,type:string,name:string>"
    return fetched(spark, "graph", read, parts, f"part int, at bigint, a {one}, r struct<id:string,type:string,evidence_ids:array<string>>, b {one}")


def neo4j_client(uri: str | None, query: str, part: int, parts: int):
    """Records of a Neo4j database, by its driver, where that is installed; ``uri``: ``scheme://user:password@host``.  One part only."""
    try:
        import neo4j
    except ImportError:
        raise S.SourceError("the neo4j driver is not installed on the executors") from None
    m = re.fullmatch(r"(\w[\w+]*://)(?:([^:@/]*):([^@/]*)@)?(.*)", uri or "")
    if not m:
        raise S.SourceError("no graph store address")
    tell = lambda x: {"id": x.element_id, "labels": sorted(getattr(x, "labels", [])), "type": getattr(x, "type", None), "properties": dict(x)}
    with neo4j.GraphDatabase.driver(m[1] + m[4], auth=(m[2], m[3]) if m[2] else None) as driver, driver.session() as session:
        for r in session.run(query) if part == 0 else ():
            yield tell(r["a"]), tell(r["r"]), tell(r["b"])


def graphml_elements(stream) -> Iterator[tuple]:
    """(kind, id, source, target, data) of the direct children of the first graph, in document order, in bounded memory.

    Names count without namespace, data keys without case; what a node or edge holds deeper than its own data is left out.
    """
    import xml.etree.ElementTree as ET

    local = lambda tag: tag.rsplit("}", 1)[-1]
    depth, graph, seen = 0, None, False
    try:
        for event, el in ET.iterparse(stream, events=("start", "end")):
            if event == "start":
                depth += 1
                if depth == 2 and local(el.tag) == "graph" and not seen:
                    graph, seen = el, True
                continue
            if depth == 3 and graph is not None:
                kind = local(el.tag)
                if kind in ("node", "edge"):
                    data: dict[str, str] = {}
                    for d in el:
                        if local(d.tag) == "data" and d.get("key") is not None:
                            if d.get("key").lower() in data:
                                raise S.SourceError(f"{kind} {el.get('id')!r} has data {d.get('key')!r} twice")
                            data[d.get("key").lower()] = "".join(d.itertext())
                    yield kind, el.get("id"), el.get("source"), el.get("target"), data
                graph.clear()
            elif depth == 2:
                if el is graph:
                    graph = None
                el.clear()
            depth -= 1
    except ET.ParseError as e:
        raise S.SourceError(f"invalid XML: {e}") from None
    if not seen:
        raise S.SourceError("no graph under the document's root")


def graphml_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, kind, id, source, target, data) of a GraphML document, or of all of a folder; a document a partition."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise S.SourceError(f"{path}: no such file")
    found, walk = [], fs.listFiles(p, True)
    while walk.hasNext():
        f = walk.next()
        if f.getLen() and not re.match(r"[._]", f.getPath().getName()):
            found.append(f.getPath().toString())
    files = sorted(found)

    def read(part: int):
        from pyarrow.fs import FileSystem

        uri = files[part]
        store, name = FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
        with store.open_input_stream(name) as stream:
            for at, row in enumerate(graphml_elements(stream)):
                yield part, at, *row

    return fetched(spark, "graphml", read, len(files), "file int, at bigint, kind string, id string, source string, target string, data map<string,string>")
