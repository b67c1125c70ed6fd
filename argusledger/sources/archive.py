"""Archives of JSON documents: append-only folders that hold each run once, checked before anything is written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argusledger.functions.tables import cut, drop_cut
from argusledger.sources import schema as S
from argusledger.sources.documents import exists

#: Folders of an archive; part of its layout.
BUCKETS = 64


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(value, bucket): one JSON document a row; none where nothing was archived."""
    if not exists(spark, path):
        return spark.createDataFrame([], "value string, bucket int")
    return spark.read.schema("value string, bucket int").text(path)


def archive(documents: DataFrame, path: str, run_id: str, flaws: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
    """Adds documents (one column of JSON text) to the archive; returns how many were ``written``, and ``kept`` as they were.

    ``run_id`` is the path of the run's id in a document (``$.run_id``).  ``flaws`` gives (value, violations) of invalid ones of a table
    (value).  One of them, one without an id, two that differ under one id, or one that differs from what the archive has of its
    run: nothing is written and an error says which.  Repeated rows, and runs archived before, are written once in all, so a job
    that failed may run again.  Files appear together when Spark commits.  One writer at a time; no document, no change.

    A document takes one line: line ends between its tokens become spaces.  Of the archive only folders of the new runs are read.
    """
    spark = documents.sparkSession
    value = F.regexp_replace(F.col(f"`{documents.columns[0]}`"), "[\r\n]+", " ")
    ident = F.get_json_object("value", run_id)
    rows = cut(documents.select(value.alias("value")).distinct().withColumn("run", ident).withColumn("bucket", F.pmod(F.crc32(F.col("run").cast("binary")), F.lit(BUCKETS)).cast("int")))
    try:
        lost = rows.filter("run is null").limit(1).count()
        if lost:
            raise S.SourceError(f"{path}: a document has no {run_id}")
        bad = flaws(rows.select("value")).limit(1).collect() if flaws else []
        if bad:
            raise S.SourceError(f"{path}: run {_run(spark, bad[0].value, run_id)}: {'; '.join(bad[0].violations)}")
        _one_each(path, rows)
        here = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS
        old = read_archive(spark, path).filter(F.col("bucket").isin(here)).withColumn("run", ident)
        _one_each(path, rows.unionByName(old))
        new = rows.join(old.select("run"), "run", "left_anti")
        written = new.count()
        if written:
            new.select("value", "bucket").repartition(F.col("bucket")).write.mode("append").partitionBy("bucket").text(path)
        return {"written": written, "kept": rows.count() - written}
    finally:
        drop_cut(rows)


def _one_each(path: str, rows: DataFrame) -> None:
    twice = rows.groupBy("run").agg(F.min("value").alias("a"), F.max("value").alias("b")).filter("a <> b").select("run").limit(1).collect()
    if twice:
        raise S.SourceError(f"{path}: run {twice[0].run} has two documents that differ")


def _run(spark: SparkSession, value: str, run_id: str) -> str:
    return spark.createDataFrame([(value,)], "value string").select(F.get_json_object("value", run_id)).first()[0]
