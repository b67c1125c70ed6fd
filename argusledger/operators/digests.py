"""Digests of files and folders of any size, as trees over lines: no task holds a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argusledger.sources.documents import exists
from argusledger.sources.places import PLACE, placed, with_numbers

#: Children of a node of the tree, as a power of two.  It is part of what a digest means.
FAN_BITS = 12


def _parents(nodes: DataFrame) -> DataFrame:
    """One level up: a node's digest is that of its children's, in their order.  4096 children are 160 KB."""
    up = nodes.groupBy("file", F.shiftright("number", FAN_BITS).alias("number"))
    # The children's numbers order them, and each task joins what it has of a node before the shuffle.
    return up.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "digest"))), lambda x: F.lower(F.hex(x.digest))), ""), 256).alias("hex")).select("file", "number", F.unhex("hex").alias("digest"))


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(name, length, digest) of all files below ``folder`` (or of this one file), names from the folder on.

    A line is what newlines part, of any bytes; its SHA-256 is a leaf of a tree of three levels, whose root and the file's length make
    the digest.  So it doesn't depend on how Spark splits the files.  40 bytes a line are shuffled.  Compressed
    files are digested by their content and their compressed length; hidden ones (``.x``, ``_x``) and those without bytes are left out.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.getFileStatus(p)
    root = status.getPath().toUri().getRawPath().rstrip("/")
    above = len(root if status.isDirectory() else root.rsplit("/", 1)[0])
    # Reads the list of files and no content.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("length"))
    lines = placed(spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(folder))
    leaf = F.unhex(F.sha2(F.col("value").cast("binary"), 256))
    nodes = with_numbers(lines, within_file=True, base=0).select(F.col(f"{PLACE}.file").alias("file"), F.col("row_number").alias("number"), leaf.alias("digest"))
    for _ in range(3):
        nodes = _parents(nodes)
    # Only files of over 2^36 lines have several nodes left.
    roots = nodes.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "digest"))), lambda x: F.lower(F.hex(x.digest))), "").alias("root"))
    inner = F.substring(F.regexp_replace("file", "^[^:/]*:(//[^/]*)?", ""), above + 2, 1 << 30)
    name = F.url_decode(F.replace(inner, F.lit("+"), F.lit("%2B")))
    return files.join(roots, "file").select(name.alias("name"), "length", F.sha2(F.concat_ws(":", F.col("length").cast("string"), F.col("root")), 256).alias("digest"))


def _tagged(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), x)


def dataset_hash(spark: SparkSession, folder: str) -> str | None:
    """``sha256:...`` of a file or a folder of any number of files; None where there is none.

    A byte, a name, a file more or less change it.  Files are joined in 4096 groups by their names' hashes, so no row holds all.
    """
    if not exists(spark, folder):
        return None
    entry = F.concat_ws("=", "name", "digest")
    groups = file_digests(spark, folder).groupBy(F.substring(F.sha2("name", 256), 1, 3).alias("g")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), "\n"), 256).alias("h"))
    all_of_them = groups.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "h"))), lambda x: x.h), "").alias("x"))
    return all_of_them.filter("x <> ''").select(_tagged(F.sha2("x", 256)).alias("h")).head(1)[0].h if not groups.isEmpty() else None
