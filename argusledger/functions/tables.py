"""Tables in the cluster's shared folder, and joins that hold under skew."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that a broadcast side may have at most; beyond either a shuffle join is used.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 32 << 20
#: Row groups of :func:`cut`: writers hold one in memory for each task.
ROW_GROUP_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where that is unset and all executors are this machine's."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='argusledger-')}"
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir() or root
    return root.rstrip("/")


_MADE: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Tables that :func:`cut` makes inside are deleted at the end, but for those taken out of the list it gives."""
    _MADE.append(made := [])
    try:
        yield made
    finally:
        _MADE.remove(made)
        for df in made:
            drop_cut(df)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/argus-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._argus_path = path
    for made in _MADE[-1:]:
        made.append(out)
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a table made by :func:`cut` once nothing reads it any more."""
    spark, path = df.sparkSession, getattr(df, "_argus_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def skew_join(big: DataFrame, small: DataFrame, key: str, weight: str, hot_share: int = 1000) -> DataFrame:
    """``big`` left join ``small`` (unique ``key``, null-safe not needed).

    ``weight`` counts the rows of ``big`` that a key has.  At most ``hot_share`` keys can have more than
    a ``1/hot_share`` share of all rows; just those are broadcast, the rest is a plain shuffle join, so
    no task gets the rows of a hot key.
    """
    total = small.agg(F.sum(weight)).first()[0] or 0
    limit = max(1000, total // hot_share)
    hot = small.filter(F.col(weight) > limit).drop(weight)
    cold = small.filter(F.col(weight) <= limit).drop(weight)
    mark = hot.withColumn("_hot", F.lit(True))
    marked = big.join(F.broadcast(mark), key, "left")
    values = [c for c in hot.columns if c != key]
    is_hot = marked.filter(F.col("_hot")).select(*big.columns, *values)
    not_hot = marked.filter(F.col("_hot").isNull()).select(*big.columns)
    return is_hot.unionByName(not_hot.join(cold, key, "left").select(*big.columns, *values))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes, else as it is (a shuffle join follows).

    A value of variable length counts with its length as text, a fixed one with eight bytes.
    """
    wide = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "map", "struct")]
    long = [F.octet_length(f"`{c}`") if df.schema[c].dataType.typeName() in ("string", "binary") else F.octet_length(F.to_json(F.struct(f"`{c}`"))) for c in wide]
    each = sum((F.coalesce(x, F.lit(0)) + 8 for x in long), F.lit(8 * (len(df.columns) - len(wide)) + 16))
    got = df.select(each.alias("n")).limit(rows + 1).agg(F.count("*").alias("rows"), F.sum("n").alias("bytes")).first()
    return F.broadcast(df) if got.rows <= rows and (got.bytes or 0) <= size else df


class Shield:
    """A table whose columns have names that no operator uses inside, so that any names may come in, dots included.

    ``df`` holds each column that is needed under its own name, the others as ``in_0``, ``in_1`` and so on; :meth:`back` gives
    the names back.  An input column named like a new one (without case) is replaced by it.
    """

    def __init__(self, df: DataFrame, *needed: str):
        self.names = df.columns
        self.place: dict[str, int] = {}
        for n in needed:
            fit = [i for i, c in enumerate(self.names) if c == n] or [i for i, c in enumerate(self.names) if c.lower() == n.lower()]
            if not fit:
                raise ValueError(f"no column {n!r} in {self.names}")
            self.place[n] = fit[0]
        named = {i: n for n, i in self.place.items()}
        self.inner = [named.get(i, f"in_{i}") for i in range(len(self.names))]
        self.df = df.toDF(*self.inner)

    def back(self, out: DataFrame, new: dict[str, str] | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
        """``out`` with the input's names, less ``drop`` (inner names), and ``new`` columns: outer name to inner name."""
        new = new or {}
        taken = {c.lower() for c in new}
        keep = [(i, c) for i, c in zip(self.inner, self.names, strict=True) if i not in drop and c.lower() not in taken]
        return out.select(*[i for i, _ in keep], *new.values()).toDF(*[c for _, c in keep], *new)
