import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def tables(con, sf_dir=SF):
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")


@pytest.fixture(scope="session")
def same(spark):
    """Asserts that a query and its SQL give the same rows."""

    def check(query, sql, sf_dir=SF):
        got = query(spark, sf_dir).toArrow().to_pylist()
        con = duckdb.connect()
        tables(con, sf_dir)
        want = con.sql(sql).to_arrow_table().to_pylist()
        cols = sorted(want[0]) if want else []
        assert len(got) == len(want)
        a, b = (sorted(repr([r[c] for c in cols]) for r in rs) for rs in (got, want))
        assert a == b

    return check
