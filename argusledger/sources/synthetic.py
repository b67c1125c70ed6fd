"""A synthetic ledger of any size (MSC-11) for trials: accounts pay each other in patterns whose shapes are parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argusledger.functions.normalise import HIGH_RISK_DESTINATIONS


@dataclass(frozen=True)
class Pattern:
    """``groups`` groups of accounts.  Sizes are drawn evenly between two bounds, amounts are log-normal around ``median``, delays
    exponential with mean ``gap_hours``, and a group is reported with chance ``reported``.

    ``loop``: money goes around all accounts, ``laps`` times, less ``fee`` a step.  ``funnel``: all accounts pay one, which pays on abroad.
    ``noise``: any account of the group pays any other, ``laps`` payments an account.
    """

    kind: str
    groups: int
    size: tuple[int, int]
    median: float
    spread: float = 0.6
    gap_hours: float = 9.0
    reported: float = 0.0
    laps: int = 1
    fee: float = 0.02
    abroad: float = 0.1


PATTERNS = (Pattern("loop", 12, (4, 9), 7400.0, 0.3, 5.0, 0.7, 2, abroad=0.5), Pattern("funnel", 10, (6, 30), 930.0, 0.2, 2.0, 0.4, abroad=0.8), Pattern("noise", 40, (5, 25), 310.0, 1.1, 30.0, 0.01, 3))


def ledger(spark: SparkSession, patterns: tuple[Pattern, ...] = PATTERNS, start: str = "2025-03-03 00:00:00", days: int = 180, seed: int = 1) -> DataFrame:
    """(txn_id, timestamp, source_account, destination_account, amount, source_country, destination_country, sar_linked).

    A row depends on its pattern, group and step and the seed alone, so reruns agree however rows are dealt out.
    """
    parts = [_rows(spark, i, p, start, days, seed) for i, p in enumerate(patterns)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _rows(spark: SparkSession, number: int, p: Pattern, start: str, days: int, seed: int) -> DataFrame:
    def even(name: str, *by: str) -> Column:
        """Evenly between 0 and 1, both left out."""
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(number), F.lit(name), *by), F.lit(1 << 40)) + 0.5) / float(1 << 40)

    def normal(name: str, *by: str) -> Column:
        return F.sqrt(-2 * F.log(even(f"{name}-r", *by))) * F.cos(2 * 3.141592653589793 * even(f"{name}-a", *by))

    step, size = F.col("step"), F.col("size")
    groups = spark.range(p.groups).withColumnRenamed("id", "g")
    groups = groups.select("g", F.floor(p.size[0] + even("size", "g") * (p.size[1] - p.size[0] + 1)).alias("size"), (even("start", "g") * days * 24).alias("first"), (even("reported", "g") < p.reported).alias("reported"))
    steps = {"loop": size * p.laps, "funnel": size, "noise": size * p.laps}[p.kind]
    rows = groups.select("*", F.explode(F.sequence(F.lit(0).cast("long"), steps - 1)).alias("step"))
    other = lambda a: (a + 1 + F.floor(even("to", "g", "step") * (size - 1))) % size
    payer = {"loop": step % size, "funnel": (step + 1) % size, "noise": F.floor(even("from", "g", "step") * size)}[p.kind]
    payee = {"loop": (step + 1) % size, "funnel": F.when(step < size - 1, 0).otherwise(size), "noise": other(payer)}[p.kind]
    amount = p.median * F.exp(p.spread * normal("amount", "g", *([] if p.kind == "loop" else ["step"])))
    if p.kind == "loop":
        amount = amount * F.pow(F.lit(1 - p.fee), step)
    if p.kind == "funnel":
        amount = F.when(step < size - 1, amount).otherwise(p.median * (size - 1) * (1 - p.fee))
    hours = F.col("first") + p.gap_hours * (step - F.log(even("gap", "g", "step")))
    name = lambda x: F.format_string(f"ACC-{number}-%d-%d", "g", x.cast("long"))
    foreign = F.element_at(F.array(*map(F.lit, HIGH_RISK_DESTINATIONS)), (1 + F.floor(even("country", "g", "step") * len(HIGH_RISK_DESTINATIONS))).cast("int"))
    return rows.select(
        F.format_string(f"SYN-{number}-%d-%d", "g", "step").alias("txn_id"), F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + F.floor(3600 * hours)).alias("timestamp"), name(payer).alias("source_account"), name(payee).alias("destination_account"),
        F.greatest(amount, F.lit(0.01)).cast("decimal(18,2)").alias("amount"), F.lit("GB").alias("source_country"), F.when(even("abroad", "g", "step") < p.abroad, foreign).otherwise("GB").alias("destination_country"), F.col("reported").cast("int").alias("sar_linked"))
