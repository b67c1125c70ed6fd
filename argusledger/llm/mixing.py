"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources share the wanted words by weight; a target stops at ``cap`` times its source's size and the excess
is reshared.  The targets are turned into blocks of ``BLOCK`` words (highest quotients ``target / (2k + 1)``), first over
sources, then over each source's shards.  What whole blocks leave of a source's target, less than a block or where its shards have
no whole block, is added to or taken from its shards in their order.  Within a shard the documents, in a seeded order, form a
stream of words cut into blocks, of which the first ones are taken: because the order is seeded, they are a random choice of
documents, and only the one in which the last block ends is cut.  A quota above the stream takes the whole stream again,
``cap`` times at most.  A block's size depends on nothing in the data, so one source's choice of words doesn't change another's.

:func:`mix` shuffles (row, id, source, hash, size), never a text; :func:`mixed_documents` shuffles the texts once.  The driver
sees one row per source and per shard: at most ``MAX_SOURCES`` sources (beyond them an error is raised), and ``MAX_SHARDS``
shards plus one per source.

Edge cases: a null or empty text has no words and is taken 0 times; null sources are one source, the last; rows that share
an id, or have none, are documents of their own, dealt to shards by their text too; rows equal in id, source and text are
numbered, so that a third of all rows being copies still spreads over all shards; very long texts are one document like
any other, cut where the last block ends; an empty table mixes to nothing.  Rows equal in id, source and text are exchangeable: one
of them stands for all in the written mix, as often as they are taken.  Other columns, of any names, pass through :func:`mixed_documents`.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argusledger.llm.common import Shield, cut, drop_cut, partitions, release, row_key, scratch, small, ws_trim_count

#: Shards over all sources, besides one for each source, and the least words of a shard.
MAX_SHARDS, SHARD_WORDS = 10_000, 200_000
#: Sources that the driver plans, at most.
MAX_SOURCES = 1_000_000
#: Words of a block.
BLOCK = 512
#: Copies of one text that a task writes, at most.
COPIES = 64


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap * size``; what a cap cuts off is reshared by weight."""
    out = [0.0] * len(sizes)
    left, open_ = float(total), [i for i, s in enumerate(sizes) if s > 0]
    while open_ and left > 0:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit >= cap * sizes[i]]
        for i in full or open_:
            out[i] = float(cap * sizes[i]) if full else weights[i] * unit
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def apportion(shares: list[float], seats: int, most: list[int]) -> list[int]:
    """Sainte-Lague: seats go to the highest quotients ``share / (2 * own + 1)``, none beyond ``most``; ties to the first.

    A divisor found by bisection gives a lower allocation that the quotients contain; the rest is dealt
    one by one from a heap.
    """
    seats = min(seats, sum(most))
    at = lambda d: [min(m, int(s / d + 0.5)) for s, m in zip(shares, most, strict=True)]
    if seats <= 0 or not any(s > 0 for s in shares):
        return [0] * len(shares)
    low, high = 0.0, 2.0 * max(shares) + 1
    for _ in range(100):
        mid = (low + high) / 2
        if mid <= 0 or sum(at(mid)) > seats:
            low = mid
        else:
            high = mid
    own = at(high)
    heap = [(-s / (2 * k + 1), i) for i, (s, k, m) in enumerate(zip(shares, own, most, strict=True)) if k < m and s > 0]
    heapq.heapify(heap)
    left = seats - sum(own)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        own[i] += 1
        left -= 1
        if own[i] < most[i]:
            heapq.heappush(heap, (-shares[i] / (2 * own[i] + 1), i))
    return own


def deal(target: int, quota: int, streams: list[int], cap: int, block: int) -> list[int]:
    """Words that each shard gives, of ``target`` in all: whole blocks by Sainte-Lague, ``quota`` of them, and what is left."""
    own = [q * block for q in apportion([float(x) for x in streams], quota, [cap * x // block for x in streams])]
    left = target - sum(own)
    for i, x in enumerate(streams):
        more = min(left, cap * x - own[i]) if left > 0 else max(left, -own[i])
        own[i] += more
        left -= more
    return own


def _plan(sized: DataFrame, weights: tuple[float, ...], cap: int, share: float, seed: int) -> DataFrame:
    """One row per (source, shard) with its stream's length and the words that it gives."""
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    sizes = [r["size"] for r in totals]
    whole = sum(sizes)
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * whole, cap)
    quotas = apportion(targets, round(sum(targets) / BLOCK), [cap * -(-s // BLOCK) for s in sizes])
    per = max(SHARD_WORDS, -(-whole // MAX_SHARDS))
    rows = [(r.source, s, t, max(1, -(-s // per)), q) for r, s, t, q in zip(totals, sizes, targets, quotas, strict=True)]
    by_source = spark.createDataFrame(rows, "source string, source_size long, target double, shards long, quota long")
    dealt = sized.join(small(by_source.select(F.col("source").alias("s2"), "shards")), F.col("source").eqNullSafe(F.col("s2")))
    shards: dict[str | None, list[tuple[int, int]]] = {}
    for r in dealt.groupBy("source", _shard(seed).alias("shard")).agg(F.sum("size").alias("size")).collect():
        shards.setdefault(r.source, []).append((r.shard, r["size"]))
    plan = []
    for source, size, target, n, quota in rows:
        own = sorted(shards.get(source, []))
        given = deal(round(target), quota, [x for _, x in own], cap, BLOCK)
        plan += [(source, size, target, n, k, x, g) for (k, x), g in zip(own, given, strict=True)]
    return spark.createDataFrame(plan, "source string, source_size long, target double, shards long, shard long, stream long, given long")


def _shard(seed: int) -> Column:
    return F.pmod(F.xxhash64("id", "k1", "k2", "copy", F.lit(seed)), F.col("shards"))


_KEY = ["k1", "k2"]


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (row, a number, and k1, k2) with ``copy``, which counts the rows of equal k1 and k2, in place of ``row``.

    They are counted within the partitions that they come from, and those counts are added up: no task sees all of a group.
    """
    again = cut(rows.groupBy(*_KEY).agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    if not again.limit(1).count():
        return rows.drop("row").withColumn("copy", F.lit(0).cast("long"))
    names = [c for c in rows.columns if c != "row"]
    many = rows.join(small(again), _KEY, "left_semi").withColumn("part", F.shiftright(F.col("row"), 33))  # of monotonically_increasing_id
    many = cut(many.withColumn("copy", F.row_number().over(Window.partitionBy(*_KEY, "part").orderBy("row"))))
    counts = many.groupBy(*_KEY, "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*_KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = counts.select(*_KEY, "part", before.alias("before"))
    many = many.join(small(offset), [*_KEY, "part"]).select(*names, (F.col("copy") + F.col("before") - 1).cast("long").alias("copy"))
    return rows.select(*names).join(small(again), _KEY, "left_anti").withColumn("copy", F.lit(0).cast("long")).select(*names, "copy").unionByName(many)


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, share: float = 1.0, seed: int = 11,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id, source, size, source_size, target, taken, and where it lies in its shard's stream.

    ``taken`` counts the words that the mix takes of the document, repeats included.  ``stream`` and ``given`` are the words of the
    shard's stream and those taken of it, ``begin`` the document's first place in it: the stream is taken ``copies``
    times and its first ``extra`` words once more.
    Rows are told apart by ``k1`` and ``k2`` (the :func:`row_key` of id, source and text) and ``copy``.
    """
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), *row_key(id_col, source_col, text_col), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), ws_trim_count(F.col(text_col)).alias("size")))
    sized = cut(_numbered(rows))
    drop_cut(rows)
    plan = _plan(sized, weights, cap, share, seed)
    count = plan.groupBy("source").agg(F.max("shards").alias("shards")).select(F.col("source").alias("s1"), "shards")
    out = sized.join(small(count), F.col("source").eqNullSafe(F.col("s1"))).withColumn("shard", _shard(seed)).drop("s1", "shards")
    stream = Window.partitionBy("source", "shard").orderBy(F.xxhash64("id", "k1", "k2", "copy", F.lit(seed + 1)), "id", "k1", "k2", "copy")
    some = out.filter("size > 0").withColumn("stop", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    # Rows without words have no place in a stream, so that any number of them burdens no shard.
    out = some.unionByName(out.filter("size = 0").withColumn("stop", F.lit(0).cast("long"))).withColumn("begin", F.col("stop") - F.col("size"))
    right = plan.select(F.col("source").alias("s2"), F.col("shard").alias("shard2"), "source_size", "target", "stream", "given")
    out = out.join(small(right), F.col("source").eqNullSafe(F.col("s2")) & (F.col("shard") == F.col("shard2"))).drop("s2", "shard2")
    out = out.withColumns({"copies": F.expr("given div greatest(stream, 1)"), "extra": F.expr("given % greatest(stream, 1)")})
    part = F.least(F.greatest(F.col("extra") - F.col("begin"), F.lit(0)), F.col("size"))
    return out.withColumn("taken", (F.col("size") * F.col("copies") + part).cast("long"))


def _first_words(names: list[str]):
    """Rows with the first ``m_cut`` words of their texts."""
    import re
    from itertools import islice

    word = re.compile(r"[^\x20\x09-\x0D]+")

    def run(batches):
        for batch in batches:
            texts = []
            for text, n in zip(batch.column("text").to_pylist(), batch.column("m_cut").to_pylist(), strict=True):
                last = next(islice(word.finditer(text), n - 1, None))
                texts.append(text[: last.end()])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)
        release()

    return run


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, share: float = 1.0, seed: int = 11) -> DataFrame:
    """The mix itself: whole documents as often as they are taken, and of each shard one at most up to the word where its last block ends.

    Each row is taken as :func:`mix` plans it for just that row, whatever other rows share its doc_id and text.
    """
    own = Shield(docs, "doc_id", "text", "source")
    keyed = own.df.select("*", *row_key("doc_id", "source", "text"))
    plan = mix(own.df, weights, cap, share, seed).filter("size > 0 and (taken > 0 or copy = 1)")
    plan = cut(plan.select(*_KEY, "copy", F.expr("taken div size").alias("m_full"), F.expr("taken % size").alias("m_cut")))
    again = cut(plan.filter("copy = 1").select(*_KEY))  # keys of several rows
    full = cut(plan.groupBy(*_KEY).agg(F.sum("m_full").alias("m_full")).filter("m_full > 0"))
    some = plan.filter("m_cut > 0").select(*_KEY, "m_cut")  # a row a shard at most
    if again.limit(1).count():
        one = keyed.join(small(again), _KEY, "left_semi").groupBy(*_KEY).agg(F.first(F.struct(*own.inner)).alias("row"))
        keyed = keyed.join(small(again), _KEY, "left_anti").select(*own.inner, *_KEY).unionByName(one.select(*[F.col(f"row.{c}").alias(c) for c in own.inner], *_KEY))
    each = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("m_nth")
    rest = keyed.join(full.filter(F.col("m_full") <= COPIES), _KEY).select(*own.inner, each(F.col("m_full")))
    # A text with many copies is dealt out in rows of COPIES each before they are written.
    hot = keyed.join(small(full.filter(F.col("m_full") > COPIES)), _KEY)
    hot = hot.select(*own.inner, "m_full", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m_full - 1) div {COPIES}"))).alias("m_lot"))
    hot = hot.repartition(partitions(docs.sparkSession)).select(*own.inner, each(F.least(F.lit(COPIES).cast("long"), F.expr(f"m_full - m_lot * {COPIES}"))))
    cuts = keyed.join(small(some), _KEY).select(*own.inner, "m_cut").mapInArrow(_first_words(own.inner), own.df.schema)
    return own.back(rest.drop("m_nth").unionByName(hot.drop("m_nth")).unionByName(cuts))


def report(docs: DataFrame) -> DataFrame:
    with scratch() as made:
        out = cut(mix(docs.select("doc_id", "text", "source")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "shard"))
        made.remove(out)
    return out
