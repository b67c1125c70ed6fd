"""Periodic runs of words, found by comparing a text's word ids with every shift of themselves.

A run is a stretch of words with smallest period q (words q apart are equal), of at least ``least`` words and ``exponent`` periods,
that no neighbouring word extends.  For each lag q up to n / ``exponent`` the ids are compared with themselves q places on in one
vectorised step, and true stretches of ``max((exponent - 1) * q, least - q)`` places or more are runs of period q.  A stretch that a
divisor of q explains comes out at that divisor with the same ends, so the smallest lag of each (start, end) is the period.

The work of a text grows with the square of its words: the sum of ``n - lag`` over all lags.  A text of at most ``WHOLE``
bytes is scanned where it lies, many texts in one array (each has ids of its own, so that no stretch crosses).
Longer ones are numbered once for each distinct text, and Spark deals their lag ranges of about ``RANGE`` comparisons over all
executors; their stretches are joined back by the text's hashes (:func:`row_key`).  From ``MAX_RANGES`` ranges on they are longer.

Edge cases: null and empty texts have no words and no runs; rows that repeat, or share an id, are judged each by its own text;
texts of any length are read whole; an empty table gives an empty one; other columns, of any names, pass through.  Columns named
``n_words``, ``runs`` or ``collapsed`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argusledger.llm.common import Shield, chunks, crc32_sql, cut, release, row_key, scratch, small

#: Bytes of a text that is scanned where it lies, at most; comparisons of one lag range, about; ranges of a text at most.
WHOLE, RANGE, MAX_RANGES = 1 << 16, 1 << 26, 4096
#: Words of a run, and its periods, at least.
LEAST, EXPONENT = 12, 2
_RUN = "struct<start: bigint, length: bigint, period: bigint>"
_ARROW_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def number(words: list[bytes], first: int = 0) -> tuple[list[int], int]:
    """Ids of words from ``first`` on, equal for equal words, and the next free id."""
    seen: dict[bytes, int] = {}
    ids = [first + seen.setdefault(w, len(seen)) for w in words]
    return ids, first + len(seen)


def stretches(ids: np.ndarray, ends: np.ndarray, low: int, high: int, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and lags, low <= lag < high, of stretches with that period in texts that lie one after another in ``ids``,
    longest first, ``ends`` telling where each ends.  One stretch may have several lags."""
    if len(ids) and ids.max() < 1 << 16:
        ids = ids.astype(np.uint16)  # compared twice as fast
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = np.searchsorted(-np.diff(ends, prepend=0), -exponent * np.arange(low, high), "right")  # texts with that many words
    for lag, n in zip(range(low, high), np.concatenate([[0], ends])[held].tolist(), strict=True):
        if not n:
            break
        need = max((exponent - 1) * lag, least - lag)
        equal = ids[: n - lag] == ids[lag:n]
        if np.count_nonzero(equal) < need:
            continue
        same = equal.nonzero()[0]
        edge = (same[1:] - same[:-1] != 1).nonzero()[0]
        first, last = same[np.concatenate([[0], edge + 1])], same[np.concatenate([edge, [len(same) - 1]])]
        long = last - first + 1 >= need
        if long.any():
            first, last = first[long], last[long]
            found.append((first, last + 1 + lag, np.full(len(first), lag)))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def smallest(start: np.ndarray, end: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (start, end) once with its smallest lag, by start and lag."""
    order = np.lexsort((lag, end, start))
    start, end, lag = start[order], end[order], lag[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, lag = start[new], end[new], lag[new]
    order = np.lexsort((lag, start))
    return start[order], end[order], lag[order]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words less those that a run (start, length, period) has after its first period, joined by one space."""
    if not runs:
        return b" ".join(words).decode()
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([w for w, d in zip(words, np.cumsum(depth).tolist()) if not d]).decode()


def _words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []  # bytes.split() splits at \x20 and \x09-\x0D


def _with_runs(part: pa.RecordBatch, names: list[str], words: list[list[bytes]], runs: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
    off = np.cumsum([0, *map(len, runs)]).astype(np.int32)
    flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
    kind = _ARROW_RUN.value_type
    lists = pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(kind)))
    more = [pa.array([len(w) for w in words], pa.int64()), lists, pa.array([collapse(w, r) for w, r in zip(words, runs, strict=True)], pa.string())]
    return pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *more], names=[*names, "n_words", "runs", "collapsed"])


def _scan(names: list[str], least: int, exponent: int):
    """All lags of whole texts, as many texts at once as a chunk holds."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                words = [_words(x) for x in part.column("text").to_pylist()]
                order = sorted(range(len(words)), key=lambda i: -len(words[i]))
                ids, free = np.zeros(sum(map(len, words)), np.int32), 0
                ends = np.cumsum([len(words[i]) for i in order])
                for i, end in zip(order, ends.tolist(), strict=True):
                    own, free = number(words[i], free)
                    ids[end - len(own) : end] = own
                start, end, lag = smallest(*stretches(ids, ends, 1, len(words[order[0]]) // exponent + 1, least, exponent))
                runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
                of = np.searchsorted(ends, start, "right")
                for k, s, e, q in zip(of.tolist(), start.tolist(), end.tolist(), lag.tolist(), strict=True):
                    base = int(ends[k - 1]) if k else 0
                    runs[order[k]].append((s - base, e - s, q))
                yield _with_runs(part, names, words, runs)
        release()

    return run


def _numbers(batches):
    """Word ids of long texts."""
    for batch in batches:
        for part in chunks(batch, "text"):
            ids = [np.array(number(_words(x))[0], np.int32).tobytes() for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), pa.array(ids, pa.binary())], names=["k1", "k2", "ids"])
    release()


def _range(least: int, exponent: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int32)
                got = smallest(*stretches(ids, np.array([len(ids)]), batch.column("low")[i].as_py(), batch.column("high")[i].as_py(), least, exponent))
                n = len(got[0])
                key = [pa.array(np.full(n, batch.column(c)[i].as_py()), pa.int64()) for c in ("k1", "k2")]
                yield pa.RecordBatch.from_arrays([*key, *(pa.array(x, pa.int64()) for x in (got[0], got[1] - got[0], got[2]))], names=["k1", "k2", "start", "length", "period"])
        release()

    return run


def _known(names: list[str]):
    """Texts whose runs are known."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                words = [_words(x) for x in part.column("text").to_pylist()]
                runs = [[(r["start"], r["length"], r["period"]) for r in own or []] for own in part.column("found").to_pylist()]
                yield _with_runs(part, names, words, runs)
        release()

    return run


def _cost(n: Column, exponent: int) -> Column:
    """Comparisons of all lags."""
    lags = F.floor(n / exponent)
    return lags * n - (lags * (lags + 1) / 2)


def find_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, text_col: str = "text", whole: int = WHOLE, per_range: int = RANGE) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length and period of each, by start and period) and ``collapsed``, the text
    with one period of each run."""
    own = Shield(docs.withColumnRenamed(text_col, "text") if text_col != "text" else docs, "text")
    names = own.inner
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    out = T.StructType([*own.df.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T._parse_datatype_string(f"array<{_RUN}>")), T.StructField("collapsed", T.StringType())])
    light = own.df.filter(size <= whole).mapInArrow(_scan(names, least, exponent), out)
    heavy = own.df.filter(size > whole).select("*", *row_key("text"))
    ids = heavy.select("k1", "k2", "text").mapInArrow(_numbers, "k1 long, k2 long, ids binary").dropDuplicates(["k1", "k2"])
    n = (F.octet_length("ids") / 4).cast("long")
    parts = F.greatest(F.lit(1), F.least(F.ceil(_cost(n.cast("double"), exponent) / per_range), F.lit(MAX_RANGES))).cast("long")
    ranges = ids.select("k1", "k2", "ids", F.floor(n / exponent).cast("long").alias("lags"), parts.alias("parts"))
    ranges = ranges.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    at = lambda k: F.expr(f"1 + lags * ({k}) div parts")
    ranges = ranges.select("k1", "k2", "ids", at("part").alias("low"), at("part + 1").alias("high")).repartition("k1", "k2", "low")
    found = ranges.mapInArrow(_range(least, exponent), "k1 long, k2 long, start long, length long, period long")
    found = found.groupBy("k1", "k2", "start", "length").agg(F.min("period").alias("period"))
    # A text has fewer runs than words, so a row of them is bounded by its text.
    found = cut(found.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("found")))
    known = heavy.join(small(found), ["k1", "k2"], "left").select(*names, "found").mapInArrow(_known(names), out)
    new = {"n_words": "n_words", "runs": "runs", "collapsed": "collapsed"}
    both = own.back(light.unionByName(known), new)
    return both.withColumnRenamed("text", text_col) if text_col != "text" else both


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the query's repeats: h = crc32(doc_id), g = h div 10; where h % 10 = 0, the words from g % n on repeat
    with period 1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = docs.select("doc_id", "text", h.alias("h"), F.expr("text").alias("kept"))
    plain = some.filter("h is null or h % 10 <> 0").select("doc_id", "text")
    some = some.filter("h % 10 = 0").select("doc_id", "text", F.expr("h div 10").alias("g"), words.alias("words")).withColumn("n", F.size("words").cast("long"))
    a = some.withColumn("a", F.when(F.col("n") > 0, F.expr("g % greatest(n, 1)")).otherwise(0)).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("concat(slice(words, 1, int(a)), slice(flatten(array_repeat(slice(words, int(a) + 1, int(p)), int((n - a) div p) + 1)), 1, int(n - a)))")
    return plain.unionByName(a.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text")))


def report(documents: DataFrame) -> DataFrame:
    """The contract's row of each document, its repeats planted."""
    with scratch() as made:
        out = cut(_report(documents))
        made.remove(out)
    return out


def _report(documents: DataFrame) -> DataFrame:
    runs = find_runs(planted(documents))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    told = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return told.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Of the lags only those go on whose words agree at as many places, a quarter of the lag apart, as any run must have.
SQL = f"""
with d as (select row_number() over () as r, doc_id, {crc32_sql("doc_id::varchar")} as h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
g as (select *, len(w) as n, h // 10 as g, (h // 10) % greatest(len(w), 1) as a from d),
p as (select *, 1 + (n - a) // (3 + g % 8) as p from g),
t as (select r, doc_id, n, case when h % 10 = 0 and n > 0 then w[:a] || [w[1 + a + i % p] for i in range(n - a)] else w end as w from p),
words as (select r, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from t),
lags as (select r, n, unnest(range(1, n // 2 + 1)) as q from t),
places as (select r, q, unnest(range(0, n - q, greatest(1, q // 4))) as i from lags),
hopeful as (select l.r, l.q from places l join words x on x.r = l.r and x.i = l.i join words y on y.r = l.r and y.i = l.i + l.q and y.word = x.word
  group by l.r, l.q having count(*) >= greatest(l.q, 12 - l.q) // greatest(1, l.q // 4)),
equal as (select c.r, c.q, x.i, x.i - row_number() over (partition by c.r, c.q order by x.i) as k from hopeful c join words x on x.r = c.r join words y on y.r = c.r and y.i = x.i + c.q and y.word = x.word),
stretch as (select r, q, min(i) as s, max(i) + 1 + q as e from equal group by r, q, k having count(*) >= greatest(q, 12 - q)),
runs as (select r, s, e - s as m, min(q) as q from stretch group by r, s, e),
told as (select r, count(*) as n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' order by s, q) as lines from runs group by r),
best as (select * from runs qualify row_number() over (partition by r order by m desc, s, q) = 1),
kept as (select w.r, string_agg(w.word, ' ' order by w.i) as text from words w where not exists (select 1 from runs u where u.r = w.r and w.i >= u.s + u.q and w.i < u.s + u.m) group by w.r)
select t.doc_id, coalesce(told.n_runs, 0)::bigint as n_runs, b.s::bigint as start, b.m::bigint as length, b.q::bigint as period, (1000 * b.m // b.q)::bigint as exponent_milli,
  sha256(coalesce(told.lines, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
from t left join told using (r) left join best b using (r) left join kept using (r)
"""
