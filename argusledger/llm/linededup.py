"""Line dedup by content-defined line chunks, native DataFrame functions only.

A text's lines (split at newlines) are hashed; where a rolling hash over two line hashes is divisible by
``divisor`` a chunk ends, unless one would end a line before or the text ends a line after: so a chunk has two lines or
more, and inserted or deleted lines move just the boundaries beside them.  Chunks of two lines or more whose bytes
occur again are removed, all but the first (smallest doc_id, then MD5 of the text, then place).
Hashes only find candidates, counted before any text is shuffled: just the candidates are grouped by their bytes.

Edge cases: a null text has no lines and keeps the empty text; an empty text is one empty line; rows equal in doc_id and
text are one document (all stay, or lose, the same lines); rows that share a doc_id, or have none, but differ in text are
documents of their own; a text of one line is always kept; an empty table gives an empty one.  Other columns, of any names,
pass through; input columns named ``ld_lines`` or ``ld_removed`` are replaced.

Chunks leave repeated passages behind where a boundary outside the passage decides.  ``dedup_passages`` has no boundaries:
a line goes if it lies in a passage of two lines or more that occurred before, in an earlier place that it doesn't overlap.
Pairs of neighbouring lines decide it, as every longer passage is made of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argusledger.llm.common import Shield, cut, drop_cut, skew_join

DIVISOR, _PRIME = 4, 1_000_003


def _lines() -> Column:
    return F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(F.split("text", "\n", -1))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``mark``: with the doc_id it names a document, whatever other rows share its doc_id."""
    return docs.withColumn("mark", F.unhex(F.md5(F.col("text").cast("binary"))))


def _with_chunks(docs: DataFrame, divisor: int) -> DataFrame:
    """Adds ``lines`` and ``ends``, the last line of each chunk."""
    line_hash = lambda x: F.conv(F.left(F.md5(x.cast("binary")), F.lit(7)), 16, 10).cast("long")
    out = docs.withColumn("lines", _lines()).withColumn("hash", F.transform("lines", line_hash))
    raw = F.transform("hash", lambda h, i: (i > 0) & ((F.get("hash", i - 1) * 31 + h) % _PRIME % divisor == 0))
    out = out.withColumn("raw", raw).drop("hash")
    last = F.size("raw") - 1
    every = F.when(last < 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), last))
    ends = F.filter(every, lambda i: (i == last) | ((i < last - 1) & F.get("raw", i) & ~F.get("raw", i - 1)))
    return out.withColumn("ends", ends).drop("raw")


def _begin(at: Column) -> Column:
    return F.when(at == 0, F.lit(0)).otherwise(F.get("ends", at - 1) + 1)


def _chunk(i: Column) -> Column:
    return F.array_join(F.slice(F.col("lines"), _begin(i) + 1, F.get("ends", i) - _begin(i) + 1), "\n")


def _same_document(left: str = "doc_id", right: str = "id2") -> Column:
    return F.col(left).eqNullSafe(F.col(right)) & (F.col("mark") == F.col("mark2"))


def repeated_chunks(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """(doc_id, mark, place) of every chunk that is removed."""
    own = _keyed(docs.select("doc_id", "text"))
    places = F.filter(F.transform("ends", lambda end, i: F.struct(i.alias("place"), (end - _begin(i) + 1).alias("n"), F.xxhash64(_chunk(i)).alias("h"))), lambda c: c.n > 1)
    hashes = cut(_with_chunks(own, divisor).select("doc_id", "mark", F.explode(places).alias("c")).select("doc_id", "mark", "c.place", "c.h"))
    often = cut(hashes.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    # A hot hash is broadcast, so no task gets its rows.
    found = skew_join(hashes, often.withColumn("often", F.lit(True)), "h", "n").filter("often")
    asked = found.groupBy(F.col("doc_id").alias("id2"), F.col("mark").alias("mark2")).agg(F.collect_set("place").alias("asked"))
    # "merge": texts are shuffled in the same way at every size.
    rows = _with_chunks(own.join(asked.hint("merge"), _same_document()), divisor)
    rows = cut(rows.select("doc_id", "mark", F.explode(F.transform("asked", lambda i: F.struct(i.alias("place"), _chunk(i).alias("chunk")))).alias("c")).select("doc_id", "mark", "c.place", "c.chunk"))
    # Grouped by the chunk itself: this compares bytes, and a chunk of very many rows is summed up before the shuffle.
    same = rows.groupBy("chunk").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "place")).alias("first")).filter("n > 1")
    same = cut(same.select(F.sha2("chunk", 256).alias("digest"), "n", "first"))
    marked = skew_join(rows.select("doc_id", "mark", "place", F.sha2("chunk", 256).alias("digest")), same, "digest", "n")
    out = cut(marked.filter(F.col("first").isNotNull() & ~F.struct("doc_id", "mark", "place").eqNullSafe(F.col("first"))).select("doc_id", "mark", "place").distinct())
    for done in (hashes, often, rows, same):
        drop_cut(done)
    return out


def _pair_rows(docs: DataFrame) -> DataFrame:
    """Each line with the next: doc_id, mark, place (of the first) and the two lines' SHA-256, so that no text is shuffled."""
    rows = _keyed(docs.select("doc_id", "text")).select("doc_id", "mark", _lines().alias("lines"))
    pairs = F.transform(F.slice("lines", F.lit(1), F.greatest(F.size("lines") - 1, F.lit(0))), lambda x, i: F.struct(i.alias("place"), F.unhex(F.sha2(F.concat(x, F.lit("\n"), F.get("lines", i + 1)), 256)).alias("digest")))
    return rows.select("doc_id", "mark", F.explode(pairs).alias("c")).select("doc_id", "mark", "c.place", "c.digest")


def repeated_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, place) of every pair of lines that is removed."""
    rows = _pair_rows(docs)
    same = cut(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "place")).alias("first")).filter("n > 1"))
    found = skew_join(rows, same, "digest", "n").filter(F.col("first").isNotNull())
    here = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    # The first itself, or the pair that overlaps it.
    return found.filter(~(here & F.col("place").between(F.col("first.place"), F.col("first.place") + 1))).select("doc_id", "mark", "place")


def _with_gone(docs: DataFrame, gone: DataFrame) -> tuple[Shield, DataFrame]:
    """``docs`` shielded, with the array ``gone`` of each document's removed places."""
    own = Shield(docs, "doc_id", "text")
    per = gone.groupBy(F.col("doc_id").alias("id2"), F.col("mark").alias("mark2")).agg(F.collect_set("place").alias("gone"))
    both = _keyed(own.df).join(per.hint("merge"), _same_document(), "left").drop("id2", "mark2")
    return own, both.withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))


def _finish(own: Shield, out: DataFrame) -> DataFrame:
    out = out.withColumns({"text": F.array_join("kept", "\n"), "n_lines": F.size("lines").cast("long"), "n_removed": (F.size("lines") - F.size("kept")).cast("long")})
    return own.back(out, {"ld_lines": "n_lines", "ld_removed": "n_removed"})


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """``docs`` with ``text`` less the removed chunks, and ``ld_lines`` and ``ld_removed``, counts of lines."""
    own, out = _with_gone(docs, repeated_chunks(Shield(docs, "doc_id", "text").df, divisor))
    out = _with_chunks(out, divisor)
    places = F.when(F.size("ends") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size("ends") - 1))
    kept = F.filter(places, lambda i: ~F.array_contains("gone", i))
    pieces = F.transform(kept, lambda i: F.slice(F.col("lines"), _begin(i) + 1, F.get("ends", i) - _begin(i) + 1))
    return _finish(own, out.withColumn("kept", F.flatten(pieces)))


def dedup_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` less the repeated passages, and ``ld_lines`` and ``ld_removed``, counts of lines."""
    own, out = _with_gone(docs, repeated_pairs(Shield(docs, "doc_id", "text").df))
    out = out.withColumn("lines", _lines())
    every = F.when(F.size("lines") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size("lines") - 1))
    left = F.array_except(every, F.concat("gone", F.transform("gone", lambda i: i + 1)))
    return _finish(own, out.withColumn("kept", F.transform(left, lambda i: F.get("lines", i))))


def report(docs: DataFrame, dedup=dedup_lines) -> DataFrame:
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


#: DuckDB SQL for op3.
SQL = rf"""
with d as (select distinct doc_id, text from documents where text is not null),
l as (select doc_id, text, md5(text) as mark, string_split(text, chr(10)) as lines from d),
h as (
  select doc_id, mark, lines, list_transform(lines, lambda x: cast('0x' || left(md5(x), 7) as bigint)) as hs from l),
q as (
  select doc_id, mark, n, i, line, i > 1 and (hs[i - 1] * 31 + hs[i]) % {_PRIME} % {DIVISOR} = 0 as raw
  from (select doc_id, mark, hs, len(lines) as n, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as i from h)),
r as (
  select doc_id, mark, i, line, case when i = n or (i < n - 1 and raw and not coalesce(lag(raw) over (partition by doc_id, mark order by i), false)) then 1 else 0 end as fin from q),
p as (
  select doc_id, mark, i, line, coalesce(sum(fin) over (partition by doc_id, mark order by i rows between unbounded preceding and 1 preceding), 0) as place from r),
c as (
  select doc_id, mark, place, count(*) as n, string_agg(line, chr(10) order by i) as chunk from p group by 1, 2, 3),
m as (
  select *, case when n > 1 then row_number() over (partition by n > 1, chunk order by doc_id nulls first, mark, place) else 1 end as rn from c),
k as (
  select doc_id, mark, sum(n) as n_lines, sum(case when rn > 1 then n else 0 end) as n_removed,
    string_agg(case when rn = 1 then chunk end, chr(10) order by place) as kept
  from m group by 1, 2)
select documents.doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents left join k on k.doc_id is not distinct from documents.doc_id and k.mark = md5(documents.text)
"""

#: DuckDB SQL for op3_line_passages.
PASSAGES_SQL = """
with l as (
  select distinct doc_id, md5(text) as mark, string_split(text, chr(10)) as lines from documents where text is not null),
p as (
  select doc_id, mark, unnest(lines) as line, unnest(range(0, len(lines))) as i from l),
w as (
  select *, lead(line) over (partition by doc_id, mark order by i) as line2 from p),
f as (
  select doc_id, mark, i, first_value(doc_id) over o as doc0, first_value(mark) over o as mark0, first_value(i) over o as i0
  from w where line2 is not null window o as (partition by line, line2 order by doc_id nulls first, mark, i)),
b as (
  select doc_id, mark, i from f where doc_id is distinct from doc0 or mark <> mark0 or i - i0 >= 2),
g as (
  select doc_id, mark, i from b union select doc_id, mark, i + 1 from b),
k as (
  select p.doc_id, p.mark, count(*) as n_lines, count(g.i) as n_removed,
    string_agg(case when g.i is null then line end, chr(10) order by p.i) as kept
  from p left join g on g.doc_id is not distinct from p.doc_id and g.mark = p.mark and g.i = p.i group by 1, 2)
select documents.doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents left join k on k.doc_id is not distinct from documents.doc_id and k.mark = md5(documents.text)
"""
