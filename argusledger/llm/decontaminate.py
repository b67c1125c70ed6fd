"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are runs of digits, ASCII letters (A-Z lower-cased) and non-ASCII characters.  An item's windows are
its n-grams; an item of fewer words, but not none, is one window.  A document's windows are looked up by
hash and each hit is verified byte by byte.

Edge cases: a null or empty text has no words and no hit; items with null id or no words are ignored;
repeated items count once; repeated documents are judged row by row, whatever their doc_ids; an empty benchmark hits nothing,
an empty table gives an empty one.  Other columns, of any names, pass through; input columns named ``dc_n_words``,
``dc_n_hit`` or ``dc_items`` are replaced.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argusledger.functions.tables import small
from argusledger.llm.common import WORD, Shield, Words, chunks, cut, grams, release

#: Benchmark text that is broadcast at once.  A larger benchmark is scanned in blocks of about this size.
BLOCK_BYTES = 16 << 20
_BITS = 22


class Windows:
    """All windows of one length: hashes in ascending order, where each window's words lie in ``text``, and whose they are.

    Arrays only: 28 bytes a window besides the benchmark's text.
    """

    def __init__(self, size: int, text: np.ndarray, items: list[str], hashes, starts, ends, owners):
        order = np.argsort(hashes, kind="stable")
        self.size, self.text, self.items = size, text, items
        self.keys, self.starts, self.ends, self.owners = hashes[order], starts[order], ends[order], owners[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.keys >> np.uint64(64 - _BITS)] = True

    def owners_of(self, h: np.uint64, words: bytes) -> frozenset[str]:
        """Items that have just these words (parted by one space) as a window."""
        lo, hi = np.searchsorted(self.keys, h, "left"), np.searchsorted(self.keys, h, "right")
        return frozenset(self.items[self.owners[i]] for i in range(lo, hi) if self.text[self.starts[i] : self.ends[i]].tobytes() == words)


def _item_block(items, n: int) -> list[Windows]:
    """The windows of items (id, text), by length.  The texts are kept as their words, parted by one space."""
    names: list[str] = []
    texts: list[np.ndarray] = []
    by_length: dict[int, list] = {}
    at = 0
    for item, text in items:
        w = Words(pa.array([text], pa.string()), WORD, lower=True)
        count = len(w.starts)
        if not count:
            continue
        size = min(n, count)
        text = np.frombuffer(b" ".join(w.raw[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)), np.uint8)
        edge = at + np.concatenate([[0], np.cumsum(w.ends - w.starts + 1)])  # where each word starts
        windows = count - size + 1
        by_length.setdefault(size, []).append((grams(w.hash, size), edge[:windows], edge[size:] - 1, np.full(windows, len(names), np.int32)))
        texts += [text, np.frombuffer(b" ", np.uint8)]
        at += len(text) + 1
        names.append(item)
    whole = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
    return [Windows(size, whole, names, *(np.concatenate(x) for x in zip(*parts, strict=True))) for size, parts in by_length.items()]


def _mark(words: Words, block: list[Windows]) -> tuple[np.ndarray, list[set[str]]]:
    """Which words are inside a window, and each text's items."""
    n = len(words.starts)
    inside = np.zeros(n + 1, np.int64)
    found: list[set[str]] = [set() for _ in range(len(words.off) - 1)]
    for own in block:
        size, keys = own.size, own.keys
        g = grams(words.hash, size)
        at = np.flatnonzero(own.seen[g >> np.uint64(64 - _BITS)])
        if not len(at):
            continue
        slot = np.minimum(np.searchsorted(keys, g[at]), len(keys) - 1)
        at = at[keys[slot] == g[at]]
        doc = np.searchsorted(words.span, at, "right") - 1
        ok = at + size <= words.span[doc + 1]
        known: dict[tuple[int, bytes], frozenset[str]] = {}
        for i, d in zip(at[ok].tolist(), doc[ok].tolist(), strict=True):
            h = int(g[i])
            region = words.raw[words.starts[i] : words.ends[i + size - 1]].tobytes()
            if (h, region) not in known:
                text = b" ".join(words.raw[words.starts[j] : words.ends[j]].tobytes() for j in range(i, i + size))
                known[h, region] = own.owners_of(g[i], text)
            items = known[h, region]
            if items:
                inside[i] += 1
                inside[i + size] -= 1
                found[d] |= items
    return np.cumsum(inside[:-1]) > 0, found


def _without(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> str:
    """The text less the bytes from the first to the last word of each run of hit words."""
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    out, at = [], 0
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        out.append(raw[at : starts[a]].tobytes())
        at = ends[b - 1]
    out.append(raw[at:].tobytes())
    return b"".join(out).decode("utf-8")


_STATE = ("m_words", "m_hits", "m_items")


def _scan(shared, text_col: str, hits_only: bool = False):
    """Adds what this block marks to the state; ``hits_only`` gives the rows that it marks alone, without their texts."""

    def run(batches):
        block = shared.value
        for batch in batches:
            for part in chunks(batch, text_col):
                w = Words(part.column(text_col), WORD, lower=True)
                hit, found = _mark(w, block)
                total = np.concatenate([[0], np.cumsum(hit)])
                counts = w.span[1:] - w.span[:-1]
                hits = total[w.span[1:]] - total[w.span[:-1]]
                marks, names = ([x or [] for x in part.column(c).to_pylist()] for c in ("m_hits", "m_items"))
                at = np.flatnonzero(hits)
                for d in at.tolist():
                    marks[d].append(np.packbits(hit[w.span[d] : w.span[d + 1]]).tobytes())
                    names[d] = sorted(found[d].union(names[d]))
                columns = {c: part.column(c) for c in part.schema.names if c not in _STATE and not (hits_only and c == text_col)}
                columns["m_words"] = pa.array(counts, pa.int64())
                columns["m_hits"] = pa.array(marks, pa.list_(pa.binary()))
                columns["m_items"] = pa.array(names, pa.list_(pa.string()))
                out = pa.RecordBatch.from_pydict(columns)
                yield out.take(pa.array(at)) if hits_only else out
        release()

    return run


def _either(marks: list[bytes], count: int) -> np.ndarray:
    """Words that any of the bit sets marks."""
    out = np.zeros(count, bool)
    for m in marks:
        out |= np.unpackbits(np.frombuffer(m, np.uint8), count=count).astype(bool)
    return out


def _finish(text_col: str, excise: bool, names: list[str]):
    def run(batches):
        for batch in batches:
            for part in chunks(batch, text_col):
                marks, items = part.column("m_hits").to_pylist(), part.column("m_items").to_pylist()
                counts = part.column("m_words").to_pylist()
                hit = [int(_either(m, c).sum()) if m else 0 for m, c in zip(marks, counts, strict=True)]
                columns = {c: part.column(c) for c in names}
                if excise and any(hit):
                    texts = part.column(text_col).to_pylist()
                    for d in (i for i, x in enumerate(hit) if x):
                        one = pa.array([texts[d]], pa.string())
                        w = Words(one, WORD, lower=True, hashed=False)
                        raw = np.frombuffer(texts[d].encode(), np.uint8)
                        texts[d] = _without(raw, w.starts, w.ends, _either(marks[d], counts[d]))
                    columns[text_col] = pa.array(texts, pa.string())
                columns["m_n_words"] = pa.array(counts, pa.int64())
                columns["m_n_hit"] = pa.array(hit, pa.int64())
                columns["m_found"] = pa.array([x or [] for x in items], pa.list_(pa.string()))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def annotate(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", excise: bool = False) -> DataFrame:
    """``docs`` with ``dc_n_words``, ``dc_n_hit`` and ``dc_items`` (sorted ids of items with occurring windows).

    ``excise`` cuts hit spans out of the text.  The benchmark is broadcast in blocks of bounded size.  One block is one narrow pass
    over the documents: nothing is shuffled.  Of several, each but the last reads the texts and writes marks of the rows it hits
    (a bit a word); the marks are joined to the documents once, by a row number, and the last pass does the rest.
    """
    spark = docs.sparkSession
    own = Shield(docs, text_col)
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).filter("i is not null and t is not null")
    total = items.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    nothing = {"m_words": F.lit(0).cast("long"), "m_hits": F.lit(None).cast("array<binary>"), "m_items": F.lit(None).cast("array<string>")}

    def block(b: int):
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        return spark.sparkContext.broadcast(_item_block(((r.i, r.t) for r in mine.toLocalIterator()), n))

    if blocks == 1:
        out = own.df.withColumns(nothing)
    else:
        base, marks = cut(own.df.withColumn("m_id", F.monotonically_increasing_id())), None
        for b in range(blocks - 1):
            shared = block(b)
            mine = cut(base.select("m_id", text_col).withColumns(nothing).mapInArrow(_scan(shared, text_col, True), "m_id long, m_words long, m_hits array<binary>, m_items array<string>"))
            shared.unpersist()
            marks = mine if marks is None else marks.unionByName(mine)
        # At most a set for each block of the benchmark.
        each = marks.groupBy("m_id").agg(F.flatten(F.collect_list("m_hits")).alias("m_hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("m_items")))).alias("m_items"))
        out = base.join(small(each), "m_id", "left").select(*own.inner, nothing["m_words"].alias("m_words"), "m_hits", "m_items")
    scan = _scan(block(blocks - 1), text_col)
    schema = T.StructType([*own.df.schema.fields, T.StructField("m_n_words", T.LongType()), T.StructField("m_n_hit", T.LongType()), T.StructField("m_found", T.ArrayType(T.StringType()))])
    finish = _finish(text_col, excise, own.inner)
    return own.back(out.mapInArrow(lambda batches: finish(scan(batches)), schema), {"dc_n_words": "m_n_words", "dc_n_hit": "m_n_hit", "dc_items": "m_found"})


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents", text_col: str = "text") -> DataFrame:
    """``docs`` less every document with a hit, or (``remove="spans"``) less the hit spans of their texts."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove!r}")
    own = Shield(docs, text_col)
    out = annotate(own.df, benchmark, n, text_col, excise=remove == "spans")
    return own.back(out.filter("dc_n_hit = 0") if remove == "documents" else out)


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """One row per document: counts of words, hit words and items, a digest of the item ids, and the verdict."""
    out = annotate(docs.select("doc_id", "text"), benchmark, n)
    return out.select(
        "doc_id",
        F.col("dc_n_words").alias("n_words"),
        F.col("dc_n_hit").alias("n_hit"),
        F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("dc_items", ","), 256).alias("items_sha256"),
        (F.col("dc_n_hit") > 0).alias("contaminated"),
    )


#: DuckDB SQL for op1.
SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null and item_id is not null),
bw as (
  select distinct item_id, least(10, len(w)) as size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct size from bw),
dw as (
  select doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') as win
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d, sizes where len(w) >= size)),
hits as (select dw.doc_id, dw.size, dw.i, bw.item_id from dw join bw using (size, win)),
pos as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + size)) as p from hits) group by 1),
its as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hits) group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (doc_id) left join its using (doc_id)
"""
