"""Substring dedup: seed and extend on winnowed anchors.

A window is ``n`` consecutive words of one document; words of windows that occur again anywhere are removed.

Seed: each window's anchor is the smallest hash among the k-grams (k about n / 2) inside it, so equal windows have
equal anchors, and about one k-gram in ten is one.  Only anchors that occur twice or more are seeds.
Join: the places of a seed meet, each with the n - k words to its left and to its right.
Extend: all places of a seed are extended at once, word by word to the left and to the right: places that agree so far
are split by their next word, so G places cost G rows and not G * G pairs.  Words are compared by their bytes
(words over ``LONG`` bytes by SHA-256).  A place whose extents to both sides agree with another's over ``n`` words or more is
a repeat there; the repeats of a document are merged to maximal ones.

Hot groups: places with the same ``n - k`` words on both sides inside one slice of the input are settled there, and the slice
sends one of them.  Seeds with more than ``OFTEN`` places (the ``HOT`` most frequent ones) aren't extended in one group: each of
their windows is a group of its own, by the BLAKE2b digest of its words, again with one row for each slice at most.

Edge cases: null and empty texts have no words; texts under ``n`` words have no window; repeated rows are separate documents,
so all of their windows repeat; rows that share a doc_id, or have none, are documents of their own; texts of any length are read
whole, those of over 2^25 words in overlapping parts; an empty table gives an empty one.  Other columns, of any names, pass through; input columns named ``sd_words``, ``sd_removed`` or ``sd_text`` are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argusledger.llm.common import NOT_SPACE, Shield, Words, chunks, cut, drop_cut, grams, mix64, partitions, release, row_key, runs

#: Bytes of text of one slice, in which repeats are settled before the shuffle: for seeds, and for their extents.
SLICE_BYTES, EXTENT_BYTES = 10 << 20, 3 << 20
#: Places of a seed that are extended as one group, and how many more frequent seeds are known everywhere.
OFTEN, HOT = 512, 1 << 21
#: Bytes of a word that is compared as it is.
LONG = 200
_SENT = "p int, kind int, k1 long, k2 long, rows binary, extra binary"
_BITS = np.uint64(26)


def _anchors(w: Words, n: int, k: int, step: int = 1 << 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each k-gram, the index of each window's anchor, and which windows lie in one text."""
    g = grams(w.hash, k)
    whole = w.whole(n)
    want, found = n - k + 1, []
    for a in range(0, len(whole), step):  # places within a step fit into the low bits
        part = g[a : min(len(g), a + step + want - 1)]
        best = ((part >> _BITS) << _BITS) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while width * 2 <= want:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if width < want:
            best = np.minimum(best[: len(best) - (want - width)], best[want - width :])
        found.append((best & ((np.uint64(1) << _BITS) - np.uint64(1))).astype(np.int64) + a)
    return g, np.concatenate(found) if found else np.zeros(0, np.int64), whole


# --- packed rows -----------------------------------------------------------------------------

_SEED = np.dtype([("key", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("at", "<u4"), ("times", "<u4")])
_SPOT = np.dtype([("key", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("at", "<u4"), ("left", "<u2"), ("words", "<u2"), ("size", "<u4"), ("times", "<u4")])
_WINDOW = np.dtype([("key", "<u8"), ("low", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("at", "<u4"), ("times", "<u4")])


def _ranges(k1: np.ndarray, k2: np.ndarray, at: np.ndarray):
    """Per document: the ascending places as ranges (start, end), as bytes."""
    if not len(at):
        return
    order = np.lexsort((at, k2, k1))
    k1, k2, at = k1[order], k2[order], at[order].astype(np.int64)
    other = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
    fresh = other | np.concatenate([[True], at[1:] > at[:-1] + 1])
    begin = np.flatnonzero(fresh)
    last = np.concatenate([begin[1:], [len(at)]]) - 1
    pairs = np.stack([at[begin], at[last] + 1], axis=1).astype("<u4")
    edge = np.concatenate([np.flatnonzero(other[begin]), [len(begin)]])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(k1[begin[a]]), int(k2[begin[a]]), pairs[a:b].tobytes()


class _Out:
    """Rows of _SENT: kind 0 is settled (a document's places), the others are packed entries on their way to part ``p``."""

    def __init__(self, bits: int):
        self.bits, self.rows = bits, [[] for _ in range(6)]

    def add(self, *values) -> None:
        for c, v in zip(self.rows, values, strict=True):
            c.append(v)

    def settled(self, k1, k2, at) -> None:
        for a, b, blob in _ranges(k1, k2, at):
            self.add((a ^ (a >> 17)) & ((1 << self.bits) - 1), 0, a, b, blob, None)

    def packed(self, kind: int, entries: np.ndarray, extra: list[bytes] | None = None) -> None:
        p = (entries["key"] >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.argsort(p, kind="stable")
        edge = runs(p[order])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own = order[a:b]
            self.add(int(p[own[0]]), kind, None, None, entries[own].tobytes(), pa.compress(b"".join([extra[i] for i in own.tolist()]), "zstd", asbytes=True) if extra is not None else None)

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.rows, kinds, strict=True)], names=["p", "kind", "k1", "k2", "rows", "extra"])
        self.rows = [[] for _ in range(6)]
        return out


def _keys(part: pa.RecordBatch, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(part.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("k1", "k2"))


def _same(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows together, and the edges of their runs."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(max(0, len(order) - 1), bool)
    for c in columns:
        x = c[order]
        new |= x[1:] != x[:-1]
    return order, np.concatenate([[0], np.flatnonzero(new) + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)


# --- seeds -----------------------------------------------------------------------------------


def _find_seeds(n: int, k: int, bits: int, size: int):
    """Each slice's anchors, one entry for each; those that repeat in the slice are settled."""

    def run(batches):
        out, found, held = _Out(bits), [], 0

        def flush():
            x = np.concatenate(found)
            order, edge = _same(x["key"])
            times = np.diff(edge)
            often = order[np.repeat(times > 1, times)]
            out.settled(x["k1"][often], x["k2"][often], x["at"][often])
            first = x[order[edge[:-1]]]
            first["times"] = times
            out.packed(1, first)
            return out.batch()

        for batch in batches:
            for part in chunks(batch, "text"):
                w = Words(part.column("text"), NOT_SPACE, lower=False)
                g, anchor, whole = _anchors(w, n, k)
                at = np.unique(anchor[whole])
                doc = np.searchsorted(w.span, at, "right") - 1
                x = np.zeros(len(at), _SEED)
                x["key"] = mix64(g[at])  # anchors are small hashes: mixed, they are dealt out evenly
                x["k1"], x["k2"] = _keys(part, doc)
                x["at"] = at - w.span[doc]
                found.append(x)
                held += len(w.raw)
                if held >= size:
                    yield flush()
                    found, held = [], 0
        if found:
            yield flush()
        found = []
        release()

    return run


def _parts(batches):
    """(p, its rows) of rows sorted by p: one part is held at a time.  Settled rows come as (None, batch)."""
    held, now = [], None
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        done = pa.array(np.flatnonzero(kind == 0))
        if len(done):
            yield None, batch.take(done)
        rest = batch.take(pa.array(np.flatnonzero(kind != 0)))
        p = rest.column("p").to_numpy()
        edge = runs(p)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if held and p[a] != now:
                yield now, held
                held = []
            now = p[a]
            held += rest.slice(a, b - a).select(["kind", "rows", "extra"]).to_pylist()
    if held:
        yield now, held


_FOUND = "k1 long, k2 long, places binary, seed long, times long"


def _found(ranges, seeds=(), times=()) -> pa.RecordBatch:
    rows = list(ranges)
    none = [None] * len(seeds)
    cols = ([*(r[i] for r in rows), *none] for i in range(3))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*cols, [*([None] * len(rows)), *seeds], [*([None] * len(rows)), *times]], (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["k1", "k2", "places", "seed", "times"])


def _settled(batch: pa.RecordBatch) -> pa.RecordBatch:
    none = pa.nulls(batch.num_rows, pa.int64())
    return pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), batch.column("rows"), none, none], names=["k1", "k2", "places", "seed", "times"])


def _join_seeds(often: int):
    """Documents' places of the anchors that repeat, and the frequent ones with their counts."""

    def run(batches):
        for p, rows in _parts(batches):
            if p is None:
                yield _settled(rows)
                continue
            x = np.concatenate([np.frombuffer(r["rows"], _SEED) for r in rows])
            order, edge = _same(x["key"])
            total = np.add.reduceat(x["times"][order].astype(np.int64), edge[:-1])
            mine = order[np.repeat(total > 1, np.diff(edge))]
            mine = mine[x["times"][mine] == 1]
            hot = total > often
            yield _found(_ranges(x["k1"][mine], x["k2"][mine], x["at"][mine]), x["key"][order[edge[:-1][hot]]].view(np.int64).tolist(), total[hot].tolist())
        release()

    return run


# --- extents ---------------------------------------------------------------------------------


def _normal(w: Words) -> tuple[bytes, np.ndarray]:
    """All words, each with a space after it, and where each starts (one more)."""
    size = w.ends - w.starts
    if len(size) and int(size.max()) > LONG:
        words = [w.raw[a:b].tobytes() for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]
        words = [x if len(x) <= LONG else b"\0" + hashlib.sha256(x).hexdigest().encode() for x in words]
        return b" ".join([*words, b""]), np.concatenate([[0], np.cumsum([len(x) + 1 for x in words])])
    off = np.concatenate([[0], np.cumsum(size + 1)])
    out = w.raw[np.minimum(np.repeat(w.starts - off[:-1], size + 1) + np.arange(off[-1]), max(0, len(w.raw) - 1))]
    out[off[1:] - 1] = 0x20
    return out.tobytes(), off


def _send_extents(n: int, k: int, bits: int, shared, size: int):
    """Each slice's places of seeds with the words around them; of frequent seeds, the windows."""
    side = n - k

    def run(batches):
        hot = shared.value
        out = _Out(bits)
        spots: dict[tuple[bytes, int], list] = {}  # (words, left): key, places
        windows: dict[bytes, list] = {}
        held = 0

        def settle(groups, start, count):
            k1, k2, at = [], [], []
            for what, (_, places) in groups:
                if len(places) > 1:
                    for a, b, c in places:
                        some = range(start(what, c), start(what, c) + count(what))
                        k1 += [a] * len(some)
                        k2 += [b] * len(some)
                        at += some
            out.settled(np.array(k1, np.int64), np.array(k2, np.int64), np.array(at, np.int64))

        def flush():
            settle(spots.items(), lambda what, at: at - what[1], lambda what: max(0, what[0].count(b" ") - n + 1))
            settle(windows.items(), lambda what, at: at, lambda what: 1)
            x = np.array([(key, *places[0], left, text.count(b" "), len(text), len(places)) for (text, left), (key, places) in spots.items()], _SPOT)
            out.packed(2, x, [text for text, _ in spots])
            y = np.array([(*np.frombuffer(digest, "<u8"), *places[0], len(places)) for digest, (_, places) in windows.items()], _WINDOW)
            out.packed(3, y)
            spots.clear()
            windows.clear()
            return out.batch()

        for batch in batches:
            for part in chunks(batch, "text"):
                w = Words(part.column("text"), NOT_SPACE, lower=False)
                g, anchor, whole = _anchors(w, n, k)
                seeds = np.zeros(len(g) + 1, np.int32)
                for d, blobs in enumerate(part.column("places").to_pylist()):
                    for blob in blobs or ():
                        span = np.frombuffer(blob, "<u4").reshape(-1, 2).astype(np.int64) + w.span[d]
                        np.add.at(seeds, span[:, 0], 1)
                        np.add.at(seeds, span[:, 1], -1)
                at = np.flatnonzero(np.cumsum(seeds[:-1]) > 0)
                if not len(at):
                    continue
                text, off = _normal(w)
                key = mix64(g[at])
                often = np.zeros(len(at), bool)
                if len(hot):
                    often = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                doc = np.searchsorted(w.span, at, "right") - 1
                k1, k2 = _keys(part, doc)
                left = np.minimum(side, at - w.span[doc])
                right = np.minimum(side, w.span[doc + 1] - at - k)
                place = at - w.span[doc]
                cold = ~often & (left + k + right >= n)
                for a, b, h, x, y, c, m in zip(off[at - left][cold].tolist(), off[at + k + right][cold].tolist(), key[cold].tolist(), k1[cold].tolist(), k2[cold].tolist(), place[cold].tolist(), left[cold].tolist(), strict=True):
                    spots.setdefault((text[a:b], m), (h, []))[1].append((x, y, c))
                if often.any():
                    of = np.full(len(g), -1)
                    of[at[often]] = np.flatnonzero(often)
                    start = np.flatnonzero(whole & (of[anchor] >= 0)) if len(whole) else np.zeros(0, np.int64)
                    spot = of[anchor[start]]
                    for a, b, x, y, c in zip(off[start].tolist(), off[start + n].tolist(), k1[spot].tolist(), k2[spot].tolist(), (start - w.span[doc[spot]]).tolist(), strict=True):
                        windows.setdefault(hashlib.blake2b(text[a:b], digest_size=16).digest(), (None, []))[1].append((x, y, c))
                held += len(w.raw)
                if held >= size:
                    yield flush()
                    held = 0
        yield flush()
        release()

    return run


def _refine(cls: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Classes split by the next word."""
    return np.unique(cls * np.int64(int(code.max()) + 1 if len(code) else 1) + code, return_inverse=True)[1]


def _shared(cls: np.ndarray) -> np.ndarray:
    """Which members' classes have another member."""
    return np.bincount(cls)[cls] > 1 if len(cls) else np.zeros(0, bool)


def _extend(x: np.ndarray, texts: bytes, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, offset to the left) of every window around a place that another place of its seed has too."""
    side = n - k
    raw = np.frombuffer(texts, np.uint8)
    ends = np.flatnonzero(raw == 0x20) + 1
    offsets = np.concatenate([[0], ends]).astype("<i8")
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(texts)])
    code = pc.dictionary_encode(words).indices.to_numpy().astype(np.int64)  # by bytes
    first = np.cumsum(x["words"].astype(np.int64)) - x["words"]
    anchor, left = first + x["left"], x["left"].astype(np.int64)
    right = x["words"].astype(np.int64) - left - k
    cls = np.unique(x["key"], return_inverse=True)[1]
    for j in range(k):  # the seed itself, by its words
        leader = np.zeros(int(cls.max()) + 1, np.int64)
        leader[cls] = code[anchor + j]
        if (leader[cls] != code[anchor + j]).any():
            cls = _refine(cls, code[anchor + j])

    def spread(reach, at):
        """For each distance: members that still share their extent with another, and its class."""
        who = np.flatnonzero(_shared(cls))
        own, out = cls[who], []
        for j in range(side + 1):
            if j:
                far = reach[who] >= j
                who, own = who[far], own[far]
                own = _refine(own, code[at(who, j)])
                more = _shared(own)
                who, own = who[more], own[more]
            out.append((who, own))
        return out

    to_left = spread(left, lambda who, j: anchor[who] - j)
    to_right = spread(right, lambda who, j: anchor[who] + k + j - 1)
    found, offset = [], []
    for o in range(side + 1):
        (a, la), (b, rb) = to_left[o], to_right[side - o]
        both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        if len(both):
            hit = both[_shared(np.unique(la[ia] * np.int64(int(rb.max()) + 1) + rb[ib], return_inverse=True)[1])]
            found.append(hit)
            offset.append(np.full(len(hit), o))
    return (np.concatenate(found), np.concatenate(offset)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _join_extents(n: int, k: int):
    def run(batches):
        for p, rows in _parts(batches):
            if p is None:
                yield _settled(rows)
                continue
            spots = [r for r in rows if r["kind"] == 2]
            if spots:
                each = [np.frombuffer(r["rows"], _SPOT) for r in spots]
                texts = b"".join([pa.decompress(r["extra"], int(x["size"].sum()), "zstd", asbytes=True) for r, x in zip(spots, each, strict=True)])
                x = np.concatenate(each)
                entry, offset = _extend(x, texts, n, k)
                own = x["times"][entry] == 1  # the others are settled
                entry, offset = entry[own], offset[own]
                yield _found(_ranges(x["k1"][entry], x["k2"][entry], x["at"][entry].astype(np.int64) - offset))
            windows = [np.frombuffer(r["rows"], _WINDOW) for r in rows if r["kind"] == 3]
            if windows:
                y = np.concatenate(windows)
                order, edge = _same(y["key"], y["low"])
                mine = order[np.repeat(np.diff(edge) > 1, np.diff(edge))]
                mine = mine[y["times"][mine] == 1]
                yield _found(_ranges(y["k1"][mine], y["k2"][mine], y["at"][mine]))
        release()

    return run


def _meet(sent: DataFrame, join) -> DataFrame:
    return cut(sent.repartition(partitions(sent.sparkSession), "p").sortWithinPartitions("p").mapInArrow(join, _FOUND))


def _by_document(found: DataFrame) -> DataFrame:
    some = found.filter("places is not null")
    return some.groupBy(F.col("k1").alias("j1"), F.col("k2").alias("j2")).agg(F.collect_set("places").alias("places"))


def _same_document():
    return (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2"))


def repeats(docs: DataFrame, n: int = 35, often: int = OFTEN, slices: tuple[int, int] = (SLICE_BYTES, EXTENT_BYTES)) -> DataFrame:
    """(j1, j2, places): first words of all repeated windows, as ranges, by the :func:`row_key` of doc_id and text."""
    spark = docs.sparkSession
    k = n // 2 + 1
    bits = min(24, max(1, (4 * partitions(spark) - 1).bit_length()))
    own = docs.select(*row_key("doc_id", "text"), "text")
    seeds = _meet(own.mapInArrow(_find_seeds(n, k, bits, slices[0]), _SENT), _join_seeds(often))
    hot = seeds.filter("seed is not null").orderBy(F.desc("times"), "seed").limit(HOT).select("seed").toArrow()  # 8 bytes each
    shared = spark.sparkContext.broadcast(np.sort(hot.column("seed").to_numpy().astype(np.int64).view(np.uint64)))
    seeded = own.join(_by_document(seeds), _same_document()).select("k1", "k2", "text", "places")
    out = _meet(seeded.mapInArrow(_send_extents(n, k, bits, shared, slices[1]), _SENT), _join_extents(n, k))
    drop_cut(seeds)
    return _by_document(out)


def _rebuild(n: int):
    def run(batches):
        for batch in batches:
            words, gone, kept = [], [], []
            for text, blobs in zip(batch.column("text"), batch.column("places").to_pylist(), strict=True):
                own = (text.as_py() or "").encode().split()
                left = own
                if blobs:
                    cuts = np.zeros(len(own) + 1, np.int32)
                    for blob in blobs:
                        span = np.frombuffer(blob, "<u4").reshape(-1, 2).astype(np.int64)
                        np.add.at(cuts, span[:, 0], 1)
                        np.add.at(cuts, np.minimum(span[:, 1] + n - 1, len(own)), -1)
                    left = [own[i] for i in np.flatnonzero(np.cumsum(cuts[:-1]) == 0).tolist()]
                words.append(len(own))
                gone.append(len(own) - len(left))
                kept.append(b" ".join(left).decode())
            columns = {c: batch.column(c) for c in batch.schema.names if c not in ("text", "places")}
            yield pa.RecordBatch.from_pydict(columns | {"m_words": pa.array(words, pa.int64()), "m_removed": pa.array(gone, pa.int64()), "m_text": pa.array(kept, pa.string())})

    return run


def dedup_substrings(docs: DataFrame, n: int = 35, **options) -> DataFrame:
    """``docs`` (less ``text``) with ``sd_words``, ``sd_removed`` and ``sd_text``: kept words, joined by one space.

    ``options`` go to :func:`repeats`: they steer cost only.
    """
    own = Shield(docs, "doc_id", "text")
    keyed = own.df.select("*", *row_key("doc_id", "text"))
    both = keyed.join(repeats(own.df, n, **options), _same_document(), "left").drop("k1", "k2", "j1", "j2")
    schema = T.StructType([*[f for f in own.df.schema.fields if f.name != "text"], T.StructField("m_words", T.LongType()), T.StructField("m_removed", T.LongType()), T.StructField("m_text", T.StringType())])
    return own.back(both.mapInArrow(_rebuild(n), schema), {"sd_words": "m_words", "sd_removed": "m_removed", "sd_text": "m_text"}, drop=("text",))


def report(docs: DataFrame) -> DataFrame:
    out = dedup_substrings(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("sd_words").alias("n_words"), F.col("sd_removed").alias("n_removed"), F.sha2("sd_text", 256).alias("kept_sha256"))


#: DuckDB SQL for op6.
SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
x as (
  select rid, i, md5(array_to_string(w[i : i + 34], ' ')) as win
  from (select rid, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
r as (select rid, i from x where win in (select win from x group by win having count(*) > 1)),
g as (select distinct rid, unnest(range(i, i + 35)) as i from r),
a as (select rid, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from d),
k as (
  select a.rid, count(g.i) as n_removed, string_agg(case when g.i is null then a.word end, ' ' order by a.i) as kept
  from a left join g on a.rid = g.rid and a.i = g.i group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (rid)
"""
