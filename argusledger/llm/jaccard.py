"""Exact n-gram Jaccard self-join with set-relation skipping, and the components of its links.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; fewer words: the whole sequence as one).
Documents with equal sets are one class, named by a hash of the set; links between classes have a Jaccard
similarity of at least ``percent`` / 100, which is tested on whole sets.

1. Order: shingles that occur in many classes (the most frequent ones, counted over all documents) come last,
   the others by hash.  The order steers cost only; any order gives the same links.
2. Index: similar sets share a shingle in their prefixes, so only prefixes are listed, with set size and position.
   Lists are sorted by size and cut into blocks; a block whose best position cannot reach the overlap is skipped.  A long
   list is crossed in pairs of larger blocks, skipped alike, each pair a row of its own, so that no task has a list's square.
3. First answers: in each list a set is paired with the list's leader of its size group, then, in rounds, with a few
   sets of other components; each set's most promising partners are verified, and the links' components follow.  The
   rounds end when they find little.
4. Derived answers: only pairs of different components are left.  A leader's overlap with another leader bounds the
   overlaps of the sets that resemble the two: overlap(x, y) <= overlap(lx, ly) + |x - lx| + |y - ly|.  Pairs that
   the bound cannot settle are verified one by one.

:func:`links` returns enough links to connect whatever the join connects; :func:`all_links` returns every link between classes,
and :func:`link_counts` each row's class and its number of links.

Edge cases: null or empty texts and texts without words have the empty set and are linked with nothing; rows
that share a doc_id are documents of their own, each in the component of its own text; a null doc_id is returned with its
component's smallest doc_id, null if it has none; a text of any length is one set of all its shingles; an empty table gives an empty
one.  Only doc_id and text are read, so
other columns may have any names.  Classes are named by a 64-bit hash of the set; a second one tests the names, and where
two sets share a name all are named anew with another seed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argusledger.functions.tables import BROADCAST_ROWS, cut, drop_cut, partitions, scratch, skew_join, small
from argusledger.llm.common import NOT_SPACE, Shield, Words, chunks, grams, mix64, release, row_key, runs
from argusledger.operators.graph import connected_components

#: Frequent shingles that the order knows (the most frequent ones), and how frequent one must be.
FREQUENT, OFTEN = 1 << 19, 12
#: Shingles that a task gathers before it sends them on.
SLICE = 800_000
#: Sets of one leader that one task compares.
GROUP = 250
#: Rounds of first answers, at most; what they leave is settled in the last step.
ROUNDS = 6
_BLOCK = 64
#: A list with more entries is crossed in pairs of blocks of this size, each pair by itself.
LONG = 1 << 13
#: Pairs up to so many are broadcast as they are (under 20 MB), without the jobs and shuffles that more of them need: each
#: task and each plan costs the driver memory.
FEW = 200_000


def _sets(batches, n: int):
    """(row batch, index, distinct shingle hashes in ascending order) of each text."""
    for batch in batches:
        for part in chunks(batch, "text"):
            w = Words(part.column("text"), NOT_SPACE, lower=True)
            g = grams(w.hash, n)
            lo, hi = w.span[:-1].tolist(), w.span[1:].tolist()
            for d, (a, b) in enumerate(zip(lo, hi, strict=True)):
                if b - a >= n:
                    x = np.sort(g[a : b - n + 1])
                    if len(x) > 1:
                        x = x[np.concatenate([[True], x[1:] != x[:-1]])]
                elif b > a:
                    x = mix64(grams(w.hash[a:b], b - a) + np.uint64(b - a))
                else:
                    x = np.zeros(0, np.uint64)
                yield part, d, x


def _node(x: np.ndarray, seed: int = 0) -> int:
    """The class of a set (ascending, distinct)."""
    h = xxhash.xxh3_64_intdigest(x, seed)
    return h - (1 << 64) if h >> 63 else h


#: Seeds of the class names that are tried, and of the hash that tests them.
_SEEDS, _TEST = (0, 1, 2, 3), 1_000_003


def _classes(batches, n: int, seed: int = 0):
    """(node, shingles), each class once a task."""
    seen: set[int] = set()
    for _, _, x in _sets(batches, n):
        if len(x):
            node = _node(x, seed)
            if node not in seen:
                seen.add(node)
                yield node, x
    release()


def _members(n: int, seed: int = 0, keep: tuple[str, ...] = ()):
    """Each row's doc_id, size, class and test, and its columns ``keep`` (long)."""

    def run(batches):
        ids: list = []
        kept: list[list] = [[] for _ in keep]
        nodes: list[int] = []
        sizes: list[int] = []
        tests: list[int] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, sizes, nodes, tests, *kept)], names=["doc_id", "n_shingles", "node", "test", *keep])
        last = None
        for part, d, x in _sets(batches, n):
            if part is not last:
                last, own, others = part, part.column("doc_id").to_pylist(), [part.column(c).to_pylist() for c in keep]
            ids.append(own[d])
            for c, x_ in zip(kept, others, strict=True):
                c.append(x_[d])
            nodes.append(_node(x, seed))
            tests.append(_node(x, _TEST))
            sizes.append(len(x))
            if len(ids) >= 20_000:
                yield flush()
                ids, nodes, sizes, tests, kept = [], [], [], [], [[] for _ in keep]
        yield flush()

    return run


# --- 1: the order ----------------------------------------------------------------------------


def _count(n: int, bits: int):
    """Fingerprints of all shingles and how often this slice has them, dealt out by their top bits."""

    def flush(held):
        h = np.sort(np.concatenate(held)) >> np.uint64(32 - bits)
        edge = runs(h)
        key, times = h[edge[:-1]], np.minimum(np.diff(edge), 65535).astype(np.uint16)
        p = (key >> np.uint64(32)).astype(np.int64)
        cuts = runs(p)
        out = [[], [], [], []]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            many = np.flatnonzero(times[a:b] > 1)
            for c, x in zip(out, (int(p[a]), key[a:b].astype(np.uint32).tobytes(), many.astype(np.uint32).tobytes(), times[a:b][many].tobytes()), strict=True):
                c.append(x)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(x, pa.binary()) for x in out[1:]]], names=["p", "keys", "many", "times"])

    def run(batches):
        held, size = [], 0
        for _, x in _classes(batches, n):
            held.append(x)
            size += len(x)
            if size >= SLICE:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _by_part(batches, columns):
    """p and its rows' values, of rows sorted by p: one part is held at a time."""
    held, now = [], None
    for batch in batches:
        cols = [batch.column(c) for c in columns]
        for i, p in enumerate(batch.column("p").to_pylist()):
            if p != now and held:
                yield now, held
                held = []
            now = p
            held.append([c[i].as_py() for c in cols])
    if held:
        yield now, held
    held = []
    release()


def _frequent(batches):
    for p, rows in _by_part(batches, ("keys", "many", "times")):
        keys = np.concatenate([np.frombuffer(r[0], np.uint32) for r in rows])
        times = np.ones(len(keys), np.int64)
        at = 0
        for r in rows:
            times[at + np.frombuffer(r[1], np.uint32).astype(np.int64)] = np.frombuffer(r[2], np.uint16)
            at += len(r[0]) // 4
        order = np.argsort(keys, kind="stable")
        edge = runs(keys[order])
        total = np.add.reduceat(times[order], edge[:-1])
        often = total >= OFTEN
        key = (keys[order][edge[:-1]][often].astype(np.int64)) | (p << 32)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(total[often], pa.int64())], names=["key", "times"])


def _order(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """Top bits of the most frequent shingles, ascending: at most FREQUENT of them reach the driver."""
    parts = partitions(docs.sparkSession)
    often = docs.mapInArrow(_count(n, bits), "p int, keys binary, many binary, times binary").repartition(parts, "p").sortWithinPartitions("p").mapInArrow(_frequent, "key long, times long")
    top = often.orderBy(F.desc("times"), "key").limit(FREQUENT).select("key").toArrow()
    return np.sort(top.column("key").to_numpy().astype(np.uint64))


# --- 2: the index ----------------------------------------------------------------------------


def _prefixes(n: int, bits: int, percent: int, shared, seed: int = 0):
    def flush(held):
        h, node, size, at = (np.concatenate(x) for x in zip(*held, strict=True))
        p = (h & np.uint64((1 << bits) - 1)).astype(np.int64)  # low bits: prefixes hold small hashes, so the top bits are uneven
        order = np.argsort(p, kind="stable")
        p, h, node, size, at = p[order], h[order], node[order], size[order], at[order]
        cuts = runs(p)
        rows = [(int(p[a]), h[a:b].tobytes(), node[a:b].tobytes(), size[a:b].tobytes(), at[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["p", "h", "node", "size", "at"])

    def run(batches):
        often = shared.value
        seen = np.zeros(1 << 22, bool)
        seen[often & np.uint64((1 << 22) - 1)] = True
        held, count = [], 0
        for node, x in _classes(batches, n, seed):
            top = x >> np.uint64(32 - bits)
            late = seen[top & np.uint64((1 << 22) - 1)]
            if late.any():
                at = np.flatnonzero(late)
                slot = np.minimum(np.searchsorted(often, top[at]), len(often) - 1)
                late[at] = often[slot] == top[at]
                x = np.concatenate([x[~late], x[late]])
            size = len(x)
            first = size + (-percent * size // 100) + 1
            held.append((x[:first], np.full(first, node, np.int64), np.full(first, size, np.uint32), np.arange(first, dtype=np.uint32)))
            count += first
            if count >= SLICE // 2:
                yield flush(held)
                held, count = [], 0
        if held:
            yield flush(held)

    return run


def _lists(batches, percent: int):
    """Lists of two classes or more, each sorted by size and position."""
    names = ["p", "list", "node", "size", "at"]
    for p, rows in _by_part(batches, ("h", "node", "size", "at")):
        h, node, size, at = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in enumerate((np.uint64, np.int64, np.uint32, np.uint32)))
        order = np.argsort(h, kind="stable")
        edge = runs(h[order])
        order = order[np.repeat(np.diff(edge) > 1, np.diff(edge))]
        order = order[np.lexsort((node[order], at[order], size[order], h[order]))]
        h, node, size, at = h[order], node[order], size[order], at[order]
        if len(h):  # a class that several tasks have sent stays once
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])
            h, node, size, at = h[new], node[new], size[new], at[new]
            edge = runs(h)
            more = np.repeat(np.diff(edge) > 1, np.diff(edge))
            h, node, size, at = h[more], node[more], size[more], at[more]
        if len(h):
            # In lists of two, the common case, an entry without a partner in reach goes.
            edge = runs(h)
            two = edge[:-1][np.diff(edge) == 2]
            off = two[~_reach(size[two], at[two], size[two + 1], at[two + 1], percent)]
            keep = np.ones(len(h), bool)
            keep[off] = keep[off + 1] = False
            h, node, size, at = h[keep], node[keep], size[keep], at[keep]
        if len(h):
            edge = runs(h)
            number = np.repeat(np.arange(len(edge) - 1, dtype=np.uint32), np.diff(edge))
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (number, node, size, at)]], names=names)


def _arrays(row: dict):
    return (np.frombuffer(row[c], t) for c, t in (("list", np.uint32), ("node", np.int64), ("size", np.uint32), ("at", np.uint32)))


def _reach(size_a, at_a, size_b, at_b, percent: int):
    """Whether two sets can have the overlap that they need, by the position of a shared shingle."""
    size_a, size_b, at_a, at_b = (np.asarray(x).astype(np.int64) for x in (size_a, size_b, at_a, at_b))
    need = -(-percent * (size_a + size_b) // (100 + percent))
    return (100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)) & (np.minimum(size_a - at_a, size_b - at_b) >= need)


# --- 3: first answers ------------------------------------------------------------------------


def _leaders(percent: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                number, node, size, at = _arrays(row)
                group = (np.log(size) / np.log(100 / percent)).astype(np.int64)
                key = number.astype(np.int64) << 12 | group
                edge = runs(key)
                lead = np.repeat(edge[:-1], np.diff(edge))
                ok = (node != node[lead]) & _reach(size, at, size[lead], at[lead], percent)
                a, b = node[ok], node[lead][ok]
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                if len(a):
                    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                    yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(np.diff(np.concatenate([new, [len(a)]])), pa.int64())], names=["a", "b", "shared"])

    return run


def _label(comps, node, row):
    """The component of each node; a node without links is its own."""
    keys, values = comps.value if comps else (np.frombuffer(row["keys"], np.int64), np.frombuffer(row["values"], np.int64))
    if not len(keys):
        return node
    slot = np.minimum(np.searchsorted(keys, node), len(keys) - 1)
    return np.where(keys[slot] == node, values[slot], node)


def _partners(percent: int, turn: int, comps):
    """In each list, each set with a few sets of other components that are in reach."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                number, node, size, at = _arrays(row)
                comp = _label(comps, node, row)
                edge = runs(number)
                mixed = np.maximum.reduceat(comp, edge[:-1]) != np.minimum.reduceat(comp, edge[:-1])
                mine = np.repeat(mixed, np.diff(edge))
                if not mine.any():
                    continue
                node, size, at, comp, number = node[mine], size[mine], at[mine], comp[mine], number[mine]
                edge = runs(number)
                first, m = np.repeat(edge[:-1], np.diff(edge)), np.repeat(np.diff(edge), np.diff(edge))
                place = np.arange(len(node)) - first
                seed = mix64(node.view(np.uint64) ^ np.uint64(turn * 1_000_003 + row["p"]) ^ (number.astype(np.uint64) << np.uint64(20)))
                pairs = []
                for k in range(4 << min(turn, 4)):
                    some = np.flatnonzero(m > max(1, k - 2))  # a short list needs few turns
                    if not len(some):
                        break
                    shift = 1 + (mix64(seed[some] + np.uint64(k)) % (m[some] - 1).astype(np.uint64)).astype(np.int64)
                    to = first[some] + (place[some] + shift) % m[some]
                    ok = (comp[to] != comp[some]) & _reach(size[some], at[some], size[to], at[to], percent)
                    pairs.append((node[some][ok], node[to][ok]))
                a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                if len(a):
                    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                    shared = np.diff(np.concatenate([new, [len(a)]]))
                    a, b = a[new], b[new]
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(shared, pa.int64())], names=["a", "b", "shared"])

    return run


# --- 4: what is left -------------------------------------------------------------------------


def _pieces(percent: int, long: int):
    """Of lists with over ``long`` entries: each two of their blocks that have sets in reach of each other, as a list of its own.

    ``cut`` counts the first block's entries; 0: a block with itself.  ``p`` is negative and spreads the pieces.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                number, *columns = _arrays(row)
                edge = runs(number)
                for k in np.flatnonzero(np.diff(edge) > long).tolist():
                    node, size, at = (c[edge[k] : edge[k + 1]] for c in columns)
                    starts = np.arange(0, len(node), long)
                    ends = np.minimum(starts + long, len(node))
                    low, high = size[starts].astype(np.int64), size[ends - 1].astype(np.int64)
                    best = np.maximum.reduceat(size.astype(np.int64) - at, starts)  # the most that a set of the block can still share
                    for i in range(len(starts)):
                        j = np.arange(i, len(starts))
                        need = -(-percent * (low[i] + low[j]) // (100 + percent))
                        for to in j[(100 * high[i] >= percent * low[j]) & (np.minimum(best[i], best[j]) >= need)].tolist():
                            part = np.arange(starts[i], ends[i]) if to == i else np.concatenate([np.arange(starts[i], ends[i]), np.arange(starts[to], ends[to])])
                            name = -1 - (xxhash.xxh3_64_intdigest(np.array([row["p"], k, i, to], np.int64).tobytes()) >> 1)
                            blobs = [np.zeros(len(part), np.uint32), *(c[part] for c in (node, size, at))]
                            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in blobs], pa.array([0 if to == i else long], pa.int32())], names=["p", "list", "node", "size", "at", "cut"])

    return run


def _crossed(lists: DataFrame, percent: int, long: int) -> DataFrame:
    """The lists to cross: as they are (``cut`` null), and the pieces of long ones, dealt out to all tasks."""
    some = lists.filter(F.octet_length("list") > 4 * long).mapInArrow(_pieces(percent, long), "p long, list binary, node binary, size binary, at binary, cut int")
    return lists.select(F.col("p").cast("long").alias("p"), "list", "node", "size", "at", F.lit(None).cast("int").alias("cut")).unionByName(some.repartition(partitions(lists.sparkSession), "p"))


def _cross(percent: int, comps, long: int):
    """Pairs in a list that can reach their overlap and aren't connected yet.  Lists of over ``long`` entries are left to their pieces."""

    def pairs(node, size, at, comp, cut):
        m = len(node)
        starts = np.arange(0, m, _BLOCK)
        low, high, least = size[starts], size[np.minimum(starts + _BLOCK, m) - 1], np.minimum.reduceat(at, starts)
        for i in range(cut or m - 1):
            to = int(np.searchsorted(size, 100 * int(size[i]) // percent, "right"))
            j = np.arange(max(i + 1, cut), to)
            if len(j) > 2 * _BLOCK:  # skip blocks by position
                need = -(-percent * (int(size[i]) + low.astype(np.int64)) // (100 + percent))
                can = high.astype(np.int64) - least >= need
                j = j[can[j // _BLOCK]]
            j = j[comp[j] != comp[i]]
            j = j[_reach(size[i], at[i], size[j], at[j], percent)]
            if len(j):
                yield np.full(len(j), node[i]), node[j]

    def distinct(found):
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        a, b = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                number, node, size, at = _arrays(row)
                comp = _label(comps, node, row)
                edge = runs(number)
                mixed = np.maximum.reduceat(comp, edge[:-1]) != np.minimum.reduceat(comp, edge[:-1])
                if row["cut"] is None:
                    mixed &= np.diff(edge) <= long
                found, held = [], 0
                for k in np.flatnonzero(mixed).tolist():
                    for x in pairs(*(v[edge[k] : edge[k + 1]] for v in (node, size, at, comp)), row["cut"] or 0):
                        found.append(x)
                        held += len(x[0])
                    if held > 500_000:
                        yield distinct(found)
                        found, held = [], 0
                if found:
                    yield distinct(found)

    return run


def _with_components(lists: DataFrame, comps: DataFrame, make, schema: str) -> DataFrame:
    """``make(components)`` over the lists.  The components are broadcast where they are few enough, else joined."""
    spark = lists.sparkSession
    if comps.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        got = comps.toArrow()
        keys, values = got.column("node").to_numpy(), got.column("component").to_numpy()
        order = np.argsort(keys)
        return lists.mapInArrow(make(spark.sparkContext.broadcast((keys[order], values[order]))), schema)

    def nodes(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = np.unique(np.frombuffer(row["node"], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), row["p"], np.int64)), pa.array(own)], names=["p", "node"])

    def pack(key, table):
        order = np.argsort(table.column("node").to_numpy())
        return pa.table({"p": [key[0].as_py()], "keys": [table.column("node").to_numpy()[order].tobytes()], "values": [table.column("component").to_numpy()[order].tobytes()]}, schema=pa.schema([("p", pa.int64()), ("keys", pa.binary()), ("values", pa.binary())]))

    own = lists.mapInArrow(nodes, "p long, node long").join(comps, "node").groupBy("p").applyInArrow(pack, "p long, keys binary, values binary")
    full = lists.join(own, "p", "left").withColumns({c: F.coalesce(c, F.lit(b"")) for c in ("keys", "values")})
    return full.mapInArrow(make(None), schema)


# --- verification ----------------------------------------------------------------------------


def _ship(n: int, seed: int = 0):
    def run(batches):
        nodes, blobs, size = [], [], 0
        for node, x in _classes(batches, n, seed):
            nodes.append(node)
            blobs.append(x.tobytes())
            size += len(x)
            if size >= SLICE // 3:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], names=["node", "items"])
                nodes, blobs, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], names=["node", "items"])

    return run


def _compare(batches):
    """Rows sorted by (b, salt, kind, node): the leader's set, then those to compare with it.  A set that several tasks have sent counts once."""
    key, lead, last = None, np.zeros(0, np.uint64), None
    for batch in batches:
        out = [[], [], [], [], []]
        b, salt, kind, a = (batch.column(c).to_pylist() for c in ("b", "salt", "kind", "node"))
        items = batch.column("items")
        for i, k in enumerate(zip(b, salt, strict=True)):
            x = np.frombuffer(items[i].as_py(), np.uint64)
            if kind[i] == 0:
                key, lead, last = k, x, None
            elif k == key and a[i] != last:
                last = a[i]
                slot = np.minimum(np.searchsorted(lead, x), len(lead) - 1)
                for c, v in zip(out, (a[i], b[i], len(x), len(lead), int((lead[slot] == x).sum())), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b", "size_a", "size_b", "overlap"])


def _listed(batches):
    for batch in batches:
        for row in batch.to_pylist():
            own = np.unique(np.frombuffer(row["node"], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(own)], names=["node"])


def _unknown(pairs: DataFrame, known: DataFrame, n_known: int) -> DataFrame:
    """The pairs that are not among the known ones, of which there are at most ``n_known``."""
    known = known.select("a", "b")
    return pairs.join(F.broadcast(known) if n_known <= FEW else known, ["a", "b"], "left_anti")


def overlaps(sets: DataFrame, pairs: DataFrame, n_pairs: int | None = None) -> DataFrame:
    """(a, b, size_a, size_b, overlap) of every pair (a, b) of classes, once, from whole sets.  ``n_pairs``: how many there are, if known.

    A class's set goes to the group of each b that it is paired with; groups are split after GROUP sets.
    """
    parts = partitions(sets.sparkSession)
    few = (pairs.count() if n_pairs is None else n_pairs) <= FEW
    groups = cut(pairs.groupBy("b").agg(F.count("*").alias("n")).withColumn("salts", F.expr(f"cast((n + {GROUP - 1}) div {GROUP} as int)")))
    salted = pairs.join(F.broadcast(groups.drop("n")), "b") if few else skew_join(pairs, groups, "b", "n")
    mine = salted.select(F.col("a").alias("node"), "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"))
    leads = groups.select(F.col("b").alias("node"), "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"))
    targets = cut(mine.unionByName(leads))
    dealt = sets.join(F.broadcast(targets) if few else small(targets), "node").repartition(parts, "b", "salt").sortWithinPartitions("b", "salt", "kind", "node")
    out = cut(dealt.mapInArrow(_compare, "a long, b long, size_a long, size_b long, overlap long"))
    drop_cut(targets)
    drop_cut(groups)
    return out


def _index(docs: DataFrame, n: int, percent: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of the lists, of the classes in them, and of these classes' sets."""
    spark = docs.sparkSession
    parts = partitions(spark)
    bits = min(24, max(1, (4 * parts - 1).bit_length()))
    own = docs.select("text")
    order = spark.sparkContext.broadcast(_order(own, n, bits))
    index = own.mapInArrow(_prefixes(n, bits, percent, order, seed), "p int, h binary, node binary, size binary, at binary")
    lists = cut(index.repartition(parts, "p").sortWithinPartitions("p").mapInArrow(lambda batches: _lists(batches, percent), "p int, list binary, node binary, size binary, at binary"))
    listed = cut(lists.mapInArrow(_listed, "node long").distinct())
    sets = cut(own.mapInArrow(_ship(n, seed), "node long, items binary").join(small(listed), "node"))
    return lists, listed, sets


def _similar(percent: int) -> str:
    return f"100 * overlap >= {percent} * (size_a + size_b - overlap)"


def all_links(docs: DataFrame, n: int = 5, percent: int = 75, seed: int = 0, long: int = LONG) -> DataFrame:
    """Every link (a, b, size_a, size_b, overlap), a > b, between classes: all pairs in reach of a list are verified.

    A group of G similar but different sets has G * G / 2 links, and so has this result; copies are one class.
    """
    lists, listed, sets = _index(docs, n, percent, seed)
    none = docs.sparkSession.sparkContext.broadcast((np.zeros(0, np.int64), np.zeros(0, np.int64)))
    near = cut(_crossed(lists, percent, long).mapInArrow(_cross(percent, none, long), "a long, b long").distinct())
    out = cut(overlaps(sets, near).filter(_similar(percent)))
    for done in (lists, listed, sets, near):
        drop_cut(done)
    return out


def link_counts(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """Per row: doc_id, n_shingles, node (class), and n_links, the number of other rows that it is linked with."""
    own, members, classes, seed = _named(docs, n)
    found = all_links(own, n, percent, seed)
    both = found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = classes.select("node", "n")
    beside = both.join(size.select(F.col("node").alias("b"), "n"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    per = cut(size.join(beside, "node", "left").select("node", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    return skew_join(members, per, "node", "n").select("doc_id", "n_shingles", "node", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def links(docs: DataFrame, n: int = 5, percent: int = 75, seed: int = 0, long: int = LONG) -> DataFrame:
    """Verified links (a, b) between classes: enough of them to connect whatever the join connects."""
    spark = docs.sparkSession
    lists, listed, sets = _index(docs, n, percent, seed)
    similar = _similar(percent)

    found = known = spark.createDataFrame([], "a long, b long, size_a long, size_b long, overlap long")
    comps = spark.createDataFrame([], "node long, component long")
    n_known = 0
    for turn in range(ROUNDS):
        if turn == 0:
            some = lists.mapInArrow(_leaders(percent), "a long, b long, shared long")
        else:
            some = _with_components(lists, comps, lambda c, turn=turn: _partners(percent, turn, c), "a long, b long, shared long")
        best = Window.partitionBy("x").orderBy(F.desc("shared"), F.xxhash64("a", "b"))
        some = some.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
        some = some.select(F.col("a").alias("x"), F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "shared")
        some = _unknown(some, known, n_known).withColumn("_r", F.row_number().over(best))
        some = cut(some.filter(F.col("_r") <= (1 if turn == 0 else 2 << turn)).select("a", "b").distinct())
        tried = some.count()
        checked = overlaps(sets, some, tried)
        known = cut(known.unionByName(checked))
        n_known += tried
        good = checked.filter(similar).count()
        if good:
            found = known.filter(similar)
            comps = cut(connected_components(found, "a", "b"))
        if good <= 0.003 * tried and (turn or not good):
            break

    left = _with_components(_crossed(lists, percent, long), comps, lambda c: _cross(percent, c, long), "a long, b long").distinct()
    left = cut(_unknown(left, known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), n_known))
    info = found.select(F.col("a").alias("node"), F.col("b").alias("lead"), (F.col("size_a") - F.col("overlap")).alias("extra"), F.col("size_a").alias("own"))
    info = cut(info.groupBy("node").agg(F.min(F.struct("lead", "extra", "own")).alias("x")).select("node", "x.*"))
    side = lambda k: small(info).select(F.col("node").alias(k), F.col("lead").alias(f"l{k}"), F.col("extra").alias(f"e{k}"), F.col("own").alias(f"s{k}"))
    led = left.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"), F.coalesce("ea", F.lit(0)).alias("ea"), F.coalesce("eb", F.lit(0)).alias("eb"), "sa", "sb")
    led = cut(led.withColumns({"x": F.least("la", "lb"), "y": F.greatest("la", "lb")}))
    ask = led.select(F.col("y").alias("a"), F.col("x").alias("b")).filter("a <> b").distinct()
    fresh = overlaps(sets, cut(_unknown(ask, known, n_known)))
    known = known.unionByName(fresh)
    both = led.join(small(known.select(F.col("a").alias("y"), F.col("b").alias("x"), "size_a", "size_b", "overlap")), ["x", "y"], "left")
    direct = (F.col("ea") == 0) & (F.col("eb") == 0) & F.least("a", "b").eqNullSafe(F.col("x")) & F.greatest("a", "b").eqNullSafe(F.col("y"))
    own_size = lambda k: F.coalesce(f"s{k}", F.when(F.col(f"l{k}") == F.col("y"), F.col("size_a")).otherwise(F.col("size_b")))
    both = both.withColumn("both_sizes", own_size("a") + own_size("b"))
    need = F.expr(f"({percent} * both_sizes + {99 + percent}) div {100 + percent}")
    open_ = both.filter(~direct & (F.col("overlap").isNull() | (F.col("overlap") + F.col("ea") + F.col("eb") >= need))).select("a", "b").distinct()
    late = overlaps(sets, cut(open_)).filter(similar)
    out = cut(known.filter(similar).select("a", "b").unionByName(late.select("a", "b")).distinct())
    for done in (lists, sets, listed, left, led):
        drop_cut(done)
    return out


def _named(docs: DataFrame, n: int, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(doc_id, text), tables of all rows' classes and of the classes, and the seed that names each set differently."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    for seed in _SEEDS:
        members = cut(own.mapInArrow(_members(n, seed, keep), ", ".join([f"{c} long" for c in ("doc_id", "n_shingles", "node", "test", *keep)])))
        classes = members.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.min(F.struct("test", "n_shingles")).alias("low"), F.max(F.struct("test", "n_shingles")).alias("high"))
        classes = cut(classes)
        if not classes.filter("low <> high").limit(1).count():
            return own, members.drop("test"), classes.drop("low", "high"), seed
    raise RuntimeError("sets share their names with every seed")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, node (class), component (its smallest class), component_id and the columns ``keep`` (long)."""
    own, members, classes, seed = _named(docs, n, keep)
    comps = connected_components(links(own, n, percent, seed), "a", "b")
    classes = cut(classes.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node")))
    roots = cut(classes.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("w")))
    named = cut(skew_join(classes, roots, "component", "w").select("node", "component", "component_id", "n"))  # a skew join reads it three times
    out = skew_join(members, named, "node", "n")
    return out.select("doc_id", *keep, "n_shingles", "node", "component", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))




def one_of_each(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id (null last), then by its text's hash.

    It is decided by doc_id and text together, so a row never goes for what another row of its doc_id says, and rows without
    doc_id are judged like any other; of rows equal in both one stays.  Rows without words stay, repeated ones too.
    """
    own, key = Shield(docs, "doc_id", "text"), ["k1", "k2"]
    keyed = own.df.select("*", *row_key("doc_id", "text"))
    found = cut(near_duplicates(keyed, n, percent, (*key,)).filter("n_shingles > 0").select("doc_id", *key, "component"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *key)
    first = cut(found.groupBy("component").agg(F.min(order).alias("x")).select("x.k1", "x.k2"))
    times = found.groupBy(*key).agg(F.count("*").alias("n"))
    again = cut(times.filter("n > 1").select(*key).join(first, key, "left_semi"))
    gone = cut(times.select(*key).join(first, key, "left_anti"))
    left = keyed.join(small(gone.unionByName(again)), key, "left_anti")
    if again.limit(1).count():
        one = keyed.join(small(again), key, "left_semi").groupBy(*key).agg(F.first(F.struct(*own.inner)).alias("row"))
        left = left.select(*own.inner).unionByName(one.select(*[F.col(f"row.{c}").alias(c) for c in own.inner]))
    return own.back(left)


def report(docs: DataFrame) -> DataFrame:
    with scratch() as made:
        out = cut(near_duplicates(docs).select("doc_id", "n_shingles", "component_id"))
        made.remove(out)
    return out


#: DuckDB SQL for op4.
SQL = r"""
with recursive w as materialized (
  select row_number() over () as rid, doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from (select distinct doc_id, text from documents)),
s as (
  select distinct rid, hash(array_to_string(w[i : i + least(5, len(w)) - 1], ' ')) as s
  from (select rid, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i from w where len(w) > 0)),
n as (select rid, count(*) as n from s group by 1),
o as (
  select a.rid as x, b.rid as y, count(*) as o from s a join s b on a.s = b.s and a.rid < b.rid group by 1, 2),
l as (
  select x, y from o join n a on a.rid = x join n b on b.rid = y where 100 * o >= 75 * (a.n + b.n - o)),
e as (select x, y from l union all select y, x from l),
r as (select rid as node, rid as seen from n union select r.node, e.y from r join e on e.x = r.seen),
c as (select node, min(doc_id) as component_id from r join w on w.rid = seen group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, case when n.n is null then d.doc_id else c.component_id end as component_id
from documents d join w on w.doc_id is not distinct from d.doc_id and w.text is not distinct from d.text left join n using (rid) left join c on c.node = rid
"""
