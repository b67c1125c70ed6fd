"""Approximate nearest neighbours by cosine: a hierarchical k-means tree searched best bin first.

The upper tree is fitted on a bounded sample (``FIT`` vectors) for leaves of about ``LEAF`` vectors of the data; every vector is
indexed in the leaf that a greedy descent reaches.  Leaves that the data fill with more than ``SPLIT`` vectors get a tree of
their own, fitted on executors on a sample of their vectors, so leaves grow in number with the data and not in size.  A query
walks a tree with a priority queue, always on to the most similar open node, and visits so many leaves as the sample's
queries needed for the wanted recall (``calibrate``), and more if they hold too few vectors.  A query travels once to
each leaf that it visits.  Leaves are split into blocks of ``BLOCK`` vectors; the blocks' nearest are merged.

Copies: vectors that are equal are indexed once, with their k + 1 smallest ids (no other can be in an answer), and equal
queries are asked once, so that a vector that a third of all rows hold costs no more than another.

Scores are cosines in double precision of the original vectors.  Edge cases: vectors that are null, zero, hold null
or non-finite components, or have another length than most take no part; rows with the query's vec_id are its own, rows
that repeat (vec_id, vector) count once, and a vec_id with several vectors is as near as the nearest of them;
ties go to the smaller vec_id; with too few candidates all are returned; an empty table returns nothing.  Only the two columns
named are read, so others may have any names.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argusledger.functions.tables import cut, partitions, small

#: Vectors that a tree is fitted on at most; its branching; vectors of the data in a leaf, of the sample at least; vectors of a block.
FIT, BRANCH, LEAF, LEAST, BLOCK = 65_536, 12, 1024, 48, 16_384
#: Vectors of a leaf from which it gets a tree of its own, and what that is fitted on at most, about.
SPLIT, FIT_LEAF = 64 * LEAF, 16_384
#: Recall that the number of visited leaves is calibrated to, on at most so many held queries.
RECALL, HELD = 0.96, 400


class Tree:
    """Centres, children and leaf numbers of all nodes, as arrays."""

    def __init__(self, unit: np.ndarray, branch: int = BRANCH, leaf: int = LEAST, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = [np.zeros(unit.shape[1])]
        self.children: list[list[int]] = [[]]
        self.leaf_of: list[int] = [-1]
        self.leaves = 0
        stack = [(0, np.arange(len(unit)))]
        while stack:
            node, rows = stack.pop()
            groups = self._split(unit, rows, branch, rng) if len(rows) > leaf else []
            if len(groups) < 2:
                self.leaf_of[node] = self.leaves
                self.leaves += 1
                continue
            for centre, own in groups:
                self.centres.append(centre)
                self.children.append([])
                self.leaf_of.append(-1)
                self.children[node].append(len(self.centres) - 1)
                stack.append((len(self.centres) - 1, own))
        self.table = [np.stack([self.centres[c] for c in kids]) if kids else None for kids in self.children]

    @staticmethod
    def _split(unit, rows, branch, rng):
        x = unit[rows]
        centres = x[rng.choice(len(x), min(branch, len(x)), replace=False)]
        for _ in range(8):
            own = np.argmax(x @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
        own = np.argmax(x @ centres.T, axis=1)
        return [(centres[k], rows[own == k]) for k in range(len(centres)) if (own == k).any()]

    def assign(self, unit: np.ndarray) -> np.ndarray:
        out = np.zeros(len(unit), np.int64)
        stack = [(0, np.arange(len(unit)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if self.table[node] is None:
                out[rows] = self.leaf_of[node]
                continue
            own = np.argmax(unit[rows] @ self.table[node].T, axis=1)
            stack += [(kid, rows[own == k]) for k, kid in enumerate(self.children[node])]
        return out

    def walk(self, q: np.ndarray):
        """Leaves, best bin first."""
        queue = [(-1.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.table[node] is None:
                yield self.leaf_of[node]
                continue
            for kid, s in zip(self.children[node], (self.table[node] @ q).tolist(), strict=True):
                heapq.heappush(queue, (-s, kid))


def calibrate(tree: Tree, unit: np.ndarray, k: int, recall: float = RECALL, held: int = HELD) -> int:
    """Leaves to visit so that the sample's queries find that share of their k nearest in the sample."""
    if len(unit) < 2:
        return 1
    leaf = tree.assign(unit)
    ranks = []
    for i in np.linspace(0, len(unit) - 1, min(held, len(unit))).astype(int).tolist():
        s = unit @ unit[i]
        s[i] = -2
        near = np.argpartition(-s, min(k, len(s) - 1) - 1)[:k]
        place = {x: r for r, x in enumerate(tree.walk(unit[i]))}
        ranks += [place[x] + 1 for x in leaf[near].tolist()]
    return int(np.quantile(ranks, recall, method="higher"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows, each from products summed in the same order."""
    return (v * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum(axis=1)))


def best(queries: np.ndarray, ids: list[list[int]], vectors: np.ndarray, k: int):
    """(query, id, score) of each query's k nearest, by score and then id; a vector may have several ids.  A matrix product
    finds them with room for its rounding; they are ranked by :func:`cosine`."""
    near = _unit(queries) @ _unit(vectors).T
    want = min(k, near.shape[1])
    k_th = -np.partition(-near, want - 1, axis=1)[:, want - 1]
    for i, q in enumerate(queries):
        at = np.flatnonzero(near[i] >= k_th[i] - 1e-9)
        pairs = sorted((-s, x) for j, s in zip(at.tolist(), cosine(q, vectors[at]).tolist(), strict=True) for x in ids[j])
        for s, x in pairs[:k]:
            yield i, x, -s


def _rows(batch: pa.RecordBatch, take, **more) -> pa.RecordBatch:
    """Rows of ``batch`` with new columns before its ids, keys and vectors."""
    take = pa.array(take, pa.int64())
    kept = ["ids", "r1", "r2", "vec"]
    return pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in more.values()), *(batch.column(c).take(take) for c in kept)], names=[*more, *kept])


_ITEM = "ids array<long>, r1 long, r2 long, vec array<double>"


def _assign(shared, dim: int):
    def run(batches):
        tree = shared.value[0]
        for batch in batches:
            yield _rows(batch, np.arange(batch.num_rows), leaf=tree.assign(_unit(_matrix(batch.column("vec"), dim))))

    return run


def _visited(tree: Tree, visits: int, unit: np.ndarray, count, k: int) -> tuple[list[int], list[int]]:
    """Rows of ``unit`` and the leaves that each visits; ``count`` tells how many vectors a leaf holds."""
    rows, leaves = [], []
    for i, q in enumerate(unit):
        held = seen = 0
        for x in tree.walk(q):
            if seen >= visits and held > k:
                break
            seen += 1
            held += count.get(x, 0) if count is not None else k + 1
            rows.append(i)
            leaves.append(x)
    return rows, leaves


def _visit(shared, dim: int, sizes, k: int):
    def run(batches):
        tree, visits = shared.value
        for batch in batches:
            rows, leaves = _visited(tree, visits, _unit(_matrix(batch.column("vec"), dim)), sizes.value, k)
            yield _rows(batch, rows, leaf=leaves)

    return run


def _fit_leaf(dim: int, k: int, leaf_rows: dict[int, int], per: int):
    """A tree of its own for each large leaf, from a sample of its vectors."""

    def run(key, table):
        leaf = key[0].as_py()
        unit = _unit(_matrix(table.column("vec"), dim))
        tree = Tree(unit, leaf=max(LEAST, per * len(unit) // leaf_rows[leaf]))
        return pa.table({"leaf": [leaf], "tree": [pickle.dumps((tree, calibrate(tree, unit, k)))]}, schema=pa.schema([("leaf", pa.int64()), ("tree", pa.binary())]))

    return run


def _below(dim: int, k: int, visit: bool):
    """Rows (leaf, salt, kind), sorted: a leaf's tree, then the vectors that go down it, to one leaf or to those they visit."""

    def run(batches):
        now, tree, visits = None, None, 0
        for batch in batches:
            leaf, salt, kind = (batch.column(c).to_numpy() for c in ("leaf", "salt", "kind"))
            edge = _edges(leaf, salt, kind)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if kind[a] == 0:
                    now, (tree, visits) = (leaf[a], salt[a]), pickle.loads(batch.column("tree")[a].as_py())  # noqa: S301  our own
                    continue
                part = batch.slice(a, b - a)
                if now != (leaf[a], salt[a]):  # a small leaf: no tree
                    yield _rows(part, np.arange(b - a), leaf=leaf[a:b], sub=np.zeros(b - a, np.int64))
                    continue
                unit = _unit(_matrix(part.column("vec"), dim))
                if visit:
                    rows, subs = _visited(tree, visits, unit, None, k)
                else:
                    rows, subs = np.arange(b - a), tree.assign(unit)
                yield _rows(part, rows, leaf=np.full(len(rows), leaf[a]), sub=subs)

    return run


def _edges(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(columns[0])]])


def _search(dim: int, k: int):
    """Rows (leaf, sub, part, kind), sorted: a block's vectors, then its queries."""

    def run(batches):
        now, ids, held = None, [], []
        for batch in batches:
            code = [batch.column(c).to_numpy() for c in ("leaf", "sub", "part", "kind")]
            edge, out = _edges(*code), [[], [], [], []]
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                block, part = tuple(int(c[a]) for c in code[:3]), batch.slice(a, b - a)
                if block != now:
                    now, ids, held = block, [], []
                if code[3][a] == 0:
                    ids += part.column("ids").to_pylist()
                    held.append(_matrix(part.column("vec"), dim))
                elif held:
                    held = [np.concatenate(held)] if len(held) > 1 else held
                    r1, r2, vec = part.column("r1").to_numpy(), part.column("r2").to_numpy(), _matrix(part.column("vec"), dim)
                    for c in range(0, b - a, 512):
                        for i, x, score in best(vec[c : c + 512], ids, held[0], k):
                            for col, v in zip(out, (int(r1[c + i]), int(r2[c + i]), x, score), strict=True):
                                col.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.float64())], names=["r1", "r2", "vec_id", "score"])

    return run


def _down(rows: DataFrame, trees: DataFrame | None, large: dict[int, int], dim: int, k: int, visit: bool) -> DataFrame:
    """Rows with ``sub``, their leaf within a large leaf's own tree (0 without one).  Large leaves are salted."""
    if trees is None:
        return rows.select("leaf", F.lit(0).cast("long").alias("sub"), "ids", "r1", "r2", "vec")
    spark = rows.sparkSession
    salts = spark.createDataFrame([(x, -(-n // SPLIT)) for x, n in large.items()], "leaf long, salts long")
    items = rows.join(small(salts), "leaf", "left").select("leaf", F.pmod(F.xxhash64("r1"), F.coalesce("salts", F.lit(1))).alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("tree"), "ids", "r1", "r2", "vec")
    none = spark.createDataFrame([], _ITEM)
    heads = trees.join(small(salts), "leaf").select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "tree", *[F.lit(None).cast(f.dataType).alias(f.name) for f in none.schema.fields])
    both = items.unionByName(heads).repartition(partitions(spark), "leaf", "salt").sortWithinPartitions("leaf", "salt", "kind")
    return both.mapInArrow(_below(dim, k, visit), f"leaf long, sub long, {_ITEM}")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", leaf_rows: int = LEAF, split: int = SPLIT, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    v = F.col(f"`{vec_col}`").cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("vec")).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).filter(F.forall("vec", fine) & F.exists("vec", lambda x: x != 0))
    dims = good.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dims.d
    # Equal vectors have equal r1 and r2; different ones share both with a chance below 1e-17.
    base = good.filter(F.size("vec") == dim).select("vec_id", F.xxhash64("vec").alias("r1"), F.xxhash64(F.lit("r2"), "vec").alias("r2"), "vec")
    base = cut(base.dropDuplicates(["vec_id", "r1", "r2"]))
    first = Window.partitionBy("r1", "r2").orderBy("vec_id")
    items = base.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)  # limited before the shuffle too
    items = cut(items.groupBy("r1", "r2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vec").alias("vec")).select("ids", "r1", "r2", "vec"))
    total = items.count()
    sample = items.orderBy("r1", "r2").limit(FIT).select("vec").toArrow()
    unit = _unit(_matrix(sample.column("vec"), dim))
    tree = Tree(unit, leaf=max(LEAST, leaf_rows * len(unit) // total))
    shared = spark.sparkContext.broadcast((tree, calibrate(tree, unit, k)))

    index = cut(items.mapInArrow(_assign(shared, dim), f"leaf long, {_ITEM}"))
    counts = {r.leaf: r["count"] for r in index.groupBy("leaf").count().collect()}  # one row a leaf of the upper tree
    large, trees = {x: n for x, n in counts.items() if n > split}, None
    if large:
        share = F.create_map(*[F.lit(x) for leaf, n in large.items() for x in (leaf, int(min(1.0, FIT_LEAF / n) * (1 << 30)))])
        some = index.filter(F.col("leaf").isin(*large) & (F.pmod(F.xxhash64("r1"), F.lit(1 << 30)) < F.element_at(share, F.col("leaf"))))
        trees = cut(some.groupBy("leaf").applyInArrow(_fit_leaf(dim, k, large, leaf_rows), "leaf long, tree binary"))
        index = cut(_down(index, trees, large, dim, k, visit=False))
    else:
        index = _down(index, None, large, dim, k, visit=False)
    asked = base.filter(F.col("vec_id") % every == 0)
    queries = asked.dropDuplicates(["r1", "r2"]).select(F.array("vec_id").alias("ids"), "r1", "r2", "vec")
    queries = _down(queries.mapInArrow(_visit(shared, dim, spark.sparkContext.broadcast(counts), k), f"leaf long, {_ITEM}"), trees, large, dim, k, visit=True)

    blocks = cut(index.groupBy("leaf", "sub").agg(F.count("*").alias("n")).select("leaf", "sub", F.expr(f"(n + {block - 1}) div {block}").alias("blocks")))
    held = index.join(small(blocks), ["leaf", "sub"]).select("leaf", "sub", F.pmod(F.xxhash64("r1"), F.col("blocks")).alias("part"), F.lit(0).alias("kind"), "ids", "r1", "r2", "vec")
    seek = queries.join(small(blocks), ["leaf", "sub"]).select("leaf", "sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"), F.lit(1).alias("kind"), "ids", "r1", "r2", "vec")
    both = held.unionByName(seek).repartition(partitions(spark), "leaf", "sub", "part").sortWithinPartitions("leaf", "sub", "part", "kind")
    found = both.mapInArrow(_search(dim, k + 1), "r1 long, r2 long, vec_id long, score double")
    found = found.groupBy("r1", "r2", "vec_id").agg(F.max("score").alias("score"))
    top = Window.partitionBy("r1", "r2").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k + 1).drop("n")
    each = asked.select(F.col("vec_id").alias("query_id"), "r1", "r2").join(found, ["r1", "r2"]).filter("vec_id <> query_id")
    each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings.select("vec_id", "embedding"))
