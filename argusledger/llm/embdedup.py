"""Near-duplicate vectors by cosine: inverted lists with product-quantised residuals, then exact cosines.

Fit, on a sample of at most ``FIT`` vectors: ``LIST`` vectors a coarse list (spherical k-means), and a codebook of ``CODES``
words for each of ``PARTS`` subspaces of the residuals.  Every vector is indexed: its list, a byte a subspace, and two numbers of
its quantisation error e.  A vector is asked in its own list and in the nearest lists up to the number that :func:`sufficient` has
found.  In a list its distances are sums of table lookups.  A pair with cosine t or more differs by a vector of length ``sqrt(2 - 2t)`` at
most, so its looked-up value can't fall below t by more than ``v.e + sqrt(2 - 2t) * |e|``: that bound drops no pair, and all others
that pass it get their exact cosine in double precision.

Counting: a link (u, v) counts for u where u is asked in v's list.  If v isn't asked in u's list it counts for both there, so each link
that either side finds counts once for each.  A list is cut into blocks of ``BLOCK`` vectors; a block gives counts, and links enough
to connect what it found, never all pairs of a group.  Equal vectors are indexed once with their number.

Edge cases: vectors that are null, zero, hold null or non-finite components, or have another length than most link with nothing;
rows that repeat, or share an id, are vectors of their own, equal ones linked; a null id is never the smallest of a component
but where it is alone, and is then kept; an empty table gives an empty one; only the two columns named are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argusledger.functions.tables import cut, partitions, scratch, small
from argusledger.operators.graph import connected_components

#: Vectors that the lists are fitted on at most, and the codebooks; vectors of a list, lists at most; vectors of a block.
FIT, FIT_CODES, LIST, MAX_LISTS, BLOCK = 65_536, 16_384, 1024, 4096, 2048
#: Subspaces and words of a codebook.
PARTS, CODES = 8, 256
#: Share of neighbours at the threshold whose list must be among those that either side is asked in.
RECALL, HELD = 0.9995, 8000


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, spherical: bool, rounds: int = 8) -> np.ndarray:
    """Centres by largest product (unit vectors) or least distance; those that nothing is nearest to go."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for r in range(rounds + 1):
        own = nearest(x, centres, spherical)
        size = np.bincount(own, minlength=len(centres)).astype(float)
        if r == rounds:
            return centres[size > 0]
        sums = np.stack([np.bincount(own, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
        if spherical:
            size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 0, sums / np.where(size > 0, size, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, spherical: bool) -> np.ndarray:
    shift = np.zeros(len(centres)) if spherical else 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([np.argmax(x[a : a + 4096] @ centres.T - shift, axis=1) for a in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def sufficient(unit: np.ndarray, centres: np.ndarray, least: float, rng: np.random.Generator) -> int:
    """Lists to ask in so that one of two neighbours is asked in the other's list, for ``RECALL`` of neighbours that lie in random
    directions just at the threshold (nearer ones need fewer), and of the sample's own neighbours."""

    def ranks(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        su, sv, at = u @ centres.T, v @ centres.T, np.arange(len(u))
        lu, lv = su.argmax(axis=1), sv.argmax(axis=1)
        return np.minimum((su > su[at, lv][:, None]).sum(axis=1), (sv > sv[at, lu][:, None]).sum(axis=1)) + 1

    u = unit[rng.choice(len(unit), HELD)]
    w = rng.standard_normal(u.shape)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    size = np.linalg.norm(w, axis=1, keepdims=True)
    v = least * u + np.sqrt(1 - least * least) * w / np.where(size > 0, size, 1)
    need = int(np.quantile(ranks(u, v), RECALL, method="higher"))
    some = rng.choice(len(unit), min(512, len(unit)), replace=False)
    near = unit[some] @ unit.T
    near[np.arange(len(some)), some] = -1
    best = near.argmax(axis=1)  # each one's nearest, so that a large group weighs no more than others
    real = near[np.arange(len(some)), best] >= least
    if real.any():
        need = max(need, int(np.quantile(ranks(unit[some[real]], unit[best[real]]), RECALL, method="higher")))
    return need


class Index:
    """Centres, codebooks and the number of lists to ask in."""

    def __init__(self, unit: np.ndarray, total: int, least: float, per_list: int = LIST, parts: int = PARTS, seed: int = 3):
        rng = np.random.default_rng(seed)
        dim = unit.shape[1]
        self.least, self.edges = least, np.linspace(0, dim, min(parts, dim) + 1).astype(int)
        self.centres = kmeans(unit, max(1, min(MAX_LISTS, total // per_list, len(unit) // 16)), rng, True)
        self.probes = min(len(self.centres), sufficient(unit, self.centres, least, rng))
        some = unit[rng.choice(len(unit), min(FIT_CODES, len(unit)), replace=False)]
        rest = some - self.centres[nearest(some, self.centres, True)]
        self.books = [kmeans(rest[:, a:b], CODES, rng, False, 6) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]

    def encode(self, unit: np.ndarray):
        """Lists asked in (own first), codes, v.e and \\|e\\| of each vector."""
        score = unit @ self.centres.T
        lists = np.argsort(-score, axis=1, kind="stable")[:, : self.probes]
        rest = unit - self.centres[lists[:, 0]]
        codes = np.empty((len(unit), len(self.books)), np.uint8)
        for m, (book, a, b) in enumerate(zip(self.books, self.edges[:-1], self.edges[1:], strict=True)):
            codes[:, m] = nearest(rest[:, a:b], book, False)
            rest[:, a:b] -= book[codes[:, m]]
        return lists, codes, (unit * rest).sum(axis=1), np.linalg.norm(rest, axis=1)

    def looked_up(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Products of a list's coded vectors with queries, by sums over tables of (word, query)."""
        out = np.repeat((queries @ self.centres[which]).astype(np.float32)[None, :], len(codes), axis=0)
        for m, (book, a, b) in enumerate(zip(self.books, self.edges[:-1], self.edges[1:], strict=True)):
            out += (book @ queries[:, a:b].T).astype(np.float32)[codes[:, m]]
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows; each row is scaled by its largest component first, so that no product overflows."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets that a and b are in; ``label`` names each set by its smallest place."""
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a].copy(), low)
        np.minimum.at(label, label[b].copy(), low)
        while (label[label] != label).any():
            label[:] = label[label]


def _encode(shared, dim: int):
    def run(batches):
        index = shared.value
        for batch in batches:
            lists, codes, own, size = index.encode(_unit(_matrix(batch.column("vec"), dim)))
            asked = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * index.probes, pa.int32()), pa.array(lists.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array(lists[:, 0], pa.int32()), asked, pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(own), pa.array(size), batch.column("vec")], names=["node", "n", "list", "asked", "code", "own", "size", "vec"])

    return run


class _Block:
    """A list's block: its vectors, and the sets that links have joined."""

    def __init__(self, index: Index, which: int, parts: list[pa.RecordBatch], dim: int):
        col = lambda c: np.concatenate([p.column(c).to_numpy() for p in parts])
        self.index, self.which, self.node, self.n = index, which, col("node"), col("n")
        self.codes = np.frombuffer(b"".join(x for p in parts for x in p.column("code").to_pylist()), np.uint8).reshape(len(self.node), -1)
        self.asked = np.concatenate([p.column("asked").flatten().to_numpy().reshape(p.num_rows, -1) for p in parts])
        self.vec = np.concatenate([_matrix(p.column("vec"), dim) for p in parts])
        far = np.sqrt(2 - 2 * index.least)
        self.floor = (index.least - col("own") - far * col("size") - 1e-5).astype(np.float32)  # lookups are single precision
        self.label = np.arange(len(self.node))

    def ask(self, part: pa.RecordBatch, dim: int):
        """(a, b, n): n more links of a, or (b not null) a link."""
        vec, node, home, n = _matrix(part.column("vec"), dim), part.column("node").to_numpy(), part.column("list").to_numpy(), part.column("n").to_numpy()
        near = self.index.looked_up(_unit(vec), self.which, self.codes)
        at, by = np.nonzero(near >= self.floor[:, None])
        other = self.node[at] != node[by]
        at, by = at[other], by[other]
        ok = np.zeros(len(at), bool)
        for a in range(0, len(at), 16_384):  # exact
            s = slice(a, a + 16_384)
            ok[s] = cosines(self.vec[at[s]], vec[by[s]]) >= self.index.least
        at, by = at[ok], by[ok]
        if not len(at):
            return
        links = np.bincount(by, self.n[at], len(node)).astype(np.int64)
        some = links.nonzero()[0]
        yield node[some], None, links[some]
        lone = ~(self.asked[at] == home[by][:, None]).any(axis=1)  # the other side isn't asked where this one lies
        if lone.any():
            links = np.bincount(at[lone], n[by[lone]], len(self.node)).astype(np.int64)
            back = links.nonzero()[0]
            yield self.node[back], None, links[back]
        order = np.argsort(by, kind="stable")
        at, by = at[order], by[order]
        new = np.concatenate([[True], by[1:] != by[:-1]])
        first = at[new][np.cumsum(new) - 1]
        merge(self.label, at, first)
        yield node[by[new]], self.node[at[new]], np.zeros(new.sum(), np.int64)

    def joined(self):
        own = (self.label != np.arange(len(self.label))).nonzero()[0]
        if len(own):
            yield self.node[own], self.node[self.label[own]], np.zeros(len(own), np.int64)


def _search(shared, dim: int):
    """Rows (at, part, kind), sorted: a block's vectors, then those that are asked in it."""

    def told(found):
        for a, b, n in found:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    def run(batches):
        index, now, held, block = shared.value, None, [], None
        for batch in batches:
            code = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("at", "part", "kind")])
            edge = np.concatenate([[0], (code[:, 1:] != code[:, :-1]).any(axis=0).nonzero()[0] + 1, [batch.num_rows]])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if b == a:
                    continue
                if (code[0, a], code[1, a]) != now:
                    if block:
                        yield from told(block.joined())
                    now, held, block = (code[0, a], code[1, a]), [], None
                part = batch.slice(a, b - a)
                if code[2, a] == 0:
                    held.append(part)
                    continue
                if held and not block:
                    block = _Block(index, int(now[0]), held, dim)
                for x in range(0, b - a, 256) if block else ():
                    yield from told(block.ask(part.slice(x, 256), dim))
        if block:
            yield from told(block.joined())

    return run


def usable(vec: Column) -> Column:
    """Whether a vector takes part: no null, zero or non-finite one."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vec.isNotNull() & F.forall(vec, fine) & F.exists(vec, lambda x: x != 0)


def near_vectors(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", per_list: int = LIST, block: int = BLOCK) -> DataFrame:
    """Each row's (vec_id, n_links, component_id, kept): links with a cosine of ``least`` or more."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").alias("vec"))
    dims = rows.filter(usable(F.col("vec"))).groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = dims.d
    good = F.coalesce(usable(F.col("vec")) & (F.size("vec") == dim), F.lit(False))
    # Equal vectors have equal r1 and r2; different ones share both with a chance below 1e-17.
    keyed = cut(rows.select("vec_id", *[F.when(good, x).alias(k) for k, x in (("r1", F.xxhash64("vec")), ("r2", F.xxhash64(F.lit("r2"), "vec")))], F.when(good, F.col("vec")).alias("vec")))
    classes = keyed.filter("r1 is not null").groupBy("r1", "r2").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    total = classes.count()
    sample = classes.orderBy("r1", "r2").limit(FIT).select("vec").toArrow()
    index = Index(_unit(_matrix(sample.column("vec"), dim)), total, least, per_list)
    shared = spark.sparkContext.broadcast(index)  # at most MAX_LISTS centres and PARTS * CODES words

    kind = classes.schema["vec"].dataType.simpleString()
    coded = cut(classes.select("node", "n", "vec").mapInArrow(_encode(shared, dim), f"node long, n long, list int, asked array<int>, code binary, own double, size double, vec {kind}"))
    blocks = coded.groupBy("list").agg(F.count("*").alias("rows")).select(F.col("list").alias("at"), F.expr(f"int((rows + {block - 1}) div {block})").alias("blocks"))
    blocks = small(blocks)
    held = coded.withColumn("at", F.col("list")).join(blocks, "at").select("at", F.pmod(F.hash("node"), F.col("blocks")).alias("part"), F.lit(0).alias("kind"), *coded.columns)
    none = lambda c: F.lit(None).cast(coded.schema[c].dataType).alias(c)
    seek = coded.select(F.explode("asked").alias("at"), "node", "n", "list", "vec").join(blocks, "at")
    seek = seek.select("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.lit(1).alias("kind"), *[c if c in ("node", "n", "list", "vec") else none(c) for c in coded.columns])
    both = held.unionByName(seek).repartition(partitions(spark), "at", "part").sortWithinPartitions("at", "part", "kind")
    found = cut(both.mapInArrow(_search(shared, dim), "a long, b long, n long"))

    comps = connected_components(found.filter("b is not null"), "a", "b")
    links = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("more"))
    named = classes.select("node", "r1", "r2", "least_id", "n").join(links.withColumnRenamed("a", "node"), "node", "left").join(comps, "node", "left")
    named = cut(named.select("r1", "r2", "least_id", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    ids = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    told = cut(named.join(small(ids), "component").select("r1", "r2", "n_links", "component_id"))
    out = keyed.select("vec_id", "r1", "r2").join(small(told), ["r1", "r2"], "left")
    comp = F.when(F.col("r1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.col("vec_id").eqNullSafe(comp).alias("kept"))


def report(embeddings: DataFrame) -> DataFrame:
    with scratch() as made:
        out = cut(near_vectors(embeddings))
        made.remove(out)
    return out
