import numpy as np
import pytest

from argusledger.llm import embdedup
from argusledger.llm.queries import QUERIES


def plain(ids, vecs, least=0.9):
    """(vec_id, n_links, component_id, kept) from all pairs."""
    good = [v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vecs]
    x = np.array([v if g else [0.0] * 16 for v, g in zip(vecs, good)], float)
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    size = np.linalg.norm(x, axis=1)
    u = x / np.where(size > 0, size, 1)[:, None]
    near = (u @ u.T >= least) & np.array(good)[:, None] & np.array(good)[None, :]
    np.fill_diagonal(near, False)
    comp = [-1] * len(ids)
    out = []
    for i in range(len(ids)):
        if comp[i] < 0:
            stack, comp[i] = [i], i
            while stack:
                for j in near[stack.pop()].nonzero()[0].tolist():
                    if comp[j] < 0:
                        comp[j] = i
                        stack.append(j)
    for i, c in enumerate(comp):
        all_ids = [ids[j] for j in range(len(ids)) if comp[j] == c and ids[j] is not None]
        least_id = min(all_ids) if all_ids and (good[i] or ids[i] is not None) else None
        out.append((ids[i], int(near[i].sum()), least_id, ids[i] == least_id))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def mixed():
    rng = np.random.default_rng(5)
    rows = rng.standard_normal((1500, 16))
    walk = [rng.standard_normal(16)]
    for _ in range(60):  # a chain of links
        walk.append(walk[-1] + 0.09 * np.linalg.norm(walk[-1]) * rng.standard_normal(16) / 4)
    hot = rng.standard_normal(16)
    group = hot + 0.12 * rng.standard_normal((700, 16))  # a third of all rows, near each other
    vecs = [v.tolist() for v in [*rows, *walk, *group, *(rows[:40] + 0.02 * rng.standard_normal((40, 16))), *(1e200 * rows[:3]), *(1e-200 * rows[3:5])]]
    vecs += [vecs[7]] * 90 + [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0], []]
    ids = rng.permutation(len(vecs)).tolist()
    ids[3] = None
    ids[-1] = None
    ids[20] = ids[21]
    vecs.append(vecs[11])
    ids.append(ids[11])
    return ids, vecs


@pytest.mark.parametrize(("per_list", "block"), [(4096, 4096), (60, 50)])
def test_by_all_pairs(spark, mixed, per_list, block):
    ids, vecs = mixed
    df = spark.createDataFrame([(i, v, "r1", 0) for i, v in zip(ids, vecs)], "vec_id long, embedding array<double>, node string, n int")
    got = embdedup.near_vectors(df, per_list=per_list, block=block)
    told = sorted(repr(tuple(r)) for r in got.select("vec_id", "n_links", "component_id", "kept").collect())
    want = plain(ids, vecs)
    if per_list == 4096:  # one list: no pair can be missed
        assert told == want
    links = lambda rows: sum(eval(r)[1] for r in rows)  # noqa: E731, S307
    assert links(told) <= links(want) and links(told) >= 0.99 * links(want)


def test_bounds(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16))
    x[1500:] = x[:1500] + 0.1 * rng.standard_normal((1500, 16))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    index = embdedup.Index(u, 3000, 0.9, 100)
    lists, codes, own, size = index.encode(u)
    assert 1 < index.probes < len(index.centres)
    for which in range(len(index.centres)):
        held = (lists[:, 0] == which).nonzero()[0]
        near = index.looked_up(u, which, codes[held])
        floor = 0.9 - own[held] - np.sqrt(0.2) * size[held] - 1e-5
        true = u[held] @ u.T >= 0.9
        assert (near >= floor[:, None])[true].all()
        assert (near >= floor[:, None]).mean() < 0.5


def test_empty_and_floats(spark):
    assert embdedup.report(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    few = embdedup.report(spark.createDataFrame([(4, [1.0, 0.0]), (2, [1.0, 0.1]), (9, None)], "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, few.collect())) == [(2, 1, 2, True), (4, 1, 2, False), (9, 0, 9, True)]
    only = embdedup.report(spark.createDataFrame([(4, [0.0]), (None, None)], "vec_id long, embedding array<float>"))
    assert sorted(map(repr, map(tuple, only.collect()))) == ["(4, 0, 4, True)", "(None, 0, None, True)"]


def test_query_on_the_table_with_large_groups(spark):
    d = "/root/testdata/check_h"
    got = QUERIES["op11_embedding_dedup"](spark, d).toPandas().set_index("vec_id")
    e = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    x = np.stack(e.embedding).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = np.concatenate([(u[a : a + 1000] @ u.T >= 0.9).sum(axis=1) - 1 for a in range(0, len(u), 1000)])
    assert len(got) == len(e) and (got.loc[e.vec_id].n_links.to_numpy() <= links).all()
    assert got.n_links.sum() >= 0.99 * links.sum()
