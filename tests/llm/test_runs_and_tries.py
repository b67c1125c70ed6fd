import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from argusledger.llm import chattrie, periodic
from argusledger.llm.queries import QUERIES, SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, n_words string, runs string, node string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_runs(words, least=12, exponent=2):
    """All runs by trying every lag and growing every place, and the smallest lag of equal stretches."""
    best = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                best.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def plain_report(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = sorted((s, q, m) for s, m, q in runs)
    return (doc_id, len(runs), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4), sha("".join(f"{s},{m},{q}\n" for s, q, m in told)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t ", "a", "a b " * 40, "x" * 30_000 + " y", "x " * 11, "x " * 12, "\x1c a \x85 " * 9]
    for k in range(120):
        base = [rng.choice("abcdef漢é") for _ in range(rng.randrange(60))]
        piece = [rng.choice("ab") for _ in range(rng.randrange(1, 12))]
        out.append(" ".join(base + piece * rng.randrange(9) + base[: rng.randrange(30)] + piece[::-1] * rng.randrange(5)))
    return out


@pytest.mark.parametrize("whole", [periodic.WHOLE, 5])
def test_runs_by_brute_force(spark, texts, whole, monkeypatch):
    monkeypatch.setattr(periodic.find_runs, "__defaults__", (12, 2, "text", whole, 100))
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(5, texts[20]), (5, texts[20]), (5, texts[21])]
    docs = spark.createDataFrame([(*r, "n", "r", "x") for r in rows], DOCS)
    got = sorted(map(repr, (tuple(r) for r in periodic.report(docs).collect())))
    assert got == sorted(repr(plain_report(*r)) for r in rows)
    found = periodic.find_runs(docs)
    assert sorted(found.columns) == sorted(docs.columns + ["collapsed"])
    for r in found.filter("doc_id = 20").collect():
        assert [(x.start, x.length, x.period) for x in r.runs] == sorted(plain_runs(WORD.findall(r.text)), key=lambda x: (x[0], x[2])) and r.node == "x"
    assert periodic.report(docs.limit(0)).count() == 0


def test_long_text_in_lag_ranges(spark, monkeypatch):
    rng = np.random.default_rng(1)
    words = [f"w{x}" for x in rng.integers(0, 4000, 30_000)]
    words[9000:21_000] = words[9000:12_000] * 4
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words)), (3, "tail")], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.find_runs(docs).collect()}
    assert [tuple(x) for x in got[1].runs] == [(9000, 12_000, 3000)] and got[2].runs == got[1].runs and got[3].runs == []
    assert got[1].collapsed == " ".join(words[:12_000] + words[21_000:]) and got[1].n_words == 30_000


def plain_trie(rebuilt):
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    ends = {node: sha(",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(node))) for node, cs in members.items()}
    return sorted((min(cs), len(node), min(members[node[:-1]]) if node else -(10**9), len(cs), len(kids[node]), leaves[node], saved[node], ends[node]) for node, cs in members.items())


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + v[h:]
    return out


def told(df):
    return sorted(tuple(-(10**9) if x is None else x for x in r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def test_trie_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(None, 1, "user", "x"), (7, None, None, None), (7, None, None, None), (11, 3, "user", "é漢"), (3_000_000, 0, "user", "long " * 9000)]
    for c in range(300):
        deep = rng.choice([1, 3, 3, 8, 20])
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", None])) for t in range(deep)]
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(150) for t in range(7)]  # a third are copies
    rows += [(5000 + 100 * c + 3, t, "user", f"same {t}") for c in range(30) for t in range(3)]  # no first conversation: turnless or short
    conv = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int")
    want = plain_trie(plain_rebuilt(rows))
    assert any(r[1] == 0 and r[7] != chattrie._EMPTY for r in want)  # turnless ones end at the root
    assert told(chattrie.report(conv)) == want
    assert chattrie.report(conv.limit(0)).count() == 0
    alone = conv.filter("conv_id = 3000000")
    assert told(chattrie.report(alone)) == plain_trie(plain_rebuilt([r for r in rows if r[0] == 3_000_000]))


@pytest.mark.parametrize("name", ["op12_periodic_runs", "op13_prefix_trie"])
def test_parity_at_ten_times(same, name):
    same(QUERIES[name], SQL[name], "/root/testdata/sf0.01")


def test_stages_on_an_empty_table_and_a_long_text(spark):
    import corpus_pipeline
    from argusledger.llm import decontaminate, jaccard, linededup, mixing, substring, tokenpack

    sf = "/root/testdata/sf0.001"
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, none, sf)
        assert got.count() == 0 and (name == "token_output" or got.columns == none.columns)
    long = " ".join(f"word{i}" for i in range(60_000))  # over half a megabyte
    docs = spark.createDataFrame([(1, long, "a"), (2, long.replace("word7 ", "other "), "a"), (3, "short", "b")], "doc_id long, text string, source string")
    bench = spark.createDataFrame([(5, " ".join(f"word{i}" for i in range(59_980, 60_000)))], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.report(docs, bench).collect()} == {1: 20, 2: 20, 3: 0}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.report(docs).collect()} == {1: (59_996, 1), 2: (59_996, 1), 3: (1, 3)}
    assert {r.doc_id: r.n_removed for r in substring.report(docs).collect()} == {1: 59_992, 2: 59_992, 3: 0}
    assert {r.doc_id: r.size for r in mixing.report(docs).collect()} == {1: 60_000, 2: 60_000, 3: 1}
    assert linededup.report(docs).count() == 3 and {r.doc_id: r.n_tokens > 60_000 for r in tokenpack.report(docs).collect()} == {1: True, 2: True, 3: False}
