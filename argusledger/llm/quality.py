"""Quality classifier: a sparse rule ensemble over text statistics, compiled to Spark column expressions.

Statistics of each whole text come from a numpy kernel.  Small boosted trees are grown on a bounded sample of labelled
rows (``FIT``); each path from a root to a node is a rule, a conjunction of comparisons.  A lasso logistic regression
weighs the rules, with its penalty chosen on rows held apart, and the few that are left are compiled to one column
expression over the statistics.

Edge cases: null and empty texts have statistics of 0 and are scored by the rules like any other; labels that are
null, or of no document, are ignored; repeated rows are scored alike, and a label of a doc_id that several rows share is learned
from one of them, that with the smallest hash of its text; with one
class of labels, or none, the score is their mean, or 0.5; an empty table gives an empty one.  Other columns, of any names,
pass through; input columns named ``qs_score`` or like a statistic (``qs_*`` of STATS) are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argusledger.llm.common import NOT_SPACE, Shield, Words, chunks, release

#: Labelled rows that rules are fitted on, at most.
FIT = 8000
STATS = (
    "n_bytes", "n_words", "n_lines", "word_bytes", "upper", "digit", "symbol", "stop", "comma", "bang", "pipe", "non_ascii",
    "distinct", "again", "line_again", "line_words", "capital_words", "marked_words", "long_words", "one_byte_words",
)


def _classes() -> np.ndarray:
    """For each byte, which of seven classes it counts in."""
    out = np.zeros((256, 7), np.uint8)
    out[0x41:0x5B, 0] = 1
    out[0x30:0x3A, 1] = 1
    for c in b"#$%&*@^~+=<>{}[]\\/_`":
        out[c, 2] = 1
    for i, c in enumerate((b".", b",;:", b"!?", b"|"), 3):
        for x in c:
            out[x, i] = 1
    return out


_CLASS = _classes()


def statistics(arr: pa.Array) -> dict[str, np.ndarray]:
    """STATS of each text of a column."""
    w = Words(arr, NOT_SPACE, lower=False)
    raw, off, docs = w.raw, w.off, len(w.off) - 1
    size = np.diff(off).astype(np.float64)
    words = np.diff(w.span).astype(np.float64)

    def by_doc(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return np.diff(total[edges]).astype(np.float64)

    per = lambda x, of: x / np.maximum(of, 1)
    length = w.ends - w.starts
    last, first = raw[w.ends - 1] if len(length) else raw[:0], raw[w.starts] if len(length) else raw[:0]
    alnum = lambda c: ((c >= 0x30) & (c <= 0x39)) | ((c >= 0x41) & (c <= 0x5A)) | ((c >= 0x61) & (c <= 0x7A)) | (c >= 0x80)
    same = np.concatenate([w.hash[1:] == w.hash[:-1], [False]]) if len(length) else np.zeros(0, bool)
    upper = _CLASS[raw, 0]
    ups = np.concatenate([[0], np.cumsum(upper, dtype=np.int64)])
    out = {
        "n_bytes": size, "n_words": words, "word_bytes": per(by_doc(np.ones(0), np.zeros(docs + 1, int)) if not len(length) else by_doc(length, w.span), words),
        "n_lines": by_doc(raw == 10, off) + (size > 0),
        "upper": per(by_doc(upper, off), size), "non_ascii": per(by_doc(raw >= 0x80, off), size),
        "again": per(by_doc(same, w.span), words), "long_words": per(by_doc(length > 24, w.span), words), "one_byte_words": per(by_doc(length == 1, w.span), words),
        "capital_words": per(by_doc(2 * (ups[w.ends] - ups[w.starts]) > length, w.span), words),
        "marked_words": per(by_doc(~alnum(last) & ~np.isin(last, np.frombuffer(b".,", np.uint8)) | ~alnum(first), w.span), words),
    }
    for name, k in (("digit", 1), ("symbol", 2), ("stop", 3), ("comma", 4), ("bang", 5), ("pipe", 6)):
        out[name] = per(by_doc(_CLASS[raw, k], off), size)
    distinct, line_again = np.zeros(docs), np.zeros(docs)
    breaks = np.concatenate([[-1], np.flatnonzero(raw == 10)])
    line_of = np.searchsorted(breaks, w.starts, "right")
    for d, (a, b) in enumerate(zip(w.span[:-1].tolist(), w.span[1:].tolist(), strict=True)):
        if b > a:
            own = np.sort(w.hash[a:b])
            distinct[d] = (1 + np.count_nonzero(own[1:] != own[:-1])) / (b - a)
            lines = line_of[a:b]
            edge = np.concatenate([[0], np.flatnonzero(lines[1:] != lines[:-1]) + 1])
            key = np.sort(np.add.reduceat(w.hash[a:b], edge))
            line_again[d] = np.count_nonzero(key[1:] == key[:-1]) / len(key)
    out["distinct"], out["line_again"], out["line_words"] = distinct, line_again, per(words, out["n_lines"])
    return {k: out[k] for k in STATS}


def _stats(batches):
    for batch in batches:
        for part in chunks(batch, "text"):
            own = statistics(part.column("text"))
            columns = {c: part.column(c) for c in part.schema.names if c != "text"}
            yield pa.RecordBatch.from_pydict(columns | {f"qs_{k}": pa.array(v, pa.float64()) for k, v in own.items()})
    release()


def _with_statistics(own: Shield) -> DataFrame:
    kept = [f for f in own.df.schema.fields if f.name != "text"]
    return own.df.mapInArrow(_stats, T.StructType([*kept, *[T.StructField(f"qs_{k}", T.DoubleType()) for k in STATS]]))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics as columns ``qs_*`` in place of the text."""
    own = Shield(docs, "text")
    return own.back(_with_statistics(own), {f"qs_{k}": f"qs_{k}" for k in STATS}, drop=("text",))


#: A rule: comparisons (statistic, above?, threshold) that all hold.
Rule = tuple[tuple[str, bool, float], ...]


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for name, above, at in rule:
        v = x[:, STATS.index(name)]
        ok &= v > at if above else v <= at
    return ok


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3) -> list[Rule]:
    """Paths of boosted trees, over thresholds at quantiles."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 25))) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)  # bin <= k: x <= cut k
    score = np.full(len(y), math.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    found: dict[Rule, None] = {}

    def split(rows, grad, weight):
        best = (1e-9, 0, 0)
        g_all, h_all = grad[rows].sum(), weight[rows].sum()
        for j, c in enumerate(cuts):
            g = np.cumsum(np.bincount(bins[rows, j], grad[rows], len(c) + 1))[:-1]
            h = np.cumsum(np.bincount(bins[rows, j], weight[rows], len(c) + 1))[:-1]
            n = np.cumsum(np.bincount(bins[rows, j], minlength=len(c) + 1))[:-1]
            gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
            gain = np.where((n >= 8) & (len(rows) - n >= 8), gain, 0)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), j, int(gain.argmax()))
        return best

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, weight = y - p, p * (1 - p)
        stack: list[tuple[np.ndarray, Rule]] = [(np.arange(len(y)), ())]
        while stack:
            rows, path = stack.pop()
            gain, j, k = split(rows, grad, weight) if len(path) < depth else (0, 0, 0)
            if gain <= 1e-3:
                score[rows] += rate * grad[rows].sum() / (weight[rows].sum() + 1)
                continue
            low = bins[rows, j] <= k
            for above, part in ((False, rows[low]), (True, rows[~low])):
                rule = (*path, (STATS[j], above, float(cuts[j][k])))
                found[rule] = None
                stack.append((part, rule))
    return list(found)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty, by accelerated proximal gradient."""
    n, m = r.shape
    step = 4.0 / (np.linalg.norm(np.c_[r, np.ones(n)], 2) ** 2 / n)
    w = v = np.zeros(m + 1)
    t = 1.0
    a = np.c_[r, np.ones(n)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a @ v)))
        new = v - step * (a.T @ (p - y) / n)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


def fit_rules(x: np.ndarray, y: np.ndarray) -> tuple[list[tuple[Rule, float]], float]:
    """Weighed rules and the bias."""
    rate = float(y.mean()) if len(y) else 0.5
    if len(y) < 20 or rate in (0.0, 1.0):
        rate = min(max(rate, 1e-3), 1 - 1e-3)
        return [], math.log(rate / (1 - rate))
    apart = np.arange(len(y)) % 5 == 0
    rules = grow_rules(x[~apart], y[~apart])
    r = np.stack([_holds(u, x) for u in rules], axis=1).astype(np.float64) if rules else np.zeros((len(y), 0))
    best = None
    for penalty in (0.0003, 0.001, 0.003):
        w, b = lasso(r[~apart], y[~apart], penalty)
        p = np.clip(1 / (1 + np.exp(-(r[apart] @ w + b))), 1e-6, 1 - 1e-6)
        loss = -(y[apart] * np.log(p) + (1 - y[apart]) * np.log(1 - p)).mean()
        if best is None or loss < best[0] - 1e-4:
            best = (loss, w, b)
    _, w, b = best
    return [(u, float(k)) for u, k in zip(rules, w, strict=True) if abs(k) > 1e-9], b


def compile_rules(rules: list[tuple[Rule, float]], bias: float, prefix: str = "qs_") -> Column:
    """The score (0 to 1) as an expression over the statistics' columns."""
    total = F.lit(bias)
    for rule, weight in rules:
        hold = None
        for name, above, at in rule:
            one = F.col(f"{prefix}{name}") > at if above else F.col(f"{prefix}{name}") <= at
            hold = one if hold is None else hold & one
        total = total + F.when(hold, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit: int = FIT, label_col: str = "quality") -> tuple[list[tuple[Rule, float]], float]:
    """Rules from the labelled rows that may be learned from: a sample of at most ``2 * fit``, by a hash of the id.

    The driver sees the statistics of one row of each sampled label, however many rows share its doc_id.
    """
    own = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_id"))).distinct()
    total = own.count()
    share = min(1.0, fit / max(1, total))
    own = own.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("_id"), "_id").limit(2 * fit)
    rows = docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("_id")).select("doc_id", "_y", "text", F.xxhash64("text").alias("_h"))
    told = [f"qs_{k}" for k in STATS]
    one = with_statistics(rows).groupBy("doc_id", "_y").agg(F.min_by(F.struct(*told), "_h").alias("s"))
    got = one.select("doc_id", "_y", "s.*").orderBy(F.xxhash64("doc_id"), "doc_id", "_y").toArrow()
    x = np.stack([got.column(f"qs_{k}").to_numpy() for k in STATS], axis=1) if got.num_rows else np.zeros((0, len(STATS)))
    return fit_rules(x, got.column("_y").to_numpy().astype(np.float64))


def score(docs: DataFrame, rules: list[tuple[Rule, float]], bias: float) -> DataFrame:
    """``docs`` less ``text``, with the statistics and ``qs_score``."""
    own = Shield(docs, "text")
    out = _with_statistics(own).withColumn("m_score", compile_rules(rules, bias))
    return own.back(out, {**{f"qs_{k}": f"qs_{k}" for k in STATS}, "qs_score": "m_score"}, drop=("text",))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs.select("doc_id", "text"), *train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("qs_score").alias("score"), (F.col("qs_score") >= 0.3).cast("int").alias("predicted"))
