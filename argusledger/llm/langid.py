"""Language ID: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's features are all its byte n-grams (A-Z lower-cased), hashed to ``BUCKETS``; their embeddings are averaged and a
linear layer gives a score for each language.  Because the average is linear, the trained model is folded to one
table of per-n-gram scores, so scoring a whole text is one gather and one sum.  A temperature and the rejection
threshold are calibrated on documents that SGD did not see.

The model is fitted on a bounded sample of labelled rows: about ``fit`` documents over the ``languages`` most frequent languages, of
each at most ``snippets`` pieces of ``snippet`` characters, spread over the whole text (arguments of :func:`train`).  Only those
languages are learned, whatever others the rows name.  Texts are scored whole.  Edge cases: a text
that is null or has no letter is ``und`` with score 0 and rejected; without labelled rows every text is ``und`` with
score 0 and none is rejected but those without a letter; repeated rows and ties are judged alike; an empty table gives an
empty one.  Other columns, of any names, pass through; input columns named ``li_lang``, ``li_score`` or ``li_rejected`` are
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argusledger.llm.common import _LOWER, Shield, chunks, release, text_bytes

#: Labelled documents that the model is fitted on, at most; hash buckets, width of an embedding, n-gram lengths.
FIT, BUCKETS, WIDTH, GRAMS = 4000, 1 << 16, 16, (2, 4)
#: What a document gives to the fit, at most: pieces, and characters of a piece.
SNIPPETS, SNIPPET = 8, 1024
#: Languages that are learned, at most; each gives 20 documents or more, if it has them.
LANGUAGES = 200


def _ids(raw: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram from each byte on."""
    b = raw.astype(np.uint32)
    x = np.full(max(0, len(b) - n + 1), n, np.uint32)
    for k in range(n):
        x = (x * np.uint32(0x01000193)) ^ b[k : len(b) - n + 1 + k]
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA6B)
    return (x >> np.uint32(16)) & np.uint32(BUCKETS - 1)


def _features(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([_ids(raw, n) for n in GRAMS])
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0)
    key, times = np.unique(ids, return_counts=True)
    return key.astype(np.int64), times / times.sum()


def _clip(step: np.ndarray) -> np.ndarray:
    """A step of length 1 at most: texts that are always judged wrongly (noise) can't drive the weights away."""
    return step / max(1.0, float(np.sqrt((step * step).sum())))


class Model:
    """``table``: a row of language scores for each bucket; ``bias``; ``langs``; ``sharp`` (1 / temperature); ``least``."""

    def __init__(self, texts: list[str], langs: list[str], seed: int = 3, epochs: int = 4, rate: float = 0.5):
        self.langs = sorted(set(langs), key=lambda x: x.encode())
        of = {x: i for i, x in enumerate(self.langs)}
        rng = np.random.default_rng(seed)
        raws = [_LOWER[np.frombuffer(t.encode(), np.uint8)] for t in texts]
        y = np.array([of[x] for x in langs], np.int64)
        held = np.arange(len(raws)) % 5 == 0
        embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
        weight = np.zeros((len(self.langs), WIDTH), np.float32)
        bias = np.zeros(len(self.langs), np.float32)
        weight[:] = rng.normal(0, 0.1, weight.shape)

        def snippet(raw):
            size = int(rng.integers(8, 400))
            at = int(rng.integers(0, max(1, len(raw) - size)))
            return raw[at : at + size]

        whole = [_features(r) for r in raws]
        steps, done = epochs * 2 * int((~held).sum()), 0
        for _ in range(epochs):
            for i in rng.permutation(np.flatnonzero(~held)).tolist():
                for key, share in (whole[i], _features(snippet(raws[i]))):
                    if not len(key):
                        continue
                    lr = rate * (1 - done / max(1, steps))
                    done += 1
                    rows = embed[key]
                    h = share @ rows
                    z = weight @ h + bias
                    z = np.exp(z - z.max())
                    grad = z / z.sum()
                    grad[y[i]] -= 1
                    back = _clip(weight.T @ grad)
                    weight -= (lr * _clip(np.outer(grad, h))).astype(np.float32)
                    bias -= (lr * 0.1 * grad).astype(np.float32)
                    # The average moves by lr * back, however many buckets a text has and however uneven their shares are.
                    embed[key] = rows - np.outer(lr / (share @ share) * share, back).astype(np.float32)
        self.layers = embed, weight  # for tests: not shipped
        self.table = (embed @ weight.T).astype(np.float32)
        if not np.isfinite(self.table).all():
            raise FloatingPointError("the language model's training diverged")
        self.bias, self.sharp, self.least = bias.astype(np.float64), 1.0, 0.0
        self._calibrate([_features(snippet(raws[i])) if j % 2 else whole[i] for j, i in enumerate(np.flatnonzero(held).tolist())], y[held])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "layers"}

    def _calibrate(self, features, y) -> None:
        z = np.array([share @ self.table[key] + self.bias if len(key) else self.bias for key, share in features]).reshape(-1, len(self.langs))
        if not len(z):
            return

        def loss(sharp):  # with smoothed labels, so that a few sure texts don't make every text sure
            log = np.log(np.maximum(self.chances(z, sharp), 1e-12))
            return -(0.95 * log[np.arange(len(y)), y] + 0.05 * log.mean(axis=1)).mean()

        self.sharp = min(np.geomspace(0.02, 10, 61), key=loss)
        p = self.chances(z, self.sharp)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        #: Below all that was right among the held texts: what is less sure than any of them is no known language.
        self.least = float(min(0.5, 0.9 * right.min())) if len(right) else 0.0

    @staticmethod
    def chances(z: np.ndarray, sharp: float) -> np.ndarray:
        z = z * sharp
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def score(self, arr: pa.Array) -> np.ndarray:
        """Chances of each language, for all texts of a column."""
        raw, off = text_bytes(arr)
        raw = _LOWER[raw]
        total = np.zeros((len(off) - 1, len(self.langs)))
        size = np.zeros(len(off) - 1)
        for n in GRAMS:
            ids = _ids(raw, n)
            lo, hi = off[:-1], np.maximum(off[:-1], off[1:] - n + 1)
            some = np.flatnonzero(hi > lo)
            if not len(some):
                continue
            edge = np.stack([lo[some], hi[some]], axis=1).ravel()
            rows = np.concatenate([self.table[ids], np.zeros((1, len(self.langs)), np.float32)])
            total[some] += np.add.reduceat(rows, edge, axis=0, dtype=np.float64)[::2]
            size[some] += hi[some] - lo[some]
        return self.chances(total / np.maximum(size, 1)[:, None] + self.bias, self.sharp)


def held_out(doc_id: Column) -> Column:
    """Rows that no model of op8 may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, fit: int = FIT, languages: int = LANGUAGES, snippets: int = SNIPPETS, snippet: int = SNIPPET) -> Model | None:
    """A model from the rows of (doc_id, text, lang) that may be learned from; None without any.

    The driver sees ``languages`` counts and ``max(2 * fit, 40 * languages)`` rows at most, however many languages there are.
    """
    own = docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & has_letter(F.col("text")))
    counts = {r.lang: r["count"] for r in own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return None
    # Of each language an equal share of FIT, chosen by a hash of the row.
    quota = max(20, fit // len(counts))
    pick = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, quota / n) * (1 << 30)))])
    # A long text is cut to pieces at even distances, which bounds what reaches the driver.
    most, n = snippets * snippet, F.length("text")
    step = ((n - snippet) / max(1, snippets - 1)).cast("int")
    pieces = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(snippets - 1)), lambda i: F.substring("text", i * step + 1, F.lit(snippet))), "\n")
    own = own.filter(F.col("lang").isin(*counts)).select(F.xxhash64("doc_id", "text").alias("h"), pick.alias("pick"), "doc_id", "lang", F.when(n <= most, F.col("text")).otherwise(pieces).alias("text"))
    rows = own.filter(F.col("pick") < F.element_at(share, F.col("lang"))).orderBy("h", "doc_id").limit(max(2 * fit, 40 * languages)).toArrow().to_pylist()
    if not rows:
        rows = [r.asDict() for r in own.orderBy("h", "doc_id").limit(fit).collect()]
    return Model([r["text"] for r in rows], [r["lang"] for r in rows])


def _score(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                p = model.score(part.column("text"))
                top = p.argmax(axis=1)
                letter = part.column("m_letter").to_numpy(zero_copy_only=False).astype(bool)
                best = np.where(letter, p[np.arange(len(top)), top], 0.0)
                lang = [model.langs[i] if ok else "und" for i, ok in zip(top.tolist(), letter.tolist(), strict=True)]
                columns = {c: part.column(c) for c in part.schema.names if c != "m_letter"}
                yield pa.RecordBatch.from_pydict(columns | {"m_lang": pa.array(lang, pa.string()), "m_score": pa.array(best, pa.float64()), "m_rejected": pa.array(~letter | (best < model.least))})
        release()

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``li_lang``, ``li_score`` and ``li_rejected``; the text is the only input."""
    own = Shield(docs, "text")
    marked = own.df.withColumn("m_letter", has_letter(F.col("text")))
    new = {"li_lang": "m_lang", "li_score": "m_score", "li_rejected": "m_rejected"}
    if model is None:
        return own.back(marked.withColumns({"m_lang": F.lit("und"), "m_score": F.lit(0.0), "m_rejected": ~F.col("m_letter")}), new)
    schema = T.StructType([*own.df.schema.fields, T.StructField("m_lang", T.StringType()), T.StructField("m_score", T.DoubleType()), T.StructField("m_rejected", T.BooleanType())])
    return own.back(marked.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), schema), new)


def recognised(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` less the rejected ones."""
    own = Shield(docs, "text")
    return own.back(identify(own.df, model).filter(~F.col("li_rejected")))


def report(docs: DataFrame) -> DataFrame:
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("li_lang").alias("lang_pred"), F.col("li_score").alias("score"), F.col("li_rejected").alias("rejected"))
