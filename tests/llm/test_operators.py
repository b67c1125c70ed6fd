import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from argusledger.llm import annsearch, chatformat, decontaminate, jaccard, langid, linededup, mixing, quality, substring, tokenpack
from argusledger.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_hit string, node string"
LONG = " ".join(f"w{i}" for i in range(3000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(1, LONG, "en", "a", None, "x", "y"), (2, LONG + " tail", "en", "a", 1, None, None), (2, LONG + " tail", "en", "a", 1, None, None), (3, None, None, None, None, None, None),
            (4, "", "de", "b", 0, "", ""), (5, "  \n\t ", "de", None, 3, "", ""), (None, "no id here at all", "en", "c", 3, "", ""), (6, "ünï 漢字 \n a b c\n a b c", "fr", "b", 1, "", "")]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_parity(same, name):
    same(QUERIES[name], SQL[name])


def test_odd_rows_and_empty_tables(spark, odd):
    bench = spark.createDataFrame([(1, "w10 W11 w12"), (2, None), (None, "x"), (3, ""), (1, "w10 W11 w12")], "item_id long, text string")
    got = decontaminate.report(odd, bench).collect()
    assert sorted((r.doc_id or 0, r.n_hit) for r in got) == [(0, 0), (1, 3), (2, 3), (2, 3), (3, 0), (4, 0), (5, 0), (6, 0)]
    assert decontaminate.decontaminate(odd, bench).columns == odd.columns
    cleaned = decontaminate.decontaminate(odd, bench, remove="spans").filter("doc_id = 1").first().text
    assert "w10 " not in cleaned and "w9  w13" in cleaned
    near = {r.doc_id: r for r in jaccard.report(odd).collect()}
    assert near[2].component_id == 1 and near[3].n_shingles == 0 and near[3].component_id == 3 and near[6].component_id == 6
    sub = {r.doc_id: r for r in substring.report(odd).collect()}
    assert sub[1].n_removed == 3000 and sub[2].n_removed == 3001 and sub[4].n_words == 0
    mixed = mixing.report(odd).collect()
    assert len(mixed) == 8 and all(0 <= r.taken <= 3 * r.size for r in mixed)
    assert {r.doc_id: r.n_lines for r in linededup.report(odd).collect()}[3] == 0
    model = langid.train(odd)
    assert {r.doc_id: r.lang_pred for r in langid.report(odd).collect()}[3] == "und" and model is not None
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (99, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.report(odd, labels).collect())
    assert [r.start for r in tokenpack.report(odd).orderBy("start").collect()][0] == 0
    none = odd.limit(0)
    for f in (jaccard.report, substring.report, mixing.report, linededup.report, langid.report, tokenpack.report):
        assert f(none).count() == 0
    assert decontaminate.report(none, bench.limit(0)).count() == 0 and quality.report(none, labels.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi & <b>"), (1, 1, "assistant", "</s><|turn|>x"), (1, 1, "assistant", "</s><|turn|>x"), (2, 0, "assistant", None), (None, None, None, None), (3, 0, "a\nb", "&lt;")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chatformat.read_back(chatformat.format_chats(conv)).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", "hi & <b>"), ("assistant", "</s><|turn|>x"), ("assistant", "</s><|turn|>x")] and not back[1].valid
    assert [tuple(t) for t in back[3].turns] == [("a\nb", "&lt;")] and back[2].loss_texts == [""] and [tuple(t) for t in back[None].turns] == [("", "")]
    assert chatformat.report(conv.limit(0)).filter("conv_id = -1 and valid").count() == 1


def test_jaccard_in_all_ways(spark, same, monkeypatch):
    import argusledger.functions.tables as t

    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(jaccard, "small", lambda df: t.small(df, -1))
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    same(QUERIES["op4_jaccard_join"], SQL["op4_jaccard_join"])


def test_decontamination_in_blocks(same, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    same(QUERIES["op1_decontaminate"], SQL["op1_decontaminate"])


def test_blocks_mark_as_one(spark, monkeypatch):
    from argusledger.llm.common import read

    bench = read(spark, SF, "benchmark").select("item_id", "text")
    first = [r.text for r in bench.orderBy("item_id").limit(3).collect()]
    odd = [(None, f"a {first[0]} b {first[1]}", 1), (7, None, 2), (7, "", 3), (7, f"{first[2]} " * 2000, 4), (8, "none of it", 5), (8, "none of it", 5)]
    docs = read(spark, SF, "documents").select("doc_id", "text", F.lit(0).alias("m_id")).unionByName(spark.createDataFrame(odd, "doc_id long, text string, m_id int"))
    kept = lambda df: sorted(map(repr, df.collect()))
    made = lambda: (kept(decontaminate.annotate(docs, bench)), kept(decontaminate.decontaminate(docs, bench)), kept(decontaminate.decontaminate(docs, bench, remove="spans")), kept(decontaminate.annotate(docs.limit(0), bench)))
    whole = made()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert made() == whole and len(whole[1]) < docs.count()


def test_apportionment():
    rng = np.random.default_rng(1)
    for _ in range(200):
        w, n = rng.integers(1, 50, 6).astype(float).tolist(), int(rng.integers(0, 60))
        most = rng.integers(1, 30, 6).tolist()
        own = [0] * 6
        for _ in range(min(n, sum(most))):
            i = max((i for i in range(6) if own[i] < most[i]), key=lambda i: (w[i] / (2 * own[i] + 1), -i))
            own[i] += 1
        assert mixing.apportion(w, n, most) == own
    assert mixing.water_fill([10, 100, 0], [1, 1, 1], 110, 3) == [30, 80, 0]


def test_mix_meets_targets(spark):
    p = mixing.report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    g = p.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((g.taken - g.target).abs() / g.target).max() < 0.01 and abs(g.target.sum() - p["size"].sum()) < 1e-6
    docs = mixing.mixed_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    assert sum(len(x.split()) for x in docs.text) == p.taken.sum()


def test_nearest(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    odd = [(10**6, None), (10**6 + 50, [0.0] * 64), (10**6 + 100, [float("nan")] * 64), (10**6 + 1, [1.0])]
    got = annsearch.report(spark.createDataFrame([*[(int(i), [float(x) for x in v]) for i, v in zip(e.vec_id, e.embedding)], *odd], "vec_id long, embedding array<float>")).toPandas()
    x = np.stack(e.embedding).astype(float)
    u, hit = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    queries = [i for i in e.vec_id if i % 50 == 0]
    for q in queries:
        s = u @ u[list(e.vec_id).index(q)]
        s[list(e.vec_id).index(q)] = -9
        hit += len(set(e.vec_id[np.argsort(-s)[:5]]) & set(got[got.query_id == q].vec_id))
    assert hit >= 0.9 * 5 * len(queries) and set(got.query_id) == set(queries)
    assert annsearch.report(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    few = annsearch.report(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in few] == [(1, 1.0), (2, 1.0)]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    p = langid.report(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas())
    assert (p[p.held_out].lang == p[p.held_out].lang_pred).mean() > 0.98 and p.rejected.mean() < 0.01
    q = quality.report(docs, labels).toPandas().merge(labels.toPandas())
    q = q[q.held_out]
    assert (q.predicted == q.quality).mean() > 0.9


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 20])
def test_packs(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 10_001).astype(np.uint32)
    p = tokenpack.Pack(tokenpack.pack(ids, np.array([0, 5, 5, 10_001]), np.array([3, 4, 9]), bits, block=100 if bits % 8 else 128))
    assert (p.ids() == ids).all() and (p.ids(333, 7777) == ids[333:7777]).all() and len(p.document(1)) == 0 and (p.document(2) == ids[5:]).all()


def test_encoder_agrees_with_the_library(monkeypatch):
    import random

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        coder = tokenpack.Encoder(f.read())
    monkeypatch.setattr(tokenpack._trim, "__defaults__", (60, 20))
    rng, parts = random.Random(5), [" ", " ", "  ", "\n", "\t", "a", "é", "ß", "don't", "'s", "1", "23", "_", "...", "<|", "x", "<|endoftext|>", "½", "—", "\u3000", "日本", "\xa0", "\xad", "\r\n"]
    texts = ["".join(rng.choice(parts[: 16 if rng.random() < 0.7 else None]) for _ in range(rng.randrange(14))) for _ in range(5000)]
    got = [x for i in range(0, len(texts), 97) for x in coder.encode(texts[i : i + 97])]
    assert got == coder._ids(texts)


def test_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a  b \n c\n\n  d ", "it's we'll 'S x²³ ½ ªº né", "\tα <|endoftext|> y", " ", "", None, "x y z", "日本", "end  ", "a b\nc d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    at = 0
    for r in tokenpack.report(docs).orderBy("doc_id").collect():
        ids = np.array([*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.toPandas(), after.schema)
    assert 0 < corpus_pipeline.run(spark, SF).count()
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), SF).count() == 0


def test_language_model_stays_finite_on_uneven_and_mislabelled_texts():
    words = {"aa": "der hund und die katze sind nicht da", "bb": "the dog and the cat are not here", "cc": "el perro y el gato no estan aqui"}
    rng = np.random.default_rng(5)
    texts, langs = [], []
    for i in range(150):
        lang = "abc"[i % 3] * 2
        text = " ".join(rng.choice(words[lang].split(), 30))
        if i % 5 == 1:  # one line repeated, then letters in no order: many buckets, nearly all of the share in a few
            text += " " + words[lang] * 4000 + " " + "".join(chr(97 + x) for x in rng.integers(0, 26, 20_000))
        texts.append(text)
        langs.append("abc"[(i + 1) % 3] * 2 if i % 20 == 3 else lang)
    model = langid.Model(texts, langs)
    assert np.isfinite(model.table).all() and np.isfinite(model.bias).all()
    p = model.score(pa.array(list(words.values())))
    assert np.isfinite(p).all() and [model.langs[k] for k in p.argmax(axis=1)] == list(words)


def test_repeated_passages_go_whole(spark):
    rng, rows = np.random.default_rng(2), []
    plain = lambda k: [f"own {x}" for x in rng.integers(0, 1 << 40, k)]
    planted = [[f"p{j} line {i}" for i in range(3 + j)] for j in range(20)] + [["same"] * 7]
    for at in range(4):
        for j, lines in enumerate(planted):
            rows.append((at * 100 + j, "\n".join([*plain(3), *lines, *plain(3)])))
    rows += [(1000, "x\nx\nx"), (1001, "alone"), (1002, None), (1003, rows[5][1])]
    got = {r.doc_id: r for r in linededup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for at in range(4):
        for j, lines in enumerate(planted):
            first = 0 if j < 20 else 5  # of seven equal lines the first two stay
            assert got[at * 100 + j].ld_removed == (len(lines) if at else first)
    assert (got[1000].text, got[1001].text, got[1002].text, got[1003].text) == ("x\nx\nx", "alone", "", "")


def test_near_duplicates_are_decided_by_row(spark):
    import corpus_pipeline

    own = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    a, b, c, d, e, f = map(own, "abcdef")
    rows = [(1, a, "x"), (2, a + " tail", "x"), (3, b, "x"), (3, b, "y"), (4, c, "x"), (4, a, "x"), (5, c, "x"), (6, d, "x"), (6, e, "x"), (None, f, "x"), (None, f, "x"), (None, a, "x"), (7, "", "x"), (7, "", "x"), (8, None, "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    want = [(1, a), (3, b), (4, c), (6, d), (6, e), (None, f), (7, ""), (7, ""), (8, None), (None, "")]
    assert sorted(repr((r.doc_id, r.text)) for r in got.collect()) == sorted(map(repr, want))


def test_pipeline_keeps_what_plain_rules_keep(spark):
    from collections import Counter

    import corpus_pipeline
    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer

    con = duckdb.connect()
    con.execute(f"create view benchmark as select * from '{SF}/benchmark.parquet'")

    def plain(documents, name, keep):
        con.register("documents", documents)
        return Counter(x for (x,) in con.sql(f"select doc_id from ({SQL[name]}) where {keep}").fetchall())

    docs, ids = spark.read.parquet(f"{SF}/documents.parquet"), lambda t: Counter(t.column("doc_id").to_pylist())
    stages, before = dict(corpus_pipeline.STAGES), docs.toArrow()
    now = lambda name: stages[name](spark, spark.createDataFrame(before), SF).toArrow()
    after = now("language_id")
    assert not ids(after) - ids(before) and sum((ids(before) - ids(after)).values()) <= 2
    before = after
    after = now("ngram_jaccard_join")
    assert ids(after) == plain(before, "op4_jaccard_join", "doc_id = component_id")
    before = after
    after = now("benchmark_decontamination")
    assert ids(after) == plain(before, "op1_decontaminate", "not contaminated")
    before = after
    after = now("source_mixing")
    rows = lambda t: zip(t.column("doc_id").to_pylist(), t.column("source").to_pylist(), t.column("text").to_pylist(), strict=True)
    whole, taken, size = {i: (s, t or "") for i, s, t in rows(before)}, Counter(), Counter()
    for s, t in whole.values():
        size[s] += len(t.split())
    times, cuts = Counter(), Counter()
    for i, s, t in rows(after):
        assert whole[i][0] == s and whole[i][1].startswith(t)
        taken[s] += len(t.split())
        times[i] += 1
        cuts[s] += t != whole[i][1]
    wanted = dict(zip(sorted(size), mixing.water_fill([size[s] for s in sorted(size)], [1 + k % 3 for k in range(len(size))], sum(size.values()), 3), strict=True))
    assert max(times.values()) <= 3 and max(cuts.values()) <= 1 and all(abs(taken[s] - wanted[s]) <= 1 for s in size)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in after.to_pylist():
        x = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"], len(x), zlib.crc32(x.tobytes())))
    got = sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted(want)


Q, R = ("\n".join(f"{k}{i} word" for i in range(40)) for k in "qr")
#: Ids that repeat with other texts, or are missing.
REPEATED = [(1, Q), (2, Q), (2, R), (3, None), (None, Q), (None, R + "\nmore"), (None, "x\ny\nz\nw"), (2, Q), (4, ""), (5, "a"), (6, "s\ns\ns\ns\ns"), (7, "s\ns\ns\ns\ns")]


def by_sql(sql, **views):
    import duckdb

    con = duckdb.connect()
    for name, rows in views.items():
        con.register(name, rows.toArrow())
    return sorted(map(repr, con.sql(sql).to_arrow_table().to_pylist()))


def rows_of(df, sql_columns):
    return sorted(repr({c: r[c] for c in sql_columns}) for r in df.toArrow().to_pylist())


def test_lines_of_repeated_ids(spark):
    docs = spark.createDataFrame(REPEATED, "doc_id long, text string")
    names = ("doc_id", "n_lines", "n_removed", "kept_sha256")
    assert rows_of(linededup.report(docs), names) == by_sql(linededup.SQL, documents=docs)
    assert rows_of(linededup.report(docs, linededup.dedup_passages), names) == by_sql(linededup.PASSAGES_SQL, documents=docs)
    assert all(r.ld_removed < 5 for r in linededup.dedup_lines(docs).filter("doc_id is null and text like '%more%'").collect())  # R's first place


def plain_substrings(rows, n):
    """Per row the kept words, by every window of n words."""
    from collections import Counter

    words = [(text or "").encode().split() for _, text in rows]
    times = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - n + 1) if times[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        out.append((doc, b" ".join(x for i, x in enumerate(w) if i not in gone).decode(), len(gone)))
    return sorted(map(repr, out))


@pytest.mark.parametrize(("n", "options"), [(6, {}), (6, {"often": 2}), (7, {"often": 3, "slices": (400, 300)}), (35, {"often": 4, "slices": (3000, 2000)})])
def test_extents_against_all_windows(spark, n, options):
    rng = np.random.default_rng(n)
    long = "L" * 300
    passage = [f"p{i}" for i in range(3 * n)]
    rows = []
    for i in range(120):
        w = rng.choice(["a", "b", "c", long, "\x00é", "d"], rng.integers(0, 5 * n)).tolist() if i % 2 else [f"u{i}_{j}" for j in range(rng.integers(0, 3 * n))]
        if i % 3 == 0:
            at, a = rng.integers(0, len(w) + 1), rng.integers(0, n)
            w[at:at] = passage[a : a + int(rng.integers(n - 2, 2 * n))]
        rows.append((None if i % 7 == 0 else i % 40, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [rows[3], rows[3], (None, None), (5, ""), (6, " ".join(passage)), (7, " ".join(passage[1:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(repr((r.doc_id, r.sd_text, r.sd_removed)) for r in substring.dedup_substrings(docs, n, **options).collect())
    assert got == plain_substrings(rows, n)
    assert sum(int(x.rpartition(", ")[2][:-1]) > 0 for x in got) > 20


def test_language_scores_by_plain_sums():
    """The folded table against the layers themselves, n-gram by n-gram."""
    texts = ["der hund ist da", "the dog is here", "el perro no esta", "a", "", "xyz " * 300] * 8
    model = langid.Model(texts, ["de", "en", "es", "en", "de", "es"] * 8, epochs=1)
    embed, weight = model.layers

    def bucket(gram):
        x = len(gram)
        for c in gram:
            x = (x * 0x01000193 & 0xFFFFFFFF) ^ c
        x ^= x >> 15
        return (x * 0x85EBCA6B & 0xFFFFFFFF) >> 16

    got = model.score(pa.array([*texts[:6], "ÜNÏ Hund", None]))
    for row, text in zip(got, [*texts[:6], "ÜNÏ Hund", ""], strict=True):
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
        ids = [bucket(raw[i : i + n]) for n in langid.GRAMS for i in range(len(raw) - n + 1)]
        z = weight @ np.mean([embed[i] for i in ids], axis=0) if ids else np.zeros(3)
        z = np.exp((z + model.bias) * model.sharp - ((z + model.bias) * model.sharp).max())
        assert np.allclose(row, z / z.sum(), atol=1e-4)
    import pickle

    assert not hasattr(pickle.loads(pickle.dumps(model)), "layers")


def test_rules_by_plain_logic(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules, bias = quality.train(docs, labels)
    rows = quality.score(docs.select("doc_id", "text"), rules, bias).toPandas().sort_values("doc_id")
    for r in rows.to_dict("records"):
        total = bias + sum(w for rule, w in rules if all(r[f"qs_{k}"] > at if above else r[f"qs_{k}"] <= at for k, above, at in rule))
        assert abs(r["qs_score"] - 1 / (1 + np.exp(-total))) < 1e-9
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in rows.to_dict("records")[:200]:
        text = texts[r["doc_id"]]
        raw, words = text.encode(), text.encode().split()
        lines = [x.split() for x in raw.split(b"\n")]
        own = [tuple(x) for x in lines if x]
        want = {"n_bytes": len(raw), "n_words": len(words), "n_lines": raw.count(b"\n") + bool(raw), "upper": sum(65 <= c <= 90 for c in raw) / max(1, len(raw)), "digit": sum(48 <= c <= 57 for c in raw) / max(1, len(raw)),
                "distinct": len(set(words)) / max(1, len(words)), "long_words": sum(len(w) > 24 for w in words) / max(1, len(words)), "again": sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words)), "line_again": (len(own) - len(set(own))) / max(1, len(own)) if words else 0}
        for k, v in want.items():
            assert abs(r[f"qs_{k}"] - v) < 1e-9, (k, r["doc_id"])


def test_taken_words_by_plain_streams(spark, monkeypatch):
    """Each document's share of its shard's first words, and every text of the written mix."""
    import re

    monkeypatch.setattr(mixing, "COPIES", 16)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 900)
    rows = [(None, "hot text of six words here", "a") for _ in range(300)] + [(i % 20, "w " * (i * 7 % 60), "abc"[i % 3]) for i in range(200)] + [(3, None, "c"), (None, "", None), (4, "only words", None), (5, " five words\tof a source\n", "tiny")]
    rows += [(100, " \n ".join(f"w{i}" for i in range(9000)), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    p = mixing.mix(docs).toPandas()
    assert len(p) == len(rows)
    text_of, want = {}, []
    for r in docs.select("text", *mixing.row_key("doc_id", "source", "text")).collect():
        text_of[r.k1, r.k2] = r.text
    for _, shard in p[p["size"] > 0].groupby(["source", "shard"], dropna=False):
        shard = shard.sort_values("begin")
        own = [i for i, n in zip(shard.index, shard["size"], strict=True) for _ in range(n)]  # the stream, word by word
        first = shard.iloc[0]
        assert shard.begin.tolist() == [own.index(i) for i in shard.index] and shard.given.nunique() == 1 and first.stream == len(own)
        taken = dict.fromkeys(shard.index, 0)
        for at in range(first.given):
            taken[own[at % len(own)]] += 1
        assert taken == shard.taken.to_dict()
        for i, n in taken.items():
            text, size = text_of[shard.k1[i], shard.k2[i]], int(shard["size"][i])
            want += [text] * (n // size)
            if n % size:
                want.append(re.match(r"[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){%d}" % (n % size), text)[0].rstrip())
        assert sum(n % s > 0 for n, s in zip(taken.values(), shard["size"], strict=True)) <= 1
    by_source = p.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"))
    assert (by_source.taken - by_source.target).abs().max() <= 0.5 and by_source.taken["tiny"] == 15
    got = mixing.mixed_documents(docs).toPandas()
    assert sorted(got.text) == sorted(want) and (p.taken <= 3 * p["size"]).all()
    again = mixing.report(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "source", "taken"]
    assert sorted(map(str, again[key].values.tolist())) == sorted(map(str, p.rename(columns={"id": "doc_id"})[key].values.tolist()))


def test_a_small_source_cuts_no_other(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    tiny = spark.createDataFrame([(-1, "just five words of text", "zz")], docs.schema)
    for df in (docs, docs.unionByName(tiny)):
        got = mixing.report(df).toPandas()
        cuts = got[(got["size"] > 0) & (got.taken % got["size"].clip(lower=1) > 0)]
        assert len(cuts) == len(cuts[["source", "shard"]].drop_duplicates()) <= got.source.nunique() + 1  # one a shard
        assert got[got.doc_id == -1].taken.tolist() in ([], [15])


def test_what_a_fit_may_read(spark, monkeypatch):
    """A labelled id of 100,000 rows, and 10,000 languages."""
    words = spark.createDataFrame([(i, f"some text {i} of words, more or less", i % 2) for i in range(1, 60)], "doc_id long, text string, quality int")
    hot = spark.range(100_000).select((F.lit(61) * F.lit(1)).alias("doc_id"), F.concat(F.lit("copy "), F.col("id")).alias("text"))
    seen = {}
    monkeypatch.setattr(quality, "fit_rules", lambda x, y: (seen.update(n=len(y)), ([], 0.0))[1])
    labels = words.select("doc_id", "quality").unionByName(spark.createDataFrame([(61, 1), (61, 1)], "doc_id long, quality int"))
    quality.train(words.select("doc_id", "text").unionByName(hot), labels)
    assert seen["n"] <= 60
    many = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"), F.concat(F.lit("l"), F.col("id") % 10_000).alias("lang"))
    monkeypatch.setattr(langid, "Model", lambda texts, langs: seen.update(texts=len(texts), langs=len(set(langs))))
    langid.train(many.union(spark.range(4000).select("id", F.lit("ein Text"), F.lit("de"))), languages=50)
    assert seen["langs"] == 50 and seen["texts"] <= 8000
    langid.train(spark.createDataFrame([(0, "z" * 10**6, "x"), (2, None, "y")], "doc_id long, text string, lang string"), snippets=1, snippet=100)


@pytest.mark.parametrize("options", [{}, {"leaf_rows": 32, "split": 200, "block": 64}])
def test_nearest_of_copies(spark, options):
    """A vector that a third of all rows hold, scaled copies, repeated ids: against all distances."""
    rng = np.random.default_rng(3)
    hot, other = rng.normal(size=8), rng.normal(size=(400, 8)) + 3 * rng.normal(size=(20, 8)).repeat(20, axis=0)
    rows = [(i, hot.tolist()) for i in range(300)] + [(1000 + i, x.tolist()) for i, x in enumerate(other)] + [(2000, (2 * hot).tolist()), (2001, hot.tolist()), (2001, hot.tolist()), (2050, other[0].tolist()), (2050, other[9].tolist())]
    got = annsearch.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50, **options).collect()
    want, hit = {}, 0
    for q in {i for i, _ in rows if i % 50 == 0}:
        near = {}
        for a in (np.array(v) for i, v in rows if i == q):
            for i, v in rows:
                if i != q:
                    s = float(annsearch.cosine(a, np.array([v]))[0])
                    near[i] = max(near.get(i, -2), s)
        want[q] = sorted(((-s, i) for i, s in near.items()))[:5]
    for q, w in want.items():
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and [x[2] for x in own] == sorted((x[2] for x in own), reverse=True)
        hit += len({i for _, i, _ in own} & {i for _, i in w})
        if q < 300 or q == 2000:
            assert [i for _, i, _ in own] == [i for _, i in w]
    assert hit >= 0.9 * 5 * len(want)


#: Names that operators use inside, that they return, or that need quoting.
CLASH = ["a.b", "text.x", "DOC_ID2", "lines", "ends", "gone", "kept", "mark", "k1", "j2", "places", "m_row", "m_words", "m_letter", "in_0", "in_3", "id", "row", "size", "hash", "copy", "component", "node", "ld_lines", "LD_removed", "sd_text", "dc_items", "li_lang", "qs_upper", "qs_score", "_id", "_lines", "`q`"]


@pytest.mark.parametrize("name", ["decontaminate", "spans", "annotate", "mix", "lines", "passages", "substrings", "identify", "quality", "one_of_each", "language_id", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_output", "report10", "report4"])
def test_clashing_columns(spark, name):
    import corpus_pipeline

    text = "Some words of a text\nthat no other one has in it\nand a last line"
    docs = spark.createDataFrame([(1, text, "en", "a", *range(len(CLASH))), (2, None, None, None, *[None] * len(CLASH))], ", ".join(["doc_id long", "text string", "lang string", "source string", *[f"`{c.replace('`', '``')}` long" for c in CLASH]]))
    bench = spark.createDataFrame([(1, "nothing of it")], "item_id long, text string")
    run = {
        "decontaminate": lambda: decontaminate.decontaminate(docs, bench), "spans": lambda: decontaminate.decontaminate(docs, bench, remove="spans"), "annotate": lambda: decontaminate.annotate(docs, bench), "mix": lambda: mixing.mixed_documents(docs),
        "lines": lambda: linededup.dedup_lines(docs), "passages": lambda: linededup.dedup_passages(docs), "substrings": lambda: substring.dedup_substrings(docs), "identify": lambda: langid.identify(docs, langid.train(docs)),
        "quality": lambda: quality.score(docs, [], 0.0), "one_of_each": lambda: jaccard.one_of_each(docs), "report10": lambda: tokenpack.report(docs), "report4": lambda: jaccard.report(docs), **{k: (lambda f=f: f(spark, docs, SF)) for k, f in corpus_pipeline.STAGES},
    }[name]
    new = {"annotate": ("dc_n_words", "dc_n_hit", "dc_items"), "lines": ("ld_lines", "ld_removed"), "passages": ("ld_lines", "ld_removed"), "substrings": ("sd_words", "sd_removed", "sd_text"), "identify": ("li_lang", "li_score", "li_rejected"), "quality": (*[f"qs_{k}" for k in quality.STATS], "qs_score")}.get(name, ())
    out = run()
    got = out.toArrow().to_pylist()
    if name in ("token_output", "report10", "report4"):
        assert len(got) == 2 and out.columns[0] == "doc_id"
        return
    gone = {c.lower() for c in new} | ({"text"} if name in ("substrings", "quality") else set())
    assert out.columns == [c for c in docs.columns if c.lower() not in gone] + list(new)
    first = next(r for r in got if r["doc_id"] == 1)
    assert all(first[c] == i for i, c in enumerate(CLASH) if c.lower() not in gone) and ("text" in gone or first["text"] == text)


def test_a_third_of_the_rows_without_id(spark):
    """Null ids with one text, and with many: every operator against its SQL, tokens against their order."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long + "\nsecond line\nthird") for _ in range(60)] + [(None, f"{i} {long} {i}\nline {i}\nmore") for i in range(30)] + [(i, " ".join(f"u{i}_{j}" for j in range(50))) for i in range(120)] + [(7, "")] * 40 + [(None, None)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert rows_of(substring.report(docs), ("doc_id", "n_words", "n_removed", "kept_sha256")) == by_sql(substring.SQL, documents=docs)
    assert rows_of(linededup.report(docs), ("doc_id", "n_lines", "n_removed", "kept_sha256")) == by_sql(linededup.SQL, documents=docs)
    assert rows_of(jaccard.report(docs), ("doc_id", "n_shingles", "component_id")) == by_sql(jaccard.SQL, documents=docs)
    got = tokenpack.report(docs).orderBy("start").collect()
    assert len(got) == len(rows) and [r.doc_id for r in got] == sorted((r for r, _ in rows), key=lambda x: (x is not None, x or 0))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    one = {(r.doc_id, r.text) for r in jaccard.one_of_each(docs).collect()}
    assert len([1 for d, t in one if d is None and t]) == 1 and (None, None) in one and (7, "") in one


def test_links_are_all_links(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(9001, " ".join(f"z{i}" for i in range(60))), (9002, " ".join(f"z{i}" for i in range(61))), (9003, " ".join(f"z{i}" for i in range(4, 64))), (9003, " ".join(f"z{i}" for i in range(60)))], "doc_id long, text string"))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.collect()
    words = [(r.text or "").translate(lower).encode().split() for r in rows]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    count = [sum(1 for j, y in enumerate(sets) if i != j and x and y and 100 * len(x & y) >= 75 * len(x | y)) for i, x in enumerate(sets)]
    assert sorted((r.doc_id, r.n_shingles, r.n_links) for r in jaccard.link_counts(docs).collect()) == sorted((r.doc_id, len(x), n) for r, x, n in zip(rows, sets, count, strict=True))


def test_any_mark_after_a_role(spark):
    conv = spark.createDataFrame([(1, 0, "a: b", "x: <y>"), (1, 1, "assistant", ": ")], "conv_id long, turn long, role string, text string")
    t = chatformat.ChatTemplate(after_role=": ")
    back = chatformat.read_back(chatformat.format_chats(conv, t), t).first()
    assert [tuple(x) for x in back.turns] == [("a: b", "x: <y>"), ("assistant", ": ")] and back.loss_texts == [": "]
    for bad in ({"after_role": ""}, {"after_role": "&"}, {"head": ""}, {"end": "x"}):
        with pytest.raises(ValueError):
            chatformat.ChatTemplate(**bad)


@pytest.mark.parametrize("long", [2, 7, 64])
def test_long_lists_in_pieces(spark, long):
    pick = np.random.default_rng(5)
    base = [pick.integers(0, 3, 90).tolist() for _ in range(4)]
    texts = []
    for i in range(260):  # few words, so that all shingles are frequent and lists are long; sizes and places vary
        w = list(base[i % 4][: int(pick.integers(20, 90))])
        for at in pick.integers(0, len(w), int(pick.integers(0, 4))):
            w[at] = int(pick.integers(0, 3))
        texts.append(" ".join(f"v{x}" for x in w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = list({frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (t.split() for t in texts)})
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    found = [(r.a, r.b, r.overlap) for r in jaccard.all_links(docs, long=long).collect()]
    assert len(found) == len(set(found)) == len(near) and sorted(x[2] for x in found) == sorted(len(sets[i] & sets[j]) for i, j in near)

    def groups(pairs):
        root = {}
        up = lambda x: x if root.setdefault(x, x) == x else up(root[x])
        for x, y in pairs:
            root[up(x)] = up(y)
        return sorted(np.unique([up(x) for x in root], return_counts=True)[1].tolist())

    pieces = jaccard._crossed(jaccard._index(docs, 5, 75, 0)[0], 75, long).filter("cut is not null")
    assert (pieces.count() > 0) and groups((r.a, r.b) for r in jaccard.links(docs, long=long).collect()) == groups(near)


def test_overlaps_of_few_and_of_many_pairs(spark, monkeypatch):
    """A set that came from several tasks counts once, and few pairs take few tasks, which cost the driver memory."""
    items = {i: np.arange(i, i + 6, dtype=np.uint64) for i in range(40)}
    rows = [(i, x.tobytes()) for i, x in items.items()] * 3
    sets = spark.createDataFrame(rows, "node long, items binary").repartition(6)
    asked = [(a, b) for b in range(4) for a in range(b + 1, 40)]
    pairs = spark.createDataFrame(asked, "a long, b long")
    want = sorted((a, b, 6, 6, max(0, 6 - (a - b))) for a, b in asked)
    monkeypatch.setattr(jaccard, "GROUP", 5)
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "50"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for few, most in ((200_000, 220), (-1, 600)):
            monkeypatch.setattr(jaccard, "FEW", few, raising=False)
            spark.sparkContext.setJobGroup(f"overlaps {few}", "")
            got = jaccard.overlaps(sets, pairs)
            tell = spark.sparkContext.statusTracker()
            stages = [tell.getStageInfo(i) for j in tell.getJobIdsForGroup(f"overlaps {few}") for i in tell.getJobInfo(j).stageIds]
            assert sorted(map(tuple, got.collect())) == want
            assert sum(s.numCompletedTasks for s in stages if s) < most
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sparkContext._jsc.clearJobGroup()
