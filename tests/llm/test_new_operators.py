"""Divergence of sources, fill-in-the-middle and language-model scores against their plain versions, and on odd tables."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.arrays import put
from skein.llm import divergence, infill, kneser_ney
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t", "one", "é", "\U0001f600", "a<P>b", "<S>", "x<M", "<P", ">", "tail<", "\U0001f600é" * 40, "many words\n\nin lines \n of text\n", "\n", "   lead", "Ünï CÖDE word Word WORD", "a b c"]


def rows_of(r, n):
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in ["x", "Y", "ü", "zz"]]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return [(i, " ".join(r.choices(vocabulary, weights, k=r.choice([0, 3, 12, 60]))), r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", "hot", "hot", "hot", None, ""]), 0) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = rows_of(r, 260) + [(1000 + k, t, "xx", "odd", 0) for k, t in enumerate(ODD)] + [(None, "no key here", "en", "s1", 0), (None, None, None, None, None)]
    return out + [out[5], out[5]] + [(5000, " ".join(r.choice(["ax", "bY", "new"]) for _ in range(60_000)), "de", "long", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_divergence(docs, rows):
    got = sorted(tuple(r) for r in divergence.digest(docs).collect())
    assert got == brute.divergence([(r[2], r[3], r[1]) for r in rows])


def test_divergence_in_tiles_and_chunks(spark, monkeypatch):
    """More sources than a tile has, and more vectors than a chunk."""
    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "CHUNK", 4)
    r = random.Random(2)
    rows = [(i, " ".join(f"w{chr(97 + r.randrange(26))}{chr(97 + int(r.random() ** 3 * 26))}" for _ in range(40)), "en", f"s{int(r.random() ** 2 * 11)}", 0) for i in range(400)]
    pairs, own = divergence.audit(spark.createDataFrame(rows, DOCS), least=5, ranks=7)
    got = [(x["lang"], x["source"], part, x["item"], x["value"], x["rank"]) for part, df in (("pair", pairs), ("term", own)) for x in df.collect()]
    assert sorted(got) == brute.divergence([(x[2], x[3], x[1]) for x in rows], least=5, ranks=7)


def test_divergence_counts_past_a_long(spark):
    one = spark.createDataFrame([(10**14, 3 * 10**14, 7)], "n long, total long, kept long").select(divergence.share(F.col("n"), F.col("total"), F.col("kept")).alias("p")).first()
    assert one["p"] == 1 + 10**9 * (10**14 + 5) // (3 * 10**14 + 35)


def test_divergence_few(spark, empty):
    assert divergence.digest(empty).count() == 0
    two = spark.createDataFrame([("a b", "en", "x"), (None, "en", "y"), ("c", "de", "z")], "text string, lang string, source string")
    assert sorted(map(tuple, divergence.digest(two).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("unit", infill.UNITS)
def test_infill(docs, rows, unit, monkeypatch):
    monkeypatch.setattr(infill, "SLICE", 3000)
    out = infill.rewritten(docs, unit=unit).withColumn("back", infill.restored(F.col("rewritten"), F.col("form")))
    got = sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix"], r["middle"], r["rewritten"], r["back"]) for r in out.collect()), key=repr)
    assert got == sorted(((r[0], r[1], *brute.infill(r[0], r[1], unit), r[1] or "") for r in rows), key=repr)


def test_infill_digest(docs, rows):
    got = sorted((tuple(r) for r in infill.digest(docs).collect()), key=repr)
    want = []
    for r in rows:
        n, form, prefix, middle, out = brute.infill(r[0], r[1])
        want.append((r[0], n, form, prefix, middle, sha(out), sha(r[1] or "")))
    assert got == sorted(want, key=repr)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_infill_of_odd_tables(spark, empty):
    assert infill.digest(empty).count() == 0
    clash = spark.createDataFrame([(1, "some text", "kept", 7)], "doc_id long, text string, __h1 string, form long")
    out = infill.rewritten(clash)
    assert out.columns == ["doc_id", "text", "__h1", "form", "n", "prefix", "middle", "rewritten"]
    assert out.first()["__h1"] == "kept" and out.first()["form"] in infill.FORMS
    with pytest.raises(ValueError, match="called"):
        infill.rewritten(clash, text="form")
    with pytest.raises(ValueError, match="unit"):
        infill.rewritten(clash, unit="page")


def test_kneser_ney(docs, rows, monkeypatch):
    want_tokens, want, *_ = brute.kneser_ney([(r[0], r[1]) for r in rows])
    got = kneser_ney.digest(docs).collect()
    assert {r["train_tokens"] for r in got} == {want_tokens}
    key = lambda x: (str(x[0]), x[2], x[3], round(x[4], 6))
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got), key=key)
    want = sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    np.testing.assert_allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)


def test_kneser_ney_in_pieces(docs, rows, monkeypatch):
    """Small pieces and many segments change nothing; the model is read again from its folder."""
    spark = docs.sparkSession
    trained = [(k, t) for k, t, *_ in rows if zlib.crc32(b"" if k is None else str(k).encode()) % 10]
    model = kneser_ney.train(docs.where(~kneser_ney.held_out(F.col("doc_id"))))
    monkeypatch.setattr(kneser_ney, "BATCH", 7)
    monkeypatch.setattr(kneser_ney, "SCORED", 7)
    monkeypatch.setattr(kneser_ney, "LEAST_SEGMENTS", 5)
    small = kneser_ney.train(docs.where(~kneser_ney.held_out(F.col("doc_id"))))
    assert (small.tokens, small.kept, small.pairs) == (model.tokens, model.kept, model.pairs) and small.segments == 5
    assert kneser_ney.opened(spark, small.folder) == small
    _, _, p, uses = brute.kneser_ney(trained + [])
    few = docs.where("n_chars = 0 and doc_id < 200 or doc_id > 999 and doc_id < 2000").select("doc_id", "text", F.lit(1).alias("score"))
    one, two = ({(r["doc_id"], r["text"]): r for r in kneser_ney.scored(few, m).collect()} for m in (model, kneser_ney.opened(spark, small.folder)))
    for k in one:
        assert one[k]["score"] == pytest.approx(two[k]["score"], rel=1e-9)
        assert one[k]["perplexity"] == pytest.approx(10 ** (-one[k]["score"] / one[k]["n_tokens"]))


def test_kneser_ney_shares_out_one():
    """After any word, known or not, all words and an unknown one have a probability of 1 together."""
    rows = [(k, t) for k, t, *_ in rows_of(random.Random(4), 60)]
    _, _, p, uses = brute.kneser_ney(rows)
    for v in [" ", "ax", "nobody"]:
        assert sum(p(w, v) for w in uses) + p("unseen", v) == pytest.approx(1)


def test_kneser_ney_prefers_its_own(spark):
    """Held-out texts in the order of training score better than the same words in another."""
    r = random.Random(9)
    follow = {w: [f"w{r.randrange(200)}" for _ in range(3)] for w in (f"w{k}" for k in range(200))}

    def chain(n):
        ws = ["w0"]
        while len(ws) < n:
            ws.append(r.choice(follow[ws[-1]]))
        return ws

    model = kneser_ney.train(spark.createDataFrame([(" ".join(chain(300)),) for _ in range(80)], "text string"))
    texts = [chain(60) for _ in range(20)]
    mixed = [r.sample(t, len(t)) for t in texts]
    got = kneser_ney.scored(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts + mixed)], "k long, text string"), model).collect()
    scores = {x["k"]: x["perplexity"] for x in got}
    assert all(3 * scores[k] < scores[k + 20] for k in range(20))


def test_kneser_ney_of_nothing(spark, empty):
    assert kneser_ney.digest(empty).count() == 0
    model = kneser_ney.train(empty)
    out = kneser_ney.scored(spark.createDataFrame([("a b",), (None,)], "text string"), model).collect()
    assert [(r["n_tokens"], r["n_known"], r["score"]) for r in out] == [(3, 0, 0.0), (1, 0, 0.0)]


class Caught:
    """Stands for a table and keeps the functions that workers would get."""

    def mapInArrow(self, count, schema):
        self.count = count
        return self

    def groupBy(self, *names):
        return self

    def applyInArrow(self, write, schema):
        self.write = write
        return self

    def agg(self, *sums):
        return self


def test_kneser_ney_counts_pairs_in_little_memory(spark, tmp_path):
    """A worker's arrays have at most 60 bytes a token while it counts a batch of texts."""
    r = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in (r.random(2000) ** 3 * 30_000).astype(int)) for _ in range(524)]
    h = np.unique(np.concatenate([h for _, _, h, _ in kneser_ney.hashes(pa.array(texts))]))
    for s in range(16):
        put(f"{tmp_path}/words/{s}.h", h[kneser_ney.segment_of(h, 16) == s])
    table, tokens = Caught(), 524 * 2002
    kneser_ney.pair_counts(table, str(tmp_path), 16, 20)
    batches = [pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]
    tracemalloc.start()
    sent = sum(b.num_rows for b in table.count(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent and peak < 60 * tokens
