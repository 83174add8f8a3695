"""Plans, and the queries that SQL cannot express, against plain versions on a small fixture."""

import datetime as dt
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.config import Settings
from skein.functions.porter import stem
from skein.functions.text import ascii_text
from skein.plans import prepare, registry
from skein.streaming import crawl
from tests.test_operators import plain_greedy

WORDS = "robot robots walking walks machine machines learned learning paper papers story stories running ran quickly house houses garden".split()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Sixty short documents in groups of near copies, some of the last two sources."""
    path = tmp_path_factory.mktemp("small")
    rng = np.random.default_rng(7)
    bases = [[WORDS[k] + str(rng.integers(0, 6)) for k in rng.integers(0, len(WORDS), 40)] for _ in range(6)]
    rows = []
    for i in range(60):
        ws = list(bases[i % 6])
        for k in rng.integers(0, 40, rng.integers(0, 25)):
            ws[k] = WORDS[rng.integers(0, len(WORDS))]
        text = f"({'x' if i % 3 else 'y'} - now) " + " ".join(ws[:12]) + ". Then " + " ".join(ws[12:25]) + "! And the " + " ".join(ws[25:]) + "."
        rows.append((i, text, "en" if i % 2 else "de", f"src{(i * 7) % 20}", int(rng.integers(14, 30))))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), rows


def vectors(rows, form=str):
    tokens = {i: [form(w.lower()) for w in re.findall(r"\w+", t, re.ASCII)] for i, t, *_ in rows}
    df = Counter(w for ws in tokens.values() for w in set(ws))
    out = {}
    for i, ws in tokens.items():
        raw = {w: math.log2(n + 1) * (math.log2(len(rows) + 1) - math.log2(df[w] + 1)) for w, n in Counter(ws).items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out[i] = {w: x / norm for w, x in raw.items()}
    return out


def window_pairs(rows, form=str):
    """(i, j, sim, i is published) of the query's window."""
    v = vectors(rows, form)
    day = {i: dt.date(2024, 1, 1) + dt.timedelta(n % 30) for i, *_, n in rows}
    source = {i: s for i, _, _, s, _ in rows}
    recent = [i for i in day if dt.date(2024, 1, 16) <= day[i] <= dt.date(2024, 1, 30)]
    sims = [(i, j, sum(w * v[j].get(t, 0) for t, w in v[i].items())) for i in recent for j in recent if i < j and source[j] in ("src18", "src19")]
    return [(i, j, s, source[i] in ("src0", "src1", "src2", "src3")) for i, j, s in sims if s >= 0.13]


def test_greedy_sets_of_the_window(spark, small):
    path, rows = small
    want = plain_greedy(sorted((i, j) for i, j, _, p in window_pairs(rows) if not p))
    got = {}
    for r in registry.dup_greedy_sets(spark, path).collect():
        got.setdefault((r["grp"], r["set_no"]), set()).add(r["urlid"])
    assert len(want) > 0 and sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_prepared_articles(spark, small):
    """What the daily run, by stems, says of duplicates, step by step; the rules before it are the same without stems, as the text's listed words are their own."""
    path, rows = small
    out = {r["urlid"]: r for r in registry.prepare_articles(spark, path).collect()}
    pairs = window_pairs(rows, stem)
    assert {p[:2] for p in pairs} != {p[:2] for p in window_pairs(rows)}
    arts = registry.relational.with_categories(registry.A.articles(spark, path).drop("category"), registry.A.categories(spark, path))
    todo, found = prepare.judged(arts, registry.SETTINGS)
    assert {(r["i"], r["j"]): (round(r["sim"], 9), r["i_published"]) for r in found.collect()} == {(i, j): (round(s, 9), p) for i, j, s, p in pairs}
    judged = {r["urlid"]: {"publish": r["publish"], "transcript": " | ".join(r["transcript"])} for r in registry.duplicates.without_published(todo, found, 0.13).collect()}
    unstemmed = {r["urlid"]: r for r in registry.prepare_rules(spark, path).collect()}
    duplicate = lambda r: "already published" in r["transcript"]
    assert all(r["transcript"] == unstemmed[u]["transcript"] for u, r in judged.items() if not duplicate(r) and not duplicate(unstemmed[u]))
    source = {i: s for i, _, _, s, _ in rows}
    assert set(out) == {i for i in source if source[i] in ("src18", "src19")}
    dups, last = {u: 0 for u in out}, {}
    for i, j, _, published in sorted(pairs):
        if published:
            last[j] = i
    for u in last:
        dups[u] = 1
    sims = {(a, b) for i, j, _, p in pairs if not p for a, b in ((i, j), (j, i))}
    publish = {u: judged[u]["publish"] for u in out}
    relevance = lambda u: int(source[u][3:])
    cats = lambda u: (u < 40) * (u % 2 + (u % 5 == 0))
    for group in plain_greedy(sorted((i, j) for i, j, _, p in pairs if not p)):
        mine = group & out.keys()
        for u in mine:
            dups[u] = sum((u, w) in sims for w in mine)
        ranked = sorted((u for u in mine if publish[u]), key=lambda u: (-dups[u], -relevance(u), -cats(u), u))
        for u in ranked[1:]:
            publish[u] = False
    assert {u: r["publish"] for u, r in out.items()} == publish
    assert {u: r["n_duplicates"] for u, r in out.items()} == dups
    assert all(r["transcript"].startswith(judged[u]["transcript"]) for u, r in out.items())


def test_stems_of_the_fixture(spark, small):
    path, rows = small
    want = Counter((i, stem(w.lower())) for i, t, *_ in rows for w in re.findall(r"\w+", t, re.ASCII))
    assert {(r["urlid"], r["term"]): r["tf"] for r in registry.stemmed_terms(spark, path).collect()} == want


def test_two_sentences_of_the_fixture(spark, small):
    path, rows = small
    got = {r["urlid"]: r["summary"] for r in registry.summary_two_sentences(spark, path).collect()}
    for i, text, *_ in rows:
        assert got[i] == text.split(") ", 1)[1].split(" And the ")[0]


def test_scaled_centroids_of_the_fixture(spark, small):
    path, _ = small
    rows = registry.centroid_mds(spark, path).collect()
    d = {(r["i"], r["j"]): r["d"] for r in registry.centroid_dissim(spark, path).collect()}
    (a, b) = rows
    assert math.isclose(math.dist(a[1:], b[1:]), d[a[0], b[0]], abs_tol=1e-5)


def test_prepare_by_stems_and_by_stream(spark, small, tmp_path):
    """Stemmed phrases count, and micro-batches give what one run gives for their articles."""
    path, rows = small
    settings = Settings(as_of=dt.date(2024, 1, 30), whitelist=("machine learning", "robot", "walk", "garden"), period_days=30)
    arts = registry.A.articles(spark, path).drop("category").withColumn("categories", F.array(F.lit("x"))).where("urlid < 30")
    todo, _ = prepare.judged(arts, settings)
    stems = {i: f" {' '.join(stem(w.lower()) for w in re.findall(r'[A-Za-z0-9_]+', t))} " for i, t, *_ in rows}
    few = {i for i, s in stems.items() if sum(f" {p} " in s for p in ("machin learn", "robot", "walk", "garden")) < 2}
    got = {r["urlid"] for r in todo.where(F.array_contains("transcript", "Rejected due to only one or no whitelisted terms")).collect()}
    assert got == few & {r["urlid"] for r in todo.collect()}
    arts.where(~F.col("processed")).write.parquet(str(tmp_path / "in"))
    known = arts.where("processed")
    stream = crawl.read_parquet(spark, str(tmp_path / "in"), arts.schema, 100)
    prepare.prepare_stream(stream, known, settings, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    columns = ["urlid", "publish", F.array_join("transcript", "|")]
    want = sorted(map(tuple, prepare.prepare(arts, settings).select(*columns).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*columns).collect())) == want and want


def test_clean_content_in_ascii(spark, tmp_path):
    """The query against the steps one by one, and letters of three scripts."""
    texts = ["Щука и ёж. Щука и ёж - плывут ,  к реке . Ουρανός < γη & naïve ß Share this  конец", "Plain title. all ASCII", "Ψυχή μου. " + "слово " * 1200]
    spark.createDataFrame([(i, t, "en", "src1", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))

    def plain(text):
        title, c = text.split(".")[0], re.sub(r"\s+", " ", text)
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = c.replace(a, b)
        c = ascii_text(c).strip()
        c = re.sub(re.escape(title) + r"\s*-?\s*", "", c)
        c = re.sub(r"\s+\.", ".", re.sub(r"\s+,\s+", ", ", re.sub(r"\s*Share this\s*", "", c)))
        if len(c) > 5000:
            part = c[:5000]
            c = part[: part.rfind(".")] if "." in part else part[: part.rfind(" ")] if " " in part else part
        return hashlib.md5((c + "...").encode()).hexdigest()

    assert {r["urlid"]: r["digest"] for r in registry.clean_content_ascii(spark, str(tmp_path)).collect()} == {i: plain(t) for i, t in enumerate(texts)}
    for given, want in [("Щука и ёж, Йод", "Shchuka i iozh, Iod"), ("Ουρανός ΟΥΡΑΝΟΣ Ψυχή", "Ouranos OURANOS Psukhe"), ("naïve ß € Ærø", "naive ss EUR AEro"), ("日本 x", " x"), ("Київ", "Kiiv"), ("е\u0301", "e")]:
        assert ascii_text(given) == want
