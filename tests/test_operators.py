import datetime as dt
import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.linalg import Vectors
from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import classify, duplicates, evaluate, graphs, relational, rules, similarity, vocabulary
from skein.plans import registry

DAY = dt.date(2024, 1, 30)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "urlid long, content string")


def test_tfidf_is_normalised(spark):
    v = vocabulary.vectors(docs(spark, "a a b", "b c", "d")).collect()
    norms = {}
    for r in v:
        norms[r["urlid"]] = norms.get(r["urlid"], 0) + r["w"] ** 2
    assert all(abs(n - 1) < 1e-9 for n in norms.values())


def naive_pairs(v, least):
    by = {}
    for r in v:
        by.setdefault(r["urlid"], {})[r["term"]] = r["w"]
    ids = sorted(by)
    out = {}
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            s = sum(w * by[j].get(t, 0) for t, w in by[i].items())
            if s >= least:
                out[i, j] = s
    return out


@pytest.mark.parametrize("least", [0.1, 0.3, 0.6, 0.95])
def test_prefix_filter_loses_nothing(spark, least):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) % 40) for _ in range(40)]
    texts += texts[:5]
    v = vocabulary.vectors(docs(spark, *texts))
    want = naive_pairs(v.collect(), least)
    got = {(r["i"], r["j"]): r["sim"] for r in similarity.similar_pairs(v, least).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_blocks_and_index_find_the_same(spark, monkeypatch):
    """Several blocks of several pieces, dense and sparse terms, and documents that only come later."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 25) % 60) for _ in range(90)]
    v = vocabulary.vectors(docs(spark, *texts, "alone", texts[0]))
    monkeypatch.setattr(similarity, "BLOCK", 7)
    monkeypatch.setattr(similarity, "MOST_TOGETHER", 20)
    monkeypatch.setattr(similarity, "PIECE", 5)
    want = naive_pairs(v.collect(), 0.2)
    for found in (similarity.block_pairs(v, 0.2, "urlid", None), similarity.indexed_pairs(v, 0.2, "urlid", None, 0.8)):
        got = {(r["i"], r["j"]): r["sim"] for r in found.collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    later = spark.createDataFrame([(k,) for k in range(0, 92, 3)], "urlid long")
    for found in (similarity.block_pairs(v, 0.2, "urlid", later), similarity.indexed_pairs(v, 0.2, "urlid", later, 0.8)):
        assert {(r["i"], r["j"]) for r in found.collect()} == {k for k in want if k[1] % 3 == 0}


def plain_greedy(pairs):
    """Sets tried in order, as a list."""
    sets = []
    for i, j in pairs:
        for s in sets:
            if i in s or j in s:
                s |= {i, j}
                break
        else:
            sets.append({i, j})
    return sets


def greedy_of(spark, pairs):
    """The sets of each component in the order of their numbers, by components in the order of their labels."""
    found = {}
    for r in duplicates.greedy_groups(spark.createDataFrame(pairs, "i long, j long")).collect():
        found.setdefault((r["grp"], r["set_no"]), set()).add(r["urlid"])
    for grp in {g for g, _ in found}:
        assert {k for g, k in found if g == grp} == set(range(sum(g == grp for g, _ in found)))
    return [found[k] for k in sorted(found)]


def plain_by_component(pairs):
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for i, j in pairs:
        a, b = sorted((root(i), root(j)))
        label[b] = a
    sets = plain_greedy(pairs)
    return [s for grp in sorted({root(i) for i, _ in pairs}) for s in sets if root(min(s)) == grp]


def test_greedy_sets_of_random_graphs(spark):
    """Two hundred graphs of 13 articles at once, as articles of their own, each against the plain version."""
    r = np.random.default_rng(3)
    pairs = set()
    for g in range(200):
        for _ in range(r.integers(1, 30)):
            i, j = sorted(int(x) for x in r.integers(0, 13, 2))
            if i < j:
                pairs.add((100 * g + i, 100 * g + j))
    assert greedy_of(spark, sorted(pairs)) == plain_by_component(sorted(pairs))


@pytest.mark.parametrize("shape", ["path", "backwards", "star", "zigzag"])
def test_greedy_sets_of_long_chains(spark, monkeypatch, shape):
    monkeypatch.setattr(duplicates, "RUN_BITS", 3)
    n = 300
    pairs = {
        "path": [(k, k + 1) for k in range(n)],
        "backwards": [(n - k - 1, 1000 + k) for k in range(n)] + [(n - k - 2, 1000 + k) for k in range(n - 1)],
        "star": [(0, k + 1) for k in range(n)] + [(k + 1, 2000) for k in range(0, n, 2)],
        "zigzag": [(k, 1000 + k) for k in range(n)] + [(k, 999 + k) for k in range(1, n)],
    }[shape]
    assert greedy_of(spark, sorted(pairs)) == plain_by_component(sorted(pairs))


def test_greedy_sets_of_a_large_component(spark):
    r = np.random.default_rng(8)
    pairs = sorted({(int(i), int(j)) for i, j in np.sort(r.zipf(1.3, (350_000, 2)) % 60_000, axis=1) if i < j})
    assert len(pairs) > 60_000
    got = greedy_of(spark, pairs)
    # The plain version with the first set of each article at hand.
    sets, home = [], {}
    for i, j in pairs:
        at = min(home.get(i, len(sets)), home.get(j, len(sets)))
        if at == len(sets):
            sets.append(set())
        sets[at] |= {i, j}
        home[i] = home[j] = at
    assert sorted(map(sorted, got)) == sorted(map(sorted, sets))


def test_greedy_keeps_overlapping_sets(spark):
    pairs = spark.createDataFrame([(1, 5), (2, 6), (5, 6)], "i long, j long")
    got = {}
    for r in duplicates.greedy_groups(pairs).collect():
        got.setdefault(r["set_no"], set()).add(r["urlid"])
    assert got == {0: {1, 5, 6}, 1: {2, 6}}


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "i long, j long")
    got = {r["urlid"]: r["grp"] for r in duplicates.components(pairs).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_filter_duplicates(spark):
    rows = [(u, f"t{u}", True, 5 if u != 3 else 9, ["c"], []) for u in (2, 3, 4, 7)]
    arts = spark.createDataFrame(rows, "urlid long, title string, publish boolean, source_relevance int, categories array<string>, transcript array<string>")
    pairs = spark.createDataFrame([(1, 7, 0.5, True), (2, 3, 0.9, False), (3, 4, 0.8, False)], "i long, j long, sim double, i_published boolean")
    got = {r["urlid"]: r for r in duplicates.filter_duplicates(arts, pairs, 0.13).collect()}
    assert [u for u in got if got[u]["publish"]] == [3]
    assert got[3]["transcript"] == ["Preferred over duplicates"]
    assert got[2]["transcript"] == ["Rejected because duplicate 3 was chosen instead"]
    assert got[7]["transcript"] == ["Rejected because duplicate (sim=0.500, cutoff=0.130) of already published article 1"]
    assert [(x["urlid"], x["similarity"]) for x in got[3]["duplicates"]] == [(2, 0.9), (4, 0.8)]


def test_rules_accumulate(spark):
    a = spark.createDataFrame([(1, None, "http://x/bad", "s", []), (2, DAY, "http://x/ok", "s", ["c"])], "urlid long, pubdate date, url string, source string, categories array<string>")
    out = rules.category_rule(rules.url_rule(rules.date_rule(rules.opened(a), DAY, 7), ["bad", "x"])).orderBy("urlid").collect()
    assert out[0]["transcript"] == ["Rejected due to bogus publication date.", "Rejected because url matched blacklisted url bad", "Rejected due to no selected categories"]
    assert out[0]["pubdate"] == DAY
    assert out[1]["transcript"] == ["Rejected because url matched blacklisted url x"]


def test_whitelist_rule(spark):
    a = rules.opened(spark.createDataFrame([(1, "s", "neural networks learn"), (2, "User Submitted", "x"), (3, "s", "robots")], "urlid long, source string, content string"))
    terms = vocabulary.whitelist_terms(spark, ["neural network", "learning", "robot", "Robot"])
    out = {r["urlid"]: r["publish"] for r in rules.whitelist_rule(a, vocabulary.whitelist_hits(a, terms)).collect()}
    assert out == {1: True, 2: True, 3: False}


def test_training_corpus(spark):
    corpus = docs(spark, "a b", "", "c", "d")
    cats = spark.createDataFrame([(0, "y"), (0, "x"), (1, "x"), (2, "NotRelated")], "urlid long, category string")
    assert [tuple(r) for r in relational.training_corpus(corpus, cats).collect()] == [(0, "a b", "x y")]


def test_split_sizes(spark):
    parts = [r["part"] for r in relational.split_at(spark.range(57).withColumnRenamed("id", "urlid"), 0.5).collect()]
    assert (parts.count("train"), parts.count("predict")) == (28, 5)


def test_insert_and_replace(spark):
    old = spark.createDataFrame([(1, "a")], "urlid long, url string")
    new = spark.createDataFrame([(2, "a"), (4, "b"), (3, "b")], "urlid long, url string")
    assert sorted(map(tuple, relational.insert_if_absent(old, new).collect())) == [(1, "a"), (3, "b")]
    cats = spark.createDataFrame([(1, "x"), (2, "y")], "urlid long, category string")
    assert sorted(map(tuple, relational.replace_by_key(cats, spark.createDataFrame([(1, "z"), (1, "w")], cats.schema)).collect())) == [(1, "w"), (1, "z"), (2, "y")]


def test_sweep_and_best(spark):
    dates = spark.createDataFrame([(1, DAY), (2, DAY), (3, DAY - dt.timedelta(20)), (4, None), (5, DAY)], "urlid long, pubdate date")
    sims = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.7), (2, 3, 0.2), (1, 5, 0.5), (2, 4, 0.3)], "i long, j long, sim double")
    gold = evaluate.gold_pairs(spark.createDataFrame([([1, 2], "a"), ([2, 3], "b"), ([4, 5], "c")], "ids array<long>, label string"))
    rows = {r["k"]: r for r in evaluate.cutoff_sweep(sims, dates, gold).collect()}
    # Within 14 days: 1-2, 1-4, 1-5, 2-4, 2-5, 3-4, 4-5; gold of these 1-2 and 4-5, the latter with nothing in common.
    assert (rows[0]["tp"], rows[0]["fp"]) == (2, 5)
    assert (rows[1]["tp"], rows[1]["fp"]) == (1, 2)
    assert (rows[51]["tp"], rows[51]["fp"], rows[95]["tp"]) == (1, 0, 0)
    assert math.isclose(rows[51]["recall"], 1 / 3) and rows[95]["precision"] == 0
    assert evaluate.best_cutoff(evaluate.cutoff_sweep(sims, dates, gold)).first()["k"] == 51


def test_label_sweep_counts_what_lists_of_pairs_say(spark, monkeypatch):
    """Gold pairs by label against the same pairs as a table: null and shared labels, null dates, pairs without a common term."""
    monkeypatch.setattr(similarity, "BLOCK", 9)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, rng.integers(1, 12)) % 30) for _ in range(50)] + ["", "only", "here"]
    rows = [(k, None if k % 11 == 0 else DAY - dt.timedelta(int(rng.integers(0, 40))), None if k % 7 == 0 else f"l{rng.integers(0, 5)}") for k in range(len(texts))]
    v, described = vocabulary.vectors(docs(spark, *texts)), spark.createDataFrame(rows, "urlid long, pubdate date, label string")
    gold = spark.createDataFrame([(i, j) for i, _, a in rows for j, _, b in rows if i < j and a and a == b], "i long, j long")
    want = evaluate.cutoff_sweep(similarity.similar_pairs(v, 0.0), described.select("urlid", "pubdate"), gold).orderBy("k").collect()
    assert evaluate.label_sweep(v, described).orderBy("k").collect() == want
    assert want[0]["tp"] > want[30]["tp"] > 0 and want[0]["fp"] > want[1]["fp"] > 0
    day = {k: d for k, d, _ in rows}
    near = sum(1 for i in day for j in day if i < j and (day[i] is None or day[j] is None or abs((day[i] - day[j]).days) < 14))
    assert tuple(evaluate.pairs_within(described, 14).first()) == (len(rows) * (len(rows) - 1) // 2, near)
    sims, facts = similarity.similar_pairs(v, 0.3), described
    by_pairs, by_label = (evaluate.review_pairs(sims, facts, known, 0.3, labels=labels).collect() for known, labels in ((gold, None), (None, facts)))
    assert sorted(by_pairs) == sorted(by_label) and by_label


def test_review_includes_the_last_day(spark):
    dates = spark.createDataFrame([(1, DAY), (2, DAY - dt.timedelta(14)), (3, DAY - dt.timedelta(15)), (4, None)], "urlid long, pubdate date")
    sims = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.9), (1, 4, 0.5), (2, 3, 0.4), (3, 4, 0.9)], "i long, j long, sim double")
    known = spark.createDataFrame([(3, 4)], "i long, j long")
    assert sorted((r["i"], r["j"]) for r in evaluate.review_pairs(sims, dates, known, 0.5).collect()) == [(1, 2), (1, 4)]


def test_winners_by_links(spark):
    """The article with the most duplicates of its own wins, before relevance."""
    pairs = spark.createDataFrame([(1, 2), (2, 3), (2, 4)], "i long, j long")
    arts = spark.createDataFrame([(1, 9, 1), (2, 1, 1), (3, 9, 2), (4, 9, 1)], "urlid long, source_relevance int, n_cats int")
    got = {r["urlid"]: r["place"] for r in duplicates.winners(duplicates.components(pairs), arts, pairs).collect()}
    assert got == {2: 1, 3: 2, 1: 3, 4: 4}


def test_spread_subsample(spark):
    rows = [(i, "a" if i < 200 else None if i < 230 else "b") for i in range(300)]
    got = relational.spread_subsample(spark.createDataFrame(rows, "id long, label string"), "label", "id").collect()
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r[0])
    md5 = lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)
    assert sorted(r["id"] for r in got) == sorted(i for ids in by.values() for i in sorted(ids, key=md5)[:30])


def test_vocabulary_of_a_train_split(spark, tmp_path):
    rows = docs(spark, *[f"w{i} common" for i in range(20)])
    train, predict, voc = vocabulary.train_vocabulary(rows, 0.5, str(tmp_path / "v"))
    assert (train.count(), predict.count()) == (10, 2)
    table = spark.read.parquet(str(tmp_path / "v" / "terms")).orderBy("rowid").collect()
    assert [r["rowid"] for r in table] == list(range(1, 12)) and [r["word"] for r in table] == sorted(r["word"] for r in table)
    assert {r["term"]: r["df"] for r in voc.terms.collect()}["common"] == 10 and voc.documents.first()["n_docs"] == 10
    assert vocabulary.tfidf(vocabulary.term_frequency(rows), voc).select("term").distinct().count() == 11


def test_whitelist_list_and_join_agree(spark, monkeypatch):
    rows = docs(spark, "the cat of the house", "a cat", "of the of the")
    terms = vocabulary.whitelist_terms(spark, ["cat", "of the", "the cat of", "absent"], stem=False)
    short = sorted(map(tuple, vocabulary.whitelist_hits(rows, terms, stem=False).collect()))
    monkeypatch.setattr(vocabulary, "LISTED", 0)
    assert short == sorted(map(tuple, vocabulary.whitelist_hits(rows, terms, stem=False).collect()))
    assert short == [(0, "cat", 1), (0, "of the", 1), (0, "the cat of", 1), (1, "cat", 1), (2, "of the", 2)]


def test_svm(spark):
    rng = np.random.default_rng(3)
    points = [(Vectors.dense(p), float(p @ p < 1)) for p in rng.normal(size=(120, 2))]
    ring = spark.createDataFrame(points, ["features", "label"])
    c, g, accuracy = classify.svm_grid(ring, [-1, 3], [1, -9], folds=2)
    assert g == 1 and accuracy > 0.8
    p = classify.svm_probability(spark.createDataFrame([(Vectors.dense([x, 1.0]), float(x > 0)) for x in rng.normal(size=80)], ["features", "label"]), 1)
    out = p.transform(spark.createDataFrame([(Vectors.dense([3.0, 1.0]),), (Vectors.dense([-3.0, 1.0]),)], ["features"])).collect()
    assert out[0]["probability"][1] > 0.9 > 0.1 > out[1]["probability"][1]


def test_tables_by_id_and_state(spark):
    arts = spark.createDataFrame([(1, True, False, DAY), (2, True, True, DAY), (3, True, False, None), (4, False, False, DAY)], "urlid long, publishable boolean, published boolean, pubdate date")
    assert [r["urlid"] for r in relational.publishable(arts).collect()] == [1]
    assert sorted(r["urlid"] for r in relational.between(arts, 2, 3).collect()) == [2, 3]
    assert [r["urlid"] for r in relational.latest_first(arts).collect()] == [4, 3, 2, 1]


def test_ranked_summary(spark):
    text = "Robots walk. Cats sleep all day long. Robots walk and robots run. The end is near."
    got = docs(spark, text, None, "").select("urlid", T.ranked_summary("content").alias("s")).orderBy("urlid").collect()
    assert got[0]["s"] == "Robots walk. Robots walk and robots run." and got[1]["s"] is None and got[2]["s"] == ""


def test_mds_keeps_distances():
    points = np.random.default_rng(1).normal(size=(6, 2))
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    found = evaluate.classical_mds(d)
    assert np.allclose(np.linalg.norm(found[:, None] - found[None], axis=2), d)


def test_topic_models(spark):
    rows = spark.createDataFrame([(i, "robot arm" if i % 2 else "cooking", "robots move fast" if i % 2 else "soup and bread", "robots move" if i % 2 else "soup") for i in range(40)], "urlid long, title string, body string, summary string")
    labels = spark.createDataFrame([(i, "ai") for i in range(1, 40, 2)], "urlid long, category string")
    got = {r["urlid"]: r["categories"] for r in classify.predict(classify.train(rows, labels, ["ai"], 20), rows).collect()}
    assert all((got[i] == ["ai"]) == bool(i % 2) for i in range(40))


def test_nearest(spark):
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)], i % 3) for i in range(20)], "vec_id long, embedding array<double>, label int")
    got = classify.nearest(v, v.where("vec_id = 0"), 3).orderBy("place").collect()
    want = sorted(range(1, 20), key=lambda i: (-math.cos(i), i))[:3]
    assert [r["vec_id"] for r in got] == want
    assert classify.vote(classify.nearest(v, v.where("vec_id = 0"), 3)).count() == 1


def test_training_rows_are_bounded(spark):
    rows = spark.range(200).select(F.col("id").alias("urlid"), F.lit("x").alias("title"))
    labelled = spark.createDataFrame([(k,) for k in list(range(0, 100)) + [3, 3, None, 500]], "urlid long")
    assert sorted(r["urlid"] for r in classify.training_rows(rows, labelled).collect()) == list(range(100))
    few = classify.training_rows(rows, labelled, most=30)
    assert few.count() in (28, 29, 30) and sorted(few.collect()) == sorted(classify.training_rows(rows.repartition(7), labelled.repartition(3), most=30).collect())


def test_all_labelled_rows_are_trained_on(spark):
    """F12 of round 4: no bound unless one is asked for."""
    rows = spark.range(20_500).select(F.col("id").alias("urlid"), F.lit("x").alias("title"))
    assert classify.training_rows(rows, rows.select("urlid")).count() == 20_500


def test_nearer_takes_the_least_id_of_equals():
    """F12 of round 4: pieces that follow each other leave what all at once would."""
    rng = np.random.default_rng(4)
    d, ids = rng.integers(0, 4, (6, 40)).astype(float), rng.permutation(40)
    d[0], d[1, 2:] = np.inf, np.inf
    best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
    for some in np.array_split(np.arange(40), 7):
        best = classify.nearer(best, d[:, some], ids[some], ids[some] % 2.0, 3)
    want = [(r, x, i) for r in range(6) for x, i in sorted(zip(d[r], ids, strict=True))[:3] if np.isfinite(x)]
    assert list(zip(*best[:3], strict=True)) == want and list(best[3]) == [i % 2 for _, _, i in want]


def test_svm_finds_the_margin():
    """On four points the machine is the one known in closed form, and the whole grid is searched."""
    x, y = np.array([[-1.0], [1.0], [-3.0], [3.0]]), np.array([-1.0, 1.0, -1.0, 1.0])
    weights = classify.trained_svm(x @ x.T + 1, y, 10.0)
    assert np.allclose(weights, [-0.5, 0.5, 0, 0], atol=1e-2)
    assert len(classify.C_EXPONENTS) * len(classify.G_EXPONENTS) == 110


def test_svm_scores_of_all_points(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(90, 2))
    inside = (points**2).sum(1) < 1
    rows = spark.createDataFrame([(Vectors.dense(p), float(i)) for p, i in zip(points, inside, strict=True)], ["features", "label"])
    got = {(r["c"], r["g"]): r["accuracy"] for r in classify.svm_scores(rows).collect()}
    assert len(got) == 110
    best = max(got.values())
    assert best > 0.9 > got[-5, -15]
    assert classify.svm_grid(rows)[2] == best


@pytest.mark.parametrize("together", [17, 2000])
def test_knn_by_blocks_is_the_plain_vote(spark, monkeypatch, together):
    monkeypatch.setattr(classify, "TOGETHER", together)
    rng = np.random.default_rng(2)
    x, label, fold = rng.poisson(0.7, (80, 6)).astype(float), rng.integers(0, 2, 80).astype(float), rng.integers(0, 4, 80)
    rows = spark.createDataFrame([(k, Vectors.dense(x[k]), float(label[k]), int(fold[k])) for k in range(80)], ["urlid", "features", "label", "fold"])
    right = 0
    for k in range(80):
        near = sorted((((x[k] - x[j]) ** 2).sum(), j) for j in range(80) if fold[j] != fold[k])[:3]
        right += (sum(label[j] for _, j in near) >= 2) == (label[k] == 1)
    assert classify.knn_accuracy(rows) == pytest.approx(right / 80)


def test_landmarks_keep_the_distances_of_a_plane(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(120, 2))
    far = lambda a, b: float(np.linalg.norm(points[a] - points[b]))
    near = spark.createDataFrame([(i, j, far(i, j)) for i in range(120) for j in range(0, 120, 12)], "i long, j long, d double")
    found = {r["i"]: (r["y1"], r["y2"]) for r in evaluate.placed(near, spark.createDataFrame([(j,) for j in range(0, 120, 12)], "j long")).collect()}
    assert len(found) == 120
    for a, b in [(0, 1), (5, 77), (13, 119), (50, 51)]:
        assert math.dist(found[a], found[b]) == pytest.approx(far(a, b), abs=1e-6)


def test_scaled_documents_keep_groups_apart(spark):
    """Three groups of documents with words of their own, and one document without a common word."""
    r = np.random.default_rng(7)
    texts = [" ".join(f"g{k % 3}w{int(x)}" for x in r.zipf(1.3, 30) % 25) for k in range(60)] + ["alone"]
    v = vocabulary.vectors(docs(spark, *texts))
    found = {r["urlid"]: np.array([r["y1"], r["y2"]]) for r in evaluate.scaled_documents(v, landmarks=30).collect()}
    assert set(found) == set(range(61))
    centres = [np.mean([found[k] for k in range(g, 60, 3)], axis=0) for g in range(3)]
    spread = max(np.linalg.norm(found[k] - centres[k % 3]) for k in range(60))
    assert all(np.linalg.norm(centres[a] - centres[b]) > 2 * spread for a in range(3) for b in range(a))


def test_dissimilarity_clamps(spark):
    assert spark.range(1).select(similarity.dissimilarity(F.lit(1.0)).alias("d")).first()["d"] == 0


def test_topics_of_unlabelled_documents(spark, tmp_path, monkeypatch):
    """Models come from the labelled rows with the default number of words; all documents get topics."""
    rows = [(i, ("bright clear. fine fine text" if i % 2 else "dull grey. poor poor text") + f" n{i}.", "en", "src1", 30) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    train, seen = classify.train, []

    def watched(rows, *args, terms=classify.TERMS):
        seen.append((rows.count(), terms))
        return train(rows, *args[:1], ["good"], terms=terms)

    monkeypatch.setattr(classify, "train", watched)
    got = {r["urlid"]: r["categories"] for r in registry.predict_topics(spark, str(tmp_path)).collect()}
    assert seen == [(20, 1000)]
    assert got == {i: "good" if i % 2 else "" for i in range(40)}


def test_pairs_of_blocks_are_not_shuffled(spark, monkeypatch):
    """The pieces face each other where they are read; the mark of i, also an unknown one, comes along."""
    monkeypatch.setattr(similarity, "BLOCK", 3)
    v = vocabulary.vectors(docs(spark, *[f"a{k % 4} b{k % 3} c" for k in range(12)]))
    marks = spark.createDataFrame([(k, None if k % 3 == 0 else k % 3 == 1) for k in range(12)], "urlid long, mark boolean")
    found = similarity.block_pairs(v, 0.1, "urlid", marks.where("urlid > 5").select("urlid"), marks)
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    want = naive_pairs(v.collect(), 0.1)
    assert {(r["i"], r["j"]): r["mark"] for r in found.collect()} == {(i, j): None if i % 3 == 0 else i % 3 == 1 for i, j in want if j > 5}


def test_nearest_by_pieces_is_that_of_all_pairs(spark, monkeypatch):
    """Copies, null and zero vectors, null elements and other lengths, in several pieces; no row per pair leaves a task."""
    for name, size in (("FACED", 7), ("ASKED", 3), ("CHUNK", 2)):
        monkeypatch.setattr(classify, name, size)
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=4)], k % 3) for k in range(30)]
    rows += [(30, rows[2][1], 1), (31, rows[2][1], 2), (32, None, 0), (33, [0.0] * 4, 0), (34, [1.0, None, 1.0, 1.0], 1), (35, [1.0], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    few = v.where("vec_id in (2, 5, 32, 33, 34, 35)")
    cosine = similarity.dense_cosine(F.col("embedding"), F.col("q")).alias("sim")
    pairs = v.join(few.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", "label", cosine)
    want = pairs.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id"))).where("place <= 33")
    got = classify.nearest(v, few, 33)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert "MapInPandas" in got._jdf.queryExecution().executedPlan().toString()


def test_corpus_labels_do_not_depend_on_the_text(spark):
    corpus = spark.createDataFrame([(0, "a"), (1, "?!"), (2, None), (2, "b"), (3, "c")], "urlid long, content string")
    cats = spark.createDataFrame([(0, "y"), (0, "x"), (1, "NotRelated"), (2, "z")], "urlid long, category string")
    assert sorted(map(tuple, relational.joined_labels(corpus, cats).collect())) == [(0, "x y"), (1, "NotRelated"), (2, "z z")]


def test_edges_are_reduced_to_stars(spark):
    edges = [(a, b) for a in range(40) for b in range(a + 1, 40)] + [(50, 51), (52, 51), (60, 60)]
    df = spark.createDataFrame(edges, "a long, b long").coalesce(1)
    assert graphs.stars(df).count() == 39 + 2
    assert {tuple(r) for r in graphs.components(df).collect()} == {(k, 0) for k in range(40)} | {(50, 50), (51, 50), (52, 50)}


def test_dealt_texts_are_counted_where_they_are(spark):
    """Also where a document has two rows; the terms are not shuffled."""
    df = spark.createDataFrame([(1, "a b a"), (1, "A c"), (2, ""), (3, None), (4, "d")], "urlid long, content string")
    got = vocabulary.term_frequency(df, dealt=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, vocabulary.term_frequency(df).collect()))
    assert "hashpartitioning(urlid" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", term#" not in plan.split("hashpartitioning(", 1)[1].split(")")[0]


def test_vectors_are_made_where_texts_are_read(spark, monkeypatch):
    """The same as by shuffles, also of stems and in small batches, without a shuffle of terms."""
    monkeypatch.setattr(vocabulary, "COUNTED", 7)
    texts = ["a b a running runs", "", "Ran, RUNS a_b 7", None, "the the of", "x " * 30 + "b"]
    rows = docs(spark, *texts)
    for stem, stop in ((False, ()), (True, ("the",))):
        tf = vocabulary.term_frequency(rows, stopwords=stop)
        tf = vocabulary.stem_terms(tf) if stem else tf
        want = {(r["urlid"], r["term"]): (r["w"], r["df"]) for r in vocabulary.tfidf(tf, vocabulary.Vocabulary.fit(tf, rows)).collect()}
        v = vocabulary.vectors(rows, stopwords=stop, stem=stem)
        got = {(r["urlid"], r["term"]): (r["w"], r["df"]) for r in v.collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k][0], want[k][0], abs_tol=1e-12) and got[k][1] == want[k][1] for k in want)
        assert "Exchange" not in v._jdf.queryExecution().executedPlan().toString()
    stems = vocabulary.stemmed_frequency(rows)
    assert sorted(map(tuple, stems.collect())) == sorted(map(tuple, vocabulary.stem_terms(vocabulary.term_frequency(rows)).collect()))
    assert "Exchange" not in stems._jdf.queryExecution().executedPlan().toString()
    assert vocabulary.vectors(docs(spark, "", None)).count() == 0


def test_vectors_of_repeated_documents(spark):
    """Rows of one document are one vector, and each row counts in the number of documents."""
    rows = spark.createDataFrame([(1, "a b"), (1, "b c"), (2, "a"), (None, "d")], "urlid long, content string")
    tf = vocabulary.term_frequency(rows)
    want = sorted(map(str, vocabulary.tfidf(tf, vocabulary.Vocabulary.fit(tf, rows)).collect()))
    assert sorted(map(str, vocabulary.vectors(rows).collect())) == want
    assert sorted(map(str, vocabulary.stemmed_frequency(rows).collect())) == sorted(map(str, tf.collect()))


def test_pairs_of_texts_are_those_of_their_vectors(spark, monkeypatch):
    """Also for later documents, marks, documents without an id and those of several rows."""
    rng = np.random.default_rng(2)
    monkeypatch.setattr(similarity, "BLOCK", 7)
    monkeypatch.setattr(similarity, "MOST_TOGETHER", 20)
    rows = [(k, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 25) % 60), k % 3 == 0, [None, True, False][k % 5 % 3]) for k in range(60)] + [(60, "", True, True)]
    for more in ([(None, "w1 w2", True, True)], [(3, "w1 w2", True, True)]):
        df = spark.createDataFrame(rows + more, "urlid long, content string, later boolean, mark boolean")
        v = vocabulary.vectors(df)
        named = v.where("urlid is not null")
        want = {(i, j): s for (i, j), s in naive_pairs(named.collect(), 0.2).items()}
        got = {(r["i"], r["j"]): r["sim"] for r in similarity.similar_documents(df, 0.2).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
        if more[0][0] is None:
            some = df.where("urlid is null or urlid > 9")
            marked = {(r["i"], r["j"]): r["mark"] for r in similarity.similar_documents(df, 0.2, some).collect()}
            assert marked == {(i, j): rows[i][3] for i, j in want if i > 9 and rows[j][2]}


def test_sweep_of_texts_is_that_of_their_vectors(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 9)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, rng.integers(1, 12)) % 30) for _ in range(50)] + ["", "only"]
    rows = [(k, t, None if k % 11 == 0 else DAY - dt.timedelta(int(rng.integers(0, 40))), None if k % 7 == 0 else f"l{rng.integers(0, 5)}") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "urlid long, content string, pubdate date, label string")
    want = evaluate.label_sweep(vocabulary.vectors(df), df.drop("content")).orderBy("k").collect()
    assert evaluate.label_sweep(None, df).orderBy("k").collect() == want


@pytest.mark.parametrize("many", [1, 40, 10**9])
def test_product_of_pieces(monkeypatch, many):
    """F1 to F5 of round 4: dense, mixed and entry by entry; only terms without weight are looked at again, and a piece that stays is made ready once."""
    monkeypatch.setattr(similarity, "MANY", many)
    monkeypatch.setattr(similarity, "PIECE", 3)
    monkeypatch.setattr(similarity, "PRODUCTS", 50)
    rng = np.random.default_rng(8)
    whole = [np.where(rng.random((n, 30)) < rng.random(30), rng.random((n, 30)), 0) for n in (12, 9)]
    there = [w > 0 for w in whole]
    whole[0][:, 3] = whole[1][:, 4] = 0  # terms that are there without weight
    whole[0][0], there[0][0] = 0, np.arange(30) == 3
    sides = []
    for w, t in zip(whole, there, strict=True):
        term, row = np.nonzero(t.T)
        sides.append(similarity.Sparse.of(np.unique(term), np.bincount(term)[np.unique(term)], row, w[row, term], len(w)))
    for shared in (False, True):
        dots, met = similarity.product(*sides, shared)
        assert np.allclose(dots, whole[0] @ whole[1].T, atol=1e-12)
        assert (met == (there[0] @ there[1].T if shared else whole[0] @ whole[1].T > 0)).all()
    empty = similarity.Sparse.of(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0), 4)
    assert not similarity.product(empty, sides[1], True)[1].any() and not similarity.product(sides[0], empty)[0].any()


def test_a_piece_that_stays_is_made_ready_once(monkeypatch):
    """F1 to F5 of round 4."""
    made = []
    monkeypatch.setattr(similarity, "sparse", lambda piece, real=similarity.sparse: made.append(piece["id"][0]) or real(piece))
    kinds = similarity.SQUEEZED
    piece = lambda low: {"low": low, "high": low + 1, "id": np.array([low, low + 1])} | {c: similarity.squeezed(np.array(x, kinds[c])) for c, x in {"row": [0, 1], "term": [5], "size": [2], "weight": [0.5, 1.0]}.items()}
    rows = [{f"{c}_{k}": v for k, p in (("a", piece(x)), ("b", piece(y))) for c, v in p.items()} for x in (0, 10) for y in (0, 10, 20)]
    out = list(similarity.compared(iter([pd.DataFrame(rows[:4]), pd.DataFrame(rows[4:])]), False))
    assert len(out) == 6 and sorted(made) == [0, 0, 10, 10, 20]
    assert all((dots == [[0.25, 0.5], [0.5, 1.0]]).all() for _, _, dots, _ in out)


def test_top_grams_are_those_of_all_counts(spark, monkeypatch):
    """also where buckets are shared and no batch has all; what can't be among the first is not shuffled."""
    monkeypatch.setattr(vocabulary, "COUNTED", 40)
    monkeypatch.setattr(vocabulary, "LEADING", 6)
    rng = np.random.default_rng(3)
    df = docs(spark, *[" ".join(f"w{int(x)}" for x in rng.zipf(1.5, rng.integers(0, 30)) % 50) for _ in range(40)], None, "", "A a", "b")
    for bits in (3, 12):
        monkeypatch.setattr(vocabulary, "BUCKET_BITS", bits)
        for n, k in ((2, 5), (3, 8), (2, 100_000)):
            want = vocabulary.gram_counts(df, n).orderBy(F.desc("n"), "gram").limit(k).collect()
            assert vocabulary.top_grams(df, n, k).collect() == want and len(want) >= 5
    assert vocabulary.top_grams(docs(spark, "", None), 2).collect() == []


def test_points_of_texts_are_those_of_their_vectors(spark):
    """also for texts without a term of any landmark and those without terms, without a shuffle of terms."""
    df = docs(spark, *[f"a{k % 4} b{k % 3} c" for k in range(12)], "alone", "", None)
    want = {r["urlid"]: (r["y1"], r["y2"]) for r in evaluate.scaled_documents(vocabulary.vectors(df), landmarks=5).collect()}
    out = evaluate.scaled_texts(df, landmarks=5)
    got = {r["urlid"]: (r["y1"], r["y2"]) for r in out.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_distances_of_texts_are_those_of_their_vectors(spark):
    """texts without terms, of no category and of several rows; no text's terms are shuffled."""
    rows = [(k, f"a{k % 4} b{k % 3} c" if k % 5 else f"lone{k}", ["x", "y", None][k % 3]) for k in range(20)] + [(20, "", "x"), (21, None, "y"), (22, "c c a1", "y")]
    for more in ([], [(3, "c d", "x")]):
        df = spark.createDataFrame(rows + more, "urlid long, content string, category string")
        v, weights = vocabulary.vectors(df), similarity.text_weights(df)
        want = similarity.centroids(v, df.select("urlid", "category"))
        centres = similarity.text_centroids(df, weights=weights)
        by = [{(r["category"], r["term"]): r["w"] for r in c.collect()} for c in (centres, want)]
        assert by[0].keys() == by[1].keys() and all(math.isclose(by[0][k], by[1][k], abs_tol=1e-12) for k in by[1])
        far = similarity.text_dissimilarity(df, centres, weights)
        by = [{(r["urlid"], r["category"]): r["d"] for r in x.collect()} for x in (far, similarity.sparse_dissimilarity(v, want, "urlid", "category"))]
        assert by[0].keys() == by[1].keys() and len(by[1]) > 20 and all(math.isclose(by[0][k], by[1][k], abs_tol=1e-9) for k in by[1])
        assert more or "Exchange" not in far._jdf.queryExecution().executedPlan().toString()
