"""The pipeline's stages against the plain versions, each on its own input."""

import random

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import DOCS, corpus, prose


def test_stages(spark, tmp_path):
    page = "Home | News | About | Help\nA plain sentence of ordinary words that says one thing or two.\nTous droits réservés.\nAnother line with quite different content closes this text."
    junk = "a### b%%% c*** d$$$ e f### g&&& h### i%%% j k###"
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}", 0) for i, t in [*corpus(), (900, page), (901, junk)]], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    item = " ".join(corpus()[30][1].split()[5:45])
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen, current = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"], r["source"]) for r in current.collect()]
        out = stage(spark, current, str(tmp_path))
        if name != "shards":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, current)
    ids = lambda name: sorted(r["doc_id"] for r in seen[name][1].collect())
    texts = lambda name: [(d, t) for d, t, _ in seen[name][0]]
    want = {d: brute.cleaned(t) for d, t in texts("quality_rules")}
    assert {r["doc_id"]: r["text"] for r in seen["quality_rules"][1].collect()} == {d: t for d, t in want.items() if t is not None}
    assert ids("near_duplicates") == sorted({c for _, c in brute.classes(texts("near_duplicates")).values()})
    bad = {d for d, _ in brute.contaminated(texts("decontamination"), [(0, item)])}
    assert ids("decontamination") == sorted(d for d, _ in texts("decontamination") if d not in bad)
    copies = brute.mixed([(d, s, t) for d, t, s in seen["source_mix"][0]])
    assert ids("source_mix") == sorted(d for (d, _, _), n in copies for _ in range(n))
    assert ids("shards") == ids("source_mix")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids("shards"))


def test_odd_tables(spark, tmp_path):
    """Null and shared ids, repeated rows and null texts: each different clean text stays once up to the mix; an empty table gives nothing."""
    r = random.Random(40)
    clean = [prose(r, 60) for _ in range(8)]
    rows = [(None, clean[0]), (None, clean[1]), (1, clean[2]), (1, clean[3]), (2, clean[4]), (2, clean[4]), (3, clean[4]), (None, clean[4]), (4, None), (None, None), (5, ""), (6, clean[5]), (None, clean[5]), (7, clean[6]), (-1, clean[7])]
    docs = spark.createDataFrame([(i, t, "en" if i else None, "src1" if i != 2 else None, None) for i, t in rows], DOCS)
    spark.createDataFrame([(0, prose(r, 30)), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    current = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, current, str(tmp_path)).write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
    assert sorted(x["text"] for x in current.collect()) == sorted(clean)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert 0 < corpus_pipeline.run(spark, str(tmp_path)).count() <= 3 * len(clean)
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "benchmark.parquet")).write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
