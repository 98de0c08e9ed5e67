"""Operators over rows: duplicates, similarity, sources, sinks, streams, pipelines."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textweir.functions import text as T
from textweir.operators import dedup, scorers, scoring, similarity, stats
from textweir.plans import pipeline
from textweir.queries import core
from textweir.sources import readers, writers
from textweir.streaming import streams


def greedy(ids, buckets):
    by_id = {}
    for b, i in buckets:
        by_id.setdefault(i, set()).add(b)
    used, kept = set(), []
    for i in sorted(ids):
        if not by_id.get(i, set()) & used:
            kept.append(i)
            used |= by_id.get(i, set())
    return kept


def union_find(ids, edges):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed", range(4))
def test_greedy_and_components(spark, seed):
    rng = random.Random(seed)
    ids = list(range(60))
    buckets = sorted({(rng.randrange(45), i) for i in ids for _ in range(rng.randrange(3))})
    nodes, rows = spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(buckets, "bucket long, id long")
    kept = sorted(r["id"] for r in dedup.greedy_survivors(nodes, rows).collect())
    assert kept == greedy(ids, buckets)
    pairs = [(a, b) for x, a in buckets for y, b in buckets if x == y and a < b]
    got = {r["id"]: r["component"] for r in dedup.components(nodes, dedup.bucket_stars(rows)).collect()}
    assert got == union_find(ids, pairs)
    assert {r["id"] for r in dedup.component_survivors(nodes, dedup.bucket_stars(rows)).collect()} <= set(kept)


def test_long_chain_is_one_component(spark):
    n = 400
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert dedup.components(spark.range(n), edges).agg(F.max("component")).first()[0] == 0


def test_chain_greedy_keeps_both_ends(spark):
    nodes = spark.range(3)
    buckets = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 2)], "bucket long, id long")
    assert sorted(r["id"] for r in dedup.greedy_survivors(nodes, buckets).collect()) == [0, 2]
    assert [r["id"] for r in dedup.component_survivors(nodes, dedup.bucket_stars(buckets)).collect()] == [0]


def test_short_docs_collapse_or_stay(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "three"), (3, None), (4, "a b c d e f g h")], "id long, text string")
    signed = dedup.signatures(df, "id", "text", dedup.word_ngrams(5), dedup.AT_08)
    for how, want in (("collapse", [1, 4]), ("keep", [1, 2, 3, 4])):
        stars = dedup.bucket_stars(dedup.band_buckets(signed, dedup.AT_08, how))
        assert sorted(r["id"] for r in dedup.component_survivors(df, stars).collect()) == want


def test_exact_survivors(spark):
    df = spark.createDataFrame([(3, " Same  text here "), (1, "same text HERE"), (2, "short"), (4, None), (5, "another longer text")], "id long, text string")
    assert sorted(r["id"] for r in dedup.exact_survivors(df, "id", "text").collect()) == [1, 5]
    assert dedup.exact_survivors(df.limit(0), "id", "text").count() == 0


@pytest.mark.parametrize("metric", ["dot", "l2"])
def test_top_k_is_exact_over_blocks(spark, metric):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(90, 4)), 1)  # rounded, so that ties occur
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    spec = similarity.TopK(k=4, metric=metric, block_rows=16)
    got = {}
    for r in similarity.top_k(rows.filter("id % 20 = 0"), rows, spec).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    for q in range(0, 90, 20):
        s = x @ x[q] if metric == "dot" else -((x - x[q]) ** 2).sum(1)
        want = sorted(range(90), key=lambda i: (-round(float(s[i]), 9), i))[:4]
        assert [round(float(s[got[q][k]]), 9) for k in (1, 2, 3, 4)] == [round(float(s[i]), 9) for i in want]


def test_ivf_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = rows.filter("id % 20 = 0")
    exact = {(r["query_id"], r["id"]) for r in similarity.top_k(q, rows, similarity.TopK(k=5, metric="l2")).collect()}
    found = {(r["query_id"], r["id"]) for r in similarity.ivf_top_k(q, rows, 5, similarity.IvfSpec(lists=20, probes=10)).collect()}
    assert len(exact & found) / len(exact) >= 0.9


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_ivf_recall_of_the_registered_setting(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = rows.filter("id % 20 = 0")
    # A row is its own nearest, whatever is probed; only the others say something.
    exact = {(r["query_id"], r["id"]) for r in similarity.top_k(q, rows, similarity.TopK(k=5, metric="l2")).collect() if r["query_id"] != r["id"]}
    found = {(r["query_id"], r["id"]) for r in similarity.ivf_top_k(q, rows, 5).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"text": "good", "n": 1}\n\n{broken\n{"text": null, "n": 2}\n', encoding="utf-8")
    audited = readers.read_json_lines_audited(spark, str(tmp_path / "in"), "text string, n long")
    assert audited.count() == 3 and audited.filter("is_bad").count() == 1
    assert readers.read_json_lines(spark, str(tmp_path / "in"), "text string, n long").count() == 2
    with pytest.raises(Exception):
        readers.read_json_lines(spark, str(tmp_path / "in"), "text string, n long", strict=True).collect()
    df = spark.range(100).select("id", F.concat(F.lit("é "), F.col("id")).alias("text"), F.when(F.col("id") % 3 == 0, "rag").otherwise("code").alias("category"))
    writers.write_shards(df, str(tmp_path / "shards"), 4, "id")
    spans = []
    for p in sorted((tmp_path / "shards").glob("*.json")):
        ids = [json.loads(x)["id"] for x in p.read_text(encoding="utf-8").splitlines()]
        if ids:
            assert ids == list(range(ids[0], ids[-1] + 1))
            spans.append((ids[0], ids[-1]))
    assert sum(b - a + 1 for a, b in spans) == 100
    for mode, made in (("separate", {"combined", "separate"}), ("combined", {"combined"}), ("none", set()), ("odd", {"combined", "separate"})):
        writers.write_by_category(df, str(tmp_path / mode), mode=mode, enabled={"code": False})
        assert {p.name for p in (tmp_path / mode).glob("*")} == made
        if made:
            assert spark.read.json(str(tmp_path / mode / "combined")).count() == 34
    writers.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv")).count() == 100


def test_training_records(spark):
    df = spark.createDataFrame([([1, 2], "t"), ([], "kept"), (None, None)], "tokens array<int>, text string")
    assert [tuple(r) for r in writers.training_records(df).collect()] == [("1 2", 2), ("kept", None), (None, None)]


def test_streams_match_batch(spark, tmp_path):
    for k, rows in enumerate([[(1, "a long enough text"), (2, "A long  enough text")], [(3, "another one"), (4, "a long enough text"), (5, None)]]):
        spark.createDataFrame(rows, "id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = streams.read_files(spark, str(tmp_path / "in"), "id long, text string", files_a_batch=1)
    out = streams.run_available(streams.distinct_texts(s), str(tmp_path / "out"))
    assert out.count() == out.select("sha").distinct().count() == 3
    again = streams.read_files(spark, str(tmp_path / "in"), "id long, text string", files_a_batch=1)
    assert streams.run_available(streams.distinct_texts(again), str(tmp_path / "out")).count() == 3


def test_funnel_sums(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,), (None,)], "stage string")
    rows = {r["stage"]: (r["rejected"], r["cleared"]) for r in stats.funnel(df, "stage", ("a", "b", "c")).collect()}
    assert rows == {"a": (2, 3), "b": (1, 2), "c": (0, 2)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, text string")
    assert pipeline.comprehensive(none).count() == 0
    assert scoring.lm_scores(none, "id", "text").count() == 0
    assert stats.length_stats(none.withColumn("n", F.lit(1)), "n").first()["valid_records"] == 0
    assert similarity.tfidf_similarity(none, "id", "text", {"a": "some words"}).count() == 0
    assert dedup.components(none.select("id"), spark.createDataFrame([], "src long, dst long")).count() == 0


def test_comprehensive_stages(spark):
    df = spark.createDataFrame([(1, "x"), (2, "You can execute the function because we learn. However, it returns a response. Do you see the result?"), (3, None)], "id long, text string")
    rows = {r["id"]: (r["rejected_at"], r["should_include"]) for r in pipeline.comprehensive(df).collect()}
    assert rows[1] == rows[3] == ("preselect", False) and rows[2] == (None, True)


def test_combined_preselect_rejects_by_similarity(spark):
    from textweir.functions import rules as R
    from textweir.queries import core

    sf = "/root/testdata/sf0.01"
    rule = core.featured(spark, sf).select("doc_id", R.enhanced_checks().alias("c")).select("doc_id", R.enhanced_preselect(F.col("c")).alias("rule"))
    near = core.sim_tfidf(spark, sf).groupBy("doc_id").agg(F.max("similarity").alias("similarity"))
    rows = core.plan_combined_preselect(spark, sf).join(rule, "doc_id").join(near, "doc_id").collect()
    outcomes = set()
    for r in rows:
        hints, own = r["hints"].split(",") if r["hints"] else [], r["rule"]["hints"] if r["rule"]["passed"] else []
        outcomes.add((r["rule"]["passed"], r["passed"]))
        assert r["passed"] == (r["rule"]["passed"] and r["similarity"] >= core.NEAR_DESCRIPTION)
        want = [x for x, counts in ((r["rule"]["quality_score"], r["rule"]["passed"]), (r["similarity"], r["passed"])) if counts]
        assert r["combined_score"] == pytest.approx(sum(want) / len(want) if want else 0, abs=2e-6)
        assert (len(hints) == len(own) + 1 and hints[-1] in core.DESCRIBED) if r["passed"] else hints == own
    assert outcomes == {(True, True), (True, False), (False, False)}


def test_threshold_sweep_is_monotone(spark):
    df = spark.range(50).select((F.col("id") / 50).alias("s"))
    kept = [r["kept"] for r in scoring.threshold_sweep(df, "s", [0.1, 0.5, 0.9]).collect()]
    assert kept == [45, 25, 5]


def test_classifier_learns(spark):
    rows = [(i, "good clean words" if i % 2 else "bad foul terms", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    model = scoring.fit_classifier(df, "text", "label")
    scored = scoring.classify(model, df, "text").select("label", (F.col("p1") > 0.5).alias("said"))
    assert stats.binary_metrics(scored.select((F.col("label") == 1).alias("t"), "said"), "t", "said").first()["accuracy"] == 1.0


def test_command_line_filter(spark, tmp_path):
    from textweir import cli
    from textweir.functions import categories as C
    from test_functions import COMMANDS

    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps({"text": t}) for t in COMMANDS), encoding="utf-8")
    counts = cli.filter_commands(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"), C.STRICTNESS["moderate"])
    assert counts == {"read": 12, "kept": 9}
    assert cli.parser().parse_args(["commands", "a", "b", "--strictness", "lenient"]).strictness == "lenient"


def test_examples(spark):
    from textweir.operators import examples

    df = spark.createDataFrame([(i, "a", 0.9) for i in range(10)] + [(20, "b", 0.1), (21, "a", 0.5)], "id long, g string, s double")
    rows = examples.labelled_examples(df, "g", "s").collect()
    assert {r["g"] for r in rows} == {"a"} and len(rows) == 10 and {r["label"] for r in rows} == {1}
    pairs = [(r["id"], r["negative_id"]) for r in examples.with_negative(spark.range(2500), "id", 100).collect()]
    assert len(pairs) == 2500 and all(a != b for a, b in pairs) and len({b for _, b in pairs}) > 2450
    assert examples.with_negative(spark.range(1), "id").first()["negative_id"] is None
    seen, o = examples.observed(spark.range(7), "seen", F.max("id").alias("top"))
    assert len(seen.collect()) == 7 and o.get == {"rows": 7, "top": 6}


def test_stream_of_near_copies(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog and runs away into the deep forest again"
    for rows in ([(1, text), (2, text + "."), (3, "something else entirely is written in this other text here")], [(4, text + " "), (5, "a third kind of text that nobody has seen before at all")]):
        spark.createDataFrame(rows, "id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = streams.read_files(spark, str(tmp_path / "in"), "id long, text string", files_a_batch=1)
    assert sorted(r["id"] for r in streams.drop_near_copies(s, "id", "text", str(tmp_path / "work")).collect()) in ([1, 3, 5], [3, 4, 5])


def test_scorers_fall_back(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "c"), (4, "c")], "id long, text string").withColumn("score", F.lit("clash"))

    def length():
        return lambda texts: [float(len(t)) for t in texts]

    def fails_on_c():
        def score(texts):
            if "c" in texts:
                raise ValueError
            return [1.0] * len(texts)

        return score

    def got(out):
        return sorted((r["id"], r["score"], r["scored"]) for r in out.collect())

    assert got(scorers.scores(df, "id", "text", length)) == [(1, 3.0, True), (2, 0.0, True), (3, 0.0, True), (4, 1.0, True), (4, 1.0, True)]
    assert {x[1:] for x in got(scorers.scores(df, "id", "text", core.missing_model))} == {(0.5, False)}
    one_each = got(scorers.scores(df, "id", "text", fails_on_c, fallback=0.3, rows=1))
    assert one_each == [(1, 1.0, True), (2, 1.0, True), (3, 1.0, True), (4, 0.3, False), (4, 0.3, False)]
    assert got(scorers.scores_where(df, F.col("text") == "c", "id", "text", length, otherwise=0.0)) == [(1, 0.0, False), (2, 0.0, False), (3, 0.0, False), (4, 1.0, True), (4, 1.0, True)]
    assert scorers.scores(df.limit(0), "id", "text", length).count() == 0


def test_exact_percentile(spark):
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=3000), rng.integers(0, 5, 500).astype(float), np.array([2.5]), np.concatenate([np.zeros(1000), [1e12]])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(3)
        for q in (0.0, 0.25, 0.5, 0.75, 0.999, 1.0):
            assert stats.exact_percentile(df, "v", q, bins=16, most=20) == pytest.approx(np.quantile(values, q), abs=1e-9)
    assert stats.exact_percentile(df.limit(0), "v") is None
    assert stats.percentile_filter(df.limit(0), "v").count() == 0


def test_running_totals_over_spans(spark):
    df = spark.range(1000).withColumn("f", F.col("id") % 3 == 0)
    got = [tuple(r) for r in stats.running_totals(df, "id", "f", every=10, blocks_a_span=7).orderBy("block").collect()]
    assert got == [(b, 10 * (b + 1), len(range(0, 10 * (b + 1), 3))) for b in range(100)]
    assert stats.running_totals(df.limit(0), "id", "f").count() == 0


def test_text_of_samples(spark):
    turns = "array<struct<from: string, value: string>>"
    c = spark.createDataFrame([([("u", " hi"), ("b", None), ("b", "there ")],), ([],), (None,)], f"conversations {turns}")
    assert [r["text"] for r in T.sample_text(c).collect()] == ["hi there", "", ""]
    two = spark.createDataFrame([("do", "done"), (None, "x"), (None, None)], "instruction string, output string")
    assert [r["text"] for r in T.sample_text(two).collect()] == ["do done", "x", ""]
    any_ = spark.createDataFrame([("a", 1, "b"), (None, 2, None)], "x string, n int, y string")
    assert [r["text"] for r in T.sample_text(any_).collect()] == ["a b", ""]
    k = spark.createDataFrame([(None, "g"), ("c", "g"), (None, None)], "cluster_id string, group string")
    assert [r["c"] for r in k.select(T.cluster_of(k).alias("c")).collect()] == ["g", "c", "unknown"]


def test_chain_without_a_scorer(spark):
    long = "We explain the problem step by step. " * 8
    df = spark.createDataFrame([(1, long), (2, "short"), (3, None), (4, "the cat sat on a mat and we saw it all day long. " * 3)], "id long, text string")
    got = {r["id"]: r["rejected_at"] for r in pipeline.chain(df).collect()}
    assert got[1] in (None, "diversity") and got[2] == got[3] == "word_count"
    scored = df.withColumn("lp", F.lit(9.0)).withColumn("other", F.array(F.lit("x")))
    assert {r["rejected_at"] for r in pipeline.chain(scored, log_perplexity="lp").collect()} <= {"perplexity", "word_count", "diversity"}
