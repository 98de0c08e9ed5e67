"""Near copies against all pairs, with and without crowded buckets, and on edge rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from textweir.llm import nearcopies
from textweir.llm.nearcopies import NearCopies, NearCopySpec, expand_pairs, near_copies, near_copy_classes, words
from textweir.session import cut

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def brute(rows, spec):
    sets = {}
    for i, t in rows:
        w = words(t or "")
        if len(w) >= max(spec.min_words, spec.words_per_shingle):
            k = spec.words_per_shingle
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= spec.threshold * len(sets[a] | sets[b])}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if i % 3 or not rows:
            text = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 90))]
        else:
            text = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((i, " ".join(text)))
    return rows


def found(spark, rows, spec):
    df = spark.createDataFrame(rows, "id long, text string")
    return {(r["id_a"], r["id_b"]) for r in expand_pairs(near_copies(df, "id", "text", spec)).collect()}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("limit", [64, 1])
def test_all_pairs(spark, seed, limit):
    spec = NearCopySpec(threshold=0.6, words_per_shingle=3, min_words=30, bucket_limit=limit, max_bands=80)
    rows = corpus(seed)
    assert found(spark, rows, spec) == brute(rows, spec)


def test_all_pairs_of_crowded_buckets(spark):
    spec = NearCopySpec(threshold=0.6, words_per_shingle=3, min_words=30, crowd_limit=1, max_bands=80)
    rows = corpus(1)
    assert found(spark, rows, spec) == brute(rows, spec)


def test_copies_met_by_many_tasks_keep_no_band_rows(spark, monkeypatch):
    rng, kept, cut = random.Random(9), [], nearcopies.cut
    texts = [" ".join(f"{k}x{rng.randrange(400)}" for _ in range(40)) for k in range(10)]
    df = spark.createDataFrame([(10 * i + k, t) for i in range(80) for k, t in enumerate(texts)], "id long, text string").repartition(80)
    monkeypatch.setattr(nearcopies, "cut", lambda x: kept.append(cut(x)) or kept[-1])
    monkeypatch.setattr(nearcopies, "_prefix_pairs", lambda *a: pytest.fail("no bucket has two different texts"))
    near = near_copies(df, "id", "text", NearCopySpec(threshold=0.6, words_per_shingle=3, min_words=30))
    # No two different texts share a band, so only the memberships go to disk, however many tasks met a text.
    assert kept[0].count() == 800 and near.pairs.count() == 0
    assert expand_pairs(near).count() == 10 * 80 * 79 // 2


def test_cut_leaves_no_shuffle_files(spark):
    def files():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count(".data")

    before, setting = files(), spark.conf.get(CLEANUP)
    df = cut(spark.range(20_000).repartition("id"))
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and df.count() == 20_000 and spark.conf.get(CLEANUP) == setting


def test_default_is_five_words_at_four_fifths():
    spec = NearCopySpec()
    assert (spec.words_per_shingle, spec.threshold) == (5, 0.8)
    bands, rows = spec.bands_and_rows()
    assert 1 - (1 - spec.threshold**rows) ** bands >= spec.target_recall and bands <= spec.max_bands


def test_a_third_of_all_rows_is_one_text(spark):
    rows = corpus(5, 40)
    rows += [(1000 + i, rows[1][1].upper() + " !") for i in range(30)]
    spec = NearCopySpec(threshold=0.6, words_per_shingle=3, min_words=30)
    df = spark.createDataFrame(rows, "id long, text string").repartition(8)
    near = near_copies(df, "id", "text", spec)
    assert near.members.filter(F.col("rep") == 1).count() == 31
    assert near.pairs.filter("ra = 1 or rb = 1").count() <= 40
    assert {(r["id_a"], r["id_b"]) for r in expand_pairs(near).collect()} == brute(rows, spec)
    linked = {r["id"]: r["linked_records"] for r in near_copy_classes(near).collect()}
    pairs = brute(rows, spec)
    assert linked == {i: sum(i in p for p in pairs) for i in linked}


def test_edges(spark):
    text = " ".join(f"x{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "too few words"), (5, text), (6, text + "!"), (None, text), (7, text * 3000), (8, text.replace(" ", "\r\n "))]
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "1 as key", "2 as fp", "'a' as rep", "3 as n", "4 as record")
    near = near_copies(df, "id", "text", NearCopySpec())
    assert {(r["id_a"], r["id_b"]) for r in expand_pairs(near).collect()} == brute([r for r in rows if r[0]], NearCopySpec()) == {(a, b) for a in (5, 6, 7) for b in (6, 7, 8) if a < b}
    assert sorted(r["id"] for r in near_copy_classes(near).collect()) == [5, 6, 7, 8]  # the long text repeats the same runs
    empty = near_copies(df.limit(0), "id", "text", NearCopySpec())
    assert expand_pairs(empty).count() == 0 and near_copy_classes(empty).count() == 0


def test_unreachable_recall_is_an_error():
    with pytest.raises(ValueError):
        NearCopySpec(threshold=0.09).bands_and_rows()


def test_large_classes_are_expanded_once(spark):
    m = spark.range(1200).select("id", F.lit(0).cast("long").alias("rep")).union(spark.range(2000, 2003).select("id", F.lit(2000).cast("long").alias("rep")))
    pairs = spark.createDataFrame([(0, 2000, 0.9)], "ra long, rb long, similarity double")
    out = expand_pairs(NearCopies(m, pairs))
    n = 1200 * 1199 // 2 + 3 + 1200 * 3
    assert out.count() == n == out.distinct().count() and out.filter("id_a >= id_b").count() == 0
