"""Reservoir and packing: exact sizes, uniformity, wholeness, edge rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textweir.llm import queries
from textweir.llm.packing import PackSpec, best_fit, pack
from textweir.llm.reservoir import Reservoir, ReservoirSpec, hypergeometric, log_probability, reservoir, split_draw


@pytest.mark.parametrize("good,bad,draws", [(5, 7, 4), (300, 20, 50), (1, 99, 10), (40, 40, 80), (0, 5, 3), (5, 0, 3)])
def test_hypergeometric_moments(good, bad, draws):
    rng = np.random.default_rng(2)
    x = np.array([hypergeometric(rng, good, bad, draws) for _ in range(4000)])
    n = good + bad
    mean = draws * good / n
    var = mean * bad / n * (n - draws) / max(n - 1, 1)
    assert abs(x.mean() - mean) <= 4 * np.sqrt(var / len(x)) + 1e-9
    assert x.min() >= max(0, draws - bad) and x.max() <= min(draws, good)


def test_hypergeometric_beyond_a_billion():
    x = hypergeometric(np.random.default_rng(0), 10**11, 10**12, 10**6)
    assert abs(x - 10**6 / 11) < 6 * np.sqrt(10**6 / 11)


def test_split_draw_adds_up():
    rng = np.random.default_rng(3)
    for _ in range(50):
        out = split_draw(rng, [3, 0, 5, 9], 8)
        assert sum(out) == 8 and all(a <= b for a, b in zip(out, [3, 0, 5, 9]))


@pytest.mark.parametrize("good,bad,draws", [(10**9, 10**10, 300), (10**13, 10**14, 2000), (10**14, 10**15, 2000), (10**15, 3, 50), (7, 10**15, 10**9), (30, 40, 35), (3, 10**6, 10**6)])
def test_probabilities_add_up(good, bad, draws):
    mass = [math.exp(log_probability(k, good, bad, draws)) for k in range(max(0, draws - bad), min(draws, good) + 1)]
    assert abs(sum(mass) - 1) < 1e-9
    mean = sum(m * k for k, m in zip(range(max(0, draws - bad), len(mass) + draws), mass))
    assert abs(mean - draws * good / (good + bad)) < 1e-6 * (mean + 1e-3)


def pieced(spark, sizes):
    edges = [int(x) for x in np.cumsum([0, *sizes])]
    out = spark.range(0).select("id", F.lit(0).alias("no"))
    for n, (a, b) in enumerate(zip(edges, edges[1:])):
        out = out.union(spark.range(a, b).select("id", F.lit(n).alias("no")))
    return out, edges


def by_turns(spark, df, spec, path):
    r = Reservoir(spark, str(path), spec, merge_every=2)
    for n in sorted(x["no"] for x in df.select("no").distinct().collect()):
        r.add(df.filter(F.col("no") == n), "id")
    return r.rows()


@pytest.mark.parametrize("stream", [False, True])
def test_sample_is_uniform_over_pieces(spark, tmp_path, stream):
    sizes = [200, 3000, 50, 1500, 5000, 250]
    df, edges = pieced(spark, sizes)
    spec = ReservoirSpec(size=1000, seed=4)
    out = by_turns(spark, df, spec, tmp_path).withColumnRenamed("key", "id") if stream else reservoir(df, "id", "no", spec)
    ids = sorted(r["id"] for r in out.collect())
    assert len(ids) == len(set(ids)) == 1000
    got = np.histogram(ids, bins=edges)[0]
    want = np.array(sizes) / edges[-1] * 1000
    assert (((got - want) ** 2 / want).sum()) < 20.5  # chi-square with 5 degrees, one in a thousand
    assert abs(np.mean(ids) - edges[-1] / 2) < 4 * edges[-1] / np.sqrt(12 * 1000)


def test_resent_records_count_once(spark, tmp_path):
    rows = [(1, 0), (1, 0), (2, 0), (None, 0), (3, 0), (1, 2), (3, 2), (3, 3), (4, 3), (5, None), (4, None)]
    df = spark.createDataFrame(rows, "id long, no int").withColumn("key", F.lit("clash")).withColumn("slot", F.lit(9)).withColumn("piece", F.lit(1)).withColumn("turn", F.lit(1))
    assert sorted(r["id"] for r in reservoir(df, "id", "no", ReservoirSpec(size=10)).collect()) == [1, 2, 3, 4, 5]
    assert reservoir(df, "id", "no", ReservoirSpec(size=2)).count() == 2
    assert reservoir(df.limit(0), "id", "no").count() == 0
    r = Reservoir(spark, str(tmp_path), ReservoirSpec(size=10))
    assert r.rows() is None
    for part in (df.filter("no = 0"), df.limit(0), df.filter("no = 2"), df.filter("no = 3")):
        r.add(part, "id")
    assert sorted(x["key"] for x in r.rows().collect()) == [1, 2, 3, 4]


def test_every_record_equally_likely(spark):
    seen = Counter()
    df, _ = pieced(spark, [4, 2, 6])
    df = df.cache()
    for seed in range(30):
        seen.update(r["id"] for r in reservoir(df, "id", "no", ReservoirSpec(size=3, least_slots=2, seed=seed)).collect())
    assert sum(seen.values()) == 90
    first, last = sum(seen[i] for i in range(6)), sum(seen[i] for i in range(6, 12))
    assert abs(first - last) < 40


def test_registered_sample(spark):
    sf = "/root/testdata/sf0.01"
    ids = [r["sample_id"] for r in queries.p6_sample(spark, sf).collect()]
    known = {r["sample_id"] for r in spark.read.parquet(f"{sf}/climblab_sample.parquet").select("sample_id").collect()}
    assert len(ids) == len(set(ids)) == queries.RESERVOIR.size and set(ids) <= known


def test_best_fit_keeps_capacity():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 3000)
    bins, fills = best_fit(sizes, 100)
    assert (np.bincount(bins, sizes) == fills).all() and fills.max() <= 100
    assert fills[:-1].mean() > 98


def test_packing(spark):
    rng = np.random.default_rng(7)
    sizes = [int(x) for x in rng.lognormal(4.5, 1.2, 3000)] + [0, 2048, 4096, 5000, 100_000]
    rows = [(i, s) for i, s in enumerate(sizes)] + [(9000, None), (9001, -5), (5, 77), (5, 77), (None, 10)]
    df = spark.createDataFrame(rows, "id long, size long").selectExpr("*", "1 as _uid", "'x' as bin", "2 as part", "3 as fill")
    out = pack(df, "id", "size", PackSpec(capacity=2048, items_a_task=500)).collect()
    total, members = defaultdict(int), defaultdict(list)
    for r in out:
        members[r["id"]].append(r)
        if r["container"] is None:
            assert r["size"] == 0
        else:
            total[r["container"]] += r["size"]
    for r in out:
        assert r["container"] is None or total[r["container"]] == r["fill"] <= 2048
    for i, s in enumerate(sizes):
        own = members[i]
        if i == 5:
            assert sum(r["size"] for r in own) == s + 154
        else:
            assert sum(r["size"] for r in own) == s
            assert len(own) == max(1, -(-s // 2048)), "split only where larger than a container"
            assert sorted(r["part"] for r in own) == list(range(len(own)))
    assert sum(total.values()) / (2048 * len(total)) > 0.97
    assert pack(df.limit(0), "id", "size").count() == 0


def test_items_that_never_fit_together(spark):
    df = spark.range(3000).select("id", (F.col("id") % 500 + 1025).alias("size"))
    out = pack(df, "id", "size", PackSpec(capacity=2048, items_a_task=100))
    assert out.select("container").distinct().count() == out.count() == 3000


def test_few_small_items_of_all_partitions_meet(spark):
    # Hardly any of the open containers can be merged, and those lie in different partitions.
    df = spark.range(2000).select("id", F.when(F.col("id") < 16, 100).otherwise(1990).alias("size"))
    out = pack(df, "id", "size", PackSpec(capacity=2048, fan_in=2)).select("container", "fill").distinct()
    assert sorted(r["fill"] for r in out.collect()) == [1600] + [1990] * 1984
