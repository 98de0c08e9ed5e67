"""A uniform sample of fixed size from data that arrive in pieces, its total unknown.

A distributed reservoir: of each arriving piece only records never seen before count; one
hypergeometric draw says how many of the sample the piece's records take over; the draw is
split over hash-partitioned slots (multivariate hypergeometric); each slot evicts
and inserts that many, chosen uniformly. After every piece the sample is a uniform
sample, without replacement, of all distinct records so far.

The draws need only the numbers of new records of each piece and slot, so ``reservoir`` makes
them for all stored pieces in turn, each from what had arrived till then, and applies them slot by slot: the table is read
and shuffled once whatever the number of pieces. ``Reservoir`` takes pieces one at a time, for a stream, with the records
seen kept as a folder for each slot bucket.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textweir.session import cut


@dataclass(frozen=True)
class ReservoirSpec:
    size: int = 2000
    #: Records of the sample that a slot holds, about; so the slots follow from the size.
    slot_rows: int = 50_000
    least_slots: int = 32
    seed: int = 17

    @property
    def slots(self) -> int:
        return max(self.least_slots, -(-self.size // self.slot_rows))


def _stirling_rest(n: float) -> float:
    """ln n! less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n**2) / n**2) / n**2) / n


def _deviance(x: float, mean: float) -> float:
    """x ln(x / mean) + mean - x without cancellation."""
    if x == 0:
        return mean
    e = (mean - x) / x
    if abs(e) > 0.1:
        return x * math.log(x / mean) + mean - x
    # -ln(1 + e) + e as a series
    total, power, k = 0.0, e * e, 2
    while abs(power) > 1e-18:
        total += power / k if k % 2 == 0 else -power / k
        power *= e
        k += 1
    return x * total


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """ln of the binomial probability, by its saddle point; exact to the last places for any n."""
    if x == 0:
        return n * (math.log1p(-p) if p < 0.5 else math.log(q)) if n else 0.0
    if x == n:
        return n * (math.log1p(-q) if q < 0.5 else math.log(p))
    rest = _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return rest + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def log_probability(k: int, good: int, bad: int, draws: int) -> float:
    """ln of the chance that ``k`` of ``draws`` without replacement are good ones."""
    if not draws:
        return 0.0
    p, q = draws / (good + bad), (good + bad - draws) / (good + bad)
    if q == 0:
        return 0.0
    return _log_binomial(k, good, p, q) + _log_binomial(draws - k, bad, p, q) - _log_binomial(draws, good + bad, p, q)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many good ones are among ``draws`` without replacement; inversion from the mode, for counts of any size."""
    low, high = max(0, draws - bad), min(draws, good)
    if low >= high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    at_mode = math.exp(log_probability(mode, good, bad, draws))
    u = rng.random() - at_mode
    if u < 0:
        return mode
    up, down, p_up, p_down = mode, mode, at_mode, at_mode
    while up < high or down > low:
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u < 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u < 0:
                return down
    return mode  # what rounding leaves over


def split_draw(rng: np.random.Generator, counts: list[int], draws: int) -> list[int]:
    """How many of ``draws`` without replacement fall on each slot."""
    out, left = [], sum(counts)
    for c in counts:
        left -= c
        out.append(hypergeometric(rng, c, left, draws))
        draws -= out[-1]
    return out


@dataclass
class Draws:
    """The running state of the draws: how many records have arrived, and how many of each slot are held."""

    spec: ReservoirSpec
    rng: np.random.Generator = field(init=False)
    held: list[int] = field(init=False)
    total: int = 0

    def __post_init__(self) -> None:
        self.rng, self.held = np.random.default_rng(self.spec.seed), [0] * self.spec.slots

    def take(self, counts: list[int]) -> tuple[list[int], list[int]]:
        """(evicted, inserted) of each slot for a piece with so many new records of each slot."""
        arrived = sum(counts)
        size = min(self.spec.size, self.total + arrived)
        taken = hypergeometric(self.rng, arrived, self.total, size)
        inserted = split_draw(self.rng, counts, taken)
        evicted = split_draw(self.rng, self.held, sum(self.held) - (size - taken))
        self.total += arrived
        self.held = [h - e + i for h, e, i in zip(self.held, evicted, inserted)]
        return evicted, inserted


def _slot(key: Column, spec: ReservoirSpec) -> Column:
    return F.pmod(F.xxhash64(F.lit(spec.seed), key), F.lit(spec.slots)).cast("int")


def _order(spec: ReservoirSpec, purpose: object) -> Column:
    return F.xxhash64(F.lit(f"{spec.seed}/{purpose}"), F.col("key"))


def _replayed(evictions: dict[int, list[tuple[int, int]]], seed: int):
    """Rows (key, slot, turn) of one slot -> the keys that it holds after all turns."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        slot = int(rows["slot"].iloc[0])
        rng = np.random.default_rng([seed, slot])
        rows = rows.sort_values(["turn", "order", "key"], kind="stable")
        new = dict(list(rows.groupby("turn")["key"]))
        held = np.zeros(0, dtype=rows["key"].dtype)
        for turn, evicted in evictions.get(slot, []):
            if evicted:
                held = np.delete(held, rng.choice(len(held), evicted, replace=False))
            if turn in new:
                held = np.concatenate([held, new[turn].to_numpy()])
        return pd.DataFrame({"key": held})

    return run


def reservoir(df: DataFrame, id_col: str, piece_col: str, spec: ReservoirSpec = ReservoirSpec()) -> DataFrame:
    """(id) of a uniform sample of ``spec.size`` distinct ids, or of all where there are fewer.

    Pieces count in the order of ``piece_col``, rows without a piece last; a record sent again,
    in the same or a later piece, stays one record, of its first piece. Null ids are no records. An empty table gives an empty
    sample. The result is fixed by the seed and the pieces, not by partitions. The ids are integers.
    """
    piece = F.struct(F.col(piece_col).isNull().alias("late"), F.col(piece_col).alias("no"))
    rows = df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("key")).agg(F.min(piece).alias("piece"))
    first = cut(rows.select("key", "piece", _slot(F.col("key"), spec).alias("slot")))
    # A row for each piece and slot: the draws go through them in turn.
    counted = first.groupBy("piece", "slot").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()
    by_piece: dict[tuple, list[int]] = {}
    for r in counted:
        by_piece.setdefault((r["piece"]["late"], r["piece"]["no"]), [0] * spec.slots)[r["slot"]] = r["n"]
    draws, quotas, evictions = Draws(spec), [], {}
    for turn, key in enumerate(sorted(by_piece, key=lambda k: (k[0], k[1] if k[1] is not None else 0))):
        evicted, inserted = draws.take(by_piece[key])
        quotas += [(key[0], key[1], s, turn, i) for s, i in enumerate(inserted) if i]
        for s, e in enumerate(evicted):
            if e or inserted[s]:
                evictions.setdefault(s, []).append((turn, e))
    if not quotas:
        return first.limit(0).select(F.col("key").alias(id_col))
    kind = dict(df.dtypes)[piece_col]
    wanted = df.sparkSession.createDataFrame(quotas, f"late boolean, no {kind}, slot int, turn int, quota int")
    # As many quotas as there are pieces and slots with an insertion; these grow thin with the logarithm of the data.
    fresh = first.select("key", "slot", "piece.late", "piece.no").withColumn("order", _order(spec, "insert"))
    met = fresh.alias("f").join(
        F.broadcast(wanted).alias("w"),
        (F.col("f.slot") == F.col("w.slot")) & (F.col("f.late") == F.col("w.late")) & F.col("f.no").eqNullSafe(F.col("w.no")),
    ).select("f.key", "f.slot", "w.turn", "w.quota", "f.order")
    rank = F.row_number().over(Window.partitionBy("slot", "turn").orderBy("order", "key"))
    chosen = met.withColumn("rank", rank).filter(F.col("rank") <= F.col("quota")).select("key", "slot", "turn", "order")
    # A slot gets its share of size (1 + ln(records / size)) rows.
    kept = chosen.groupBy("slot").applyInPandas(_replayed(evictions, spec.seed), "key long")
    return kept.select(F.col("key").alias(id_col))


class Reservoir:
    """The sample of pieces that come one at a time; for a stream, call ``add`` for each batch.

    ``path`` is a folder that all executors share. Records seen are kept there by bucket of their hash, a folder a piece; a piece reads
    only the buckets that it touches, and of these only ids. ``merge_every`` pieces are merged into one folder, so that
    files stay few.
    """

    def __init__(self, spark: SparkSession, path: str, spec: ReservoirSpec = ReservoirSpec(), merge_every: int = 8) -> None:
        self.spark, self.path, self.spec, self.merge_every = spark, path, spec, merge_every
        self.draws, self.turn, self.folders, self.sample = Draws(spec), 0, [], None

    def add(self, piece: DataFrame, id_col: str) -> None:
        """Take in a piece; null ids are no records, ids seen before count no more, an empty piece changes nothing."""
        spec, turn = self.spec, self.turn
        self.turn += 1
        fresh = piece.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("key")).distinct().withColumn("slot", _slot(F.col("key"), spec))
        if self.folders:
            fresh = fresh.join(self.spark.read.schema("key long, slot int").parquet(*self.folders), ["slot", "key"], "left_anti")
        folder = f"{self.path}/seen-{turn}"
        fresh.repartition("slot").write.mode("overwrite").parquet(folder)
        fresh = self.spark.read.schema("key long, slot int").parquet(folder)
        by_slot = {r["slot"]: r["n"] for r in fresh.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not by_slot:
            return
        evicted, inserted = self.draws.take([by_slot.get(s, 0) for s in range(spec.slots)])
        self.folders.append(folder)

        def ranked(df: DataFrame, purpose: str, quota: list[int]) -> tuple[DataFrame, Column]:
            limits = F.element_at(F.array(*[F.lit(int(q)) for q in quota]), F.col("slot") + 1)
            return df.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(_order(spec, f"{turn}/{purpose}"), "key"))), limits

        new, most = ranked(fresh, "insert", inserted)
        out = new.filter(F.col("rank") <= most).select("key", "slot")
        if self.sample is not None:
            old, gone = ranked(self.sample, "evict", evicted)
            out = old.filter(F.col("rank") > gone).select("key", "slot").union(out)
        self.sample = cut(out)
        if len(self.folders) >= self.merge_every:
            merged = f"{self.path}/merged-{turn}"
            self.spark.read.schema("key long, slot int").parquet(*self.folders).repartition("slot").write.mode("overwrite").parquet(merged)
            self.folders = [merged]

    def rows(self) -> DataFrame | None:
        """(key) of the sample so far; None before the first record."""
        return None if self.sample is None else self.sample.select("key")
