"""Near-duplicate records with small edits: MinHash banding with exact verification.

Plan, for a collection far too large for pairwise comparison:

1. One Arrow pass cuts the words. Records with the same words form one *class*; the
   pass gives ``(record, class)`` and, from ``bands * rows`` MinHash values,
   ``(band key, class)``. A task gives each class's keys once, so a third of all
   rows being one page costs one row a task.
2. One shuffle by key. On its reduce side a class that several tasks met in a bucket
   is reduced to one row, and band keys held by a single class (nearly all) are
   dropped; what remains is checkpointed with the memberships, and the shuffle's files go.
3. Each class is represented by its smallest record.
   One bit of each of 128 MinHash values makes a sketch; pairs whose sketches differ
   too much for the threshold, by nearly four standard deviations, aren't verified.
4. Keys give candidate pairs by an equi-join that compares the sketches at once, so
   only likely pairs are ever written. Buckets of more than ``bucket_limit`` classes
   are dealt out in blocks, so that no task has one alone. Classes in buckets of more
   than ``crowd_limit`` go through an exact prefix-filtered set join instead.
5. Candidates are verified on their full sets of word n-grams.

Results: ``near_copy_classes`` (one row per record: class, links), ``near_copy_pairs``
(pairs of class representatives) and ``expand_pairs`` (pairs of records).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textweir.session import cut

_WORD = re.compile(r"[^\W_]+")
SKETCH_BITS = 64
#: ``record`` is (guard, id, sketch, sketch) in member rows and null in band rows, which keeps the many band rows small.
PASS_ONE = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("record", pa.list_(pa.int64()))])


@dataclass(frozen=True)
class NearCopySpec:
    """What counts as a near copy and how candidates are sought."""

    threshold: float = 0.8
    words_per_shingle: int = 5
    min_words: int = 5
    #: Share of the pairs at ``safe_similarity`` that must share a band.
    target_recall: float = 0.99
    #: Similarity at which the recall is set; the threshold itself if not given.
    safe_similarity: float | None = None
    max_bands: int = 48
    seed: int = 20011
    #: Classes in one bucket beyond which its pairs are made block by block, of 16 times as many classes.
    bucket_limit: int = 64
    #: Classes in one bucket beyond which the exact prefix join takes over; its shingles take some twenty times the room of the texts.
    crowd_limit: int = 131_072

    def most_differing_bits(self) -> int:
        """Differing bits of two sketches that a pair at the sought similarity exceeds about once in ten thousand times."""
        differ = (1 - (self.safe_similarity or self.threshold)) / 2
        bits = 2 * SKETCH_BITS
        return math.ceil(bits * differ + 3.8 * math.sqrt(bits * differ * (1 - differ)))

    def bands_and_rows(self) -> tuple[int, int]:
        """The most selective banding (most rows a band) that still reaches the recall; an error where ``max_bands`` are too few for it."""
        s = self.safe_similarity or self.threshold
        best = None
        for rows in range(1, 40):
            hit = s**rows
            bands = 1 if hit >= self.target_recall else math.ceil(math.log(1 - self.target_recall) / math.log(1 - hit))
            if bands > self.max_bands:
                break
            best = (bands, rows)
        if best is None:
            raise ValueError(f"{self.max_bands} bands can't reach a recall of {self.target_recall} at a similarity of {s}")
        return best


def words(text: str) -> list[str]:
    """Lower-cased maximal runs of letters and digits."""
    return _WORD.findall(text.lower())


def shingle_hashes(word_hashes: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word runs of ``width``, document after document, and each document's first index."""
    mixed = np.zeros(len(word_hashes) - width + 1, dtype=np.uint64)
    for j in range(width):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += word_hashes[j : len(word_hashes) - width + 1 + j]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    ends = np.cumsum(sizes)
    keep = np.ones(len(word_hashes), dtype=bool)
    for j in range(1, width):
        keep[ends - j] = False
    starts = np.concatenate([[0], np.cumsum(sizes - width + 1)[:-1]])
    return mixed[keep[: len(mixed)]], starts


class _WordHashes:
    """64-bit hashes of words, remembered while a bounded table has room."""

    def __init__(self, room: int = 500_000) -> None:
        self.known: dict[str, int] = {}
        self.room = room

    def __call__(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.room:
            known.clear()
        for w in set(tokens).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def _pass_one(spec: NearCopySpec):
    """(id, text) -> a member row (spread key, class, guard, id, sketch) for each record, band rows (key, class) for each class."""
    bands, rows = spec.bands_and_rows()
    width, seed, least = spec.words_per_shingle, spec.seed, max(spec.min_words, spec.words_per_shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        n_hashes = max(bands * rows, 2 * SKETCH_BITS)
        multipliers = rng.integers(0, 2**31, n_hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        shifts = rng.integers(0, 2**32, n_hashes, dtype=np.uint32)
        hashes, seen = _WordHashes(), {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                if len(seen) > 1_000_000:
                    seen.clear()
                ids, classes, owns, parts, sizes, kept = [], [], [], [], [], []
                for record, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if text is None or record is None:
                        continue
                    tokens = words(text)
                    if len(tokens) < least:
                        continue
                    own = xxhash.xxh3_128_intdigest(" ".join(tokens), seed) >> 1
                    # The class is 63 bits; the rest of the digest only guards the memberships.
                    low = own & 0x7FFFFFFFFFFFFFFF
                    ids.append(record)
                    classes.append((low, own >> 64))
                    owns.append(own)
                    if own not in seen:
                        seen[own] = (0, 0)
                        parts.append(hashes(tokens))
                        sizes.append(len(tokens))
                        kept.append(own)
                if not ids:
                    continue
                if kept:
                    shingles, starts = shingle_hashes(np.concatenate(parts), np.array(sizes), width)
                    short = (shingles >> np.uint64(32)).astype(np.uint32)
                    keys = np.empty((bands, len(kept)), dtype=np.uint64)
                    sketch = np.zeros((2, len(kept)), dtype=np.uint64)
                    for j in range(n_hashes):
                        low = np.minimum.reduceat(short * multipliers[j] + shifts[j], starts)
                        if j < 2 * SKETCH_BITS:
                            # any bit of a mix of the value is as good as another
                            sketch[j // SKETCH_BITS] |= (low * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(np.uint64) << np.uint64(j % SKETCH_BITS)
                        b, first = divmod(j, rows)
                        if b < bands:
                            key = (np.full(len(kept), b + 1, dtype=np.uint64) if not first else keys[b]) ^ low
                            key *= np.uint64(0x9E3779B97F4A7C15)
                            keys[b] = key ^ key >> np.uint64(31)
                    for own, x, y in zip(kept, *sketch.view(np.int64).tolist()):
                        seen[own] = (x, y)
                member = np.array([(*c, *seen[own]) for c, own in zip(classes, owns)], dtype=np.int64)
                spread = np.array([xxhash.xxh64_intdigest(f"{i}") >> 1 for i in ids], dtype=np.int64)
                record = np.column_stack([member[:, 1], np.array(ids, dtype=np.int64), member[:, 2:]])
                record = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(ids) + 1, 4, dtype=np.int32)), pa.array(record.ravel()))
                yield pa.record_batch([pa.array(spread), pa.array(member[:, 0]), record], schema=PASS_ONE)
                if kept:
                    none = pa.nulls(bands * len(kept), pa.list_(pa.int64()))
                    lows = np.array([own & 0x7FFFFFFFFFFFFFFF for own in kept], dtype=np.int64)
                    yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(lows, bands)), none], schema=PASS_ONE)

    return run


def _sets_of(texts: list[str], hashes: _WordHashes, width: int) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    tokens = [words(t) for t in texts]
    sizes = np.array([len(t) for t in tokens])
    shingles, starts = shingle_hashes(hashes([w for t in tokens for w in t]), sizes, width)
    return [np.unique(x) for x in np.split(shingles, starts[1:])]


def _similar(spec: NearCopySpec):
    """(ra, rb, text a, text b) -> (ra, rb, similarity) of those at or above the threshold, on their full sets."""
    schema = pa.schema([("ra", pa.int64()), ("rb", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                left, right = part.column(2).to_pylist(), part.column(3).to_pylist()
                where = {t: i for i, t in enumerate(dict.fromkeys(left + right))}
                sets = _sets_of(list(where), hashes, spec.words_per_shingle)
                value = np.zeros(len(left))
                for i, (x, y) in enumerate(zip(left, right)):
                    x, y = sets[where[x]], sets[where[y]]
                    if min(len(x), len(y)) >= spec.threshold * max(len(x), len(y)) - 1e-9:
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        value[i] = both / (len(x) + len(y) - both)
                keep = np.flatnonzero(value >= spec.threshold - 1e-12)
                yield pa.record_batch([part.column(0).take(keep), part.column(1).take(keep), pa.array(value[keep])], schema=schema)

    return run


def _shingle_rows(spec: NearCopySpec):
    """(rep, text) -> (rep, size of its set, shingle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                sets = _sets_of(part.column(1).to_pylist(), hashes, spec.words_per_shingle)
                sizes = np.array([len(x) for x in sets])
                yield pa.record_batch(
                    [pa.array(np.repeat(part.column(0).to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets).view(np.int64))],
                    names=["rep", "n", "s"],
                )

    return run


def _prefix_pairs(docs: DataFrame, spec: NearCopySpec) -> DataFrame:
    """All candidate pairs among ``docs`` (rep, text) by the prefix principle; exact, no banding.

    Two sets with Jaccard similarity t share one of the ``n - ceil(t n) + 1`` rarest
    members of either. Boilerplate is the commonest part of a set and so outside its prefix, unless it makes up more than about ``t`` of it.
    """
    t = spec.threshold
    members = docs.mapInArrow(_shingle_rows(spec), "rep long, n long, s long")
    rarity = members.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = members.join(rarity, "s", "left").withColumn(
        "rank", F.row_number().over(Window.partitionBy("rep").orderBy(F.coalesce("df", F.lit(1)), "s"))
    )
    prefix = ranked.filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1).filter("df > 1").select("rep", "n", "s")
    a, b = prefix.alias("a"), prefix.alias("b")
    return (
        a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.rep") < F.col("b.rep")))
        .filter((F.col("a.n") >= t * F.col("b.n") - 1e-9) & (F.col("b.n") >= t * F.col("a.n") - 1e-9))
        .select(F.col("a.rep").alias("ra"), F.col("b.rep").alias("rb"))
        .distinct()
    )


@dataclass(frozen=True)
class NearCopies:
    """``members``: (id, rep) of every record with enough words; ``pairs``: (ra, rb, similarity) of representatives."""

    members: DataFrame
    pairs: DataFrame


def near_copies(df: DataFrame, id_col: str, text_col: str, spec: NearCopySpec = NearCopySpec()) -> NearCopies:
    """Classes of equal records and the pairs of classes whose similarity is at least the threshold.

    Null, empty and short texts (under ``min_words`` words) belong to no class and no
    pair. Rows with the same words fall into one class, whose representative is its
    smallest id; a repeated id stands for one record, a row with a null id for none. An empty table gives empty results. Other
    columns are ignored, whatever their names.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    held = docs.mapInArrow(_pass_one(spec), "key long, fp long, record array<long>").repartition("key")
    # A class may be in a bucket once for each task that met it: equal rows are neighbours in this order, and all but one are dropped.
    bucket, band = [F.col("key"), F.col("record").isNull()], F.col("record").isNull()
    before = F.lag("fp").over(Window.partitionBy(*bucket).orderBy("fp"))
    once = held.withColumn("before", before).filter(~band | F.col("before").isNull() | (F.col("before") != F.col("fp")))
    n = F.count(F.lit(1)).over(Window.partitionBy(*bucket))
    kept = cut(once.withColumn("n", n).filter(~band | (F.col("n") > 1)).select("key", "fp", "record", "n"))

    one = [F.col("record")[i].alias(c) for i, c in enumerate(("fp2", "id", "sketch_a", "sketch_b"))]
    members = kept.filter("record is not null").select("fp", *one)
    reps = cut(members.groupBy("fp", "fp2").agg(F.min("id").alias("rep"), F.min("sketch_a").alias("sketch_a"), F.min("sketch_b").alias("sketch_b")))
    members = cut(members.select("id", "fp", "fp2").join(reps.select("fp", "fp2", "rep"), ["fp", "fp2"]).select("id", "rep"))
    shared = kept.filter("record is null").select("key", "fp", "n").join(reps.select("fp", "rep", "sketch_a", "sketch_b"), "fp")
    blocks = F.when(F.col("n") > spec.bucket_limit, F.ceil(F.col("n") / (16 * spec.bucket_limit))).otherwise(1).cast("int")
    dealt = shared.filter(F.col("n") <= spec.crowd_limit).withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    a = dealt.select("key", own, F.col("rep").alias("ra"), F.col("sketch_a").alias("aa"), F.col("sketch_b").alias("ba"))
    b = dealt.select("key", each, F.col("rep").alias("rb"), F.col("sketch_a").alias("ab"), F.col("sketch_b").alias("bb"))
    differing = F.bit_count(F.expr("aa ^ ab")) + F.bit_count(F.expr("ba ^ bb"))
    candidates = a.join(b, ["key", "block"]).filter((F.col("ra") < F.col("rb")) & (differing <= spec.most_differing_bits())).select("ra", "rb").distinct()
    if not kept.filter(F.col("record").isNull() & (F.col("n") > spec.crowd_limit)).isEmpty():
        wide = shared.filter(F.col("n") > spec.crowd_limit)
        candidates = candidates.union(cut(_prefix_pairs(_texts(docs, wide.select("rep").distinct()), spec))).distinct()
    return NearCopies(members, _verified(docs, cut(candidates), spec))


def _texts(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, text) of the given representatives, one row each."""
    return docs.filter("text is not null").withColumnRenamed("id", "rep").join(reps.hint("merge"), "rep", "left_semi").groupBy("rep").agg(F.max("text").alias("text"))


def _verified(docs: DataFrame, candidates: DataFrame, spec: NearCopySpec) -> DataFrame:
    needed = candidates.select(F.explode(F.array("ra", "rb")).alias("rep")).distinct()
    texts = _texts(docs, needed)
    return (
        candidates.join(texts.select(F.col("rep").alias("ra"), F.col("text").alias("ta")), "ra")
        .join(texts.select(F.col("rep").alias("rb"), F.col("text").alias("tb")), "rb")
        .select("ra", "rb", "ta", "tb")
        .mapInArrow(_similar(spec), "ra long, rb long, similarity double")
    )


def expand_pairs(found: NearCopies, blocks: int = 32) -> DataFrame:
    """(id_a, id_b), smaller first: linked records, copies within a class included.

    Its rows grow with the square of a class; ``near_copy_classes`` says the same in a row a record and is the form for
    large collections. A large class's pairs are made in ``blocks`` tasks: its first members are dealt out by a hash, the second ones go to each.
    """
    m = found.members
    crowded = m.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rep", F.when(F.col("n") > 1000, blocks).otherwise(1).alias("b"))
    dealt = m.join(crowded, "rep")
    across = (
        found.pairs.join(m.select(F.col("rep").alias("ra"), F.col("id").alias("ia")), "ra")
        .join(m.select(F.col("rep").alias("rb"), F.col("id").alias("ib")), "rb")
        .select("ia", "ib")
    )
    x = dealt.select("rep", F.col("id").alias("ia"), F.pmod(F.xxhash64("id"), F.col("b")).cast("int").alias("block"))
    y = dealt.select("rep", F.col("id").alias("ib"), F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("block"))
    within = x.join(y, ["rep", "block"]).filter("ia < ib").select("ia", "ib")
    return across.union(within).select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))


def near_copy_classes(found: NearCopies) -> DataFrame:
    """One row per record: id, class_id (smallest id with the same words), class_size, linked_classes, linked_records.

    ``linked_records`` counts the other records at or above the threshold, copies included.
    """
    sizes = found.members.groupBy("rep").agg(F.count(F.lit(1)).alias("class_size"))
    p = found.pairs
    ends = p.select(F.col("ra").alias("rep"), F.col("rb").alias("other")).union(p.select(F.col("rb").alias("rep"), F.col("ra").alias("other")))
    links = (
        ends.join(sizes.select(F.col("rep").alias("other"), "class_size"), "other")
        .groupBy("rep")
        .agg(F.count(F.lit(1)).alias("linked_classes"), F.sum("class_size").alias("others"))
    )
    return (
        found.members.join(sizes, "rep")
        .join(links, "rep", "left")
        .select(
            "id",
            F.col("rep").alias("class_id"),
            "class_size",
            F.coalesce("linked_classes", F.lit(0)).cast("long").alias("linked_classes"),
            (F.coalesce("others", F.lit(0)) + F.col("class_size") - 1).cast("long").alias("linked_records"),
        )
    )
