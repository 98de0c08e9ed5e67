"""Encoding of a whole corpus with a public tokenizer, by a table of distinct words.

1. Each text is cut into the tokenizer's words (its own pre-tokenizer, so that word
   edges are exactly its own); words repeat, so only each text's distinct ones are counted.
2. Every distinct word of the corpus is encoded once; the table is checkpointed.
3. Words that make up a large share of all rows are few by arithmetic (at most
   ``1 / hot_share`` of them); they are filled in by the pass over the texts. All
   others are joined by word, with the text's positions of the word, which spreads evenly.
4. Each text's ids are put back by position.

``decode`` goes the other way through an id-to-piece join.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweir.llm.tokenizers import load, tokenizer_path
from textweir.session import cut, spread

#: One row for each text: ``sizes`` has two bytes for each word, the number of its ids where it is filled in and ``_JOINED`` where it
#: is joined; ``filled`` has those ids as 32-bit integers. One row for each other word of a text: the word and its places.
_SPLIT = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("sizes", pa.binary()), ("filled", pa.binary()), ("word", pa.string()), ("pos", pa.list_(pa.int32()))])
_SPLIT_DDL = "k1 long, k2 long, sizes binary, filled binary, word string, pos array<int>"
_JOINED = 65535


@dataclass(frozen=True)
class EncodeSpec:
    tokenizer: str = "byte_bpe_50k.json"
    folder: str | None = None
    #: A word in more than this share of all (text, word) rows is filled in without a join; so at most 1 / hot_share words.
    hot_share: float = 0.0001

    @property
    def path(self) -> str:
        return tokenizer_path(self.tokenizer, self.folder)


# The pattern of byte-level pre-tokenizers.
_BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Scripts whose letters no version of Unicode has changed, by first and last character; they need no comparison.
_SETTLED = ((0x3400, 0x4DBF), (0x4E00, 0x9FD0), (0xAC00, 0xD7A3), (0xD800, 0xF8FF))


def _own_words(path: str, text: str) -> list[str]:
    """The words by the tokenizer's own pre-tokenizer: parts of the text for byte-level ones, else in its alphabet."""
    found = load(path).pre_tokenizer.pre_tokenize_str(text)
    return [text[a:b] for _, (a, b) in found] if _byte_level(path) else [w for w, _ in found]


@lru_cache(4)
def _byte_level(path: str) -> bool:
    """Whether words are cut by ``_BYTE_LEVEL`` from the unchanged text."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    own = made.get("pre_tokenizer") or {}
    return made.get("normalizer") is None and own.get("type") == "ByteLevel" and own.get("use_regex", True) and not own.get("add_prefix_space", True)


@lru_cache(4)
def doubtful_characters(path: str) -> str:
    """Characters up to U+1FFFF that the tokenizer's Unicode version classes otherwise than ours, found by comparing both. Made once, on the driver."""

    def same(chars: list[str]) -> bool:
        # Beside a letter, a digit, a sign and a space, so that any difference of class moves an edge.
        probe = "".join(f"x{c}1{c}!{c} {c}\n" for c in chars)
        return _own_words(path, probe) == _BYTE_LEVEL.findall(probe)

    if not _byte_level(path):
        return ""
    points = [c for c in range(0x20000) if not any(a <= c <= b for a, b in _SETTLED)]
    return "".join(chr(c) for i in range(0, len(points), 64) if not same(block := [chr(p) for p in points[i : i + 64]]) for c in points[i : i + 64] if not same([chr(c)]))


@lru_cache(4)
def _as_set(odd: str) -> frozenset[str]:
    return frozenset(odd)


def in_doubt(text: str, odd: str) -> bool:
    """Whether a text has one of the characters ``odd``, or one beyond U+1FFFF."""
    return not text.isascii() and (not _as_set(odd).isdisjoint(text) or max(text) > "\U0001ffff")


def split_words(path: str, text: str, odd: str | None = None) -> list[str]:
    """The tokenizer's words of a text: parts of it for byte-level tokenizers, else in the tokenizer's own alphabet.

    ``odd`` are the tokenizer's ``doubtful_characters``; a text with one of them, or one beyond U+1FFFF, is cut by the tokenizer itself.
    """
    if not text:
        return []
    if _byte_level(path):
        known = doubtful_characters(path) if odd is None else odd
        return _own_words(path, text) if in_doubt(text, known) else _BYTE_LEVEL.findall(text)
    tok = load(path)
    return _own_words(path, tok.normalizer.normalize_str(text) if tok.normalizer is not None else text)


def encode_word(path: str, word: str) -> list[int]:
    if _byte_level(path):
        word = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(_SHOWN)
    return [t.id for t in load(path).model.tokenize(word)]


def _distinct_words(path: str):
    odd = doubtful_characters(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, texts = {}, 0
            for text in batch.column(0).to_pylist():
                for w in set(split_words(path, text, odd) if text else ()):
                    words[w] = words.get(w, 0) + 1
                texts += 1
                if texts % 256 == 0 and words:
                    yield pa.record_batch([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "texts"])
                    words = {}
            if words:
                yield pa.record_batch([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "texts"])

    return run


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode_word(path, w) for w in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["word", "texts", "ids"])

    return run


def _split(path: str, hot: dict[str, list[int]]):
    odd = doubtful_characters(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                k1, k2, sizes, filled, word, pos = [], [], [], [], [], []
                for a, b, text in zip(*(part.column(c).to_pylist() for c in range(3))):
                    words = split_words(path, text, odd) if text else []
                    places: dict[str, list[int]] = {}
                    counts, ids = np.full(len(words), _JOINED, dtype=np.uint16), []
                    for i, w in enumerate(words):
                        known = hot.get(w)
                        if known is None:
                            places.setdefault(w, []).append(i)
                        else:
                            counts[i] = len(known)
                            ids += known
                    # One row for every text, so that none is lost, whatever its words.
                    k1 += [a] * (len(places) + 1)
                    k2 += [b] * (len(places) + 1)
                    sizes.append(counts.tobytes())
                    sizes += [None] * len(places)
                    filled.append(np.array(ids, dtype=np.int32).tobytes())
                    filled += [None] * len(places)
                    word.append(None)
                    word += places
                    pos.append(None)
                    pos += places.values()
                columns = [pa.array(x, f.type) for x, f in zip((k1, k2, sizes, filled, word, pos), _SPLIT)]
                yield pa.record_batch(columns, schema=_SPLIT)

    return run


def _ragged(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. up to each length, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def place(sizes: list[bytes], filled: list[bytes], words_of: np.ndarray, pos: np.ndarray, pos_of: np.ndarray, ids: np.ndarray, ids_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of texts in order, and how many each text has.

    ``words_of`` counts each text's joined words; ``pos_of`` and ``ids_of`` count each such word's places and ids in
    ``pos`` and ``ids``.
    """
    n = np.frombuffer(b"".join(sizes), dtype=np.uint16).astype(np.int64)
    words_in = np.array([len(x) // 2 for x in sizes], dtype=np.int64)
    base = np.cumsum(words_in) - words_in
    known = n < _JOINED
    word = np.repeat(np.arange(len(pos_of)), pos_of)  # the joined word at each place
    at = np.repeat(np.repeat(base, words_of), pos_of) + pos
    n[at] = ids_of[word]
    start = np.cumsum(n) - n
    out = np.empty(int(n.sum()), dtype=np.int32)
    out[np.repeat(known, n)] = np.frombuffer(b"".join(filled), dtype=np.int32)
    first = np.cumsum(ids_of) - ids_of
    each = ids_of[word]
    step = _ragged(each)
    out[np.repeat(start[at], each) + step] = ids[np.repeat(first[word], each) + step]
    ends = np.concatenate([[0], np.cumsum(n)])
    return out, ends[base + words_in] - ends[base]


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, sizes, filled, joined words) -> (k1, k2, ids)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            part = whole.slice(at, 256)
            joined = part.column(4)
            words = joined.flatten()
            counts = [np.nan_to_num(x.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64) for x in (joined, words.field("pos"), words.field("ids"))]
            flat = [words.field(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "ids")]
            ids, each = place(part.column(2).to_pylist(), part.column(3).to_pylist(), counts[0], flat[0], counts[1], flat[1], counts[2])
            offsets = np.concatenate([[0], np.cumsum(each)]).astype(np.int32)
            yield pa.record_batch([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["k1", "k2", "ids"])


def word_table(df: DataFrame, text_col: str, spec: EncodeSpec = EncodeSpec()) -> DataFrame:
    """(word, texts, ids): each distinct word of the corpus, how many texts have it, and its ids."""
    counted = df.select(text_col).mapInArrow(_distinct_words(spec.path), "word string, texts long")
    return counted.groupBy("word").agg(F.sum("texts").alias("texts")).mapInArrow(_encode_words(spec.path), "word string, texts long, ids array<int>")


def _keys(*columns: str) -> list[Column]:
    """(k1, k2): 128 bits of a row's content. Keys by content stay the same when a lost task runs again on rows in another order."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(seed), *parts).alias(f"k{seed}") for seed in (1, 2)]


def _common(table: DataFrame, spec: EncodeSpec) -> dict[str, list[int]]:
    """The words of a word table that are in a large share of all rows, with their ids; bounded: fewer than 1 / hot_share can have that share."""
    total = table.agg(F.sum("texts")).first()[0] or 0
    hot = table.filter((F.col("texts") > max(spec.hot_share * total, 1)) & (F.size("ids") < _JOINED)).collect()
    return {r["word"]: list(r["ids"]) for r in hot}


def _with_ids(rows: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Rows of (k1, k2, word, ...) with their words' columns from the table; a text's own row has a null word.

    Texts' own rows go along under keys of their own, spread by text, that no word equals; so one pass gives both kinds.
    """
    key = F.coalesce("word", F.concat(F.lit("\0"), F.col("k1").cast("string")))
    return rows.withColumn("word", key).join(table.select("word", *columns), "word", "left")


def encode(df: DataFrame, id_col: str, text_col: str, spec: EncodeSpec = EncodeSpec()) -> DataFrame:
    """(id, ids) of every row, without special tokens.

    Null, empty texts give an empty list; every input row gives one output row,
    repeated ids and rows and null ids included. Other columns are ignored.
    """
    docs = spread(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))).select(*_keys("_id", "_text"), "_id", "_text")
    table = cut(word_table(docs, "_text", spec))
    rows = docs.select("k1", "k2", "_text").mapInArrow(_split(spec.path, _common(table, spec)), _SPLIT_DDL)
    # Equal rows meet in one group; their words are then placed more than once, to the same end.
    joined = F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("pos", "ids"))).alias("joined")
    every = _with_ids(rows, table, "ids").groupBy("k1", "k2").agg(F.max("sizes").alias("sizes"), F.max("filled").alias("filled"), joined)
    placed = every.select("k1", "k2", "sizes", "filled", "joined").mapInArrow(_placed, "k1 long, k2 long, ids array<int>")
    return docs.select("k1", "k2", "_id").join(placed, ["k1", "k2"]).select(F.col("_id").alias(id_col), "ids")


def _counted(path: str, hot: dict[str, int]):
    """(k1, k2, text) -> a row with the number of ids of the common words, and a row (word, times) for each other word."""

    odd = doubtful_characters(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                k1, k2, word, times = [], [], [], []
                for a, b, text in zip(*(part.column(c).to_pylist() for c in range(3))):
                    words, known = Counter(split_words(path, text, odd) if text else ()), 0
                    rest = {}
                    for w, n in words.items():
                        if w in hot:
                            known += n * hot[w]
                        else:
                            rest[w] = n
                    k1 += [a] * (len(rest) + 1)
                    k2 += [b] * (len(rest) + 1)
                    word += [None, *rest]
                    times += [known, *rest.values()]
                yield pa.record_batch([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(word, pa.string()), pa.array(times, pa.int64())], names=["k1", "k2", "word", "times"])

    return run


def token_counts(df: DataFrame, id_col: str, text_col: str, spec: EncodeSpec = EncodeSpec()) -> DataFrame:
    """(id, n_tokens) of every row: the length of its list of ``encode``, without making the lists."""
    docs = spread(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))).select(*_keys("_id", "_text"), "_id", "_text")
    table = cut(word_table(docs, "_text", spec)).withColumn("n", F.size("ids"))
    common = {w: len(ids) for w, ids in _common(table, spec).items()}
    rows = docs.select("k1", "k2", "_text").mapInArrow(_counted(spec.path, common), "k1 long, k2 long, word string, times long")
    # Equal rows meet in one group, so the sum is divided by their number.
    met = _with_ids(rows, table, "n").groupBy("k1", "k2").agg(F.sum(F.col("times") * F.coalesce("n", F.lit(1))).alias("total"), F.count_if(F.col("n").isNull()).alias("rows"))
    counts = met.select("k1", "k2", F.expr("total div rows").alias("n_tokens"))
    return docs.select("k1", "k2", "_id").join(counts, ["k1", "k2"]).select(F.col("_id").alias(id_col), "n_tokens")


def _byte_alphabet() -> dict[str, int]:
    """Byte-level tokenizers write each byte as a printable character: itself where it is one, else from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Bytes, as characters of the same number, to the alphabet.
_SHOWN = {b: c for c, b in _byte_alphabet().items()}


def decode(df: DataFrame, id_col: str, ids_col: str, spec: EncodeSpec = EncodeSpec()) -> DataFrame:
    """(id, text): ids back to text through a join with the tokenizer's pieces; byte-level tokenizers only."""
    alphabet = _byte_alphabet()
    tok = load(spec.path)
    pieces = [(i, bytearray(alphabet.get(c, 63) for c in p)) for p, i in tok.get_vocab().items()]
    spark = df.sparkSession
    # The vocabulary is fixed by the tokenizer's file: some fifty thousand short pieces.
    vocabulary = F.broadcast(spark.createDataFrame(pieces, "piece_id int, piece binary"))
    rows = df.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids")).select(*_keys("_id", "_ids"), "_id", "_ids")
    lists = rows.select("k1", "k2", "_ids").dropDuplicates(["k1", "k2"])
    spread_ids = lists.select("k1", "k2", F.posexplode("_ids").alias("at", "piece_id")).join(vocabulary, "piece_id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join(x["piece"] for x in sorted(row, key=lambda x: x["at"])).decode("utf-8", "replace") for row in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["k1", "k2", "text"])

    gathered = spread_ids.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "piece")).alias("row"))
    texts = gathered.mapInArrow(joined, "k1 long, k2 long, text string")
    return rows.select("k1", "k2", "_id").join(texts, ["k1", "k2"], "left").select(F.col("_id").alias(id_col), F.coalesce("text", F.lit("")).alias("text"))
