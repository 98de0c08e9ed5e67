"""A slot for any scorer of texts: loaded once a worker, applied in batches, with a score to fall back on.

A scorer is a function without arguments that loads a model and gives a function from a list of texts to a list of scores.
Functions pickle by name, so the model itself is never sent. Here no model can be loaded; tests and queries use plain functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Load = Callable[[], Callable[[list[str]], Sequence[float]]]


@lru_cache(8)
def _loaded(load: Load):
    try:
        return load()
    except Exception:  # whatever keeps a model from loading, the fallback stands in
        return None


def _scored(load: Load, fallback: float, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _loaded(load)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                part = whole.slice(at, rows)
                texts = [t or "" for t in part.column(1).to_pylist()]
                values, ok = [fallback] * len(texts), score is not None
                if ok:
                    try:
                        values = [float(x) for x in score(texts)]
                    except Exception:
                        ok = False
                yield pa.record_batch([part.column(0), pa.array(values, pa.float64()), pa.array([ok] * len(texts))], names=["id", "score", "scored"])

    return run


def scores(df: DataFrame, id_col: str, text_col: str, load: Load, fallback: float = 0.5, rows: int = 64) -> DataFrame:
    """(id, score, scored) of every row, ``rows`` texts at a time.

    Where the scorer can't be loaded, or fails on a batch, its texts get ``fallback`` and ``scored`` is false. Null texts are scored as empty.
    """
    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = plain.mapInArrow(_scored(load, fallback, rows), f"id {dict(plain.dtypes)['id']}, score double, scored boolean")
    return out.withColumnRenamed("id", id_col)


def scores_where(df: DataFrame, wanted: Column, id_col: str, text_col: str, load: Load, otherwise: float, fallback: float = 0.5) -> DataFrame:
    """Like ``scores``, but only rows with ``wanted`` are sent to the scorer; the others have the score ``otherwise``."""
    chosen = F.coalesce(wanted, F.lit(False))
    rest = df.filter(~chosen).select(id_col, F.lit(float(otherwise)).alias("score"), F.lit(False).alias("scored"))
    return scores(df.filter(chosen), id_col, text_col, load, fallback).unionByName(rest)
