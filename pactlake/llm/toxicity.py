"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

Each text's lower-cased character n-grams are hashed to `2**bits` features that count as present or absent. The
log-count ratio of a feature compares how often labelled toxic and other texts hold it; a logistic model is fitted on
the features scaled by their ratios. Its product with the ratios is one weight for each feature, so a text's score
needs one look-up for each distinct n-gram.

The fit takes at most `per_label` labelled texts of each label (whole texts; the same on each run; of rows that share an
id, one). Only their hashed
features reach the driver. Scoring is one pass over all texts, without a shuffle.

Empty inputs: with no labelled row of some label the score is the share of label 1 (0.0 without any label). Null and
empty texts get the score of a text without features. Repeated rows get a result each. Labels that name a document
twice with different values count both. Columns other than the named ones are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE, bounded_sample, characters, crc_mod, fit_logistic, one_text, row_ranges, slices

ORDERS = (4, 5)


@dataclass
class ToxicityModel:
    weight: np.ndarray  # float32, one for each feature
    bias: float
    bits: int
    orders: tuple[int, ...]


_SPACE = np.uint32(32)
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F), np.uint32(0x165667B1), np.uint32(0xD3A2646D))


def _features(texts: list[str], bits: int, orders: tuple[int, ...]) -> Iterator[np.ndarray]:
    """The distinct feature numbers of each text: n-grams of its lower-cased characters, a space put before and after."""
    ends = np.cumsum([0, *map(len, texts)])
    stamp = np.zeros(1 << bits, np.int32)
    for i, j in slices(ends, SLICE // 2):
        code, offs = characters([f" {t.lower()} " if t else "" for t in texts[i:j]])
        code = np.where((code == 10) | (code == 9) | (code == 13), _SPACE, code)
        grams = []
        for n in orders:
            h = np.zeros(max(0, len(code) - n + 1), np.uint32)
            for k in range(n):
                h += code[k : k + len(h)] * _FACTORS[k]
            h ^= h >> np.uint32(15)
            h *= _FACTORS[n % 6]
            grams.append(h >> np.uint32(32 - bits))
        for a, b in zip(offs[:-1], offs[1:], strict=True):
            own = np.concatenate([g[a : max(a, b - n + 1)] for n, g in zip(orders, grams, strict=True)])
            at = np.arange(len(own), dtype=np.int32)
            stamp[own] = at
            yield own[stamp[own] == at]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = 2000, bits: int = 18, orders: tuple[int, ...] = ORDERS, alpha: float = 1.0, least_ratio: float = 0.5, least_texts: int = 4) -> ToxicityModel:
    """A model of `labels` (id_col, label_col of 0 or 1) on the texts of `docs`. At most `per_label` texts of each label are used."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col), F.col(label_col).cast("int").alias("_y"))
    sample = bounded_sample(known, id_col, "_y", per_label)
    picked = docs.select(id_col, text_col).join(F.broadcast(sample), id_col)
    picked = one_text(picked, [id_col, "_y", "n_label"], text_col).select("_y", "n_label", F.col(text_col).alias("_text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for k, own in enumerate(_features(texts, bits, orders)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 1], batch.column(1)[k : k + 1], pa.array([np.sort(own).astype(np.int32)], pa.list_(pa.int32()))], ["y", "n_label", "index"])

    rows = picked.mapInArrow(extract, "y int, n_label long, index array<int>").toArrow()
    y = rows["y"].to_numpy().astype(float)
    weight = np.zeros(1 << bits, np.float32)
    total = {float(k): float(n) for k, n in set(zip(y, rows["n_label"].to_pylist(), strict=True))}
    if len(total) < 2:
        share = next(iter(total), 0.0)
        return ToxicityModel(weight, 30.0 if share else -30.0, bits, orders)
    lists = rows["index"].combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
    starts, held = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
    sums = np.array([int(held[a:b].sum()) for a, b in zip(starts[:-1], starts[1:], strict=True)])
    order = np.lexsort((sums, np.diff(starts), y))  # the same order of rows on each run
    index = np.concatenate([held[starts[k] : starts[k + 1]] for k in order])
    starts, y = np.concatenate([[0], np.cumsum(np.diff(starts)[order])]), y[order]
    del rows, lists, held
    n1, n0 = y.sum(), len(y) - y.sum()
    seen = {0.0: np.zeros(1 << bits, np.int64), 1.0: np.zeros(1 << bits, np.int64)}
    for border, kind in ((slice(0, int(n0) + 1), 0.0), (slice(int(n0), None), 1.0)):  # rows of label 0 come first
        own = starts[border]
        for i, j in row_ranges(own):
            seen[kind] += np.bincount(index[own[i] : own[j]], minlength=1 << bits)
    ratio = np.log((seen[1.0] + alpha) / (n1 + 2 * alpha)) - np.log((seen[0.0] + alpha) / (n0 + 2 * alpha))
    used = (seen[1.0] + seen[0.0] >= least_texts) & (np.abs(ratio) >= least_ratio)
    number = (np.cumsum(used) - 1).astype(np.int32)
    parts, lengths = [], []
    for i, j in row_ranges(starts):
        own = index[starts[i] : starts[j]]
        keep = used[own]
        parts.append(number[own[keep]])
        lengths.append(np.bincount(np.repeat(np.arange(j - i), np.diff(starts[i : j + 1])), keep, j - i).astype(np.int64))
    index = np.concatenate(parts)
    del parts
    starts = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
    each = np.where(y > 0, total[1.0] / n1, total[0.0] / n0)
    w, bias = fit_logistic(starts, index, None, y, each, int(used.sum()), l2=1e-2, steps=120, rate=0.01, scale=ratio[used])
    weight[used] = (w * ratio[used]).astype(np.float32)
    return ToxicityModel(weight, bias, bits, orders)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 for each text: the likelier label 1, the higher. `out` takes the place of a column of that name."""
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            z = np.fromiter((m.weight[own].sum(dtype=np.float64) for own in _features(texts, m.bits, m.orders)), np.float64, len(texts)) + m.bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted for each document; learns from the labels of documents that are not held out."""
    learn = labels.where(crc_mod("doc_id", folds) != held)
    model = fit(docs, learn)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
