"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary linear classifier on character 1- to 3-gram frequencies
tells whether the language's bit is 0 or 1. A text's language is the one whose codeword loses least: the logistic
losses of all bits are summed, each weighted by how well its classifier separates the training texts. A text is marked
ambiguous if the second language loses hardly more.

The fit takes at most `per_label` texts of each language (whole; the same on each run; of rows that share id and language,
one); only their hashed features
reach the driver. Prediction is one pass without a shuffle. With few languages all distinct bit splits are used
(2**(k-1) - 1 for k languages), beyond that `code_bits` splits drawn from a fixed seed.

Null texts and texts without a letter are `und` with score 0. With no training row every text is `und`; with one
language each text with a letter gets it with score 1. Repeated rows get a result each; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE, bounded_sample, characters, crc_mod, fit_logistic, free_names, one_text, slices

#: Frequencies are so small that the bits' weights would have to grow very large.
SCALE = 30.0
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weight: np.ndarray  # features x bits, float32
    bias: np.ndarray
    bit_weight: np.ndarray
    bits: int


def codewords(k: int, code_bits: int = 31, seed: int = 7) -> np.ndarray:
    """k codewords of -1 and 1 as rows. Each column splits the languages in two, no split comes twice, nor with its sides changed.

    Up to six languages take all splits. More take `code_bits` of them (at least four times the bits that tell them apart), drawn from a fixed seed: of 50 draws the one whose closest codewords are farthest apart.
    """
    if k <= 6:
        return np.array([[1 if (split >> (k - 1 - i)) & 1 else -1 for split in range(1, 2 ** (k - 1))] for i in range(k)], np.int8).reshape(k, -1)
    rng, best, most, n = np.random.default_rng(seed), None, -1, max(code_bits, 4 * int(np.ceil(np.log2(k))))
    for _ in range(50):
        splits: dict[bytes, np.ndarray] = {}
        while len(splits) < n:
            split = (rng.integers(0, 2, k) * 2 - 1).astype(np.int8)
            split *= split[0]  # the first language's side is 1: a split and its mirror are the same
            if (split < 0).any():
                splits.setdefault(split.tobytes(), split)
        code = np.stack(list(splits.values()), 1)
        apart = min((code[a] != code[b]).sum() for a in range(k) for b in range(a))
        if apart > most:
            best, most = code, apart
    return best


def _grams(texts: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: the feature number of each n-gram of the letters (other characters count as a space), and where each text's begin."""
    ends = np.cumsum([0, *map(len, texts)])
    shift = np.uint32(32 - bits)
    for i, j in slices(ends, SLICE // 2):
        code, offs = characters([f" {t.lower()}  " for t in texts[i:j]])
        letter = (code >= 192) & (code != 215) & (code != 247) & ((code < 0x2000) | (code > 0x2BFF)) | (code >= 97) & (code <= 122)
        code = np.where(letter, code, 32).astype(np.uint32)
        keep = np.ones(len(code), bool)  # a run of spaces counts once
        keep[1:] = letter[1:] | letter[:-1]
        keep[offs[:-1]] = True
        offs = np.concatenate([[0], np.cumsum(keep)])[offs]
        code = code[keep]
        h = np.empty((3, max(0, len(code) - 2)), np.uint32)
        n = h.shape[1]
        h[0] = code[:n] * _FACTORS[0]
        h[1] = code[:n] * _FACTORS[1] + code[1 : n + 1] * _FACTORS[2] + np.uint32(1)
        h[2] = code[:n] * _FACTORS[2] + code[1 : n + 1] * _FACTORS[0] + code[2 : n + 2] * _FACTORS[1] + np.uint32(2)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        yield h >> shift, np.minimum(offs, n)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = 400, bits: int = 14, code_bits: int = 31) -> LanguageModel:
    sample = bounded_sample(docs, id_col, label_col, per_label)
    picked = docs.select(id_col, label_col, text_col).join(F.broadcast(sample.select(id_col, label_col)), [id_col, label_col])
    picked = one_text(picked, [id_col, label_col], text_col).select(F.col(label_col).alias("_label"), F.col(text_col).alias("_text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, k = [t or "" for t in batch.column(1).to_pylist()], 0
            for grams, offs in _grams(texts, bits):
                for a, b in zip(offs[:-1], offs[1:], strict=True):
                    index, count = np.unique(grams[:, a:b], return_counts=True)
                    value = (count * (SCALE / max(1, 3 * (b - a)))).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 1].cast(pa.string()), pa.array([index.astype(np.int32)], pa.list_(pa.int32())), pa.array([value], pa.list_(pa.float32()))], ["label", "index", "value"])
                    k += 1

    rows = picked.mapInArrow(extract, "label string, index array<int>, value array<float>").toArrow().to_pydict()
    order = sorted(range(len(rows["label"])), key=lambda r: (rows["label"][r], len(rows["index"][r]), rows["index"][r][:50], rows["value"][r][:50]))
    labels = [rows["label"][r] for r in order]
    languages = sorted(set(labels))
    code = codewords(len(languages), code_bits) if languages else np.zeros((0, 0), np.int8)
    n_bits = code.shape[1]
    weight, bias, trust = np.zeros((1 << bits, n_bits), np.float32), np.zeros(n_bits), np.ones(n_bits)
    if n_bits:
        starts = np.concatenate([[0], np.cumsum([len(rows["index"][r]) for r in order])])
        index = np.concatenate([np.asarray(rows["index"][r], np.int64) for r in order])
        value = np.concatenate([np.asarray(rows["value"][r]) for r in order])
        of = np.array([languages.index(x) for x in labels])
        row = np.repeat(np.arange(len(of)), np.diff(starts))
        each = 1 / np.bincount(of)[of]
        for b in range(n_bits):
            y = (code[of, b] > 0).astype(float)
            w, bias[b] = fit_logistic(starts, index, value, y, each, 1 << bits, l2=1e-5, steps=60, rate=0.3)
            weight[:, b] = w
            z = np.bincount(row, w[index] * value, len(of)) + bias[b]
            trust[b] = max(1e-3, (each * ((z > 0) == (y > 0))).sum() / each.sum() - 0.5)
    return LanguageModel(languages, code, weight, bias, trust / max(trust.sum(), 1e-9), bits)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", margin: float = 0.1) -> DataFrame:
    """`docs` with lang_pred, score (0 to 1) and ambiguous; they take the place of columns of these names."""
    docs = docs.drop("lang_pred", "score", "ambiguous")
    names, (letters,) = docs.columns, free_names(docs, "letter")
    docs = docs.withColumn(letters, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        code, n_bits = m.code.astype(float), m.code.shape[1]
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            z = np.zeros((len(texts), n_bits))
            k = 0
            for grams, offs in _grams(texts, m.bits) if n_bits else ():
                sums = np.zeros((n_bits, grams.shape[1] + 1))
                for b in range(n_bits):
                    w = np.ascontiguousarray(m.weight[:, b])
                    np.cumsum(w[grams[0]] + w[grams[1]] + w[grams[2]], out=sums[b, 1:], dtype=np.float64)
                span = np.maximum(1, 3 * np.diff(offs))
                z[k : k + len(span)] = ((sums[:, offs[1:]] - sums[:, offs[:-1]]) * (SCALE / span)).T + m.bias
                k += len(span)
            loss = (np.logaddexp(0, -z[:, None, :] * code[None]) * m.bit_weight).sum(2) if len(m.languages) else np.zeros((len(texts), 1))
            letter = batch.column(letters).to_numpy(zero_copy_only=False).astype(bool)
            known = letter & bool(m.languages)
            best = loss.argmin(1)
            near = np.exp(-(loss - loss.min(1, keepdims=True)) * 4)
            score = np.where(known, near.max(1) / near.sum(1), 0.0)
            order = np.sort(loss, 1)
            unsure = (order[:, 1] - order[:, 0] < margin) & known if loss.shape[1] > 1 else np.zeros(len(texts), bool)
            pred = [m.languages[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(pred, pa.string()), pa.array(score), pa.array(unsure)], [*names, "lang_pred", "score", "ambiguous"])

    return docs.mapInArrow(run, schema)


def languages(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of each document; learns from the texts and langs of documents that are not held out."""
    model = fit(docs.where(F.col("lang").isNotNull() & (crc_mod("doc_id", folds) != held)))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
