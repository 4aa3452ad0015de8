"""Approximate search of vectors: an inverted file with product-quantised distances and exact rescoring.

`fit` learns a codebook on a bounded sample: the centres of the lists (k-means on unit vectors) and, for each part of
`WIDTH` numbers of what a vector lacks from its list's centre, up to 256 centres of that part. `encode` gives every row its
nearest list and a byte for each part; that is the index, a tenth or less of the vectors' size. `search` takes a stated set
of queries in blocks: each task scores the codes of the lists that a query probes by look-up tables and passes on its best
`rescored` of each query; the best of all tasks are scored exactly against the vectors.

How many lists are probed and how many rows rescored is set by the fit: so many that of the sample's own nearest
neighbours (by brute force within the sample, for `ASKED` of its rows) a share of `goal` is found. Vectors without any
structure need a large share of the lists for that, vectors with structure few; `probe_share` tells it.

Null vectors are left out, those of length zero score 0. All vectors have one length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import _blocks, _matrix, _unit, cosine

#: The sample that a codebook is fitted on: rows and bytes at most.
SAMPLE_ROWS, SAMPLE_BYTES = 50_000, 64 << 20
#: Lists at most, and rows of the sample that the probes are set with.
MOST_LISTS, ASKED = 4096, 256
#: Numbers of a vector that share a byte of its code.
WIDTH = 4
ROUNDS = 8


@dataclass(frozen=True)
class Codebook:
    centres: np.ndarray
    """A row for each list."""
    parts: np.ndarray
    """For each part of a code, a row for each of its values."""
    probes: int
    rescored: int

    @property
    def probe_share(self) -> float:
        return self.probes / max(1, len(self.centres))


# --- the fit, on the sample ---


def _nearest_centre(rows: np.ndarray, centres: np.ndarray, step: int = 4096) -> np.ndarray:
    """For each row the centre at the least distance."""
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *((rows[i : i + step] @ centres.T - half).argmax(1) for i in range(0, len(rows), step))])


def _means(rows: np.ndarray, k: int, rng: np.random.Generator, unit: bool) -> np.ndarray:
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(ROUNDS):
        own = _nearest_centre(rows, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        centres = _unit(centres) if unit else centres
    return centres


def _padded(rows: np.ndarray) -> np.ndarray:
    """Rows cut into parts of WIDTH numbers, with zeros at the end."""
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % WIDTH))).reshape(len(rows), -1, WIDTH)


def _codes(rows: np.ndarray, own: np.ndarray, centres: np.ndarray, parts: np.ndarray) -> np.ndarray:
    rest = _padded(rows - centres[own])
    return np.stack([_nearest_centre(rest[:, m], parts[m]) for m in range(len(parts))], 1).astype(np.uint8)


def _tables(queries: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """For each query and part, what each value of the part adds to the score."""
    return np.einsum("qmw,mvw->qmv", _padded(queries), parts, optimize=True)


def sample_of(vectors: DataFrame, key: str, value: str) -> np.ndarray:
    """Unit vectors of about SAMPLE_ROWS rows or SAMPLE_BYTES, whichever is less: those of the least hash of their key."""
    rows = vectors.where(F.col(value).isNotNull())
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(value)).alias("d")).first()
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(seen["d"] or 1, 1))))
    share = min(1.0, 1.1 * most / max(seen["n"], 1))
    picked = rows.where(F.pmod(F.xxhash64(F.lit(29), key), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col(value).cast("array<double>").alias("v"))
    return _unit(_matrix(picked.limit(most).toArrow()["v"].combine_chunks()))


def fit(vectors: DataFrame, k: int = 10, goal: float = 0.93, key: str = "vec_id", value: str = "embedding", lists: int | None = None) -> Codebook:
    """A codebook for searches of k neighbours, with as many lists as a quarter of the sample's rows, MOST_LISTS at most."""
    rows, rng = sample_of(vectors, key, value), np.random.default_rng(7)
    if not len(rows):
        return Codebook(np.zeros((0, 0)), np.zeros((0, 256, WIDTH)), 0, k)  # no vectors: no lists
    centres = _means(rows, lists or max(1, min(MOST_LISTS, len(rows) // 4)), rng, True)
    own = _nearest_centre(rows, centres)
    rest = _padded(rows - centres[own])
    parts = [_means(rest[:, m], 256, rng, False) for m in range(rest.shape[1])]
    parts = np.stack([np.pad(p, ((0, 256 - len(p)), (0, 0)), mode="edge") for p in parts])
    # of how many lists, and behind how many better codes, the true neighbours of some rows are
    asked = rng.choice(len(rows), min(ASKED, len(rows)), replace=False)
    exact = rows[asked] @ rows.T
    exact[np.arange(len(asked)), asked] = -np.inf
    true = np.argsort(-exact, 1)[:, : min(k, len(rows) - 1)]
    if not true.size:
        return Codebook(centres, parts, len(centres), max(4 * k, 64))
    to_lists = rows[asked] @ centres.T
    turn = np.argsort(np.argsort(-to_lists, 1), 1)  # the place of each list among a query's
    probes = int(np.quantile(np.take_along_axis(turn, own[true], 1), goal + (1 - goal) / 2)) + 1
    codes, table = _codes(rows, own, centres, parts), _tables(rows[asked], parts)
    behind = []
    for q in range(len(asked)):
        guess = to_lists[q, own] + table[q, np.arange(len(parts)), codes].sum(1)
        guess[turn[q, own] >= probes] = -np.inf
        guess[asked[q]] = -np.inf
        behind += [int((guess > guess[t]).sum()) for t in true[q] if guess[t] > -np.inf]
    rescored = int(np.quantile(behind, goal + (1 - goal) / 2)) + 1 if behind else k
    return Codebook(centres, parts, probes, int(np.clip(2 * rescored, 4 * k, 1000)))


# --- the index ---


def encode(vectors: DataFrame, book: Codebook, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """key, list and code of every row with a vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(book)
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for batch in batches:
            if batch.num_rows:
                rows = _unit(_matrix(batch.column(1)))
                own = _nearest_centre(rows, book.centres)
                codes = _codes(rows, own, book.centres, book.parts)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], [key, "list", "code"])

    return vectors.where(F.col(value).isNotNull()).select(key, F.col(value).cast("array<double>")).mapInArrow(run, f"`{key}` {kind}, list int, code binary")


def write_index(vectors: DataFrame, book: Codebook, folder: str, key: str = "vec_id", value: str = "embedding") -> None:
    """The index as Parquet files sorted by list, and the codebook beside it."""
    spark = vectors.sparkSession
    encode(vectors, book, key, value).repartitionByRange("list", key).sortWithinPartitions("list").write.parquet(f"{folder}/codes")
    flat = lambda a: (list(a.shape), a.ravel().tolist())
    spark.createDataFrame([(book.probes, book.rescored, *flat(book.centres), *flat(book.parts))], "probes int, rescored int, centre_shape array<int>, centres array<double>, part_shape array<int>, parts array<double>").write.parquet(f"{folder}/codebook")


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, Codebook]:
    r = spark.read.parquet(f"{folder}/codebook").first()
    whole = lambda values, shape: np.asarray(values).reshape(shape)
    return spark.read.parquet(f"{folder}/codes"), Codebook(whole(r["centres"], r["centre_shape"]), whole(r["parts"], r["part_shape"]), r["probes"], r["rescored"])


# --- the search ---


def coded_candidates(index: DataFrame, block: DataFrame, book: Codebook, keep: int, key: str, by: str, value: str) -> DataFrame:
    """by, key and guess: of each task the `keep` rows of each query of the block whose codes score best in the lists that it probes. The block, of 1,000 queries or about, goes through the driver."""
    asked = block.where(F.col(value).isNotNull()).select(F.col(by).alias("by"), F.col(value).cast("array<double>").alias("q")).toArrow()
    shared = index.sparkSession.sparkContext.broadcast((asked.combine_chunks(), book))
    kinds = f"`{by}` {block.schema[by].dataType.simpleString()}, `{key}` {index.schema[key].dataType.simpleString()}, guess double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, book = shared.value
        names, queries = asked["by"].combine_chunks(), _unit(_matrix(asked["q"].combine_chunks()))
        if not len(queries) or not len(book.centres):
            return
        to_lists, tables = queries @ book.centres.T, _tables(queries, book.parts)
        place = np.argsort(np.argsort(-to_lists, 1, kind="stable"), 1, kind="stable")
        held, waiting = None, []

        def best(parts: list[pa.Table]) -> pa.Table:
            whole = pa.concat_tables(parts)
            q, guess = whole["q"].to_numpy(), whole["guess"].to_numpy()
            order = np.lexsort((-guess, q))
            nth = np.arange(len(q)) - np.searchsorted(q[order], q[order])
            return whole.take(pa.array(order[nth < keep]))

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(lists), -1)
            for own in np.unique(lists):
                who = np.flatnonzero(place[:, own] < book.probes)
                mine = np.flatnonzero(lists == own)
                if not len(who):
                    continue
                guess = np.repeat(to_lists[who, own, None], len(mine), 1)
                for m in range(codes.shape[1]):
                    guess += tables[who, m][:, codes[mine, m]]
                if len(mine) > keep:
                    row, at = np.nonzero(guess >= -np.partition(-guess, keep - 1, 1)[:, keep - 1 : keep])
                else:
                    row, at = np.indices(guess.shape).reshape(2, -1)
                waiting.append(pa.table({"q": pa.array(who[row]), "guess": pa.array(guess[row, at]), "key": batch.column(0).take(pa.array(mine[at]))}))
            if sum(map(len, waiting)) > 2 * keep * len(queries):
                held, waiting = best(waiting if held is None else [held, *waiting]), []
        if held is not None or waiting:
            out = best(waiting if held is None else [held, *waiting]).combine_chunks()
            for part in out.to_batches(max_chunksize=100_000):
                yield pa.RecordBatch.from_arrays([names.take(part.column(0)), part.column(2), part.column(1)], [by, key, "guess"])

    return index.select(key, "list", "code").mapInArrow(run, kinds)


def search(index: DataFrame, vectors: DataFrame, queries: DataFrame, book: Codebook, k: int = 10, key: str = "vec_id", by: str = "query_id", value: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """As retrieval.nearest(), approximately: by, key, score (exact) and place of k vectors that are among the most alike each query. index: encode() of the same vectors."""
    found, keep = [], max(book.rescored, k + exclude_self)
    for block in _blocks(queries, by):
        near = coded_candidates(index, block, book, keep, key, by, value)
        near = near.where(F.col(key) != F.col(by)) if exclude_self else near
        near = near.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("guess"), key))).where(F.col("_n") <= keep).select(by, key).distinct()
        asked = block.where(F.col(value).isNotNull()).select(by, F.col(value).alias("_q"))
        # `keep` rows for each of the block's queries, and a block: both small
        own = vectors.where(F.col(value).isNotNull()).select(key, value).join(F.broadcast(near), key).join(F.broadcast(asked), by)
        scored = own.select(by, key, cosine(F.col("_q"), F.col(value)).alias("score"))
        found.append(scored.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key))).where(F.col("place") <= k))
    return reduce(DataFrame.unionByName, found)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id", by: str = "query_id") -> DataFrame:
    """n (rows of the exact answer), hits (those that were found) and recall."""
    both = exact.select(by, key).join(found.select(by, key).withColumn("_hit", F.lit(1)), [by, key], "left")
    out = both.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("hits"))
    return out.withColumn("recall", F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(1.0))


def met(index: DataFrame, queries: DataFrame, book: Codebook, value: str = "embedding") -> DataFrame:
    """pairs (of queries and rows) whose codes a search compares, and of how many in all."""
    asked = queries.where(F.col(value).isNotNull()).select(F.col(value).cast("array<double>").alias("q"))
    shared = index.sparkSession.sparkContext.broadcast(book)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(shared.value.centres):
                near = np.argsort(-(_unit(_matrix(batch.column(0))) @ shared.value.centres.T), 1, kind="stable")[:, : shared.value.probes]
                own, n = np.unique(near, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n)], ["list", "asked"])

    per = asked.mapInArrow(probed, "list int, asked long").groupBy("list").agg(F.sum("asked").alias("asked"))
    rows = index.groupBy("list").agg(F.count(F.lit(1)).alias("rows"))
    total = rows.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("r")).crossJoin(asked.agg(F.count(F.lit(1)).alias("q")))  # one row each
    return rows.join(per, "list").agg(F.coalesce(F.sum(F.col("rows") * F.col("asked")), F.lit(0)).alias("pairs")).crossJoin(total).select("pairs", (F.col("r") * F.col("q")).alias("of_all"))
