"""Array helpers that the corpus operators share inside Spark tasks, and bounded sampling of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes (or characters) that a task turns into arrays at once; one longer text is taken whole.
SLICE = 1_000_000

U64 = np.uint64
_M1, _M2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, in place."""
    x ^= x >> U64(31)
    x *= _M2
    x ^= x >> U64(29)
    x *= _M1
    x ^= x >> U64(32)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An identifier of the pair (a, b), elementwise."""
    out = a * _M1
    out ^= out >> U64(30)
    out += b
    out *= _M2
    out ^= out >> U64(28)
    return out


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in a row, and where each text starts and ends in them. Null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays([c.cast(pa.large_string()) for c in col.chunks]) if col.num_chunks else pa.array([], pa.large_string())
    arr = col.cast(pa.large_string()).fill_null("")
    _, offs, data = arr.buffers()
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


#: \x20 and \x09 to \x0D
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True

_BYTE = mix(np.arange(1, 257, dtype=U64) * _M2)
_BASE = 0x9E3779B97F4A7C15 | 1
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and their inverses."""
    if not _POW or len(_POW[0]) < n:
        size = max(n, SLICE + 1)
        out = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, base, U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        _POW[:] = out
    return _POW[0], _POW[1]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit identifier of the bytes of each span."""
    power, inverse = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=sums[1:])
    out = (sums[ends] - sums[starts]) * inverse[starts]
    out += (ends - starts).astype(U64)
    return mix(out)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of bytes that are not white space) and, for each text, where its words begin in them (one more at the end)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    full = ~SPACE[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = full[:-1]
    inner = offsets[1:-1]
    before[inner[inner < n]] = False
    starts = np.flatnonzero(full & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = full[1:]
    cut = inner[(inner > 0)] - 1
    after[cut] = False
    ends = np.flatnonzero(full & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text starts and ends in them."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offsets[1:])
    return np.frombuffer(joined, np.uint32), offsets


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def crc_mod(column: str, n: int):
    """crc32 of the value as text, modulo n (null for null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def bounded_sample(rows: DataFrame, key: str, label: str, per_label: int) -> DataFrame:
    """At most `per_label` rows (key, label) of each label, the same ones on each run: those whose key has the lowest hash.

    A cut on the hash that the label's count sets comes first, so what is ranked is bounded too; labels with fewer rows stay whole. Adds n_label, the label's rows in all.
    """
    from pyspark.sql import Window

    rows = rows.select(key, label).where(F.col(key).isNotNull() & F.col(label).isNotNull()).distinct()
    total = F.broadcast(rows.groupBy(label).agg(F.count(F.lit(1)).alias("n_label")))
    at = F.pmod(F.xxhash64(F.lit(17), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = rows.join(total, label).withColumn("_at", at).where(F.col("_at") * F.col("n_label") <= F.lit(1.5 * per_label + 50))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_at", key))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= per_label).select(key, label, "n_label")


def one_text(rows: DataFrame, keys: list[str], text: str, parts: int = 16) -> DataFrame:
    """One row for each value of `keys`, with the text of the least hash: rows that repeat a sampled key don't make the sample larger. A partial aggregate, so a key that many rows share is no load."""
    return rows.groupBy(*keys).agg(F.min_by(text, F.xxhash64(text)).alias(text)).repartition(parts, *keys)


#: Entries of sparse rows that are worked on at once.
ENTRIES = 1 << 20


def row_ranges(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of sparse rows of about ENTRIES entries each."""
    return slices(starts, ENTRIES)


def fit_logistic(starts: np.ndarray, index: np.ndarray, value: np.ndarray | None, y: np.ndarray, weight: np.ndarray, dim: int, l2: float = 1e-3, steps: int = 80, rate: float = 0.05, scale: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model on sparse rows, by Adam over all rows at each step. An entry's value is `value`, or 1, times its feature's `scale`, if given. Rows are taken in ranges, so that only these need room for numbers of their own."""
    w, b = np.zeros(dim), 0.0
    m, v, mb, vb = np.zeros(dim), np.zeros(dim), 0.0, 0.0
    lengths, ranges = np.diff(starts), list(row_ranges(starts))
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        whole, g, gb = w if scale is None else w * scale, np.zeros(dim), 0.0
        for i, j in ranges:
            own, of = index[starts[i] : starts[j]], np.repeat(np.arange(j - i), lengths[i:j])
            part = None if value is None else value[starts[i] : starts[j]]
            z = np.bincount(of, whole[own] if part is None else whole[own] * part, j - i) + b
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i:j]) * weight[i:j]
            g += np.bincount(own, err[of] if part is None else err[of] * part, dim)
            gb += err.sum()
        g = (g if scale is None else g * scale) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-10)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-10)
    return w, float(b)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """A column name for each of `wanted` that no column of `df` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` as a reliable checkpoint in the shared folder of spark.checkpoint.dir."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session without that setting, as in tests, gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    return folder.rstrip("/")


#: A word of the contracts: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
