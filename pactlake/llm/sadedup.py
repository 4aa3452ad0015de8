"""Removal of long repeated substrings by bucket-pointer refinement.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Positions are bucketed by the
bytes that follow them; a bucket identifier of twice the length is made from two identifiers of the length before, at
a position and at a later offset, and is reused for the next (8, 16, 25, 50, 100, 200, 400 bytes for length 400).
Buckets of one position are dropped as early as they are known to be single:

1. Documents are dealt into blocks of about `block_bytes` by a hash. In each block, the least 200-byte identifier
   (the anchor) within each 400-byte string is chosen; equal strings choose equal anchors. A run of positions with one
   anchor is the unit from here on: its identifiers are those of the anchor and of the run's whole bytes.
2. Each block sends each of its pairs of identifiers once, with its count. Runs whose anchor is single are done. Runs
   whose whole bytes occur twice repeat throughout.
3. In what is left (the ends of repeats), the runs' positions are refined to 400-byte identifiers, which are sent and
   counted as well; of runs that equal each other, one stands for all.
4. Each block marks its repeated positions and cuts the covered bytes.

Texts are shuffled once, into blocks; all else that moves are rows of identifiers: about one for each 50 bytes in step 2,
fewer in step 3, and an answer to those that repeat. Their number grows with the input, not with its square. A repeated
pair of identifiers has a row for each block and no more. An anchor has one for each block and each of its surroundings,
so a passage that stands everywhere in other words makes up a share of all rows; such anchors are dealt by both identifiers
(see totals()). Identifiers have 64 bits, as strings are never compared themselves.

Null texts count as empty, and nothing is removed from texts shorter than `length`. Repeated rows are documents of
their own: equal long rows remove each other. All columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import combine, cut_lineage, free_names, mix, text_bytes

CHUNK = 1 << 19
#: An anchor with more rows than this, and than one in HOT_SHARE of all, is dealt apart; blocks that are looked at for such anchors.
HOT_ROWS, HOT_SHARE = 100_000, 10_000
SOME_BLOCKS = 16
U64 = np.uint64


def bucket_ids(buf: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Identifiers of the strings of `length` // 2 (rounded up) and of `length` bytes at each position, and the shorter length."""
    steps, n = [length], length
    while n > 8:
        n = -(-n // 2)
        steps.append(n)
    steps = steps[::-1]  # steps[0] <= 8
    size = len(buf) - steps[0] + 1
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    ids = np.ndarray((size,), np.uint64, padded, strides=(1,)) & U64((1 << 8 * steps[0]) - 1)
    half, half_len = ids, steps[0]
    for now, nxt in zip(steps[:-1], steps[1:], strict=True):
        half, half_len = ids, now
        m = len(buf) - nxt + 1
        ids = combine(ids[:m], ids[nxt - now : nxt - now + m])
    return half, ids, half_len


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, for each first position."""
    n = len(v)
    pad = -n % w
    rows = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs(buf: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For pieces of a block: first and last position of each run (in the block), its anchor's and its bytes' identifiers, the identifiers of all strings and where they start."""
    for s in range(0, len(buf), CHUNK):
        piece = buf[s : s + CHUNK + length - 1]
        if len(piece) < length:
            return
        half, ids, half_len = bucket_ids(piece, length)
        n = len(ids)
        value = mix(half.copy()) & U64(0xFFFFFFFF00000000) | np.arange(len(half), dtype=U64)
        anchor = (sliding_least(value, length - half_len + 1)[:n] & U64(0xFFFFFFFF)).astype(np.int64)
        room = np.zeros(n + 1, np.int64)  # positions whose string ends within the text
        first, last = offs[:-1] - s, offs[1:] - length - s
        ok = (last >= first) & (last >= 0) & (first < n)
        np.add.at(room, np.maximum(first[ok], 0), 1)
        np.add.at(room, np.minimum(last[ok] + 1, n), -1)
        valid = np.cumsum(room)[:-1] > 0
        if not valid.any():
            continue
        at = np.flatnonzero(valid)
        new = np.ones(len(at), bool)
        new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)
        lo, hi = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
        a = anchor[lo]
        whole = combine(combine(ids[lo], ids[hi]), ((hi - lo) * (2 * length) + a - lo).astype(U64))
        yield lo + s, hi + s, half[a], whole, ids, s


def run_counts(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of identifiers (anchor, whole bytes) of a block's runs, and how many runs have each."""
    parts = [(r[2], r[3]) for r in runs(buf, offs, length)]
    anchor, whole = (np.concatenate([np.zeros(0, U64), *(p[k] for p in parts)]) for k in (0, 1))
    order = np.lexsort((whole, anchor))
    anchor, whole = anchor[order], whole[order]
    new = np.ones(len(order), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
    at = np.flatnonzero(new)
    return anchor[at], whole[at], np.diff(np.append(at, len(order)))


def _rows(block: int, names: tuple[str, ...], *columns: np.ndarray) -> pa.Table:
    """A table of a block's identifiers and counts."""
    return pa.table([pa.array(np.full(len(columns[0]), block, np.int32)), *(pa.array(c.view(np.int64) if c.dtype == U64 else c.astype(np.int64)) for c in columns)], names=["_block", *names])


class _Known:
    """Identifiers that repeat, with their counts and a flag."""

    def __init__(self, keys: pa.ChunkedArray, totals: pa.ChunkedArray | None = None, first: pa.ChunkedArray | None = None):
        keys = keys.to_numpy().view(U64)
        self.keys, at = np.unique(keys, return_index=True)
        self.totals = np.full(len(at), 2) if totals is None else totals.to_numpy()[at]
        self.first = np.ones(len(at), bool) if first is None else first.to_numpy(zero_copy_only=False).astype(bool)[at]

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals (1 for a key that doesn't repeat) and flags."""
        if not len(self.keys):
            return np.ones(len(keys), np.int64), np.ones(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.totals[at], 1), np.where(hit, self.first[at], True)


def _known_runs(found: pa.Table) -> tuple[_Known, _Known]:
    own = found.filter(pc.is_valid(found["anchor"]))
    return _Known(own["anchor"], own["of_anchor"]), _Known(own["whole"], own["of_whole"], own["first"])


def _state(anchor: np.ndarray, whole: np.ndarray, anchors: _Known, wholes: _Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run: does it repeat throughout, is it to be refined, does it stand for its equals."""
    of_anchor, _ = anchors(anchor)
    of_whole, first = wholes(whole)
    full = of_whole >= 2
    mixed = of_anchor > of_whole
    return full, ~full & mixed, full & mixed & first


def hot_anchors(sample: DataFrame, share: float, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The anchors that have more than `hot_rows` rows, and than one in HOT_SHARE of all, if the blocks at hand (rows _block, anchor, whole, n) are that share of all blocks; None if there are none. HOT_SHARE at most. Blocks are dealt by a hash, so some tell of all; an anchor that chance leaves out is only dealt like any other."""
    sample = cut_lineage(sample)
    most = max(hot_rows * share, sample.count() / HOT_SHARE)
    hot = cut_lineage(sample.groupBy("anchor").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most).select("anchor"))
    return None if hot.isEmpty() else hot


def totals(sent: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """_block, anchor, whole, of_anchor, of_whole and first (whether the block is the first with these bytes) of the rows (_block, anchor, whole, n) whose anchor occurs twice or more.

    A passage in differing surroundings has a row for each of them under one anchor. Such anchors (`hot`, HOT_SHARE at most) are dealt by anchor and whole bytes, and their totals come from a partial aggregate.
    """
    pair = Window.partitionBy("anchor", "whole")
    of_pair = ["_block", "anchor", "whole", "n", F.sum("n").over(pair).alias("of_whole"), (F.min("_block").over(pair) == F.col("_block")).alias("first")]
    out = ["_block", "anchor", "whole", "of_anchor", "of_whole", "first"]
    cold, found = sent, None
    if hot is not None:
        names = F.broadcast(hot)
        cold, warm = sent.join(names, "anchor", "left_anti"), sent.join(names, "anchor")
        of_anchor = F.broadcast(warm.groupBy("anchor").agg(F.sum("n").alias("of_anchor")))
        found = warm.repartition("anchor", "whole").select(*of_pair).join(of_anchor, "anchor").select(*out)
    # one sort by both serves both windows
    rest = cold.repartition("anchor").select(*of_pair).withColumn("of_anchor", F.sum("n").over(Window.partitionBy("anchor"))).select(*out)
    return (rest if found is None else rest.unionByName(found)).where("of_anchor > 1")


def block_of(rows: DataFrame, blocks: int):
    """A block for each row, by a hash of its plain columns."""
    return F.pmod(F.xxhash64(*[F.col(c) for c, k in rows.dtypes if k in ("bigint", "int", "string")]), F.lit(blocks)).cast("int")


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = 400, block_bytes: int = 4 << 20, out: tuple[str, str] = ("_spans", "_kept"), hot_rows: int = HOT_ROWS) -> DataFrame:
    """All columns of `docs`, with spans (start and end of each removed run of bytes) and the bytes left, as `out`, which take the place of columns of these names."""
    docs = docs.drop(*out)
    total = docs.select(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    names = docs.columns
    # inside, columns go by their place, so that they may have any name
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    text = f"c{names.index(text_col)}"
    placed = own.withColumn("_block", block_of(own, blocks))
    dealt = placed.repartition(max(1, min(blocks, 100_000)), "_block")

    def anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _rows(key[0].as_py(), ("anchor", "whole", "n"), *run_counts(*text_bytes(table[text]), length))

    sent = dealt.groupBy("_block").applyInArrow(anchors, "_block int, anchor long, whole long, n long")
    few = max(1, min(SOME_BLOCKS, blocks // 8))
    # the text alone goes on: Spark derives filters for each choice of old and new names, which doubles with each column kept
    sample = placed.where(F.col("_block") < few).select("_block", text).repartition(few, "_block").groupBy("_block").applyInArrow(anchors, sent.schema)
    known = totals(sent, hot_anchors(sample, few / blocks, hot_rows))

    def strings(key: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
        buf, offs = text_bytes(table[text])
        by_anchor, by_whole = _known_runs(found)
        parts, shown = [np.zeros(0, U64)], np.zeros(0, U64)
        for lo, hi, anchor, whole, ids, s in runs(buf, offs, length):
            _, refine, stands = _state(anchor, whole, by_anchor, by_whole)
            # one of a block's own equal runs is enough
            at = np.flatnonzero(stands)
            _, one = np.unique(whole[at], return_index=True)
            at = at[one][~np.isin(whole[at[one]], shown)]
            shown = np.concatenate([shown, whole[at]])
            pick = np.concatenate([np.flatnonzero(refine), at])
            parts += [ids[a - s : b - s + 1] for a, b in zip(lo[pick], hi[pick], strict=True)]
        return _rows(key[0].as_py(), ("string", "n"), *np.unique(np.concatenate(parts), return_counts=True))

    refined = dealt.groupBy("_block").cogroup(known.groupBy("_block")).applyInArrow(strings, "_block int, string long, n long")
    repeated = refined.select("_block", "string", F.sum("n").over(Window.partitionBy("string")).alias("total")).where("total > 1").select("_block", "string")
    told = known.unionByName(repeated, allowMissingColumns=True)
    schema = T.StructType([*own.schema.fields, T.StructField("_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("_kept", T.BinaryType())])

    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        buf, offs = text_bytes(table[text])
        by_anchor, by_whole = _known_runs(found)
        by_string = _Known(found["string"].filter(pc.is_valid(found["string"])))
        change = np.zeros(len(buf) + 1, np.int32)
        for lo, hi, anchor, whole, ids, s in runs(buf, offs, length):
            full, refine, _ = _state(anchor, whole, by_anchor, by_whole)
            np.add.at(change, lo[full], 1)
            np.add.at(change, hi[full] + length, -1)
            if refine.any():
                at = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo[refine], hi[refine], strict=True)])
                at = at[by_string(ids[at - s])[0] >= 2]
                np.add.at(change, at, 1)
                np.add.at(change, at + length, -1)
        gone = np.cumsum(change, dtype=np.int32)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        inner = offs[1:-1]
        split = inner[(inner > 0) & (inner < len(buf))]
        split = split[gone[split] & gone[split - 1]]  # where a removed run meets the next text's
        edge = np.sort(np.concatenate([edge, split, split]))
        start, end = edge[::2], edge[1::2]
        of = np.searchsorted(offs, start, "right") - 1
        bounds = np.searchsorted(of, np.arange(len(offs)))
        spans = [[[int(x - o), int(y - o)] for x, y in zip(start[i:j], end[i:j], strict=True)] for i, j, o in zip(bounds[:-1], bounds[1:], offs, strict=False)]
        kept = [buf[i:j][~gone[i:j]].tobytes() for i, j in zip(offs[:-1], offs[1:], strict=True)]
        held = table.select([f"c{k}" for k in range(len(names))])
        return held.append_column("_spans", pa.array(spans, pa.list_(pa.list_(pa.int64())))).append_column("_kept", pa.array(kept, pa.binary()))

    done = dealt.groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(cut, schema)
    return done.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], F.col("_spans").alias(out[0]), F.col("_kept").alias(out[1]))


def digest(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    out = repeated_spans(docs.select("doc_id", "text"), length=length)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("_kept")).alias("n_removed"), F.size("_spans").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = 400) -> DataFrame:
    """`docs` with the repeated bytes cut from its texts. A character that loses a byte goes whole; null texts stay null."""
    spans, kept = free_names(docs, "spans", "kept")
    out = repeated_spans(docs, text_col, length, out=(spans, kept))
    left = F.col(kept).cast("string")
    text = F.when(F.size(spans) == 0, F.col(text_col)).otherwise(F.coalesce(F.try_validate_utf8(left), F.regexp_replace(F.make_valid_utf8(left), "�", "")))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
