"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a text with up to `rate` of its length in edits. It is split into one piece more than its
edit budget, so one piece at least occurs unchanged. All pieces are searched at once (an Aho-Corasick automaton); each
hit tells where the item would lie, hits that agree on that within the budget share a window, and the window is
verified with Myers's bit-parallel distance. Letters A-Z are lowered and white space counts as a space on both sides.

The items are a stated query set. They are read in blocks of at most `block_chars` characters, found from an
aggregate; only a block is ever broadcast. One block is matched with all texts in one pass without a shuffle. Of several,
each takes a pass over the texts that gives the hits of texts that have some, keyed by the text; those are joined back.

Items under `least_chars` characters (white space at the ends aside) count only where they occur without an edit and
between word borders. Items of null text or white space alone are left out; equal items are all reported.
Null and empty texts match nothing. Repeated rows get a result each. All columns are kept, whatever their names; `_hits`
holds item, distance, start and end (in characters) of the best match in each window, by item and start. Without items
all hits are empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, free_names

#: Texts with a hit up to which their hits are broadcast to all texts; more are joined by a shuffle.
BROADCAST = 100_000
_PLAIN = {c: c + 32 for c in range(65, 91)} | {c: 32 for c in (9, 10, 11, 12, 13)}
HITS = T.ArrayType(T.StructType([T.StructField("item", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_HITS = pa.list_(pa.struct([("item", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def plain(text: str) -> str:
    return text.translate(_PLAIN)


def budget(length: int, rate: float) -> int:
    return int(length * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces that make up the item, with their offsets."""
    cut = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def bordered(text: str, start: int, end: int) -> bool:
    """Whether no word goes on over either end of text[start:end]."""
    part = lambda k: 0 <= k < len(text) and (text[k].isalnum() or text[k] == "_")
    return not (part(start - 1) and part(start)) and not (part(end - 1) and part(end))


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << k
    return out


def nearest(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance of a pattern of m characters to any substring of the text, and where the first such one ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, m, 0
    for at, c in enumerate(text, 1):
        x = peq.get(c, 0) | vn
        d0 = (((x & vp) + vp) ^ vp) | x
        hn = vp & d0
        hp = vn | (full & ~(vp | d0))
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
            if score < best:
                best, end = score, at
        x = hp << 1
        vn = x & d0 & full
        vp = ((hn << 1) | ~(x | d0)) & full
    return best, end


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least_chars: int):
        import ahocorasick

        self.items, self.auto, self.any = [], ahocorasick.Automaton(), False
        where: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            item, k = plain(text).strip(), len(self.items)
            if not item:
                continue
            short = len(item) < least_chars
            errors = 0 if short else budget(len(item), rate)
            self.items.append((item_id, len(item), errors, short, masks(item), masks(item[::-1])))
            for offset, piece in pieces(item, errors):
                where.setdefault(piece, []).append((k, offset))
        for piece, at in where.items():
            self.auto.add_word(piece, (len(piece), at))
            self.any = True
        if self.any:
            self.auto.make_automaton()

    def __call__(self, text: str) -> list[dict]:
        if not self.any or not text:
            return []
        text = plain(text)
        starts: dict[int, set[int]] = {}
        for end, (size, at) in self.auto.iter(text):
            for k, offset in at:
                starts.setdefault(k, set()).add(end + 1 - size - offset)
        out = []
        for k, found in starts.items():
            item_id, m, errors, short, forward, backward = self.items[k]
            order = sorted(found)
            if short:  # its one piece is the item
                out += [{"item": item_id, "distance": 0, "start": a, "end": a + m} for a in order if bordered(text, a, a + m)]
                continue
            i = 0
            while i < len(order):
                j = i
                while j + 1 < len(order) and order[j + 1] - order[j] <= 2 * errors:
                    j += 1
                lo, hi = max(0, order[i] - errors), order[j] + m + errors
                distance, stop = nearest(forward, m, text[lo:hi])
                if distance <= errors:
                    stop += lo
                    _, back = nearest(backward, m, text[max(0, stop - m - errors) : stop][::-1])
                    out.append({"item": item_id, "distance": distance, "start": stop - back, "end": stop})
                i = j + 1
        return sorted(out, key=lambda h: (h["item"], h["start"]))


_matchers: dict[tuple, Matcher] = {}


def _matcher(items: tuple[tuple[int, str], ...], rate: float, least_chars: int) -> Matcher:
    key = (hash(items), rate, least_chars)
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(list(items), rate, least_chars)
    return _matchers[key]


def match(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = 0.08, least_chars: int = 24, block_chars: int = 4_000_000, out: str = "_hits") -> DataFrame:
    """`docs` with the hits of each text in `out`, which takes the place of a column of that name."""
    docs = docs.drop(out)
    known = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("item_text")).where(F.length("item_text") > 0)
    total = known.select(F.sum(F.length("item_text")).alias("n")).first()["n"] or 0
    blocks = -(-int(total) // block_chars)
    if not blocks:
        return docs.withColumn(out, F.array().cast(HITS))

    def shared(k: int):
        own = known.where(F.pmod(F.xxhash64("item", "item_text"), F.lit(blocks)) == k) if blocks > 1 else known
        return docs.sparkSession.sparkContext.broadcast(tuple(sorted((r["item"], r["item_text"]) for r in own.collect())))

    def found(block, texts: pa.Array) -> pa.Array:
        matcher = _matcher(block.value, rate, least_chars)
        return pa.array([matcher(t or "") for t in texts.to_pylist()], _ARROW_HITS)

    if blocks == 1:
        block, at = shared(0), docs.columns.index(text_col)

        def with_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, found(block, batch.column(at))], [*batch.schema.names, out])

        return docs.mapInArrow(with_hits, T.StructType([*docs.schema.fields, T.StructField(out, HITS)]))

    def side(k: int) -> DataFrame:
        block = shared(k)

        def only_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = found(block, batch.column(1))
                some = pc.greater(pc.list_value_length(hits), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(some), hits.filter(some)], ["of", "own"])

        texts = docs.where(F.length(text_col) > 0).select(F.md5(F.col(text_col).cast("binary")).alias("of"), F.col(text_col))
        got = texts.mapInArrow(only_hits, T.StructType([T.StructField("of", T.StringType()), T.StructField("own", HITS)]))
        return got.groupBy("of").agg(F.first("own").alias("own"))  # equal texts have equal hits

    (key,) = free_names(docs, "of")
    hits = reduce(DataFrame.unionByName, [side(k) for k in range(blocks)]).groupBy(F.col("of").alias(key)).agg(F.flatten(F.collect_list("own")).alias(out))
    hits = cut_lineage(hits)
    few = hits.count() <= BROADCAST
    joined = docs.withColumn(key, F.md5(F.col(text_col).cast("binary"))).join(F.broadcast(hits) if few else hits, key, "left")
    order = lambda x, y: F.when((x["item"] == y["item"]) & (x["start"] == y["start"]), 0).when((x["item"] < y["item"]) | ((x["item"] == y["item"]) & (x["start"] < y["start"])), -1).otherwise(1)
    return joined.select(*docs.columns, F.array_sort(F.coalesce(out, F.array().cast(HITS)), order).alias(out))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_hits, items (ids, sorted) and least_distance of each document."""
    out = match(docs.select("doc_id", "text"), benchmark)
    items = F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["item"])))
    return out.select("doc_id", (F.size("_hits") > 0).alias("contaminated"), F.size("_hits").alias("n_hits"), items.alias("items"), F.array_min(F.transform("_hits", lambda h: h["distance"])).alias("least_distance"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item."""
    (hits,) = free_names(docs, "hits")
    return match(docs, benchmark, out=hits).where(F.size(hits) == 0).drop(hits)
