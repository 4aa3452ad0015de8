"""Quality rules on repeated text, from a suffix array of each document's words.

The suffix array is refined bucket by bucket: words sort into buckets, and only positions whose bucket holds more than
one are sorted again, by the rank of the position 1, 2, 4, ... words on, until every bucket is single. The ranks of all
rounds give the longest common prefix of neighbours in the array; a position's longest repeat is the larger of its two.
Neighbours with a common prefix of `least` words or more are the intervals of maximal repeats; their spans are united
into covered words. A document passes if the covered share of its bytes and its longest repeat stay within limits.

One pass without a shuffle; a task holds arrays of one slice of texts (about two million bytes) at a time, or of one
longer text. Null and empty texts have no words: all counts are 0, base_failed is true, kept false. Repeats never cross
documents. Repeated rows get a result each; columns other than the two named ones are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, SPACE, combine, mix, slices, span_hashes, text_bytes, words

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, repeat_bytes long, word_bytes long, longest_repeat long"


def longest_repeats(token: np.ndarray, doc: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a run of `least` tokens or more starts that also starts elsewhere in the document, and the longest such run of each.

    token: an identifier of each token; doc: the document's number; ends: the position after the document's last token.
    """
    n = len(token)
    empty = np.zeros(0, np.int64)
    if n < 2:
        return empty, empty
    key = combine(token, mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    ranked = key[order]
    head = np.ones(n, bool)
    head[1:] = ranked[1:] != ranked[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    single = head & np.append(head[1:], True)
    active = order[~single]
    levels, step = [rank.copy()], 1
    while len(active):
        after = active + step
        inside = after < ends[active]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        old = rank[active]
        sub = np.argsort(old * (n + 1) + second)
        active, old, second = active[sub], old[sub], second[sub]
        at = np.arange(len(active))
        first = np.ones(len(active), bool)
        first[1:] = old[1:] != old[:-1]
        head = first.copy()
        head[1:] |= second[1:] != second[:-1]
        rank[active] = old + np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
        single = head & np.append(head[1:], True)
        active = active[~single]
        levels.append(rank.copy())
        step *= 2
    base = int(np.log2(least))
    if base >= len(levels):
        return empty, empty
    coarse = levels[base]
    count = np.bincount(coarse, minlength=n)
    pos = np.flatnonzero((count[coarse] > 1) & (np.arange(n) + (1 << base) <= ends))
    if not len(pos):
        return empty, empty
    pos = pos[np.argsort(rank[pos])]
    a, b = pos[:-1], pos[1:]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + lcp, b + lcp
        ok = (i + (1 << k) <= ends[a]) & (j + (1 << k) <= ends[b])
        ok[ok] = levels[k][i[ok]] == levels[k][j[ok]]
        lcp += ok * (1 << k)
    longest = np.zeros(len(pos), np.int64)
    longest[:-1] = lcp
    longest[1:] = np.maximum(longest[1:], lcp)
    keep = longest >= least
    return pos[keep], longest[keep]


def _per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def measure(buf: np.ndarray, offs: np.ndarray, least: int) -> list[np.ndarray]:
    """The columns of SCHEMA for the texts of one slice."""
    docs = len(offs) - 1
    starts, ends, bounds = words(buf, offs)
    count = np.diff(bounds)
    doc = np.repeat(np.arange(docs), count)
    chars = _per_doc(~SPACE[buf] & ((buf & 0xC0) != 0x80), offs)
    symbols = _per_doc(SYMBOL[buf], offs)
    # lines with a word
    cuts = np.flatnonzero(buf == 10)
    line_start = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], cuts + 1]))
    line_start = line_start[line_start < len(buf)]
    line_doc = np.searchsorted(offs, line_start, "right") - 1
    line_end = np.minimum(np.append(cuts, len(buf))[np.searchsorted(cuts, line_start, "left")], offs[line_doc + 1])
    has = np.searchsorted(starts, line_end, "left") > np.searchsorted(starts, line_start, "left")
    line_start, line_end, line_doc = line_start[has], line_end[has], line_doc[has]
    line_key = combine(span_hashes(buf, line_start, line_end), mix(line_doc.astype(np.uint64) + np.uint64(1)))
    _, kept = np.unique(line_key, return_index=True)
    dup_lines = np.bincount(line_doc, minlength=docs) - np.bincount(line_doc[kept], minlength=docs)
    # repeats of words
    token = span_hashes(buf, starts, ends)
    pos, longest = longest_repeats(token, doc, bounds[1:][doc], least)
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, pos, 1)
    np.add.at(change, pos + longest, -1)
    covered = np.cumsum(change)[:-1] > 0
    width = ends - starts
    most = np.zeros(docs, np.int64)
    np.maximum.at(most, doc[pos], longest)
    return [count, chars, symbols, dup_lines, _per_doc(covered, bounds), _per_doc(width * covered, bounds), _per_doc(width, bounds), most]


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 8) -> DataFrame:
    """id_col and the columns of SCHEMA for each document; repeats count from `least` words on."""
    base = docs.select(id_col, text_col)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_bytes(batch.column(1))
            for i, j in slices(offs, SLICE):
                out = measure(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], least)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *(pa.array(x.astype(np.int64)) for x in out)], [id_col, *names])

    kind = base.schema[id_col].dataType.simpleString()
    return base.mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


def quality(docs: DataFrame, max_share: float = 0.3, max_repeat: int = 100) -> DataFrame:
    """The columns of repetition() with base_failed, repeat_share (of the words' bytes) and kept."""
    share = F.when(F.col("word_bytes") > 0, F.col("repeat_bytes") / F.col("word_bytes")).otherwise(F.lit(0.0))
    out = repetition(docs).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    out = out.withColumn("repeat_share", share)
    kept = ~F.col("base_failed") & (F.col("repeat_share") <= max_share) & (F.col("longest_repeat") <= max_repeat)
    return out.withColumn("kept", kept).drop("repeat_bytes", "word_bytes")
