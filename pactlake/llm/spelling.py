"""Spelling variants by k-d trees over letter counts.

Words are the runs of Latin letters of all texts (see runs()), each with its count. Two words are near if one inserted,
deleted or replaced letter turns one into the other. Such an edit takes one letter away at most and adds one at most, so
the letter counts of near words differ by two in all (L1), by one up and one down. That makes a range search:

1. For each word length a k-d tree over letter counts splits the words at medians of the letter with the widest spread.
   Its upper part is fitted on a sample of about `SAMPLE` distinct words (by hash), which bounds what reaches the driver;
   all words are dealt to its leaves, the cells.
2. Each word is also sent as a query to all cells of its own and of the next length whose box it may reach with one
   letter less and one more.
3. In a task, a cell's words get a k-d tree of their own down to leaves of `LEAF` words. All queries go down it together,
   and only to boxes within their reach. In a leaf, letter counts are compared as bit sets, and what is within reach is
   verified letter by letter.

Each pair of near words is found once: between equal lengths by its smaller word, between lengths by the shorter one. A
cell with more than 2 * `CELL` words is cut by a hash of the words, each part with all queries; more than 8 * `CELL`
queries are cut likewise, so that no task holds more than these. No word, query or pair is dropped. Words of equal letter
counts (anagrams) can't be told apart by any tree of this kind: a cell of many of them compares its queries with all.
Words of `LONG` letters or more share one tree.

A word's form is its most frequent near word, if that is at least `ratio` times as frequent; its root is found by
pointer doubling over forms, whose counts grow at each step, so that there are no cycles and few rounds.

Null texts hold no words; a null id counts as empty in the hash that deletes letters. Repeated rows count as often as they
come. An empty table, or one without words, gives no rows. Columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

SAMPLE = 200_000
CELL = 8192
LEAF = 48
LONG = 40
#: Pairs that are compared at once.
PAIRS = 1 << 21
#: a to z, then U+00C0 to U+00FF
LETTERS = 90
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, every: int = 31) -> DataFrame:
    """The words of `docs`: lower-cased (A-Z) runs of letters. A run loses one letter if `every` divides the crc32 of `id:run`, that of the place which the crc32 gives; words shorter than `least` go."""
    run = F.explode(F.regexp_extract_all(text_col, F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0)))
    held = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run")).select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    held = held.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run").cast("long")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.pmod("h", F.lit(every)) == 0, cut).otherwise(F.col("run"))
    return held.select(word.alias("word")).where(F.length("word") >= least)


def vocabulary(words: DataFrame, least: int = 2) -> DataFrame:
    """word and n, for words that occur `least` times or more."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


# --- letter counts ---


def codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row (all are below 256), and where each word starts and ends in them."""
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False), out=offsets[1:])
    return np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8), offsets


def counts(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Letter counts of each word, up to 255."""
    letter = np.where(flat < 128, flat - np.uint8(97), flat - np.uint8(0xC0) + np.uint8(26))
    own = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets)) * LETTERS
    out = np.zeros((len(offsets) - 1, LETTERS), np.uint8)
    step = 4096
    for i in range(0, len(out), step):
        j = min(i + step, len(out))
        part = np.bincount(own[offsets[i] : offsets[j]] - i * LETTERS + letter[offsets[i] : offsets[j]], minlength=(j - i) * LETTERS)
        out[i:j] = np.minimum(part, 255).reshape(j - i, LETTERS)
    return out


def bit_sets(vectors: np.ndarray) -> np.ndarray:
    """Letter counts as 128 bits: four for each letter (accented ones share six places), as many set as the count, up to four. Bits that differ are no more than the counts do."""
    groups = np.zeros((len(vectors), 32), np.uint16)
    groups[:, :26] = vectors[:, :26]
    for k in range(26, LETTERS):
        groups[:, 26 + k % 6] += vectors[:, k]
    unary = (1 << np.minimum(groups, 4).astype(np.uint64)) - np.uint64(1)
    shift = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return np.stack([np.bitwise_or.reduce(unary[:, :16] << shift, 1), np.bitwise_or.reduce(unary[:, 16:] << shift, 1)], 1)


# --- the tree ---


def split(vectors: np.ndarray) -> tuple[int, int] | None:
    """The letter with the widest spread and its median, the last count that goes left; None if all are equal."""
    wide = vectors.var(0)
    dim = int(wide.argmax())
    if wide[dim] == 0:
        return None
    column = vectors[:, dim]
    low, high = int(column.min()), int(column.max())
    middle = int(np.median(column))
    options = [c for c in (middle - 1, middle) if low <= c < high]
    return dim, min(options, key=lambda c: abs(int((column <= c).sum()) * 2 - len(column)))


def grow(vectors: np.ndarray, leaf: float, first: int) -> tuple[list[list[int]], int]:
    """A tree as rows (letter, last count that goes left, left, right); a row of letter -1 is a leaf, whose number (from `first`) is in place of the left. Also the next free number."""
    nodes: list[list[int]] = [[-1, 0, 0, 0]]
    todo = [(0, np.arange(len(vectors)))]
    while todo:
        k, own = todo.pop()
        cut = split(vectors[own]) if len(own) > leaf else None
        if cut is None:
            nodes[k] = [-1, 0, first, 0]
            first += 1
            continue
        left = vectors[own, cut[0]] <= cut[1]
        nodes[k] = [*cut, len(nodes), len(nodes) + 1]
        nodes += [[-1, 0, 0, 0], [-1, 0, 0, 0]]
        todo += [(nodes[k][2], own[left]), (nodes[k][3], own[~left])]
    return nodes, first


def home(nodes: list[list[int]], vectors: np.ndarray) -> np.ndarray:
    """The leaf that each vector belongs to."""
    out = np.zeros(len(vectors), np.int64)
    todo = [(0, np.arange(len(vectors)))]
    while todo:
        k, own = todo.pop()
        dim, cut, left, right = nodes[k]
        if dim < 0:
            out[own] = left
        elif len(own):
            low = vectors[own, dim] <= cut
            todo += [(left, own[low]), (right, own[~low])]
    return out


def down(own: np.ndarray, less: np.ndarray, more: np.ndarray, column: np.ndarray, cut: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The queries that may have near words in the left and in the right box, with the letters they have gone down and up by so far. A letter taken (less) or added (more) twice is out of reach."""
    value = column[own]
    inside = value <= cut
    far = (value == cut + 1) & ~less
    yield np.concatenate([own[inside], own[far]]), np.concatenate([less[inside], np.ones(far.sum(), bool)]), np.concatenate([more[inside], more[far]])
    far = (value == cut) & ~more
    yield np.concatenate([own[~inside], own[far]]), np.concatenate([less[~inside], less[far]]), np.concatenate([more[~inside], np.ones(far.sum(), bool)])


def visits(nodes: list[list[int]], vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each leaf with the queries whose reach meets its box."""
    none = np.zeros(len(vectors), bool)
    todo = [(0, np.arange(len(vectors)), none, none)]
    while todo:
        k, own, less, more = todo.pop()
        dim, cut, left, right = nodes[k]
        if not len(own):
            continue
        if dim < 0:
            yield left, own
            continue
        for child, part in zip((left, right), down(own, less, more, vectors[:, dim], cut), strict=True):
            todo.append((child, *part))


# --- a cell ---


def near_pairs(words: pa.Array, queries: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places (of queries, of words) of the near pairs with a query that is shorter, or as long and smaller."""
    if not len(words) or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    (w_flat, w_at), (q_flat, q_at) = codes(words), codes(queries)
    w_vec, q_vec = counts(w_flat, w_at), counts(q_flat, q_at)
    w_bits, q_bits = bit_sets(w_vec), bit_sets(q_vec)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    none = np.zeros(len(queries), bool)
    todo = [(np.arange(len(words)), np.arange(len(queries)), none, none)]
    while todo:
        mine, own, less, more = todo.pop()
        if not len(own):
            continue
        cut = split(w_vec[mine]) if len(mine) > LEAF else None
        if cut is None:
            step = max(1, PAIRS // len(mine))
            for i in range(0, len(own), step):
                q = own[i : i + step]
                apart = np.bitwise_count(q_bits[q, None, 0] ^ w_bits[None, mine, 0])
                apart += np.bitwise_count(q_bits[q, None, 1] ^ w_bits[None, mine, 1])
                a, b = np.nonzero(apart <= 2)
                found.append(_verified(q[a], mine[b], q_flat, q_at, w_flat, w_at))
            continue
        left = w_vec[mine, cut[0]] <= cut[1]
        for side, part in zip((mine[left], mine[~left]), down(own, less, more, q_vec[:, cut[0]], cut[1]), strict=True):
            todo.append((side, *part))
    return tuple(np.concatenate(k) for k in zip((np.zeros(0, np.int64), np.zeros(0, np.int64)), *found, strict=True))


def _verified(q: np.ndarray, w: np.ndarray, q_flat: np.ndarray, q_at: np.ndarray, w_flat: np.ndarray, w_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of which one is the other with one letter replaced (query smaller) or inserted (query shorter)."""
    length, other = q_at[q + 1] - q_at[q], w_at[w + 1] - w_at[w]
    keep_q, keep_w = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for extra in (0, 1):
        of_kind = np.flatnonzero(other - length == extra)
        for size in np.unique(length[of_kind]):
            these = of_kind[length[of_kind] == size]
            span, step = np.arange(size), max(1, PAIRS // int(size))
            for i in range(0, len(these), step):
                at = these[i : i + step]
                a = q_flat[q_at[q[at], None] + span]
                same = a == w_flat[w_at[w[at], None] + span]
                if extra:
                    behind = a == w_flat[w_at[w[at], None] + span + 1]
                    first = np.where(same.all(1), size, same.argmin(1))  # letters alike from the start
                    last = np.where(behind.all(1), size, behind[:, ::-1].argmin(1))  # and from the end
                    ok = first + last >= size
                else:
                    ok = same.sum(1) == size - 1
                    spot = same.argmin(1)
                    ok &= q_flat[q_at[q[at]] + spot] < w_flat[w_at[w[at]] + spot]
                keep_q.append(q[at[ok]])
                keep_w.append(w[at[ok]])
    return np.concatenate(keep_q), np.concatenate(keep_w)


# --- the search ---


def fit_trees(vocab: DataFrame, total: int) -> dict[int, list[list[int]]]:
    """A tree for each length (LONG for all beyond), on a sample of about SAMPLE words. Leaves are numbered throughout."""
    share = min(1.0, SAMPLE / max(total, 1))
    picked = vocab.where(F.pmod(F.xxhash64(F.lit(13), "word"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("word").toArrow()["word"].combine_chunks()
    picked = picked.chunk(0) if isinstance(picked, pa.ChunkedArray) and picked.num_chunks else picked
    picked = picked if isinstance(picked, pa.Array) else pa.array([], pa.string())
    flat, offsets = codes(picked)
    vectors, length = counts(flat, offsets), np.minimum(np.diff(offsets), LONG)
    trees, first = {}, 0
    leaf = max(CELL, total / 20_000) * share  # 40,000 cells or about, however many words
    for size in range(LONG + 2):
        trees[size], first = grow(vectors[length == size], leaf, first)
    return trees


def near_words(vocab: DataFrame) -> DataFrame:
    """word, near and near_n (count of `near`): each pair of near words in both directions. vocab: word, n (a row for each word), already written."""
    total = vocab.count()
    trees = vocab.sparkSession.sparkContext.broadcast(fit_trees(vocab, total))

    def leaves(batch: pa.RecordBatch) -> Iterator[tuple[bool, int, np.ndarray]]:
        flat, offsets = codes(batch.column(0))
        vectors, length = counts(flat, offsets), np.minimum(np.diff(offsets), LONG)
        for size in np.unique(length):
            own = np.flatnonzero(length == size)
            cells = home(trees.value[size], vectors[own])
            for cell in np.unique(cells):
                yield False, int(cell), own[cells == cell]
            for target in {int(size), min(int(size) + 1, LONG)}:
                for cell, some in visits(trees.value[target], vectors[own]):
                    yield True, cell, own[some]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bool], int] = {}
        for batch in batches:
            for asks, cell, own in leaves(batch):
                seen[cell, asks] = seen.get((cell, asks), 0) + len(own)
        yield pa.RecordBatch.from_pydict({"cell": pa.array([c for c, _ in seen], pa.int32()), "asks": pa.array([a for _, a in seen], pa.bool_()), "rows": pa.array(list(seen.values()), pa.int64())})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asks, cell, own in leaves(batch):
                part = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), cell, np.int32)), pa.array(np.full(len(own), asks)), *part.columns], ["cell", "asks", "word", "n"])

    parts = lambda asks, most: F.ceil(F.sum(F.when(F.col("asks") == asks, F.col("rows")).otherwise(0)) / most).cast("int")
    sizes = vocab.select("word").mapInArrow(tally, "cell int, asks boolean, rows long").groupBy("cell").agg(F.greatest(F.lit(1), parts(False, 2 * CELL)).alias("of_words"), F.greatest(F.lit(1), parts(True, 8 * CELL)).alias("of_queries"))
    # a row for each cell, of which there are 40,000 or about
    dealt = vocab.select("word", "n").mapInArrow(deal, "cell int, asks boolean, word string, n long").join(F.broadcast(sizes), "cell")
    part = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "word"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    words = dealt.where("not asks").select("cell", part(1, "of_words").alias("words"), every("of_queries").alias("queries"), "asks", "word", "n")
    queries = dealt.where("asks").select("cell", every("of_words").alias("words"), part(2, "of_queries").alias("queries"), "asks", "word", "n")

    def search(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        own, other = (table.filter(pa.array(k)).combine_chunks() for k in (~asks, asks))
        flat = lambda t: pa.concat_arrays(t["word"].chunks) if t["word"].num_chunks else pa.array([], pa.string())
        q, w = near_pairs(flat(own), flat(other))
        a, b = other.take(pa.array(q)), own.take(pa.array(w))
        ends = lambda name: (pa.chunked_array([*a[name].chunks, *b[name].chunks], table.schema.field(name).type), pa.chunked_array([*b[name].chunks, *a[name].chunks], table.schema.field(name).type))
        (word, near), (_, near_n) = ends("word"), ends("n")
        return pa.table({"word": word, "near": near, "near_n": near_n})

    both = words.unionByName(queries)
    return both.groupBy("cell", "words", "queries").applyInArrow(search, "word string, near string, near_n long")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of `docs` that occurs `least` times or more."""
    vocab = cut_lineage(vocabulary(runs(docs, id_col, text_col), least))
    best = near_words(vocab).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    held = vocab.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    takes = F.col("form_n") >= F.col("n") * ratio
    held = cut_lineage(held.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, F.col("form_n")).alias("form_n")))
    links = held.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    most = held.agg(F.max("n")).first()[0] or 1
    steps = 1  # forms followed so far; each is `ratio` times as frequent as the one before
    while least * ratio**steps <= most:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = cut_lineage(links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
        steps *= 2
    out = held.join(links, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
