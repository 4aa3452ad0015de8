"""Near-duplicates by a chosen-path set similarity join.

A document's set holds the identifiers of its word shingles. Documents with equal sets are one node from the start, so
copies are never compared with each other. The nodes are searched in independent trees:

- In each tree a node takes the path of its least-hashed token (minwise choice, another hash for each tree).
- A path of up to `TASK` nodes is a leaf: all its nodes are compared.
- Nodes of a crowded path branch again: each follows `BRANCH` tokens, chosen by hashes that the path sets, and so on
  down, as long as that leaves at most half of the pairs to compare. A path that doesn't fall apart is compared whole,
  in blocks of about `SMALL` nodes, each two of them in a task of their own, so no path is thinned out or cut.

Before that, the nodes of crowded paths are compared with `LEADERS` of them; what is linked is one group from then on.
Only pairs of different groups are looked for, and paths that hold one group are done, so a group of very many near
copies costs as much as it has nodes. Likely pairs (by sketches of 64 bytes) are confirmed on whole sets, where the
texts of their nodes follow them; a pair is skipped only once confirmed links have joined its ends. Each task gives the
least node that its links reach, and components come from alternating large-star and small-star steps, with a
checkpoint after each.

Recall: at any depth, a pair of similarity s stays together in a tree with probability q = 2 - 1/s at least (the fixed
point of q = s (1 - (1 - q) ** 2), as both take each of two branches with probability s). The number of trees is the
least that misses a pair at the threshold with probability `MISS` at most, summed over how its 64 chosen tokens may
agree; the equal sketch bytes asked for miss it with probability `MISS` at most, too.

Texts without a word have an empty set and are linked with nothing. With fewer words than a shingle has, the whole
sequence is one shingle. Documents without an id take part; they never give a component its name, and without any named
member the component is null. An empty table gives an empty result. Columns other than the named ones are ignored (their
names may be any). Sets are compared by 64-bit identifiers of shingles, nodes by a 64-bit identifier of the set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, combine, cut_lineage, free_names, lower_ascii, mix, slices, span_hashes, text_bytes, words

#: Most that a pair at the threshold may be missed by: by all trees, and by its sketch.
MISS = 1e-5
BRANCH = 2
SMALL = 256
#: Nodes on one path up to which a task compares it whole.
TASK = 512
#: Nodes of a crowded path that all its nodes are compared with first.
LEADERS = 32
#: Rows of a list of nodes up to which it is broadcast (about 80 bytes each); a longer one is joined by a shuffle.
BROADCAST = 400_000
#: Bytes of text that are turned into sets at once where pairs are confirmed.
TEXTS = 4_000_000
#: Links that a task of a component step takes.
EDGES_A_TASK = 200_000
COORDINATES = 64
U64 = np.uint64
_ADD = mix(np.arange(1, COORDINATES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_TIMES = mix(np.arange(1001, 1001 + COORDINATES, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def missed(threshold: float, n_trees: int) -> float:
    """The most that `n_trees` trees of any depth miss a pair of that similarity by."""
    out = 0.0
    for k in range(COORDINATES + 1):
        stays = max(0.0, 2 - COORDINATES / k) if k else 0.0
        out += comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k) * (1 - stays) ** n_trees
    return out


def trees(threshold: float) -> int:
    """The least number of trees that miss a pair of that similarity with probability `MISS` at most."""
    for n in range(1, 33):
        if missed(threshold, n) <= MISS:
            return n
    raise ValueError(f"a threshold of {threshold} takes more than 32 trees")


def least_equal(threshold: float) -> int:
    """The most equal bytes of a sketch that a pair of that similarity falls short of with probability `MISS` at most."""
    below, k = 0.0, 0
    while k < COORDINATES:
        below += comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k)
        if below > MISS:
            break
        k += 1
    return k


def shingle_sets(col: pa.Array | pa.ChunkedArray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of a text column: the distinct shingle identifiers of all its texts, sorted within each, and how many each has."""
    buf, offs = text_bytes(col)
    for i, j in slices(offs):
        own = lower_ascii(buf[offs[i] : offs[j]])
        starts, ends, bounds = words(own, offs[i : j + 1] - offs[i])
        token = span_hashes(own, starts, ends)
        n = max(0, len(token) - size + 1)
        rolled = token[:n].copy()
        for k in range(1, size):
            rolled = combine(rolled, token[k : k + n])
        sets = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= size:
                sets.append(np.unique(rolled[a : b - size + 1]))
            elif b > a:
                h = token[a : a + 1] + U64(b - a)
                for k in range(a + 1, b):
                    h = combine(h, token[k : k + 1])
                sets.append(mix(h))
            else:
                sets.append(np.zeros(0, U64))
        yield (np.concatenate(sets) if sets else np.zeros(0, U64)), np.fromiter(map(len, sets), np.int64, len(sets))


def set_ids(tokens: np.ndarray, count: np.ndarray) -> np.ndarray:
    """An identifier of each set, 0 for an empty one."""
    out, full = np.zeros(len(count), U64), count > 0
    if full.any():
        starts = (np.cumsum(count) - count)[full]
        out[full] = combine(np.add.reduceat(mix(tokens ^ U64(0x5851F42D4C957F2D)), starts), np.bitwise_xor.reduceat(tokens, starts) + count[full].astype(U64))
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, text_hash, n_shingles, node (an identifier of the set, null if empty) and sketch (COORDINATES chosen tokens)."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    names = ["id", "text_hash", "n_shingles", "node", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = 0
            for tokens, count in shingle_sets(batch.column(1), size):
                rows = len(count)
                full = count > 0
                starts = (np.cumsum(count) - count)[full]
                chosen = np.zeros((int(full.sum()), COORDINATES), np.uint32)
                node = set_ids(tokens, count)
                if len(starts):
                    for c in range(COORDINATES):
                        chosen[:, c] = np.minimum.reduceat((((tokens + _ADD[c]) * _TIMES[c]) >> U64(32)).astype(np.uint32), starts)
                sketch, at = [None] * rows, np.flatnonzero(full)
                for r, row in zip(at, chosen, strict=True):
                    sketch[r] = row.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + rows], batch.column(2)[k : k + rows], pa.array(count), pa.array(node.view(np.int64), mask=~full), pa.array(sketch, pa.binary())], names)
                k += rows

    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, text_hash long, n_shingles long, node long, sketch binary")


ROW = "key long, node long, tree int, whole long, first binary, small binary"


def heads(nodes: DataFrame, n_trees: int) -> DataFrame:
    """key, node and tree of each node's path in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                chosen = _chosen(batch.column(1))
                for t in range(n_trees):
                    yield pa.RecordBatch.from_arrays([_key(chosen, t), batch.column(0), pa.array(np.full(len(chosen), t, np.int32))], ["key", "node", "tree"])

    return nodes.select("node", "sketch").mapInArrow(run, "key long, node long, tree int")


def _chosen(sketch: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketch.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _key(chosen: np.ndarray, t: int) -> pa.Array:
    return pa.array(mix(combine(np.full(len(chosen), U64(t + 1)), chosen[:, t].astype(U64))).view(np.int64))


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def paths(nodes: DataFrame, n_trees: int, which: str) -> DataFrame:
    """ROW and sketch for each tree in the bit set `which` of the nodes (node, sketch, whole, crowded): the path's key, the trees whose path is compared whole, the tokens chosen in all trees, and the small sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            chosen, bits = _chosen(batch.column(1)), batch.column(3).to_numpy()
            own = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), _binary(chosen[:, :n_trees]), _binary(chosen.astype(np.uint8)), batch.column(1)], ["node", "whole", "first", "small", "sketch"])
            for t in range(n_trees):
                at = pa.array(np.flatnonzero((bits >> t) & 1))
                part = own.take(at)
                yield pa.RecordBatch.from_arrays([_key(chosen, t).take(at), part.column(0), pa.array(np.full(len(at), t, np.int32)), *part.columns[1:]], ["key", "node", "tree", "whole", "first", "small", "sketch"])

    out = nodes.select("node", "sketch", "whole", F.col(which).alias("bits")).mapInArrow(run, ROW + ", sketch binary")
    return out if which == "crowded" else out.drop("sketch")


def children(rows: DataFrame) -> DataFrame:
    """The rows of crowded paths, each on `BRANCH` paths below its own (`parent`)."""
    names = ["parent", *rows.columns]
    sketch = rows.columns.index("sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, chosen, at = batch.column(0).to_numpy().view(U64), _chosen(batch.column(sketch)), np.arange(batch.num_rows)
            h = mix(key.copy())
            for b in range(BRANCH):
                turn = ((h + U64(b) * (U64(1) + (h >> U64(32)) % U64(COORDINATES - 1))) % U64(COORDINATES)).astype(np.int64)
                below = mix(combine(combine(key, turn.astype(U64) + U64(1)), chosen[at, turn].astype(U64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(below.view(np.int64)), *batch.columns[1:]], names)

    schema = T.StructType([T.StructField("parent", T.LongType()), *rows.schema.fields])
    return rows.mapInArrow(run, schema)


def to_compare(rows: DataFrame, *by: str) -> DataFrame:
    """n (rows) and pairs (of rows of different groups, each counted twice) of each path in `by`; paths without such a pair are left out."""
    size = rows.groupBy(*by, "grp").agg(F.count(F.lit(1)).alias("m")).groupBy(*by).agg(F.sum("m").alias("n"), F.sum(F.col("m").cast("double") * F.col("m")).alias("_own"))
    return size.select(*by, "n", (F.col("n").cast("double") * F.col("n") - F.col("_own")).alias("pairs")).where("pairs > 0")


def as_leaves(rows: DataFrame) -> DataFrame:
    return rows.select("key", "node", "tree", "whole", "first", "small", "grp", F.lit(0).alias("part"), F.lit(False).alias("apart"))


def in_blocks(rows: DataFrame) -> DataFrame:
    """Leaves of crowded paths (with n): each path becomes a key for each two of its blocks, in which only nodes of different blocks are compared (apart). The blocks of its largest group are not compared with each other."""
    main = rows.groupBy("key", "grp").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max(F.struct("m", "grp")).alias("main"))
    split = rows.join(main, "key").withColumn("_in", F.col("grp") == F.col("main.grp"))
    n_main, n_rest = (F.ceil(x / SMALL).cast("int") for x in (F.col("main.m"), F.col("n") - F.col("main.m")))
    part = F.when(F.col("_in"), F.pmod(F.xxhash64("node"), n_main)).otherwise(n_main + F.pmod(F.xxhash64("node"), n_rest)).cast("int")
    split = split.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.when(F.col("_in"), n_main).otherwise(F.lit(0)), n_main + n_rest - 1)))
    key = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    return split.select(key.alias("key"), "node", "tree", "whole", "first", "small", "grp", "part", (F.col("part") != F.col("other")).alias("apart"))


def below(crowded: DataFrame) -> DataFrame:
    """Leaves of crowded paths (ROW, sketch, grp), level by level. A level halves the pairs to compare at least, so the levels end."""
    now = cut_lineage(crowded.withColumn("tree", F.lit(-1)).join(to_compare(crowded, "key"), "key"))
    leaves = as_leaves(now.limit(0))
    while not now.isEmpty():
        left = to_compare(children(now.select(crowded.columns)), "parent", "key").groupBy(F.col("parent").alias("key")).agg(F.sum("pairs").alias("left"))
        judged = cut_lineage(now.join(left, "key", "left").withColumn("_split", 2 * F.coalesce("left", F.lit(0.0)) <= F.col("pairs")))
        lower = children(judged.where("_split").select(crowded.columns)).drop("parent")
        lower = cut_lineage(lower.join(to_compare(lower, "key"), "key"))
        leaves = leaves.unionByName(in_blocks(judged.where("not _split"))).unionByName(as_leaves(lower.where(F.col("n") <= TASK)))
        now = lower.where(F.col("n") > TASK)
    return leaves


def around_leaders(crowded: DataFrame, counts: DataFrame) -> DataFrame:
    """Leaves in which the nodes of a crowded path, in blocks of about `TASK`, meet its leaders only. counts: key, n."""
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("key", "node"), "node"))
    leaders = crowded.select("key", "node").withColumn("_turn", turn).where(F.col("_turn") <= LEADERS).select("key", "node", F.lit(True).alias("_lead"))
    parts = F.ceil(F.col("n") / TASK).cast("int")
    rows = crowded.join(counts, "key").join(leaders, ["key", "node"], "left").withColumn("_lead", F.coalesce("_lead", F.lit(False)))
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    rows = rows.withColumn("_part", F.explode(F.when(F.col("_lead"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))))
    return rows.select(F.xxhash64("key", "_part").alias("key"), "node", F.lit(-1).alias("tree"), F.lit(0).cast("long").alias("whole"), "first", "small", F.col("node").alias("grp"), F.col("_lead").cast("int").alias("part"), F.lit(True).alias("apart"))


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first column, cut so that no key goes on in the next one."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if rest and rest[0].column(0)[0].as_py() != key[0]:
            yield from joined(rest)
            rest = []
        last = int(np.searchsorted(key, key[-1]))  # the last key may go on
        if last:
            yield from joined([*rest, batch.slice(0, last)])
            rest = []
        rest.append(batch.slice(last))
    yield from joined(rest)


def joined(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if batches:
        yield from pa.Table.from_batches(batches).combine_chunks().to_batches()


def likely(batch: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (i, j) of whole keys that are of different groups, meet here first and whose sketches agree in `least` bytes or more, and in how many. Columns: as of as_leaves."""
    key, tree, whole_in, grp, part, apart = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3, 6, 7, 8))
    first = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint32).reshape(len(key), -1)
    small = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, COORDINATES)
    counts = ((whole_in[:, None] >> np.arange(first.shape[1])) & 1).astype(bool)
    out, at, d = [], np.arange(len(key)), 0
    while len(at):  # rows that are d apart
        d += 1
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        for k in range(0, len(at), 1 << 16):
            i = at[k : k + (1 << 16)]
            i = i[(grp[i] != grp[i + d]) & (~apart[i] | (part[i] != part[i + d]))]
            meet = (first[i] == first[i + d]) & counts[i]
            i = i[np.where(meet.any(1), meet.argmax(1), -1) == tree[i]]
            same = (small[i] == small[i + d]).sum(1)
            ok = same >= least
            out.append((i[ok], i[ok] + d, same[ok]))
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))


def with_partner(rows: DataFrame, least: int) -> DataFrame:
    """The `rows` that are in a likely pair of their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole(batches):
            i, j, _ = likely(batch, least)
            yield batch.take(pa.array(np.unique(np.concatenate([i, j]))))

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, rows.schema)


def in_common(one: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each set shares with one (all sorted)."""
    flat = np.concatenate(sets)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    return np.add.reduceat(hit, np.cumsum([0, *map(len, sets[:-1])]), dtype=np.int64)


def linked(sets: list[np.ndarray], grp: np.ndarray, i: np.ndarray, j: np.ndarray, same: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The root of each set after all pairs (i, j) that confirmed links don't join already were compared, and which sets have a link. Roots are positions; sets of one group start with one root."""
    _, of = np.unique(grp, return_inverse=True)
    root = np.full(of.max() + 1, len(grp))
    np.minimum.at(root, of, np.arange(len(grp)))
    root, touched = root[of], np.zeros(len(grp), bool)
    while True:
        open_ = root[i] != root[j]
        i, j, same = i[open_], j[open_], same[open_]
        if not len(i):
            return root, touched
        hub = np.bincount(np.concatenate([i, j]), minlength=len(grp)).argmax()
        own = (i == hub) | (j == hub)
        with_, agree = np.where(i[own] == hub, j[own], i[own]), same[own]
        i, j, same = i[~own], j[~own], same[~own]
        some = 1
        while len(with_):  # of each other group the likeliest first, then twice as many
            order = np.lexsort((-agree, root[with_]))
            with_, agree = with_[order], agree[order]
            new = np.ones(len(with_), bool)
            new[1:] = root[with_[1:]] != root[with_[:-1]]
            nth = np.arange(len(with_)) - np.maximum.accumulate(np.where(new, np.arange(len(with_)), 0))
            now = nth < some
            test = with_[now]
            common = in_common(sets[hub], [sets[k] for k in test])
            ok = test[100 * common >= percent * (len(sets[hub]) + np.array([len(sets[k]) for k in test]) - common)]
            if len(ok):
                touched[hub] = touched[ok] = True
                joined_roots = np.unique(root[np.append(ok, hub)])
                root[np.isin(root, joined_roots)] = joined_roots[0]
            with_, agree = with_[~now], agree[~now]
            stay = root[with_] != root[hub]
            with_, agree, some = with_[stay], agree[stay], some * 2


def confirm(rows: DataFrame, size: int, percent: int, least: int) -> DataFrame:
    """node and root (the least node that its links reach within the key) of each row with a link. Linked are likely pairs whose whole sets have at least `percent` of 100 parts in common. rows: as for `likely`, and text."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole keys with texts of about TEXTS bytes together, one key at least."""
        for batch in whole(batches):
            key = batch.column(0).to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            upto = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(9)).to_numpy(zero_copy_only=False))])[cut]
            for a, b in slices(upto, TEXTS):
                yield batch.slice(cut[a], cut[b] - cut[a])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            i, j, same = likely(batch, least)
            sets = []
            for tokens, count in shingle_sets(batch.column(9), size):
                sets += np.split(tokens, np.cumsum(count)[:-1])
            key, node, grp = (batch.column(k).to_numpy() for k in (0, 1, 6))
            cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            order = np.argsort(i, kind="stable")
            i, j, same = i[order], j[order], same[order]
            ends = np.searchsorted(i, cut)
            nodes, roots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b, x, y in zip(cut[:-1], cut[1:], ends[:-1], ends[1:], strict=True):
                if y > x:
                    root, touched = linked(sets[a:b], grp[a:b], i[x:y] - a, j[x:y] - a, same[x:y], percent)
                    some = np.flatnonzero(touched)
                    nodes.append(node[a:b][some])
                    roots.append(node[a:b][root[some]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(roots))], ["node", "root"])

    own = rows.select("key", "node", "tree", "whole", "first", "small", "grp", "part", "apart", "text")
    return own.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node that can be reached) of each node of `edges` (a, b).

    Each half of a round takes a partial minimum for each node and joins it back, so a node with very many links is never in one group.
    """

    def settled(df: DataFrame) -> tuple[DataFrame, tuple]:
        kept = cut_lineage(df)
        found = kept.select(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return kept.coalesce(max(1, found["n"] // EDGES_A_TASK)), tuple(found)

    now, seen = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while before != seen:
        tasks = max(1, 2 * seen[0] // EDGES_A_TASK)
        # large star: larger neighbours move to the least neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks)
        # small star: a node and its smaller neighbours move to the least of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        before, (now, seen) = seen, settled(moved.where("u <> v").coalesce(tasks).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _texts(docs: DataFrame, signed: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """node and text (of one of its rows) of the nodes in `wanted`."""
    at = signed.where(F.col("node").isNotNull()).join(wanted, "node").groupBy("node").agg(F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("at"))
    at = cut_lineage(at.select("node", F.col("at.id").alias("a_id"), F.col("at.text_hash").alias("a_hash")))
    few = at.count() <= BROADCAST
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")).where(F.col("text").isNotNull())
    picked = own.join(F.broadcast(at) if few else at, F.col("id").eqNullSafe(F.col("a_id")) & (F.col("text_hash") == F.col("a_hash")))
    return cut_lineage(picked.groupBy("node").agg(F.min("text").alias("text")))


def _groups(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows' sketches (id, text_hash, n_shingles, node), and node, first (the least id of the node's rows) and root of each node."""
    signed = cut_lineage(sketches(docs, id_col, text_col, size))
    nodes = cut_lineage(signed.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("first"), F.max("sketch").alias("sketch")))
    n_trees, least = trees(percent / 100), least_equal(percent / 100)

    def links(leaves: DataFrame) -> DataFrame:
        met = cut_lineage(with_partner(leaves, least))
        texts = _texts(docs, signed, id_col, text_col, met.select("node").distinct())
        return cut_lineage(confirm(met.join(texts, "node"), size, percent, least)).where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))

    own = heads(nodes, n_trees)
    shared = own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bit = lambda has: F.bit_or(F.when(has, F.expr("shiftleft(1L, tree)")).otherwise(F.lit(0).cast("long")))
    bits = cut_lineage(own.join(shared, "key").groupBy("node").agg(bit(F.col("n") <= TASK).alias("whole"), bit(F.col("n") > TASK).alias("crowded")))
    held = nodes.select("node", "sketch").join(bits, "node")
    leaves = as_leaves(paths(held, n_trees, "whole").withColumn("grp", F.col("node")))
    edges = []
    if not bits.where("crowded <> 0").isEmpty():
        crowded = cut_lineage(paths(held.where("crowded <> 0"), n_trees, "crowded"))
        edges.append(links(around_leaders(crowded, crowded.groupBy("key").agg(F.count(F.lit(1)).alias("n")))))
        crowded = crowded.join(components(edges[0]).withColumnRenamed("root", "grp"), "node", "left").withColumn("grp", F.coalesce("grp", "node"))
        leaves = leaves.unionByName(below(cut_lineage(crowded.select("key", "node", "tree", "whole", "first", "small", "sketch", "grp"))))
    edges.append(links(leaves))
    placed = nodes.select("node", "first").join(components(reduce(DataFrame.unionByName, edges)), "node", "left")
    return signed.drop("sketch"), placed.select("node", "first", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 85) -> DataFrame:
    """id_col, n_shingles, component_id (the least id that links reach) and kept (id_col is component_id) of each document."""
    signed, placed = _groups(docs, id_col, text_col, size, percent)
    name = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(name, "root").select("node", "component_id")
    out = signed.join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each group (the least id, then text hash, then hash of all its plain columns), and all rows without a word."""
    signed, placed = _groups(docs, id_col, text_col, size, percent)
    hashed, a_id, a_hash = free_names(docs, "hash", "id", "text_hash")
    rows = signed.join(placed.select("node", "root"), "node")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("best")).select(F.col("best.id").alias(a_id), F.col("best.text_hash").alias(a_hash))
    worded = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    own = docs.withColumn(hashed, F.xxhash64(text_col))
    stay = own.join(best, F.col(id_col).eqNullSafe(F.col(a_id)) & (F.col(hashed) == F.col(a_hash)), "left_semi").where(worded)
    plain = [F.col(f"`{f.name}`") for f in docs.schema if isinstance(f.dataType, T.AtomicType)]
    one = stay.groupBy(F.col(id_col).alias(a_id), F.col(hashed).alias(a_hash)).agg(F.min_by(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]), F.xxhash64(*plain)).alias(hashed))
    kept = one.select(*[F.col(f"{hashed}.c{k}").alias(c) for k, c in enumerate(docs.columns)])
    return kept.unionByName(own.where(~worded).drop(hashed))
