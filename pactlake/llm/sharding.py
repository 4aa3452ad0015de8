"""Sharding by k-d tree. DataFrame functions only.

Documents are points in a space of metadata: source, language, length and content (the text's checksum), each as a number
of 60 bits. Its upper 20 bits are the value's class: a hash for source and language, the logarithm for length, the
checksum's upper bits for content. The lower bits spread the documents of a class: 28 bits of a hash of id and checksum,
then 12 that tell repeated rows apart. So one source, or one text, may hold a third of all rows and still be cut.

A node of the tree that is to give k shards is cut where floor(k/2) / k of its bytes lie below, on the dimension in which
it is widest. All nodes of a level are cut together: their boxes come from one aggregate, and the weighted median from
histograms of `BINS` bins by node, of which the one that the median falls into is cut into bins anew, until it holds one
value. Only a row for each node reaches the driver, and the splits of a level (no more than there are shards) are
broadcast. With a number of shards, or bytes of a shard, given, sizes differ by little more than the longest documents.

Slots number a shard's rows from 0 in order of a hash, by the counts of its buckets and by rows within a bucket, so that no
task sorts a shard. Sizes and checksums are taken once and checkpointed; texts are never shuffled, but to write shards.

Null texts have size `extra` and the checksum of an empty text; null sources or languages are values of their own.
Documents without an id are told apart by their checksum, and repeated rows by a number of their own, so which of equal
rows goes where may differ between clusters, but not what comes out. An empty table gives an empty result. Columns other
than the four named are ignored; write_shards() keeps all of them, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, free_names

#: Places of source, language, length and content.
PLACES = ("p0", "p1", "p2", "p3")
CLASS, HASH, ROW = 20, 28, 12
BINS = 1 << 12
#: Rows of a bucket of slots, on average.
BUCKET = 4000


def points(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", extra: int = 16, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, order (a hash) and the place in each dimension, as p0, p1 and so on, of each document; then the columns `keep`."""
    binary = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    held = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + extra).cast("long").alias("size"), F.crc32(binary).alias("text_crc32"), F.col(source_col).alias("_source"), F.col(lang_col).alias("_lang"), F.shiftrightunsigned(F.xxhash64(F.lit(3), F.monotonically_increasing_id()), 64 - ROW).alias("_row"), *[F.col(f"`{c}`") for c in keep])
    upper = lambda h: F.shiftrightunsigned(h, 64 - CLASS)
    class_ = (
        upper(F.xxhash64(F.lit(1), "_source")),
        upper(F.xxhash64(F.lit(2), "_lang")),
        F.least(F.lit((1 << CLASS) - 1), F.floor(F.log2(F.col("size").cast("double")) * (1 << (CLASS - 6)))).cast("long"),
        F.shiftright(F.col("text_crc32"), 32 - CLASS),
    )
    spread = lambda k: F.shiftrightunsigned(F.xxhash64(F.lit(10 + k), F.col("doc_id"), F.col("text_crc32")), 64 - HASH)
    place = [F.shiftleft(c, HASH + ROW).bitwiseOR(F.shiftleft(spread(k), ROW)).bitwiseOR(F.col("_row")).alias(p) for k, (p, c) in enumerate(zip(PLACES, class_, strict=True))]
    order = F.xxhash64(F.lit(5), F.col("doc_id"), F.col("text_crc32")).alias("order")
    return held.select("doc_id", "size", "text_crc32", order, *place, *[F.col(f"`{c}`") for c in keep])


def _table(spark: SparkSession, names: str, rows: list[tuple[int, ...]]) -> DataFrame:
    """A small table of whole numbers, at least one row."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(f'{v}L' for v in r) + ')' for r in rows)} AS t({names})")


def _medians(rows: DataFrame, boxes: dict[int, tuple[int, int, int]]) -> dict[int, int]:
    """The last place that goes below, for each node. rows: node, place, size; boxes: for each node, its least and greatest place and the bytes that are to lie below."""
    out: dict[int, int] = {}
    state = {node: (lo, hi, goal, None) for node, (lo, hi, goal) in boxes.items()}
    while state:
        asked = _table(rows.sparkSession, "node, lo, hi, goal, width", [(n, lo, hi, goal, max(1, -(-(hi - lo + 1) // BINS))) for n, (lo, hi, goal, _) in state.items()])
        inside = rows.join(F.broadcast(asked), "node").where(F.col("place").between(F.col("lo"), F.col("hi")))
        at_bin = F.expr("(place - lo) div width")
        bins = inside.groupBy("node", at_bin.alias("bin")).agg(F.sum("size").alias("bytes"), F.min("place").alias("first"), F.max("place").alias("last"), F.max("goal").alias("goal"))
        bins = bins.withColumn("upto", F.sum("bytes").over(Window.partitionBy("node").orderBy("bin")))  # BINS rows a node at most
        over = F.col("upto") >= F.col("goal")
        hit = bins.groupBy("node").agg(F.min_by(F.struct("first", "last", "bytes", "upto"), F.when(over, F.col("bin"))).alias("b"), F.max(F.when(~over, F.col("last"))).alias("below"))
        for r in hit.collect():  # a row for each node
            _, _, goal, below = state.pop(r["node"])
            below = below if r["below"] is None else r["below"]
            b, before = r["b"], r["b"]["upto"] - r["b"]["bytes"]
            if b["first"] < b["last"]:
                state[r["node"]] = (b["first"], b["last"], goal - before, below)
            else:  # this one place goes to the side that brings the bytes below nearer to the goal
                out[r["node"]] = b["first"] if below is None or b["upto"] - goal <= goal - before else below
    return out


def tree(rows: DataFrame, shards: int) -> list[list[tuple[int, int, int, int, int]]]:
    """The splits of each level: node, dimension, last place that goes below, and the two nodes that it gives. Leaves are numbered -1 (shard 0), -2 and so on."""
    levels: list[list[tuple[int, int, int, int, int]]] = []
    pending = {0: (shards, 0)}  # node: how many shards it is to give, and the first of them
    held, free, span = rows.withColumn("node", F.lit(0).cast("long")), 1, None
    while pending:
        stats = held.where("node >= 0").groupBy("node").agg(F.sum("size").alias("bytes"), *[f(p).alias(f"{n}_{p}") for p in PLACES for n, f in (("lo", F.min), ("hi", F.max))])
        boxes = {r["node"]: r for r in stats.collect()}
        box = lambda node, p: (boxes[node][f"lo_{p}"], boxes[node][f"hi_{p}"])
        if span is None and boxes:
            span = {p: max(1, box(0, p)[1] - box(0, p)[0]) for p in PLACES}
        dims = {node: max(range(len(PLACES)), key=lambda d: (box(node, PLACES[d])[1] - box(node, PLACES[d])[0]) / span[PLACES[d]]) for node in boxes}  # noqa: B023
        cuts: dict[int, int] = {}
        if dims:
            chosen = held.join(F.broadcast(_table(rows.sparkSession, "node, dim", list(dims.items()))), "node").select("node", _pick(F.col("dim")).alias("place"), "size")
            goal = lambda node: boxes[node]["bytes"] * (pending[node][0] // 2) // pending[node][0]  # noqa: E731, B023
            cuts = _medians(chosen, {node: (*box(node, PLACES[d]), goal(node)) for node, d in dims.items()})
        level, after = [], {}
        for node, (k, first) in pending.items():
            sides = []
            for n, at in ((k // 2, first), (k - k // 2, first + k // 2)):
                if n > 1:
                    after[free] = (n, at)
                    sides.append(free)
                    free += 1
                else:
                    sides.append(-1 - at)
            level.append((node, dims.get(node, 0), cuts.get(node, 0), *sides))
        levels.append(level)
        held, pending = _descend(held, level), after
    return levels


def _pick(dim: Column) -> Column:
    return F.coalesce(*[F.when(dim == k, F.col(p)) for k, p in enumerate(PLACES)])


def _descend(rows: DataFrame, level: list[tuple[int, int, int, int, int]]) -> DataFrame:
    splits = _table(rows.sparkSession, "node, _dim, _cut, _below, _above", level)
    side = F.when(_pick(F.col("_dim")) <= F.col("_cut"), F.col("_below")).otherwise(F.col("_above"))
    own = [F.col(f"`{c}`") for c in rows.columns if c != "node"]
    return rows.join(F.broadcast(splits), "node", "left").select(*own, F.when(F.col("_dim").isNull(), F.col("node")).otherwise(side).alias("node"))


def assign(held: DataFrame, shards: int) -> DataFrame:
    """Checkpointed rows of points() with shard and slot."""
    out = held.withColumn("node", F.lit(0 if shards > 1 else -1).cast("long"))
    for level in tree(held, shards) if shards > 1 else []:
        out = _descend(out, level)
    return slots(out.withColumn("shard", -1 - F.col("node")).drop("node"))


def slots(rows: DataFrame) -> DataFrame:
    """Rows of points() with a shard and their slot, from 0 in each shard."""
    bits = max(0, math.ceil(math.log2(max(1, rows.count() / BUCKET))))
    cells = rows.withColumn("_bucket", F.shiftrightunsigned("order", 64 - bits) if bits else F.lit(0).cast("long"))
    # equal rows have one order; if they fill a bucket, it falls into parts
    size = cells.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    above = F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_n")
    size = size.select("shard", "_bucket", F.ceil(F.col("_n") / (4 * BUCKET)).alias("_parts"), above.alias("_above"))
    cells = cells.join(size, ["shard", "_bucket"]).withColumn("_part", F.pmod(F.col(PLACES[0]).bitwiseAND((1 << ROW) - 1), F.col("_parts")))
    part = cells.groupBy("shard", "_bucket", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard", "_bucket").orderBy("_part")) - F.col("_n")
    part = part.select("shard", "_bucket", "_part", before.alias("_before"))
    nth = F.row_number().over(Window.partitionBy("shard", "_bucket", "_part").orderBy("order", "size", "text_crc32", "doc_id"))
    out = cells.withColumn("_nth", nth).join(part, ["shard", "_bucket", "_part"])
    return out.withColumn("slot", F.col("_above") + F.col("_before") + F.col("_nth") - 1).drop("_bucket", "_part", "_parts", "_nth", "_above", "_before")


def shards_for(held: DataFrame, target_bytes: int) -> int:
    """How many shards of about `target_bytes` the points need."""
    return max(1, math.ceil((held.agg(F.sum("size")).first()[0] or 0) / target_bytes))


def shard_documents(docs: DataFrame, shards: int | None = 40, target_bytes: int | None = None, **columns) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each document, for a number of shards or a target of bytes a shard."""
    held = cut_lineage(points(docs, **columns))
    out = assign(held, shards if target_bytes is None else shards_for(held, target_bytes))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, shards: int | None = None, target_bytes: int = 512 << 20, **columns) -> None:
    """Writes all columns of `docs` as Parquet, a folder _shard=k for each shard (with more underscores if a column is named so), its rows in order of their slots."""
    names = [f"_c{k}" for k in range(len(docs.columns))]
    at = {k: names[docs.columns.index(columns.get(k, c))] for k, c in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"), ("lang_col", "lang"))}
    held = cut_lineage(points(docs.toDF(*names), keep=tuple(names), **at))
    placed = assign(held, shards or shards_for(held, target_bytes))
    (shard,) = free_names(docs, "shard")
    kept = placed.select(F.col("shard"), "slot", *names).repartition("shard").sortWithinPartitions("shard", "slot")
    kept.select(F.col("shard").alias(shard), *[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]).write.partitionBy(shard).parquet(folder)
