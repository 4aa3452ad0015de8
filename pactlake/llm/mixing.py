"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

The sources share a budget of as many words as all documents hold, by weight, but none gets more than `repeats` times
what it holds; the excess goes to the others by weight (a water level, found from the sources sorted by the level at
which they are full). Each source's documents are shuffled by a hash. Each pass over a document has a virtual finish
time: the words of its source up to its end divided by the source's target. The passes are taken in order of finish
time until the budget is used up.

No window covers a whole source or all documents, nor all buckets of these: documents fall into hash buckets, buckets into
groups of buckets, and a running sum is that of the groups, plus that of the buckets in a group, plus that of the
documents in a bucket. The global cut is found the same way on buckets of finish time. The number of buckets follows the
number of documents (of groups and of buckets in a group, its root), so a hot source is spread over as many tasks as
there are buckets. Sizes are counted once and checkpointed; texts are never shuffled.

Null text: size 0, taken 0. Null sources form one source, the last. A source of size 0 has target 0. Documents without an
id are shuffled by their text. Documents with the same id are told apart by size; of rows that equal each other in all of
these, some may be taken more often than others, and all are in one bucket. An empty table gives an empty result. Columns
other than the named ones are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, word_count


def targets(sized: DataFrame, repeats: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, place (from 0), weight and target of each source. sized: source, size."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("long"))
    per = per.withColumn("full", F.col("source_size") * repeats)
    whole = Window.partitionBy(F.lit(0))
    order = whole.orderBy(F.col("full") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum("full").over(before), F.lit(0))
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumns({"rest": rest, "share": share, "nth": F.row_number().over(order)})
    open_ = F.col("rest") * F.col("weight") <= F.col("full") * F.col("share")
    first = F.min(F.when(open_, F.col("nth"))).over(whole)
    level = F.max(F.when(F.col("nth") == F.col("first"), F.col("rest") / F.col("share"))).over(whole)
    per = per.withColumn("first", first).withColumn("level", level)
    target = F.when(F.col("nth") < F.col("first"), F.col("full").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return per.select("source", "source_size", "place", "weight", target.alias("target"))


def _digits(rows: int) -> int:
    return max(1, min(7, math.ceil(math.log(max(rows, 1) / 4000, 16)))) if rows > 4000 else 1


def mix(docs: DataFrame, repeats: int = 3, weights: tuple[int, ...] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken and passes of each document."""
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.coalesce(F.col(text_col), F.lit(""))))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.md5(name.cast("binary")).alias("hash"))
    return mix_sized(cut_lineage(sized), repeats, weights)


def mix_sized(sized: DataFrame, repeats: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """As mix(), for rows doc_id, source, size, hash (hex digits)."""
    digits = _digits(sized.count())
    per = targets(sized, repeats, weights)
    bucket = F.substring("hash", 1, digits)
    sums = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    sums = sums.withColumn("upper", F.substring("bucket", 1, digits // 2))
    uppers = sums.groupBy("source", "upper").agg(F.sum("bucket_size").alias("upper_size"))
    uppers = uppers.withColumn("above", F.sum("upper_size").over(Window.partitionBy("source").orderBy("upper")) - F.col("upper_size"))
    uppers = uppers.alias("u").join(per.alias("p"), F.col("u.source").eqNullSafe(F.col("p.source"))).select("u.source", "upper", "above", "source_size", "place", "target")
    sums = sums.withColumn("before", F.sum("bucket_size").over(Window.partitionBy("source", "upper").orderBy("bucket")) - F.col("bucket_size"))
    sums = sums.alias("s").join(uppers.alias("u"), F.col("s.source").eqNullSafe(F.col("u.source")) & (F.col("s.upper") == F.col("u.upper")))
    sums = sums.select("s.source", "bucket", (F.col("above") + F.col("before")).alias("before"), "source_size", "place", "target")
    within = Window.partitionBy("source", "bucket").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    docs = sized.withColumn("bucket", bucket).withColumn("inside", F.sum("size").over(within))
    docs = docs.alias("d").join(sums.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.bucket") == F.col("s.bucket")))
    docs = docs.select("doc_id", "d.source", "size", "hash", "source_size", "place", "target", (F.col("before") + F.col("inside")).alias("upto"))
    passes = F.when(F.col("target") > 0, F.least(F.lit(repeats), F.floor(F.col("target") / F.col("source_size")) + 1)).otherwise(0).cast("int")
    finish = F.when(F.col("size") > 0, F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda k: F.when((k < passes), (k * F.col("source_size") + F.col("upto")) / F.col("target"))))
    docs = cut_lineage(docs.withColumn("finish", F.filter(F.coalesce(finish, F.array().cast("array<double>")), lambda v: v.isNotNull())))

    # the cut: the last pass in order of finish time that the budget has room for
    buckets, side = 16**digits, 16 ** (digits - digits // 2)
    each = docs.select(F.posexplode("finish").alias("pass", "at"), "size", "place", "hash", "doc_id").withColumn("slot", F.floor(F.col("at") * buckets))
    key = F.struct("at", "place", "pass", "hash", F.col("doc_id"), "size")
    slots = each.groupBy("slot").agg(F.sum("size").alias("slot_size"))
    budget = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar()
    slots = slots.withColumn("part", F.floor(F.col("slot") / side))
    parts = slots.groupBy("part").agg(F.sum("slot_size").alias("part_size"))
    parts = parts.withColumn("upto", F.sum("part_size").over(Window.partitionBy(F.lit(0)).orderBy("part"))).where(F.col("upto") > budget)
    at_part = parts.agg(F.min_by(F.struct("part", (F.col("upto") - F.col("part_size")).alias("before")), "part").alias("p"))
    inside = slots.crossJoin(F.broadcast(at_part)).where(F.col("part") == F.col("p.part"))  # one row: no product
    running = inside.withColumn("upto", F.col("p.before") + F.sum("slot_size").over(Window.partitionBy(F.lit(0)).orderBy("slot")))
    edge = running.where(F.col("upto") > budget).agg(F.min_by(F.struct("slot", (F.col("upto") - F.col("slot_size")).alias("before")), "slot").alias("e"))
    last = each.crossJoin(F.broadcast(edge)).where(F.col("slot") == F.col("e.slot"))  # one row at most: no product
    fits = last.withColumn("upto", F.col("e.before") + F.sum("size").over(Window.partitionBy("slot").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)))
    cut = fits.agg(F.max(F.when(F.col("upto") <= budget, key)).alias("cut"), F.max("slot").alias("slot"))
    cut = cut.select(F.when(F.col("slot").isNotNull(), F.coalesce("cut", F.struct((F.col("slot") / buckets).alias("at"), F.lit(-1).alias("place"), F.lit(0).alias("pass"), F.lit("").alias("hash"), F.lit(None).cast(dict(sized.dtypes)["doc_id"]).alias("doc_id"), F.lit(0).cast("long").alias("size")))).alias("cut"))
    out = docs.crossJoin(F.broadcast(cut))  # one row
    own = F.transform(F.col("finish"), lambda v, k: F.struct(v.alias("at"), F.col("place"), k.alias("pass"), F.col("hash"), F.col("doc_id"), F.col("size")))
    taken = F.size(F.filter(own, lambda x: F.col("cut").isNull() | (x <= F.col("cut"))))
    return out.select("doc_id", "source", "size", "source_size", "target", (taken * F.col("size")).cast("long").alias("taken"), taken.alias("passes"))


ORACLE = r"""
WITH sized AS MATERIALIZED (SELECT row_number() OVER () AS nth_row, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(doc_id::VARCHAR, 'text ' || coalesce(text, ''))) AS hash FROM documents),
a AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
b AS (SELECT *, (place % 3) + 1 AS weight, source_size * 3 AS full_ FROM a),
c AS (SELECT *, row_number() OVER (ORDER BY full_ / weight, place) AS nth,
  sum(source_size) OVER () - coalesce(sum(full_) OVER (ORDER BY full_ / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY full_ / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS share FROM b),
d AS (SELECT min(nth) AS first_ FROM c WHERE rest * weight <= full_ * share),
e AS (SELECT c.*, CASE WHEN nth < first_ THEN full_::DOUBLE ELSE (SELECT rest::DOUBLE / share::DOUBLE FROM c, d WHERE nth = first_) * weight END AS target FROM c, d),
f AS (SELECT sized.*, e.source_size, e.place, e.target, sum(size) OVER (PARTITION BY e.place ORDER BY hash, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized JOIN e ON sized.source IS NOT DISTINCT FROM e.source),
g AS (SELECT f.*, k AS pass, (k * source_size + upto)::DOUBLE / target AS due FROM f, range(3) t(k) WHERE size > 0 AND target > 0 AND k < least(3, floor(target / source_size) + 1)),
h AS (SELECT *, sum(size) OVER (ORDER BY due, place, pass, hash, doc_id, size ROWS UNBOUNDED PRECEDING) AS used FROM g),
i AS (SELECT nth_row, count(*) AS passes FROM h WHERE used <= (SELECT sum(size) FROM sized) GROUP BY nth_row)
SELECT f.doc_id, f.source, f.size::BIGINT AS size, f.source_size, f.target, (coalesce(passes, 0) * f.size)::BIGINT AS taken, coalesce(passes, 0)::INTEGER AS passes
FROM f LEFT JOIN i ON f.nth_row = i.nth_row
"""
