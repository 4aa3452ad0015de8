"""Language-model scores by prediction by partial matching.

Training texts fill a trie of byte contexts of up to `ORDER` bytes. A byte's probability is that of the longest context
seen in training: its count there over all counts plus distinct bytes, or, if it was not seen there, the escape
probability (distinct bytes over the same sum) times its probability in the context one byte shorter, from which the
bytes seen in the longer context are excluded. Bytes seen nowhere share what is left evenly. A text ends with a zero
byte, so the score of a text is a probability over all texts.

The trie is a Spark table, without a bound: a row for each node of each order. What a byte costs depends on the gram of
the `ORDER` bytes before it and itself, so the orders are joined from the shortest to the longest, each node with the
one that lacks its first byte (at most 256 nodes share one), and sums over a context are windows of at most 256 rows.
That gives a logarithm for each gram that any text holds.

Texts are dealt into blocks of about `block_bytes`. A block sends each of its distinct grams and words once, with its
training count (0 for those of held-out texts only), and gets each gram's logarithm and each word's total count back. So
a hot gram or word has a row for each block, not for each occurrence; its total is an aggregate that is joined back, and
adaptive execution can split that join. Nothing that grows with the texts passes the driver or is broadcast.

Null and empty texts hold one token, the end, and score the probability of ending at once. Without training texts all
counts are 0 and each byte has probability 1/256. Documents with a null id are learned from and not held out. Repeated
rows get a result each; columns other than the two named ones are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, slices, text_bytes

ORDER = 4
U64 = np.uint64


class _Table:
    """Look-up of 64-bit keys by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        size = 1 << self.bits
        self.slot = np.full(size, -1, np.int32)
        self.keys = keys
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.slot[at] < 0
            _, one = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.slot[at[put]] = left[put]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, at = left[stay], (at[stay] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._home(keys)
        found = self.slot[at]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found[open_] = self.slot[at[open_]]
            again = found[open_]
            open_ = open_[(again >= 0) & (self.keys[again] != keys[open_])]
        return found


def framed(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with ORDER zero bytes before and one after each, and their starts and the end."""
    docs = len(offs) - 1
    new = offs + np.arange(docs + 1) * (ORDER + 1)
    out = np.zeros(new[-1], np.uint8)
    out[np.arange(len(buf)) + np.repeat(np.arange(docs) * (ORDER + 1) + ORDER, np.diff(offs))] = buf
    return out, new


def grams_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram at each byte of the texts and their ends, as numbers, and where each text's begin."""
    out, new = framed(buf, offs)
    n = len(out) - ORDER
    key = np.zeros(n, U64)
    for k in range(ORDER + 1):
        key = (key << U64(8)) | out[k : k + n]
    keep = np.ones(n, bool)
    for k in range(ORDER):
        keep[new[1:-1] - ORDER + k] = False
    return key[keep], offs + np.arange(len(offs))


def code_lengths(grams: DataFrame) -> DataFrame:
    """gram and logp (log10 of the probability of its last byte after the bytes before) of grams (gram, n: its count in training texts, 0 for one that is only asked for)."""
    before = None
    for k in range(ORDER + 1):
        nodes = grams.groupBy(F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("gram")).agg(F.sum("n").alias("n"))
        context = Window.partitionBy(F.shiftright("gram", 8) if k else F.lit(0))  # 256 rows at most
        log, seen = F.log10, F.col("n") > 0
        if k:
            nodes = nodes.withColumn("low", F.col("gram").bitwiseAND((1 << 8 * k) - 1)).join(before, "low")
        total, distinct = F.sum("n").over(context).alias("total"), F.count_if(seen).over(context).alias("distinct")
        shared = F.sum(F.when(seen, F.col("n1") if k else F.lit(0)).otherwise(0)).over(context).alias("shared")
        nodes = nodes.select("*", total, distinct, shared)
        if k:
            more = F.col("distinct1") - F.col("distinct")
            rest = F.col("total1") - F.col("shared") + more  # of the shorter context, without the bytes seen in this one
            left = F.when(rest > 0, log(rest.cast("double"))).otherwise(0.0)
            escape = F.when(more > 0, log(more.cast("double")) - left).otherwise(0.0)
            shorter = F.when(F.col("n1") > 0, F.col("value1") - left).otherwise(escape + F.col("value1"))
        else:
            shorter = -log(F.greatest(F.lit(1), 256 - F.col("distinct")).cast("double"))
        whole = log((F.col("total") + F.col("distinct")).cast("double"))
        fresh = F.when(F.col("distinct") == 0, F.col("logp1") if k else shorter).when(seen, log(F.col("n").cast("double")) - whole).otherwise(log(F.col("distinct").cast("double")) - whole + shorter)
        value = F.when(seen, log(F.col("n").cast("double"))).otherwise(shorter)
        own = [F.col("n").alias("n1"), F.col("total").alias("total1"), F.col("distinct").alias("distinct1"), value.alias("value1"), fresh.alias("logp1")]
        before = nodes.select(F.col("gram").alias("low"), *own)
    return before.select(F.col("low").alias("gram"), F.col("logp1").alias("logp"))


def scores(docs: DataFrame, folds: int = 7, held: int = 2, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of each document."""
    held_out = F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False))
    base = docs.select("doc_id", F.col("text"), held_out.alias("held_out"))
    size = base.select(F.sum(F.octet_length("text")).alias("n"), F.count_if(~F.col("held_out")).alias("train")).first()
    blocks = max(1, -(-int(size["n"] or 0) // block_bytes))
    train_docs = int(size["train"] or 0)
    dealt = base.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(min(blocks, 100_000), "_block")

    def words_of(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        count: Counter = Counter()
        rest: set = set()
        buf, offs = text_bytes(table["text"])
        data = buf.tobytes()
        for a, b, out in zip(offs[:-1], offs[1:], table["held_out"].to_pylist(), strict=True):
            (rest if out else count).update(data[a:b].lower().split())
        rest -= count.keys()
        words = [*count, *rest]
        return pa.table([pa.array([key[0].as_py()] * len(words), pa.int32()), pa.array(words, pa.binary()).cast(pa.string()), pa.array([*count.values(), *[0] * len(rest)], pa.int64())], names=["_block", "word", "n"])

    def grams(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)
        buf, offs = text_bytes(table["text"])
        train = ~table["held_out"].to_numpy().astype(bool)
        for i, j in slices(offs):
            own, at = grams_of(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            new, of = np.unique(own, return_inverse=True)
            n = np.bincount(of, np.repeat(train[i:j], np.diff(at)), len(new)).astype(np.int64)
            keys, of = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(of, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        return pa.table([pa.array(np.full(len(keys), key[0].as_py(), np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["_block", "gram", "n"])

    # One exchange of each serves the totals and the join that sends them back. Spark reuses it as both take all its columns, which can't be null, so that no filter is inferred for one of them.
    sure = lambda key, none: [F.coalesce("_block", F.lit(-1)).alias("_block"), F.coalesce(key, F.lit(none)).alias(key), F.coalesce("n", F.lit(0).cast("long")).alias("n")]
    sent = lambda f, key, kind, none: dealt.groupBy("_block").applyInArrow(f, f"_block int, {key} {kind}, n long").select(*sure(key, none)).repartition(key)
    summed = lambda own, key: own.groupBy(key).agg(F.sum("n").alias("total"), F.min("_block").alias("first")).where("first >= 0").drop("first")
    own_words, own_grams = sent(words_of, "word", "string", ""), sent(grams, "gram", "long", -1)
    totals = summed(own_words, "word").where("total > 0")
    known = own_words.join(totals.withColumnRenamed("word", "of"), (F.col("word") == F.col("of")) & (F.col("n") <= F.col("total")))
    lengths = code_lengths(summed(own_grams, "gram").withColumnRenamed("total", "n"))
    told = own_grams.join(lengths.withColumnRenamed("gram", "of"), (F.col("gram") == F.col("of")) & (F.col("n") >= F.col("logp")))
    both = known.select("_block", "word", F.lit(None).cast("long").alias("gram"), F.col("total").cast("double").alias("value")).unionByName(told.select("_block", F.lit(None).cast("string").alias("word"), "gram", F.col("logp").alias("value")))
    whole = totals.agg(F.struct((F.coalesce(F.sum("total"), F.lit(0)) + train_docs).alias("n"), (F.count(F.lit(1)) + int(train_docs > 0)).alias("v")).alias("t")).scalar()

    def score(table: pa.Table, found: pa.Table) -> pa.Table:
        of_word = found.filter(found["gram"].is_null())
        value = dict(zip(of_word["word"].cast(pa.binary()).to_pylist(), np.log10(of_word["value"].to_numpy() + 1).tolist(), strict=True))
        of_gram = found.filter(found["gram"].is_valid())
        number, logp = _Table(of_gram["gram"].to_numpy().view(U64)), of_gram["value"].to_numpy()
        buf, offs = text_bytes(table["text"])
        data = buf.tobytes()
        n_tokens, n_known, log_sum = [], [], []
        for a, b in zip(offs[:-1], offs[1:], strict=True):
            words = data[a:b].lower().split()
            own = [x for x in map(value.get, words) if x is not None]
            n_tokens.append(len(words) + 1)
            n_known.append(len(own) + (train_docs > 0))
            log_sum.append(sum(own) + np.log10(train_docs + 1.0))
        out = []
        for i, j in slices(offs):
            own, at = grams_of(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            out.append(np.add.reduceat(logp[number(own)], at[:-1]))
        return pa.table(
            [table["doc_id"], table["held_out"], pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(log_sum, pa.float64()), pa.array(np.concatenate(out) if out else [], pa.float64()), pa.array(np.diff(offs))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "log_sum", "score", "n_bytes"],
        )

    kind = base.schema["doc_id"].dataType.simpleString()
    out = dealt.groupBy("_block").cogroup(both.groupBy("_block")).applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, log_sum double, score double, n_bytes long")
    out = out.withColumn("t", whole)
    base_score = F.col("log_sum") - F.col("n_tokens") * F.log10((F.col("t.n") + F.col("t.v") + 1).cast("double"))
    per_byte = -F.col("score") / ((F.col("n_bytes") + 1) * float(np.log10(2.0)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.col("t.n").alias("train_tokens"), base_score.alias("base_score"), "score", per_byte.alias("bits_per_byte"))
