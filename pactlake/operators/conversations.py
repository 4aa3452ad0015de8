"""Stored conversations: cleaning, caps, titles, history windows and streamed pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze, strip_reasoning

TEXT_LIMIT, MESSAGES, CONVERSATIONS = 20_000, 200, 200
SOURCES, SOURCE_LIMIT = 100, 600


def clean(messages: DataFrame) -> DataFrame:
    """Messages of users and assistants that are not blank, cut at TEXT_LIMIT characters. A column `sources` (an array of structs with text) keeps SOURCES of them, their texts cut at SOURCE_LIMIT with an ellipsis."""
    if "sources" in messages.columns:
        fields = [f.name for f in messages.schema["sources"].dataType.elementType]
        text = lambda x: F.when(F.length(x["text"]) > SOURCE_LIMIT, F.concat(F.substring(x["text"], 1, SOURCE_LIMIT), F.lit(" …"))).otherwise(x["text"])
        cut = F.transform(F.slice("sources", 1, SOURCES), lambda x: F.struct(*[(text(x) if f == "text" else x[f]).alias(f) for f in fields]))
        messages = messages.withColumn("sources", cut)
    return messages.where(F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != "")).withColumn("text", F.substring("text", 1, TEXT_LIMIT))


def newest(messages: DataFrame, n: int = MESSAGES) -> DataFrame:
    """The last n messages of each conversation."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def newest_conversations(messages: DataFrame, n: int = CONVERSATIONS, by: str = "turn") -> DataFrame:
    """Messages of the n conversations with the latest `by`; the choice is a bounded top-k."""
    last = messages.groupBy("conv_id").agg(F.max(by).alias("last")).orderBy(F.desc("last"), F.desc("conv_id")).limit(n)
    return messages.join(last.select("conv_id"), "conv_id", "left_semi")


def title(first_text: Column) -> Column:
    """Eighty characters of the first message, with an ellipsis if it is longer."""
    text = squeeze(first_text)
    return F.when(F.length(text) > 80, F.concat(F.rtrim(F.substring(text, 1, 79)), F.lit("…"))).otherwise(text)


def listing(messages: DataFrame) -> DataFrame:
    """conv_id, title, n_messages, last_turn."""
    asked = F.min(F.when((F.col("role") == "user") & (F.trim("text") != ""), F.struct("turn", "text")))
    per = messages.groupBy("conv_id").agg(asked.alias("first"), F.count(F.lit(1)).alias("n_messages"), F.max("turn").alias("last_turn"))
    return per.select("conv_id", F.coalesce(title(F.col("first.text")), F.lit("New conversation")).alias("title"), "n_messages", "last_turn")


def valid_id(conv_id: Column) -> Column:
    return conv_id.rlike("^[A-Za-z0-9_-]{8,64}$")


def history(messages: DataFrame, turns: int = 8, used: int = 6, chars: int = 1500) -> DataFrame:
    """With each message the texts of the last `used` of `turns` turns before it, each cut, as one block."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-turns, -1)
    line = F.when(F.trim("text") != "", F.concat(F.col("role"), F.lit(": "), F.substring("text", 1, chars)))
    return messages.withColumn("_h", F.collect_list(line).over(before)).withColumn("history", F.array_join(F.slice("_h", F.greatest(F.size("_h") - used + 1, F.lit(1)), F.lit(used)), "\n")).drop("_h")


def previous_spec(messages: DataFrame, spec: str = "spec") -> DataFrame:
    """With each message the spec of the last assistant turn before it."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("previous_spec", F.last(F.when(F.col("role") == "assistant", F.col(spec)), ignorenulls=True).over(before))


def follow_up_text(messages: DataFrame, short: int = 80) -> DataFrame:
    """The search text of each question: a short one is put behind the user's question before it."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before)
    out = messages.withColumn("_last", last).where(F.col("role") == "user")
    return out.withColumn("search_text", F.when((F.length("text") < short) & F.col("_last").isNotNull(), F.concat("_last", F.lit(" "), "text")).otherwise(F.col("text"))).drop("_last")


def reassemble(pieces: DataFrame) -> DataFrame:
    """answer_id and text of streamed pieces (answer_id, seq, text), without what the model thought, also where a tag is split between pieces."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return pieces.groupBy("answer_id").agg(whole.alias("text")).withColumn("text", strip_reasoning(F.col("text")))


def evaluate(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id and status (pass, fail, skip) of answers (case_id, answer, route) against cases (case_id, expect_route, expect_contains)."""
    both = cases.join(answers, "case_id", "left")
    todo = F.exists("expect_contains", lambda x: F.contains(F.upper(x), F.lit("TODO")))
    said = F.forall("expect_contains", lambda x: F.contains(F.lower(F.coalesce("answer", F.lit(""))), F.lower(x)))
    route = F.col("expect_route").isNull() | F.coalesce(F.col("route") == F.col("expect_route"), F.lit(False))
    return both.select("case_id", F.when(todo, "skip").when(said & route, "pass").otherwise("fail").alias("status"))
