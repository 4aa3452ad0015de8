"""Batches of documents against what is stored: duplicates, changes, upserts and what to do again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def exact_duplicates(records: DataFrame) -> DataFrame:
    """Records (contract_id, content_hash, updated_at) with `keep` (the newest of each hash, then the least id) and `kept_id`. Records without a hash are all kept.

    The newest comes from a partial aggregate that is joined back, so a hash with very many copies is in no single group.
    """
    best = records.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.max(F.coalesce("updated_at", F.lit(""))).alias("_at"))
    at = records.join(best, "content_hash").where(F.coalesce("updated_at", F.lit("")) == F.col("_at"))
    kept = at.groupBy("content_hash").agg(F.min("contract_id").alias("kept_id"))
    out = records.join(kept, "content_hash", "left").withColumn("kept_id", F.coalesce("kept_id", "contract_id"))
    return out.withColumn("keep", F.col("kept_id") == F.col("contract_id")).select(*records.columns, "kept_id", "keep")


def match_stored(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """New documents (arrival, filename, content_hash) with duplicate_of (a stored contract with the same bytes) and the name that stays; of equal new ones the first to arrive counts."""
    known = stored.groupBy("content_hash").agg(F.min(F.struct("contract_id", "filename")).alias("s"))
    first = batch.groupBy("content_hash").agg(F.min(F.struct("arrival", "filename")).alias("f"))
    out = batch.join(known, "content_hash", "left").join(first, "content_hash")
    name = F.coalesce(F.col("s.filename"), F.col("f.filename"))
    return out.select("arrival", "content_hash", name.alias("filename"), F.col("s.contract_id").alias("duplicate_of"), (F.col("f.arrival") == F.col("arrival")).alias("first_copy"))


def fingerprint(clauses: DataFrame) -> DataFrame:
    """A hash of each contract's clause texts in order."""
    rows = F.array_sort(F.collect_list(F.struct("clause_id", "text")))
    return clauses.groupBy("contract_id").agg(F.sha2(F.to_json(rows), 256).alias("fingerprint"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """contract_id and change (added, removed, changed, same) by fingerprint. A changed contract loses its results."""
    a, b = fingerprint(old).withColumnRenamed("fingerprint", "_old"), fingerprint(new).withColumnRenamed("fingerprint", "_new")
    how = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "same").otherwise("changed")
    return a.join(b, "contract_id", "full").select("contract_id", how.alias("change"))


def reset_changed(records: DataFrame, changed: DataFrame) -> DataFrame:
    """Records with status `uploaded` where their clauses changed."""
    out = records.join(changed.where("change = 'changed'").select("contract_id", F.lit(True).alias("_c")), "contract_id", "left")
    return out.withColumn("status", F.when(F.col("_c"), "uploaded").otherwise(F.col("status"))).select(records.columns)


def keep_better_extraction(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """New facts, but old ones of a model where the new ones are a fallback (extraction_method), with a warning."""
    both = new.join(old.select("contract_id", *[F.col(c).alias(f"_o_{c}") for c in [*fields, "extraction_method"]]), "contract_id", "left")
    stay = F.coalesce((F.col("extraction_method") != "llm") & (F.col("_o_extraction_method") == "llm"), F.lit(False))
    kept = [F.when(stay, F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c) for c in [*fields, "extraction_method"]]
    warn = F.when(stay, F.array(F.lit("The previous extraction was kept: the model gave no result."))).otherwise(F.array().cast("array<string>"))
    return both.select("contract_id", *kept, warn.alias("extraction_warnings"))


def upsert(stored: DataFrame, new: DataFrame, key: str = "contract_id") -> DataFrame:
    """Stored rows with all rows of the new keys replaced."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(stored: DataFrame, gone: DataFrame, key: str = "contract_id") -> DataFrame:
    return stored.join(gone.select(key), key, "left_anti")


def due_for_analysis(records: DataFrame, changed: DataFrame, mode: str = "changed") -> DataFrame:
    """Contracts to analyse again (mode all, or changed: changed or never analysed), with whether their policy is stored (`has_policy`)."""
    out = records.join(changed.select("contract_id", "change"), "contract_id", "left")
    due = F.lit(True) if mode == "all" else F.coalesce(F.col("change") == "changed", F.lit(False)) | (F.col("status") != "analyzed")
    return out.where(due).select("contract_id", F.col("policy_id").isNotNull().alias("has_policy"))


def backfill(records: DataFrame, facts: DataFrame, force: bool = False) -> DataFrame:
    """contract_id and outcome (updated, failed, skipped): records without facts, or all, take those of `facts`."""
    out = records.join(facts.select("contract_id", F.lit(True).alias("_f")), "contract_id", "left")
    due = F.lit(force) | F.col("contract_about").isNull()
    return out.select("contract_id", F.when(~due, "skipped").when(F.col("_f"), "updated").otherwise("failed").alias("outcome"))


def outcome(results: DataFrame) -> DataFrame:
    """status and number of documents of a batch, with up to 20 names."""
    place = F.row_number().over(Window.partitionBy("status").orderBy("filename"))
    names = results.where(F.col("filename").isNotNull()).select("status", "filename").distinct().withColumn("_n", place).where(F.col("_n") <= 20)
    some = names.groupBy("status").agg(F.array_sort(F.collect_list("filename")).alias("some"))
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n")).join(some, "status", "left").withColumn("some", F.coalesce("some", F.array().cast("array<string>")))


def can_skip(change: Column, state: Column) -> Column:
    return (change == "same") & (state == "analyzed")


def warnings() -> Column:
    """Warnings of an upload from its columns duplicate_of, reprocessed, coverage_ok, ocr_error, index_error."""
    return F.array_compact(F.array(
        F.when(F.col("duplicate_of").isNotNull(), F.concat(F.lit("Same file as "), F.col("duplicate_of").cast("string"))),
        F.when(F.col("reprocessed"), "Replaced the stored version"), F.when(~F.col("coverage_ok"), "Part of the text is in no clause"),
        F.when(F.col("ocr_error").isNotNull(), F.concat(F.lit("OCR: "), F.col("ocr_error"))), F.when(F.col("index_error").isNotNull(), F.concat(F.lit("Not searchable: "), F.col("index_error"))),
    ))


def listing_status(files: DataFrame, most_bytes: int = 50 << 20) -> DataFrame:
    """path, length and status (accepted, skipped) of files; hidden and system files are left out, one of each path and size stays."""
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    seen = files.where(~name.rlike(r"^(\.|~\$|Thumbs\.db$|desktop\.ini$)")).dropDuplicates(["path", "length"])
    return seen.withColumn("status", F.when(F.lower(name).rlike(r"\.(pdf|txt)$") & (F.col("length") <= most_bytes), "accepted").otherwise("skipped"))


def lookup(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records of the contracts in `wanted` (contract_id)."""
    return records.join(wanted.select("contract_id").distinct(), "contract_id", "left_semi")


def newest_first(records: DataFrame) -> DataFrame:
    return records.orderBy(F.coalesce("updated_at", "created_at", F.lit("")).desc(), "contract_id")


@dataclass(frozen=True)
class Rebuilt:
    """The tables of a full rebuild."""

    outcome: DataFrame  # contract_id, outcome (duplicate, unreadable, rebuilt), n_clauses
    clauses: DataFrame  # contract_id, clause_id, text
    facts: DataFrame  # labelled facts of each contract
    passages: DataFrame  # contract_id, kind, passage_id, text, embedding
    due: DataFrame  # contracts to analyse again, with has_policy
    not_searchable: DataFrame  # contract_id of kept contracts without a passage


def rebuild_all(records: DataFrame, pages: DataFrame, stored: DataFrame, mode: str = "changed", embed: Callable[[DataFrame], DataFrame] | None = None) -> Rebuilt:
    """Everything anew from the pages (contract_id, page_no, text) of the records that stay: parts, facts, passages with embeddings (words in buckets, or a user's `embed`), and what must be analysed again.

    records: contract_id, content_hash, updated_at, status, policy_id; stored: contract_id, clause_id, text as of before.
    """
    from .facts import labelled_facts
    from .parsing import join_pages, split_document, strip_furniture
    from .retrieval import embed_words

    kept = exact_duplicates(records)
    stays = kept.where("keep")
    docs = join_pages(strip_furniture(pages.join(stays.select("contract_id"), "contract_id", "left_semi")))
    parts = split_document(docs)
    clauses = parts.where("kind = 'clause'").select("contract_id", "clause_id", "text")
    passages = (embed or embed_words)(parts.select("contract_id", "kind", F.when(F.col("kind") == "header", "header").otherwise(F.col("clause_id").cast("string")).alias("passage_id"), "text"))
    change = changes(stored.join(stays.select("contract_id"), "contract_id", "left_semi"), clauses)
    n = clauses.groupBy("contract_id").agg(F.count(F.lit(1)).alias("n_clauses"))
    out = kept.join(n, "contract_id", "left").withColumn("n_clauses", F.coalesce("n_clauses", F.lit(0)))
    how = F.when(~F.col("keep"), "duplicate").when(F.col("n_clauses") == 0, "unreadable").otherwise("rebuilt")
    return Rebuilt(
        out.select("contract_id", how.alias("outcome"), "n_clauses"), clauses, labelled_facts(docs), passages,
        due_for_analysis(stays, change, mode), stays.select("contract_id").join(parts.select("contract_id"), "contract_id", "left_anti"),
    )


def rebuild(records: DataFrame, pages: DataFrame) -> DataFrame:
    """One outcome for each contract of a full rebuild: duplicate, unreadable (no clause) or rebuilt with its number of clauses."""
    from .parsing import join_pages, split_document, strip_furniture

    kept = exact_duplicates(records)
    wanted = pages.join(kept.where("keep").select("contract_id"), "contract_id", "left_semi")
    parts = split_document(join_pages(strip_furniture(wanted))).where("kind = 'clause'").groupBy("contract_id").agg(F.count(F.lit(1)).alias("n_clauses"))
    out = kept.join(parts, "contract_id", "left").withColumn("n_clauses", F.coalesce("n_clauses", F.lit(0)))
    return out.select("contract_id", F.when(~F.col("keep"), "duplicate").when(F.col("n_clauses") == 0, "unreadable").otherwise("rebuilt").alias("outcome"), "n_clauses")


