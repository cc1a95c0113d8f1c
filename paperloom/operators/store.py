"""Solved papers and questions: lookup, reuse, resume, upsert.

Tables are DataFrames. Lookups are equi-joins on a key; what is best or latest
for a key is an aggregation (max_by), not a sort. Writes give the new snapshot,
which the caller swaps in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import CACHE_LEAST


def eligible() -> Column:
    """Rows that a lookup may reuse."""
    return (~F.coalesce("needs_teacher_check", F.lit(True))) & (F.coalesce("verification_status", F.lit("")) == "passed") & F.col("model_used").isNotNull() & F.col("prompt_version").isNotNull() & F.col("confidence").isNotNull()


def cache_lookup(items: DataFrame, solved: DataFrame) -> DataFrame:
    """items (question_signature, ...) with cache_status and the cached row's
    id, answer, confidence and verified_by."""
    row = F.struct("confidence", "id", F.struct("answer", "model_used", "prompt_version", "verified_by").alias("row"))
    best = solved.where(eligible()).groupBy("question_signature").agg(F.max(row).alias("top"))
    best = best.select("question_signature", F.col("top.id").alias("cached_id"), F.col("top.row.answer").alias("cached_answer"), F.col("top.confidence").alias("cached_confidence"), "top.row.model_used", "top.row.prompt_version", F.concat(F.lit("cache:signature:"), F.coalesce("top.row.verified_by", F.lit("db"))).alias("cached_by"))
    hit = (F.col("cached_confidence") >= CACHE_LEAST) & (F.coalesce("cached_answer", F.lit("")) != "") & (F.col("model_used") != "") & (F.col("prompt_version") != "")
    hit = F.coalesce(hit, F.lit(False))
    kept = [F.when(hit, F.col(c)).alias(c) for c in ("cached_id", "cached_answer", "cached_confidence", "cached_by")]
    return items.join(best, "question_signature", "left").select(*items.columns, F.when(hit, "hit").otherwise("miss").alias("cache_status"), *kept)


def paper_gate(papers: DataFrame, solved: DataFrame) -> DataFrame:
    """(paper_id, hit): a ready paper whose every expected question has a
    reusable, confident row."""
    sound = eligible() & (F.col("model_used") != "") & (F.col("prompt_version") != "") & (F.col("confidence") >= CACHE_LEAST)
    rows = solved.groupBy("paper_id").agg(F.count("*").alias("rows"), F.bool_and(F.coalesce(sound, F.lit(False))).alias("sound"))
    hit = (F.col("status") == "ready") & F.col("sound") & (F.col("rows") == F.coalesce("total_questions", F.lit(0)))
    return papers.join(rows, "paper_id", "left").select("paper_id", F.coalesce(hit, F.lit(False)).alias("hit"))


def paper_by_fingerprint(papers: DataFrame, wanted: DataFrame) -> DataFrame:
    return papers.where("status = 'ready'").join(wanted.select("fingerprint"), "fingerprint", "left_semi")


def payload(papers: DataFrame, solved: DataFrame) -> DataFrame:
    """(paper_id, total_questions, solutions) of papers that pass the gate."""
    hits = paper_gate(papers, solved).where("hit").select("paper_id")
    rows = solved.join(hits, "paper_id", "left_semi").withColumn("by", F.concat(F.lit("cache:paper_fingerprint:"), F.coalesce("verified_by", F.lit("db"))))
    return rows.groupBy("paper_id").agg(F.count("*").alias("total_questions"), F.array_sort(F.collect_list(F.struct("id", "question_number", "answer", "confidence", F.col("by").alias("verified_by")))).alias("solutions"))


def remaining(items: DataFrame, solved: DataFrame) -> DataFrame:
    """Work that no checkpoint holds yet."""
    return items.join(solved.select("paper_id", "work_item_id"), ["paper_id", "work_item_id"], "left_anti")


def resume_rows(solved: DataFrame, papers: DataFrame) -> DataFrame:
    """What is solved already of papers (paper_id): rows to go on with, told to be
    from a checkpoint; what they lack is empty."""
    rows = solved.join(papers.select("paper_id"), "paper_id", "left_semi")
    empty = {c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c) for c in ("steps", "mark_split", "common_mistakes") if c in rows.columns}
    by = F.concat(F.lit("checkpoint:"), F.coalesce("verified_by", F.lit("db"))).alias("verified_by")
    return rows.select("paper_id", "id", "question_number", "answer", *empty.values(), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), by, "needs_teacher_check")


def first_questions(questions: DataFrame, n: int) -> DataFrame:
    """The first n of each paper in document order."""
    return questions.where(F.col("question_index") < n)


def without_papers(papers: DataFrame, solved: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the papers of gone: children go with their paper."""
    keys = gone.select("paper_id")
    return papers.join(keys, "paper_id", "left_anti"), solved.join(keys, "paper_id", "left_anti")


def given(col: Column) -> Column:
    """Null for what an update doesn't state: null, empty, zero."""
    return F.when(col.cast("string").isin("", "0", "0.0"), None).otherwise(col)


def upsert_papers(papers: DataFrame, updates: DataFrame, key: str = "paper_id", always: tuple[str, ...] = ("status",)) -> DataFrame:
    """updates over papers: an update's status always counts, its other fields
    where they state something; new keys are inserted."""
    rest = [c for c in papers.columns if c != key]
    old, new = papers.select(key, F.struct(*rest).alias("old")), updates.select(key, F.struct(*rest).alias("new"))

    def merged(c: str) -> Column:
        o, n = F.col("old")[c], F.col("new")[c]
        return F.when(F.col("new").isNull(), o).when(F.col("old").isNull() | F.lit(c in always), n).otherwise(F.coalesce(given(n), o)).alias(c)

    return old.join(new, key, "full_outer").select(key, *(merged(c) for c in rest))


def mark_status(papers: DataFrame, marks: DataFrame) -> DataFrame:
    """marks (paper_id, status): absent papers are left out."""
    new = marks.select("paper_id", F.col("status").alias("new_status"))
    return papers.join(new, "paper_id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The whole row that is last by `order` for each key."""
    rest = [c for c in rows.columns if c not in keys]
    top = F.max(F.struct(*order, F.struct(*rest).alias("row")))
    return rows.groupBy(*keys).agg(top.alias("top")).select(*keys, *(F.col("top.row")[c].alias(c) for c in rest))


def upsert_checkpoints(solved: DataFrame, batch: DataFrame) -> DataFrame:
    """Full overwrite by (paper, work item), or (paper, number) where an item
    has no id; unknown marks are 0, teacher checks default to true."""
    def tidy(df: DataFrame, age: int) -> DataFrame:
        key = F.coalesce("work_item_id", F.concat(F.lit("#"), F.col("question_number")))
        return df.withColumns({"marks": F.coalesce("marks", F.lit(0)), "needs_teacher_check": F.coalesce("needs_teacher_check", F.lit(True)), "upsert_key": key, "upsert_age": F.lit(age)})

    both = tidy(solved, 0).unionByName(tidy(batch, 1))
    return latest(both, ["paper_id", "upsert_key"], ["upsert_age", "id"]).drop("upsert_key", "upsert_age")
