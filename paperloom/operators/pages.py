"""Pages of lines: running heads and footers, classes, header facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import extract, is_furniture, normalise, trimmed
from .dealing import dealt


def without_furniture(lines: DataFrame, share: float = 0.6, size: int | None = None, placed: bool = False) -> DataFrame:
    """lines (paper_id, page, line_no, text) without blank lines and, in papers
    of two pages or more, without what is printed on most of the pages: a line
    on `share` of them (two at least), short, near the top or bottom, and no
    bare number, question start or finished sentence. size: about how many lines
    there are, where it is known. Lines that are dealt by paper (placed) aren't
    dealt or counted again."""
    kept = lines.withColumn("text", normalise(F.col("text"))).where("text <> ''")
    kept = kept if placed else dealt(kept, "paper_id", size=lines.count() if size is None else size)
    # dealt once: all windows are inside a paper. Longer lines are no running heads, whatever they repeat
    paper, page = Window.partitionBy("paper_id"), Window.partitionBy("paper_id", "page")
    # pages are told by their first line, so that no row holds a set of them
    rows = kept.withColumn("from_top", F.row_number().over(page.orderBy("line_no"))).withColumn("in_page", F.count("*").over(page))
    rows = rows.withColumn("pages", F.sum(((F.col("from_top") == 1) & F.col("page").isNotNull()).cast("int")).over(paper))
    # only papers of two pages or more have running heads; the rest stays in its order
    short = F.when((F.col("pages") > 1) & (F.length("text") <= P.RUNNING_HEAD), F.col("text"))
    wording = Window.partitionBy("paper_id", "short")
    rows = rows.withColumn("short", short).withColumn("again", F.lag("page").over(wording.orderBy("page")))
    rows = rows.withColumn("on_pages", F.sum((~F.col("page").eqNullSafe(F.col("again"))).cast("int")).over(wording))
    least = F.greatest(F.lit(2), F.ceil(F.col("pages") * share))
    text = F.col("text")
    band = (F.col("from_top") <= P.BAND) | (F.col("from_top") > F.col("in_page") - P.BAND)
    running = (F.col("on_pages") >= least) & (F.length("text") <= P.RUNNING_HEAD) & ~text.rlike(P.BARE_NUMBER) & ~text.rlike(P.QUESTION_START) & ~text.rlike(P.SENTENCE_END) & band
    return rows.where((F.col("pages") < 2) | ~(is_furniture(text) | running)).select("paper_id", "page", "line_no", "text")


HEADER = {"subject": P.SUBJECT, "class": P.CLASS, "time_allowed": P.TIME_ALLOWED, "total_marks": P.TOTAL_MARKS}


def header_facts(lines: DataFrame, *also: Column) -> DataFrame:
    """One row for each paper: the first line that states a fact states it; the
    board only counts at the end of a line that also has the total marks. also:
    aggregates of page and line_no to tell in the same pass."""
    text, at = F.col("text"), F.struct("page", "line_no")
    facts = {k: F.when(text.rlike(p), trimmed(F.regexp_extract(text, p, 1))) for k, p in HEADER.items()}
    facts["board"] = F.when(text.rlike(P.TOTAL_MARKS), extract(text, P.BOARD_TAIL))
    first = [F.nullif(F.min_by(F.col(k), F.when(F.col(k).isNotNull(), at)), F.lit("")).alias(k) for k in facts]
    out = lines.select("paper_id", "page", "line_no", *(v.alias(k) for k, v in facts.items())).groupBy("paper_id").agg(*first, *also)
    return out.withColumn("total_marks", F.nullif(F.col("total_marks").cast("int"), F.lit(0)))


def header_view(lines: DataFrame) -> DataFrame:
    """(paper_id, subject, class, board): who a paper is for."""
    return header_facts(lines).select("paper_id", "subject", "class", "board")


def paper_rollup(questions: DataFrame) -> DataFrame:
    """(paper_id, total_questions, total_marks, sections): sections in order of
    first appearance; marks are the sum where every question has some, else null:
    null isn't 0."""
    parts = questions.groupBy("paper_id", "section").agg(F.min("question_index").alias("at"), F.count("*").alias("n"), F.count("marks").alias("known"), F.sum("marks").alias("total"))
    named = F.when(F.col("section") != "", F.struct("at", "section"))
    sections = F.transform(F.array_sort(F.collect_list(named)), lambda x: x["section"])
    return parts.groupBy("paper_id").agg(F.sum("n").cast("int").alias("total_questions"), F.when(F.sum("n") == F.sum("known"), F.sum("total")).alias("total_marks"), sections.alias("sections"))
