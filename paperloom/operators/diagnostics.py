"""Data-quality rules. Rules that look at one row at a time give an array of
findings. Rules over a paper are windows on questions and papers that are dealt by
paper once: a row carries what its place in each order tells, and one pass at the
end explodes what each row has found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import text_key, trimmed
from .dealing import dealt

DIAGNOSTIC = ["paper_id", "code", "severity", "message", "page", "question"]
DECLARED = ["total_questions", "total_pages", "declared_total_marks", "declared_question_count", "declared_sections"]
FOUND = "array<struct<code:string,severity:string,message:string,page:int,question:string>>"
SHORTEST_TEXT, LEAST_CONFIDENCE, GAPS_SHOWN = 3, 0.5, 12


def finding(code: str, severity: str, message: Column | str, page: Column | None = None, question: Column | None = None) -> list[Column]:
    said = message if isinstance(message, Column) else F.lit(message)
    return [F.col("paper_id").cast("string").alias("paper_id"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), said.alias("message"), (page if page is not None else F.lit(None)).cast("int").alias("page"), (question if question is not None else F.lit(None)).cast("string").alias("question")]


def no_questions(papers: DataFrame, questions: DataFrame) -> DataFrame:
    return papers.select("paper_id").join(questions.select("paper_id"), "paper_id", "left_anti").select(*finding("no_questions", "error", "no question was found"))


def broken_rules() -> Column:
    """Findings of the rules on one question: number, text, page, type, marks,
    options, figure."""
    said, marks, options = F.coalesce(F.col("text"), F.lit("")), F.col("marks"), F.col("options")
    blank, size = ~said.rlike(r"\S"), F.coalesce(F.when(options.isNull(), 0).otherwise(F.size(options)), F.lit(0))
    tests = [
        ("missing_number", "error", ~F.coalesce(F.col("number"), F.lit("")).rlike(r"\S")),
        ("empty_text", "error", blank),
        ("suspiciously_short_text", "warning", (F.length(trimmed(said)) < SHORTEST_TEXT) & ~blank),
        ("invalid_page", "error", F.col("page") < 1),
        ("invalid_type", "error", ~F.coalesce(F.col("type").isin(*P.TYPES), F.lit(False))),
        ("invalid_marks", "error", (marks < 0) | (marks > P.MAX_MARKS)),
        ("empty_options", "warning", options.isNotNull() & (size == 0)),
        ("mcq_without_options", "warning", (F.col("type") == "mcq") & (size == 0)),
        ("figure_without_reference", "warning", F.coalesce(F.col("has_figure"), F.lit(False)) & ~F.col("text").rlike(P.FIGURE_REF)),
    ]

    def found(code: str, severity: str) -> Column:
        said = F.concat(F.lit("question "), F.coalesce("number", F.lit("?")), F.lit(f": {code}"))
        return F.struct(*finding(code, severity, said, F.col("page"), F.col("number"))[1:])

    none = F.array().cast(FOUND)
    any_of = reduce(Column.__or__, (F.coalesce(test, F.lit(False)) for *_, test in tests))  # most rows have none, and need no array
    rules = F.when(any_of, F.filter(F.array(*(F.when(test, found(c, s)) for c, s, test in tests)), lambda x: x.isNotNull())).otherwise(none)
    blanks = F.transform(F.filter(options, lambda o: F.coalesce(trimmed(o) == "", F.lit(True))), lambda _: found("invalid_option", "error"))
    return F.concat(rules, F.when(size > 0, blanks).otherwise(none))


def row_rules(questions: DataFrame) -> DataFrame:
    """Findings of the rules on one question."""
    return questions.select(F.col("paper_id").cast("string").alias("paper_id"), F.explode(broken_rules()).alias("f")).select("paper_id", "f.*")


def met(papers: DataFrame, questions: DataFrame, size: int | None = None) -> DataFrame:
    """Questions and papers (`whole`: with what they declare) as rows of one table,
    dealt by paper to as many tasks as `size` rows need, if it is given."""
    paper_id = F.col("paper_id").cast("string").alias("paper_id")
    asked = questions.select(paper_id, "question_index", "number", "section", "page", "marks", text_key(F.col("text")).alias("key"), broken_rules().alias("broken"), F.lit(False).alias("whole"))
    rows = asked.unionByName(papers.select(paper_id, *DECLARED, F.lit(True).alias("whole")), allowMissingColumns=True)
    return rows if size is None else dealt(rows, "paper_id", size=size)


def repeated(key: str, *finer: str) -> Column:
    """A key that a paper has more than once and its pages, at its first row."""
    by = Window.partitionBy("paper_id", key).orderBy(*finer, "question_index")
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pages = F.array_join(F.sort_array(F.collect_set("page").over(every)).cast("array<string>"), ", ")
    again = (F.col(key) != "") & (F.row_number().over(by) == 1) & (F.count("*").over(every) > 1)
    return F.when(again, F.struct(F.col(key).alias("key"), F.concat(F.lit("on pages "), pages).alias("pages")))


def numbering(rows: DataFrame) -> DataFrame:
    """Repeated numbers; n, a number where it is first met; below, the next smaller
    one; missing, the first numbers between them (however wide the gaps)."""
    rows = rows.withColumn("label", trimmed(F.col("number")))
    before = F.lag("number").over(Window.partitionBy("paper_id", "label").orderBy("number", "question_index"))
    first = F.coalesce(before != F.col("number"), F.lit(True))
    rows = rows.withColumns({"n": F.when(F.col("number").rlike("^[0-9]{1,9}$") & first, F.col("number").cast("int")), "same_number": repeated("label", "number")})
    by = Window.partitionBy("paper_id").orderBy("n")
    low = F.min("n").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumns({"below": F.lag("n").over(by), "low": low, "rank": F.dense_rank().over(by)})
    skipped = F.col("below") - F.col("low") + 2 - F.col("rank")  # at least so many are missing below this gap, or one more
    shown = F.sequence(F.col("below") + 1, F.least(F.col("n") - 1, F.col("below") + GAPS_SHOWN))
    return rows.withColumn("missing", F.when((F.col("n") - F.col("below") > 1) & (skipped < GAPS_SHOWN), shown))


def ordering(rows: DataFrame) -> DataFrame:
    """leads, a paper's first question; falls, a number after a larger one; returns,
    a section's first question after another section, if it was there before."""
    has = F.coalesce(F.col("section"), F.lit("")) != ""
    again = F.row_number().over(Window.partitionBy("paper_id", "section").orderBy("question_index")) > 1
    rows = rows.withColumns({"has": has, "again": has & again})
    order = Window.partitionBy("paper_id").orderBy("question_index")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    section = F.last(F.when(F.col("has"), F.col("section")), ignorenulls=True).over(earlier)
    asked = F.count_if(~F.col("whole")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumns({"leads": ~F.col("whole") & (asked == 1), "falls": F.last("n", ignorenulls=True).over(earlier) > F.col("n"), "returns": F.col("again") & (section != F.col("section"))})


def totals(rows: DataFrame) -> DataFrame:
    """What a paper's questions sum up to, and what it declares of sections and
    pages, at each of its rows. The sum is that of the known marks, even if some are
    unknown; rows without a paper have none."""
    paper, col, known = Window.partitionBy("paper_id"), F.col, F.col("paper_id").isNotNull()
    sums = {
        "asked": F.count_if(~col("whole")), "known": F.count("marks"), "sum": F.sum("marks"), "first_page": F.min("page"), "sectioned": F.count_if("has"),
        "any_falls": F.bool_or("falls"), "spelled": F.count("n"), "values": F.count_if(col("n").isNotNull() & F.coalesce(col("n") != col("below"), F.lit(True))),
        "gaps": F.collect_list("missing"), "last_page": F.min("total_pages"), "stated": F.collect_list("declared_sections"),
    }
    rows = rows.withColumns({name: c.over(paper) for name, c in sums.items()})
    return rows.withColumns({"last_page": F.when(known, col("last_page")), "stated": F.when(known, F.flatten("stated")), "joined": F.when(known, col("asked")).otherwise(0)})


def paper_rules(papers: DataFrame, questions: DataFrame, source: str = "pdf", size: int | None = None) -> DataFrame:
    """Findings of all rules on questions and papers. Repeats are errors in a
    printed paper, warnings in one read from images."""
    rows = met(papers, questions, size)
    rows = totals(ordering(numbering(rows.withColumn("same_text", repeated("key")))))
    col, leads, declares = F.col, F.col("leads"), F.col("whole") & (F.col("joined") > 0)
    repeats = "warning" if source == "image" else "error"
    shown = F.slice(F.sort_array(F.flatten("gaps")), 1, GAPS_SHOWN).cast("array<string>")

    def found(code: str, severity: str, test: Column, message: Column | str | None = None, page: Column | None = None, question: Column | None = None) -> Column:
        return F.when(test, F.struct(*finding(code, severity, code if message is None else message, page, question)[1:]))

    at = (col("page"), col("number"))
    tests = [
        found("no_questions", "error", col("whole") & (col("joined") == 0), "no question was found"),
        found("duplicate_number", repeats, col("same_number").isNotNull(), col("same_number.pages"), None, col("same_number.key")),
        found("duplicate_text", repeats, col("same_text").isNotNull(), col("same_text.pages"), None, col("same_text.key")),
        found("impossible_ordering", "error", leads & col("any_falls"), "numbers do not ascend"),
        found("numbering_starts_above_one", "warning", leads & (col("low") != 1) & (col("values") == col("spelled")), F.concat(F.lit("starts at "), col("low").cast("string"))),
        found("numbering_gap", "warning", leads & (F.size("gaps") > 0), F.concat(F.lit("missing "), F.array_join(shown, ", "))),
        found("partial_sections", "warning", leads & (col("sectioned") > 0) & (col("sectioned") < col("asked")), "some questions have no section"),
        found("inconsistent_section", "error", col("has") & (F.size("stated") > 0) & ~F.coalesce(F.array_contains("stated", col("section")), F.lit(False)), F.concat(F.lit("undeclared section "), col("section")), *at),
        found("section_reappears", "warning", col("returns"), F.concat(F.lit("section "), col("section"), F.lit(" returns")), *at),
        found("unknown_marks", "warning", declares & (col("known") < col("joined"))),
        found("marks_total_unknown", "warning", declares & col("declared_total_marks").isNotNull() & (col("known") == 0)),
        found("marks_total_mismatch", "warning", declares & (col("known") > 0) & (col("sum") != col("declared_total_marks"))),
        found("question_count_mismatch", "warning", declares & (col("declared_question_count") != col("joined"))),
        found("total_questions_mismatch", "error", declares & (col("total_questions") != col("joined"))),
        found("no_question_on_first_page", "warning", declares & (col("first_page") != 1)),
        found("page_out_of_range", "error", col("page") > col("last_page"), "page beyond the last", *at),
    ]
    broken = F.coalesce("broken", F.array().cast(FOUND))
    return rows.select("paper_id", F.explode(F.concat(F.array(*tests), broken)).alias("f")).where("f is not null").select("paper_id", "f.*")


def low_confidence(confidences: DataFrame) -> DataFrame:
    """confidences: (paper_id, number, confidence)."""
    return confidences.where(F.col("confidence") < LEAST_CONFIDENCE).select(*finding("low_confidence", "warning", "read with little confidence", None, F.col("number")))


def parser_findings(parsed: DataFrame) -> DataFrame:
    """What the parser put aside, as warnings."""
    rejected = parsed.select("paper_id", F.explode("rejected").alias("line")).select(*finding("rejected_question_candidate", "warning", F.col("line")))
    return rejected.unionByName(parsed.where("strategy = 'relaxed'").select(*finding("parser_note", "warning", "numbers do not follow one another; read relaxed")))


def report(papers: DataFrame, questions: DataFrame, source: str = "pdf", confidences: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """All diagnostics. papers: paper_id, total_questions, total_pages,
    declared_total_marks, declared_question_count, declared_sections. size: rows of
    both, where they are known; they are dealt to as many tasks as they need."""
    parts = [paper_rules(papers, questions, source, size)]
    if confidences is not None:
        parts.append(low_confidence(confidences))
    return reduce(DataFrame.unionByName, (p.select(*DIAGNOSTIC) for p in parts))


def gate(papers: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(paper_id, errors, warnings, ok) for every paper."""
    counts = diagnostics.groupBy("paper_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    rows = papers.select(F.col("paper_id").cast("string").alias("paper_id")).join(counts, "paper_id", "left").fillna(0, ["errors", "warnings"])
    return rows.withColumn("ok", F.col("errors") == 0)


class InvalidPapers(ValueError):
    """Papers with errors; its text names the first of them."""


def raise_if_invalid(diagnostics: DataFrame, shown: int = 5) -> None:
    bad = diagnostics.where("severity = 'error'").select("paper_id", "code").limit(shown).collect()
    if bad:
        raise InvalidPapers("; ".join(f"{r.paper_id}: {r.code}" for r in bad))
