"""Solution payloads: structure, and an operational confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOLUTION = "question_number string, answer string, steps array<string>, mark_split array<struct<marks:int,`for`:string>>, common_mistakes array<struct<wrong:string,why:string>>"
STORE_LEAST = CACHE_LEAST = 0.90


def strictly(col: Column) -> Column:
    """Only a literal true counts."""
    return F.coalesce(col, F.lit(False))


def blank(col: Column) -> Column:
    return F.coalesce(F.trim(col) == "", F.lit(True))


def split_total(mark_split: Column) -> Column:
    return F.aggregate(mark_split, F.lit(0), lambda total, x: total + F.coalesce(x["marks"], F.lit(0)))


def payload_errors(answer: Column, steps: Column, mark_split: Column, mistakes: Column, marks: Column) -> Column:
    """All errors of a payload, in this order; an empty array if it is sound."""
    named = lambda name, col, bad, text: F.transform(F.filter(F.transform(col, lambda x, i: F.struct(bad(x).alias("bad"), i.alias("i"))), lambda x: x["bad"]), lambda x: F.concat(F.lit(f"{name}["), x["i"].cast("string"), F.lit(f"] {text}")))
    total = split_total(mark_split)
    single = [
        F.when(blank(answer), "no answer"),
        F.when(steps.isNull() | F.exists(steps, blank), "steps missing or blank"),
        F.when(mark_split.isNull(), "no mark_split"),
        F.when(marks.isNotNull() & (F.size(mark_split) > 0) & (total > marks), F.concat(F.lit("mark_split adds up to "), total.cast("string"), F.lit(" of "), marks.cast("string"))),
        F.when(mistakes.isNull(), "no common_mistakes"),
    ]
    none = F.array().cast("array<string>")
    items = [
        F.coalesce(named("mark_split", mark_split, lambda x: F.coalesce(x["marks"] < 0, F.lit(True)) | x["for"].isNull(), "has no marks of 0 or more, or no for"), none),
        F.coalesce(named("common_mistakes", mistakes, lambda x: x["wrong"].isNull() | x["why"].isNull(), "lacks wrong or why"), none),
    ]
    return F.concat(F.filter(F.array(*single), lambda x: x.isNotNull()), *items)


def confidence(answer: Column, steps: Column, mark_split: Column, marks: Column, structure: Column, review: Column, independent: Column, status: Column) -> Column:
    """A conservative score: signals add up, an unpassed check caps it."""
    worth = lambda test, points: F.when(strictly(test), points).otherwise(0)
    hundredths = 25 + worth(~blank(answer), 15) + worth(F.size(steps) > 0, 10) + worth(marks.isNotNull() & (F.size(mark_split) > 0) & (split_total(mark_split) <= marks), 10) + worth(structure, 10) + worth(review, 20) + worth(independent, 10)
    capped = F.when(F.coalesce(status, F.lit("")) == "passed", hundredths).otherwise(F.least(hundredths, F.lit(59)))
    return F.greatest(F.lit(0), F.least(capped, F.lit(99))) / 100
