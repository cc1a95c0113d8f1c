"""Deterministic identities: exact, never fuzzy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_text

VERSION, UNIT_SEPARATOR = "v2", "␟"


def file_fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def paper_id(fingerprint: Column) -> Column:
    return F.concat(F.lit("pap_"), F.substring(fingerprint, 1, 8))


def work_item_id(paper: Column, index: Column) -> Column:
    return F.format_string("%s:q:%04d", paper, index)


def question_signature(text: Column, marks: Column | None = None, board: Column | None = None, class_name: Column | None = None, subject: Column | None = None, options: Column | None = None, has_figure: Column | None = None) -> Column:
    """SHA-256 over the eight parts; what is missing has its default, so that
    null marks and 0 are one (part of the contract)."""
    given = lambda c, default: F.coalesce(c, F.lit(default)) if c is not None else F.lit(default)
    board = F.when(given(board, "") == "", "CBSE").otherwise(given(board, ""))
    listed = F.array_join(F.transform(F.coalesce(options, F.array().cast("array<string>")), normalize_text), UNIT_SEPARATOR) if options is not None else F.lit("")
    parts = [F.lit(VERSION), normalize_text(text), given(marks, 0).cast("string"), F.upper(F.trim(board)), F.lower(F.trim(given(class_name, ""))), F.lower(F.trim(given(subject, ""))), listed, F.concat(F.lit("figure="), F.when(given(has_figure, False), "1").otherwise("0"))]
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)
