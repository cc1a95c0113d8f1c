"""Line and text functions over columns. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def trimmed(col: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def normalise(col: Column) -> Column:
    """No-break space to space, then trimmed."""
    return trimmed(F.translate(col, "\u00a0", " "))


def extract(col: Column, pattern: str, group: int = 1) -> Column:
    """A group's text; null where nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def is_section(line: Column) -> Column:
    return line.rlike(P.SECTION) & (F.length(line) <= P.MAX_HEADING)


def is_attempt(line: Column) -> Column:
    return line.rlike(P.ATTEMPT_START) & line.rlike(P.ATTEMPT_SHAPE)


def is_furniture(line: Column) -> Column:
    return line.rlike(P.QNO_HEADER) | line.rlike(P.PAGE_FOOTER)


def line_class(text: Column) -> Column:
    """The first class whose test holds, in this order."""
    line = normalise(text)
    tests = (("blank", line == ""), ("furniture", is_furniture(line)), ("chapter", line.rlike(P.CHAPTER_TAG)), ("section", is_section(line)), ("instruction", is_attempt(line)), ("or", line.rlike(P.OR_SEPARATOR)), ("bare_number", line.rlike(P.BARE_NUMBER)), ("instructions_heading", line.rlike(P.INSTRUCTIONS_HEADING)), ("question", line.rlike(P.QUESTION_START)))
    out = F
    for name, test in tests:
        out = out.when(test, name)
    return out.otherwise("content")


def is_instruction(text: Column) -> Column:
    """Whether line_class is instruction. Most lines don't start like one, and are
    tried for nothing else; one that does can't be of the classes before it."""
    return text.rlike(P.ATTEMPT_OPENING) & is_attempt(normalise(text))


def section_label(line: Column) -> Column:
    return extract(line, P.SECTION, 1)


def section_title(line: Column) -> Column:
    return extract(line, P.SECTION, 2)


def declared_count(line: Column) -> Column:
    """Questions that an instruction says are to be answered."""
    return F.coalesce(extract(line, P.DECLARED_ALL), extract(line, P.DECLARED_PICK)).cast("int")


def carried_marks(line: Column) -> Column:
    return extract(line, P.CARRIED_MARKS).cast("int")


def option_groups(text: Column) -> Column:
    """Options of a line that starts with a bracket, labels kept."""
    line = normalise(text)
    parts = F.filter(F.split(line, r"(?=\([A-H]\))", -1), lambda x: x.rlike(r"^\([A-H]\)"))
    tidy = F.transform(parts, lambda x: trimmed(F.concat(F.substring(x, 1, 3), F.lit(" "), trimmed(F.substring(x, F.lit(4), F.length(x))))))
    return F.when(line.startswith("("), tidy).otherwise(F.array().cast("array<string>"))


def joined(col: Column) -> Column:
    return trimmed(F.regexp_replace(col, r"\s+", " "))


def figure_flag(text: Column) -> Column:
    return text.rlike(P.FIGURE_REF) | text.rlike(P.FIGURE_BELOW)


def question_type(text: Column, options: Column, marks: Column) -> Column:
    return F.when(F.coalesce(F.size(options), F.lit(0)) > 0, "mcq").when(text.rlike(P.CASE_STUDY), "long").when(marks >= 5, "long").when(text.rlike(P.NUMERICAL_HINTS), "numerical").otherwise("short")


def trailing_marks(line: Column) -> Column:
    """Marks printed after a sentence, from 1 to MAX_MARKS."""
    n = extract(line, P.TRAILING_MARKS, 2).cast("int")
    return F.when(n.between(1, P.MAX_MARKS), n)


def promotable(text: Column) -> Column:
    """Whether a rejected start is worth a second, relaxed pass."""
    line = normalise(text)
    body = F.regexp_extract(line, P.QUESTION_START, 3)
    return ~line.rlike(P.BARE_NUMBER) & line.rlike(P.QUESTION_START) & body.rlike("[A-Za-z]{3,}") & ~body.rlike(P.UNIT_LEAD) & ((F.length(body) >= 25) | body.rlike(r"[A-Za-z]{3,}\s+\S+\s+\S"))


def normalize_text(text: Column) -> Column:
    """The form of a text that its identity is taken from."""
    t = F.translate(F.lower(F.coalesce(text, F.lit(""))), "“”‘’—–−", "\"\"''---")
    t = F.regexp_replace(t, P.QUESTION_LABEL, "")
    t = joined(F.translate(t, "\u00a0", " "))
    return F.regexp_replace(t, r"[.:\s]+$", "")


def text_key(text: Column, size: int = 160) -> Column:
    """Lower-case letters and digits; empty keys are no identity."""
    return F.substring(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", ""), 1, size)


def strip_fences(text: Column) -> Column:
    """A fenced block's body, else the trimmed text."""
    return F.coalesce(extract(text, r"(?s)```[A-Za-z]*\s*\n?(.*?)\s*```"), trimmed(text))
