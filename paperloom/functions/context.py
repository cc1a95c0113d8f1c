"""What a provider is told of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The keys of the context and the column that each is read from.
KEYS = {
    "question_number": "number", "question_text": "text", "marks": "marks", "options": "options", "has_figure": "has_figure", "section": "section", "section_title": "section_title",
    "chapter": "chapter", "figure_interpretation": "figure_interpretation", "tool_results": "tool_results", "subject": "subject", "class_name": "class_name", "board": "board",
}
UNSTATED = {"question_number": "?", "question_text": "", "has_figure": False}


def question_context(df: DataFrame) -> Column:
    """The JSON object of all KEYS, in this order, without white space; a key
    whose column df lacks or that is null is null, or what UNSTATED says."""

    def value(key: str) -> Column:
        found = F.col(KEYS[key]) if KEYS[key] in df.columns else F.lit(None).cast("boolean" if key == "has_figure" else "string")
        return (F.coalesce(found, F.lit(UNSTATED[key])) if key in UNSTATED else found).alias(key)

    return F.to_json(F.struct(*map(value, KEYS)), {"ignoreNullFields": "false"})
