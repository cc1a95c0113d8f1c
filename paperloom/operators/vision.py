"""Items read from page images: from model JSON to questions without repeats.

Order decides what "first" means, so every item carries its place `idx` in its
paper. Items of one key are folded in that order inside one array expression;
keys are a paper's, so the arrays stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import shapes as H
from ..functions.text import joined, strip_fences, text_key, trimmed
from . import diagnostics

SCHEMA_INVALID = "schema_invalid"

#: What a reply's item should hold. Fields not in STRICT are read whatever they
#: hold: numbers as texts, anything but nothing as true.
EXPECTED = {
    "question_number": (H.STRING, H.NUMBER), "question_text": (H.STRING, H.NULL), "marks": (H.NUMBER, H.STRING, H.NULL), "question_type": (H.STRING, H.NULL), "options": (H.ARRAY, H.NULL), "options[]": (H.STRING,),
    "confidence": (H.NUMBER, H.NULL), "section": (H.STRING, H.NUMBER, H.NULL), "has_figure": (H.BOOLEAN, H.NULL), "choice_group": (H.STRING, H.NUMBER, H.NULL),
}
STRICT = ("question_text", "question_type", "options")
#: Leaves that the tiles of a page may have, and items that a leaf may have.
LEAVES, MOST_ITEMS = 4, 100_000


def replied() -> Column:
    return F.try_parse_json(strip_fences(F.col("reply")))


def place(tile: Column) -> Column:
    """The order of a page's tiles (their way of halves): the first leaf below."""
    return F.conv(F.rpad(tile, LEAVES.bit_length() - 1, "0"), 2, 10).cast("long")


def parse_items(replies: DataFrame) -> DataFrame:
    """replies (paper_id, page, reply, and tile where a page was read in parts) to
    items, one row each, or one row with an error where the reply is no object
    with a list of questions, or where one of them is no object or has no number:
    that rejects the whole reply. The page is the real one, whatever the model
    claims. misfits tells fields of another type than expected, with their path."""
    keys = ["paper_id", "page", *(c for c in ("tile",) if c in replies.columns)]
    rows = replies.select(*keys, replied().alias("r"))
    rows = rows.select(*keys, F.try_variant_get(H.member(F.col("r"), "questions"), "$", "array<variant>").alias("questions"))
    number = H.as_text(H.member(F.col("q"), "question_number"))
    wrong = (
        F.when(F.col("questions").isNull(), "the reply is no object with a list of questions")
        .when(F.exists("questions", lambda q: F.coalesce(H.kind_of(q) != H.OBJECT, F.lit(True))), "an item is no object")
        .when(F.exists("questions", lambda q: F.coalesce(H.as_text(H.member(q, "question_number")), F.lit("")) == ""), "an item has no question_number")
    )
    rows = rows.withColumn("error", wrong)
    good = rows.where("error is null").select(*keys, F.posexplode("questions").alias("pos", "q"))
    # each field is taken out once, and read in the next step
    held = good.select(*keys, "pos", number.alias("number"), *(H.member(F.col("q"), n).alias(n) for n in EXPECTED if n not in ("question_number", "options[]")), H.misfits(F.col("q"), EXPECTED, F.concat(F.lit("questions["), F.col("pos").cast("string"), F.lit("]"))).alias("misfits"))
    text = F.coalesce(H.as_text(F.col("question_text")), F.lit(""))
    kind = H.as_text(F.col("question_type"))
    listed = F.try_variant_get("options", "$", "array<variant>")
    section = F.nullif(F.replace(F.upper(F.trim(H.as_text(F.col("section")))), F.lit("SECTION "), F.lit("")), F.lit(""))
    leaf = F.col("page").cast("long") * LEAVES + (place(F.col("tile")) if "tile" in keys else 0)
    items = held.select(
        *keys, (leaf * MOST_ITEMS + F.col("pos")).alias("idx"), "number", text.alias("text"), H.as_text(F.col("marks")).alias("marks"),
        F.when(kind.isin(*P.VISION_TYPES), kind).otherwise("unknown").alias("kind"),
        F.coalesce(F.transform(listed, H.as_text), F.array().cast("array<string>")).alias("options"),
        F.coalesce(F.when(H.kind_of(F.col("confidence")) == H.NUMBER, F.try_variant_get("confidence", "$", "double")), F.lit(0.0)).alias("confidence"), section.alias("section"),
        H.truthy(F.col("has_figure")).alias("has_figure"), F.coalesce(H.as_text(F.col("choice_group")), F.when(text.rlike(r"\bOR\b"), F.col("number"))).alias("choice_group"),
        "misfits", F.lit(None).cast("string").alias("error"),
    )
    bad = rows.where("error is not null").select(*keys, "error")
    return items.unionByName(bad, allowMissingColumns=True)


def schema_findings(items: DataFrame) -> DataFrame:
    """Diagnostics of items' misfits: errors of fields that must have their type,
    warnings of those that are read whatever they hold."""
    told = items.select("paper_id", "page", "number", F.explode("misfits").alias("m"))
    strict = F.regexp_extract("m.path", r"^questions\[[0-9]+\]\.([a-z_]+)", 1).isin(*STRICT)
    said = F.concat("m.path", F.lit(": expected "), "m.expected", F.lit(", found "), "m.found")
    finding = diagnostics.finding(SCHEMA_INVALID, "error", said, F.col("page"), F.col("number"))
    return told.select(*(F.when(strict, "error").otherwise("warning").alias("severity") if k == 2 else c for k, c in enumerate(finding)))


def reply_metadata(replies: DataFrame) -> DataFrame:
    """(paper_id, page, subject, class, board) that each reply states, and its tile."""
    keys = ["paper_id", "page", *(c for c in ("tile",) if c in replies.columns)]
    rows = replies.select(*keys, H.member(replied(), "metadata").alias("m"))
    return rows.select(*keys, *(H.as_text(H.member(F.col("m"), n)).alias(n) for n in ("subject", "class", "board")))


def canonical_marks(marks: Column) -> Column:
    """Whole numbers only; anything else is unknown."""
    n = marks.try_cast("double")
    return F.when(n == F.floor(n), n.cast("int"))


def canonical(items: DataFrame) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for pair in P.VISION_TYPES.items() for x in pair))
    sound = items.where("error is null") if "error" in items.columns else items
    return sound.select("paper_id", "page", "idx", "number", "section", "text", canonical_marks(F.col("marks")).alias("marks"), F.coalesce(F.get(F.array(kinds), F.lit(0))[F.col("kind")], F.lit("short")).alias("type"), F.when(F.size("options") > 0, F.col("options")).alias("options"), "has_figure", "choice_group", "confidence")


def option_label(option: Column) -> Column:
    return F.upper(F.regexp_extract(F.coalesce(option, F.lit("")), r"^\s*\(([A-Za-z])\)", 1))


def option_union(lists: Column) -> Column:
    """Options of an array of lists, in order; the first spelling of a label
    stays; options without a label always stay."""
    flat = F.flatten(lists)
    step = lambda got, o: F.when((option_label(o) != "") & F.exists(got, lambda g: option_label(g) == option_label(o)), got).otherwise(F.concat(got, F.array(o)))
    return F.aggregate(flat, F.array().cast("array<string>"), step)


def in_order(*names: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("idx", *names)))


def field(name: str) -> Column:
    return F.transform("all", lambda x: x[name])


def first_known(name: str) -> Column:
    return F.get(F.filter(field(name), lambda x: x.isNotNull()), F.lit(0))


def merge_tiles(items: DataFrame, keys: tuple[str, ...] = ("paper_id", "page")) -> DataFrame:
    """Items of the overlapping tiles of a page (or of what keys name), one for each number: options
    united, texts joined unless one holds the other, first known marks and
    section, least confidence, a figure if any has one; all else is the first
    item's. Numbers and texts are compared without white space around them."""
    number, head = trimmed(F.col("number")), F.substring(trimmed(F.col("text")), 1, 200)
    every = [c for c in items.columns if c not in keys]
    once = items.groupBy(*keys, number.alias("key"), head.alias("head"), F.col("options").alias("key_options")).agg(F.min_by(F.struct(*every), "idx").alias("i"))
    groups = once.select(*keys, "key", "i.*").groupBy(*keys, "key").agg(in_order(*(c for c in every if c != "idx")).alias("all"))
    text = F.aggregate(field("text"), F.lit(None).cast("string"), lambda a, b: F.when(a.isNull(), b).when(F.contains(a, b), a).when(F.contains(b, a), b).otherwise(F.trim(F.concat(a, F.lit(" "), b))))
    folded = {"text": text, "marks": first_known("marks"), "options": option_union(field("options")), "confidence": F.array_min(field("confidence")), "section": first_known("section"), "has_figure": F.exists("all", lambda x: x["has_figure"])}
    return groups.select(*keys, *(folded.get(c, F.col("all")[0][c]).alias(c) for c in every))


LABELS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def united_options(options: Column, idx: Column) -> Column:
    """The option union of a group, as one aggregate: the first option of each
    label, and all without one, in order. Labels are combined before any shuffle;
    only options without a label are listed, which the result holds anyway."""
    placed = F.transform(F.coalesce(options, F.array().cast("array<string>")), lambda o, k: F.struct(idx.alias("idx"), k.alias("k"), o.alias("o")))
    first = [F.min(F.get(F.filter(placed, lambda x: option_label(x["o"]) == label), F.lit(0))) for label in LABELS]
    free = F.flatten(F.collect_list(F.filter(placed, lambda x: option_label(x["o"]) == "")))
    return F.transform(F.array_sort(F.concat(F.filter(F.array(*first), lambda x: x.isNotNull()), free)), lambda x: x["o"])


def dedupe_by_text(items: DataFrame) -> DataFrame:
    """One item for each wording of a page: the first, whole; options united,
    first known marks, least confidence. Texts without any [a-z0-9] have no key
    and all stay. A wording that very many items share is combined as it is read,
    not gathered."""
    every = [c for c in items.columns if c not in ("paper_id", "page")]
    keyed = items.withColumn("key", text_key(F.col("text"))).withColumn("own", F.when(F.col("key") == "", F.col("idx")))
    first = F.min_by(F.struct(*every), "idx").alias("i")
    folded = {"marks": F.min_by("marks", F.when(F.col("marks").isNotNull(), F.col("idx"))).alias("f_marks"), "confidence": F.min("confidence").alias("f_confidence"), "options": united_options(F.col("options"), F.col("idx")).alias("f_options")}
    groups = keyed.groupBy("paper_id", "page", "key", "own").agg(first, *folded.values())
    return groups.select("paper_id", "page", *(F.col(f"f_{c}").alias(c) if c in folded else F.col("i")[c].alias(c) for c in every))


def dedupe_across_pages(items: DataFrame) -> DataFrame:
    """The first item of each number and wording of a paper."""
    key = F.substring(joined(F.col("text")), 1, 200)
    rest = [c for c in items.columns if c not in ("paper_id", "number")]
    return items.groupBy("paper_id", "number", key.alias("key")).agg(F.min_by(F.struct(*rest), "idx").alias("i")).select("paper_id", "number", *(F.col("i")[c].alias(c) for c in rest))


def merge_metadata(pages: DataFrame, keys: tuple[str, ...] = ("subject", "class", "board")) -> DataFrame:
    """The first value of each key that isn't empty, in the order of pages and
    their tiles."""
    at = F.struct("page", place(F.col("tile")).alias("tile")) if "tile" in pages.columns else F.col("page")
    return pages.groupBy("paper_id").agg(*(F.min_by(k, F.when(F.coalesce(F.col(k), F.lit("")) != "", at)).alias(k) for k in keys))


def confidences(items: DataFrame) -> DataFrame:
    """The last confidence of each number."""
    return items.where("confidence is not null").groupBy("paper_id", "number").agg(F.max_by("confidence", "idx").alias("confidence"))
