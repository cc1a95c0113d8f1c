"""Shapes of model output: what a field holds, and what it should hold.

A field is read as a VARIANT, so that a value of another type than expected is
seen, and told with its path, where a typed read would only give null."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: JSON types as findings name them.
NULL, BOOLEAN, NUMBER, STRING, ARRAY, OBJECT = "null", "boolean", "number", "string", "array", "object"


def kind_of(value: Column) -> Column:
    """The JSON type of a VARIANT; null where there is no value."""
    said = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), None).when(said == "VOID", NULL).when(said == "BOOLEAN", BOOLEAN).when(said == "STRING", STRING)
        .when(said.startswith("ARRAY"), ARRAY).when(said.startswith("OBJECT"), OBJECT).otherwise(NUMBER)
    )


def member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def as_text(value: Column) -> Column:
    """A value's text; arrays and objects as JSON."""
    return F.when(kind_of(value).isin(ARRAY, OBJECT), F.to_json(value)).otherwise(F.try_variant_get(value, "$", "string"))


def truthy(value: Column) -> Column:
    """False for what is missing, null, false, zero or empty; true for all else,
    texts like "no" among it."""
    kind = kind_of(value)
    return F.coalesce(
        F.when(kind == BOOLEAN, F.try_variant_get(value, "$", "boolean")).when(kind == NUMBER, F.try_variant_get(value, "$", "double") != 0)
        .when(kind == STRING, F.try_variant_get(value, "$", "string") != "").when(kind.isin(ARRAY, OBJECT), ~F.to_json(value).isin("[]", "{}")).otherwise(False),
        F.lit(False),
    )


def texts(value: Column) -> Column:
    """An array of texts, or null where one is something else."""
    listed = F.try_variant_get(value, "$", "array<variant>")
    return F.when(F.forall(listed, lambda x: kind_of(x) == STRING), F.transform(listed, lambda x: F.try_variant_get(x, "$", "string")))


FOUND = "array<struct<path:string,expected:string,found:string>>"


def misfits(value: Column, expected: Mapping[str, tuple[str, ...]], path: Column) -> Column:
    """Findings (path, expected, found) of an object's fields that hold another
    type than one of those expected; a missing field is none. Elements of an array
    of which `name[]` is expected are looked at one by one."""
    found = []
    for name, kinds in expected.items():
        if name.endswith("[]"):
            listed = F.coalesce(F.try_variant_get(member(value, name[:-2]), "$", "array<variant>"), F.array().cast("array<variant>"))
            told = F.transform(listed, lambda x, i: F.struct(F.concat(path, F.lit(f".{name[:-2]}["), i.cast("string"), F.lit("]")).alias("path"), F.lit(" or ".join(kinds)).alias("expected"), F.coalesce(kind_of(x), F.lit(NULL)).alias("found")))
            found.append(F.filter(told, lambda x: ~x["found"].isin(*kinds)))
            continue
        kind = kind_of(member(value, name))
        told = F.struct(F.concat(path, F.lit(f".{name}")).alias("path"), F.lit(" or ".join(kinds)).alias("expected"), kind.alias("found"))
        found.append(F.when(~kind.isin(*kinds), F.array(told)).otherwise(F.array().cast(FOUND)))
    return F.concat(*found)
