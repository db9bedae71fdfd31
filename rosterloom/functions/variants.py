"""Answers and claims of mixed types, read as variants: one column for strings, numbers and objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import as_col, json_object_in


def answer(response: Column | str) -> Column:
    """The JSON object inside a response as a variant; null if there is none or it is broken."""
    return F.try_parse_json(json_object_in(as_col(response)))


def first_claim(claims: Column, name: str) -> Column:
    """The first value of a claim that is not null, whatever type it has.

    A claim is a list of values; a single value counts as a list of one.
    """
    listed = F.try_variant_get(claims, f"$.{name}", "array<variant>")
    single = F.try_variant_get(claims, f"$.{name}", "variant")
    values = F.filter(F.coalesce(listed, F.array(single)), lambda v: v.isNotNull() & ~F.is_variant_null(v))
    return F.get(values, 0)


def claim_text(value: Column) -> Column:
    """A claim value as text: scalars as they are, an object's `value`, a list's first element."""
    return F.coalesce(F.try_variant_get(value, "$.value", "string"), F.try_variant_get(value, "$[0]", "string"),
                      F.try_variant_get(value, "$", "string"))


def claim_kind(value: Column) -> Column:
    """string, number, object or list (null for null)."""
    kind = F.schema_of_variant(value)
    return (F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "list")
            .when(kind == "STRING", "string").when(kind.isNotNull(), "number"))


def answer_fields(df: DataFrame, id_col: str, response: str) -> DataFrame:
    """(id, field, kind, value): one row for each field of each answer, values as JSON text.

    A response without a valid answer has one row without a field.
    """
    read = df.select(F.col(id_col), answer(response).alias("answer"))
    fields = df.sparkSession.tvf.variant_explode_outer(F.col("answer").outer())
    return read.lateralJoin(fields).select(
        id_col, F.col("key").alias("field"), claim_kind(F.col("value")).alias("kind"),
        F.to_json("value").alias("value"))
