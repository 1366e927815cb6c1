"""Reading loosely shaped JSON held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def get(doc: Column, path: str, dtype: str) -> Column:
    return F.try_variant_get(doc, "$." + path, dtype)


def text(doc: Column, path: str) -> Column:
    return get(doc, path, "string")


def _refused(what: str, text: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"unreadable {what}: "), F.coalesce(text, F.lit("null"))))


def whole(text: Column, name: str) -> Column:
    """A count out of its JSON text: missing, null and empty are 0, ``1000.0`` and ``"1000"`` are 1000, anything else
    stops the load. Nothing is read as 0 without a word."""
    plain, number = text.try_cast("bigint"), text.try_cast("double")
    return (
        F.when(text.isNull() | (F.trim(text) == ""), F.lit(0).cast("bigint"))
        .when(plain.isNotNull(), plain)
        .when(F.abs(number) < 9e18, number.cast("bigint"))
        .otherwise(_refused(f"number in {name}", text).cast("bigint"))
    )


def real(text: Column, name: str) -> Column:
    """An amount out of its text, by the same rules."""
    number = text.try_cast("double")
    return (
        F.when(text.isNull() | (F.trim(text) == ""), F.lit(0.0))
        .when(F.abs(number) < F.lit(float("inf")), number)
        .otherwise(_refused(f"amount in {name}", text).cast("double"))
    )


def moment(text: Column) -> Column:
    """Unix seconds or ISO-8601 as text -> TIMESTAMP in UTC; anything else, null included, stops the load."""
    seconds = text.try_cast("double")
    return (
        F.when(seconds.isNotNull(), F.timestamp_seconds(seconds))
        .when(F.try_to_timestamp(text).isNotNull(), F.try_to_timestamp(text))
        .otherwise(_refused("timestamp", text).cast("timestamp"))
    )


_NUMBERS = r"^(tinyint|smallint|int|bigint|float|double|decimal.*)$"


def kind_of(value: Column) -> Column:
    """'number', 'string', 'boolean', 'object', 'array', 'null'; SQL NULL when the value is absent.

    For scalars. On large values use the tests below: the schema of a variant covers all of its content.
    """
    name = F.lower(F.substring_index(F.schema_of_variant(value), "<", 1))
    return F.replace(F.regexp_replace(name, _NUMBERS, "number"), F.lit("void"), F.lit("null"))


def as_object(value: Column) -> Column:
    """Fields of an object; NULL for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def as_list(value: Column) -> Column:
    """Elements of a list; NULL for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def has_key(doc: Column, key: str) -> Column:
    return get(doc, key, "variant").isNotNull()


def instant(value: Column) -> Column:
    """Unix seconds (a JSON number) or ISO-8601 text -> TIMESTAMP in UTC; anything else stops the load."""
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(kind_of(value) == "number", F.timestamp_seconds(F.try_variant_get(value, "$", "double")))
        .when(F.try_to_timestamp(text).isNotNull(), F.try_to_timestamp(text))
        .otherwise(_refused("timestamp", text).cast("timestamp"))
    )
