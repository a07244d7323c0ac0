"""Numbers and strings out of JSON whose types cannot be trusted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(value: Column, path: str) -> tuple[Column, Column]:
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    return kind, F.try_variant_get(value, path, "string")


def _number(kind: Column) -> Column:
    return kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")


def lenient_long(value: Column, path: str) -> Column:
    """A whole number: a number is cut towards zero, a string must be a whole number, anything else is null."""
    kind, text = _at(value, path)
    return F.when(kind == "STRING", F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))).when(_number(kind), text.try_cast("double").try_cast("bigint"))


def lenient_double(value: Column, path: str) -> Column:
    """A number, or a string that is one; booleans and others are null."""
    kind, text = _at(value, path)
    return F.when((kind == "STRING") | _number(kind), text.try_cast("double"))


def lenient_string(value: Column, path: str) -> Column:
    """A string, or a whole number as one."""
    kind, text = _at(value, path)
    return F.when((kind == "STRING") | kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT)"), text).when(kind.rlike(r"^DECIMAL\(\d+,0\)"), text)


def lenient_boolean(value: Column, path: str) -> Column:
    """True only for a JSON true."""
    kind, text = _at(value, path)
    return F.coalesce((kind == "BOOLEAN") & (text == "true"), F.lit(False))
