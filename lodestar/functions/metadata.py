"""Schemaless metadata, kept as JSON strings: typed equality and the string form of values."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(value: Mapping[str, Any] | None) -> str:
    """The canonical JSON of metadata."""
    return json.dumps(value or {}, separators=(",", ":"), ensure_ascii=False)


def _path(field: str) -> str:
    return "$['" + field.replace("'", "\\'") + "']"


def raw_value(metadata: Column, field: str) -> Column:
    """The field's value as text; null where it is absent or a JSON null."""
    return F.get_json_object(metadata, _path(field))


def kind_of(metadata: Column, field: str) -> Column:
    """STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, VOID, ARRAY<..> or OBJECT<..>; null where the field is absent."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(metadata), '$["' + field.replace('"', '\\"') + '"]', "variant"))


def as_text(metadata: Column, field: str) -> Column:
    """The field's value as text, booleans as True and False."""
    raw = raw_value(metadata, field)
    return F.when(kind_of(metadata, field) == "BOOLEAN", F.initcap(raw)).otherwise(raw)


def equals(metadata: Column, field: str, value: Any) -> Column:
    """Whether the field has that value, by type: 1, 1.0 and true are equal, "1" is another; None holds for an absent field."""
    raw, kind = raw_value(metadata, field), kind_of(metadata, field)
    if value is None:
        return raw.isNull()
    if isinstance(value, (bool, int, float)):
        number = F.when(kind == "BOOLEAN", (raw == "true").cast("double")).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), raw.try_cast("double"))
        return F.coalesce(number == F.lit(float(value)), F.lit(False))
    if isinstance(value, str):
        return F.coalesce((kind == "STRING") & (raw == value), F.lit(False))
    return F.coalesce(~kind.isin("STRING") & (raw == json.dumps(value, separators=(",", ":"), ensure_ascii=False)), F.lit(False))


def matches(metadata: Column, condition: Mapping[str, Any]) -> Column:
    """Whether all fields have the values of the condition; an empty one holds always."""
    out = F.lit(True)
    for field, value in condition.items():
        out = out & equals(metadata, field, value)
    return out


def predicate(metadata: Column, condition) -> Column:
    """A mapping, a column, an SQL string or a Python function of the metadata, as a column."""
    if condition is None:
        return F.lit(True)
    if isinstance(condition, Column):
        return condition
    if isinstance(condition, str):
        return F.expr(condition)
    if isinstance(condition, Mapping):
        return matches(metadata, condition)
    if callable(condition):

        @F.udf("boolean", useArrow=True)
        def holds(text: str | None) -> bool:
            return bool(condition(json.loads(text or "{}")))

        return holds(metadata)
    raise TypeError(f"no filter: {condition!r}")
