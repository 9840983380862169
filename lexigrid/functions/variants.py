"""Typed reads of VARIANT members: a member of another type counts as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, BOOLEAN, VOID and so on; null for a missing value."""
    s = F.schema_of_variant(v)
    return F.when(s.startswith("OBJECT"), "OBJECT").when(s.startswith("ARRAY"), "ARRAY").otherwise(s)


def member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _typed(v: Column, name: str, kinds: list[str], as_type: str, default) -> Column:
    m = member(v, name)
    got = F.when(kind(m).isin(kinds), F.try_variant_get(v, f"$['{name}']", as_type))
    return got if default is None else F.coalesce(got, default if isinstance(default, Column) else F.lit(default))


def get_string(v: Column, name: str, default=None) -> Column:
    return _typed(v, name, ["STRING"], "string", default)


def get_int(v: Column, name: str, default=None) -> Column:
    return _typed(v, name, ["BIGINT"], "bigint", default)


def get_bool(v: Column, name: str, default=None) -> Column:
    return _typed(v, name, ["BOOLEAN"], "boolean", default)


def get_object(v: Column, name: str) -> Column:
    m = member(v, name)
    return F.when(kind(m) == "OBJECT", m)


def get_array(v: Column, name: str) -> Column:
    m = member(v, name)
    return F.when(kind(m) == "ARRAY", m)
