"""Values of manifest attributes. An attribute is (name, raw_value, kind, s, b, i) with kind String, Boolean, Integer, Hex or
Reference; strings are in ``s``, booleans in ``b``, the others in ``i``. Of attributes of one name the first counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ATTRIBUTES = "array<struct<name:string,raw_value:string,kind:string,s:string,b:boolean,i:bigint>>"


def attribute(attrs: Column, name: str) -> Column:
    return F.try_element_at(F.filter(attrs, lambda a: a["name"] == name), F.lit(1))


def value_text(a: Column) -> Column:
    """An attribute's value as text."""
    k, i = a["kind"], a["i"]
    low = F.lower(F.hex(i))
    return (
        F.when(k == "String", a["s"])
        .when(k == "Boolean", a["b"].cast("string"))
        .when(k == "Integer", i.cast("string"))
        .when(k == "Hex", F.concat(F.lit("0x"), low))
        .when(k == "Reference", F.concat(F.lit("@0x"), F.when(F.length(low) < 8, F.lpad(low, 8, "0")).otherwise(low)))
    )


def attribute_values(attrs: Column) -> Column:
    """The attributes as a map from name to (text, flag), of one name the first. Made once for each element, so that a summary's
    many look-ups don't go through the list each time."""
    names = F.transform(attrs, lambda a: a["name"])
    first = F.filter(attrs, lambda a, i: a["name"].isNotNull() & (F.array_position(names, a["name"]) == i + 1))
    return F.map_from_entries(F.transform(first, lambda a: F.struct(a["name"].alias("name"), F.struct(value_text(a).alias("text"), value_flag(a).alias("flag")).alias("value"))))


def text(values: Column, *names: str) -> Column:
    """The first of the named attributes that is there, as text (P12, P15); ``values`` is a map of ``attribute_values``."""
    found = [values[n]["text"] for n in names]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def value_flag(a: Column) -> Column:
    """An attribute's value as a boolean, null for what is none."""
    return F.when(a["kind"] == "Boolean", a["b"]).when(a["kind"] == "Integer", a["i"] != 0).when((a["kind"] == "String") & a["s"].isin("true", "false"), a["s"] == "true")


def flag(values: Column, name: str) -> Column:
    return values[name]["flag"]


def name_or_empty(values: Column) -> Column:
    """P16."""
    return F.coalesce(text(values, "android:name"), F.lit(""))


def version_code(attrs: Column) -> Column:
    """Integers and strings as they are, any other kind with the kind's name."""
    a = attribute(attrs, "android:versionCode")
    plain = F.when(a["kind"] == "Boolean", a["b"].cast("string")).otherwise(a["i"].cast("string"))
    return F.when(a["kind"].isin("Integer", "String"), value_text(a)).otherwise(F.concat(a["kind"], F.lit("("), plain, F.lit(")")))
