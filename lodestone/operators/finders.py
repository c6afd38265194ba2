"""Finders by regular expression, cross references in both directions, and texts of ids.

Patterns are Java regular expressions matched from the start of a value, not necessarily to its end. Definitions and references are compared by
name, for what one DEX refers to another may define; each finder filters the dictionaries before it joins them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..plans.model import CodeModel
from . import graph

#: What stands for ids without an entry.
NO_STRING, NO_TYPE = "AG:IS: invalid string", "AG:ITI: invalid type"
ANY = ".*"


def begins(column: str, pattern: str) -> Column:
    return F.lit(True) if pattern == ANY else F.col(column).rlike(f"^(?:{pattern})")


def find_classes(model: CodeModel, name: str = ANY, no_external: bool = False) -> DataFrame:
    """(class_name, is_external) of classes, defined or only named; arrays and primitives are none."""
    named = model.types.where(F.col("descriptor").startswith("L") & begins("descriptor", name)).select(F.col("descriptor").alias("class_name")).distinct()
    defined = model.class_defs.where(begins("class_name", name)).select("class_name").distinct().withColumn("defined", F.lit(True))
    found = named.join(defined, "class_name", "full").select("class_name", F.col("defined").isNull().alias("is_external"))
    return found.where("NOT is_external") if no_external else found


def _members(model: CodeModel, kind: str, class_name: str, name: str, descriptor: str, flags: str, no_external: bool) -> DataFrame:
    idx, kinds = ("method_idx", ["direct_method", "virtual_method"]) if kind == "method" else ("field_idx", ["static_field", "instance_field"])
    table = model.methods if kind == "method" else model.fields
    key = ["class_name", "name", "descriptor"]
    named = table.where(begins("class_name", class_name) & begins("name", name) & begins("descriptor", descriptor))
    own = model.class_members.where(F.col("kind").isin(kinds)).select("dex_id", F.col("member_idx").alias(idx), "access_flags")
    defined = named.select("dex_id", idx, *key).join(own, ["dex_id", idx]).groupBy(*key).agg(F.min("access_flags").alias("access_flags"))
    found = named.select(*key).distinct().join(defined, key, "left")
    found = found.select(*key, F.coalesce(F.array_join(names.access_names(F.col("access_flags").cast("long")), " "), F.lit("")).alias("flags"), F.col("access_flags").isNull().alias("is_external"))
    found = found.where(begins("flags", flags))
    return found.where("NOT is_external") if no_external else found


def find_methods(model: CodeModel, class_name: str = ANY, name: str = ANY, descriptor: str = ANY, flags: str = ANY, no_external: bool = False) -> DataFrame:
    """(class_name, name, descriptor, flags, is_external), once each. A method that no class has as a member is external, without flags."""
    return _members(model, "method", class_name, name, descriptor, flags, no_external)


def find_fields(model: CodeModel, class_name: str = ANY, name: str = ANY, descriptor: str = ANY, flags: str = ANY, no_external: bool = False) -> DataFrame:
    return _members(model, "field", class_name, name, descriptor, flags, no_external)


def find_strings(model: CodeModel, pattern: str = ANY, dex_id: object = None) -> DataFrame:
    """Distinct strings; of one DEX, if it is named."""
    table = model.strings if dex_id is None else model.strings.where(F.col("dex_id") == F.lit(dex_id))
    return table.where(begins("value", pattern)).select("value").distinct()


def external_methods(model: CodeModel) -> DataFrame:
    """(class_name, name, descriptor) of methods that are named but no class has as a member."""
    return find_methods(model).where("is_external").select("class_name", "name", "descriptor")


def xrefs(edges: DataFrame, given: dict[str, str | None], columns: list[str], places: bool) -> DataFrame:
    """Edges that have the given values (None: any): distinct, or each with its place."""
    for column, value in given.items():
        edges = edges.where(F.col(column) == value) if value is not None else edges
    return edges.select(*columns, "insn_off") if places else edges.select(*columns).distinct()


def callers(model: CodeModel, class_name: str, name: str | None = None, descriptor: str | None = None, places: bool = False) -> DataFrame:
    """Who calls a class's methods. places: a row for each call, with its place."""
    given = {"to_class": class_name, "to_name": name, "to_descriptor": descriptor}
    return xrefs(graph.call_edges(model), given, ["from_class", "from_name", "from_descriptor"], places)


def callees(model: CodeModel, class_name: str, name: str | None = None, descriptor: str | None = None, places: bool = False) -> DataFrame:
    """Whom a class's methods call."""
    given = {"from_class": class_name, "from_name": name, "from_descriptor": descriptor}
    return xrefs(graph.call_edges(model), given, ["to_class", "to_name", "to_descriptor", "is_external"], places)


def string_users(model: CodeModel, value: str) -> DataFrame:
    """Methods that use one string, whatever its DEX."""
    return graph.string_edges(model, value).select("class_name", "method_name").distinct()


def field_users(model: CodeModel, class_name: str, name: str, access: str | None = None, places: bool = False) -> DataFrame:
    """Methods that read (``r``) or write (``w``) a field."""
    given = {"field_class": class_name, "field_name": name, "access": access}
    return xrefs(graph.field_edges(model), given, ["class_name", "method_name", "access"], places)


def class_users(model: CodeModel, class_name: str, kind: str | None = None) -> DataFrame:
    """Classes whose code makes (``new_instance``) or names (``const_class``) a class."""
    edges = graph.type_edges(model).where(F.col("to_class") == class_name)
    return (edges.where(F.col("kind") == kind) if kind else edges).select("from_class", "kind").distinct()


def texts(model: CodeModel, ids: DataFrame) -> DataFrame:
    """``ids`` (dex_id, ref_kind ``string`` or ``type``, ref_idx, ...) with the column text; ids without an entry get a text that says so."""
    strings = model.strings.select("dex_id", F.lit("string").alias("ref_kind"), F.col("string_idx").alias("ref_idx"), F.col("value").alias("text"))
    types = model.types.select("dex_id", F.lit("type").alias("ref_kind"), F.col("type_idx").alias("ref_idx"), F.col("descriptor").alias("text"))
    missing = F.when(F.col("ref_kind") == "string", NO_STRING).when(F.col("ref_kind") == "type", NO_TYPE)
    return ids.join(strings.union(types).hint("merge"), ["dex_id", "ref_kind", "ref_idx"], "left").withColumn("text", F.coalesce("text", missing))


def outer_classes(model: CodeModel) -> DataFrame:
    """(class_name, outer, outermost) of inner classes: the nearest and the farthest defined class whose name theirs continues with ``$``."""
    every = model.class_defs.select("class_name").distinct()
    body = F.substring("class_name", F.lit(1), F.length("class_name") - 1)
    parts = F.split(body, r"\$")
    inner = every.where(F.size(parts) > 1).select("class_name", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("n"), parts.alias("p"))
    inner = inner.select("class_name", "n", F.concat(F.array_join(F.slice("p", 1, F.col("n")), "$"), F.lit(";")).alias("outer"))
    known = inner.join(every.withColumnRenamed("class_name", "outer"), "outer", "left_semi")
    return known.groupBy("class_name").agg(F.max_by("outer", "n").alias("outer"), F.min_by("outer", "n").alias("outermost"))


def code_regions(model: CodeModel) -> DataFrame:
    """(dex_id, begin, end) of the places where a DEX's bodies begin."""
    return model.owners.groupBy("dex_id").agg(F.min("code_off").alias("begin"), F.max("code_off").alias("end"))


def linkable(model: CodeModel, rows: DataFrame, class_col: str) -> DataFrame:
    """Rows whose class is defined in the archives."""
    return rows.join(model.class_defs.select(F.col("class_name").alias(class_col)).distinct(), class_col, "left_semi").select(*rows.columns)
