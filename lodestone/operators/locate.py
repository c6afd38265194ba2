"""Dictionary lookups: which strings, types, methods and fields a pattern names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..plans.model import CodeModel

KINDS = ("string", "type", "method", "field")


@dataclass(frozen=True)
class FindQuery:
    """What to look for.

    name: a string's pattern, a type's pattern, or a member's name. class_name: for members. exact_name and
    fuzzy_class choose equality or search. mode: "literal" searches substrings, "regex" Java regular expressions; both
    look at one value at a time.
    """

    kind: str
    name: str | None = None
    class_name: str | None = None
    exact_name: bool = False
    fuzzy_class: bool = False
    mode: str = "literal"

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        if self.kind in ("method", "field") and not self.name and not self.class_name:
            raise ValueError("a class or a name is required")


def fits(column: Column, pattern: str, mode: str) -> Column:
    return column.rlike(pattern) if mode == "regex" else F.contains(column, F.lit(pattern))


def strings(model: CodeModel, q: FindQuery) -> DataFrame:
    """An empty pattern names every string."""
    found = model.strings if not q.name else model.strings.where(F.col("value") == q.name if q.exact_name else fits(F.col("value"), q.name, q.mode))
    return found.select("dex_id", F.col("string_idx").alias("ref_idx"), F.col("value").alias("label"))


def types(model: CodeModel, q: FindQuery) -> DataFrame:
    """An empty pattern names no type."""
    if not q.name:
        found = model.types.where("false")
    elif q.exact_name:
        found = model.types.where(F.col("descriptor") == names.class_descriptor(F.lit(q.name)))
    else:
        pattern = q.name.replace(".", "/") if q.mode == "literal" and "/" not in q.name else q.name
        found = model.types.where(fits(F.col("descriptor"), pattern, q.mode))
    return found.select("dex_id", F.col("type_idx").alias("ref_idx"), F.col("descriptor").alias("label"))


def members(model: CodeModel, q: FindQuery) -> DataFrame:
    """Methods or fields by class (absent, exact, fuzzy) and name (absent, part, exact)."""
    df = model.methods if q.kind == "method" else model.fields
    if q.class_name:
        if q.fuzzy_class:
            pattern = q.class_name.replace(".", "/") if "/" not in q.class_name and q.mode == "literal" else q.class_name
            df = df.where(fits(F.col("class_name"), pattern, q.mode))
        else:
            df = df.where(F.col("class_name") == names.class_descriptor(F.lit(q.class_name)))
    if q.name:
        df = df.where(F.col("name") == q.name if q.exact_name else fits(F.col("name"), q.name, q.mode))
    idx = "method_idx" if q.kind == "method" else "field_idx"
    label = names.method_label if q.kind == "method" else names.field_label
    return df.select("dex_id", F.col(idx).alias("ref_idx"), label(F.col("class_name"), F.col("name"), F.col("descriptor")).alias("label"))


def locate(model: CodeModel, q: FindQuery) -> DataFrame:
    """(dex_id, ref_idx, label) of what a query names."""
    return {"string": strings, "type": types}.get(q.kind, members)(model, q)


def list_classes(model: CodeModel, prefix: str | None = None) -> DataFrame:
    """Defined classes in the order of entries, containers and definitions; duplicates stay."""
    df = model.class_defs
    if prefix is not None:
        df = df.where(F.col("class_name").startswith(names.class_prefix(F.lit(prefix))))
    # The order is that of three numbers; they come along, for a DataFrame keeps no order of itself.
    return df.join(model.dex, "dex_id").select("entry_ord", "logical_ord", "class_def_ord", "dex_name", "class_name")


def class_filter(model: CodeModel, text: str, limit: int) -> DataFrame:
    """The first classes whose dotted name holds the text, whatever its case; none for a blank text."""
    text = text.strip().lower()
    name = names.dotted(F.col("class_name"))
    found = model.class_defs.select(name.alias("class_display")).distinct().where(F.contains(F.lower("class_display"), F.lit(text)) if text else F.lit(False))
    return found.orderBy("class_display").limit(limit)


def first_dex_of_class(model: CodeModel) -> DataFrame:
    """Each class with the DEX that defines it first."""
    order = Window.partitionBy("class_name").orderBy("entry_ord", "logical_ord", "class_def_ord")
    df = model.class_defs.join(model.dex, "dex_id").withColumn("nth", F.row_number().over(order))
    return df.where("nth = 1").select("class_name", "dex_name")


def defines_class(model: CodeModel, name: str) -> DataFrame:
    """The DEX files that define a class."""
    defs = model.class_defs.where(F.col("class_name") == names.class_descriptor(F.lit(name)))
    return model.dex.join(defs, "dex_id", "left_semi").select("dex_name")


def find_class(model: CodeModel, name: str) -> DataFrame:
    """The definition of a class that comes first."""
    defs = model.class_defs.where(F.col("class_name") == names.class_descriptor(F.lit(name)))
    return defs.join(model.dex, "dex_id").orderBy("entry_ord", "logical_ord", "class_def_ord").limit(1)


def extends(model: CodeModel, name: str) -> DataFrame:
    """Classes whose superclass, in their own DEX, is the named one."""
    target = model.types.where(F.col("descriptor") == names.class_descriptor(F.lit(name))).select("dex_id", F.col("type_idx").alias("superclass_idx"), F.col("descriptor").alias("target"))
    return model.class_defs.join(target, ["dex_id", "superclass_idx"]).join(model.dex, "dex_id").select("dex_name", "class_def_ord", "class_name", "target")


def implements(model: CodeModel, name: str) -> DataFrame:
    """Classes that list the named interface."""
    target = model.types.where(F.col("descriptor") == names.class_descriptor(F.lit(name))).select("dex_id", F.col("type_idx").alias("i"), F.col("descriptor").alias("target"))
    listed = model.class_defs.select("dex_id", "class_def_ord", "class_name", F.explode(F.array_distinct("interface_type_idxs")).alias("i"))
    return listed.join(target, ["dex_id", "i"]).join(model.dex, "dex_id").select("dex_name", "class_def_ord", "class_name", "target")


def search_members(model: CodeModel, kind: str, text: str, limit: int = 5000) -> DataFrame:
    """The first ``limit`` members whose name holds the text, and total_hits of all of them."""
    df = model.methods if kind == "method" else model.fields
    idx = "method_idx" if kind == "method" else "field_idx"
    hits = df.where(F.contains("name", F.lit(text))).join(model.dex, "dex_id")
    total = hits.agg(F.count("*").alias("total_hits"))
    # orderBy + limit is a top-k of each task and of their results; the total is one combined count.
    top = hits.orderBy("entry_ord", "logical_ord", idx).limit(limit).select("dex_name", F.col(idx).alias("member_idx"), "class_name", "name", "descriptor")
    return top.join(F.broadcast(total))
