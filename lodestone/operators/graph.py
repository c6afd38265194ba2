"""Edges of the code graph, hierarchy and packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions import names
from ..plans.model import CodeModel

READS = [*range(0x52, 0x59), *range(0x60, 0x67)]
WRITES = [*range(0x59, 0x60), *range(0x67, 0x6E)]
INVOKES = [*range(0x6E, 0x73), *range(0x74, 0x79)]


def call_edges(model: CodeModel) -> DataFrame:
    """Calls with caller and callee; is_external tells that the callee's class isn't defined anywhere."""
    calls = model.refs.where(F.col("opcode").isin(INVOKES)).select("dex_id", "code_off", "insn_off", F.col("ref_idx").alias("callee_idx"))
    targets = model.methods.select("dex_id", F.col("method_idx").alias("callee_idx"), F.col("class_name").alias("to_class"), F.col("name").alias("to_name"), F.col("descriptor").alias("to_descriptor"))
    callers = model.owners.select("dex_id", "code_off", F.col("class_name").alias("from_class"), F.col("method_name").alias("from_name"), F.col("method_descriptor").alias("from_descriptor"), "method_idx")
    defined = model.class_defs.select(F.col("class_name").alias("to_class")).distinct().withColumn("defined", F.lit(True))
    edges = calls.join(targets, ["dex_id", "callee_idx"]).join(callers, ["dex_id", "code_off"])
    edges = edges.join(defined, "to_class", "left")
    return edges.select("dex_id", "from_class", "from_name", "from_descriptor", "method_idx", "to_class", "to_name", "to_descriptor", "callee_idx", "insn_off", F.col("defined").isNull().alias("is_external"))


def callers_of(model: CodeModel) -> DataFrame:
    """Calls without their places: distinct (callee, caller)."""
    return call_edges(model).select("to_class", "to_name", "from_class", "from_name").distinct()


def field_edges(model: CodeModel) -> DataFrame:
    """Reads and writes of fields: the accessing method, the declaring class, and access r or w."""
    access = F.when(F.col("opcode").isin(READS), "r").when(F.col("opcode").isin(WRITES), "w")
    uses = model.refs.where("ref_kind = 'field'").withColumn("access", access).where("access IS NOT NULL").select("dex_id", "code_off", "insn_off", "access", F.col("ref_idx").alias("field_idx"))
    named = model.fields.select("dex_id", "field_idx", F.col("class_name").alias("field_class"), F.col("name").alias("field_name"))
    return uses.join(named, ["dex_id", "field_idx"]).join(model.owners, ["dex_id", "code_off"]).select("dex_id", "class_name", "method_name", "method_idx", "field_class", "field_name", "field_idx", "access", "insn_off")


def _owned(model: CodeModel, uses: DataFrame) -> DataFrame:
    """All of ``uses`` (dex_id, code_off, ...) with their owners."""
    uses, owners = session.spread(["dex_id", "code_off"], uses, model.owners)
    return uses.join(owners, ["dex_id", "code_off"])


def string_edges(model: CodeModel, value: str | None = None) -> DataFrame:
    """Which methods use which strings, once each. All strings are merged, never broadcast: Spark takes their size from files, which may be a
    hundredth of that in memory. ``value`` names one string."""
    uses = model.refs.where("ref_kind = 'string'").select("dex_id", "code_off", F.col("ref_idx").alias("string_idx")).distinct()
    strings = model.strings.hint("merge") if value is None else model.strings.where(F.col("value") == value)
    return _owned(model, uses.join(strings, ["dex_id", "string_idx"])).select("dex_id", "method_idx", "class_name", "method_name", "string_idx", "value").distinct()


def type_edges(model: CodeModel) -> DataFrame:
    """Classes made (new-instance) or named (const-class) by a class's code; itself left out, arrays by their element."""
    uses = model.refs.where(F.col("opcode").isin(0x1C, 0x22)).select("dex_id", "code_off", "opcode", F.col("ref_idx").alias("type_idx"))
    named = uses.join(model.types.hint("merge"), ["dex_id", "type_idx"]).withColumn("to_class", names.reference_class(F.col("descriptor"))).where("to_class IS NOT NULL")
    kind = F.when(F.col("opcode") == 0x22, "new_instance").otherwise("const_class")
    return _owned(model, named).where("class_name <> to_class").select(F.col("class_name").alias("from_class"), "to_class", kind.alias("kind")).distinct()


def external_classes(model: CodeModel) -> DataFrame:
    """Named but nowhere defined."""
    return model.types.select("descriptor").distinct().join(model.class_defs.select(F.col("class_name").alias("descriptor")), "descriptor", "left_anti")


def external_in_dex(model: CodeModel) -> DataFrame:
    """Per DEX, how many of its types are defined in it and how many elsewhere."""
    here = model.class_defs.select("dex_id", F.col("class_type_idx").alias("type_idx")).withColumn("here", F.lit(1))
    both = model.types.join(here, ["dex_id", "type_idx"], "left")
    return both.groupBy("dex_id").agg(F.count("here").alias("internal"), F.count_if(F.col("here").isNull()).alias("external"))


def api_usage(model: CodeModel, is_api: Column) -> DataFrame:
    """Calls of methods whose class (column to_class) is an API by the given predicate, counted by target."""
    return call_edges(model).where(is_api).groupBy("to_class", "to_name").agg(F.count("*").alias("calls"), F.count_distinct("from_class").alias("classes"))


def extends_edges(model: CodeModel) -> DataFrame:
    """(class_name, super_name): by descriptors, for a superclass may be defined in another DEX."""
    supers = model.types.select("dex_id", F.col("type_idx").alias("superclass_idx"), F.col("descriptor").alias("super_name"))
    return model.class_defs.join(supers, ["dex_id", "superclass_idx"], "left").select("class_name", "super_name").distinct()


def _below(parents: DataFrame, level: DataFrame) -> DataFrame:
    """``level`` (class_name, depth, ...) and all levels below it, joined one at a time until one is empty.

    No path without a circle is longer than there are classes; rows beyond that raise an error. Each level's lineage is
    cut, so that deep hierarchies don't repeat the joins above.
    """
    session.reliable(level.sparkSession)
    kept = [c for c in level.columns if c not in ("class_name", "depth")]
    most = parents.select("class_name").distinct().count() + 1
    out, found = level, 0
    while not level.isEmpty():
        found += 1
        if found > most:
            raise ValueError("a class is its own superclass")
        up = level.withColumnRenamed("class_name", "super_name")
        level = parents.join(up, "super_name").select("class_name", (F.col("depth") + 1).alias("depth"), *kept)
        level = level.checkpoint()
        out = out.union(level)
    return out


def hierarchy(model: CodeModel) -> DataFrame:
    """(class_name, depth, root): distance from the topmost known superclass. A class without one is its own root.

    Levels are joined one at a time until none is left; Spark's recursive CTE would do the same, with limits on
    rows and levels. Only counts go to the driver.
    """
    edges = extends_edges(model).cache()
    defined = edges.select("class_name").distinct()
    parents = edges.where("super_name IS NOT NULL")
    orphans = parents.join(defined.withColumnRenamed("class_name", "super_name"), "super_name", "left_anti").select("class_name")
    level = edges.where("super_name IS NULL").select("class_name").union(orphans).distinct().select("class_name", F.lit(1).alias("depth"), F.col("class_name").alias("root"))
    out = _below(parents, level)
    return out.select("class_name", F.col("depth").cast("long").alias("depth"), "root")


def descendants(model: CodeModel, name: str) -> DataFrame:
    """All classes below the named one, with their distance."""
    parents = extends_edges(model).where("super_name IS NOT NULL").cache()
    level = parents.where(F.col("super_name") == name).select("class_name", F.lit(1).cast("long").alias("depth"))
    return _below(parents, level)


def package_children(model: CodeModel) -> DataFrame:
    """(package, child): each package's direct sub-packages; the root is the empty package."""
    parts = F.split(names.package_of(F.col("class_name")), "/")
    prefixes = model.class_defs.where(names.package_of(F.col("class_name")) != "").select(parts.alias("p")).distinct()
    pairs = prefixes.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    path = lambda n: F.array_join(F.slice("p", 1, n), "/")
    return pairs.select(F.when(F.col("n") > 1, path(F.col("n") - 1)).otherwise(F.lit("")).alias("package"), path(F.col("n")).alias("child")).distinct()


def package_classes(model: CodeModel) -> DataFrame:
    """(package, simple_name, place): the classes of a package in the order of their lower-case names."""
    from pyspark.sql import Window

    rows = model.class_defs.select(names.package_of(F.col("class_name")).alias("package"), names.simple_name(F.col("class_name")).alias("simple_name")).distinct()
    order = Window.partitionBy("package").orderBy(F.lower("simple_name"), "simple_name")
    return rows.withColumn("place", (F.row_number().over(order) - 1).cast("long"))
